"""Every catalogued query against its SQL in DuckDB, and rows for those that SQL cannot say."""

import pytest
from conftest import rows

from lodestack.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), duck.execute(catalog.SQL[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_inserted_text_takes_turns_of_any_length(spark, tmp_path):
    texts = ["a short turn with words", "many words " * 500]
    table = spark.createDataFrame([(k, 0, "user", x) for k, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.path, r.start, r.length) for r in catalog.inserted_text(spark, str(tmp_path)).collect()}
    assert got == {(f"/c/{k}.md#0", 10, 4) for k in range(len(texts))}
