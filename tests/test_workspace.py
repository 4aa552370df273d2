"""The workspace object end to end: attributed writes, versions, branches, merges, collection."""

from pyspark.sql import functions as F

from lodestack.operators import attribution
from lodestack.workspace import Workspace


def files(spark, **named):
    return spark.createDataFrame([(f"/{k.replace('_', '/')}.md", bytearray(v.encode())) for k, v in named.items()], "path string, data binary")


def bodies(ws):
    return {r.path: bytes(r.data).decode() for r in ws.read(ws.table("working").select("path")).collect()}


def test_versions_and_merges(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    ws.write(files(spark, a="1\n2\n3\n", d_b="x\n", e=""), 1, 1, 10)
    assert bodies(ws) == {"/a.md": "1\n2\n3\n", "/d/b.md": "x\n", "/e.md": ""}
    first = ws.commit("me", "first", 11)
    assert ws.status().count() == 0
    ws.create_branch("side", first)
    ws.write(files(spark, a="1\ntwo\n3\n"), 2, 5, 12)
    assert [tuple(r) for r in ws.status().collect()] == [("/a.md", "M")]
    runs = ws.table("working").join(ws.table("blame"), F.col("hash") == F.col("content_hash")).where("path = '/a.md'").first().runs
    assert [tuple(r) for r in runs] == [(1, 1, 2), (2, 5, 4), (1, 1, 2)]
    second = ws.commit("me", "second", 13)
    assert [r.message for r in ws.log().collect()] == ["second", "first"]
    ws.checkout(first)
    assert bodies(ws)["/a.md"] == "1\n2\n3\n"
    ws.write(files(spark, a="1\n2\n3\nfour\n", d_c="new\n"), 3, 0, 14)
    ws.commit("you", "third", 15, "side")
    ws.checkout(second)
    assert ws.merge("side", "me", 16) == ("merged", [])
    assert bodies(ws) == {"/a.md": "1\ntwo\n3\nfour\n", "/d/b.md": "x\n", "/d/c.md": "new\n", "/e.md": ""}
    assert ws.merge("side", "me", 17)[0] == "up_to_date"
    ws.checkout(first)
    ws.write(files(spark, a="1\nZWEI\n3\n"), 3, 0, 18)
    ws.create_branch("clash", first)
    ws.commit("you", "fourth", 19, "clash")
    ws.checkout(ws.head())
    outcome, conflicts = ws.merge("clash", "me", 20)
    assert outcome == "conflicts" and conflicts == [("/a.md", "content")]
    assert "<<<<<<<" in bodies(ws)["/a.md"]
    swept = ws.collect_garbage(1_000, 100)
    assert swept.where("state = 'reachable'").count() > 0 and swept.where("state = 'skipped_undated'").count() == 0
    events = ws.table("events")
    assert events.count() == events.select("seq").distinct().count()


def test_namespace_and_feed(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    ws.write(files(spark, a_x="1", a_y="2", b="3"), 1, 0, 1)
    ws.rename("/a", "/c", 1, 0, 2)
    ws.remove("/b.md", 1, 0, 3)
    assert sorted(bodies(ws)) == ["/c/x.md", "/c/y.md"]
    assert [(r.kind, r.path, r.detail) for r in ws.table("events").orderBy("seq").collect()][3:] == [("rename", "/a", "/c"), ("remove", "/b.md", None)]


def test_co_edited_text():
    assert attribution.inserted_ranges("ab", "a\U0001f600xb") == [(1, 3)]
    assert attribution.inserted_ranges("", "") == []
    assert attribution.spans_of_blame("aéb", [(1, 0, 3)], (9, 9)) == [("aé", 1, 0), ("b", 9, 9)]
