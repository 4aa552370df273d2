"""The thin opN_<name> queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.mixing import Target

SEQUENCE_TOKENS = 4096
TOKEN_LIMIT = 2048
SHARDS = 40
#: Sources are flattened to nearly even weights, over half as many words again as there are: entropy and repeats both bind.
MIX_TARGET = Target(entropy=0.99999, repeats=4.0)
MIX_PASSES = 1.5


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.ngram import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), SEQUENCE_TOKENS, 1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.telephony import store_and_describe

    return store_and_describe(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), MIX_TARGET, passes=MIX_PASSES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), TOKEN_LIMIT)


def op10_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.rans import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


OP3_SQL = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest),
r AS (SELECT p.*, first, coalesce(page_id > first, false) AS again FROM p LEFT JOIN f USING (digest))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM r"""


def oracle_sql() -> dict[str, str]:
    """Learned lists, tokenizers, media, XXH64 and differencing are not SQL; tests hold those against brute force."""
    return {"op3_warc": OP3_SQL}
