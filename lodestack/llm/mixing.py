"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source token shares are raised to an exponent and normalised. The exponent is found by bisection: the largest one (the
nearest to the natural shares) whose weights reach a target entropy, or the smallest one under which no source is
repeated more than a limit. The weights become token budgets, and each source's budget is met by whole passes over its
documents and part of one more: documents are dealt to blocks by hash, blocks are permuted anew in each pass, and the
part takes blocks in their order until the budget is met, the last of them document by document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import SPACE, write_table

#: Documents are dealt to this many blocks for each source; a larger source has larger blocks.
BLOCKS = 4_096
BISECTIONS = 60
#: A table of blocks of at most this many rows is broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Target:
    """What the exponent must meet; ``entropy`` as a share of the largest possible (log of the number of sources)."""

    entropy: float | None = 0.95
    repeats: float | None = 4.0


def weights(shares: dict[str, float], exponent: float) -> dict[str, float]:
    top = max(shares.values())
    raised = {k: (v / top) ** exponent for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def find_exponent(tokens: dict[str, int], target: Target, budget: float) -> float:
    """The exponent in 0 to 1. Entropy falls and the largest repetition falls as it grows, so each has one crossing;
    where both are asked for, the repetition limit goes first (a larger exponent than the entropy's)."""
    total = sum(tokens.values())
    shares = {k: v / total for k, v in tokens.items()}

    def bisect(low_fits) -> float:
        """The crossing between an exponent of 0, where low_fits holds, and 1, where it doesn't."""
        low, high = 0.0, 1.0
        for _ in range(BISECTIONS):
            mid = (low + high) / 2
            low, high = (mid, high) if low_fits(weights(shares, mid)) else (low, mid)
        return (low + high) / 2

    exponent = 1.0
    if target.entropy is not None and len(shares) > 1:
        wanted = target.entropy * math.log(len(shares))
        if entropy(shares) < wanted:
            exponent = bisect(lambda w: entropy(w) >= wanted)
    if target.repeats is not None:

        def repeats(w: dict[str, float]) -> float:
            return max(w[k] * budget / tokens[k] for k in w)

        if repeats(weights(shares, exponent)) > target.repeats:
            exponent = max(exponent, bisect(lambda w: repeats(w) > target.repeats)) if repeats(shares) <= target.repeats else 1.0
    return exponent


def budgets(tokens: dict[str, int], target: Target, budget: int) -> dict[str, int]:
    """Whole token budgets that sum to ``budget`` (largest remainders, ties by name)."""
    own = {k: v for k, v in tokens.items() if v > 0}
    if not own:
        return {}
    total = sum(own.values())
    w = weights({k: v / total for k, v in own.items()}, find_exponent(own, target, budget))
    parts = {k: v * budget for k, v in w.items()}
    out = {k: int(v) for k, v in parts.items()}
    for k in sorted(parts, key=lambda k: (out[k] - parts[k], k))[: budget - sum(out.values())]:
        out[k] += 1
    return out


def local(spark: SparkSession, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """A small table of literals."""
    named = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, kinds.items())]) for row in rows]
    empty = F.array().cast(f"array<struct<{', '.join(f'{c}: {t}' for c, t in kinds.items())}>>")
    return spark.range(1).select(F.inline(F.array(*named) if named else empty))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def dealt(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str) -> dict[str, Column]:
    """The columns that mixing needs of each document."""
    return {
        "doc_id": docs[id_column].cast("long"),
        "source": F.coalesce(docs[source_column], F.lit("")),
        "n_tokens": word_count(docs[text_column]),
        "block": F.pmod(F.xxhash64(docs[id_column], F.lit(seed)), F.lit(BLOCKS)).cast("int"),
    }


def ranked_blocks(own: DataFrame, target: Target, budget: int | None, seed: int, passes: float = 1.0) -> DataFrame:
    """source, block, epoch, place, left, tokens: the blocks that each pass takes, in its order, with the budget left.

    own: a written table of source, block, n_tokens. A block with tokens <= left is taken whole, else in part.
    """
    blocks = write_table(own.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    tokens = {r.source: r.tokens for r in blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    given = budgets(tokens, target, int(passes * sum(tokens.values())) if budget is None else budget)
    plan = local(own.sparkSession, [(k, b, tokens[k]) for k, b in sorted(given.items()) if b], {"source": "string", "given": "long", "of": "long"})
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(given - 1) div of")))
    plan = plan.select("source", "given", "of", epochs.alias("_e")).select("source", F.col("_e").cast("int").alias("epoch"), (F.col("given") - F.col("_e") * F.col("of")).alias("room"))
    order = Window.partitionBy("source", "epoch").orderBy("_h", "block")
    out = blocks.join(plan, "source").withColumn("_h", F.xxhash64("source", "epoch", "block", F.lit(seed)))
    out = out.withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).withColumn("place", F.row_number().over(order) - 1)
    out = out.where("before < room OR (tokens = 0 AND before <= room)")
    return write_table(out.select("source", "block", "epoch", "place", (F.col("room") - F.col("before")).alias("left"), "tokens"), "ranked")


def cut(rows: DataFrame, seed: int, source: str, doc: str, tokens: str) -> DataFrame:
    """Of rows of partly taken blocks (with epoch and left) those that the budget reaches, in a hashed order.

    A block's rows are dealt to BLOCKS smaller blocks, which are taken in order; only the one where the budget ends is
    ordered row by row, so no task holds more than that. Equal rows may share a smaller block: they are ordered there.
    """
    small = F.pmod(F.xxhash64(doc, "epoch", F.lit(seed), F.lit("small")), F.lit(BLOCKS)).cast("int")
    dealt = rows.withColumn("_small", small)
    sums = dealt.groupBy(F.col(source).alias("_cs"), F.col("epoch").alias("_ce"), F.col("_small").alias("_cb"), F.col("left").alias("_cl")).agg(F.sum(tokens).alias("_cn"))
    upto = Window.partitionBy("_cs", "_ce").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_cr", F.col("_cl") - F.coalesce(F.sum("_cn").over(upto), F.lit(0))).where("_cr > 0").drop("_cl")
    both = dealt.join(sums, (F.col(source) == F.col("_cs")) & (F.col("epoch") == F.col("_ce")) & (F.col("_small") == F.col("_cb")))
    columns = rows.columns
    order = Window.partitionBy("_cs", "_ce").orderBy(F.xxhash64(doc, "epoch", F.lit(seed)), doc, tokens).rowsBetween(Window.unboundedPreceding, -1)
    last = both.where("_cn > _cr").withColumn("_before", F.coalesce(F.sum(tokens).over(order), F.lit(0))).where("_before < _cr")
    return both.where("_cn <= _cr").select(*columns).union(last.select(*columns))


def beside(df: DataFrame) -> DataFrame:
    """Broadcast where the table's checked size allows it; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, target: Target = Target(), budget: int | None = None, seed: int = 42, passes: float = 1.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, n_words, epoch, block, place: the documents drawn, once for each pass that draws them.

    ``budget``: words to draw, by default ``passes`` times as many as there are. Words are what is counted for tokens. Null sources are one source (""),
    null texts and ids are as good as any, documents without words come with their block (a source without any word
    is not drawn); repeated rows are drawn each for itself; other columns are ignored; an empty table draws nothing. A
    source may hold any share of the rows: documents are joined with their block's row only, and only the block where
    a budget ends is ordered.
    """
    own = write_table(docs.select(*[c.alias(k) for k, c in dealt(docs, seed, id_column, text_column, source_column).items()]), "sized")
    ranked = ranked_blocks(own, target, budget, seed, passes)
    names = ["doc_id", "source", F.col("n_tokens").alias("n_words"), "epoch", "block", "place"]
    whole = own.join(beside(ranked.where("tokens <= left").drop("left", "tokens")), ["source", "block"])
    part = cut(own.join(beside(ranked.where("tokens > left").drop("tokens")), ["source", "block"]), seed, "source", "doc_id", "n_tokens")
    return whole.select(*names).union(part.select(*names))


def mixed_documents(docs: DataFrame, target: Target = Target(), budget: int | None = None, seed: int = 42) -> DataFrame:
    """docs with each row as often as ``mix`` draws it; texts are not shuffled where the blocks' table can be broadcast."""
    columns = dealt(docs, seed, "doc_id", "text", "source")
    own = write_table(docs.select(*[columns[k].alias(k) for k in ("source", "block", "n_tokens")]), "sized")
    ranked = ranked_blocks(own, target, budget, seed).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "epoch", "left", "tokens")
    times = ranked.where("tokens <= left").groupBy("_source", "_block").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), columns["source"].alias("_s"), columns["block"].alias("_b"))
    on = [F.col("_s") == F.col("_source"), F.col("_b") == F.col("_block")]
    whole = rows.join(beside(write_table(times, "times")), on).select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    last = rows.join(beside(ranked.where("tokens > left").drop("tokens")), on)
    last = last.withColumns({"_id": F.col("_row.doc_id"), "_n": word_count(F.col("_row.text"))})
    return whole.select("_row.*").union(cut(last, seed, "_s", "_id", "_n").select("_row.*"))
