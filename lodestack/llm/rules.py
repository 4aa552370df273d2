"""Quality rules as learned decision lists, in DataFrame functions only.

``text_stats`` computes whole-text statistics as column expressions. ``learn`` grows an ordered list of rules, each a
conjunction of thresholds, by sequential covering over all labelled rows: their statistics are binned once, each
candidate threshold's counts come from one aggregation over the rows that are still uncovered, a rule grows while the
best threshold improves it, and is pruned on the held-out half. The list is emitted as one ``CASE WHEN`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import words_of, write_table

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: What the learned rules look at, per hundred or per thousand so that whole-number thresholds are enough.
FEATURES = {
    "symbols_per_1000": "1000 * n_symbols div greatest(word_chars, 1)",
    "repeated_per_100": "100 * n_repeat_words div greatest(n_words, 1)",
    "duplicate_lines_per_100_words": "100 * n_dup_lines div greatest(n_words, 1)",
    "chars_per_10_words": "10 * word_chars div greatest(n_words, 1)",
    "words": "n_words",
}


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed of the whole text.

    Words are runs of non-space characters; null texts have none. n_repeat_words: words in 5-word windows that occur
    twice or more in the text, first occurrences included; most texts repeat no window and are settled by one pass
    over 64-bit window hashes, the others sort them, so time grows as n log n with the text. Columns of docs with these
    names (in any case) are replaced; all others, of any name, are kept. An empty table gives an empty result.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    carried = [c for c in docs.columns if c.lower() not in own]
    body = F.coalesce(F.col(text), F.lit(""))
    # the other columns travel as one, so that no name of theirs can meet one of these steps
    row = docs.select(F.struct(*carried).alias("_row"), body.alias("_t"))
    kept = ["_row"]
    row = row.select(*kept, "_t", words_of(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_l"))
    lines = F.filter(F.col("_l"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    row = row.select(
        *kept,
        "_w",
        F.size("_w").alias("_n"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    hashes = ", ".join(f"_w[i + {k}]" for k in range(WINDOW_WORDS))
    row = row.select(
        *kept, "_n", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN _n < {WINDOW_WORDS + 1} THEN array() ELSE transform(sequence(0, _n - {WINDOW_WORDS}), i -> xxhash64({hashes})) END").alias("_h"),
    )
    row = row.select(*[c for c in row.columns if c != "_h"], F.expr("CASE WHEN size(array_distinct(_h)) = size(_h) THEN NULL ELSE array_sort(transform(_h, (h, i) -> struct(h, i))) END").alias("_s"))
    # windows whose hash equals a neighbour's in sorted order, back in text order
    row = row.select(*[c for c in row.columns if c != "_s"], F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(_s) AND _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.i))").alias("_at"))
    repeated = F.expr(f"coalesce(aggregate(_at, named_struct('n', 0L, 'last', -{WINDOW_WORDS}), (a, i) -> named_struct('n', a.n + least({WINDOW_WORDS}, i - a.last), 'last', i), a -> a.n), 0L)")
    # always true, but not to the optimizer: a filter on the results must not be pushed into the steps above, where
    # words would be split anew for each element
    row = row.select(*kept, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.when(F.rand(0) + F.col("_n") >= 0, repeated).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return row.select(*[F.col("_row")[c].alias(c) for c in carried], *own[:5], failed.alias("base_failed"))


FEATURE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Test:
    """feature >= at (above) or feature <= at."""

    feature: str
    above: bool
    at: int

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.at}"

    def on(self, column: str) -> Column:
        return F.col(column) >= self.at if self.above else F.col(column) <= self.at


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    keep: bool

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds decides; else the default (keep)."""

    rules: tuple[Rule, ...]
    default: bool = True

    def sql(self) -> str:
        if not self.rules:
            return str(self.default).lower()
        return "CASE " + " ".join(f"WHEN {r.sql()} THEN {str(r.keep).lower()}" for r in self.rules) + f" ELSE {str(self.default).lower()} END"

    def column(self) -> Column:
        return F.expr(self.sql())


def candidates(rows: DataFrame, bins: int) -> dict[str, list[int]]:
    """For each feature at most ``bins`` thresholds: quantiles over all labelled rows."""
    shares = [i / bins for i in range(bins + 1)]
    got = rows.agg(*[F.percentile_approx(f, F.array(*map(F.lit, shares)), F.lit(10_000)).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(got[f] or [])) for f in FEATURES}


def coverage(rows: DataFrame, cuts: dict[str, list[int]], reject: int) -> dict[Test, tuple[int, int]]:
    """(rows of the class to reject, others) that each test covers: one aggregation, at most features x bins x 2 rows."""
    bins = [f"struct('{f}' AS f, size(filter(array({', '.join(f'{c}L' for c in own)}), c -> c <= {f})) AS b)" for f, own in cuts.items() if own]
    if not bins:
        return {}
    dealt = rows.select("label", F.explode(F.expr(f"array({', '.join(bins)})")).alias("x"))
    n = {(r.f, r.b, r.bad): r.n for r in dealt.groupBy("x.f", "x.b", (F.col("label") == reject).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict[Test, tuple[int, int]] = {}
    for f, own in cuts.items():
        for k, c in enumerate(own):
            out[Test(f, True, c)] = tuple(sum(n.get((f, b, x), 0) for b in range(k + 1, len(own) + 1)) for x in (True, False))
            if k:  # below the lowest cut there is nothing
                out[Test(f, False, c - 1)] = tuple(sum(n.get((f, b, x), 0) for b in range(k + 1)) for x in (True, False))
    return out


def purity(bad: int, good: int, weight: float) -> float:
    """Precision with Laplace's correction, good rows counted ``weight`` times."""
    return (bad + 0.5) / (bad + weight * good + 1)


def learn(labelled: DataFrame, reject: int = 0, most_rules: int = 8, most_tests: int = 3, bins: int = 48, least_precision: float = 0.9, least_covered: int = 5, most_failures: int = 3) -> DecisionList:
    """A decision list that rejects what ``label`` = reject marks. labelled: the statistics and ``label`` (rows with another null are left out).

    Sequential covering: rules are grown on two thirds of the rows (by a hash of the row), pruned on the rest, and kept
    where all uncovered rows and the held-out ones have at least ``least_precision`` of rejected rows; the rows that a
    rule covers are removed before the next. A rule that fails is grown again without its first test, up to
    ``most_failures`` times in all. An empty table, or one label only, gives the empty list (keep).
    """
    rows = labelled.where("label IS NOT NULL").select("label", F.pmod(F.xxhash64(*labelled.columns), F.lit(3)).alias("part"), *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    rows = write_table(rows, "labelled")
    cuts = candidates(rows, bins)
    rules: list[Rule] = []
    left, failed = rows, set()
    while len(rules) < most_rules and len(failed) < most_failures:
        grow, hold = left.where("part < 2"), left.where("part = 2")
        tests: list[Test] = []
        best_score, own = 0.0, grow
        while len(tests) < most_tests:
            found = coverage(own, cuts, reject)
            total = max((b for b, _ in found.values()), default=0)
            usable = {t: (b, g) for t, (b, g) in found.items() if b >= least_covered and b >= 0.02 * total and t not in failed}
            if not usable:
                break
            test = max(usable, key=lambda t: (round(purity(*usable[t], 3.0) * usable[t][0] ** 0.25, 9), t.feature, t.above, -t.at))
            score = purity(*usable[test], 3.0)
            if tests and score <= best_score + 0.005:
                break
            tests.append(test)
            best_score, own = score, own.where(test.on(test.feature))
            if usable[test][1] == 0:
                break
        if not tests:
            break
        tests = prune(tests, hold, reject)
        bad, good = covered(left, tests, reject)
        held, spoilt = covered(hold, tests, reject)
        if bad < least_covered or bad < least_precision * (bad + good) or held < least_precision * (held + spoilt):
            failed.add(tests[0])
            continue
        rules.append(Rule(tuple(tests), False))
        left = left.where(~reduce(and_, [t.on(t.feature) for t in tests]))
    return DecisionList(tuple(rules))


def covered(rows: DataFrame, tests: list[Test], reject: int) -> tuple[int, int]:
    for t in tests:
        rows = rows.where(t.on(t.feature))
    got = rows.agg(F.count_if(F.col("label") == reject).alias("b"), F.count_if(F.col("label") != reject).alias("g")).first()
    return got.b, got.g


def prune(tests: list[Test], hold: DataFrame, reject: int) -> list[Test]:
    """Drops last tests while the held-out rows don't get purer by them."""
    while len(tests) > 1:
        with_it, without = covered(hold, tests, reject), covered(hold, tests[:-1], reject)
        if purity(*with_it, 3.0) > purity(*without, 3.0):
            break
        tests = tests[:-1]
    return tests


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, DecisionList]:
    """The statistics and verdicts of every document, and the list learned from the labelled ones.

    kept is false where base_failed, else the list's verdict. Documents without a label are judged alike. Rows of
    ``labels`` with a null id or label teach nothing, repeated labels teach repeatedly. Null and empty texts have no
    words and are not kept; texts of any length are counted whole; repeated rows are judged alike; an empty table gives
    an empty result, and without labels only the base rejects.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    stats = write_table(text_stats(own).drop("text"), "stats")
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("label"))
    taught = stats.join(known, stats.doc_id == known._id).where("NOT base_failed")
    rules = learn(taught)
    return stats.withColumn("kept", F.coalesce(~F.col("base_failed") & rules.column(), F.lit(False))), rules


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without what the base and the learned rules reject; rows are judged one by one, their columns stay."""
    own = docs.select(F.struct(*docs.columns).alias("_row"))
    stats = write_table(text_stats(own, "_row.text"), "stats")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    taught = stats.select(F.col("_row.doc_id").alias("_doc"), *FEATURE_STATS, "base_failed").join(known, F.col("_doc") == F.col("_id")).where("NOT base_failed")
    return stats.where(~F.col("base_failed") & learn(taught).column()).select("_row.*")
