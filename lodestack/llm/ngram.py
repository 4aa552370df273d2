"""Quality classifier: an interpolated modified Kneser-Ney word trigram model trained on all trusted text.

With interpolation written as back-off, a word's log probability is

    log p(c) + log g(b) + [log p(c|b) / (g(b) p(c))] + [log g(a, b)] + [log p(c|a, b) / (g(a, b) p(c|b))],

g being the mass that a context leaves and a bracket zero where its n-gram was not counted. Every term hangs on one
n-gram, so the model is a table of additive weights by n-gram, and scoring is a join of the documents' n-grams with it,
summed up by document. No part of the model is held by the driver or whole by a worker.

All counts are taken over every trusted document but the quarter that thresholds come from. Trigrams are counted, weighed
and joined in ROUNDS by their middle word: contexts (a, b) and lower orders (b, c) of a trigram lie in its round. So
what is on disk at one time is one round's n-grams; texts are read again in each round, which costs no disk. Blocks count
their trigrams and pack them for equal parts of the hash space of their pairs of words, where tasks count them by sorting. A round's
weights are packed once into shards of the hash space. Its document n-grams are packed by block (keys once each, with
the documents that hold them) and dealt to these shards for one of PARTS of the texts after the other, so that what is on
disk is a part's n-grams, and no text is hashed twice in a round; shards are equal parts of the hash space, so no n-gram's frequency makes one task
larger by more than its holders' 2 bytes each. Words and n-grams are known by 64-bit hashes. Thresholds are quantiles for
each language over all trusted documents that were not trained on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import drop_tables, tidy, words_of, write_table

#: A document is rejected above this quantile of its language's trusted, held-out documents plus a margin in nats;
#: the margin has a part that falls with the root of the document's words, as chance does.
QUANTILE = 0.995
MARGIN = 0.5
SPREAD = 4.0
#: Shorter documents are kept: their perplexity says little.
LEAST_WORDS = 10
#: Marks of a text's start and end; no word holds a blank.
START, END = b" <s>", b" </s>"
#: Bytes of the texts whose n-grams are sorted together.
BLOCK_BYTES = 6_000_000
#: Bytes of the texts whose words are hashed together: the steps' arrays take some 20 bytes for each.
HASH_BYTES = 1_000_000
#: Texts of a block: their places are 16 bits wide.
BLOCK_TEXTS = 60_000
#: Parts by middle word that are counted and joined one after the other.
ROUNDS = 5
#: Parts by text whose n-grams are dealt one after the other within a round.
PARTS = 3
#: Weights of one shard, which a task holds at a time.
SHARD_WEIGHTS = 2_000_000
#: Bytes of a round's texts whose trigrams a task counts.
SHARD_BYTES = 6_000_000
#: Weights that a task packs together.
PACK_WEIGHTS = 250_000
#: Keys of a block that travel as one row.
ROW_KEYS = 65_536
#: The key that each block sends for each of its texts in each round: it tells how many blocks hold the text.
MARK = 1
#: Longer words are hashed one by one.
LONG_WORD = 64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def spark_hash(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long columns (seed 42), as unsigned."""
    seed = np.full(len(columns[0]), 42, np.uint64)
    for x in columns:
        seed = seed + _P5 + np.uint64(8)
        seed ^= turn(x.view(np.uint64) * _P2, 31) * _P1
        seed = turn(seed, 27) * _P1 + _P4
        seed ^= seed >> np.uint64(33)
        seed *= _P2
        seed ^= seed >> np.uint64(29)
        seed *= _P3
        seed ^= seed >> np.uint64(32)
    return seed


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def mark_key(mark: bytes, lang: str) -> int:
    """The key of a language's START or END, unsigned."""
    return xxhash.xxh64_intdigest(mark, language_seed(lang))


def document_key(text: bytes, lang: str) -> int:
    return xxhash.xxh3_64_intdigest(text, language_seed(lang))


def round_of(word: np.ndarray, rounds: int) -> np.ndarray:
    return (word >> np.uint64(40)) % np.uint64(rounds)


def in_round(word: Column, k: int, rounds: int) -> Column:
    return F.shiftrightunsigned(word, 40) % rounds == k


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts) of a batch of (lang, text), some BLOCK_BYTES at a time."""
    langs, texts, size = [], [], 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        langs.append(lang)
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size > BLOCK_BYTES or len(texts) >= BLOCK_TEXTS:
            yield langs, texts
            langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def word_keys(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every word of the texts in order, words of each text), some HASH_BYTES at a time."""
    sizes = np.cumsum([len(x) for x in texts])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // HASH_BYTES)) + 1).tolist(), len(texts)]
    parts = [hashed_words(langs[a:b], texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([h for h, _ in parts]), np.concatenate([many for _, many in parts])


def hashed_words(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_keys of a few texts. Words are hashed 8 bytes at a time, all together."""
    seeds = {x: language_seed(x) for x in set(langs)}
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data + bytes(8), np.uint8)
    word = np.concatenate(([False], ~_BLANK[raw[: len(data)]]))
    edges = np.flatnonzero(word[1:] != word[:-1])  # the last byte is blank: edges come in pairs
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(x) + 1 for x in texts])
    many = np.diff(np.searchsorted(starts, ends), prepend=0)
    h = np.repeat(np.array([seeds[x] for x in langs], np.uint64), many)
    wide = np.ndarray((len(data) + 1,), "<u8", buffer=raw.data, strides=(1,))
    h = h + sizes.astype(np.uint64) * _P5
    own = np.flatnonzero(sizes <= LONG_WORD)
    at, left = starts[own], sizes[own]
    while len(own):
        v = wide[at]
        part = left < 8
        v[part] &= (np.uint64(1) << (np.uint64(8) * left[part].astype(np.uint64))) - np.uint64(1)
        h[own] = turn(h[own] ^ (v * _P2), 31) * _P1 + _P4
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    if len(long := np.flatnonzero(sizes > LONG_WORD)):
        of = np.repeat(np.arange(len(texts)), many)
        for i in long.tolist():
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]], seeds[langs[of[i]]])
    return h, many


def padded(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word keys, places of the texts' first marks): texts one after the other, each behind two starts and before an end."""
    h, many = word_keys(langs, texts)
    first = np.cumsum(many + 3) - many - 3
    out = np.empty(len(h) + 3 * len(texts), np.uint64)
    marks = {x: (mark_key(START, x), mark_key(END, x)) for x in set(langs)}
    start, end = (np.array([marks[x][k] for x in langs], np.uint64) for k in (0, 1))
    out[first] = out[first + 1] = start
    out[first + many + 2] = end
    out[np.arange(len(h)) + 3 * np.repeat(np.arange(len(texts)), many) + 2] = h
    return out, first


def training_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text, _digest (equal for equal words of a language) of what is trained on. docs: doc_id, lang, text."""
    own = docs.join(trusted, docs.doc_id == trusted._id, "left_semi").withColumn("_words", F.array_join(words_of(F.col("text")), " ")).where("_words <> ''")
    own = own.select("doc_id", "lang", "text", F.unhex(F.sha2(F.concat("lang", F.lit(" "), "_words"), 256)).alias("_digest"))
    # a quarter is never trained on: thresholds need texts that the model has not seen; copies fall on one side
    return own.where(F.pmod(F.xxhash64("_digest"), F.lit(4)) != 0)


def packed_trigrams(l: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> bytes:
    """Language numbers, the three word keys and counts of some trigrams."""
    return shrunk(b"".join((np.array([len(n)], "<u4").tobytes(), planes(l.astype("<i4")), *[planes(x.astype("<u8")) for x in words], planes(n.astype("<i8")))))


def unpacked_trigrams(data: bytes) -> list[np.ndarray]:
    """[l, a, b, c, n]"""
    view = whole_again(data)
    n = int(np.frombuffer(view, "<u4", 1)[0])
    edges = np.cumsum([4, 4 * n, 8 * n, 8 * n, 8 * n])
    return [joined(view[at:], kind, n) for at, kind in zip(edges.tolist(), ("<i4", "<u8", "<u8", "<u8", "<i8"))]


def counted(l: np.ndarray, words: list[np.ndarray], n: np.ndarray, pair: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(key of the pair, l, words, n) of each different trigram in the order of the keys; pair: the first word's place."""
    grams = spark_hash(*words)
    by = np.argsort(grams)
    edges = np.flatnonzero(np.diff(grams[by], prepend=~grams[by[:1]]) != 0)
    at, n = by[edges], np.add.reduceat(n[by], edges) if len(by) else n
    words = [x[at] for x in words]
    key = spark_hash(*words[pair : pair + 2])
    by = np.argsort(key)
    return key[by], l[at[by]], [x[by] for x in words], n[by]


def trigram_counts(model: Model, k: int, pair: int, finish: Callable[..., pa.RecordBatch], kinds: str) -> DataFrame:
    """What ``finish`` makes of the trigrams of round k, dealt by a pair of their words (the first two, 0, or the last, 1):
    it gets the first place of each pair, and l, (a, b, c), n of all trigrams, those of one pair together.

    Each block is counted where it is, and packed for equal parts of the pairs' hash space; a task counts such a part.
    """
    numbers, rounds, shards = model.numbers, model.rounds, model.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, own in blocks(batch):
                c, first = padded(langs, own)
                real = np.ones(len(c), bool)
                real[first] = real[first + 1] = False
                at = np.flatnonzero(real)
                at = at[round_of(c[at - 1], rounds) == k]
                of = np.array([numbers[x] for x in langs], np.int32)[np.searchsorted(first, at, side="right") - 1]
                key, of, words, n = counted(of, [c[at - 2], c[at - 1], c[at]], np.ones(len(at), np.int64), pair)
                cuts = np.searchsorted(shard_of(key, shards), np.arange(shards + 1)).tolist()
                some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
                out = [packed_trigrams(of[i:j], [x[i:j] for x in words], n[i:j]) for i, j in ((cuts[s], cuts[s + 1]) for s in some)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out, pa.binary())], names=["shard", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []

        def made() -> Iterator[pa.RecordBatch]:
            l, *words, n = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            key, l, words, n = counted(l, words, n, pair)
            out = finish(np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0), l, words, n)
            for at in range(0, out.num_rows, ROW_KEYS):
                yield out.slice(at, ROW_KEYS)

        for batch in batches:
            for shard, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                if parts and shard != now:
                    yield from made()
                now = shard
                parts.append(unpacked_trigrams(one.as_py()))
        if parts:
            yield from made()

    dealt = model.texts.mapInArrow(run, "shard int, packed binary").repartitionById(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, kinds)


def bigram_counts(model: Model, k: int) -> DataFrame:
    """l, b, c, n of the bigrams of round k (see Model.bigrams), and for each task and language a row of these with s: how many
    trigrams were counted once, twice, 3, 4 and more than 2 times, the sum of the counts, the trigrams."""
    starts = np.array([mark_key(START, x) for x in model.numbers], np.uint64)

    def finish(first: np.ndarray, l: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        many = np.where(np.isin(words[1][first], starts), np.add.reduceat(n, first), np.diff(np.append(first, len(n))))
        told = {x: n[l == x] for x in np.unique(l).tolist()}
        s = [[*[int((x == i).sum()) for i in (1, 2, 3, 4)], int((x > 2).sum()), int(x.sum()), len(x)] for x in told.values()]
        none = pa.nulls(len(s), pa.int64())
        two = [pa.array(l[first]), *[pa.array(x[first].view(np.int64)) for x in words[1:]], pa.array(many), pa.nulls(len(first), pa.list_(pa.int64()))]
        more = [pa.array(list(told), pa.int32()), none, none, none, pa.array(s, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(two, more)], names=["l", "b", "c", "n", "s"])

    return trigram_counts(model, k, 1, finish, "l int, b long, c long, n long, s array<long>")


def context_shares(model: Model, k: int) -> DataFrame:
    """l, a, b, c, n of the trigrams of round k, whether it is the one that stands for (a, b), g3 (the mass that (a, b)
    leaves) and x (the discounted share, by g3)."""
    d3 = np.array([row[3] for row in model.table])

    def finish(first: np.ndarray, l: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        many = np.diff(np.append(first, len(n)))
        total = np.add.reduceat(n, first).astype(np.float64)
        mass = sum(d3[l[first], i] * np.add.reduceat(x.astype(np.int64), first) for i, x in enumerate((n == 1, n == 2, n > 2)))
        g3, stands = np.repeat(mass / total, many), np.zeros(len(n), bool)
        stands[first] = True
        x = (n - d3[l, np.minimum(n, 3) - 1]) / np.repeat(total, many) / g3
        columns = [pa.array(l), *[pa.array(w.view(np.int64)) for w in words], pa.array(n), pa.array(stands), pa.array(g3.astype(np.float32)), pa.array(x.astype(np.float32))]
        return pa.RecordBatch.from_arrays(columns, names=["l", "a", "b", "c", "n", "first", "g3", "x"])

    return trigram_counts(model, k, 0, finish, "l int, a long, b long, c long, n long, first boolean, g3 float, x float")


def counts_of_counts(counts: DataFrame) -> dict[int, tuple[int, ...]]:
    """By language (a row each): how many counts are 1, 2, 3, 4 and above 2; their sum; the rows."""
    n = F.col("n")
    own = counts.groupBy("l").agg(*[F.count_if(n == k) for k in (1, 2, 3, 4)], F.count_if(n > 2), F.sum("n"), F.count(F.lit(1)))
    with tidy(counts.sparkSession):
        return {r[0]: tuple(r)[1:] for r in own.collect()}


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and more, by modified Kneser-Ney from counts of counts, within 0 and the count."""
    y = n1 / max(n1 + 2 * n2, 1.0)
    raw = [k - (k + 1) * y * more / own if own else 0.5 * k for k, own, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def contexts(counts: DataFrame, *by: Column) -> DataFrame:
    """by, total, n1, n2, n3: the sum of a context's counts, and how many are 1, 2, more."""
    n = F.col("n")
    return counts.groupBy("l", *by).agg(F.sum("n").alias("total"), F.count_if(n == 1).alias("n1"), F.count_if(n == 2).alias("n2"), F.count_if(n > 2).alias("n3"))


def discounted(order: int) -> Column:
    n = F.col("n")
    return n - F.when(n == 1, F.col(f"d{order}")[0]).when(n == 2, F.col(f"d{order}")[1]).otherwise(F.col(f"d{order}")[2])


def left_mass(order: int) -> Column:
    """The share of a context's mass that its discounts leave to the lower order."""
    d = F.col(f"d{order}")
    return (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")


@dataclass
class Model:
    """What training leaves: the texts (lang, text) that rounds count anew, words (l, k, n: their different left
    neighbours), and by language its number, discounts of the orders, sum of n, and the log probability of an unknown word."""

    texts: DataFrame
    words: DataFrame
    numbers: dict[str, int]
    table: list[tuple]
    base: dict[str, float]
    rounds: int
    shards: int

    def told(self) -> DataFrame:
        kinds = "l int, d1 array<double>, d2 array<double>, d3 array<double>, total1 double, base double"
        return F.broadcast(self.words.sparkSession.createDataFrame(self.table, kinds))  # a row for each language

    def bigrams(self, c3: DataFrame) -> DataFrame:
        """l, b, c, n: different left neighbours; bigrams at a text's start keep their own counts, as nothing varies before them."""
        starts = F.col("b").isin([signed(mark_key(START, x)) for x in self.numbers])
        return c3.groupBy("l", "b", "c").agg(F.when(starts, F.sum("n")).otherwise(F.count(F.lit(1))).alias("n"))

    def weights(self, k: int) -> tuple[DataFrame, list[DataFrame]]:
        """(k, w: the weights of the n-grams of round k; tables to drop after use). Bigrams' and contexts' keys differ."""
        told = self.told()
        c3 = write_table(context_shares(self, k), "trigrams")
        c2 = write_table(self.bigrams(c3), "bigrams")
        of_b = contexts(c2, F.col("b")).join(told, "l")
        of_b = write_table(of_b.select("b", "total", left_mass(2).alias("g2")), "left")
        p1 = discounted(1) / F.col("total1") + F.col("base")
        known = self.words.join(told, "l").select("k", p1.alias("p1"), "base")
        # what is looked up has a row for each key: the other side is not sorted for it
        two = c2.join(of_b.hint("shuffle_hash"), "b").join(known.select(F.col("k").alias("c"), "p1").hint("shuffle_hash"), "c").join(told.select("l", "d2"), "l")
        low = F.col("g2") * F.col("p1")
        two = write_table(two.select("b", "c", low.alias("low"), (discounted(2) / F.col("total") + low).alias("p2")), "pairs")
        drop_tables(c2)
        three = c3.join(two.select("b", "c", "p2").hint("shuffle_hash"), ["b", "c"])
        gain = F.log1p(F.col("x") / F.col("p2"))
        row = lambda key, w: (key.alias("k"), w.cast("float").alias("w"))
        out = (
            known.where(in_round(F.col("k"), k, self.rounds)).select(*row(F.col("k"), F.log(F.col("p1") / F.col("base"))))
            .union(of_b.select(*row(F.col("b"), F.log("g2"))))
            .union(two.select(*row(F.xxhash64("b", "c"), F.log(F.col("p2") / F.col("low")))))
            .union(c3.where("first").select(*row(F.xxhash64("a", "b", F.lit(0).cast("long")), F.log("g3"))))
            .union(three.select(*row(F.xxhash64("a", "b", "c"), gain)))
        )
        out = write_table(out, "weights")
        drop_tables(c3, of_b, two)
        return out, [out]

    def score(self, lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities, words) of each text of one language; the end of a text counts as a word."""
        rows = [(k, lang, t.decode()) for k, t in enumerate(texts)]
        docs = self.words.sparkSession.createDataFrame(rows, "doc_id long, lang string, text string")
        got = sorted(perplexities(docs, self, ["doc_id"]).collect())
        n = np.array([r.n_words for r in got], np.int64)
        return -np.array([np.nan if r.log_perplexity is None else r.log_perplexity for r in got]) * (n + 1), n


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def weigh(texts: DataFrame, langs: list[str], rounds: int | None = None) -> Model:
    """The model of the texts (lang, text): every round is counted once for what all rounds need of it."""
    rounds = rounds or ROUNDS
    spark = texts.sparkSession
    with tidy(spark):
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // (rounds * SHARD_BYTES)))
    model = Model(texts, texts, {x: k for k, x in enumerate(langs)}, [], {}, rounds, shards)
    s2, s3 = ({k: np.zeros(7, np.int64) for k in range(len(langs))} for _ in range(2))
    parts = []
    for k in range(rounds):
        # trigrams are dealt by their bigram: each task tells how often its trigrams were counted once, twice ..
        both = write_table(bigram_counts(model, k), "bigrams")
        c2 = both.where("s IS NULL")
        with tidy(texts.sparkSession):
            of3 = {r[0]: tuple(r)[1:] for r in both.where("s IS NOT NULL").groupBy("l").agg(*[F.sum(F.col("s")[i]) for i in range(7)]).collect()}
        for s, found in ((s2, counts_of_counts(c2)), (s3, of3)):
            for x, own in found.items():
                s[x] += own
        parts.append(write_table(c2.groupBy("l", F.col("c").alias("k")).agg(F.count(F.lit(1)).alias("n")), "words"))
        drop_tables(both)
    model.words = write_table(reduce(DataFrame.union, parts).groupBy("l", "k").agg(F.sum("n").alias("n")), "words")
    drop_tables(*parts)
    s1 = counts_of_counts(model.words)
    for lang, k in model.numbers.items():
        d1, d2, d3 = (discounts(*map(int, s[k][:4])) for s in (s1, s2, s3))
        n1, n2, _, _, more, total, size = s1[k]
        rest = (d1[0] * n1 + d1[1] * n2 + d1[2] * more) / total / (size + 2)  # evenly with a text's start and the unknown word
        model.table.append((k, d1, d2, d3, float(total), rest))
        model.base[lang] = float(np.log(rest))
    return model


def train(docs: DataFrame, labels: DataFrame, trusted: int = 1, label: str = "quality") -> tuple[Model | None, DataFrame]:
    """(model, ids trained on) from the documents labelled ``trusted``; None where there is none."""
    known = labels.where(F.col(label) == trusted).select(F.col("doc_id").alias("_id")).distinct()
    own = write_table(training_documents(docs.select("doc_id", "lang", "text").where("text IS NOT NULL"), known), "trusted")
    ids = write_table(own.select("doc_id").distinct(), "trained")
    texts = write_table(own.dropDuplicates(["_digest"]).select("lang", "text"), "texts")
    drop_tables(own)
    langs = sorted(r[0] for r in texts.select("lang").distinct().collect())  # a row for each language
    return (weigh(texts, langs) if langs else None), ids


def planes(x: np.ndarray) -> bytes:
    """The array's bytes, those of one place together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def joined(data: memoryview, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).reshape(-1)


def shrunk(data: bytes) -> bytes:
    return np.uint32(len(data)).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def whole_again(data: bytes) -> memoryview:
    return memoryview(pa.decompress(data[4:], int(np.frombuffer(data, "<u4", 1)[0]), codec="zstd", asbytes=True))


def packed(keys: np.ndarray, many: np.ndarray, holders: np.ndarray, docs: np.ndarray) -> bytes:
    """Ascending keys (as steps), how many holders each has, and the holders' places among docs (keys of the texts)."""
    some, places = np.unique(holders, return_inverse=True)
    head = np.array([len(keys), len(holders), len(some)], "<u4").tobytes()
    return shrunk(b"".join((head, docs[some].astype("<u8").tobytes(), planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8")), planes(many.astype("<u4")), planes(places.astype("<u2")))))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    view = whole_again(data)
    n, held, some = np.frombuffer(view, "<u4", 3).tolist()
    edges = np.cumsum([12, 8 * some, 8 * n, 4 * n])
    docs = np.frombuffer(view, "<u8", some, 12)
    keys = np.cumsum(joined(view[edges[1] :], "<u8", n), dtype=np.uint64)
    return keys, joined(view[edges[2] :], "<u4", n), joined(view[edges[3] :], "<u2", held), docs


def shard_of(k: np.ndarray, shards: int) -> np.ndarray:
    return ((k >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def document_ngrams(docs: DataFrame, langs: set[str], k: int, rounds: int, shards: int) -> DataFrame:
    """shard, packed: the n-grams of round k of (lang, text), each once for a block; equal texts of a block are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                own = {document_key(t, x): (x, t) for x, t in zip(*block) if x in langs}
                if not own:
                    continue
                c, first = padded(*map(list, zip(*own.values())))
                key = np.array(list(own), np.uint64)
                real = np.ones(len(c), bool)
                real[first] = False
                at2 = np.flatnonzero(real & (round_of(c, rounds) == k))
                real[first + 1] = False
                at3 = np.flatnonzero(real)
                at3 = at3[round_of(c[at3 - 1], rounds) == k]
                x, y, z = c[at3 - 2], c[at3 - 1], c[at3]
                mark = np.full(len(key), MARK, np.uint64)
                grams = np.concatenate((mark, c[at2], spark_hash(y, z), spark_hash(x, y, np.zeros(len(x), np.uint64)), spark_hash(x, y, z)))
                of2, of3 = (np.searchsorted(first, at, side="right") - 1 for at in (at2, at3))
                held = np.concatenate((np.arange(len(key)), of2, of3, of3, of3)).astype(np.uint16)
                by = np.argsort(grams)
                grams, held = grams[by], held[by]
                edges = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                keys, many = grams[edges], np.diff(np.append(edges, len(grams)))
                cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                edges = np.append(edges, len(grams))
                out: tuple[list, list] = ([], [])
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    for i in range(cuts[s], cuts[s + 1], ROW_KEYS):
                        j = min(i + ROW_KEYS, cuts[s + 1])
                        out[0].append(s)
                        out[1].append(packed(keys[i:j], many[i:j], held[edges[i] : edges[j]], key))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["shard", "packed"])

    return docs.mapInArrow(run, "shard int, packed binary")


def packed_shard(k: np.ndarray, w: np.ndarray) -> bytes:
    """How many, the ascending keys (as steps), the weights."""
    return shrunk(b"".join((np.array([len(k)], "<u4").tobytes(), planes(np.diff(k, prepend=np.uint64(0)).astype("<u8")), planes(w.astype("<f4")))))


def unpacked_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    view = whole_again(data)
    n = int(np.frombuffer(view, "<u4", 1)[0])
    return np.cumsum(joined(view[4:], "<u8", n), dtype=np.uint64), joined(view[4 + 8 * n :], "<f4", n)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending keys, sums of their weights) of several (keys, weights)."""
    k, w = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(k)
    k, w = k[by], w[by]
    edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[edges], np.add.reduceat(w.astype(np.float64), edges).astype(np.float32)


def packed_weights(weights: DataFrame, shards: int) -> DataFrame:
    """shard, packed: the weights (k, w) by shard, a row for each shard; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            k, w = summed(parts)
            parts.clear()
            cuts = np.searchsorted(shard_of(k, shards), np.arange(shards + 1))
            own = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            out = [packed_shard(k[cuts[s] : cuts[s + 1]], w[cuts[s] : cuts[s + 1]]) for s in own]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(out, pa.binary())], names=["shard", "packed"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= PACK_WEIGHTS:
                yield made()
                size = 0
        if parts:
            yield made()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []

        def made() -> pa.RecordBatch:
            one = packed_shard(*summed(parts))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([one], pa.binary())], names=["shard", "packed"])

        for batch in batches:
            for shard, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                if parts and shard != now:
                    yield made()
                now = shard
                parts.append(unpacked_shard(one.as_py()))
        if parts:
            yield made()

    dealt = weights.mapInArrow(run, "shard int, packed binary").repartitionById(shards, "shard").sortWithinPartitions("shard")
    return write_table(dealt.mapInArrow(merge, "shard int, packed binary"), "shards")


def met(weights: DataFrame, ngrams: DataFrame, shards: int) -> DataFrame:
    """d, w, s: sums of the weights by document key, and how often the document was asked for. A shard's weights (shard,
    packed) come before its n-grams, which stream past them."""
    rows = weights.select("shard", F.lit(False).alias("asks"), "packed").union(ngrams.select("shard", F.lit(True), "packed"))
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, value = -1, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for shard, asks, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if shard != now:
                    now, known, value = shard, np.zeros(0, np.uint64), np.zeros(0)
                if not asks:
                    known, value = unpacked_shard(one.as_py())
                    continue
                keys, many, places, docs = unpacked(one.as_py())
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                w = np.where(known[at] == keys, value[at], 0.0) if len(known) else np.zeros(len(keys))
                total = np.bincount(places, np.repeat(w, many), len(docs))
                asked = np.bincount(places, np.repeat(keys == MARK, many), len(docs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(docs.view(np.int64)), pa.array(total), pa.array(asked)], names=["d", "w", "s"])

    return dealt.mapInArrow(run, "d long, w double, s long").groupBy("d").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """d, w: the sum of all weights of each text of docs (lang, text) by its key; a written table."""
    spark, out = docs.sparkSession, []
    for k in range(model.rounds):
        weights, done = model.weights(k)
        with tidy(spark):
            shards = max(spark.sparkContext.defaultParallelism, -(-weights.count() // SHARD_WEIGHTS))
        dealt = packed_weights(weights, shards)
        drop_tables(*done)
        for part in range(PARTS):
            own = docs.where(F.pmod(F.xxhash64("text"), F.lit(PARTS)) == part)
            found = met(dealt, document_ngrams(own, set(model.base), k, model.rounds, shards), shards)
            # a text of several blocks was asked for by each of them
            out.append(write_table(found.select("d", (F.col("w") / F.col("s")).alias("w")), "sums"))
        drop_tables(dealt)
    total = write_table(reduce(DataFrame.union, out).groupBy("d").agg(F.sum("w").alias("w")), "scores")
    drop_tables(*out)
    return total


def perplexities(docs: DataFrame, model: Model | None, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of docs with n_words and log_perplexity (null where the language has no model)."""
    kept = docs.select(*carry)
    lang = F.coalesce("lang", F.lit(""))
    names = [*carry, "_lang", "_d", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, (x, t) in enumerate(zip(batch.column(0), batch.column(1))):
                text = (t.as_py() or "").encode()
                n[i], d[i] = len(text.split()), document_key(text, x.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(d.view(np.int64)), pa.array(n)], names=names)

    own = docs.select(lang.alias("_lang"), F.col("text").alias("_text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    schema = T.StructType([*kept.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_d", T.LongType()), T.StructField("n_words", T.LongType())])
    told = own.mapInArrow(run, schema)
    if model is None:
        return told.select(*carry, "n_words", F.lit(None).cast("double").alias("log_perplexity"))
    found = scores(docs.select(lang.alias("lang"), "text"), model)
    base = F.lit(None).cast("double")
    for name, value in model.base.items():  # a row for each language
        base = F.when(F.col("_lang") == name, F.lit(value)).otherwise(base)
    log = F.col("w") + (F.col("n_words") + 1) * base
    return told.join(found, told._d == found.d, "left").select(*carry, "n_words", (-log / (F.col("n_words") + 1)).alias("log_perplexity"))


def classify(docs: DataFrame, labels: DataFrame, trusted: int = 1, label: str = "quality", quantile: float = QUANTILE, carry: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``carry`` of docs with n_words, log_perplexity, threshold and kept, for every document.

    docs need doc_id, lang and text, and no column of these names. Null texts have no words; texts of fewer than
    LEAST_WORDS words, of a language without trusted text, or with no trusted document at all are kept. Null languages
    are one language; repeated rows are judged alike; an empty table gives an empty result.
    """
    model, trained = train(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text"), labels, trusted, label)
    scored = write_table(perplexities(docs, model, list(dict.fromkeys(["doc_id", "lang", *carry]))), "scored")
    known = labels.where(F.col(label) == trusted).select("doc_id").distinct()
    lang = F.coalesce("lang", F.lit(""))
    told = scored.select("doc_id", lang.alias("_lang"), "n_words", "log_perplexity")
    held = told.where(F.col("n_words") >= LEAST_WORDS).join(known, "doc_id", "left_semi").join(trained, "doc_id", "left_anti")
    limits = {r[0]: r[1] for r in held.groupBy("_lang").agg(F.percentile_approx("log_perplexity", quantile, 10_000)).collect() if r[1] is not None}
    own = F.lit(None).cast("double")
    for name, value in sorted(limits.items()):  # a row for each language
        own = F.when(lang == name, F.lit(value)).otherwise(own)
    limit = own + MARGIN + SPREAD / F.sqrt(F.greatest("n_words", F.lit(1)))
    out = scored.withColumn("threshold", limit)
    fine = (F.col("n_words") < LEAST_WORDS) | F.col("log_perplexity").isNull() | F.col("threshold").isNull() | (F.col("log_perplexity") <= F.col("threshold"))
    return out.select(*carry, "n_words", "log_perplexity", "threshold", fine.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without what ``classify`` rejects; rows are judged one by one, their columns stay."""
    own = docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("_row"))
    return classify(own, labels, carry=("_row",)).where("kept").select("_row.*")
