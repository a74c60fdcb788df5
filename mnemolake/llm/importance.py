"""Target-distribution importance resampling over hashed n-grams.

Features of a text are its runs of 1 to 3 words; each falls into one of ``BUCKETS`` buckets by its crc32. A bucket's
gain is the logarithm of its share in the target texts over its share in the raw ones, a document's weight is the sum over
its features, and adding Gumbel noise to it makes the highest scores a sample without replacement.

The n-grams of a batch are interned in an open-addressed NumPy table: an occurrence probes from the slot of its xxhash64 on,
takes an empty slot or joins one of an equal hash and equal bytes. A slot holds bucket and count, so a bucket is computed once per
different n-gram; counts go into the totals, and the slot ids of the occurrences gather the gains.

Tasks return one array of totals each; arrays are added in a tree of tasks, and the driver gets at most
``FEW`` of them, each of the size of the buckets. Texts are read twice, once for totals and once for weights, and never
shuffled. Ranks come from scores dealt by range: a rank is the number of rows in earlier ranges plus the place in the own one.

Defined cases: null or wordless texts have no feature and weight 0; a null doc_id is hashed as the empty string and ranks after
others of its score; repeated rows are documents of their own; very long texts are worked on in stretches of
``SLAB_WORDS`` words; other columns are ignored; with an empty target or raw table gains follow from the formula; no documents give
an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.llm.decontamination import words_of
from mnemolake.llm.tables import table
from mnemolake.session import cut

ORDERS = 3
BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words whose n-grams are interned together, and occurrences that are hashed at once, so that temporary arrays stay in cache.
SLAB_WORDS = 1 << 16
HASHED = 1 << 14
#: Arrays of totals that one task or the driver adds up.
FEW = 32
U = np.uint64
P1, P2, P3, P4, P5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxhash64(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of stretches of ``data``, which ends in eight bytes that do not count."""
    out = np.empty(len(starts), U)
    for a in range(0, len(starts), HASHED):
        out[a : a + HASHED] = _hash_some(data, starts[a : a + HASHED], sizes[a : a + HASHED])
    return out


def _hash_some(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = P5 + sizes.astype(U)
    for lane in range(3):
        at = np.flatnonzero(sizes >= 8 * lane + 8)
        if not len(at):
            break
        k = _turn(eights[starts[at] + 8 * lane] * P2, 31) * P1
        h[at] = _turn(h[at] ^ k, 27) * P1 + P4
    # the last bytes, up to seven, as one integer
    rest = sizes & 7
    tail = eights[starts + (sizes - rest)]
    four = rest >= 4
    h = np.where(four, _turn(h ^ ((tail & U(0xFFFFFFFF)) * P1), 23) * P2 + P3, h)
    tail = np.where(four, tail >> U(32), tail)
    rest = rest & 3
    for i in range(3):
        h = np.where(rest > i, _turn(h ^ (((tail >> U(8 * i)) & U(255)) * P5), 11) * P1, h)
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    h ^= h >> U(32)
    # stretches of 32 bytes and more have four lanes of state; they are rare
    for i in np.flatnonzero(sizes >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return h


class NgramTable:
    """Different stretches of one batch, in open-addressed slots with a bucket and a count each."""

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, buckets: int = BUCKETS):
        self.data, self.starts, self.sizes = data, starts, sizes
        n = len(starts)
        keys = xxhash64(data, starts, sizes)
        bits = max(4, int(2 * n - 1).bit_length())
        # first occurrence in each slot, -1: empty
        self.first = np.full(1 << bits, -1, np.int64)
        self.slot_of = np.empty(n, np.int64)
        at, slot = np.arange(n), (keys >> U(64 - bits)).astype(np.int64)
        while len(at):
            empty = self.first[slot] < 0
            # of several occurrences that claim one slot the last written stays; all look at what is there now
            self.first[slot[empty]] = at[empty]
            held = self.first[slot]
            same = held == at
            twin = np.flatnonzero(~same & (keys[held] == keys[at]))
            same[twin] = self._equal(at[twin], held[twin])
            self.slot_of[at[same]] = slot[same]
            at, slot = at[~same], (slot[~same] + 1) & ((1 << bits) - 1)
        used = np.flatnonzero(self.first >= 0)
        self.counts = np.zeros(1 << bits, np.int64)
        self.counts += np.bincount(self.slot_of, minlength=1 << bits)
        self.buckets = np.zeros(1 << bits, np.int32)
        a = starts[self.first[used]]
        b = a + sizes[self.first[used]]
        crc = zlib.crc32
        self.buckets[used] = [crc(data[i:j]) % buckets for i, j in zip(a.tolist(), b.tolist())]
        self.used = used

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences ``a`` and ``b`` agree in every byte."""
        eights = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        same = self.sizes[a] == self.sizes[b]
        open_, at = np.flatnonzero(same), 0
        while len(open_):
            left = self.sizes[a[open_]] - at
            mask = U(0xFFFFFFFFFFFFFFFF) >> (U(8) * np.maximum(8 - left, 0).astype(U))
            differs = ((eights[self.starts[a[open_]] + at] ^ eights[self.starts[b[open_]] + at]) & mask) != 0
            same[open_[differs]] = False
            open_ = open_[~differs & (left > 8)]
            at += 8
        return same

    def totals(self, buckets: int = BUCKETS) -> np.ndarray:
        """Occurrences per bucket."""
        return np.bincount(np.repeat(self.buckets[self.used], self.counts[self.used]), minlength=buckets)

    def gathered(self, gains: np.ndarray) -> np.ndarray:
        """The gain of every occurrence."""
        return gains[self.buckets][self.slot_of]


def stretches(texts: list[str | None], orders: int = ORDERS) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, sizes, text number) of all n-grams of some texts, about SLAB_WORDS words at a time."""
    held: list[tuple[int, list[bytes], int]] = []  # text number, words, how many of them start n-grams
    size = 0
    for number, text in enumerate(texts):
        words = words_of(text)
        for at in range(0, len(words), SLAB_WORDS):
            own = min(SLAB_WORDS, len(words) - at)
            held.append((number, words[at : at + own + orders - 1], own))
            size += own
            if size >= SLAB_WORDS:
                yield _stretches(held, orders)
                held, size = [], 0
    if held:
        yield _stretches(held, orders)


def _stretches(held: list[tuple[int, list[bytes], int]], orders: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    words = [w for _, ws, _ in held for w in ws]
    data = b" ".join(words) + bytes(9)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    counts = np.array([len(ws) for _, ws, _ in held])
    part = np.repeat(np.arange(len(held)), counts)
    first = np.cumsum(counts) - counts
    own = np.arange(len(words)) - first[part] < np.array([o for _, _, o in held])[part]
    last = (first + counts)[part]
    starts, sizes, numbers = [], [], []
    for n in range(orders):
        at = np.flatnonzero(own & (np.arange(len(words)) + n < last))
        starts.append(start[at])
        sizes.append(end[at + n] - start[at])
        numbers.append(part[at])
    number_of = np.array([number for number, _, _ in held])
    return data, np.concatenate(starts), np.concatenate(sizes), number_of[np.concatenate(numbers)]


def bucket_totals(texts: DataFrame, text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket over all rows of ``texts``."""

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, starts, sizes, _ in stretches(batch.column(0).to_pylist(), orders):
                total += NgramTable(data, starts, sizes, buckets).totals(buckets)
        if total.any():
            yield one(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.asarray(batch.column(0).flatten()).reshape(-1, buckets).sum(axis=0)
        if total.any():
            yield one(total)

    totals = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "total array<long>")
    tasks = totals.rdd.getNumPartitions()
    while tasks > FEW:
        tasks = -(-tasks // FEW)
        totals = totals.repartition(tasks).mapInArrow(add, "total array<long>")
    found = np.zeros(buckets, np.int64)
    for r in totals.collect():  # at most FEW rows of one number per bucket
        found += np.array(r["total"], np.int64)
    return found


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the raw texts."""
    buckets, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, features, weights = (np.zeros(len(texts), np.int64) for _ in range(3))
            for data, starts, sizes, number in stretches(texts, orders):
                own = NgramTable(data, starts, sizes, len(gains)).gathered(gains)
                features += np.bincount(number, minlength=len(texts))
                np.add.at(weights, number, own)
            for i in range(len(texts)):
                # n words give n + (n - 1) + ... features, fewer where the text is shorter than an n-gram
                words[i] = _words_for(int(features[i]), orders)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def _words_for(features: int, orders: int) -> int:
    """The number of words that give so many n-grams."""
    for n in range(orders):
        if n * (n + 1) // 2 == features:
            return n
    return (features + orders * (orders - 1) // 2) // orders


def gumbel(doc_id, seed: int = SEED):
    """floor of 1000 times the Gumbel noise of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored(doc_id, n_words, n_features, weight, score)`` and the rank of the best ``percent`` of documents with enough words."""
    scored = cut(scored)
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.desc("weight")]
    dealt = cut(scored.filter(able).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row per task
    take = percent * sum(sizes.values()) // 100
    before, rows = 0, []
    for r in sorted(sizes):
        rows.append((r, before))
        before += sizes[r]
    starts = dealt.sparkSession.createDataFrame(rows, "_range int, _before long")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.col("_before")
    ranked = dealt.join(F.broadcast(starts), "_range").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    columns = [*scored.columns, "rank"]
    return ranked.select(*columns).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document."""
    gains = bucket_gains(bucket_totals(docs, text_col, orders, buckets), bucket_totals(target, text_col, orders, buckets))
    scored = weighted(docs, gains, id_col, text_col, orders).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return drawn(scored, percent, least_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's texts, and a draw of five per cent by them."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
