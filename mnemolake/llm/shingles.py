"""Exact n-gram Jaccard join by vertical partitioning, with components of the links.

A document's set holds its distinct word n-grams. The global n-gram order puts the grams
of few text chunks first. The join runs on distinct texts:

1. Texts are reduced to one row per distinct text and task, then dealt into chunks; a
   chunk reports its distinct grams as 32-bit fingerprints to buckets. A bucket answers in how
   many chunks a gram occurs (fingerprints may merge grams: that only
   lets more texts through the next test, and the order stays one order for all).
2. A text whose grams that others hold are fewer than the threshold of its own set
   cannot link with anything and leaves. Usually only near copies remain.
3. Linked texts share a gram of their prefixes (the first ``n - ceil(percent * n / 100) + 1`` in the
   global order), so components of "shares a prefix gram", found from star edges, hold all links.
   A cluster of up to ``CELL_TEXTS`` texts is one cell. Larger ones are cut into bands of set sizes
   (links reach the next band at most) and salted blocks; each pair of blocks is a cell.
4. In a cell the global order is cut into fragments. Each fragment yields its partial overlaps as
   one product of incidence matrices, partial overlaps are summed per pair, and a pair is
   dropped as soon as the fragments left cannot lift it to its threshold. A cell returns a
   spanning forest of its links, never its pairs.
5. Components of all forests, joined back to the documents by their text's hash.

No cap anywhere: copies collapse before the first shuffle of grams, a hot gram only
contributes star edges, a large cluster only more cells.

Defined cases: null text or no word: empty set, linked with nothing; fewer words
than ``width`` are one gram, the whole sequence; a row with a null doc_id takes no part (empty set); repeated
rows each get their row; other columns are ignored; an empty table gives no row. Equal 64-bit gram
hashes inside a text are one gram (128-bit hashes tell texts apart).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.hashing import REACH, SLAB, Prefix, U, mix
from mnemolake.llm.tables import parts_for, table, text_bytes
from mnemolake.operators.clusters import components
from mnemolake.session import cut

WIDTH, PERCENT = 4, 85
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
CELL_TEXTS = 1024
#: Entries of one incidence matrix.
FRAGMENT_CELLS = 4 << 20
SEEN_TEXTS = 500_000


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), U)
    size = end - start
    usual = size <= REACH
    for at in range(0, len(data), SLAB):
        low, high = np.searchsorted(start, [at, at + SLAB])
        if low < high:
            prefix = Prefix(data[at : at + SLAB + REACH])
            own = np.flatnonzero(usual[low:high]) + low
            out[own] = prefix.stretches(start[own] - at, end[own] - at)
    for i in np.flatnonzero(~usual):
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    ends = np.cumsum(lengths + 1)
    per_text = np.diff(np.searchsorted(start, ends), prepend=0)
    return out, per_text


def gram_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text (not yet lower-cased)."""
    words, counts = word_hashes([t.lower() for t in texts])
    sets, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if not n:
            sets.append(np.zeros(0, U))
            continue
        k = min(n, width)
        h = np.full(n - k + 1, U(k))
        for j in range(k):
            h = mix(h * U(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j])
        sets.append(np.unique(h))
    return sets


def _texts(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts of a chunk with both hashes and the smallest document of each, in the order of the hashes."""
    found: dict[tuple[int, int], list] = {}
    for h1, h2, doc, text in zip(*(rows.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "body"))):
        held = found.setdefault((h1, h2), [doc, None])
        held[0] = min(held[0], doc)
        if text is not None:
            held[1] = text
    keys = sorted(found)
    return (
        [found[k][1] or b"" for k in keys], np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64),
        np.array([found[k][0] for k in keys], np.int64),
    )


def links_in(sets: list[np.ndarray], other: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix of links between ``sets`` (rows) and ``other`` (columns; None: themselves).

    Sets are sorted arrays in the global order, which is cut into fragments here.
    """
    cols = sets if other is None else other
    na, nb = np.array([len(s) for s in sets]), np.array([len(s) for s in cols])
    # 100 * both >= percent * (a + b - both)
    need = -(-percent * (na[:, None] + nb[None, :]) // (100 + percent))
    alive = np.minimum(na[:, None], nb[None, :]) >= need
    if not alive.any():
        return alive
    a_tok = np.concatenate(sets)
    a_row = np.repeat(np.arange(len(sets)), na)
    if other is None:
        b_tok, b_row = a_tok, a_row
        kept, count = np.unique(a_tok, return_counts=True)
        kept = kept[count > 1]
    else:
        b_tok, b_row = np.concatenate(cols), np.repeat(np.arange(len(cols)), nb)
        kept = np.intersect1d(a_tok, b_tok)
    total = np.zeros(alive.shape, np.int32)
    if not len(kept):
        return total >= need

    def places(tok: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(kept, tok), len(kept) - 1)
        held = kept[at] == tok
        return at[held], row[held]

    a_at, a_row = places(a_tok, a_row)
    b_at, b_row = (a_at, a_row) if other is None else places(b_tok, b_row)
    step = max(64, FRAGMENT_CELLS // (len(sets) + len(cols)))
    left_a = np.bincount(a_row, minlength=len(sets))
    left_b = np.bincount(b_row, minlength=len(cols))
    for begin in range(0, len(kept), step):
        wide = min(step, len(kept) - begin)

        def incidence(at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
            held = (at >= begin) & (at < begin + wide)
            m = np.zeros((n, wide), np.float32)
            m[row[held], at[held] - begin] = 1
            return m

        a = incidence(a_at, a_row, len(sets))
        b = a if other is None else incidence(b_at, b_row, len(cols))
        total += (a @ b.T).astype(np.int32)
        left_a = left_a - a.sum(axis=1).astype(np.int64)
        left_b = left_b - b.sum(axis=1).astype(np.int64)
        alive &= total + np.minimum(left_a[:, None], left_b[None, :]) >= need
        if not alive.any():
            return alive
    return alive & (total >= need)


def forest(links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """(text, smallest text it reaches) for the graph of a link matrix between two lists of texts."""
    names = np.unique(np.concatenate([rows, cols]))
    r, c = np.searchsorted(names, rows), np.searchsorted(names, cols)
    label = np.arange(len(names))
    i, j = np.nonzero(links)
    i, j = r[i], c[j]
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(names)))
    return list(zip(names[own].tolist(), names[label[own]].tolist()))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, n_members (texts in the component)."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"),
        F.col("text").cast("string").cast("binary").alias("body"),
    )
    total = text_bytes(named, "body")
    n_chunks, n_buckets = parts_for(total, CHUNK_BYTES, 12), parts_for(total, BUCKET_BYTES, 12)
    names = ["h1", "h2", "doc_id", "body"]
    layout = pa.schema([(c, pa.int64()) for c in names[:3]] + [("body", pa.binary())])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each text with the text, later ones only where their document is smaller."""
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            h1, h2, ids = (batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id"))
            take, bare = [], []
            for i, (a, b, doc) in enumerate(zip(h1, h2, ids)):
                held = seen.get((a, b))
                if held is None or doc < held:
                    (take if held is None else bare).append(i)
                    seen[a, b] = doc
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(take, pa.int64())) for c in columns], schema=layout)
            if bare:
                few = [c.take(pa.array(bare, pa.int64())) for c in columns[:3]]
                yield pa.RecordBatch.from_arrays([*few, pa.nulls(len(bare), pa.binary())], schema=layout)
            if len(seen) > SEEN_TEXTS:
                seen.clear()

    texts = named.filter(F.col("doc_id").isNotNull() & F.col("body").isNotNull()).select("h1", "h2", "doc_id", "body")
    chunks = texts.mapInArrow(once, "h1 long, h2 long, doc_id long, body binary").withColumn(
        "chunk", F.pmod(F.col("h1"), F.lit(n_chunks))
    )

    def report(key: tuple, rows: pa.Table) -> pa.Table:
        sets = gram_sets(_texts(rows)[0], width)
        grams = np.unique(np.concatenate(sets)) if sets else np.zeros(0, U)
        bucket, mark = (grams % U(n_buckets)).astype(np.int64), (grams // U(n_buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        keys, starts = np.unique(bucket[order], return_index=True)
        blobs = [np.unique(p).tobytes() for p in np.split(mark[order], starts[1:])] if len(keys) else []
        return pa.table([pa.array(keys, pa.int64()), pa.array([key[0].as_py()] * len(keys), pa.int64()), pa.array(blobs, pa.binary())], names=["key", "other", "data"])

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        chunk, blobs = rows.column("other").to_pylist(), [np.frombuffer(b, np.uint32) for b in rows.column("data").to_pylist()]
        mark, n = np.unique(np.concatenate(blobs), return_counts=True)
        mark, n = mark[n > 1], np.minimum(n[n > 1], 255).astype(np.uint8)
        out = []
        for c, own in zip(chunk, blobs):
            held = np.isin(mark, own, assume_unique=True)
            if held.any():
                out.append((c, key[0].as_py(), mark[held].tobytes() + n[held].tobytes()))
        cols = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["key", "other", "data"])

    def survivors(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        bodies, h1, h2, node = _texts(rows)
        sets = gram_sets(bodies, width)
        marks, counts = [np.zeros(0, U)], [np.zeros(0, np.uint8)]
        for bucket, blob in zip(answers.column("other").to_pylist(), answers.column("data").to_pylist()):
            n = len(blob) // 5
            marks.append(np.frombuffer(blob, np.uint32, n).astype(U) | U(bucket << 32))
            counts.append(np.frombuffer(blob, np.uint8, n, 4 * n))
        marks, counts = np.concatenate(marks), np.concatenate(counts)
        order = np.argsort(marks)
        marks, counts = marks[order], counts[order]
        grams = np.concatenate(sets) if sets else np.zeros(0, U)
        _, back, here = np.unique(grams, return_inverse=True, return_counts=True)
        mark = (grams // U(n_buckets)) & U(0xFFFFFFFF) | ((grams % U(n_buckets)) << U(32))
        at = np.minimum(np.searchsorted(marks, mark), max(0, len(marks) - 1))
        chunks_with = np.where(marks[at] == mark, counts[at], 1) if len(marks) else np.ones(len(grams), np.uint8)
        shared = (chunks_with > 1) | (here[back] > 1) if len(grams) else np.zeros(0, bool)
        # the place in the global order: how many chunks hold the gram, then its hash
        place = (chunks_with.astype(U) << U(56)) | (grams >> U(8))
        out, a = [], 0
        for i, s in enumerate(sets):
            n = len(s)
            own, held = place[a : a + n], shared[a : a + n]
            a += n
            keep = n > 0 and 100 * int(held.sum()) >= percent * n
            prefix = None
            if keep:
                by = np.argsort(own)
                first = by[: n - -(-percent * n // 100) + 1]
                prefix = own[first[held[first]]].view(np.int64).tolist()
                own = own[by]
            out.append((int(h1[i]), int(h2[i]), int(node[i]), n, own.tobytes() if keep else None, prefix))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h1", "h2", "node", "n", "grams", "prefix"])

    blob = "key long, other long, data binary"
    counted = chunks.groupBy("chunk").applyInArrow(report, blob).groupBy("key").applyInArrow(count, blob)
    texts_out = cut(
        chunks.groupBy("chunk").cogroup(counted.groupBy("key")).applyInArrow(
            survivors, "h1 long, h2 long, node long, n long, grams binary, prefix array<long>"
        )
    )
    prefix = texts_out.filter(F.size("prefix") > 0).select("node", F.explode("prefix").alias("gram"))
    stars = prefix.groupBy("gram").agg(F.min("node").alias("j"), F.max("node").alias("last")).filter("j < last").select("gram", "j")
    edges = prefix.join(stars, "gram").filter("node > j").select(F.col("node").alias("i"), "j").distinct()
    clusters = cut(components(edges))
    sized = clusters.groupBy("component").agg(F.count("*").alias("size"))
    member = texts_out.filter(F.col("grams").isNotNull()).select("node", "n", "grams").join(
        clusters.join(sized, "component").withColumnRenamed("id", "node"), "node"
    )
    found = _cell_links(member, percent)
    linked = components(found)
    extent = linked.groupBy("component").agg(F.count("*").alias("n_members"))
    by_text = texts_out.select("h1", "h2", "node", "n").join(
        linked.join(extent, "component").select(F.col("id").alias("node"), "component", "n_members"), "node", "left"
    ).select("h1", "h2", F.col("n").alias("_n"), F.coalesce("component", "node").alias("_c"), F.coalesce("n_members", F.lit(1)).alias("_m"))
    # copies and single texts alike: one lookup per text hash; the lookup side has one row per text
    out = named.select("doc_id", "h1", "h2").join(by_text, ["h1", "h2"], "left")
    has = (F.coalesce(F.col("_n"), F.lit(0)) > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(has, F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has, F.col("_m")).otherwise(F.lit(1)).cast("long").alias("n_members"),
    )


def _cell_links(member: DataFrame, percent: int) -> DataFrame:
    """Spanning forest (i, j) of the links inside every cluster; ``member`` has component, size, node, n, grams."""
    # a little wider than a link can reach, so that rounding moves none past the next band
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * float(np.log(100 / percent)) + 1e-9)).cast("long")
    large = F.col("size") > CELL_TEXTS
    banded = member.filter(large).select("component", "node", "n", "grams", band.alias("band"))
    blocks = banded.groupBy("component", "band").agg(F.ceil(F.count("*") / F.lit(CELL_TEXTS // 2)).alias("blocks"))
    ahead = blocks.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("ahead"))
    behind = blocks.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("behind"))
    around = blocks.join(ahead, ["component", "band"], "left").join(behind, ["component", "band"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    zero = F.lit(0).cast("long")

    def cell(b1, k1, b2, k2, side):
        return F.struct(b1.alias("b1"), k1.alias("k1"), b2.alias("b2"), k2.alias("k2"), F.lit(side).alias("side"))

    def to(n, make):
        return F.when(n > 0, F.transform(F.sequence(zero, n - 1), make)).otherwise(F.array().cast("array<struct<b1:bigint,k1:bigint,b2:bigint,k2:bigint,side:int>>"))

    b, k = F.col("band"), F.col("_own")
    here = to(F.col("blocks"), lambda x: F.when(x >= k, cell(b, k, b, x, 0)).otherwise(cell(b, x, b, k, 1)))
    up = to(F.coalesce("ahead", zero), lambda x: cell(b, k, b + 1, x, 0))
    down = to(F.coalesce("behind", zero), lambda x: cell(b - 1, x, b, k, 1))
    spread = banded.join(around, ["component", "band"]).withColumn("_own", own).select(
        "component", "node", "grams", F.explode(F.concat(here, up, down)).alias("c")
    ).select("component", "node", "grams", F.concat_ws(":", "c.b1", "c.k1", "c.b2", "c.k2").alias("cell"), "c.side")
    # small clusters: one cell each, many to a task
    small = member.filter(~large).select("component", "node", "grams", F.lit("").alias("cell"), F.lit(0).alias("side"))
    total = member.agg(F.sum(F.octet_length("grams").cast("long"))).first()[0] or 0
    n_groups = parts_for(total, CHUNK_BYTES, 12)
    dealt = small.unionByName(spread).withColumn("group", F.pmod(F.xxhash64("component", "cell"), F.lit(n_groups)))

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        cells: dict[tuple[int, str], list[list]] = {}
        cols = (rows.column(c).to_pylist() for c in ("component", "cell", "side", "node", "grams"))
        for comp, name, side, node, grams in zip(*cols):
            cells.setdefault((comp, name), [[], []])[side].append((node, grams))
        out: list[tuple[int, int]] = []
        for (_, name), (left, right) in cells.items():
            a = sorted(left)
            sets = [np.frombuffer(g, U) for _, g in a]
            nodes = np.array([n for n, _ in a], np.int64)
            if right:
                b = sorted(right)
                links = links_in(sets, [np.frombuffer(g, U) for _, g in b], percent) if a else np.zeros((0, len(b)), bool)
                out += forest(links, nodes, np.array([n for n, _ in b], np.int64))
            elif len(a) > 1:
                links = links_in(sets, None, percent)
                np.fill_diagonal(links, False)
                out += forest(links, nodes, nodes)
        i, j = zip(*out) if out else ((), ())
        return pa.table([pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["i", "j"])

    return dealt.groupBy("group").applyInArrow(link, "i long, j long")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set of 4-word shingles and their component at 85 percent."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
