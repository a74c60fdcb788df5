"""Exact substring dedup with a sparse suffix array, sorted deep-shallow.

Every byte covered by a ``WIDTH``-byte string that also starts in a document with a
smaller id is removed. Sorting all suffixes of a corpus would shuffle many
times its size, so suffixes are thinned without losing a match: each window of ``WIDTH`` bytes belongs
to the smallest-ranked ``GRAM``-byte gram inside it, neighbouring windows with one owner form a
fragment, and equal windows have equal owners, so they meet under the owner's hash.

1. Documents are dealt into chunks of a few megabytes. A chunk emits, per distinct (owner,
   fragment) hash, its smallest document: copies are counted before any shuffle.
2. Owners meet in buckets. Of equal fragments all but those of the smallest document are
   removed as a whole. Owners with several distinct fragments ask one chunk for the text of each.
3. The windows of these fragments are the suffixes that are sorted: multikey quicksort
   over 8-byte words to a shallow depth, then a blind trie per group whose common prefix is longer.
   Classes of equal windows say which windows of a fragment an earlier document has.
4. Chunks get the answers, mark windows, and cut the bytes.

Grams that are frequent in a bounded sample rank last. A gram inside a common passage then
owns a window only where all grams are common, so its fragments are equal everywhere and collapse in step 1; the sample
only balances the work, results do not depend on it. Gram hashes of 64 bits and fragment hashes of
48 bits must both agree; texts are compared byte by byte in step 3.

Defined cases: null text is empty; a null doc_id is neither a source nor changed;
equal doc_ids do not remove each other's strings; other columns are ignored; an empty table gives no
row; texts shorter than ``WIDTH`` are kept whole. A document of any length is worked on in slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.hashing import SLAB, Prefix, U, mix
from mnemolake.llm.tables import parts_for, sha256_hex, table, text_bytes

WIDTH = 50
GRAM = 20
#: Windows that start together may have any of 31 grams, so a fragment has at most 31 windows: one bit each.
SPREAD = WIDTH - GRAM + 1
WHOLE = np.uint32(1 << 31)
LOW48 = U((1 << 48) - 1)
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 1 << 14
FREQUENT_SHARE = 0.004
SHALLOW_WORDS = 4


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def fragments(data: np.ndarray, lengths: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Owner hash, fragment hash, document number, first and last window start of every fragment."""
    ends = np.cumsum(lengths)
    found = []
    for at in range(0, max(0, len(data) - WIDTH + 1), SLAB):
        slab = data[at : at + SLAB + WIDTH - 1]
        prefix = Prefix(slab)
        gram = prefix.grams(GRAM)
        rank = gram >> U(1)
        if frequent is not None:
            rank |= frequent[(gram >> U(48)).astype(np.int64)]
        place = np.arange(len(gram), dtype=U)
        least = _smallest((rank & ~U(63)) | (place & U(63)), SPREAD)
        start = np.arange(len(least), dtype=np.int64)
        low, high = np.searchsorted(ends, [at, at + len(least) - 1], side="right")
        doc = np.zeros(len(least), np.int64)
        np.add.at(doc, ends[low:high] - at, 1)
        doc = np.cumsum(doc) + low
        start = start[at + start + WIDTH <= ends[doc]]
        if not len(start):
            continue
        own = start + ((least[start].astype(np.int64) - start) & 63)
        new = np.ones(len(start), bool)
        new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])
        first = np.flatnonzero(new)
        s0, s1 = start[first], start[np.append(first[1:] - 1, len(start) - 1)]
        found.append((gram[own[first]], prefix.stretches(s0, s1 + WIDTH) & LOW48, doc[s0], s0 + at, s1 + at))
    if not found:
        return (np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*found))


def _chunk(docs: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids with null as None, bodies, bytes of all texts with an id end to end, lengths (0 without an id), and the id per document.

    Rows of a chunk arrive in any order; they are put into one order, so that
    every pass over a chunk finds the same slabs and fragments.
    """
    ids, bodies = docs.column("doc_id").to_pylist(), [t or b"" for t in docs.column("body").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, bodies[i]))
    ids, bodies = [ids[i] for i in order], [bodies[i] for i in order]
    texts = [t if i is not None else b"" for i, t in zip(ids, bodies)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    return ids, bodies, data, np.array([len(t) for t in texts], np.int64), np.array([i or 0 for i in ids], np.int64)


def _classes(h: np.ndarray, f: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (owner, fragment, document), and where each class begins in it."""
    order = np.lexsort((doc, f, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (f[order[1:]] != f[order[:-1]])
    return order, np.flatnonzero(new)


class Chunk:
    """Fragments of a chunk's documents and their classes of equal owner and fragment hashes.

    Classes are numbered in the order of their hashes, and within each bucket in that
    order too: a bucket's answer names a class by its place there, which every pass over the chunk finds again.
    """

    def __init__(self, docs: pa.Table, frequent: np.ndarray | None, n_buckets: int):
        self.raw, self.bodies, self.data, self.lengths, self.ids = _chunk(docs)
        self.h, self.f, self.doc, self.s0, self.s1 = fragments(self.data, self.lengths, frequent)
        self.order, self.first = _classes(self.h, self.f, self.ids[self.doc])
        #: the fragment of each class in its smallest document
        self.first_of = self.order[self.first]
        bucket = (self.h[self.first_of] % U(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        keys, starts = np.unique(bucket[by], return_index=True)
        self.by_bucket = dict(zip(keys.tolist(), np.split(by, starts[1:]))) if len(keys) else {}


def _blobs(key: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One (key, kind, packed columns) per distinct key."""
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    for k, part in zip(keys.tolist(), np.split(order, starts[1:])):
        yield k, kind, b"".join(c[part].tobytes() for c in columns)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(blob, k, n, at))
        at += size
    return out


def _packed(h: np.ndarray, f: np.ndarray, doc: np.ndarray) -> bytes:
    """Owner hashes, 48-bit fragment hashes and documents in as few bytes as hold them: the corpus' largest shuffle."""
    wide = len(doc) and (doc.min() < 0 or doc.max() >= 1 << 32)
    docs = doc if wide else doc.astype(np.uint32)
    return b"".join([b"\1" if wide else b"\0", h.tobytes(), f.astype(np.uint32).tobytes(), (f >> U(32)).astype(np.uint16).tobytes(), docs.tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, low, high, doc = _unpack(blob[1:], U, np.uint32, np.uint16, np.int64 if blob[0] else np.uint32)
    return h, low.astype(U) | (high.astype(U) << U(32)), doc.astype(np.int64)


class BlindTrie:
    """Patricia trie over suffixes of ``text`` that are compared to ``width`` bytes: inner nodes keep only the branching position."""

    def __init__(self, text: bytes, width: int = WIDTH):
        self.text, self.width, self.root = text, width, None

    def add(self, start: int) -> list[int]:
        """Insert a suffix; returns the list of suffixes equal to it."""
        text, width = self.text, self.width
        if self.root is None:
            self.root = [start]
            return self.root
        node = self.root
        while isinstance(node, tuple):
            at, children = node
            node = children.get(text[start + at]) or next(iter(children.values()))
        other = node[0]
        mine, theirs = text[start : start + width], text[other : other + width]
        if mine == theirs:
            node.append(start)
            return node
        same = (8 * width - (int.from_bytes(mine) ^ int.from_bytes(theirs)).bit_length()) // 8
        leaf = [start]
        # the place is the edge into the first node that branches behind the common prefix
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][text[start + node[0]]]
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine[same]] = leaf
            return leaf
        inner = (same, {theirs[same]: node, mine[same]: leaf})
        if parent is None:
            self.root = inner
        else:
            parent[1][text[start + parent[0]]] = inner
        return leaf

    def classes(self) -> Iterator[list[int]]:
        """Lists of equal suffixes in lexicographic order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def sort_windows(text: bytes, starts: np.ndarray, shallow: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the windows at ``starts``: their order, and the class number of each place in it.

    Shallow: ternary splits word by word (8 bytes a step) as in multikey quicksort; a
    group of one is done. Deep: groups that still agree after ``shallow`` words go through a blind trie.
    """
    data = np.frombuffer(text + b"\0" * 8, np.uint8)
    word = np.zeros(len(text) + 1, ">u8").astype(U)
    for k in range(8):
        word |= data[k : len(text) + 1 + k].astype(U) << U(56 - 8 * k)
    n = len(starts)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # group number of each place, ascending
    open_ = np.arange(n)  # places whose group has more than one member
    for depth in range(shallow):
        if not len(open_):
            break
        own = order[open_]
        w = word[starts[own] + 8 * depth]
        by = np.lexsort((w, group[open_]))
        order[open_] = own[by]
        w, g = w[by], group[open_]
        new = np.zeros(n, bool)
        new[0] = True
        new[1:] = group[1:] != group[:-1]
        inside = np.flatnonzero((w[1:] != w[:-1]) & (g[1:] == g[:-1])) + 1
        new[open_[inside]] = True
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)
    if len(open_):
        bounds = np.flatnonzero(np.diff(group[open_], prepend=-1))
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        for part in np.split(open_, bounds[1:]):
            members = order[part]
            trie = BlindTrie(text)
            by_start: dict[int, list[int]] = {}
            for i, s in zip(members.tolist(), starts[members].tolist()):
                if s in by_start:
                    by_start[s].append(i)
                    continue
                by_start[s] = [i]
                trie.add(s)
            at = int(part[0])
            for equal in trie.classes():
                new[at] = True
                for s in equal:
                    for i in by_start[s]:
                        order[at] = i
                        at += 1
        group = np.cumsum(new) - 1
    return order, group


def frequent_grams(docs: DataFrame, n_docs: int) -> np.ndarray | None:
    """Rank bit per leading 16 bits of a gram hash, set for grams in many documents of a sample of about ``SAMPLE_DOCS`` (of each at most ``SAMPLE_BYTES``)."""
    share = min(1 << 30, (1 << 30) * SAMPLE_DOCS // max(1, n_docs))
    thin = docs.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id", "body"), F.lit(1 << 30)) < share)
    rows = thin.select(F.substring("body", 1, SAMPLE_BYTES).alias("body")).limit(2 * SAMPLE_DOCS).collect()
    if not rows:
        return None
    seen: list[np.ndarray] = []
    for r in rows:
        data = np.frombuffer(bytes(r["body"] or b""), np.uint8)
        if len(data) >= GRAM:
            seen.append(np.unique(Prefix(data).grams(GRAM)))
    if not seen:
        return None
    grams, count = np.unique(np.concatenate(seen), return_counts=True)
    often = grams[count >= max(6, FREQUENT_SHARE * len(rows))]
    bits = np.zeros(1 << 16, U)
    bits[(often >> U(48)).astype(np.int64)] = U(1) << U(63)
    return bits


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut repeated strings from ``docs(doc_id, text)``.

    Returns doc_id, n_bytes, kept (binary: the remaining bytes) and spans (start and
    length in bytes of each maximal removed run). Repeated rows are kept, each with its result.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body"))
    total, n_docs = text_bytes(body, "body"), body.count()
    n_chunks, n_buckets = parts_for(total, CHUNK_BYTES, 12), parts_for(total, BUCKET_BYTES, 12)
    frequent = frequent_grams(body, n_docs)
    chunks = body.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "body"), F.lit(n_chunks)))
    names = ["key", "kind", "data"]
    schema = "key long, kind long, data binary"

    def emit(key: tuple, docs: pa.Table) -> pa.Table:
        own = Chunk(docs, frequent, n_buckets)
        c = own.first_of
        rows = [
            (b, key[0].as_py(), _packed(own.h[c[p]], own.f[c[p]], own.ids[own.doc[c[p]]])) for b, p in own.by_bucket.items()
        ]
        return _table(rows, names)

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        unpacked = [_unpacked(b) for b in rows.column("data").to_pylist()]
        sizes = [len(u[0]) for u in unpacked]
        h, f, d = (np.concatenate(c) for c in zip(*unpacked))
        chunk = np.repeat(rows.column("kind").to_numpy(), sizes)
        number = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        order, first = _classes(h, f, d)
        h, d, chunk, number = h[order], d[order], chunk[order], number[order]
        whole = d > np.repeat(d[first], np.diff(np.append(first, len(h))))
        # owners with fragments of different texts whose smallest documents differ
        ch, cd = h[first], d[first]
        begin = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        differ = np.minimum.reduceat(cd, begin) < np.maximum.reduceat(cd, begin)
        ask = first[np.repeat(differ, np.diff(np.append(begin, len(ch))))]
        head = key[0].as_py().to_bytes(8, "little")
        out = _blobs(chunk[whole], 0, number[whole]), _blobs(chunk[ask], 1, number[ask])
        return _table([(k, kind, head + b) for part in out for k, kind, b in part], names)

    def texts(key: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        kind, blobs = asked.column("kind").to_pylist(), asked.column("data").to_pylist()
        # answers that are already known pass through, in a bucket that the chunk's number chooses
        rows = [(key[0].as_py() % n_buckets, -1 - key[0].as_py(), b) for k, b in zip(kind, blobs) if k == 0]
        wanted = [b for k, b in zip(kind, blobs) if k == 1]
        if wanted:
            own = Chunk(docs, frequent, n_buckets)
            for blob in wanted:
                bucket, number = int.from_bytes(blob[:8], "little"), np.frombuffer(blob, np.uint32, offset=8)
                part = own.first_of[own.by_bucket[bucket][number]]
                s0, s1 = own.s0[part], own.s1[part] + WIDTH
                text = b"".join([own.data[a:b].tobytes() for a, b in zip(s0.tolist(), s1.tolist())])
                doc, size = own.ids[own.doc[part]], (s1 - s0).astype(np.uint8)
                rows.append((bucket, key[0].as_py(), b"".join([len(part).to_bytes(4, "little"), number.tobytes(), doc.tobytes(), size.tobytes(), text])))
        return _table(rows, names)

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        out, parts, texts_ = [], [], []
        for chunk, blob in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist()):
            if chunk < 0:
                out.append((-1 - chunk, 0, blob))
                continue
            n = int.from_bytes(blob[:4], "little")
            parts.append((*_unpack(blob[4 : 4 + 13 * n], np.uint32, np.int64, np.uint8), np.full(n, chunk)))
            texts_.append(blob[4 + 13 * n :])
        if parts:
            number, d, size, chunk = [np.concatenate(c) for c in zip(*parts)]
            n_windows = size.astype(np.int64) - WIDTH + 1
            begin = np.concatenate([[0], np.cumsum(size.astype(np.int64))[:-1]])
            frag = np.repeat(np.arange(len(d)), n_windows)
            inside = np.arange(len(frag)) - np.repeat(np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows)
            order, group = sort_windows(b"".join(texts_), begin[frag] + inside)
            doc = d[frag[order]]
            least = np.minimum.reduceat(doc, np.flatnonzero(np.diff(group, prepend=-1)))
            hit = order[doc > least[group]]
            bits = np.zeros(len(d), np.uint32)
            np.bitwise_or.at(bits, frag[hit], np.uint32(1) << inside[hit].astype(np.uint32))
            told = np.flatnonzero(bits)
            head = key[0].as_py().to_bytes(8, "little")
            out += [(k, 1, head + b) for k, _, b in _blobs(chunk[told], 1, number[told], bits[told])]
        return _table(out, names)

    def cut_out(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = Chunk(docs, frequent, n_buckets)
        raw, data, lengths, ids, doc, s0, s1 = own.raw, own.data, own.lengths, own.ids, own.doc, own.s0, own.s1
        order, first = own.order, own.first
        mask = np.zeros(len(first), np.uint32)
        for kind, blob in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()):
            mine = own.by_bucket[int.from_bytes(blob[:8], "little")]
            if kind == 0:
                mask[mine[np.frombuffer(blob, np.uint32, offset=8)]] |= WHOLE
            else:
                number, bits = _unpack(blob[8:], np.uint32, np.uint32)
                mask[mine[number]] |= bits
        sizes = np.diff(np.append(first, len(order)))
        every = (ids[doc[order]] > np.repeat(ids[doc[own.first_of]], sizes)) | (np.repeat(mask, sizes) & WHOLE > 0)
        some = np.flatnonzero(~every & (np.repeat(mask, sizes) > 0))
        hit = np.zeros(len(data) + 1, np.int32)
        whole = order[every]
        np.add.at(hit, s0[whole], 1)
        np.add.at(hit, s1[whole] + WIDTH, -1)
        partly, m = order[some], np.repeat(mask, sizes)[some]
        for j in range(SPREAD):
            at = s0[partly[(m >> np.uint32(j)) & np.uint32(1) > 0]] + j
            np.add.at(hit, at, 1)
            np.add.at(hit, at + WIDTH, -1)
        gone = np.cumsum(hit)[:-1] > 0
        begin = np.cumsum(lengths) - lengths
        kept, spans, n_bytes = [], [], []
        bodies = own.bodies
        for i, (b, n) in enumerate(zip(begin.tolist(), lengths.tolist())):
            mine = gone[b : b + n]
            if raw[i] is None or not mine.any():
                kept.append(bodies[i])
                spans.append([])
            else:
                kept.append(data[b : b + n][~mine].tobytes())
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "length": e - s} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
            n_bytes.append(len(bodies[i]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table(
            [pa.array(raw, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)],
            names=["doc_id", "n_bytes", "kept", "spans"],
        )

    met = chunks.groupBy("chunk").applyInArrow(emit, schema).groupBy("key").applyInArrow(meet, schema)
    sent = chunks.groupBy("chunk").cogroup(met.groupBy("key")).applyInArrow(texts, schema)
    answers = sent.groupBy("key").applyInArrow(sort, schema)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("key")).applyInArrow(
        cut_out, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>"
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without 50-byte strings of earlier ones."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return out.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        sha256_hex(F.col("kept")).alias("kept_sha256"),
    )
