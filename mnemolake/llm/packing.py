"""Packing of token sequences: first-fit decreasing in randomised groups of documents.

Documents are tokenized in tasks; only piece sizes and checksums are shuffled. A
document longer than a sequence is cut into full pieces and a rest. Pieces are
dealt by a hash of the document (and of its place in its task, so that repeated
rows spread) into groups of about ``group_docs`` documents, and each group is
packed on its own: pieces in decreasing length go to the first bin with room, found in
a tournament tree whose inner nodes hold the largest free capacity below them.

A group's size follows from the row count, never from a key, so a source or a group of
copies that holds a third of all rows is spread over all groups. Defined cases: a null text is
empty and yields the end id alone; repeated rows are packed each; a null doc_id is
carried; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.tables import keep_only, parts_for, table

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 4096
#: Words whose ids a worker keeps; beyond it the table is started anew.
KEPT_WORDS = 700_000
OUT_ROWS = 20_000


class WordTokens(dict):
    """Packed 32-bit ids by white-space separated word, at most KEPT_WORDS.

    The tokenizer's normalizer and pre-tokenizer end at blanks and line feeds, so the ids of a
    text are those of its words in order. Commas and stops behind a letter or digit
    are tokens of their own and case is dropped, so a word is looked up again without them
    before the tokenizer is asked. ``fill`` encodes the new words of a text at once.
    """

    def __init__(self, model_file: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_file)
        self[""] = b""

    @staticmethod
    def core(word: str) -> tuple[str, str]:
        """The word as it is looked up, and the commas and stops behind it."""
        if word.isascii():
            word = word.lower()
        stem = word.rstrip(",.")
        # a letter that is no ASCII may end in a mark once its case is dropped
        return (stem, word[len(stem) :]) if stem and stem[-1].isascii() and stem[-1].isalnum() else (word, "")

    def fill(self, words: list[str]) -> None:
        missing = {w for w in words if w not in self}
        if not missing:
            return
        if len(self) + 2 * len(missing) > KEPT_WORDS:
            self.clear()
            self[""] = b""
            missing = set(words)
        parts = {w: self.core(w) for w in missing}
        asked = list({p for pair in parts.values() for p in pair if p not in self})
        if asked:
            found = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
            self.update(zip(asked, [array("I", e.ids).tobytes() for e in found]))
        self.update({w: self[a] + self[b] for w, (a, b) in parts.items()})

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        self.fill(words)
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def _tokens(model_file: str) -> WordTokens:
    return WordTokens(model_file)


def default_model(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bins:
    """Open bins in a tournament tree of free capacities; finds the first bin with room."""

    def __init__(self, capacity: int, most: int):
        self.capacity = capacity
        self.leaves = 1
        while self.leaves < most:
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of a piece of ``size`` tokens."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        offset = self.capacity - free[at]
        free[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            most = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == most:
                break
            free[at] = most
        return leaf, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset per piece, given in decreasing order of size."""
    bins = Bins(capacity, max(1, len(sizes)))
    return [bins.place(size) for size in sizes]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, model_file: str | None = None, end_id: int = END_ID, keep_ids: bool = True
) -> DataFrame:
    """Pieces of every document's ids: doc_id, start, length, ids_crc32, doc_tokens, row_in_task, and the ids if kept."""
    path = model_file
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens(path or default_model())
        keep_only("packing", own)
        seen = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows))
                kinds = [kind] + [pa.int64()] * 5 + ([pa.list_(pa.int32())] if keep_ids else [])
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = own.encode(text.as_py() or "") + end
                total = len(packed) // 4
                for start in range(0, total, capacity):
                    piece = packed[4 * start : 4 * (start + capacity)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, seen)
                    rows.append(row + (array("i", piece).tolist(),) if keep_ids else row)
                    if len(rows) >= (OUT_ROWS // 50 if keep_ids else OUT_ROWS):
                        yield out()
                        rows = []
                seen += 1
            if rows:
                yield out()

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_in_task"] + (["ids"] if keep_ids else [])
    schema = f"doc_id {picked.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:6])
    return picked.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def pack(pieces: DataFrame, n_groups: int, capacity: int = CAPACITY, seed: int = 20) -> DataFrame:
    """Place pieces into sequences: adds sequence_id and offset to the columns of ``pieces``."""
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row_in_task"), F.lit(n_groups)))
    kept = [c for c in pieces.columns if c != "row_in_task"]

    def place(key: tuple, group: pa.Table) -> pa.Table:
        # ties in length go by what the row says, so a second attempt packs alike
        order = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        found = first_fit_decreasing(order.column("length").to_pylist(), capacity)
        first = key[0].as_py() << 32
        out = order.select(kept)
        out = out.append_column("sequence_id", pa.array([first + b for b, _ in found], pa.int64()))
        return out.append_column("offset", pa.array([o for _, o in found], pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    return dealt.groupBy("_group").applyInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, model_file: str | None = None, end_id: int = END_ID,
    group_docs: int = GROUP_DOCS, keep_ids: bool = True,
) -> DataFrame:
    """Tokenize and pack all documents: one row per piece with its place (and its ids, if kept)."""
    n_groups = parts_for(docs.count(), group_docs)
    return pack(token_pieces(docs, capacity, model_file, end_id, keep_ids), n_groups, capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
