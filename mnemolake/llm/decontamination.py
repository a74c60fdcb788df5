"""Benchmark decontamination: occurrences of test strings by Wu-Manber multi-pattern search.

Texts become words (A-Z folded, everything but letters, digits and characters beyond ASCII parts words), joined by single blanks. The
test strings are all windows of ``WINDOW`` words of the items, with the blanks around them, so an
occurrence never starts or ends inside a word. Tables of a set of test strings hold, for the hash of each block of
bytes in their first m bytes, how far the search may move on; positions whose block ends a test string's m bytes look up
the bucket of that block and of the first bytes, and the strings found there are compared byte by byte. Test strings are
dealt into classes by length with tables of their own, so a short item does not shorten everyone's moves.
A task searches stretches of a batch of documents side by side with NumPy.

Documents are read once and never shuffled. Items are cut into pieces and dealt into groups of about
``TABLE_BYTES``; one group's tables are broadcast. A benchmark of several groups is searched group by group over the
checkpointed documents, and the hits of a document are merged by its row.

Defined cases: null or wordless texts have no words and no hit; items without words occur nowhere; an item of fewer words than a window
is one window; repeated items count once per id, a null item id counts as the empty string; repeated documents are searched
each; a null doc_id is carried; other columns are ignored; an empty table of items leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.tables import parts_for, table
from mnemolake.session import cut

WINDOW = 10
#: Bytes of item texts whose tables are broadcast together.
TABLE_BYTES = 4 << 20
#: Words of an item that are dealt together; neighbouring pieces share all words but one of a window.
PIECE_WORDS = 20_000
#: Bytes of text that a task searches at once, and the length of the stretches in them that advance side by side.
BATCH_BYTES = 4 << 20
STRETCH = 2048
#: Pairs of position and test string that are compared at once.
PAIRS = 1 << 18
#: Least lengths of the classes of test strings, and the bytes of a block in each.
CLASSES = ((3, 2), (6, 4), (12, 6), (24, 8))
MOST_MOVE = 255
U = np.uint64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def joined(words: list[bytes]) -> bytes:
    """Words with one blank before, between and behind them."""
    return b" %b " % b" ".join(words) if words else b""


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from every position of ``data`` on as one integer; ``data`` ends in eight bytes that do not count."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    return x * U(0xD6E8FEB86659FD93)


def _mask(size: int) -> np.uint64:
    return U((1 << (8 * min(size, 8))) - 1)


class ShiftTables:
    """Tables of one class of test strings, given by their places in ``data``."""

    def __init__(self, eights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, block: int):
        self.m, self.block = int(min(sizes.min(), MOST_MOVE)), block
        self.last = self.m - block
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(starts) * (self.last + 1))), 10, 22))
        self.moves = np.full(1 << self.bits, self.last + 1, np.uint8)
        for j in range(self.last + 1):  # later blocks allow smaller moves and overwrite
            self.moves[self.slots(eights[starts + j])] = self.last - j
        keys = self.keys(eights[starts], eights[starts + self.last])
        order = np.argsort(keys, kind="stable")
        self.bucket_keys, self.bucket = keys[order], numbers[order]

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        return _mix(blocks & _mask(self.block)) >> U(64 - self.bits)

    def keys(self, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        return _mix(_mix(heads & _mask(self.m)) ^ (tails & _mask(self.block)))

    def candidates(self, eights: np.ndarray, size: int) -> np.ndarray:
        """Positions whose block ends the first m bytes of some test string."""
        ends = np.minimum(np.arange(0, size, STRETCH, dtype=np.int64) + STRETCH, size - self.m + 1)
        at = np.arange(0, size, STRETCH, dtype=np.int64)
        at, ends, found = at[at < ends], ends[at < ends], []
        while len(at):
            move = self.moves[self.slots(eights[at + self.last])]
            stop = move == 0
            if stop.any():
                found.append(at[stop])
            at = at + np.maximum(move, 1)
            alive = at < ends
            if not alive.all():
                at, ends = at[alive], ends[alive]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class TestStrings:
    """All windows of some items, each different window once, with the items that hold it."""

    __test__ = False

    def __init__(self, pieces: list[tuple[str, bytes]], window: int = WINDOW):
        self.items: list[str] = sorted({item for item, _ in pieces})
        number_of = {item: i for i, item in enumerate(self.items)}
        seen: dict[bytes, int] = {}
        starts, sizes, words, holders = [], [], [], []
        at = 0
        for item, text in pieces:
            blanks = [i for i, c in enumerate(text) if c == 32]
            n = min(window, len(blanks) - 1)
            for a, b in zip(blanks, blanks[n:]):
                number = seen.setdefault(text[a : b + 1], len(starts))
                if number == len(starts):
                    starts.append(at + a)
                    sizes.append(b + 1 - a)
                    words.append(n)
                    holders.append([])
                if not holders[number] or holders[number][-1] != number_of[item]:
                    holders[number].append(number_of[item])
            at += len(text)
        del seen
        self.data = b"".join(text for _, text in pieces) + bytes(8)
        self.starts, self.sizes, self.words = (np.array(x, np.int64) for x in (starts, sizes, words))
        self.first_holder = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
        self.holders = np.array([i for h in holders for i in h], np.int32)
        least = np.array([c for c, _ in CLASSES])
        kind = np.searchsorted(least, self.sizes, "right") - 1
        eights = _eights(self.data)
        self.tables = [ShiftTables(eights, self.starts[kind == c], self.sizes[kind == c], np.flatnonzero(kind == c), block) for c, (_, block) in enumerate(CLASSES) if (kind == c).any()]

    def occurrences(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(position, test string) of every occurrence in ``data``, which ends in eight bytes that do not count."""
        text, own, size = _eights(data), _eights(self.data), len(data) - 8
        places, numbers = [], []
        for t in self.tables:
            at = t.candidates(text, size)
            keys = t.keys(text[at], text[at + t.last])
            low, high = np.searchsorted(t.bucket_keys, keys, "left"), np.searchsorted(t.bucket_keys, keys, "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            upto = np.cumsum(count)
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
                n = count[begin:end]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place, number = np.repeat(at[begin:end], n), t.bucket[np.repeat(low[begin:end], n) + offset]
                same = self._equal(text, own, size, place, number)
                places.append(place[same])
                numbers.append(number[same])
                begin = end
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(numbers)

    def _equal(self, text: np.ndarray, own: np.ndarray, size: int, place: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which pairs agree in every byte."""
        start, length = self.starts[number], self.sizes[number]
        left = np.flatnonzero(place + length <= size)
        short = length[left] < 8
        mask = U(0xFFFFFFFFFFFFFFFF) >> (U(8) * np.maximum(8 - length[left], 0).astype(U))
        left = left[((text[place[left]] ^ own[start[left]]) & np.where(short, mask, U(0xFFFFFFFFFFFFFFFF))) == 0]
        at, done = 8, [left[length[left] <= 8]]
        left = left[length[left] > 8]
        while len(left):
            here = np.minimum(at, length[left] - 8)
            left = left[text[place[left] + here] == own[start[left] + here]]
            at += 8
            done.append(left[length[left] <= at])
            left = left[length[left] > at]
        return np.concatenate(done)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Intervals as maximal runs, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return [{"start": int(starts[a]), "end": int(reach[b])} for a, b in zip(first, last)]


def hits_of(words: list[list[bytes]], strings: TestStrings) -> dict[int, tuple[list[dict[str, int]], list[str]]]:
    """Word runs inside occurrences and the items that occur, for those of some texts that have any."""
    texts = [joined(w) for w in words]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    place, number = strings.occurrences(b"\n".join([*texts, bytes(8)]))
    order = np.argsort(place, kind="stable")
    place, number = place[order], number[order]
    doc = np.searchsorted(first, place, "right") - 1
    out = {}
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        blanks = np.flatnonzero(np.frombuffer(texts[d], np.uint8) == 32)
        word = np.searchsorted(blanks, place[a:b] - first[d])
        held = {i for n in np.unique(number[a:b]).tolist() for i in strings.holders[strings.first_holder[n] : strings.first_holder[n + 1]].tolist()}
        out[d] = merged(word, word + strings.words[number[a:b]]), [strings.items[i] for i in sorted(held)]
    return out


def item_pieces(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, piece, words: item texts as words, long ones in pieces that share all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    out.append((item or "", at, joined(words[at : at + PIECE_WORDS + window - 1])))
            names = ["item", "piece", "words"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], names=names)

    picked = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "item string, piece long, words binary")


FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _search(docs: DataFrame, held, only_hits: bool) -> DataFrame:
    """The first column of ``docs`` (key, text) with words, spans and items; held: a broadcast of TestStrings or None."""
    name = docs.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = held.value if held is not None else None
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), BATCH_BYTES, "right")))
                words = [words_of(t.as_py()) for t in texts[begin:end]]
                hits = hits_of(words, strings) if strings is not None else {}
                at = sorted(hits) if only_hits else range(len(words))
                cols = [[len(words[d]) for d in at], [hits[d][0] if d in hits else [] for d in at], [hits[d][1] if d in hits else [] for d in at]]
                key = keys[begin:end].take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([key, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[name, "n_words", "spans", "items"])
                begin = end

    return docs.mapInArrow(run, f"`{name}` {docs.schema[0].dataType.simpleString()}, {FOUND}")


def contaminations(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """doc_id, n_words, spans (maximal runs of hit words, end exclusive) and items (sorted ids that occur) of every document."""
    spark = docs.sparkSession
    pieces = cut(item_pieces(items, window))
    n_groups = parts_for(int(pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0), table_bytes)
    group = F.pmod(F.xxhash64("item", "piece"), F.lit(n_groups))

    def strings(g: int):
        # a group's bytes are bounded, whatever the benchmark holds
        found = [(r["item"], bytes(r["words"])) for r in pieces.filter(group == g).select("item", "words").collect()]
        return spark.sparkContext.broadcast(TestStrings(sorted(found), window)) if found else None

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if n_groups == 1:
        return _search(picked, strings(0), False)
    rows = cut(picked.select(F.monotonically_increasing_id().alias("_row"), "text", "doc_id"))
    found = None
    for g in range(n_groups):
        part = cut(_search(rows.select("_row", "text"), strings(g), True).drop("n_words"))
        found = part if found is None else found.unionByName(part)
    # a row's hits of all groups: no more than its words allow
    both = found.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    base = _search(rows.select(F.struct("_row", "doc_id").alias("key"), "text"), None, False).select("key.*", "n_words")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return base.join(both, "_row", "left").select(
        "doc_id", "n_words", _runs(F.coalesce("spans", none)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _runs(spans):
    """Spans of several groups as maximal runs."""

    def add(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start: bigint, end: bigint>>"), add)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten benchmark words, and the items that occur."""
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# the tables' ids are no nulls and each of its own
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
g AS (SELECT item_id, least({WINDOW}, len(w)) AS k, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS pos, w FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[pos + 1 : pos + k], ' ') AS s FROM g),
t AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(len(w) - k + 1)) AS pos FROM d JOIN (SELECT DISTINCT k FROM p) ON len(w) >= k)),
h AS (SELECT t.doc_id, t.k, t.pos, p.item_id FROM t JOIN p USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
