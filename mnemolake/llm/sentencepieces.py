"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A merge-type (BPE) encoding is valid exactly when every token re-merges to itself and
every adjacent pair of tokens, merged again from its characters, comes out as
that pair. The encoder walks over a chunk with the longest vocabulary
match found by an Aho-Corasick automaton, checks the new token against the one before it,
falls back to shorter matches, and steps back when none is left; a bitfield
keeps the positions from which no valid encoding was found, so that none is tried
twice. Characters outside the vocabulary become byte tokens.

Chunks: if no vocabulary piece has a word mark behind another character, no merge crosses
the place before a run of word marks, so a text is encoded chunk by chunk and
frequent chunks are kept in a bounded table of each worker. Otherwise the
whole text is one chunk.

Work is row by row, so a hot source or an executor loss only costs its own rows. Defined
cases: null text is empty (the end id only); a repeated row is encoded again; a null
doc_id is carried; other columns are ignored; an empty table gives an empty result.
Models with user-defined or unused pieces, or of another type, are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.tables import sha256_hex, table

MARK = "▁"
#: Chunks and token pairs that a worker keeps; beyond it the table is started anew.
KEPT_CHUNKS = 700_000
KEPT_PAIRS = 400_000
OUT_BYTES = 8 << 20
#: Above every id and code point, so that a pair of tokens is one number.
PAIR_STEP = 4_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Codec:
    """Encoder and decoder of one model file."""

    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        with open(model_file, "rb") as f:
            proto = f.read()
        pieces, normalizer, trainer = [], {3: 1, 4: 1, 5: 1}, {}
        for number, value in _fields(proto):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer |= dict(_fields(value))
        kinds = [p.get(3, self.NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or set(kinds) - {self.NORMAL, self.UNKNOWN, self.CONTROL, self.BYTE}:
            raise ValueError("only merge-type models without user-defined or unused pieces are encoded")
        if trainer.get(24):
            raise ValueError("models with word marks as suffixes are not encoded")
        texts = [p.get(1, b"").decode("utf-8") for p in pieces]
        self.texts = texts
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == self.NORMAL}
        self.scores = {t: pieces[i].get(2, 0.0) for t, i in self.ids.items()}
        self.unknown = kinds.index(self.UNKNOWN)
        self.bytes = {int(texts[i][3:5], 16): i for i, k in enumerate(kinds) if k == self.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, k in enumerate(kinds) if k == self.CONTROL}
        self.end = next(i for i, t in enumerate(texts) if kinds[i] == self.CONTROL and t == "</s>")
        # pieces that no merge of their own characters yields never occur in an encoding
        self.sizes = [len(t) for t in texts]
        reached = {t: i for t, i in self.ids.items() if len(t) == 1 or len(self.merged(t)) == 1}
        self.automaton = ahocorasick.Automaton()
        for t, i in reached.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((reached[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reached), None) for t, i in reached.items()}
        self.reached = reached
        self.plain = not normalizer.get(2) and normalizer[3] and not normalizer[4] and normalizer[5]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.splits = not any(MARK in t.lstrip(MARK) for t in self.ids)
        # characters that no longer piece contains stand alone, whatever is around them
        longer = {c for t in self.ids if len(t) > 1 for c in t}
        alone = [c for c in "\n\t\r" if c not in longer]
        self.alone = re.compile("([" + "".join(map(re.escape, alone)) + "])") if alone else None
        self.chunk_of = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = _Chunks(self)
        self.words: dict[str, bytes] = _Chunks(self, MARK)
        self.shown = ["" if i in self.silent else " ⁇ " if i == self.unknown else t.replace(MARK, " ") for i, t in enumerate(texts)]

    def merged(self, text: str) -> list[str]:
        """Merge ``text`` from its characters: best score first, leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens re-merge to themselves. Negative: a character outside the vocabulary."""
        key = a * PAIR_STEP + b
        found = self.pairs.get(key)
        if found is None:
            left = self.texts[a] if a >= 0 else chr(~a)
            right = self.texts[b] if b >= 0 else chr(~b)
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def tokens(self, chunk: str) -> list[int]:
        """Tokens of one chunk by backtracking; ``~code point`` for characters outside the vocabulary."""
        if (i := self.reached.get(chunk)) is not None:
            return [i]
        n, sizes, shorter, pairs = len(chunk), self.sizes, self.shorter, self.pairs
        # matches come by their ends, so the last one kept for a start is the longest
        longest: list[int | None] = [None] * n
        for end, i in self.automaton.iter(chunk):
            longest[end + 1 - sizes[i]] = i
        open_at = (1 << (n + 1)) - 1
        out: list[int] = []
        at = 0
        token = longest[0]
        if token is None:
            token = ~ord(chunk[0])
        while True:
            end = at + (sizes[token] if token >= 0 else 1)
            fits = open_at >> end & 1
            if fits and out:
                fits = pairs.get(out[-1] * PAIR_STEP + token)
                if fits is None:
                    fits = self._fit(out[-1], token)
            if fits:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                if token is None:
                    token = ~ord(chunk[at])
                continue
            token = shorter[token] if token >= 0 else None
            while token is None:
                open_at &= ~(1 << at)
                if not out:
                    raise ValueError("no valid encoding")
                last = out.pop()
                at -= sizes[last] if last >= 0 else 1
                token = shorter[last] if last >= 0 else None

    def ids_of(self, tokens: list[int]) -> list[int]:
        """Replace characters outside the vocabulary by their bytes, or by the unknown id."""
        if not tokens or min(tokens) >= 0:
            return tokens
        out: list[int] = []
        for t in tokens:
            if t >= 0:
                out.append(t)
            else:
                out += [self.bytes[b] for b in chr(~t).encode("utf-8")] if self.bytes else [self.unknown]
        return out

    def entry(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit numbers."""
        if self.alone and len(chunk) > 1 and self.alone.search(chunk):
            return b"".join([self.chunks[p] for p in self.alone.split(chunk) if p])
        return array("i", self.ids_of(self.tokens(chunk))).tobytes()

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        if not text:
            return [self.end]
        if self.plain and self.splits and MARK not in text and "  " not in text and text[0] != " ":
            packed = b"".join(map(self.words.__getitem__, text.split(" ")))
        else:
            normal = MARK + text.replace(" ", MARK) if self.plain else self.processor.normalize(text)
            chunks = self.chunk_of.findall(normal) if self.splits else [normal]
            packed = b"".join(map(self.chunks.__getitem__, chunks))
        ids = array("i", packed).tolist()
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: word marks as spaces, the mark put before the text dropped, runs of byte tokens as UTF-8 (a byte that is none becomes U+FFFD)."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                byte = self.byte_of.get(i)
                if byte is not None:
                    run.append(byte)
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(self.shown[i])
            out.append(_utf8(bytes(run)))
            text = "".join(out)
        return text[1:] if self.plain and text.startswith(" ") else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class _Chunks(dict):
    """Packed ids of chunks by text, at most KEPT_CHUNKS."""

    def __init__(self, codec: Codec, prefix: str = ""):
        super().__init__()
        self.codec, self.prefix = codec, prefix

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        found = self.codec.entry(self.prefix + chunk)
        # a long run of characters is rare and would only fill the table
        if len(chunk) <= 64:
            self[chunk] = found
        return found


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def default_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with an end id and decode it again.

    Returns the id, n_tokens, ids_text (decimal ids joined by one space) and decoded.
    The model file must lie at the same path on every machine; None stands for the
    file that the installed package names there.
    """
    path = model_file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or default_model())

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            ids, n, texts, decoded = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(decoded, pa.string())],
                names=[id_col, "n_tokens", "ids_text", "decoded"],
            )

        for batch in batches:
            rows, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.encode(text.as_py() or "")
                shown, decoded = " ".join(map(str, ids)), own.decode(ids)
                rows.append((i, len(ids), shown, decoded))
                size += len(shown) + len(decoded)
                if size >= OUT_BYTES:
                    yield out(rows, batch.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield out(rows, batch.schema.field(0).type)

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_text string, decoded string")


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests of the operator's output."""
    out = encode_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_tokens", sha256_hex(F.col("ids_text")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )
