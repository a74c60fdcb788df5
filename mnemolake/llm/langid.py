"""Language identification of words in code-switched text: a linear-chain conditional random field.

Words carry affix, character n-gram and lexicon features; learned transitions tie
neighbouring words together; forward-backward gives each word's language
probabilities. A document's language is the one with the largest mean probability,
which is also its score.

Learning: on a bounded sample of labelled rows per language (``docs_per_lang`` documents
chosen by a hash, of each a span of ``SAMPLE_CHARS`` characters at a hashed place), by
Adam steps on the chain's likelihood. Half of the training sequences are joined from
spans of two languages, so that transitions are learned from switches. The model is a
few hundred kilobytes whatever the corpus size; it goes to the tasks with the function.

Prediction reads whole texts. A long chain is computed in blocks of ``BLOCK`` words: block
transfer matrices for all blocks at once, a short chain over blocks, then all blocks
inside at once; this is the exact forward-backward. Rows are independent, so no
key can be hot.

Defined cases: null text or text without a letter is ``und`` with score 0; equal
languages go to the alphabetically first; repeated rows get equal predictions; other columns
are ignored; an empty table gives no row; without a labelled row every text is ``und``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.tables import keep_only, table

UNKNOWN = "und"
#: A longer run of letters, as in scripts without spaces, becomes several words of the chain.
WORD_CHARS = 24
WORD = re.compile(r"[^\W\d_]{1,%d}" % WORD_CHARS)
DOCS_PER_LANG = 400
WORDS_PER_DOC = 200
SAMPLE_CHARS = 4000
FEATURE_BITS = 16
LEXICON_WORDS = 2000
BLOCK = 64
BATCH_WORDS = 200_000
KEPT_WORDS = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def feature_ids(word: str, lexicon: dict[str, int], bits: int = FEATURE_BITS) -> list[int]:
    """Hashed features: word end and start pieces, inner n-grams, and the lexicons that hold the word."""
    bound = f"<{word}>"
    found = {f"p{bound[:n]}" for n in (2, 3, 4)} | {f"s{bound[-n:]}" for n in (2, 3, 4)}
    found |= {bound[i : i + n] for n in (1, 2, 3) for i in range(len(bound) - n + 1)}
    mask = (1 << bits) - 1
    out = [zlib.crc32(f.encode()) & mask for f in sorted(found)]
    held = lexicon.get(word)
    out.append(zlib.crc32(b"lexicon:%d" % (-1 if held is None else held)) & mask)
    return out


#: Of the model used last: packed scores by word, at most KEPT_WORDS.
_known: dict[int, dict[str, bytes]] = {}


@dataclass
class Model:
    """Labels, lexicon (word to the language where it is most usual), emission weights, transition weights."""

    labels: list[str]
    lexicon: dict[str, int]
    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    mark: int = 0

    def sealed(self) -> Model:
        """With a checksum of the weights, which workers tell models apart by."""
        self.mark = zlib.crc32(self.emit.tobytes()) << 32 | zlib.crc32(self.trans.tobytes() + self.start.tobytes())
        return self

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label; a worker keeps those of words it has seen, over all its tasks with one model."""
        keep_only("langid", _known)
        if self.mark not in _known:
            _known.clear()
            _known[self.mark] = {}
        known = _known[self.mark]
        missing = {w for w in words if w not in known}
        if len(known) + len(missing) > KEPT_WORDS:
            known.clear()
            missing = set(words)
        if missing:
            order = list(missing)
            ids = [feature_ids(w, self.lexicon) for w in order]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = np.add.reduceat(self.emit[flat], starts, axis=0) / np.sqrt(sizes)[:, None]
            known.update(zip(order, (row.tobytes() for row in sums.astype(np.float64))))
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.float64).reshape(len(words), len(self.labels))


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, sides: bool = False
) -> np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every word of several chains laid end to end.

    With ``sides`` also what pairs of neighbours need: the forward vectors, and the
    backward vectors times the word's own potential.

    ``scores`` (words x labels) are log potentials, ``lengths`` the chains' sizes (each at
    least 1). Chains are padded to whole blocks; the first word's step uses ``start``.
    """
    labels = scores.shape[1]
    blocks = -(-lengths // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    where = np.arange(len(scores)) - np.repeat(first, lengths) + np.repeat(base[:-1] * BLOCK, lengths)
    n = int(base[-1])
    # potentials of a step: transition times emission; padding is the identity
    pot = np.exp(scores - scores.max(axis=1, keepdims=True))
    emit = np.ones((n * BLOCK, labels))
    emit[where] = pot
    real = np.zeros(n * BLOCK, bool)
    real[where] = True
    emit, real = emit.reshape(n, BLOCK, labels), real.reshape(n, BLOCK)
    move = np.exp(trans - trans.max())
    eye = np.eye(labels)
    opening = np.zeros(n, bool)
    opening[base[:-1]] = True

    def step(t: int) -> np.ndarray:
        """Matrices (blocks x labels x labels) that take the label of the word before to that of word t."""
        m = move[None] * emit[:, t, None, :]
        if t == 0:
            m[opening] = np.exp(start - start.max())[None, None, :] * emit[opening, 0][:, None, :]
        m[~real[:, t]] = eye
        return m

    whole = np.broadcast_to(eye, (n, labels, labels)).copy()
    for t in range(BLOCK):
        whole = whole @ step(t)
        whole /= whole.max(axis=(1, 2), keepdims=True)
    enter = np.empty((n, labels))
    leave = np.empty((n, labels))
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    v = np.full((len(lengths), labels), 1.0 / labels)
    for k, count in enumerate(live):
        at = base[order[:count]] + k
        enter[at] = v[:count]
        v[:count] = np.einsum("bi,bij->bj", v[:count], whole[at])
        v[:count] /= v[:count].sum(axis=1, keepdims=True)
    u = np.ones((len(lengths), labels))
    for k in range(len(live) - 1, -1, -1):
        count = live[k]
        at = base[order[:count]] + k
        leave[at] = u[:count]
        u[:count] = np.einsum("bij,bj->bi", whole[at], u[:count])
        u[:count] /= u[:count].sum(axis=1, keepdims=True)
    ahead = np.empty((n, BLOCK, labels))
    v = enter
    for t in range(BLOCK):
        v = np.einsum("bi,bij->bj", v, step(t))
        v /= v.sum(axis=1, keepdims=True)
        ahead[:, t] = v
    u = leave
    out = np.empty((n, BLOCK, labels))
    back = np.empty((n, BLOCK, labels)) if sides else None
    for t in range(BLOCK - 1, -1, -1):
        p = ahead[:, t] * u
        if sides:
            back[:, t] = emit[:, t] * u
        out[:, t] = p / p.sum(axis=1, keepdims=True)
        u = np.einsum("bij,bj->bi", step(t), u)
        u /= u.sum(axis=1, keepdims=True)
    if sides:
        return tuple(x.reshape(n * BLOCK, labels)[where] for x in (out, ahead, back))
    return out.reshape(n * BLOCK, labels)[where]


def _training_chains(rows: list[tuple[str, list[str]]], labels: list[str], seed: int) -> list[tuple[list[str], list[int]]]:
    """Word sequences with a label per word: single-language ones, and as many joined from two."""
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(labels)}
    single = [(w, [number[lang]] * len(w)) for lang, w in rows if w]
    mixed = []
    for w, y in single:
        other = single[int(rng.integers(len(single)))]
        at, take, skip = int(rng.integers(len(w) + 1)), int(rng.integers(3, 25)), int(rng.integers(len(other[0])))
        piece = slice(skip, skip + take)
        mixed.append((w[:at] + other[0][piece] + w[at:], y[:at] + other[1][piece] + y[at:]))
    return single + mixed


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.05, seed: int = 9) -> Model | None:
    """Fit the field on (language, text) rows; None without any word."""
    labels = sorted({lang for lang, text in rows if words_of(text)})
    if not labels:
        return None
    lists: list[tuple[str, list[str]]] = []
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        w = words_of(text)
        begin = zlib.crc32(text.encode()) % max(1, len(w) - WORDS_PER_DOC + 1)
        lists.append((lang, w[begin : begin + WORDS_PER_DOC]))
        for x in lists[-1][1]:
            counts.setdefault(x, np.zeros(len(labels)))[labels.index(lang)] += 1
    usual = sorted(counts, key=lambda x: (-counts[x].sum(), x))[:LEXICON_WORDS]
    lexicon = {x: int(np.argmax(counts[x])) for x in usual if counts[x].max() >= 0.6 * counts[x].sum()}
    n = len(labels)
    emit = np.zeros((1 << FEATURE_BITS, n))
    model = Model(labels, lexicon, emit, np.eye(n), np.zeros(n))
    if n == 1:
        return model.sealed()
    chains = _training_chains(lists, labels, seed)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(x for c in chains for x in c[0]))}
    ids = [feature_ids(w, lexicon) for w in vocabulary]
    sizes = np.array([len(x) for x in ids])
    flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scale = 1 / np.sqrt(sizes)
    params = [emit, model.trans, model.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, t = np.random.default_rng(seed), 0
    per_step = 64
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for k in range(0, len(order), per_step):
            picked = [chains[i] for i in order[k : k + per_step]]
            lengths = np.array([len(c[0]) for c in picked])
            words = np.array([vocabulary[x] for c in picked for x in c[0]])
            y = np.array([x for c in picked for x in c[1]])
            own, back = np.unique(words, return_inverse=True)
            own_flat = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in own])
            own_starts = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
            scores = (np.add.reduceat(emit[own_flat], own_starts, axis=0) * scale[own][:, None])[back]
            p, ahead, behind = forward_backward(scores, lengths, model.trans, model.start, sides=True)
            gold = np.eye(n)[y]
            by_word = np.zeros((len(own), n))
            np.add.at(by_word, back, gold - p)
            g_emit = np.zeros_like(emit)
            np.add.at(g_emit, own_flat, np.repeat(by_word * scale[own][:, None], sizes[own], axis=0))
            inner = np.ones(len(y), bool)
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            inner[begins] = False
            at = np.flatnonzero(inner)
            pair = ahead[at - 1][:, :, None] * np.exp(model.trans)[None] * behind[at][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            g_trans = -pair.sum(axis=0)
            np.add.at(g_trans, (y[at - 1], y[at]), 1)
            g_start = (gold - p)[begins].sum(axis=0)
            t += 1
            for q, g, m, s in zip(params, (g_emit, g_trans, g_start), first, second):
                g = g / len(y) - 1e-6 * q
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                q += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    model.emit = emit.astype(np.float32)
    return model.sealed()


def learn(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, most_langs: int = 64) -> Model | None:
    """Train on at most ``docs_per_lang`` rows of each of the ``most_langs`` most frequent languages.

    ``labelled`` has doc_id, text, lang. Rows are thinned by a hash before any sort, so
    the sample is bounded for every size of the input.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    span = 1 << 30
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(span, span * 3 * docs_per_lang // n))).otherwise(share)
    thin = rows.withColumn("h", F.xxhash64(F.lit(9), "doc_id", F.col("text"))).filter(F.pmod("h", F.lit(span)) < share)
    begin = F.pmod("h", F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS)).cast("int") + 1
    ranked = thin.select(
        "lang", F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text"), "h",
        F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("k"),
    ).filter(F.col("k") <= docs_per_lang)
    found = ranked.orderBy("lang", "h", "text").select("lang", "text").collect()
    return train([(r["lang"], r["text"]) for r in found])


def predict_texts(model: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if model is None:
        return out
    at: list[int] = []
    lists: list[list[str]] = []
    size = 0

    def settle() -> None:
        lengths = np.array([len(w) for w in lists])
        p = forward_backward(model.emissions([x for w in lists for x in w]), lengths, model.trans, model.start)
        mean = np.add.reduceat(p, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
        for i, m in zip(at, mean):
            k = int(np.argmax(m))
            out[i] = (model.labels[k], min(1.0, float(m[k])))

    # only the words of one group of texts are held at a time
    for i, t in enumerate(texts):
        words = words_of(t) if t else []
        if not words:
            continue
        if lists and size + len(words) > BATCH_WORDS:
            settle()
            at, lists, size = [], [], 0
        at.append(i)
        lists.append(words)
        size += len(words)
    if lists:
        settle()
    return out


def identify(docs: DataFrame, model: Model | None, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to the ``id_cols`` of every row; whole texts are read, no other column."""

    # a text that is returned anyway is not sent twice
    given = [*id_cols] if text_col in id_cols else [*id_cols, text_col]
    place = given.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict_texts(model, batch.column(place).to_pylist())
            own = [batch.column(i) for i in range(len(id_cols))]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                own + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*id_cols, "lang_pred", "score"]
            )

    picked = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in given])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(id_cols)])
    return picked.mapInArrow(run, f"{fields}, lang_pred string, score double")


RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))


def text_runs(model: Model | None, text: str | None) -> list[dict]:
    """Runs of neighbouring words of one most probable language: start, end (code points, end exclusive), lang, mean probability.

    Words are those of the text as it stands, lower-cased one by one; null, empty or letterless texts have no run.
    """
    spans = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text or "")]
    if model is None or not spans:
        return []
    words = [w for _, _, w in spans]
    p = forward_backward(model.emissions(words), np.array([len(words)]), model.trans, model.start)
    said = p.argmax(axis=1)
    edges = [0, *(np.flatnonzero(np.diff(said)) + 1).tolist(), len(said)]
    return [
        {"start": spans[a][0], "end": spans[b - 1][1], "lang": model.labels[said[a]], "score": min(1.0, float(p[a:b, said[a]].mean()))}
        for a, b in zip(edges[:-1], edges[1:])
    ]


def label_runs(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The languages inside every text, for code-switched ones: ``id_col`` and ``runs``, an array as of ``text_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [text_runs(model, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, RUN)], names=[id_col, "runs"])

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, runs array<struct<start: int, end: int, lang: string, score: double>>")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang").filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model, ("doc_id", "held_out"))
