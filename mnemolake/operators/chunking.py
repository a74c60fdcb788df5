"""Spans, windows and budget batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions import text as TX
from mnemolake.functions.clean import let
from mnemolake.operators import ordered


def safe_token_target(max_tokens: Column, margin: Column) -> Column:
    """F9."""
    return F.greatest(max_tokens - margin, F.lit(1))


def fits_one_call(c: Column, target: int) -> Column:
    """F9 gate: a text of at most ``target`` bytes cannot exceed ``target`` tokens."""
    return F.octet_length(c) <= target


def _field_spans(c: Column, field: str, target: int) -> Column:
    """Array of struct(field, text, n) whose texts concatenate to the field."""
    return let(TX.token_pieces(F.coalesce(c, F.lit(""))), lambda pieces: _spans(pieces, field, target))


def _spans(pieces: Column, field: str, target: int) -> Column:
    count = F.ceil(F.size(pieces) / target).cast("int")
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: F.struct(
            F.lit(field).alias("field"),
            F.array_join(F.slice(pieces, i * target + 1, target), "").alias("text"),
            F.size(F.slice(pieces, i * target + 1, target)).alias("n"),
        ),
    )
    return F.when(count > 0, spans).otherwise(
        F.array().cast("array<struct<field:string,text:string,n:int>>")
    )


def token_spans(qa: DataFrame, id_col: str, fields: list[str], target: int) -> DataFrame:
    """Chunks of at most ``target`` tokens that cover every field completely.

    Blanks between tokens belong to the chunk before them (leading blanks to
    the first), so no character is lost. The chunk index runs over the fields.
    """
    arrays = [_field_spans(F.col(f), f, target) for f in fields]
    ex = qa.select(F.col(id_col), F.posexplode(F.concat(*arrays)).alias("chunk_index", "s"))
    lens = W.partitionBy(id_col, "field").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    flat = ex.select(
        id_col, "chunk_index", F.col("s.field").alias("field"), F.col("s.text").alias("text"), F.col("s.n").alias("token_count")
    )
    # one text is one row, so the window only ever holds the chunks of one text
    return flat.withColumn("source_end", F.sum(F.length("text")).over(lens)).withColumn(
        "source_start", F.col("source_end") - F.length("text")
    ).withColumn("source_sha256", F.sha2("text", 256))


def overlapping_windows(docs: DataFrame, id_col: str, text_col: str, max_chars: int, overlap: int) -> DataFrame:
    """Windows of ``max_chars`` with ``overlap``, cut at the last newline of the
    final ``overlap`` characters. Stops at the window that reaches the end.
    """
    schema = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def bounds(text: str) -> list[tuple[int, int]]:
        out, start, n = [], 0, len(text)
        while True:
            end = min(start + max_chars, n)
            if end < n:
                cut = text.rfind("\n", start + max_chars - overlap, end)
                end = cut if cut > start else end
            out.append((start, end))
            if end >= n:
                return out
            start = max(end - overlap, start + 1)

    @F.pandas_udf(schema)
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in bounds(t or "")])

    ex = docs.select(id_col, text_col, F.posexplode(windows(F.col(text_col))).alias("window_index", "w"))
    return ex.select(
        id_col, "window_index", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
        F.col(text_col).substr(F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"),
    )


def shorten_query(c: Column, target: int, head_ratio: float = 0.6) -> Column:
    """F8: text within ``target`` tokens unchanged, else head 60 % + newline + tail 40 %.

    With whitespace tokens the joining newline is a blank between tokens and
    costs no budget.
    """
    return let(TX.token_pieces(F.coalesce(c, F.lit(""))), lambda pieces: _shortened(c, pieces, target, head_ratio))


def _shortened(c: Column, pieces: Column, target: int, head_ratio: float) -> Column:
    n = F.size(pieces)
    head = max(1, int(target * head_ratio))
    tail = max(1, target - int(target * head_ratio))
    head_text = F.rtrim(F.array_join(F.slice(pieces, 1, head), ""), F.lit(" \t\n\r\x0b\x0c"))
    tail_text = F.array_join(F.slice(pieces, F.greatest(n - tail + 1, F.lit(1)), tail), "")
    short = F.concat(head_text, F.lit("\n"), tail_text) if target >= 2 else head_text
    return F.when(n <= target, F.coalesce(c, F.lit(""))).otherwise(short)


def _jumps(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For every start, the first row that no longer fits a batch begun there."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    nxt = np.maximum(nxt, np.arange(len(sizes)) + 1)
    return nxt


def _run(sizes: np.ndarray, limit: int, entry: int) -> tuple[np.ndarray, int, int]:
    """Batch starts inside one slice when ``entry`` characters are already open.

    ``entry`` < 0 means no batch is open. An oversize row stands alone: it is
    its own batch and the next row starts another. Returns (starts flag, open
    size at the end or -1, number of starts).
    """
    n = len(sizes)
    starts = np.zeros(n, dtype=bool)
    total = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    if entry >= 0:
        i = int(np.searchsorted(total, limit - entry, side="right") - 1)
        i = max(0, min(i, n))
        if i >= n:
            return starts, entry + int(total[n]), 0
    nxt = _jumps(sizes, limit)
    last = i
    while i < n:
        starts[i] = True
        last, i = i, int(nxt[i])
    open_size = int(total[n] - total[last])
    return starts, (-1 if open_size > limit else open_size), int(starts.sum())


def _scan_batches(rows: DataFrame, limit: int, keys: list[str], order: str, size: str) -> DataFrame:
    """One pass over sessions that each fit a task; Arrow batches stream through."""
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_no", T.LongType())])

    def scan(batches):
        current, used, no = None, -1, 0
        for pdf in batches:
            out = []
            for key, n in zip(zip(*[pdf[k] for k in keys]), pdf[size]):
                if key != current:
                    current, used, no = key, -1, 0
                if n > limit:
                    used, no = -1, no + 1
                elif used < 0 or used + n > limit:
                    used, no = n, no + 1
                else:
                    used += n
                out.append(no)
            yield pdf.assign(batch_no=out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(scan, schema)


def budget_batches(rows: DataFrame, max_chars: int, keys: tuple[str, ...] = ("session_id",), order: str = "ord", size: str = "chars") -> DataFrame:
    """Consecutive rows of a session packed into batches of at most ``max_chars``.

    A row is never split; an oversize row is a batch of its own. A batch start
    depends on the one before it, so a long session is folded in three steps:
    each slice reports how it maps the size left open before it to the size left
    open after it (a step function with few steps, because runs from different
    starts soon coincide), the steps of a session are chained, and each slice is
    then numbered from its known entry. No task holds more than one slice of rows.

    Returns the input with ``batch_no`` counted per session.
    """
    limit = max(1, int(max_chars))
    if not ordered.is_hot(rows, keys):
        return _scan_batches(rows, limit, list(keys), order, size)
    r = rows.withColumn("_slice", F.floor(F.col(order) / ordered.SLICE_ROWS).cast("long"))
    keyed = [*keys, "_slice"]
    key_fields = [T.StructField(k, r.schema[k].dataType) for k in keyed]
    step_schema = T.StructType([
        *key_fields, T.StructField("lo", T.LongType()), T.StructField("out", T.LongType()), T.StructField("n", T.LongType()),
    ])

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes = pdf[size].to_numpy(dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        # the only entries where the outcome can change are those at which one more row stops fitting
        edges = sorted({-1, 0, *(int(limit - t + 1) for t in np.unique(total[1:]) if 0 < limit - t + 1 <= limit)})
        out, prev = [], None
        # entries are grouped by the first row that does not fit; evaluate the run once per row
        memo: dict[int, tuple[int, int]] = {}
        for e in edges:
            if e < 0:
                first = 0
            else:
                first = int(np.searchsorted(total, limit - e, side="right") - 1)
                first = max(0, min(first, len(sizes)))
            if first >= len(sizes):
                val = (None, 0)
            else:
                if first not in memo:
                    _, tail, cnt = _run(sizes[first:], limit, -1)
                    memo[first] = (tail, cnt)
                val = memo[first]
            row = (e, val)
            if prev is None or prev != val:
                out.append(row)
                prev = val
        base = {k: pdf[k].iloc[0] for k in keyed}
        grow = int(total[-1])
        # out = -2 - grow stands for "nothing starts here: the open size grows by the slice total"
        return pd.DataFrame([
            {**base, "lo": e, "out": (-2 - grow) if v[0] is None else v[0], "n": v[1]} for e, v in out
        ])

    folded = r.groupBy(*keyed).applyInPandas(steps, step_schema)
    entry_schema = T.StructType([*key_fields, T.StructField("_open", T.LongType()), T.StructField("_done", T.LongType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        # summaries only: a few steps per slice
        pdf = pdf.sort_values(["_slice", "lo"])
        open_size, done, out = -1, 0, []
        for sl, part in pdf.groupby("_slice", sort=True):
            out.append((*[part[k].iloc[0] for k in keys], sl, open_size, done))
            hit = int(np.searchsorted(part["lo"].to_numpy(), open_size, side="right")) - 1
            after = int(part["out"].iloc[hit])
            open_size = max(open_size, 0) - after - 2 if after <= -2 else after
            done += int(part["n"].iloc[hit])
        return pd.DataFrame(out, columns=[*keyed, "_open", "_done"])

    entries = folded.groupBy(*keys).applyInPandas(chain, entry_schema)
    joined = r.join(entries, keyed)
    out_schema = T.StructType([*r.schema.fields, T.StructField("batch_no", T.LongType())])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        starts, _, _ = _run(pdf[size].to_numpy(dtype=np.int64), limit, int(pdf["_open"].iloc[0]))
        pdf["batch_no"] = pdf["_done"].iloc[0] + np.cumsum(starts)
        return pdf[[f.name for f in out_schema.fields]]

    return joined.groupBy(*keyed).applyInPandas(number, out_schema).drop("_slice")
