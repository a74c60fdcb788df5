"""Hooks for user functions: embedding with a failure ledger, reranking, text generation.

A hook runs inside Arrow batches of a partition. Failures become ledger rows,
never silent nulls. Texts that already have a vector are joined from the cache,
and equal texts are sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RERANK_CLIP = 2000
RETRYABLE = ("timeout", "rate_limit", "server_error", "connection")


def classify_error(exc: Exception) -> str:
    text = f"{type(exc).__name__} {exc}".lower()
    if "timeout" in text or "timed out" in text:
        return "timeout"
    if "429" in text or "rate" in text:
        return "rate_limit"
    if "connection" in text:
        return "connection"
    if any(code in text for code in ("500", "502", "503", "504")):
        return "server_error"
    return "invalid_input"


def embed(
    rows: DataFrame, id_col: str, text_col: str, function: Callable[[list[str]], list[list[float]]],
    cache: DataFrame | None = None, batch_size: int = 64, retries: int = 1,
) -> DataFrame:
    """(id, sha, vec, outcome, error_class, retryable, attempts) per row.

    Blank text is skipped. A batch that fails is retried, then sent one text at
    a time so that one bad text cannot fail its neighbours. An empty or all-zero
    vector is a failure. ``cache``: (sha, vec).
    """
    keyed = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "sha", F.sha2("text", 256)
    )
    blank = F.trim("text") == ""
    distinct = keyed.filter(~blank).groupBy("sha").agg(F.min("text").alias("text"))
    if cache is not None:
        distinct = distinct.join(cache.select("sha"), "sha", "left_anti")
    schema = "sha string, vec array<double>, error_class string, attempts int"

    def call(texts: list[str]) -> list[tuple]:
        last = "invalid_input"
        for attempt in range(1, retries + 2):
            try:
                out = function(texts)
                if len(out) != len(texts):
                    # vectors would land on the wrong texts
                    raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
                return [
                    (v, None, attempt) if len(v) and any(v) else (None, "zero_vector", attempt) for v in out
                ]
            except Exception as exc:
                last = classify_error(exc)
        if len(texts) == 1:
            return [(None, last, retries + 1)]
        return [call([t])[0] for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for i in range(0, len(pdf), batch_size):
                got += call(pdf["text"].iloc[i : i + batch_size].tolist())
            yield pd.DataFrame({
                "sha": pdf["sha"], "vec": [list(g[0]) if g[0] is not None else None for g in got],
                "error_class": [g[1] for g in got], "attempts": [g[2] for g in got],
            })

    fresh = distinct.mapInPandas(run, schema)
    if cache is not None:
        hit = cache.select("sha", "vec", F.lit(None).cast("string").alias("error_class"), F.lit(0).alias("attempts"))
        fresh = fresh.unionByName(hit)
    j = keyed.drop("text").join(fresh, "sha", "left")
    outcome = F.when(F.col("vec").isNotNull(), "ok").when(F.col("error_class").isNotNull(), "failed").otherwise("skipped")
    return j.select(
        "id", "sha", "vec", outcome.alias("outcome"), "error_class",
        F.coalesce(F.col("error_class").isin(*RETRYABLE), F.lit(False)).alias("retryable"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
    )


def hashed_embedding(rows: DataFrame, id_col: str, tokens, dims: int = 64) -> DataFrame:
    """signed bag of tokens hashed into ``dims`` places, unit length.

    Uses xxhash64, so the values are this library's own.
    """
    t = rows.select(F.col(id_col).alias("id"), F.explode(tokens).alias("t"))
    h = F.xxhash64("t")
    place = t.select("id", F.pmod(h, F.lit(dims)).cast("int").alias("p"), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    summed = place.groupBy("id", "p").agg(F.sum("s").alias("s"))
    full = summed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    return full.filter("n > 0").select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n")).alias("vec")
    )


def rerank_scores(candidates: DataFrame, function: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """(query_id, source_id, rerank_score); one call per query on its bounded window.

    ``candidates``: query_id, query, source_id, rank, text. Texts are clipped to
    2000 characters. A call that fails or returns another number of scores gives
    nulls, which leaves the query in fusion order.
    """
    schema = "query_id long, source_id string, rerank_score double"
    c = candidates.withColumn("text", F.substring("text", 1, RERANK_CLIP))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        try:
            scores = list(function(pdf["query"].iloc[0], pdf["text"].tolist()))
        except Exception:
            scores = []
        if len(scores) != len(pdf):
            scores = [None] * len(pdf)
        return pd.DataFrame({"query_id": pdf["query_id"], "source_id": pdf["source_id"], "rerank_score": scores})

    return c.groupBy("query_id").applyInPandas(one, schema)


def generate_text(rows: DataFrame, id_col: str, text_col: str, function: Callable[[str], str] | None = None, prefix: str = "seed_") -> DataFrame:
    """A name or text per row; without a function, or when it fails, a label from the text."""
    fallback = F.concat(F.lit(prefix), F.substring(text_col, 1, 20), F.lit("…"))
    if function is None:
        return rows.withColumn("generated", fallback)

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        def safe(t):
            try:
                return function(t)
            except Exception:
                return None

        return texts.map(safe)

    return rows.withColumn("generated", F.coalesce(call(F.col(text_col)), fallback))


def deterministic_vector(text: str, dims: int = 64) -> list[float]:
    """Test embedder: signed token counts in hashed places."""
    v = np.zeros(dims)
    for tok in text.lower().split():
        d = hashlib.blake2b(tok.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "big") % dims] += 1.0 if d[4] % 2 == 0 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()
