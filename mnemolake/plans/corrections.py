"""Corrections from request to suppression: apply, extend the chains, find what they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators import lineage, versions
from mnemolake.session import cut


def run(
    requests: DataFrame, memories: DataFrame, edges: DataFrame, sources: DataFrame, provenance: DataFrame,
    stream: DataFrame, qa: DataFrame, entries: DataFrame, notes: DataFrame, recorded_at,
) -> dict[str, DataFrame]:
    """Results per request, the new memory and edge rows, and the invalidation ledger rows.

    ``provenance``: (memory_id, stream_id, qa_id) of the corrected memories.
    """
    results = cut(versions.apply_corrections(requests, memories, edges, sources))
    won = results.filter(F.col("result") == "COMMITTED")
    new_edges = won.select(
        "relation_id", "correction_id", F.col("memory_id").alias("from_id"), F.col("replacement_id").alias("to_id"),
        F.when(F.col("mode") == "withdraw", "withdraws").otherwise("supersedes").alias("relation_type"), recorded_at.alias("recorded_at"),
    )
    body = requests.select("req_no", "replacement_content", "replacement_title")
    new_memories = won.filter(F.col("replacement_id").isNotNull()).join(body, "req_no").join(
        memories.select("memory_id", "category", F.col("title").alias("_t")), "memory_id"
    ).select(
        F.col("replacement_id").alias("memory_id"), "category", F.coalesce("replacement_title", "_t").alias("title"),
        F.col("replacement_content").alias("content"), F.lit("active").alias("status"), recorded_at.alias("created_at"),
    )
    refs = won.join(provenance, "memory_id").select(F.col("correction_id").alias("ref_id"), "stream_id", "qa_id")
    resolved = cut(lineage.resolve_sources(refs, stream, qa))
    targets = resolved.filter("status = 'OK'").select(F.col("ref_id").alias("correction_id"), F.col("resolved_qa_id").alias("qa_id"))
    affected = cut(lineage.affected_artifacts(targets, entries, notes))
    return {
        "results": results, "edges": new_edges, "memories": new_memories, "sources": resolved,
        "ledger": lineage.invalidations(affected), "unmapped": lineage.unmapped(targets, affected),
    }
