"""Correction chains, as-of reads and batch corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import ident as I
from mnemolake.functions.clean import strip
from mnemolake.operators import ordered
from mnemolake.session import cut

DEPTH_SLICE = 65_536


def chains(memories: DataFrame, edges: DataFrame, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(members, errors).

    ``memories``: memory_id. ``edges``: from_id, to_id (null for a withdrawal).
    Members get chain_id (the first version) and depth. Parent pointers double
    every round, so a chain of n versions needs log2(n) rounds; a node that never
    meets a first version sits on a cycle. Edges with a missing endpoint, and
    nodes with two parents or two children, fail closed: their whole chain goes
    to ``errors``.
    """
    ids = memories.select("memory_id")
    known = edges.join(ids.withColumnRenamed("memory_id", "from_id"), "from_id", "left_semi")
    steps = edges.filter(F.col("to_id").isNotNull())
    dangling = edges.join(ids.withColumnRenamed("memory_id", "from_id"), "from_id", "left_anti").select(
        F.col("to_id").alias("memory_id")
    ).filter(F.col("memory_id").isNotNull()).unionByName(
        steps.join(ids.withColumnRenamed("memory_id", "to_id"), "to_id", "left_anti").select(F.col("from_id").alias("memory_id"))
    ).withColumn("error", F.lit("missing_endpoint"))
    forks = known.groupBy("from_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("from_id").alias("memory_id")
    ).unionByName(
        steps.groupBy("to_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("to_id").alias("memory_id"))
    ).withColumn("error", F.lit("fork"))
    parent = steps.groupBy("to_id").agg(F.min("from_id").alias("p")).withColumnRenamed("to_id", "memory_id")
    state = cut(
        ids.join(parent, "memory_id", "left").select(
            "memory_id", F.col("p").alias("anc"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("dist"),
            F.when(F.col("p").isNull(), F.col("memory_id")).alias("root"),
        )
    )
    waiting = None
    for _ in range(max_rounds):
        moving = state.filter(F.col("root").isNull())
        left = moving.count()
        # a chain that still has unplaced versions places some every round, so a
        # round that placed none leaves only cycles
        if left == 0 or left == waiting:
            break
        waiting = left
        hop = state.select(
            F.col("memory_id").alias("anc"), F.col("anc").alias("_a"), F.col("dist").alias("_d"), F.col("root").alias("_r")
        )
        jumped = moving.join(hop, "anc", "left").select(
            "memory_id",
            F.coalesce("_a", "anc").alias("anc"),
            (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"),
            F.when(F.col("_r").isNotNull(), F.col("_r")).when(F.col("_d").isNull(), F.col("anc")).alias("root"),
        )
        state = cut(state.filter(F.col("root").isNotNull()).unionByName(jumped))
    else:
        raise RuntimeError(f"chains did not settle in {max_rounds} rounds")
    cycle = state.filter(F.col("root").isNull()).select("memory_id", F.lit("cycle").alias("error"))
    direct = dangling.unionByName(forks).unionByName(cycle)
    placed = state.filter(F.col("root").isNotNull()).select("memory_id", F.col("root").alias("chain_id"), F.col("dist").alias("depth"))
    bad_chains = placed.join(direct.filter(F.col("error") != "cycle"), "memory_id").select("chain_id", "error").groupBy("chain_id").agg(F.min("error").alias("error"))
    errors = placed.join(bad_chains, "chain_id").select("memory_id", "error").unionByName(cycle)
    return placed.join(bad_chains.select("chain_id"), "chain_id", "left_anti"), errors


def version_labels(members: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Each version is current, superseded, withdrawn or archived."""
    out = edges.select(F.col("from_id").alias("memory_id"), "relation_type")
    return members.join(memories.select("memory_id", "status"), "memory_id").join(out, "memory_id", "left").select(
        "memory_id", "chain_id", "depth",
        F.when(F.col("relation_type") == "withdraws", "withdrawn")
        .when(F.col("relation_type") == "supersedes", "superseded")
        .when(F.col("status") == "active", "current")
        .otherwise("archived")
        .alias("label"),
    )


def as_of(requests: DataFrame, members: DataFrame, memories: DataFrame, edges: DataFrame, basis: str = "recorded") -> DataFrame:
    """C14: the version of a chain that was current at a moment.

    Edges apply in chain order while their time is at or before the moment and
    stop at the first that is not, at a withdrawal, or at a missing time (then
    the answer is indeterminate, never a guess). An edge is therefore reached
    exactly when the running maximum of the edge times up to it is not later
    than the moment, which turns the read into one ordered as-of scan over
    edges and requests instead of requests times edges.

    ``requests``: (request_id, memory_id, t). Returns request_id, chain_id,
    status (active, withdrawn, absent, indeterminate) and current_id.
    """
    when_col = "recorded_at" if basis == "recorded" else "effective_at"
    end_of_time = F.lit("9999-12-31 00:00:00").cast("timestamp")
    e = edges.withColumnRenamed("from_id", "memory_id").join(members, "memory_id").select(
        "chain_id", "depth", "relation_type", F.col(when_col).alias("_t")
    ).withColumn("_slice", F.floor(F.col("depth") / DEPTH_SLICE))
    barrier = F.when(F.col("_t").isNull(), end_of_time).otherwise(F.col("_t"))
    hot = ordered.is_hot(members, ["chain_id"])
    e = ordered.running_max(e, ["chain_id"], "_slice", ["depth"], barrier, "_reach", hot)
    # after a withdrawal nothing applies any more
    first_stop = e.filter(F.col("relation_type") == "withdraws").groupBy("chain_id").agg(F.min("depth").alias("_w"))
    e = e.join(first_stop, "chain_id", "left").filter(F.col("_w").isNull() | (F.col("depth") <= F.col("_w")))
    heads = members.filter(F.col("depth") == 0).join(memories.select("memory_id", "created_at"), "memory_id").select(
        "chain_id", "created_at"
    )
    asked = requests.join(members.select("memory_id", "chain_id"), "memory_id").select("request_id", "chain_id", "t")
    marks = e.filter(F.col("_reach") < end_of_time).select(
        "chain_id", F.col("_reach").alias("t"), F.lit(0).alias("_kind"), "depth", F.lit(None).cast(asked.schema["request_id"].dataType).alias("request_id")
    )
    line = marks.unionByName(
        asked.select("chain_id", "t", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("depth"), "request_id")
    ).withColumn("_slice", F.date_trunc("day", "t"))
    order = ["t", "_kind", "_ord"]
    line = line.withColumn("_ord", F.coalesce("depth", F.lit(0).cast("long")))
    line = ordered.carry_forward(line, ["chain_id"], "_slice", order, F.col("depth"), "_applied", hot or ordered.is_hot(asked, ["chain_id"]))
    got = line.filter(F.col("_kind") == 1).select("request_id", "chain_id", "t", "_applied")
    nxt = F.coalesce("_applied", F.lit(-1).cast("long")) + 1
    got = got.withColumn("_next", nxt).join(heads, "chain_id", "left")
    applied_edge = e.select("chain_id", F.col("depth").alias("_applied"), F.col("relation_type").alias("_rt"))
    open_edge = e.filter(F.col("_t").isNull()).select("chain_id", F.col("depth").alias("_next"), F.lit(True).alias("_unknown"))
    node = members.select("chain_id", F.col("depth").alias("_next"), F.col("memory_id").alias("_cur"))
    joined = (
        got.join(applied_edge, ["chain_id", "_applied"], "left")
        .join(open_edge, ["chain_id", "_next"], "left")
        .join(node, ["chain_id", "_next"], "left")
    )
    status = (
        F.when(F.col("t") < F.col("created_at"), "absent")
        .when(F.col("_rt") == "withdraws", "withdrawn")
        .when(F.col("_unknown"), "indeterminate")
        .otherwise("active")
    )
    return joined.withColumn("status", status).select(
        "request_id", "chain_id", "status", F.when(F.col("status") == "active", F.col("_cur")).alias("current_id")
    )


REQUEST_FIELDS = ("memory_id", "mode", "replacement_content", "replacement_title", "correction_reason", "correction_source_id", "effective_at")


def request_json(req: DataFrame) -> Column:
    parts = {f: I.json_string(F.col(f).cast("string")) for f in REQUEST_FIELDS}
    return I.canonical_json(parts)


def apply_corrections(requests: DataFrame, memories: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One result row per request.

    Shape errors first, authority last among the checks that need no state;
    then source, target and currency against the tables. Of several valid
    requests for one target the first (``req_no``) wins; the others meet a target
    that is no longer current. A request whose correction is already committed
    is DEDUPLICATED.
    """
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    withdraw = F.col("mode") == "withdraw"
    bad_shape = (
        blank(F.col("memory_id"))
        | ~F.coalesce(F.col("mode").isin("replace", "withdraw"), F.lit(False))
        | (withdraw & (F.col("replacement_content").isNotNull() | F.col("replacement_title").isNotNull()))
        | (~withdraw & blank(F.col("replacement_content")))
        | (F.col("replacement_title").isNotNull() & blank(F.col("replacement_title")))
        | (F.col("correction_reason").isNotNull() & blank(F.col("correction_reason")))
        | (F.col("correction_source_id").isNotNull() & ~F.col("correction_source_id").rlike("^[0-9]+$"))
        | (
            F.col("effective_at").isNotNull()
            & ~F.col("effective_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
        )
    )
    r = requests.withColumn("correction_id", I.correction_id(request_json(requests)))
    r = r.withColumn(
        "_code",
        F.when(bad_shape, "INVALID_REQUEST").when(
            F.coalesce(F.col("authority"), F.lit("")) != "explicit_user", "UNAUTHORIZED_AUTHORITY"
        ),
    )
    src = sources.filter(F.col("role") == "user").select(F.col("source_id").cast("string").alias("correction_source_id"), F.lit(1).alias("_src"))
    tgt = memories.select("memory_id", "status", "category", F.col("title").alias("_title"))
    out = edges.select(F.col("from_id").alias("memory_id"), F.col("correction_id").alias("_done"))
    r = r.join(src, "correction_source_id", "left").join(tgt, "memory_id", "left").join(out, "memory_id", "left")
    code = (
        F.when(F.col("_code").isNotNull(), F.col("_code"))
        .when(F.col("correction_source_id").isNotNull() & F.col("_src").isNull(), "INVALID_CORRECTION_SOURCE")
        .when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("_done") == F.col("correction_id"), "DEDUPLICATED")
        .when(F.col("_done").isNotNull() | (F.col("status") != "active"), "TARGET_NOT_CURRENT")
    )
    r = r.withColumn("_code", code)
    winner = r.filter(F.col("_code").isNull()).groupBy("memory_id").agg(
        F.min("req_no").alias("_win"), F.min_by("correction_id", "req_no").alias("_wid")
    )
    r = r.join(winner, "memory_id", "left")
    result = (
        F.when(F.col("_code").isNotNull(), F.col("_code"))
        .when(F.col("req_no") == F.col("_win"), "COMMITTED")
        .when(F.col("correction_id") == F.col("_wid"), "DEDUPLICATED")
        .otherwise("TARGET_NOT_CURRENT")
    )
    title = F.coalesce("replacement_title", "_title")
    replacement = I.replacement_memory_id(
        F.col("memory_id"), F.col("category"), title, F.col("replacement_content"),
        F.array().cast("array<string>"), F.col("correction_id"),
    )
    r = r.withColumn("result", result)
    return r.select(
        "req_no", "memory_id", "mode", "result", "correction_id",
        F.when((F.col("result") == "COMMITTED") & ~withdraw, replacement).alias("replacement_id"),
        F.when(F.col("result") == "COMMITTED", I.relation_id(F.col("correction_id"))).alias("relation_id"),
    )


def replacement_tail(starts: DataFrame, hops: DataFrame, max_hops: int = 16) -> DataFrame:
    """Follow the newest replacement of each id, at most ``max_hops`` times.

    ``starts``: (correction_id, derived_id). ``hops``: (correction_id, derived_id,
    replacement_id, created_at, invalidation_id). Hops a correction made itself
    are not followed, so a replay resolves as the first pass did.
    """
    newest = F.struct("created_at", "invalidation_id")
    live = hops.filter(F.col("replacement_id").isNotNull())
    # newest hop overall and newest hop by any other correction, per id
    best = live.groupBy("derived_id").agg(F.max_by(F.struct("correction_id", "replacement_id"), newest).alias("_b"))
    other = (
        live.join(best.select("derived_id", F.col("_b.correction_id").alias("_bc")), "derived_id")
        .filter(F.col("correction_id") != F.col("_bc"))
        .groupBy("derived_id").agg(F.max_by("replacement_id", newest).alias("_second"))
    )
    step = cut(best.join(other, "derived_id", "left").select(
        F.col("derived_id").alias("_cur"), F.col("_b.correction_id").alias("_bc"),
        F.col("_b.replacement_id").alias("_bn"), "_second",
    ))
    state = cut(starts.select("correction_id", "derived_id", F.col("derived_id").alias("_cur"), F.array("derived_id").alias("_seen")))
    for _ in range(max_hops):
        moved = state.join(step, "_cur", "left").withColumn(
            "_nxt", F.when(F.col("_bc") != F.col("correction_id"), F.col("_bn")).otherwise(F.col("_second"))
        ).withColumn(
            "_nxt", F.when(F.col("_nxt").isNotNull() & ~F.array_contains("_seen", F.col("_nxt")), F.col("_nxt"))
        )
        nxt = cut(moved.select(
            "correction_id", "derived_id", F.coalesce("_nxt", "_cur").alias("_cur"),
            F.when(F.col("_nxt").isNotNull(), F.array_append("_seen", F.col("_nxt"))).otherwise(F.col("_seen")).alias("_seen"),
            F.col("_nxt").isNotNull().alias("_moved"),
        ))
        done = nxt.filter("_moved").limit(1).count() == 0
        state = nxt.drop("_moved")
        if done:
            break
    return state.select("correction_id", "derived_id", F.col("_cur").alias("tail_id"))


def rebuild_lineage(invalidations: DataFrame, corrections: DataFrame, entries: DataFrame) -> DataFrame:
    """C17: topic -> correction -> memories -> question/answer ids, one row per rebuilt topic."""
    qa = entries.select("topic_id", "source_qa_id").distinct()
    return (
        invalidations.filter(F.col("derived_kind") == "topic")
        .join(corrections.select("correction_id", "from_id", "to_id"), "correction_id")
        .join(qa, F.col("derived_id") == F.col("topic_id"), "left")
        .groupBy("derived_id", "correction_id", "from_id", "to_id")
        .agg(F.count("source_qa_id").alias("n_qa"), F.min("source_qa_id").alias("first_qa"), F.max("source_qa_id").alias("last_qa"))
        .withColumn("rebuilt_id", I.rebuilt_topic_id(F.col("derived_id").cast("string"), F.col("correction_id")))
    )


def note_head(notes: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Per document the newest note that is not invalidated (ids follow the version order)."""
    ok = notes.join(invalidated.select("note_id"), "note_id", "left_anti")
    return ok.groupBy("doc").agg(F.max("note_id").alias("note_id"), F.max_by("content", "note_id").alias("content"))
