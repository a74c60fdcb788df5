"""From corrections to derived artifacts: resolution, discovery, suppression, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions import ident as I
from mnemolake.functions.clean import let, strip
from mnemolake.operators import ordered
from mnemolake.session import cut

#: Points of one stretch of the number line, while there are no more stretches than ``MOST_STRETCHES``.
STRETCH_POINTS = 1024
MOST_STRETCHES = 8192
#: Points of one stretch that a task should take; more (one number held by very many rows) are spread.
SALT_POINTS = 262_144
#: Segments of one session, and their characters, that are held beside each of its answers.
HELD_SEGMENTS = 512
HELD_CHARS = 1 << 20


def contained_in_ranges(
    points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, closed_hi: bool = False, bucket: int = STRETCH_POINTS
) -> DataFrame:
    """Points inside [lo, hi) (or [lo, hi]), of any width, as an equi-join on stretches of the number line.

    Boundaries are quantiles of the points, so every stretch holds about ``bucket`` points (at most ``MOST_STRETCHES``
    numbers come to the driver). A point lies in one stretch; a range goes to each stretch
    that it touches, where all but its two ends match every point there. Rows with a null number match nothing.
    """
    from pyspark.ml.feature import Bucketizer

    last = F.col(hi) if closed_hi else F.col(hi) - 1
    p = points.filter(F.col(point).isNotNull()).withColumn("_x", F.col(point).cast("double"))
    r = ranges.filter(F.col(lo) <= last).withColumns({"_x": F.col(lo).cast("double"), "_y": last.cast("double")})
    n = max(1, min(MOST_STRETCHES, p.count() // bucket))
    inner = sorted(set(p.approxQuantile("_x", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    splits = [-float("inf"), *inner, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    place = lambda df, x, out: Bucketizer(splits=splits, inputCol=x, outputCol=out).transform(df).withColumn(out, F.col(out).cast("int")).drop(x)
    p = place(p, "_x", "_s")
    r = place(place(r, "_x", "_a"), "_y", "_b").withColumn("_s", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    # at most one row per stretch, and none unless some number is held by very many rows
    crowded = cut(p.groupBy("_s").agg(F.ceil(F.count("*") / SALT_POINTS).cast("int").alias("_k")).filter("_k > 1"))
    if crowded.limit(1).count():
        few, k = F.broadcast(crowded), F.coalesce("_k", F.lit(1))
        # numbered once and written, so that a task that runs again deals its rows alike
        p = cut(p).join(few, "_s", "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), k).cast("int")).drop("_k")
        r = r.join(few, "_s", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), k - 1))).drop("_k")
    else:
        p, r = p.withColumn("_salt", F.lit(0)), r.withColumn("_salt", F.lit(0))
    inside = (F.col(point) >= F.col(lo)) & (F.col(point) <= last)
    return p.join(r, ["_s", "_salt"]).filter(inside).drop("_s", "_salt")


def _literal_id(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def resolve_sources(refs: DataFrame, stream: DataFrame, qa: DataFrame) -> DataFrame:
    """A provenance reference to exactly one QA id, or a reason.

    ``refs``: (ref_id, stream_id, qa_id) as text, either may be null.
    ``stream``: (id, role, host, session_id, event_id). ``qa``: (id, source_id).
    """
    users = stream.filter(F.col("role") == "user").select(
        F.col("id").alias("_sid"),
        F.explode(I.source_candidates(F.col("host"), F.col("session_id"), F.col("event_id"))).alias("source_id"),
    )
    by_stream = (
        refs.filter(F.col("stream_id").isNotNull())
        .withColumn("_sid", _literal_id(F.col("stream_id")))
        .join(users, "_sid")
        .join(qa.select(F.col("id").alias("_hit"), "source_id"), "source_id")
        .groupBy("ref_id").agg(F.countDistinct("_hit").alias("_n"), F.min("_hit").alias("_from_stream"))
    )
    by_qa = (
        refs.filter(F.col("qa_id").isNotNull())
        .withColumn("_from_qa", _literal_id(F.col("qa_id")))
        .join(qa.select(F.col("id").alias("_from_qa")).distinct(), "_from_qa")
        .select("ref_id", "_from_qa")
    )
    r = refs.join(by_stream, "ref_id", "left").join(by_qa, "ref_id", "left")
    has_s, has_q = F.col("stream_id").isNotNull(), F.col("qa_id").isNotNull()
    status = (
        F.when(~has_s & ~has_q, "NO_SOURCE")
        .when(has_s & (F.coalesce("_n", F.lit(0)) == 0), "SOURCE_NOT_MAPPED")
        .when(has_s & (F.col("_n") > 1), "SOURCE_AMBIGUOUS")
        .when(has_q & F.col("_from_qa").isNull(), "SOURCE_NOT_MAPPED")
        .when(has_s & has_q & (F.col("_from_stream") != F.col("_from_qa")), "SOURCE_IDENTITY_CONFLICT")
        .otherwise("OK")
    )
    return r.withColumn("status", status).select(
        "ref_id", "status", F.when(F.col("status") == "OK", F.coalesce("_from_stream", "_from_qa")).alias("resolved_qa_id")
    )


def affected_artifacts(corrections: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """(correction_id, qa_id, derived_kind, derived_id) found by structure only.

    ``corrections``: (correction_id, qa_id). Topics come from their entries,
    notes from the id range they were written over.
    """
    topics = corrections.join(
        entries.select(F.col("source_qa_id").alias("qa_id"), "topic_id").distinct(), "qa_id"
    ).select("correction_id", "qa_id", F.lit("topic").alias("derived_kind"), F.col("topic_id").cast("string").alias("derived_id"))
    ranged = contained_in_ranges(
        corrections.select("qa_id").distinct(), notes.select("note_id", "lo", "hi"), "qa_id", "lo", "hi"
    ).select("qa_id", "note_id")
    found = corrections.join(ranged, "qa_id").select(
        "correction_id", "qa_id", F.lit("observer_note").alias("derived_kind"), F.col("note_id").cast("string").alias("derived_id")
    )
    return topics.unionByName(found)


def _by_span(corrections: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((qa_id, lo, hi) of corrected ids inside spans, notes with a span); equal spans of notes are one."""
    spanned = notes.select("note_id", "lo", "hi").filter(F.col("lo") < F.col("hi"))
    spans = spanned.select("lo", "hi").distinct()
    inside = contained_in_ranges(corrections.select("qa_id").distinct(), spans, "qa_id", "lo", "hi")
    return inside.select("qa_id", "lo", "hi"), spanned


def affected_once(corrections: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """What ``affected_artifacts`` finds, one row per (correction_id, derived_kind, derived_id).

    Corrections meet each span once, however many notes and ids lie behind it; notes with one span, the usual case,
    then need no comparison of rows.
    """
    topics = corrections.join(
        entries.select(F.col("source_qa_id").alias("qa_id"), "topic_id").distinct(), "qa_id"
    ).select("correction_id", F.lit("topic").alias("derived_kind"), F.col("topic_id").cast("string").alias("derived_id")).distinct()
    inside, spanned = _by_span(corrections, notes)
    hit = cut(corrections.select("correction_id", "qa_id").distinct().join(inside, "qa_id").select("correction_id", "lo", "hi").distinct())
    named = spanned.groupBy("note_id").agg(F.count("*").alias("_n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    single = named.filter("_n = 1").join(hit, ["lo", "hi"]).select("correction_id", "note_id")
    several = spanned.join(named.filter("_n > 1").select("note_id"), "note_id", "left_semi").join(hit, ["lo", "hi"]).select("correction_id", "note_id").distinct()
    found = single.unionByName(several).select(
        "correction_id", F.lit("observer_note").alias("derived_kind"), F.col("note_id").cast("string").alias("derived_id")
    )
    return topics.unionByName(found)


def covered(corrections: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """Corrected ids that some artifact covers, once each."""
    inside, _ = _by_span(corrections, notes)
    listed = corrections.select("qa_id").distinct().join(entries.select(F.col("source_qa_id").alias("qa_id")).distinct(), "qa_id", "left_semi")
    return inside.select("qa_id").unionByName(listed).distinct()


def ledger(once: DataFrame) -> DataFrame:
    """J21 ledger rows of artifacts that are listed once (``affected_once``)."""
    return once.withColumn("invalidation_id", I.invalidation_id(F.col("correction_id"), F.col("derived_kind"), F.col("derived_id")))


def invalidations(affected: DataFrame) -> DataFrame:
    """J21 ledger rows, one per (correction, artifact)."""
    return ledger(affected.select("correction_id", "derived_kind", "derived_id").distinct())


def unmapped(corrections: DataFrame, affected: DataFrame) -> DataFrame:
    """Corrected QA ids that no artifact covers."""
    return corrections.select("qa_id").distinct().join(affected.select("qa_id").distinct(), "qa_id", "left_anti")


def suppress(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Drop hits whose artifact was ever invalidated, whatever became of it since."""
    gone = ledger.select(F.col("derived_kind").alias("kind"), F.col("derived_id").alias("source_id")).distinct()
    return hits.join(gone, ["kind", "source_id"], "left_anti")


def ledger_with_content(ledger: DataFrame, topics: DataFrame, notes: DataFrame) -> DataFrame:
    """Each invalidation with the text of the artifact it names."""
    body = topics.select(
        F.lit("topic").alias("derived_kind"), F.col("topic_id").cast("string").alias("derived_id"), F.col("body").alias("content")
    ).unionByName(
        notes.select(
            F.lit("observer_note").alias("derived_kind"), F.col("note_id").cast("string").alias("derived_id"), "content"
        )
    )
    return ledger.join(body, ["derived_kind", "derived_id"], "left")


def merge_late_answers(late: DataFrame, closed: DataFrame) -> DataFrame:
    """Append late assistant rows to the pair of their turn, once per event.

    ``closed``: (host, session_id, host_turn_id, source_id, answer,
    merged_event_ids). ``late``: (host, session_id, host_turn_id, event_id, ord,
    content). Changed pairs lose their vector (it must be rebuilt); a late row
    whose turn is unknown is returned with status held.
    """
    key = ["host", "session_id", "host_turn_id"]
    one = ordered.first_per_key(late, [*key, "event_id"], F.col("ord"))
    owner = one.join(closed.select(*key, "source_id", "merged_event_ids"), key, "left")
    status = (
        F.when(F.col("source_id").isNull(), "held")
        .when(F.array_contains("merged_event_ids", F.col("event_id")), "already_merged")
        .otherwise("merged")
    )
    return owner.withColumn("status", status).select(*key, "event_id", "ord", "content", "source_id", "status")


def apply_late_answers(closed: DataFrame, merged: DataFrame) -> DataFrame:
    """J23 second half: pairs rewritten with the merged rows in order."""
    add = merged.filter(F.col("status") == "merged").groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "event_id", "content"))).alias("_new")
    )
    j = closed.join(add, "source_id", "left")
    changed = F.col("_new").isNotNull()
    return j.select(
        *[c for c in closed.columns if c not in ("answer", "merged_event_ids")],
        F.when(changed, F.concat_ws("\n", "answer", F.array_join(F.transform("_new", lambda x: x["content"]), "\n")))
        .otherwise(F.col("answer")).alias("answer"),
        F.when(changed, F.concat("merged_event_ids", F.transform("_new", lambda x: x["event_id"])))
        .otherwise(F.col("merged_event_ids")).alias("merged_event_ids"),
        changed.alias("needs_vector"),
    )


def qa_scope(source_id: Column, host: Column, session: Column) -> Column:
    """Whether a pair's id proves it belongs to (host, session)."""
    parts = F.split(source_id, "/", 4)
    legacy = (F.coalesce(host, F.lit("")) == "") | (host == "legacy")
    prefix = F.when(legacy, F.concat_ws("/", F.lit("qa_sync"), session, F.lit(""))).otherwise(
        F.concat_ws("/", F.lit("qa_sync"), host, session, F.lit(""))
    )
    foreign = (
        (F.size(parts) >= 4)
        & (F.get(parts, 0) == "qa_sync") & (F.get(parts, 2) == session) & (F.get(parts, 1) != host)
    )
    return F.when(source_id.startswith(prefix), "current").when(foreign, "foreign").otherwise("unscoped")


def contaminated_pairs(qa: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pairs that hold an autonomous delivery's events (polluted) or only its text (unknown).

    ``qa``: (session_id, host, source_id, merged_event_ids, answer). A segment
    can only sit in an answer of its own session. A session's segments, while they are few, are held beside each
    of its answers; those of other sessions join on the session and the segment's first word before the substring is checked.
    """
    events = deliveries.select("session_id", F.explode("event_ids").alias("_ev")).distinct()
    scoped = qa.withColumn("scope", qa_scope(F.col("source_id"), F.col("host"), F.col("session_id"))).filter(
        F.col("scope") != "foreign"
    )
    overlap = (
        scoped.select("session_id", "source_id", F.explode("merged_event_ids").alias("_ev"))
        .join(events, ["session_id", "_ev"]).groupBy("source_id").agg(F.count("*").alias("n_events"))
    )
    first_word = lambda c: F.get(F.split(c, r"\s+"), 0)
    segs = deliveries.select("session_id", F.explode(F.split("content", "\n")).alias("_x")).select(
        "session_id", strip(F.col("_x")).alias("_seg")
    ).filter("_seg <> ''").distinct()
    # only sessions that had a delivery can hold its text
    size = cut(segs.groupBy("session_id").agg(F.count("*").alias("_n"), F.sum(F.length("_seg")).alias("_chars")))
    held = (F.col("_n") <= HELD_SEGMENTS) & (F.col("_chars") <= HELD_CHARS)
    few, crowded = size.filter(held).select("session_id"), size.filter(~held).select("session_id")
    lists = segs.join(few, "session_id", "left_semi").groupBy("session_id").agg(F.collect_list("_seg").alias("_segs"))
    text_few = scoped.select("session_id", "source_id", "answer").join(lists, "session_id").filter(
        F.exists("_segs", lambda x: F.col("answer").contains(x))
    ).select("source_id")
    segs = segs.join(crowded, "session_id", "left_semi").withColumn("_w", first_word(F.col("_seg")))
    # a segment's first word ends at a blank inside the answer only when the segment has
    # more words, so one-word segments match any answer word that holds them
    many = segs.filter(F.col("_seg") != F.col("_w"))
    touched = scoped.join(crowded, "session_id", "left_semi")
    words = touched.select(
        "session_id", "source_id", "answer",
        F.explode(F.array_distinct(F.split("answer", r"\s+"))).alias("_aw"),
    )
    tails = words.withColumn(
        "_w", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_aw"), F.lit(1))), lambda i: F.col("_aw").substr(i, F.length("_aw"))))
    )
    text_many = tails.join(many, ["session_id", "_w"]).filter(F.col("answer").contains(F.col("_seg"))).select("source_id")
    one = segs.filter(F.col("_seg") == F.col("_w")).select("session_id", F.col("_seg").alias("_w"))
    inner = words.select("session_id", "source_id", "_aw").distinct().withColumn("_g", F.explode(F.array_distinct(_prefix_grams(F.col("_aw")))))
    text_one = inner.join(one.withColumn("_g", F.substring("_w", 1, 3)), ["session_id", "_g"]).filter(
        F.col("_aw").contains(F.col("_w"))
    ).select("source_id")
    text = text_few.unionByName(text_many).unionByName(text_one).distinct().withColumn("_text", F.lit(1))
    j = scoped.join(overlap, "source_id", "left").join(text, "source_id", "left")
    verdict = (
        F.when((F.col("scope") == "current") & F.col("n_events").isNotNull(), "polluted")
        .when(F.col("n_events").isNotNull() | F.col("_text").isNotNull(), "unknown")
    )
    return j.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull()).select(
        "session_id", "source_id", "scope", "verdict", F.coalesce("n_events", F.lit(0)).alias("n_events")
    )


def _prefix_grams(c: Column) -> Column:
    """Every window of up to three characters that can start a match inside a word."""
    n = F.length(c)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.flatten(
        F.transform(starts, lambda i: F.array(c.substr(i, F.lit(1)), c.substr(i, F.lit(2)), c.substr(i, F.lit(3))))
    )


def resolve_context(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """A numeric id names a row, any other the newest row of that session."""
    numeric = ids.withColumn("_n", _literal_id(F.col("ref"))).filter("_n is not null").join(
        messages.select(F.col("id").alias("_n"), F.col("id"), "session_id", "content"), "_n"
    ).select("ref", "id", "session_id", "content")
    newest = messages.groupBy("session_id").agg(F.max_by(F.struct("id", "content"), F.col("id")).alias("m"))
    named = ids.filter(~F.col("ref").rlike("^[0-9]+$")).join(newest, F.col("ref") == F.col("session_id")).select(
        "ref", "m.id", "session_id", "m.content"
    )
    return numeric.unionByName(named)


def anchor_expand(
    query_terms: DataFrame, segment_hits: DataFrame, note_hits: DataFrame, note_topics: DataFrame,
    topics: DataFrame, qa: DataFrame, notes: DataFrame,
) -> DataFrame:
    """Evidence pairs around the nearest note sentences, else around the nearest notes.

    ``segment_hits`` / ``note_hits``: (query_id, note_id, rank[, qa_id]) already cut
    by their floors and counts. Sentence hits win; a query with none uses notes,
    their first linked topics, the ``[#n]`` references of those topics (n-th id
    of the note range), and the whole range when nothing is cited. Evidence is
    scored by how many of the query's terms it holds.
    """
    direct = segment_hits.filter(F.col("qa_id").isNotNull()).select("query_id", "qa_id", F.lit("segment").alias("via"))
    rest = note_hits.join(segment_hits.select("query_id").distinct(), "query_id", "left_anti")
    span = rest.select("query_id", "note_id").join(notes.select("note_id", "lo", "hi"), "note_id")
    in_range = contained_in_ranges(
        qa.select("qa_id"), span.select("note_id", "lo", "hi").distinct(), "qa_id", "lo", "hi", closed_hi=True
    ).select("note_id", "qa_id")
    numbered = in_range.withColumn("_slice", F.floor(F.col("qa_id") / ordered.SLICE_ROWS))
    numbered = ordered.row_number(numbered, ["note_id"], "_slice", ["qa_id"], "n", ordered.is_hot(numbered, ["note_id"])).drop("_slice")
    cited = (
        span.select("query_id", "note_id")
        .join(note_topics.filter(F.col("topic_rank") <= 2), "note_id")
        .join(topics.select("topic_id", "body"), "topic_id")
        .select("query_id", "note_id", F.explode(F.regexp_extract_all("body", F.lit(r"\[#(\d+)\]"), 1)).alias("_n"))
        .select("query_id", "note_id", F.col("_n").try_cast("bigint").alias("n")).distinct()
        .join(numbered, ["note_id", "n"])
        .select("query_id", "note_id", "qa_id")
    )
    uncited = span.select("query_id", "note_id").join(cited.select("query_id", "note_id").distinct(), ["query_id", "note_id"], "left_anti")
    whole = uncited.join(in_range, "note_id").select("query_id", "qa_id", F.lit("range").alias("via"))
    evidence = (
        direct.unionByName(cited.select("query_id", "qa_id", F.lit("citation").alias("via"))).unionByName(whole)
        .groupBy("query_id", "qa_id").agg(F.min("via").alias("via"))
    )
    text = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    terms = query_terms.groupBy("query_id").agg(F.collect_set("term").alias("_terms"))
    return (
        evidence.join(qa, "qa_id").join(terms, "query_id", "left")
        .withColumn(
            "score",
            let(text, lambda x: F.size(F.filter(F.coalesce("_terms", F.array().cast("array<string>")), lambda t: x.contains(t)))),
        )
        .select("query_id", "qa_id", "via", "score")
    )
