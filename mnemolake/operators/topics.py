"""Topic assignment, updates, merges and upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions import clean as C
from mnemolake.functions import text as T
from mnemolake.operators import clusters, lexical, ordered, vectors
from mnemolake.session import cut

# characters of one topic's facts that a task may solve by itself (an automaton takes some forty bytes a character)
TOPIC_CHARS = 4 << 20


def assign_by_vector(items: DataFrame, topics: DataFrame, floor: float, k: int, dims: int = 64) -> DataFrame:
    """Item x topic links with cosine >= floor, best ``k`` topics per item, labelled."""
    hits = vectors.top_k_cosine(items.select(F.col("id").alias("query_id"), "vec"), topics, k, floor, dims=dims)
    return hits.select(
        F.col("query_id").alias("item_id"), F.col("id").alias("topic_id"), "cosine", "rank",
        F.format_string("vector:%.2f", "cosine").alias("evidence"),
    )


def append_entries(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New entries take the sequence numbers after the topic's largest one.

    ``new``: topic_id, ord (dense enough to slice by), source_qa_id.
    """
    top = existing.groupBy("topic_id").agg(F.max("seq").alias("_top"))
    n = new.withColumn("_slice", F.floor(F.col("ord") / ordered.SLICE_ROWS))
    n = ordered.row_number(n, ["topic_id"], "_slice", ["ord"], "_rn", ordered.is_hot(new, ["topic_id"]))
    return n.join(top, "topic_id", "left").withColumn(
        "seq", F.coalesce("_top", F.lit(0)) + F.col("_rn")
    ).drop("_top", "_rn", "_slice")


def session_text(messages: DataFrame, max_turns: int = 100) -> DataFrame:
    """the first turns of a session, 300 characters each, joined in order."""
    w = W.partitionBy("session_id").orderBy("ord")
    head = messages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_turns)
    head = head.filter(F.col("role").isin("user", "assistant", "tool"))
    return head.groupBy("session_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring("content", 1, 300).alias("t")))), lambda s: s["t"]), " "
        ).alias("text"),
        F.count("*").alias("turns"),
    )


def refine_decision(sessions: DataFrame, best: DataFrame, stable: DataFrame, now: Column) -> DataFrame:
    """C11: what to do with a session given its best topic match.

    ``sessions``: session_id, turns, last_processed, last_active, text.
    ``best``: session_id, topic, cosine. ``stable``: session_id, stable.
    """
    j = sessions.join(best, "session_id", "left").join(stable.select("session_id", "stable"), "session_id", "left")
    quiet = F.unix_timestamp(now) - F.unix_timestamp("last_active")
    action = (
        F.when(F.col("turns") < 3, "skip_short")
        .when(F.col("turns") <= F.col("last_processed"), "skip_no_new")
        .when((quiet < 300) & (F.col("last_processed") > 0), "skip_cooldown")
        .when(F.length(C.strip(F.col("text"))) < 30, "skip_text")
        .when(F.col("cosine") >= 0.75, "assign")
        .when((F.col("cosine") >= 0.55) & F.coalesce("stable", F.lit(False)), "candidate")
        .when(F.col("cosine") >= 0.55, "changed")
        .otherwise("orphan")
    )
    return j.withColumn("action", action).select(
        "session_id", "action", F.when(F.col("action").isin("assign", "candidate"), F.col("topic")).alias("topic")
    )


def mark_dormant(topics: DataFrame, entries: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Active topics whose newest entry (else own stamp) is at least ``days`` old."""
    last = entries.groupBy("topic_id").agg(F.max("ts").alias("_last"))
    t = topics.join(last, "topic_id", "left").withColumn("last_seen", F.coalesce("_last", "updated_at"))
    old = F.datediff(F.to_date(as_of), F.to_date("last_seen")) >= days
    return t.withColumn(
        "status", F.when((F.col("status") == "active") & old, "dormant").otherwise(F.col("status"))
    ).drop("_last")


def drain_candidates(buffer: DataFrame, as_of: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(entries to append, buffer that stays): candidates older than a day go to their topic."""
    old = (F.col("action") == "candidate") & (F.col("ts") < as_of - F.expr(f"INTERVAL {hours} HOURS"))
    out = buffer.filter(old & F.col("topic_id").isNotNull())
    return out, buffer.join(out.select("id"), "id", "left_anti")


def distinct_facts(topics: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts not already written in the topic body nor in an earlier kept fact.

    ``topics``: topic_id, body. ``facts``: topic_id, fact_id (order), fact.
    Equal facts collapse first. A topic of at most ``TOPIC_CHARS`` characters is solved by one task. For larger ones, containment between
    two facts needs the longer one to hold the first characters of the shorter, which is an
    equi-join on (topic, gram); the scan order is then resolved as a greedy
    selection over those pairs.
    """
    f = facts.withColumn("_n", T.normalise_fact(F.col("fact"))).filter("_n <> ''")
    body = topics.select("topic_id", T.normalise_fact(F.col("body")).alias("_b"))
    f = f.join(body, "topic_id", "left").filter(~F.coalesce(F.col("_b").contains(F.col("_n")), F.lit(False))).drop("_b")
    first = cut(ordered.first_per_key(f.select("topic_id", "fact_id", "fact", "_n"), ["topic_id", "_n"], F.col("fact_id")))
    size = first.groupBy("topic_id").agg(F.sum(F.length("_n") + 8).alias("_size"))
    large = cut(size.filter(F.col("_size") > TOPIC_CHARS).select("topic_id"))
    few = first.join(large, "topic_id", "left_anti")
    cols = ["topic_id", "fact_id", "fact"]
    schema = first.select(*cols).schema
    kept = few.groupBy("topic_id").applyInPandas(lambda pdf: _kept_facts(pdf)[cols], schema)
    if large.limit(1).count() == 0:
        return kept
    return kept.unionByName(_distinct_by_grams(first.join(large, "topic_id", "left_semi")).select(*cols))


def _kept_facts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The facts of one topic that a scan in order keeps; one automaton of all facts tells which hold which."""
    import ahocorasick

    pdf = pdf.sort_values("fact_id")
    texts = pdf["_n"].tolist()
    automaton = ahocorasick.Automaton()
    for i, text in enumerate(texts):
        automaton.add_word(text, i)
    automaton.make_automaton()
    near: list[set[int]] = [set() for _ in texts]
    for j, text in enumerate(texts):
        for i in {i for _, i in automaton.iter(text)} - {j}:
            near[max(i, j)].add(min(i, j))
    kept = np.zeros(len(texts), dtype=bool)
    for j, earlier in enumerate(near):
        kept[j] = not any(kept[i] for i in earlier)
    return pdf[kept]


def _distinct_by_grams(first: DataFrame) -> DataFrame:
    """The same for topics of any size, by joins; texts join the candidates last."""
    anchors = first.select("topic_id", F.col("fact_id").alias("_s"), F.substring("_n", 1, 4).alias("_g"))
    grams = first.select("topic_id", F.col("fact_id").alias("_h"), F.explode(F.array_distinct(_windows(F.col("_n")))).alias("_g"))
    text = lambda name, n: first.select(F.col("fact_id").alias(name), F.col("_n").alias(n))
    pairs = (
        grams.join(anchors, ["topic_id", "_g"]).filter(F.col("_h") != F.col("_s")).select("_h", "_s")
        .join(text("_h", "_hn"), "_h").join(text("_s", "_sn"), "_s").filter(F.col("_hn").contains(F.col("_sn")))
        .select(F.least("_h", "_s").alias("i"), F.greatest("_h", "_s").alias("j")).distinct()
    )
    kept = clusters.greedy_leaders(first.select(F.col("fact_id").alias("id")), pairs)
    return first.join(kept.withColumnRenamed("id", "fact_id"), "fact_id")


def _windows(c: Column) -> Column:
    """Every window of one to four characters that starts somewhere in the text."""
    return F.concat(*[T.grams(c, n) for n in (1, 2, 3, 4)])


def fact_refs(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """Cited ``[#n]`` numbers of a fact as QA ids of its batch; several are listed, one is linked.

    ``facts``: batch_no, fact_id, fact. ``batch``: batch_no, ordinal, qa_id.
    """
    cited = facts.select(
        "batch_no", "fact_id", F.posexplode(F.regexp_extract_all("fact", F.lit(R.FACT_CITATION), 1)).alias("pos", "_n")
    ).withColumn("ordinal", F.col("_n").try_cast("bigint"))
    got = cited.join(batch, ["batch_no", "ordinal"]).groupBy("fact_id", "qa_id").agg(F.min("pos").alias("pos"))
    return facts.select("fact_id").join(
        got.groupBy("fact_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "qa_id"))), lambda s: s["qa_id"]).alias("_ids")
        ),
        "fact_id", "left",
    ).select(
        "fact_id",
        F.when(F.size("_ids") == 1, F.get("_ids", 0)).alias("source_qa_id"),
        F.when(F.size("_ids") > 1, F.concat(F.lit(":qa="), F.array_join("_ids", ","))).otherwise("").alias("source_suffix"),
    )


def apply_updates(topics: DataFrame, updates: DataFrame) -> DataFrame:
    """Create, update and append in one full outer join.

    A stored title stays, keywords are cleaned and merged in order, the new
    summary replaces the old one, new facts are appended under the body.
    ``updates``: topic_id, title, summary, keywords, facts (already distinct).
    """
    u = updates.select(
        "topic_id", F.col("title").alias("_t"), F.col("summary").alias("_s"),
        T.keyword_hygiene(F.coalesce("keywords", F.array().cast("array<string>"))).alias("_k"), F.col("facts").alias("_f"),
    )
    j = topics.join(u, "topic_id", "full_outer")
    empty = F.array().cast("array<string>")
    facts = F.array_join(F.transform(F.coalesce("_f", empty), lambda f: F.concat(F.lit("- "), f)), "\n")
    return j.select(
        "topic_id",
        F.coalesce(C.strip(C.none_if_blank(F.col("title"))), C.strip(F.col("_t"))).alias("title"),
        F.coalesce(C.none_if_blank(F.col("_s")), F.col("summary")).alias("summary"),
        F.array_distinct(F.concat(F.coalesce("keywords", empty), F.coalesce("_k", empty))).alias("keywords"),
        F.when(facts == "", F.coalesce("body", F.lit(""))).otherwise(F.concat_ws("\n", C.none_if_blank(F.col("body")), facts)).alias("body"),
        F.when(F.col("_t").isNull() & F.col("_s").isNull() & F.col("_f").isNull(), "kept")
        .when(F.col("title").isNull() & F.col("body").isNull(), "created").otherwise("updated").alias("change"),
    )


def merge_topics(topics: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bodies joined and keywords united in order under the target, sources dropped.

    ``mapping``: source_id, target_id. The target comes first, then the sources by id.
    """
    m = topics.join(mapping.withColumnRenamed("source_id", "topic_id"), "topic_id", "left").withColumn(
        "_to", F.coalesce("target_id", "topic_id")
    )
    rank = F.when(F.col("topic_id") == F.col("_to"), 0).otherwise(1)
    pack = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("topic_id"), "title", "body", "keywords")))
    g = m.groupBy("_to").agg(pack.alias("_p"))
    bodies = F.filter(F.transform("_p", lambda s: C.strip(F.coalesce(s["body"], F.lit("")))), lambda b: b != "")
    return g.select(
        F.col("_to").alias("topic_id"),
        F.get("_p", 0)["title"].alias("title"),
        F.array_join(bodies, "\n\n").alias("body"),
        F.array_distinct(F.flatten(F.transform("_p", lambda s: F.coalesce(s["keywords"], F.array().cast("array<string>"))))).alias("keywords"),
        F.size("_p").alias("merged_from"),
    )


def synthesis_input(entries: DataFrame, per_topic: int = 15, max_chars: int = 300) -> DataFrame:
    """The first entries of each topic, clipped, time-labelled, joined in order."""
    w = W.partitionBy("topic_id").orderBy("seq")
    head = entries.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_topic)
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.substring("content", 1, max_chars))
    return head.groupBy("topic_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda s: s["l"]), "\n").alias("material"),
        F.count("*").alias("n_entries"),
    )


def confidence_pass(cards: DataFrame, texts: DataFrame, threshold: int = 3, verified: float = 0.7) -> DataFrame:
    """Cards below the verified confidence gain the count of texts that mention them.

    ``cards``: id, title, content, confidence, observation_count. ``texts``: text_id, text.
    """
    low = cards.filter(F.col("confidence") < verified)
    kw = lexical.keywords(low, "id", F.col("title"), F.col("content"))
    seen = lexical.observation_counts(kw, "id", texts, "text_id", "text")
    j = low.join(seen, "id", "left").withColumn("_new", F.coalesce("observations", F.lit(0)))
    total = F.col("observation_count") + F.col("_new")
    return j.select(
        "id", total.alias("observation_count"),
        F.when((F.col("_new") > 0) & (total >= threshold), verified).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("_new") > 0).alias("verified"),
        ((F.col("_new") > 0) & (total >= threshold)).alias("boosted"),
    )


def audit_markers(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Bullets under the decision and progress headings that lack a mark."""
    lines = notes.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("ord", "_l")).withColumn("_l", C.strip(F.col("_l")))
    lines = lines.withColumn("_slice", ordered.slice_of("ord"))
    head = F.when(F.col("_l").startswith("## "), F.col("_l"))
    lines = ordered.carry_forward(lines, [id_col], "_slice", ["ord"], head, "_h", False)
    bullet = F.col("_l").rlike("^[-*•]")
    dec = bullet & F.coalesce(F.col("_h").contains(R.DECISION_HEADING), F.lit(False))
    prg = bullet & F.coalesce(F.col("_h").contains(R.PROGRESS_HEADING), F.lit(False))
    has_attr, has_status = F.col("_l").rlike(R.ATTRIBUTION_MARK), F.col("_l").rlike(R.STATUS_MARK)
    return lines.groupBy(id_col).agg(
        F.count_if(dec).alias("decisions"),
        F.count_if(dec & ~has_attr).alias("decisions_missing_attr"),
        F.count_if(dec & ~has_status).alias("decisions_missing_status"),
        F.count_if(prg).alias("progress"),
        F.count_if(prg & ~has_status).alias("progress_missing_status"),
    )


def premise_ids(c: Column) -> Column:
    """Ids listed in the premise comment of a note."""
    inner = F.regexp_extract(F.coalesce(c, F.lit("")), r"<!-- (?:premise|contradiction):\s*([^>]+)\s*-->", 1)
    return F.filter(F.transform(F.split(inner, ","), C.strip), lambda x: x != "")


def attach_timestamps(bodies: DataFrame, qa: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """P25: ``[5904]`` in a body becomes ``[5904 @2023-04-20]``, the day of that pair; unknown ids stay.

    The body is cut into plain and id pieces, ids join the pairs, pieces are put
    back in their order.
    """
    pieces = F.regexp_extract_all(text_col, F.lit(r"(\[\d{3,7}\]|[^\[]+|\[)"), 1)
    p = bodies.select(id_col, F.posexplode(pieces).alias("pos", "piece"))
    ref = F.when(F.col("piece").rlike(r"^\[\d{3,7}\]$"), F.regexp_extract("piece", r"\d+", 0).try_cast("bigint"))
    p = p.withColumn("qa_id", ref).join(qa.select("qa_id", "ts"), "qa_id", "left")
    shown = F.when(F.col("ts").isNotNull(), F.concat(F.lit("["), F.col("qa_id").cast("string"), F.lit(" @"), F.date_format("ts", "yyyy-MM-dd"), F.lit("]"))).otherwise(F.col("piece"))
    return p.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]), "").alias(text_col)
    )


def topic_stats(topics: DataFrame, buffer: DataFrame) -> DataFrame:
    """Topics by status and buffer rows by primary topic, one labelled table."""
    a = topics.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("topics").alias("part"), F.col("status").alias("label"), "n")
    b = buffer.groupBy("topic_id").agg(F.count("*").alias("n")).select(
        F.lit("buffer").alias("part"), F.coalesce(F.col("topic_id").cast("string"), F.lit("none")).alias("label"), "n"
    )
    return a.unionByName(b)
