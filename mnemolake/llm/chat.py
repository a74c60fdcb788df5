"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation becomes one or more windows. Prefix sums of turn tokens choose
turn-aligned spans: turns that start in the same stretch of ``stride`` tokens
share a window, a turn longer than ``room - stride`` has a window to itself, so a
window exceeds the budget only if a single turn (or the system turn) does. Every
window repeats the leading system turn and the last turns of the window before it
that fit into ``history`` tokens. Only assistant turns that are new in a window
are under its loss mask, so each assistant text is a target exactly once.

Rendered window: ``<s>`` and per turn ``[INST]role[/INST]\\ntext</s>\\n``. Control
strings inside roles and texts are escaped: a backslash is doubled, a control string gets a
backslash behind its first character, and a line feed in a role becomes ``\\n``.

A turn may be anywhere in a conversation that holds a third of all rows: rows are
range-partitioned by (conversation, turn), prefix sums run inside a range, and one
summary row per (range, conversation) carries them on. No conversation is
collected; a window holds at most ``budget / 4`` turns because every turn costs
at least four tokens.

Defined cases: a null text or role is empty; null turns come first; repeated rows
are turns of their own, ordered by (turn, role, text); rows with a null conversation id form one
conversation; an empty table gives no window; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.llm.tables import table
from mnemolake.session import cut

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
BOS, HEAD, BODY, END = "<s>", "[INST]", "[/INST]\n", "</s>\n"
TURN_TOKENS = 4
BYTES_PER_TOKEN = 4


def escape(text: Column) -> Column:
    """Make control strings inert; ``unescape`` restores the text exactly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes separate the pieces in which a single one marks an escape."""
    piece = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(role, r"\\\\"), piece), "\\")


def turn_tokens(role: Column, text: Column) -> Column:
    """Estimated tokens of a rendered turn: a constant for its marks and one per four bytes."""
    size = F.octet_length(role).cast("long") + F.octet_length(text)
    return F.lit(TURN_TOKENS) + F.ceil(size / F.lit(BYTES_PER_TOKEN))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["_pid"] == b["_s"]) & a["conv_id"].eqNullSafe(b["_conv"])


def format_windows(
    turns: DataFrame, budget: int = 1024, history: int = 256, system_budget: int = 128
) -> DataFrame:
    """Windows of every conversation of ``turns(conv_id, turn, role, text)``.

    Returns conv_id, first_turn (position of the first new turn in the conversation),
    n_new, n_repeated, has_system, tokens, over_budget, text, new_from (offset of the
    first new turn), loss_spans (start and end offsets of new assistant texts).
    Offsets are code points. Windows of a conversation are ordered by first_turn.
    """
    room = budget - history - system_budget
    if room < 4 * TURN_TOKENS:
        raise ValueError("budget must exceed history and system_budget by a few turns")
    stride = room * 3 // 4
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_rid"),
    )
    tokens = turn_tokens(F.col("role"), F.col("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_rid"]
    # the range of a row is fixed once, so that a lost task cannot move a boundary
    placed = cut(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
            "conv_id", "role", "text", tokens.cast("long").alias("tokens"),
            F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_seq"),
        ).withColumn("_long", (F.col("tokens") > room - stride).cast("long"))
    )
    per_slice = placed.groupBy(F.col("_pid").alias("_s"), F.col("conv_id").alias("_conv")).agg(
        F.sum("tokens").alias("_t"), F.sum("_long").alias("_l"), F.count("*").alias("_n"),
        F.min_by(F.struct("_long", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "tokens"), "_seq").alias("_head"),
    )
    conv = W.partitionBy("_conv")
    before = conv.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    whole = conv.orderBy("_s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    slices = per_slice.select(
        "_s", "_conv", F.coalesce(F.sum("_t").over(before), zero).alias("_t0"),
        F.coalesce(F.sum("_l").over(before), zero).alias("_l0"), F.coalesce(F.sum("_n").over(before), zero).alias("_n0"),
        F.sum("_n").over(whole).alias("_total"), F.first("_head").over(whole).alias("_first"),
        F.lead("_head").over(conv.orderBy("_s"))["_long"].alias("_next_long"),
    )
    local = W.partitionBy("_pid", "conv_id").orderBy("_seq")
    run = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    scanned = placed.select(
        "*", (F.sum("tokens").over(run) - F.col("tokens")).alias("_tb"), (F.sum("_long").over(run) - F.col("_long")).alias("_lb"),
        (F.row_number().over(local) - 1).alias("_rn"), F.lead("_long").over(local).alias("_lead"),
    )
    has_system = (F.col("_first.role") == "system") & (F.col("_total") > 1)
    longs = F.col("_l0") + F.col("_lb")
    start = F.col("_t0") + F.col("_tb")
    joined = scanned.join(slices, _same(scanned, slices)).select(
        "conv_id", "role", "text", "tokens", "_seq", (F.col("_n0") + F.col("_rn")).alias("pos"), "_total",
        has_system.alias("has_system"), F.when(has_system, F.col("_first")).alias("_sys"),
        F.floor(start / stride).alias("_b"), (longs * 2 + F.col("_long")).alias("_k"),
        F.floor((start + F.col("tokens")) / stride).alias("_b2"),
        ((longs + F.col("_long")) * 2 + F.coalesce("_lead", "_next_long")).alias("_k2"),
    ).filter(~(F.col("has_system") & (F.col("pos") == 0)))
    window = W.partitionBy("conv_id", "_b", "_k")
    backwards = window.orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    members = joined.withColumn("_tail", F.sum("tokens").over(backwards))
    last = F.max("pos").over(window) == F.col("pos")
    # the window's last turn knows which window comes next; its turns learn it from there
    members = members.select(
        "*", F.max(F.when(last, F.struct("_b2", "_k2"))).over(window).alias("_next"),
    )
    # a turn is new in its own window and, if it fits, history in the next one
    home = F.struct(F.col("_b").alias("b"), F.col("_k").alias("k"), F.lit(False).alias("old"))
    again = F.struct(F.col("_next._b2").alias("b"), F.col("_next._k2").alias("k"), F.lit(True).alias("old"))
    repeats = (F.col("_tail") <= history) & F.col("_next._k2").isNotNull()
    spread = members.select(
        "conv_id", "role", "text", "tokens", "pos", "has_system", "_sys",
        F.explode(F.when(repeats, F.array(home, again)).otherwise(F.array(home))).alias("_w"),
    )
    body = escape(F.col("text"))
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(BODY))
    turns_out = spread.select(
        "conv_id", "_w.b", "_w.k", "_w.old", "role", "tokens", "pos", "has_system", "_sys",
        F.char_length(head).alias("_h"), F.char_length(body).alias("_c"), F.concat(head, body, F.lit(END)).alias("_out"),
    )
    in_window = W.partitionBy("conv_id", "b", "k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    sys_out = F.concat(F.lit(HEAD), escape_role(F.col("_sys.role")), F.lit(BODY), escape(F.coalesce(F.col("_sys.text"), F.lit(""))), F.lit(END))
    lead_in = F.lit(len(BOS)) + F.coalesce(F.char_length(sys_out), F.lit(0))
    offset = turns_out.withColumn(
        "_at", lead_in + F.coalesce(F.sum(F.char_length("_out")).over(in_window), zero)
    )
    span = F.struct(
        (F.col("_at") + F.col("_h")).alias("start"), (F.col("_at") + F.col("_h") + F.col("_c")).alias("end")
    )
    new = ~F.col("old")
    packed = offset.groupBy("conv_id", "b", "k").agg(
        F.min(F.when(new, F.col("pos"))).alias("first_turn"), F.sum(new.cast("long")).alias("n_new"),
        F.sum(F.col("old").cast("long")).alias("n_repeated"), F.first("has_system").alias("has_system"),
        (F.sum("tokens") + F.coalesce(F.first("_sys.tokens"), zero)).alias("tokens"),
        F.min(F.when(new, F.col("_at"))).alias("new_from"), F.first("_sys").alias("_sys"),
        F.array_sort(F.collect_list(F.struct("pos", "_out"))).alias("_turns"),
        F.array_sort(F.collect_list(F.when(new & (F.col("role") == "assistant"), span))).alias("loss_spans"),
    )
    text = F.concat(
        F.lit(BOS), F.coalesce(sys_out, F.lit("")), F.array_join(F.transform("_turns", lambda t: t["_out"]), "")
    )
    return packed.select(
        "conv_id", "first_turn", "n_new", "n_repeated", "has_system", "tokens",
        (F.col("tokens") > budget).alias("over_budget"), text.alias("text"), "new_from", "loss_spans",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets of formatted windows as text: per window the canonical new turns and the unmasked text.

    ``turns`` is role, line feed, text, line feed per turn that is new in the window;
    the first window of a conversation includes its system turn.
    """
    opening = F.col("first_turn") == F.col("has_system").cast("long")
    begin = F.when(opening, F.lit(len(BOS))).otherwise(F.col("new_from")).cast("int")
    fresh = F.expr("substring(text, _begin + 1)")
    rows = windows.withColumn("_begin", begin).withColumn("_fresh", fresh)
    # the piece behind the last end mark is empty
    pieces = F.split(F.col("_fresh"), END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def canonical(piece: Column) -> Column:
        cut_at = F.instr(piece, BODY)
        role = F.substring(piece, F.lit(len(HEAD) + 1), cut_at - len(HEAD) - 1)
        text = F.substring(piece, cut_at + len(BODY), F.char_length(piece))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    def target(span: Column) -> Column:
        start = span["start"].cast("int")
        return unescape(F.substring(F.col("text"), start + 1, span["end"].cast("int") - start))

    return rows.select(
        "conv_id", "first_turn", F.size(pieces).cast("long").alias("n_turns"),
        F.array_join(F.transform(pieces, canonical), "").alias("turns"),
        F.array_join(F.transform("loss_spans", target), "").alias("targets"),
        F.char_length("text").cast("long").alias("chars"),
    )


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation. A digest of a whole conversation is one value over its whole text, so that text meets in one row here and only here."""
    parts = read_back(windows).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("first_turn", "turns", "targets"))).alias("_w"),
    )
    turns = F.array_join(F.transform("_w", lambda w: w["turns"]), "")
    targets = F.array_join(F.transform("_w", lambda w: w["targets"]), "")
    return parts.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars",
    )


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digest(format_windows(rows.unionByName(extra)))


_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _mark in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}' || chr(92) || '{_mark[1:]}')"

# budget 1024, history 256, system budget 128: room 640, stride 480, a turn over 160 tokens is long
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, 4 + ceil((strlen(role) + strlen(text)) / 4.0)::BIGINT AS tk,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS total FROM t),
b AS (SELECT *, (tk > 160)::INT AS lg,
  length(replace({_ESCAPED.format('role')}, chr(10), chr(92) || 'n')) + length({_ESCAPED.format('text')}) + 19 AS chars FROM a),
c AS (SELECT *, sum(tk) OVER w - tk AS st, sum(lg) OVER w - lg AS lb FROM b
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, floor(st / 480)::BIGINT AS wb, lb * 2 + lg AS wk, bool_or(pos = 0 AND role = 'system') OVER (PARTITION BY conv_id) AND total > 1 AS sys,
  max(CASE WHEN pos = 0 THEN chars END) OVER (PARTITION BY conv_id) AS head_chars FROM c),
e AS (SELECT *, sum(tk) OVER (PARTITION BY conv_id, wb, wk ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS tail,
  max(pos) OVER (PARTITION BY conv_id, wb, wk) AS last_pos FROM d WHERE NOT (sys AND pos = 0)),
f AS (SELECT conv_id, sum(chars) + sum(CASE WHEN tail <= 256 AND last_pos < total - 1 THEN chars ELSE 0 END)
  + count(DISTINCT (wb, wk)) * (3 + CASE WHEN any_value(sys) THEN any_value(head_chars) ELSE 0 END) AS formatted_chars FROM e GROUP BY conv_id)
SELECT t2.conv_id, t2.n_turns, t2.turns_sha256, t2.loss_chars, t2.loss_sha256, f.formatted_chars::BIGINT AS formatted_chars
FROM (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256 FROM b GROUP BY conv_id) t2
JOIN f ON f.conv_id IS NOT DISTINCT FROM t2.conv_id
"""
