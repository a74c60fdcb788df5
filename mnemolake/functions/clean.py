"""Cleaning rules as column expressions: markers, shells, noise, dumps, event kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake import rules as R


def strip(c: Column) -> Column:
    """Trim every kind of ASCII whitespace from both ends."""
    return F.btrim(c, F.lit(R.WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(R.WHITESPACE))


def quoted(words) -> str:
    """Regex alternation of literal words."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def any_prefix(c: Column, prefixes) -> Column:
    """One anchored alternation, so the input expression appears once in the plan."""
    return c.rlike(rf"^(?:{quoted(prefixes)})")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Rules with many branches would otherwise copy their input expression into
    every branch when the optimizer merges projections and pushes filters.
    """
    return F.get(F.transform(F.array(value), body), 0)


def none_if_blank(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def strip_time_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^" + R.TS_PREFIX, "")


def strip_host_markers(c: Column) -> Column:
    """Drop up to four rounds of timestamp / message id / reply marks at the head."""
    reply = r"\[\[reply_to_current\]\]"
    head = rf"^(?:(?:{R.TS_PREFIX})?(?:{R.MESSAGE_ID_MARK})?(?:{reply})?\s*){{1,4}}"
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), head, ""))


def strip_wrapper(c: Column) -> Column:
    """Remove untrusted-metadata blocks."""
    return F.regexp_replace(c, R.UNTRUSTED_WRAPPER, "")


def has_mojibake(c: Column) -> Column:
    """P3."""
    return F.coalesce(c, F.lit("")).rlike(R.PRIVATE_USE)


_PREAMBLE = (
    rf"^\s*(?:{quoted(R.AUTOMATION_PREFIXES)}"
    rf"|(?:{R.TS_PREFIX})?\[cron[:\[]"
    r"|(?s:\[\{.{0,192}\"type\"))"
)


def is_machine_preamble(c: Column) -> Column:
    """Text that only a host can have produced.

    Fixed openings, a cron bracket (after an optional time stamp), or a dump of
    typed blocks with its first ``"type"`` inside 200 characters.
    """
    return F.coalesce(c, F.lit("")).rlike(_PREAMBLE)


def _group(c: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(c, pattern, 1))


def unwrap_injected(c: Column) -> Column:
    """P5: ``struct(body, kind)`` for a shell, null for plain text."""
    return let(strip(F.coalesce(c, F.lit(""))), _unwrap)


def _unwrap(t: Column) -> Column:
    close_newline = F.instr(t, "]\n")
    close_at = F.when(close_newline > 0, close_newline).otherwise(F.instr(t, "] "))
    platform_body = F.when(close_at > 0, strip(t.substr(close_at + 1, F.length(t)))).otherwise("")

    def shell(body: Column, kind: str) -> Column:
        return F.struct(body.alias("body"), F.lit(kind).alias("kind"))

    return (
        F.when(t.startswith(R.OOB_OPEN), shell(_group(t, R.OOB_BODY), "out_of_band"))
        .when(t.startswith(R.GOAL_OPEN), shell(_group(t, R.GOAL_BODY), "standing_goal"))
        .when(
            t.startswith("[Mentioned:") | t.startswith("[Replying to:"),
            shell(platform_body, "platform_prefix"),
        )
        .when(
            t.startswith(R.REPLY_MARK),
            shell(strip(t.substr(F.lit(len(R.REPLY_MARK) + 1), F.length(t))), "reply_quote"),
        )
        .when(t.startswith(R.SKILL_OPEN), shell(_group(t, R.SKILL_BODY), "skill_invocation"))
    )


def noise_reason(role: Column, c: Column) -> Column:
    """First matching noise rule, null when the row is conversation."""
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: _noise(role, t))


def _noise(role: Column, t: Column) -> Column:
    t_plain = strip(strip_time_prefix(t))
    keys = F.map_keys(F.from_json(t, "map<string,string>"))
    control_json = (
        t.startswith("{")
        & t.endswith("}")
        & (F.length(t) <= 400)
        & (F.size(F.coalesce(keys, F.array())) > 0)
        & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in R.CONTROL_JSON_KEYS]))) == 0)
    )
    return (
        F.when(t == "", "empty")
        .when(t_plain.rlike(R.CRON_BRACKET), "cron")
        .when(any_prefix(t, R.AUTOMATION_PREFIXES), "automation")
        .when(
            t.rlike(R.INJECTION_HEAD) | t.rlike(R.SUBAGENT_ANYWHERE) | t_plain.rlike(R.SYSTEM_INJECT_HEAD),
            "subagent",
        )
        .when(t.rlike(R.HEARTBEAT_ANYWHERE) | t.rlike(R.HEARTBEAT_WHOLE), "heartbeat")
        .when(role == "system", "system")
        .when(role.isin(*R.MACHINE_ROLES), "tool")
        .when(F.substring(t, 1, 200).rlike(R.IMAGE_DESCRIPTION), "image_desc")
        .when(control_json, "tool_json")
    )


_DUMP_HEAD = rf"^\s*(?:{quoted(R.DUMP_PREFIXES)})|" + "|".join(
    rf"^\s*(?s:.{{0,{R.DUMP_HEAD_CHARS - len(m)}}})\Q{m}\E" for m in R.DUMP_MARKERS
)


def is_machine_dump(c: Column) -> Column:
    """A pasted file or an over-long body."""
    return let(
        F.coalesce(c, F.lit("")),
        lambda t: ((F.length(t) > R.MAX_QUESTION_CHARS) & (strip(t) != "")) | t.rlike(_DUMP_HEAD),
    )


def is_compaction_glue(c: Column) -> Column:
    """P8."""
    return lstrip(F.coalesce(c, F.lit(""))).rlike(R.COMPACTION_HEAD)


def normalize_head(c: Column) -> Column:
    """P10: drop a leading clock wrapper, but only in front of a bracketed head."""
    pattern = r"^\s*\[?\s*(?:" + R.TIME_WRAPPER_BODY + r")\s*\]?\s*(?=\[)"
    return F.regexp_replace(lstrip(F.coalesce(c, F.lit(""))), pattern, "")


def host_event_kind(
    role: Column, content: Column, display_kind: Column | None = None, session_source: Column | None = None
) -> Column:
    """One of eight event kinds, first matching rule wins."""
    r = F.lower(strip(F.coalesce(role, F.lit(""))))
    dk = F.lower(strip(F.coalesce(display_kind, F.lit("")))) if display_kind is not None else F.lit("")
    src = F.lower(strip(F.coalesce(session_source, F.lit("")))) if session_source is not None else F.lit("")
    return let(normalize_head(content), lambda head: _event_kind(r, dk, src, head))


def _event_kind(r: Column, dk: Column, src: Column, head: Column) -> Column:
    window = F.substring(head, 1, 400)
    fullwidth = (
        F.when(window.contains("scheduled cron job") | window.contains("has invoked the"), "NEW_ROOT")
        .when(
            head.startswith("【ASYNC")
            | window.contains("background process")
            | window.contains("background subagent")
            | window.contains("delegation"),
            "ASYNC_BOUNDARY",
        )
        .otherwise("CONTROL")
    )
    return (
        F.when(r.isin("tool", "tool_call", "tool_result", "function"), "NORMAL_TOOL")
        .when(dk.isin(*R.TERMINAL_DISPLAY_KINDS) | any_prefix(head, R.TERMINAL_PREFIXES), "TERMINAL")
        .when(dk.isin(*R.REAL_USER_DISPLAY_KINDS) | head.startswith(R.OOB_OPEN), "REAL_USER")
        .when(any_prefix(head, R.CONTINUATION_PREFIXES), "CONTINUATION")
        .when(
            any_prefix(head, R.ASYNC_PREFIXES)
            | head.rlike(R.ASYNC_NUMBERED)
            | dk.isin(*R.ASYNC_DISPLAY_KINDS),
            "ASYNC_BOUNDARY",
        )
        .when(any_prefix(head, R.FULLWIDTH_PREFIXES), fullwidth)
        .when(any_prefix(head, R.NEW_ROOT_PREFIXES) | ((src == "cron") & (r == "user")), "NEW_ROOT")
        .when(
            any_prefix(head, R.CONTROL_PREFIXES)
            | (head.startswith(R.TITLE_GENERATION_HEAD) & head.contains(R.TITLE_GENERATION_MARK)),
            "CONTROL",
        )
        .when(r == "user", "REAL_USER")
        .when(r == "assistant", "NORMAL_ASSISTANT")
        .otherwise("CONTROL")
    )


def oob_payload(c: Column) -> Column:
    """The human text inside an out-of-band wrapper, other text unchanged."""
    return let(F.coalesce(c, F.lit("")), lambda raw: let(normalize_head(raw), lambda head: _payload(raw, head)))


def _payload(raw: Column, head: Column) -> Column:
    open_end = F.instr(head, "]")
    body = head.substr(open_end + 1, F.length(head))
    closed = F.when(
        body.contains(R.OOB_CLOSE), F.substring_index(body, R.OOB_CLOSE, -1)
    )
    inner = F.when(
        closed.isNotNull(),
        body.substr(F.lit(1), F.length(body) - F.length(closed) - len(R.OOB_CLOSE)),
    ).otherwise(body)
    return F.when(
        head.startswith(R.OOB_OPEN) & (open_end > 0), F.btrim(inner, F.lit("\r\n"))
    ).otherwise(raw)


def is_machine_session(source: Column) -> Column:
    """Unknown sources stay in."""
    return F.coalesce(F.lower(strip(source)).isin(*R.MACHINE_SESSION_SOURCES), F.lit(False))


def remove_nul(c: Column) -> Column:
    """P13."""
    return F.translate(c, "\x00", "")


def had_nul(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).contains("\x00")


def join_text_blocks(blocks: Column, kinds=("text",), sep: str = "\n\n", trim_each: bool = True) -> Column:
    """Joined text blocks of ``array<struct<type,text>>``."""
    kept = F.filter(
        blocks,
        lambda b: b["type"].isin(*kinds) & b["text"].isNotNull() & (strip(b["text"]) != ""),
    )
    return F.array_join(F.transform(kept, lambda b: strip(b["text"]) if trim_each else b["text"]), sep)


def import_skip_reason(role: Column, content: Column, display_kind: Column) -> Column:
    """Exclusion ladder, null when the row is kept."""
    text = F.coalesce(content, F.lit(""))
    return (
        F.when(~F.coalesce(role, F.lit("assistant")).isin("user", "assistant"), "skipped_roles")
        .when(strip(text) == "", "skipped_empty")
        .when(any_prefix(lstrip(text), R.SYSTEM_TEXT_PREFIXES), "skipped_system_text")
        .when(display_kind.isin(*R.EXCLUDED_DISPLAY_KINDS), "skipped_display_kind")
    )


def is_importable_qa(question: Column, answer: Column) -> Column:
    """P17."""
    both = F.struct(strip(F.coalesce(question, F.lit(""))).alias("q"), strip(F.coalesce(answer, F.lit(""))).alias("a"))
    return let(both, lambda p: _importable(p["q"], p["a"]))


def _importable(q: Column, a: Column) -> Column:
    noise = reduce(
        lambda x, y: x | y,
        [F.lower(q).contains(n) | F.lower(a).contains(n) for n in R.IMPORT_NOISE],
    )
    return (
        (F.length(q) >= 5)
        & (F.length(a) >= 5)
        & ~F.lower(q).startswith("heartbeat")
        & ~F.lower(q).startswith("system")
        & ~q.rlike(R.IMPORT_INJECTION_HEAD)
        & ~any_prefix(q, R.IMPORT_INJECTION_PREFIXES)
        & ~noise
        & (a != R.TOOL_ONLY_ANSWER)
    )


def not_inspection_session(session_id: Column) -> Column:
    """Null session ids drop, as ``NOT LIKE`` does."""
    return ~session_id.contains(".trajectory")


def redact(c: Column, max_len: int = 240) -> Column:
    """Hide url credentials, bearer tokens and key=value secrets, then clip."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), R.URL_USERINFO, "$1***@")
    s = F.regexp_replace(s, R.BEARER, "bearer=<redacted>")
    s = F.regexp_replace(s, R.SECRET_PAIR, "$1=<redacted>")
    return F.when(
        F.length(s) > max_len, F.concat(s.substr(1, max(0, max_len - 3)), F.lit("..."))
    ).otherwise(s)


def path_label(path: Column, kind: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.substring_index(path, "/", -1).alias("leaf"),
        F.substring(F.sha2(path, 256), 1, 12).alias("hash12"),
    )


def has_raw_dialogue(c: Column) -> Column:
    """P35."""
    return F.coalesce(c, F.lit("")).rlike(R.RAW_DIALOGUE)


def preview(c: Column, n: int = 200) -> Column:
    """newlines become spaces, then the first ``n`` characters."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), "\r?\n", " ")
    return strip(F.substring(flat, 1, n))


def clip(c: Column, n: int) -> Column:
    """Whitespace-collapsed text of at most ``n`` characters, ellipsis included."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 1), F.lit("…")))
