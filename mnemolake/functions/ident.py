"""Stable identities: content hashes, canonical JSON ids, source templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.clean import none_if_blank, strip


def json_string(c: Column) -> Column:
    """JSON string literal of a column, non-ASCII kept.

    ``to_json`` of a one-field struct gives the escaping; the wrapper is cut off.
    """
    wrapped = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def json_string_array(c: Column) -> Column:
    arr = F.coalesce(c, F.array().cast("array<string>"))
    wrapped = F.to_json(F.struct(arr.alias("v")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; values are already rendered JSON columns."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def snapshot_event_id(session: Column, ts: Column, text: Column, idx: Column) -> Column:
    """The same message in another snapshot gets the same id."""
    stamp = F.coalesce(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("nots"))
    digest = F.substring(F.sha1(F.concat(session, F.lit("|"), text)), 1, 16)
    return F.concat_ws(":", session, stamp, idx.cast("string"), digest)


def uid_or_hash_event_id(uid: Column, session: Column, role: Column, occurred: Column, text: Column) -> Column:
    """Native uid first, else a hash of what the message says and when."""
    uid_text = none_if_blank(uid.cast("string"))
    body = F.concat_ws("|", session, role, F.coalesce(occurred, F.lit("None")), text)
    return F.coalesce(
        F.concat(F.lit("uid:"), strip(uid_text)),
        F.concat(F.lit("h:"), F.substring(F.sha1(body), 1, 24)),
    )


def memory_id(category: Column, title: Column, content: Column, tags: Column) -> Column:
    """I4."""
    doc = canonical_json({
        "category": json_string(category), "title": json_string(title),
        "content": json_string(content), "tags": json_string_array(tags),
    })
    return F.concat(F.lit("mem_"), F.sha2(doc, 256))


def correction_id(request_json: Column) -> Column:
    """``request_json`` is canonical and already holds the target id."""
    return F.concat(F.lit("cor_"), F.sha2(request_json, 256))


def replacement_memory_id(target: Column, category: Column, title: Column, content: Column, tags: Column, correction: Column) -> Column:
    doc = canonical_json({
        "corrected_from": json_string(target), "category": json_string(category),
        "title": json_string(title), "content": json_string(content),
        "tags": json_string_array(tags), "correction_id": json_string(correction),
    })
    return F.concat(F.lit("mem_"), F.sha2(doc, 256))


def relation_id(correction: Column) -> Column:
    return F.concat(F.lit("rel_"), F.sha2(correction, 256))


def invalidation_id(correction: Column, kind: Column, derived: Column) -> Column:
    """I6."""
    return F.concat(F.lit("inv_"), F.sha2(F.concat_ws("|", correction, kind, derived), 256))


def rebuilt_topic_id(topic: Column, correction: Column) -> Column:
    raw = F.concat(topic, F.lit("|rebuild|"), correction)
    return F.concat(F.lit("t_"), F.substring(F.md5(raw), 1, 8))


def topic_id(title: Column) -> Column:
    return F.concat(F.lit("t_"), F.substring(F.md5(title), 1, 8))


def task_event_id(task: Column, event_type: Column, source: Column) -> Column:
    return F.concat(
        F.lit("te_"), F.substring(F.sha2(F.concat_ws("|", task, event_type, source), 256), 1, 32)
    )


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding; form encoding differs at space, ``*`` and ``~``."""
    e = F.url_encode(F.coalesce(c, F.lit("")))
    e = F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(e, F.lit("%7E"), F.lit("~"))


def delivery_id(host: Column, session: Column, event: Column) -> Column:
    """I7."""
    return F.concat_ws(
        "/", F.lit("delivery"), percent_encode(host), percent_encode(session), percent_encode(event)
    )


def message_key(ids: list[Column], ts: Column, role: Column, content: Column) -> Column:
    """I8: ``struct(key, reliable)``; provider ids, then time and role, then content."""
    native = F.coalesce(*[strip(none_if_blank(c.cast("string"))) for c in ids])
    timed = F.concat(
        F.lit("ts:"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00|"), F.coalesce(role, F.lit(""))
    )
    hashed = F.concat(
        F.lit("fb:"), F.coalesce(role, F.lit("")), F.lit("|"), F.sha2(F.coalesce(content, F.lit("")), 256)
    )
    return F.struct(
        F.coalesce(native, timed, hashed).alias("key"),
        (native.isNotNull() | timed.isNotNull()).alias("reliable"),
    )


def qa_source_id(host: Column, session: Column, q_turn: Column, q_event: Column) -> Column:
    """Namespaced when the host is known, else the older template."""
    has_event = F.coalesce(q_event, F.lit("")) != ""
    named = (F.coalesce(strip(host), F.lit("")) != "") & (strip(host) != "legacy")
    return (
        F.when(has_event & named, F.concat_ws("/", F.lit("qa_sync"), strip(host), session, q_event))
        .when(
            has_event,
            F.concat_ws("/", F.lit("qa_sync"), session, q_turn.cast("string"), F.substring(q_event, 1, 16)),
        )
        .otherwise(F.concat_ws("/", F.lit("qa_sync"), session, q_turn.cast("string")))
    )


def source_candidates(host: Column, session: Column, event: Column) -> Column:
    """The two exact source ids a complete identity can have."""
    parts = [strip(F.coalesce(c, F.lit(""))) for c in (host, session, event)]
    complete = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(
        complete,
        F.array(
            F.concat_ws("/", F.lit("qa_sync"), *parts), F.concat_ws("/", F.lit("qa_import"), *parts)
        ),
    ).otherwise(F.array().cast("array<string>"))
