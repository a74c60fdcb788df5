"""Tokens, bigrams, keywords and lexical scores as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions.clean import let, strip


def chars(c: Column) -> Column:
    """Characters of a string; array access keeps later steps linear in its length."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def grams(c: Column, n: int) -> Column:
    """All ``n``-character windows of a string, in order (empty when it is shorter)."""
    if n == 1:
        return chars(c)
    return let(
        chars(c),
        lambda cs: F.when(
            F.size(cs) >= n,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))),
                lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def _run_tokens(run: Column) -> Column:
    short = F.array(run)
    return F.when(F.length(run) <= 3, short).otherwise(F.concat(grams(run, 3), short))


def tokenize(c: Column) -> Column:
    """distinct tokens in order; long CJK runs give trigrams plus the run."""
    low = F.lower(F.coalesce(c, F.lit("")))
    piece = f"{R.CJK_TOKEN_RUN}|[^{R.CJK_TOKEN_RUN[1:-2]}]+"
    pieces = F.regexp_extract_all(low, F.lit(f"({piece})"), 1)
    words = lambda p: F.filter(F.transform(F.split(p, R.TOKEN_SEPARATORS), strip), lambda w: w != "")
    per_piece = F.transform(
        pieces, lambda p: F.when(p.rlike(f"^{R.CJK_TOKEN_RUN}$"), _run_tokens(p)).otherwise(words(p))
    )
    return F.array_distinct(F.flatten(per_piece))


def cjk_bigrams(c: Column) -> Column:
    """distinct two-character windows of CJK runs; a lone character stays itself."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({R.CJK_BIGRAM_RUN})"), 1)
    return F.array_distinct(
        F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(grams(r, 2))))
    )


def keyword_score(title: Column, tags: Column, content: Column, terms: Column, item_id: Column | None = None) -> Column:
    """0.4 per title hit, else 0.3 per tag hit, else 0.25 per body hit, capped at 1."""
    folded = F.struct(
        F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(content, F.lit(""))).alias("b"),
        F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower).alias("g"),
    )
    return let(folded, lambda x: _keyword_score(x["t"], x["g"], x["b"], terms, item_id))


def _keyword_score(t: Column, tag_text: Column, b: Column, terms: Column, item_id: Column | None) -> Column:
    per_term = lambda q: (
        F.when(t.contains(q), 0.4)
        .when(F.exists(tag_text, lambda g: g.contains(q)), 0.3)
        .when(b.contains(q), 0.25)
        .otherwise(0.0)
    )
    base = F.least(F.aggregate(terms, F.lit(0.0), lambda acc, q: acc + per_term(q)), F.lit(1.0))
    if item_id is None:
        return base
    bonus = F.when(F.exists(terms, lambda q: F.lower(item_id).contains(q)), 0.2).otherwise(0.0)
    return F.least(base + bonus, F.lit(1.0))


def bigram_score(title: Column, tags: Column, bigrams: Column) -> Column:
    """0.15 for every bigram found in the title or a tag, capped at 0.9."""
    t = F.coalesce(title, F.lit(""))
    tag_text = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    hit = F.filter(bigrams, lambda g: t.contains(g) | F.exists(tag_text, lambda x: x.contains(g)))
    return F.least(F.size(hit) * F.lit(0.15), F.lit(0.9))


def qa_lexical_score(matched: Column, min_freq: Column) -> Column:
    """more for each matched term, much more when the rarest one is rare; cap 2."""
    rarity = (
        F.when(min_freq <= 1, 2.0).when(min_freq <= 3, 0.8).when(min_freq <= 10, 0.4).otherwise(0.0)
    )
    return F.least(F.lit(0.6) + F.lit(0.2) * matched + rarity, F.lit(2.0))


def topic_lexical_score(matched_long_terms: Column) -> Column:
    """F15."""
    return F.least(F.lit(0.5) + F.lit(0.15) * matched_long_terms, F.lit(1.5))


def keyword_candidates(title: Column, content: Column, chars: int | None = None, stopped: bool = True) -> Column:
    """P36 input: CJK bigrams and Latin words of title plus the body, or its first ``chars`` characters; ``stopped``: without stop words."""
    body = F.coalesce(content, F.lit(""))
    if chars is not None:
        body = F.substring(body, 1, chars)
    head = strip(F.coalesce(title, F.lit("")))
    sample = F.when(head != "", F.concat(head, F.lit(" "), body)).otherwise(body)
    runs = F.regexp_extract_all(sample, F.lit(f"({R.CJK_BASIC_RUN})"), 1)
    cjk = F.flatten(F.transform(runs, lambda r: grams(r, 2)))
    latin = F.regexp_extract_all(sample, F.lit(f"({R.LATIN_KEYWORD})"), 1)
    words = F.concat(cjk, latin)
    return F.filter(words, lambda w: ~F.lower(w).isin(*R.KEYWORD_STOPWORDS)) if stopped else words


def keyword_hygiene(tags: Column) -> Column:
    """P20: distinct tags of sane length, at most twelve."""
    cleaned = F.array_distinct(F.filter(F.transform(tags, strip), lambda t: t != ""))
    cjk_len = lambda t: F.length(F.regexp_replace(t, "[^\\u4e00-\\u9fff]", ""))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    kept = F.filter(
        cleaned,
        lambda t: ~((words(t) > 3) & (cjk_len(t) == 0)) & (cjk_len(t) <= 8) & (F.length(t) <= 20),
    )
    return F.slice(kept, 1, 12)


def tag_hygiene(tags: Column) -> Column:
    """No control characters, no edge punctuation, at most 30 characters."""
    clean = F.transform(
        tags, lambda t: F.btrim(F.regexp_replace(t, "[\\x00-\\x1f\\x7f]", ""), F.lit(" ,.;:!?-"))
    )
    return F.filter(clean, lambda t: (t != "") & (F.length(t) <= 30))


def normalise_fact(c: Column) -> Column:
    """Comparable form of a fact."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), R.FACT_NORMALISE, "")


def token_pieces(c: Column) -> Column:
    """Whitespace tokens with the blanks that follow; joined they give the text back.

    Leading blanks of the text belong to the first piece.
    """
    return F.regexp_extract_all(c, F.lit(r"(\s*\S+\s*|\s+)"), 1)
