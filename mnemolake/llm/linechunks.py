"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash (cyclic polynomial over the hashes of the last ``window`` lines) ends a chunk
where its low bits are zero, so boundaries depend on nearby lines alone and shift along with
them. Chunks of ``least`` lines or more that occur again anywhere, in another document or in
the same one, are removed except for the first occurrence (smallest doc_id, then
position). Hashes only find candidates: occurrences count as one chunk when their texts are
equal, because candidates are grouped by the text itself.

Only hashes of all chunks are shuffled to find those that repeat. A bitmap of repeated hashes of at
most ``2**BITMAP_WORD_BITS`` words (4 MB whatever the input, so it is broadcast) lets the second
scan drop most other chunks before their texts are shuffled; a join with the exact hashes follows.
Counts and first occurrences are aggregated by task before any shuffle, and the join that tells
occurrences their first one carries no text, so a passage in a third of all
documents costs small rows on the many side of a join, which adaptive execution splits.

Defined cases: null text stays null, empty text stays empty; a text of one line is never changed;
rows with the same doc_id and text are one document and are changed alike; a null doc_id
comes after all others; all columns and their order are kept, whatever their names; an empty
table gives an empty table. A document that loses all its lines keeps an empty text.

Boundaries are sparse, so a passage inside different texts seldom is a chunk of its own.
``remove_chunks_and_passages`` lets an exact pass follow, and ``remove_repeated_passages`` is that pass alone: all pairs of neighbouring lines take the place of the
chunks, and a line goes when it lies in a pair that occurs earlier, in another document or in
the same one without sharing a line with it. A run of two or more lines that stands
earlier so goes as a whole, wherever it begins or ends; a line that goes stays where it stood first.
Pairs count as one when the SHA-256 of their texts are equal, so that no text is shuffled to compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.clean import let
from mnemolake.llm.tables import table
from mnemolake.session import cut

WINDOW, LEAST = 2, 2
#: One boundary in this many lines on average (a power of two).
SPACING = 4
HASH_BITS = 60
BITMAP_WORD_BITS = 18


def line_hash(line: Column) -> Column:
    """60 bits of a line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line), 1, HASH_BITS // 4), 16, 10).cast("long")


def _turn(h: Column, by: int) -> Column:
    """Rotate a 60-bit number to the left."""
    mask = F.lit((1 << HASH_BITS) - 1)
    return F.shiftleft(h.bitwiseAND(F.lit((1 << (HASH_BITS - by)) - 1)), by).bitwiseOR(F.shiftrightunsigned(h, HASH_BITS - by)).bitwiseAND(mask)


def chunks_of(hashes: Column, window: int = WINDOW, spacing: int = SPACING) -> Column:
    """Array of (first, last) line numbers, counted from 1, of a document's chunks. ``hashes`` should be bound, as it is used often."""

    def rolled(h: Column, i: Column) -> Column:
        # what a rolling update yields: the newest hash, and older ones turned once per line since
        out = h
        for back in range(1, window):
            out = F.when(i >= back, out.bitwiseXOR(_turn(F.get(hashes, i - back), back))).otherwise(out)
        return out

    n = F.size(hashes)
    ends = F.filter(F.transform(hashes, lambda h, i: F.when((i + 1 == n) | (rolled(h, i).bitwiseAND(F.lit(spacing - 1)) == 0), i + 1)), lambda e: e.isNotNull())
    first = lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)) + 1
    return let(ends, lambda e: F.transform(e, lambda last, i: F.struct(first(e, i).alias("first"), last.alias("last"))))


def document_chunks(rows: DataFrame, window: int, least: int, spacing: int) -> DataFrame:
    """Every chunk of at least ``least`` lines of ``rows(doc, th, text)``: doc, th, first, last, hash, piece (its text)."""
    # lines, hashes and boundaries are bound one after the other, so that none is computed per use
    def of_lines(lines: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            long_enough = F.filter(chunks_of(hashes, window, spacing), lambda c: c["last"] - c["first"] + 1 >= least)

            def piece(c: Column) -> Column:
                size = c["last"] - c["first"] + 1
                return F.struct(
                    c["first"].alias("first"), c["last"].alias("last"), F.xxhash64(F.slice(hashes, c["first"], size)).alias("hash"),
                    F.array_join(F.slice(lines, c["first"], size), "\n").alias("piece"),
                )

            return F.transform(long_enough, piece)

        return let(F.transform(lines, line_hash), of_hashes)

    many = rows.filter(F.instr("text", "\n") > 0)
    return many.select("doc", "th", F.explode(let(F.split("text", "\n"), of_lines)).alias("c")).select("doc", "th", "c.*")


def line_pairs(rows: DataFrame, skip: str | None = None) -> DataFrame:
    """Every two neighbouring lines of ``rows(doc, th, text)``, in the columns of ``document_chunks``; ``piece`` is the SHA-256 of their text.

    Pairs that lie within a stretch (first, last) of the array column ``skip`` are left out.
    """
    def of_lines(lines: Column) -> Column:
        pieces = F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda line, i: F.concat_ws("\n", line, F.get(lines, i + 1)))
        return F.transform(pieces, lambda p, i: F.struct((i + 1).alias("first"), (i + 2).alias("last"), F.xxhash64(p).alias("hash"), p.alias("piece")))

    many = rows.filter(F.instr("text", "\n") > 0)
    pairs = let(F.split("text", "\n"), of_lines)
    if skip:
        inside = lambda c: F.exists(F.col(skip), lambda s: (c["first"] >= s["first"]) & (c["last"] <= s["last"]))
        pairs = F.filter(pairs, lambda c: ~F.coalesce(inside(c), F.lit(False)))
    found = many.select("doc", "th", F.explode(pairs).alias("c")).select("doc", "th", "c.*")
    # every line stands in two pairs: their texts would be shuffled twice
    return found.withColumn("piece", F.unhex(F.sha2("piece", 256)))


def repeated_chunks(rows: DataFrame, window: int = WINDOW, least: int = LEAST, spacing: int = SPACING) -> DataFrame:
    """Occurrences to remove from ``rows(doc, th, text)``: doc, th, first, last."""
    return repeated_pieces(document_chunks(rows, window, least, spacing), 1)


def repeated_pieces(found: DataFrame, lines: int) -> DataFrame:
    """Occurrences of ``found`` but the first of each text and those that begin within its first ``lines`` lines."""
    repeated = cut(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    word = F.col("hash").bitwiseAND(F.lit((1 << BITMAP_WORD_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("hash", 58).cast("int"))
    bitmap = repeated.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    # at most 2**BITMAP_WORD_BITS rows of two longs
    near = found.withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    seen = cut(near.select("doc", "th", "first", "last", "hash", "piece").join(repeated, "hash", "left_semi"))
    place = F.struct(F.col("doc").isNull().alias("late"), "doc", "th", "first")
    in_head = F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("th") == F.col("head.th")) & (F.col("first") < F.col("head.first") + lines)
    # the byte comparison: grouped by the text itself
    texts = seen.groupBy("hash", "piece").agg(F.min(place).alias("head"), F.count("*").alias("n"))
    by_hash = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.min("head").alias("head"), F.max("n").alias("n"))
    small = seen.select("doc", "th", "first", "last", "hash")
    alone = small.join(by_hash.filter("texts = 1 and n > 1"), "hash").filter(~in_head)
    # different texts under one hash are told apart by their bytes
    mixed = by_hash.filter("texts > 1").select("hash")
    heads = texts.filter("n > 1").join(mixed, "hash", "left_semi")
    apart = seen.join(mixed, "hash", "left_semi").join(heads, ["hash", "piece"]).filter(~in_head)
    return alone.select("doc", "th", "first", "last").unionByName(apart.select("doc", "th", "first", "last"))


def remove_line_chunks(
    docs: DataFrame, window: int = WINDOW, least: int = LEAST, spacing: int = SPACING, count_col: str | None = None
) -> DataFrame:
    """``docs`` (with doc_id and text) without repeated chunks; ``count_col`` adds the number of removed lines."""
    return _without(docs, lambda rows: repeated_chunks(rows, window, least, spacing), count_col)


def remove_repeated_passages(docs: DataFrame, count_col: str | None = None) -> DataFrame:
    """``docs`` (with doc_id and text) without any run of two or more lines that stands earlier; ``count_col`` as above."""
    return _without(docs, lambda rows: repeated_pieces(line_pairs(rows), 2), count_col)


def repeated_chunks_and_passages(rows: DataFrame) -> DataFrame:
    """Occurrences to remove from ``rows(doc, th, text)``: all repeated chunks, then the repeated passages that chunks miss.

    A chunk that goes lies in passages that stand earlier, so no pair of its lines is a first occurrence: the exact pass
    reads only the pairs that reach beyond the removed chunks, and both together find what the pass alone would.
    """
    chunks = cut(repeated_chunks(rows).distinct())
    gone = chunks.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("first", "last")).alias("skip"))
    marked = rows.join(gone, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left").select("doc", "th", "text", "skip")
    return chunks.unionByName(repeated_pieces(line_pairs(marked, "skip"), 2))


def remove_chunks_and_passages(docs: DataFrame, count_col: str | None = None) -> DataFrame:
    """``docs`` without repeated content-defined chunks and, by the exact pass that follows, without any other run of two or more lines that stands earlier."""
    return _without(docs, repeated_chunks_and_passages, count_col)


def _without(docs: DataFrame, find: Callable[[DataFrame], DataFrame], count_col: str | None) -> DataFrame:
    # names are replaced while the work goes on, so that no column of the input can clash
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    rows = plain.withColumns({"doc": F.col(doc), "th": F.xxhash64(text)})
    # rows of one document and text are one: a repeated row must not count as a second occurrence
    single = rows.select("doc", "th", F.col(text).alias("text")).filter(F.instr("text", "\n") > 0)
    gone = find(single).distinct()
    per_doc = gone.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone")
    )
    joined = rows.join(per_doc, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    # kept stretches lie before, between and behind the removed ones, which may overlap
    spans = F.concat(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))), F.col("gone"))

    def rebuilt(lines: Column) -> Column:
        def stretch(s: Column, i: Column) -> Column:
            end = F.coalesce(F.get(F.col("gone"), i)["first"] - 1, F.size(lines))
            return F.slice(lines, s["last"] + 1, F.greatest(end - s["last"], F.lit(0)))

        return F.array_join(F.flatten(F.transform(spans, stretch)), "\n")

    left = let(F.split(text, "\n"), rebuilt)
    out = joined
    sizes = F.transform("gone", lambda s, i: s["last"] - F.greatest(s["first"] - 1, F.get(spans, i)["last"]))
    removed = F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long"))
    cols = [F.when(F.col("gone").isNull(), F.col(c)).otherwise(left).alias(n) if c == text else F.col(c).alias(n) for c, n in zip(plain.columns, names)]
    return out.select(*cols, *([removed.alias(count_col)] if count_col else []))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated multi-line chunks, and how many lines each lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_line_chunks(docs, count_col="n_removed")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without any repeated run of two or more lines, and how many lines each lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs, count_col="n_removed")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM d WHERE len(lines) >= 2),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h FROM l),
p AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h),
r AS (SELECT doc_id, i, n, line, CASE WHEN p IS NULL THEN h ELSE xor(h, ((p & 576460752303423487) << 1) | (p >> 59)) END AS r FROM p),
c AS (SELECT *, coalesce(sum(CASE WHEN r & 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
k AS (SELECT doc_id, c, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY i) AS piece FROM c GROUP BY doc_id, c HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY doc_id, first) AS occurrence FROM k),
g AS (SELECT doc_id, c FROM o WHERE occurrence > 1),
x AS (SELECT c.doc_id, string_agg(CASE WHEN g.doc_id IS NULL THEN c.line END, chr(10) ORDER BY i) AS text, count(g.doc_id) AS n_removed
  FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.c = c.c GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN x.n_removed > 0 THEN coalesce(x.text, '') ELSE d.text END AS text, coalesce(x.n_removed, 0) AS n_removed
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""

PASSAGES_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM d WHERE len(lines) >= 2),
p AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM l),
f AS (SELECT *, first_value(doc_id) OVER w AS doc0, first_value(i) OVER w AS i0 FROM p WHERE piece IS NOT NULL WINDOW w AS (PARTITION BY piece ORDER BY doc_id, i)),
r AS (SELECT doc_id, i FROM f WHERE doc_id <> doc0 OR i >= i0 + 2),
g AS (SELECT doc_id, i FROM r UNION SELECT doc_id, i + 1 FROM r),
x AS (SELECT l.doc_id, string_agg(CASE WHEN g.doc_id IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS text, count(g.doc_id) AS n_removed
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN x.n_removed > 0 THEN coalesce(x.text, '') ELSE d.text END AS text, coalesce(x.n_removed, 0) AS n_removed
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
