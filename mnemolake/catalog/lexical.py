"""Registered queries: tokens, term frequency, quotas, lexical scores, keyword searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.catalog.base import Registry, planted, planted_sql, q
from mnemolake.functions import text as T
from mnemolake.operators import lexical, topics
from mnemolake.session import cut

reg = Registry()

SEP = q(R.TOKEN_SEPARATORS)
QS_SQL = f"""qs AS (SELECT item_id AS query_id, text || ' zzznone' || item_id AS text FROM benchmark),
tk AS (SELECT query_id, list_filter(regexp_split_to_array(lower(text), {SEP}), lambda w: w <> '') AS tok FROM qs),
tx AS (SELECT query_id, unnest(tok) AS term, generate_subscripts(tok, 1) AS i FROM tk),
td AS (SELECT query_id, term, min(i) AS i FROM tx GROUP BY query_id, term),
tm AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS ord FROM td),
mt AS (SELECT t.term, d.doc_id AS id FROM (SELECT DISTINCT term FROM tm) t JOIN documents d ON contains(lower(d.text), t.term)),
fr AS (SELECT t.term, count(mt.id) AS freq FROM (SELECT DISTINCT term FROM tm) t LEFT JOIN mt USING (term) GROUP BY t.term)"""


def bench_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" zzznone"), "item_id").alias("text"))


def corpus(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _matched(t):
    terms = lexical.query_terms(bench_queries(t))
    docs = corpus(t)
    return terms, docs, cut(lexical.term_matches(terms, docs, "id", [F.col("text")], words_only=True))


@reg.query("F1", f"WITH {QS_SQL} SELECT query_id, CAST(ord AS INTEGER) AS ord, term FROM tm")
def query_tokens(t):
    return lexical.query_terms(bench_queries(t))


@reg.query("F1", f"""WITH k AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), {SEP}), lambda w: w <> '')) AS tok FROM documents)
SELECT doc_id, len(tok) AS n_tokens, md5(array_to_string(list_sort(tok), ' ')) AS h FROM k""")
def document_tokens(t):
    d = t.documents.select("doc_id", T.tokenize(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("tok"), " ")).alias("h"))


CJK = {1: ("关于数据湖的讨论 ", ""), 2: ("", " 一"), 3: ("短词 ", " 短词")}


@reg.query("F2", f"""WITH {planted_sql(CJK, 5)} SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN '关于 于数 数据 据湖 湖的 的讨 讨论' WHEN 2 THEN '一' WHEN 3 THEN '短词' ELSE '' END AS bigrams FROM d""")
def cjk_bigrams(t):
    return planted(t, CJK, 5).select("doc_id", F.array_join(T.cjk_bigrams(F.col("c")), " ").alias("bigrams"))


@reg.query("J7", f"WITH {QS_SQL} SELECT term, id FROM mt")
def term_matches(t):
    return _matched(t)[2]


@reg.query("A5 J8", f"WITH {QS_SQL} SELECT term, freq FROM fr")
def term_frequency(t):
    terms, _, m = _matched(t)
    return lexical.document_frequency(terms, m, "id")


@reg.query("W3 J8", f"""WITH {QS_SQL}, el AS (SELECT mt.*, row_number() OVER (PARTITION BY term ORDER BY id) AS rn FROM mt JOIN documents d ON d.doc_id = mt.id WHERE d.lang <> 'de'),
lm AS (SELECT el.* FROM el JOIN fr USING (term) WHERE rn <= CASE WHEN freq <= 3 THEN 9 ELSE greatest(2, least(freq, 6)) END + 1)
SELECT tm.query_id, tm.term, lm.id, lm.rn FROM tm LEFT JOIN lm USING (term)""")
def term_quota(t):
    terms, docs, m = _matched(t)
    freq = lexical.document_frequency(terms, m, "id")
    lim = lexical.limited_matches(terms, m, docs.filter("lang <> 'de'"), freq, "id", rare_limit=9, per_term=2, freq_limit=6, tail=1)
    return lim.select("query_id", "term", "id", "rn")


@reg.query("F5 A5", f"""WITH {QS_SQL}, lg AS (SELECT tm.query_id, mt.id, fr.freq FROM tm JOIN mt USING (term) JOIN fr USING (term) WHERE length(tm.term) > 2),
ag AS (SELECT query_id, id, count(*) AS matched, min(freq) AS min_freq, count(*) FILTER (WHERE freq <= greatest(3, floor((SELECT count(*) FROM documents) * 0.01))) AS low_freq_terms FROM lg GROUP BY 1, 2)
SELECT *, round(least(0.6 + 0.2 * matched + CASE WHEN min_freq <= 1 THEN 2.0 WHEN min_freq <= 3 THEN 0.8 WHEN min_freq <= 10 THEN 0.4 ELSE 0 END, 2.0), 6)::DOUBLE AS score FROM ag""")
def qa_lexical_scores(t):
    return lexical.text_scores(lexical.query_terms(bench_queries(t)), corpus(t), "id", [F.col("text")])[0]


TOPIC_SQL = "tp AS (SELECT doc_id AS id, text[1:40] AS title, source AS category, text[1:80] AS summary, text AS body, [lang, source || '-kw'] AS keywords, CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE 'active' END AS status, doc_id % 97 AS created_at FROM documents)"


def topic_rows(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("category"),
        F.substring("text", 1, 80).alias("summary"), F.col("text").alias("body"),
        F.array("lang", F.concat("source", F.lit("-kw"))).alias("keywords"),
        F.when(F.col("doc_id") % 5 == 0, "archived").otherwise("active").alias("status"), (F.col("doc_id") % 97).alias("created_at"),
    )


@reg.query("J9 F15", f"""WITH {QS_SQL}, {TOPIC_SQL},
hit AS (SELECT tm.query_id, tm.term, tp.id, contains(lower(title || ' ' || summary || ' ' || body), term) AS spoken FROM tm JOIN tp ON tp.status = 'active' AND (contains(lower(title), term) OR contains(lower(summary), term) OR contains(lower(body), term) OR len(list_filter(keywords, lambda k: contains(lower(k), term))) > 0))
SELECT query_id, id, count(*) FILTER (WHERE spoken AND length(term) > 2) AS matched, round(least(0.5 + 0.15 * count(*) FILTER (WHERE spoken AND length(term) > 2), 1.5), 6)::DOUBLE AS score FROM hit GROUP BY 1, 2""")
def topic_keyword_scores(t):
    return lexical.topic_scores(lexical.query_terms(bench_queries(t)), topic_rows(t))


PAIR_Q_SQL = f"""w2 AS (SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(text, {SEP}), lambda w: w <> '')[2:3], ' ') AS text FROM benchmark)"""


def _two_words(t):
    words = F.filter(F.split("text", R.TOKEN_SEPARATORS), lambda w: w != "")
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 2, 2), " ").alias("text"))


@reg.query("T2", f"""WITH {PAIR_Q_SQL}, {TOPIC_SQL}, sp AS (SELECT query_id, text, list_filter(string_split(text, ' '), lambda w: length(w) > 1) AS ts FROM w2),
k AS (SELECT query_id, id, CASE WHEN contains(lower(title), lower(text)) THEN 0.8 WHEN len(list_filter(keywords, lambda k: contains(lower(k), lower(text)))) > 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS score,
 row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(lower(title), lower(CASE WHEN len(ts) > 0 THEN ts[1] ELSE text END)) THEN 0 ELSE 1 END, created_at DESC, id) AS rank
 FROM sp, tp WHERE len(list_filter(CASE WHEN len(ts) > 0 THEN ts ELSE [text] END, lambda w: NOT (contains(lower(title), lower(w)) OR contains(lower(category), lower(w)) OR contains(lower(body), lower(w)) OR len(list_filter(keywords, lambda k: contains(lower(k), lower(w)))) > 0))) = 0 AND text <> '')
SELECT * FROM k WHERE rank <= 20""")
def all_terms_search(t):
    return lexical.all_terms_search(_two_words(t), topic_rows(t), 20)


@reg.query("T3", f"""WITH w AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(text, {SEP}), lambda w: w <> '')[2] AS text FROM benchmark),
k AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 97 DESC, doc_id) AS rank FROM w, documents d
 WHERE doc_id % 4 <> 0 AND (contains(lower(d.text[1:20]), lower(w.text)) OR contains(lower(d.text), lower(w.text)) OR contains(lower(d.lang), lower(w.text)) OR contains(lower(d.source), lower(w.text))))
SELECT * FROM k WHERE rank <= 15""")
def memory_search(t):
    words = F.filter(F.split("text", R.TOKEN_SEPARATORS), lambda w: w != "")
    qn = t.benchmark.select(F.col("item_id").alias("query_id"), F.get(words, 1).alias("text"))
    mem = t.documents.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"),
        F.when(F.col("doc_id") % 4 == 0, "archived").otherwise("active").alias("status"), (F.col("doc_id") % 97).alias("created_at"),
    )
    return lexical.memory_search(qn, mem, 15)


@reg.query("T4", f"""WITH w AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN lower(list_filter(regexp_split_to_array(text, {SEP}), lambda w: w <> '')[2][1:3]) || 'x zq' ELSE lower(array_to_string(list_filter(regexp_split_to_array(text, {SEP}), lambda w: w <> '')[2:4], ' ')) END AS text FROM benchmark),
tq AS (SELECT DISTINCT query_id, unnest(list_filter(string_split(text, ' '), lambda x: length(x) > 1)) AS term FROM w),
cd AS (SELECT doc_id AS id, source AS title, lang AS category, text AS content, doc_id % 97 AS created_at FROM documents WHERE doc_id % 6 <> 0),
ps AS (SELECT DISTINCT id, created_at, unnest(regexp_split_to_array(lower(title || ' ' || category || ' ' || content), {SEP})) AS word FROM cd),
ex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, any_value(created_at) DESC, id) AS rank FROM tq JOIN ps ON word = term GROUP BY query_id, id),
sb AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY max(CASE WHEN contains(lower(title), term) THEN 1 ELSE 0 END) DESC, max(created_at) DESC, id) AS rank FROM tq, cd
  WHERE query_id NOT IN (SELECT query_id FROM ex) AND (contains(lower(title), term) OR contains(lower(category), term) OR contains(lower(content), term)) GROUP BY query_id, id)
SELECT query_id, id, rank, 'word' AS matched_by FROM ex WHERE rank <= 10 UNION ALL SELECT query_id, id, rank, 'substring' FROM sb WHERE rank <= 10""")
def card_search(t):
    words = F.filter(F.split("text", R.TOKEN_SEPARATORS), lambda w: w != "")
    text = F.when(F.col("item_id") % 3 == 0, F.concat(F.lower(F.substring(F.get(words, 1), 1, 3)), F.lit("x zq"))).otherwise(
        F.lower(F.array_join(F.slice(words, 2, 3), " "))
    )
    qn = t.benchmark.select(F.col("item_id").alias("query_id"), text.alias("text"))
    cards = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("category"), F.col("text").alias("content"),
        (F.col("doc_id") % 97).alias("created_at"), F.when(F.col("doc_id") % 6 == 0, F.lit(1)).alias("archived_at"),
    )
    return lexical.card_search(qn, cards, 10)


@reg.query("T5", f"""WITH {QS_SQL}, h AS (SELECT query_id, id, count(*) AS matched_terms FROM tm JOIN mt USING (term) WHERE length(tm.term) > 2 GROUP BY 1, 2),
k AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY matched_terms DESC, CASE WHEN id % 8 = 0 THEN NULL ELSE id % 89 END DESC NULLS LAST, id DESC) AS rank FROM h)
SELECT * FROM k WHERE rank <= 50""")
def delivery_candidates(t):
    d = corpus(t).select("id", F.col("text").alias("content"), F.when(F.col("id") % 8 != 0, F.col("id") % 89).alias("created_at"))
    return lexical.delivery_candidates(lexical.query_terms(bench_queries(t)), d, 50)


@reg.query("P31", f"""WITH s AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN trim(text[1:4]) ELSE text END AS text FROM benchmark), {TOPIC_SQL},
h AS (SELECT query_id, arg_min(title, id) AS title FROM s JOIN tp ON length(trim(text)) < 6 AND status = 'active' AND contains(lower(title), lower(trim(text))) GROUP BY query_id)
SELECT query_id, text, coalesce(title, text) AS expanded FROM s LEFT JOIN h USING (query_id)""")
def short_query_expansion(t):
    s = t.benchmark.select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("item_id") % 2 == 0, F.trim(F.substring("text", 1, 4))).otherwise(F.col("text")).alias("text"),
    )
    return lexical.expand_short_query(s, topic_rows(t))


_KW_STOP = ",".join(q(w) for w in R.KEYWORD_STOPWORDS)
KW_SQL = f"""kx AS (SELECT doc_id AS id, unnest(regexp_extract_all(source || ' ' || text, '[a-zA-Z][a-zA-Z0-9_-]{{2,}}')) AS keyword FROM documents {{where}}),
kc AS (SELECT id, keyword, count(*) AS n FROM kx WHERE lower(keyword) NOT IN ({_KW_STOP}) GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, keyword) AS rank FROM kc QUALIFY rank <= 6)"""


def kw_sql(where: str = "") -> str:
    return KW_SQL.replace("{where}", where)



@reg.query("P36", f"WITH {kw_sql()} SELECT id, keyword, n, rank FROM kw")
def item_keywords(t):
    d = corpus(t)
    return lexical.keywords(d, "id", F.col("source"), F.col("text"))


CARDS_WHERE = "WHERE doc_id % 3 <> 0"


def _cards(t):
    return corpus(t).select(
        "id", F.col("source").alias("title"), F.col("text").alias("content"),
        F.when(F.col("id") % 3 == 0, 0.9).otherwise(0.3).alias("confidence"), (F.col("id") % 2 + 1).alias("observation_count"),
    )


def _texts(t):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")


OBS_SQL = f"""{kw_sql(CARDS_WHERE)}, ob AS (SELECT kw.id, count(DISTINCT c.conv_id * 1000 + c.turn) AS observations FROM kw JOIN conversations c ON contains(c.text, kw.keyword) GROUP BY kw.id)"""


@reg.query("J35", f"WITH {OBS_SQL} SELECT id, observations FROM ob")
def keyword_observations(t):
    low = _cards(t).filter("confidence < 0.7")
    kw = lexical.keywords(low, "id", F.col("title"), F.col("content"))
    return lexical.observation_counts(kw, "id", _texts(t), "text_id", "text")


@reg.query("A31 J35", f"""WITH {OBS_SQL}, c AS (SELECT doc_id AS id, doc_id % 2 + 1 AS oc FROM documents {CARDS_WHERE}), j AS (SELECT c.id, oc, coalesce(observations, 0) AS n FROM c LEFT JOIN ob USING (id))
SELECT count(*) AS scanned, count(*) FILTER (WHERE n > 0) AS verified, count(*) FILTER (WHERE n > 0 AND oc + n >= 3) AS boosted, CAST(sum(oc + n) AS BIGINT) AS observations FROM j""")
def confidence_pass(t):
    c = topics.confidence_pass(_cards(t), _texts(t))
    return c.agg(
        F.count("*").alias("scanned"), F.count_if("verified").alias("verified"), F.count_if("boosted").alias("boosted"),
        F.sum("observation_count").alias("observations"),
    )


@reg.query("F3 F4", f"""WITH {QS_SQL}, x AS (SELECT tk.query_id, d.doc_id, list_aggregate(list_transform(list_distinct(tok), lambda w: CASE WHEN contains(lower(source), w) THEN 0.4 WHEN contains(lower(lang), w) THEN 0.3 WHEN contains(lower(d.text), w) THEN 0.25 ELSE 0 END), 'sum') AS s
 FROM tk JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = tk.query_id)
SELECT query_id, doc_id, round(least(s, 1.0), 6)::DOUBLE AS score, CASE doc_id % 5 WHEN 1 THEN 0.3 WHEN 3 THEN 0.15 ELSE 0 END::DOUBLE AS bigram FROM x""")
def keyword_scores(t):
    n = t.benchmark.agg(F.count("*").alias("n")).scalar()
    qn = bench_queries(t).select("query_id", T.tokenize(F.col("text")).alias("terms"))
    d = t.documents.withColumn("query_id", F.pmod(F.col("doc_id"), n))
    score = T.keyword_score(F.col("source"), F.array("lang"), F.col("text"), F.col("terms"))
    cjk_title = F.when(F.col("doc_id") % 5 == 1, "数据湖").when(F.col("doc_id") % 5 == 3, "数据").otherwise("none")
    bigram = T.bigram_score(cjk_title, F.array("lang"), T.cjk_bigrams(F.lit("数据湖")))
    return d.join(qn, "query_id").select("query_id", "doc_id", F.round(score, 6).alias("score"), F.round(bigram, 6).alias("bigram"))
