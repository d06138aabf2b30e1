"""Registered queries of the core operators, and SQL that gives the same rows on the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.vectors import hash_buckets, top_by_blocks
from ..operators import answer, chunking, evaluate, index, metadata, search, serving
from ..session import materialize, shared_dir, table
from ..sources import pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Pieces of SQL shared by several queries.
_FOLD_FROM, _FOLD_TO = T.fold_chars()
_LIG = "lower({x})"
for _a, _b in T.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"
_FOLD = "translate(" + _LIG + ", '" + _FOLD_FROM + "', '" + _FOLD_TO.replace("'", "''") + "')"
_SP = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x0b]+"
_NORM = f"trim(regexp_replace(translate({{x}}, '’‘«»“”–—', '''''\"\"\"\"--'), '{_SP}', ' ', 'g'), ' ')"


def fold_sql(x: str) -> str:
    return _FOLD.replace("{x}", x)


def norm_sql(x: str) -> str:
    return _NORM.replace("{x}", x)


def words_sql(x: str) -> str:
    return f"regexp_extract_all(lower({norm_sql(x)}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def marked_sql(x: str) -> str:
    """Runs of digits in angle brackets, which stand in for the look-around that RE2 lacks."""
    return f"regexp_replace({x}, '([0-9]+)', '<\\1>', 'g')"


_BAM = r"(?i)<([0-9]{1,3})>\s*/?\s*([gw])\s*/?\s*<([0-9]{4}|[0-9]{2})>"
_AMMC = r"(?i)n\s*°\s*<([0-9]{1,2})>\s*[-_/]\s*<([0-9]{4}|[0-9]{2})>"


def refs_sql(x: str) -> str:
    m = marked_sql(x)
    ex = lambda p, g: f"regexp_extract_all({m}, '{p}', {g})"
    year = "CASE WHEN length(r[3]) = 4 THEN r[3] ELSE '20' || r[3] END"
    a = f"list_transform(list_zip({ex(_BAM, 1)}, {ex(_BAM, 2)}, {ex(_BAM, 3)}), lambda r: 'ref:' || r[1]::int || '/' || lower(r[2]) || '/' || {year})"
    b = f"list_transform(list_zip({ex(_AMMC, 1)}, {ex(_AMMC, 2)}), lambda r: 'ref:' || lpad((r[1]::int)::varchar, 2, '0') || '-' || r[2])"
    return f"list_concat({a}, {b})"


def tokens_sql(x: str) -> str:
    w = f"list_filter(regexp_extract_all({fold_sql(x)}, '[a-z0-9]+'), lambda w: w NOT IN ({_strings(sorted(set(C.STOPWORDS)))}))"
    return f"list_concat(list_transform({w}, lambda w: regexp_replace(w, '^(.{{4,}})[sx]$', '\\1')), {refs_sql(x)})"


_ASKED = "SELECT DISTINCT id AS query_id, question FROM golden WHERE TRY_CAST(substr(id, 2) AS BIGINT) % 100 = 0"
_HASHED = """{name} AS (
  SELECT k, bucket, count(*) AS n FROM (
    SELECT k, CAST('0x' || substr(md5(unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'))), 1, 2) AS INTEGER) AS bucket FROM ({rows})) GROUP BY ALL)"""


def dense_sql(rows: str, k: int) -> str:
    q = _HASHED.format(name="q", rows=f"SELECT query_id AS k, question AS t FROM ({_ASKED})")
    c = _HASHED.format(name="c", rows=rows)
    return f"""{q}, {c},
  qn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM q GROUP BY k), cn AS (SELECT k, sqrt(sum(n * n)) AS norm FROM c GROUP BY k),
  dots AS (SELECT q.k AS query_id, c.k AS chunk_id, sum(q.n * c.n) AS dot FROM q JOIN c USING (bucket) GROUP BY ALL),
  scored AS (SELECT query_id, chunk_id, round(dot / (qn.norm * cn.norm), 9) AS score FROM dots JOIN qn ON qn.k = query_id JOIN cn ON cn.k = chunk_id),
  dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {k})"""


_CHUNK_ROWS = "SELECT DISTINCT id AS k, text AS t FROM chunks WHERE text IS NOT NULL"


def bm25_sql(k: int) -> str:
    return f"""tok AS (SELECT id AS chunk_id, {tokens_sql('whole')} AS ts FROM (SELECT DISTINCT id, concat_ws(' ', reference, section, text) AS whole FROM chunks WHERE text IS NOT NULL)),
  stats AS (SELECT count(*) AS chunks, greatest(coalesce(avg(len(ts)), 1), 1) AS avg_len FROM tok),
  post AS (SELECT chunk_id, n, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS n, unnest(ts) AS term FROM tok) GROUP BY ALL),
  wt AS (SELECT chunk_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)) AS weight, chunks FROM post, stats),
  asked AS (SELECT DISTINCT query_id, unnest({tokens_sql('question')}) AS term FROM ({_ASKED})),
  df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM asked) GROUP BY term),
  kw0 AS (SELECT query_id, chunk_id, round(sum(weight * ln(1 + (chunks - df + 0.5) / (df + 0.5))), 9) AS score FROM wt JOIN df USING (term) JOIN asked USING (term) GROUP BY ALL),
  kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM kw0 QUALIFY rank <= {k})"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set: golden questions whose number is divisible by 100."""
    g = table(spark, d, "golden").where(F.expr("TRY_CAST(substr(id, 2) AS BIGINT) % 100 = 0"))
    return g.select(F.col("id").alias("query_id"), "question").distinct()


# ---- search ------------------------------------------------------------------------------------------------------


@query(f"WITH {dense_sql(_CHUNK_ROWS, 6)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.dense(table(spark, d, "chunks"), asked(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {dense_sql(_CHUNK_ROWS + " AND issuer = 'BAM' AND published BETWEEN DATE '2020-01-01' AND DATE '2029-12-31'", 6)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense""")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = search.SearchFilter(issuers=("BAM",), date_from="2020-01-01", date_to="2029-12-31")
    return search.dense(table(spark, d, "chunks"), asked(spark, d), where=f).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e AS q, e WHERE q.vec_id % 100 = 0)
SELECT query_id, neighbour_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 6""")
def dense_knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return top_by_blocks(e.select(F.col("vec_id").alias("neighbour_id"), "embedding"), "neighbour_id", "embedding", q, "query_id", "q", 6).withColumn("score", F.round("score", 6))


@query("""WITH """ + _HASHED.format(name="c", rows="SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL") + """
SELECT k AS doc_id, CAST(count(*) AS BIGINT) AS buckets, CAST(sum(n) AS BIGINT) AS words, round(sqrt(sum(n * n)), 6) AS norm FROM c GROUP BY k""")
def hash_embed_norms(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(hash_buckets("text")).alias("bucket"))
    return b.groupBy("doc_id", "bucket").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum("n").alias("words"), F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 6).alias("norm"))


@query(f"WITH {bm25_sql(6)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "chunks"), asked(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {bm25_sql(6)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search over the postings of an index that was built from some issuers' chunks and then brought up to date with all."""
    chunks = table(spark, d, "chunks")
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.build(chunks.where("issuer = 'BAM'"), root, avg_len=search.corpus_stats(search.token_rows(chunks)).first()["avg_len"])
    index.ingest(root, chunks)
    return index.keyword_search(spark, root, asked(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {bm25_sql(6)} SELECT chunk_id, CAST(count(*) AS BIGINT) AS terms, CAST(sum(tf) AS BIGINT) AS length, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS weight
FROM post, stats GROUP BY chunk_id""")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    t = search.token_rows(table(spark, d, "chunks"))
    return search.postings(t, search.corpus_stats(t)).groupBy("chunk_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""WITH {bm25_sql(6)} SELECT term, CAST(count(*) AS BIGINT) AS df, round(ln(1 + (any_value(chunks) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post, stats GROUP BY term""")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    t = search.token_rows(table(spark, d, "chunks"))
    df = t.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(search.corpus_stats(t))).select("term", "df", F.round(search.idf(F.col("chunks"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {dense_sql(_CHUNK_ROWS, 30)}, {bm25_sql(30)},
  f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM kw) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 6""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(table(spark, d, "chunks"), asked(spark, d)).withColumn("score", F.round("score", 6))


_W3 = "list_distinct(regexp_extract_all(lower({x}), '[\\p{L}\\p{N}_]{3,}'))"


@query(f"""WITH {dense_sql(_CHUNK_ROWS, 20)},
  j AS (SELECT query_id, chunk_id, score AS first_stage_score, rank AS first, {_W3.replace('{x}', 'question')} AS q, {_W3.replace('{x}', 't')} AS w
        FROM dense JOIN ({_ASKED}) USING (query_id) JOIN ({_CHUNK_ROWS}) ON k = chunk_id),
  s AS (SELECT *, round(len(list_intersect(q, w)) / greatest(len(q), 1), 9) AS score FROM j)
SELECT query_id, chunk_id, round(score, 6) AS score, round(first_stage_score, 6) AS first_stage_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM s QUALIFY rank <= 6""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    c, q = table(spark, d, "chunks"), asked(spark, d)
    out = search.rerank(search.dense(c, q, 20), q, c)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("first_stage_score", 6).alias("first_stage_score"), "rank")


# ---- language, guardrails, text ----------------------------------------------------------------------------------


def language_sql(x: str) -> str:
    n = lambda p, y: f"len(regexp_extract_all({y}, '{p}'))"
    words = f"regexp_extract_all(lower({x}), '[a-zà-ÿ'']+')"
    count = lambda hints: f"len(list_filter({words}, lambda w: w IN ({_strings(hints)})))"
    ar, la = n(r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]", x), n("[A-Za-zÀ-ÿ]", x)
    fr, en = f"({count(C.FRENCH_HINTS)} + 2 * {n('[éèêàùçôîâ]', f'lower({x})')})", count(C.ENGLISH_HINTS)
    return f"CASE WHEN {ar} > 0 AND {ar} >= {la} THEN 'ar' WHEN {fr} = 0 AND {en} = 0 THEN 'fr' WHEN {fr} >= {en} THEN 'fr' ELSE 'en' END"


@query(f"SELECT doc_id, {language_sql('text')} AS language FROM documents WHERE text IS NOT NULL")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.detect_language("text").alias("language"))


@query(f"""SELECT lang, CAST(count_if(g = 'fr') AS BIGINT) AS fr, CAST(count_if(g = 'en') AS BIGINT) AS en, CAST(count_if(g = 'ar') AS BIGINT) AS ar
FROM (SELECT lang, {language_sql('text')} AS g FROM documents WHERE text IS NOT NULL) GROUP BY lang""")
def language_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = detect_language(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.confusion(rows, "lang", "language", ["fr", "en", "ar"])


def sanitize_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({x}, '’‘', ''''''), '[^\\PC\\n\\t]', '', 'g'), '{_SP}', ' ', 'g'), ' ')"


_GUARD = f"""SELECT id, CASE WHEN q = '' THEN 'empty' WHEN length(q) > 1000 THEN 'too_long' WHEN {' OR '.join("regexp_matches(q, '(?i)" + p.replace("'", "''") + "')" for p in C.META_PATTERNS)} THEN 'meta'
  WHEN regexp_full_match(q, '(?i)(?:{C.GREETING_WORDS})[\\s!.,؟?]*(?:(?:à vous|à toi|everyone|all))?[\\s!.,؟?]*') THEN 'greeting' ELSE 'ok' END AS verdict
FROM (SELECT DISTINCT id, {sanitize_sql('question')} AS q FROM golden)"""


@query(_GUARD)
def guardrail_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").select("id", "question").distinct().select("id", T.guard_verdict("question").alias("verdict"))


@query(f"""WITH v AS ({_GUARD}), c AS (SELECT CASE WHEN answerable THEN 'ok' ELSE 'off_topic' END AS expected, verdict FROM v JOIN (SELECT DISTINCT id, answerable FROM golden) USING (id))
SELECT expected, CAST(count(*) AS BIGINT) AS n, CAST(count_if(verdict = expected) AS BIGINT) AS "right", round(count_if(verdict = expected) / count(*), 6) AS accuracy FROM c GROUP BY expected""")
def guard_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the guard alone on all questions: an answerable one ought to pass, another to be off topic."""
    g = table(spark, d, "golden").select("id", "question", "answerable").distinct()
    return evaluate.guard_accuracy(g.select(F.when(F.col("answerable"), "ok").otherwise("off_topic").alias("expected"), T.guard_verdict("question").alias("verdict")))


@query()
def scope_scores(spark: SparkSession, d: str) -> DataFrame:
    return answer.scope_scores(table(spark, d, "golden").select(F.col("id").alias("query_id"), "question"))


_LINES = "list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda s: trim(s, ' ') != '')"


@query(f"""SELECT file, page, coalesce(array_to_string([s FOR s, i IN l IF NOT ((i <= 2 OR i > len(l) - 2) AND regexp_full_match(s, '\\s*[-–]?\\s*[0-9]{{1,3}}\\s*[-–]?\\s*'))], chr(10)), '') AS body
FROM (SELECT file, p.page AS page, {_LINES.replace('text', 'p.text')} AS l FROM (SELECT DISTINCT file, unnest(pages) AS p FROM ocr_payload))""")
def strip_edge_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return pages.exploded(table(spark, d, "ocr_payload")).select("file", "page", T.strip_page_number_lines("text").alias("body"))


@query()
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.exploded(table(spark, d, "ocr_payload")).withColumn("text", T.nfc("text")).select("file", "page", T.clean_page("text").alias("text"))


@query(f"""SELECT id, {norm_sql('question')} AS normalized, lower(regexp_replace({norm_sql('question')}, '{_SP}', '', 'g')) AS compacted, {fold_sql('question')} AS folded,
  CAST(len({words_sql('question')}) AS INTEGER) AS words, substr(sha256(question), 1, 12) AS key_id, CAST(len({tokens_sql('question')}) AS INTEGER) AS search_tokens
FROM (SELECT DISTINCT id, question FROM golden)""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden").select("id", "question").distinct()
    return g.select("id", T.normalize("question").alias("normalized"), T.compact("question").alias("compacted"), T.fold("question").alias("folded"), F.size(T.content_words("question")).alias("words"), T.key_id("question").alias("key_id"), F.size(T.search_tokens("question")).alias("search_tokens"))


@query(f"SELECT id, array_to_string({refs_sql('header')}, ' ') AS refs FROM (SELECT DISTINCT id, coalesce(header, '') AS header FROM chunks)")
def reference_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.coalesce("header", F.lit("")).alias("header")).distinct().select("id", F.array_join(T.reference_tokens("header"), " ").alias("refs"))


@query("""SELECT term, CAST(CAST('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2) AS BIGINT) >> 1 AS BIGINT) AS term_index
FROM (SELECT DISTINCT reference AS term, md5(reference) AS m FROM doc_meta WHERE reference IS NOT NULL)""")
def term_indexes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_meta").where(F.col("reference").isNotNull()).select(F.col("reference").alias("term")).distinct().select("term", T.term_index("term").alias("term_index"))


@query()
def title_references(spark: SparkSession, d: str) -> DataFrame:
    return metadata.latest(table(spark, d, "doc_meta")).select("file", T.title_reference("title", "issuer").alias("reference"))


_DAY = r"(?:^|[^\p{L}\p{N}_])(1[eE][rR]|[0-9]{1,2})\s+([a-zA-Zéèêûô]+)\s+([0-9]{4})(?:[^\p{L}\p{N}_]|$)"


@query(f"""WITH m AS (SELECT id, list_zip(regexp_extract_all(text, '{_DAY}', 1), regexp_extract_all(text, '{_DAY}', 2), regexp_extract_all(text, '{_DAY}', 3)) AS l FROM (SELECT DISTINCT id, text FROM chunks)),
  c AS (SELECT id, list_filter(list_transform(l, lambda r: TRY_CAST(r[3] || '-' || lpad(CAST(list_position([{_strings(C.MONTHS)}], {fold_sql('r[2]')}) AS VARCHAR), 2, '0') || '-' || lpad(replace(lower(r[1]), 'er', ''), 2, '0') AS DATE)), lambda v: v IS NOT NULL) AS v FROM m)
SELECT id, v[1] AS first_date FROM c WHERE len(v) > 0""")
def french_dates(spark: SparkSession, d: str) -> DataFrame:
    return search.unique_chunks(table(spark, d, "chunks").select("id", "text")).select("id", T.french_date("text").alias("first_date")).where(F.col("first_date").isNotNull())


def article_ids_sql(s: str) -> str:
    return f"""list_distinct(list_concat(
  list_transform(regexp_extract_all({s}, '(?i)(premier|1er|[0-9]+(?:\\.[0-9]+)*)', 1), lambda m: CASE WHEN lower(m) IN ('premier', '1er') THEN '1' ELSE m END),
  flatten(list_transform(list_zip(regexp_extract_all({s}, '([0-9]+)\\s*-\\s*([0-9]+)', 1), regexp_extract_all({s}, '([0-9]+)\\s*-\\s*([0-9]+)', 2)),
    lambda r: CASE WHEN r[2]::int >= r[1]::int AND r[2]::int - r[1]::int <= 20 THEN list_transform(range(r[1]::int, r[2]::int + 1), lambda n: n::varchar) ELSE [] END))))"""


@query(f"SELECT s AS section, array_to_string(list_sort({article_ids_sql('s')}), ' ') AS ids FROM (SELECT DISTINCT section AS s FROM chunks WHERE section IS NOT NULL)")
def section_article_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "chunks").where(F.col("section").isNotNull()).select("section").distinct()
    return s.select("section", F.array_join(F.array_sort(T.article_ids("section")), " ").alias("ids"))


@query("""SELECT file, lower(issuer) || '-' || slug || '-' || substr(sha1(url), 1, 8) AS stem FROM (
  SELECT DISTINCT file, issuer, url, CASE WHEN c = '' THEN 'document' ELSE translate(c, ' ', '-') END AS slug FROM (
    SELECT file, issuer, url, rtrim(substr(trim(regexp_replace(""" + fold_sql("title") + """, '[^a-z0-9]+', ' ', 'g'), ' '), 1, 60), ' ') AS c FROM doc_meta))""")
def document_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_meta").select("file", "issuer", "url", "title").distinct().select("file", T.document_stem("issuer", "title", "url").alias("stem")).distinct()


_LINK = "replace(url_encode(regexp_extract(url, '^([^#]*)', 1)), '%25', chr(1))"
for _c in ":/?&=+@;,~!$'()*":
    _LINK = f"replace({_LINK}, '%{ord(_c):02X}', chr({ord(_c)}))"


@query(f"SELECT id, replace({_LINK}, chr(1), '%') || '#page=' || CAST(page_start AS VARCHAR) AS link FROM (SELECT DISTINCT id, url, page_start FROM chunks)")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return search.unique_chunks(table(spark, d, "chunks").select("id", "url", "page_start")).select("id", T.page_link("url", "page_start").alias("link"))


# ---- chunking ----------------------------------------------------------------------------------------------------


def _chunked(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return chunking.chunk_documents(pages.page_texts(pages.exploded(table(spark, d, "ocr_payload")), table(spark, d, "spans").select("file", F.col("span_id").alias("page"), "text")), strategy)


@query()
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "fixed")


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "sentence")


@query()
def legal_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _chunked(spark, d, "legal")
    return index.with_ids(c, table(spark, d, "doc_meta"))


@query()
def article_headings(spark: SparkSession, d: str) -> DataFrame:
    return chunking.article_rows(search.unique_chunks(table(spark, d, "chunks").select("id", "text")), "id", "text")


@query("""SELECT id, coalesce(len(t) >= 12 AND 4 * len(list_filter(t, lambda w: regexp_matches(w, '[0-9]'))) >= len(t), false) AS table_like
FROM (SELECT DISTINCT id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w != '') AS t FROM chunks WHERE text IS NOT NULL)""")
def table_like_chunks(spark: SparkSession, d: str) -> DataFrame:
    return search.unique_chunks(table(spark, d, "chunks").where(F.col("text").isNotNull()).select("id", "text")).select("id", chunking.is_table_like("text").alias("table_like"))


# ---- evaluation --------------------------------------------------------------------------------------------------

_COVER = "coalesce(len(list_filter({q}, lambda w: list_contains({t}, w))) / nullif(len({q}), 0), 0)"
_EVIDENCE = """ev AS (SELECT id, e.file AS file, e.page AS page, e.quote AS quote FROM (
  SELECT id, unnest(list_filter(list_concat([evidence], coalesce(extra_evidence, [])), lambda x: x IS NOT NULL)) AS e FROM (SELECT DISTINCT * FROM golden)))"""


@query(f"""WITH {_EVIDENCE}, q AS (SELECT id, file, {words_sql('quote')} AS qw FROM ev WHERE quote IS NOT NULL), c AS (SELECT DISTINCT id AS chunk_id, file, list_distinct({words_sql('text')}) AS tw FROM chunks WHERE text IS NOT NULL)
SELECT id, chunk_id, round(max({_COVER.format(q='qw', t='tw')}), 6) AS coverage FROM q JOIN c USING (file) GROUP BY ALL HAVING max({_COVER.format(q='qw', t='tw')}) >= 0.5""")
def passage_hits(spark: SparkSession, d: str) -> DataFrame:
    ev = evaluate.all_evidence(table(spark, d, "golden")).where(F.col("quote").isNotNull()).select("id", "file", T.content_words("quote").alias("qw"))
    c = search.unique_chunks(table(spark, d, "chunks").where(F.col("text").isNotNull()).select("id", "file", "text")).select(F.col("id").alias("chunk_id"), "file", F.array_distinct(T.content_words("text")).alias("tw"))
    cover = F.coalesce(F.size(F.filter("qw", lambda w: F.array_contains("tw", w))) / F.nullif(F.size("qw"), F.lit(0)), F.lit(0.0))
    return ev.join(c, "file").groupBy("id", "chunk_id").agg(F.round(F.max(cover), 6).alias("coverage")).where(F.col("coverage") >= 0.5)


@query(f"""WITH {dense_sql(_CHUNK_ROWS, 6)}, {_EVIDENCE}, g AS (SELECT DISTINCT id, difficulty, language, theme, {article_ids_sql("coalesce(expected_section, '')")} AS wanted FROM golden
    WHERE answerable AND evidence IS NOT NULL AND status IS DISTINCT FROM 'rejected' AND id IN (SELECT query_id FROM dense)),
  j AS (SELECT g.id, rank, {_COVER.format(q=words_sql('quote'), t=words_sql('text'))} >= 0.5 AS covers, list_has_any(wanted, {article_ids_sql("coalesce(section, '')")}) AS fits
        FROM dense JOIN g ON g.id = query_id JOIN (SELECT DISTINCT id AS chunk_id, file, text, section FROM chunks) c USING (chunk_id) JOIN ev ON ev.id = g.id AND ev.file = c.file),
  r AS (SELECT g.id, difficulty, language, theme, min(CASE WHEN covers THEN rank END) AS p, min(rank) AS d, min(CASE WHEN fits THEN rank END) AS s FROM g LEFT JOIN j ON j.id = g.id GROUP BY ALL),
  per AS (SELECT 'all' AS slice, NULL AS value, p, d, s FROM r UNION ALL SELECT 'difficulty', difficulty, p, d, s FROM r UNION ALL SELECT 'language', language, p, d, s FROM r UNION ALL SELECT 'theme', theme, p, d, s FROM r)
SELECT slice, value, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (WHERE p = 1) / count(*), 6) AS hit_1, round(count(*) FILTER (WHERE p <= 3) / count(*), 6) AS hit_3, round(count(p) / count(*), 6) AS hit_k,
  round(sum(coalesce(1 / p, 0)) / count(*), 6) AS mrr_k, round(count(d) / count(*), 6) AS doc_hit_k, round(count(s) / count(*), 6) AS section_hit_k FROM per GROUP BY slice, value""")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    c, g = table(spark, d, "chunks"), table(spark, d, "golden")
    hits = materialize(search.dense(c, asked(spark, d)), "hits")
    return evaluate.retrieval_summary(evaluate.retrieval_ranks(g, hits, c))


@query(f"""WITH {dense_sql(_CHUNK_ROWS, 6)}, {_EVIDENCE}, g AS (SELECT DISTINCT id, difficulty, language, theme FROM golden WHERE answerable AND evidence IS NOT NULL AND status IS DISTINCT FROM 'rejected' AND id IN (SELECT query_id FROM dense)),
  j AS (SELECT g.id, rank, ev.file = c.file AS same, {_COVER.format(q=words_sql('quote'), t=words_sql('text'))} >= 0.5 AS covers
        FROM dense JOIN g ON g.id = query_id JOIN (SELECT DISTINCT id AS chunk_id, file, text FROM chunks) c USING (chunk_id) JOIN ev ON ev.id = g.id)
SELECT g.id, CAST(min(CASE WHEN same AND covers THEN rank END) AS INTEGER) AS passage_rank, CAST(min(CASE WHEN same THEN rank END) AS INTEGER) AS doc_rank FROM g LEFT JOIN j ON j.id = g.id GROUP BY g.id""")
def first_hit_ranks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    hits = materialize(search.dense(c, asked(spark, d)), "hits")
    return evaluate.retrieval_ranks(table(spark, d, "golden"), hits, c).select("id", "passage_rank", "doc_rank")


@query("""SELECT id, CASE WHEN answerable AND evidence IS NULL THEN 'answerable without evidence'
  WHEN NOT answerable AND (evidence IS NOT NULL OR len(coalesce(expected_facts, [])) > 0 OR len(coalesce(derived_facts, [])) > 0) THEN 'unanswerable with evidence or facts'
  WHEN len(coalesce(derived_facts, [])) > 0 AND notes IS NULL THEN 'derived facts without notes' END AS error FROM (SELECT DISTINCT * FROM golden) WHERE error IS NOT NULL""")
def golden_consistency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.consistency_errors(table(spark, d, "golden"))


@query("SELECT language, status, CAST(count(DISTINCT id) AS BIGINT) AS items FROM golden GROUP BY ALL")
def golden_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").groupBy("language", "status").agg(F.countDistinct("id").alias("items"))


def compact_sql(x: str) -> str:
    return f"lower(regexp_replace({norm_sql(x)}, '{_SP}', '', 'g'))"


@query(f"""WITH {_EVIDENCE}, p AS (SELECT DISTINCT file, page, {compact_sql('text')} AS t FROM native_pages),
  j AS (SELECT ev.*, p.page AS pp, contains(p.t, {compact_sql('quote')}) AS h FROM ev LEFT JOIN p ON p.file = ev.file WHERE quote IS NOT NULL)
SELECT id, file, page, CASE WHEN bool_or(pp = page AND h) THEN 'ok' WHEN count(pp) = 0 THEN 'missing file' WHEN NOT coalesce(bool_or(pp = page), false) THEN 'missing page' ELSE 'not on page' END AS status,
  min(CASE WHEN h THEN pp END) AS found_page FROM j GROUP BY id, file, page, quote""")
def quotes_on_pages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.quotes_on_pages(table(spark, d, "golden"), table(spark, d, "native_pages"))


@query()
def page_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.file_accuracy(evaluate.page_accuracy(table(spark, d, "native_pages"), pages.exploded(table(spark, d, "ocr_payload"))))


@query("""WITH b AS (SELECT DISTINCT ON (file) * FROM ocr_bench WHERE language = 'fr' ORDER BY file)
SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(pages) AS BIGINT) AS pages, round(sum(char_edits) / greatest(sum(chars), 1), 6) AS cer, round(sum(word_edits) / greatest(sum(words), 1), 6) AS wer,
  round(sum(numbers_found) / greatest(sum(numbers), 1), 6) AS number_recall, round(avg(bag_f1), 6) AS bag_f1 FROM b""")
def accuracy_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy_totals(table(spark, d, "ocr_bench"))


@query()
def fact_matching(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.fact_scores(table(spark, d, "answers"), table(spark, d, "golden"))


@query("""WITH s AS (SELECT DISTINCT answer_id, trim(answer, ' ') AS a FROM answers WHERE answer IS NOT NULL),
 t AS (SELECT answer_id, a, list_filter(regexp_extract_all(a, '[^.!?؟\\n]+(?:[.!?؟]+|$)(?:\\s*\\[[0-9]+\\])*'), lambda x: len(regexp_split_to_array(trim(x, ' '), '""" + _SP + """')) >= 4) AS l FROM s)
SELECT answer_id, round(CASE WHEN len(l) = 0 THEN CASE WHEN regexp_matches(a, '\\[[0-9]+\\]') THEN 1.0 ELSE 0.0 END ELSE len(list_filter(l, lambda x: regexp_matches(x, '\\[[0-9]+\\]'))) / len(l) END, 6) AS coverage FROM t""")
def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers").where(F.col("answer").isNotNull()).dropDuplicates(["answer_id"])
    return a.select("answer_id", F.round(T.citation_coverage("answer"), 6).alias("coverage"))


@query("""SELECT answer_id, regexp_replace(regexp_replace(answer, '\\[(?:[04-9]|[0-9]{2,})\\]', '', 'g'), '[ \\t]+([.,;:])', '\\1', 'g') AS answer,
  array_to_string(list_filter(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda m: coalesce(TRY_CAST(m AS INT) BETWEEN 1 AND 3, false)), ' ') AS cited
FROM (SELECT DISTINCT answer_id, answer FROM answers WHERE answer IS NOT NULL)""")
def valid_citations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers").where(F.col("answer").isNotNull()).dropDuplicates(["answer_id"])
    marks = F.filter(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: F.coalesce(m.try_cast("int").between(1, 3), F.lit(False)))
    return a.select("answer_id", T.keep_valid_citations("answer", F.lit(3)).alias("answer"), F.array_join(marks, " ").alias("cited"))


def _summary_sql(by: str) -> str:
    p = lambda q: f"list_sort(list(latency_ms) FILTER (abstention != 'score'))[1 + CAST(round_even({q} * (count(latency_ms) FILTER (abstention != 'score') - 1), 0) AS INTEGER)]"
    return f"""SELECT {by}, CAST(count(*) AS BIGINT) AS n, round(sum(facts_found) FILTER (answerable) / greatest(sum(facts_total) FILTER (answerable), 1), 6) AS fact_recall,
  round(sum(numeric_found) FILTER (answerable) / greatest(sum(numeric_total) FILTER (answerable), 1), 6) AS numeric_recall,
  round(avg(coalesce(cites_document, false)::int) FILTER (answerable AND abstention = 'none'), 6) AS cites_document, round(avg(coalesce(cites_article, false)::int) FILTER (answerable AND abstention = 'none'), 6) AS cites_article,
  round(avg(citation_coverage) FILTER (answerable AND abstention = 'none'), 6) AS citation_coverage, round(avg((abstention != 'none')::int) FILTER (answerable), 6) AS false_abstention,
  round(avg((abstention != 'none')::int) FILTER (NOT answerable), 6) AS abstention_accuracy, round(avg(faithfulness), 6) AS faithfulness, round(avg((faithfulness >= 1)::int), 6) AS fully_faithful,
  round(avg(correctness) FILTER (faithfulness IS NOT NULL), 6) AS correctness, round(avg(relevance) FILTER (faithfulness IS NOT NULL), 6) AS relevance, {p(0.5)} AS latency_p50, {p(0.95)} AS latency_p95,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
FROM (SELECT DISTINCT ON (answer_id) * FROM answers ORDER BY answer_id) GROUP BY {by}"""


@query(_summary_sql("difficulty"))
def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.answer_summary(table(spark, d, "answers"), "difficulty")


@query("""SELECT answer_id, round(greatest(least(round_even(coalesce(faithfulness, 0) * 4, 0), 4), 0) / 4, 6) AS faithfulness, CAST(least(greatest(coalesce(relevance, 1), 1), 5) AS INTEGER) AS relevance,
  round(CASE WHEN n > 0 THEN least(found + 1, n) / n ELSE 1.0 END, 6) AS correctness, CAST(least(len(coalesce(unsupported, [])), 5) AS INTEGER) AS unsupported
FROM (SELECT DISTINCT answer_id, faithfulness, relevance, coalesce(facts_total, 0) AS n, coalesce(facts_found, 0) AS found, unsupported FROM answers)""")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts read back from the JSON that a judge would write with the figures of `answers` (one fact more than found)."""
    a = table(spark, d, "answers").dropDuplicates(["answer_id"]).withColumn("facts", F.coalesce("facts_total", F.lit(0)))
    figures = F.struct(F.lit(4).alias("claims"), F.bround(F.col("faithfulness") * 4).cast("int").alias("supported_claims"), "relevance", (F.coalesce("facts_found", F.lit(0)) + 1).alias("facts_conveyed"), "unsupported", "missing_facts")
    v = a.select("answer_id", answer.judge_verdict(F.concat(F.lit("```json "), F.to_json(figures), F.lit(" ```")), "facts").alias("v"))
    return v.select("answer_id", F.round("v.faithfulness", 6).alias("faithfulness"), "v.relevance", F.round("v.correctness", 6).alias("correctness"), F.size("v.unsupported").alias("unsupported"))


@query("""WITH g AS (SELECT DISTINCT id, len(coalesce(expected_facts, [])) + len(coalesce(derived_facts, [])) AS n, evidence.file AS file, evidence.page AS page FROM golden WHERE answerable),
  h AS (SELECT g.id, count(DISTINCT c.id) AS sources FROM g LEFT JOIN chunks c ON c.file = g.file AND g.page BETWEEN c.page_start AND c.page_end GROUP BY g.id)
SELECT DISTINCT answer_id, CAST(n AS INTEGER) AS facts, CAST(sources AS INTEGER) AS sources FROM answers JOIN g USING (id) JOIN h USING (id) WHERE answer IS NOT NULL AND abstention = 'none'""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge is given, with the chunks on the page of the evidence as sources."""
    c, g = table(spark, d, "chunks"), table(spark, d, "golden")
    ev = g.select(F.col("id").alias("query_id"), F.col("evidence.file").alias("file"), F.col("evidence.page").alias("page")).distinct()
    on_page = ev.join(c.select(F.col("id").alias("chunk_id"), "file", "page_start", "page_end"), "file").where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    hits = on_page.select("query_id", "chunk_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return answer.judge_prompts(table(spark, d, "answers"), g, hits, c).select("answer_id", "facts", "sources")


@query()
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    c, q = table(spark, d, "chunks"), asked(spark, d)
    hits = materialize(search.dense(c, q), "hits")
    return answer.prompts(hits, c, q)


@query()
def answered_with_citations(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain with a fixed model that cites its first and second source and one that doesn't exist."""
    c = table(spark, d, "chunks")
    g = answer.guarded(asked(spark, d), with_scope=True).where("verdict = 'ok'")
    q = materialize(g.select("query_id", F.col("clean").alias("question")), "asked")
    hits = materialize(search.dense(c, q), "hits")
    kept = answer.prompts(hits, c, q).join(answer.supported(hits).where("supported").select("query_id"), "query_id", "left_semi")
    raw = answer.generate(kept, lambda ps: ["Voir [2] et [1] , mais [9] ."] * len(ps))
    return answer.citations(answer.finished(raw, F.lit("")), hits, c)


@query()
def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain over the query set without a model: statuses and sources."""
    from . import pipeline

    return pipeline.answers(table(spark, d, "chunks"), asked(spark, d), mode="hybrid", min_score=0.01)


@query()
def followup_summary(spark: SparkSession, d: str) -> DataFrame:
    """Follow-ups whose context is the item before the target: items whose number is divisible by 100."""
    from . import pipeline

    g = table(spark, d, "golden")
    n = F.expr("TRY_CAST(substr(id, 2) AS BIGINT)")
    t = g.where((n % 100 == 0) & F.col("answerable")).select("id", F.col("id").alias("target"), F.format_string("g%08d", n + 1).alias("context"), F.lit("@target").alias("followup"), F.lit("follow_up").alias("kind")).distinct()
    return pipeline.followup_summary(pipeline.followup_ranks(t, g, table(spark, d, "chunks")))


@query("""SELECT a.verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT answer_id, CASE WHEN NOT answerable AND abstention != 'none' THEN 'right_abstention' WHEN NOT answerable THEN 'missed_abstention'
  WHEN abstention != 'none' THEN 'false_abstention' ELSE 'answered' END AS verdict FROM answers) a GROUP BY a.verdict""")
def abstention_outcomes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers").dropDuplicates(["answer_id"])
    no, ab = ~F.col("answerable"), F.col("abstention") != "none"
    v = F.when(no & ab, "right_abstention").when(no, "missed_abstention").when(ab, "false_abstention").otherwise("answered")
    return serving.counters(a.select(v.alias("verdict")), "verdict")


# ---- corpus, metadata --------------------------------------------------------------------------------------------


@query("""SELECT CAST(count(DISTINCT file) AS BIGINT) AS documents, array_to_string(list_sort(list_distinct(list(issuer))), ',') AS issuers, CAST(min(year(published)) AS INTEGER) AS first_year, CAST(max(year(published)) AS INTEGER) AS last_year FROM chunks""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return index.summary(table(spark, d, "chunks"))


_LATEST = "(SELECT DISTINCT ON (file) * FROM doc_meta ORDER BY file, fetched_at DESC NULLS LAST)"


@query(f"""WITH s AS (SELECT file, count(*) AS pages, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w != ''))) AS words FROM (SELECT DISTINCT file, page, text FROM native_pages) GROUP BY file)
SELECT issuer, CAST(grouping(issuer) AS TINYINT) AS is_total, CAST(count(*) AS BIGINT) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(words) AS BIGINT) AS words, CAST(sum((text_source IS NOT DISTINCT FROM 'ocr')::int) AS BIGINT) AS scanned,
  round(avg((text_source IS NOT DISTINCT FROM 'ocr')::int), 6) AS scanned_share FROM {_LATEST} JOIN s USING (file) GROUP BY ROLLUP (issuer)""")
def corpus_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metadata.corpus_rollup(table(spark, d, "doc_meta"), metadata.document_stats(table(spark, d, "native_pages")))


@query(f"SELECT CAST(year(published) // 5 * 5 AS INTEGER) AS period, CAST(count(*) AS BIGINT) AS documents FROM {_LATEST} WHERE published IS NOT NULL GROUP BY 1")
def period_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metadata.period_histogram(table(spark, d, "doc_meta"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS documents, median(n_chars) AS median_chars, CAST(max(n_chars) AS BIGINT) AS max_chars, count(*) FILTER (published >= DATE '2020-01-01') AS since_2020 FROM documents GROUP BY source""")
def source_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.median("n_chars").alias("median_chars"), F.max("n_chars").alias("max_chars"), F.count_if(F.col("published") >= F.lit("2020-01-01").cast("date")).alias("since_2020"))


@query(f"SELECT file, title, issuer, reference, published, url, language, source_page, sha256, text_source, needs_review, notes FROM {_LATEST}")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return metadata.manifest(table(spark, d, "doc_meta"))


@query(f"""SELECT m.file, CASE WHEN m.issuer = 'AMMC' THEN NULL ELSE m.reference END AS reference, CASE WHEN m.issuer = 'AMMC' THEN 'x-' || m.title ELSE m.title END AS title,
  (CASE WHEN m.issuer = 'AMMC' THEN NULL ELSE m.reference END) IS NULL OR m.published IS NULL AS needs_review FROM {_LATEST} m""")
def override_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = materialize(metadata.latest(table(spark, d, "doc_meta")), "latest")
    o = m.where("issuer = 'AMMC'").select("file", F.array(F.lit("reference"), F.lit("title")).alias("fields"), F.lit(None).cast("string").alias("reference"), F.concat(F.lit("x-"), "title").alias("title"))
    return metadata.override(m, o).select("file", "reference", "title", "needs_review")


@query("SELECT DISTINCT url FROM doc_meta WHERE url NOT IN (SELECT url FROM chunks WHERE url IS NOT NULL) AND url IS NOT NULL")
def missing_selected_urls(spark: SparkSession, d: str) -> DataFrame:
    return metadata.missing_urls(table(spark, d, "doc_meta").where(F.col("url").isNotNull()), table(spark, d, "chunks"))


@query("""SELECT file, title, url FROM (SELECT DISTINCT ON (url) * FROM doc_meta ORDER BY url, fetched_at, file) WHERE issuer = 'AMMC' AND regexp_matches(title, '(?i)circulaire') AND regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '\\.pdf$')""")
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    c = metadata.first_wins(table(spark, d, "doc_meta"), "url", ["fetched_at", "file"])
    return metadata.select_candidates(c, "ammc", "circulaire").where(metadata.is_pdf(F.col("url"))).select("file", "title", "url")


@query("""WITH old AS (SELECT file, max(sha256) AS sha FROM doc_meta WHERE fetched_at < TIMESTAMP '2031-08-01' GROUP BY file), new AS (SELECT file, max(sha256) AS sha FROM doc_meta WHERE fetched_at >= TIMESTAMP '2031-06-01' GROUP BY file)
SELECT new.file, CASE WHEN old.file IS NULL THEN 'added' WHEN old.sha IS NOT DISTINCT FROM new.sha THEN 'unchanged' ELSE 'updated' END AS status FROM new LEFT JOIN old USING (file)""")
def incremental_ingest_status(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "doc_meta")
    state = lambda c: m.where(c).groupBy("file").agg(F.max("sha256").alias("sha"), F.count("*").alias("n"))
    return index.ingest_status(state("fetched_at < TIMESTAMP '2031-08-01'"), state("fetched_at >= TIMESTAMP '2031-06-01'"))


@query("""WITH b AS (SELECT DISTINCT ON (id) id, file, section FROM chunks WHERE issuer != 'ACAPS' ORDER BY id), n AS (SELECT DISTINCT ON (id) id, file, 'new' AS section FROM chunks WHERE issuer != 'BAM' ORDER BY id)
SELECT * FROM b WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upserted_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "file", "section", "issuer")
    base = c.where("issuer != 'ACAPS'").drop("issuer").dropDuplicates(["id"])
    return index.upsert(base, c.where("issuer != 'BAM'").withColumn("section", F.lit("new")).drop("issuer"))


# ---- serving, conversations --------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT DISTINCT ON (conv_id, turn_no) * FROM turns ORDER BY conv_id, turn_no),
 p AS (SELECT *, list(CASE WHEN length(trim(coalesce(answer, ''), ' ')) > 0 THEN turn_no END) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM t)
SELECT turn_id, CAST(least(coalesce(len(list_filter(l, lambda x: x IS NOT NULL)), 0), 3) AS INTEGER) AS useful, coalesce(array_to_string(list_filter(l, lambda x: x IS NOT NULL)[-3:], ','), '') AS history FROM p""")
def history_last3(spark: SparkSession, d: str) -> DataFrame:
    t = answer.with_history(table(spark, d, "turns"))
    return t.select("turn_id", F.size("history").alias("useful"), F.array_join(F.transform("history", lambda x: x["turn"].cast("string")), ",").alias("history"))


@query()
def follow_up_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = answer.with_history(table(spark, d, "turns")).where(F.size("history") > 0)
    return t.select("turn_id", answer.history_prompt("history", F.coalesce("question", F.lit(""))).alias("prompt"))


@query("""SELECT source, list_sort(list(latency_ms))[1 + CAST(round_even(0.5 * (count(latency_ms) - 1), 0) AS INTEGER)] AS p50, list_sort(list(latency_ms))[1 + CAST(round_even(0.95 * (count(latency_ms) - 1), 0) AS INTEGER)] AS p95
FROM (SELECT DISTINCT ON (answer_id) * FROM answers ORDER BY answer_id) WHERE latency_ms IS NOT NULL GROUP BY source""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_ranks(table(spark, d, "answers").dropDuplicates(["answer_id"]), "source", "latency_ms", {"p50": 50, "p95": 95})


@query(f"""WITH a AS (SELECT DISTINCT ON (answer_id) source, latency_ms / 1000 AS s FROM answers WHERE latency_ms IS NOT NULL ORDER BY answer_id), b AS (SELECT unnest({C.LATENCY_BUCKETS}::DOUBLE[]) AS le)
SELECT source, le, CAST(count_if(s <= le) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS count, round(sum(s), 6) AS sum FROM a, b GROUP BY source, le""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers").where(F.col("latency_ms").isNotNull()).dropDuplicates(["answer_id"]).select("source", (F.col("latency_ms") / 1000).alias("s"))
    return serving.latency_histogram(a, "s", "source")


@query("SELECT source, abstention, CAST(count(DISTINCT answer_id) AS BIGINT) AS n FROM answers GROUP BY ALL")
def counter_by_label(spark: SparkSession, d: str) -> DataFrame:
    return serving.counters(table(spark, d, "answers").dropDuplicates(["answer_id"]), "source", "abstention")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return serving.tumbling(table(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return serving.sessions(table(spark, d, "events"))


@query()
def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return serving.rate_limited(table(spark, d, "events").select("event_id", "user_id", "ts"))


@query()
def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", F.concat_ws("|", F.lit("6"), F.col("user_id").cast("string"), "event_type").alias("cache_key"))
    return serving.cache_outcomes(e, "cache_key")
