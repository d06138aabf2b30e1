"""The queries of the problems, as functions of (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import areas, bpe, budget, canon, language, lines, pack, scan, split, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = lines.recurring_lines(table(spark, d, "chunks"), rare=True)
    return found.select(F.col("rec").alias("chunk_id"), F.col("line_no").cast("int").alias("line_no"))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, text): each chunk without the lines of the site."""
    chunks = table(spark, d, "chunks")
    return lines.without_lines(chunks.select("id", "text"), lines.recurring_lines(chunks, rare=True)).select(F.col("id").alias("chunk_id"), "text").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return scan.scan_noise(chunks, *(table(spark, d, t) for t in ("doc_meta", "ocr_payload", "native_pages")), lines.recurring_lines(chunks))


def p2_repair(spark: SparkSession, d: str) -> DataFrame:
    return scan.repair_gain(*(table(spark, d, t) for t in ("chunks", "doc_meta", "ocr_payload", "native_pages")))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return scan.repaired_texts(chunks, *(table(spark, d, t) for t in ("doc_meta", "ocr_payload", "native_pages")), lines.recurring_lines(chunks))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    judged = truncation.truncated(truncation.values(table(spark, d, "answers"), table(spark, d, "turns")))
    return judged.where("cut").select("tbl", "row_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.truncated(truncation.values(table(spark, d, "answers"), table(spark, d, "turns"))))


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many records each kind of evidence decided."""
    cut = truncation.truncated(truncation.values(table(spark, d, "answers"), table(spark, d, "turns"))).where("cut")
    return cut.groupBy("tbl", "by").agg(F.count("*").alias("records"))


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    texts = budget.corpus_texts(table(spark, d, "chunks"), table(spark, d, "documents"))
    return budget.slices(budget.record_tokens(texts))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.print_alike_pairs(table(spark, d, "chunks"), table(spark, d, "golden"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical_forms(table(spark, d, "chunks"), table(spark, d, "golden"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    texts = language.labelled_texts(chunks, table(spark, d, "documents"))
    return language.found(chunks, table(spark, d, "doc_meta"), texts, lines.recurring_lines(chunks))


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    texts = language.labelled_texts(chunks, table(spark, d, "documents"))
    return language.languages(chunks, table(spark, d, "doc_meta"), texts, lines.recurring_lines(chunks))


def p6_stretches(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return language.stretches(chunks, language.labelled_text(language.labelled_texts(chunks, table(spark, d, "documents"))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = split.regulatory_items(table(spark, d, "chunks"), table(spark, d, "spans"))
    return split.split_oversized(items, with_text=False).where(F.col("piece") == 1).select("tbl", "item")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(split.regulatory_items(table(spark, d, "chunks"), table(spark, d, "spans")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(pack.token_sizes(table(spark, d, "documents")))


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return areas.document_areas(*(table(spark, d, t) for t in ("documents", "subject_areas", "subject_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "area").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the documents that have each area."""
    n = table(spark, d, "documents").agg(F.countDistinct("doc_id").alias("documents"))
    per = _areas(spark, d).groupBy("area").agg(F.countDistinct("doc_id").alias("having"))
    return per.crossJoin(F.broadcast(n)).select("area", "having", "documents", F.round(F.col("having") / F.col("documents"), 6).alias("share"))


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """labels, found, both: areas found with the labels of one half of the documents, compared with those of the other half."""
    labels = table(spark, d, "subject_labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = areas.document_areas(table(spark, d, "documents"), table(spark, d, "subject_areas"), labels.where(half))
    return areas.agreement(found, labels.where(~half))


QUERIES = {"p1_found": p1_found, "p1_cleaned": p1_cleaned, "p2_found": p2_found, "p2_repair": p2_repair, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_rates": p3_rates, "p3_evidence": p3_evidence, "p4_tokens": p4_tokens, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_languages": p6_languages, "p6_stretches": p6_stretches, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_shares": p10_shares, "p10_held_out": p10_held_out}


def _form_sql(x: str) -> str:
    """The canonical form of a column, rare joined letters included, as SQL over the whole column."""
    form, rare = canon.canonical_sql()
    return f"(SELECT {form} FROM (SELECT CASE WHEN regexp_matches({x}, '{canon._RARE}') THEN {rare.replace('replace(x,', f'replace({x},')} ELSE {x} END AS x))"


SQL: dict[str, str] = {
    "p5_found": f"""WITH c AS (SELECT id, file, text, {_form_sql('text')} AS form FROM (SELECT DISTINCT id, file, text FROM chunks WHERE text IS NOT NULL)),
      q AS (SELECT id, question AS text, {_form_sql('question')} AS form FROM (SELECT DISTINCT id, question FROM golden WHERE question IS NOT NULL)),
      e AS (SELECT id, file, quote, {_form_sql('quote')} AS form FROM (SELECT DISTINCT id, evidence.file AS file, evidence.quote AS quote FROM golden WHERE evidence.quote != ''))
      SELECT DISTINCT 'chunk' AS kind, a.id AS key_a, b.id AS key_b FROM c a JOIN c b USING (form) WHERE a.id < b.id AND a.text != b.text
      UNION ALL SELECT DISTINCT 'question', a.id, b.id FROM q a JOIN q b USING (form) WHERE a.id < b.id AND a.text != b.text
      UNION ALL SELECT DISTINCT 'quote', c.id, e.id FROM c JOIN e USING (file) WHERE contains(c.form, e.form) AND NOT contains(c.text, e.quote)""",
    "p7_found": """SELECT DISTINCT 'chunks' AS tbl, id AS item FROM chunks WHERE length(text) > 1200
      UNION ALL SELECT DISTINCT 'spans', CAST(span_id AS VARCHAR) FROM spans WHERE length(text) > 1200""",
}
