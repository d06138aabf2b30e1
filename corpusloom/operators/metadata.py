"""Document metadata: candidates, selections, overrides, manifests and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(meta: DataFrame, key: str = "file", at: str = "fetched_at") -> DataFrame:
    """One row per key, the last fetched."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*meta.columns))
    return meta.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_candidates(candidates: DataFrame, issuer: str | None = None, match: str | None = None, urls: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Candidates by issuer, by a pattern in the title (any case), by a list of URLs; the first `limit` by position."""
    c = candidates
    if issuer:
        c = c.where(F.col("issuer") == issuer.upper())
    if match:
        c = c.where(F.col("title").rlike("(?iu)" + match))
    if urls is not None:
        c = c.join(urls.select("url").distinct(), "url", "left_semi")
    return c.orderBy("position").limit(limit) if limit is not None else c


def missing_urls(selected: DataFrame, found: DataFrame) -> DataFrame:
    return selected.select("url").distinct().join(found.select("url"), "url", "left_anti")


def is_pdf(url):
    """The path of a URL ends with .pdf, in any case."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^?#]*", 0)).rlike(r"\.pdf$"), F.lit(False))


def override(meta: DataFrame, overrides: DataFrame, key: str = "file") -> DataFrame:
    """`meta` with the fields that an override sets, even to null. `overrides`: key, fields (array of the names set) and
    the values; needs_review follows from the result."""
    names = [c for c in overrides.columns if c not in (key, "fields")]
    o = overrides.select(key, "fields", *[F.col(c).alias(f"_{c}") for c in names])
    j = meta.join(o, key, "left")
    out = j.select(*[F.when(F.array_contains("fields", c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in meta.columns])
    return out.withColumn("needs_review", F.col("reference").isNull() | F.col("published").isNull()) if "needs_review" in meta.columns else out


def manifest(meta: DataFrame) -> DataFrame:
    """All metadata but the time of fetching, one row per file."""
    return latest(meta).drop("fetched_at")


def document_stats(pages: DataFrame) -> DataFrame:
    """(file, pages, words)."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return pages.dropDuplicates(["file", "page"]).groupBy("file").agg(F.count("*").alias("pages"), F.sum(words).alias("words"))


def corpus_rollup(meta: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents, pages, words and scanned share per issuer and in all (rollup)."""
    j = latest(meta).join(stats, "file").select("issuer", "pages", "words", F.when(F.col("text_source") == "ocr", 1).otherwise(0).alias("s"))
    out = j.rollup("issuer").agg(F.grouping("issuer").alias("is_total"), F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("words").alias("words"), F.sum("s").alias("scanned"), F.round(F.avg("s"), 6).alias("scanned_share"))
    return out


def period_histogram(meta: DataFrame) -> DataFrame:
    """Documents per five years of publication."""
    return latest(meta).where(F.col("published").isNotNull()).groupBy((F.floor(F.year("published") / 5) * 5).cast("int").alias("period")).agg(F.count("*").alias("documents"))


def needs_ocr(pages: DataFrame, least: float = 100.0) -> DataFrame:
    """(file, needs_ocr): little text per page on average while some page holds an image or many shapes. `pages`: file,
    text, images, shapes."""
    return pages.groupBy("file").agg(((F.avg(F.length(F.trim(F.coalesce("text", F.lit(""))))) < least) & F.bool_or((F.col("images") > 0) | (F.col("shapes") >= 50))).alias("needs_ocr"))
