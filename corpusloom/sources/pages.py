"""Readers of page texts, sidecars, golden sets and listing pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCR = "engine string, language string, dpi int, pages array<struct<page int, text string>>"
EVIDENCE = "struct<file string, page int, quote string>"
GOLDEN = (
    "id string, question string, language string, answerable boolean, theme string, difficulty string, expected_issuer string, expected_reference string, expected_section string, "
    f"expected_facts array<string>, derived_facts array<string>, evidence {EVIDENCE}, extra_evidence array<{EVIDENCE}>, status string, notes string"
)
META = "title string, issuer string, reference string, published date, url string, language string, source_page string, sha256 string, fetched_at timestamp, text_source string, needs_review boolean, notes string"


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """All *.pdf below a folder: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(root)


def sidecar(path, suffix: str = ".yaml"):
    return F.regexp_replace(path, r"\.pdf$", suffix)


def acceptable_pdf(content, most: int = 50_000_000):
    """The bytes begin like a PDF and aren't too many."""
    return F.coalesce((F.substring(content, 1, 4) == F.lit(b"%PDF")) & (F.length(content) <= most), F.lit(False))


def ocr_pages(spark: SparkSession, root: str) -> DataFrame:
    """(file, page, text) of the *.ocr.json files below a folder."""
    j = spark.read.schema(OCR).option("multiLine", True).option("pathGlobFilter", "*.ocr.json").option("recursiveFileLookup", True).json(root)
    return exploded(j.withColumn("file", F.regexp_replace(F.input_file_name(), r"\.ocr\.json$", ".pdf")))


def exploded(payload: DataFrame) -> DataFrame:
    return payload.select("file", F.explode("pages").alias("p")).select("file", F.col("p.page").alias("page"), F.col("p.text").alias("text")).dropDuplicates(["file", "page"])


def native_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(file, page, text) of PDFs by a given extractor; a file that can't be read has no pages."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, i + 1, t) for i, t in enumerate(extract(content))]
                except Exception:  # noqa: S112 - one broken file doesn't stop the scan
                    continue
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "file string, page int, text string")


def page_texts(ocr: DataFrame, native: DataFrame) -> DataFrame:
    """(file, page, text): the scanned reading where a file has one, else its own text."""
    own = native.dropDuplicates(["file", "page"]).join(ocr.select("file").distinct(), "file", "left_anti")
    return ocr.select("file", "page", "text").unionByName(own.select("file", "page", "text"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines golden set; blank lines are skipped."""
    return spark.read.schema(GOLDEN).json(path).where(F.col("id").isNotNull())


def write_golden(df: DataFrame, path: str) -> None:
    """JSON lines without nulls and empty lists."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    df.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in lists}).write.option("ignoreNullFields", True).json(path)


def guard_cases(cases: DataFrame, golden_set: DataFrame) -> DataFrame:
    """(id, question, language, expected): the cases, and the golden questions as ok."""
    g = golden_set.dropDuplicates(["id"]).select("id", "question", "language", F.lit("ok").alias("expected"))
    return cases.select("id", "question", "language", "expected").unionByName(g)


def yaml_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(file, fields map<string,string>) of flat key: value sidecars below a folder; a null value is absent."""
    t = spark.read.option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", True).text(root, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda s: s.rlike(r"^[A-Za-z_0-9]+\s*:"))
    clean = lambda v: F.regexp_replace(F.trim(v), r"^(['\"])(.*)\1$", "$2")
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), clean(F.regexp_replace(s, r"^[^:]*:", "")).alias("value")))
    kept = F.filter(pairs, lambda p: ~p["value"].isin("null", "~", ""))
    return t.select(F.regexp_replace(F.input_file_name(), r"\.yaml$", ".pdf").alias("file"), F.map_from_entries(kept).alias("fields"))


class _Listing(HTMLParser):
    """Links of a listing page with the title of their row, and the link to the next page."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[list[str]] = []
        self.next: str | None = None
        self.row = ""
        self.depth = 0
        self.open: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "div" and (self.depth or "views-field-title" in (a.get("class") or "")):
            self.depth += 1
            self.row = "" if self.depth == 1 else self.row
        elif tag == "a" and a.get("href"):
            if "next" in (a.get("rel") or ""):
                self.next = a["href"]
            self.open = [a["href"] or "", "", ""]

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.row += data
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "div" and self.depth:
            self.depth -= 1
        elif tag == "a" and self.open:
            self.links.append([self.open[0], self.open[1], self.row])
            self.open = None
        elif tag == "li":
            self.row = ""


def listing_links(pages: DataFrame) -> DataFrame:
    """(page_url, position, url, title, next_url) of the PDF links of listing pages (url, html): the first of each URL;
    the title is the row's, else the link's, else the file's name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["url"], b["html"], strict=True):
                p = _Listing()
                p.feed(html or "")
                seen: set[str] = set()
                nxt = urljoin(page, p.next) if p.next else None
                for href, text, row in p.links:
                    url = urljoin(page, href)
                    path = urlsplit(url).path
                    if path.lower().endswith(".pdf") and url not in seen:
                        seen.add(url)
                        name = unquote(path.rsplit("/", 1)[-1])[:-4]
                        rows.append((page, len(seen) - 1, url, " ".join(row.split()) or " ".join(text.split()) or name, nxt))
            yield pd.DataFrame(rows, columns=["page_url", "position", "url", "title", "next_url"])

    return pages.select("url", "html").mapInPandas(run, "page_url string, position int, url string, title string, next_url string")
