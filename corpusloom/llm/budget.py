"""Problem 4: how many tokens each slice of the corpus holds under a public tokenizer.

Texts beyond `limit` characters are cut where the tokenizer's word pattern has a border whatever surrounds it (before a
blank between two letters: a run of letters ends there and ` ?\\p{L}+` starts there), and the parts are spread over the
workers by a salt; exact counts of the parts are summed per record, then rolled up.

Defined cases: null and empty texts have 0 tokens and count as records; repeated rows of a key count once; a null
source, language or host is its own slice; a text without such a border stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path

#: Characters from which a text is divided.
LIMIT = 16_000
_border = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def independent_parts(text: str, limit: int = LIMIT) -> list[str]:
    """The text cut at the last border before each multiple of `limit`; the parts join to the text again."""
    out, start = [], 0
    while len(text) - start > limit:
        stop = start + limit
        while stop > start and not _border.match(text, stop):
            stop -= 1
        if stop == start:  # no border within the limit: the next one after it
            m = _border.search(text, start + limit)
            if not m:
                break
            stop = m.start()
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]]


def _count(df: DataFrame, path: str) -> DataFrame:
    """Replaces the last column, a text, by its number of tokens."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = encoder(path).counts(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*names[:-1], "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{fields}, tokens bigint")


def record_tokens(texts: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(tbl, key, source, language, host, tokens) per record. `texts`: tbl, key, source, language, host, text."""
    path = tokenizer or tokenizer_path()
    cols = ["tbl", "key", "source", "language", "host"]
    t = texts.select(*cols, F.coalesce("text", F.lit("")).alias("text"))
    whole = _count(t.where(F.length("text") <= limit).select(*cols, F.lit(0).alias("part"), "text"), path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [independent_parts(x, limit) for x in b.column(5).to_pylist()]
            rows = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int32())
            taken = [c.take(rows) for c in b.columns[:5]]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array([k for p in parts for k in range(len(p))], pa.int32()), pa.array([x for p in parts for x in p], pa.string())], [*cols, "part", "text"]
            )

    fields = ", ".join(f"{c} string" for c in cols)
    parts = t.where(F.length("text") > limit).mapInArrow(cut, f"{fields}, part int, text string")
    salted = parts.repartition(F.xxhash64("tbl", "key", "part"))
    per_part = whole.unionByName(_count(salted, path)).dropDuplicates(["tbl", "key", "part"])
    return per_part.groupBy("tbl", "key").agg(*[F.min(c).alias(c) for c in cols[2:]], F.sum("tokens").alias("tokens"))


def language_code(label: Column) -> Column:
    """A label in any usual code, tag or name as a two-letter code; placeholders and unknown labels as null."""
    first = F.regexp_extract(F.lower(F.trim(label)), "^([^-_ ]+)", 1)
    out = None
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(first.isin(*names), code) if out is None else out.when(first.isin(*names), code)
    return out


#: Usual codes and names of the languages of the corpus.
LANGUAGE_NAMES = {
    "fr": ["fr", "fra", "fre", "français", "francais", "french", "französisch", "francés", "frances", "الفرنسية", "فرنسي", "فرنسية"],
    "ar": ["ar", "ara", "arabic", "arabe", "العربية", "عربي", "عربية", "árabe", "ary"],
    "en": ["en", "eng", "english", "anglais", "inglés", "ingles", "الإنجليزية", "إنجليزية"],
    "es": ["es", "spa", "esp", "spanish", "espagnol", "español", "espanol", "castellano", "الإسبانية", "إسبانية"],
}


def corpus_texts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts of both tables with their slices; a stored placeholder for the language is null here."""
    def of(df: DataFrame, tbl: str, key: str, source: str, language: str) -> DataFrame:
        return df.select(
            F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("key"), F.col(source).alias("source"),
            language_code(F.col(language)).alias("language"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "text",
        ).withColumn("host", F.expr("nullif(host, '')"))

    return of(chunks, "chunks", "id", "issuer", "language").unionByName(of(documents, "documents", "doc_id", "source", "lang"))


def slices(records: DataFrame) -> DataFrame:
    """Totals per table by source, by language, by host, and by all three: (tbl, slice, source, language, host, records,
    tokens)."""
    g = F.grouping_id()
    out = records.groupingSets(
        [[F.col("tbl"), F.col("source")], [F.col("tbl"), F.col("language")], [F.col("tbl"), F.col("host")], [F.col("tbl"), F.col("source"), F.col("language"), F.col("host")]],
        "tbl", "source", "language", "host",
    ).agg(g.alias("g"), F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    name = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "language").when(F.col("g") == 6, "host").otherwise("source,language,host")
    return out.select("tbl", name.alias("slice"), "source", "language", "host", "records", "tokens")
