"""Problem 5: one form for texts that print alike.

DuckDB runs inside the Arrow partitions: embedded SQL with regular expressions (characters without ink), `replace`
(joined letters), `translate` (width and presentation forms, blanks, hyphens, look-alike letters) and `nfc_normalize`.

Defined cases: a null text has a null form and prints like nothing; an empty text is a text; a null file joins nothing;
repeated rows count once; letter case, accents, raised digits, punctuation, the number of blanks and line breaks stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side
from .forms import NO_INK, joined, single


def _class(chars: str) -> str:
    """A character class with every character but "-" written as \\x{..}."""
    return "[" + "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in chars) + "]"


#: Joined letters of the large Arabic presentation block: rare, so they are written out only in texts that hold any.
_RARE = "[\\x{fb07}-\\x{fdfb}\\x{fe70}-\\x{fe7f}]"
#: A text of these characters alone is already in its form.
_PLAIN = "[\\x00-\\x7f\\xa1-\\xac\\xae-\\x{2ff}\\x{60c}\\x{61b}\\x{61f}\\x{621}-\\x{64a}\\x{660}-\\x{669}«»’–—…]*"


#: (length of a piece, pieces in a window, least length of a quote's form) of each tier; a window and a piece fit into the least
#: length. Forms without a character have a tier of their own, the last.
TIERS = ((8, 32, 39), (8, 8, 15), (2, 1, 2), (1, 1, 1), (0, 1, 0))
#: So many pieces of a quote are looked up; the rarest one that occurs in its file meets the chunks.
MOST_PRINTS = 16


def tier_of(form: str) -> int:
    return next(i for i, (_, _, least) in enumerate(TIERS) if len(form) >= least)


def prints(form: str, tier: int) -> np.ndarray:
    """The least hash of a piece of each window of neighbouring pieces, each once. A text that contains another has all of
    its prints, whatever surrounds it."""
    k, w, _ = TIERS[tier]
    if not k:
        return np.zeros(1, np.int64)
    a = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(a) - k + 1
    if n < w:
        return np.zeros(0, np.int64)
    h = np.full(n, tier + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : j + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    step = 1
    while step < w:  # w is a power of two
        h, step = np.minimum(h[:-step], h[step:]), step * 2
    return np.unique(h).view(np.int64)


def _replaced(expr: str, letters: dict[str, str]) -> str:
    for a, b in letters.items():
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


@lru_cache(1)
def canonical_sql() -> tuple[str, str]:
    """The SQL expressions of x for its form, and for x with the rare joined letters written out."""
    common = {a: b for a, b in joined().items() if not ("\ufb07" <= a <= "\ufdfb" or "\ufe70" <= a <= "\ufe7f")}
    rare = {a: b for a, b in joined().items() if a not in common}
    e = _replaced(f"regexp_replace(x, '{_class(NO_INK)}', '', 'g')", common)
    e = f"nfc_normalize(translate({e}, '{''.join(single())}', '{''.join(single().values())}'))"
    return f"CASE WHEN regexp_full_match(x, '{_PLAIN}') THEN x ELSE {e} END", _replaced("x", rare)


def _connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB"})
    form, rare = canonical_sql()
    con.execute(f"CREATE MACRO print_form(x) AS ({form})")
    con.execute(f"CREATE MACRO spelled(x) AS (CASE WHEN regexp_matches(x, '{_RARE}') THEN {rare} ELSE x END)")
    return con


_con: duckdb.DuckDBPyConnection | None = None


def _db() -> duckdb.DuckDBPyConnection:
    global _con
    if _con is None:
        _con = _connect()
    return _con


def run_sql(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """`sql` over each Arrow batch of `df`, as the view `batch`, with the macros print_form and spelled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _db()
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            out = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            yield from out.to_batches()

    return df.mapInArrow(run, schema)


def canonical(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """`df` with the form of `text_col` in `out_col`."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return run_sql(df, f'SELECT {names}, print_form(spelled("{text_col}")) AS "{out_col}" FROM batch', f"{fields}, `{out_col}` string")


def canonical_forms(chunks: DataFrame, golden: DataFrame) -> DataFrame:
    """(column, id, form): the consistent form of chunks.text, golden.question and golden.evidence.quote; `id` of the row."""
    parts = [chunks.select(F.lit("chunks.text").alias("column"), "id", "text")]
    parts += [golden.select(F.lit(f"golden.{c}").alias("column"), "id", F.col(c).alias("text")) for c in ("question", "evidence.quote")]
    return canonical(parts[0].unionByName(parts[1]).unionByName(parts[2]), "text", "form").select("column", "id", "form").distinct()


def _printed(df: DataFrame, sql: str, schema: str, wanted: str, most: int | None = None) -> DataFrame:
    """run_sql with `prints` of the column `whole`, which is dropped, for the tiers in the bits of `wanted`; without it (null)
    for the tier of the form itself, at most `most`, and with that `tier`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _db()
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            out = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            cells, offsets, tiers = [], [0], []
            for form, bits in zip(out["whole"].to_pylist(), out[wanted].to_pylist(), strict=True):
                tiers.append(tier_of(form))
                which = [tiers[-1]] if bits is None else [t for t in range(len(TIERS)) if bits >> t & 1]
                cells += [prints(form, t)[:most] for t in which]
                offsets.append(offsets[-1] + sum(map(len, cells[len(cells) - len(which) :])) if which else offsets[-1])
            flat = pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64))
            out = out.drop_columns(["whole", wanted]).append_column("tier", pa.array(tiers, pa.int32()))
            yield from out.append_column("prints", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)).to_batches()

    return df.mapInArrow(run, f"{schema}, tier int, prints array<bigint>")


def quote_pairs(seen: DataFrame, quotes: DataFrame) -> DataFrame:
    """(rid, qid): chunks and quotes of one file that can match, found by the rarest print of each quote. `seen`: rid, file,
    prints; `quotes`: qid, file, prints; written tables. No file's quotes or chunks are gathered."""
    key = F.xxhash64("file", "print")
    asked = materialize(quotes.select("qid", "file", F.explode("prints").alias("print")).select("qid", key.alias("key")), "quote-prints")
    had = seen.select("rid", "file", F.explode("prints").alias("print")).select("rid", key.alias("key"))
    hits = materialize(had.join(small_side(materialize(asked.select("key").distinct(), "quote-keys")), "key", "left_semi").distinct(), "quote-hits")
    rate = hits.groupBy("key").agg(F.count("*").alias("n"))
    rarest = asked.join(rate, "key").groupBy("qid").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    return hits.join(small_side(materialize(rarest, "quote-rarest")), "key").select("rid", "qid")


def print_alike_pairs(chunks: DataFrame, golden: DataFrame) -> DataFrame:
    """(kind, key_a, key_b) as TESTDATA.md defines p5_found."""
    q = golden.select("id", "question", F.col("evidence.file").alias("file"), F.col("evidence.quote").alias("quote"))
    named = q.where(F.col("quote").isNotNull() & (F.col("quote") != "") & F.col("file").isNotNull()).select(F.xxhash64("file", "quote").alias("qid"), "id", "file", "quote")
    sql = "SELECT qid, file, quote, print_form(spelled(quote)) AS quote_form, print_form(spelled(quote)) AS whole, NULL::INTEGER AS wanted FROM batch"
    quotes = _printed(named.select("qid", "file", "quote").distinct(), sql, "qid bigint, file string, quote string, quote_form string", "wanted", MOST_PRINTS)
    quotes = materialize(quotes, "quotes")
    wanted = materialize(quotes.groupBy("file").agg(F.bit_or(F.expr("shiftleft(1, tier)")).alias("wanted")), "quote-tiers")
    text = chunks.where(F.col("text").isNotNull()).select(F.xxhash64("id", "file", "text").alias("rid"), "id", "file", "text")
    sql = """
        WITH t AS (SELECT rid, id, file, text, print_form(spelled(text)) AS whole, coalesce(wanted, 0) AS wanted FROM batch)
        SELECT rid, id, file, md5(whole) AS form, md5(text) AS stored, whole, wanted FROM t"""
    seen = _printed(text.join(small_side(wanted), "file", "left").select("rid", "id", "file", "text", "wanted"), sql, "rid bigint, id string, file string, form string, stored string", "wanted")
    seen = materialize(seen, "forms")
    asked = q.where(F.col("question").isNotNull()).select("id", F.col("question").alias("text"))
    asked = materialize(run_sql(asked, "SELECT id, md5(print_form(spelled(text))) AS form, md5(text) AS stored FROM batch", "id string, form string, stored string"), "question-forms")
    met = quote_pairs(seen, quotes).join(small_side(quotes.select("qid", F.col("file").alias("quote_file"), "quote", "quote_form")), "qid")
    met = small_side(materialize(met, "quote-met"))
    both = text.join(met, "rid").where((F.col("file") == F.col("quote_file")) & ~F.contains("text", "quote")).select("id", "text", "qid", "quote_form")
    hits = materialize(run_sql(both, "SELECT id, qid FROM batch WHERE contains(print_form(spelled(text)), quote_form)", "id string, qid bigint").distinct(), "quote-found")
    quote = named.select("qid", F.col("id").alias("b")).distinct().join(hits, "qid").select(F.lit("quote").alias("kind"), F.col("id").alias("a"), "b")
    pairs = _pairs(seen, "chunk").unionByName(_pairs(asked, "question")).unionByName(quote)
    return pairs.select("kind", F.when(F.col("kind") == "quote", F.col("a")).otherwise(F.least("a", "b")).alias("key_a"), F.when(F.col("kind") == "quote", F.col("b")).otherwise(F.greatest("a", "b")).alias("key_b")).distinct()


def _pairs(forms: DataFrame, kind: str) -> DataFrame:
    """Pairs of ids of one form that are stored differently. Forms stored in one way only, however often, drop out first;
    the ways of a form are paired before the ids, so that equally stored copies never meet."""
    f = forms.select("id", "form", "stored").distinct()
    many = f.groupBy("form").agg(F.min("stored").alias("x"), F.max("stored").alias("y")).where(F.col("x") != F.col("y")).select("form")
    f = materialize(f.join(many, "form", "left_semi"), "alike")
    ways = f.select("form", "stored").distinct()
    ways = ways.join(ways.withColumnRenamed("stored", "other"), "form").where(F.col("stored") < F.col("other"))
    g = f.select(F.col("id").alias("b"), "form", F.col("stored").alias("other"))
    return f.join(ways, ["form", "stored"]).join(g, ["form", "other"]).where(F.col("id") != F.col("b")).select(F.lit(kind).alias("kind"), F.col("id").alias("a"), "b")
