"""Retrieval, answer, guardrail and text-accuracy metrics as aggregates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PASSAGE = 0.5


def hit_rate(rank: Column, k: int) -> Column:
    """Share of ranks up to k; null is a miss; 0 for no rows."""
    return F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mrr(rank: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0)), F.lit(0.0))


#: Groups of up to this many rows are ranked as they are; of larger ones only the rows around the percentile are.
RANKED_WHOLE = 10_000
AROUND = 0.0005


def nearest_ranks(rows: DataFrame, by: str, value: str, named: dict[str, float]) -> DataFrame:
    """(by, one column per name): the value at index round-half-even(q/100 * (n-1)) of each group's sorted values, exact.

    An approximate percentile on either side brackets the place; values below are counted, and only values within the
    bracket are ranked, so no group is sorted whole in one task. Nulls are left out; a group of nulls gives no row."""
    v = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    out = None
    for name, q in named.items():
        low, high = max(0.0, q / 100 - AROUND), min(1.0, q / 100 + AROUND)
        g = v.groupBy("_by").agg(F.count("*").alias("n"), F.percentile_approx("_v", [low, high], 10_000).alias("at"))
        g = g.select(F.col("_by").alias("_g"), F.bround(F.lit(q / 100) * (F.col("n") - 1), 0).cast("bigint").alias("index"), F.when(F.col("n") > RANKED_WHOLE, F.col("at")).alias("at"))
        j = v.join(g, v["_by"].eqNullSafe(g["_g"])).drop("_g")
        below = j.where(F.col("_v") < F.col("at")[0]).groupBy(F.col("_by").alias("_g")).agg(F.count("*").alias("below"))
        inside = j.where(F.col("at").isNull() | F.col("_v").between(F.col("at")[0], F.col("at")[1]))
        place = F.row_number().over(Window.partitionBy("_by").orderBy("_v")) - 1
        r = inside.withColumn("place", place).join(below, inside["_by"].eqNullSafe(below["_g"]), "left").where(F.col("place") + F.coalesce("below", F.lit(0)) == F.col("index"))
        r = r.select("_by", F.col("_v").alias(name))
        out = r if out is None else out.withColumnRenamed("_by", "_o").join(r, F.col("_o").eqNullSafe(F.col("_by"))).drop("_o")
    return out.select(F.col("_by").alias(by), *named)


def all_evidence(golden: DataFrame) -> DataFrame:
    """(id, file, page, quote): the evidence of each item, main and extra."""
    ev = F.array_compact(F.concat(F.array("evidence"), F.coalesce("extra_evidence", F.array().cast(golden.schema["extra_evidence"].dataType))))
    return golden.dropDuplicates(["id"]).select("id", F.explode(ev).alias("e")).select("id", "e.file", "e.page", "e.quote")


def consistency_errors(golden: DataFrame) -> DataFrame:
    """(id, error): items that break the rules: evidence if and only if answerable; no facts without an answer; derived
    facts need notes."""
    g = golden.dropDuplicates(["id"])
    has = F.col("evidence").isNotNull()
    facts = (F.size(F.coalesce("expected_facts", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("derived_facts", F.array().cast("array<string>"))) > 0)
    error = F.when(F.col("answerable") & ~has, "answerable without evidence").when(~F.col("answerable") & (has | facts), "unanswerable with evidence or facts").when(
        (F.size(F.coalesce("derived_facts", F.array().cast("array<string>"))) > 0) & F.col("notes").isNull(), "derived facts without notes")
    return g.select("id", error.alias("error")).where(F.col("error").isNotNull())


def retrieval_ranks(golden: DataFrame, hits: DataFrame, chunks: DataFrame, passage: float = PASSAGE) -> DataFrame:
    """(id, difficulty, language, theme, passage_rank, doc_rank, section_rank) of the eligible items among `hits`
    (query_id, chunk_id, rank)."""
    g = golden.dropDuplicates(["id"]).where(F.col("answerable") & F.col("evidence").isNotNull() & ~F.col("status").eqNullSafe("rejected"))
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("file").alias("cfile"), "text", F.col("section").alias("csection")).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    ev = all_evidence(golden).join(hits.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    j = hits.select(F.col("query_id").alias("id"), "chunk_id", "rank").join(c, "chunk_id").join(ev, "id").join(g.select("id", "expected_section"), "id")
    same = F.col("cfile") == F.col("file")
    wanted = T.article_ids("expected_section")
    per = j.groupBy("id").agg(
        F.min(F.when(same & (T.quote_coverage("quote", "text") >= passage), F.col("rank"))).alias("passage_rank"),
        F.min(F.when(same, F.col("rank"))).alias("doc_rank"),
        F.min(F.when(same & F.arrays_overlap(wanted, T.article_ids("csection")), F.col("rank"))).alias("section_rank"),
    )
    asked = hits.select(F.col("query_id").alias("id")).distinct()
    return g.join(asked, "id", "left_semi").select("id", "difficulty", "language", "theme").join(per, "id", "left")


def retrieval_summary(ranks: DataFrame, k: int = 6) -> DataFrame:
    """The metrics over all items and per difficulty, language and theme, in one pass (grouping sets)."""
    p, d, s = F.col("passage_rank"), F.col("doc_rank"), F.col("section_rank")
    r = lambda c: F.round(c, 6)
    out = ranks.groupingSets([[], [F.col("difficulty")], [F.col("language")], [F.col("theme")]], "difficulty", "language", "theme").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), r(hit_rate(p, 1)).alias("hit_1"), r(hit_rate(p, 3)).alias("hit_3"), r(hit_rate(p, k)).alias("hit_k"),
        r(mrr(p, k)).alias("mrr_k"), r(hit_rate(d, k)).alias("doc_hit_k"), r(hit_rate(s, k)).alias("section_hit_k"),
    )
    slice_ = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "difficulty").when(F.col("g") == 5, "language").otherwise("theme")
    return out.select(slice_.alias("slice"), F.coalesce("difficulty", "language", "theme").alias("value"), "n", "hit_1", "hit_3", "hit_k", "mrr_k", "doc_hit_k", "section_hit_k")


def guard_accuracy(cases: DataFrame) -> DataFrame:
    """(expected, n, right, accuracy) of cases (expected, verdict); a null verdict is wrong, a null class is a class."""
    right = F.coalesce(F.count_if(F.col("verdict") == F.col("expected")), F.lit(0))
    return cases.groupBy("expected").agg(F.count("*").alias("n"), right.alias("right")).withColumn("accuracy", F.round(F.col("right") / F.col("n"), 6))


def guard_mismatches(cases: DataFrame) -> DataFrame:
    """The cases whose verdict isn't the expected one."""
    return cases.where(~F.col("verdict").eqNullSafe(F.col("expected")))


def fact_scores(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """(answer_id, facts_found, facts_total, numbers_found, numbers_total) of each answer against its item's facts."""
    g = golden.dropDuplicates(["id"]).select("id", F.explode("expected_facts").alias("fact")).withColumn("ff", T.fact_form("fact"))
    a = answers.dropDuplicates(["answer_id"]).select("answer_id", "id", T.fact_form(F.coalesce("answer", F.lit(""))).alias("af"))
    j = a.join(g, "id")
    wanted = T.form_numbers(F.col("ff"))
    numeric = F.size(wanted) > 0
    found = numeric & (F.size(F.array_except(wanted, T.form_numbers(F.col("af")))) == 0)
    return j.groupBy("answer_id").agg(F.count_if(T.form_found(F.col("ff"), F.col("af"))).alias("facts_found"), F.count("*").alias("facts_total"), F.count_if(found).alias("numbers_found"), F.count_if(numeric).alias("numbers_total"))


def answer_summary(answers: DataFrame, by: str) -> DataFrame:
    """Answer metrics per group, each over its own denominator; the latency excludes abstentions by score; an empty
    denominator gives null."""
    a = answers.dropDuplicates(["answer_id"])
    ok, out = F.col("answerable"), ~F.col("answerable")
    abst = F.col("abstention") != "none"
    done = ok & ~abst
    share = lambda cond, of: F.round(F.avg(F.when(of, F.when(cond, 1.0).otherwise(0.0))), 6)
    ratio = lambda x, y: F.round(F.sum(F.when(ok, F.col(x))) / F.greatest(F.sum(F.when(ok, F.col(y))), F.lit(1)), 6)
    judged = F.col("faithfulness").isNotNull()
    cols = [
        F.count("*").alias("n"), ratio("facts_found", "facts_total").alias("fact_recall"), ratio("numeric_found", "numeric_total").alias("numeric_recall"),
        share(F.col("cites_document"), done).alias("cites_document"), share(F.col("cites_article"), done).alias("cites_article"),
        F.round(F.avg(F.when(done, F.col("citation_coverage"))), 6).alias("citation_coverage"), share(abst, ok).alias("false_abstention"), share(abst, out).alias("abstention_accuracy"),
        F.round(F.avg(F.when(judged, F.col("faithfulness"))), 6).alias("faithfulness"), share(F.col("faithfulness") >= 1, judged).alias("fully_faithful"),
        F.round(F.avg(F.when(judged, F.col("correctness"))), 6).alias("correctness"), F.round(F.avg(F.when(judged, F.col("relevance").cast("double"))), 6).alias("relevance"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    ]
    late = nearest_ranks(a.where("abstention != 'score'"), by, "latency_ms", {"latency_p50": 50, "latency_p95": 95}).withColumnRenamed(by, "_late")
    out = a.groupBy(by).agg(*cols)
    return out.join(late, out[by].eqNullSafe(late["_late"]), "left").drop("_late")


def page_accuracy(reference: DataFrame, scanned: DataFrame) -> DataFrame:
    """(file, page, char_edits, chars, word_edits, words, bag_f1, numbers_found, numbers). Inputs: file, page, text."""
    r = reference.dropDuplicates(["file", "page"]).select("file", "page", F.col("text").alias("rt")).where(F.trim("rt") != "")
    s = scanned.dropDuplicates(["file", "page"]).select("file", "page", F.col("text").alias("st"))
    j = r.join(s, ["file", "page"], "left").select("file", "page", "rt", F.coalesce("st", F.lit("")).alias("st"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    numbers = lambda c: T.number_tokens(T.strip_page_number(c, "page"))
    # a generator works out its columns once per row; a projection would repeat them in every expression that names them
    once = F.struct(T.normalize("rt").alias("r"), T.normalize("st").alias("s"), numbers("rt").alias("rnum"), numbers("st").alias("snum"))
    j = j.select("file", "page", F.inline(F.array(once))).select("file", "page", "r", "s", words(F.col("r")).alias("rw"), words(F.col("s")).alias("sw"), "rnum", "snum")
    kinds = {f.name: f.dataType.simpleString() for f in j.schema.fields[:2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rw, sw, rn, sn = (b.column(k).to_pylist() for k in range(4, 8))
            common = [(Counter(x) & Counter(y)).total() for x, y in zip(rw, sw, strict=True)]
            f1 = [round(2.0 * c / (len(x) + len(y)), 6) if c else 0.0 for c, x, y in zip(common, rw, sw, strict=True)]
            found = [(Counter(x) & Counter(y)).total() for x, y in zip(rn, sn, strict=True)]
            edits = [word_edits(x, y) for x, y in zip(rw, sw, strict=True)]
            cols = [b.column(k) for k in range(4)] + [pa.array(edits, pa.int32()), pa.array(list(map(len, rw)), pa.int32()), pa.array(f1, pa.float64()), pa.array(found, pa.int32()), pa.array(list(map(len, rn)), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["file", "page", "r", "s", "word_edits", "words", "bag_f1", "numbers_found", "numbers"])

    out = j.mapInArrow(run, f"file {kinds['file']}, page {kinds['page']}, r string, s string, word_edits int, words int, bag_f1 double, numbers_found int, numbers int")
    return out.select("file", "page", F.levenshtein("r", "s").alias("char_edits"), F.length("r").alias("chars"), "word_edits", "words", "bag_f1", "numbers_found", "numbers")


def word_edits(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists, a row of the table at a time: what a row takes from its left neighbour is a running minimum."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (a, b))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, w in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.append(i, best) - steps) + steps
    return int(row[-1])


def file_accuracy(pages: DataFrame) -> DataFrame:
    return pages.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("char_edits", "chars", "word_edits", "words", "numbers_found", "numbers")], F.count("*").alias("pages"), F.round(F.avg("bag_f1"), 6).alias("bag_f1"))


def accuracy_totals(bench: DataFrame, language: str | None = "fr") -> DataFrame:
    """One row of totals: error rates over sums, the mean of the files' F1."""
    b = bench.dropDuplicates(["file"])
    b = b.where(F.col("language") == language) if language else b
    ratio = lambda x, y: F.round(F.sum(x) / F.greatest(F.sum(y), F.lit(1)), 6)
    return b.agg(F.count("*").alias("files"), F.sum("pages").alias("pages"), ratio("char_edits", "chars").alias("cer"), ratio("word_edits", "words").alias("wer"), ratio("numbers_found", "numbers").alias("number_recall"), F.round(F.avg("bag_f1"), 6).alias("bag_f1"))


def confusion(rows: DataFrame, expected: str, got: str, values: list[str]) -> DataFrame:
    """Counts per expected value, one column per verdict."""
    return rows.groupBy(expected).pivot(got, values).agg(F.count(F.lit(1))).na.fill(0)


def quotes_on_pages(golden: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, file, page, status, found_page) of each piece of evidence: ok, missing file (no pages of it are known),
    missing page, or not on page, with the first page of the file that does hold the quote."""
    ev = all_evidence(golden).where(F.col("quote").isNotNull())
    p = pages.dropDuplicates(["file", "page"]).select("file", F.col("page").alias("ppage"), T.compact("text").alias("ptext"))
    j = ev.join(p, "file", "left").withColumn("holds", F.contains("ptext", T.compact("quote")))
    a = j.groupBy("id", "file", "page", "quote").agg(F.count("ppage").alias("pages"), F.bool_or(F.col("ppage") == F.col("page")).alias("there"), F.bool_or((F.col("ppage") == F.col("page")) & F.col("holds")).alias("ok"), F.min(F.when(F.col("holds"), F.col("ppage"))).alias("found_page"))
    return a.select("id", "file", "page", F.when(F.col("ok"), "ok").when(F.col("pages") == 0, "missing file").when(~F.coalesce("there", F.lit(False)), "missing page").otherwise("not on page").alias("status"), "found_page")
