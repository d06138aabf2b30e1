"""From questions and hits to answers: guardrails, abstention, prompts, citations, outputs. A batch of questions is a
DataFrame; blocked and unsupported questions leave before any model is called."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.vectors import hash_matrix

MIN_SCORE = 0.35
HISTORY_TURNS = 3
HISTORY_CHARS = 500
NOT_FOUND = "NOT_FOUND"


def scope_scores(questions: DataFrame) -> DataFrame:
    """(query_id, inside, outside): the highest cosine to a phrase of each side (36 fixed phrases). `questions`:
    query_id, question; a null question scores 0."""
    sides = (hash_matrix(C.IN_SCOPE), hash_matrix(C.OUT_OF_SCOPE))

    @F.pandas_udf("inside double, outside double")
    def score(s: pd.Series) -> pd.DataFrame:
        def unit(m):
            n = np.sqrt((m * m).sum(1, keepdims=True))
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        q = unit(hash_matrix(list(s)))
        inside, outside = ((q @ unit(x).T).max(1).round(9) for x in sides)
        return pd.DataFrame({"inside": inside, "outside": outside})

    return questions.dropDuplicates(["query_id"]).withColumn("s", score(F.coalesce(T.sanitize("question"), F.lit("")))).select("query_id", "s.inside", "s.outside")


def guarded(questions: DataFrame, with_scope: bool = False, margin: float = 0.0) -> DataFrame:
    """`questions` with clean, lang and verdict."""
    q = questions.withColumn("clean", T.sanitize(F.coalesce("question", F.lit(""))))
    scope = None
    if with_scope:
        q = q.join(scope_scores(questions), "query_id")
        scope = F.col("outside") <= F.col("inside") + margin
    return q.withColumns({"lang": T.detect_language("clean"), "verdict": T.guard_verdict("clean", scope)})


def with_history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn_no", keep: int = HISTORY_TURNS) -> DataFrame:
    """Each turn with its last `keep` earlier turns as an array of (question, answer, turn), oldest first; turns without
    an answer are no history. Repeated turns count once.

    A turn with an answer knows the ones before it (lags among its like), and each turn takes over the array of the last
    one before it: running windows of constant state, whatever the length of a conversation."""
    t = turns.dropDuplicates([conversation, turn])
    useful = F.length(F.trim(F.coalesce("answer", F.lit("")))) > 0
    own = F.struct("question", "answer", F.col(turn).alias("turn"))
    like = Window.partitionBy(conversation, "_useful").orderBy(turn)
    upto = F.array_compact(F.array(*[F.lag(own, k).over(like) for k in range(keep - 1, 0, -1)], own))
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_useful", useful).withColumn("_upto", F.when(F.col("_useful"), upto))
    none = F.array().cast(t.schema["_upto"].dataType)
    return t.withColumn("history", F.coalesce(F.last("_upto", ignorenulls=True).over(before), none)).drop("_useful", "_upto")


def supported(hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, supported): whether the best hit reaches the floor, compared with the first-stage score if reranked."""
    s = F.coalesce("first_stage_score", "score") if "first_stage_score" in hits.columns else F.col("score")
    return hits.groupBy("query_id").agg((F.max(F.when(F.col("rank") == 1, s)) >= min_score).alias("supported"))


def escape(x: Column | str) -> Column:
    y = F.col(x) if isinstance(x, str) else x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        y = F.replace(y, F.lit(a), F.lit(b))
    return y


def source_block(number: Column, issuer: Column, reference: Column, title: Column, first: Column, last: Column, text: Column) -> Column:
    """One numbered source of a prompt."""
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    attr = lambda name, v: F.concat(F.lit(f' {name}="'), escape(F.coalesce(v, F.lit(""))), F.lit('"'))
    return F.concat(F.lit("<source"), attr("n", number.cast("string")), attr("issuer", issuer), attr("reference", reference), attr("title", title), attr("pages", pages), F.lit(">\n"), escape(text), F.lit("\n</source>"))


def prompts(hits: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, sources, prompt): the hits of each question as numbered sources, and the question."""
    c = chunks.join(hits.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    j = hits.join(c.withColumnRenamed("id", "chunk_id"), "chunk_id")
    block = source_block(F.col("rank"), F.col("issuer"), F.col("reference"), F.col("title"), F.col("page_start"), F.col("page_end"), F.coalesce("text", F.lit("")))
    packed = j.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["b"]), "\n\n")
    return packed.join(questions, "query_id").select("query_id", F.size("s").alias("sources"), F.concat(body, F.lit("\n\n"), F.col("question")).alias("prompt"))


def history_prompt(history: Column | str, question: Column | str) -> Column:
    """Earlier turns (answers without citations, cut) and the follow-up, for rewriting it as a question of its own."""
    h = F.col(history) if isinstance(history, str) else history
    q = F.col(question) if isinstance(question, str) else question
    plain = lambda a: F.substring(F.trim(F.regexp_replace(a, r"\[\d+\]", "")), 1, HISTORY_CHARS)
    lines = F.transform(h, lambda t: F.concat(F.lit("Q: "), escape(F.coalesce(t["question"], F.lit(""))), F.lit("\nA: "), escape(plain(t["answer"]))))
    return F.concat_ws("\n\n", F.array_join(lines, "\n\n"), F.concat(F.lit("Follow-up: "), escape(q)))


def rewritten(raw: Column | str, question: Column | str) -> Column:
    """The first inked line of a rewrite without quotes; the question itself if that is empty or too long."""
    r = F.col(raw) if isinstance(raw, str) else raw
    q = F.col(question) if isinstance(question, str) else question
    lines = F.filter(F.split(F.coalesce(r, F.lit("")), "\n"), lambda s: F.trim(s) != "")
    first = F.regexp_replace(F.trim(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))), "^[\"'«» ]+|[\"'«» ]+$", "")
    return F.when((first == "") | (F.length(first) > C.MAX_QUESTION_CHARS), q).otherwise(first)


def finished(raw: DataFrame, fallback: Column) -> DataFrame:
    """`raw` (query_id, sources, text) with the final answer, its citation numbers and abstention: a signal anywhere means
    not found; else invalid citations are removed."""
    signal = F.contains(F.upper("text"), F.lit(NOT_FOUND))
    return raw.withColumns({
        "answer": F.when(signal, fallback).otherwise(T.keep_valid_citations("text", "sources")),
        "cited": F.when(signal, F.array().cast("array<int>")).otherwise(T.cited_numbers("text", "sources")),
        "abstention": F.when(signal, "signal").otherwise("none"),
    })


def citations(done: DataFrame, hits: DataFrame, chunks: DataFrame, chars: int = 240) -> DataFrame:
    """(query_id, position, number, issuer, reference, title, link, snippet) of the cited sources, in order of appearance."""
    c = chunks.join(hits.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "chunk_id")
    cited = done.select("query_id", F.posexplode("cited").alias("position", "number"))
    j = cited.join(hits.select("query_id", F.col("rank").alias("number"), "chunk_id"), ["query_id", "number"]).join(c, "chunk_id")
    return j.select("query_id", "position", "number", "issuer", "reference", "title", T.page_link("url", "page_start").alias("link"), F.substring("text", 1, chars).alias("snippet"))


def status(verdict: Column, abstention: Column, generated: Column) -> Column:
    return F.when(verdict != "ok", "out_of_scope").when(abstention != "none", "not_found").when(generated, "answered").otherwise("sources_only")


def generate(prompted: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """`prompted` (query_id, sources, prompt) with the model's text; a failing batch gives null texts and the error."""
    def run(batches):
        for b in batches:
            try:
                yield b.assign(text=model(b["prompt"].tolist()), error=None)
            except Exception as e:  # one failing batch doesn't stop the run
                yield pd.concat([b, pd.DataFrame({"text": [None] * len(b), "error": [str(e)] * len(b)}, index=b.index)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompted.schema.fields)
    return prompted.mapInPandas(run, f"{kinds}, text string, error string")


def judge_prompts(answers: DataFrame, golden: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, sources, facts, prompt): what a judge is given of each answered answerable item: question, answer, sources in
    rank order, the facts to be conveyed, the quotes of its evidence and the notes. `facts` is what judge_verdict needs. Null
    answers are left out; items without hits have no sources."""
    none = F.array().cast("array<string>")
    g = golden.dropDuplicates(["id"]).where("answerable")
    quotes = F.array_compact(F.concat(F.array("evidence.quote"), F.coalesce(F.transform("extra_evidence", lambda e: e["quote"]), none)))
    g = g.select("id", "question", "notes", F.concat(F.coalesce("expected_facts", none), F.coalesce("derived_facts", none)).alias("facts"), quotes.alias("quotes"))
    c = chunks.join(hits.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", "reference", "section").alias("at"), "text")
    packed = hits.select(F.col("query_id").alias("id"), "chunk_id", "rank").join(c, "chunk_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "at", "text"))).alias("s"))
    a = answers.dropDuplicates(["answer_id"]).where(F.col("answer").isNotNull() & (F.col("abstention") == "none")).select("answer_id", "id", "answer")
    j = a.join(g, "id").join(packed, "id", "left")
    s = F.coalesce("s", F.array().cast(packed.schema["s"].dataType))
    shown = F.array_join(F.transform(s, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["at"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    part = lambda title, body: F.concat(F.lit(title + "\n"), body)
    prompt = F.concat_ws("\n\n", F.lit(C.JUDGE_TASK), part("Question", F.coalesce("question", F.lit(""))), part("Answer", F.col("answer")), part("Sources", shown),
                         part("Expected facts", F.array_join("facts", "\n")), part("Evidence", F.array_join("quotes", "\n")), part("Notes", F.col("notes")))
    return j.select("answer_id", F.size(s).alias("sources"), F.size("facts").alias("facts"), prompt.alias("prompt"))


def judge_verdict(raw: Column | str, facts: Column | str) -> Column:
    """A judge's JSON as a struct: faithfulness = supported of all claims (1 without claims), correctness = conveyed of all
    `facts` (1 without facts), relevance 1 to 5, lists of at most five. Counts are clamped, missing ones are 0; null where there
    is no JSON object that can be read."""
    r, total = F.col(raw) if isinstance(raw, str) else raw, F.col(facts) if isinstance(facts, str) else facts
    keys = "claims string, supported_claims string, facts_conveyed string, relevance string, unsupported array<string>, missing_facts array<string>, unreadable string"
    v = F.from_json(F.nullif(F.regexp_extract(r, r"(?s)\{.*\}", 0), F.lit("")), keys, {"columnNameOfCorruptRecord": "unreadable"})
    number = lambda k, least: F.greatest(F.coalesce(v[k].try_cast("double").try_cast("int"), F.lit(least)), F.lit(least))
    claims = number("claims", 0)
    share = lambda n, of: F.when(of > 0, F.least(n, of) / of).otherwise(F.lit(1.0))
    five = lambda a: F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, 5)
    out = F.struct(share(number("supported_claims", 0), claims).alias("faithfulness"), F.least(number("relevance", 1), F.lit(5)).alias("relevance"), share(number("facts_conveyed", 0), total).alias("correctness"),
                   five(v["unsupported"]).alias("unsupported"), five(v["missing_facts"]).alias("missing_facts"))
    return F.when(v.isNotNull() & v["unreadable"].isNull(), out)
