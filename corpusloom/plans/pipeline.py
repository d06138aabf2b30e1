"""Whole chains: from a batch of questions to outputs, and the evaluation of follow-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer, evaluate, search
from ..session import materialize

#: Fixed answers by verdict (or "not_found") and language; callers may pass their own.
REPLIES = {
    "empty": {"fr": "La question est vide.", "en": "The question is empty.", "ar": "السؤال فارغ."},
    "too_long": {"fr": "La question est trop longue.", "en": "The question is too long.", "ar": "السؤال طويل جدا."},
    "meta": {"fr": "Je réponds aux questions sur les textes du corpus.", "en": "I answer questions about the texts of the corpus.", "ar": "أجيب عن الأسئلة المتعلقة بنصوص المدونة."},
    "greeting": {"fr": "Bonjour. Posez votre question.", "en": "Hello. Ask your question.", "ar": "مرحبا. اطرح سؤالك."},
    "off_topic": {"fr": "La question sort du domaine du corpus.", "en": "The question is outside the corpus.", "ar": "السؤال خارج نطاق المدونة."},
    "not_found": {"fr": "Les textes consultés ne répondent pas à la question.", "en": "The texts consulted don't answer the question.", "ar": "لا تجيب النصوص المطلع عليها عن السؤال."},
}


def reply(kind: Column, lang: Column, replies: dict = REPLIES) -> Column:
    table = F.create_map(*[x for k, by in replies.items() for la, t in by.items() for x in (F.lit(f"{k}|{la}"), F.lit(t))])
    return table[F.concat_ws("|", kind, lang)]


def retrieve(chunks: DataFrame, questions: DataFrame, mode: str = "dense", k: int = search.TOP_K, where: search.SearchFilter | None = None, rerank: bool = False, candidates: int = 20) -> DataFrame:
    """Hits of one mode (dense, sparse, hybrid), reranked on request from max(k, candidates) hits."""
    depth = max(k, candidates) if rerank else k
    hits = {"dense": search.dense, "sparse": search.bm25, "hybrid": search.hybrid}[mode](chunks, questions, depth, where)
    return search.rerank(hits, questions, chunks, k) if rerank else hits


def answers(chunks: DataFrame, questions: DataFrame, model: Callable[[list[str]], list[str]] | None = None, min_score: float = answer.MIN_SCORE, with_scope: bool = True, **how) -> DataFrame:
    """(query_id, lang, verdict, abstention, status, answer, cited, sources) for a batch (query_id, question).

    Blocked questions, questions without support and, without a model, all others end before generation."""
    g = materialize(answer.guarded(questions, with_scope).select("query_id", "clean", "lang", "verdict"), "guarded")
    ok = g.where("verdict = 'ok'").select("query_id", F.col("clean").alias("question"), "lang")
    hits = materialize(retrieve(chunks, ok, **how), "hits")
    per = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("sources"))
    none = F.array().cast("array<int>")
    cols = ["query_id", "lang", "verdict", "abstention", "status", "answer", "cited", "sources"]

    blocked = g.where("verdict != 'ok'").withColumns({"abstention": F.lit("none"), "status": F.lit("out_of_scope"), "answer": reply(F.col("verdict"), F.col("lang")), "cited": none, "sources": F.lit(0)})
    known = ok.join(answer.supported(hits, min_score), "query_id", "left").join(per, "query_id", "left").withColumn("verdict", F.lit("ok")).withColumn("sources", F.coalesce("sources", F.lit(0)))
    weak = known.where(~F.coalesce("supported", F.lit(False))).withColumns({"abstention": F.lit("low_score"), "status": F.lit("not_found"), "answer": reply(F.lit("not_found"), F.col("lang")), "cited": none})
    strong = known.where("supported")
    if model is None:
        done = strong.withColumns({"abstention": F.lit("none"), "status": F.lit("sources_only"), "answer": F.lit(None).cast("string"), "cited": none})
    else:
        prompts = answer.prompts(hits, chunks, strong.select("query_id", "question"))
        raw = answer.generate(prompts, model).join(strong.select("query_id", "lang", "verdict"), "query_id")
        done = answer.finished(raw, reply(F.lit("not_found"), F.col("lang")))
        done = done.withColumn("abstention", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("abstention"))).withColumn("status", answer.status(F.col("verdict"), F.col("abstention"), F.lit(True)))
    return blocked.select(*cols).unionByName(weak.select(*cols)).unionByName(done.select(*cols))


def followup_ranks(cases: DataFrame, golden: DataFrame, chunks: DataFrame, k: int = search.TOP_K, rewrite: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, kind, alone, in_context): the first hit of each case's target asked alone and rewritten with its context.
    `cases`: id, context, followup ("@target" stands for the target's own question), target, kind."""
    g = golden.dropDuplicates(["id"])
    c, t = g.select(F.col("id").alias("context"), F.col("question").alias("context_question")), g.select(F.col("id").alias("target"), F.col("question").alias("target_question"))
    j = cases.dropDuplicates(["id"]).join(c, "context").join(t, "target")
    asked = F.when(F.col("followup") == "@target", F.col("target_question")).otherwise(F.col("followup"))
    rewrite = rewrite or (lambda question, context: F.concat_ws(" ", question, context))
    j = materialize(j.select("id", "kind", "target", asked.alias("alone"), rewrite(asked, F.col("context_question")).alias("in_context")), "followups")
    out = j.select("id", "kind")
    for how in ("alone", "in_context"):
        hits = search.dense(chunks, j.select(F.col("id").alias("query_id"), F.col(how).alias("question")), k)
        ev = evaluate.all_evidence(golden).withColumnRenamed("id", "target").join(j.select("id", "target"), "target")
        texts = chunks.select(F.col("id").alias("chunk_id"), F.col("file").alias("cfile"), "text").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
        per = hits.withColumnRenamed("query_id", "id").join(texts, "chunk_id").join(ev, "id").where((F.col("cfile") == F.col("file")) & (T.quote_coverage("quote", "text") >= evaluate.PASSAGE))
        out = out.join(per.groupBy("id").agg(F.min("rank").alias(how)), "id", "left")
    return out


def followup_summary(ranks: DataFrame) -> DataFrame:
    """Per kind: cases, hit share and mean reciprocal rank alone and in context (any rank of the list counts)."""
    rr = lambda c: F.round(F.sum(F.when(F.col(c).isNotNull(), 1.0 / F.col(c)).otherwise(0.0)) / F.greatest(F.count("*"), F.lit(1)), 6)
    hit = lambda c: F.round(F.count(c) / F.greatest(F.count("*"), F.lit(1)), 6)
    return ranks.groupBy("kind").agg(F.count("*").alias("n"), hit("alone").alias("hit_alone"), hit("in_context").alias("hit_in_context"), rr("alone").alias("mrr_alone"), rr("in_context").alias("mrr_in_context"))
