"""python -m corpusloom COMMAND: a thin command line over the library, on a folder of parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions import text as T
from .operators import evaluate, index, metadata, reports, search
from .plans import pipeline, registry
from .session import materialize, table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("command", choices=["ingest", "ask", "eval", "corpus-report", "golden-check", "guardrails"])
    p.add_argument("data", help="folder of parquet tables")
    p.add_argument("--index", help="root of the index")
    p.add_argument("--question", default="")
    p.add_argument("--mode", default="dense", choices=["dense", "sparse", "hybrid"])
    p.add_argument("--k", type=int, default=search.TOP_K)
    p.add_argument("--out", help="folder of the report")
    p.add_argument("--min-hit-rate", type=float, default=0.0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    load = lambda name: table(spark, a.data, name)
    if a.command == "ingest":
        index.ingest(a.index, load("chunks")).groupBy("status").count().show()
        return 0
    chunks = index.read(spark, a.index, "chunks") if a.index else load("chunks")
    if a.command == "ask":
        q = spark.createDataFrame([("q", a.question)], "query_id string, question string")
        pipeline.retrieve(chunks, q, a.mode, a.k).join(chunks.withColumnRenamed("id", "chunk_id").select("chunk_id", "title", "section", "text"), "chunk_id").orderBy("rank").show(a.k, truncate=120)
        return 0
    if a.command == "eval":
        hits = materialize(pipeline.retrieve(chunks, registry.asked(spark, a.data), a.mode, a.k), "hits")
        summary = evaluate.retrieval_summary(evaluate.retrieval_ranks(load("golden"), hits, chunks), a.k)
        reports.write(a.out or ".", "Retrieval", summary, {"mode": a.mode, "k": a.k}, ("hit_1", "hit_3", "hit_k", "doc_hit_k", "section_hit_k"))
        return reports.gate(summary.where("slice = 'all'").first()["hit_k"], a.min_hit_rate)
    if a.command == "corpus-report":
        reports.write(a.out or ".", "Corpus", metadata.corpus_rollup(load("doc_meta"), metadata.document_stats(load("native_pages"))), shares=("scanned_share",))
        return 0
    if a.command == "golden-check":
        bad = evaluate.consistency_errors(load("golden"))
        bad.show(50, truncate=False)
        return int(not bad.isEmpty())
    load("golden").select("id", T.guard_verdict("question").alias("verdict")).distinct().groupBy("verdict").count().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
