"""The index: tables in buckets of files, written by generations, and a catalog that names the generation of each bucket.

Folders are `root/<generation>/<table>/bucket=<b>`; the file `root/CURRENT` is the catalog. Ingestion writes a new generation of
the buckets whose files changed and replaces the catalog in one step: other buckets are neither read nor written, and a failure
leaves the earlier state in place. Tables: `chunks`; `postings` (chunk_id, n, term, tf), by term within each file, stored as lists
per term of the chunks' numbers (`pos` of the stored chunks); `terms` (term, df) and `lengths` (chunks, total), which add up over
the buckets; `files` (file, sha, n).

Defined cases: an id belongs to one file, of repeated ids any row stays; a null text has no postings; a null file lies in bucket
0 and is taken by `build` only; an empty table gives an empty index; a generation may have other columns than an earlier one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..session import materialize, small_side
from . import search

TABLES = ("chunks", "postings", "terms", "lengths", "files")
#: Buckets of a new index. At 100 TB take some thousands, so that a bucket is some ten GB.
BUCKETS = 32


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def catalog(spark: SparkSession, root: str) -> dict | None:
    """buckets, avg_len, and for each generation in use its buckets and the schemas of its tables; None without an index."""
    path, fs = _fs(spark, f"{root}/CURRENT")
    return json.loads("".join(r[0] for r in spark.read.text(f"{root}/CURRENT").collect())) if fs.exists(path) else None


def _point(spark: SparkSession, root: str, now: dict) -> None:
    """Replace the catalog by renaming a finished file over it, in one step."""
    jvm = spark._jvm
    new, fs = _fs(spark, f"{root}/CURRENT.{uuid.uuid4().hex}")
    old, _ = _fs(spark, f"{root}/CURRENT")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).rename(new, old, over)


def bucket_of(file: Column | str, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(file), F.lit(buckets)), F.lit(0)).cast("int")


def _parts(spark: SparkSession, root: str, now: dict, name: str, only: list[int] | None = None) -> dict[str, DataFrame]:
    """A stored table by generation."""
    out = {}
    for gen, g in now["generations"].items():
        wanted = [b for b in g["buckets"] if only is None or b in only]
        out[gen] = spark.read.schema(StructType.fromJson(g["schemas"][name])).parquet(f"{root}/{gen}/{name}").where(F.col("bucket").isin(wanted) if wanted else F.lit(False)).drop("bucket")
    return out


def read(spark: SparkSession, root: str, name: str, only: list[int] | None = None) -> DataFrame:
    """A table of the index, of some buckets only on request. `postings` come with their weight."""
    now = catalog(spark, root)
    if now is None:
        raise FileNotFoundError(f"no index in {root}")
    whole = None
    for gen, part in _parts(spark, root, now, name, only).items():
        if name == "postings":
            ids = _parts(spark, root, now, "chunks", only)[gen].select("pos", F.col("id").alias("chunk_id"))
            part = part.select("term", F.inline(F.arrays_zip("pos", "n", "tf"))).join(ids, "pos").select("chunk_id", "n", "term", "tf")
        part = part.drop("pos")
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if name == "postings":
        whole = whole.withColumn("weight", search.weight(F.lit(now["avg_len"])))
    return whole


def exists(spark: SparkSession, root: str) -> bool:
    return catalog(spark, root) is not None


def count(spark: SparkSession, root: str) -> int:
    """Chunks in the index; 0 without an index."""
    return read(spark, root, "chunks").count() if exists(spark, root) else 0


def _each_once(chunks: DataFrame) -> DataFrame:
    """Any one row per id. Only rows of repeated ids move."""
    repeated = small_side(materialize(chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id")), "index-repeated"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    return chunks.join(repeated, same, "left_anti").unionByName(chunks.join(repeated, same, "left_semi").dropDuplicates(["id"]))


def _inverted(tokens: DataFrame) -> DataFrame:
    """(bucket, term, pos, n, tf), the last three lists of equal length: `tokens` (bucket, pos, tokens) by term, where they lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n = np.diff(b.column(2).offsets.to_numpy())
            coded = b.column(2).flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(b)), n)
            lists = bucket[row].astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            lists, of = np.unique(lists, return_inverse=True)
            pairs, tf = np.unique(of * len(b) + row, return_counts=True)
            begin = pa.array(np.searchsorted(pairs // len(b), np.arange(len(lists) + 1)), pa.int32())
            row = pairs % len(b)
            columns = [pa.ListArray.from_arrays(begin, pa.array(x, kind)) for x, kind in ((pos[row], pa.int64()), (n[row], pa.int32()), (tf, pa.int32()))]
            terms = coded.dictionary.take(pa.array(lists % len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([pa.array(lists // len(coded.dictionary), pa.int32()), terms, *columns], ["bucket", "term", "pos", "n", "tf"])

    return tokens.select("bucket", "pos", "tokens").mapInArrow(run, "bucket int, term string, pos array<bigint>, n array<int>, tf array<int>")


def _write(chunks: DataFrame, root: str, buckets: int) -> tuple[str, dict]:
    """Write a generation of these chunks: its name and the schemas of its tables. Text moves once, to its bucket."""
    spark = chunks.sparkSession
    gen, schemas = f"g-{uuid.uuid4().hex}", {}

    def write(df: DataFrame, name: str, order: str | None = None, moves: bool = True) -> DataFrame:
        df = df.hint("rebalance", "bucket") if moves else df  # small buckets share a task, one with a file that holds a third of the rows is split
        df = df.withColumn("pos", F.monotonically_increasing_id()) if name == "chunks" else df
        df = df.sortWithinPartitions("bucket", order) if order else df
        df.write.partitionBy("bucket").parquet(f"{root}/{gen}/{name}")
        schema = StructType([f for f in df.schema if f.name != "bucket"] + [df.schema["bucket"]])
        schemas[name] = json.loads(schema.json())
        return spark.read.schema(schema).parquet(f"{root}/{gen}/{name}")

    c = _each_once(chunks.drop("bucket", "pos")).withColumn("bucket", bucket_of("file", buckets))
    c = write(c, "chunks")
    p = write(_inverted(search.tokenised(c, "bucket", "pos")), "postings", "term", moves=False)
    write(p.groupBy("bucket", "term").agg(F.sum(F.size("pos")).alias("df")), "terms", "term")
    total = p.groupBy("bucket").agg(F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))
    count = c.where(F.col("text").isNotNull()).groupBy("bucket").agg(F.count("*").alias("chunks"))
    write(count.join(total, "bucket", "left").select("bucket", "chunks", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")), "lengths")
    write(file_states(c).withColumn("bucket", bucket_of("file", buckets)), "files")
    return gen, schemas


def build(chunks: DataFrame, root: str, avg_len: float | None = None, buckets: int = BUCKETS) -> str:
    """Write a whole new generation, then the catalog. With `avg_len` that average length is used for the weights."""
    spark = chunks.sparkSession
    gen, schemas = _write(chunks, root, buckets)
    if avg_len is None:
        lengths = spark.read.schema(StructType.fromJson(schemas["lengths"])).parquet(f"{root}/{gen}/lengths")
        avg_len = lengths.agg(F.sum("total") / F.sum("chunks")).first()[0] or 1.0
    _point(spark, root, {"buckets": buckets, "avg_len": max(1.0, float(avg_len)), "generations": {gen: {"buckets": list(range(buckets)), "schemas": schemas}}})
    return gen


def remove_unused(spark: SparkSession, root: str) -> list[str]:
    """Delete the generations that the catalog doesn't name, once no reader uses them and nothing is being written."""
    now = catalog(spark, root)
    path, fs = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if now else []
    gone = [n for n in names if n.startswith("g-") and n not in now["generations"]]
    for n in gone:
        fs.delete(_fs(spark, f"{root}/{n}")[0], True)
    return gone


def upsert(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`base` with the rows of `new` added or, by key, replaced; of repeated new keys any row stays."""
    fresh = new.dropDuplicates([key])
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def without_files(base: DataFrame, files: DataFrame) -> DataFrame:
    return base.join(files.select("file").distinct(), "file", "left_anti")


def file_states(chunks: DataFrame) -> DataFrame:
    """(file, sha, n) of the files in the index."""
    return chunks.groupBy("file").agg(F.max("content_sha256").alias("sha"), F.countDistinct("id").alias("n"))


def ingest_status(stored: DataFrame, incoming: DataFrame, remove_missing: bool = False) -> DataFrame:
    """(file, status): added, updated, unchanged, emptied or, on request, removed. Both sides: file, sha, n. A null sha
    equals only a null."""
    s = stored.select("file", F.col("sha").alias("old"), F.col("n").alias("old_n"))
    i = incoming.select("file", F.col("sha").alias("new"), F.col("n").alias("new_n"))
    j = i.join(s, "file", "full_outer")
    status = (
        F.when(F.col("new_n").isNull(), "removed" if remove_missing else None)
        .when(F.col("new_n") == 0, F.when(F.col("old_n").isNull(), "unchanged").otherwise("emptied"))
        .when(F.col("old_n").isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    )
    return j.select("file", status.alias("status")).where(F.col("status").isNotNull())


def ingest(root: str, chunks: DataFrame) -> DataFrame:
    """Bring the index up to date with the chunks of some files: changed files are replaced, equal ones left alone; only the
    buckets of changed files are read and written, and the average length stays. Gives (file, status)."""
    spark = chunks.sparkSession
    now = catalog(spark, root)
    if now is None:
        build(chunks, root)
        return read(spark, root, "files").select("file", F.lit("added").alias("status"))
    incoming = chunks.where(F.col("file").isNotNull())
    what = ingest_status(read(spark, root, "files").where(F.col("file").isNotNull()), file_states(incoming))
    what = materialize(what.where(F.col("status").isin("added", "updated", "unchanged")), "ingest")
    changed = what.where(F.col("status") != "unchanged")
    buckets = now["buckets"]
    touched = sorted(r[0] for r in changed.select(bucket_of("file", buckets)).distinct().collect())
    if not touched:
        return what
    changed = small_side(changed.select("file"))
    fresh = incoming.join(changed, "file", "left_semi")
    merged = read(spark, root, "chunks", touched).join(changed, "file", "left_anti").unionByName(fresh, allowMissingColumns=True)
    gen, schemas = _write(merged, root, buckets)
    generations = {g: {**x, "buckets": [b for b in x["buckets"] if b not in touched]} for g, x in now["generations"].items()}
    generations[gen] = {"buckets": touched, "schemas": schemas}
    _point(spark, root, {**now, "generations": {g: x for g, x in generations.items() if x["buckets"]}})
    return what


def keyword_search(spark: SparkSession, root: str, questions: DataFrame, k: int = search.TOP_K, where: search.SearchFilter | None = None) -> DataFrame:
    """`search.bm25` over the stored postings: (query_id, chunk_id, score, rank). Neither text nor postings of other terms are read."""
    asked = search.query_terms(questions)
    terms = small_side(materialize(asked.select("term").distinct(), "query-words"))
    now = catalog(spark, root)
    n = read(spark, root, "lengths").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).first()["chunks"]
    df = read(spark, root, "terms").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    chunks, rows = _parts(spark, root, now, "chunks"), None
    for gen, p in _parts(spark, root, now, "postings").items():
        p = p.join(terms, "term", "left_semi").select("term", F.inline(F.arrays_zip("pos", "n", "tf")))
        p = p.groupBy("pos").agg(F.max("n").alias("n"), F.collect_list(F.struct("term", "tf")).alias("t"))
        c = (chunks[gen].where(where.condition()) if where else chunks[gen]).select("pos", F.col("id").alias("chunk_id"))
        p = p.join(c, "pos").select("chunk_id", "n", F.col("t.term").alias("tokens"), F.col("t.tf").alias("tfs"))
        rows = p if rows is None else rows.unionByName(p)
    return search.top_by_terms(rows, asked, df, n, now["avg_len"], k)


def summary(chunks: DataFrame) -> DataFrame:
    """One row: documents, issuers, first and last year."""
    return chunks.agg(F.countDistinct("file").alias("documents"), F.array_join(F.sort_array(F.collect_set("issuer")), ",").alias("issuers"), F.min(F.year("published")).alias("first_year"), F.max(F.year("published")).alias("last_year"))


def with_ids(spans: DataFrame, meta: DataFrame, prefix: str = "corpus") -> DataFrame:
    """Chunker output with the metadata of its file, ids and content hash."""
    m = meta.dropDuplicates(["file"]).select("file", "issuer", "reference", "title", "url", "language", "published")
    return spans.join(m, "file").select(T.chunk_id(prefix, "file", "index").alias("id"), "*", F.sha2("text", 256).alias("content_sha256"))
