"""Dense vectors: hashed bags of words as expressions, and exact nearest neighbours by blocks of a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import WORD

DIM = 256
#: Queries that one pass over the rows takes along; more queries take more passes.
BLOCK = 1000


def hash_buckets(x: Column | str) -> Column:
    """The bucket of each word: the first byte of its MD5."""
    words = F.regexp_extract_all(F.lower(F.col(x) if isinstance(x, str) else x), F.lit(WORD + "+"), F.lit(0))
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int"))


def hash_counts(x: Column | str) -> Column:
    """Words per bucket, an array of 256."""
    b = hash_buckets(x)
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.size(F.filter(b, lambda y: y == i)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / n))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def hash_matrix(texts: list[str | None]) -> np.ndarray:
    """Rows of word counts per bucket (the twin of hash_counts inside tasks); words of a batch are hashed once."""
    import hashlib
    from itertools import chain

    import regex

    words = [regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower()) for t in texts]
    bucket = {w: hashlib.md5(w.encode(), usedforsecurity=False).digest()[0] for w in set(chain.from_iterable(words))}
    out = np.zeros((len(texts), DIM))
    for i, ws in enumerate(words):
        if ws:
            out[i] = np.bincount([bucket[w] for w in ws], minlength=DIM)
    return out


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_by_blocks(rows: DataFrame, row_id: str, value: str, queries: DataFrame, query_id: str, query_value: str, k: int) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of highest cosine for each query, exact.

    `value` holds vectors (arrays) or texts (hashed word counts). The query set, in blocks, is sent to the rows; each
    batch multiplies matrices, each task returns k rows per query, which one window per query reduces to k. Scores are rounded
    to nine digits before ranking; ties go to the smaller row id. Rows of equal id count once.
    """
    spark = rows.sparkSession
    qs = queries.select(query_id, query_value).dropDuplicates([query_id]).orderBy(query_id).collect()
    texts = rows.schema[value].dataType.simpleString() == "string"
    to_matrix = (lambda c: hash_matrix(c.to_pylist())) if texts else _matrix
    kinds = (queries.schema[query_id].dataType.simpleString(), rows.schema[row_id].dataType.simpleString())
    src = rows.select(row_id, value).where(F.col(value).isNotNull())
    out = None
    for at in range(0, max(1, len(qs)), BLOCK):
        part = [r for r in qs[at : at + BLOCK] if r[1] is not None]
        own = hash_matrix([r[1] for r in part]) if texts else np.array([r[1] for r in part], np.float64).reshape(len(part), -1)
        block = spark.sparkContext.broadcast(([r[0] for r in part], _unit_rows(own)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q = block.value
            kept: list = [(np.zeros(0), np.zeros(0, object))] * len(ids)
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                names, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)  # each id once
                names = names.astype(object)
                score = np.round(q @ _unit_rows(to_matrix(b.column(1).take(pa.array(first)))).T, 9)
                for i, s in enumerate(score):
                    at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    before, known = kept[i], set(kept[i][1])
                    at = [j for j in at[np.lexsort((at, -s[at]))[:k]] if names[j] not in known]
                    both, them = np.concatenate([before[0], s[at]]), np.concatenate([before[1], names[at]])
                    best = sorted(range(len(both)), key=lambda x, both=both, them=them: (-both[x], them[x]))[:k]
                    kept[i] = (both[best], them[best])
            for i, (score, them) in enumerate(kept):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(them)).cast(pa.int64() if kinds[0] == "bigint" else pa.string()), pa.array(list(them)).cast(pa.int64() if kinds[1] == "bigint" else pa.string()), pa.array(score)], [query_id, row_id, "score"])

        top = src.mapInArrow(run, f"{query_id} {kinds[0]}, {row_id} {kinds[1]}, score double")
        out = top if out is None else out.unionByName(top)
    return ranked(out.dropDuplicates([query_id, row_id]), query_id, row_id, k)


def ranked(scored: DataFrame, query_id: str, row_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
