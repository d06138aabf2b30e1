"""Problem 9: documents into containers of a fixed number of tokens, by sum-of-squares packing.

Each document goes where it makes the sum of the squared counts of open containers per gap smallest. The documents are
dealt by a hash into groups of about `group_docs`, so that no group grows with the corpus, and each group is packed by
itself, larger documents first. Only a document larger than a container is divided: into full containers and a rest.

Defined cases: null and empty texts (0 tokens) go into the first container of their group; repeated ids are packed
once; ties go to the smallest gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import encoder, tokenizer_path

CAPACITY = 2048
GROUP_DOCS = 20_000
#: A smaller corpus is dealt over the workers too, in groups of at least so many documents.
LEAST_DOCS = 2_500


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0 < size <= capacity), in the order given."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # open containers per gap; gaps 0 and `capacity` don't count
    out = np.empty(len(sizes), np.int64)
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        change = 2 * n[: capacity + 1 - s] - 2 * n[s:]  # of moving one container from gap g to g - s, up to a constant 2
        change += 2
        change[0] -= 2 * n[0] + 1  # to gap 0: nothing is added
        change[n[s:] == 0] = np.iinfo(np.int64).max
        change[-1] = (2 * n[capacity - s] + 1) if s < capacity else 0  # a new container: nothing is taken away
        g = int(change.argmin()) + s
        if g == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_by_gap[g].pop()
            n[g] -= 1
        if g - s:
            open_by_gap[g - s].append(b)
            n[g - s] += 1
        out[i] = b
    return out


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens), one row per id."""
    path = tokenizer or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(path).counts(b.column(1).to_pylist()), pa.int64())], ["doc_id", "tokens"])

    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens bigint")
    return sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(container, doc_id, part, start, tokens): tokens start..start+tokens of each document lie in this container."""
    sizes = materialize(sizes, "sizes")
    spark = sizes.sparkSession
    groups = max(1, min(spark.sparkContext.defaultParallelism, -(-sizes.count() // LEAST_DOCS)), -(-sizes.count() // group_docs))
    kind = sizes.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
        n = pdf["tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        has = rest > 0
        packed = sum_of_squares(rest[has], capacity)
        first = int(packed.max()) + 1 if len(packed) else 0
        ids = pdf["doc_id"].to_numpy()
        rows = [(ids[has], full[has], full[has] * capacity, rest[has], packed)]
        parts = np.concatenate([np.arange(k) for k in full]) if full.sum() else np.empty(0, np.int64)
        rows.append((ids.repeat(full), parts, parts * capacity, np.full(len(parts), capacity), first + np.arange(len(parts))))
        none = n == 0
        rows.append((ids[none], *[np.zeros(none.sum(), np.int64)] * 4))
        doc, part, start, tokens, container = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"container": [f"{key[0]}-{c}" for c in container], "doc_id": doc, "part": part.astype("int32"), "start": start, "tokens": tokens})

    dealt = sizes.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).repartition(groups, "grp")
    return dealt.groupBy("grp").applyInPandas(run, f"container string, doc_id {kind}, part int, start bigint, tokens bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of space unused."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused")
    )
