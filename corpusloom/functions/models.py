"""Adapters for models that the caller provides: embedders, rerankers, language models. A model is made once per worker;
calls are batched and retried with growing pauses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Score = Callable[[list[str], list[str]], Sequence[float]]


def retried(call: Callable, attempts: int = 4, pause: Callable[[float], None] = time.sleep, permanent: Callable[[Exception], bool] = lambda e: False) -> Callable:
    """`call`, tried again after 1, 2, 4 ... seconds; a permanent error isn't retried."""
    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                if k == attempts - 1 or permanent(e):
                    raise
                pause(2.0**k)

    return run


def embedded(df: DataFrame, text: str, out: str, make: Callable[[], Embed], batch: int = 64) -> DataFrame:
    """`df` with the vector of each text; a null text has a null vector."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            got: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(at), batch):
                for i, v in zip(at[k : k + batch], model([s.iloc[i] for i in at[k : k + batch]]), strict=True):
                    got[i] = [float(x) for x in v]
            yield pd.Series(got)

    return df.withColumn(out, run(text))


def scored(pairs: DataFrame, question: str, text: str, out: str, make: Callable[[], Score], max_chars: int | None = None) -> DataFrame:
    """`pairs` with a reranker's score of (question, text), the text cut to what the model reads."""
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in parts:
            yield pd.Series([float(x) for x in model(list(q.fillna("")), [x[:max_chars] for x in t.fillna("")])], dtype="float64")

    return pairs.withColumn(out, run(question, text))


def truncated_inputs(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """One row: how many texts are longer than a model reads, by words."""
    return df.agg(F.count("*").alias("texts"), F.count_if(F.size(T.content_words(text)) > max_tokens).alias("truncated"))
