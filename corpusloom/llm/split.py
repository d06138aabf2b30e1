"""Problem 7: items over a size limit in pieces that end at natural boundaries and overlap.

The boundaries of a text are its word starts, each with a strength: article heading, paragraph, line after a sentence,
sentence, clause, line, word. A sparse table answers "strongest boundary in this window" in constant time; of equal
ones the rightmost wins. From the cut, the next piece steps back by up to the overlap to the strongest boundary there.

Defined cases: null and empty texts and texts within the limit give no piece; a window without any boundary is cut at
the limit (before the base letter of a combining accent); repeated keys count once; a null section stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1200
OVERLAP = 200
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?؟…"], np.uint32)
_CLAUSES = np.array([ord(c) for c in ";:؛"], np.uint32)
_COMMAS = np.array([ord(c) for c in ",،)»\""], np.uint32)
_heading = re.compile(r"(?:Article|ARTICLE|Artículo|المادة|الفصل|Chapitre|CHAPITRE|Section|SECTION|Annexe|ANNEXE)\s+(?:\d|premier|[IVX])")
HEADING, PARAGRAPH, LINE_AFTER_STOP, STOP, CLAUSE, LINE, COMMA, WORD = 8, 7, 6, 5, 4, 3, 2, 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths) of the word starts after the first."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.isin(codes, _SPACES)
    at = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ink = np.where(space, 0, np.arange(1, len(codes) + 1))
    before = np.maximum.accumulate(ink)[at - 1]  # one past the last inked character before each start
    at, before = at[before > 0], before[before > 0]
    breaks = np.concatenate([[0], np.cumsum(codes == 10)])
    lines = breaks[at] - breaks[before]
    last = codes[before - 1]
    stop, clause, comma = np.isin(last, _STOPS), np.isin(last, _CLAUSES), np.isin(last, _COMMAS)
    s = np.full(len(at), WORD)
    s[comma] = COMMA
    s[lines > 0] = LINE
    s[clause] = CLAUSE
    s[stop] = STOP
    s[stop & (lines > 0)] = LINE_AFTER_STOP
    s[lines > 1] = PARAGRAPH
    starts = np.array([m.start() for m in _heading.finditer(text)], np.int64)
    s[np.isin(at, starts) & ((lines > 0) | stop)] = HEADING
    return at, s


class StrongestCut:
    """Range maximum over strengths by a sparse table; ties go right."""

    def __init__(self, strengths: np.ndarray):
        n = len(strengths)
        self.levels = [strengths.astype(np.int64) * n + np.arange(n)]
        width = 1
        while 2 * width <= n:
            row = self.levels[-1]
            self.levels.append(np.maximum(row[:-width], row[width:]))
            width *= 2
        self.n = n

    def __call__(self, low: int, high: int) -> int:
        """The index of the strongest of strengths[low:high], low < high."""
        k = (high - low).bit_length() - 1
        row = self.levels[k]
        return int(max(row[low], row[high - (1 << k)])) % self.n


def _hard_cut(text: str, start: int, stop: int) -> int:
    while stop > start + 1 and (0x300 <= ord(text[stop]) < 0x370 or 0x64B <= ord(text[stop]) < 0x660):
        stop -= 1
    return stop


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open ranges of at most `size` code points that cover the text; consecutive ones share at most `overlap`."""
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be less than half the size")
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    at, strengths = boundaries(text)
    strongest = StrongestCut(strengths) if len(at) else None
    out, start = [], 0
    while n - start > size:
        low, high = map(int, np.searchsorted(at, (start + size // 2, start + size + 1)))
        cut = int(at[strongest(low, high)]) if low < high else _hard_cut(text, start + size // 2, start + size)
        out.append((start, cut))
        low, high = map(int, np.searchsorted(at, (cut - overlap, cut)))
        start = int(at[strongest(low, high)]) if low < high else _hard_cut(text, cut - overlap - 1, cut - overlap) if overlap else cut
    return [*out, (start, n)]


def split_oversized(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(tbl, item, piece, start, stop, section[, text]) of the items over `size`. `items`: tbl, item, section, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, number, starts, stops, texts = [], [], [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                for k, (x, y) in enumerate(pieces(t, size, overlap)):
                    rows.append(i)
                    number.append(k)
                    starts.append(x)
                    stops.append(y)
                    if with_text:
                        texts.append(t[x:y])
            tbl, item, section = (b.column(k).take(pa.array(rows, pa.int32())) for k in range(3))
            cols = [tbl, item, pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), section]
            names = ["tbl", "item", "piece", "start", "stop", "section"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    over = items.where(F.length("text") > size).select("tbl", "item", "section", "text")
    schema = "tbl string, item string, piece int, start int, stop int, section string" + ", text string" * with_text
    return over.mapInArrow(run, schema).dropDuplicates(["tbl", "item", "piece"])


def regulatory_items(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    c = chunks.select(F.lit("chunks").alias("tbl"), F.col("id").alias("item"), "section", "text")
    return c.unionByName(spans.select(F.lit("spans").alias("tbl"), F.col("span_id").cast("string").alias("item"), "section", "text"))
