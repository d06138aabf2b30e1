"""Problem 1: lines of the publishing site that recur over many files of one source.

The state (`State`) is a set of tables: the files of each source, the spellings and their files, the classes found and the
spellings to be removed. `advance` reduces a new partition of chunks to a delta, merges it, assigns its lines to classes
(`class_members`) and compares the files of each class with the need. Only the records that hold a spelling whose class
crossed the need in either direction are rebuilt (`newly_crossed`, `affected`, `to_rebuild`, `without_lines`).
`recurring_lines` is one step from the empty state; any division into partitions ends in the same lines.

A line is removed if it lies within MAX_WRONG characters of a spelling whose neighbours within MAX_WRONG characters occur in
as many files as needed. Classes are found by a spelling that is frequent itself (`anchors`); where the least count is needed,
every spelling is one. With `rare`, the spellings outside these classes are looked at too: they are bounded from above by the
lines that share a piece with them, then by those that have nearly their letters too, and all that can still reach the need are
compared (`rare_classes`), so that no class is left out.

Defined cases: null text or null source gives no line; a null file counts as no file; empty lines keep their number;
repeated rows count once, a repeated partition changes nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..session import materialize, small_side
from . import alike
from .forms import fold_table, joined

MIN_CHARS = 30
MIN_SHARE = 0.03
MIN_FILES = 5
MAX_WRONG = 2
#: A spelling in this share of the files that its source needs stands for a class: every spelling where MIN_FILES are needed.
#: Classes of rarer spellings alone are those of `rare_classes`.
ANCHOR_SHARE = 0.2
#: Lines are counted as shares of the need, of which WHOLE is all. Cells with a FULL-th of it are looked up, the others bounded;
#: of the rests in these cells with a FULL_AGAIN-th.
WHOLE, FULL, FULL_AGAIN = 1 << 32, 100, 100
#: Tables of one or two numbers a row are small up to so many rows.
NARROW_ROWS = 1_000_000
#: So many cells are sent to the tasks at most.
MOST_SENT = 4_000_000
#: The ranges in which joined letters lie.
JOINED = "[\u0132\u0133\u01c4-\u01cc\ufb00-\ufb17\ufbea-\ufdfb\ufe70-\ufe7f\ufef5-\ufefc]"


#: Texts of about so many characters are folded together.
TOGETHER = 1 << 20
#: Marks of characters that fold to none or to several, beyond all characters.
_NONE, _SEVERAL = 0x110000, 0x110001
_joined = re.compile(JOINED)


@lru_cache(1)
def _fold_codes() -> np.ndarray:
    """What each character folds to, by its number."""
    codes = np.arange(_NONE, dtype="<u4")
    codes[1] = _NONE
    for c, to in fold_table().items():
        codes[ord(c)] = ord(to) if to else _NONE
    for c in joined():
        codes[ord(c)] = _SEVERAL
    return codes


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beginning and the end of each line; all end with a line feed."""
    ends = np.flatnonzero(codes == 10)
    return np.append(0, ends[:-1] + 1), ends


def fold_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, line_no, key): the lines of at least MIN_CHARS characters of some texts, folded as `folded_lines` says."""
    text = "\n".join([*texts, ""])
    codes = _codes(text)
    begin, end = _bounds(codes)
    length = end - begin
    for i in np.flatnonzero((length >= MIN_CHARS) & ((codes[begin] == 32) | (codes[end - 1] == 32))):
        length[i] = len(text[begin[i] : end[i]].strip(" "))
    long = length >= MIN_CHARS
    of = [t.count("\n") + 1 for t in texts]
    row = np.repeat(np.arange(len(texts)), of)
    no = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of)
    to = _fold_codes()[codes]
    if (to == _SEVERAL).any():  # few texts hold joined letters
        to = _fold_codes()[_codes(_joined.sub(lambda m: joined().get(m[0], m[0]), text))]
    to = to[to != _NONE]
    # any number is one 0: zeros behind a zero, or behind a point or comma between zeros
    zero, point = to == 48, (to == 46) | (to == 44)
    gone = np.zeros(len(to), bool)
    gone[1:] = zero[1:] & zero[:-1]
    gone[2:] |= zero[2:] & point[1:-1] & zero[:-2]
    gone[1:-1] |= point[1:-1] & zero[:-2] & zero[2:]
    to = to[~gone]
    begin, end = _bounds(to)
    to = to[np.repeat(long, end - begin + 1)]
    to = to[to != 10]
    ends = np.append(0, np.cumsum((end - begin)[long]))
    at = np.append(0, np.cumsum((to >= 0x80).astype(np.int32) + (to >= 0x800) + (to >= 0x10000) + 1))  # byte of each character
    key = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(to.tobytes().decode("utf-32-le").encode()))
    return row[long], no[long], key


def _file_hash(file_col: str) -> Column:
    return F.when(F.col(file_col).isNotNull(), F.xxhash64(file_col))


def folded_lines(chunks: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "issuer", file_col: str = "file") -> DataFrame:
    """(rec, line_no, source, fh, h, key): each line of at least MIN_CHARS characters in the form in which lines are
    compared: without case, accents, blanks, any number as one 0, characters that print alike unified, joined letters written out."""
    c = chunks.select(F.col(id_col).alias("rec"), F.col(source_col).alias("source"), _file_hash(file_col).alias("fh"), F.col(text_col).alias("text"))
    c = c.where(F.col("source").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, i = b.column("text").to_pylist(), 0
            while i < len(texts):
                first, n = i, 0
                while i < len(texts) and n < TOGETHER:
                    n += len(texts[i]) + 1
                    i += 1
                row, no, key = fold_lines(texts[first:i])
                rec, source, fh = (b.column(k).take(pa.array(row + first)) for k in ("rec", "source", "fh"))
                yield pa.RecordBatch.from_arrays([rec, pa.array(no.astype(np.int32)), source, fh, key], ["rec", "line_no", "source", "fh", "key"])

    kinds = StructType([c.schema["rec"], StructField("line_no", IntegerType()), c.schema["source"], c.schema["fh"], StructField("key", StringType())])
    return c.mapInArrow(run, kinds).withColumn("h", F.xxhash64("source", "key")).select("rec", "line_no", "source", "fh", "h", "key")


def source_files(chunks: DataFrame, source_col: str = "issuer", file_col: str = "file") -> DataFrame:
    """(source, fh): the distinct files of each source."""
    return chunks.where(F.col(source_col).isNotNull()).select(F.col(source_col).alias("source"), _file_hash(file_col).alias("fh")).distinct()


def source_needs(files: DataFrame) -> DataFrame:
    """(source, need): the files in which a line must occur. `files`: as source_files."""
    n = files.groupBy("source").agg(F.count("fh").alias("files"))
    return n.select("source", F.greatest(F.lit(MIN_FILES), F.ceil(F.col("files") * MIN_SHARE - 1e-9)).alias("need"))


def line_files(lines: DataFrame) -> DataFrame:
    """The delta of one partition: distinct (source, h, fh)."""
    return lines.select("source", "h", "fh").distinct()


def merge_line_files(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a delta; applying a delta twice changes nothing."""
    return state.unionByName(delta).distinct()


def spelt(lines: DataFrame) -> DataFrame:
    """(source, h, key, n): the distinct spellings and how many lines hold them."""
    return lines.groupBy("source", "h", "key").agg(F.count("*").alias("n"))


def _length_of_piece(length: Column) -> Column:
    """Three pieces fit into a key with room for the middle one to move; in steps of 4 for most, so that few lengths occur. Keys
    under five characters have one empty piece."""
    return F.greatest(F.lit(0), F.when(length >= 14, F.floor((length - 2) / 12) * 4).otherwise(F.floor((length - 2) / 3))).cast("int")


def _cut(key: Column, kind: str, g: Column, moved: int = 0) -> tuple[Column, Column]:
    """One piece of length g of a key (the first, the last, or the one after the first, moved), and the rest of the key."""
    if kind == "a":
        return F.substring(key, F.lit(1), g), F.substring(key, g + 1, F.length(key))
    if kind == "z":
        return F.right(key, g), F.left(key, F.length(key) - g)
    return F.substring(key, g + 1 + moved, g), F.concat(F.left(key, g + moved), F.substring(key, 2 * g + 1 + moved, F.length(key)))


def _cell(group: str, kind: str, g: Column, piece: Column) -> Column:
    return F.xxhash64(group, F.lit(kind), g, piece)


def _cells(rows: DataFrame, group: str = "source") -> DataFrame:
    """`rows` (`group`, key, ..) once for each of the three pieces of the key, with `cell`."""
    key, g = F.col("key"), _length_of_piece(F.length("key"))
    return rows.select("*", F.explode(F.array(*[_cell(group, k, g, _cut(key, k, g)[0]) for k in ("a", "z", "m")])).alias("cell"))


def _probes(rows: DataFrame, group: str = "source") -> DataFrame:
    """`rows` (`group`, key, ..) once for each cell in which a key within MAX_WRONG characters can lie, with `cell`.

    At most two wrong characters leave one of the other's three pieces intact: the first, the last, or, if both ends have
    exactly one wrong character, the one after the first, moved by at most one. The lengths of its pieces are those of keys up to
    two characters shorter or longer."""
    key, n = F.col("key"), F.length("key")
    lengths = F.array_distinct(F.array(*[_length_of_piece(n + d) for d in range(-MAX_WRONG, MAX_WRONG + 1)]))
    rows = rows.select("*", F.explode(lengths).alias("_g"))
    g = F.col("_g")
    cells = [_cell(group, k, g, _cut(key, k, g, d)[0]) for k, d in (("a", 0), ("z", 0), ("m", -1), ("m", 0), ("m", 1))]
    return rows.select("*", F.explode(F.array(*cells)).alias("cell")).drop("_g")


def _alike(a: str, b: str) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= MAX_WRONG) & ((F.col(a) == F.col(b)) | (F.levenshtein(a, b, MAX_WRONG) >= 0))


def anchors(files: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, h, files, need): spellings frequent enough to stand for a class. `files`: as line_files."""
    floor = F.ceil(F.col("need") * ANCHOR_SHARE - 1e-9)
    counts = files.groupBy("source", "h").agg(F.count("fh").alias("files"))
    return counts.join(small_side(needs), "source").where(F.col("files") >= floor)


def class_members(spellings: DataFrame, top: DataFrame) -> DataFrame:
    """(source, h, anchor): each spelling with every anchor within MAX_WRONG characters. Both sides: source, h, key; `top`: a
    written table of anchors."""
    index = top.select("source", F.col("h").alias("anchor"), F.col("key").alias("akey"))
    index = _cells(index.withColumn("key", F.col("akey"))).select(F.col("source").alias("asource"), "anchor", "akey", "cell")
    index = small_side(materialize(index.distinct(), "line-index"))
    met = _probes(spellings.select("source", "h", "key")).select("source", "h", "key", "cell").join(index, "cell")
    return met.where((F.col("source") == F.col("asource")) & _alike("key", "akey")).select("source", "h", "anchor").distinct()


def _third(length: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((length - 2) / 3)).cast("int")


def _cell_of_length(group: str, kind: str, length: Column, piece: Column) -> Column:
    return F.xxhash64(group, F.lit(kind), length, piece)


def _cells_of_length(group: str) -> Column:
    """(cell, rest) for each of the three pieces of the key, as an array."""
    key, g = F.col("key"), _third(F.length("key"))
    parts = [(k, *_cut(key, k, g)) for k in ("a", "z", "m")]
    return F.array(*[F.struct(_cell_of_length(group, k, F.length("key"), piece).alias("cell"), rest.alias("rest")) for k, piece, rest in parts])


def _full_cells(rows: DataFrame, group: str, part: int) -> DataFrame:
    """(cell, share): the cells of `rows` (`group`, key, share), three for each by piece and length of the key, whose lines come to at
    least 1 / `part` of the need; the others hold at most _light lines each."""
    cells = rows.select("share", F.inline(_cells_of_length(group))).groupBy("cell").agg(F.sum("share").alias("share")).where(F.col("share") >= -(-WHOLE // part))
    return small_side(materialize(cells, "line-cells"), NARROW_ROWS)


def _lookups(rows: DataFrame, group: str, by: int | Column) -> DataFrame:
    """`rows` (`group`, key, ..) once for each cell in which a key within MAX_WRONG characters, longer by `by`, can lie, with `by`,
    `cell` and `rest`: the first piece, the last, or the one after the first, moved by what one wrong character can move it
    while the other makes up the length."""
    key, by = F.col("key"), F.lit(by) if isinstance(by, int) else by
    length = F.length("key") + by
    g = _third(length)
    parts = [("a", *_cut(key, "a", g), None), ("z", *_cut(key, "z", g), None), *[("m", *_cut(key, "m", g, d), F.abs(by + d) <= 1) for d in (-1, 0, 1)]]
    cells = [F.struct(by.alias("by"), _cell_of_length(group, k, length, piece).alias("cell"), rest.alias("rest")) for k, piece, rest, _ in parts]
    cells = [c if x[3] is None else F.when(x[3], c) for c, x in zip(cells, parts, strict=True)]
    return rows.select(*[c for c in rows.columns if c != "by"], F.inline(F.array(*cells))).where(F.col("cell").isNotNull())


#: So many cells are looked up for a key: 10 by its ends, 9 by the middle.
LOOKUPS = 19


def _all_lookups(rows: DataFrame, group: str) -> DataFrame:
    return _lookups(rows.select("*", F.explode(F.array(*[F.lit(d) for d in range(-MAX_WRONG, MAX_WRONG + 1)])).alias("_by")), group, F.col("_by")).drop("_by")


def _light(need: Column, part: int) -> Column:
    """The share that a cell outside _full_cells can add at most: its lines are fewer than need / `part`."""
    return F.ceil((F.ceil(need / part) - 1) * WHOLE / need)


def _shares(spellings: DataFrame, needs: DataFrame) -> DataFrame:
    """(h, source, key, need, share): the lines of each spelling as a share of the need, rounded up."""
    return spellings.join(small_side(needs), "source").select("h", "source", "key", "need", F.ceil(F.col("n") * WHOLE / F.col("need")).alias("share"))


def rare_classes(spellings: DataFrame, covered: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, h, anchor): the spellings within MAX_WRONG characters of each spelling `anchor` outside `covered`, of those that
    can reach the need. `spellings`: as spelt; `covered`: (source, h), spellings removed or judged already; written tables.

    The lines that lie within reach of a spelling share a piece with it, and have nearly the letters that it has. First the
    lines in the cells of these pieces bound the files of its class from above. A class needs a full cell, of which there are few,
    since the need grows with the files: so cells move once to be counted and are sent to the spellings. Those that remain are sent to
    all spellings, which meet them by cell and letters; the lines of these pairs bound the class again, and what can still
    reach the need is compared. Where more than MOST_SENT cells would be sent, `rare_classes_by_joins` does the same by joins."""
    spark = spellings.sparkSession
    shares = _shares(spellings, needs).select("h", "source", "key", "need", "share", F.xxhash64("source").alias("group"))
    asked = shares.join(small_side(covered), ["source", "h"], "left_anti").select("h", "key", "need", "group")

    def keys(b: pa.RecordBatch) -> alike.Keys:
        return alike.keys_of(b.column("key"), b.column("group").to_numpy())

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(x.view(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = alike.cells(keys(b))
            yield pa.RecordBatch.from_arrays([signed(cells.ravel()), pa.array(np.repeat(b.column("share").to_numpy(), 3))], ["cell", "share"])

    full = shares.select("key", "group", "share").mapInArrow(count, "cell long, share long").groupBy("cell").agg(F.sum("share").alias("share")).where(F.col("share") >= -(-WHOLE // FULL))
    full = materialize(full, "line-cells")
    if full.count() > MOST_SENT:
        return rare_classes_by_joins(spellings, covered, needs)
    held = full.toArrow()
    cells, most = held.column("cell").to_numpy().view(np.uint64), held.column("share").to_numpy()
    sent = spark.sparkContext.broadcast((alike.Sorted.of(cells), most[np.argsort(cells)]))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, share = sent.value
        for b in batches:
            k, need = keys(b), b.column("need").to_numpy()
            reach = np.full(len(need), len(alike.PLACES), np.int64) * (light := -(-(-(-need // FULL) - 1) * WHOLE // need))
            for wanted in alike.lookups(k):
                row, begin, _ = there.met(wanted)
                reach[row] += share[begin] - light[row]
            able = reach >= WHOLE
            yield pa.RecordBatch.from_arrays([b.column("h").filter(pa.array(able)), *[signed(x[able].copy()) for x in (alike.letters(k), *alike.cells(k).T)]], ["anchor", "letters", "a", "z", "m"])

    one = materialize(asked.mapInArrow(bound, "anchor long, letters long, a long, z long, m long"), "line-able")
    if 3 * one.count() > MOST_SENT:
        return rare_classes_by_joins(spellings, covered, needs)
    held = one.toArrow()
    names, marks, *places = (held.column(c).to_numpy() for c in one.columns)
    cells = np.concatenate(places).view(np.uint64)
    index = spark.sparkContext.broadcast((alike.Sorted.of(cells), np.argsort(cells, kind="stable") % max(1, len(names)), marks.view(np.uint64), names))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, owner, marks, names = index.value
        for b in batches:
            row, own = alike.pairs(keys(b), there, owner, marks)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[row]) for c in ("h", "share")] + [pa.array(names[own])], ["h", "share", "anchor"])

    met = materialize(shares.select("h", "key", "group", "share").mapInArrow(meet, "h long, share long, anchor long"), "line-met")
    two = materialize(met.groupBy("anchor").agg(F.sum("share").alias("share")).where(F.col("share") >= WHOLE).select("anchor"), "line-able")
    met = materialize(met.join(small_side(two, NARROW_ROWS), "anchor", "left_semi").select("h", "anchor"), "line-met")
    top = materialize(spellings.join(small_side(two.withColumnRenamed("anchor", "h"), NARROW_ROWS), "h", "left_semi").select(F.col("source").alias("asource"), F.col("h").alias("anchor"), F.col("key").alias("akey")), "line-rare-keys")
    met = materialize(met.join(small_side(top), "anchor"), "line-met")
    return spellings.select("source", "h", "key").join(small_side(met), "h").where((F.col("source") == F.col("asource")) & _alike("key", "akey")).select("source", "h", "anchor").distinct()


def rare_classes_by_joins(spellings: DataFrame, covered: DataFrame, needs: DataFrame) -> DataFrame:
    """The same as `rare_classes` for any number of cells and spellings: the cells of a piece and, of the rest of the key, of a piece
    again bound the files of a class."""
    shares = _shares(spellings, needs)
    asked = shares.join(small_side(covered), ["source", "h"], "left_anti").drop("share")
    full = _full_cells(shares, "source", FULL)

    def able(per: DataFrame) -> DataFrame:
        per = per.groupBy("h").agg(F.sum("share").alias("share"), F.count("*").alias("met"), F.max("need").alias("need"))
        reach = F.col("share") + F.greatest(F.lit(LOOKUPS) - F.col("met"), F.lit(0)) * _light(F.col("need"), FULL)
        return small_side(materialize(per.where(reach >= WHOLE).select("h"), "line-able"), NARROW_ROWS)

    one = able(_all_lookups(asked, "source").join(full, "cell").select("h", "need", "share"))
    again = _all_lookups(asked.join(one, "h", "left_semi"), "source").join(full, "cell")
    again = again.select("h", "need", F.col("cell").alias("one"), "by", F.col("rest").alias("key"), F.col("share").alias("most"))
    cells = small_side(materialize(again.select("one").distinct(), "line-cells"), NARROW_ROWS)
    held = shares.select("share", F.inline(_cells_of_length("source"))).select("share", F.col("cell").alias("one"), F.col("rest").alias("key")).join(cells, "one", "left_semi")
    met = _lookups(again, "one", F.col("by")).join(_full_cells(held, "one", FULL_AGAIN), "cell", "left")
    least = F.sum(F.coalesce("share", _light(F.col("need"), FULL_AGAIN)))
    two = able(met.groupBy("h", "one").agg(F.least(F.max("most"), least).alias("share"), F.max("need").alias("need")))
    return class_members(spellings, materialize(spellings.join(two, "h", "left_semi").select("source", "h", "key"), "line-rare-keys"))


class State(NamedTuple):
    """What is kept between partitions, as written tables."""

    lines: DataFrame  #: folded_lines of the partitions so far
    sources: DataFrame  #: (source, fh)
    files: DataFrame  #: (source, h, fh) of each spelling
    spellings: DataFrame  #: (source, h, key, n)
    keys: DataFrame  #: (source, h, key) of each spelling that ever stood for a class
    near: DataFrame  #: (source, h, anchor) of each spelling within reach of one of these
    crossed: DataFrame  #: (source, h): spellings to be removed


def advance(before: State | None, chunks: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "issuer", file_col: str = "file", rare: bool = False) -> State:
    """The state after a partition of chunks; None is the empty state. `rare`: also the classes without an anchor.

    A spelling becomes an anchor only by a new file, so its key is in the delta; earlier spellings are read again only for
    the anchors that are new."""
    lines = materialize(folded_lines(chunks, id_col, text_col, source_col, file_col), "lines")
    sources, files = source_files(chunks, source_col, file_col), line_files(lines)
    fresh_spellings = spellings = materialize(spelt(lines), "line-spellings")
    if before is not None:
        sources, files = merge_line_files(before.sources, sources), merge_line_files(before.files, files)
        spellings = before.spellings.unionByName(spellings).groupBy("source", "h", "key").agg(F.sum("n").alias("n"))
        spellings = materialize(spellings, "line-spellings")
    sources, files = materialize(sources, "line-sources"), materialize(files, "line-files")
    needs = materialize(source_needs(sources), "line-needs")
    top = materialize(anchors(files, needs), "line-anchors")
    keys = fresh_spellings.join(small_side(top), ["source", "h"], "left_semi").select("source", "h", "key")
    if before is None:
        keys = materialize(keys, "line-anchor-keys")
        near = class_members(spellings, keys)
    else:
        fresh = materialize(keys.join(before.keys, ["source", "h"], "left_anti"), "line-new-keys")
        keys = materialize(before.keys.unionByName(fresh), "line-anchor-keys")
        near = class_members(fresh_spellings, keys).unionByName(class_members(before.spellings, fresh)).unionByName(before.near).distinct()
        lines = before.lines.unionByName(lines)
    near = materialize(near, "line-classes")
    now = near.join(small_side(top.select("source", F.col("h").alias("anchor"))), ["source", "anchor"], "left_semi")
    crossed = materialize(crossed_spellings(now, files, needs), "lines-crossed")
    if rare:
        judged = materialize(crossed.unionByName(top.select("source", "h")).distinct(), "lines-judged")
        more = materialize(rare_classes(spellings, judged, needs), "line-rare")
        crossed = materialize(crossed.unionByName(crossed_spellings(more, files, needs)).distinct(), "lines-crossed")
    return State(lines, sources, files, spellings, keys, near, crossed)


def crossed_spellings(near: DataFrame, files: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, h): the spellings of classes that occur in as many files as needed. `near`: (source, h, anchor), a written table."""
    of_class = small_side(near).join(files, ["source", "h"]).select("source", "anchor", "fh").distinct()
    big = of_class.groupBy("source", "anchor").agg(F.count("fh").alias("n")).join(small_side(needs), "source").where(F.col("n") >= F.col("need"))
    return near.join(small_side(materialize(big.select("source", "anchor"), "line-big")), ["source", "anchor"], "left_semi").select("source", "h").distinct()


def found_lines(state: State) -> DataFrame:
    """(rec, line_no): the lines to be removed from each record so far."""
    return state.lines.join(small_side(state.crossed), ["source", "h"], "left_semi").select("rec", "line_no").distinct()


def recurring_lines(chunks: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "issuer", file_col: str = "file", rare: bool = False) -> DataFrame:
    """(rec, line_no): the lines to be removed from each record."""
    return found_lines(advance(None, chunks, id_col, text_col, source_col, file_col, rare))


def newly_crossed(before: State | DataFrame, after: State | DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """(source, h): spellings at or over the threshold in the state `after` but not in `before`; with the states changed over,
    those that fell below it. Of plain tables (source, h, fh) with `needs` each spelling is a class of its own."""
    def over(state: State | DataFrame) -> DataFrame:
        if isinstance(state, State):
            return state.crossed
        n = state.groupBy("source", "h").agg(F.count("fh").alias("n"))
        return n.join(needs, "source").where(F.col("n") >= F.col("need")).select("source", "h")

    return over(after).join(over(before), ["source", "h"], "left_anti")


def affected(lines: DataFrame, crossed: DataFrame) -> DataFrame:
    """(rec): the records to be rebuilt."""
    return lines.join(crossed, ["source", "h"], "left_semi").select("rec").distinct()


def to_rebuild(before: State, after: State) -> DataFrame:
    """(rec): the records of earlier partitions whose lines to be removed changed."""
    return affected(before.lines, newly_crossed(before, after).unionByName(newly_crossed(after, before)))


def without_lines(chunks: DataFrame, found: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`chunks` with the found lines taken out of the text; rows without any are unchanged (a null text stays null)."""
    gone = found.groupBy(F.col("rec").alias("_rec")).agg(F.collect_set("line_no").alias("_gone"))
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    j = chunks.join(gone, F.col(id_col) == F.col("_rec"), "left")
    return j.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).drop("_gone", "_rec")
