"""Problem 6: the language of files, chunks and single-language stretches, by cross-parsing entropy.

Labelled running text of each language gives a suffix automaton. A sentence is parsed greedily into the longest phrases, blanks
included, that occur in the labelled text; each costs the logarithm of the labelled text's length (the bits that point at a place
in it), so that texts of different length compare. The language of the lowest cost wins, and the confidence is how much lower it
is than the runner-up's. A sentence whose phrases are no longer than those of a text in none of the languages (`KNOWN`
characters) is in no known language. The costs of sentences add up to those of chunks and files, each with its confidence.

The automata are tables (state x letter), and all sentences of an Arrow batch are parsed side by side, one letter of each at a
time. Sentences beyond `LANE` letters are parsed in parts, whatever their length.

The labelled sample is bounded (`SAMPLE` texts of at most `SAMPLE_CHARS` characters per language, those of the smallest hashes;
their distinct sentences up to `LABELLED` letters). Labels are partly wrong: a sentence teaches a language only if most of its
words are about as frequent under its label as under the label where they are most frequent.

Defined cases: null and blank texts have no language; text without letters takes the language before it; unknown labels
and placeholders count as missing; repeated keys count once; ties go to the order fr, ar, en, es.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side
from .budget import language_code
from .forms import joined, print_alike, python_table

LANGS = ("fr", "ar", "en", "es")
COSTS = tuple(f"{k}_cost" for k in LANGS)
SAMPLE, SAMPLE_CHARS, LABELLED = 400, 5_000, 40_000
#: A word belongs to a language's labelled text if seen so often and at this rate of its highest rate under any label; a sentence if
#: this share of its words do.
LEAST_SEEN, LEAST_RATE, OWN_WORDS = 3, 0.25, 0.7
#: A language is reported for a chunk from this share of its words.
SHARE = 0.15
#: Sentences of fewer words, or less clear ones, take the language before them.
SURE_WORDS, SURE = 3, 0.15
#: Characters per phrase below which a sentence of SURE_WORDS words is in none of the languages.
KNOWN = 3.0
#: Letters parsed in one go.
LANE = 256
_run = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"(?<=[.!?؟;])\s+|\n")
#: What ends a sentence before a blank.
_STOPS = ".!?؟;"


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, in the form in which characters that print alike are one; a blank for
    anything else, 0 for characters without ink."""
    out = np.full(0x10000, 32, np.uint16)
    for c in map(chr, range(0x10000)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    for c, to in python_table().items():
        if c < 0x10000:
            out[c] = ord(to[0].lower()) if to and to[0].isalpha() else 32 if to else 0
    for c in joined():
        out[ord(c)] = ord(joined()[c][0].lower())
    return out


class SuffixAutomaton:
    """Recognises every substring of a text."""

    def __init__(self, text: str):
        self.go: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            new = len(self.go)
            self.go.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and ch not in self.go[p]:
                self.go[p][ch] = new
                p = link[p]
            if p >= 0:
                q = self.go[p][ch]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.go)
                    self.go.append(dict(self.go[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = clone
                    while p >= 0 and self.go[p].get(ch) == q:
                        self.go[p][ch] = clone
                        p = link[p]
            last = new

    def phrases(self, text: str) -> int:
        """Longest matches that make up the text; a character never seen is one phrase."""
        n, i = 0, 0
        while i < len(text):
            state, start = 0, i
            while i < len(text) and (nxt := self.go[state].get(text[i])) is not None:
                state, i = nxt, i + 1
            i += i == start
            n += 1
        return n


def plain(text: str) -> str:
    """The letters of a text in the form that is parsed: lower case, anything between words one blank."""
    codes = np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[np.where(codes < 0x10000, codes, 32)]
    x = x[x > 0]
    x = x[(x != 32) | (np.append(32, x[:-1]) != 32)]
    return x.astype("<u2").tobytes().decode("utf-16-le", "surrogatepass").strip(" ")


class Parser:
    """The automata of the labelled texts as one table, and the parse of many sentences side by side."""

    def __init__(self, labelled: dict[str, str]):
        tables, self.symbol, self.base, self.width = [], [], [], []
        self.bits = np.array([np.log2(max(2, len(labelled.get(k, "")))) for k in LANGS])
        at = 0
        for lang in LANGS:
            go = SuffixAutomaton(labelled.get(lang, "")).go
            letters = sorted(go[0])
            number = {c: i + 1 for i, c in enumerate(letters)}
            symbol = np.zeros(0x10000, np.int32)  # 0: a letter never seen
            for c, i in number.items():
                symbol[ord(c)] = i
            w = len(letters) + 1
            t = np.full((len(go) + 1, w), -1, np.int32)  # the last state: after a letter never seen
            for s, moves in enumerate(go):
                for c, to in moves.items():
                    t[s, number[c]] = at + to * w
            tables.append(t.ravel())
            self.symbol.append(symbol)
            self.base.append(at)
            self.width.append(w)
            at += t.size
        self.table = np.concatenate(tables)
        self.dead = np.array([b + len(t) - w for b, t, w in zip(self.base, tables, self.width, strict=True)], np.int32)
        self.root = np.array(self.base, np.int32)

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, start, stop, words, letters, phrases[language]) of every sentence that has a letter: the number of its text, its
        place there (of a text in composed form), and what the parse gives."""
        composed = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
        codes = np.frombuffer("\n".join([*composed, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 0x10000, codes, 0x2022).astype(np.uint16)
        x = _letters()[codes]
        space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
        ends = codes == 10
        ends[1:] |= space[1:] & np.isin(codes[:-1], np.array([ord(c) for c in _STOPS], np.uint16))
        of = np.cumsum(ends) - ends  # an end belongs to the sentence before it
        lengths = np.fromiter(map(len, composed), np.int64, len(composed)) + 1
        first = np.concatenate([[0], np.cumsum(lengths)])
        keep = np.flatnonzero(x)
        y = x[keep]
        s = of[keep]
        fresh = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        blank_before = np.append(True, y[:-1] == 32) | fresh if len(s) else fresh
        word = (y != 32) & blank_before
        kept = (y != 32) | ~blank_before  # one blank between words, none at the beginning
        keep, y, s, word = keep[kept], y[kept], s[kept], word[kept]
        kept = (y != 32) | ~np.append(s[1:] != s[:-1], True) if len(s) else kept[:0]  # nor at the end
        keep, y, s, word = keep[kept], y[kept], s[kept], word[kept]
        if not len(y) or not word.any():
            z = np.zeros(0, np.int64)
            return z, z, z, z, z, np.zeros((0, len(LANGS)), np.int64)
        n = int(s[-1]) + 1
        words = np.bincount(s, word, n).astype(np.int64)
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        ids = s[at]
        size = np.diff(np.append(at, len(s)))
        # lanes of at most LANE letters
        parts = -(-size // LANE)
        lane_of = np.repeat(np.arange(len(ids)), parts)
        nth = np.arange(len(lane_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        lane_at = at[lane_of] + nth * LANE
        lane_len = np.minimum(LANE, size[lane_of] - nth * LANE)
        got = self._parse(y, lane_at, lane_len)
        phrases = np.zeros((len(ids), len(LANGS)), np.int64)
        np.add.at(phrases, lane_of, got)
        has = words[ids] > 0
        start, stop = keep[at], keep[at + size - 1] + 1
        text = np.searchsorted(first, start, "right") - 1
        return text[has], (start - first[text])[has], (stop - first[text])[has], words[ids][has], size[has], phrases[has]

    def _parse(self, y: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases per lane and language."""
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        out = np.zeros((len(LANGS), len(at)), np.int32)
        state = np.repeat(self.dead[:, None], len(at), 1)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        symbols = [s[y] for s in self.symbol]
        for t, n in enumerate(active.tolist()):
            place = at[:n] + t
            for k in range(len(LANGS)):
                c = symbols[k][place]
                to = self.table[state[k, :n] + c]
                miss = np.flatnonzero(to < 0)
                if len(miss):
                    out[k, miss] += 1
                    again = self.table[self.root[k] + c[miss]]
                    to[miss] = np.where(again < 0, self.dead[k], again)
                state[k, :n] = to
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out.T[back]

    def judge(self, text: str) -> tuple[int, int, float]:
        """(words, language, confidence) of a text as a whole; language -1 without words or in none of the languages."""
        _, _, _, words, letters, phrases = self.sentences([text])
        lang, sure = self.decide(words.sum(keepdims=True), letters.sum(keepdims=True), phrases.sum(0, keepdims=True))
        return int(words.sum()), int(lang[0]) if len(words) else -1, float(sure[0]) if len(words) else 0.0

    def decide(self, words: np.ndarray, letters: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language or -1, confidence) per row."""
        cost = phrases * self.bits
        best = cost.argmin(1) if len(cost) else np.zeros(0, np.int64)
        low = np.sort(cost, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sure = np.where(low[:, 1] > 0, 1 - low[:, 0] / low[:, 1], 0.0)
        own = phrases[np.arange(len(best)), best]
        return np.where((words >= SURE_WORDS) & (letters < KNOWN * own), -1, best), sure


_parsers: dict[int, Parser] = {}


def _parser(labelled: dict[str, str]) -> Parser:
    key = hash(tuple(labelled.get(lang, "") for lang in LANGS))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(labelled)
    return _parsers[key]


def labelled_text(texts: DataFrame, sample: int = SAMPLE) -> dict[str, str]:
    """Running text of each language from a bounded sample. `texts`: key, label, text."""
    t = texts.select("key", language_code(F.col("label")).alias("lang"), F.xxhash64("key").alias("h"), "text").where(F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))
    # what can be among the smallest hashes of its language is looked up first, so that no language meets in one task
    some = t.select("key", "lang", "h").withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64)))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "key"))
    ids = some.withColumn("r", within).where(F.col("r") <= sample).select("key", "lang", "h").withColumn("r", rank).where(F.col("r") <= sample).select("key", "lang")
    ids = F.broadcast(materialize(ids.distinct(), "sample"))  # at most `sample` rows a language
    rows = t.join(ids, ["key", "lang"]).select("lang", "key", "text").distinct().orderBy("lang", "key", "text").collect()
    counts: dict[str, Counter] = {lang: Counter() for lang in LANGS}
    spoken: dict[str, dict[str, list[str]]] = {lang: {} for lang in LANGS}
    for r in rows:
        for s in _sentence.split(print_alike(r["text"])):
            words = plain(s).split(" ")
            if words != [""]:
                counts[r["lang"]].update(words)
                spoken[r["lang"]][" ".join(words)] = words
    total = {lang: max(1, c.total()) for lang, c in counts.items()}
    top: Counter = Counter()
    for lang, c in counts.items():
        for w, n in c.items():
            top[w] = max(top[w], n / total[lang])
    out = {}
    for lang, c in counts.items():
        own = {w for w, n in c.items() if n >= LEAST_SEEN and n / total[lang] >= LEAST_RATE * top[w]}
        kept, size = [], 0
        for s, words in spoken[lang].items():
            if size < LABELLED and sum(w in own for w in words) >= OWN_WORDS * len(words):
                kept.append(s)
                size += len(s) + 1
        out[lang] = " ".join(kept)
    return out


def _is_title(line: str, title: set[str]) -> bool:
    if len(title.intersection(line.lower().split())) < 2:
        return False
    words = _run.findall(line.lower())
    return len(words) >= 3 and sum(w in title for w in words) >= 0.7 * len(words)


def _body(text: str | None, title: str | None, gone: list[int] | None) -> str:
    """The text without the lines given and without running titles."""
    if not text:
        return ""
    names = set(_run.findall(title.lower())) if title else set()
    if not names and not gone:
        return text
    out = set(gone or ())
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out and not (names and _is_title(line, names)))


def _spread(text: np.ndarray, words: np.ndarray, lang: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """The language of each sentence: short or unclear ones take that of the sentence before them in their text."""
    first = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    firm = first | (words >= SURE_WORDS) | (sure > SURE)
    return lang[np.maximum.accumulate(np.where(firm, np.arange(len(text)), 0))] if len(text) else lang


def line_languages(chunks: DataFrame, labelled: dict[str, str]) -> DataFrame:
    """(id, fr, ar, en, es, fr_cost, ..): words per language of each row, and what its text costs in each language; the lines
    `gone` and running titles left out. `chunks`: id, text, title, gone."""
    shared = chunks.sparkSession.sparkContext.broadcast(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _parser(shared.value)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                texts = [_body(*x) for x in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
                text, _, _, words, letters, phrases = p.sentences(texts)
                lang = _spread(text, words, *p.decide(words, letters, phrases))
                sums = [np.bincount(text[lang == k], words[lang == k], len(texts)).astype(np.int64) for k in range(len(LANGS))]
                known = lang >= 0
                costs = [np.bincount(text[known], phrases[known, k] * p.bits[k], len(texts)) for k in range(len(LANGS))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums), *map(pa.array, costs)], ["id", *LANGS, *COSTS])

    kinds = ", ".join([f"{k} bigint" for k in LANGS] + [f"{k} double" for k in COSTS])
    return chunks.select("id", "text", "title", "gone").mapInArrow(run, f"id string, {kinds}")


def stretches(chunks: DataFrame, labelled: dict[str, str]) -> DataFrame:
    """(id, stretch, start, stop, lang, words, confidence): maximal runs of sentences of one language, as offsets (of the text in
    composed form); text in none of the languages has a null one."""
    shared = chunks.sparkSession.sparkContext.broadcast(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _parser(shared.value)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                text, start, stop, words, letters, phrases = p.sentences([t or "" for t in part.column(1).to_pylist()])
                lang, sure = p.decide(words, letters, phrases)
                lang = _spread(text, words, lang, sure)
                new = np.append(True, (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])) if len(text) else np.zeros(0, bool)
                of = np.cumsum(new) - 1
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(text)) - 1 if len(head) else head
                n = np.bincount(of, words, len(head)).astype(np.int32)
                mean = np.bincount(of, sure * words, len(head)) / np.maximum(n, 1)
                t = text[head]
                nth = np.arange(len(head)) - np.searchsorted(t, t, "left")
                names = [LANGS[k] if k >= 0 else None for k in lang[head].tolist()]
                cols = [part.column(0).take(pa.array(t)), pa.array(nth.astype(np.int32)), pa.array(start[head].astype(np.int32)), pa.array(stop[last].astype(np.int32)), pa.array(names, pa.string()), pa.array(n), pa.array(np.round(mean, 4))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "stretch", "start", "stop", "lang", "words", "confidence"])

    return chunks.select("id", "text").mapInArrow(run, "id string, stretch int, start int, stop int, lang string, words int, confidence double").dropDuplicates(["id", "stretch"])


def chunk_languages(chunks: DataFrame, labelled: dict[str, str], site_lines: DataFrame | None = None) -> DataFrame:
    """(id, file, label, fr, ar, en, es, fr_cost, .., total): words and costs per language of each chunk, site lines (rec, line_no)
    left out."""
    c = chunks.select("id", "text", "title", "file", "language")
    if site_lines is not None:
        gone = site_lines.groupBy(F.col("rec").alias("r")).agg(F.collect_set("line_no").alias("gone"))
        c = c.join(small_side(materialize(gone, "gone")), F.col("id") == F.col("r"), "left").drop("r")
    else:
        c = c.withColumn("gone", F.lit(None).cast("array<int>"))
    per = line_languages(c, labelled).dropDuplicates(["id"])
    about = chunks.groupBy("id").agg(F.min("file").alias("file"), F.min("language").alias("label"))
    total = sum((F.col(k) for k in LANGS), F.lit(0))
    return about.join(per, "id").withColumn("total", total).withColumn("label", language_code(F.col("label")))


def main_language() -> Column:
    best = F.greatest(*[F.col(k) for k in LANGS])
    out = F.when(F.col("total") == 0, None)
    for k in LANGS:
        out = out.when(F.col(k) == best, k)
    return out


def confidence_of(lang: Column) -> Column:
    """How much less `lang` costs than the best other language; null without a language."""
    out = None
    for k in LANGS:
        rest = F.least(*[F.col(f"{x}_cost") for x in LANGS if x != k])
        own = F.greatest(F.lit(0.0), F.round(1 - F.col(f"{k}_cost") / rest, 4))
        out = F.when(lang == k, own) if out is None else out.when(lang == k, own)
    return out


def assigned(chunks: DataFrame, doc_meta: DataFrame, texts: DataFrame, site_lines: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Every chunk, as chunk_languages with `lang` and `confidence`, and (file, lang, confidence) of every file of either table. Chunks
    and files without words have neither language nor confidence."""
    c = chunk_languages(chunks, labelled_text(texts), site_lines).withColumn("lang", main_language())
    c = materialize(c.withColumn("confidence", confidence_of(F.col("lang"))), "languages")
    sums = [F.sum(k).alias(k) for k in COSTS]
    votes = c.where("total > 0").groupBy("file", "lang").agg(F.count("*").alias("n"), F.sum("total").alias("w"), *sums)
    file = votes.groupBy("file").agg(F.max_by("lang", F.struct("n", "w", "lang")).alias("lang"), *sums)
    file = file.select("file", "lang", confidence_of(F.col("lang")).alias("confidence"))
    every = doc_meta.select("file").unionByName(chunks.select("file")).where(F.col("file").isNotNull()).distinct()
    return c, every.join(file, "file", "left")


def languages(chunks: DataFrame, doc_meta: DataFrame, texts: DataFrame, site_lines: DataFrame | None) -> DataFrame:
    """(level, rec, lang, confidence) of every file and chunk."""
    c, file = assigned(chunks, doc_meta, texts, site_lines)
    c = c.where(F.col("id").isNotNull()).select(F.lit("chunk").alias("level"), F.col("id").alias("rec"), "lang", "confidence")
    return c.unionByName(file.select(F.lit("file").alias("level"), F.col("file").alias("rec"), "lang", "confidence"))


def found(chunks: DataFrame, doc_meta: DataFrame, texts: DataFrame, site_lines: DataFrame | None) -> DataFrame:
    """(level, rec, lang) as TESTDATA.md defines p6_found."""
    c, file = assigned(chunks, doc_meta, texts, site_lines)
    c = c.where("total > 0")
    own = F.coalesce(*[F.when(F.col("label") == k, F.col(k)) for k in LANGS], F.lit(0))
    wrong = F.col("label").isNull() | (F.col("total") - own >= SHARE * F.col("total"))
    langs = F.array_compact(F.array(*[F.when(F.col(k) >= SHARE * F.col("total"), F.lit(k)) for k in LANGS]))
    chunk = c.where(wrong).select(F.lit("chunk").alias("level"), F.col("id").alias("rec"), F.explode(langs).alias("lang"))
    labels = doc_meta.where(F.col("file").isNotNull()).select("file", language_code(F.col("language")).alias("label")).distinct()
    off = labels.join(file.where(F.col("lang").isNotNull()), "file").where(F.col("label").isNull() | (F.col("label") != F.col("lang")))
    return chunk.unionByName(off.select(F.lit("file").alias("level"), F.col("file").alias("rec"), "lang")).distinct()


def labelled_texts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    c = chunks.select(F.col("id").alias("key"), F.col("language").alias("label"), "text")
    return c.unionByName(documents.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("label"), "text"))
