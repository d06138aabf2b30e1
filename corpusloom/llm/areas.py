"""Problem 10: the subject areas of each document.

The areas are those of the table of areas. The lexicon is learned: of the word sequences (up to GRAM words) in labelled documents
those stay that occur with one area far more often than chance allows. Labelling functions vote on each sentence: the lexicon
(several words in sequence, several words of the area, one word), the address (URL), the section (title) and the source (areas that
its labelled documents favour). A latent model learns how accurate each function is from the counts of vote patterns in all
documents (EM, starting from the votes of word sequences), and a sentence treats an area if its posterior probability is at
least one half. A document has the areas of at least `SHARE` of its sentences.

The lexicon is fitted on at most FIT_DOCS labelled documents, those of the smallest hashes, each text once; all else is counted over
all documents.

Defined cases: null and blank texts give no row; a null title, url or source is no vote; repeated ids count once; ties
at exactly the share count in; without labels only the names of the areas make up the lexicon. Whole texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side
from .forms import fold_table, joined

SHARE = 0.25
ROUNDS = 30
#: A source favours an area if the area's share of its labelled documents is this many times its share of all of them.
FAVOURED = 2.0

#: Labelled documents of which the lexicon is fitted; words in a sequence; documents in which it must occur; the least share of them
#: with its area; and the least logarithm of how unlikely the share is by chance.
FIT_DOCS, GRAM, LEAST_DOCS, LEAST_PURE, SURPRISE = 4_000, 4, 3, 0.5, 8.0
#: A single word counts from this length.
WORD_CHARS = 5
TERM, WORDS, WORD = 3, 2, 1
Lexicon = dict[str, tuple[str, int]]
_word = re.compile(r"[^\W\d_]+")
_ends = re.compile(r"[.!?؟](?=\s|$)")


@lru_cache(1)
def _plain() -> dict[int, str]:
    """Folds case, accents and odd characters, but keeps one blank for each blank."""
    t = {ord(a): b if b or not a.isspace() else " " for a, b in fold_table().items() if b != "0"}
    return t | {ord(a): b.lower() for a, b in joined().items()}


#: Marks of characters that fold to none or to several, beyond all characters.
_NONE, _SEVERAL = 0x110000, 0x110001


@lru_cache(1)
def _plain_codes() -> np.ndarray:
    """`_plain` by character number."""
    codes = np.arange(_NONE, dtype="<u4")
    for c, to in _plain().items():
        codes[c] = ord(to) if len(to) == 1 else _SEVERAL if to else _NONE
    return codes


def fold(text: str) -> str:
    if len(text) < 100 or text.isascii():
        return text.translate(_plain())
    codes = _plain_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    most = codes.max()
    if most == _SEVERAL:
        return text.translate(_plain())
    return (codes[codes < _NONE] if most == _NONE else codes).tobytes().decode("utf-32-le", "surrogatepass")


def _sequences(sentence: str) -> set[str]:
    """The words (of WORD_CHARS letters) and the sequences of 2 to GRAM words of a folded sentence, as they stand there; nothing but
    blanks, apostrophes and hyphens may lie between the words."""
    out = set()
    spans = [m.span() for m in _word.finditer(sentence)]
    run = 0  # words before this one that it follows directly
    for k, (a, b) in enumerate(spans):
        run = run + 1 if k and not sentence[spans[k - 1][1] : a].strip(" '-") else 0
        if b - a >= WORD_CHARS:
            out.add(sentence[a:b])
        for n in range(1, min(run, GRAM - 1) + 1):
            out.add(sentence[spans[k - n][0] : b])
    return out


def labelled_docs(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, text, title, url, source, areas): at most `fit_docs` labelled documents with text, each text once."""
    of = labels.where(F.col("doc_id").isNotNull() & F.col("area").isNotNull()).groupBy("doc_id").agg(F.collect_set("area").alias("areas"))
    of = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    d = docs.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "title", "url", "source")
    return d.join(F.broadcast(materialize(of, "area-labels")), "doc_id").dropDuplicates(["text"])  # at most fit_docs rows


def learned_lexicon(labelled: DataFrame, areas: list[str]) -> Lexicon:
    """The area and the number of words of each sequence that tells an area. `labelled`: as labelled_docs, a written table."""
    known = {a: k for k, a in enumerate(areas)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, flags = [], []
            for text, title, source, of in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                body = _running_text(text, title or "", source or "")
                bits = sum(1 << known[a] for a in of if a in known)
                own = set().union(*map(_sequences, _ends.split(body)))
                seqs += own
                flags += [bits] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(flags, pa.int64())], ["seq", "bits"])

    n = labelled.count()
    if not n or not areas:
        return {}
    bit = [F.shiftright("bits", k).bitwiseAND(F.lit(1)) for k in range(len(areas))]
    base = labelled.agg(*[F.avg(F.array_contains("areas", a).cast("double")).alias(f"a{k}") for k, a in enumerate(areas)]).first()
    per = labelled.select("text", "title", "source", "areas").mapInArrow(run, "seq string, bits bigint").groupBy("seq").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"n{k}") for k, x in enumerate(bit)])
    per = per.where(F.col("n") >= LEAST_DOCS)
    options = []
    for k in range(len(areas)):
        q = min(max(base[f"a{k}"] or 0.0, 0.5 / n), 1 - 0.5 / n)
        p = F.col(f"n{k}") / F.col("n")
        kl = F.col("n") * (p * F.log(F.greatest(p, F.lit(1e-9)) / q) + (1 - p) * F.log(F.greatest(1 - p, F.lit(1e-9)) / (1 - q)))
        options.append(F.struct(F.when((p > q) & (p >= LEAST_PURE), kl).otherwise(0.0).alias("kl"), F.lit(k).alias("k")))
    best = per.select("seq", F.array_max(F.array(*options)).alias("b")).where(F.col("b.kl") >= SURPRISE).select("seq", "b.k")
    return {r["seq"]: (areas[r["k"]], len(_word.findall(r["seq"]))) for r in best.collect()}  # of a bounded number of documents


def named_lexicon(subject_areas: DataFrame) -> Lexicon:
    """The words of the areas' own names that only one area has. `subject_areas`: area, label_fr, label_en; a table of areas."""
    owners: dict[str, set[str]] = defaultdict(set)
    for r in subject_areas.where(F.col("area").isNotNull()).select("area", "label_fr", "label_en").distinct().collect():
        for name in (r["label_fr"], r["label_en"]):
            for w in _word.findall(fold(name or "")):
                if len(w) >= WORD_CHARS:
                    owners[w].add(r["area"])
    return {w: (next(iter(own)), 1) for w, own in owners.items() if len(own) == 1}


def needed(lexicon: Lexicon) -> Lexicon:
    """The lexicon without sequences that hold a shorter sequence of several words of the same area: wherever they stand, that one
    stands too, in the same sentence, with the same vote."""
    out = {}
    for seq, (area, words) in lexicon.items():
        spans = [m.span() for m in _word.finditer(seq)]
        parts = (seq[a:b] for k, (a, _) in enumerate(spans) for _, b in spans[k + 1 :] if b - a < spans[-1][1] - spans[0][0])
        if words < 2 or not any(p in lexicon and lexicon[p][0] == area and lexicon[p][1] > 1 for p in parts):
            out[seq] = area, words
    return out


class Matcher:
    """Finds the sequences of a lexicon in folded texts, without those that aren't `needed`."""

    def __init__(self, lexicon: Lexicon, areas: list[str]):
        self.number = {a: k for k, a in enumerate(areas)}
        self.automaton = ahocorasick.Automaton()
        for seq, (area, words) in needed(lexicon).items():
            self.automaton.add_word(seq, (len(seq), self.number[area], TERM if words > 1 else WORD, seq))
        if lexicon:
            self.automaton.make_automaton()
        self.empty = not lexicon

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """(end, area, kind, sequence) of each whole-word match."""
        for end, (n, k, kind, seq) in () if self.empty else self.automaton.iter(text):
            start = end - n + 1
            if (start and text[start - 1].isalpha() and text[start - 1] != "و") or (end + 1 < len(text) and text[end + 1].isalpha()):
                continue
            yield end, k, kind, seq

    def named(self, text: str) -> set[int]:
        """The areas of the sequences of several words."""
        return {k for _, k, kind, _ in self(fold(text)) if kind == TERM}


def _names(line: str, source: str) -> bool:
    """Whether the line holds the source's name as a word."""
    i = line.find(source)
    return i >= 0 and not line[i - 1 : i].isalnum() and not line[i + len(source) : i + len(source) + 1].isalnum()


def _running_text(text: str, title: str, source: str) -> str:
    """The lines of the document without its title and without lines of the site, joined to one line."""
    kept = []
    t, s = fold(title).strip() if title else "", fold(source) if source else ""
    for line in fold(text).split("\n"):
        x = line.strip()
        if not x or x == t or (len(s) > 3 and _names(x, s)) or x.count("|") > 1:
            continue
        if kept and kept[-1][-1] in "-¬" and kept[-1][-2:-1].isalpha():
            kept[-1] = kept[-1][:-1] + x
        else:
            kept.append(x)
    return " ".join(" ".join(kept).split())


def votes(find: Matcher, text: str, title: str | None, url: str | None, source: str | None) -> tuple[int, Counter]:
    """(sentences, Counter of (area, lexicon, address, section) over sentences with any vote)."""
    body = _running_text(text, title or "", source or "")
    stops = [m.end() for m in _ends.finditer(body)]
    if not stops or len(body[stops[-1] :].split()) >= 5:
        stops.append(len(body) + 1)
    at: dict[tuple[int, int], str | int] = {}  # the one word seen so far, or WORDS or TERM
    last, i = len(stops) - 1, 0
    stop = stops[0]
    for end, k, kind, seq in find(body):  # in the order of their ends
        if end >= stop:
            i = bisect_left(stops, end + 1, i)
            if i > last:
                break
            stop = stops[i]
        if kind == TERM:
            at[i, k] = TERM
        elif (seen := at.setdefault((i, k), seq)) != seq and seen != TERM:
            at[i, k] = WORDS
    address = find.named(unquote(url or "").replace("-", " "))
    section = find.named(title or "")
    out: Counter = Counter()
    for (_, k), seen in at.items():
        out[k, seen if seen in (TERM, WORDS) else WORD, k in address, k in section] += 1
    for k in address | section:
        if silent := len(stops) - sum(n for (a, *_), n in out.items() if a == k):
            out[k, 0, k in address, k in section] += silent
    return len(stops), out


_matchers: dict[int, Matcher] = {}


def document_votes(docs: DataFrame, lexicon: Lexicon, areas: list[str]) -> DataFrame:
    """(doc_id, source, sentences, area, lexicon, address, section, n): the pattern counts of each document; area null
    for a document without any vote."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((hash((tuple(sorted(lexicon.items())), tuple(areas))), lexicon, areas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lex, names = shared.value
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(lex, names)
        find = _matchers[key]
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            ids, texts, titles, urls, sources = (c.to_pylist() for c in b.columns)
            for doc, text, title, url, source in zip(ids, texts, titles, urls, sources, strict=True):
                n, out = votes(find, text, title, url, source)
                rows = [(names[k], lex_, ad, se, m) for (k, lex_, ad, se), m in out.items()] or [(None, 0, False, False, 0)]
                for r in rows:
                    for c, v in zip(cols, (doc, source, n, *r), strict=True):
                        c.append(v)
            types = [b.column(0).type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "source", "sentences", "area", "lexicon", "address", "section", "n"])

    d = docs.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "title", "url", "source")
    return d.mapInArrow(run, f"doc_id {kind}, source string, sentences int, area string, lexicon int, address boolean, section boolean, n int")


def favoured(labelled: DataFrame) -> DataFrame:
    """(source, area, favours): the areas that the labelled documents of a source favour, whatever their texts say."""
    n = labelled.count()
    t = labelled.where(F.col("source").isNotNull()).select("source", F.explode("areas").alias("area"))
    per_source = labelled.groupBy("source").agg(F.count("*").alias("of_source"))
    per_area = t.groupBy("area").agg(F.count("*").alias("of_area"))
    j = t.groupBy("source", "area").agg(F.count("*").alias("n")).join(per_source, "source").join(per_area, "area")  # of FIT_DOCS rows
    return j.where((F.col("n") >= 2) & (F.col("n") / F.col("of_source") >= FAVOURED * F.col("of_area") / max(1, n))).select("source", "area", F.lit(True).alias("favours"))


#: What is believed of the lexicon before any counts: the shares of its votes where the area is and isn't treated. The belief weighs
#: as much as all the sentences that a sequence votes for, or against: what the model learns is how far the counts depart from it, and
#: how accurate the other functions are.
BELIEF = {TERM: (0.86, 0.002), WORDS: (0.05, 0.001), WORD: (0.04, 0.007), 0: (0.05, 0.99)}


def learn(patterns: dict[tuple, int], silent: int, favoured_silent: int = 0, rounds: int = ROUNDS) -> dict[tuple, float]:
    """The posterior of each vote pattern (lexicon, address, section, source) by EM. The address repeats the section in many
    collections, so the two count as one function of four values; the others are taken as independent given the truth.
    `silent`, `favoured_silent`: sentence-area pairs without any vote, or with that of the source alone."""
    counts = Counter(patterns)
    counts[0, False, False, False] += silent
    counts[0, False, False, True] += favoured_silent
    views = [(p[0], p[1:3], p[3]) for p in counts]
    post = {p: 0.98 if p[0] == TERM else 0.6 if p[0] == WORDS else 0.2 if p[0] == WORD else 0.01 for p in counts}
    everything = max(1, sum(counts.values()))
    named = max(8.0, sum(n for p, n in counts.items() if p[0] == TERM))
    for _ in range(rounds):
        prior = sum(post[p] * n for p, n in counts.items()) / everything
        table = []
        for f in range(3):
            yes: Counter = Counter()
            no: Counter = Counter()
            for p, v in zip(counts, views, strict=True):
                yes[v[f]] += post[p] * counts[p] + 0.5 * (f > 0)
                no[v[f]] += (1 - post[p]) * counts[p] + 0.5 * (f > 0)
            if f == 0:
                for v, (a, b) in BELIEF.items():
                    yes[v] += a * named
                    no[v] += b * everything
            table.append({v: (yes[v] / yes.total(), no[v] / no.total()) for v in yes})
        for p, v in zip(counts, views, strict=True):
            a, b = prior, 1 - prior
            for f in range(3):
                ya, nb = table[f][v[f]]
                a, b = a * ya, b * nb
            post[p] = a / (a + b) if a + b else 0.0
    return post


def document_areas(docs: DataFrame, subject_areas: DataFrame, subject_labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, area, share): the areas of at least SHARE of each document's sentences."""
    areas = sorted(r["area"] for r in subject_areas.where(F.col("area").isNotNull()).select("area").distinct().collect())
    labelled = materialize(labelled_docs(docs, subject_labels, fit_docs), "area-labelled")
    lexicon = named_lexicon(subject_areas) | learned_lexicon(labelled, areas)
    v = materialize(document_votes(docs, lexicon, areas), "area-votes")
    fav = small_side(materialize(favoured(labelled), "area-sources"))
    v = v.join(fav, ["source", "area"], "left").withColumn("favours", F.coalesce("favours", F.lit(False)))
    features = ["lexicon", "address", "section", "favours"]
    seen = v.where(F.col("area").isNotNull()).groupBy(*features).agg(F.sum("n").alias("n")).collect()  # at most 4 x 2 x 2 x 2 rows
    patterns = {(r["lexicon"], r["address"], r["section"], r["favours"]): r["n"] for r in seen}
    per_source = v.select("doc_id", "source", "sentences").distinct().groupBy("source").agg(F.sum("sentences").alias("sentences"))
    fav_areas = fav.groupBy("source").agg(F.count("*").alias("areas"))
    s = per_source.join(fav_areas, "source", "left").agg(F.sum("sentences").alias("all"), F.sum(F.col("sentences") * F.coalesce("areas", F.lit(0))).alias("favoured")).first()
    favoured_silent = max(0, (s["favoured"] or 0) - sum(n for p, n in patterns.items() if p[3]))
    silent = max(0, (s["all"] or 0) * len(areas) - sum(patterns.values()) - favoured_silent)
    post = learn(patterns, silent, favoured_silent)
    rows = [(*p, x) for p, x in post.items()]
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(rows or [(0, False, False, False, 0.0)], "lexicon int, address boolean, section boolean, favours boolean, p double"))
    sure = v.dropDuplicates(["doc_id", "area", *features]).join(known, features).where(F.col("p") >= 0.5)
    share = sure.groupBy("doc_id", "area", "sentences").agg(F.sum("n").alias("n"))
    return share.where(F.col("n") >= SHARE * F.col("sentences")).select("doc_id", "area", (F.col("n") / F.col("sentences")).alias("share"))


def agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labels, found and both, over the labelled documents. `labels`: doc_id, area; `none` is no area."""
    want = labels.where("area != 'none' AND doc_id IS NOT NULL").select("doc_id", "area").distinct().withColumn("want", F.lit(1))
    got = found.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "area").distinct().withColumn("got", F.lit(1))
    j = want.join(got, ["doc_id", "area"], "full_outer")
    return j.agg(F.count("want").alias("labels"), F.count("got").alias("found"), F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("both"))
