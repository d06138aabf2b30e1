"""Problem 2: noise in text from scanned pages.

An averaged perceptron predicts an edit for each character of a word (keep, delete, replace or insert before) and for each line
end within a word (join, join and keep the hyphen), learned from scanned pages aligned with their correct text. A character edit
is proposed for words that the clean part of the corpus doesn't know, and holds if the edited word is a firm word there. Page
numbers and running titles are lines that look like one (page range, title); a second perceptron, with features of the line's place
(distance from the edges of its page or the next page break, its neighbours), judges whether such a line is furniture; it is
learned from the lines of scanned pages that their correct text doesn't have.

Defined cases: null and empty texts have no noise; without training pages no character is edited, line ends go by the vocabulary
and every line that looks like furniture is; a null title has no running title; null page numbers match no page; repeated keys
count once.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from .areas import fold
from .forms import print_alike
from .lines import without_lines

#: The model is fitted on the pages of at most this many files, those of the smallest hashes.
TRAIN_FILES = 200
EPOCHS = 4
#: A word is firm if seen so often in text that wasn't scanned, whatever the size of the corpus. Up to FIRM_MOST firm words are sent to
#: the workers; more meet the words that each text asks for in a join (`_asked_for`), with the same results.
FIRM_SEEN, FIRM_MOST = 3, 3_000_000
#: The least score over keeping of an edit, by length of the word: below 4 letters, below 6, longer.
LEAST = ((4, 0.0), (6, -1.0), (1 << 30, -3.0))
#: Two edits of one word count as so much less likely than the worse of them, which has this score at least.
TWO, LEAST_TWO = 0.5, -0.5
#: Longer words (codes of thousands of characters) have edits by the million; these are looked at only if a firm word is near.
LONG = 24

_hyphens = "-‐‑¬\xad"
_outer = " \t\r.,;:()[]{}«»“”\"?؟،؛…!|*•–—-‐‑¬\xad"
_pagelike = re.compile(r"^\W*(?:p\.|page|pag\.|pág\.|الصفحة|صفحة|ص)?\s*(\d{1,4}|[٠-٩]{1,4})\s*(?:[/|]\s*(?:\d{1,4}|[٠-٩]{1,4}))?\W*$", re.I)
_endings = re.compile(r"^[\s\d٠-٩—–|\-\[\]().]+|[\s\d٠-٩—–|\-\[\]().]+$")
_reference = re.compile(r"[\s—–|(\[-]*(?:n°\s*)?\d+\s*/\s*\w+\s*/\s*\d+[\s)\]]*$", re.I)
_apart = re.compile(r"['’‘ʼ\-‐‑]")
_lettered = re.compile(r"[^\W\d_]")
_number = re.compile(r"^[\d.,/%°٠-٩٫]+$")


def edit_script(noisy: str, clean: str) -> list[str]:
    """The edit of each character of `noisy` (and of its end): K, D, R<c>, or I<c> before it. Of several characters lost
    at one place the first is given."""
    n, m = len(noisy), len(clean)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n or j == m:
                cost[i][j] = (n - i) + (m - j)
            else:
                cost[i][j] = min(cost[i + 1][j + 1] + (noisy[i] != clean[j]), cost[i + 1][j] + 1, cost[i][j + 1] + 1)
    ops = ["K"] * (n + 1)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and noisy[i] == clean[j] and cost[i][j] == cost[i + 1][j + 1]:
            i, j = i + 1, j + 1
        elif i < n and j < m and cost[i][j] == cost[i + 1][j + 1] + 1:
            ops[i] = "R" + clean[j]
            i, j = i + 1, j + 1
        elif i < n and cost[i][j] == cost[i + 1][j] + 1:
            ops[i] = "D"
            i += 1
        else:
            if ops[i] == "K":
                ops[i] = "I" + clean[j]
            j += 1
    return ops


def _features(word: str, i: int) -> tuple[str, ...]:
    w = f"^^{word}$$"
    a, b, c, d, e = w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4] if i + 4 < len(w) else "$"
    return "c" + c, "l" + b + c, "r" + c + d, "m" + b + c + d, "p" + a + b + c, "s" + c + d + e


class CharacterEditor:
    """An averaged perceptron over the edits of single characters."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.weights = weights or {}
        self.places: dict[str, list[tuple[float, str]]] = {}
        self.inner: dict[str, list[tuple[float, str]]] = {}

    @classmethod
    def fit(cls, pairs: list[tuple[str, str]], line_ends: list[tuple[tuple[str, ...], str]] = (), lines: list[tuple[tuple[str, ...], str]] = (), epochs: int = EPOCHS) -> CharacterEditor:
        """`pairs`: (noisy word, clean word); equal words teach keeping. `line_ends`: features and J (join) or H (join, keep the
        hyphen). `lines`: features and F (furniture) or K."""
        seen = [(_features(a, i), op) for a, b in pairs for i, op in enumerate(edit_script(a, b))]
        return cls(_averaged([*seen, *line_ends, *lines], epochs, cls._best))

    @staticmethod
    def _best(w: dict, feats: tuple[str, ...]) -> str:
        s: dict[str, float] = {"K": 0.0}
        for f in feats:
            if f in w:
                for label, x in w[f].items():
                    s[label] = s.get(label, 0.0) + x
        return max(s, key=lambda k: (s[k], k == "K"))

    def _at(self, word: str, i: int) -> list[tuple[float, str]]:
        """(score over keeping, edit) at one place, best first; places of equal surroundings are worked out once."""
        w = f"^^{word}$$"[i : i + 5]
        known = self.places.get(w)
        if known is None:
            if len(self.places) > 300_000:
                self.places.clear()
                self.inner.clear()
            *near, p, s = _features(word, i)
            wide = [self.weights[f] for f in (p, s) if f in self.weights]
            if wide or (known := self.inner.get(near[-1])) is None:  # few places have a feature wider than their neighbours
                scores: dict[str, float] = {}
                for some in (*[self.weights[f] for f in near if f in self.weights], *wide):
                    for label, x in some.items():
                        scores[label] = scores.get(label, 0.0) + x
                keep = scores.pop("K", 0.0)
                known = sorted(((x - keep, label) for label, x in scores.items()), reverse=True)
                if not wide:
                    self.inner[near[-1]] = known
            self.places[w] = known
        return known

    def _edits(self, word: str, places: Iterable[int], least: float) -> list[tuple[float, int, str, int]]:
        """(score, place, edit, sequences of three letters that it touches) of the edits of at least the score `least`."""
        out = []
        for i in places:
            for x, label in self._at(word, i):
                if x < least:
                    break
                out.append((x, i, label, (0b111 if label[0] != "I" else 0b11) << i >> 1))
        return out

    def prefers(self, feats: tuple[str, ...], a: str, b: str) -> float | None:
        """The score of label a over b; None if nothing was learned about either."""
        known = [self.weights[f] for f in feats if f in self.weights]
        if not any(a in w or b in w for w in known):
            return None
        return sum(w.get(a, 0.0) - w.get(b, 0.0) for w in known)

    def proposals(self, word: str, least: float, threes: set[str] | None = None) -> list[tuple[float, str]]:
        """Words that one edit of at least the score `least`, or two edits of at least LEAST_TWO, make of this one, best first.
        `threes`: the only sequences of three letters that the result may have, with ^ and $ at its ends; edits that leave
        another one untouched are passed over."""
        p = f"^{word}$"
        bad = sum(1 << i for i in range(len(p) - 2) if p[i : i + 3] not in threes) if threes is not None else 0
        low = bad & -bad
        if bad & ~(low * 0b111) and (rest := bad & ~(low * 0b111)) & ~((rest & -rest) * 0b111):
            return []  # an edit touches three neighbouring sequences at most, so two don't reach all of these
        if low:  # one edit at least touches the first of them; without one that may be of two, other places don't matter
            at = low.bit_length() - 1
            edits = [e for e in self._edits(word, range(max(0, at - 1), min(len(word), at + 1) + 1), least) if e[3] & low]
            if any(e[0] >= LEAST_TWO for e in edits):
                edits = self._edits(word, range(len(word) + 1), least)
        else:
            edits = self._edits(word, range(len(word) + 1), least)
        found = [(s, apply_edits(word, [(i, op)])) for s, i, op, touched in edits if not bad & ~touched]
        both = [e for e in edits if e[0] >= max(LEAST_TWO, least)]
        for x, (s1, i1, o1, t1) in enumerate(both):
            if not low or t1 & low:
                for y, (s2, i2, o2, t2) in enumerate(both):
                    if i1 != i2 and not bad & ~(t1 | t2) and (x < y or (low and not t2 & low)):
                        found.append((min(s1, s2) - TWO, apply_edits(word, [(i1, o1), (i2, o2)])))
        found.sort(reverse=True)
        return found


def _averaged(seen: list[tuple[tuple[str, ...], str]], epochs: int, best) -> dict[str, dict[str, float]]:
    """The averaged weights of a perceptron over (features, label)."""
    w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    total: dict[tuple[str, str], float] = defaultdict(float)
    since: dict[tuple[str, str], int] = defaultdict(int)
    t = 0
    for _ in range(epochs):
        for feats, op in seen:
            t += 1
            got = best(w, feats)
            if got != op:
                for f in feats:
                    for label, by in ((op, 1.0), (got, -1.0)):
                        k = (f, label)
                        total[k] += (t - since[k]) * w[f][label]
                        since[k] = t
                        w[f][label] += by
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for (f, label), x in total.items():
        mean = (x + (t - since[f, label]) * w[f][label]) / max(1, t)
        if abs(mean) > 1e-4:
            out[f][label] = round(mean, 5)
    return dict(out)


def join_features(left: str, right: str, firm) -> tuple[str, ...]:
    """Of a line end within a word: the letters beside it, and which of the halves, the whole and the spelling with a hyphen are known."""
    known = "".join(str(int(x in firm)) for x in (left, right, left + right, f"{left}-{right}"))
    return f"j{known}", f"jl{left[-2:]}", f"jr{right[:2]}", f"js{min(len(left), 4)}{min(len(right), 4)}", "j"


def place_features(lines: list[str], i: int, kind: str, alike: set[int]) -> tuple[str, ...]:
    """Of a line that looks like furniture: its place from the top and the bottom of its page, as far as that is seen (the edges
    of the text, or another such line), and what stands before and after it. `alike`: the lines that look like furniture."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    at = full.index(i)
    up, down = min(at, 3), min(len(full) - 1 - at, 3)
    before = lines[full[at - 1]].rstrip() if at else ""
    after = lines[full[at + 1]].strip() if at + 1 < len(full) else ""
    beside = sum(full[k] in alike for k in (at - 1, at + 1) if 0 <= k < len(full))
    blank = int(i > 0 and not lines[i - 1].strip()) + 2 * int(i + 1 < len(lines) and not lines[i + 1].strip())
    runs_on = int(bool(before) and before[-1] not in ".!?:;؟") + 2 * int(after[:1].islower())
    return f"f{kind}", f"fu{kind}{up}", f"fd{kind}{down}", f"fb{kind}{beside}", f"fe{kind}{blank}", f"fr{kind}{runs_on}"


def apply_edits(word: str, edits: list[tuple[int, str]]) -> str:
    for i, op in sorted(edits, reverse=True):
        word = word[:i] + (word[i + 1 :] if op == "D" else op[1:] + word[i + 1 :] if op[0] == "R" else op[1:] + word[i:])
    return word


def words_of(line: str) -> list[str]:
    """The words of a line in the form of the vocabulary: without outer punctuation, elisions and hyphens taken apart."""
    out = []
    for token in print_alike(line).lower().split():
        t = token.strip(_outer)
        if t and "/" not in t and not _number.match(t):
            out += [p for p in _apart.split(t) if p and _lettered.search(p)]
    return out


@lru_cache(100_000)
def _words_of_token(token: str) -> tuple[str, ...]:
    return tuple(words_of(token))


def _first_token(line: str) -> str:
    """The first of print_alike(line).lower().split(), or an empty text."""
    return next((x[0] for t in line.split() if (x := print_alike(t).lower().split())), "")


def _last_token(line: str) -> str:
    """The last of print_alike(line).lower().split(); there is one."""
    return next(x[-1] for t in reversed(line.split()) if (x := print_alike(t).lower().split()))


def aligned_words(scanned: str, native: str) -> list[tuple[str, str]]:
    """Pairs of words of a scanned page and its correct text, by aligning the two lists of words."""
    from difflib import SequenceMatcher

    joined = re.sub(rf"(?<=[^\W\d_])[{_hyphens}]\n(?=[^\W\d_])", "", scanned)
    a, b = words_of(joined), words_of(native)
    out = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [(w, w) for w in a[i1:i2]]
        elif tag == "replace" and i2 - i1 == j2 - j1:
            out += [(x, y) for x, y in zip(a[i1:i2], b[j1:j2], strict=True) if abs(len(x) - len(y)) <= 2]
    return out


def _line_ends(scanned: str, native: str, firm) -> list[tuple[tuple[str, ...], str]]:
    """The line ends within words of a page, with what its correct text makes of them."""
    whole = set(words_of(native))
    spelled = {t.lower().strip(_outer) for t in print_alike(native).split()}
    out = []
    for a, b in zip((lines := scanned.split("\n")), lines[1:], strict=False):
        if halves := _halves(a.rstrip(), b):
            left, right = halves
            label = "J" if left + right in whole else "H" if any(x.endswith(f"{left}-{right}") for x in spelled) else None
            if label:
                out.append((join_features(left, right, firm), label))
    return out


def _halves(line: str, after: str) -> tuple[str, str] | None:
    """The two parts of a word that the end of a line divides."""
    if not line or line[-1] not in _hyphens or not line[-2:-1].isalpha():
        return None
    right = _first_token(after).rstrip(_outer)
    left = _last_token(line[:-1]).lstrip(_outer)
    return (_apart.split(left)[-1], _apart.split(right)[0]) if right and right[0].isalpha() else None


def _furniture(pages: list[tuple[int, str, str]], title: str | None) -> list[tuple[tuple[str, ...], str]]:
    """The lines of a file's pages (page, scanned, native) that look like furniture, and whether the correct text has them."""
    r = Reader({}, {})
    out = []
    for page, scanned, native in pages:
        lines = scanned.split("\n")
        look = {i: k for i, x in enumerate(lines) if x.strip() and (k := r.looks(lines, i, title, page, page))}
        has = {fold(x).strip() for x in native.split("\n")}
        out += [(place_features(lines, i, k, set(look)), "K" if fold(lines[i]).strip() in has else "F") for i, k in look.items()]
    return out


def train(ocr_payload: DataFrame, native_pages: DataFrame, doc_meta: DataFrame | None = None, files: int = TRAIN_FILES, half: int | None = None) -> CharacterEditor:
    """The editor fitted on the pages of at most `files` files; with `half` (0 or 1) of the files of that half only."""
    chosen = ocr_payload.select("file").where(F.col("file").isNotNull()).distinct()
    if half is not None:
        chosen = chosen.where(F.pmod(F.xxhash64("file"), F.lit(2)) == half)
    chosen = F.broadcast(materialize(chosen.orderBy(F.xxhash64("file"), "file").limit(files), "train-files"))
    pages = ocr_payload.join(chosen, "file").select("file", F.explode("pages").alias("p")).select("file", F.col("p.page").alias("page"), F.col("p.text").alias("scanned"))
    native = native_pages.join(chosen, "file").select("file", "page", F.col("text").alias("native"))
    rows = pages.join(native, ["file", "page"]).where(F.col("scanned").isNotNull() & F.col("native").isNotNull()).dropDuplicates(["file", "page"]).orderBy("file", "page").collect()
    titles = {r["file"]: r["title"] for r in doc_meta.join(chosen, "file").groupBy("file").agg(F.min("title").alias("title")).collect()} if doc_meta is not None else {}
    seen: Counter = Counter()
    words: Counter = Counter()
    of: dict[str, list] = defaultdict(list)
    for r in rows:
        seen.update(aligned_words(r["scanned"], r["native"]))
        words.update(words_of(r["native"]))
        words.update(t for x in print_alike(r["native"]).lower().split() if "-" in (t := x.strip(_outer)))
        of[r["file"]].append((r["page"], r["scanned"], r["native"]))
    ends = [x for r in rows for x in _line_ends(r["scanned"], r["native"], words)]
    lines = [x for f, p in of.items() for x in _furniture(p, titles.get(f))]
    # each pair once or, if it is frequent, a few times: the model learns confusions, not word counts
    return CharacterEditor.fit([p for p, n in sorted(seen.items()) for _ in range(1 if p[0] == p[1] else min(n, 3))], ends, lines)


def clean_words(texts: DataFrame) -> DataFrame:
    """(word, n): the words of texts that weren't scanned, counted per batch first. `texts`: text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: Counter = Counter()
            for t in b.column(0).to_pylist():
                raw.update(t.split())
            c: Counter = Counter()
            for token, n in raw.items():
                for w in words_of(token):
                    c[w] += n
                t = print_alike(token).lower().strip(_outer)
                if "-" in t:
                    c[t] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    counted = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def firm_words(counts: DataFrame) -> DataFrame:
    """(word, n): words frequent enough to be correct."""
    return counts.where(F.col("n") >= FIRM_SEEN)


def sequences(firm: DataFrame) -> DataFrame:
    """(three): the sequences of three letters of the firm words, ^ and $ at their ends. They are bounded by the alphabets."""
    p = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    return firm.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))).alias("three")).distinct()


class Reader:
    """Judges the lines of scanned texts."""

    def __init__(self, weights: dict, firm: dict[str, int], threes: set[str] | None = None):
        self.editor, self.firm = CharacterEditor(weights), firm
        self.threes = {p[i : i + 3] for w in firm for p in (f"^{w}$",) for i in range(len(p) - 2)} if threes is None else threes
        #: The long firm words by length, where all firm words are known.
        self.long: dict[int, list[str]] | None = defaultdict(list) if threes is None else None
        for w in firm if threes is None else ():
            if len(w) >= LONG - 1:
                self.long[len(w)].append(w)
        self.fixed: dict[str, str | None] = {}
        self.tokens: dict[str, int] = {}
        self.plain: set[str] = set()  # tokens of 0 in `tokens`
        self.titles: dict[str, tuple[str, set, set]] = {}
        self.headers: dict[tuple[str, str], bool] = {}

    def fix(self, word: str) -> str | None:
        """The firm word that the editor makes of an unknown word, if any."""
        if word in self.firm:
            return None
        if word not in self.fixed:
            if len(self.fixed) > 300_000:
                self.fixed.clear()
            self.fixed[word] = self._fix(word)
        return self.fixed[word]

    def _fix(self, word: str) -> str | None:
        if len(word) < 2 or not self.editor.weights:
            return None
        if len(word) > LONG and self.long is not None and not any(_near(word, w, 2) for n in range(len(word) - 2, len(word) + 3) for w in self.long.get(n, ())):
            return None
        least = next(x for n, x in LEAST if len(word) < n)
        return next((w for _, w in self.editor.proposals(word, least, self.threes) if len(w) > 1 and w in self.firm), None)

    def is_header(self, line: str, title: str | None) -> bool:
        """The running title, whole or shortened, perhaps with a page number or the reference."""
        if not title:
            return False
        known = self.titles.get(title)
        if known is None:
            if len(self.titles) > 20_000:
                self.titles.clear()
            t = fold(title)
            known = self.titles[title] = ("".join(t.split()), {w for w in re.findall(r"\w+", t) if len(w) > 1}, set(title.lower().split()))
        full, words, tokens = known
        here = line.lower().split()
        same = len(tokens.intersection(here))
        if same < 2 or same < 0.4 * len(here):  # most lines of the text end here
            return False
        found = self.headers.get((title, line))
        if found is None:  # a running title stands on many pages
            if len(self.headers) > 100_000:
                self.headers.clear()
            found = self.headers[title, line] = self._is_header(line, full, words)
        return found

    @staticmethod
    def _is_header(line: str, full: str, words: set[str]) -> bool:
        flat = fold(line)
        own = [w for w in re.findall(r"\w+", flat) if len(w) > 1 and not w.isdigit()]
        if len(own) < 2:
            return False
        if len(own) >= 4 and sum(w in words for w in own) >= 0.85 * len(own) and not flat.rstrip().endswith("."):
            return True
        whole = _endings.sub("", flat)
        for core in {whole, _reference.sub("", whole)}:
            c = "".join(core.rstrip(".… ").split())
            if len(c) >= 10 and abs(len(c) - len(full[: len(c)])) <= 2 and _near(c, full[: len(c)], max(2, len(c) // 8)):
                return True
        return False

    def page_of(self, line: str, first: int | None, last: int | None) -> bool:
        m = _pagelike.match(line)
        return bool(m) and first is not None and first <= int(m.group(1)) <= (last if last is not None else first)

    def looks(self, lines: list[str], i: int, title: str | None, first: int | None, last: int | None) -> str | None:
        """What kind of furniture the line looks like, by its own text."""
        if first is not None and self.page_of(lines[i], first, last):
            return None if self._in_table(lines, i) else "page"
        return "header" if title and self.is_header(lines[i], title) else None

    def kinds(self, text: str, title: str | None, first: int | None, last: int | None) -> list[tuple[int, str]]:
        lines = text.split("\n")
        look = {i: k for i, x in enumerate(lines) if x.strip() and (k := self.looks(lines, i, title, first, last))}
        out: list[tuple[int, str]] = []
        for i, kind in look.items():
            score = self.editor.prefers(place_features(lines, i, kind, set(look)), "F", "K")
            if score is None or score > 0:
                out.append((i, kind))
        gone = {i for i, _ in out}
        body = [i for i, x in enumerate(lines) if i not in gone and x.strip()]
        cut = False  # whether the line before ends within a word
        for k, i in enumerate(body):
            line = lines[i].rstrip()
            tokens = line.split()
            if cut:  # the halves of a divided word are no words
                tokens = tokens[1:]
            cut = line[-1] in _hyphens and line[-2:-1].isalpha()
            if cut:
                if self.divided(line, lines[body[k + 1]] if k + 1 < len(body) else ""):
                    out.append((i, "hyphen"))
                tokens = tokens[:-1]
            if self.misread(tokens):
                out.append((i, "char"))
        return out

    @staticmethod
    def _in_table(lines: list[str], i: int) -> bool:
        near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        return any(re.fullmatch(r"[\W\d]*\d[\W\d]*", x) for x in near)

    def divided(self, line: str, after: str) -> bool:
        """Whether the hyphen at the end stands only for the line end."""
        left = _last_token(line[:-1]).lstrip(_outer)
        right = _first_token(after).rstrip(_outer)
        if not right or not right[0].isalpha():
            return not right
        half = _apart.split(left)[-1]
        score = self.editor.prefers(join_features(half, _apart.split(right)[0], self.firm), "J", "H")
        if score:
            return score > 0
        whole = self.firm.get(half + _apart.split(right)[0], 0)
        kept = self.firm.get(f"{left.split(chr(39))[-1]}-{right}", 0) + self.firm.get(f"{half}-{_apart.split(right)[0]}", 0)
        return whole >= kept if whole or kept else half not in self.firm or _apart.split(right)[0] not in self.firm

    def _judge(self, token: str) -> int:
        """0: only firm words, numbers and the like; 1: a misread word; 2: an unknown word."""
        unknown = [w for w in words_of(token) if w not in self.firm]
        return 0 if not unknown else 1 if any(map(self.fix, unknown)) else 2

    def misread(self, tokens: list[str]) -> bool:
        """Whether a word is misread, or is a firm word only together with its neighbour."""
        if self.plain.issuperset(tokens):
            return False
        known = self.tokens
        judged = list(map(known.get, tokens))
        if None in judged:
            if len(known) > 500_000:
                known.clear()
                self.plain.clear()
            for t in tokens:
                if t not in known:
                    known[t] = self._judge(t)
                    if not known[t]:
                        self.plain.add(t)
            judged = [known[t] if t in known else self._judge(t) for t in tokens]
        if not any(judged):
            return False
        if 1 in judged:
            return True
        for k, j in enumerate(judged):
            if j:
                for a, b in ((k - 1, k), (k, k + 1)):
                    if a >= 0 and b < len(tokens) and self._one_word(tokens[a], tokens[b]):
                        return True
        return False

    def _one_word(self, a: str, b: str) -> bool:
        x, y = _words_of_token(a), _words_of_token(b)
        whole = x[-1] + y[0] if x and y else ""
        return len(whole) > 3 and whole in self.firm and (x[-1] not in self.firm or y[0] not in self.firm)

    def repaired(self, text: str, title: str | None, first: int | None, last: int | None) -> str:
        """Continuous paragraphs: without page numbers and running titles, words joined over line ends, characters put
        right. A line that ends a sentence short of the usual width ends its paragraph."""
        gone = {i for i, k in self.kinds(text, title, first, last) if k in ("page", "header")}
        lines = [x.rstrip() for i, x in enumerate(text.split("\n")) if i not in gone]
        width = max((len(x) for x in lines), default=0)
        out = ""
        for k, line in enumerate(lines):
            if not line:
                out = out.rstrip() + "\n"
                continue
            after = next((x for x in lines[k + 1 :] if x), "")
            if line[-1] in _hyphens and line[-2:-1].isalpha() and after[:1].isalpha():
                out += line[:-1] if self.divided(line, after) else line[:-1] + "-"
            elif line[-1] in ".!?؟" and len(line) < 0.8 * width:
                out += line + "\n"
            else:
                out += line + " "
        return "\n".join(" ".join(self._put_right(p)) for p in out.strip().split("\n"))

    def _put_right(self, paragraph: str) -> list[str]:
        tokens, out = paragraph.split(), []
        for t in tokens:
            if out and (j := words_of(out[-1] + t)) and len(j) == 1 and j[0] in self.firm and len(j[0]) > 3:
                a, b = words_of(out[-1]), words_of(t)
                if len(a) == len(b) == 1 and (a[0] not in self.firm or b[0] not in self.firm):
                    out[-1] += t
                    continue
            core = t
            for w in words_of(t):
                if (f := self.fix(w)) and (i := core.lower().find(w)) >= 0:
                    core = core[:i] + (f.capitalize() if core[i].isupper() else f) + core[i + len(w) :]
            out.append(core)
        return out


def _near(a: str, b: str, most: int) -> bool:
    """Edit distance of at most `most`. One edit destroys at most two pairs of neighbours, so texts with too few common
    pairs are told apart at once; the others are compared along the diagonal only, as far as they can still be near."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    pairs = set(map(str.__add__, b, b[1:]))
    if sum(map(pairs.__contains__, map(str.__add__, a, a[1:]))) < len(a) - 1 - 2 * most:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))  # equal ends cost nothing
    a, b = a[i:], b[i:]
    i = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - i], b[: len(b) - i]
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            new[j] = best
        if min(new.values(), default=far) > most:
            return False
        row = new
    return row.get(len(b), far) <= most


_readers: dict[str, Reader] = {}


def _reader(key: str, weights: dict, firm: dict[str, int]) -> Reader:
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(weights, firm)
    return _readers[key]


def _send(spark, editor: CharacterEditor, firm: DataFrame):
    """Model and vocabulary to the workers; both are bounded (see TRAIN_FILES and FIRM_MOST). The key tells them from others."""
    words = {r["word"]: r["n"] for r in firm.collect()}
    return spark.sparkContext.broadcast((uuid.uuid4().hex, editor.weights, words))


class _Facts(dict):
    """What is known of the vocabulary: counts of firm words, 0 for others. Words asked for beyond that count as not firm and are
    noted."""

    def __init__(self, known: dict[str, int]):
        super().__init__({w: n for w, n in known.items() if n})
        self.known, self.asked = known, set()

    def __contains__(self, word) -> bool:
        if word not in self.known:
            self.asked.add(word)
        return super().__contains__(word)

    def get(self, word, default=None):
        return super().get(word, default) if word in self else default


class _Asker(Reader):
    """A reader that knows some facts only; edits are proposed once a word is known not to be firm."""

    def about(self, known: dict[str, int]) -> _Asker:
        self.firm = _Facts(known)
        self.fixed.clear()
        self.tokens.clear()
        self.plain.clear()
        return self

    def fix(self, word: str) -> str | None:
        return None if word in self.firm or word not in self.firm.known else super().fix(word)


def _asked_for(scanned: DataFrame, editor: CharacterEditor, firm: DataFrame, read, kind: str) -> DataFrame:
    """(id, out): `read` of each text, whatever the number of firm words. In each round a text is read with the facts gathered for it;
    words that it asked for beyond meet the firm words in a join and come back to it, until it asks for none."""
    spark = scanned.sparkSession
    sent = spark.sparkContext.broadcast((editor.weights, {r["three"] for r in sequences(firm).collect()}))
    columns = ["id", "text", "title", "page_start", "page_end"]
    known = StructType.fromDDL("known array<struct<word:string,n:bigint>>")["known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, threes = sent.value
        r = _Asker(weights, {}, threes)
        for b in batches:
            rows = [dict(zip(b.schema.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            for x in rows:
                facts = {f["word"]: f["n"] for f in x["known"]}
                x["out"] = read(r.about(facts), *(x[c] for c in columns[1:]))
                x["asked"] = sorted(r.firm.asked)
            yield pa.RecordBatch.from_pylist(rows, schema)

    todo = scanned.select(F.uuid().alias("row"), *columns).withColumn("known", F.array().cast(known.dataType))
    kinds = StructType([*todo.schema, *StructType.fromDDL(f"out {kind}, asked array<string>")])
    schema = to_arrow_schema(kinds)
    done = None
    while True:
        seen = materialize(todo.mapInArrow(run, kinds), "scan-asked")
        ready = seen.where(F.size("asked") == 0).select("id", "out")
        done = ready if done is None else done.unionByName(ready)
        open_ = seen.where(F.size("asked") > 0)
        if open_.isEmpty():
            return done
        wanted = open_.select("row", F.explode("asked").alias("word"))
        facts = wanted.join(firm, "word", "left").groupBy("row").agg(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n"))).alias("more"))
        todo = open_.join(facts, "row").select("row", *columns, F.concat("known", "more").cast(known.dataType).alias("known"))


def noise(scanned: DataFrame, editor: CharacterEditor, firm: DataFrame, most: int = FIRM_MOST) -> DataFrame:
    """(id, line_no, kind). `scanned`: id, text, title, page_start, page_end; more than `most` firm words aren't sent to the workers."""
    if firm.count() > most:
        found = _asked_for(scanned, editor, firm, lambda r, text, *x: [{"line_no": no, "kind": kind} for no, kind in r.kinds(text, *x)] if text else [], "array<struct<line_no:int,kind:string>>")
        return found.select("id", F.inline("out"))
    sent = _send(scanned.sparkSession, editor, firm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _reader(*sent.value)
        for b in batches:
            ids, nos, kinds = [], [], []
            for i, text, title, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for no, kind in r.kinds(text, title, first, last) if text else ():
                    ids.append(i)
                    nos.append(no)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(kinds, pa.string())], ["id", "line_no", "kind"])

    return scanned.select("id", "text", "title", "page_start", "page_end").mapInArrow(run, "id string, line_no int, kind string")


def _spread_out(scanned: DataFrame) -> DataFrame:
    """Pages that meet in few partitions are dealt over the workers before Python reads them."""
    cols = scanned.select("id", "text", "title", "page_start", "page_end")
    return cols.repartition(F.xxhash64("id")) if "file" in scanned.columns else cols


def repair(scanned: DataFrame, editor: CharacterEditor, firm: DataFrame, most: int = FIRM_MOST) -> DataFrame:
    """(id, repaired): continuous, correct paragraphs. `most`: as in noise."""
    if firm.count() > most:
        found = _asked_for(_spread_out(scanned), editor, firm, lambda r, text, *x: None if text is None else r.repaired(text, *x), "string")
        return found.withColumnRenamed("out", "repaired")
    sent = _send(scanned.sparkSession, editor, firm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _reader(*sent.value)
        for b in batches:
            ids, *cols = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([None if x[0] is None else r.repaired(*x) for x in zip(*cols, strict=True)], pa.string())], ["id", "repaired"])

    return _spread_out(scanned).mapInArrow(run, "id string, repaired string")


def by_source(chunks: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """`chunks` with `was_scanned`: false only for files with a text layer of their own."""
    native = doc_meta.groupBy("file").agg((F.count_if(F.col("text_source") == "ocr") == 0).alias("_native"))
    return chunks.join(native.hint("shuffle_hash"), "file", "left").withColumn("was_scanned", ~F.coalesce("_native", F.lit(False))).drop("_native")


def scan_noise(chunks: DataFrame, doc_meta: DataFrame, ocr_payload: DataFrame, native_pages: DataFrame, site_lines: DataFrame) -> DataFrame:
    """(chunk_id, line_no, kind) as TESTDATA.md defines p2_found."""
    c = by_source(chunks.select("id", "file", "text", "title", "page_start", "page_end"), doc_meta)
    editor = train(ocr_payload, native_pages, doc_meta)
    firm = materialize(firm_words(materialize(clean_words(c.where(~F.col("was_scanned"))), "words")), "firm-words")
    found = noise(c.where("was_scanned"), editor, firm)
    site = site_lines.select(F.col("rec").alias("id"), "line_no")
    return found.join(site, ["id", "line_no"], "left_anti").select(F.col("id").alias("chunk_id"), "line_no", "kind").distinct()


def payload_pages(ocr_payload: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """(id, file, page, text, title, page_start, page_end): one row per scanned page; id is file#page."""
    titles = doc_meta.groupBy("file").agg(F.min("title").alias("title"))
    p = ocr_payload.select("file", F.explode("pages").alias("p")).select("file", F.col("p.page").alias("page"), F.col("p.text").alias("text")).dropDuplicates(["file", "page"])
    return p.join(titles, "file", "left").select(F.concat_ws("#", "file", "page").alias("id"), "file", "page", "text", "title", F.col("page").alias("page_start"), F.col("page").alias("page_end"))


def repaired_texts(chunks: DataFrame, doc_meta: DataFrame, ocr_payload: DataFrame, native_pages: DataFrame, site_lines: DataFrame) -> DataFrame:
    """(kind, key, text): the repaired text of each scanned chunk, without the lines of the site, which would run into its
    paragraphs, and of each page of ocr_payload (key file#page)."""
    c = by_source(chunks.select("id", "file", "text", "title", "page_start", "page_end"), doc_meta)
    firm = materialize(firm_words(materialize(clean_words(c.where(~F.col("was_scanned"))), "words")), "firm-words")
    cols = ["id", "text", "title", "page_start", "page_end"]
    scanned = without_lines(c.where("was_scanned"), site_lines).select(F.concat(F.lit("chunk:"), "id").alias("id"), *cols[1:])
    pages = payload_pages(ocr_payload, doc_meta).select(F.concat(F.lit("page:"), "id").alias("id"), *cols[1:])
    done = repair(scanned.unionByName(pages), train(ocr_payload, native_pages, doc_meta), firm)
    return done.select(F.substring_index("id", ":", 1).alias("kind"), F.regexp_replace("id", "^[a-z]+:", "").alias("key"), F.col("repaired").alias("text")).distinct()


def _compared(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "’‘«»“”–—", "''\"\"\"\"--"), r"\s+", " "))


def repair_gain(chunks: DataFrame, doc_meta: DataFrame, ocr_payload: DataFrame, native_pages: DataFrame) -> DataFrame:
    """(file, chars, edits_before, edits_after): character edits of the pages of ocr_payload against native_pages. Each half of the
    files is repaired by the editor that was fitted on the other half."""
    c = by_source(chunks.select("id", "file", "text"), doc_meta)
    firm = materialize(firm_words(materialize(clean_words(c.where(~F.col("was_scanned"))), "words")), "firm-words")
    pages = payload_pages(ocr_payload, doc_meta)
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    done = [repair(pages.where(half == k), train(ocr_payload, native_pages, doc_meta, half=1 - k), firm) for k in (0, 1)]
    done = pages.join(done[0].unionByName(done[1]), "id")
    native = native_pages.select("file", "page", F.col("text").alias("native")).dropDuplicates(["file", "page"])
    n = _compared(F.col("native"))
    j = done.join(native, ["file", "page"]).select("file", F.length(n).alias("chars"), F.levenshtein(_compared(F.col("text")), n).alias("before"), F.levenshtein(_compared(F.col("repaired")), n).alias("after"))
    return j.groupBy("file").agg(F.sum("chars").alias("chars"), F.sum("before").alias("edits_before"), F.sum("after").alias("edits_after"))
