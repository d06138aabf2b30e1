"""Problem 8: byte-level BPE encoding of a corpus by walking a trie of its distinct words.

A prefix of a correct BPE encoding is the correct encoding of the prefix of the text. So the last token of every prefix
of a word says all there is to know: the encoding of the word is read off by stepping back over last tokens. Words are
visited depth-first in the order of their bytes, so the last tokens of a shared prefix are computed once; words already
seen by the worker are looked up. Text is cut into words by the tokenizer's own pattern, which no token crosses.

Defined cases: null and empty texts give an empty list. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; LOOM_TOKENIZERS overrides it.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("LOOM_TOKENIZERS", TOKENIZERS), name)


def _byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable Latin-1 by itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieEncoder:
    """Encodes sets of words; keeps what it has encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.longest = max(map(len, self.ids))
        self.merge = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (k, vocab[a], vocab[b]) for k, (a, b) in enumerate(merges)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.size: dict[int, int] = {i: len(t) for t, i in self.ids.items()}

    def together(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side: no merge across their border comes before the merges that
        make them. Walks the border from the outside in, undoing the later of the two merges at each step."""
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        ok, bound = True, len(self.merge)
        a, b = left, right
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < bound:
                ok = False
                break
            ka, kb = (self.made[a][0] if a in self.made else -1), (self.made[b][0] if b in self.made else -1)
            if ka < 0 and kb < 0:
                break
            if ka > kb:  # of equal merges the left one is done first, so the right one is undone first
                bound, a = ka, self.made[a][2]
            else:
                bound, b = kb + 1, self.made[b][1]
        self.fits[key] = ok
        return ok

    def _last(self, word: bytes, i: int, last: list[int]) -> int:
        """The last token of the encoding of word[:i]."""
        for n in range(min(i, self.longest), 0, -1):
            t = self.ids.get(word[i - n : i])
            if t is not None and (n == i or self.together(last[i - n], t)):
                return t
        raise ValueError(f"no token ends {word[:i]!r}")

    def learn(self, words: set[str]) -> None:
        """Encode new words depth-first along the trie of their bytes."""
        before, last = b"", [0]
        for raw, word in sorted((w.encode(), w) for w in words):
            same = 0
            for x, y in zip(before, raw, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, len(raw) + 1):
                last.append(self._last(raw, i, last))
            out, i = [], len(raw)
            while i:
                out.append(last[i])
                i -= self.size[last[i]]
            self.words[word] = np.array(out[::-1], np.int32).tobytes()
            before = raw

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        split = [_words(t) if t else [] for t in texts]
        known = self.words
        if fresh := set(chain.from_iterable(split)).difference(known):
            self.learn(fresh)
        parts = [b"".join(map(known.__getitem__, ws)) for ws in split]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return np.frombuffer(b"".join(parts), np.int32), offsets

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [_words(t) if t else [] for t in texts]
        known = self.words
        if fresh := set(chain.from_iterable(split)).difference(known):
            self.learn(fresh)
        return [sum(map(len, map(known.__getitem__, ws))) // 4 for ws in split]


_by_pattern = regex.compile(PATTERN).findall
#: The same cut by the standard library, several times faster: letters are the word characters that are neither decimal
#: digits nor "_". Texts with other numbers (raised, Roman, fractions) or separators U+001C-U+001F, whose classes differ, take PATTERN.
_fast = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_others = frozenset(c for c in map(chr, range(0x11_0000)) if unicodedata.category(c) in ("No", "Nl") or "\x1c" <= c <= "\x1f")


def _words(text: str) -> list[str]:
    return _fast(text) if _others.isdisjoint(text) else _by_pattern(text)


_encoders: dict[str, TrieEncoder] = {}
#: A worker forgets its words beyond this number, so that its memory stays bounded on any corpus.
KEPT_WORDS = 400_000


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder of a vocabulary, made once and kept over tasks."""
    e = _encoders.get(path)
    if e is None:
        e = _encoders[path] = TrieEncoder(path)
    if len(e.words) > KEPT_WORDS:
        e.words.clear()
    if len(e.fits) > 4 * KEPT_WORDS:
        e.fits.clear()
    return e


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of each text, one row per input row."""
    path = tokenizer or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offsets = encoder(path).encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
