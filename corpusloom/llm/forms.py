"""Tables of characters that print alike, built by rule from the Unicode database.

`PRINT_ALIKE` keeps everything that a reader can see (letter case, accents, punctuation, raised digits) and unifies the
rest; `FOLD` goes further for comparing lines: it also drops case, accents and blanks and unifies digits.
"""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache

#: Letters of other scripts that are drawn like a Latin letter.
ALIKE_FROM = "аеорсухіѕјһԛԝѵԁӏАВЕКМНОРСТУХІЅЈԚԜҮονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲɡ"
ALIKE_TO = "aeopcyxisjhqwvdlABEKMHOPCTYXISJQWYovpABEZHIKMNOPTYXcg"
#: Characters without ink, as a class for regular expressions (RE2 and Python's re both read it).
NO_INK = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
#: Kinds of blank and of hyphen.
BLANKS = "               　"
HYPHENS = "‐‑﹣－"

_PRESENTATION = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")


@lru_cache(1)
def alike() -> dict[str, str]:
    return dict(zip(ALIKE_FROM, ALIKE_TO, strict=True))


@lru_cache(1)
def single() -> dict[str, str]:
    """One character to one: width and presentation forms of letters and digits, blanks, hyphens, look-alike letters."""
    out = dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-") | alike()
    for c in map(chr, range(0x370, 0x10000)):
        d = U.decomposition(c)
        if d.startswith(_PRESENTATION):
            k = U.normalize("NFKC", c)
            if len(k) == 1 and U.category(k)[0] in "LN":
                out[c] = k
        elif d and "<" not in d and (n := U.normalize("NFD", c))[0] in alike():
            k = U.normalize("NFC", alike()[n[0]] + n[1:])
            if len(k) == 1:
                out[c] = k
    return out


@lru_cache(1)
def joined() -> dict[str, str]:
    """Joined letters that stand for several: Latin ligatures, Arabic lam-alef and the other joined presentation forms."""
    out = {}
    for c in map(chr, [*range(0xFB00, 0xFB18), *range(0xFBEA, 0xFDFC), *range(0xFE70, 0xFEFD), 0x132, 0x133, *range(0x1C4, 0x1CD)]):
        k = U.normalize("NFKC", c)
        if len(k) > 1 and not k[0].isspace() and U.category(c)[0] == "L":
            out[c] = k
    return out


@lru_cache(1)
def python_table() -> dict[int, str]:
    """For str.translate before NFC: what `print_alike` does, for short words inside tasks."""
    ink = {}
    for part in "\u00ad\u034f\u061c\u180e\ufeff":
        ink[ord(part)] = ""
    for a, b in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F)):
        ink |= {c: "" for c in range(a, b + 1)}
    return {ord(a): b for a, b in (single() | joined()).items()} | ink


def print_alike(text: str) -> str:
    """The form in which texts that print alike are equal (the Python twin of the SQL in `canon`)."""
    return text if text.isascii() else U.normalize("NFC", text.translate(python_table()))


@lru_cache(1)
def fold_table() -> dict[str, str]:
    """One character to one or none: case, accents, blanks and the above removed, all digits as 0. Joined letters (`joined`) are
    to be written out before."""
    out: dict[str, str] = {}
    one = single()
    for c in map(chr, [*range(0x20, 0x600), *range(0x600, 0x700), *range(0x1E00, 0x2100), *range(0xFB50, 0xFDFC), *range(0xFE00, 0xFF66)]):
        if c.isspace() or U.category(c) in ("Mn", "Cf"):
            out[c] = ""
            continue
        k = "".join(x for x in U.normalize("NFKD", one.get(c, c)) if not U.combining(x)).lower()
        k = "".join(one.get(x, x) for x in k) if len(k) == 1 else k
        k = "0" if k.isdigit() else k
        if len(k) == 1 and k != c:
            out[c] = k
    out |= {"’": "'", "‘": "'", "–": "-", "—": "-", "«": '"', "»": '"', "“": '"', "”": '"'}
    return out
