"""Text functions as Column expressions.

Classes such as \\w are written out (letters, numbers, "_"), so that other engines read the patterns alike. A null input
gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfc(x: Column | str) -> Column:
    """Canonical composition (Spark has no such function). It can't stand inside a lambda: give it a column of its own."""
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return F.pandas_udf(compose, "string")(_col(x))


@lru_cache(1)
def fold_chars() -> tuple[str, str]:
    """Lower-case characters without their accents and compatibility forms, one to one; marks at the end, to be deleted."""
    a, b, gone = [], [], []
    for c in map(chr, [*range(0x80, 0x700), *range(0x1E00, 0x2070), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFF5F)]):
        if unicodedata.combining(c):
            gone.append(c)
            continue
        k = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if k != c and len(k) == 1 and not k.isspace() and not c.isupper():
            a.append(c)
            b.append(k.lower())
    return "".join(a + gone), "".join(b)


LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def fold(x: Column | str) -> Column:
    """Lower case without accents."""
    y = F.lower(_col(x))
    for a, b in LIGATURES.items():
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.translate(y, *fold_chars())


def collapse(x: Column | str) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(_col(x), SPACE + "+", " "))


def sanitize(x: Column | str) -> Column:
    """Without control and format characters but line breaks and tabs; straight apostrophes; collapsed."""
    return collapse(F.regexp_replace(F.translate(_col(x), "’‘", "''"), r"[\p{C}&&[^\n\t]]", ""))


def normalize(x: Column | str) -> Column:
    """Quotes and dashes unified, collapsed."""
    return collapse(F.translate(_col(x), "’‘«»“”–—", "''\"\"\"\"--"))


def compact(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(normalize(x), SPACE + "+", ""))


def content_words(x: Column | str) -> Column:
    """Words of at least two characters of the normalized lower-case text, with repeats."""
    return F.regexp_extract_all(F.lower(normalize(x)), F.lit(WORD + "{2,}"), F.lit(0))


def quote_coverage(quote: Column | str, text: Column | str) -> Column:
    """Share of the quote's words (with repeats) that the text holds; 0 without words."""
    q, t = content_words(quote), F.array_distinct(content_words(text))
    return F.coalesce(F.size(F.filter(q, lambda w: F.array_contains(t, w))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def detect_language(x: Column | str, default: str = "fr") -> Column:
    """Arabic by script; French or English by function words and accents; ties are French."""
    t, low = _col(x), F.lower(_col(x))
    arabic = F.regexp_count(t, F.lit(r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"))
    latin = F.regexp_count(t, F.lit(r"[A-Za-zÀ-ÿ]"))
    words = F.regexp_extract_all(low, F.lit("[a-zà-ÿ']+"), F.lit(0))
    count = lambda hints: F.size(F.filter(words, lambda w: w.isin(hints)))
    fr, en = count(C.FRENCH_HINTS) + 2 * F.regexp_count(low, F.lit("[éèêàùçôîâ]")), count(C.ENGLISH_HINTS)
    return F.when((arabic > 0) & (arabic >= latin), "ar").when((fr == 0) & (en == 0), default).when(fr >= en, "fr").otherwise("en")


def ocr_language(language: Column | str) -> Column:
    """The three-letter code by which a scanned document is read; French unless Arabic or English."""
    x = _col(language)
    return F.when(x == "ar", "ara").when(x == "en", "eng").otherwise("fra")


def is_meta(x: Column | str) -> Column:
    hit = F.lit(False)
    for p in C.META_PATTERNS:
        hit = hit | _col(x).rlike("(?iuU)" + p)
    return hit


def is_greeting(x: Column | str) -> Column:
    return _col(x).rlike(rf"(?iuU)^(?:{C.GREETING_WORDS})[\s!.,؟?]*(?:(?:à vous|à toi|everyone|all))?[\s!.,؟?]*$")


def guard_verdict(question: Column | str, in_scope: Column | None = None) -> Column:
    """empty, too_long, meta, greeting, off_topic or ok, decided in this order on the sanitized question."""
    q = sanitize(question)
    out = F.when(q == "", "empty").when(F.length(q) > C.MAX_QUESTION_CHARS, "too_long").when(is_meta(q), "meta").when(is_greeting(q), "greeting")
    if in_scope is not None:
        out = out.when(~in_scope, "off_topic")
    return out.otherwise("ok")


def _inked_lines(x: Column) -> Column:
    return F.filter(F.split(x, r"\r\n|[\n\r]"), lambda s: F.trim(s) != "")


def strip_page_number_lines(x: Column | str) -> Column:
    """Without blank lines and without 1-3 digit lines among the first and last two others."""
    lines = _inked_lines(_col(x))
    n = F.size(lines)
    kept = F.filter(lines, lambda s, i: ~(((i < 2) | (i >= n - 2)) & s.rlike(r"^\s*[-–]?\s*\d{1,3}\s*[-–]?\s*$")))
    return F.array_join(kept, "\n")


def strip_page_number(x: Column | str, page: Column | str) -> Column:
    """Without the page's own number where it stands alone in the first or last two inked lines."""
    lines = _inked_lines(_col(x))
    n = F.size(lines)
    own = F.concat(F.lit(r"^\s*[-–]?\s*"), _col(page).cast("string"), F.lit(r"\s*[-–]?\s*$"))
    return F.array_join(F.filter(lines, lambda s, i: ~(((i < 2) | (i >= n - 2)) & F.coalesce(F.rlike(s, own), F.lit(False)))), "\n")


def clean_page(x: Column | str) -> Column:
    """One composed page (see nfc) as a paragraph of running text; the order of the steps matters."""
    y = collapse(strip_page_number_lines(_col(x)))
    for p in C.BOILERPLATE:
        y = F.regexp_replace(y, p, " ")
    y = F.regexp_replace(y, r"(?U)\b(?:Articie|Articte|Artide|Artlcle|Aricle|Arficle)(?=\s*\d)", "Article")
    y = F.regexp_replace(y, r"(?U)\b(Article|ARTICLE)(\d)", "$1 $2")
    y = F.regexp_replace(y, r"(?U)(\w)- (?=[a-zà-ÿ])", "$1-")
    return collapse(y)


def number_tokens(x: Column | str) -> Column:
    """Numbers and percentages without blanks, with repeats."""
    found = F.regexp_extract_all(normalize(x), F.lit(r"\d+(?:[.,]\d+)*(?:\s*%)?"), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(s, r"\s+", ""))


def reference_tokens(x: Column | str) -> Column:
    """Legal references in one spelling: ref:9/w/2098 and ref:01-23."""
    t = _col(x)
    bam = r"(?i)(?<!\d)(\d{1,3})\s*/?\s*([gw])\s*/?\s*(\d{4}|\d{2})(?!\d)"
    ammc = r"(?i)n\s*°\s*(\d{1,2})\s*[-_/]\s*(\d{4}|\d{2})(?!\d)"
    part = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    num = lambda s: s.cast("int").cast("string")
    year = lambda y: F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), y))
    a = F.transform(F.arrays_zip(part(bam, 1).alias("n"), part(bam, 2).alias("s"), part(bam, 3).alias("y")), lambda r: F.concat(F.lit("ref:"), num(r["n"]), F.lit("/"), F.lower(r["s"]), F.lit("/"), year(r["y"])))
    b = F.transform(F.arrays_zip(part(ammc, 1).alias("n"), part(ammc, 2).alias("y")), lambda r: F.concat(F.lit("ref:"), F.lpad(num(r["n"]), 2, "0"), F.lit("-"), r["y"]))
    return F.concat(a, b)


def search_tokens(x: Column | str) -> Column:
    """Folded words without stop words, plural endings off, then reference tokens."""
    words = F.filter(F.regexp_extract_all(fold(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(C.STOPWORDS))
    return F.concat(F.transform(words, lambda w: F.regexp_replace(w, "^(.{4,})[sx]$", "$1")), reference_tokens(x))


def term_index(term: Column | str) -> Column:
    """Stable 31-bit index of a term: the first four bytes of its MD5, little-endian, shifted right by one."""
    h = F.md5(_col(term))
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.shiftright(F.conv(le, 16, 10).cast("long"), 1)


def chunk_id(prefix: str, file: Column | str, index: Column | str) -> Column:
    """Name-based (version 5) UUID of prefix:file#index in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat(F.lit(prefix + ":"), _col(file), F.lit("#"), _col(index).cast("string")), "utf-8")))
    variant = F.substring(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(0x3F).bitwiseOR(0x80)), -2, 2)
    return F.lower(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)))


def keep_valid_citations(answer: Column | str, sources: Column | str) -> Column:
    """Without [n] beyond the number of sources, and without the blanks that this leaves before punctuation."""
    marks = F.array_distinct(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1)))
    bad = F.filter(marks, lambda m: ~F.coalesce(m.try_cast("bigint").between(1, _col(sources)), F.lit(False)))
    out = F.aggregate(bad, _col(answer), lambda acc, m: F.replace(acc, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    return F.regexp_replace(out, r"[ \t]+([.,;:])", "$1")


def cited_numbers(answer: Column | str, sources: Column | str) -> Column:
    """Valid citation numbers in the order of first appearance."""
    marks = F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("int"))
    return F.array_distinct(F.filter(marks, lambda m: m.between(1, _col(sources))))


def citation_coverage(answer: Column | str) -> Column:
    """Share of the sentences of at least four words that carry a citation."""
    a = F.trim(_col(answer))
    sentences = F.filter(F.regexp_extract_all(a, F.lit(r"[^.!?؟\n]+(?:[.!?؟]+|$)(?:\s*\[\d+\])*"), F.lit(0)), lambda s: F.size(F.split(F.trim(s), SPACE + "+")) >= 4)
    cited = F.size(F.filter(sentences, lambda s: s.rlike(r"\[\d+\]")))
    return F.when(F.size(sentences) == 0, F.when(a.rlike(r"\[\d+\]"), 1.0).otherwise(0.0)).otherwise(cited / F.size(sentences))


def fact_form(x: Column | str) -> Column:
    """Facts in one form: digits unified, number words as digits, decimals with a comma, no blanks."""
    spelled = "|".join(sorted([*C.NUMBER_WORDS, "cent", "cents", "mille", "et"], key=len, reverse=True))
    y = F.lower(F.translate(normalize(x), "٠١٢٣٤٥٦٧٨٩٫٪", "0123456789,%"))
    y = F.regexp_replace(y, rf"(?:(?:{spelled})[\s-]*){{1,5}}\((\d[\d.,\s]*)\)", "$1")
    for w in sorted(C.NUMBER_WORDS, key=len, reverse=True):
        y = F.regexp_replace(y, rf"(?U)\b{w}\b", C.NUMBER_WORDS[w])
    y = F.regexp_replace(y, r"(?<=\d)[ .,](?=\d{3}(?!\d))", "")
    y = F.regexp_replace(y, r"(?<=\d)[.,](?=\d)", ",")
    return F.regexp_replace(y, r"\s+", "")


def form_numbers(form: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(form, F.lit(r"\d+(?:,\d+)*%?"), F.lit(0)))


def form_found(fact: Column, answer: Column) -> Column:
    """Both in fact form: the fact stands in the answer and isn't part of a longer number."""
    q = F.concat(F.lit("\\Q"), fact, F.lit("\\E"))
    pattern = F.concat(F.when(fact.rlike(r"^\d"), r"(?<![\d,])").otherwise(""), q, F.when(fact.rlike(r"\d$"), r"(?![\d,]*\d)").otherwise(""))
    return F.coalesce((fact != "") & F.rlike(answer, pattern), F.lit(False))


def article_ids(section: Column | str) -> Column:
    """Article numbers of a label, ranges of at most twenty spelled out; null gives none."""
    s = F.coalesce(_col(section), F.lit(""))
    ids = F.transform(F.regexp_extract_all(s, F.lit(r"(?i)(premier|1er|\d+(?:\.\d+)*)"), F.lit(1)), lambda m: F.when(F.lower(m).isin("premier", "1er"), "1").otherwise(m))
    low, high = (F.regexp_extract_all(s, F.lit(r"(\d+)\s*-\s*(\d+)"), F.lit(g)) for g in (1, 2))
    spans = F.zip_with(low, high, lambda a, b: F.when((b.try_cast("int") >= a.try_cast("int")) & (b.try_cast("bigint") - a.try_cast("bigint") <= 20), F.transform(F.sequence(a.try_cast("int"), b.try_cast("int")), lambda n: n.cast("string"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(ids, F.flatten(spans)))


def slug(x: Column | str, most: int = 60) -> Column:
    s = F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " "))
    cut = F.rtrim(F.substring(s, 1, most))
    return F.when(cut == "", "document").otherwise(F.translate(cut, " ", "-"))


def document_stem(issuer: Column | str, title: Column | str, url: Column | str) -> Column:
    return F.concat_ws("-", F.lower(_col(issuer)), slug(title), F.substring(F.sha1(_col(url)), 1, 8))


def page_link(url: Column | str, page: Column | str) -> Column:
    """The URL without its fragment, percent-encoded where needed, opened at a page."""
    u = F.url_encode(F.regexp_extract(_col(url), "^([^#]*)", 1))
    for c in ":/?&=%#+@;,~!$'()":
        u = F.replace(u, F.lit(f"%{ord(c):02X}"), F.lit("\x01" if c == "%" else "\x02" if c == "+" else c))
    u = F.replace(F.replace(F.replace(u, F.lit("+"), F.lit("%20")), F.lit("\x01"), F.lit("%")), F.lit("\x02"), F.lit("+"))
    return F.concat(u, F.lit("#page="), _col(page).cast("string"))


def cache_key(question: Column | str, k: Column | str, scope: Column | str) -> Column:
    """k|scope|question, the question collapsed and case-folded."""
    return F.concat_ws("|", _col(k).cast("string"), _col(scope), F.replace(F.lower(collapse(question)), F.lit("ß"), F.lit("ss")))


def key_id(key: Column | str) -> Column:
    return F.substring(F.sha2(_col(key), 256), 1, 12)


def french_date(x: Column | str) -> Column:
    """The first valid French date of a text."""
    p = r"(?i)(?<![\p{L}\p{N}_])(1er|\d{1,2})\s+([a-zéèêûô]+)\s+(\d{4})(?![\p{L}\p{N}_])"
    d, m, y = (F.regexp_extract_all(_col(x), F.lit(p), F.lit(g)) for g in (1, 2, 3))
    months = F.create_map(*[v for i, name in enumerate(C.MONTHS) for v in (F.lit(name), F.lit(i + 1))])
    found = F.transform(F.arrays_zip(d.alias("d"), m.alias("m"), y.alias("y")), lambda r: F.try_to_date(F.concat_ws("-", r["y"], F.lpad(months[fold(r["m"])].cast("string"), 2, "0"), F.lpad(F.regexp_replace(F.lower(r["d"]), "er", ""), 2, "0")), "yyyy-MM-dd"))
    return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(1))


def title_reference(title: Column | str, issuer: Column | str) -> Column:
    """The earliest legal reference of a title; at one place the issuer's own form comes first."""
    t, i = _col(title), _col(issuer)
    bam = r"(?i)(?<!\d)(\d{1,3})\s*/?\s*([gw])\s*/?\s*(\d{4}|\d{2})(?!\d)"
    ammc = r"(?i)n\s*°\s*(\d{1,2})\s*[-_/]\s*(\d{4}|\d{2})(?!\d)"
    generic = r"(?i)n\s*°\s*(\d+(?:\s*[-/]\s*[A-Z0-9]+)+)(?![\p{L}\p{N}_])"
    g = lambda p, k: F.regexp_extract(t, p, k)
    at = lambda p, lead: F.regexp_instr(t, F.lit(p)) + (F.length(F.regexp_extract(F.regexp_substr(t, F.lit(p)), lead, 0)) if lead else F.lit(0))
    year = F.when(F.length(g(bam, 3)) == 4, g(bam, 3)).otherwise(F.concat(F.lit("20"), g(bam, 3)))
    own = F.when((i == "BAM") & t.rlike(bam), F.struct(at(bam, "").alias("p"), F.lit(0).alias("o"), F.concat(g(bam, 1).cast("int").cast("string"), F.lit("/"), F.upper(g(bam, 2)), F.lit("/"), year).alias("r")))
    own = own.when((i == "AMMC") & t.rlike(ammc), F.struct(at(ammc, r"(?i)^n\s*°\s*").alias("p"), F.lit(0).alias("o"), F.concat(F.lpad(g(ammc, 1).cast("int").cast("string"), 2, "0"), F.lit("-"), g(ammc, 2)).alias("r")))
    other = F.when(t.rlike(generic), F.struct(at(generic, r"(?i)^n\s*°\s*").alias("p"), F.lit(1).alias("o"), F.regexp_replace(g(generic, 1), r"\s+", "").alias("r")))
    return F.array_min(F.array_compact(F.array(own, other)))["r"]
