"""Problem 3: values that were cut before their end, and how often each source cuts.

The vocabulary trie is a table: one row per node (a prefix of a known word) with whether it is a word. Known words are
those seen inside values, not at their end. A value whose last token is a node but not a word ends within a word. Length
evidence: per source, lengths (in characters or bytes) at which values pile up that end openly. Endings are judged by
how often their last two words elsewhere end a sentence or a list item.

Defined cases: null, empty and blank values are not cut; repeated keys count once; a null source is a source of its
own; short answers, lists, abstentions and citations are cut only by evidence other than the missing full stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side

#: A length is a limit of its source if so many running texts end openly at it, and these are this share of all values there.
PILE = 3
PILE_SHARE = 0.7
#: Words from which a value without an end counts as running text.
RUNNING_WORDS = 8
#: A pair of words seen `SEEN` times that ends a phrase at most at this rate doesn't end one here either.
SEEN = 3
RARE_END = 0.1
#: A text is one that its source repeats from this share of the source's records (and three).
COPIED = 0.001
#: Characters at the end that hold any mark of continuation.
MARK_CHARS = 20
_MARK = r"(?s)\s*(?:…|\.{3}|\[…\]|\[\.{3}\]|\(suite\)|\(à suivre\)|\(continued\)|\(cont\.\)|\(يتبع\))\s*$"
_CONTINUED = r"(?s)(?:\[…\]|\[\.{3}\]|\(suite\)|\(à suivre\)|\(continued\)|\(cont\.\)|\(يتبع\))\s*$"
_CITED = r"\[\d+(?:\s*[,;-]\s*\d+)*\]\s*[.]?$"
_ENDED = r"[.!?؟»”\"\])]$"
_ITEM = r"^\s*(?:[-•*–·]|\d+[.)])\s"


def values(answers: DataFrame, turns: DataFrame) -> DataFrame:
    """(tbl, row_id, source, value), one row per key, of the values that are not blank."""
    a = answers.select(F.lit("answers").alias("tbl"), F.col("answer_id").alias("row_id"), "source", F.col("answer").alias("value"))
    t = turns.select(F.lit("turns").alias("tbl"), F.col("turn_id").alias("row_id"), "source", F.col("answer").alias("value"))
    return a.unionByName(t).where(F.length(F.trim("value")) > 0).dropDuplicates(["tbl", "row_id"])


def _end(x: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(x, F.lit(" \t\r\n\u00a0"))


def _steps(value: Column) -> Column:
    """Words in lower case with numbers as 0 and "¶" for each end of a sentence, item or citation."""
    ends = F.regexp_replace(F.lower(value), r"\[\d+\]|[.!?؟:;؛]+(?=\s|$)|\n", " ¶ ")
    return F.filter(F.split(F.regexp_replace(ends, r"\d+", "0"), r"[^\p{L}\p{M}\p{N}¶%]+"), lambda w: w != "")


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """`df` with columns that are worked out once per row, however often they are used: Spark would repeat a projection's
    expressions wherever they are named, but not those of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def described(vals: DataFrame) -> DataFrame:
    v = _once(vals.select("tbl", "row_id", "source", "value"), whole=_end(F.col("value")), chars=F.length("value"), bytes=F.octet_length("value"))
    v = _once(v.drop("value"), close=F.right("whole", F.lit(MARK_CHARS)))
    v = _once(v, marked=F.col("close").rlike(_MARK), continued=F.col("close").rlike(_CONTINUED), bad=F.endswith("close", F.lit("\ufffd")))
    v = _once(v, body=F.when(F.col("marked"), _end(F.regexp_replace("whole", _MARK, ""))).otherwise(F.col("whole"))).drop("whole", "close")
    last = F.substring_index("body", "\n", -1)
    v = _once(v, last_line=last, end=F.right(last, F.lit(60)), steps=_steps(F.col("body")), copy=F.xxhash64("body"))
    return v.select(
        "tbl", "row_id", "source", "marked", "continued", "chars", "bytes", "steps", "copy",
        (F.col("bad") | F.col("body").rlike(r"\[[^\]]*$") | F.col("end").rlike(r"[,،(\-–'’]$")).alias("broken"),
        (F.col("end").rlike(_ENDED) | F.col("end").rlike(_CITED)).alias("ended"),
        F.col("last_line").rlike(_ITEM).alias("item"),
        F.regexp_extract(F.lower("last_line"), r"([\p{L}\p{M}]+)$", 1).alias("tail"),
        F.size(F.filter("steps", lambda w: w != "¶")).alias("words"),
    )


def trie_nodes(described_values: DataFrame) -> DataFrame:
    """(node, is_word): the trie of the words seen anywhere but at the end of a value that ends openly."""
    inner = F.when(F.col("ended"), F.col("steps")).otherwise(F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))))
    words = described_values.select(F.explode(inner).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{M}]+$")).distinct()
    nodes = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.left("word", n))).alias("node"))
    return nodes.groupBy("node").agg(F.max(F.col("node") == F.col("word")).alias("is_word"))


def phrase_ends(described_values: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, seen, ends): how often each pair of words of `asked` (a, b) occurs inside values, and ends a sentence or an item."""
    n = F.size("steps")
    trip = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.element_at("steps", i).alias("a"), F.element_at("steps", i + 1).alias("b"), F.element_at("steps", i + 2).alias("c")))
    t = described_values.where(n >= 3).select(F.inline(trip)).where((F.col("a") != "¶") & (F.col("b") != "¶"))
    t = t.join(small_side(asked), ["a", "b"], "left_semi")
    return t.groupBy("a", "b").agg(F.count("*").alias("seen"), F.sum(F.when(F.col("c") == "¶", 1).otherwise(0)).alias("ends"))


def limits(judged: DataFrame) -> DataFrame:
    """(source, measure, n): lengths at which the values of a source pile up with open ends."""
    long = judged.select("source", (F.col("running") & ~F.col("ended")).alias("open"), F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("measure", "n"))
    return long.groupBy("source", "measure", "n").agg(F.count("*").alias("all"), F.count_if("open").alias("open")).where(
        (F.col("open") >= PILE) & (F.col("open") >= PILE_SHARE * F.col("all"))
    ).select("source", "measure", "n")


def judged(vals: DataFrame) -> DataFrame:
    """`vals` (tbl, row_id, source) with the evidence of each: within_word (trie), at_limit (length), ends_rarely, ends_often,
    broken, continued, marked, ended, running, copied. Only keys and flags move: values that don't end in a letter skip the
    trie, and a text that recurs is counted by its hash."""
    d = materialize(described(vals), "values")
    flags = ["tbl", "row_id", "source", "marked", "continued", "broken", "ended", "item", "words", "chars", "bytes", "copy"]
    rows = d.select(*flags, "tail", F.try_element_at("steps", F.lit(-2)).alias("a"), F.try_element_at("steps", F.lit(-1)).alias("b"))
    rows = materialize(rows, "ends")
    tails = rows.where((F.col("tail") != "") & ~F.col("ended"))
    nodes = trie_nodes(d).withColumnRenamed("node", "tail").join(small_side(materialize(tails.select("tail").distinct(), "tails")), "tail", "left_semi")
    pairs = materialize(tails.where(F.col("a").isNotNull()).select("a", "b").distinct(), "pairs")
    ends = materialize(phrase_ends(d, pairs), "phrase-ends")
    some = tails.join(small_side(materialize(nodes, "nodes")), "tail", "left").join(small_side(ends), ["a", "b"], "left")
    rest = rows.where((F.col("tail") == "") | F.col("ended"))
    j = some.unionByName(rest, allowMissingColumns=True)
    again = rows.where(~F.col("ended")).groupBy("source", "copy").agg(F.count("*").alias("copies")).where("copies > 1")
    many = small_side(materialize(rows.groupBy(F.col("source").alias("m")).agg(F.count("*").alias("records")), "records"))
    again = again.join(many, F.col("source").eqNullSafe(F.col("m"))).where(F.col("copies") >= F.greatest(F.lit(3), F.col("records") * COPIED))
    again = small_side(materialize(again.select(F.col("source").alias("s"), F.col("copy").alias("c"), F.lit(True).alias("copied")), "copied"))
    j = j.join(again, j["source"].eqNullSafe(again["s"]) & (j["copy"] == again["c"]), "left").drop("s", "c")
    j = j.select(
        "tbl", "row_id", "source", "marked", "continued", "broken", "ended", "chars", "bytes", F.coalesce("copied", F.lit(False)).alias("copied"),
        (F.col("is_word").isNotNull() & ~F.coalesce("is_word", F.lit(False))).alias("within_word"),
        (F.coalesce("seen", F.lit(0)) >= SEEN).alias("seen_often"), F.coalesce(F.col("ends") / F.col("seen"), F.lit(0.0)).alias("rate"),
        ((F.col("words") >= RUNNING_WORDS) & ~F.col("item")).alias("running"),
    ).withColumns({"ends_rarely": F.col("seen_often") & (F.col("rate") <= RARE_END), "ends_often": F.col("seen_often") & (F.col("rate") >= 0.5)})
    j = materialize(j.drop("seen_often", "rate"), "endings")
    at = materialize(limits(j), "limits")
    for m in ("chars", "bytes"):
        lim = small_side(materialize(at.where(F.col("measure") == m).select(F.col("source").alias("s"), F.col("n").alias("at_n"), F.lit(True).alias(f"at_{m}")), "limit"))
        j = j.join(lim, j["source"].eqNullSafe(lim["s"]) & (j[m] == lim["at_n"]), "left").drop("s", "at_n")
    return j.withColumn("at_limit", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))


def truncated(vals: DataFrame) -> DataFrame:
    """`vals` (tbl, row_id, source) with the columns `cut` and `by`, the evidence that decided: word, length, phrase, mark, open.

    A value is cut that ends within a word (trie) or openly at a length where its source's values end openly (length), then by
    how its last two words end elsewhere, by a mark of continuation or an open bracket, and last as running text without an end.
    A text that a source repeats is not cut for the lack of an end alone."""
    j = judged(vals)
    open_end = ~F.col("ended")
    unfinished = F.col("within_word") | F.col("ends_rarely") | F.col("at_limit")
    by = (
        F.when(open_end & F.col("within_word"), "word").when(open_end & F.col("at_limit"), "length").when(open_end & F.col("ends_rarely") & ~F.col("copied"), "phrase")
        .when(F.col("broken") | F.col("continued") | (F.col("marked") & (unfinished | (F.col("running") & open_end))), "mark")
        .when(open_end & F.col("running") & ~F.col("ends_often") & ~F.col("copied"), "open")
    )
    return j.select("tbl", "row_id", "source", by.isNotNull().alias("cut"), by.alias("by"))


def rates(judged: DataFrame) -> DataFrame:
    """(tbl, source, records, cut, rate)."""
    return judged.groupBy("tbl", "source").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("rate"))
