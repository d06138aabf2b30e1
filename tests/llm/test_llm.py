"""Operators of the llm package on small fixtures: brute force, round trips and the defined cases."""

import base64
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import areas, bpe, budget, canon, forms, language, lines, pack, scan, split, truncation

TOKENIZERS = os.path.isfile(bpe.tokenizer_path())
DOC = "doc_id bigint, text string, title string, url string, source string"
CHUNK = "id string, text string, file string, issuer string, extra string"


# 1 lines ----------------------------------------------------------------------------------------------------------


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_recurring_lines_with_noise(spark):
    line = "Consulté 27 fois depuis sa mise en ligne le 05/08/2011"
    variants = [line, line.replace("27", "4"), line.upper(), "Consulte 1 fois depuis sa mise  en ligne le 05/84/2011 ", "Consulté 27 fols depuis sa mise en lignc le 05/08/2011", "Consulté 27 fois depuis sа mise en ligne le 05/08/2011"]
    rows = [(f"c{i}", f"Texte propre {'abcdefghij'[i % 10] * (i + 1)}\n\n{v}", f"f{i}", "BAM", "x") for i, v in enumerate(variants)]
    rows += [rows[0], ("n1", None, "f9", "BAM", ""), ("n2", line, "f9", None, ""), ("n3", line, None, "AMMC", ""), ("few", "Une ligne rare de plus de trente caractères ici", "f1", "BAM", ""), ("short", "trop court", "f2", "BAM", "")]
    got = {(r[0], r[1]) for r in lines.recurring_lines(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {(f"c{i}", 2) for i in range(6)}
    clean = {r["id"]: r["text"] for r in lines.without_lines(spark.createDataFrame(rows, CHUNK), lines.recurring_lines(spark.createDataFrame(rows, CHUNK))).collect()}
    assert clean["c0"] == "Texte propre a\n" and clean["n1"] is None and clean["few"] == rows[-2][1]


def test_lines_fold_by_arrays_as_defined_character_by_character(spark):
    rng = random.Random(2)
    alpha = [*"aé0129.,;  \t\r\n\n", "\ufb01", "\ufdfa", "\ufefb", "\u0663", "\uff41", "e\u0301", "\xa0", "\U0001d54f", "\u200b", "\u0132", "\u2003", "\u2019", "\u0410", "\u0130"]
    texts = ["".join(rng.choices(alpha, k=rng.randrange(200))) for _ in range(400)] + ["", "\n", " " * 40, "x" * 29, f"  {'y' * 30} ", "0.0,00 1" + "z" * 30, "1" * 40 + "\n" + "2" * 40, None]
    table, want = forms.fold_table(), set()
    for i, text in enumerate(texts):
        for no, line in enumerate((text or "").split("\n")):
            if len(line.strip(" ")) >= lines.MIN_CHARS:
                x = "".join(table.get(c, c) for c in "".join(forms.joined().get(c, c) for c in line))
                want.add((f"c{i}", no, re.sub("0+(?:[.,]0+)*", "0", x)))
    df = lines.folded_lines(spark.createDataFrame([(f"c{i}", t, "f", "BAM", "") for i, t in enumerate(texts)] + [("none", "n" * 40, "f", None, "")], CHUNK))
    got = df.collect()
    assert {(r["rec"], r["line_no"], r["key"]) for r in got} == want and len(got) == len(want) > 200
    assert "translate" not in df._jdf.queryExecution().executedPlan().toString()  # a look-up of a text for each character


def test_members_match_brute_force(spark):
    rng = random.Random(1)
    base = ["abonnez vous a la lettre hebdomadaire du guichet", "document diffuse par le portail reglementaire"]
    keys = []
    for k in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s))
            op = rng.randrange(3)
            if op == 0:
                s[i] = rng.choice("xyzw")
            elif op == 1:
                del s[i]
            else:
                s.insert(i, rng.choice("xyzw"))
        keys.append("".join(s).replace(" ", ""))
    df = spark.createDataFrame([("S", k) for k in sorted(set(keys))], "source string, key string").withColumn("h", F.xxhash64("source", "key"))
    top = spark.createDataFrame([("S", b.replace(" ", "")) for b in base], "source string, key string").withColumn("h", F.xxhash64("source", "key"))
    got = {r["key"] for r in lines.class_members(df, top).join(df, "h").collect()}
    assert got == {k for k in keys if any(_levenshtein(k, b.replace(" ", "")) <= 2 for b in base)}


def _due(texts, files, need):
    """By brute force: the lines within two characters of one whose neighbours occur in `need` files."""
    near = [[j for j, b in enumerate(texts) if _levenshtein(a, b) <= 2] for a in texts]
    full = [len({files[j] for j in n}) >= need for n in near]
    return {i for i, n in enumerate(near) if any(full[j] for j in n)}


def test_rare_classes_match_brute_force(spark):
    """Classes without any frequent spelling, in a source that needs six files; with short and long keys."""
    rng = random.Random(11)
    base = ["documentdiffuseparleportailreglementaireduroyaumeetsesannexes", "abonnezvousalalettrehebdomadaire", "ouvertdulundiauvendredide"]
    texts, files = [], []
    for b in base:
        for f in range(14):
            s = list(b)
            for _ in range(rng.randrange(4)):
                i, op = rng.randrange(len(s)), rng.randrange(3)
                s[i : i + (op < 2)] = [] if op == 0 else [rng.choice("wxkq")]
            texts.append("".join(s))
            files.append(f"f{f}")
    rows = [(f"c{i}", t + " " * 40 + ".", f, "BAM", "") for i, (t, f) in enumerate(zip(texts, files, strict=True))]
    rows = [(a, b.strip()[:-1] + " " * 20 + "|", *rest) for a, b, *rest in rows]
    filler = [(f"d{i}", "texte", f"g{i}", "BAM", "") for i in range(180)]
    due = {(f"c{i}", 0) for i in _due(texts, files, 6)}
    state = lines.advance(None, spark.createDataFrame(rows + filler, CHUNK), rare=True)
    assert {tuple(r) for r in lines.found_lines(state).collect()} == due and len(due) > 20
    assert {tuple(r) for r in lines.recurring_lines(spark.createDataFrame(rows + filler, CHUNK)).collect()} <= due
    few = spark.createDataFrame(rows + filler[:100], CHUNK)  # 114 files need five: every spelling is an anchor
    assert {tuple(r) for r in lines.recurring_lines(few).collect()} == {(f"c{i}", 0) for i in _due(texts, files, 5)}


def test_rare_classes_move_no_lookups(spark):
    """Cells are counted once; the spellings and their lookups meet the full ones where they lie. Classes by single cells count too."""
    rng = random.Random(5)
    base = "documentdiffuseparleportailreglementaireduroyaume"
    texts = [base] + [base[:i] + x + base[i + 1 :] for i, x in ((3, "w"), (20, "x"), (40, "k"), (12, "q"), (30, "w"), (47, "k"))]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(44)) for _ in range(150)]
    spellings = lines.materialize(spark.createDataFrame([("BAM", i, t, 1) for i, t in enumerate(texts)], "source string, h bigint, key string, n bigint"), "test")
    needs = lines.materialize(spark.createDataFrame([("BAM", 7)], "source string, need bigint"), "test")
    got = lines.rare_classes(spellings, spellings.select("source", "h").limit(0), needs)
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if _levenshtein(a, b) <= 2}
    assert {(r["h"], r["anchor"]) for r in got.collect()} == {(i, j) for i, j in near if sum(k == j for _, k in near) >= 7}
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_rare_keys_of_one_template_are_told_apart_by_letters(spark, monkeypatch):
    """Lines that differ by a name in the same sentence share nearly all pieces; few of them are compared character by character."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = [name() + ",fautedequoil'agrementpeutetreretire." for _ in range(300)]
    site = "documentdiffuseparleportailreglementaireduroyaume"
    texts += [site[:i] + "#" + site[i + 1 :] for i in range(40)]
    spellings = lines.materialize(spark.createDataFrame([("BAM", i, t, 1) for i, t in enumerate(texts)], "source string, h bigint, key string, n bigint"), "test")
    needs = lines.materialize(spark.createDataFrame([("BAM", 30)], "source string, need bigint"), "test")
    written, real = {}, lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: written.setdefault(name, real(df, name)) if name == "line-rare-keys" else real(df, name))
    got = {(r["h"], r["anchor"]) for r in lines.rare_classes(spellings, spellings.select("source", "h").limit(0), needs).collect()}
    assert got == {(i, j) for i in range(300, 340) for j in range(300, 340)}
    assert written["line-rare-keys"].count() == 40


def test_rare_classes_by_arrays_and_by_joins_agree(spark, monkeypatch):
    """Short keys, keys of several bytes a character, two sources; a table without candidates; what is too much to send."""
    rng = random.Random(8)
    keys = set()
    for base in ("abcabc", "a", "\u064a\u062c\u0648\u0632\u0644\u0644\u0645\u0624\u0633\u0633\u0627\u062a\u0627\u0644\u0646\u0634\u0631", "aé€\U0001d54fb" * 5, "leconseildelaconcurrenceetsesservices"):
        for _ in range(40):
            x = list(base)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(x) + 1)
                x[i : i + rng.randrange(2)] = [rng.choice("abé€\u0644")] if rng.random() < 0.7 else []
            keys.add("".join(x))
    rows = [(s, h, k, 1 + rng.randrange(3)) for h, (s, k) in enumerate((s, k) for s in ("BAM", "AMMC") for k in sorted(keys) if s == "BAM" or rng.random() < 0.5)]
    spellings = lines.materialize(spark.createDataFrame(rows, "source string, h bigint, key string, n bigint"), "test")
    needs = lines.materialize(spark.createDataFrame([("BAM", 12), ("AMMC", 20)], "source string, need bigint"), "test")
    none = spellings.select("source", "h").limit(0)
    n, need = {h: n for _, h, _, n in rows}, {"BAM": 12, "AMMC": 20}
    near = {(s, h, j) for s, h, k, _ in rows for t, j, b, _ in rows if s == t and _levenshtein(k, b) <= 2}
    reach = Counter()
    for _, h, j in near:
        reach[j] += n[h]
    due = {(s, h, j) for s, h, j in near if reach[j] >= need[s]}
    arrays = {tuple(r) for r in lines.rare_classes(spellings, none, needs).collect()}
    assert due and due <= arrays <= near
    assert lines.rare_classes(spellings, spellings.select("source", "h"), needs).count() == 0
    monkeypatch.setattr(lines, "MOST_SENT", 0)
    joins = {tuple(r) for r in lines.rare_classes(spellings, none, needs).collect()}
    assert due <= joins <= near


def test_eight_spellings_and_joined_letters(spark):
    line = "Une ligne du site qui revient partout ici"
    spelt = [line[:k] + "#" + line[k + 1 :] for k in range(8)]
    arabic = "\u0644\u0627 \u064a\u062c\u0648\u0632 \u0644\u0644\u0645\u0624\u0633\u0633\u0627\u062a \u0644\u0627 \u0648\u0644\u0627 \u0627\u0644\u0646\u0634\u0631 \u0628\u062f\u0648\u0646 \u0625\u0630\u0646"
    forms_ = [arabic if i % 2 else arabic.replace("\u0644\u0627", "\ufefb") for i in range(8)]
    latin = ["Un e\ufb03cace suivi des \ufb02ux et du pro\ufb01l a\ufb00ecté" if i % 2 else "Un efficace suivi des flux et du profil affecté" for i in range(8)]
    for texts in (spelt, forms_, latin):
        df = spark.createDataFrame([(f"c{i}", t, f"f{i}", "BAM", "") for i, t in enumerate(texts)], CHUNK)
        assert lines.recurring_lines(df).count() == 8


def test_incremental_state(spark):
    line = "Une ligne du site qui revient partout ici"
    mk = lambda ids: lines.folded_lines(spark.createDataFrame([(f"c{i}", line, f"f{i}", "BAM", "") for i in ids], CHUNK))
    a, b = mk(range(3)), mk(range(2, 7))
    needs = spark.createDataFrame([("BAM", 5)], "source string, need int")
    before = lines.line_files(a)
    after = lines.merge_line_files(before, lines.line_files(b))
    assert lines.merge_line_files(after, lines.line_files(b)).count() == after.count() == 7
    crossed = lines.newly_crossed(before, after, needs)
    assert crossed.count() == 1 and lines.newly_crossed(after, after, needs).count() == 0
    assert {r["rec"] for r in lines.affected(a.unionByName(b), crossed).collect()} == {f"c{i}" for i in range(7)}


def test_partitions_end_in_the_same_lines(spark):
    """Copies with wrong characters count towards their class and are rebuilt when it crosses the need, or falls below it."""
    line = "Une ligne du site qui revient partout ici"
    spelt = [line, line, line.replace("site", "sitc"), line.replace("partout", "part0ut"), line.replace("revient", "rcvicnt"), line]
    other = "Une autre ligne que seuls deux fichiers de plus portent"
    rows = [(f"c{i}", f"texte {i}\n{v}" + (f"\n{other.replace('seuls', 'sculs') if i < 2 else other}" if i % 2 == 0 or i < 2 else ""), f"f{i}", "BAM", "") for i, v in enumerate(spelt)]
    parts = [spark.createDataFrame(r, CHUNK) for r in (rows[:4], rows[4:], [(f"d{i}", "texte", f"g{i}", "BAM", "") for i in range(200)])]
    first = lines.advance(None, parts[0])
    second = lines.advance(first, parts[1])
    assert lines.found_lines(first).count() == 0
    assert {tuple(r) for r in lines.found_lines(second).collect()} == {(f"c{i}", 1) for i in range(6)}
    assert {r["rec"] for r in lines.to_rebuild(first, second).collect()} == {f"c{i}" for i in range(4)}
    again = lines.advance(second, parts[1])
    assert lines.found_lines(again).count() == 6 and lines.to_rebuild(second, again).count() == 0
    third = lines.advance(second, parts[2])  # 206 files need 7
    assert lines.found_lines(third).count() == 0 and {r["rec"] for r in lines.to_rebuild(second, third).collect()} == {f"c{i}" for i in range(6)}
    whole = lines.recurring_lines(parts[0].unionByName(parts[1]))
    assert {tuple(r) for r in whole.collect()} == {(f"c{i}", 1) for i in range(6)}


def test_clashing_columns(spark):
    """Extra columns that carry the operators' own names change nothing and are kept."""
    line = "Une ligne du site qui revient partout ici"
    own = ["rec", "source", "key", "h", "line_no", "_x", "word", "tokens", "lang", "total", "native", "share", "area", "n", "piece", "form"]
    base = spark.createDataFrame([(f"c{i}", f"texte {i}\n{line}", f"f{i}", "BAM") for i in range(6)], "id string, text string, file string, issuer string")
    wide = base.withColumns({c: F.lit("z") for c in own})
    found = lines.recurring_lines(wide)
    assert {tuple(r) for r in found.collect()} == {(f"c{i}", 1) for i in range(6)}
    out = lines.without_lines(wide, found)
    assert set(out.columns) == set(wide.columns) and {r["text"] for r in out.collect()} == {f"texte {i}" for i in range(6)}
    assert scan.by_source(wide, spark.createDataFrame([("f0", "native")], "file string, text_source string")).where("not was_scanned").count() == 1
    docs, names, labels = _area_tables(spark, [(1, "Le coussin de trésorerie est revu.", "t", "u", "ssss")])
    docs = docs.withColumns({c: F.lit("z") for c in own})
    assert [r["area"] for r in areas.document_areas(docs, names, labels.withColumns({"n": F.lit(1), "share": F.lit(2)})).where("doc_id = 1").collect()] == ["liquidity"]
    assert pack.pack(pack.token_sizes(docs)).count() == 49 if TOKENIZERS else True


def test_lines_of_nothing(spark):
    assert lines.recurring_lines(spark.createDataFrame([], CHUNK)).count() == 0


# 2 scans ----------------------------------------------------------------------------------------------------------


def test_edit_scripts_apply():
    for a, b in (("exigcr", "exiger"), ("reti|re", "retirer"), ("agrérnent", "agrément"), ("mot", "mot"), ("clu", "du")):
        ops = scan.edit_script(a, b)
        assert len(ops) == len(a) + 1
        if sum(o != "K" for o in ops) == _levenshtein(a, b):
            assert scan.apply_edits(a, [(i, o) for i, o in enumerate(ops) if o != "K"]) == b


def _reader():
    clean = "les établissements assujettis contrôlent la séparation des pouvoirs exécutifs et peut exiger des mesures correctrices sous la responsabilité conformément agrément".split()
    swap = {"e": "c", "l": "|", "o": "0", "i": "!"}
    pairs = [(w[:i] + swap[w[i]] + w[i + 1 :], w) for w in clean for i in range(1, len(w)) if w[i] in swap] + [(w, w) for w in clean]
    firm = dict.fromkeys(clean, 50) | {"au-delà": 20, "porte-monnaie": 9}
    return scan.Reader(scan.CharacterEditor.fit(pairs).weights, firm)


def test_kinds_of_noise():
    r = _reader()
    title = "Circulaire n°73/G/2019 relative au programme Vralemare, le règlement des sinistres"
    text = "\n".join(["3", "Circulaire n°73/G/2019 relative au programme Vralemare,", "les établissements assu-", "jettis contrôlent la séparation au-", "delà des mesurcs correctrices", "le séparati0n des pou voirs", "12 | 45", "Mesabeti contrôlent", ""])
    assert r.kinds(text, title, 3, 3) == [(0, "page"), (1, "header"), (2, "hyphen"), (4, "char"), (5, "char")]
    assert r.kinds("7\n12\n3", title, 7, 7) == [] and r.kinds("", None, None, None) == []
    assert r.kinds("Mesabeti contrôlent", None, None, None) == []


def test_repair(spark):
    r = _reader()
    assert r.repaired("3\nles établissements assu-\njettis peut exigcr des mesures au-\ndelà des pou voirs.", None, 3, 3) == "les établissements assujettis peut exiger des mesures au-delà des pouvoirs."
    df = spark.createDataFrame([("a", None, None, None, None)], "id string, text string, title string, page_start int, page_end int")
    firm = spark.createDataFrame([("mot", 5)], "word string, n bigint")
    assert scan.repair(df, scan.CharacterEditor(), firm).first()["repaired"] is None
    assert scan.noise(df, scan.CharacterEditor(), firm).count() == 0


def test_vocabulary_of_any_size_gives_the_same(spark):
    r = _reader()
    title = "Circulaire n°73/G/2019 relative au programme Vralemare, le règlement des sinistres"
    texts = ["3\nles établissements assu-\njettis contrôlent la séparation au-\ndelà des mesurcs correctrices\nle séparati0n des pou voirs", "les porte-\nmonnaie des pou voirs exécutifs pcut ex!gcr", "", None, "peut peut cxiger p|ut"]
    df = spark.createDataFrame([(f"t{i}", t, title, 3, 3) for i, t in enumerate(texts)], "id string, text string, title string, page_start int, page_end int")
    rows = [(w, n) for w, n in r.firm.items()] + [(f"mot{i}", 3) for i in range(50)] + [("mesurcs", 2)]
    firm = scan.firm_words(spark.createDataFrame(rows, "word string, n bigint"))
    assert firm.count() == len(rows) - 1 and {x["three"] for x in scan.sequences(firm).collect()} == scan.Reader({}, dict(rows[:-1])).threes
    for f in (scan.noise, scan.repair):
        whole, parts = (sorted(map(tuple, f(df, r.editor, firm, most).collect()), key=str) for most in (1000, 10))
        assert whole == parts and len(whole) > 4


def test_fix_equals_all_edits_and_looks_at_few_places(monkeypatch):
    """Where a sequence of three letters is unknown, edits elsewhere are looked at only if they can be one of two."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9)))
    firm = {word(): 3 for _ in range(40)}
    labels = ["D", "K", *(o + c for o in "RI" for c in "abcd")]
    words = {word() for _ in range(300)} - set(firm) | {"abcdxabcd", "dcbax"}
    feats = sorted({f for w in words for i in range(len(w) + 1) for f in scan._features(w, i)})
    weights = {f: {x: rng.uniform(-2, 1) for x in rng.sample(labels, 4)} for f in rng.sample(feats, len(feats) // 2)}
    r, found = scan.Reader(weights, firm), 0
    for w in words:
        least, edits = next(x for n, x in scan.LEAST if len(w) < n), []
        for i in range(len(w) + 1):
            of: dict = {}
            for f in scan._features(w, i):
                for label, x in weights.get(f, {}).items():
                    of[label] = of.get(label, 0.0) + x
            keep = of.pop("K", 0.0)
            edits += [(x - keep, i, label) for label, x in of.items() if x - keep >= least]
        every = [(x, scan.apply_edits(w, [(i, o)])) for x, i, o in edits]
        both = [e for e in edits if e[0] >= max(scan.LEAST_TWO, least)]
        every += [(min(a[0], b[0]) - scan.TWO, scan.apply_edits(w, [a[1:], b[1:]])) for k, a in enumerate(both) for b in both[k + 1 :] if a[1] != b[1]]
        want = next((x for _, x in sorted(every, reverse=True) if len(x) > 1 and x in firm), None)
        assert r.fix(w) == want
        found += want is not None
    assert found > 20
    r = scan.Reader({"ca": {"Ro": 2.0}, "ce": {"Ri": -2.0}}, {"bonjourlesamis": 3})
    looked, real = [], scan.CharacterEditor._at
    monkeypatch.setattr(scan.CharacterEditor, "_at", lambda self, w, i: looked.append(i) or real(self, w, i))
    assert r.fix("bonjourlxsamis") is None and len(looked) == 3


def test_long_codes_are_edited_only_near_a_firm_word(monkeypatch):
    """A code of thousands of characters with known sequences of three letters has millions of pairs of edits."""
    rng = random.Random(7)
    code = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    firm = {x: 3 for x in (code(3000), code(40), code(25))}
    weights = {f"c{c}": {"Ra": 1.0, "Rb": 0.5, "D": 0.2} for c in "abcdefx"}
    asked, real = [], scan.CharacterEditor.proposals
    monkeypatch.setattr(scan.CharacterEditor, "proposals", lambda self, w, *x: asked.append(len(w)) or real(self, w, *x))
    r = scan.Reader(weights, firm)
    assert r.fix(code(3000)) is None and r.fix(code(3003)) is None and r.fix(code(40)) is None and not asked
    for w in list(firm)[1:]:
        i = w.index("a", 5)
        assert r.fix(w[:i] + "x" + w[i + 1 :]) == w and r.fix(w[:i] + "xx" + w[i + 1 :]) == w
    assert asked


def test_running_title_is_judged_once(monkeypatch):
    judged, real = [], scan._near
    monkeypatch.setattr(scan, "_near", lambda *x: judged.append(x) or real(*x))
    r = scan.Reader({}, {})
    title, line = "Circulaire relative au porte-monnaie mobile", "Circulaire relative aux porte"
    assert [r.is_header(line, t) for t in (title, "Note", title, None)] == [True, False, True, False] and len(judged) == 1
    for a, b in (("abcdefgh", "abxdefgh"), ("abcdefgh", "bcdefghi"), ("aaaa", "aa"), ("", "ab"), ("abc", ""), ("xaaay", "yaaax"), ("abcabcabc", "abcabc")):
        for most in range(5):
            assert real(a, b, most) == (_levenshtein(a, b) <= most), (a, b, most)


# 3 truncation -----------------------------------------------------------------------------------------------------


def test_truncated(spark):
    ends = ["Les établissements transmettent chaque année un rapport complet.", "Les organismes transmettent chaque mois un rapport au conseil."]
    full = [("turns", i, "api", ends[i % 2] + f" Version {i}.") for i in range(20)]
    cut = [("turns", 100, "api", "Les établissements transmettent chaque année un rap"), ("turns", 101, "api", "Les organismes transmettent chaque mois un rapport au conseil et chaque année un"), ("turns", 102, "api", "Les organismes transmet…")]
    fine = [("turns", 200, "api", "Article 43"), ("turns", 201, "api", "81 %"), ("turns", 202, "api", "Voici :\n- un rapport complet\n- un rapport au conseil"), ("turns", 203, "api", "Les organismes transmettent chaque mois un rapport au conseil [2]"), ("turns", 204, None, "Oui")]
    vals = spark.createDataFrame(full + cut + fine, "tbl string, row_id bigint, source string, value string")
    got = {r["row_id"] for r in truncation.truncated(vals).where("cut").collect()}
    assert got == {100, 101, 102}
    assert truncation.truncated(vals.limit(0)).count() == 0


def test_limit_of_a_source(spark):
    rng = random.Random(2)
    words = "conseil rapport année mesure risque banque client compte taux marché".split()
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [("answers", i, "m", text(60)[:200]) for i in range(12)] + [("answers", 50 + i, "m", text(12)) for i in range(30)]
    got = {r["row_id"] for r in truncation.truncated(spark.createDataFrame(rows, "tbl string, row_id bigint, source string, value string")).where("cut").collect()}
    assert set(range(12)) <= got and not any(i >= 50 for i in got)


def test_values_drop_blank_and_repeated(spark):
    a = spark.createDataFrame([(1, "s", None), (2, "s", " "), (3, "s", "x"), (3, "s", "x")], "answer_id bigint, source string, answer string")
    t = spark.createDataFrame([], "turn_id bigint, source string, answer string")
    assert [(r["tbl"], r["row_id"]) for r in truncation.values(a, t).collect()] == [("answers", 3)]


# 4, 8, 9 tokens ---------------------------------------------------------------------------------------------------

HARD = ["", None, "a", "don't we'll\n\n\n  ok", "é" * 100, "<|endoftext|>", "🙂👍🏽" * 20, "=" * 500, "ab" * 999, " " * 300 + "x", "x²½ Ⅷ ٣٤ ＡＢ", "المادة 3 نص", "a\x1cb c d", "tail  ", "aaaaaaaaaaaaaa" * 50]


@pytest.mark.skipif(not TOKENIZERS, reason="no tokenizer files")
def test_ids_equal_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("abcé 12'\n.العر") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert all(got[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert bpe.encode_texts(df.limit(0)).count() == 0


@pytest.mark.skipif(not TOKENIZERS, reason="no tokenizer files")
def test_parts_count_like_the_whole(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdeé'.;  ") for _ in range(9)) for _ in range(400)) + "\n\n  end" + "z" * 90
    parts = budget.independent_parts(long, 100)
    assert "".join(parts) == long and len(parts) > 10
    e = bpe.encoder(bpe.tokenizer_path())
    assert sum(e.counts(parts)) == e.counts([long])[0]
    rows = [("t", "1", "s", "fr", "h", long), ("t", "1", "s", "fr", "h", long), ("t", "2", None, None, None, None)]
    got = {r["key"]: r["tokens"] for r in budget.record_tokens(spark.createDataFrame(rows, "tbl string, key string, source string, language string, host string, text string"), limit=100).collect()}
    assert got == {"1": e.counts([long])[0], "2": 0}


def test_language_labels(spark):
    rows = [("fr_MA",), ("Français",), ("AR",), ("en-GB",), ("und",), ("n/a",), ("",), (None,), ("spa",)]
    assert [r[0] for r in spark.createDataFrame(rows, "l string").select(budget.language_code(F.col("l"))).collect()] == ["fr", "fr", "ar", "en", None, None, None, None, "es"]


def test_sum_of_squares_is_the_rule():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 41, 300)
    got = pack.sum_of_squares(sizes, 40)
    level: list[int] = []
    for s, b in zip(sizes.tolist(), got.tolist(), strict=True):
        def score(k, s=s):
            new = [*level, 0] if k == len(level) else list(level)
            new[k] += s
            gaps = [40 - x for x in new if 0 < x < 40]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        options = [k for k in range(len(level) + 1) if (level[k] if k < len(level) else 0) + s <= 40]
        assert score(b if b < len(level) else len(level)) == min(map(score, options))
        if b == len(level):
            level.append(0)
        level[b] += s
    assert max(level) <= 40


def test_pack_keeps_everything(spark):
    sizes = spark.createDataFrame([(1, 0), (2, 5000), (3, 2048), (4, 100), (5, 1948), (6, 0)], "doc_id bigint, tokens bigint")
    rows = pack.pack(sizes).collect()
    per, doc = {}, {}
    for r in rows:
        per[r["container"]] = per.get(r["container"], 0) + r["tokens"]
        doc[r["doc_id"]] = doc.get(r["doc_id"], 0) + r["tokens"]
    assert max(per.values()) <= 2048 and doc == {1: 0, 2: 5000, 3: 2048, 4: 100, 5: 1948, 6: 0}
    assert {r["doc_id"] for r in rows if r["part"] > 0} == {2} and pack.pack(sizes.limit(0)).count() == 0


# 5 forms ----------------------------------------------------------------------------------------------------------


def test_sql_and_python_forms_agree(spark):
    texts = ["m\u0435\u0455ur\u0435s \ufb01n \uff4c\uff45\uff11\uff12", "\ufefb \ufe8e \ufdf2 e\u0301", "e\u200bmpty\u00ad 10\u00a0000 10\u2009000", "a\u2011b\u2010c", "E=mc² “x” ’", "", None, "日本 中文", "\u0397 Η", "A\nB\u2028C"]
    got = [r["form"] for r in canon.canonical(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "form").collect()]
    assert got == [None if t is None else forms.print_alike(t) for t in texts]
    assert forms.print_alike("m\u0435\u0455ur\u0435s") == "mesures" and forms.print_alike("x²") == "x²" and forms.print_alike("É") != forms.print_alike("E")


def test_print_alike_pairs(spark):
    ch = spark.createDataFrame([("c1", "f", "un délai de 10 jours"), ("c2", "f", "un de\u0301lai de\u00a010 jours"), ("c3", "f", "un délai de 10 jours"), ("c4", "g", "un delai de 10 jours"), ("c1", "f", "un délai de 10 jours"), ("c5", "f", None)], "id string, file string, text string")
    ev = "struct<file string, page int, quote string>"
    go = spark.createDataFrame([("g1", "Quel délai ?", ("f", 1, "délai de 10")), ("g2", "Qu\u0435l délai ?", None), ("g3", None, ("g", 1, "délai"))], f"id string, question string, evidence {ev}")
    got = {tuple(r) for r in canon.print_alike_pairs(ch, go).collect()}
    assert got == {("chunk", "c1", "c2"), ("chunk", "c2", "c3"), ("question", "g1", "g2"), ("quote", "c2", "g1")}
    assert canon.print_alike_pairs(ch.limit(0), go.limit(0)).count() == 0


def test_quotes_meet_few_chunks(spark):
    """All quotes and chunks in one file: few pairs are compared, and the pairs found are those of comparing all."""
    rng = random.Random(5)
    letters = "abcdeéfiﬁ \u0430\u00a0-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    odd = {"\u0430": "a", "\u00a0": " ", "ﬁ": "fi"}
    quotes = ["\u200b", "a", "b\u200b"]
    for t in texts * 2:
        i = rng.randrange(len(t))
        quotes.append("".join(odd.get(c, c) if rng.random() < 0.5 else c for c in t[i : i + rng.choice((1, 2, 3, 14, 15, 16, 38, 39, 40, 200))]))
    ch = spark.createDataFrame([(f"c{i:03}", "f", t) for i, t in enumerate(texts)], "id string, file string, text string")
    go = spark.createDataFrame([(f"g{i:03}", None, ("f", 1, q)) for i, q in enumerate(quotes)], "id string, question string, evidence struct<file string, page int, quote string>")
    got = {tuple(r)[1:] for r in canon.print_alike_pairs(ch, go).where("kind = 'quote'").collect()}
    form = forms.print_alike
    assert got == {(f"c{i:03}", f"g{j:03}") for i, t in enumerate(texts) for j, q in enumerate(quotes) if form(q) in form(t) and q not in t}
    for t in texts:
        for tier, (_, _, least) in enumerate(canon.TIERS):
            if len(t) > least:
                i = rng.randrange(len(t) - least)
                assert set(canon.prints(t[i : i + least], tier)) <= set(canon.prints(t, tier))
    seen = spark.createDataFrame([(i, "f", canon.prints(form(t), 0).tolist()) for i, t in enumerate(texts)], "rid bigint, file string, prints array<bigint>")
    asked = spark.createDataFrame([(i, "f", canon.prints(form(t), 0).tolist()) for i, t in enumerate(texts) if len(form(t)) >= 39], "qid bigint, file string, prints array<bigint>")
    assert asked.count() <= canon.quote_pairs(seen, asked).count() < 2 * len(texts)


# 6 languages ------------------------------------------------------------------------------------------------------

WORDS = {
    "fr": "les établissements sont tenus de transmettre un rapport à l autorité dans un délai de trente jours".split(), "en": "the institutions shall submit a report to the authority within thirty days of the notice".split(),
    "es": "las entidades deben remitir un informe a la autoridad en el plazo de treinta días".split(), "ar": "يجب على المؤسسات تقديم تقرير إلى السلطة داخل أجل ثلاثين يوما".split(),
}


def test_automaton_is_exact():
    text = "banana ananas savane"
    a = language.SuffixAutomaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    def known(s):
        state = 0
        for c in s:
            if c not in a.go[state]:
                return False
            state = a.go[state][c]
        return True
    rng = random.Random(6)
    assert all(map(known, subs))
    assert all(known(s) == (s in subs) for s in ("".join(rng.choice("bansve x") for _ in range(rng.randrange(1, 6))) for _ in range(500)))
    assert a.phrases("banane") == 2 and a.phrases("xx") == 2 and a.phrases("a ana") == 1


def test_parse_side_by_side_is_the_greedy_parse():
    labelled = {k: " ".join(w) for k, w in WORDS.items()}
    p = language.Parser(labelled)
    automata = [language.SuffixAutomaton(labelled[k]) for k in language.LANGS]
    rng = random.Random(10)
    words = [*sum(WORDS.values(), []), "xyz", "12", "q", "É", "e\u0301t\u00e9", "\u200b", "—"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(200)]
    text, start, stop, n, letters, phrases = p.sentences(texts)
    seen = {}
    for t, a, z, size, got in zip(text.tolist(), start.tolist(), stop.tolist(), letters.tolist(), phrases.tolist(), strict=True):
        s = language.plain(forms.print_alike(texts[t])[a:z] if texts[t].isascii() else language.unicodedata.normalize("NFC", texts[t])[a:z])
        assert len(s) == size and got == [x.phrases(s) for x in automata]
        seen[t] = seen.get(t, "") + s
    assert all(seen.get(i, "") == language.plain(t) for i, t in enumerate(texts))
    assert p.sentences([])[0].size == 0 and p.sentences(["", "12 !"])[0].size == 0


def test_long_sentences_and_unknown_languages():
    p = language.Parser({k: " ".join(w) for k, w in WORDS.items()})
    for k, w in WORDS.items():
        for times in (1, 700, 4000):
            n, lang, sure = p.judge(" ".join(w * times))
            assert (n, language.LANGS[lang]) == (len(w) * times, k) and sure > 0.3
    assert p.judge("Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich")[1] == -1 and p.judge("12 % !") == (0, -1, 0.0)


def test_languages(spark):
    fr, en, ar, es = (" ".join(WORDS[k]) + "." for k in ("fr", "en", "ar", "es"))
    rows = [("c1", f"{fr} {fr}", "f", "t", "fr"), ("c2", f"{fr} {en}", "f", "t", "French"), ("c3", en, "f", "t", None), ("c4", f"{ar}\n{es}", "g", "t", "ar"), ("c5", None, "g", "t", "fr"), ("c6", "12 %", "g", "t", "fr"), ("c1", f"{fr} {fr}", "f", "t", "fr")]
    ch = spark.createDataFrame(rows, "id string, text string, file string, title string, language string")
    texts = spark.createDataFrame([(f"{k}{i}", k, " ".join(w)) for k, w in WORDS.items() for i in range(4)], "key string, label string, text string")
    meta = spark.createDataFrame([("f", "xx"), ("g", "ar"), ("h", "fr")], "file string, language string")
    got = {tuple(r) for r in language.found(ch, meta, texts, None).collect()}
    assert got == {("chunk", "c2", "fr"), ("chunk", "c2", "en"), ("chunk", "c3", "en"), ("chunk", "c4", "ar"), ("chunk", "c4", "es"), ("file", "f", "fr"), ("file", "g", "es")}
    s = language.stretches(ch, language.labelled_text(texts)).where("id = 'c4'").orderBy("stretch").collect()
    assert [r["lang"] for r in s] == ["ar", "es"] and all(0 < r["confidence"] <= 1 for r in s)
    assert language.found(ch.limit(0), meta.limit(0), texts.limit(0), None).count() == 0


def test_every_file_and_chunk_has_a_language(spark):
    fr, en, ar, es = (" ".join(WORDS[k]) + "." for k in ("fr", "en", "ar", "es"))
    rows = [("c1", f"{fr} {fr}", "f", "t", "fr"), ("c2", f"{fr} {en}", "f", "t", "French"), ("c3", en, "f", "t", None), ("c4", f"{ar}\n{es}", "g", "t", "ar"), ("c5", None, "g", "t", "fr"), ("c6", "12 %", "g", "t", "fr"), ("c1", f"{fr} {fr}", "f", "t", "fr")]
    ch = spark.createDataFrame(rows, "id string, text string, file string, title string, language string")
    texts = spark.createDataFrame([(f"{k}{i}", k, " ".join(w)) for k, w in WORDS.items() for i in range(4)], "key string, label string, text string")
    meta = spark.createDataFrame([("f", "xx"), ("g", "ar"), ("h", "fr")], "file string, language string")
    every = {(r["level"], r["rec"]): (r["lang"], r["confidence"]) for r in language.languages(ch, meta, texts, None).collect()}
    assert {k: v[0] for k, v in every.items()} == {("chunk", "c1"): "fr", ("chunk", "c2"): "fr", ("chunk", "c3"): "en", ("chunk", "c4"): "es", ("chunk", "c5"): None, ("chunk", "c6"): None, ("file", "f"): "fr", ("file", "g"): "es", ("file", "h"): None}
    assert all((lang is None) == (sure is None) and (sure is None or 0 <= sure <= 1) for lang, sure in every.values())
    assert every["chunk", "c1"][1] > every["chunk", "c2"][1] and every["chunk", "c3"][1] > 0.3 and every["file", "f"][1] < every["chunk", "c1"][1]


# 7 pieces ---------------------------------------------------------------------------------------------------------


def test_pieces_cover_and_end_well():
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(["mot ", "fin. ", "suite; ", "\n", "\n\n", "Article 3 ", "é", "x" * 40]) for _ in range(rng.randrange(1, 900)))
        spans = split.pieces(text)
        assert all(b - a <= 1200 for a, b in spans) and (not text or (spans[0][0] == 0 and spans[-1][1] == len(text)))
        assert all(x[0] < y[0] <= x[1] and x[1] - y[0] <= 200 and y[1] > x[1] for x, y in zip(spans, spans[1:], strict=False))
    at, s = split.boundaries("Un. Deux ; trois\n\nquatre\nArticle 2 cinq, six")
    assert s.tolist() == [split.STOP, split.WORD, split.CLAUSE, split.PARAGRAPH, split.HEADING, split.WORD, split.WORD, split.COMMA]
    assert split.pieces("x" * 2500)[0] == (0, 1200)


def test_strongest_cut_matches_brute_force():
    rng = np.random.default_rng(8)
    s = rng.integers(0, 5, 200)
    cut = split.StrongestCut(s)
    for _ in range(500):
        a, b = sorted(rng.choice(201, 2, replace=False).tolist())
        assert cut(a, b) == max(range(a, b), key=lambda i: (s[i], i))


def test_split_items(spark):
    rows = [("t", "a", None, "mot " * 400), ("t", "a", None, "mot " * 400), ("t", "b", "s", "court"), ("t", "c", "s", None), ("t", "d", "s", "")]
    out = split.split_oversized(spark.createDataFrame(rows, "tbl string, item string, section string, text string"))
    assert {r["item"] for r in out.collect()} == {"a"} and out.groupBy("item", "piece").count().where("count > 1").count() == 0


# 10 areas ---------------------------------------------------------------------------------------------------------

AREAS = [("payments", "Moyens de paiement", "Payments"), ("liquidity", "Liquidité et solvabilité", "Liquidity and solvency"), (None, None, None)]


def _area_tables(spark, docs=()):
    """24 labelled documents an area, which say so in two different phrases, and the given ones."""
    said = {"payments": ("le porte-monnaie mobile", "les virements instantanés"), "liquidity": ("le coussin de trésorerie", "les actifs de premier rang")}
    rows, labels = [], []
    for k, (area, (a, b)) in enumerate(said.items()):
        for i in range(24):
            doc = 1000 + 100 * k + i
            rows.append((doc, f"La société {i} décrit {a if i % 3 else b} ici. Le texte {'abcdefghijklmnopqrstuvwx'[i] * 5} prend effet. L'autorité vérifie {b if i % 2 else a} aussi.", f"Note {i}", None, "s"))
            labels += [(doc, area, "x"), (doc, area, "y")]
    labels += [(1, "none", "x"), (None, "payments", "x"), (77, None, "x")]
    return spark.createDataFrame(rows + list(docs), DOC), spark.createDataFrame(AREAS, "area string, label_fr string, label_en string"), spark.createDataFrame(labels, "doc_id bigint, area string, annotator string")


def test_areas(spark):
    pay, liq, none = "Le porte-monnaie mobile est contrôlé.", "Le coussin de trésorerie est revu.", "Le secrétariat répond sous dix jours."
    rows = [(1, " ".join([pay] * 3 + [none]), "Note", None, "s"), (2, " ".join([liq, none, none, none]), None, None, None), (3, " ".join([liq] + [none] * 4), "x", "u", "s"), (4, None, None, None, None), (5, "  ", "", "", ""), (6, f"{pay} {liq}", "t", "u", "s"), (7, "Le coussin de\ntrésorerie est rеvu. Le cous-\nsin de trésorerie est là.", "t", "u", "s")]
    rows += [rows[0]]
    got = {}
    for r in areas.document_areas(*_area_tables(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    assert got[1] == {"payments"} and got[2] == {"liquidity"} and 3 not in got and 4 not in got and 5 not in got and got[6] == {"payments", "liquidity"} and got[7] == {"liquidity"}
    docs, names, labels = _area_tables(spark)
    assert areas.document_areas(docs.limit(0), names, labels).count() == 0
    assert areas.document_areas(docs, names, labels.limit(0)).count() == 0 and areas.document_areas(docs, names.limit(0), labels).count() == 0


def test_lexicon_is_learned_from_labels(spark):
    docs, names, labels = _area_tables(spark)
    lex = areas.learned_lexicon(areas.labelled_docs(docs, labels), ["liquidity", "payments"])
    assert lex["porte-monnaie mobile"] == ("payments", 3) and lex["coussin de tresorerie"] == ("liquidity", 3) and "prend effet" not in lex and "la societe" not in lex
    assert areas.named_lexicon(names)["paiement"] == ("payments", 1)
    want = areas.agreement(areas.document_areas(docs, names, labels), labels).first()
    assert want["labels"] == 48 and want["both"] >= 46


def test_latent_model_prefers_accurate_functions():
    rng = random.Random(9)
    counts, truth = {}, {}
    for _ in range(20000):
        y = rng.random() < 0.2
        lex = rng.choice([3, 3, 3, 2]) if y and rng.random() < 0.9 else (1 if rng.random() < 0.05 else 0)
        p = (lex, y and rng.random() < 0.5, y and rng.random() < 0.4, rng.random() < 0.3)
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + y
    post = areas.learn(counts, 0)
    assert all(post[p] > 0.5 for p in counts if p[0] == 3) and post[0, False, False, False] < 0.2
    wrong = sum(min(truth[p], n) if post[p] < 0.5 else n - truth[p] for p, n in counts.items())
    assert wrong / 20000 < 0.03


def test_votes_by_the_needed_sequences_only_equal_those_by_all():
    # two words tell the area already: longer sequences with them aren't searched for, unless they tell another area
    said = ["coussin de tresorerie", "le coussin de tresorerie", "coussin de tresorerie mobile", "le coussin de tresorerie mobile"]
    lex = {x: ("liquidity", len(x.split())) for x in said} | {"le coussin": ("payments", 2), "tresorerie": ("liquidity", 1), "solvabilite": ("liquidity", 1), "virements": ("payments", 1)}
    find = areas.Matcher(lex, names := ["liquidity", "payments"])
    assert set(find.automaton) == {"coussin de tresorerie", "le coussin", "tresorerie", "solvabilite", "virements"}
    every = areas.Matcher({}, names)
    for x, (area, n) in lex.items():
        every.automaton.add_word(x, (len(x), names.index(area), areas.TERM if n > 1 else areas.WORD, x))
    every.automaton.make_automaton()
    every.empty = False
    rng = random.Random(4)
    words = ["le", "coussin", "de", "trésorerie", "mobile", "solvabilité", "virements", "où", "fin.", "fin. Le", "\n", "وcoussin", "coussin de trésorerie", "e\u0301t", "ﬁn"]
    for _ in range(300):
        text, title, url = (" ".join(rng.choices(words, k=k)) for k in (rng.randrange(1, 60), 4, 4))
        body, seen = areas._running_text(text, title, ""), {}
        stops = [m.end() for m in areas._ends.finditer(body)]
        if not stops or len(body[stops[-1] :].split()) >= 5:
            stops.append(len(body) + 1)
        for end, k, kind, x in every(body):
            if (i := sum(stop <= end for stop in stops)) < len(stops):
                seen.setdefault((i, k), set()).add(areas.TERM if kind == areas.TERM else x)
        ways, want = (every.named(url.replace("-", " ")), every.named(title)), Counter()
        for (_, k), x in seen.items():
            want[k, areas.TERM if areas.TERM in x else min(len(x), areas.WORDS), k in ways[0], k in ways[1]] += 1
        for k in ways[0] | ways[1]:
            want[k, 0, k in ways[0], k in ways[1]] += len(stops) - sum(n for (a, *_), n in want.items() if a == k)
        assert areas.votes(find, text, title, url, None) == (len(stops), +want)


def test_long_texts_fold_as_short_ones():
    every = "".join(map(chr, range(0x110000)))
    parts = [every[i : i + 90] for i in range(0, len(every), 90)]
    short = list(map(areas.fold, parts))
    assert areas.fold(every) == "".join(short)
    for i in range(0, len(parts), 3):
        assert areas.fold("".join(parts[i : i + 3])) == "".join(short[i : i + 3])


# all --------------------------------------------------------------------------------------------------------------


def test_queries_run_on_the_smallest_tables(spark):
    from corpusloom.llm import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    columns = {"p1_found": ["chunk_id", "line_no"], "p2_found": ["chunk_id", "line_no", "kind"], "p3_found": ["tbl", "row_id"], "p5_found": ["kind", "key_a", "key_b"], "p6_found": ["level", "rec", "lang"], "p7_found": ["tbl", "item"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "area"]}
    for name, q in queries.QUERIES.items():
        if not TOKENIZERS and name in ("p4_tokens", "p8_ids", "p9_containers"):
            continue
        df = q(spark, d)
        assert df.count() > 0, name
        if name in columns:
            assert df.columns == columns[name]
            assert df.count() == (df.distinct().count() if name != "p8_ids" else spark.read.parquet(f"{d}/documents.parquet").count())


def test_texts_come_out_whole(spark):
    """Every chunk without its site lines, every scanned chunk and page repaired, every text of three columns in its form."""
    from corpusloom.llm import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    chunks, golden = read("chunks"), read("golden")
    texts = {r["id"]: r["text"] for r in chunks.select("id", "text").collect()}
    gone = {}
    for r in queries.p1_found(spark, d).collect():
        gone.setdefault(r["chunk_id"], set()).add(r["line_no"])
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in texts.items()}
    assert {r["chunk_id"]: r["text"] for r in queries.p1_cleaned(spark, d).collect()} == want and gone
    got = queries.p2_repaired(spark, d).collect()
    scanned = {r["id"] for r in scan.by_source(chunks, read("doc_meta")).where("was_scanned").select("id").collect()}
    assert {r["key"] for r in got if r["kind"] == "chunk"} == scanned
    assert {r["key"] for r in got if r["kind"] == "page"} == {r["id"] for r in scan.payload_pages(read("ocr_payload"), read("doc_meta")).collect()}
    assert all((r["text"] is None) == (texts[r["key"]] is None) for r in got if r["kind"] == "chunk")
    want = {("chunks.text", i, t) for i, t in texts.items()} | {("golden.question", r["id"], r["question"]) for r in golden.collect()} | {("golden.evidence.quote", r["id"], r["evidence"] and r["evidence"]["quote"]) for r in golden.collect()}
    assert {tuple(r) for r in queries.p5_forms(spark, d).collect()} == {(c, i, None if t is None else forms.print_alike(t)) for c, i, t in want}


def test_edits_that_cannot_give_a_known_word_are_passed_over():
    r = _reader()
    for w in ("exigcr", "mesurcs", "respcnsabi|ité", "conf0rmement", "lcs", "xyzzyx"):
        every = [p for p in r.editor.proposals(w, -3.0) if p[1] in r.firm]
        assert [p for p in r.editor.proposals(w, -3.0, r.threes) if p[1] in r.firm] == every


def test_line_ends_and_furniture_are_learned():
    ends = [(scan.join_features(a, b, set()), y) for a, b, y in (("établis", "sement", "J"), ("mesu", "res", "J"), ("porte", "monnaie", "H"), ("porte", "parole", "H"))]
    e = scan.CharacterEditor.fit([], ends)
    assert e.prefers(scan.join_features("contrôles", "sement", set()), "J", "H") > 0 > e.prefers(scan.join_features("porte", "avions", set()), "J", "H")
    assert scan.CharacterEditor().prefers(("j",), "J", "H") is None
    native = "La banque contrôle 12 agences.\n12\nLe conseil vérifie."
    pages = [(12, f"12\n{native.replace(chr(10) + '12', '')}", native.replace("\n12", "")) for _ in range(6)]
    pages += [(12, "La banque contrôle\n12\nagences du pays.", "La banque contrôle\n12\nagences du pays.") for _ in range(6)]
    m = scan.CharacterEditor.fit([], [], scan._furniture(pages, None))
    r = scan.Reader(m.weights, {})
    assert r.kinds("12\nLa banque contrôle.\nLe conseil vérifie.", None, 12, 12) == [(0, "page")]
    assert r.kinds("La banque contrôle\n12\nagences du pays.", None, 12, 12) == []
