import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import top_by_blocks
from corpusloom.operators import answer, chunking, evaluate, index, metadata, search, serving
from corpusloom.session import shared_dir
from corpusloom.sources import pages
from corpusloom.streaming import jobs


def test_windows_lose_no_word():
    text = " ".join(f"mot{i}" for i in range(400))
    spans = list(chunking.Outline(text).windows(0, len(text), 120, 30))
    assert all(b - a <= 120 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    words = {w for a, b in spans for w in text[a:b].split()}
    assert words == set(text.split())
    assert all(y[0] < x[1] for x, y in zip(spans, spans[1:], strict=False))


def test_article_headings_are_repaired():
    text = "Article 11 Un. Article 42 Deux. Article 13 Trois. selon l'article 5 ci-dessus. المادة 3 نص"
    assert [x for _, x in chunking.article_headings(text)] == ["Article 11", "Article 12", "Article 13", "Article 3"]


def test_legal_sections():
    spans = chunking.page_spans(["Préambule court.", "Article 1 Petit. Article 2 Petit aussi. Article 3 " + "Une phrase assez longue pour compter. " * 20], "legal", 400, 60)
    assert spans[0][3] is None and spans[1][3] == "Articles 1-2" and all(len(s[0]) <= 400 for s in spans)
    assert {s[3] for s in spans[2:]} == {"Article 3"} and spans[-1][2] == 2


def test_table_stays_with_its_introduction():
    table = "Le barème est : " + " ".join(f"{i} % {i * 3}" for i in range(22))
    text = "Article 1 Début. " * 3 + table
    assert any(len(s[0]) > 150 and "barème" in s[0] for s in chunking.page_spans([text], "legal", 150, 20))


def test_chunking_edges(spark):
    schema = "file string, page int, text string"
    assert chunking.chunk_documents(spark.createDataFrame([], schema), "fixed").count() == 0
    df = spark.createDataFrame([("a", 1, None), ("a", 2, " "), ("b", 1, "x"), ("b", 1, "x"), ("c", None, "y")], schema)
    assert [tuple(r) for r in chunking.chunk_documents(df, "fixed").collect()] == [("b", 0, "x", 1, 1, None)]
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, "other")
    with pytest.raises(ValueError):
        chunking.page_spans(["a"], "fixed", 10, 10)
    far = spark.createDataFrame([("a", 1, "un"), ("a", 5, "deux trois"), ("a", 9, " ")], schema)
    assert [tuple(r)[2:5] for r in chunking.chunk_documents(far, "sentence", 7, 0).collect()] == [("un deux", 1, 5), ("trois", 5, 5)]


def test_packs_match_a_plain_walk():
    """Sentences walked one by one, as the definition says, against the searches in the outline."""
    rng = np.random.default_rng(3)
    words = ["mot", "phrase", "banque", "taux ;", "fin.", "Note :", "12", "3 %", "long" * 9, "Suite.", "(a)"]
    for _ in range(150):
        text = " ".join(rng.choice(words, rng.integers(1, 120)))
        o, size, overlap = chunking.Outline(text), 80, int(rng.integers(0, 60))
        begin, stop = o.sentences(0, len(text))
        assert "".join(text[begin[0] : stop[-1]]) == text and not any(text[a:b].rstrip().endswith(":") for a, b in list(zip(begin, stop, strict=True))[:-1])
        want, pack = [], []
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            if b - a > size:
                want += [(pack[0][0], pack[-1][1])] if pack else []
                pack = []
                want += [(a, b)] if b - a <= 2 * size and chunking.table_like(text[a:b]) else list(o.windows(a, b, size, overlap))
                continue
            if pack and b - pack[0][0] > size:
                want.append((pack[0][0], pack[-1][1]))
                pack = [u for u in pack if pack[-1][1] - u[0] <= overlap and b - u[0] <= size]
            pack.append((a, b))
        want += [(pack[0][0], pack[-1][1])] if pack else []
        got = list(o.packs(0, len(text), size, overlap, 2 * size))
        assert got == (want if len(text) > size else [(0, len(text))])


def test_numbers_of_headings():
    assert [chunking.heading_number(x) for x in ("premier", "12 bis", "3 . 2", "7", "الأولى")] == [("premier", 1), ("12 bis", 12), ("3.2", None), ("7", 7), ("premier", 1)]


def _chunks(spark):
    rows = [("c1", "le ratio de solvabilité des banques", "BAM", "fr", "2020-01-01"), ("c2", "la lutte contre le blanchiment", "AMMC", "fr", None), ("c3", "circulaire n° 9/W/2098 sur le risque", "BAM", "fr", "2021-06-01"), ("c1", "le ratio de solvabilité des banques", "BAM", "fr", "2020-01-01"), ("c4", None, "BAM", "ar", "2022-01-01")]
    return spark.createDataFrame(rows, "id string, text string, issuer string, language string, published string").withColumn("published", F.col("published").cast("date"))


def _questions(spark):
    return spark.createDataFrame([("q1", "ratio de solvabilité"), ("q2", "9 w 98"), ("q3", None)], "query_id string, question string")


def test_search_modes(spark):
    c, q = _chunks(spark), _questions(spark)
    best = {r["query_id"]: r["chunk_id"] for r in search.bm25(c, q, 1).collect()}
    assert best == {"q1": "c1", "q2": "c3"}
    d = search.dense(c, q, 2)
    assert d.where("query_id = 'q1' and rank = 1").first()["chunk_id"] == "c1" and d.where("query_id = 'q3'").count() == 0
    h = search.hybrid(c, q, 3)
    assert h.where("query_id = 'q2' and rank = 1").first()["chunk_id"] == "c3"
    assert h.groupBy("query_id", "chunk_id").count().where("count > 1").count() == 0
    empty = c.limit(0)
    assert search.hybrid(empty, q).count() == 0 and search.dense(c, q.limit(0)).count() == 0


def test_filter_is_inclusive_and_drops_null_dates(spark):
    f = search.SearchFilter(date_from="2020-01-01", date_to="2021-06-01")
    assert sorted(r["id"] for r in _chunks(spark).dropDuplicates(["id"]).where(f.condition()).collect()) == ["c1", "c3"]
    assert search.SearchFilter().is_empty and search.SearchFilter(issuers=("B", "A")).key() == "A,B|||"


def test_rerank_keeps_first_score(spark):
    c, q = _chunks(spark), _questions(spark)
    hits = spark.createDataFrame([("q1", "c2", 0.9, 1), ("q1", "c1", 0.5, 2)], "query_id string, chunk_id string, score double, rank int")
    out = search.rerank(hits, q, c).orderBy("rank").collect()
    assert [(r["chunk_id"], r["first_stage_score"]) for r in out] == [("c1", 0.5), ("c2", 0.9)]


def test_exact_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<double>").repartition(5)
    got = top_by_blocks(rows, "id", "v", rows.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv")), "q", "qv", 4).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 100, 200):
        want = np.lexsort((np.arange(300), -np.round(u @ u[q], 9)))[:4].tolist()
        assert [r["id"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == want


def test_index_lifecycle(spark, tmp_path):
    root = str(tmp_path / "index")
    cols = "id string, file string, text string, content_sha256 string"
    first = spark.createDataFrame([("1", "a", "un texte", "s1"), ("2", "b", "deux textes", "s2")], cols)
    assert not index.exists(spark, root) and index.count(spark, root) == 0
    assert {(r["file"], r["status"]) for r in index.ingest(root, first).collect()} == {("a", "added"), ("b", "added")}
    assert {r["status"] for r in index.ingest(root, first).collect()} == {"unchanged"}
    changed = spark.createDataFrame([("3", "a", "autre texte", "s3"), ("4", "c", "nouveau", "s4")], cols)
    assert {(r["file"], r["status"]) for r in index.ingest(root, changed).collect()} == {("a", "updated"), ("c", "added")}
    assert sorted(r["id"] for r in index.read(spark, root, "chunks").collect()) == ["2", "3", "4"]
    assert "weight" in index.read(spark, root, "postings").columns


def test_index_touches_only_the_buckets_of_changed_files(spark, tmp_path):
    root = str(tmp_path / "index")
    cols = "id string, file string, text string, content_sha256 string, issuer string"
    words = ["taux", "fonds", "client", "capital", "risque", "avis"]
    rows = [(f"c{i}", f"f{i % 20}", " ".join(words[(i * j) % 6] for j in range(1, 3 + i % 5)), f"s{i}", "BAM" if i % 3 else None) for i in range(80)]
    rows += [("n", None, "avis sans fichier", None, None), ("t", "f1", None, "s", None), rows[0]]
    chunks = spark.createDataFrame(rows, cols)
    index.build(chunks, root, buckets=8)
    questions = spark.createDataFrame([(0, "taux des fonds"), (1, "avis client client"), (2, ""), (3, None)], "query_id long, question string")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(index.keyword_search(spark, root, questions), search.bm25(chunks, questions))
    only = search.SearchFilter(issuers=("BAM",))
    assert same(index.keyword_search(spark, root, questions, 3, only), search.bm25(chunks, questions, 3, only))

    before = index.catalog(spark, root)
    (old,) = before["generations"]
    new = spark.createDataFrame([("c5", "f5", "taux neuf", "x")], "id string, file string, text string, content_sha256 string")
    assert {(r["file"], r["status"]) for r in index.ingest(root, new).collect()} == {("f5", "updated")}
    after = index.catalog(spark, root)["generations"]
    touched = [g for g in after if g != old]
    assert len(after[old]["buckets"]) == 7 and len(touched) == 1 and len(after[touched[0]]["buckets"]) == 1
    whole = spark.createDataFrame([r for r in rows if r[1] != "f5"] + [("c5", "f5", "taux neuf", "x", None)], cols)
    assert same(index.read(spark, root, "chunks").select("id", "file", "text").distinct(), whole.select("id", "file", "text").distinct())
    ids = lambda d: sorted((r["query_id"], r["chunk_id"]) for r in d.collect())
    fresh = str(tmp_path / "fresh")
    index.build(whole, fresh, before["avg_len"], buckets=8)
    assert same(index.keyword_search(spark, root, questions, 100), index.keyword_search(spark, fresh, questions, 100)) and ids(index.keyword_search(spark, root, questions, 100))
    assert index.remove_unused(spark, root) == []
    index.build(whole, root)
    assert sorted(index.remove_unused(spark, root)) == sorted(after)
    empty = str(tmp_path / "empty")
    index.build(chunks.limit(0), empty)
    assert index.count(spark, empty) == 0 and index.keyword_search(spark, empty, questions).count() == 0
    index.ingest(empty, new)
    assert index.count(spark, empty) == 1


def test_ingest_status(spark):
    s = spark.createDataFrame([("a", "1", 2), ("b", "2", 1), ("d", "4", 1), ("e", None, 1)], "file string, sha string, n int")
    i = spark.createDataFrame([("a", "1", 2), ("b", "9", 1), ("c", "3", 1), ("e", None, 0)], "file string, sha string, n int")
    assert {(r[0], r[1]) for r in index.ingest_status(s, i, True).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "added"), ("d", "removed"), ("e", "emptied")}


def test_override_sets_even_null(spark):
    m = spark.createDataFrame([("a", "r1", "t1"), ("b", "r2", "t2")], "file string, reference string, title string")
    o = spark.createDataFrame([("a", ["reference"], None, "x")], "file string, fields array<string>, reference string, title string")
    assert {(r[0], r[1], r[2]) for r in metadata.override(m, o).collect()} == {("a", None, "t1"), ("b", "r2", "t2")}


def test_rate_limit_and_cache(spark):
    rows = [(i, 1, float(t)) for i, t in enumerate([0, 0, 0, 1, 60])] + [(9, 2, 5.0)]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["allowed"] for r in serving.rate_limited(e, per_minute=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 9: True}
    assert serving.rate_limited(e, per_minute=0).where("not allowed").count() == 0
    c = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate([0, 500, 600, 601, 1300])], "event_id bigint, k string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["event_id"]: r["hit"] for r in serving.cache_outcomes(c, "k").collect()} == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_answer_steps(spark):
    t = spark.createDataFrame([(1, i, f"q{i}", None if i == 2 else f"a{i} [1]") for i in range(1, 6)], "conv_id int, turn_no int, question string, answer string")
    last = answer.with_history(t).where("turn_no = 5").first()["history"]
    assert [h["question"] for h in last] == ["q1", "q3", "q4"]
    raw = spark.createDataFrame([("q", 2, "Oui [1] , non [7] ."), ("r", 1, "not_found")], "query_id string, sources int, text string")
    out = {r["query_id"]: r for r in answer.finished(raw, F.lit("rien")).collect()}
    assert out["q"]["answer"] == "Oui [1], non." and out["q"]["cited"] == [1] and out["r"]["answer"] == "rien" and out["r"]["abstention"] == "signal"


def test_filters_are_equal_whatever_their_order():
    a, b = search.SearchFilter(issuers=("B", "A", "B"), date_from="2020-01-01"), search.SearchFilter(issuers=("A", "B"), date_from="2020-01-01")
    assert a == b and a.key() == b.key()
    with pytest.raises(ValueError, match="after"):
        search.SearchFilter(date_from="2021-01-01", date_to="2020-12-31")


def test_judge_and_guard(spark):
    raw = ['```json {"claims": 4, "supported_claims": 9, "relevance": 8, "facts_conveyed": 3, "unsupported": ["a","b","c","d","e","f"]} ```', "none", '{"claims": 0, "relevance": 3, "facts_conveyed": -1}', "{broken", '{"claims": "2", "supported_claims": 1.0}', "{}", None]
    v = [r[0] for r in spark.createDataFrame([(r, 2) for r in raw], "raw string, facts int").select(answer.judge_verdict("raw", "facts")).collect()]
    assert [x and (x["faithfulness"], x["relevance"], x["correctness"]) for x in v] == [(1.0, 5, 1.0), None, (1.0, 3, 0.0), None, (0.5, 1, 0.0), (1.0, 1, 0.0), None]
    assert len(v[0]["unsupported"]) == 5
    nothing = spark.createDataFrame([("{}", 0)], "raw string, facts int").select(answer.judge_verdict("raw", "facts")).first()[0]
    assert nothing["correctness"] == 1.0
    ev = "struct<file:string,page:int,quote:string>"
    g = spark.createDataFrame([("g", "Q?", True, ["f1"], None, ("x", 1, "cite"), None, "n")], f"id string, question string, answerable boolean, expected_facts array<string>, derived_facts array<string>, evidence {ev}, extra_evidence array<{ev}>, notes string")
    a = spark.createDataFrame([(1, "g", "A", "none"), (2, "g", None, "none"), (3, "g", "B", "signal"), (4, "h", "C", "none")], "answer_id long, id string, answer string, abstention string")
    hits = spark.createDataFrame([("g", "c2", 2), ("g", "c1", 1)], "query_id string, chunk_id string, rank int")
    c = spark.createDataFrame([("c1", "R", "S", "un"), ("c2", None, None, None)], "id string, reference string, section string, text string")
    (p,) = answer.judge_prompts(a, g, hits, c).collect()
    assert (p["answer_id"], p["sources"], p["facts"]) == (1, 2, 1) and "[1] R S: un\n[2] : " in p["prompt"] and "cite" in p["prompt"] and p["prompt"].endswith("Notes\nn")
    cases = spark.createDataFrame([("ok", "ok"), ("ok", "meta"), ("meta", None)], "expected string, verdict string")
    assert {(r["expected"], r["n"], r["right"], r["accuracy"]) for r in evaluate.guard_accuracy(cases).collect()} == {("ok", 2, 1, 0.5), ("meta", 1, 0, 0.0)}
    assert evaluate.guard_mismatches(cases).count() == 2


def test_failing_model_gives_error_rows(spark):
    p = spark.createDataFrame([("q", 1, "x")], "query_id string, sources int, prompt string")

    def model(_):
        raise RuntimeError("down")

    r = answer.generate(p, model).first()
    assert r["text"] is None and r["error"] == "down"


def test_listing(spark):
    html = '<li><div class="views-field-title">Circulaire <b>1</b></div><a href="/a%20b.PDF?x=1">PDF</a></li><li><a href="c.pdf">Texte C</a><a href="c.pdf">again</a></li><a href="d.pdf"></a><a rel="next" href="?page=2">suite</a>'
    got = [(r["url"], r["title"], r["next_url"]) for r in pages.listing_links(spark.createDataFrame([("https://x.y/l/", html)], "url string, html string")).orderBy("position").collect()]
    nxt = "https://x.y/l/?page=2"
    assert got == [("https://x.y/a%20b.PDF?x=1", "Circulaire 1", nxt), ("https://x.y/l/c.pdf", "Texte C", nxt), ("https://x.y/l/d.pdf", "d", nxt)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.ocr.json").write_text('{"engine": "e", "language": "fr", "dpi": 300, "pages": [{"page": 1, "text": "un"}]}')
    (tmp_path / "a.yaml").write_text("title: 'Un titre'\nreference: null\nissuer: BAM\n")
    assert [(r["page"], r["text"]) for r in pages.ocr_pages(spark, str(tmp_path)).collect()] == [(1, "un")]
    assert pages.yaml_metadata(spark, str(tmp_path)).first()["fields"] == {"title": "Un titre", "issuer": "BAM"}
    (tmp_path / "g.jsonl").write_text('{"id": "g1", "question": "q", "expected_facts": ["x"]}\n\n{"id": "g2", "question": "r"}\n')
    g = pages.golden(spark, str(tmp_path / "g.jsonl"))
    assert g.count() == 2
    pages.write_golden(g, str(tmp_path / "out"))
    assert "derived_facts" not in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(i, 1, float(t)) for i, t in enumerate([0, 0, 0, 120])]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, s double").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp, event_type string, value double").parquet(src)
    q = jobs.rate_limiter(stream, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["allowed"] for r in spark.sql("select * from limited").collect()} == {0: True, 1: True, 2: False, 3: True}
    w = jobs.windowed_requests(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    w.processAllAvailable()
    w.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == 4
    chunks = str(tmp_path / "chunks")
    spark.createDataFrame([("1", "a", "un texte", "s1")], "id string, file string, text string, content_sha256 string").write.parquet(chunks)
    i = jobs.ingest_stream(spark.readStream.schema("id string, file string, text string, content_sha256 string").parquet(chunks), str(tmp_path / "ix"), str(tmp_path / "cp3")).start()
    i.processAllAvailable()
    i.stop()
    assert index.count(spark, str(tmp_path / "ix")) == 1


def test_pipeline_statuses(spark):
    from corpusloom.plans import pipeline

    c = _chunks(spark).withColumns({"reference": F.lit("9/W/2098"), "title": F.lit('T & "x"'), "page_start": F.lit(1), "page_end": F.lit(2), "url": F.lit("https://x.y/a.pdf")})
    q = spark.createDataFrame([("ok", "ratio de solvabilité des banques"), ("hi", "Bonjour"), ("no", "zzz yyy"), ("nil", None)], "query_id string, question string")
    got = {r["query_id"]: r for r in pipeline.answers(c, q, lambda ps: ["Oui [1] [9]." for _ in ps], with_scope=False, min_score=0.5).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok": "answered", "hi": "out_of_scope", "no": "not_found", "nil": "out_of_scope"}
    assert got["ok"]["cited"] == [1] and got["ok"]["answer"] == "Oui [1]." and got["no"]["abstention"] == "low_score" and got["nil"]["verdict"] == "empty"
    assert pipeline.answers(c, q, None, with_scope=False, min_score=0.5).where("status = 'sources_only'").count() == 1


def test_models(spark):
    from corpusloom.functions import models

    df = spark.createDataFrame([("a",), (None,), ("bb",)], "t string")
    assert [r["v"] for r in models.embedded(df, "t", "v", lambda: lambda xs: [[len(x), 1.0] for x in xs], batch=1).collect()] == [[1.0, 1.0], None, [2.0, 1.0]]
    assert [r["s"] for r in models.scored(df, "t", "t", "s", lambda: lambda q, t: [len(x) for x in t], 1).collect()] == [1.0, 0.0, 1.0]
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.retried(flaky, pause=waits.append)() == "ok" and waits == [1.0, 2.0]


def test_reports(spark, tmp_path):
    from corpusloom.operators import reports

    reports.write(str(tmp_path), "R", spark.createDataFrame([("a", 0.5), ("b", None)], "k string, share double"), shares=("share",))
    assert "| a | 50.0% |" in (tmp_path / "report.md").read_text() and "n/a" in (tmp_path / "report.md").read_text()
    assert reports.gate(0.8, 0.85) == 1 and reports.gate(0.9, 0.85) == 0
    with pytest.raises(ValueError):
        reports.rows_of(spark.range(2000))


def test_evidence_of_missing_files_is_reported(spark):
    ev = "struct<file string, page int, quote string>"
    g = spark.createDataFrame([("g1", ("a", 1, "un délai"), []), ("g2", ("a", 2, "un délai"), []), ("g3", ("z", 1, "un délai"), []), ("g4", ("a", 9, "absent"), [])], f"id string, evidence {ev}, extra_evidence array<{ev}>")
    p = spark.createDataFrame([("a", 1, "Dans un délai de dix jours"), ("a", 2, "Rien")], "file string, page int, text string")
    got = {r["id"]: (r["status"], r["found_page"]) for r in evaluate.quotes_on_pages(g, p).collect()}
    assert got == {"g1": ("ok", 1), "g2": ("not on page", 1), "g3": ("missing file", None), "g4": ("missing page", None)}


def test_keyword_search_moves_k_rows_per_query_and_task(spark):
    """Neither postings nor pairs of query and chunk may move: they grow with queries times chunks."""
    chunks = spark.range(0, 600, 1, 3).selectExpr("concat('c', id) AS id", "concat('f', id % 40) AS file", "concat('fonds taux ', repeat('client ', cast(id % 7 AS int)), 'mot', id % 50) AS text", "'s' AS content_sha256")
    chunks = chunks.unionByName(chunks.where("file = 'f1'"))
    questions = spark.range(60).selectExpr("id AS query_id", "concat('taux des fonds du client mot', id % 50) AS question")
    rows = {r["id"]: search_words(r["text"]) for r in chunks.collect()}
    asked = {r["query_id"]: sorted(set(search_words(r["question"]))) for r in questions.collect()}
    n, avg = len(rows), sum(map(len, rows.values())) / len(rows)
    df = {t: sum(t in ws for ws in rows.values()) for ts in asked.values() for t in ts}
    want = set()
    for q, ts in asked.items():
        score = {c: sum((tf := ws.count(t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg)) * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in ts if t in ws) for c, ws in rows.items()}
        best = sorted((-round(s, 9), c) for c, s in score.items() if s)[:4]
        want |= {(q, c, round(-s, 7), rank + 1) for rank, (s, c) in enumerate(best)}
    root = f"{shared_dir(spark)}/keyword-index"
    index.build(chunks, root, buckets=4)
    for got in (search.bm25(chunks, questions, 4), index.keyword_search(spark, root, questions, 4)):
        assert {(r["query_id"], r["chunk_id"], round(r["score"], 7), r["rank"]) for r in got.collect()} == want
        assert "query_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n", 1)[1]


def search_words(text):
    return [w[:-1] if len(w) > 4 and w[-1] in "sx" else w for w in text.split() if w not in ("des", "du")]


def test_blocks_of_queries_find_what_one_block_finds(spark, monkeypatch):
    c, q = _chunks(spark), _questions(spark)
    whole = sorted(map(tuple, search.bm25(c, q, 3).collect()))
    monkeypatch.setattr(search, "BLOCK", 1)
    monkeypatch.setattr(search, "MOST_TERMS", 1)
    assert sorted(map(tuple, search.bm25(c, q, 3).collect())) == whole and len(whole) > 1


def test_dense_search_moves_k_rows_per_query_and_task(spark):
    rows = spark.range(0, 90, 1, 2).selectExpr("concat('c', id % 80) AS id", "concat('taux ', repeat('fonds ', cast(id % 80 % 9 AS int))) AS text")
    q = spark.createDataFrame([("a", "taux"), ("b", "taux fonds fonds"), ("c", None)], "query_id string, question string")
    whole = sorted(map(tuple, search.dense(rows, q, 5).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = search.dense(rows, q, 5)
        assert sorted(map(tuple, got.collect())) == whole and len(whole) == 10
        plan = got._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().head()
        ran = search.dense(rows, q, 5).sparkSession
        moved = DataFrame(ran._jvm.org.apache.spark.sql.classic.Dataset.ofRows(ran._jsparkSession, plan), ran).count()
        assert moved <= 2 * 2 * 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
