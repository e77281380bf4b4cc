"""Sharded lexical search, blocks of queries, saved threads, views, pages as files, notes on chapters, intermediate tables."""

import math
import os
import shutil
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from folianta.functions import text as T
from folianta.operators import audit, dense, ingest, lexical, library, notes, providers, records, reuse, similar
from folianta.sources import index as store
from folianta.sources import tables
from folianta.sources.pages import read_pages, write_pages

PASSAGES = [
    ("a", "x", "old lamp old mill"), ("b", "x", "lamp"), ("c", "y", "mill lamp river"), ("d", "y", None), ("e", None, "lamp lamp lamp"), ("f", "y", "the and of"), ("g", "x", "lamp"), ("h", "z", "river"),
]


def brute(terms, scope, k):
    docs = {i: [w for w in (t or "").split() if w not in T.STOP_WORDS] for i, _, t in PASSAGES}
    book = {i: b for i, b, _ in PASSAGES}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = []
    for i, d in docs.items():
        if scope is not None and book[i] != scope:
            continue
        s = sum(weight * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, weight in terms if w in d)
        if s:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize(("shard", "block"), [(20_000, 1024), (2, 1)])
def test_sharded_search_equals_brute_force(spark, shard, block):
    index = lexical.build(spark.createDataFrame(PASSAGES, "id string, book_id string, text string"))
    asked = [(1, "old lamp", None), (2, "lamp", "x"), (3, "river mill", "nowhere"), (4, None, None), (5, "the", None), (6, "unheard", None), (7, "lamp river", "y")]
    terms = lexical.query_terms(spark.createDataFrame(asked, "query_id int, query string, scope string"))
    got = {}
    for r in lexical.search(index, terms, 3, shard, block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = {q: brute([(w, 1.0) for w in (text or "").split() if w != "the"], scope, 3) for q, text, scope in asked}
    assert got == {q: v for q, v in want.items() if v}
    every = lexical.search(index, terms, None).where("query_id = 1").count()
    assert every == len(brute([("old", 1.0), ("lamp", 1.0)], None, 99))


def test_search_of_nothing(spark):
    passages = spark.createDataFrame(PASSAGES, "id string, book_id string, text string")
    none = spark.createDataFrame([], "query_id int, query string, scope string")
    assert lexical.search(lexical.build(passages), lexical.query_terms(none), 3).count() == 0
    some = spark.createDataFrame([(1, "lamp", None)], "query_id int, query string, scope string")
    empty = lexical.build(passages.limit(0))
    assert lexical.search(empty, lexical.query_terms(some), 3).count() == 0 and empty.terms.count() == 0


def test_dense_search_in_blocks(spark):
    rows = [(f"v{i}", "b" if i % 2 else "c", [math.cos(i), math.sin(i)]) for i in range(40)] + [("w", "b", [1.0, 0.0]), ("u", "b", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, book_id string, vector array<double>")
    asked = spark.createDataFrame([(i, "b" if i == 3 else None, [math.cos(i), math.sin(i)]) for i in range(7)], "query_id int, scope string, vector array<double>")
    ordered = lambda found: found.orderBy("query_id", "rank").collect()
    one = ordered(dense.search(asked, vectors, 4, 2))
    assert one == ordered(dense.search(asked, vectors, 4, 2, shard_rows=5, block_queries=2)) and len(one) == 28
    assert [r.id for r in one if r.query_id == 0][:3] == ["u", "v0", "w"]
    assert {r.id for r in one if r.query_id == 3} <= {f"v{i}" for i in range(1, 40, 2)} | {"u", "w"}


def test_a_shingle_of_many_passages(spark, monkeypatch):
    words = "anna sold the old mill beside the river to harlan moor"
    df = spark.createDataFrame([(f"p{i:03d}", f"b{i % 2}", f"x{i} {words}") for i in range(50)], "id string, book_id string, text string")
    shingles = reuse.shingles(df)
    whole = sorted(reuse.pairs(shingles, shingles, 1, "a_id < b_id").collect())
    monkeypatch.setattr(reuse, "SALT_ROWS", 7)
    assert whole == sorted(reuse.pairs(shingles, shingles, 1, "a_id < b_id").collect()) and len(whole) == 50 * 49 // 2
    assert all(r.longest in words for r in whole)


def test_hash_of_utf16_units(spark):
    def fnv(text):
        h, data = 2166136261, text.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["", "Chapter 1", "é ß", "🕯 lamp 𝔄", "漢字"]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", T.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: fnv(t) for t in texts} | {None: None}


def test_statements_about_the_search(spark):
    said = ["Nothing. It was found behind the old mill wall.", "Nothing about the lamp was found in the books today.", "Nothing was found in any of the books today.", "No passage tells who sold the old mill."]
    rows = [(i, f"The aunt sold the old mill in spring [b:1:0]. {s}", ["b:1:0"]) for i, s in enumerate(said)]
    got = audit.claims(spark.createDataFrame(rows, "answer_id int, answer string, retrieved array<string>")).groupBy("answer_id").count()
    # "Nothing." alone is a stub, and what follows it states something
    assert {r.answer_id: r["count"] for r in got.collect()} == {0: 2, 1: 1, 2: 1, 3: 1}


def test_saved_threads(spark):
    threads = spark.createDataFrame([("t1", "ann", "old", 1, 1), ("t2", "bob", "old", 1, 1)], "id string, visitor string, title string, created_at long, updated_at long")
    turns = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b"), (3, None, "c")], "id long, thread_id string, content string")
    saved = spark.createDataFrame([("t1", "ann", "new", 1, 2), ("t2", "eve", "hers", 1, 2), ("t3", "eve", "third", 3, 3)], threads.schema)
    fresh = spark.createDataFrame([("t1", "x"), ("t1", "y"), ("t2", "stolen"), ("t3", "z")], "thread_id string, content string")
    a, b = records.save_threads(threads, turns, saved, fresh)
    assert {(r.id, r.title) for r in a.collect()} == {("t1", "new"), ("t2", "old"), ("t3", "third")}
    assert sorted((r.thread_id or "", r.content) for r in b.collect()) == [("", "c"), ("t1", "x"), ("t1", "y"), ("t2", "b"), ("t3", "z")]
    # a thread saved without turns loses those it had
    assert records.save_threads(threads, turns, saved, fresh.limit(0))[1].count() == 2


def test_requests_without_time(spark):
    df = spark.createDataFrame([("v", 0, 1), ("v", 3_600_000, 2), ("v", 3_600_001, 3), ("v", None, 4), (None, 5, 5), (None, 6, 6), ("v", -1, 7)], "visitor string, at long, id long")
    assert {r.id: r.used for r in records.requests_last_hour(df).collect()} == {7: 1, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 2}


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a:0:0", "a", 0, 0, "Mrs Younge kept the lamp."), ("b:0:0", "b", 0, 0, "The lamp and the mill of Younge."), ("c:0:0", "c", 0, 0, "A lamp lit by nobody.")]
    passages = spark.createDataFrame(rows, "id string, book_id string, chapter_index int, chunk_index int, text string")
    vectors = spark.createDataFrame([(r[0], r[1], 0, [1.0, 0.0]) for r in rows], "id string, book_id string, chapter_index int, vector array<double>")
    return library.Library(passages, vectors, lexical.build(passages))


def test_search_in_view(spark, small):
    asked = spark.createDataFrame([(1, "lamp mill", None), (2, "lamp", "b"), (3, "lamp", "c")], "query_id int, query string, scope string")
    views = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "a")], "query_id int, book_id string")
    scopes = {r.query_id: r.scope for r in library.in_view(asked, views).collect()}
    # a scope out of view counts as none, but the one book in view is the scope
    assert scopes == {1: None, 2: "b", 3: "a"}
    found = library.search_books(small, asked, providers.Offline(), 2, views, names=False, mode="sparse").collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append(r.id)
    assert {k: set(v) for k, v in got.items()} == {1: {"a:0:0", "c:0:0"}, 2: {"b:0:0"}, 3: {"a:0:0"}}

    class Failing(providers.Offline):
        def order(self, query, texts):
            raise RuntimeError

    kept = library.search_books(small, asked, Failing(), 2, views, names=False, mode="sparse")
    assert kept.where("query_id = 1").count() == 2
    assert library.search_books(small, asked.limit(0), providers.Offline(), mode="sparse").count() == 0


def test_pairs_judged(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9, 0.4, "the mill", "the mill"), ("c", "d", 0.5, 0.4, None, "x")], "a_id string, b_id string, similarity double, baseline double, a_text string, b_text string")
    told = {r.a_id: r.relationship for r in providers.judge_pairs(pairs, providers.Offline()).collect()}
    assert told == {"a": "shared_theme", "c": "coincidental"}
    malformed = SimpleNamespace(compare=lambda *_: {"confidence": "high"})
    assert {(r.a_id, r.similarity, r.relationship, r.confidence) for r in providers.judge_pairs(pairs, malformed).collect()} == {("a", 0.9, None, None), ("c", 0.5, None, None)}


def test_pages_as_files(spark, tmp_path):
    html = '<html><body><h2>CHAPTERI. The Mill</h2>\n<p><img alt="T">he old mill<span class="pagenum">7</span></p><div class="caption">A mill</div><p>stood.</p></body></html>'
    write_pages(spark.createDataFrame([("a b+c", html), ("d", "")], "book_id string, html string"), str(tmp_path / "made"))
    os.makedirs(tmp_path / "made" / "loose")
    (tmp_path / "made" / "loose" / "mill.html").write_text(html)
    pages = read_pages(spark, str(tmp_path / "made"))
    assert {r.book_id for r in pages.collect()} == {"a b+c", "d", "mill"}
    made = ingest.sections_of(ingest.read_html(pages), least_words=1).collect()
    assert {(r.book_id, r.title, tuple(r.paragraphs)) for r in made} == {(b, "CHAPTER I. The Mill", ("The old mill", "stood.")) for b in ("a b+c", "mill")}


def test_notes_on_chapters(spark, tmp_path):
    chapters = spark.createDataFrame([("a", 0, "One"), ("a", 1, "Two"), ("b", 0, None)], "book_id string, chapter_index int, title string")
    made = spark.createDataFrame([("a", 1, "Two", "It ends.", ["m"], 3), ("a", 9, "Notes", "none", [], 0), ("b", 0, None, "All.", None, 0)], "book_id string, chapter_index int, title string, summary string, moments array<string>, rewritten int")
    path = str(tmp_path / "notes")
    assert store.load_notes(spark, path).count() == 0
    store.write_notes(made, path)
    found = store.load_notes(spark, path)
    joined = notes.onto_chapters(chapters, found)
    assert {(r.book_id, r.chapter_index, r.summary, tuple(r.moments)) for r in joined.collect()} == {("a", 0, None, ()), ("a", 1, "It ends.", ("m",)), ("b", 0, "All.", ())}
    told = notes.about_the_book(spark.createDataFrame([("a",), ("b",), ("a",)], "book_id string"), spark.createDataFrame([("a", "A book.")], "book_id string, summary string"), joined)
    assert {(r.book_id, r.summary, r.chapters, r.prepared) for r in told.collect()} == {("a", "A book.", "Two: It ends.", True), ("b", None, None, False)}


def test_embedded_text(spark):
    row = spark.createDataFrame([("B", None, "t")], "b string, c string, t string").select(T.embed_text(F.col("b"), F.col("c"), F.col("t")).alias("e")).head()
    assert row.e == "B, \n\nt"


def test_intermediate_tables_are_released(spark):
    kept = tables.materialise(spark.range(3).toDF("id"), tables.INDEX + "test")
    gone = tables.materialise(spark.range(3).toDF("id"), "test")
    files = gone.inputFiles()
    assert tables.release(spark) >= 1 and kept.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
    made = []
    for _ in range(2):
        tables.lasting(spark, ("test",), lambda: made.append(1))
    assert len(made) == 1
    # somebody clears the folder: what was built is built again
    tables.lasting(spark, ("cleared",), lambda: tables.materialise(spark.range(3).toDF("id"), tables.INDEX + "test"))
    for path in tables._written[spark.sparkContext.applicationId]:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    assert tables.lasting(spark, ("cleared",), lambda: tables.materialise(spark.range(4).toDF("id"), tables.INDEX + "test")).count() == 4


def test_no_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    cluster = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=Conf))
    with pytest.raises(tables.SharedFolderMissing):
        tables.shared_folder(cluster)


def moved(spark):
    """Bytes of shuffle files."""
    made = spark.sparkContext.getConf().get("spark.local.dir")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(made) for f in files if f.startswith("shuffle_"))


def test_lexical_search_moves_no_posting_for_each_block_of_queries(spark):
    passages = spark.range(800).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("b").alias("book_id"), F.expr("array_join(transform(sequence(1, 150), i -> concat('w', abs(xxhash64(id, i)) % 3000)), ' ')").alias("text"))
    asked = spark.range(6000).select(F.col("id").alias("query_id"), F.expr("concat('w', id % 3000, ' w', id * 7 % 3000)").alias("query"), F.lit(None).cast("string").alias("scope"))
    index, terms = lexical.build(passages), lexical.query_terms(asked)
    assert index.terms.count() == 3000
    before = moved(spark)
    assert lexical.search(index, terms, 3).count() > 10_000
    assert moved(spark) - before < 4_000_000


def test_baselines_of_many_books_in_little_time(spark):
    began = time.time()
    vectors = spark.range(24_000).select(F.col("id"), F.concat(F.lit("b"), F.col("id") % 400).alias("book_id"), F.expr("transform(sequence(1, 64), i -> cast(hash(id, i) % 1000 / 1000.0 as double))").alias("vector"))
    found = similar.baselines(vectors)
    # 3,600 products for each of 79,800 pairs took minutes
    assert found.count() == 79_800 and found.agg(F.sum("baseline")).first()[0] is not None and time.time() - began < 45


def test_dense_search_moves_no_vector_for_each_block_of_queries(spark):
    vectors = spark.range(1900).select(F.concat(F.lit("v"), "id").alias("id"), F.concat(F.lit("b"), F.col("id") % 3).alias("book_id"), F.expr("transform(sequence(1, 64), i -> cast(hash(id, i) / 2147483648.0 as double))").alias("vector"))
    asked = spark.range(25_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, F.lit("b1")).alias("scope"), F.expr("transform(sequence(1, 64), i -> cast(hash(id, i, 1) / 2147483648.0 as double))").alias("vector"))
    before = moved(spark)
    assert dense.search(asked, vectors, 3).count() == 75_000
    once = moved(spark)
    # vectors moved for each 8,192 queries, 1 MB each time
    assert dense.search(asked, vectors, 3, block_queries=8192).count() == 75_000
    assert moved(spark) - once > once - before + 1_000_000
    few = asked.where("query_id < 20")
    want = {}
    v = {r.id: (r.book_id, r.vector) for r in vectors.collect()}
    for r in few.collect():
        scores = sorted((-round(sum(x * y for x, y in zip(r.vector, w, strict=True)), 6), i) for i, (book, w) in v.items() if r.scope in (None, book))
        want[r.query_id] = [i for _, i in scores[:3]]
    got = {}
    for r in dense.search(few, vectors, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def _library_of(spark, books, each, seed):
    """Vectors of ``books`` books, a third of them copies of others, so that products tie."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(books * each, 8)).astype(np.float32)
    x[draw.integers(0, len(x), len(x) // 3)] = x[draw.integers(0, len(x), len(x) // 3)]
    rows = [(f"b{i % books}:{i // books // 3}:{i}", f"b{i % books}", f"b{i % books}:{i // books // 3}", [float(n) for n in x[i]]) for i in range(len(x))]
    return spark.createDataFrame([*rows, ("none", None, None, [1.0] * 8)], "id string, book_id string, chapter string, vector array<float>")


def test_books_come_by_in_batches(spark):
    from folianta.functions.vectors import unit

    vectors = _library_of(spark, 5, 40, 1)
    rows = [(r.id, r.book_id, np.array(r.v)) for r in vectors.select("id", "book_id", unit(F.col("vector")).alias("v")).collect() if r.book_id]
    want = {}
    for i, b, x in rows:
        for j, c, y in rows:
            if b != c:
                want[i, c] = min(want.get((i, c), (2.0, "")), (-round(float(x @ y), 6), j))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # a book goes over several batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        for block_rows in (30, 1000):
            got = {(r.a_id, r.b_book): (-r.similarity, r.b_id) for r in similar.nearest_of_books(vectors, 8, block_rows, raw=True).collect()}
            assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_rows_leave_a_task_book_by_book():
    """What is held of a result is a book's rows, not those of all books of a task."""
    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(60, 8)).tolist()
    rows = [{"asks": True, "id": f"a{i}", "book_id": "a", "chapter": None, "vector": x[i]} for i in range(20)] + [{"asks": False, "id": f"{b}{i}", "book_id": b, "chapter": None, "vector": x[20 + i]} for b in "bcdef" for i in range(8)]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=9)
    found = list(similar._books_met(iter(batches), 8, True))
    assert [(book, len(who)) for _, book, _, _, who in found] == [(b, 20) for b in "bcdef"]


@pytest.mark.parametrize("seed", [3, 4])
def test_tasks_send_on_only_pairs_that_may_be_chosen(spark, monkeypatch, seed):
    vectors = _library_of(spark, 6, 60, seed)
    pairs = similar.nearest_of_books(vectors, 8, raw=True).select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "similarity").distinct()
    chapter = lambda side: vectors.select(F.col("id").alias(f"{side}_id"), F.col("chapter").alias(f"{side}_chapter"))
    want = similar.diverse(pairs.join(chapter("a"), "a_id").join(chapter("b"), "b_id").select("a_id", "b_id", "a_chapter", "b_chapter", "similarity"), 3)
    sent, real = [], similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda df, label: sent.append(real(df, label)) or sent[-1])
    got = similar.diverse_of_books(vectors, 3, 8, block_rows=50, raw=True)
    row = lambda r: (r.place, r.a_id, r.b_id, r.a_chapter, r.b_chapter, r.similarity)
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect())) and got.count() == 3
    tasks = 16
    assert sent[0].count() <= tasks * 2 * 3 * 3 < pairs.count()


def test_a_shard_is_scored_in_stretches():
    """A task of several stretches sends on k rows for a query, the same as if it had one."""
    import pyarrow as pa

    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    shard = pa.table({"id": [f"p{i:03}" for i in range(200)], "book_id": [None if i % 17 == 0 else f"b{i % 3}" for i in range(200)], "words": [" ".join(draw.choice(words, draw.integers(0, 12))) for _ in range(200)]})
    term = lambda w: {"term": str(w), "weight": float(draw.choice([1.0, 0.5])), "idf": 1.5}
    queries = pa.table({"query_id": list(range(40)), "scope": pa.array([None if i % 4 else f"b{i % 5}" for i in range(40)], pa.string()), "terms": [[term(w) for w in draw.choice(words, 3, replace=False)] for _ in range(40)]})
    one, *others = (lexical._scores(5, 6.0, lexical.DEFAULTS, stretch)(queries, shard).to_pydict() for stretch in (1000, 7, 64))
    assert all(one == other for other in others) and max(Counter(one["query_id"]).values()) == 5 and len(set(one["query_id"])) > 30


def test_words_alone_are_searched_for_what_is_wanted(spark, sf, monkeypatch):
    from folianta.plans import corpus
    from folianta.plans import queries as core

    asked, real = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda index, terms, k, *more: asked.append(k) or real(index, terms, k, *more))
    lib, queries = corpus.library(spark, sf), corpus.queries(spark, sf)
    few = library.retrieve(lib, queries, 4, mode="sparse", neighbours=0).select("query_id", "id", "score", "place").collect()
    core.queries()["answer_relevance"](spark, sf)
    assert asked == [4, 3]
    many = library.retrieve(lib, queries, 24, mode="sparse", neighbours=0).where("place <= 4").select("query_id", "id", "score", "place").collect()
    assert sorted(few) == sorted(many)


@pytest.mark.parametrize("name", ["rerank_order", "claim_audit"])
def test_a_search_is_run_once(spark, sf, name):
    """What reads a search twice reads it from a table."""
    from folianta.plans import queries as core

    assert "CoGroups" not in core.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("owner", ["id", "book_id"])
def test_shingles_of_one_passage_or_book_are_left_out(spark, sf, owner):
    from folianta.plans import corpus

    passages = corpus.chunks(spark, sf)
    every, shared = reuse.shingles(passages), reuse.shingles(passages, shared=owner)
    times = Counter(r.phrase for r in every.select("phrase", owner).distinct().collect())
    rows = lambda df: {(r.id, r.place, r.phrase, r.size, r.h, r.g) for r in df.collect()}
    want, got = {r for r in rows(every) if times[r[2]] > 1}, rows(shared)
    assert want <= got <= rows(every) and len(got) < len(want) + len(times) / 100
    condition = "a_id < b_id" + " and a_book <> b_book" * (owner == "book_id")
    told = lambda a: sorted(reuse.pairs(a, a, 1, condition).collect())
    assert told(every) == told(shared)


def left(spark, most):
    """Bytes of shuffle files, once deleting has come down to ``most`` or had its time."""
    until = time.time() + 10
    while moved(spark) > most and time.time() < until:
        time.sleep(0.2)
    return moved(spark)


def test_shuffle_files_of_a_written_table_go(spark):
    before = moved(spark)
    made = tables.materialise(spark.range(300_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(5, "h"), "test")
    assert made.count() == 300_000 and left(spark, before + 100_000) <= before + 100_000
    assert spark.conf.get(tables.CLEANUP) == "false"


def test_lexical_search_moves_no_passage(spark, monkeypatch):
    passages = spark.range(4000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("b").alias("book_id"), F.expr("array_join(transform(sequence(1, 150), i -> concat('w', abs(xxhash64(id, i)) % 3000)), ' ')").alias("text"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.expr("concat('w', id, ' w', id + 7)").alias("query"), F.lit(None).cast("string").alias("scope"))
    index, terms = lexical.build(passages), lexical.query_terms(asked)
    assert index.terms.count() == 3000
    # what the search shuffles stays, so that it can be counted
    monkeypatch.setattr(tables, "CLEANUP", "spark.sql.test.none")
    before = moved(spark)
    one = lexical.search(index, terms, 3, block_queries=40).collect()
    assert len(one) == 120 and moved(spark) - before < 500_000
    assert sorted(one) == sorted(lexical.search(index, terms, 3, 50, 7).collect())


def test_queries_of_the_same_terms_are_scored_once(spark, monkeypatch):
    index = lexical.build(spark.createDataFrame(PASSAGES, "id string, book_id string, text string"))
    sent, real = [], lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df, label: sent.append((label, real(df, label))) or sent[-1][1])
    asked = [(1, "old lamp", None), (2, "the lamp, old", None), (3, "old lamp", "x"), (4, "lamp old lamp", None), (5, "old mill", None)]
    found = lexical.search(index, lexical.query_terms(spark.createDataFrame(asked, "query_id int, query string, scope string")), 3).collect()
    got = {q: [(r.id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q, _, _ in asked}
    old = [("old", 1.0), ("lamp", 1.0)]
    assert got == {1: brute(old, None, 3), 2: brute(old, None, 3), 3: brute(old, "x", 3), 4: brute(old, None, 3), 5: brute([("old", 1.0), ("mill", 1.0)], None, 3)}
    assert [df.count() for label, df in sent if label == "packs"] == [3]
    # a query that comes with two books has the best of both
    twice = spark.createDataFrame([(1, "lamp", "x"), (1, "lamp", "y"), (2, "lamp", "y")], "query_id int, query string, scope string")
    rows = lexical.search(index, lexical.query_terms(twice), 3).collect()
    both = sorted(brute([("lamp", 1.0)], "x", 9) + brute([("lamp", 1.0)], "y", 9), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r.id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 1] == both


def test_texts_that_meet_nothing_do_not_move(spark):
    from folianta.functions.frames import may_meet

    texts = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("t").alias("text")).unionByName(spark.createDataFrame([(None, "t")], "id string, text string"))
    named = texts.where("id like 'p7%' or id is null").select("id")
    kept = may_meet(texts, named)
    assert kept.join(named, "id", "left_semi").count() == named.where("id is not null").count() <= kept.count() < named.count() + 200
    assert may_meet(texts, named.limit(0)).count() == 0
    # the rows go before repeated ones are looked for
    plan = may_meet(texts.dropDuplicates(["id"]), named)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("there(")


def test_an_index_is_made_without_moving_its_texts(spark, tmp_path, monkeypatch):
    from folianta.functions import frames
    from folianta.plans import corpus

    rows = spark.range(4000).select(F.concat(F.lit("p"), F.col("id") % 3960).alias("id"), F.lit("b").alias("book_id"), F.expr("array_join(transform(sequence(1, 150), i -> sha2(concat(id % 3960, ' ', i), 256)), ' ')").alias("text"))
    rows.unionByName(spark.createDataFrame([(None, "b", "lamp")] * 2, "id string, book_id string, text string")).write.parquet(f"{tmp_path}/chunks.parquet")
    # what is shuffled stays, so that it can be counted
    monkeypatch.setattr(tables, "CLEANUP", "spark.sql.test.none")
    before = moved(spark)
    index = corpus.index(spark, str(tmp_path))
    # all texts have 39 MB, those of repeated ids 0.8 MB
    assert moved(spark) - before < 2_000_000
    assert {r.id: len(r.tokens) for r in index.split.collect()} == {f"p{n}": 150 for n in range(3960)} | {None: 1}
    loaded = tables.load(spark, str(tmp_path), "chunks")
    assert frames.once(loaded).count() == 3961
    monkeypatch.setattr(frames, "MOST_REPEATED", 7)
    assert frames.once(loaded).count() == 3961 and frames.once(loaded.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["pass_rates", "bm25_alias", "topic_coverage", "entity_expansion"])
def test_searches_of_all_cases_hold_no_passages_on_disk(spark, sf, name):
    """Neither a shuffle of passages for a block nor one of queries for a shard is left in the plan."""
    from folianta.plans import queries as core

    plan = core.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" not in plan


def test_books_of_hits_come_from_the_index(spark, sf):
    """The chunks aren't read again and shuffled once more to drop repeated rows."""
    from folianta.plans import queries as core

    made = core.queries()["topic_coverage"](spark, sf)
    assert not [path for path in made.inputFiles() if "chunks.parquet" in path]


def test_following_names_by_words_makes_no_vectors(spark, sf, monkeypatch):
    from folianta.plans import corpus
    from folianta.plans import queries as core

    met, real = [], library.may_meet
    monkeypatch.setattr(corpus, "vectors", lambda *_: pytest.fail("vectors are made"))
    monkeypatch.setattr(library, "may_meet", lambda *given: met.append(1) or real(*given))
    assert core.queries()["entity_expansion"](spark, sf).columns == ["query_id", "id", "name", "place"] and met


@pytest.mark.parametrize(("block", "met"), [(6_000_000, 2_000_000), (300, 1)])
def test_pairs_across_books_equal_those_of_a_join(spark, sf, block, met):
    from folianta.plans import corpus

    odd = spark.createDataFrame([("q1", None, "b"), (None, "b1", "b"), ("q2", "b1", None), ("q3", "b2", "")], "id string, book_id string, text string")
    same = spark.range(40).select(F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("b"), F.col("id") % 3).alias("book_id"), F.concat(F.lit("old lamp green mill river stone bridge tower harbour candle w"), F.col("id") % 5, F.lit(" letter w"), F.col("id") % 7).alias("text"))
    passages = corpus.chunks(spark, sf).select("id", "book_id", "text").unionByName(odd).unionByName(same)
    a = reuse.shingles(passages)
    want = sorted(reuse.pairs(a, a, 2, "a_id < b_id and a_book <> b_book").collect())
    assert len(want) > 300 and sorted(reuse.across_books(passages, 2, block_shingles=block, met_rows=met).collect()) == want
    assert reuse.across_books(passages.limit(0), 2, block_shingles=block).collect() == []


def test_pairs_across_books_do_not_move(spark, tmp_path):
    from folianta.plans import queries as core

    text = F.concat(F.lit("old lamp green mill river stone bridge tower harbour candle letter window garden w"), F.col("id") % 700)
    rows = spark.range(1400).select(F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("b"), F.col("id") % 7).alias("book_id"), text.alias("text"))
    rows.write.parquet(f"{tmp_path}/chunks.parquet")
    before = moved(spark)
    pairs = core.queries()["reuse_pairs"](spark, str(tmp_path))
    assert pairs.count() > 800_000
    assert moved(spark) - before < 1_000_000


def test_a_share_is_rounded_as_spark_does(spark):
    of = [(s, u) for u in range(0, 700) for s in range(0, min(u, 12) + 1)]
    want = spark.createDataFrame(of, "s bigint, u bigint").select("s", "u", F.round(F.coalesce(F.col("s") / F.nullif("u", F.lit(0)), F.lit(0.0)), 4).alias("r")).collect()
    shared, union = np.array([r.s for r in want]), np.array([r.u for r in want])
    assert reuse._rounded(shared, union).tolist() == [r.r for r in want]


@pytest.mark.parametrize(("block", "stretch", "pairs"), [(1_000_000, 65_536, 500_000), (200, 60, 50)])
def test_ranks_of_passages_for_their_own_words(spark, sf, block, stretch, pairs):
    from folianta.plans import corpus

    odd = [(*p, p[2]) for p in PASSAGES] + [("n1", "x", "nothing like it", "river"), ("n2", "x", "", ""), ("n3", "x", "lamp lamp mill", "unheard lamp"), ("n4", "x", "lamp", "unheard"), (None, "x", "lamp canal", "lamp")]
    passages = spark.createDataFrame(odd, "id string, book_id string, text string, query string").unionByName(corpus.chunks(spark, sf).select("id", "book_id", "text", F.expr("substr(text, 1, 60)").alias("query")))
    alike = spark.range(300).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("x").alias("book_id"), F.expr("array_join(transform(sequence(1, 3 + id % 30), i -> concat('w', abs(xxhash64(id % 60, i)) % 40)), ' ')").alias("text"))
    passages = passages.unionByName(alike.withColumn("query", F.expr("array_join(slice(split(text, ' '), 1, 4), ' ')")))
    index = lexical.build(passages)
    asked = passages.select(F.col("id").alias("query_id"), "query", F.lit(None).cast("string").alias("scope"))
    want = sorted((r.id, r["rank"]) for r in lexical.search(index, lexical.query_terms(asked), 8).where("query_id = id").collect())
    got = sorted(tuple(r) for r in lexical.own_ranks(index, asked, 8, block_queries=block, stretch=stretch, pairs=pairs).collect())
    assert got == want and len({rank for _, rank in want}) == 8


def test_own_words_are_not_scored_against_every_passage(spark, sf, monkeypatch):
    from folianta.plans import queries as core

    def no(*_, **__):
        raise AssertionError("every query against every passage that holds one of its words")

    monkeypatch.setattr(lexical, "_scores", no)
    assert core.queries()["needle_rates_library"](spark, sf).count() == 2
