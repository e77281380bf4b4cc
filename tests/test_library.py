import os

import pytest
from pyspark.sql import functions as F

from folianta.functions import text as T
from folianta.functions.frames import numbered
from folianta.operators import audit, evaluate, lexical, library, notes, providers, records, similar
from folianta.sources import index as store

PASSAGES = [
    ("a:0:0", "a", 0, 0, "Mrs Younge kept the old house in Ramsgate by the sea"),
    ("a:0:1", "a", 0, 1, "the weather was fine that day and the sea was calm"),
    ("a:1:0", "a", 1, 0, "a letter came to the house in the morning"),
    ("b:0:0", "b", 0, 0, "a marriage of convenience in the house by the sea"),
    ("b:1:0", "b", 1, 0, None),
]


@pytest.fixture
def lib(spark):
    rows = spark.createDataFrame(PASSAGES, "id string, book_id string, chapter_index int, chunk_index int, text string")
    v = [(p[0], p[1], p[2], [1.0 if i == n else 0.5 if i == n + 1 else 0.0 for i in range(64)]) for n, p in enumerate(PASSAGES)]
    return library.Library(rows, spark.createDataFrame(v, "id string, book_id string, chapter_index int, vector array<double>"), lexical.build(rows))


def asked(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, query string, scope string")


def test_numbering_covers_every_row_in_order(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("x"))
    got = {r.x: r.place for r in numbered(df, ["x"]).collect()}
    assert got == {i: i for i in range(1000)}
    assert numbered(df.where("false"), ["x"]).count() == 0
    tied = numbered(spark.createDataFrame([(None,), (1,), (1,)], "x int"), ["x"]).collect()
    assert sorted(r.place for r in tied) == [0, 1, 2] and next(r.place for r in tied if r.x is None) == 0


def test_retrieve_modes(spark, lib):
    q = asked(spark, (1, "Ramsgate house", None), (2, "house sea", "b"), (3, None, None))
    sparse = library.retrieve(lib, q, 2, mode="sparse", neighbours=0).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.id) for r in sparse] == [(1, "a:0:0"), (1, "a:1:0"), (2, "b:0:0")]
    assert all(r.dense_rank is None for r in sparse)
    first = lib.vectors.where("id = 'a:0:0'").select(F.lit(1).alias("query_id"), "vector")
    both = library.retrieve(lib, q, 1, query_vectors=first).where("query_id = 1").orderBy("place").collect()
    assert [r.id for r in both] == ["a:0:0", "a:0:1"] and both[1].score == 0
    vectors = spark.createDataFrame([(1, PASSAGES[2][0])], "query_id int, id string").join(lib.vectors, "id").select("query_id", "vector")
    dense = library.retrieve(lib, q, 1, mode="dense", query_vectors=vectors, neighbours=0).collect()
    assert [(r.query_id, r.id, r.sparse_rank) for r in dense] == [(1, "a:1:0", None)]
    with pytest.raises(ValueError):
        library.retrieve(lib, q, mode="other")


def test_broad_search_takes_wordings_in_turn(spark, lib):
    phrases = spark.createDataFrame([(1, 1, "letter"), (1, 2, "marriage"), (1, 3, "ab"), (1, 6, "weather")], "query_id int, list_no int, phrase string")
    got = library.broad_search(lib, asked(spark, (1, "Ramsgate", None)), phrases, 5, mode="sparse", neighbours=0).orderBy("place").collect()
    assert [(r.id, r.list_no, r.via) for r in got] == [("a:0:0", 0, [0]), ("a:1:0", 1, [1]), ("b:0:0", 2, [2])]
    none = phrases.where("false")
    assert library.broad_search(lib, asked(spark, (1, None, None)), none, 5, mode="sparse", neighbours=0).count() == 0


def test_phrases_survive_a_failing_provider(spark):
    class Failing(providers.Offline):
        def phrases(self, query):
            raise RuntimeError

    q = asked(spark, (1, "one two three", None), (2, None, None))
    assert [(r.list_no, r.phrase) for r in providers.phrases(q, providers.Offline()).orderBy("list_no").collect()] == [(1, "one two"), (2, "three")]
    assert providers.phrases(q, Failing()).count() == 0


def test_names_lead_to_further_passages(spark):
    texts = ["the letter was from Mrs Younge of Ramsgate", "Younge kept a house", "the sea at Ramsgate", "a letter came"]
    rows = spark.createDataFrame([(f"a:{i}:0", "a", i, 0, t) for i, t in enumerate(texts)], "id string, book_id string, chapter_index int, chunk_index int, text string")
    lib = library.Library(rows, rows.select("id", "book_id", "chapter_index", F.array_repeat(F.lit(0.125), 64).alias("vector")), lexical.build(rows))
    found = spark.createDataFrame([(1, "a:0:0"), (2, "a:3:0")], "query_id int, id string")
    got = library.expand_on_entities(lib, asked(spark, (1, "letter", None), (2, "letter", None)), found, least_idf=0.1, mode="sparse", neighbours=0)
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, "a:1:0"), (1, "a:2:0")}
    assert library.expand_on_entities(lib, asked(spark, (1, "letter", None)), found, mode="sparse", neighbours=0).count() == 0


def test_compare(spark, lib):
    told = library.compare(lib, "a", "b")
    assert told.pairs.count() <= 2 and told.summary.first().candidates_compared == 6
    theme = spark.createDataFrame([("a:1:0",)], "id string")
    narrowed = library.compare(lib, "a", "b", theme=theme)
    assert {r.a_id for r in narrowed.pairs.collect()} == {"a:1:0"} and narrowed.summary.first().candidates_compared == 2
    with pytest.raises(ValueError):
        library.compare(lib, "a", "nowhere")


def test_diverse_is_the_plain_greedy_choice(spark):
    import random

    r = random.Random(5)
    rows = [(f"a{i}", f"b{i}", r.randrange(9), r.randrange(9), round(r.random(), 3)) for i in range(300)]
    for top in (1, 3, 6):
        a, b, want = set(), set(), []
        for x in sorted(rows, key=lambda x: (-x[4], x[0], x[1])):
            if x[2] not in a and x[3] not in b and len(want) < top:
                a.add(x[2]), b.add(x[3])
                want.append(x[0])
        df = spark.createDataFrame(rows, "a_id string, b_id string, a_chapter int, b_chapter int, similarity double")
        assert [x.a_id for x in similar.diverse(df, top).orderBy("place").collect()] == want


def test_chapter_notes(spark):
    class Drifting(providers.Offline):
        def summarise(self, title, text):
            if title == "fails":
                raise RuntimeError
            return {"summary": "made up", "moments": ["She walked down to the quay at night", "nobody ever wrote these words here", "short"]}

    long = "x " * 20_000 + "She walked -- down to the QUAY at night."
    rows = spark.createDataFrame([("a", 0, "t", long), ("a", 1, "fails", "text"), ("a", 2, None, None)], "book_id string, chapter_index int, title string, text string")
    made = notes.chapter_notes(rows, Drifting())
    got = {r.chapter_index: r for r in made.collect()}
    # a moment behind the part a provider was given counts, as the whole text is looked at
    assert got[0].moments == ["She walked down to the quay at night"] and got[0].rewritten == 1
    assert (got[1].summary, got[1].moments) == ("", []) and got[2].moments == []
    book = notes.book_notes(made, providers.Offline()).collect()
    assert [(r.book_id, r.chapters) for r in book] == [("a", 3)]


def test_survey(spark):
    rows = [("a", i, f"t{i}", "a letter came" if i % 2 else "nothing") for i in range(20)] + [("b", 0, None, None)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, title string, summary string")
    got = {r.book_id: (r.chapters, r.marked, r["first"]) for r in notes.survey(df, "letter", providers.Offline(), 3).collect()}
    assert got == {"a": (20, 10, "t1, t3, t5"), "b": (1, 0, "")}
    with pytest.raises(ValueError):
        notes.survey(df, " x", providers.Offline())


def test_stride_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    assert sorted(r.x for r in evaluate.stride_sample(df, ["x"], 10, 13).collect()) == list(range(3, 100, 10))
    assert evaluate.stride_sample(df, ["x"], 500).count() == 100
    assert evaluate.stride_sample(df.where("false"), ["x"], 5).count() == 0


def test_answer_relevance(spark):
    q = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [1.0, 1.0])], "case_id string, vector array<double>")
    g = spark.createDataFrame([("c1", [1.0, 0.0]), ("c1", [0.0, 1.0]), ("c2", [0.0, 1.0])], "case_id string, vector array<double>")
    each = evaluate.answer_relevance(q, g)
    got = {r.case_id: (r.relevance, r.baseline, r.separation) for r in each.collect()}
    assert got == {"c1": (0.5, 0.0, 0.5), "c2": (1.0, 0.5, 0.5)}
    assert evaluate.relevance_summary(each).first().cases == 2
    assert [r.case_id for r in evaluate.least_relevant(each, 1).collect()] == ["c1"]
    assert evaluate.relevance_summary(evaluate.answer_relevance(q, g.where("false"))).first().cases == 0


def test_seams(spark):
    p = spark.createDataFrame([("1", "he lost the key"), ("2", "she found a Lamp"), ("3", None)], "id string, text string")
    s = spark.createDataFrame([("1", "2"), ("2", "3")], "before_id string, after_id string")
    t = spark.createDataFrame([("1", "the Key", "lamp"), ("1", "he", "lamp"), ("1", "...", "lamp")], "before_id string, before string, after string")
    cases = evaluate.seam_cases(s, p, t)
    assert [(r.before, r.after) for r in cases.collect()] == [("the key", "lamp")]
    cases = cases.select(F.lit(1).alias("query_id"), "before", "after").unionByName(spark.createDataFrame([(2, "the key", "lamp"), (3, "the key", "lamp")], "query_id int, before string, after string"))
    found = spark.createDataFrame([(1, "2", 1), (1, "1", 2), (2, "1", 1)], "query_id int, id string, place int")
    out = evaluate.seam_outcomes(cases, found, p)
    assert {r.query_id: r.outcome for r in out.collect()} == {1: "both", 2: "before", 3: "neither"}
    r = evaluate.seam_rates(out).first()
    assert (r.cases, r.both, r.either, r.neither) == (3, 1, 1, 1)


def test_guardrails_and_faithful_share(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True), (True, None)], "flagged boolean, passed boolean")
    r = evaluate.guardrail_counts(df).first()
    assert (r.good, r.bad, r.flagged_good, r.flagged_bad, r.precision) == (1, 2, 1, 1, 0.5)
    assert evaluate.guardrail_counts(df.where("false")).first().precision is None
    r = evaluate.faithful_share(spark.createDataFrame([(True,), (False,), (None,), (True,)], "faithful boolean")).first()
    assert (r.picked, r.judged, r.faithful, r.share) == (4, 3, 2, 0.5)


def test_places_cited(spark):
    a = spark.createDataFrame([(1, "x [a:0:0] [a:0:1] [a:1:0] [b:0:0]"), (2, "none"), (3, None)], "answer_id int, answer string")
    assert {r.answer_id: (r.chapters, r.books) for r in evaluate.places_cited(a).collect()} == {1: (3, 2), 2: (0, 0), 3: (0, 0)}


def test_judge_by_words(spark):
    c = spark.createDataFrame([(1, 0, "Younge kept Ramsgate", ["p"]), (1, 1, "quite different words", ["p"]), (1, 2, "Younge left everything behind yesterday", ["p"]), (1, 3, "of the", ["p"])], "answer_id int, claim_no int, claim string, cited array<string>")
    p = spark.createDataFrame([("p", "Mrs Younge kept a house in Ramsgate"), ("q", None)], "id string, text string")
    got = {r.claim_no: (r.supported, r.kind) for r in audit.judge_by_words(c, p).collect()}
    assert got == {0: (True, "fact"), 1: (False, "inference"), 2: (False, "fact"), 3: (False, "inference")}


def test_display_helpers(spark):
    rows = [("CHAPTER XVII. ",), ("Chapter 4: The Storm",), ("The Beginning",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(T.tidy_title(F.col("t")), T.chapter_ref(F.col("t")), T.without_ref(F.col("t"))).collect()]
    assert got == [("Chapter XVII", "XVII", ""), ("Chapter 4: The Storm", "4", "The Storm"), ("The Beginning", "The Beginn", "The Beginning"), (None, None, None)]
    long = "word " * 20
    clause = [r[0] for r in spark.createDataFrame([(long,), ("short",), (None,)], "t string").select(T.first_clause(F.col("t"))).collect()]
    assert clause == ["word " * 10 + "word…", "short", ""]
    kinds = spark.createDataFrame([("HTTP 429 too many",), ("content_filter hit",), ("boom 4290",)], "m string").select(T.error_kind(F.col("m")))
    assert [r[0] for r in kinds.collect()] == ["rate_limited", "filtered", "failed"]
    spans = spark.createDataFrame([("He said “it’s a long way home” and “it’s a long way home” and “not in the passage”", 'x "it\'s a  long way home"')], "a string, p string")
    assert spans.select(T.echoed_spans(F.col("a"), F.col("p"))).first()[0] == ["it’s a long way home"]


def test_index(spark, lib, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(store.IndexFault):
        store.load_index(spark, path, 64)
    store.write_index(lib.passages, lib.vectors, path)
    assert store.load_index(spark, path, 64).count() == 5
    with pytest.raises(store.IndexFault):
        store.load_index(spark, path, 63)
    planted = store.load_index(spark, path, 64).limit(1).withColumn("id", F.lit("planted"))
    assert store.with_planted(store.load_index(spark, path, 64), planted).count() == 6 and store.load_index(spark, path, 64).count() == 5
    store.write_index(lib.passages, lib.vectors.where("id <> 'a:0:0'"), path)
    with pytest.raises(store.IndexFault):
        store.load_index(spark, path, 64)


def test_notes_feedback_and_case_files(spark, tmp_path):
    assert store.load_notes(spark, str(tmp_path / "none")).count() == 0
    log = str(tmp_path / "log")
    row = spark.createDataFrame([(1, "x" * 5000), (2, None)], "id int, answer string")
    store.append_feedback(row, log)
    store.append_feedback(row, log)
    assert sorted((r.id, r.n or 0) for r in spark.read.schema("id int, answer string").json(log).select("id", F.length("answer").alias("n")).collect()) == [(1, 4000), (1, 4000), (2, 0), (2, 0)]
    os.makedirs(tmp_path / "cases")
    (tmp_path / "cases" / "x.json").write_text('{"note": "n",\n "cases": [{"id": "c1", "anyOf": ["a"]}, {"id": "c2"}]}')
    got = store.read_cases(spark, str(tmp_path / "cases"), "id string, anyOf array<string>").orderBy("id").collect()
    assert [(r.id, r.anyOf) for r in got] == [("c1", ["a"]), ("c2", None)]
    store.write_results(spark.range(2), str(tmp_path / "out"))
    store.write_results(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_histories_and_tools(spark):
    threads = spark.createDataFrame([("t1", "v", "a", 5), ("t2", "v", "b", 9), ("t3", None, "c", 9), ("t0", "v", "d", 9)], "id string, visitor string, title string, updated_at bigint")
    listed = records.recent_by_visitor(threads, 2)
    assert sorted((r.id, r.place) for r in listed.collect()) == [("t0", 1), ("t2", 2)]
    rows = [(1, "t2", "user", "q", None, None), (2, "t2", "bot", "a", '["x:1:1"]', '[{"tool": "search"}, {"k": 1}]'), (2, "t2", "bot", "a", '["x:1:1"]', '[{"tool": "search"}, {"k": 1}]'), (3, "t1", "user", "q", "broken", "broken"), (None, "t2", "user", "q", None, None)]
    turns = spark.createDataFrame(rows, "id bigint, thread_id string, role string, content string, citations string, steps string")
    assert sorted((r.turn_id, r.cited) for r in records.histories(listed, turns).collect()) == [(1, []), (2, ["x:1:1"])]
    assert [tuple(r) for r in records.tool_usage(turns).collect()] == [("search", 1, 1)]
    assert records.histories(listed.where("false"), turns).count() == 0


def test_a_book_against_itself_tells_a_pair_once(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron"
    rows = spark.createDataFrame([("a:0:0", "a", 0, 0, text), ("a:0:1", "a", 0, 1, text)], "id string, book_id string, chapter_index int, chunk_index int, text string")
    vectors = rows.select("id", "book_id", "chapter_index", F.array_repeat(F.lit(0.125), 64).alias("vector"))
    told = library.compare(library.Library(rows, vectors, lexical.build(rows)), "a", "a")
    assert [(r.a_id, r.b_id, r.shared) for r in told.verbatim.collect()] == [("a:0:0", "a:0:1", 5)]
