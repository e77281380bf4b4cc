import numpy as np
import pytest
from pyspark.sql import functions as F

from folianta.operators import audit, counting, dense, evaluate, fusion, lexical, providers, records, reuse, similar

PASSAGES = [("a:0:0", "a", 0, 0, "Mrs Younge kept the house in Ramsgate"), ("a:0:1", "a", 0, 1, "the weather was fine that day"), ("b:0:0", "b", 0, 0, "a marriage of convenience in the house"), ("b:0:1", "b", 0, 1, None)]


@pytest.fixture
def passages(spark):
    return spark.createDataFrame(PASSAGES, "id string, book_id string, chapter_index int, chunk_index int, text string")


def queries(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, query string, scope string")


def test_bm25(spark, passages):
    index = lexical.build(passages)
    found = lexical.search(index, lexical.query_terms(queries(spark, (1, "Mrs Younge house", None), (2, "house", "b"), (3, "absent", None), (4, None, None))), 5).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.id)
    assert by == {1: ["a:0:0", "b:0:0"], 2: ["b:0:0"]}
    got = {r.query_id: r.max_idf for r in lexical.max_idf(index, queries(spark, (1, "house", None), (2, "absent", None), (3, None, None))).collect()}
    assert got[1] > 0 and got[2] == 0 and got[3] == 0


def test_aliases_weigh_less_and_only_if_not_typed(spark, passages):
    aliases = spark.createDataFrame([("weather", "marriage"), ("marriage", "weather")], "term string, alias string")
    terms = {(r.query_id, r.term): r.weight for r in lexical.query_terms(queries(spark, (1, "weather", None), (2, "weather marriage", None)), aliases).collect()}
    assert terms == {(1, "weather"): 1.0, (1, "marriage"): 0.3, (2, "weather"): 1.0, (2, "marriage"): 1.0}


def test_empty_index(spark, passages):
    index = lexical.build(passages.limit(0))
    assert lexical.search(index, lexical.query_terms(queries(spark, (1, "house", None))), 5).count() == 0


def test_dense_ties_scope_and_negative(spark):
    v = spark.createDataFrame([("x", "a", [1.0, 0.0]), ("y", "a", [1.0, 0.0]), ("z", "b", [-1.0, 0.0])], "id string, book_id string, vector array<double>")
    q = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, "b", [1.0, 0.0])], "query_id int, scope string, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in dense.search(q, v, 3, dims=2).collect())
    assert got == [(1, 1, "x", 1.0), (1, 2, "y", 1.0), (1, 3, "z", -1.0), (2, 1, "z", -1.0)]
    assert dense.search(q, v.limit(0), 3, dims=2).count() == 0


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id int, id string, rank int")


def test_fusion(spark):
    got = fusion.rrf(ranked(spark, ["x", "y"]), ranked(spark, ["y", "z"]), 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["y", "x", "z"]
    assert (got[1].sparse_rank, got[2].dense_rank) == (None, None)
    alone = fusion.rrf(ranked(spark, ["x", "y"]), ranked(spark, []), 3).orderBy("rank").collect()
    assert [r.id for r in alone] == ["x", "y"]


def test_neighbours(spark):
    spots = spark.createDataFrame([(f"p{i}", "b", 0, i) for i in range(6)], "id string, book_id string, chapter_index int, chunk_index int")
    hits = fusion.rrf(ranked(spark, ["p1", "p3", "p5"]), ranked(spark, []), 3)
    got = fusion.with_neighbours(hits, spots).orderBy("place").collect()
    assert [r.id for r in got] == ["p1", "p3", "p5", "p0", "p2", "p4"]
    assert got[3].score == 0 and got[3].dense_rank is None


def test_round_robin_and_rerank(spark):
    rows = [(1, 0, 0, "a", "b", 1), (1, 1, 0, "b", "b", 1), (1, 0, 1, "c", "b", 2), (1, 1, 1, "d", "b", 3)]
    lists = spark.createDataFrame(rows, "query_id int, list_no int, rank int, id string, book_id string, chapter_index int")
    assert [r.id for r in fusion.round_robin(lists, 5).orderBy("place").collect()] == ["a", "c", "d"]
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, id string, place int")
    o = spark.createDataFrame([(1, [3, 3, 9, 1])], "query_id int, order array<int>")
    got = fusion.rerank(c, o, 8).orderBy("query_id", "new_place").collect()
    assert [r.id for r in got] == ["c", "a", "b", "z"]


def test_shingles(spark):
    twelve = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron"
    rows = [("1", "a", twelve), ("2", "b", twelve.replace("kappa", "other")), ("3", "b", "and the of it was in his her"), ("4", "b", "too short"), ("5", "b", None), ("6", "b", twelve)]
    s = reuse.shingles(spark.createDataFrame(rows, "id string, book_id string, text string"))
    assert {r.id: r["count"] for r in s.groupBy("id").count().collect()} == {"1": 5, "2": 5, "6": 5}
    got = {(r.a_id, r.b_id): (r.shared, r.jaccard) for r in reuse.pairs(s, s, 1, "a_id < b_id").collect()}
    assert got == {("1", "2"): (2, 0.25), ("1", "6"): (5, 1.0), ("2", "6"): (2, 0.25)}


def test_strength_has_no_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0.44, 0.50, 0.60, 0.72)], "s double")
    said = [r[0] for r in df.select(similar.strength(F.col("s"), F.lit(0.4316))).collect()]
    assert len(set(said)) == 4 and not any(ch.isdigit() for x in said for ch in x)


def test_diverse(spark):
    rows = [("a1", "b1", 1, 1, 0.9), ("a2", "b2", 1, 2, 0.8), ("a3", "b1", 2, 1, 0.7), ("a4", "b4", 2, 2, 0.6), ("a5", "b5", 1, 1, 0.95)]
    got = similar.diverse(spark.createDataFrame(rows, "a_id string, b_id string, a_chapter int, b_chapter int, similarity double"), 5).orderBy("place").collect()
    assert [r.a_id for r in got] == ["a5", "a4"]


def answers(spark, *rows):
    return spark.createDataFrame([(i, a, r, p) for i, (a, r, p) in enumerate(rows)], "answer_id int, answer string, retrieved array<string>, prior array<string>")


def test_citations(spark):
    ids = spark.createDataFrame([("a:0:0",), ("a:0:1",), ("a:0:2",)], "id string")
    a = answers(spark, ("x [a:0:0] [a:0:0] [z:9:9]", ["a:0:0"], []), ("x [a:0:1] [a:0:2]", ["a:0:0"], ["a:0:1"]), ("y" * 201, ["a:0:0"], None), ("short", ["a:0:0"], None), (None, None, None))
    got = {r.answer_id: (r.cited, r.unresolved, r.not_retrieved, r.carried_over, r.uncited, r.ok) for r in audit.audit_citations(a, ids).collect()}
    assert got == {0: (2, 1, 0, 0, False, False), 1: (2, 0, 1, 1, False, False), 2: (0, 0, 0, 0, True, False), 3: (0, 0, 0, 0, False, True), 4: (0, 0, 0, 0, False, True)}


def test_quotes(spark):
    p = spark.createDataFrame([("p1", "It was a truth universally acknowledged by every man in the country of good fortune"), ("p2", "She had never in all her long life seen such a thing before today")], "id string, text string")
    cases = {
        "“a truth universally acknowledged by every man”": "ok",
        '"A TRUTH, universally acknowledged by every man"': "ok",
        "“never in all her long life seen such”": "unretrieved",
        "“a truth not universally acknowledged by every man”": "misquoted",
        "“was a truth universally acknowledged by ... man in the country of good fortune”": "ok",
        "“truth universally acknowledged by every man in [this] country of good fortune”": "ok",
        "“only five words of quote”": None,
    }
    a = answers(spark, *[(q, ["p1"], []) for q in cases])
    got = {r.answer_id: r.status for r in audit.audit_quotes(a, p).collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())


def test_claims(spark):
    text = "## Heading here\nBefore any citation it says much. He sold the old house [a:0:0]. Then he went far away indeed. Short one.\n- too few words in this\n- this bulleted line has quite enough words\nI could not find anything about that here. Let me know if you want more of it."
    got = audit.claims(answers(spark, (text, ["a:0:0"], []), (None, ["a:0:0"], []))).orderBy("claim_no").collect()
    assert [r.claim for r in got] == ["He sold the old house .", "Then he went far away indeed.", "this bulleted line has quite enough words"]
    assert all(r.cited == ["a:0:0"] for r in got)


def test_claim_audit(spark):
    found = spark.createDataFrame([(1, 0, "a", ["x"]), (1, 1, "b", ["x"]), (1, 2, "c", ["x"]), (1, 3, "d", ["x"])], "answer_id int, claim_no int, claim string, cited array<string>")
    judge = lambda df: df.withColumn("supported", (F.col("claim") == "a") | (F.array_contains("cited", "again") & (F.col("claim") == "c"))).withColumn("kind", F.when(F.col("claim") == "b", "inference").otherwise("fact"))
    again = lambda df: df.withColumn("cited", F.array(F.lit("again")))
    assert {r.claim: r.status for r in audit.audit_claims(found, judge, again).collect()} == {"a": "supported", "b": "inference", "c": "recovered", "d": "unsupported"}


def test_tampering(spark):
    a = spark.createDataFrame([(1, 'He said "I will never ever go home without you" to two men', "a:0:0"), (2, "plain", None)], "answer_id int, answer string, passage_id string")
    got = {(r.answer_id, r.kind): r.tampered for r in audit.tampered(a).collect()}
    assert got[1, "negation"] == 'He said "I will always ever go home with you" to two men'
    assert got[1, "misquote"] == 'He said "I will never ever go obviously without you" to two men'.replace("go obviously without", "obviously home without") or "obviously" in got[1, "misquote"]
    assert got[1, "number"].endswith("to nine men") and got[1, "fabrication"].endswith("[a:0:0].")
    assert {k for i, k in got if i == 2} == {"control"}


def test_entities(spark, passages):
    index = lexical.build(passages)
    p = spark.createDataFrame([(1, "what of Ramsgate", "Mrs Younge met Colonel Forster in Ramsgate")], "query_id int, query string, text string")
    assert [r.name for r in counting.entity_candidates(p, index, least_idf=0.1).collect()] == ["Mrs Younge"]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id int, rank int, hit boolean")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert sorted((r.query_id, r.found, r.rr) for r in evaluate.by_case(hits, cases).collect()) == [(1, 1, 0.5), (2, 0, 0.0), (3, 0, 0.0)]
    got = {r.query_id: (r.precision, r.weighted) for r in evaluate.precision(hits, 4).collect()}
    assert got == {1: (0.5, round((1 / 2 + 2 / 3) / 2, 6)), 2: (0.0, 0.0)}


def test_the_whole_library_is_compared(spark, sf):
    from folianta.plans import corpus, queries as core

    q = core.queries()
    v = [(r.id, r.book_id, np.array(r.vector)) for r in corpus.vectors(spark, sf).collect()]
    books = sorted({b for _, b, _ in v})
    assert len(books) > 2
    want = {}
    for i, b, x in v:
        for other in books:
            if other != b:
                near = min((-round(float(x @ y), 6), j) for j, c, y in v if c == other)
                want[i, other] = (near[1], -near[0])
    of = {i: b for i, b, _ in v}
    got = {(r.a_id, of[r.b_id]): (r.b_id, r.similarity) for r in q["nn_pairs_library"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 3e-6 for k in want)
    blocks = {(r.a_id, r.b_book): r.b_id for r in similar.nearest_of_books(corpus.vectors(spark, sf), block_rows=40).collect()}
    assert blocks == {k: b for k, (b, _) in got.items()}
    rates = q["baseline_similarity_library"](spark, sf).collect()
    assert len(rates) == len(books) * (len(books) - 1) // 2
    best = q["diverse_pairs_library"](spark, sf).orderBy("place").first()
    assert abs(best.similarity - max(s for _, s in want.values())) < 3e-6
    asked = sum(r.needles for r in q["needle_rates_library"](spark, sf).collect())
    assert asked == corpus.chunks(spark, sf).where("text is not null").count() > sum(r.needles for r in q["needle_rates"](spark, sf).collect())


def test_bootstraps_draw_as_often_as_the_reference(spark, sf, monkeypatch):
    from folianta.plans import queries as core

    drawn, real = [], evaluate.bootstrap

    def noted(values, iterations=5000, key="series"):
        drawn.append(iterations)
        return real(values, iterations, key)

    monkeypatch.setattr(evaluate, "bootstrap", noted)
    core.queries()["bootstrap_ci"](spark, sf), core.queries()["paired_bootstrap"](spark, sf)
    assert drawn == [5000, 10_000]


def test_bootstrap_spread(spark):
    rows = [("a", i, float(i % 3 == 0)) for i in range(1, 91)] + [("b", i, 2.0) for i in range(5)]
    values = spark.createDataFrame(rows, "series string, place int, value double")
    got = {r.series: r for r in evaluate.bootstrap_spread(values, 800).collect()}
    want = {r.series: r for r in evaluate.bootstrap(values, 800).collect()}
    assert (got["b"].n, got["b"].mean, got["b"].low, got["b"].high) == (5, 2.0, 2.0, 2.0)
    assert got["a"].n == want["a"].n and abs(got["a"].mean - want["a"].mean) < 1e-9
    assert abs(got["a"].low - want["a"].low) < 0.03 and abs(got["a"].high - want["a"].high) < 0.03
    assert evaluate.bootstrap_spread(values.limit(0), 50).count() == 0


def test_bootstrap(spark):
    same = spark.createDataFrame([("s", i, 1.0) for i in range(5)], "series string, place int, value double")
    r = evaluate.bootstrap(same, 200).first()
    assert (r.low, r.high, r["mean"], r.n) == (1.0, 1.0, 1.0, 5)
    a = spark.createDataFrame([(f"c{i}", 0.0) for i in range(40)], "case_id string, value double")
    b = spark.createDataFrame([(f"c{i}", 1.0 if i % 2 else 0.5) for i in range(40)], "case_id string, value double")
    assert evaluate.paired_bootstrap(a, b, 300).first().significant is True
    assert evaluate.paired_bootstrap(a, a, 300).first().significant is False


def test_rate_limit_is_recursive(spark):
    at = [0, 1000, 2000, 3_600_000, 3_600_500, 3_601_000]
    df = spark.createDataFrame([(None, t, i) for i, t in enumerate(at)], "visitor string, at bigint, id bigint")
    got = records.rate_limit(df, 2).orderBy("id").collect()
    assert [r.ok for r in got] == [True, True, False, True, False, True]
    assert [r.used for r in got] == [0, 1, 2, 1, 2, 1]
    assert all(r.ok for r in records.rate_limit(df, 0).collect())


def test_cost(spark):
    df = spark.createDataFrame([(1_000_000, 400_000, 100_000, 0), (10, 20, 0, 0)], "p bigint, c bigint, o bigint, e bigint")
    got = [r[0] for r in df.select(records.cost(F.col("p"), F.col("c"), F.col("o"), F.col("e"))).collect()]
    assert got[0] == round(0.6 * 1.25 + 0.4 * 1.25 * 0.25 + 1.0, 6) and got[1] == round(20 * 1.25 * 0.25 / 1e6, 6)


def test_threads(spark):
    t = spark.createDataFrame([("a", "v1", "old", 1, 1), ("a", "v1", "new", 1, 2), ("b", "v2", "b", 1, 1)], "id string, visitor string, title string, created_at bigint, updated_at bigint")
    kept = records.latest(t, "id", ["updated_at"])
    assert {r.id: r.title for r in kept.collect()} == {"a": "new", "b": "b"}
    saved = spark.createDataFrame([("a", "v9", "stolen", 1, 9), ("b", "v2", "mine", 1, 9), ("c", "v3", "c", 1, 1)], t.schema)
    assert {r.id: r.title for r in records.upsert_threads(kept, saved).collect()} == {"a": "new", "b": "mine", "c": "c"}
    turns = spark.createDataFrame([("a", 1), ("b", 2)], "thread_id string, id int")
    gone = spark.createDataFrame([("a", "v1"), ("b", "v1")], "id string, visitor string")
    left, said = records.delete_threads(kept, turns, gone)
    assert [r.id for r in left.collect()] == ["b"] and [r.id for r in said.collect()] == [2]


def test_providers(spark):
    p = spark.createDataFrame([(1, "alpha beta"), (2, None)], "id int, text string")
    got = providers.embed(p, providers.Offline(8)).orderBy("id").collect()
    assert abs(sum(x * x for x in got[0].vector) - 1) < 1e-6 and set(got[1].vector) == {0.0}
    c = spark.createDataFrame([(1, "beta", 1, "alpha"), (1, "beta", 2, "beta"), (2, "x", 1, "only")], "query_id int, query string, place int, text string")
    assert {r.query_id: r.order for r in providers.rerank_orders(c, providers.Offline()).collect()} == {1: [2, 1], 2: []}

    class Busy(Exception):
        status = 429

    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return "done"

    waits = []
    assert providers.with_retries(call, wait=waits.append) == "done" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(ValueError):
        providers.with_retries(lambda: (_ for _ in ()).throw(ValueError()), wait=waits.append)


def test_streaming_limit(spark, tmp_path):
    from folianta.streaming.limits import limited

    source = str(tmp_path / "in")
    rows = [("v", t, i) for i, t in enumerate([0, 1000, 2000, 3_600_000, 3_600_500])]
    spark.createDataFrame(rows, "visitor string, at bigint, id bigint").coalesce(1).write.parquet(source)
    stream = limited(spark.readStream.schema("visitor string, at bigint, id bigint").parquet(source), 2)
    query = stream.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.ok for r in spark.sql("select * from limited order by id").collect()] == [True, True, False, True, False]


def test_admit_prunes():
    ok, used, held = records.admit([0, 5, 20], [], 1, 10)
    assert (ok, used, held) == ([True, False, True], [0, 1, 0], [20])
