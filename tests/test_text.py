from pyspark.sql import functions as F

from folianta.functions import text as T
from folianta.operators import ingest


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_sentences(spark):
    got = one(spark, T.split_sentences, "Mr. Darcy came. He left!", 'He said, "Mr. W. is in." So be it.', "no end", "It was no. Then he went.", "A ‘so proud!’” Then.")
    assert got[0] == ["Mr. Darcy came.", "He left!"]
    assert got[1] == ['He said, "Mr. W.', 'is in."', "So be it."]
    assert got[2] == ["no end"]
    # the list of abbreviations is matched in any case, so a sentence that ends in "no." runs on
    assert got[3] == ["It was no. Then he went."]
    assert got[4] == ["A ‘so proud!’”", "Then."]


def test_plain_sentences_are_the_same(spark):
    texts = ["Mr. Darcy came. He left!", "a. . b", "Mrs.  X went. Dr. Y!’”) Z", "He, etc. Then. No. 5 is", "“Mr. A.” B. c? d"]
    assert one(spark, T.split_sentences, *texts) == [ingest.split_plain(t) for t in texts]


def test_spaces_words_and_nulls(spark):
    assert one(spark, T.count_words, "a b c", "  ", None, "") == [3, 0, 0, 0]
    assert one(spark, T.squash, "  a 　 b ", None) == ["a b", None]
    assert one(spark, T.tokens, "Don’t go, I say: a 1 b2") == [["don't", "go", "say", "b2"]]


def test_word_boundaries_are_plain(spark):
    df = spark.createDataFrame([("vé v été V", "v"), ("a.b a.b", "a.b"), ("St. X", "St. ")], "t string, w string")
    assert [r[0] for r in df.select(T.count_matches(F.col("t"), F.col("w"))).collect()] == [3, 2, 1]


def test_fnv(spark):
    assert one(spark, T.fnv1a, "hello", "") == [1335831723, 2166136261]


def test_headings(spark):
    assert one(spark, T.fix_heading, "CHAPTERXXVIII.", "Chapter7: The Oak", "A  b") == ["CHAPTER XXVIII.", "Chapter 7: The Oak", "A b"]
    assert one(spark, T.has_numeral, "Chapter IV", "Chapter One", "ill", None) == [True, False, True, None]


def test_html(spark):
    page = (
        '<body><div id="pg-header"><p>licence</p></div><p>before</p><h2>CHAPTERI.</h2><p class="nind"><span><img alt="N" src="x"></span>OT all &amp; more<p>next <span class="pagenum">12</span>para'
        "<table><tr><td><p>no</p></td></tr></table><h2></h2><p>  </p><p>end</p><style>p {}</style></body>"
    )
    lines = ingest.read_html(spark.createDataFrame([("b", page), ("c", None)], "book_id string, html string"))
    got = ingest.sections_of(lines, least_words=1, numbered=0.5).orderBy("chapter_index").collect()
    assert [(r.title, r.paragraphs) for r in got] == [("CHAPTER I.", ["NOT all & more", "next para"])]
    every = ingest.sections_of(lines, least_words=1).orderBy("chapter_index").collect()
    assert [r.title for r in every] == ["CHAPTER I.", "Front matter"]


def test_chunks(spark):
    long_ = " ".join(f"Word{i} goes on here." for i in range(400))
    rows = [("b", 0, [long_]), ("b", 3, [f"Paragraph {i} has a few words in it." for i in range(120)]), ("b", 4, ["short one", None, "  "]), ("b", 5, [])]
    made = ingest.chunk(spark.createDataFrame(rows, "book_id string, chapter_index int, paragraphs array<string>")).collect()
    assert len({r.id for r in made}) == len(made)
    assert all(r.word_count <= 350 + 60 for r in made)
    by = {}
    for r in made:
        by.setdefault(r.chapter_index, []).append(r)
    assert len(by[0]) > 4 and len(by[3]) > 2 and [r.text for r in by[4]] == ["short one"] and 5 not in by
    # each chunk begins with the end of the one before
    for a, b in zip(by[3], by[3][1:], strict=False):
        assert a.text.endswith(b.text.split("\n\n")[0].split(". ")[-1])


def test_percentiles_are_not_interpolated(spark):
    df = spark.createDataFrame([("b", w) for w in (10, 20, 30, 40)], "book_id string, word_count int")
    r = ingest.size_report(df).first()
    assert (r.p10, r.p50, r.p90, r["max"], r.n) == (10, 20, 30, 40, 4)


def test_title_echoes(spark):
    rows = [("b", 0, "Chapter 1: The Oak", ["Chapter 1", "THE OAK", "Body", "The Oak"]), ("b", 1, None, ["Body"]), ("b", 2, "X", [])]
    got = ingest.chapter_texts(spark.createDataFrame(rows, "book_id string, chapter_index int, title string, paragraphs array<string>")).orderBy("chapter_index").collect()
    assert [(r.dropped, r.text) for r in got] == [(2, "Body\n\nThe Oak"), (0, "Body"), (0, "")]
