import pytest

from folianta.llm import p1_pairs, p3_sentences, p9_cuts, structure

PAIRS = [
    ("Who sold the mill?", None, "empty"),
    ("Who sold the mill?", " ​\n", "empty"),
    ("Who sold the mill?", "N/A", "empty"),
    ("Who sold the mill?", "<p></p>", "empty"),
    ("Who sold the mill?", "…", "empty"),
    ("Who sold the old mill on the hill?", "WHO SOLD THE OLD MILL ON THE HILL", "copy"),
    ("Who sold the old mill on the hill?", "Question: Who sold the old mill on the hill?", "copy"),
    ("Who sold the old mill on the hill?", "Who sold the old mill on the hill?\nWho sold the old mill on the hill?", "copy"),
    ("Who sold the old mill on the hill?", "Who sold the old mill on the hill? It was the aunt who sold it in spring.", None),
    ("Who sold the mill?", "I'm sorry, but I can't help with that. You could try another question.", "refusal"),
    ("Wer verkaufte die Mühle?", "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
    ("¿Quién vendió el molino?", "No me es posible responder a esta pregunta.", "refusal"),
    ("Qui a vendu le moulin ?", "Je ne suis pas en mesure de vous aider à ce sujet.", "refusal"),
    ("Who sold the mill?", '"I cannot help you," said the aunt, and that is the answer to the clerk.', None),
    ("Who sold the mill?", "I'm sorry that the day is not given, but the aunt sold it in spring.", None),
    ("Who sold the mill to the aunt?", "Die Tante verkaufte die Mühle im Frühling, und niemand sprach davon.", "other_language"),
    ("Put the line about the mill into German.", "Die Tante verkaufte die Mühle im Frühling, und niemand sprach davon.", None),
    ("Who sold the mill to the aunt?", "她说：“磨坊是我的。”她说：“花园是我的。”", "other_language"),
    ("Who sold the mill?", "It was the aunt who sold it in the early spri", "truncated"),
    ("Who sold the mill?", "It was the aunt who sold it. [a_book:3:1] It is [a_boo", "truncated"),
    ("Who sold the mill?", "It was the aunt who sold it. [a_book:3:1]", None),
    ("Which chapter has the mill?", "Chapter 12", None),
    ("Which things does she leave?", "Three things are named:\n- the old mill\n- the new barn\n- the long wall", None),
    ("Who sold it?", "```\ncode", "truncated"),
    (None, "It was the aunt.", None),
]


LABELLED = {
    "en": "The aunt sold the mill in the spring, and nobody spoke of it to the clerk. Who knows what the letter said? It was she who had hidden it when the lamp was lit, and they all went home.",
    "de": "Die Tante verkaufte die Mühle im Frühling, und niemand sprach mit dem Schreiber davon. Wer weiß, was in diesem Brief stand? Sie hatte ihn versteckt, als es dunkel war, und alle gingen nach Hause.",
    "fr": "La tante a vendu le moulin au printemps, et personne n'en parlait au notaire. Qui sait ce que disait la lettre ? Elle l'avait cachée quand la lampe était allumée, et tous sont rentrés chez eux.",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"{lang}-{lang.upper()}" if i % 2 else lang, text + f" {i}") for lang, text in LABELLED.items() for i in range(12)] + [("en", None), (None, "Nobody."), ("ru", "Никто не знал. ok")]
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.fixture(scope="module")
def languages(labelled):
    return p1_pairs.learn_languages(labelled)


@pytest.mark.parametrize(("question", "answer", "want"), PAIRS)
def test_defects(question, answer, want, languages):
    assert p1_pairs.defect(question, answer, languages) == want


def test_languages_are_learnt(spark, labelled, languages):
    assert languages.names == ["de", "en", "fr"]
    assert languages.likeliest(p1_pairs.plain_words("Niemand verkaufte den Brief im Frühling.")) == "de"
    # languages without a profile: the answer isn't in that of the question
    for other in ("O velho farol foi aceso pelo tio durante a noite e ninguém sabia porquê.", "De oude lamp werd door de oom aangestoken, maar niemand wist waarom."):
        assert p1_pairs.defect("Who sold the mill to the aunt?", other, languages) == "other_language"
    assert p1_pairs.defect("Who sold the mill?", "Mi dispiace, ma non posso rispondere.", languages) == "refusal"
    assert p1_pairs.learn_languages(labelled.limit(0)).names == []
    # without profiles only scripts tell
    assert p1_pairs.defect("Who sold the mill to the aunt?", "Die Tante verkaufte die Mühle im Frühling, und niemand sprach davon.") is None


def test_a_question_given_back_often():
    question = "Who sold the old mill on the hill?"
    assert all(p1_pairs.defect(question, " ".join([question] * n)) == "copy" for n in range(1, 12))


OPEN = [
    ('It was the aunt who sold it, and she said "I shall keep it.', [("inner", '"')], "truncated"),
    ("It was the aunt. „Ich weiß es“, said she, ‘and I sold it.", [("inner", "‘")], "truncated"),
    ("It was the aunt (as the clerk says. " + "She sold it. " * 60, [("bracket", "(")], "truncated"),
    ("It was <b>the aunt.", [("tag", "b")], "truncated"),
    ("It was **the aunt.", [("stress", "**")], "truncated"),
    ("~~~\na ``` b (\n```\n~~~\nIt was the aunt.", [], None),
    ("She wrote `f(x` and a note*. It was the aunt.", [], None),
    ("“It was the aunt.\n\n“She sold it,” said Anna.", [], None),
    # sentences of a quotation stand alone, so these are complete
    ("It was the aunt. “She sold it in spring.", [("quote", "“")], None),
    ('It was the aunt. [a_book:3:1] "Look there!', [("quote", '"')], None),
    ("She asked: 5\" or ‘tis 6\"? The boys’ aunt sold it.", [], None),
]


@pytest.mark.parametrize(("answer", "still", "want"), OPEN)
def test_one_stack_over_the_whole_answer(answer, still, want):
    assert structure.left_open(answer) == still
    assert p1_pairs.defect("Who sold the mill?", answer) == want


def test_open_marks_take_linear_time():
    assert len(structure.left_open("(“" * 50_000 + "]»" * 50_000)) >= 50_000
    assert structure.left_open('"' * 200_000) == []
    assert structure.left_open(r"\( and \" and :( but not (") == [("bracket", "(")]


def test_tiling_takes_the_longest_first():
    assert p1_pairs.tiles("a b c d e".split(), "c d e a b c d".split()) == [(0, 3, 4), (2, 0, 3)]


def _greedy(a, b, least):
    used, found = [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return found
        n, i, j = best
        used[j : j + n] = [True] * n
        found.append((i, j, n))


def test_tiling_equals_brute_force():
    import random

    random.seed(5)
    for _ in range(300):
        a, b = random.choices("abc", k=random.randint(1, 12)), random.choices("abcd", k=random.randint(0, 30))
        for least in (1, 2, 3):
            assert p1_pairs.tiles(a, b, least) == _greedy(a, b, least)
    assert p1_pairs.tiles(["x"] * 20_000, ["x"] * 50_000)[0] == (0, 0, 20_000)


def test_pairs_table(spark, labelled):
    rows = [(1, "Who sold it?", None, 1), (1, "Who sold it?", None, 1), (2, "Who?", "The aunt sold it.", 2), (None, "Who?", None, 3), (3, "x " * 20_000, "x " * 50_000, 4)]
    df = spark.createDataFrame(rows, "id bigint, question string, answer string, defect int")
    got = sorted((r.feedback_id, r.defect) for r in p1_pairs.defective_pairs(df, labelled).collect())
    plan = p1_pairs.defective_pairs(df, labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {(r.verdict, r.defect, r.pairs) for r in p1_pairs.defect_counts(df).collect()} >= {("none", "empty", 1), ("none", "sound", 1)}
    assert got[0] == (1, "empty") and all(i != 2 for i, _ in got)
    assert p1_pairs.defective_pairs(df.limit(0)).count() == 0


ENDINGS = {
    "He went home.": "complete",
    'He said, "Go!"': "complete",
    "« Il le sait bien. »": "complete",
    "她说：“钥匙是我的。”": "complete",
    "He went home. 😀 ": "complete",
    "He went ho": "bare",
    "He went home, and": "bare",
    "by mo\n": "bare",
    "He went ho�": "broken",
    "He said &am": "broken",
    "He went hom…": "ellipsis",
    "though Mr.": "abbreviation",
    "answered no.": "complete",
    "He wrote this.\n— Anna Moor": "closing",
    "He wrote this.\nA. Moor": "closing",
    "He wrote this.\nThe End": "closing",
    "He wrote this.\n* * *": "closing",
    "He wrote this.\nMoor House, 1854": "closing",
    "He wrote this [a_book:3:1]": "closing",
    "O bridge of the mill\nand hope, and hope again\nat the end of the day": "closing",
    "(the clerk thought not!": "open",
    " \n​": "blank",
    "<b>The lamp was lit.": "open",
    '{"a": "x.': "open",
    "The lamp was lit. “It was late.": "open",
    "She said, “I will come tomorrow. It was late and the lamp.": "open",
    "(" + "The lamp was lit. " * 30 + "The end.": "open",
    "The lamp was lit by Lt. H.": "abbreviation",
    'See <a href="' + "x" * 600: "broken",
    "She thought so :( and went.": "complete",
}


@pytest.mark.parametrize(("text", "want"), ENDINGS.items())
def test_endings(text, want):
    assert p9_cuts.ending(text) == want


def test_cut_table(spark):
    rows = [(1, "He went ho", "a", 9), (1, "He went ho", "a", 9), (2, "He went home.", "a", 9), (3, None, None, 9), (4, "", "b", 9), (5, "ก" * 3, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cut int")
    assert [r.doc_id for r in p9_cuts.cut_documents(df).collect() if r.doc_id != 5] == [1]
    rates = {r.source: (r.documents, r.cut) for r in p9_cuts.cut_rates(df).collect()}
    assert rates["a"] == (2, 1)
    assert p9_cuts.cut_documents(df.limit(0)).count() == 0


def test_long_text_is_read_whole(spark):
    text = "He went home. " * 40_000
    assert p9_cuts.ending(text) == "complete" and p9_cuts.ending(text + "He we") == "bare"
    assert p9_cuts.ending("He went." + " " * 200_000 + "He we" + "😀 " * 50_000) == "bare"


def test_a_source_without_terminators_is_no_source_of_cuts(spark):
    rows = [(i, f"lamp of brass, item {i}", "catalogue") for i in range(50)] + [(100 + i, f"The lamp was lit by {i}.", "letters") for i in range(200)] + [(400, "The lamp was li", "letters"), (401, "The lamp was li", "new"), (402, "lamp of brass, cut (and", "catalogue")]
    # texts of one source that pile up at a length
    rows += [(1000 + i, ("brass lamp " * 40)[: 100 + i * 3], "shelf") for i in range(60)] + [(2000 + i, (f"brass lamp {i} " * 40)[:250], "shelf") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id for r in p9_cuts.cut_documents(df).collect()}
    assert {i for i in got if i < 1000} == {400, 401, 402}
    assert {i for i in got if i >= 2000} == set(range(2000, 2030))
    assert {r.source: r.cut for r in p9_cuts.cut_rates(df).collect()}["catalogue"] == 1


BOOK = [
    ("1", 'Dr. Moor came. He sold 3.5 pounds, i.e. all of it. "Never! I will not," said Anna.\n\nThe end came. It was late.'),
    ("2", "“My aunt sold it. She told Anna so.” He asked Anna for it and she answered no. (Who thought not!) Then Dr. Hall left."),
    ("3", "Heute kam\nHr. Wald. Am 20. Juli ging er.\n\nCHAPTER 7\n\nWo ist er? Niemand weiß es."),
    ("4", "「決して！」とアンナは叫んだ。「だめだ！わたしは売った。」値段は3.5円だ。"),
    ("5", "ไม่มีใครรู้ เสื้อคลุมริมคลอง"),
]


@pytest.fixture(scope="module")
def model(spark):
    # a small corpus in which the titles stand often before a name and never end a paragraph
    train = [(f"t{i}", f"Dr. Hall came.\n\nHr. Wald left.\n\nShe went.\n\nDr. Hall came. Hr. Wald left. She saw Dr. Moor. It was so. Am 20. Juli kam er.\n\n「決して！」とアンナは叫んだ。\n\nThen no. {i} came. He went.\n\nAll said so.\n\nHe sold it, e.g. here.\n\n\"Never! I will not,\" said Anna.\n\n“My aunt sold it. She told Anna so.”\n\n(Who thought not!) Then he left it.\n\n(No.)") for i in range(60)]
    return p3_sentences.train(spark.createDataFrame(train + BOOK, "id string, text string"))


def test_sentences(spark, model):
    df = spark.createDataFrame(BOOK + BOOK[:1] + [("6", None), ("7", "  "), (None, "A. B.")], "id string, text string")
    got = {}
    for r in p3_sentences.sentences(df, model=model).orderBy("id", "sentence_no").collect():
        got.setdefault(r.id, []).append(r.sentence)
    assert got["1"] == ["Dr. Moor came.", "He sold 3.5 pounds, i.e. all of it.", '"Never!', 'I will not," said Anna.', "The end came.", "It was late."]
    assert got["2"][:2] == ["“My aunt sold it.", "She told Anna so.”"]
    assert got["2"][-1].endswith("Dr. Hall left.")
    assert got["3"] == ["Heute kam\nHr. Wald.", "Am 20. Juli ging er.", "CHAPTER 7", "Wo ist er?", "Niemand weiß es."]
    assert got["4"] == ["「決して！」とアンナは叫んだ。", "「だめだ！", "わたしは売った。」", "値段は3.5円だ。"]
    assert got["5"] == ["ไม่มีใครรู้", "เสื้อคลุมริมคลอง"]
    assert set(got) == {"1", "2", "3", "4", "5"}


def test_starts_hold_the_whole_text(spark, model):
    df = spark.createDataFrame(BOOK, "id string, text string")
    texts = dict(BOOK)
    for key in texts:
        at = sorted(r.start_pos for r in p3_sentences.sentence_starts(df, model=model).where(f"id = '{key}'").collect())
        assert at[0] == 0 and all(not texts[key][a].isspace() for a in at)


def test_held_out_accuracy(spark):
    # sentences glued from parts whose boundaries are known
    import random

    random.seed(3)
    parts = ["The aunt sold the mill.", "Dr. Hall went home.", "Who saw Mr. Moor?", "They came, e.g. from the east, to No. 5 Hill Street.", "“I know it,” said Anna.", "The price rose from 3.5 to 4.75 pounds.", "Anna, the clerk, etc. came too."]
    rows, want = [], {}
    for i in range(400):
        paragraphs, at, places = [], 0, set()
        for _ in range(3):
            chosen = random.choices(parts, k=4)
            for j, c in enumerate(chosen):
                places.add(at)
                at += len(c) + (1 if j < 3 else 2)
            paragraphs.append(" ".join(chosen))
        rows.append((f"c{i}", "\n\n".join(paragraphs)))
        want[f"c{i}"] = places
    df = spark.createDataFrame(rows, "id string, text string")
    got = {}
    for r in p3_sentences.sentence_starts(df).collect():
        got.setdefault(r.id, set()).add(r.start_pos)
    hit = sum(len(got[k] & want[k]) for k in want)
    assert hit / sum(map(len, want.values())) > 0.99 and hit / sum(map(len, got.values())) > 0.98


def test_no_texts(spark):
    assert p3_sentences.sentence_starts(spark.createDataFrame([], "id string, text string")).count() == 0
