"""Retrieval quality: recall, reciprocal rank, precision, pass rates, bootstrap intervals."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import may_meet, numbered
from ..functions.text import citations, plain_lower, quote_words
from ..functions.vectors import dot


def expected_hits(ranked: DataFrame, cases: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, rank and hit: does the passage at a rank hold one of the case's expected terms?

    ``ranked`` has query_id, id and rank; ``cases`` query_id and any_of;
    ``passages`` id and text. Only texts that are ranked somewhere move.
    """
    texts = may_meet(passages.select("id", "text"), ranked.select("id"))
    joined = ranked.join(cases.select("query_id", "any_of"), "query_id").join(texts.select("id", plain_lower(F.col("text")).alias("text")), "id")
    hit = F.exists("any_of", lambda t: F.contains(F.col("text"), plain_lower(t)))
    return joined.select("query_id", "rank", F.coalesce(hit, F.lit(False)).alias("hit"))


def by_case(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, found (0 or 1) and rr (1 over the rank of the first hit, else 0) of every case."""
    first = hits.where("hit").groupBy("query_id").agg(F.min("rank").alias("first"))
    return cases.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.col("first").isNotNull().cast("int").alias("found"), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("rr"))


def pass_rates(results: DataFrame) -> DataFrame:
    """kind, goal, cases, passed and rate: by kind, by goal and over all, in one pass (grouping sets)."""
    # a null goal is a goal of its own, not the total of a grouping set
    named = results.select(F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("goal", F.lit("none")).alias("goal"), "passed")
    sets = [[F.col("kind")], [F.col("goal")], []]
    return named.groupingSets(sets, "kind", "goal").agg(F.count(F.lit(1)).alias("cases"), F.sum("passed").alias("passed"), F.round(F.avg("passed"), 6).alias("rate"))


def precision(hits: DataFrame, k: int) -> DataFrame:
    """query_id, precision (hits among the k) and weighted (mean of the precision at each hit; 0 without one)."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    one = F.col("hit").cast("int")
    seen = hits.where(F.col("rank") <= k).withColumn("at", F.when(F.col("hit"), F.sum(one).over(order) / F.col("rank")))
    return seen.groupBy("query_id").agg(F.round(F.sum(one) / k, 6).alias("precision"), F.coalesce(F.round(F.avg("at"), 6), F.lit(0.0)).alias("weighted"))


def majority(votes: DataFrame, needed: int = 2) -> DataFrame:
    """case_id and passed: at least ``needed`` of its votes (0 or 1)."""
    return votes.groupBy("case_id").agg((F.sum("vote") >= needed).alias("passed"))


def _draws(seed: float = 12345.0):
    """The generator results are defined by: a linear congruence in double arithmetic."""
    while True:
        seed = (seed * 1103515245.0 + 12345.0) % 2147483648.0
        yield seed / 2147483648.0


def bootstrap(values: DataFrame, iterations: int = 5000, key: str = "series") -> DataFrame:
    """key, n, mean, low and high (95 % of resampled means) for each series of values.

    ``values`` has the key, place and value. A series is the outcome of one case
    set, which people write by hand; its rows meet in one task, as the generator
    runs on from one resample to the next. An empty series has no row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("place")["value"].to_numpy(float)
        draw = _draws()
        means = np.empty(iterations)
        for b in range(iterations):
            at = np.fromiter((next(draw) for _ in range(len(x))), float, len(x))
            means[b] = x[(at * len(x)).astype(int)].sum() / len(x)
        means.sort()
        return pd.DataFrame({key: [rows[key].iloc[0]], "n": [len(x)], "mean": [x.mean()], "low": [means[int(iterations * 0.025)]], "high": [means[int(iterations * 0.975)]]})

    return values.groupBy(key).applyInPandas(run, f"{key} string, n bigint, mean double, low double, high double")


def bootstrap_spread(values: DataFrame, iterations: int = 5000, key: str = "series") -> DataFrame:
    """As ``bootstrap``, for series of any length: no task holds one.

    A draw is a hash of its resample and position, so it needs none before it
    and the bounds differ from ``bootstrap``'s as two seeds do. Places run from
    0 or any other number, without gaps.
    """
    sizes = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("_from"), F.avg("value").alias("mean"))
    drawn = values.select(key, "place").join(sizes.drop("mean"), key).select(key, "n", "_from", "place", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_b"))
    met = drawn.select(key, "n", "_b", (F.col("_from") + F.pmod(F.xxhash64("_b", (F.col("place") - F.col("_from")).cast("bigint")), F.col("n"))).alias("place")).join(values, [key, "place"])
    means = met.groupBy(key, "_b").agg((F.sum("value") / F.first("n")).alias("_mean"))
    # a row for each resample
    nth = means.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("_mean")) - 1)
    at = lambda share: F.max(F.when(F.col("_nth") == int(iterations * share), F.col("_mean")))
    return sizes.join(nth.groupBy(key).agg(at(0.025).alias("low"), at(0.975).alias("high")), key).select(key, "n", "mean", "low", "high")


def paired_bootstrap(a: DataFrame, b: DataFrame, iterations: int = 10_000) -> DataFrame:
    """n, difference, low, high and significant of the mean of b - a over the cases both have.

    Both have case_id and value. Cases are in order of their id.
    """
    both = a.select("case_id", F.col("value").alias("a")).join(b.select("case_id", F.col("value").alias("b")), "case_id")
    differences = numbered(both, ["case_id"]).select(F.lit("difference").alias("series"), "place", (F.col("b") - F.col("a")).alias("value"))
    out = bootstrap(differences, iterations)
    return out.select("n", F.col("mean").alias("difference"), "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def topic_coverage(required: DataFrame, found: DataFrame) -> DataFrame:
    """case_id and missing: the books a case asks for that no passage found is from."""
    books = found.groupBy("case_id").agg(F.collect_set("book_id").alias("books"))
    none = F.array().cast("array<string>")
    return required.join(books, "case_id", "left").select("case_id", F.array_sort(F.array_except("books_required", F.coalesce("books", none))).alias("missing"))


def needle_rates(results: DataFrame) -> DataFrame:
    """form, needles, found, rate and mean_rank (of those found) of planted passages."""
    return results.groupBy("form").agg(F.count(F.lit(1)).alias("needles"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def stride_sample(rows: DataFrame, by: list[str], most: int, offset: int = 0) -> DataFrame:
    """``most`` rows spread evenly over the order of ``by``, with their ``place`` in it.

    Every n-th row from ``offset`` on, n being the number of rows over ``most``
    rounded down (1 at least); a sampling operator. Fewer rows are all given.
    """
    placed = numbered(rows, by)
    stride = placed.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / most)).alias("_stride"))
    met = placed.crossJoin(F.broadcast(stride)).where((F.col("place") % F.col("_stride")) == (F.lit(offset) % F.col("_stride")))
    return met.drop("_stride").orderBy("place").limit(most)


def answer_relevance(questions: DataFrame, generated: DataFrame) -> DataFrame:
    """case_id, relevance, baseline and separation (6 places): is an answer about its question?

    ``questions`` has case_id and vector; ``generated`` a row for each question
    that an answer would answer (case_id, vector). Relevance is the mean product
    of a question and its own, the baseline that with the next case's (by
    case_id, the first after the last). Cases without generated questions take no part.
    """
    asked = questions.join(generated.select("case_id").distinct(), "case_id", "left_semi")
    ids = numbered(asked.select("case_id").distinct(), ["case_id"])
    size = F.broadcast(ids.agg(F.count(F.lit(1)).alias("n")))
    after = ids.crossJoin(size).select("case_id", F.pmod(F.col("place") + 1, F.col("n")).alias("place")).join(ids.select("place", F.col("case_id").alias("next_id")), "place").select("case_id", "next_id")
    # the sum of generated vectors would do for the mean, but not in the same rounding
    mean = lambda pairs, name: pairs.groupBy("case_id").agg(F.round(F.avg(dot(F.col("vector"), F.col("other"))), 6).alias(name))
    other = generated.select(F.col("case_id").alias("of"), F.col("vector").alias("other"))
    own = mean(asked.join(other, asked["case_id"] == other["of"]), "relevance")
    base = mean(asked.join(after, "case_id").join(other, F.col("next_id") == F.col("of")), "baseline")
    return own.join(base, "case_id").select("case_id", "relevance", "baseline", F.round(F.col("relevance") - F.col("baseline"), 6).alias("separation"))


def relevance_summary(each: DataFrame) -> DataFrame:
    """One row: cases, relevance, baseline and separation of the means (4 places; null without cases)."""
    own, base = F.avg("relevance"), F.avg("baseline")
    return each.agg(F.count(F.lit(1)).alias("cases"), F.round(own, 4).alias("relevance"), F.round(base, 4).alias("baseline"), F.round(own - base, 4).alias("separation"))


def least_relevant(each: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` cases with the least separation; ties go to the smaller id."""
    return each.orderBy("separation", "case_id").limit(most)


def seam_cases(seams: DataFrame, passages: DataFrame, terms: DataFrame) -> DataFrame:
    """Seams (before_id, after_id) whose ``before`` and ``after`` terms prove something: each in its own passage, not in the other.

    ``terms`` has before_id, before and after. Terms come back in normal form;
    those without a letter or digit are left out.
    """
    text = lambda id_, name: passages.select(F.col("id").alias(id_), quote_words(F.col("text")).alias(name))
    told = terms.select("before_id", quote_words(F.col("before")).alias("before"), quote_words(F.col("after")).alias("after")).where("before <> '' and after <> ''")
    met = seams.join(told, "before_id").join(text("before_id", "_a"), "before_id").join(text("after_id", "_b"), "after_id")
    has = lambda side, term: F.contains(F.col(side), F.col(term))
    return met.where(has("_a", "before") & ~has("_a", "after") & has("_b", "after") & ~has("_b", "before")).select("before_id", "after_id", "before", "after")


def seam_outcomes(cases: DataFrame, found: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id and outcome: ``both``, ``before``, ``after`` or ``neither`` of a case's terms are in its passages, put together.

    ``cases`` has query_id, before and after; ``found`` query_id, id and place.
    A query has few passages (k and their neighbours), so they are put together as one text.
    """
    texts = found.join(passages.select("id", quote_words(F.coalesce("text", F.lit(""))).alias("text")), "id")
    part = F.array_sort(F.collect_list(F.struct("place", "text")))
    whole = texts.groupBy("query_id").agg(F.array_join(F.transform(part, lambda p: p["text"]), " ").alias("whole"))
    joined = cases.join(whole, "query_id", "left")
    a, b = (F.coalesce(F.contains("whole", F.col(c)), F.lit(False)) for c in ("before", "after"))
    return joined.select("query_id", F.when(a & b, "both").when(a, "before").when(b, "after").otherwise("neither").alias("outcome"))


def seam_rates(outcomes: DataFrame) -> DataFrame:
    """One row: cases, both, either (one side only), neither and rate (of both; null without cases)."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    o = F.col("outcome")
    return outcomes.agg(F.count(F.lit(1)).alias("cases"), n(o == "both", "both"), n(o.isin("before", "after"), "either"), n(o == "neither", "neither"), F.round(F.avg((o == "both").cast("int")), 6).alias("rate"))


def guardrail_counts(results: DataFrame) -> DataFrame:
    """One row: answers judged good and bad, how many of each an audit flagged, and its precision (flags on bad answers; null without flags).

    ``results`` has flagged and passed (booleans); rows with a null in either are left out.
    """
    rows = results.where("flagged is not null and passed is not null")
    n = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    counted = rows.agg(n("passed", "good"), n("not passed", "bad"), n("passed and flagged", "flagged_good"), n("not passed and flagged", "flagged_bad"))
    flags = F.col("flagged_good") + F.col("flagged_bad")
    return counted.withColumn("precision", F.round(F.col("flagged_bad") / F.nullif(flags, F.lit(0)), 6))


def faithful_share(verdicts: DataFrame) -> DataFrame:
    """One row: picked, judged, faithful and share (of all picked, those without a verdict too) from ``faithful``, a boolean."""
    all_, good = F.count(F.lit(1)), F.count(F.when(F.col("faithful"), 1))
    return verdicts.agg(all_.alias("picked"), F.count("faithful").alias("judged"), good.alias("faithful"), F.round(good / F.nullif(all_, F.lit(0)), 6).alias("share"))


def places_cited(answers: DataFrame) -> DataFrame:
    """answer_id, chapters and books: how many different ones an answer cites (0 without citations)."""
    each = answers.select("answer_id", F.explode_outer(F.coalesce(citations(F.col("answer")), F.array().cast("array<string>"))).alias("id"))
    chapter = F.substring_index("id", ":", 2)
    return each.groupBy("answer_id").agg(F.countDistinct(chapter).alias("chapters"), F.countDistinct(F.substring_index("id", ":", 1)).alias("books"))
