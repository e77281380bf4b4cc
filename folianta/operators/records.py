"""Threads, turns, feedback, usage and limits as tables."""

from __future__ import annotations


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings

HOUR_MS = 3_600_000


def latest(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The last saved row of each key, by the columns given; a repeated row counts once."""
    order = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in by])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert_threads(threads: DataFrame, saved: DataFrame) -> DataFrame:
    """``threads`` with ``saved`` put over them; a thread of another visitor isn't touched."""
    owner = threads.select("id", F.col("visitor").alias("_owner"))
    allowed = saved.join(owner, "id", "left").where("_owner is null or _owner = visitor").drop("_owner")
    return latest(threads.unionByName(allowed), "id", ["updated_at", "title"])


def replace_turns(turns: DataFrame, fresh: DataFrame) -> DataFrame:
    """``turns`` with those of every thread in ``fresh`` replaced by ``fresh``."""
    return turns.join(fresh.select("thread_id").distinct(), "thread_id", "left_anti").unionByName(fresh)


def save_threads(threads: DataFrame, turns: DataFrame, saved: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after ``saved`` threads and their ``fresh`` turns have been put over what was there.

    All turns of a saved thread are replaced, by none if ``fresh`` has none. A
    thread of another visitor keeps its row and its turns.
    """
    owner = threads.select("id", F.col("visitor").alias("_owner"))
    mine = saved.join(owner, "id", "left").where("_owner is null or _owner = visitor").select(F.col("id").alias("thread_id")).distinct()
    kept = turns.join(mine, "thread_id", "left_anti")
    return upsert_threads(threads, saved), kept.unionByName(fresh.join(mine, "thread_id", "left_semi"), allowMissingColumns=True)


def delete_threads(threads: DataFrame, turns: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the threads in ``gone`` (id, visitor) that belong to that visitor."""
    mine = threads.join(gone.select("id", "visitor"), ["id", "visitor"], "left_semi").select("id").distinct()
    return threads.join(mine, "id", "left_anti"), turns.join(mine.withColumnRenamed("id", "thread_id"), "thread_id", "left_anti")


def recent_threads(threads: DataFrame, most: int = 40) -> DataFrame:
    """The ``most`` threads saved last."""
    return threads.orderBy(F.desc("updated_at"), "id").limit(most)


def recent_by_visitor(threads: DataFrame, most: int = 40) -> DataFrame:
    """id, visitor, title, updated_at and place (from 1) of the ``most`` threads that each visitor saved last.

    Ties go to the smaller id; threads without a visitor belong to nobody's list.
    """
    order = Window.partitionBy("visitor").orderBy(F.desc("updated_at"), "id")
    placed = threads.where("visitor is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.select("id", "visitor", "title", "updated_at", "place")


def histories(listed: DataFrame, turns: DataFrame) -> DataFrame:
    """The messages of the threads in ``listed``, a row each: thread_id, visitor, place, turn_id, role, content and cited (array).

    A thread may be long, so its messages stay rows, in the order of turn_id.
    Messages without an id or thread are left out; a repeated row counts once;
    citations that can't be read are an empty array.
    """
    said = turns.where("id is not null and thread_id is not null").dropDuplicates(["id"])
    cited = F.coalesce(F.from_json("citations", "array<string>"), F.array().cast("array<string>"))
    rows = said.select("thread_id", F.col("id").alias("turn_id"), "role", "content", cited.alias("cited"))
    return listed.select(F.col("id").alias("thread_id"), "visitor", "place").join(rows, "thread_id")


def tool_usage(turns: DataFrame) -> DataFrame:
    """tool, calls and threads: how often each tool was called, from the steps of messages; steps that can't be read are none."""
    said = turns.where("id is not null").dropDuplicates(["id"])
    steps = said.select("thread_id", F.explode(F.from_json("steps", "array<struct<tool string>>")).alias("step")).where("step.tool is not null")
    return steps.groupBy(F.col("step.tool").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("thread_id").alias("threads"))


def merge_threads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Threads of two places (id, n_turns, at): of one id the longer wins, then the later."""
    return latest(a.unionByName(b), "id", ["n_turns", "at"])


def thread_titles(turns: DataFrame, speaker: Column, most: int = 46) -> DataFrame:
    """thread_id and title: the first message of the reader, cut to ``most`` characters and an ellipsis."""
    first = turns.where(speaker).groupBy("thread_id").agg(F.min_by("content", "id").alias("text"))
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("…"))).otherwise(F.col("text"))
    return first.select("thread_id", cut.alias("title"))


def vote(verdict: Column) -> Column:
    """``up``, ``down`` or null from verdicts in several spellings."""
    said = F.lower(F.trim(verdict))
    return F.when(said.isin("up", "down"), said)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """fault (null for the totals), up and down: all votes, and the down votes by fault named."""
    voted = feedback.select(vote(F.col("verdict")).alias("v"), "fault")
    up, down = F.count(F.when(F.col("v") == "up", 1)).alias("up"), F.count(F.when(F.col("v") == "down", 1)).alias("down")
    faults = voted.where("v = 'down' and fault is not null").groupBy("fault").agg(F.lit(0).cast("bigint").alias("up"), F.count(F.lit(1)).alias("down"))
    return voted.agg(up, down).select(F.lit("all").alias("fault"), "up", "down").unionByName(faults)


def candidate_cases(feedback: DataFrame) -> DataFrame:
    """New test cases from down votes: id, kind (by fault), query, cited (ids) and the answer's first 4000 characters."""
    kind = F.when(F.col("fault") == "retrieval", "retrieval").when(F.col("fault") == "writing", "answer").otherwise("unsorted")
    cited = F.coalesce(F.from_json("cited_ids", "array<string>"), F.array().cast("array<string>"))
    down = feedback.where(vote(F.col("verdict")) == "down")
    return down.select("id", kind.alias("kind"), F.col("question").alias("query"), F.array_join(cited, " ").alias("cited"), F.substring("answer", 1, 4000).alias("answer"))


def visitor_summary(feedback: DataFrame, threads: DataFrame) -> DataFrame:
    """One row: visitors, questions, down votes, threads and the seconds spent in them."""
    a = feedback.agg(F.countDistinct("visitor").alias("visitors"), F.count(F.lit(1)).alias("questions"), F.count(F.when(vote(F.col("verdict")) == "down", 1)).alias("down"))
    b = threads.agg(F.count(F.lit(1)).alias("threads"), F.round(F.coalesce(F.sum(F.col("updated_at") - F.col("created_at")), F.lit(0)) / 1000, 3).alias("seconds"))
    return a.crossJoin(F.broadcast(b))


def cost(prompt: Column, cached: Column, completion: Column, embedding: Column, settings: Settings = DEFAULTS) -> Column:
    """What a request costs, to 6 places; cached prompt tokens are discounted and the rest isn't below 0."""
    fresh = F.greatest(F.lit(0), prompt - cached)
    total = fresh * settings.price_in + cached * (settings.price_in * settings.cached_discount) + completion * settings.price_out + embedding * settings.price_embedding
    return F.round(total / 1e6, 6)


def newest(rows: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """The ``most`` newest rows (a ring buffer of traces)."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(most)


def requests_last_hour(requests: DataFrame) -> DataFrame:
    """visitor, at, id and used: the visitor's requests up to an hour before each, itself included.

    Each request is counted in its own hour and the next, so windows hold two
    hours of a visitor and not all there is of one. Requests without a time see only themselves.
    """
    hour = F.floor(F.col("at") / HOUR_MS)
    rows = requests.select("visitor", "at", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).where("at is not null").withColumn("hour", hour + F.col("later"))
    order = Window.partitionBy("visitor", "hour").orderBy("at").rangeBetween(-HOUR_MS, 0)
    counted = rows.withColumn("used", F.count(F.lit(1)).over(order)).where("later = 0").select("visitor", "at", "id", "used")
    return counted.unionByName(requests.where("at is null").select("visitor", "at", "id", F.lit(1).cast("bigint").alias("used")))


def admit(times: list[int], held: list[int], limit: int, window_ms: int = HOUR_MS) -> tuple[list[bool], list[int], list[int]]:
    """For requests in order: admitted or not, those used before each, and the admitted times still held."""
    out, used = [], []
    for at in times:
        held = [t for t in held if t > at - window_ms]
        used.append(len(held))
        out.append(limit == 0 or len(held) < limit)
        if out[-1] and limit:
            held.append(at)
    return out, used, held


def rate_limit(requests: DataFrame, limit: int, window_ms: int = HOUR_MS) -> DataFrame:
    """visitor, at, id, used and ok: a request is admitted if fewer than ``limit`` were within the hour before.

    A refused request is not counted, so each depends on those before it. A
    pause of an hour forgets everything, so a visitor's requests are cut into
    stretches at such pauses, which spread over the cluster whoever they belong
    to. Pauses are found on the first and last request of each hour only; a
    stretch is read in order and never held as a group. A limit of 0 admits
    everything. Requests without a time are left out.
    """
    rows = requests.select("visitor", "at", "id").where("at is not null").withColumn("bucket", F.floor(F.col("at") / window_ms))
    hours = rows.groupBy("visitor", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("visitor").orderBy("bucket")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(order) >= window_ms).cast("int"), F.lit(1))
    numbered = hours.withColumn("fresh", fresh).select("visitor", "bucket", F.sum("fresh").over(order).alias("stretch"))
    same = F.col("r.visitor").eqNullSafe(F.col("n.visitor")) & (F.col("r.bucket") == F.col("n.bucket"))
    placed = rows.alias("r").join(numbered.alias("n"), same).select("r.visitor", "n.stretch", "r.at", "r.id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, []
        for batch in batches:
            used, ok = [], []
            for visitor, stretch, at in zip(batch["visitor"], batch["stretch"], batch["at"], strict=True):
                if here != (visitor, stretch):
                    here, held = (visitor, stretch), []
                admitted, before, held = admit([at], held, limit, window_ms)
                used += before
                ok += admitted
            yield batch[["visitor", "at", "id"]].assign(used=used, ok=ok)

    ordered = placed.repartition("visitor", "stretch").sortWithinPartitions("visitor", "stretch", "at", "id")
    return ordered.mapInPandas(run, f"visitor {requests.schema['visitor'].dataType.simpleString()}, at bigint, id bigint, used bigint, ok boolean")
