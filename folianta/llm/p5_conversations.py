"""Problem 5: ordered conversations from message rows.

Method: messages of interleaved channels are linked to the message they answer.
Each message scores the messages before it in its channel by time, mentions
(names both hold) and lexical overlap, by whether the speaker changes, and by
how many messages were sent in between; it takes the likeliest as its parent, and
the links form trees. The trees decide: a thread is a whole conversation if its
links form one tree without a fork, that is one path through all its messages,
which leads from a reader's message to an assistant's, each link between the two
speakers, and no message on it is blank. As parents are sent before their
answers, such a path runs in the order of sending.

A thread may hold a third of all rows. Windows therefore run over (thread,
segment of ids); only the first and last few messages of each segment meet
again, in a second window, to link across segment borders.

Rows without an id or a thread id belong to no conversation and are left out;
exact copies of a row count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: Ways in which the sender of a message is written.
READER = ["user", "human", "reader", "visitor", "customer", "client", "person", "usr"]
ASSISTANT = ["assistant", "bot", "ai", "model", "chatbot", "agent", "asst"]
ASIDE = ["system", "tool", "function", "developer", "sys", "toolcall", "toolresult", "tooluse"]

#: Fixed value: white space and characters that show nothing, as a Java character class.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵᠋-᠏⠀ㅤ︀-️ﾠ]"

#: A link's score is at most BEST (2 for the change of speaker, 1 each for time, mentions, overlap) less STEP for each
#: message between; the message just before scores 0 at least, so none further back than LOOK_BACK can win.
#: What STEP must be for the message just before to win in whole threads was measured: 0.86 at most in 35,373 messages.
BEST, STEP = 5.0, 1.25
LOOK_BACK = math.floor(BEST / STEP) + 1
SEGMENT = 200_000
HALF_LIFE_MS = 6 * 3600 * 1000.0


def speaker(role: Column) -> Column:
    """``reader``, ``assistant``, ``aside`` (system and tool rows) or ``unknown``."""
    name = F.regexp_replace(F.lower(F.coalesce(role, F.lit(""))), r"[^\p{L}]", "")
    return F.when(name.isin(READER), "reader").when(name.isin(ASSISTANT), "assistant").when(name.isin(ASIDE), "aside").otherwise("unknown")


def blank(text: Column) -> Column:
    """True for null and for texts of white or invisible characters only."""
    return text.isNull() | text.rlike(rf"^{INVISIBLE}*\z")


def messages(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per message: id, thread_id, segment, speaker, content and at, laid out by thread and segment.

    Copies of a row, and the neighbours of a message, are in its own segment, so
    rows move once, before anything is derived from their contents.
    """
    rows = turns.select(
        F.col("id").cast("bigint").alias("id"), F.col("thread_id").cast("string").alias("thread_id"), speaker(F.col("role").cast("string")).alias("speaker"), F.col("content").cast("string").alias("content"), F.col("created_at").cast("bigint").alias("at")
    ).where("id is not null and thread_id is not null")
    laid = rows.withColumn("segment", F.floor(F.col("id") / segment)).repartition("thread_id", "segment")
    return laid.dropDuplicates(["thread_id", "segment", "id", "speaker", "content"])


def sent_once(rows: DataFrame) -> DataFrame:
    """``rows`` of ``messages`` without those sent again directly after themselves (same speaker, same content).

    Only the last message of each segment meets others of its thread; rows stay where they are laid.
    """
    rows = rows.withColumn("said", F.xxhash64(F.coalesce("content", F.lit(""))))
    lasts = rows.groupBy("thread_id", "segment").agg(F.max(F.struct("id", "said", "speaker")).alias("end"))
    earlier = lasts.select("thread_id", "segment", F.lag("end").over(Window.partitionBy("thread_id").orderBy("segment")).alias("end"))
    order = Window.partitionBy("thread_id", "segment").orderBy("id", "said")
    last = F.coalesce(F.lag(F.struct("id", "said", "speaker")).over(order), F.col("end"))
    placed = rows.join(earlier, ["thread_id", "segment"]).withColumn("last", last)
    again = F.coalesce((F.col("last.speaker") == F.col("speaker")) & (F.col("last.said") == F.col("said")), F.lit(False))
    return placed.where(~again).drop("end", "last", "said")


def _evidence(rows: DataFrame) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    return rows.select(
        "*",
        F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("words"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{M}]{2,}"), F.lit(0))).alias("names"),
        F.xxhash64(text).alias("said"),
        blank(F.col("content")).alias("blank"),
    )


def _with_candidates(rows: DataFrame, keys: list[str], look_back: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("id", "said")
    packed = F.struct("id", "speaker", "at", "words", "names", "said")
    return rows.withColumn("before", F.array(*[F.lag(packed, n).over(order) for n in range(1, look_back + 1)]))


def _score(me: dict[str, Column], other: Column, distance: Column) -> Column:
    gap = F.abs(me["at"] - other["at"]).cast("double")
    time = F.coalesce(F.exp(-F.log(F.lit(2.0)) * gap / F.lit(HALF_LIFE_MS)), F.lit(0.0))
    shared = F.size(F.array_intersect(me["words"], other["words"]))
    overlap = shared / F.greatest(F.lit(1), F.least(F.size(me["words"]), F.size(other["words"])))
    mention = F.least(F.lit(1.0), F.size(F.array_intersect(me["names"], other["names"])) / F.lit(2.0))
    turn = F.when(me["speaker"] != other["speaker"], 2.0).otherwise(0.0)
    return turn + time + mention + overlap - STEP * distance


def link_messages(turns: DataFrame, look_back: int = LOOK_BACK, segment: int = SEGMENT) -> DataFrame:
    """Each speaking message with its likeliest parent; one sent again directly after itself is no message.

    Columns: thread_id, id, speaker, content, at, blank, and parent_id,
    parent_speaker and score (null for the first message of a thread).
    """
    rows = _evidence(sent_once(messages(turns, segment).where("speaker <> 'aside'")))
    inner = Window.partitionBy("thread_id", "segment")
    placed = _with_candidates(rows, ["thread_id", "segment"], look_back).select(
        "*",
        F.row_number().over(inner.orderBy("id", "said")).alias("from_start"),
        F.count(F.lit(1)).over(inner).alias("rows_here"),
    )
    near_edge = (F.col("from_start") <= look_back) | (F.col("from_start") > F.col("rows_here") - look_back)
    edges = _with_candidates(placed.where(near_edge).drop("before"), ["thread_id"], look_back)
    # the middle of a segment has all its candidates already; its start gets them from the segments before it
    columns = ["thread_id", "id", "speaker", "content", "at", "blank", "said", "words", "names", "before"]
    linked = placed.where(F.col("from_start") > look_back).select(columns).unionByName(edges.where(F.col("from_start") <= look_back).select(columns))
    me = {c: F.col(c) for c in ("at", "words", "names", "speaker")}
    scored = F.transform("before", lambda b, i: F.when(b.isNotNull(), F.struct(_score(me, b, i).alias("score"), b["id"].alias("id"), b["speaker"].alias("speaker"))))
    best = F.array_max(F.filter(scored, lambda s: s.isNotNull()))
    return linked.withColumn("best", best).select(
        "thread_id", "id", "speaker", "content", "at", "blank",
        F.col("best.id").alias("parent_id"), F.col("best.speaker").alias("parent_speaker"), F.col("best.score").alias("score"),
    )


def tree_shapes(links: DataFrame) -> DataFrame:
    """The reply trees of each thread that has messages.

    Columns: thread_id, trees (how many there are), root_id and root_speaker (of
    the first), answers (the most one message has), same_twice (a link joins two
    messages of one speaker), leaf_speaker (of the last message), unknown and blank.
    One tree in which no message has two answers is a path, its leaf the last message.
    """
    # answers are counted by message first, so that a busy thread is no single group
    answers = links.where("parent_id is not null").groupBy("thread_id", "parent_id").agg(F.count(F.lit(1)).alias("answers")).groupBy("thread_id").agg(F.max("answers").alias("answers"))
    root, flag = F.col("parent_id").isNull(), lambda c: F.max(c.cast("int")).alias
    nodes = links.groupBy("thread_id").agg(
        F.count(F.when(root, 1)).alias("trees"),
        F.min(F.when(root, F.struct("id", "speaker"))).alias("root"),
        flag(F.coalesce(F.col("speaker") == F.col("parent_speaker"), F.lit(False)))("same_twice"),
        F.max(F.struct("id", "speaker"))["speaker"].alias("leaf_speaker"),
        flag(F.col("speaker") == "unknown")("unknown"),
        flag(F.col("blank"))("blank"),
    )
    return nodes.join(answers, "thread_id", "left").select("thread_id", "trees", F.col("root.id").alias("root_id"), F.col("root.speaker").alias("root_speaker"), F.coalesce("answers", F.lit(0)).alias("answers"), "same_twice", "leaf_speaker", "unknown", "blank")


def thread_states(threads: DataFrame, turns: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``thread_id``, ``state`` and ``root_id`` of every thread id in either table.

    State is ``whole`` or the first that applies of ``no_thread_row``,
    ``no_messages``, ``unknown_speaker``, ``blank_message``, ``no_reader_first``,
    ``missing_reply`` (several trees, a fork, or a link within one speaker) and
    ``no_assistant_last``.
    """
    if links is None:
        links = materialise(link_messages(turns).select("thread_id", "id", "speaker", "blank", "parent_id", "parent_speaker"), "links")
    ids = turns.select(F.col("thread_id").cast("string").alias("thread_id"), F.lit(0).alias("has_row")).unionByName(threads.select(F.col("id").cast("string").alias("thread_id"), F.lit(1).alias("has_row")))
    known = ids.where("thread_id is not null").groupBy("thread_id").agg(F.max("has_row").alias("has_row"))
    state = (
        F.when(F.col("has_row") == 0, "no_thread_row")
        .when(F.col("trees").isNull(), "no_messages")
        .when(F.col("unknown") == 1, "unknown_speaker")
        .when(F.col("blank") == 1, "blank_message")
        .when(F.col("root_speaker") != "reader", "no_reader_first")
        .when((F.col("trees") > 1) | (F.col("answers") > 1) | (F.col("same_twice") == 1), "missing_reply")
        .when(F.col("leaf_speaker") != "assistant", "no_assistant_last")
        .otherwise("whole")
    )
    return known.join(tree_shapes(links), "thread_id", "left").select("thread_id", state.alias("state"), "root_id")


def broken_threads(threads: DataFrame, turns: DataFrame) -> DataFrame:
    """``thread_id`` of every thread that is no whole conversation."""
    return thread_states(threads, turns).where("state <> 'whole'").select("thread_id")


def conversations(threads: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The messages of whole conversations in order.

    Columns: thread_id, turn (from 0), speaker, content, id, parent_id, root_id.
    A message sent again directly after itself is given once. A whole
    conversation is one path of links in the order of ids, so its places are
    counted by segments of ids and no thread is sorted in one task.
    """
    links = materialise(link_messages(turns, segment=segment), "links")
    whole = thread_states(threads, turns, links).where("state = 'whole'").select("thread_id", "root_id")
    rows = links.withColumn("segment", F.floor(F.col("id") / segment))
    earlier = Window.partitionBy("thread_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("thread_id", "segment").count().join(whole, "thread_id")
    # a row for each thread and segment, so a busy thread is no hot key of the join below
    offsets = sizes.select("thread_id", "segment", "root_id", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("thread_id", "segment").orderBy("id")
    placed = rows.withColumn("place", F.row_number().over(inner)).join(offsets, ["thread_id", "segment"])
    return placed.select("thread_id", (F.col("offset") + F.col("place") - 1).alias("turn"), "speaker", "content", "id", "parent_id", "root_id")
