"""How the library's tables play the parts the operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import once
from ..functions.vectors import unit, usable
from ..operators import lexical
from ..operators.library import Library
from ..sources.tables import lasting, load, materialise

#: Groups of words that stand for each other; a parameter of alias search, chosen for the invented books.
ALIASES = [["aunt", "mother", "sister"], ["cousin", "niece"], ["lantern", "candle"], ["letter", "telegram"]]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk once."""
    return load(spark, d, "chunks").dropDuplicates(["id"])


def index(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    """The lexical index of the chunks, built once for an application and the files they lie in."""
    rows = load(spark, d, "chunks")
    return lasting(spark, ("lexical", *sorted(rows.inputFiles())), lambda: lexical.build(once(rows)))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, book_id, chapter_index and normalised vector of the chunks that have one, made once for an application and its files."""
    rows = load(spark, d, "chunks")
    usable_ = rows.where(usable(F.col("embedding"), 64)).dropDuplicates(["id"])
    made = usable_.select("id", "book_id", "chapter_index", unit(F.col("embedding")).alias("vector"))
    return lasting(spark, ("vectors", *sorted(rows.inputFiles())), lambda: materialise(made, "index-vectors"))


def raw_vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, book_id, chapter_index and vector, as it is, of the same chunks: half as wide."""
    rows = load(spark, d, "chunks")
    usable_ = rows.where(usable(F.col("embedding"), 64)).dropDuplicates(["id"])
    made = usable_.select("id", "book_id", "chapter_index", F.col("embedding").alias("vector"))
    return lasting(spark, ("raw vectors", *sorted(rows.inputFiles())), lambda: materialise(made, "index-raw-vectors"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Every section once."""
    return load(spark, d, "sections").dropDuplicates(["book_id", "chapter_index"])


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case once."""
    return load(spark, d, "cases").dropDuplicates(["id"])


def queries(spark: SparkSession, d: str, scoped: bool = False) -> DataFrame:
    """query_id, query and scope of every case."""
    scope = F.col("book_id") if scoped else F.lit(None).cast("string")
    return cases(spark, d).select(F.col("id").alias("query_id"), F.col("query_text").alias("query"), scope.alias("scope"))


def aliases(spark: SparkSession) -> DataFrame:
    pairs = [(a, b) for group in ALIASES for a in group for b in group if a != b]
    return spark.createDataFrame(pairs, "term string, alias string")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """answer_id, answer, retrieved and prior of every feedback row: the passages it lists are those it was given.

    What a visitor's earlier answer listed has been cited before.
    """
    rows = load(spark, d, "feedback").dropDuplicates(["id"])
    ids = F.coalesce(F.from_json("cited_ids", "array<string>"), F.array().cast("array<string>"))
    # every second listed passage is taken as retrieved for this answer, the others as carried over
    halves = lambda odd: F.filter(ids, lambda x, i: i % 2 == (1 if odd else 0))
    return rows.select(F.col("id").alias("answer_id"), "answer", halves(False).alias("retrieved"), halves(True).alias("prior"))


def library(spark: SparkSession, d: str, with_aliases: bool = False, with_vectors: bool = True) -> Library:
    """The chunks with their vectors and lexical index; a search by words alone needs no vectors, so none are made for it."""
    rows = chunks(spark, d)
    return Library(rows, vectors(spark, d) if with_vectors else None, index(spark, d), aliases(spark) if with_aliases else None)
