"""The library's index, notes, feedback log, case files and result files as sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a table of chapter notes holds.
NOTES = "book_id string, chapter_index int, title string, summary string, moments array<string>"


class IndexFault(ValueError):
    """An index that is missing or doesn't fit together."""


def write_index(passages: DataFrame, vectors: DataFrame, path: str) -> None:
    """Passages with their vectors (id, vector) as one table in a folder for each book.

    A passage without a vector is kept with a null one, and ``load_index`` reports it.
    """
    joined = passages.drop("vector").join(vectors.select("id", "vector"), "id", "left")
    # a large book is cut into several files by id, so that no task writes it alone
    joined.repartition("book_id", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("book_id").parquet(path)


def load_index(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """The table written by ``write_index``; an ``IndexFault`` if it is missing, has passages without vector, or vectors of another size."""
    try:
        index = spark.read.parquet(path)
    except AnalysisException as error:
        raise IndexFault(f"there is no index at {path}") from error
    index = index.withColumn("book_id", F.col("book_id").cast("string"))
    size = F.size("vector")
    bare, odd = index.agg(F.count(F.when(F.col("vector").isNull(), 1)), F.count(F.when(F.col("vector").isNotNull() & (size != dims), 1))).first()
    if bare:
        raise IndexFault(f"{bare} passages have no vector")
    if odd:
        raise IndexFault(f"{odd} vectors don't have {dims} numbers")
    return index


def with_planted(index: DataFrame, planted: DataFrame) -> DataFrame:
    """``index`` with further rows for one evaluation; nothing is written."""
    return index.unionByName(planted.select(*index.columns))


def write_notes(notes: DataFrame, path: str) -> None:
    """Chapter notes as a table, over those written before; columns beyond ``NOTES`` are left out."""
    columns = [part.split(" ")[0] for part in NOTES.split(", ")]
    notes.select(*columns).write.mode("overwrite").parquet(path)


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    """Chapter notes; an empty table where none have been written or they can't be read."""
    try:
        return spark.read.schema(NOTES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], NOTES)


def append_feedback(feedback: DataFrame, path: str, chars: int = 4000) -> None:
    """Adds feedback to a log of JSON lines, answers cut to ``chars``."""
    feedback.withColumn("answer", F.substring("answer", 1, chars)).write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``cases`` in case files, each one JSON document; ``schema`` is that of a case."""
    files = spark.read.schema(f"cases array<struct<{schema}>>").json(path, multiLine=True)
    return files.select(F.explode("cases").alias("c")).select("c.*")


def write_results(results: DataFrame, path: str) -> None:
    """A run's results as JSON lines, over those of the run before."""
    results.write.mode("overwrite").json(path)
