"""Books as files of HTML, one whole file a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """book_id and html of every file below ``path``.

    A folder ``book_id=...`` names the book; a file outside such a folder is
    named by its own name, without what follows the last full stop. A file is
    one row, whatever its size, as a page can't be read from its middle.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("file"))
    folder = F.regexp_extract("file", r"/book_id=([^/]*)/", 1)
    own = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.select(F.url_decode(F.replace(F.when(folder != "", folder).otherwise(own), F.lit("+"), F.lit("%2B"))).alias("book_id"), "html")


def write_pages(pages: DataFrame, path: str) -> None:
    """``pages`` (book_id, html) as a file for each, in a folder for each book."""
    pages.select("book_id", "html").write.mode("overwrite").partitionBy("book_id").text(path)
