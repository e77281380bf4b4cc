"""Helpers on whole frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of the table of bits of ``may_meet``: 2^23 bits, 1 MB.
MEET_BITS = 23
#: Repeated keys that ``once`` broadcasts at most, some 20 MB.
MOST_REPEATED = 200_000


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions use as they are.

    An ordinary column may be merged into every place that uses it and computed
    there again, inside a lambda once for each element. A generator's output isn't.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def numbered(df: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``by``, without all rows meeting in one task.

    Rows are sorted in ranges and written once, each with its range and place
    within it; only the counts of the ranges meet. Null sorts first. Rows that
    tie in ``by`` are numbered in any order; an empty frame stays empty.
    """
    from ..sources.tables import materialise

    low = F.monotonically_increasing_id()
    # the upper bits are the range, the lower 33 the place within it
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", low)
    kept = materialise(sorted_.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")).drop("_at"), "numbered")
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range: as many as there are shuffle partitions
    starts = counts.select("_range", before.alias("_start"))
    return kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with each ``key`` once, as ``dropDuplicates`` has it; a row moves only if its key is repeated.

    ``df`` is read three times, first for its keys alone. Where more keys are
    repeated than are broadcast, all rows move.
    """
    from ..sources.tables import materialise

    repeated = materialise(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "repeated")
    if repeated.count() > MOST_REPEATED:
        return df.dropDuplicates([key])
    # null is a key like any other
    keys, same = F.broadcast(repeated), F.col(key).eqNullSafe(F.col("_key"))
    return df.join(keys, same, "left_anti").unionByName(df.join(keys, same, "left_semi").dropDuplicates([key]))


def may_meet(df: DataFrame, named: DataFrame, key: str = "id") -> DataFrame:
    """``df`` without most of the rows whose ``key`` isn't in ``named``, so that a join of both moves less of it.

    A row goes if a bit of its key's hash isn't set in a broadcast table; the few
    others are left to the join. A null key goes. ``named`` is read once for it.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << MEET_BITS)).cast("int")
    # a row for each bit that is set at most
    set_ = named.where(F.col(key).isNotNull()).select(at.alias("at")).distinct().toArrow()["at"]
    bits = np.zeros(1 << MEET_BITS, np.uint8)
    bits[set_.to_numpy()] = 1
    sent = named.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    @F.pandas_udf("boolean")
    def there(at: pd.Series) -> pd.Series:
        place = at.to_numpy(np.int64)
        return pd.Series((np.frombuffer(sent.value, np.uint8)[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool))

    return df.where(F.col(key).isNotNull() & there(at))
