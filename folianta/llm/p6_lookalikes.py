"""Problem 6: one form for text that looks the same but is written with different characters.

Method: a column of Arrow texts is copied to one numpy array of code points.
Lookup tables, gathered for all of it at once, delete what shows nothing,
expand ligatures and other compatibility characters by offsets, exchange
look-alike letters, spaces, hyphens and apostrophes, and take lower case;
combining marks are put in order and composed with their letters by vector
passes. No string function is called for a row.

To find names across the two tables, each name is looked for by its longest
word. Words of the texts pass a bit table of fixed size (a megabyte, whatever
the tables hold) that knows which words any name has as its longest, and only
the places that pass are joined, by word and book, with the names. A second table
of fixed size tells how long the names of such a word are at most, so that a long
name makes no other's pieces longer. The piece of text around such a place then
decides exactly, in both forms. The places of a word that stands very often are
salted: each salt meets the names of that word in a task of its own.

Null texts have the null form. Names without any letter or digit can't be read
anywhere. Exact copies of a row count once; rows without an id take no part.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise
from .arrow import code_points, plain, ragged, strings
from .words import word_hashes

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіѕјԁһӏԛԝɡ" "АВЕКМНОРСТУХІЅЈԚԜ" "ονραικχυ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "օսհցզյոՕՍԼՏ" "ⲟⲣⲥⲞⲢⲤⲦⲚⲘⲔⲎⲒ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴ" "ɑıɩʋ",
        "aeopcyxisjdhlqwg" "ABEKMHOPCTYXISJQW" "ovpaikxu" "ABEZHIKMNOPTYX" "ouhgqjnOULS" "opcOPCTNMKHI" "DRTAJEWMHGZRWVSLCPKB" "aiiv",
        strict=True,
    )
)
APOSTROPHES = "'’‘‛ʼʹ′`´＇ʻˈꞌ"
HYPHENS = "-‐‑‒–−⁃﹣－˗"
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

#: Bits of the table of longest words, and entries of the table of how long their names are (as a power of two).
BITS = 1 << 23
LENGTHS = 1 << 20
#: Places of a word that meet its names in one task, some 20 MB.
SALT_ROWS = 100_000


def _form(point: int) -> list[int]:
    """The code points that stand for one code point."""
    char = chr(point)
    kind = unicodedata.category(char)
    if char.isspace() or kind in ("Zs", "Zl", "Zp"):
        return [32]
    if kind in ("Cf", "Cc") or point in UNSEEN:
        return []
    if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
        return [point]
    out = []
    for piece in char if char in APOSTROPHES + HYPHENS else unicodedata.normalize("NFKD", char):
        piece = "'" if piece in APOSTROPHES else "-" if piece in HYPHENS else LOOK_ALIKES.get(piece, piece)
        out += [ord(x) for x in (unicodedata.normalize("NFKD", piece.lower()) if piece != "İ" else "i")]
    return out


@functools.cache
def _tables():
    """Offsets and values of all forms; combining classes; pairs that compose; word characters."""
    n = sys.maxunicode + 1
    size = np.ones(n, np.int8)
    single = np.arange(n, dtype=np.uint32)
    start = np.zeros(n, np.int32)
    values: list[int] = []
    order = np.zeros(n, np.uint8)
    word = np.zeros(n, np.uint8)
    pairs = {}
    for point in range(n):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co", "Lo") and not unicodedata.decomposition(char) and point not in UNSEEN:
            word[point] = 2 * (kind == "Lo")
            continue
        form = _form(point)
        size[point], start[point] = len(form), len(values)
        values += form
        if len(form) == 1:
            single[point] = form[0]
        order[point] = unicodedata.combining(char)
        word[point] = 0 if kind[0] not in "LMN" else 3 if kind[0] == "M" else 1 if kind[0] == "N" or unicodedata.name(char, "").startswith("LATIN") else 2
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", char) == char:
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = point
    keys = np.array(sorted(pairs), np.int64)
    second = np.zeros(n, bool)
    second[keys & 0x1FFFFF] = True
    return size, single, start, np.array(values, np.uint32), order, word, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), second


def normal_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one form of texts given as code points, its offsets, and of each of its points the place it came from."""
    size, single, start, values, order, _, keys, composed, second = _tables()
    sizes = size[points]
    if (sizes == 1).all():
        out, source = single[points], np.arange(len(points))
    else:
        source = np.repeat(np.arange(len(points)), sizes)
        out = single[points[source]]
        many = sizes > 1
        ends = np.cumsum(sizes, dtype=np.int64)
        out[ragged((ends - sizes)[many], sizes[many].astype(np.int64))] = values[ragged(start[points[many]].astype(np.int64), sizes[many].astype(np.int64))]
    row_start = np.zeros(len(out) + 1, bool)
    at = np.searchsorted(source, offsets)
    row_start[at] = True
    marks = order[out]
    both = np.flatnonzero((marks[1:] > 0) & (marks[:-1] > marks[1:])) if len(out) else ()
    if len(both):
        # only stretches of marks out of order are sorted
        group = np.cumsum((marks == 0) | row_start[:-1])
        inside = np.flatnonzero(np.isin(group, group[both]) & (marks > 0))
        out[inside] = out[inside[np.lexsort((marks[inside], group[inside]))]]
    # a letter takes up the mark after it, again and again
    while True:
        next_ = np.flatnonzero(second[out] & ~row_start[:-1])
        next_ = next_[next_ > 0]
        if not len(next_):
            break
        pair = out[next_ - 1].astype(np.int64) << 21 | out[next_]
        found = np.searchsorted(keys, pair)
        hit = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == pair)
        if not hit.any():
            break
        # of neighbouring hits only the first composes in this pass
        gone = next_[hit]
        first = np.concatenate(([True], np.diff(gone) > 1))
        gone, into = gone[first], composed[found[hit][first]]
        out[gone - 1] = into
        keep = np.ones(len(out), bool)
        keep[gone] = False
        row_start = np.append(row_start[:-1][keep], True)
        out, source = out[keep], source[keep]
    # runs of spaces become one
    space = out == 32
    twice = np.zeros(len(out), bool)
    twice[1:] = space[1:] & space[:-1] & ~row_start[1:-1]
    if twice.any():
        out, source = out[~twice], source[~twice]
    return out, np.searchsorted(source, offsets), source


def one_form(text: Column) -> Column:
    """The one form of a text column (null stays null)."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        out, offsets, _ = normal_points(*code_points(texts))
        made = strings(out, offsets)
        return pa.compute.if_else(plain(texts).is_valid(), made, pa.scalar(None, pa.string()))

    return run(text)


def _words(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of words; a word ends where the text or the script (Latin, other) does."""
    kind = _tables()[5][out].astype(np.int8)
    # a mark belongs to what it stands on
    marks = np.flatnonzero(kind == 3)
    for _ in range(8):
        if not len(marks):
            break
        kind[marks] = np.where(marks > 0, kind[marks - 1], 0)
        marks = marks[kind[marks] == 3]
    edge = np.ones(len(out) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    inside = kind[np.minimum(at[:-1], max(0, len(out) - 1))] > 0 if len(out) else np.zeros(0, bool)
    return at[:-1][inside], at[1:][inside]


def _name_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, offsets, _ = normal_points(*code_points(batch["term"]))
        starts, ends = _words(out, offsets)
        hashes = word_hashes(out, starts, ends)
        anchor = np.zeros(batch.num_rows, np.int64)
        has = np.zeros(batch.num_rows, bool)
        row = np.searchsorted(offsets, starts, side="right") - 1
        order = np.lexsort((-starts, ends - starts))  # the longest word is written last
        anchor[row[order]] = hashes[order].view(np.int64)
        has[row] = True
        columns = {name: batch[name] for name in batch.schema.names} | {"form": pa.compute.utf8_trim_whitespace(strings(out, offsets)), "anchor": pa.array(anchor, mask=~has)}
        yield pa.RecordBatch.from_pydict(columns)


def _places(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = table.value
        for batch in batches:
            points, from_ = code_points(batch["text"])
            out, offsets, source = normal_points(points, from_)
            starts, ends = _words(out, offsets)
            hashes = word_hashes(out, starts, ends)
            slot = hashes % np.uint64(BITS)
            hit = np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            row = np.searchsorted(offsets, starts[hit], side="right") - 1
            reach = np.int64(1) << lengths[(hashes[hit] % np.uint64(LENGTHS)).astype(np.int64)].astype(np.int64)
            low = np.maximum(offsets[row], starts[hit] - reach)
            high = np.minimum(offsets[row + 1], ends[hit] + reach)
            seen = strings(out[ragged(low, high - low)], np.concatenate(([0], np.cumsum(high - low))))
            # the same piece as it is written, with all that shows nothing around it
            raw_low = np.where(low > offsets[row], source[np.maximum(low, 1) - 1] + 1, from_[row])
            raw_high = np.where(high < offsets[row + 1], source[np.minimum(high, len(source) - 1)], from_[row + 1])
            written = strings(points[ragged(raw_low, raw_high - raw_low)], np.concatenate(([0], np.cumsum(raw_high - raw_low))))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch["chunk_id"].take(take), batch["book_id"].take(take), pa.array(hashes[hit].view(np.int64)), seen, written], names=["chunk_id", "book_id", "anchor", "seen", "written"]
            )

    return run


def names_of_cases(cases: DataFrame) -> DataFrame:
    """case_id, term_no, book_id, term, form (its one form) and anchor (hash of its longest word), once each."""
    each = cases.select(F.col("id").cast("string").alias("case_id"), F.col("book_id").cast("string").alias("book_id"), F.posexplode("any_of").alias("term_no", "term"))
    each = each.where("case_id is not null and term is not null").distinct()
    schema = "case_id string, book_id string, term_no int, term string, form string, anchor bigint"
    return each.mapInArrow(_name_anchors, schema).where("anchor is not null")


def _salted(places: DataFrame, names: DataFrame, salt_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``; names of a word with many places are there once for each of its salts."""
    slot = F.pmod("anchor", F.lit(LENGTHS)).cast("int")
    sizes = places.groupBy(slot.alias("slot")).agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts"))
    # LENGTHS rows at most, 8 MB, whatever the tables hold; most slots have one salt and need no row
    many = F.broadcast(materialise(sizes.where("salts > 1"), "salts"))
    sized = lambda side: side.withColumn("slot", slot).join(many, "slot", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.pmod(F.xxhash64("chunk_id", "seen"), F.col("salts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    return sized(places).withColumn("salt", salt).drop("slot", "salts"), sized(names).withColumn("salt", every).drop("slot", "salts")


def read_but_not_written(cases: DataFrame, chunks: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``case_id``, ``term_no``, ``chunk_id``: names that can be read in a text but aren't written in it so."""
    spark = cases.sparkSession
    names = materialise(names_of_cases(cases), "names")
    slot = F.pmod(F.col("anchor"), F.lit(BITS))
    # 2**64 is a multiple of BITS, so signed and unsigned hashes have the same slot
    filled = names.select((slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int")).alias("bit")).distinct()
    words = filled.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITS / 64 rows at most
    bits = np.zeros(BITS // 64, np.uint64)
    bits[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    reach = F.max(F.ceil(F.log2(F.greatest(F.length("form"), F.lit(1))))).cast("int")
    long = names.groupBy(F.pmod("anchor", F.lit(LENGTHS)).cast("int").alias("slot")).agg(reach.alias("power")).toArrow()  # LENGTHS rows at most
    lengths = np.zeros(LENGTHS, np.uint8)
    lengths[np.asarray(long["slot"])] = np.asarray(long["power"])
    rows = chunks.select(F.col("id").cast("string").alias("chunk_id"), F.col("book_id").cast("string").alias("book_id"), F.col("text").cast("string").alias("text")).where("chunk_id is not null and text is not null")
    places = materialise(
        rows.mapInArrow(_places(spark.sparkContext.broadcast((bits, lengths))), "chunk_id string, book_id string, anchor bigint, seen string, written string"), "places"
    )
    places, names = _salted(places, names, salt_rows)
    in_book = places.join(names.where("book_id is not null"), ["anchor", "salt", "book_id"])
    anywhere = places.drop("book_id").join(names.where("book_id is null").drop("book_id"), ["anchor", "salt"])
    columns = ["case_id", "term_no", "chunk_id", F.contains("seen", "form").alias("read"), F.contains(F.lower("written"), F.lower("term")).alias("literal")]
    met = in_book.select(columns).unionByName(anywhere.select(columns))
    found = met.groupBy("case_id", "term_no", "chunk_id").agg(F.max("read").alias("read"), F.max("literal").alias("literal"))
    return found.where("read and not literal").select("case_id", "term_no", "chunk_id")
