"""Problem 3: sentence boundaries across languages and scripts.

Method: every terminator is a candidate boundary, and a maximum-entropy model
decides each one from the neighbouring tokens, their case, length, digits and
script. The model is trained on boundaries that are reliable without it: the
end of a paragraph is one, and so is a bare exclamation or question mark (or a
full stop of a script that has it for nothing else) before no small letter; a
terminator before a small letter is none; and a token (``Dr.``, ``20.``, ``?”`` before its speaker) that is often followed by
more text, yet hardly ever ends a paragraph of the whole corpus, ends no sentence.

Counts of tokens are taken over all texts. Only the fit uses a sample: labelled
candidates of about ``SAMPLE_TEXTS`` texts chosen by a hash of their ids, and of
those about ``SAMPLE_ROWS`` chosen by a hash if there are more.

A blank line always ends a sentence and a single line break is a space. Thai has
no terminators: a space beside a Thai letter is a boundary. Null and blank texts
have no sentences; exact copies of a row count once; rows without an id take no
part.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .arrow import lists

SAMPLE_TEXTS = 4000
#: The most labelled candidates that come to the driver for the fit (about 30 MB).
SAMPLE_ROWS = 400_000
#: A type ends nothing if it has gone on so often, has ended a paragraph in no more than this share of its
#: cases, and makes up this share of all candidates at least: so there are at most 1 / LEAST_SHARE such types,
#: a broadcast of a few MB, whatever the corpus.
LEAST_SEEN, MOST_ENDS, LEAST_SHARE = 24, 0.005, 5e-6
WEIGHTS = 1 << 16

# Fixed values of the candidate grammar.
TERMINATORS = ".!?…。！？．।॥"
OPENERS = "\"'“‘«„「『（([¿¡—–-*_"
_CANDIDATE = re.compile(rf"[{re.escape(TERMINATORS)}]+(?:[   ]?[»]|[\"'”’“)\]」』）】](?=[\s\"'”’»)\]」』）】.,;:!?]|\Z)|[\"'”’“»)\]」』）】](?<![\"'“])|[*_](?=\s))*")
_BLANK_LINE = re.compile(r"\s*\n[^\S\n]*\n\s*")
_SPACE = re.compile(r"\s*")
_THAI_SPACE = re.compile(r"(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
#: The word a text ends with: what follows its last sign that is no letter, digit or mark (found from the end).
_WORD_BEFORE = re.compile(r"(?:.*(?![\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0962\u0963])[\W_])?(.*)\Z", re.S)
_WORD_AFTER = re.compile(r"[^\W_]{1,12}")
_WIDE = set("。！？．।॥…")
#: Signs that end a sentence wherever they stand bare before no small letter.
_SURE = set("!?。！？।॥")

_classes: dict[str, str] = {}


def _class(char: str) -> str:
    """U and L for cased letters, D for digits, else a letter for the script or kind."""
    found = _classes.get(char)
    if found is None:
        kind = unicodedata.category(char)
        if kind in ("Lu", "Lt"):
            found = "U"
        elif kind == "Ll":
            found = "L"
        elif kind[0] == "N":
            found = "D"
        elif kind[0] in "LM":
            name = unicodedata.name(char, "?")
            found = "K" if name.startswith(("HIRAGANA", "KATAKANA")) else "C" if name.startswith("CJK") else "V" if name.startswith("DEVANAGARI") else "T" if name.startswith("THAI") else "S"
        else:
            found = "O" if char in OPENERS else "X"
        _classes[char] = found
    return found


def candidates(text: str) -> Iterator[tuple[int, bool, tuple]]:
    """Each candidate: where the next sentence would begin, whether a paragraph ends here, and its context.

    The context is (word before, terminator, closers, gap, class of what comes next, word after).
    """
    size = len(text)
    for found in _CANDIDATE.finditer(text):
        end = found.end()
        sign = found.group()
        after = _SPACE.match(text, end).end()
        gap = "" if after == end else "\n" if text.find("\n", end, after) >= 0 else " "
        stop = after == size or (gap == "\n" and text.count("\n", end, after) > 1 and _BLANK_LINE.fullmatch(text, end, after) is not None)
        bare = sign.rstrip("\"'”’“»)]」』）】*_   ")
        if not gap and after < size and bare[-1] not in _WIDE:
            # a space may be missing, but not inside a number, an abbreviation or an address
            before = _WORD_BEFORE.match(text, max(0, end - len(sign) - 24), end - len(sign)).group(1)
            if len(before) < 2 or not before[-1].islower() or _class(text[after]) not in "UO":
                continue
        here = after
        opener = ""
        while here < size and (text[here] in OPENERS or (opener and text[here] in "   ")):
            opener = "O"
            here += 1
        next_ = opener + (_class(text[here]) if here < size else "E")
        if next_ == "X" and not stop:
            continue
        word = _WORD_BEFORE.match(text, max(0, end - len(sign) - 24), end - len(sign)).group(1)[-12:]
        if word.isdigit():
            word = "#" * min(4, len(word))
        ahead = _WORD_AFTER.match(text, here)
        follows = ahead.group().lower() if ahead and next_[-1] in "UL" else ahead.group()[:2] if ahead else ""
        term = "…" if "…" in bare or ".." in bare else bare[-1]
        yield after, stop, (word, term, sign[len(bare) :].strip(), gap, next_, follows)


def types(context: tuple) -> tuple[str, ...]:
    """The token types of a context that may turn out to end nothing."""
    word, term, closers, _, next_, _ = context
    script = next_[-1] if next_[-1] in "CKVT" else "A"
    if term == "." and not closers:
        return (f"w {word}",)
    # an exclamation within a quotation ends no paragraph but may well end a sentence
    return (f"t {term}{closers} {script}",) if closers or term == "…" else ()


def features(context: tuple, ends_nothing) -> list[int]:
    """The active features of a context, as places in the weight vector."""
    word, term, closers, gap, next_, follows = context
    shape = ("#" if word.startswith("#") else ("U" if word[:1].isupper() else "l") + ("1" if len(word) == 1 else "s" if len(word) < 4 else "m")) if word else "-"
    script = next_[-1] if next_[-1] in "CKVT" else "A"
    flagged = any(x in ends_nothing for x in types(context))
    named = [
        "b", f"t{term}", f"c{closers}", f"n{next_}", f"tc{term}{closers}", f"tn{term}{next_}", f"cn{closers}{next_}", f"tcn{term}{closers}{next_}", f"gn{gap}{next_}",
        f"s{shape}", f"sn{shape}{next_}", f"st{shape}{term}{closers}", f"ts{term}{closers}{script}", f"f{follows}", f"x{flagged}", f"xn{flagged}{next_}",
    ]
    if term == "." and not closers:
        named += [f"w{word}", f"wn{word}{next_}"]
    return [zlib.crc32(x.encode()) % WEIGHTS for x in named]


def _count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        goes_on: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for text in batch["text"].to_pylist():
            for _, stop, context in candidates(text or ""):
                if stop:
                    ends.update(types(context))
                    # the end of a text has no script after it: count it for all
                    if context[4] == "E" and (context[1] != "." or context[2]):
                        ends.update(f"t {context[1]}{context[2]} {s}" for s in "CKVT")
                elif context[4][-1] != "L":
                    goes_on.update(types(context))
        names = list(goes_on.keys() | ends.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([goes_on[n] for n in names], pa.int64()), pa.array([ends[n] for n in names], pa.int64())], names=["type", "goes_on", "ends"])


def types_that_end_nothing(texts: DataFrame, least_seen: int = LEAST_SEEN, most_ends: float = MOST_ENDS, least_share: float = LEAST_SHARE) -> frozenset[str]:
    """Token types that go on often and hardly ever end a paragraph; at most 1 / ``least_share`` of them."""
    counted = texts.select("text").mapInArrow(_count_types, "type string, goes_on bigint, ends bigint").groupBy("type").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    table = materialise(counted, "types")
    every = table.agg(F.sum("goes_on")).head()[0] or 0
    kept = table.where((F.col("goes_on") >= max(least_seen, least_share * every)) & (F.col("ends") <= most_ends * F.col("goes_on")))
    return frozenset(kept.select("type").toArrow()["type"].to_pylist())


def _labelled(ends_nothing: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, active = [], []
            for text in batch["text"].to_pylist():
                for at, stop, context in candidates(text or ""):
                    if stop and at < len(text):
                        label.append(1.0)
                    elif not stop and (context[4][-1] == "L" or any(x in ends_nothing for x in types(context))):
                        label.append(0.0)
                    elif not stop and context[1] in _SURE and not context[2]:
                        label.append(1.0)
                    else:
                        continue
                    active.append(features(context[:3] + (" " if stop and context[1] not in _WIDE else "" if stop else context[3],) + context[4:], ends_nothing))
            ends = np.concatenate(([0], np.cumsum([len(a) for a in active], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.float32()), lists(np.array([i for a in active for i in a], np.int32), ends, pa.int32())], names=["label", "active"])

    return run


def fit(labels: np.ndarray, active: list[np.ndarray], passes: int = 60, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a maximum-entropy model with two outcomes, by gradient ascent with a step for each weight."""
    weights, speed = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    if not len(labels):
        return weights
    flat = np.concatenate(active)
    row = np.repeat(np.arange(len(labels)), [len(a) for a in active])
    for _ in range(passes):
        chance = 1 / (1 + np.exp(-np.bincount(row, weights[flat], len(labels))))
        slope = np.bincount(flat, (labels - chance)[row], WEIGHTS) / len(labels) - penalty * weights
        speed += slope * slope
        weights += 0.5 * slope / np.sqrt(speed)
    return weights


def train(texts: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, frozenset[str]]:
    """The model for ``texts`` (id, text): weights, and the token types that end nothing."""
    ends_nothing = types_that_end_nothing(texts)
    share = sample_texts / max(1, texts.count())
    sample = texts if share >= 1 else texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    labelled = materialise(sample.select("text").mapInArrow(_labelled(ends_nothing), "label float, active array<int>"), "labelled")
    few = sample_rows / max(1, labelled.count())
    if few < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("active", F.monotonically_increasing_id()), F.lit(1_000_000)) < int(few * 1_000_000))
    rows = labelled.toArrow()
    active = rows["active"].to_pylist()
    return fit(np.asarray(rows["label"], np.float64), [np.array(a) for a in active]), ends_nothing


def starts(text: str, boundary) -> list[int]:
    """The first place of each sentence of a text; ``boundary`` decides a candidate's context."""
    body = text.rstrip()
    first = len(text) - len(text.lstrip())
    if first >= len(body):
        return []
    found = {first}
    found.update(m.end() for m in _BLANK_LINE.finditer(text) if first < m.end() < len(body))
    found.update(m.end() for m in _THAI_SPACE.finditer(text) if first < m.end() < len(body))
    for at, stop, context in candidates(text):
        if first < at < len(body) and (stop or boundary(context)):
            found.add(at)
    return sorted(found)


def _cut(weights: np.ndarray, ends_nothing: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: defaultdict = defaultdict()

        def boundary(context: tuple) -> bool:
            told = known.get(context)
            if told is None:
                told = known[context] = bool(weights[features(context, ends_nothing)].sum() > 0)
                if len(known) > 300_000:
                    known.clear()
            return told

        for batch in batches:
            made = [starts(text, boundary) if text else [] for text in batch["text"].to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(m) for m in made], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"], lists(np.array([i for m in made for i in m], np.int32), ends, pa.int32())], names=["id", "starts"])

    return run


def sentence_starts(texts: DataFrame, key: str = "id", text: str = "text", model: tuple | None = None) -> DataFrame:
    """``key`` (as string) and ``start_pos``: a row for the first character of each sentence of each text."""
    rows = texts.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    weights, ends_nothing = model or train(rows)
    found = rows.mapInArrow(_cut(weights, ends_nothing), "id string, starts array<int>").distinct()
    return found.select(F.col("id").alias(key), F.explode("starts").alias("start_pos"))


def sentences(texts: DataFrame, key: str = "id", text: str = "text", model: tuple | None = None) -> DataFrame:
    """``key``, ``sentence_no`` (from 0), ``start_pos`` and the ``sentence`` itself, without the space around it."""
    rows = texts.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    weights, ends_nothing = model or train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cut(weights, ends_nothing)
        for batch in batches:
            for part in cut(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], part["starts"]], names=["id", "text", "starts"])

    found = rows.mapInArrow(run, "id string, text string, starts array<int>").distinct()
    each = found.select("id", "text", "starts", F.posexplode("starts").alias("sentence_no", "start_pos"))
    next_ = F.coalesce(F.try_element_at("starts", F.col("sentence_no") + 2), F.length("text"))
    piece = F.substring("text", F.col("start_pos") + 1, next_ - F.col("start_pos"))
    return each.select(F.col("id").alias(key), "sentence_no", "start_pos", F.regexp_replace(piece, r"^\s+|\s+\z", "").alias("sentence"))


def paragraph_texts(sections: DataFrame) -> DataFrame:
    """``id`` (book:chapter:paragraph) and ``text`` of every paragraph of every section."""
    each = sections.select("book_id", "chapter_index", F.posexplode("paragraphs").alias("n", "text"))
    return each.select(F.concat_ws(":", F.coalesce("book_id", F.lit("")), F.coalesce(F.col("chapter_index").cast("string"), F.lit("")), "n").alias("id"), "text").distinct()
