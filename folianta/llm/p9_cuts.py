"""Problem 9: texts that stop before their writer did.

Method: a structural completeness check. The pushdown automaton of
``structure`` reads the whole text and leaves on its stack what is still open
(fences, markup, brackets, quotations, emphasis); the end of the text is then
checked for broken multibyte sequences and escapes, for an ellipsis a field
limit left, for abbreviations that want a name, and for a missing terminator.
Verse, signatures, closing lines and references end without one. What a missing
terminator means otherwise depends on baselines counted over all documents: in a
source whose paragraphs hardly ever have one (``USUAL_SHARE``) it means nothing
unless the text stands at one of the source's field limits (lengths at which its
texts pile up), and in a script that has no terminators the last phrase decides,
by how often phrases of the corpus end so, or a field limit.

Each text is read once; the few small columns that come out are written to the
shared folder, and all baselines are counted on those.

Null, empty and blank texts are not cut. Exact copies of a row count once; rows
with a null id come out once as null if any is cut; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .structure import incomplete, left_open

# Fixed values of the grammar.
TERMINATORS = ".!?…。！？।॥؟።"
CLOSERS = "\"'”’»›)]}」』）】〉》“*_"
ABBREVIATIONS = "Mr Mrs Ms Dr St Capt Col Lt Hon Rev Prof Gen Sgt Messrs Mme Mlle Hr Fr Bd Nr vol Vol pp p No e.g i.e cf Sr Sra pág Г стр".split()
CLOSING_LINES = {"the end", "end", "finis", "fin", "ende", "fine", "конец", "完", "终", "終", "終わり", "おわり", "จบ", "समाप्त", "to be continued"}
#: Scripts whose sentences end with a space, not with a sign: Thai, Lao, Burmese, Khmer.
UNSIGNED = r"[฀-໿က-႟ក-៿]"

#: A source whose paragraphs end with a terminator less often than this has none by habit.
USUAL_SHARE = 0.2
#: So many paragraphs of the whole corpus are added to each source's own, so that a few rows prove no habit.
PRIOR_PARAGRAPHS = 5
#: A pile: at least so many texts of a source share a length, so many times what the lengths around it have.
PILE_ROWS, PILE_TIMES, PILE_AROUND = 5, 5, 32
#: Texts of a fixed form have one length without being cut: no pile holds more of a source than this.
PILE_SHARE = 0.5

#: What shows nothing: white space, control and zero-width characters.
BLANK = "".join(chr(c) for c in range(0x10000) if chr(c).isspace() or c < 0x20 or 0x200B <= c <= 0x200F) + "\u2060\ufeff\u00ad\u3164\u2800"
_LAST_WORD = re.compile(r"[^\s(\[\"“‘«„]*\Z")
_BROKEN = re.compile(r"(?:\ufffd|&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)\Z")
_OPEN_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*)?\Z")
_OPEN_LINK = re.compile(r"\]\([^)\s]*\Z")
_ELLIPSIS = re.compile(r"(?:\.\.+|…)\Z")
_ABBREVIATION = re.compile(r"(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")\.\Z")
_INITIAL = re.compile(r"(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")\. [^\W\d_]\.\Z")
_REFERENCE = re.compile(r"\[[\w .-]+(?::\d+)+(?:-\d+)?\]\Z")
_SIGNATURE = re.compile(r"(?:[—–―-]+\s*[^\W\d_][^.!?,;:]{1,60}|(?:[^\W\d_]\.\s*){1,3}[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)?)\Z")
_PLACE_AND_YEAR = re.compile(r"[^\W\d_][^.!?;:]{1,60},[^.!?;:]{0,20}\b\d{4}\Z")
_NEXT = re.compile(r"[^\W\d_]{3,20}: [^.!?]{1,70}\Z")
_RULE = re.compile(r"[\W_]+\Z")
_INNER_END = re.compile("[" + re.escape(TERMINATORS) + r"][\"'”’»)\]]*(?:\s|\Z)")
_UNSIGNED = re.compile(UNSIGNED)


def _without_signs(text: str) -> str:
    """``text`` without white space, emoji and the like at its end."""
    end = len(text)
    while end and (text[end - 1] in BLANK or unicodedata.category(text[end - 1]) in ("So", "Sk", "Sm", "Cf", "Cs", "Co") or "\ufe00" <= text[end - 1] <= "\ufe0f"):
        end -= 1
    return text[:end]


def _closes_text(lines: list[str]) -> bool:
    """Is the last line a signature, date, closing or rule below a text, or a line of verse?"""
    last = lines[-1].strip()
    if _RULE.match(last) and len(last) <= 30 and not re.search(r"[\"“„«「(\[]", last):
        return True
    if last.casefold().strip(" *_—–-~") in CLOSING_LINES:
        return True
    if len(lines) > 1 and (_SIGNATURE.match(last) or _PLACE_AND_YEAR.match(last) or (_NEXT.match(last) and len(last.split()) <= 9)):
        return True
    block = [x.strip() for x in lines if x.strip()][-4:]
    return len(block) >= 3 and all(len(x) <= 90 and not _INNER_END.search(x) for x in block[:-1][-3:]) and len(last) <= 90


def _last_script(text: str) -> bool:
    """True if the last letter of a text is of a script without terminators."""
    for char in reversed(text):
        if _UNSIGNED.match(char):
            return True
        if char.isalpha():
            return False
    return False


def ending(text: str | None, open_: list[tuple[str, str]] | None = None) -> str:
    """How a text ends; ``open_`` is what the automaton left, if it has been run already.

    ``blank``, ``complete``, ``closing`` (verse, signature, reference and the
    like), ``unsigned`` (a script without terminators), ``bare`` (no terminator),
    or a kind of cut: ``broken``, ``ellipsis``, ``abbreviation`` or ``open``.
    """
    text = (text or "").rstrip(BLANK)
    if not text:
        return "blank"
    tag, link = text.rfind("<"), text.rfind("](")
    if _BROKEN.search(text, max(0, len(text) - 12)) or (tag >= 0 and _OPEN_TAG.match(text, tag)) or (link >= 0 and _OPEN_LINK.match(text, link)):
        return "broken"
    bare = _without_signs(text)
    if not bare:
        return "closing"
    if _ELLIPSIS.search(bare, len(bare) - 2 if len(bare) > 1 else 0):
        return "ellipsis"
    body = bare.rstrip(CLOSERS + " \u00a0\u202f")
    signed = bool(body) and body[-1] in TERMINATORS
    if signed and body == bare:
        last = _LAST_WORD.search(body, body.rfind(" ") + 1).group()
        if _ABBREVIATION.fullmatch(last) or _INITIAL.search(body, max(0, len(body) - 16)):
            return "abbreviation"
    if incomplete(left_open(text) if open_ is None else open_):
        return "open"
    if signed:
        return "complete"
    if _REFERENCE.search(bare, max(0, bare.rfind("["))):
        return "closing"
    if body and _last_script(bare):
        return "unsigned"
    if _closes_text(bare.split("\n")):
        return "closing"
    if bare[-1] in ")]」』）】»" and bare != body:
        return "complete"
    return "bare"


def _paragraph_ends(text: str) -> tuple[int, int]:
    """How many lines of a text say something, and how many of them end with a terminator."""
    ends = [line.rstrip(CLOSERS + " \t\r\u00a0\u202f")[-1:] for line in text.split("\n")]
    return sum(bool(end) for end in ends), sum(bool(end) and end in TERMINATORS for end in ends)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, gram, lines, signed = [], [], [], []
        for text in batch["text"].to_pylist():
            how = ending(text)
            ends.append(how)
            gram.append(text.rstrip(BLANK)[-4:] if how == "unsigned" else None)
            said, closed = _paragraph_ends(text or "") if how in ("complete", "bare") else (0, 0)
            lines.append(said), signed.append(closed)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["source"], batch["n"], pa.array(ends, pa.string()), pa.array(gram, pa.string()), pa.array(lines, pa.int32()), pa.array(signed, pa.int32())],
            names=["doc_id", "source", "n", "ending", "gram", "lines", "signed"],
        )


def _phrase_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-character strings of unsigned scripts: how often each stands at all, how often before a space."""
    for batch in batches:
        every: Counter[str] = Counter()
        final: Counter[str] = Counter()
        for text in batch["text"].to_pylist():
            words = text.split()
            for word in words:
                every.update(word[i : i + 4] for i in range(len(word) - 3))
            final.update(word[-4:] for word in words[:-1])
        grams = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([every[g] for g in grams], pa.int64()), pa.array([final[g] for g in grams], pa.int64())], names=["gram", "stands", "ends"])


def field_limits(lengths: DataFrame, least_rows: int = PILE_ROWS, times: float = PILE_TIMES, around: int = PILE_AROUND) -> DataFrame:
    """``source`` and ``n``: every length at which a source's texts pile up.

    ``lengths`` has source and n, a row for each text. A pile has at least
    ``least_rows`` texts, and ``times`` as many as a length within ``around`` of
    it has on average, and as each of the two lengths on either side of it has.
    The windows hold one row for each length of a source, not for each text.
    """
    counted = lengths.where("n > 0").groupBy("source", "n").agg(F.count(F.lit(1)).alias("rows"))
    by_length = Window.partitionBy("source").orderBy("n")
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = (F.sum("rows").over(by_length.rangeBetween(-around, around)) - F.col("rows")) / (2 * around)
    sides = F.greatest(zero(F.max("rows").over(by_length.rangeBetween(-2, -1))), zero(F.max("rows").over(by_length.rangeBetween(1, 2))))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("source"))
    told = counted.withColumn("usual", F.greatest(mean, sides)).withColumn("share", share)
    return told.where((F.col("rows") >= least_rows) & (F.col("rows") > times * F.col("usual")) & (F.col("share") <= PILE_SHARE)).select("source", "n")


def habits(endings: DataFrame, usual_share: float = USUAL_SHARE, prior: int = PRIOR_PARAGRAPHS) -> DataFrame:
    """``source`` of those whose paragraphs hardly ever end with a terminator."""
    by_source = endings.groupBy("source").agg(F.sum("lines").alias("lines"), F.sum("signed").alias("signed"))
    whole = endings.agg(F.sum("signed") / F.greatest(F.sum("lines"), F.lit(1))).head()[0] or 0.0  # one number
    return by_source.where((F.col("signed") + prior * whole) / (F.col("lines") + prior) < usual_share).select("source")


def judge(documents: DataFrame, least_share: float = 0.02) -> DataFrame:
    """doc_id, source and ``cut`` (why a text is cut, else null), a row for each row of ``documents``."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    read = rows.select("doc_id", "source", F.length("text").alias("n"), "text").mapInArrow(_read, "doc_id bigint, source string, n int, ending string, gram string, lines int, signed int")
    ended = materialise(read, "endings")
    unsigned = rows.where(F.col("text").rlike(UNSIGNED)).select("text")
    grams = unsigned.mapInArrow(_phrase_ends, "gram string, stands bigint, ends bigint").groupBy("gram").agg(F.sum("stands").alias("stands"), F.sum("ends").alias("ends"))
    usual = grams.where((F.col("ends") > 1) & (F.col("ends") >= least_share * F.col("stands"))).select("gram", F.lit(True).alias("usual"))
    # only texts that want a baseline meet one; the rest of the corpus stays where it is
    sure = ended.where("ending not in ('unsigned', 'bare')").select("doc_id", "source", F.when(F.col("ending").isin("broken", "ellipsis", "abbreviation", "open"), F.col("ending")).alias("cut"))
    limits = field_limits(ended.select("source", "n")).withColumn("at_limit", F.lit(True))
    habit = habits(ended).withColumn("habit", F.lit(True))
    bare = ended.where("ending = 'bare'").join(habit, "source", "left").join(limits, ["source", "n"], "left")
    bare = bare.select("doc_id", "source", F.when(F.col("habit").isNull(), "unfinished").when(F.col("at_limit"), "field_limit").alias("cut"))
    special = ended.where("ending = 'unsigned'").join(usual, "gram", "left").join(limits, ["source", "n"], "left")
    special = special.select("doc_id", "source", F.when(F.col("at_limit"), "field_limit").when(F.col("usual").isNull(), "unfinished").alias("cut"))
    return sure.unionByName(bare).unionByName(special)


def cut_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document whose text is cut off."""
    return judge(documents).where("cut is not null").select("doc_id").distinct()


def cut_rates(documents: DataFrame) -> DataFrame:
    """``source``, its ``documents`` (blank ones too), how many are ``cut`` and the ``rate``."""
    each = judge(documents).groupBy("source", "doc_id").agg(F.max("cut").alias("cut"))
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("cut").alias("cut"), F.round(F.count("cut") / F.count(F.lit(1)), 6).alias("rate"))
