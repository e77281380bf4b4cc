"""Column functions on text: white space, normal forms, tokens, sentences, citations.

Every function maps null to null unless it says otherwise, and stays inside the
JVM's regular expressions and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: White space as browsers and scripts know it, wider than the JVM's own class.
SPACE = r"[\s   -     　﻿]"
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her hers him his i if in is it its me my "
    "of on or our she that the their them they this to was we were what when which who will with you your"
).split()
REUSE_STOP_WORDS = (
    "a am an and are as at be been but by did do does for from had has have he her hers him his i if in is it its me my no not "
    "of on or our she so that the their them then they this to was we were what when which who will with would you your"
).split()
ABBREVIATIONS = "Mr Mrs Ms Dr St Jr Sr Prof Rev Hon Capt Col Gen Lt Sgt Esq vs etc No i.e e.g".split()
CITATION = r"\[([a-z_]+:\d+:\d+)\]"

_END = r"(?<=[.!?][”’\"')\]]{0,3})"
_ABBREVIATION = r"(?i)(?<=(?:^|[\s (\"'“‘\[])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.)"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def squash(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trimmed(F.regexp_replace(text, rf"{SPACE}+", " "))


def straight(text: Column) -> Column:
    """Curly single quotes as straight ones."""
    return F.translate(text, "‘’", "''")


def title_words(text: Column) -> Column:
    """Small letters and digits, every run of anything else one space (for titles and notes)."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def quote_words(text: Column) -> Column:
    """As ``title_words``, for quotations: what is neither a small letter, a digit nor a space becomes a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +", " "))


def reuse_words(text: Column) -> Column:
    """Small letters, digits and apostrophes, for shingles."""
    return squash(F.regexp_replace(straight(F.lower(text)), rf"[^a-z0-9'\s   -     　﻿]", " "))


def plain_lower(text: Column) -> Column:
    """Small letters with straight apostrophes, for looking up expected terms."""
    return straight(F.lower(text))


def flat(text: Column) -> Column:
    """Straight quotes of both kinds and squashed space; case kept."""
    return squash(F.translate(text, "‘’“”", "''\"\""))


def tokens(text: Column) -> Column:
    """The terms of the lexical index in order: two characters or more, no stop words."""
    # one pass of the pattern leaves out what isn't a term; a lambda over all words would cost several times as much
    stop = "|".join(STOP_WORDS)
    return F.regexp_extract_all(straight(F.lower(text)), F.lit(rf"(?<![a-z0-9'])(?!(?:{stop})(?![a-z0-9']))[a-z0-9']{{2,}}"), F.lit(0))


def count_words(text: Column) -> Column:
    """Words by white space; 0 for blank texts and null."""
    bare = trimmed(text)
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, rf"{SPACE}+")))


def split_sentences(text: Column) -> Column:
    """Sentences by terminator and white space, not after an abbreviation (whatever its case)."""
    kept = F.regexp_replace(text, rf"{_ABBREVIATION}{SPACE}+", "\u0002")
    cut = F.regexp_replace(kept, rf"{_END}{SPACE}+", "\u0001")
    return F.split(F.translate(cut, "\u0002", " "), "\u0001")


def fix_heading(title: Column) -> Column:
    """A space between a chapter word and the numeral that sticks to it."""
    word = r"(?<![A-Za-z0-9_])(CHAPTER|Chapter|SECTION|Section)(?=[A-Z0-9])"
    return squash(F.regexp_replace(squash(title), word, "$1 "))


def has_numeral(title: Column) -> Column:
    """Does a title hold a Roman or Arabic number as a word, in any case?"""
    return title.rlike(r"(?i)(?<![A-Za-z0-9_])([IVXLC]+|\d+)(?![A-Za-z0-9_])")


def citations(text: Column) -> Column:
    """Passage ids in square brackets, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def quoted_spans(text: Column, least: int = 8, most: int = 400) -> Column:
    """What stands in curly double quotes, then what stands in straight ones with no space inside the ends."""
    curly = F.regexp_extract_all(text, F.lit(rf"“([^”]{{{least},{most}}})”"), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit(rf'"([^"\s][^"]{{{least - 2},{most - 2}}}[^"\s])"'), F.lit(1))
    return F.concat(curly, plain)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-16 units (as a bigint); a sign beyond the BMP counts as its two surrogates."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    surrogates = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))
    units = F.flatten(F.transform(codes, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(surrogates(c))))
    step = lambda h, u: ((h.bitwiseXOR(u)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), step)


def count_matches(text: Column, term: Column) -> Column:
    """How often a term stands in a text in any case, as whole words where it is made of word characters."""
    escaped = F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    wordlike = term.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_' -]*$")
    pattern = F.when(wordlike, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), escaped, F.lit("(?![A-Za-z0-9_])"))).otherwise(F.concat(F.lit("(?i)"), escaped))
    return F.regexp_count(text, pattern)


def tidy_title(title: Column) -> Column:
    """A chapter title for a list: no capitals in the word for chapter, no full stop at the end."""
    calm = F.regexp_replace(title, r"(?<![A-Za-z0-9_])CHAPTER(?![A-Za-z0-9_])", "Chapter")
    return trimmed(F.regexp_replace(calm, rf"{SPACE}*\.{SPACE}*\z", ""))


def chapter_ref(title: Column) -> Column:
    """The first number in a title, in capitals; without one, the title's first ten characters after the word for chapter."""
    number = F.regexp_extract(title, r"(?i)(?<![A-Za-z0-9_])([IVXLC]+|\d+)(?![A-Za-z0-9_])", 1)
    rest = F.substring(F.regexp_replace(title, rf"(?i)^chapter{SPACE}*", ""), 1, 10)
    return F.when(number != "", F.upper(number)).otherwise(rest)


def without_ref(title: Column) -> Column:
    """A title without the number it begins with; empty where there is nothing else."""
    return trimmed(F.regexp_replace(title, rf"(?i)^{SPACE}*(?:chapter{SPACE}+)?[IVXLC\d]+[.:]?{SPACE}*", ""))


def first_clause(note: Column, most: int = 58) -> Column:
    """A note's first ``most`` characters, cut before the last word begun, and an ellipsis; a null note is empty."""
    clean = F.coalesce(squash(note), F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, most), r"[\s,;:.]+\S*\z", ""), F.lit("…"))
    return F.when(F.length(clean) > most, cut).otherwise(clean)


def embed_text(book_title: Column, chapter_title: Column, text: Column) -> Column:
    """What is embedded for a passage where its place is to count: book and chapter title before its text; a null title is empty."""
    return F.concat(F.coalesce(book_title, F.lit("")), F.lit(", "), F.coalesce(chapter_title, F.lit("")), F.lit("\n\n"), text)


def error_kind(message: Column) -> Column:
    """``rate_limited``, ``filtered`` or ``failed``: what a provider's error message says."""
    said = lambda pattern: message.rlike("(?i)" + pattern)
    return F.when(said(r"\b429\b|rate limit"), "rate_limited").when(said("content management policy|content_filter"), "filtered").otherwise("failed")


def echoed_spans(answer: Column, passage: Column, least: int = 12) -> Column:
    """What an answer quotes in curly quotes and a passage holds, once each, in order; quotes and white space compare alike."""
    spans = F.transform(F.regexp_extract_all(answer, F.lit(rf"“([^”]{{{least},}})”"), F.lit(1)), trimmed)
    return F.array_distinct(F.filter(spans, lambda s: F.contains(flat(passage), flat(s))))
