"""A pushdown automaton that reads a whole text and tells what is still open at its end.

Fences, list items, tags, emphasis, brackets and quotations lie on one stack.
One scan stops at the signs and line breaks only; whatever is read at a sign is
read once, and a sign that closes something forgets what lies above it, so the
work is linear in the text. Nothing is forgotten by its distance or depth.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from itertools import chain

#: Opening signs with what closes them; quotations among them; tags that need no end; words that begin with an apostrophe.
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】"}
QUOTES = {"「": "」", "『": "』", "«": "»", "“": "”", "„": "“”\"", "‘": "’", "‚": "‘’", '"': '"', "»": "«", "”": "”"}
ENDLESS = set("p li dt dd tr td th thead tbody tfoot option br hr img input meta link wbr col area".split())
QUOTATION = ("quote", "inner")
#: What ends a sentence (or citation), and what may stand between that and the next one's first word.
ENDS, BETWEEN = set(".!?…。！？।॥؟]"), set("\"'”’»)」』*_—–-¡¿([«“„‘‚「『>")
_ELIDED = re.compile(r"[‘’](?:tis|twas|twere|twill|twould|em|cause|til|bout|round|n|s|\d\ds?)\b", re.I)

_OPENED_BY = {close: open_ for open_, close in BRACKETS.items()}
_ENDED_BY = {sign: [open_ for open_, close in QUOTES.items() if sign in close] for close in QUOTES.values() for sign in close}
_SIGNS = re.compile("[" + re.escape("\n`<*_" + "".join(BRACKETS) + "".join(_OPENED_BY) + "".join(QUOTES) + "".join(_ENDED_BY)) + "]")
_RUN = re.compile(r"`+|\*+|_+")
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>")
ITEM = re.compile(r"[^\S\n]*(?:[-*•–+]|\(?\d{1,3}[.)]|\(?[a-z]\))[^\S\n]+(?=\S)")
_LINE = re.compile(rf"(?P<blank>[^\S\n]*(?=\n|\Z))|[^\S\n]*(?P<fence>`{{3,}}(?=[^`\n]*(?:\n|\Z))|~{{3,}})|(?P<item>{ITEM.pattern})|(?P<indent>[^\S\n])|")
_FACES = ":;="


class _Stack(list):
    """What is open, as (kind, sign), with counts so that nothing is searched for that isn't there."""

    def __init__(self):
        self.count: Counter[tuple[str, str]] = Counter()
        self.kinds: Counter[str] = Counter()
        self.quotes: list[tuple[str, str]] = []
        self.line(0)

    def line(self, at: int) -> None:
        """A line whose first sentence begins at ``at``."""
        self.read, self.fresh = at, True

    def begins(self, text: str, at: int) -> bool:
        """True if what stands at ``at`` begins a sentence. Looks back to the place last asked for at most."""
        i = at
        while i > self.read:
            sign = text[i - 1]
            if sign in ENDS:
                self.fresh = True
                break
            if not (sign.isspace() or sign in BETWEEN):
                self.fresh = False
                break
            i -= 1
        self.read = max(self.read, at)
        return self.fresh

    def open(self, kind: str, sign: str) -> None:
        self.append((kind, sign))
        self.count[kind, sign] += 1
        self.kinds[kind] += 1
        if kind in QUOTATION:
            self.quotes.append((kind, sign))

    def _take(self) -> tuple[str, str]:
        top = self.pop()
        self.count[top] -= 1
        self.kinds[top[0]] -= 1
        if top[0] in QUOTATION:
            self.quotes.pop()
        return top

    def close(self, kind: str, sign: str) -> bool:
        if not self.count[kind, sign]:
            return False
        while self._take() != (kind, sign):
            pass
        return True

    def drop(self, *kinds: str) -> None:
        """Forgets all of these kinds, wherever they lie."""
        kept = []
        while any(self.kinds[kind] for kind in kinds):
            top = self._take()
            if top[0] not in kinds:
                kept.append(top)
        for frame in reversed(kept):
            self.open(*frame)

    def end_quote(self, sign: str) -> bool:
        """Closes the innermost quotation that ``sign`` ends."""
        if any(self.count[kind, opened] for opened in _ENDED_BY.get(sign, ()) for kind in QUOTATION):
            return self.close(*next(x for x in reversed(self.quotes) if sign in QUOTES[x[1]]))
        return False


def _quote_sign(stack: _Stack, text: str, at: int) -> None:
    """Opens or closes a quotation, by what is open and the sign's neighbours.

    Its kind is ``quote`` if it begins a sentence, ``inner`` if it begins inside one.
    """
    sign, before, after = text[at], text[at - 1 : at] or " ", text[at + 1 : at + 2] or " "
    if sign in "‘’" and (before.isalnum() and after.isalnum() or _ELIDED.match(text, at)):
        return
    inner = stack.quotes[-1][1] if stack.quotes else ""
    starts = (before.isspace() or before in "([{（【«“„‘‚'\"-–—/>*_") and not after.isspace()
    if sign in QUOTES.get(inner, "") and not (starts and sign == inner == '"'):
        stack.end_quote(sign)
    elif sign in "\"»”" and not (starts or (before in ":,;=" and after.isalnum())):
        stack.end_quote(sign)  # one further out, or one whose beginning isn't here
    elif sign in QUOTES and (before.isspace() or not after.isspace()):
        if sign == inner and stack[-1][0] in QUOTATION:  # none directly holds one of its own kind: the one before lacks its end
            stack.close(*stack[-1])
        stack.open("quote" if stack.begins(text, at) else "inner", sign)
    else:
        stack.end_quote(sign)


@functools.cache
def _same_run(ticks: int) -> re.Pattern:
    return re.compile(rf"(?<!`)`{{{ticks}}}(?!`)")


def _mark(stack: _Stack, text: str, at: int) -> int:
    """Reads a tag, a span of code or a mark of emphasis at ``at``; returns the place after it."""
    sign = text[at]
    if sign == "<":
        tag = _TAG.match(text, at)
        if not tag:
            return at + 1
        name = tag[2].lower()
        if tag[1]:
            stack.close("tag", name)
        elif not tag[3] and name not in ENDLESS:
            stack.open("tag", name)
        return tag.end()
    run = _RUN.match(text, at)
    end = run.end()
    if sign == "`":
        line_end = text.find("\n", end)
        other = _same_run(end - at).search(text, end, len(text) if line_end < 0 else line_end)
        return other.end() if other else end
    before, after = text[at - 1 : at] or " ", text[end : end + 1] or " "
    inside = before.isalnum() and after.isalnum()
    if (before.isspace() or not (inside and sign == "_")) and not (not before.isspace() and stack.close("stress", run[0])) and not after.isspace() and not before.isalnum():
        stack.open("stress", run[0])
    return end


def left_open(text: str) -> list[tuple[str, str]]:
    """What is open at the end of a text, outermost first, as (kind, sign).

    Kinds are ``fence``, ``item``, ``tag``, ``stress``, ``bracket`` and
    ``quote`` (``inner`` inside a sentence). A blank line ends quotations and
    emphasis, and so does the next item of a list; nothing is read inside
    fences, spans of code and tags, nor after a backslash.
    """
    stack = _Stack()
    fenced, read_to = False, 0
    for found in chain((None,), _SIGNS.finditer(text)):
        sign, at = (found.group(), found.start()) if found else ("\n", -1)
        if sign == "\n":
            at += 1
            line = _LINE.match(text, at)
            kind = line.lastgroup
            if fenced:
                if kind == "fence" and line["fence"].startswith(stack[-1][1]) and _LINE.match(text, line.end())["blank"] is not None:
                    stack.close(*stack[-1])
                    fenced, read_to = False, line.end()
                continue
            if kind == "fence":
                stack.open("fence", line["fence"])
                fenced = True
                continue
            if kind == "item" or kind == "blank":
                stack.drop(*QUOTATION, "stress")
            if kind == "item" or kind is None:
                stack.drop("item")
            if kind == "item":
                stack.open("item", line["item"].strip())
                read_to = max(read_to, line.end())
            stack.line(line.end() if kind == "item" else at)
        elif fenced or at < read_to or (at and text[at - 1] == "\\" and text[at - 2 : at - 1] != "\\"):
            continue
        elif sign in BRACKETS:
            if not (sign == "(" and text[at - 1 : at] in _FACES and at and (at + 1 == len(text) or text[at + 1].isspace())):  # not a sad face
                stack.open("bracket", sign)
        elif sign in _OPENED_BY:
            stack.close("bracket", _OPENED_BY[sign])
        elif sign in "`<*_":
            read_to = _mark(stack, text, at)
        else:
            _quote_sign(stack, text, at)
    return list(stack)


def incomplete(open_: list[tuple[str, str]], quotations: bool = True) -> bool:
    """Does what the automaton left open mean that a text stops early?

    A list's last item is always open, and a single star or line may be a note's mark.
    A quotation that began with its own sentence counts where ``quotations`` is true.
    """
    kinds = ("fence", "tag", "bracket", "inner", "quote") if quotations else ("fence", "tag", "bracket", "inner")
    return any(kind in kinds or (kind == "stress" and len(sign) > 1) for kind, sign in open_)
