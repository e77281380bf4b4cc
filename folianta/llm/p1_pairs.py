"""Problem 1: question and answer pairs that are defective.

Method: the pushdown parser of ``structure`` goes through the whole of an answer
with its fences, lists, tags, emphasis, brackets and quotations on one stack, and
what is left on it tells whether the answer stops early; greedy string tiling
measures how much of an answer is the question again; scripts, and profiles of
character n-grams and words learnt from labelled texts, tell languages; a grammar
of refusals (who, modal, negation, act, apology) is applied to each sentence
outside quotations. Defects are tried in the order ``empty``, ``copy``,
``refusal``, ``other_language``, ``truncated``; the first that holds is a pair's
defect.

A null or blank answer is empty. With a null or blank question only ``empty``,
``refusal`` and ``truncated`` are told; without labelled texts languages are told
by script only. Exact copies of a row count once; rows without an id take no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .p9_cuts import ending
from .structure import ITEM, incomplete, left_open

#: Language profiles are fitted on about so many labelled texts, chosen by a hash of all of a row.
PROFILE_TEXTS = 4000
#: A profile holds the commonest so many n-grams and words of a language with at least so many texts.
PROFILE_GRAMS, PROFILE_LEAST = 4000, 10
#: Natural logarithm of the odds, and words of evidence, from which a language is told.
SURE_ODDS, SURE_WORDS = 10.0, 3
#: A text of at least so many words of which fewer than so many are known to a language isn't in it.
STRANGE_WORDS, STRANGE_SHARE = 8, 0.15

# Fixed values of the grammars.
SAYS_NOTHING = {
    "", "na", "n a", "none", "null", "nil", "nan", "undefined", "empty", "blank", "no answer", "no response", "no reply", "not available", "not applicable", "tbd", "todo",
    "keine antwort", "keine", "pas de réponse", "aucune", "aucune réponse", "sin respuesta", "ninguna", "ninguna respuesta", "no hay respuesta",
}
LABELS = r"(?:question|q|you asked|your question|the question|asked|frage|ihre frage|pregunta|su pregunta|votre question|la question|antwort|answer|a|réponse|respuesta)"
LANGUAGES = {
    "en": ("english", "englisch", "anglais", "inglés", "ingles"),
    "de": ("german", "deutsch", "allemand", "alemán", "aleman"),
    "fr": ("french", "französisch", "français", "francais", "francés", "frances"),
    "es": ("spanish", "spanisch", "espagnol", "español", "espanol", "castellano"),
    "ru": ("russian", "russisch", "russe", "ruso"),
    "zh": ("chinese", "chinesisch", "chinois", "chino", "mandarin"),
    "ja": ("japanese", "japanisch", "japonais", "japonés", "japones"),
    "th": ("thai", "thailändisch", "thaï", "tailandés"),
    "hi": ("hindi",),
}
#: Who, modal, negation, act and apology in further languages; a refusal is an apology, or who, modal, negation and act in any order its language allows.
REFUSING = {
    "it": ("io|noi|mi", "posso|possiamo|voglio|devo|riesco|sono in grado", "non", "rispondere|aiutar\\w*|dire|commentare|trattano|contengono", "mi dispiace|mi spiace|purtroppo"),
    "pt": ("eu|nós|me", "posso|podemos|quero|devo|consigo|sou capaz", "não", "responder|ajudar|dizer|comentar|tratam|contêm", "desculp\\w*|sinto muito|lamento|infelizmente"),
    "nl": ("ik|wij|we", "kan|kunnen|mag|wil|zal|ben", "niet|geen", "antwoorden|beantwoorden|helpen|zeggen|ingaan", "het spijt m\\w+|sorry|helaas"),
    "ru": ("я|мы", "могу|можем|хочу|буду|умею", "не", "ответить|отвечать|помочь|сказать|комментировать", "извин\\w*|прост\\w*|к сожалению"),
}
_REFUSING = re.compile(
    "|".join(rf"\b(?:{sorry})\b|\b(?:{no})\W+(?:{can})\b.{{0,60}}\b(?:{act})\b|\b(?:{who})\W+(?:{can})\b.{{0,60}}\b(?:{no})\b.{{0,60}}\b(?:{act})\b" for who, can, no, act, sorry in REFUSING.values()),
    re.I,
)
REFUSAL = re.compile(
    r"""
    \b(?:
      (?:i|we)\s*(?:'m|\ am|'re|\ are|\ was)?\s*(?:(?:really|very|so|truly|terribly|afraid|but)\s+)*(?:sorry|unable|not\ able|not\ in\ a\ position|not\ permitted|not\ allowed|not\ comfortable)
    | (?:i|we)\s+(?:simply\ |really\ |just\ |therefore\ |also\ )?(?:can\s*not|can't|could\s*not|couldn't|won't|will\ not|must\ (?:decline|refuse)|have\ to\ (?:decline|refuse|pass)|decline|refuse|do\ not\ (?:feel|wish|want|have)|don't\ (?:feel|wish|want|have|know)|have\ no\ (?:information|answer|way)|am\ not\ going\ to|prefer\ not|would\ (?:rather|prefer)\ not|am\ declining)
    | i'd\ (?:rather|prefer)\ (?:not|to)
    | my\ apologies | (?:i\ )?apologi[sz]e | sorry
    | (?:would|is|was)\ not\ (?:be\ )?(?:appropriate|possible|right)\ for\ me
    | (?:do|does|did)(?:\ not|n't)\ (?:cover|contain|mention|address|include|tell\ me|say\ anything|provide)
    | as\ an?\ (?:ai|language\ model|assistant)
    | (?:cannot|can't|can\ not|unable\ to)\ (?:help|assist|answer|respond|comment|discuss|provide)
    | (?:falls?|lies?|is|are|goes)\ (?:well\ |far\ )?(?:outside|beyond)\ (?:of\ )?(?:what\ (?:i|we)|my|our|the\ (?:scope|subject|range))
    | (?:nothing|not\ enough|no\ information|insufficient)\ .{0,40}\b(?:to\ answer|passages|was\ given|i\ was)
    | (?:es\ tut\ mir\ leid | tut\ mir\ leid | leider | entschuldig\w* | ich\ bedau\w+)
    | (?:kann|darf|möchte|werde|will|könnte|konnte)\ (?:ich|wir)\b.{0,60}\b(?:nicht|nichts|keine?\w*)
    | ich\ (?:kann|darf|möchte|werde|will|könnte|konnte|habe|bin|weiß|muss)\b.{0,70}\b(?:nicht|nichts|keine?\w*|ablehnen|außerstande|ausserstande)
    | (?:désolée?s? | je\ regrette | pardon | excusez | mes\ excuses | toutes\ mes\ excuses | malheureusement)
    | je\ (?:ne|n')\s*(?:\w+\s+){0,2}(?:pas|rien|point|aucun\w*)
    | je\ n'\w+\ (?:pas|rien|aucun\w*)
    | je\ (?:suis\ (?:dans\ l'incapacité|incapable)|préfère\ ne|dois\ (?:refuser|décliner)|refuse|préférerais\ ne)
    | ne\ (?:permet|permettent|couvre|couvrent|contient|contiennent|mentionne|mentionnent|suffi\w+)\ (?:pas|rien) | (?:je\ m'abstiens|m'abstenir)
    | (?:geben|gibt|enthalten|enthält|erwähnen|erwähnt)\b.{0,40}\b(?:nicht|nichts|keine?\w*)\b.{0,40}\b(?:her|dazu|darüber|angaben|auskunft|antwort)
    | no\ (?:permiten?|contienen?|cubren?|mencionan?|bastan?)\b | me\ abstengo | abstenerme
    | (?:lo\ siento | lo\ lamento | lamento | disculp\w+ | perd[oó]n\w* | mis\ disculpas | lamentablemente)
    | no\ (?:me\ es\ posible|puedo|podemos|podría|sé|tengo|estoy|dispongo|quiero|deseo|debo|voy\ a|sería\ apropiado)
    | (?:prefiero|preferiría)\ no
    | me\ (?:niego|veo\ en\ la\ imposibilidad|resulta\ imposible)
    )""",
    re.I | re.X,
)
#: What may stand beside a refusal and still tells nothing about the matter.
COURTESY = re.compile(
    r"""
    \b(?:you\ (?:could|can|may|might)|please|try|feel\ free|if\ you|let\ me\ know|is\ there\ anything|perhaps\ (?:you|another)|happy\ to|thank\ you|i\ hope|another\ question|ask\ (?:me|again)|consult|there\ is\ no\ (?:answer|information)
    | bitte|sie\ (?:können|könnten)|versuchen|gerne|fragen\ sie|eine\ andere\ frage|vielen\ dank
    | vous\ pouvez|vous\ pourriez|veuillez|n'hésitez|s'il\ vous|essayez|posez|une\ autre\ question|merci
    | puede[ns]?\b|podría|por\ favor|intente|pruebe|pregunte|otra\ pregunta|gracias|si\ (?:quiere|desea)
    )""",
    re.I | re.X,
)
_BUT = re.compile(r"[,;:—–]\s*(?:but|however|though|yet|still|aber|doch|jedoch|mais|cependant|toutefois|pero|sin embargo|aunque)\b\s*(.*)", re.I | re.S)
_CITATION = re.compile(r"\[[\w .-]+(?::\d+)+(?:-\d+)?\]")
_OPEN_CITATION = re.compile(r"\[[\w:. -]{0,80}\Z")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&nbsp;")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’(?!\w)|「[^」]*」")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
_LABEL = re.compile(rf"^\W*{LABELS}\s*:\s*", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).replace("’", "'").casefold())


def says_nothing(said: list[str]) -> bool:
    """True if an answer, given by its words, is blank, a placeholder or signs only."""
    return len(said) < 4 and " ".join(said) in SAYS_NOTHING


class Runs:
    """A suffix automaton: every run of words of one text, in linear space and time."""

    def __init__(self, text: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        last = 0
        for at, word in enumerate(text):
            last = self._add(last, word, at)

    def _state(self, edges: dict[str, int], link: int, length: int, first_end: int) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.first_end.append(first_end)
        return len(self.next) - 1

    def _add(self, last: int, word: str, at: int) -> int:
        new, p = self._state({}, 0, self.length[last] + 1, at), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] != self.length[p] + 1:
                copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first_end[q])
                self.link[q] = copy
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                q = copy
            self.link[new] = q
        return new

    def longest_from(self, other: list[str]) -> list[int]:
        """For each place of ``other`` the length of the longest run from there that the text holds."""
        state = size = begin = 0
        found = [0] * len(other)
        for end, word in enumerate(other):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            # a run that ends here and can't begin earlier: what began earlier ended before this word
            while begin <= end - size:
                found[begin] = end - begin
                begin += 1
        for at in range(begin, len(other)):
            found[at] = len(other) - at
        return found

    def first_place(self, run: list[str]) -> int:
        """Where ``run`` stands first."""
        state = 0
        for word in run:
            state = self.next[state][word]
        return self.first_end[state] - len(run) + 1


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs of unused words first, as (place in a, place in b, length).

    A tile uses up words of ``b`` only, so that a repeated copy of ``a`` in it is
    tiled again. A run is put off at most once, when a longer one has taken its
    end, so the work is that of sorting, whatever the lengths.
    """
    runs = Runs(a)
    heap = [(-n, j) for j, n in enumerate(runs.longest_from(b)) if n >= least]
    heapq.heapify(heap)
    used = [False] * (len(b) + 1)
    begun: list[int] = [0] * (len(b) + 1)  # for each place, the length of the tile that begins there
    found = []
    while heap:
        n, j = heapq.heappop(heap)
        n = -n
        if used[j]:
            continue
        if used[j + n - 1]:
            # a tile no shorter than this run covers its end, so its beginning is the first used place after j
            low, high = j, j + n - 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if used[middle] else (middle, high)
            if high - j >= least:
                heapq.heappush(heap, (j - high, j))
            continue
        used[j : j + n] = [True] * n
        begun[j] = n
        found.append((runs.first_place(b[j : j + n]), j, n))
    return found


def gives_back(asked: list[str], said: list[str]) -> bool:
    """True if an answer is the question again, once or often, and nothing of its own; both are given by their words."""
    if not asked or not said:
        return False
    if said == asked or "".join(said) == "".join(asked):
        return True
    room = max(1, 0.12 * len(said))
    known = set(asked)
    if sum(word not in known for word in said) > room:  # no tile holds these
        return False
    covered = tiles(asked, said, min(3, len(asked)))
    own, back = len(said) - sum(n for _, _, n in covered), len({k for i, _, n in covered for k in range(i, i + n)})
    return back >= 0.8 * len(asked) and own <= room


_SCRIPTS = (("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[㐀-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ko", re.compile(r"[가-힯]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")))
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_BEYOND_LATIN = re.compile(r"[Ͱ-῿⺀-퟿豈-﫿]")


def script(text: str) -> str | None:
    """The language of a text that is mostly in a script other than Latin, else None."""
    others = "" if text.isascii() else "".join(_BEYOND_LATIN.findall(text))
    if others:
        latin = len(_LATIN.findall(text))
        for name, signs in _SCRIPTS:
            n = len(signs.findall(others))
            # a sign of these scripts says as much as several Latin letters
            if n and (3 if name in ("zh", "ja", "ko") else 1) * n > latin:
                return name
    return None


def plain_words(text: str) -> list[str]:
    """The words of a text that are no names: the first, and those that begin with a small letter."""
    found = _WORD.findall(unicodedata.normalize("NFKC", text).replace("’", "'"))
    if text.isupper():
        return [w.lower() for w in found if not w[0].isdigit()]
    return [w.lower() for i, w in enumerate(found) if w[0].islower() or (i == 0 and w[0].isalpha())]


def grams(word: str) -> list[str]:
    """A word's runs of three characters, with a line for its ends, and the word itself."""
    ended = f"_{word}_"
    return [ended[i : i + 3] for i in range(len(ended) - 2)] + [f"={word}"]


class Languages:
    """Profiles of languages in Latin script: how often each n-gram and word stands in each."""

    def __init__(self, profiles: dict[str, dict[str, int]]):
        self.names = sorted(profiles)
        self.profiles = profiles
        kinds = len(set().union(*profiles.values())) if profiles else 0
        self.total = [math.log(sum(profiles[name].values()) + 0.5 * kinds) for name in self.names]
        self.seen: dict[str, list[float]] = {}

    def _weights(self, word: str) -> list[float]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            known = [g for g in grams(word) if any(g in p for p in self.profiles.values())]
            found = self.seen[word] = [sum(math.log(self.profiles[name].get(g, 0) + 0.5) - all_ for g in known) for name, all_ in zip(self.names, self.total, strict=True)]
        return found

    def likeliest(self, said: list[str]) -> str | None:
        """The language of a text given by its plain words; None if there is too little to tell."""
        if len(said) < SURE_WORDS or len(self.names) < 2:
            return None
        odds = [sum(column) for column in zip(*map(self._weights, said), strict=True)]
        first, second = sorted(range(len(odds)), key=odds.__getitem__, reverse=True)[:2]
        return self.names[first] if odds[first] - odds[second] >= SURE_ODDS else None

    def strange(self, said: list[str], name: str) -> bool:
        """True if a text is long enough to tell that it isn't in the language ``name``."""
        profile = self.profiles.get(name)
        return profile is not None and len(said) >= STRANGE_WORDS and sum(f"={word}" in profile for word in said) < STRANGE_SHARE * len(said)


def foreign(question: str, answer: str, languages: Languages) -> bool:
    """True if an answer is neither in the language of its question nor in one the question asks for."""
    asked, said = script(question), script(answer)
    answered = plain_words(answer) if not said else []
    asked = asked or languages.likeliest(plain_words(question))
    if not asked:
        return False
    said = said or languages.likeliest(answered)
    wanted = asked_languages(question)
    if said and said != asked:
        return said not in wanted
    return not wanted and languages.strange(answered, asked)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not script(text):
                counts.update((lang, g) for word in plain_words(text) for g in grams(word))
        names, found = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "gram", "n"])


def learn_languages(documents: DataFrame, sample_texts: int = PROFILE_TEXTS, most: int = PROFILE_GRAMS, least_texts: int = PROFILE_LEAST) -> Languages:
    """Profiles from texts labelled with their language (``lang`` as ``de``, ``DE`` or ``de-DE``).

    Fitted on about ``sample_texts`` labelled texts; at most ``most`` rows a
    language come back, for languages with ``least_texts`` texts in the sample.
    """
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null and length(lang) = 2")
    share = sample_texts / max(1, rows.count())
    sample = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = sample.mapInArrow(_count_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= most)
    known = sample.groupBy("lang").count().where(F.col("count") >= least_texts).select("lang")
    table = top.join(F.broadcast(known), "lang").select("lang", "gram", "n").toArrow().to_pydict()  # most rows a language, two letters a language
    profiles: dict[str, dict[str, int]] = {}
    for name, gram, n in zip(table["lang"], table["gram"], table["n"], strict=True):
        profiles.setdefault(name, {})[gram] = n
    # a language of another script leaves a few stray Latin words only
    largest = max((sum(p.values()) for p in profiles.values()), default=0)
    return Languages({name: p for name, p in profiles.items() if sum(p.values()) * 200 >= largest and name not in [s for s, _ in _SCRIPTS]})


def asked_languages(question: str) -> set[str]:
    """Languages a question names."""
    said = set(words(question))
    return {name for name, names in LANGUAGES.items() if said & set(names)}


def declines(answer: str) -> bool:
    """True if an answer only declines: every sentence refuses, apologises or points elsewhere, and one refuses.

    Citations and markup are out already. Quotations are taken out first, as a quoted refusal is somebody else's; what
    follows a "but" counts as a sentence of its own.
    """
    plain = _QUOTED.sub(" “ ", answer.replace("’", "'"))
    refused = False
    for sentence in _SENTENCE.split(plain):
        while sentence:
            turn = _BUT.search(sentence)
            part, sentence = (sentence[: turn.start()], turn.group(1)) if turn else (sentence, "")
            if "“" in part:
                return False
            if REFUSAL.search(part) or _REFUSING.search(part):
                refused = True
            elif len(_WORD.findall(part)) > 1 and not COURTESY.search(part):
                return False
    return refused


def stops_early(answer: str) -> bool:
    """True if an answer stops before its last sentence, quotation, citation, fence or markup is complete."""
    text = answer.strip()
    if _OPEN_CITATION.search(text, max(0, text.rfind("["))):
        return True
    while text.endswith("]") and (cited := _CITATION.fullmatch(text, text.rfind("["))):
        text = text[: cited.start()].rstrip()
    still = left_open(text)
    # whole sentences in a quotation stand alone, so one that began with a sentence may lack its end
    if incomplete(still, quotations=False):
        return True
    how = ending(text, [])
    if how in ("broken", "ellipsis", "abbreviation"):
        return True
    if how != "bare":
        return False
    last = text[text.rfind("\n") + 1 :]
    if any(kind == "item" for kind, _ in still) and ITEM.match(last) and "\n" in text:
        # an item is complete as the items before it are: without a terminator, and no shorter than a phrase
        return text.rstrip()[-1] in ",;:-(" or len(words(last)) < 2
    few = words(text)
    return not (len(few) <= 4 and (len(few) <= 2 or few[-1].isdigit()))


NO_LANGUAGES = Languages({})


def defect(question: str | None, answer: str | None, languages: Languages = NO_LANGUAGES) -> str | None:
    """The defect of a pair, or None if it is sound."""
    if answer is None:
        return "empty"
    uncited = _CITATION.sub(" ", answer) if "[" in answer else answer
    plain = _MARKUP.sub(" ", uncited) if "<" in uncited or "&" in uncited else uncited
    said = words(plain)
    if says_nothing(said):
        return "empty"
    question = question or ""
    if question.strip() and gives_back(words(question), words(_LABEL.sub("", plain)) if ":" in plain else said):
        return "copy"
    if declines(plain):
        return "refusal"
    if foreign(question, uncited, languages):
        return "other_language"
    return "truncated" if stops_early(answer) else None


def _judge(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(q, a, languages) for q, a in zip(batch["question"].to_pylist(), batch["answer"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["feedback_id"], batch["verdict"], pa.array(found, pa.string())], names=["feedback_id", "verdict", "defect"])

    return run


def judged(feedback: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """feedback_id, verdict and ``defect`` (null where a pair is sound), a row for each row of ``feedback``.

    ``documents`` (lang, text) are the labelled texts languages are learnt from.
    Every pair is parsed once, whatever is asked of the result.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = feedback.select(F.col("id").cast("bigint").alias("feedback_id"), text("verdict") if "verdict" in feedback.columns else F.lit(None).cast("string").alias("verdict"), text("question"), text("answer"))
    languages = learn_languages(documents) if documents is not None else NO_LANGUAGES
    return rows.where("feedback_id is not null").mapInArrow(_judge(languages), "feedback_id bigint, verdict string, defect string")


def defective_pairs(feedback: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``feedback_id`` and ``defect`` of every defective pair."""
    return judged(feedback, documents).where("defect is not null").select("feedback_id", "defect").distinct()


def defect_counts(feedback: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``verdict`` (in one spelling, or ``none``), ``defect`` (or ``sound``) and the number of ``pairs``."""
    verdict = F.lower(F.trim("verdict"))
    rows = judged(feedback, documents).select("feedback_id", F.when(verdict.isin("up", "down"), verdict).otherwise("none").alias("verdict"), F.coalesce("defect", F.lit("sound")).alias("defect"))
    return rows.distinct().groupBy("verdict", "defect").agg(F.count(F.lit(1)).alias("pairs"))
