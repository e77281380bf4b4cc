"""Model-backed steps as pluggable column functions, with offline stand-ins.

A provider is any object with the methods of ``Provider``. The stand-ins are
deterministic and need no model; they keep the contracts (shape, order,
fallbacks) testable.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def order(self, query: str, texts: list[str]) -> list[int]: ...

    def judge(self, claim: str, passages: list[str]) -> dict: ...

    def phrases(self, query: str) -> list[str]: ...

    def summarise(self, title: str, text: str) -> dict: ...

    def unsupported(self, text: str, summary: str) -> list[str]: ...

    def rewrite(self, text: str, summary: str, problems: list[str]) -> str: ...

    def mark(self, wanted: str, note: str) -> bool: ...

    def compare(self, a: str, b: str, similarity: float, baseline: float) -> dict: ...


class Offline:
    """A stand-in: vectors from hashed words, order and support by shared words, a text's own beginning as its summary."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dims] += 1 if h >> 40 & 1 else -1
        return out.tolist()

    def order(self, query: str, texts: list[str]) -> list[int]:
        asked = set((query or "").lower().split())
        return sorted(range(1, len(texts) + 1), key=lambda i: (-len(asked & set((texts[i - 1] or "").lower().split())), i))

    def judge(self, claim: str, passages: list[str]) -> dict:
        said = set((claim or "").lower().split())
        best = max((len(said & set((p or "").lower().split())) / max(1, len(said)) for p in passages), default=0.0)
        return {"supported": best >= 0.5, "kind": "fact" if best else "inference"}

    def phrases(self, query: str) -> list[str]:
        said = (query or "").split()
        return [" ".join(said[i : i + 2]) for i in range(0, len(said), 2)]

    def summarise(self, title: str, text: str) -> dict:
        return {"summary": text[:200].strip(), "moments": re.findall("“([^”]+)”", text)[:3]}

    def unsupported(self, text: str, summary: str) -> list[str]:
        return [] if summary in text else [summary]

    def rewrite(self, text: str, summary: str, problems: list[str]) -> str:
        return text[:100].strip()

    def mark(self, wanted: str, note: str) -> bool:
        return bool(set((wanted or "").lower().split()) & set((note or "").lower().split()))

    def compare(self, a: str, b: str, similarity: float, baseline: float) -> dict:
        same = set((a or "").lower().split()) & set((b or "").lower().split())
        return {"relationship": "shared_theme" if similarity - baseline > 0.1 else "coincidental", "confidence": "low", "explanation": f"Both have {len(same)} words in common."}


def with_retries(call: Callable, tries: int = 6, first_wait: float = 0.4, wait: Callable[[float], None] = time.sleep):
    """``call()``, again after errors that may pass (an error's ``status`` of 408, 429 or 5xx), waiting twice as long each time.

    A longer ``retry_after`` of the error is respected.
    """
    for n in range(tries):
        try:
            return call()
        except Exception as error:
            status = getattr(error, "status", None)
            if n + 1 == tries or not (status in (408, 429) or (status or 0) >= 500):
                raise
            wait(max(first_wait * 2**n * (1 + random.random() / 4), getattr(error, "retry_after", 0) or 0))


def embed(passages: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """``passages`` (id, text) with a normalised vector, ``batch`` texts a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in with_retries(lambda at=at: provider.embed(texts[at : at + batch]))]
            yield frame.assign(vector=vectors)

    kind = passages.schema["id"].dataType.simpleString()
    made = passages.select("id", "text").mapInPandas(run, f"id {kind}, text string, vector array<double>")
    return made.select("id", "text", unit(F.col("vector")).cast("array<float>").alias("vector"))


def rerank_orders(candidates: DataFrame, provider: Provider, chars: int = 700) -> DataFrame:
    """query_id and order from candidates (query_id, query, place, text), each text cut to ``chars``.

    One candidate needs no order. A failing provider gives an empty order, which
    keeps the first stage's.
    """
    grouped = candidates.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, chars).alias("text")))).alias("given"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            orders = []
            for query, given in zip(frame["query"], frame["given"], strict=True):
                try:
                    orders.append([] if len(given) < 2 else [int(i) for i in provider.order(query, [g["text"] for g in given])])
                except Exception:
                    orders.append([])
            yield pd.DataFrame({"query_id": frame["query_id"], "order": orders})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"query_id {kind}, order array<int>")


def judge_pairs(pairs: DataFrame, provider: Provider, chars: int = 1400) -> DataFrame:
    """``pairs`` (a_id, b_id, similarity, baseline, a_text, b_text) judged: a_id, b_id, similarity, relationship, confidence, explanation.

    Each text is cut to ``chars``, as a provider takes no more. Where a provider
    fails, or its answer has no relationship, the pair keeps its similarity and
    the rest is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for row in frame.itertuples(index=False):
                try:
                    told = provider.compare(row.a_text, row.b_text, row.similarity, row.baseline)
                    said.append((str(told["relationship"]), told.get("confidence"), told.get("explanation")))
                except Exception:
                    said.append((None, None, None))
            yield frame[["a_id", "b_id", "similarity"]].assign(relationship=[s[0] for s in said], confidence=[s[1] for s in said], explanation=[s[2] for s in said])

    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, chars).alias(c)
    kind = pairs.schema["a_id"].dataType.simpleString()
    given = pairs.select("a_id", "b_id", F.col("similarity").cast("double").alias("similarity"), F.col("baseline").cast("double").alias("baseline"), cut("a_text"), cut("b_text"))
    return given.mapInPandas(run, f"a_id {kind}, b_id {kind}, similarity double, relationship string, confidence string, explanation string")


def phrases(queries: DataFrame, provider: Provider) -> DataFrame:
    """query_id, list_no (from 1) and phrase: other wordings of each query; none where the provider fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query_id, query in zip(frame["query_id"], frame["query"], strict=True):
                try:
                    rows += [(query_id, n, str(p)) for n, p in enumerate(provider.phrases(query), 1)]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["query_id", "list_no", "phrase"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, list_no int, phrase string")
