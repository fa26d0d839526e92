"""Models behind names: embeddings and scores come from providers that are registered, or from tables."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialise, ship

#: name -> a function that makes an embedder; made once in each task, it takes a batch of texts and gives a matrix.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}
#: name -> a function that makes a chat model; made once in each task, it takes (system, prompt, schema) of a batch and gives
#: a reply for each, null where it has none. What it raises is tried again.
CHATS: dict[str, Callable[[], Callable[[list[tuple[str, str, str]]], list[str | None]]]] = {}
BATCH, ATTEMPTS, WAIT = 16, 3, 5.0


def register(name: str):
    def put(make):
        EMBEDDERS[name] = make
        return make

    return put


def chat(name: str):
    def put(make):
        CHATS[name] = make
        return make

    return put


@register("hashed")
def hashed(dim: int = 64):
    """Signed hashes of words: deterministic, for tests and as an example."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embedded(df: DataFrame, text: str, provider: str, batch: int = BATCH) -> DataFrame:
    """df with an embedding of a text column; the provider is made once in each task and called with batches of a fixed size."""
    ship(df.sparkSession)
    make = EMBEDDERS[provider]

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in it:
            held = s.fillna("").tolist()
            rows = [r for at in range(0, len(held), batch) for r in embed(held[at : at + batch])]
            yield pd.Series([r.tolist() for r in rows])

    return df.withColumn("embedding", run(F.col(text)))


def sync(chunks: DataFrame, index: DataFrame, source: str, provider: str) -> DataFrame:
    """The index after a source is mirrored: live rows that are new or whose text changed are embedded, stale ones go."""
    live = chunks.where((F.col("source") == source) & F.col("excluded").isNull()).withColumn("digest", F.md5(F.col("text").cast("binary")))
    held = index.where(F.col("source") == source)
    same = held.join(live.select("key", "digest"), ["key", "digest"], "left_semi")
    new = live.join(same.select("key"), "key", "left_anti")
    added = embedded(new.select("key", "source", "digest", "text"), "text", provider).select("key", "source", "digest", "embedding")
    return index.where(F.col("source") != source).unionByName(same.select(*index.columns)).unionByName(added.select(*index.columns))


def lexical_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of a query's words that a text holds."""
    q = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)))
    t = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.round(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 9)


def persistently(call: Callable, attempts: int = ATTEMPTS, wait: float = WAIT):
    """What a call gives; an error is raised after so many attempts, with a longer wait after each."""
    for n in range(1, attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            time.sleep(wait * n)
    return call()


def replied(asked: DataFrame, provider: str | DataFrame, batch: int = BATCH, wait: float = WAIT) -> DataFrame:
    """asked(answer, system, prompt, schema, ...) with the reply of a chat model in place of these last three, written so that nothing is asked twice.

    A table (answer, system, reply) in place of a provider's name gives recorded replies; what it lacks is null.
    """
    if isinstance(provider, DataFrame):
        return materialise(asked.join(provider.select("answer", "system", "reply"), ["answer", "system"], "left").drop("system", "prompt", "schema"), "replies")
    ship(asked.sparkSession)
    make = CHATS[provider]

    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ask = make()
        for columns in it:
            rows = list(zip(*columns, strict=True))
            cuts = [rows[at : at + batch] for at in range(0, len(rows), batch)]
            yield pd.Series([r for cut in cuts for r in persistently(lambda: ask(cut), wait=wait)], dtype=object)  # noqa: B023

    return materialise(asked.withColumn("reply", run("system", "prompt", "schema")).drop("system", "prompt", "schema"), "replies")
