"""Interfaces of the models that callers bring: encoders, matchers, judges.

Each is a plain callable on batches, applied by ``mapInPandas``, so a model
is loaded once a partition and order never matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .types import type_of


class Encoder(Protocol):
    def __call__(self, texts: Sequence[str], role: str) -> Sequence[Sequence[float]]: ...


class Completer(Protocol):
    """Answers prompts; None for a request that failed for good. An answer is
    its text, or a tuple of that and the tokens of the prompt and of the answer."""

    def __call__(self, prompt: str) -> str | tuple[str | None, int, int] | None: ...


def embed(rows: DataFrame, load: Callable[[], Encoder], *, text_col: str, role: str, batch: int = 256) -> DataFrame:
    """Adds ``embedding``: unit vectors of the texts, null for a zero vector."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    out = StructType([*rows.schema.fields]).add("embedding", type_of("array<double>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            vectors: list = []
            texts = frame[text_col].fillna("").tolist()
            for i in range(0, len(texts), batch):
                vectors += [[float(x) for x in v] for v in encoder(texts[i : i + batch], role)]
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    raw = rows.mapInPandas(run, out)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("embedding", F.when(norm > 0, F.transform("embedding", lambda x: x / norm)))


def complete(rows: DataFrame, load: Callable[[], Completer], *, prompt_col: str = "prompt", threads: int = 8, retries: int = 2, usage: bool = False) -> DataFrame:
    """Adds ``response``: the answers to the prompts, ``threads`` at a time in
    each partition. With ``usage`` also ``prompt_tokens`` and
    ``completion_tokens``, null where the completer reports none. A request that keeps failing
    has a null answer, and never fails the others."""
    out = StructType([*rows.schema.fields]).add("response", "string").add("prompt_tokens", "long").add("completion_tokens", "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = load()

        def ask(prompt: str) -> tuple[str | None, int | None, int | None]:
            for _ in range(retries + 1):
                try:
                    said = completer(prompt)
                    return said if isinstance(said, tuple) else (said, None, None)
                except Exception:  # noqa: BLE001  a dead request is an answer that is missing
                    continue
            return None, None, None

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                told = pd.DataFrame(list(pool.map(ask, frame[prompt_col])), index=frame.index, columns=["response", "prompt_tokens", "completion_tokens"], dtype=object)
                yield frame.assign(**{c: told[c] for c in told.columns}).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    told = rows.mapInPandas(run, out)
    return told if usage else told.drop("prompt_tokens", "completion_tokens")
