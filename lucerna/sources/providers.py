"""Remote services behind replaceable providers, with offline stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers after which a request is sent again.
RETRY_STATUS = frozenset({408, 425, 429, 500, 502, 503, 504})


class Provider(Protocol):
    """Answers a batch of keys; an unknown key has no answer."""

    def fetch(self, keys: list[str]) -> dict[str, str]: ...


@dataclass
class TableProvider:
    """Offline provider over fixed answers."""

    answers: dict[str, str] = field(default_factory=dict)

    def fetch(self, keys: list[str]) -> dict[str, str]:
        return {k: self.answers[k] for k in keys if k in self.answers}


def with_retry(call: Callable[[], tuple[int, str]], tries: int = 4, base: float = 0.5, wait: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """Call until the status is final, waiting base·2^i (10 s at most) in between."""
    status, body = call()
    for i in range(tries - 1):
        if status not in RETRY_STATUS:
            break
        wait(min(10.0, base * 2**i))
        status, body = call()
    return status, body


def lookup(df: DataFrame, key: str, provider: Provider, batch: int = 15, out: str = "answer") -> DataFrame:
    """``key, answer`` for the distinct keys of a frame, asked ``batch`` at a time on the executors."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, rows = b[key].tolist(), []
            for i in range(0, len(keys), batch):
                rows += list(provider.fetch(keys[i : i + batch]).items())
            yield pd.DataFrame(rows, columns=[key, out])

    return df.select(key).where(F.col(key).isNotNull()).distinct().mapInPandas(run, f"{key} {kind}, {out} string")


def first_source(*columns: str) -> Column:
    """The first non-blank of several columns, in order of preference."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
