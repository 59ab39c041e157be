"""Feature counts of a whole corpus in tables of fixed size.

Every feature is hashed to a slot of a counter table, so the model is as large for 100 TB as for a
fixture and may be broadcast: its size is ``4 * sum(widths)`` bytes by construction. What collisions
add to a slot on average is estimated by ``noise`` and taken off by the users of a table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.runtime import cut

SLICES = 32
#: Tables of partitions that are added in one task.
FAN_IN = 64
_TOP = np.uint64(2**32 - 1)


def corpus_counts(df: DataFrame, cols: list[str], widths: list[int], feed: Callable[[list[np.ndarray], Iterable[tuple]], list[str] | None], keep: Callable[[list[np.ndarray]], Callable[[str], bool]] | None = None) -> list[np.ndarray] | tuple[list[np.ndarray], list[str]]:
    """Counter tables over all rows of ``df``; with ``keep`` also the frequent words.

    ``feed(tables, rows)`` adds the rows of a partition to its tables (uint64, one per width) and may return
    the partition's own frequent words. ``keep(tables)`` makes the test by the tables of the whole corpus that
    bounds them; it runs on the executors, so only words that pass it are sent, each once. Each
    partition sends its tables once, compressed and cut into slices. Slices are added in a tree: ``FAN_IN``
    neighbouring partitions a task, then as many of their sums, so no task holds more than ``FAN_IN``
    slices whatever the number of partitions. Sums stop at 2³²-1. An empty input gives zero tables.
    """
    ends = np.cumsum([0, *widths])
    cuts = np.linspace(0, int(ends[-1]), SLICES + 1).astype(int)

    def pack(x: np.ndarray) -> bytes:
        return zlib.compress(np.minimum(x, _TOP).astype(np.uint32).tobytes(), 1)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        flat = np.zeros(int(ends[-1]), dtype=np.uint64)
        tables = [flat[ends[i] : ends[i + 1]] for i in range(len(widths))]
        words = feed(tables, (row for b in batches for row in zip(*[b[c] for c in cols])))
        rows = [] if words is None else [(-1, TaskContext.get().partitionId(), zlib.compress("\n".join(words).encode(), 1))]
        rows += [(i, TaskContext.get().partitionId(), pack(flat[cuts[i] : cuts[i + 1]])) for i in range(SLICES) if flat[cuts[i] : cuts[i + 1]].any()]
        yield pd.DataFrame(rows, columns=["slice", "part", "data"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in b["data"]:
            part = np.frombuffer(zlib.decompress(x), dtype=np.uint32)
            total = part.astype(np.uint64) if total is None else total + part
        return pd.DataFrame([(int(b["slice"].iloc[0]), int(b["part"].iloc[0]) // FAN_IN, pack(total))], columns=["slice", "part", "data"])

    kind = "slice int, part int, data binary"
    parts = df.select(*cols).mapInPandas(local, kind)
    if keep:
        parts = cut(parts)  # one pass over the texts gives tables and words
    sums = parts.where("slice >= 0")
    for _ in range(max(1, math.ceil(math.log(most_partitions(df), FAN_IN)))):
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, kind)
    flat = np.zeros(int(ends[-1]), dtype=np.uint32)
    for r in sums.collect():  # SLICES rows, of fixed total size
        flat[cuts[r["slice"]] : cuts[r["slice"] + 1]] = np.frombuffer(zlib.decompress(bytes(r["data"])), dtype=np.uint32)
    tables = [flat[ends[i] : ends[i + 1]] for i in range(len(widths))]
    if not keep:
        return tables
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good = keep(shared.value)
        for b in batches:
            for data in b["data"]:
                yield pd.DataFrame({"word": [w for w in zlib.decompress(data).decode().split("\n") if w and good(w)]}, dtype=object)

    return tables, [r["word"] for r in parts.where("slice < 0").select("data").mapInPandas(pick, "word string").distinct().collect()]


def most_partitions(df: DataFrame) -> int:
    """An upper bound of the partitions of ``df``: those of a shuffle, or of a scan by the bytes the plan reads."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = 1 << 20  # no scan is cut finer than this, whatever the settings
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(1 << 24, size // split + 1))


def noise(table: np.ndarray) -> float:
    """What an average slot holds of features that meet there by chance: the median, which few heavy features cannot move."""
    return float(np.median(table))


def whole_texts(df: DataFrame, col: str) -> DataFrame:
    """The non-empty texts of a column."""
    return df.select(F.col(col).alias("text")).where(F.length("text") > 0)


def distinct_texts(df: DataFrame, col: str, key: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """``text, n``: one representative of the non-empty texts of equal ``key`` and their number, so that copies count once.

    Copies collapse within each task before the shuffle (partial aggregation), so no task holds a hub.
    """
    return whole_texts(df, col).groupBy(F.md5(key(F.col("text"))).alias("h")).agg(F.first("text").alias("text"), F.count("*").alias("n")).select("text", "n")
