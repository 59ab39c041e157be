"""Problem 7: fill containers of a fixed number of tokens with whole texts.

Method: shortest-pack-first over the length histogram. Lengths are placed longest first into packing
patterns, of which only the counts are kept; the patterns are joined back to the texts by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one length that one task ranks at most, about; a length has a part for each such number.
PART = 250_000


def token_lengths(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """``(doc_id, tokens)`` by a ``tokenizers`` vocabulary file; null and empty texts have 0 tokens."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        for b in batches:
            texts, n = b["text"].tolist(), []
            for k in range(0, len(texts), 256):
                n += [len(e.ids) for e in t.encode_batch(texts[k : k + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": n})

    return rows.mapInPandas(run, f"doc_id {kind}, tokens long")


def kept(lengths: DataFrame) -> DataFrame:
    """The lengths written to the shared checkpoint folder, so that texts are tokenised once and not again by the second pass."""
    from lucerna.runtime import cut

    return cut(lengths)


def pack_histogram(counts: dict[int, int], capacity: int, best_fit: bool = False) -> list[tuple[dict[int, int], int]]:
    """``(pattern, containers)``, a pattern being ``length → items``.

    Lengths go longest first into the pack with the most room (shortest pack first), or with
    ``best_fit`` into the fullest pack that still has room; all equal packs are filled at once. The
    work depends on the number of different lengths, not of items.
    """
    packs: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left = counts[length]
        while left:
            rooms = range(length, capacity) if best_fit else range(capacity - 1, length - 1, -1)
            room = next((r for r in rooms if packs[r]), None)
            if room is None:
                pattern, have = (), left
            else:
                pattern, have = packs[room].pop()
            start = capacity if room is None else room
            most = start // length if room is None else 1
            if room is None:
                # open packs with one item each; they are filled further as shortest packs
                packs[capacity - length].append((((length, 1),), left))
                left = 0
                continue
            n = min(have, left // most)
            if have > n:
                packs[room].append((pattern, have - n))
            grown = dict(pattern)
            grown[length] = grown.get(length, 0) + most
            packs[room - length * most].append((tuple(sorted(grown.items(), reverse=True)), n))
            left -= n * most
    merged: dict[tuple, int] = {}
    for level in packs:
        for pattern, n in level:
            merged[pattern] = merged.get(pattern, 0) + n
    return [(dict(p), n) for p, n in sorted(merged.items(), reverse=True)]


def fill_containers(lengths: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens", strategy: str = "shortest") -> DataFrame:
    """``doc_id, piece, tokens, container`` for every row of ``lengths``.

    A row over ``capacity`` gives full pieces of their own and one rest; every other row stays whole.
    Rows of 0 or null size take no room and get container 0, as does nothing else. Repeated ids are packed row by
    row. ``strategy``: ``shortest`` (shortest pack first), ``best`` (fullest pack that has room), or
    ``auto``: both histograms are packed and the one with fewer containers is used.

    Rank within a length is counted in two levels (part, then the parts before it). A length has a part for
    every ``PART`` rows of it, so one that holds a third of all rows, such as the full pieces of oversized
    texts, is spread over as many tasks as it needs. Histogram and patterns are bounded by the capacity, the
    counts of parts by the capacity and one for every ``PART`` rows.
    """
    kind = lengths.schema[id_col].dataType.simpleString()
    rows = lengths.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("n"))
    whole = rows.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"), "n")
    items = whole.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.greatest(F.col("n") - F.col("piece") * capacity, F.lit(0))).cast("int").alias("tokens"))
    counts = {r["tokens"]: r["count"] for r in items.where("tokens > 0").groupBy("tokens").count().collect()}  # at most one row a length
    parts = items.sparkSession.createDataFrame([(0, 1), *((x, n // PART + 1) for x, n in counts.items())], "tokens int, parts int")
    items = items.join(F.broadcast(parts), "tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"))
    cells = items.where("tokens > 0").groupBy("tokens", "salt").count().collect()
    plans = [pack_histogram(counts, capacity, best) for best in ([False] if strategy == "shortest" else [True] if strategy == "best" else [False, True])]
    plan = min(plans, key=lambda p: sum(n for _, n in p))
    before: dict[tuple[int, int], int] = {}
    running: dict[int, int] = {}
    for r in sorted(cells, key=lambda r: (r["tokens"], r["salt"])):
        before[r["tokens"], r["salt"]] = running.get(r["tokens"], 0)
        running[r["tokens"]] = running.get(r["tokens"], 0) + r["count"]
    slots: dict[int, list[tuple[int, int, int]]] = {}  # length → (first rank, first container, items a container)
    placed: dict[int, int] = {}
    first = 1
    for pattern, n in plan:
        for length, k in pattern.items():
            slots.setdefault(length, []).append((placed.get(length, 0), first, k))
            placed[length] = placed.get(length, 0) + k * n
        first += n
    assert placed == counts, "every item has one place"
    table = lengths.sparkSession.sparkContext.broadcast((before, {x: np.array(v, dtype=np.int64) for x, v in slots.items()}))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, slots = table.value
        for b in batches:
            out = np.zeros(len(b), dtype=np.int64)
            for (length, salt), at in b.groupby(["tokens", "salt"]).indices.items():
                if length:
                    rank = b["rank"].to_numpy()[at] + before[int(length), int(salt)]
                    s = slots[int(length)]
                    k = np.searchsorted(s[:, 0], rank, side="right") - 1
                    out[at] = s[k, 1] + (rank - s[k, 0]) // s[k, 2]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "tokens": b["tokens"], "container": out})

    return ranked.select("doc_id", "piece", "tokens", "salt", "rank").mapInPandas(run, f"doc_id {kind}, piece int, tokens int, container long")
