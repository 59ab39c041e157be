"""Problem 8: passages of held-out test items inside corpus documents.

Method: Wu-Manber multi-pattern search over word codes. The patterns are all runs of ``RUN`` words of the
items; a shift table over blocks of two words skips positions where no pattern can end, buckets of a
suffix hash select the patterns to test, and direct comparison confirms each occurrence. Confirmed runs
are then extended along the item, so altered and added words do not hide a passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, BLOCK = 3, 2
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.casefold())


class WuManber:
    """Patterns of ``RUN`` word codes with their ``(item, position)``; code 0 is a word of no item."""

    def __init__(self, items: dict[int, list[str]]):
        self.codes: dict[str, int] = {}
        for ws in items.values():
            for w in ws:
                self.codes.setdefault(w, len(self.codes) + 1)
        self.items = {i: [self.codes[w] for w in ws] for i, ws in items.items()}
        df = Counter(c for cs in self.items.values() for c in set(cs))
        self.weight = {c: math.log(1 + len(items) / n) for c, n in df.items()}
        self.base = len(self.codes) + 1
        self.bits = 20
        self.shift = np.full(1 << self.bits, RUN - BLOCK + 1, dtype=np.int8)
        #: Items of fewer words than a run, whole: length → codes → items.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for i, cs in self.items.items():
            if 0 < len(cs) < RUN:
                self.short.setdefault(len(cs), {}).setdefault(tuple(cs), []).append(i)
        self.bucket: dict[int, list[tuple[tuple[int, ...], list[tuple[int, int]]]]] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, cs in self.items.items():
            for k in range(len(cs) - RUN + 1):
                places[tuple(cs[k : k + RUN])].append((i, k))
        for pattern, at in places.items():
            for j in range(RUN - BLOCK + 1):
                h = self.block(pattern[j], pattern[j + 1])
                self.shift[h] = min(self.shift[h], RUN - BLOCK - j)
            self.bucket.setdefault(int(self.block(pattern[-2], pattern[-1])), []).append((pattern, at))

    def block(self, a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - self.bits)

    def encode(self, ws: list[str]) -> np.ndarray:
        get = self.codes.get
        return np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))

    def find(self, code: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """``item → [(position in the text, position in the item)]`` of every confirmed pattern."""
        n, out = len(code), defaultdict(list)
        if n < RUN:
            return out
        hashes = self.block(code[:-1], code[1:])  # hashes[e-1] is the block that ends at e
        step = RUN - BLOCK + 1
        live = np.arange(RUN - 1, n + step - 1, step)
        limit = live + step  # the next lattice point takes over there
        live = np.minimum(live, n - 1)
        ends: list[np.ndarray] = []
        while len(live):
            s = self.shift[hashes[live - 1]]
            hit = live[s == 0]
            if len(hit):
                ends.append(hit)
            live = live + np.maximum(s, 1)
            go = (live < limit) & (live < n)
            live, limit = live[go], limit[go]
        if not ends:
            return out
        for e in np.unique(np.concatenate(ends)).tolist():
            tail = tuple(code[e - RUN + 1 : e + 1].tolist())
            for pattern, at in self.bucket.get(int(hashes[e - 1]), ()):
                if pattern == tail:
                    for item, k in at:
                        out[item].append((e - RUN + 1, k))
        return out

    def whole(self, code: np.ndarray) -> set[int]:
        """The items shorter than a run that stand in the text, each compared whole."""
        out: set[int] = set()
        for n, items in self.short.items():
            plain = code.tolist()
            for at in np.flatnonzero(np.isin(code[: len(code) - n + 1], [k[0] for k in items])).tolist() if len(code) >= n else ():
                out.update(items.get(tuple(plain[at : at + n]), ()))
        return out

    def passage(self, code: list[int], item: int, seeds: list[tuple[int, int]], need: int, share: float) -> int:
        """Longest run of successive item words (altered ones counted) that the text repeats; 0 where it is below ``need``."""
        mine, best, done = self.items[item], 0, set()
        for j, i in sorted(seeds):
            if (j, i) in done:
                continue
            path = [(i + k, j + k) for k in range(RUN)]
            path = self._extend(mine, code, i, j, -1)[::-1] + path + self._extend(mine, code, i + RUN - 1, j + RUN - 1, 1)
            done.update((b, a) for a, b in path)
            matched = {a for a, _ in path}
            lo, hi = min(matched), max(matched)
            if hi - lo + 1 < need or hi - lo + 1 <= best:
                continue
            got = sum(self.weight[mine[a]] for a in matched)
            all_ = sum(self.weight[c] for c in mine[lo : hi + 1])
            if got >= share * all_:
                best = hi - lo + 1
            else:  # the best stretch of the needed length
                acc = np.cumsum([0.0, *[self.weight[mine[a]] * (a in matched) for a in range(lo, hi + 1)]])
                tot = np.cumsum([0.0, *[self.weight[mine[a]] for a in range(lo, hi + 1)]])
                if ((acc[need:] - acc[:-need]) >= share * (tot[need:] - tot[:-need])).any():
                    best = max(best, need)
        return best

    @staticmethod
    def _extend(mine: list[int], code: list[int], i: int, j: int, d: int) -> list[tuple[int, int]]:
        """Matched pairs beyond ``(i, j)`` in direction ``d``, over single altered, added or missing words."""
        out, n, m, misses = [], len(mine), len(code), 0
        i += d
        j += d

        def same(a: int, b: int) -> bool:
            return 0 <= a < n and 0 <= b < m and mine[a] == code[b]

        while 0 <= i < n and 0 <= j < m:
            if mine[i] == code[j]:
                out.append((i, j))
                i += d
                j += d
                misses = 0
                continue
            misses += 1
            if misses > 3:
                break
            for di, dj in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3), (2, 3), (3, 2)):
                a, b = i + d * di, j + d * dj
                if same(a, b) and (same(a + d, b + d) or same(a + 2 * d, b + 2 * d) or not 0 <= a + d < n):
                    i, j = a, b
                    break
            else:
                break
        return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", need: int = 25, share: float = 0.6, block_chars: int = 8_000_000) -> DataFrame:
    """``(item_id, doc_id, words)``: documents that repeat ``need`` successive words of an item (or all of a shorter one).

    ``words`` is the length of the longest repeated run. Words are compared without case and punctuation;
    single altered, added or missing words are stepped over, but ``share`` of the run's weight must match,
    where a word weighs the more the fewer items have it, so runs of shared phrases with other numbers and
    names are no case. Null and empty texts match nothing; each row of repeated documents and items is
    reported once. Every length of item is found: one of fewer words than a run is compared whole. The items are
    the query set: they are taken in blocks of at most ``block_chars``
    characters (one item more at most), each block a compiled table of that bounded size that is broadcast
    and searched in one narrow pass over all documents, read whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where(F.length("text") > 0)
    queries = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    kinds = rows.schema["doc_id"].dataType.simpleString(), queries.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kinds[1]}, doc_id {kinds[0]}, words int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(queries.orderBy("item_id").toLocalIterator(), block_chars):
        compiled = spark.sparkContext.broadcast(_compile(block))
        out = out.union(rows.mapInPandas(_search(compiled, need, share), schema))
    return out.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"))


def _blocks(rows: Iterator, block_chars: int) -> Iterator[dict]:
    """Items in blocks of at most ``block_chars`` characters (one item more at most); one block is held at a time."""
    block: dict = {}
    size = 0
    for r in rows:
        block.setdefault(r["item_id"], []).append(r["text"])
        size += len(r["text"])
        if size > block_chars:
            yield block
            block, size = {}, 0
    if block:
        yield block


def _compile(block: dict) -> tuple[WuManber, dict[int, object]]:
    texts, owner = {}, {}
    for item, versions in block.items():
        for t in versions:
            ws = words_of(t)
            if ws:
                owner[len(owner)] = item
                texts[len(owner) - 1] = ws
    return WuManber(texts), owner


def _search(compiled, need: int, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, owner = compiled.value
        for b in batches:
            out = []
            for d, text in zip(b["doc_id"], b["text"]):
                code = machine.encode(words_of(text))
                out += [(owner[k], d, len(machine.items[k])) for k in machine.whole(code)]
                found = machine.find(code)
                plain = None
                for k, seeds in found.items():
                    least = min(need, len(machine.items[k]))
                    if len({i for _, i in seeds}) < max(1, min(3, least - RUN + 1)):
                        continue
                    plain = plain if plain is not None else code.tolist()
                    n = machine.passage(plain, k, seeds, least, share)
                    if n:
                        out.append((owner[k], d, n))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "words"])

    return run
