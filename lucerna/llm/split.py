"""Problem 1: cut oversized texts into pieces at natural boundaries.

Method: lexical-cohesion segmentation. Around every natural boundary the cosine similarity of the
word blocks on both sides is taken; a valley marks a change of topic. Within each size window the
deepest valley becomes the cut, and the next piece starts up to ``overlap`` characters earlier.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, LINE = 3, 2, 1
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("al approx cf ch dr e.g eq eqs etc fig figs i.e jr mr mrs ms no nos p pp prof ref refs sec sr st vol vols vs".split())
_PARA = re.compile(r"\n[ \t\r\f\v]*\n\s*")
_LINE = re.compile(r"\n")
_STOP = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[”’」』）]*")
_WORD = re.compile(r"\w{3,}")
BLOCK = 40


def boundaries(text: str) -> tuple[list[int], dict[int, int]]:
    """Positions after which a piece may end, with their rank."""
    rank: dict[int, int] = {}
    for m in _LINE.finditer(text):
        rank[m.start()] = LINE
    for m in _STOP.finditer(text):
        at = m.end()
        if text[m.start()] == ".":
            word = text[max(0, m.start() - 12) : m.start()].split()
            last = word[-1].lstrip("([\"'“‘").lower() if word else ""
            if last in ABBREVIATIONS or (len(last) == 1 and last.isalpha()):
                continue
            rest = text[at : at + 8].lstrip()
            if rest and "\n" not in text[at : at + 2] and (rest[0].islower() or rest[0].isdigit()):
                continue
        rank[at] = SENTENCE
    for m in _PARA.finditer(text):
        rank[m.start()] = PARAGRAPH
    rank.pop(0, None)
    return sorted(rank), rank


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def _whole(text: str, at: int) -> int:
    """Move a hard cut back so that no combining mark or joiner is parted from its letter."""
    back = at
    while back > max(1, at - 32) and back < len(text) and (unicodedata.combining(text[back]) or text[back] in "‍️" or text[back - 1] == "‍"):
        back -= 1
    return back


def pieces(text: str, limit: int = 1200, overlap: int = 200) -> list[tuple[int, int]]:
    """``[start, end)`` of the pieces, each at most ``limit`` long; together they cover all but white space between pieces."""
    if not 0 <= overlap * 2 < limit:
        raise ValueError("overlap must be below half of limit")
    if len(text) <= limit:
        return [(0, len(text))]
    ends, rank = boundaries(text)
    found = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
    places, terms = [p for p, _ in found], [w for _, w in found]
    out, start, n = [], 0, len(text)
    while n - start > limit:
        low = start + limit // 2
        span = ends[bisect.bisect_left(ends, low) : bisect.bisect_right(ends, start + limit)]
        if not span:
            span = ends[bisect.bisect_right(ends, start + overlap) : bisect.bisect_right(ends, start + limit)]
        if span:
            sims = []
            for at in span:
                k = bisect.bisect_left(places, at)
                sims.append(_cosine(Counter(terms[max(0, k - BLOCK) : k]), Counter(terms[k : k + BLOCK])))
            best, end = -9.0, span[-1]
            for i, at in enumerate(span):
                depth = max(sims[: i + 1]) + max(sims[i:]) - 2 * sims[i]
                score = depth + {PARAGRAPH: 0.3, SENTENCE: 0.15, LINE: 0.0}[rank[at]]
                if score >= best:
                    best, end = score, at
        else:
            end = start + limit
            for k in range(start + limit, start + overlap, -1):
                if text[k].isspace():
                    end = k
                    break
            else:
                end = _whole(text, end)
        while end > start + overlap + 1 and text[end - 1].isspace():
            end -= 1
        out.append((start, end))
        start = _next_start(text, ends, start, end, overlap)
    while start < n and text[start].isspace():
        start += 1
    if start < n:
        out.append((start, n))
    return out


def _next_start(text: str, ends: list[int], start: int, end: int, overlap: int) -> int:
    low = max(start + 1, end - overlap)
    for at in ends[bisect.bisect_left(ends, low) : bisect.bisect_left(ends, end)]:
        at = _skip(text, at)
        if low <= at < end:
            return at
    if overlap:
        for at in range(low, end):
            if text[at - 1].isspace() and not text[at].isspace():
                return at
        if not any(x.isspace() for x in text[low:end]):
            return _whole(text, low)
    return _skip(text, end)


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text", start_col: str | None = "char_start", limit: int = 1200, overlap: int = 200) -> DataFrame:
    """Pieces of every row whose text is longer than ``limit`` Unicode code points.

    Returns ``item_id, piece, n_pieces, char_start, char_end, text``; ``char_start`` and ``char_end``
    are the row's own start plus the offset in its text. Rows within the limit, null and empty texts
    give no row; a null or missing start counts as 0; repeated rows are cut each for itself; other
    columns are ignored, whatever they are called. A text without any boundary is cut hard, never
    between a letter and its combining marks. The work is a narrow map, so no row leaves its task.
    """
    base = F.coalesce(F.col(start_col).cast("long"), F.lit(0)) if start_col else F.lit(0).cast("long")
    rows = df.select(F.col(id_col).alias("item_id"), base.alias("base"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, base, text in zip(b["item_id"], b["base"], b["text"]):
                cuts = pieces(text, limit, overlap)
                out += [(item, k, len(cuts), base + s, base + e, text[s:e]) for k, (s, e) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=["item_id", "piece", "n_pieces", "char_start", "char_end", "text"])

    return rows.mapInPandas(run, f"item_id {kind}, piece int, n_pieces int, char_start long, char_end long, text string")
