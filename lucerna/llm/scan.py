"""Problem 4: text of scanned pages made continuous and readable.

Method: noisy channel. Character confusion probabilities, learned from proofread chunks, times the
likelihood of word n-grams counted over the corpus; Viterbi picks the best word sequence of each line.
The same n-gram counts decide whether a word broken at a line end is joined and whether a line is a
running header that interrupts a sentence.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.hashed import corpus_counts, distinct_texts, noise

UNI, BI, LINES = 1 << 20, 1 << 21, 1 << 19
#: Share of all words that a candidate has at least; so many words (its inverse) can be candidates at most.
SHARE = 1e-6
GAP = "\0"
#: Fixed values: (printed, as misread) segments known from optical character recognition, with a prior count.
CONFUSIONS = [(a, b) for a, b in (p.split(">") for p in "rn>m m>rn l>1 1>l i>1 i>l l>i l>| i>| I>| 1>| I>l l>I o>0 0>o O>0 0>O s>5 5>s S>5 5>S s>$ S>$ e>c c>e a>@ a>o o>a B>8 8>B g>9 9>g q>9 z>2 2>z Z>2 b>6 6>b b>h h>b cl>d d>cl vv>w w>vv li>h ii>n n>ii u>ii u>n n>u f>t t>f fi>h ti>h ri>n in>m ni>m nn>m E>F F>E G>6 t>+ e>o n>h h>n y>v v>y D>O Q>O A>4 T>7".split())]
PRIOR = 2.0
_BREAKS = "-­¬‐"
_PAGE = re.compile(r"\s*[\[(—–\-|]*\s*(?:p(?:age|\.)?\s*)?(\d{1,4}|[ivxl]{1,6}(?=\s*[\])—–-]))(?:\s*/\s*\d{1,4})?\s*[\])—–\-|]*\s*", re.I)
_SECTION = re.compile(r"\s*(?:\d+(?:\.\d+)+\.?|\d+\.)\s+\S")
_EDGE = re.compile(r"^\s*(?:\d{1,4}\s{2,}|\d{1,4}\s*[|·—]\s*)|(?:\s{2,}\d{1,4}|\s*[|·—]\s*\d{1,4})\s*$")
_STRUCT = re.compile(r"\t|^\s*(?:[-*•]\s|\d+[.)]\s|\(\w{1,3}\)\s|#)|\s=\s.*\(\d+\)\s*$|\S {3,}\S")
_CORE = re.compile(r"^([\"'“‘(\[{]*)(.*?)([\"'”’)\]},.;:!?…]*)$", re.S)
_DIGITS = re.compile(r"\d+")
#: A word broken at a line end with what follows it.
_BROKEN = re.compile(r"[-­¬‐][ \t]*(?:\n\s*\S*|\Z)")


def norm(word: str) -> str:
    """Form under which a word is counted: lower case, every run of digits as 0."""
    return _DIGITS.sub("0", word.lower())


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _slots(h, width: int):
    """Two slots of a 64-bit hash, or of an array of them."""
    return h % width, ((h >> 32) * 0x9E3779B1) % width


def _mixed(a, b):
    """Hash of a pair of words from their hashes, for numbers and for arrays."""
    return (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ b >> 29) & 0xFFFFFFFFFFFFFFFF


class Counts:
    """Two-way hashed counts of words, word pairs and stand-alone lines, and the words that may be candidates.

    An estimate is the smaller of two slots less what chance adds to a slot (``noise``), and at least 0.
    """

    def __init__(self, tables: list[np.ndarray], rows: Counts | None = None, frequent: list[str] | None = None):
        #: Counts over all rows, beside these over the distinct texts.
        self.rows = rows
        self.noise = [noise(t) for t in tables]
        self.total = max(1.0, float(tables[0].sum(dtype=np.float64)) / 2)
        self.uni, self.bi, self.lines = (memoryview(np.ascontiguousarray(t)) for t in tables)
        self.least = max(LEAST + 4 * math.sqrt(self.noise[0]), SHARE * self.total)
        self.hashes: dict[str, int] = {}
        self.cache: dict[str, float] = {}
        #: Sorted candidates of small and of capitalised words; without a list any beginning is followed.
        self.frequent = None
        if frequent is not None:
            both = [c for c in (self, rows) if c is not None]
            self.frequent = [sorted(w for w in frequent if any(c.word(w) >= c.least * k for c in both)) for k in (1, CAPITAL)]
        self.begun: list[dict[str, bool]] = [{}, {}]
        #: Tokens that stay as they are; the parts of the others and their candidates by texts and by rows.
        self.fine: set[str] = set()
        self.odd: dict[str, tuple[tuple[str, str, str], dict[str, float], dict[str, float]]] = {}

    def hash(self, w: str) -> int:
        h = self.hashes.get(w)
        if h is None:
            if len(self.hashes) > 300_000:
                self.hashes.clear()
            h = self.hashes[w] = _hash(w)
        return h

    def word(self, w: str) -> float:
        n = self.cache.get(w)
        if n is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            h = _hash(w)
            n = self.uni[h % UNI]
            if n:
                n = max(0.0, min(n, self.uni[((h >> 32) * 0x9E3779B1) % UNI]) - self.noise[0])
            self.cache[w] = n
        return n

    def begins(self, prefix: str, capital: bool) -> bool:
        """Whether a possible candidate begins with ``prefix``."""
        seen = self.begun[capital]
        ok = seen.get(prefix)
        if ok is None:
            if len(seen) > 300_000:
                seen.clear()
            ok = True
            if self.frequent is not None:
                words = self.frequent[capital]
                i = bisect.bisect_left(words, prefix)
                ok = i < len(words) and words[i].startswith(prefix)
            seen[prefix] = ok
        return ok

    def pair(self, a: str, b: str) -> float:
        i, j = _slots(_mixed(self.hash(a), self.hash(b)), BI)
        return max(0.0, min(self.bi[i], self.bi[j]) - self.noise[1])

    def line(self, s: str) -> float:
        i, j = _slots(_hash(s), LINES)
        return max(0.0, min(self.lines[i], self.lines[j]) - self.noise[2])

    def log(self, a: str, b: str, own: float = 0.0) -> float:
        """Interpolated log-probability of ``b`` after ``a``, without ``own`` occurrences of its own."""
        na, nb = self.word(a), max(0.0, self.word(b) - own)
        p1 = (nb + 0.01) / self.total
        return math.log(0.75 * max(0.0, self.pair(a, b) - own) / (na + 1.0) + 0.25 * p1)


def line_key(line: str) -> str:
    return norm(_EDGE.sub("", line).strip())


def core(token: str) -> str:
    return _CORE.match(token).group(2)


class _Words(dict):
    """Token → number of its counted form; 0 is a gap. The hash of each form is kept beside it."""

    def __init__(self) -> None:
        super().__init__({GAP: 0})
        self.forms: dict[str, int] = {GAP: 0}
        self.hash: list[int] = [0]

    def __missing__(self, token: str) -> int:
        w = GAP if token.endswith(GAP) else norm(core(token))
        i = self.forms.get(w)
        if i is None:
            i = self.forms[w] = len(self.forms)
            self.hash.append(_hash(w))
        self[token] = i
        return i


def count_feed(tables: list[np.ndarray], rows: Iterable[tuple]) -> list[str]:
    """Add ``(text, copies)`` to the tables of texts (words, pairs, lines) and of rows (words, pairs). Pieces of words at hyphenated line ends are left out.

    Returns the words that have a share of ``SHARE`` here: one that has it in the corpus has it in some partition.
    """
    words, seen, held, copies = _Words(), Counter(), [], []
    often: dict[str, tuple[float, float]] = {}
    lines = tables[2]

    def both(table: np.ndarray, more: np.ndarray, h: np.ndarray, n: np.ndarray | None, m: np.ndarray | None) -> None:
        i, j = _slots(h, np.uint64(len(table)))
        for at, k in ((i, None), (j, i != j)):
            at = (at if k is None else at[k]).astype(np.int64)
            once, every = (x if k is None or x is None else x[k] for x in (n, m))
            got = np.bincount(at, weights=once, minlength=len(table)).astype(np.uint64)
            table += got
            more += got if every is once else np.bincount(at, weights=every, minlength=len(table)).astype(np.uint64)

    def flush() -> None:
        if held:
            ids = np.concatenate(held)
            h = np.array(words.hash, dtype=np.uint64)
            n = np.bincount(ids, minlength=len(h)).astype(np.float64)
            n[0] = 0
            m, every = n, None
            if max(copies) > 1:
                every = np.repeat(np.array(copies, dtype=np.float64), [len(x) for x in held])
                m = np.bincount(ids, weights=every, minlength=len(h))
                m[0] = 0
            with np.errstate(over="ignore"):
                both(tables[0], tables[3], h, n, m)
                a, b = ids[:-1], ids[1:]
                go = (a > 0) & (b > 0)
                both(tables[1], tables[4], _mixed(h[a[go]], h[b[go]]), None, every if every is None else every[1:][go])
            for w, x, y in zip(words.forms, n.tolist(), m.tolist()):
                if x:
                    a, b = often.get(w, (0.0, 0.0))
                    often[w] = a + x, b + y
            held.clear()
            copies.clear()
        for key, k in seen.items():
            for slot in set(_slots(_hash(key), LINES)):
                lines[slot] += np.uint64(k)
        seen.clear()
        if len(words) > 400_000:
            words.__init__()

    size = 0
    for text, n in rows:
        for line in text.split("\n"):
            s = line.strip()
            # only what starts like a header is ever looked up
            if s and len(s) < 70 and s[-1] not in ".?!;:," and not s[0].islower():
                seen[line_key(s)] += 1
        tokens = (_BROKEN.sub(f"{GAP} {GAP} ", text) if any(x in text for x in _BREAKS) else text).split()
        held.append(np.array([0, *map(words.__getitem__, tokens)], dtype=np.int64))
        copies.append(n)
        size += len(tokens)
        if size > 2_000_000 or len(words) > 400_000 or len(seen) > 400_000:
            flush()
            size = 0
    flush()
    once, every = (SHARE * sum(x[k] for x in often.values()) for k in (0, 1))
    return [w for w, (x, y) in often.items() if x >= once or y >= every]


def fit_counts(df: DataFrame, text_col: str = "text") -> tuple[list[np.ndarray], list[str]]:
    """Counts over the distinct texts (the copies of a chunk make no misread word of it a known one), then words and pairs over all rows; and the words that may be candidates."""

    def keep(tables: list[np.ndarray]):
        counts = counts_of(tables, None)
        return lambda w: counts.word(w) >= counts.least or counts.rows.word(w) >= counts.rows.least

    return corpus_counts(distinct_texts(df, text_col), ["text", "n"], [UNI, BI, LINES, UNI, BI], count_feed, keep)


def counts_of(tables: list[np.ndarray], frequent: list[str] | None) -> Counts:
    """The counts of ``fit_counts`` in use."""
    return Counts(tables[:3], Counts([tables[3], tables[4], tables[2]]), frequent)


def _aligned(noisy: str, proof: str) -> Iterator[tuple[str, str]]:
    """(printed, read) words of one to one replacements between a chunk and its proof."""
    lines = [x for x in noisy.split("\n") if not _PAGE.fullmatch(x)]
    a = re.sub(r"[-­¬‐][ \t]*\n\s*", "", "\n".join(lines)).split()
    b = re.sub(r"[-­¬‐][ \t]*\n\s*", "", proof).split()
    for op, i, j, x, y in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "replace" and j - i == y - x:
            for r, p in zip(a[i:j], b[x:y]):
                if abs(len(r) - len(p)) <= 2 and difflib.SequenceMatcher(None, r, p, autojunk=False).ratio() > 0.55:
                    yield p, r


def fit_confusions(chunks: DataFrame, proofs: DataFrame, id_col: str = "id", text_col: str = "text", proof_id: str = "chunk_id", proof_text: str = "proof_text") -> dict[tuple[str, str], float]:
    """``(read, printed) → log-probability`` of each misreading, from all proofread chunks.

    Segments are at most two characters a side, so the result is bounded; without proofs only the prior
    counts remain.
    """
    a = chunks.select(F.col(id_col).alias("i"), F.col(text_col).alias("noisy"))
    b = proofs.select(F.col(proof_id).alias("i"), F.col(proof_text).alias("proof"))
    both = a.join(b, "i").where("noisy is not null and proof is not null and noisy <> proof")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for x in batches:
            for noisy, proof in zip(x["noisy"], x["proof"]):
                for p, r in _aligned(noisy, proof):
                    for op, i, j, k, m in difflib.SequenceMatcher(None, p, r, autojunk=False).get_opcodes():
                        if op == "replace" and j - i <= 2 and m - k <= 2:
                            c[p[i:j], r[k:m]] += 1
        yield pd.DataFrame([(p, r, n) for (p, r), n in c.items()], columns=["p", "r", "n"])

    seen: Counter = Counter({(p, r): PRIOR for p, r in CONFUSIONS})
    for r in both.mapInPandas(run, "p string, r string, n long").groupBy("p", "r").agg(F.sum("n").alias("n")).collect():
        seen[r["p"], r["r"]] += r["n"]
    total = sum(seen.values())
    return {(r, p): math.log(n / total) + MISREAD for (p, r), n in seen.items()}


#: Share of misread words among odd ones.
MISREAD = math.log(0.1)
LEAST = 4
#: A word is odd up to this share of all words; a candidate must be so many times as frequent.
RARE, FAR = 5e-5, 20
#: How many times the expected number of misreadings a word may occur and still be one.
NOISE = 4.0
FLOOR = -16.5
#: How many times as frequent as others the candidates of a capitalised word must be: a name may be rare and right.
CAPITAL = 5


def candidates(word: str, confusions: dict[str, list[tuple[str, float]]], models: list[Counts], counts: Counts, edits: int = 2) -> list[dict[str, float]]:
    """For each model the corpus words that could have been read as ``word``, with the log-probability of the misreading (``FLOOR`` at least).

    The word is rewritten from left to right; what begins as no possible candidate does is not followed, which
    loses none and makes the search short, however long the word.
    """
    # what replaces a word must always be far more common than it
    capital = word[:1].isupper()
    usual = CAPITAL if capital else 1
    own = norm(word)
    floors = [(c, max(c.least * usual, FAR * (c.word(own) - 1))) for c in models]
    out: list[dict[str, float]] = [{} for _ in models]
    n = len(word)
    todo = [(0, "", "", 0.0, 0)]
    while todo:
        i, v, p, lp, e = todo.pop()
        if i >= n:
            if e and v != word:
                for (c, floor), found in zip(floors, out):
                    if lp > found.get(v, -99.0) and c.word(p) >= floor:
                        found[v] = lp
            continue
        step = [(i + 1, word[i], lp, e)]
        if e < edits:
            for k in (1, 2):
                if i + k <= n:
                    step += [(i + k, printed, lp + q, e + 1) for printed, q in confusions.get(word[i : i + k], ()) if lp + q >= FLOOR]
        for at, piece, total, done in step:
            form = p
            for ch in piece:  # the counted form grows with the word
                form = form + ch.lower() if not ch.isdigit() else form if form[-1:] == "0" else form + "0"
            if form == p or len(form) < 3 or counts.begins(form, capital):
                todo.append((at, v + piece, form, total, done))
    return out


def _wordlike(w: str) -> bool:
    return 2 < len(w) and sum(x.isdigit() for x in w) * 2 <= len(w) and any(x.isalpha() or x in "|$@+" for x in w)


def _rare(w: str, counts: Counts) -> bool:
    return counts.word(norm(w)) < max(counts.least, RARE * counts.total)


def odd_ones(tokens: Iterable[str], confusions: dict[str, list[tuple[str, float]]], counts: Counts) -> bool:
    """Whether a token may be misread; every distinct token is looked at once and then known."""
    found = False
    for t in set(tokens) - counts.fine:
        if t not in counts.odd:
            parts = _CORE.match(t).groups()
            w = parts[1]
            models = [c for c in (counts, counts.rows) if c is not None and _rare(w, c)] if _wordlike(w) else []
            could = dict(zip(map(id, models), candidates(w, confusions, models, counts))) if models else {}
            first, second = could.get(id(counts), {}), could.get(id(counts.rows), {})
            # the rows have a say only where the texts do not speak against it
            second = {v: lp for v, lp in second.items() if counts.word(norm(v)) >= counts.word(norm(w))}
            if not first and not second:
                if len(counts.fine) > 500_000:
                    counts.fine.clear()
                counts.fine.add(t)
                continue
            if len(counts.odd) > 200_000:
                counts.odd.clear()
            counts.odd[t] = parts, first, second
        found = True
    return found


def decode_line(tokens: list[str], confusions: dict[str, list[tuple[str, float]]], counts: Counts) -> tuple[list[str], int]:
    """The most likely words of a line and how many were misread: Viterbi over the candidates of its odd words, by the distinct texts and then by all rows."""
    if not odd_ones(tokens, confusions, counts):
        return tokens, 0
    known = [counts.odd.get(t) or (_CORE.match(t).groups(), {}, {}) for t in tokens]
    words = read = [p[1] for p, _, _ in known]
    for k, model in enumerate((counts, counts.rows)):
        could = [x[1 + k] if w == r else {} for x, w, r in zip(known, words, read)]
        if model is not None and any(could):
            words = viterbi([[(w, math.log(0.98)), *c.items()] for w, c in zip(words, could)], model)
    return [p[0] + w + p[2] for (p, _, _), w in zip(known, words)], sum(w != r for w, r in zip(words, read))


def viterbi(states: list[list[tuple[str, float]]], counts: Counts, before: str = "") -> list[str]:
    """The best path through ``(word, log-probability of the channel)`` choices; the first choice is the word as read."""
    best, prev = [(0.0, [])], [norm(before)]
    for own in states:
        step, names = [], []
        for v, lp in own:
            n = norm(v)
            # what the misreadings of its candidates explain is no evidence for the word as it stands
            read = 1 + NOISE * sum(counts.word(norm(c)) * math.exp(p) for c, p in own[1:]) if len(own) > 1 and v == own[0][0] else 0
            step.append(max(((s + counts.log(q, n, read) + lp, path + [v]) for (s, path), q in zip(best, prev)), key=lambda x: x[0]))
            names.append(n)
        best, prev = step, names
    return max(best, key=lambda x: x[0])[1]


def joined(head: str, tail: str, before: str, confusions: dict[str, list[tuple[str, float]]], counts: Counts) -> tuple[str, int, int]:
    """``(word, joined, misread)`` of a word broken as ``head-`` and ``tail``: the likelier of the whole word, a reading of it, and the compound.

    The compound counts as likely as itself or as its two parts after each other, the whole word as itself.
    """
    whole, kept = head + tail, f"{head}-{tail}"
    (fixed,), n = decode_line([whole], confusions, counts)
    p = lambda w: math.log((counts.word(norm(core(w))) + 0.01) / counts.total)
    compound = max(p(kept), p(head.rsplit("-", 1)[-1]) + p(tail))
    if max(p(fixed), p(whole)) >= compound:
        return fixed, 1, n
    return kept, 0, 0


_AUTHOR_HEAD = re.compile(r"[^\W\d_][\w'’|$@-]+(?: [A-Z]\.)*,? et al\.?", re.I)


def _loose(a: str, b: str, counts: Counts) -> bool:
    """Whether the corpus gives no reason to read ``b`` right after ``a``."""
    a, b = norm(core(a)), norm(core(b))
    n = counts.pair(a, b) - 1
    return n < 2 or n < 0.01 * counts.word(a)


def _header(line: str, before: str, after: str, gap: bool, confusions: dict, counts: Counts) -> bool:
    """Whether a line is a running header: it has a header's form, or it interrupts a sentence."""
    s = line.strip()
    # neither a number at an end nor a capital at the start, or the end of a sentence: no form of a header
    if not s[0].isdigit() and not s[-1].isdigit() and (s[0].islower() or s[-1] in "?!;:," or s[-1] == "." and s[-3:].lower() != "al."):
        return False
    bare = _EDGE.sub("", s).strip()
    letters = [x for x in bare if x.isalpha() or x in "|$@"]
    if not 3 < len(s) < 90 or len(letters) < 4 or "\t" in s:
        return False
    numbered = bare != s
    if _SECTION.match(s) and not numbered:
        return False
    caps = sum(x.isupper() or x in "|$@" for x in letters) / len(letters)
    if _AUTHOR_HEAD.fullmatch(bare) and bare[0].isupper():
        return True
    if caps > 0.85 and re.search(r"\bVOL\. ?\S+$", bare):
        return True
    table = re.search(r"\S {2,}\S|\t", before) or re.search(r"\S {2,}\S|\t", after)
    if numbered and re.search(r"\S {2,}\S", s) and bare[0].isupper() and len(letters) > 8 and not table:
        return True
    if re.search(r"\bVol\. ?\d+$", bare) and bare[0].isupper() and " " in bare:
        return numbered or not gap
    if bare[-1] in ".?!;:," or not bare[0].isupper() or gap and not numbered or len(bare.split()) < 2:
        return False
    if caps > 0.85 and len(letters) >= 10:
        return True
    words = bare.split()
    cut = before and before[-1] not in ".?!:" or after[:1].islower()
    if not cut and not numbered:
        return False
    if before and not _loose(before.split()[-1], words[0], counts) or after and not _loose(words[-1], after.split()[0], counts):
        return False
    if counts.line(line_key(bare)) >= 5:
        return True
    clean, n = decode_line(words, confusions, counts)
    return n > 0 and counts.line(line_key(" ".join(clean))) >= 5


def repair(text: str, confusions: dict[str, list[tuple[str, float]]], counts: Counts) -> tuple[str, int, int, int]:
    """``(paragraphs, words joined, words corrected, header and page lines removed)``."""
    raw = text.split("\n")
    odd = odd_ones(text.split(), confusions, counts)
    keep: list[str] = []
    n_joined = fixed = 0
    lines = [x for x in raw if not x.strip() or len(x) > 40 or not _PAGE.fullmatch(x)] if len(raw) > 1 else raw
    removed = len(raw) - len(lines)
    for k, line in enumerate(lines):
        if line.strip():
            before = lines[k - 1] if k else ""
            after = lines[k + 1] if k + 1 < len(lines) else ""
            gap = (not before.strip() and k > 0) or (not after.strip() and k < len(lines) - 1)
            if _header(line, before.strip(), after.strip(), gap, confusions, counts):
                removed += 1
                continue
        keep.append(line.rstrip())
    paragraphs: list[str] = []
    current: list[str] = []

    def close() -> None:
        if current:
            paragraphs.append(" ".join(current))
            current.clear()

    for line in keep:
        s = line.strip()
        if not s:
            close()
            paragraphs.append("")
            continue
        if _STRUCT.search(line) or len(s) < 70 and _SECTION.match(line):
            close()
            paragraphs.append(line)
            continue
        tokens = s.split()
        if odd:
            tokens, n = decode_line(tokens, confusions, counts)
            fixed += n
        if current and current[-1][-1] in _BREAKS:
            last, _, rest = current[-1].rpartition(" ")
            head = rest[:-1]
            if head and (rest[-1] in "­¬" or head[-1].isalpha() and tokens[0][:1].isalpha() and tokens[0][:1].islower()):
                if rest[-1] in "­¬":
                    (merged,), m = decode_line([head + tokens[0]], confusions, counts)
                    j = 1
                else:
                    merged, j, m = joined(head, tokens[0], last, confusions, counts)
                n_joined += j
                fixed += m
                current[-1] = f"{last} {merged}" if last else merged
                if tokens[1:]:
                    current.append(" ".join(tokens[1:]))
                continue
        current.append(" ".join(tokens))
    close()
    out = re.sub(r"\n{3,}", "\n\n", "\n".join(paragraphs)).strip("\n")
    return out, n_joined, fixed, removed


def repair_scans(chunks: DataFrame, proofs: DataFrame | None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``chunk_id, text, n_joined, n_misread, n_removed`` for every row with a text.

    ``text`` is the repaired text as paragraphs; the counts are the words joined over a line end, the
    words corrected and the header and page number lines removed: 0, 0, 0 for a clean row. Null texts
    give no row, an empty text an empty one; repeated rows are repaired each for itself; other columns
    are ignored. Words and pairs are counted over the distinct texts and over all rows, lines over the texts,
    into tables of fixed size (26 MB) that are broadcast with the words of a share of ``SHARE``; the repair is a narrow map over all rows, whose work beyond
    splitting is done once for every distinct token of a task.
    """
    spark = chunks.sparkSession
    model = fit_confusions(chunks, proofs, id_col, text_col) if proofs is not None else {(r, p): math.log(1 / len(CONFUSIONS)) + MISREAD for p, r in CONFUSIONS}
    by_read: dict[str, list[tuple[str, float]]] = {}
    for (read, printed), lp in model.items():
        by_read.setdefault(read, []).append((printed, lp))
    shared = spark.sparkContext.broadcast((by_read, *fit_counts(chunks, text_col)))
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        confusions, tables, frequent = shared.value
        counts = counts_of(tables, frequent)
        for b in batches:
            out = [(i, *repair(t, confusions, counts)) for i, t in zip(b["chunk_id"], b["text"])]
            yield pd.DataFrame(out, columns=["chunk_id", "text", "n_joined", "n_misread", "n_removed"])

    return rows.mapInPandas(run, f"chunk_id {kind}, text string, n_joined int, n_misread int, n_removed int")


def scanned(repaired: DataFrame) -> DataFrame:
    """``chunk_id`` of the rows in which noise of scanning was found."""
    return repaired.where("n_joined + n_misread + n_removed > 0").select("chunk_id")
