"""Problem 2: one consistent form for text that looks the same.

Method: a compiled longest-match transducer over grapheme clusters. A table built from rules (widths,
accents, spaces, invisible characters, ligatures, look-alike letters) is checked for conflicts when it
is compiled and applied in one pass over the clusters of a text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that cannot be told from a Latin letter.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Latin and others
    "ɡ": "g", "օ": "o", "ℓ": "ℓ",
}
#: Hyphens and apostrophes drawn alike.
PUNCTUATION = {"‐": "-", "‑": "-", "ʼ": "’", "µ": "μ", "․": ".", "꞉": ":"}
#: Letters that carry meaning of their own and may never be rewritten.
PROTECTED = frozenset("αβγδεζηθλμξπρστφχψωΓΔΘΛΞΠΣΦΨΩ²³¹ß")
MARKS = [chr(c) for c in [*range(0x300, 0x315), 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331]]


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵" or "︀" <= ch <= "︎"


@lru_cache(maxsize=1)
def compile_table() -> dict[str, str]:
    """Cluster → canonical text, built from rules; raises where two rules disagree or a result is not final."""
    table: dict[str, str] = {}

    def rule(src: str, dst: str) -> None:
        if src == dst:
            return
        if src in PROTECTED:
            raise ValueError(f"rule rewrites protected {src!r}")
        if table.setdefault(src, dst) != dst:
            raise ValueError(f"conflict on {src!r}: {table[src]!r} and {dst!r}")

    for cp in range(0xFF01, 0xFF5F):
        rule(chr(cp), chr(cp - 0xFEE0))
    for cp in range(0x3001):
        if unicodedata.category(chr(cp)) == "Zs" or chr(cp) in "\t\n\r\f\v  ":
            rule(chr(cp), " ")
    for cp in [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)]:
        rule(chr(cp), unicodedata.normalize("NFKC", chr(cp)))
    for cp in (0x212A, 0x212B, 0x2126, 0x1FBE):
        rule(chr(cp), unicodedata.normalize("NFC", chr(cp)))
    for src, dst in PUNCTUATION.items():
        rule(src, dst)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    for base in letters:
        for mark in MARKS:
            whole = unicodedata.normalize("NFC", base + mark)
            if len(whole) == 1:
                rule(base + mark, whole)
    for src, dst in table.items():
        if any(ch in table for ch in dst):
            raise ValueError(f"{src!r} does not reach a final form")
    return table


@lru_cache(maxsize=1)
def compile_look_alikes() -> dict[str, str]:
    """Look-alike → Latin letter, with its accented forms; conflict-checked against the table."""
    table, out = compile_table(), {}
    for src, dst in LOOK_ALIKES.items():
        if src in PROTECTED or src in table or dst in LOOK_ALIKES and dst != src:
            raise ValueError(f"look-alike {src!r} conflicts")
        if src == dst:
            continue
        out[src] = dst
        for mark in MARKS:
            whole, latin = unicodedata.normalize("NFC", src + mark), unicodedata.normalize("NFC", dst + mark)
            if len(whole) == 1 and len(latin) == 1:
                if out.setdefault(whole, latin) != latin:
                    raise ValueError(f"look-alike {whole!r} conflicts")
    return out


_JOINS = "‌‍"
_CLUSTER = re.compile(r"(?s).(?:[̀-ͯ᪰-᫿᷀-᷿⃐-⃿­​-‏‪-‮⁠-⁯︀-️﻿\U000e0100-\U000e01ef])*")
_LATIN = re.compile("[A-Za-zＡ-Ｚａ-ｚ]")
_PLAIN = re.compile(r"[!-~]+(?: [!-~]+)*")


def canonical(text: str) -> str:
    """The consistent form; applying it twice changes nothing."""
    if _PLAIN.fullmatch(text):
        return text
    table, alike = compile_table(), compile_look_alikes()
    latin_text = _LATIN.search(text) is not None
    out: list[str] = []
    word: list[str] = []

    def close() -> None:
        if not word:
            return
        kinds = [c for c in word if c in alike]
        if kinds:
            latin = any(x.isalpha() and ord(x) < 0x250 or "Ḁ" <= x <= "ỿ" for c in word for x in c)
            plain = [c for c in word if c.isalpha()]
            symbol = latin_text and len(plain) <= 3 and all(c in alike or c in PROTECTED for c in plain)
            if latin or symbol or all(c in alike for c in plain):
                word[:] = [alike.get(c, c) for c in word]
        out.extend(word)
        word.clear()

    for m in _CLUSTER.finditer(text):
        c = m.group()
        if len(c) > 1:
            keep = _JOINS if "؀" <= c[0] <= "෿" or c[0] > "\U0001f000" else ""
            head = c[0] if not _invisible(c[0]) else ""
            c = head + "".join(x for x in c[1:] if x in keep or not _invisible(x))
        elif _invisible(c):
            c = ""
        if not c:
            continue
        got = table.get(c)
        if got is None and len(c) > 1:
            first = alike.get(c[0]) or table.get(c[0], c[0])
            got = unicodedata.normalize("NFC", first + c[1:]) if first != " " else c
        elif got is None:
            got = c if c < "̀" else unicodedata.normalize("NFC", c)
        if got == " ":
            close()
            if out and out[-1] != " ":
                out.append(" ")
        elif got.isalpha() or unicodedata.combining(got[-1]):
            word.extend(got) if len(got) > 1 and got.isalpha() else word.append(got)
        else:
            close()
            out.append(got)
    close()
    while out and out[-1] == " ":
        out.pop()
    return "".join(out)


@F.pandas_udf(T.StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else canonical(t))


def canonical_col(c: Column) -> Column:
    """``canonical`` as a column; text of plain ASCII with single blanks never leaves the JVM."""
    plain = c.rlike(r"\A[!-~]+( [!-~]+)*\z")
    return F.when(plain, c).otherwise(_canonical_udf(F.when(~plain, c)))


def with_canonical(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of a text column; null stays null, empty stays empty."""
    return df.withColumn(out_col, canonical_col(F.col(text_col)))


def same_looking(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str = "title", right_text: str = "title") -> DataFrame:
    """``(left_id, right_id)`` of rows whose texts differ as strings but not to a reader.

    Each distinct string is rewritten once; strings meet on a hash of their canonical form and are
    compared in full. Null and blank texts match nothing; repeated rows give their pairs once. Strings
    stored many times are joined as one representative and its rows are added afterwards, and AQE
    splits a form that holds a third of the rows.
    """
    def forms(df: DataFrame, i: str, t: str, as_id: str, as_text: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(F.col(i).alias(as_id), F.col(t).alias(as_text)).where(F.trim(as_text) != "").distinct()
        return rows, rows.select(as_text).distinct().withColumn(f"{as_text}_form", canonical_col(F.col(as_text)))

    lrows, lforms = forms(left, left_id, left_text, "lid", "lt")
    rrows, rforms = forms(right, right_id, right_text, "rid", "rt")
    pairs = lforms.join(rforms, F.col("lt_form") == F.col("rt_form")).where("lt <> rt").select("lt", "rt")
    return lrows.join(pairs, "lt").join(rrows, "rt").select(F.col("lid").alias(left_id + "_l"), F.col("rid").alias(right_id + "_r")).toDF("left_id", "right_id")
