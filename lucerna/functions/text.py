"""JVM-side text expressions shared by the operators."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for "no value".
STAND_INS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "undefined", "unknown", "missing", "not available")


def nonblank(c: Column) -> Column:
    """True where the string is neither null nor blank."""
    return c.isNotNull() & (F.trim(c) != "")


def squeeze(c: Column) -> Column:
    """Collapse every run of Unicode white space to one blank and strip the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def present(c: Column) -> Column:
    """The squeezed value, or null where it is blank or a stand-in for a missing value."""
    s = squeeze(c)
    return F.when(F.lower(s).isin(*STAND_INS), None).otherwise(s)


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """Precomposed Latin letters of U+00C0..U+024F and U+1E00..U+1EFF with their bare letters, by decomposition."""
    a, b = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != chr(cp):
            a.append(chr(cp))
            b.append(bare)
    return "".join(a), "".join(b)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    src, dst = accent_pairs()
    return F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), src, dst))


def words(c: Column) -> Column:
    """Lower-case word tokens (letters, digits, underscore) as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
