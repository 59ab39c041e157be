"""HTML and TeX sources to sectioned prose."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())]))),
])
_DROP = frozenset("script style nav header footer aside noscript button form svg iframe object template".split())
_BLOCK = frozenset("p div section article ul ol li table tr figure figcaption blockquote br hr pre h1 h2 h3 h4 h5 h6".split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.cells: list[str] | None = None
        self.math = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROP:
            self.skip += 1
        if self.skip:
            return
        if tag == "math":
            alt = dict(attrs).get("alttext")
            self.math += 1
            if alt:
                self.out.append(f"${alt}$")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("td", "th"):
            self.out.append("\t" if self.out and not self.out[-1].endswith(("\n", "\t")) else "")
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROP:
            self.skip = max(0, self.skip - 1)
        elif tag == "math":
            self.math = max(0, self.math - 1)
        elif not self.skip and (tag in _BLOCK and tag != "br"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip and not self.math:
            self.out.append(re.sub(r"\s+", " ", data))


def sections_of(text: str) -> list[tuple[int, int, str]]:
    """``char_start, level, title`` of the ``#`` headings of a clean text."""
    return [(m.start(), len(m.group(1)), m.group(2).strip()) for m in re.finditer(r"(?m)^(#{1,6}) +(.+)$", text)]


def html_to_text(html: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Prose of a page: navigation, scripts and styles dropped, mathematics as ``$…$``, headings marked, tables tab-separated."""
    r = _Reader()
    r.feed(html)
    r.close()
    text = re.sub(r"[^\S\n\t]+", " ", "".join(r.out))
    text = re.sub(r" *\n[ \t]*", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return text, sections_of(text)


#: Depth of the headings.
_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


#: Commands whose argument is dropped, and those whose argument stays.
_GONE = frozenset("footnote thanks label bibliography bibliographystyle vspace hspace pagestyle input include usepackage newcommand".split())
_STAY = frozenset("textbf textit emph texttt textrm textsc textsf mbox text underline title caption".split())
#: Environments that stay marked as mathematics.
_MATHS = frozenset("equation equation* align align* eqnarray eqnarray*".split())


class _Tex:
    """One pass over a TeX source: commands are read with their bracketed arguments, braces matched."""

    def __init__(self, source: str):
        self.s, self.at, self.out = source, 0, []

    def group(self, opening: str = "{", closing: str = "}") -> str | None:
        """The argument that starts here, without its brackets."""
        k = self.at
        while k < len(self.s) and self.s[k] in " \t":
            k += 1
        if k >= len(self.s) or self.s[k] != opening:
            return None
        depth, begin = 0, k + 1
        while k < len(self.s):
            c = self.s[k]
            if c == "\\":
                k += 2
                continue
            depth += (c == opening) - (c == closing)
            k += 1
            if depth == 0:
                self.at = k
                return self.s[begin : k - 1]
        return None

    def command(self) -> None:
        m = re.compile(r"\\([A-Za-z]+)\*?|\\(.)", re.S).match(self.s, self.at)
        if m is None:
            self.at += 1
            return
        self.at = m.end()
        name = m.group(1)
        if name is None:
            self.out.append(" " if m.group(2) in " ,;!" else "\n" if m.group(2) == "\\" else m.group(2))
            return
        while name not in ("begin", "end") and self.group("[", "]") is not None:
            pass
        if name in _LEVELS:
            self.out.append(f"\n\n{'#' * _LEVELS[name]} {tex_body(self.group() or '')}\n")
        elif name.startswith("cite"):
            self.out.append(f"[CITE: {self.group() or ''}]")
        elif name.endswith("ref"):
            self.out.append(f"[REF: {self.group() or ''}]")
        elif name in _GONE:
            self.group()
        elif name in _STAY:
            self.out.append(tex_body(self.group() or ""))
        elif name in ("begin", "end"):
            kind = self.group() or ""
            if kind == "thebibliography":
                close = self.s.find("\\end{thebibliography}", self.at)
                self.at = len(self.s) if close < 0 else close + len("\\end{thebibliography}")
            elif kind in _MATHS:
                self.out.append(f"\\{name}{{{kind}}}")
            else:
                self.group("[", "]")
                self.out.append("\n")
        else:
            self.out.append(m.group())

    def run(self) -> str:
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "\\":
                self.command()
            elif c == "%":
                end = self.s.find("\n", self.at)
                self.at = len(self.s) if end < 0 else end
            else:
                stop = min((k for k in (self.s.find("\\", self.at + 1), self.s.find("%", self.at + 1)) if k >= 0), default=len(self.s))
                self.out.append(self.s[self.at : stop].replace("~", " "))
                self.at = stop
        return "".join(self.out)


def tex_body(source: str) -> str:
    return _Tex(source).run()


def tex_to_text(tex: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Prose of a TeX source: the document body without bibliography, comments, labels and footnotes; citations and references as marks."""
    begin = tex.find("\\begin{document}")
    if begin >= 0:
        end = tex.find("\\end{document}", begin)
        tex = tex[begin + len("\\begin{document}") : end if end >= 0 else len(tex)]
    lines = [" ".join(x.split()) for x in tex_body(tex).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return text, sections_of(text)


def _udf(f):
    @F.pandas_udf(SECTIONED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [f(x) if x is not None else (None, None) for x in s]
        return pd.DataFrame({"text": [r[0] for r in rows], "sections": [None if r[1] is None else [{"char_start": a, "level": b, "title": c} for a, b, c in r[1]] for r in rows]})

    return run


clean_html = _udf(html_to_text)
clean_tex = _udf(tex_to_text)

#: Usual names of a main file.
MAIN_NAMES = ("ms.tex", "main.tex", "paper.tex", "manuscript.tex")


def main_tex(files: DataFrame, by: str) -> DataFrame:
    """The main TeX file of each source: 50 for a document class, 10 for a usual name, 2 for the name of its folder, 1 for every 5,000 characters up to 10; shortest path on ties."""
    parts = F.split(F.lower("path"), "/")
    name, folder = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    points = [(F.contains(F.col("content"), F.lit("\\documentclass")), 50), (name.isin(*MAIN_NAMES), 10), (F.startswith(name, folder), 2)]
    score = F.least(F.floor(F.length("content") / 5000), F.lit(10))
    for hit, n in points:
        score = score + F.when(hit, n).otherwise(0)
    w = Window.partitionBy(by).orderBy(F.desc("_s"), F.length("path"), "path")
    return files.where(F.endswith(F.lower("path"), F.lit(".tex"))).withColumn("_s", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


_INPUT = re.compile(r"\\(?:input|include|subfile)\{([^}]+)\}")


def expand_inputs(main: str, files: dict[str, str], depth: int = 8, seen: frozenset[str] = frozenset()) -> str:
    """TeX with its inputs put in place, without following cycles, ``depth`` levels at most."""
    if depth == 0:
        return main

    def put(m: re.Match) -> str:
        name = m.group(1).strip()
        key = name if name in files else f"{name}.tex"
        if key not in files or key in seen:
            return ""
        return expand_inputs(files[key], files, depth - 1, seen | {key})

    return _INPUT.sub(put, main)


def headings(c: Column) -> Column:
    """Numbered headings of a plain text as an array of titles."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^\s*\d+(?:\.\d+)*\.?\s+(\p{Lu}[^\n.]{2,80})$"), F.lit(1))
