"""Source text as token segments: the ground the endpoint extractors stand on.

A file becomes an array of tokens by one expression (comments go, strings stay whole), the
tokens become rows, and two running counts per file give the bracket depth and the statement that a
token belongs to. Statements come back as short arrays of (text, depth), so everything after that -
calls, argument lists over several lines, decorators, keyword arguments - is array work inside a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmill.session import spread

_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_NAME, _NUMBER = r"[\p{L}_$][\w$]*+", r"\d[\w.]*+"
_SLASHED = r"//[^\n]*+|(?s:/\*.*?\*/)"

#: (comments, strings, statement ends, brackets whose inside never ends a statement) of each language.
LANGUAGES = {
    "python": (r"#[^\n]*+|\\\r?\n", r"[rRbBuUfF]{0,2}(?:(?s:" + r'""".*?"""' + r"|'''.*?''')|" + _QUOTED + ")", ["\n"], ("([{", ")]}")),
    "script": (_SLASHED, r"`[^`\\]*+(?:\\.[^`\\]*+)*+`|" + _QUOTED, ["{", "}", ";"], ("([", ")]")),
    "go": (_SLASHED, "`[^`]*+`|" + _QUOTED, ["{", "}", ";", "\n"], ("([", ")]")),
}


def segments(corpus: DataFrame, language: str) -> DataFrame:
    """(repository, path, seg, ts): the statements of each file in order, ``ts`` an array of
    (t: token, d: depth). A bracket has the depth outside of it; a statement keeps the token that
    ends it, except a line end."""
    comment, string, ends, (opening, closing) = LANGUAGES[language]
    kinds = [comment, string, _NAME, _NUMBER, ":=", "=>", *([r"\n"] if "\n" in ends else []), r"[^\s]"]
    found = F.regexp_extract_all("content", F.lit("|".join(kinds)), F.lit(0))
    files = spread(corpus.select("repository", "path", "content"))
    rows = files.select("repository", "path", F.posexplode(found).alias("pos", "t")).filter(~F.col("t").rlike(rf"^(?:{comment})$") | F.col("t").isin(*ends))
    w = Window.partitionBy("repository", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("t").isin(*opening).cast("int"), F.col("t").isin(*closing).cast("int")
    rows = rows.withColumn("d", F.sum(opens - closes).over(w) - opens)
    end = (F.col("t").isin(*ends) & (F.col("d") <= 0)).cast("int")
    rows = rows.withColumn("seg", F.sum(end).over(w) - end).filter(F.col("t") != "\n")
    cells = F.sort_array(F.collect_list(F.struct("pos", "t", "d")))
    grouped = rows.groupBy("repository", "path", "seg").agg(cells.alias("c"))
    return grouped.select("repository", "path", "seg", F.transform("c", lambda x: F.struct(x["t"], x["d"])).alias("ts"))


def tok(ts: Column, i: Column | int) -> Column:
    """Token text at a 0-based place; null outside of the array."""
    return F.get(ts, F.lit(i) if isinstance(i, int) else i)["t"]


def depth(ts: Column, i: Column | int) -> Column:
    return F.get(ts, F.lit(i) if isinstance(i, int) else i)["d"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def places(ts: Column, test: Callable[[Column], Column]) -> Column:
    """The places (0-based) that pass a test."""
    return F.filter(F.sequence(F.lit(0), F.size(ts) - 1), test)


def close_of(ts: Column, i: Column) -> Column:
    """Place of the bracket that closes the one at ``i`` (the end of the statement, if none does)."""
    # the place is worked out once, not for every cell it is held against
    found = let(i, lambda p: let(depth(ts, p), lambda d: F.array_min(places(ts, lambda j: (j > p) & (depth(ts, j) == d) & tok(ts, j).isin(")", "]", "}")))))
    return F.coalesce(found, F.size(ts))


def inside(ts: Column, i: Column) -> Column:
    """The cells between the bracket at ``i`` and the one that closes it."""
    return let(i, lambda p: F.slice(ts, p + 2, F.greatest(close_of(ts, p) - p - 1, F.lit(0))))


def text_of(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda x: x["t"]), "")


def is_string(t: Column) -> Column:
    return t.rlike("^[A-Za-z]{0,2}[\"'`]")


def unquote(t: Column) -> Column:
    return F.regexp_replace(t, "^[A-Za-z]{0,2}(?:\"\"\"|'''|[\"'`])|(?:\"\"\"|'''|[\"'`])$", "")


def strings(ts: Column) -> Column:
    """The string literals among cells, without their quotes."""
    return F.transform(F.filter(F.transform(ts, lambda x: x["t"]), is_string), unquote)


def keyword(ts: Column, name: str, sign: str = "=") -> Column:
    """Value of the first ``name = 'text'`` (or ``name: 'text'``) among cells; null without one."""
    return let(ts, lambda v: unquote(tok(v, F.get(places(v, lambda i: (tok(v, i) == name) & (tok(v, i + 1) == sign) & is_string(tok(v, i + 2))), F.lit(0)) + 2)))


def calls(ts: Column, names: Sequence[str], test: Callable[[Column], Column] | None = None) -> Column:
    """Places of ``name(`` for any of the names (and a further test of the place)."""
    return places(ts, lambda i: tok(ts, i).isin(*names) & (tok(ts, i + 1) == "(") & (test(i) if test else F.lit(True)))


def first_argument(ts: Column, i: Column) -> Column:
    """Text of the first argument of the call whose name is at ``i``."""
    def cut(args: Column) -> Column:
        comma = F.get(places(args, lambda j: (tok(args, j) == ",") & (depth(args, j) == depth(args, 0))), F.lit(0))
        return text_of(F.slice(args, 1, F.coalesce(comma, F.size(args))))

    return let(inside(ts, i + 1), cut)
