"""Full-text search on a positional postings table.

``postings`` holds one row per (term, document) with the term's places in it. It is written once
(each file sorted by term, so a query reads the pages of its own terms only) and answers boolean and
phrase queries by one grouping of those few rows per document; the texts are not scanned again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.functions.source_code import let
from opsmill.operators.documents import tokens
from opsmill.session import spread


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, places): every term of every text with its 1-based places in order.

    The words of a text are sorted and cut into terms inside its row; only rows of one key given several
    times meet in a shuffle."""
    words = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("t")).select(
        key, F.sort_array(F.transform("t", lambda w, i: F.struct(w.alias("term"), (i + 1).alias("i")))).alias("c"))
    c = F.col("c")
    firsts = F.filter(F.transform(c, lambda x, i: F.when((i == 0) | (x["term"] != F.get(c, i - 1)["term"]), i)), lambda i: i.isNotNull())

    def terms(at: Column) -> Column:
        return F.transform(at, lambda a, n: F.struct(F.get(c, a)["term"].alias("term"), F.transform(
            F.slice(c, a + 1, F.coalesce(F.get(at, n + 1), F.size(c)) - a), lambda x: x["i"]).alias("places")))

    own = words.select(key, F.explode(let(firsts, terms)).alias("p")).select("p.term", key, "p.places")
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").isEmpty():
        return own
    return own.groupBy("term", key).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))  # the places of one term under one key


def write_postings(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Postings as files sorted by term; a term that is in a third of all documents spans several files. Rows go to
    their files by hash: ranges would have to be found by a pass over all words before the one that writes them."""
    postings(docs, key, text).repartition("term", key).sortWithinPartitions("term", key).write.parquet(path)


class Query:
    """A search condition: words, ``&``, ``|``, ``!``, ``<->`` (next word), ``<n>`` (n words on) and brackets."""

    def __init__(self, kind: str, parts: tuple = (), word: str = "", gap: int = 1):
        self.kind, self.parts, self.word, self.gap = kind, parts, word, gap

    def words(self) -> list[str]:
        return [self.word] if self.kind == "word" else sorted({w for p in self.parts for w in p.words()})

    def without_hits(self) -> bool:
        """Whether a document that has none of the words matches."""
        if self.kind in ("word", "then"):
            return False
        if self.kind == "not":
            return not self.parts[0].without_hits()
        return (all if self.kind == "and" else any)(p.without_hits() for p in self.parts)

    def places(self, at: Column) -> Column:
        """Places of the last word of each occurrence, from a map of words to places."""
        none = F.array().cast("array<int>")
        if self.kind == "word":
            return F.coalesce(at[self.word], none)
        if self.kind == "or":
            return F.array_distinct(F.flatten(F.array(*[p.places(at) for p in self.parts])))
        if self.kind == "then":
            before, last = self.parts
            return F.filter(last.places(at), lambda i: F.array_contains(before.places(at), i - self.gap))
        raise ValueError("only words, | and <-> can stand in a phrase")

    def holds(self, at: Column) -> Column:
        if self.kind == "not":
            return ~self.parts[0].holds(at)
        if self.kind in ("and", "or"):
            out = self.parts[0].holds(at)
            for p in self.parts[1:]:
                out = out & p.holds(at) if self.kind == "and" else out | p.holds(at)
            return out
        return F.size(self.places(at)) > 0


def parse(text: str) -> Query:
    """``<->`` binds closest, then ``!``, ``&`` and ``|``; words are lower-cased."""
    parts = re.findall(r"<->|<\d+>|[&|!()]|[^\s&|!()<>]+", text.lower())
    at = 0

    def level(sign: str, below) -> Query:
        nonlocal at
        found = [below()]
        while at < len(parts) and parts[at] == sign:
            at += 1
            found.append(below())
        return found[0] if len(found) == 1 else Query("and" if sign == "&" else "or", tuple(found))

    def negated() -> Query:
        nonlocal at
        if at < len(parts) and parts[at] == "!":
            at += 1
            return Query("not", (negated(),))
        return phrase()

    def phrase() -> Query:
        nonlocal at
        out = single()
        while at < len(parts) and parts[at].startswith("<"):
            gap = 1 if parts[at] == "<->" else int(parts[at][1:-1])
            at += 1
            out = Query("then", (out, single()), gap=gap)
        return out

    def single() -> Query:
        nonlocal at
        if at >= len(parts) or parts[at] in "&|)":
            raise ValueError(f"a word is missing in {text!r}")
        at += 1
        if parts[at - 1] == "(":
            out = any_of()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"missing ) in {text!r}")
            at += 1
            return out
        return Query("word", word=parts[at - 1])

    def any_of() -> Query:
        return level("|", lambda: level("&", negated))

    out = any_of()
    if at < len(parts):
        raise ValueError(f"unexpected {parts[at]!r} in {text!r}")
    return out


def search(index: DataFrame, query: str, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, hits) of the documents that match; ``hits`` is the number of places of all query words.

    ``docs`` (the ids) is needed for a condition that documents without any of its words meet, such as
    ``a | !c``. Documents without words are then matched too."""
    q = parse(query)
    if q.without_hits() and docs is None:
        raise ValueError("this condition also holds for documents without its words: their ids are needed")
    own = index.filter(F.col("term").isin(q.words()))
    per = own.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))  # at most a row a word
    hits = F.aggregate(F.map_values("at"), F.lit(0), lambda n, p: n + F.size(p))
    found = per.filter(q.holds(F.col("at"))).select(key, hits.cast("long").alias("hits"))
    if not q.without_hits():
        return found
    rest = docs.select(key).distinct().join(per.select(key), key, "left_anti").select(key, F.lit(0).cast("long").alias("hits"))
    return found.unionByName(rest)
