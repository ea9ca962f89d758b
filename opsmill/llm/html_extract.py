"""Operator 4: main-text extraction with a tree-structured graphical model over the DOM.

A page becomes a tree: elements, and text blocks (the text between two block-level tags).
Every node has a hidden state: away (menus and the like), mixed (a wrapper) or content; a
block is one of the outer two. A node's own evidence is a naive-Bayes log-odds of its features:
for elements the tag, the tokens of class, id and role as a whole, and the part that a compound
token names (``site-nav`` names a nav; ``has-sidebar`` names nothing); for blocks the length, the share
of linked text, the sentence marks, the place in the page and how many short blocks stand beside it in
the same way. A 3 x 3 potential connects each node with its parent. Sum-product messages go up from the
leaves and down from the root, level by level for all pages of a slice at once, and give each node's
marginal. The text blocks whose marginal is content, in page order, are the main text.

Evidence and potentials are learned from labelled pages: pages that mark their own main part with
<article> or <main> (a bounded sample), where a block is content if it stands in that part and in no
part named as a menu, header, footer, sidebar, notice, advert, form or comments. Pages of one template (the
same set of tags and names) say the same thing, so what they say is averaged: counts are numbers
of templates. They are added to prior counts worth ``PRIOR`` templates for the few tags and
names that HTML and common usage define, so a sample of one template leaves those in force and a
sample of many overrules them. A <header> inside the article belongs to it; any other does not.
Scripts, styles, form controls and other elements without running text are never read. An
unclosed one ends with its parent, or where a block-level element starts; a head ends where
the first text or element starts that cannot stand in it.

Defined results: a null or empty page, or one without a content block, has an empty text;
unclosed and unmatched tags never fail (an element ends with its parent); a page of any
size is read as a whole; repeated rows each get a row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A

SAMPLE_PAGES = 2000
SLICE = 1 << 20
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PIECE = re.compile(r"[a-z]+")
#: Elements whose content is not running text.
SILENT = frozenset("script style noscript template head title iframe object svg canvas select option button textarea datalist video audio map".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math maction annotation annotation-xml menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
                   "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that an opening tag closes implicitly, up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an unclosed element without running text cannot hold, and what a head holds besides RAW.
BLOCK = ENDS_P | frozenset("caption dd dt li tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta".split())
#: Tags of elements without running text, outside comments and raw elements.
SCOPE = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?</\1\s*>|<(/?)({'|'.join(sorted(SILENT - RAW))})(?=[\s/>])", re.S | re.I)
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer form body blockquote".split())
MAIN = ("article", "main")
#: Names of parts that are not the article, by kind, and of parts that are.
AWAY = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager share sharing social header masthead banner footer copyright contentinfo sidebar aside complementary "
                 "widget cookie cookies consent notice notices alert popup modal overlay ad ads advert adverts advertisement sponsor sponsored promo promotion form signup subscribe newsletter "
                 "search login comment comments commentlist reply replies respond disqus discussion".split())
HERE = frozenset("article main content post entry story articlebody maincontent article-body article-content entry-content main-content page-content post-body post-content story-body".split())
#: First parts of compound names that say what a part has or belongs to, not what it is, and last parts that say nothing.
ABOUT = frozenset("has have with without no not is hide show category tag type format by in on for js".split())
SHAPES = frozenset("area bar block box container group inner item items list section wrap wrapper".split())
WRAPPERS = frozenset("div section center table tbody tr td ul ol li dl".split())
AWAY_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
#: States of a node.
AWAY_STATE, MIXED, CONTENT = range(3)
#: Strength of prior counts in templates, of a <header> (its place decides), what they leave for the
#: other states, and the smoothing of features without a prior.
PRIOR, HEADER_PRIOR, REST, SMOOTH = 40.0, 10.0, 0.02, 4.0
#: Most that one element's feature may say, and a block's features for content and, besides its links, against it.
ELEMENT_RANGE, FOR_CONTENT, AGAINST_CONTENT = 8.0, 1.0, 1.0
#: Pseudo-counts of (parent, child) states: parts that are away hold hardly anything else, content
#: parts hold little else, mixed parts hold anything.
PAIR_PRIOR = ((2000.0, 20.0, 8.0), (90.0, 70.0, 40.0), (120.0, 2.0, 2000.0))
SHORT = 40


class Page:
    """Nodes of one page in document order: parent index, features, text and depth."""

    __slots__ = ("parent", "features", "text", "depth", "main", "away", "linked")

    def __init__(self):
        self.parent, self.features, self.text, self.depth, self.main, self.away, self.linked = [0], [["tag=root"]], [None], [0], [False], [False], [0]

    def add(self, parent: int, features: list[str], text: str | None, main: bool, away: bool, linked: int = 0) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.depth.append(self.depth[parent] + 1)
        self.main.append(main)
        self.away.append(away)
        self.linked.append(linked)
        return len(self.parent) - 1


def _names(attributes: str) -> list[str]:
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        out += (m[2] or m[3] or m[4] or "").lower().split()
    return out


def named_part(name: str) -> str | None:
    """The kind of part that a class or id token names, if it is one of ``AWAY``."""
    if name in AWAY:
        return name
    pieces = PIECE.findall(name)
    if len(pieces) < 2 or pieces[0] in ABOUT:
        return None
    while len(pieces) > 1 and pieces[-1] in SHAPES:
        pieces.pop()
    return pieces[-1] if pieces[-1] in AWAY else None


def _block_features(text: str, linked: int) -> list[str]:
    n = len(text)
    size = min(n.bit_length(), 12)
    stops = sum(text.count(c) for c in ".!?。！？")
    return ["tag=#text", f"size={size}", f"linked={min(4 * linked // max(n, 1), 4)}", f"stops={min(stops, 4)}"]


def _place_features(page: "Page") -> None:
    """Add to each block its place in the page, the number of short blocks that stand as it does, and, inside a part
    that is named (as away, or as the article), the number of the part's blocks: against the name they speak
    with one voice, however many. An element around a single other one says nothing by its tag."""
    n = len(page.parent)
    children, part, inside, kind = [0] * n, [0] * n, [0] * n, [""] * n
    for i in range(1, n):
        up = page.parent[i]
        children[up] += 1
        if page.text[i] is None:
            tag = page.features[i][0][4:]
            if tag in AWAY_TAGS or any(f.startswith("part=") for f in page.features[i]):
                kind[i] = "voices_away"
            elif tag in MAIN or any(f[5:] in HERE for f in page.features[i][1:]):
                kind[i] = "voices_here"
        part[i] = i if kind[i] else part[up]
        inside[part[i]] += page.text[i] is not None
    for i in range(1, n):
        if page.text[i] is None and children[i] == 1 and page.features[i][0][4:] in WRAPPERS and page.features[i + 1][0] != "tag=#text":
            page.features[i] = ["tag=-", *page.features[i][1:]]
    blocks = [i for i, t in enumerate(page.text) if t is not None]

    def way(i: int) -> tuple[int, str]:
        up = page.parent[i]
        return page.parent[up], page.features[up][0]

    short: dict[tuple[int, str], int] = {}
    for i in blocks:
        if len(page.text[i]) < SHORT:
            short[way(i)] = short.get(way(i), 0) + 1
    for k, i in enumerate(blocks):
        page.features[i].append("place=only" if len(blocks) == 1 else "place=first" if k == 0 else "place=last" if k == len(blocks) - 1 else "place=within")
        if part[i]:
            page.features[i].append(f"{kind[part[i]]}={inside[part[i]]}")
        page.features[i].append(f"alike={min(short.get(way(i), 0), 4) if len(page.text[i]) < SHORT else 0}")


def _closed(source: str) -> set[int]:
    """Places of the tags in ``SILENT`` that have a closing tag of their own."""
    open_at: dict[str, list[int]] = {}
    out = set()
    for m in SCOPE.finditer(source):
        if m[3]:
            places = open_at.setdefault(m[3].lower(), [])
            if not m[2]:
                places.append(m.start())
            elif places:
                out.add(places.pop())
    return out


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # open non-inline elements: tag, node
    inner: list[tuple[str, int]] = []  # open inline elements: tag, open non-inline elements
    silent: list[tuple[str, bool]] = []  # an element without running text and those in it: tag, has a closing tag
    with_end: set[int] | None = None
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(htmllib.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                node = stack[-1][1]
                page.add(node, _block_features(text, min(linked, len(text))), text, page.main[node], page.away[node], linked)
        linked = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]
        while inner and inner[-1][1] > depth:
            inner.pop()

    def drop_last(tags: list, tag: str, rest: bool) -> bool:
        """Take the last ``tag`` off, with the ``rest`` after it."""
        for k in range(len(tags) - 1, -1, -1):
            if tags[k][0] == tag:
                del tags[k:len(tags) if rest else k + 1]
                return True
        return False

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[4] is not None and silent and silent[0][0] == "head" and m[4].strip():
                silent.clear()
            if m[4] is not None and not silent:
                buffer.append(m[4])
                if links:
                    linked += len(m[4])
            continue
        tag = tag.lower()
        if m[1]:  # closing
            if silent:
                if drop_last(silent, tag, True) or not any(tag == t for t, _ in (*stack, *inner)):
                    continue
                silent.clear()
            if tag in INLINE:
                drop_last(inner, tag, False)
                links = max(0, links - 1) if tag == "a" else links
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    flush()
            continue
        ended = m[3].rstrip().endswith("/")
        in_svg = tag == "svg" or any(t == "svg" for t, _ in silent)
        if ended and in_svg:
            continue
        if silent and tag not in RAW:
            if silent[0][0] == "head":
                if tag in IN_HEAD:
                    continue
                silent.clear()
            elif tag == "body" or tag in BLOCK and not any(has_end for _, has_end in silent):
                silent.clear()
            else:
                if tag not in VOID:
                    silent.append((tag, m.start() in with_end))
                continue
        if tag in RAW:  # its content is not markup
            flush()
            close_at = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close_at.end() if close_at else (end if tag in ("script", "style") else at)
            continue
        if tag in VOID:
            if tag != "wbr" and tag != "img":
                flush()
            continue
        if ended and tag in INLINE:
            continue
        if tag in SILENT:
            flush()
            with_end = _closed(source) if with_end is None else with_end
            silent.append((tag, m.start() in with_end))
            continue
        if tag in INLINE:
            inner.append((tag, len(stack)))
            links += tag == "a"
            continue
        flush()
        closed = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closed:
                close(k)
            elif stack[k][0] in CONTAINERS:
                break
        parent = stack[-1][1]
        names = list(dict.fromkeys(_names(m[3]))) if m[3] else []
        parts = list(dict.fromkeys(x for x in map(named_part, names) if x))
        main = page.main[parent] or tag in MAIN or "main" in names and "role" in m[3]
        away = page.away[parent] or tag in AWAY_TAGS or tag == "header" and not main or bool(parts)
        stack.append((tag, page.add(parent, ["tag=" + tag] + ["name=" + x for x in names] + ["part=" + x for x in parts], None, main, away)))
        links = 0 if tag in CONTAINERS else links
    flush()
    _place_features(page)
    return page


def template_of(page: Page) -> int:
    """Pages with the same set of tags and names have one template."""
    return hash_of("\n".join(sorted({" ".join(f) for f, t in zip(page.features, page.text, strict=True) if t is None})))


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def prior_counts() -> dict[str, tuple[float, float, float]]:
    """Pseudo-counts [away, mixed, content], in templates, of what HTML and common usage define."""
    out = {"name=" + x: (0.5, PRIOR / 4, PRIOR / 2) for x in HERE}
    out |= {"part=" + x: (PRIOR, REST, REST) for x in AWAY}
    out |= {"tag=" + x: (PRIOR, REST, REST) for x in AWAY_TAGS} | {"tag=header": (HEADER_PRIOR, 0.5, 0.5)}
    out |= {"tag=article": (REST, PRIOR / 8, PRIOR), "tag=main": (REST, PRIOR / 2, PRIOR)}
    out |= {"tag=" + x: (1.0, 400.0, 1.0) for x in ("root", "html", "body")}
    out |= {"tag=" + x: (2.0, 0.5, 8.0) for x in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption")}
    out |= {f"linked={k}": x for k, x in enumerate([(10.0, 1.0, 15.0), (10.0, 1.0, 10.0), (20.0, 1.0, 10.0), (60.0, 1.0, 10.0), (200.0, 1.0, 10.0)])}
    # a few characters say little for content, some hundred say much; the same for sentences
    out |= {f"size={k}": (12.0, 1.0, 12.0 * 2.0 ** min((k - 5.5) / 3, 3)) for k in range(1, 13)}
    out |= {f"stops={k}": (12.0, 1.0, 8.0 * 2.0 ** min(k, 2)) for k in range(5)}
    out |= {"place=first": (15.0, 1.0, 10.0), "place=last": (20.0, 1.0, 10.0)}
    out |= {f"alike={k}": (10.0 + 3 * k, 1.0, 10.0) for k in range(3, 5)}
    return out


def labels_of(page: Page) -> list[int] | None:
    """States of all nodes of a labelled page (None: it marks no main part). A block is content
    if it stands in the main part and in no part that is away; an element is content or away
    if (nearly) all of its text is, else mixed."""
    if not any(page.main):
        return None
    n = len(page.parent)
    inside, total = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            total[i] = len(page.text[i])
            inside[i] = total[i] if page.main[i] and not page.away[i] else 0
        if i:
            inside[page.parent[i]] += inside[i]
            total[page.parent[i]] += total[i]
    out = []
    for i in range(n):
        if page.main[i] and not page.away[i] and (2 * inside[i] > total[i] or not total[i]):
            out.append(CONTENT)
        elif not inside[i]:
            out.append(AWAY_STATE)
        else:
            out.append(MIXED)
    return out


class Model:
    """Evidence of each feature for the three states, relative to content, and the parent-child potential.

    ``counts`` has, by feature, the templates (in shares) in which it stands in each state. A prior is a
    statement about the states alike; learned counts are relative to how often elements or
    blocks have each state at all.
    """

    def __init__(self, counts: dict[str, Sequence[float]], pairs: np.ndarray):
        usual = {True: np.array(counts.get("all=text", (0, 0, 0)), float), False: np.array(counts.get("all=element", (0, 0, 0)), float)}
        usual = {k: (v + 1) / (v + 1).mean() for k, v in usual.items()}
        prior = prior_counts()
        self.evidence: dict[str, np.ndarray] = {}
        for f in prior.keys() | counts.keys():
            text = f.partition("=")[0] in ("size", "linked", "stops", "place", "alike")
            seen = np.array(counts.get(f, (0, 0, 0)), float)
            e = np.log(seen / usual[text] + np.array(prior.get(f, (SMOOTH,) * 3), float))
            self.evidence[f] = np.clip(e - e[CONTENT], -ELEMENT_RANGE, ELEMENT_RANGE)
        for f in [f for f in self.evidence if f.startswith(("voices", "all=")) or f in ("tag=#text", "tag=-")]:
            del self.evidence[f]
        self.pair = np.log((pairs + np.array(PAIR_PRIOR)) / (pairs + np.array(PAIR_PRIOR)).sum(axis=1, keepdims=True))
        self.top = np.log(np.array([0.1, 0.8, 0.1]))

    def own(self, features: Sequence[str], block: bool) -> np.ndarray:
        out = np.zeros(3)
        if not block:
            for f in features:
                if f in self.evidence:
                    out += self.evidence[f]
            return out
        said = {f: self.evidence[f][AWAY_STATE] for f in features if f in self.evidence}
        linked = sum(e for f, e in said.items() if f.startswith("linked="))
        rest = min(sum(said.values()) - linked, AGAINST_CONTENT)
        within = next((f.split("=") for f in features if f.startswith("voices")), None)
        if within and within[0] == "voices_here":
            rest = rest / int(within[1]) if rest > 0 else rest
        most = FOR_CONTENT / int(within[1]) if within and within[0] == "voices_away" else FOR_CONTENT
        out[AWAY_STATE] = max(linked + rest, -most)
        out[MIXED] = -1e3  # a block is content or not
        return out

    def marginals(self, pages: Sequence[Page]) -> np.ndarray:
        """P(content) of every node of all pages, by sum-product along the levels of the trees."""
        size = [len(p.parent) for p in pages]
        first = np.cumsum([0] + size[:-1])
        parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=True)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        known: dict[tuple, np.ndarray] = {}
        up = np.empty((len(parent), 3))  # evidence at and below a node
        i = 0
        for p in pages:
            for features, text in zip(p.features, p.text, strict=True):
                key = (text is None, *features)
                e = known.get(key)
                if e is None:
                    e = known[key] = self.own(features, text is not None)
                up[i] = e
                i += 1
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        sent = np.zeros_like(up)  # message to the parent
        for nodes in reversed(levels[1:]):
            m = self.pair[None] + up[nodes][:, None, :]  # (node, parent state, child state)
            sent[nodes] = np.logaddexp.reduce(m, axis=2)
            np.add.at(up, parent[nodes], sent[nodes])
        belief = up.copy()
        belief[levels[0]] += self.top
        for nodes in levels[1:]:
            above = belief[parent[nodes]] - sent[nodes]  # all but this child's own message
            above -= above.max(axis=1, keepdims=True)
            belief[nodes] = up[nodes] + np.logaddexp.reduce(above[:, :, None] + self.pair[None], axis=1)
        belief -= belief.max(axis=1, keepdims=True)
        chance = np.exp(belief)
        return chance[:, CONTENT] / chance.sum(axis=1)


def train(pages: DataFrame, id_column: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Shares by template over a sample of about ``sample_pages`` pages, cut by a hash of id and page."""
    total = pages.count()
    rows = pages.select(F.col(html).cast("string").alias("html"), F.col(id_column).cast("string").alias("id"))
    if total > sample_pages:
        rows = rows.filter(F.pmod(F.xxhash64("id", "html"), F.lit(1_000_003)) < int(1_000_003 * sample_pages / total))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int, float]] = []
            for source in batch.column(0):
                page = parse(source.as_py() or "")
                labels = labels_of(page)
                if labels is None:
                    continue
                found: dict[str, list[int]] = {}
                for i, y in enumerate(labels):
                    named = [*page.features[i], "all=element" if page.text[i] is None else "all=text"]
                    if i:
                        named.append(f"pair={labels[page.parent[i]]}")
                    for f in named:
                        found.setdefault(f, [0, 0, 0])[y] += 1
                template = template_of(page)
                out += [(template, f, y, n / sum(c)) for f, c in found.items() for y, n in enumerate(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32()),
                                              pa.array([r[3] for r in out], pa.float64())], names=["template", "f", "y", "share"])

    by_template = A.small_batches(rows.select("html")).mapInArrow(count, "template long, f string, y int, share double").groupBy("template", "f", "y").agg(F.avg("share").alias("share"))
    got = by_template.groupBy("f", "y").agg(F.sum("share").alias("n")).collect()  # the features of about sample_pages pages
    counts: dict[str, list[float]] = {}
    pairs = np.zeros((3, 3))
    for r in got:
        if r["f"].startswith("pair="):
            pairs[int(r["f"][5:]), r["y"]] = r["n"]
        else:
            counts.setdefault(r["f"], [0.0, 0.0, 0.0])[r["y"]] = float(r["n"])
    return Model(counts, pairs)


def extract(pages: DataFrame, model: Model, keep: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(texts: A.Texts, rows) -> dict:
            parsed = [parse(texts.row(i).decode("utf-8")) for i in range(texts.n)]
            chance = m.marginals(parsed)
            out, at = [], 0
            for page in parsed:
                out.append(" ".join(t for k, t in enumerate(page.text) if t is not None and chance[at + k] > 0.5))
                at += len(page.text)
            return {"text": pa.array(out, pa.string()), "n_chars": np.array([len(x) for x in out], np.int64)}
        return fn

    return A.scan(pages, keep, html, [("text", T.StringType()), ("n_chars", T.LongType())], make)
