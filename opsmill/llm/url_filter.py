"""Operator 1: URL filtering by mined association rules.

A URL's tokens are the labels of its host (``h:``), the pieces of its path (``p:``) and the
names of its query parameters (``q:``); pieces without a letter do not count. Spark's
FP-growth finds frequent token sets in a bounded sample of all different URLs, with the label
as one more token (``open`` where no label is known), and yields rules {tokens} -> label. Support
and confidence are then counted anew over all different URLs that hold the tokens, labelled or
not: a token that labelled URLs share with an open majority says little, and only combinations that
tell them apart stay. Rules are pruned by support, confidence and lift over the label's share, and
a rule is dropped when a shorter rule inside it, with the same label, is as confident.

Matching uses an inverted index: each rule is filed under its rarest token, a URL looks up
its own tokens in the index, and only the rules found there are tested in full. Of the
matching rules the most confident decides (then support, then the longer one, then its
text). With minimum support s and m tokens in a URL, at most C(m, 3) / s token sets
are frequent whatever the number of URLs: that bounds the index, which is a join side
without a hint.

A fixed rule list (host, path prefix, verdict) takes precedence; the longest rule wins.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule
and the default verdict; without labels nothing is mined; ties are broken as said; repeated rows each get a row; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.session import bounded

FIXED_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE_URLS = 60_000
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 0.002, 0.9, 1.2, 3
LABEL = "verdict="
OPEN = "open"
MOST_RULES = 100_000  # rules that may be broadcast; more are joined


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = FIXED_RULES) -> Column:
    """The longest fixed rule that fits, as text; null if none does."""
    found = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = FIXED_RULES) -> Column:
    out = F.lit(None).cast("string")
    for text, verdict in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    lettered = lambda x: x.rlike("[^0-9]")
    labels = F.filter(F.split(host, r"\."), lambda x: (x != "") & lettered(x))
    pieces = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & lettered(x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    mark = lambda c, m: F.transform(c, lambda x: F.concat(F.lit(m), x))
    return F.array_distinct(F.concat(mark(labels, "h:"), mark(pieces, "p:"), mark(names, "q:")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT,
         max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules (tokens, label, support, confidence, key) from (tokens, label) rows, pruned.

    ``labelled`` is the caller's bounded sample. ``key`` is the rule's rarest token. No rule leads
    to ``OPEN``, whose rows count against the others.
    """
    baskets = labelled.filter("label is not null").select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label")))).alias("items"))
    baskets = baskets.persist()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter((F.size("consequent") == 1) & F.col("consequent")[0].startswith(LABEL) & (F.size("antecedent") <= max_tokens)
                                          & ~F.exists("antecedent", lambda t: t.startswith(LABEL)) & (F.col("lift") >= min_lift) & (F.col("consequent")[0] != LABEL + OPEN))
    # both tables are small and used several times; mining runs once for each
    rules = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1_000).alias("label"), "support", "confidence").checkpoint()
    often = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq").checkpoint()
    baskets.unpersist()
    # a more general rule of the same label that is as confident makes a longer one useless
    one = rules.select(F.posexplode("tokens").alias("_", "t"), F.col("tokens").alias("sub"), F.col("label").alias("sub_label"),
                       F.col("confidence").alias("sub_confidence")).filter("_ = 0").drop("_")
    wide = rules.select("*", F.explode("tokens").alias("t"))
    useless = wide.join(one, "t").filter((F.col("sub_label") == F.col("label")) & (F.size("sub") < F.size("tokens")) & (F.col("sub_confidence") >= F.col("confidence"))
                                         & (F.size(F.array_except("sub", "tokens")) == 0)).select("tokens", "label").distinct()
    rules = rules.join(useless, ["tokens", "label"], "left_anti")
    keyed = (rules.select("*", F.explode("tokens").alias("t")).join(often, "t")
             .groupBy("tokens", "label", "support", "confidence").agg(F.min(F.struct("freq", "t"))["t"].alias("key")))
    return keyed


def recount(urls: DataFrame, rules: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """``rules`` with support and confidence over all ``urls`` (tokens, label), those that still pass."""
    urls = urls.groupBy(F.array_sort("tokens").alias("tokens"), "label").agg(F.count(F.lit(1)).alias("times"))  # a hot host has few token sets
    totals = urls.groupBy(F.col("label").alias("t_label")).agg(F.sum("times").alias("t")).checkpoint()  # a row a label
    n = totals.agg(F.sum("t")).first()[0] or 0
    side = rules.select("key", F.col("tokens").alias("r_tokens"), F.col("label").alias("r_label"))
    hits = (urls.select(F.col("tokens").alias("own"), F.col("label").alias("own_label"), "times", F.explode("tokens").alias("key")).join(bounded(side, MOST_RULES), "key")
            .filter(F.size(F.array_except("r_tokens", "own")) == 0))
    counted = hits.groupBy("key", "r_tokens", "r_label").agg(F.sum("times").alias("held"), F.sum(F.when(F.col("own_label") == F.col("r_label"), F.col("times")).otherwise(0)).alias("right"))
    share = F.col("t") / F.lit(float(max(n, 1)))
    x = counted.join(F.broadcast(totals), F.col("r_label") == F.col("t_label"))
    x = x.select(F.col("r_tokens").alias("tokens"), F.col("r_label").alias("label"), (F.col("right") / F.lit(float(max(n, 1)))).alias("support"), (F.col("right") / F.col("held")).alias("confidence"),
                 "key", share.alias("share"))
    return x.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("share"))).drop("share")


def match(urls: DataFrame, rules: DataFrame, id_column: str, tokens: str = "tokens") -> DataFrame:
    """(id, label, confidence, rule) of each URL that a rule fits: the best rule by the order above."""
    hits = (urls.select(F.col(id_column).alias("__id"), F.col(tokens).alias("__own"), F.explode(tokens).alias("key")).join(rules, "key")
            .filter(F.size(F.array_except("tokens", "__own")) == 0))
    best = F.max_by(F.struct("label", "confidence", F.array_join("tokens", " ").alias("rule")),
                    F.struct("confidence", "support", F.size("tokens"), F.array_join("tokens", " ")))
    return hits.groupBy("__id").agg(best.alias("b")).select("__id", "b.label", "b.confidence", "b.rule")


def judge(pages: DataFrame, id_column: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = FIXED_RULES,
          default: str = "allow", sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """id, host, path, rule, verdict, mined_rule and confidence of every URL.

    URLs that a fixed rule fits are the labelled ones. Rules are mined from a bounded sample of all
    different URLs and counted anew over all of them; URLs without a fixed rule get the verdict of
    the mined rules, or ``default``.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_column), F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", fixed_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    # equal URLs count once and get equal verdicts: each is matched once
    own = rows.select("__url", "host", "path", F.coalesce(verdict_of(F.col("rule"), rules), F.lit(OPEN)).alias("label")).distinct()
    own = own.select("__url", url_tokens(F.col("__url"), F.col("host"), F.col("path")).alias("tokens"), "label").checkpoint()
    total = own.count()
    sample = own if total <= sample_urls else own.filter(F.pmod(F.xxhash64(F.col("__url"), F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * sample_urls / total))
    mined = recount(own, mine(sample.select("tokens", "label"))).checkpoint()
    found = match(own.filter(F.col("label") == OPEN), mined, "__url")
    found = found.select(F.col("__id").alias("__found"), "label", "confidence", F.col("rule").alias("mined_rule"))
    joined = rows.join(found, (rows["__url"] == found["__found"]) & rows["rule"].isNull(), "left")
    return joined.select(id_column, "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "label", F.lit(default)).alias("verdict"),
                         "mined_rule", "confidence")
