"""Operator 6: exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct word n-grams. Two documents link when
``100 * intersection >= percent * union``.

**Order.** All sets are ordered alike: n-grams in at most ``FEW`` documents first, by hash, the
frequent ones last, by their number of documents, then by hash. Which n-grams are frequent, and in how many
documents, is counted over the whole corpus in packed form (a task sends the distinct
keys of its texts by hash range, so no row per n-gram travels). The list of frequent ones
is broadcast; its size is bounded by raising the threshold ``few`` until it fits
``FREQUENT_LIMIT``. A higher threshold only means longer lists, never other results.

**Prefix.** Linked sets of sizes a and b share at least o = ceil(p (a + b) / (100 + p))
n-grams, so for every k the first a - o + k n-grams of the one and the first b - o + k of
the other share at least k. Each document's k, up to ``MOST_MATCHES``, is chosen by its estimated
cost: the postings that its prefix meets (the sum of the lists' lengths) and ``VERIFY`` times the
candidates that are left. Lists of n-grams outside the frequent list are short and of different
documents: together they leave at most their sum / k candidates that share k of them. Frequent n-grams come
from passages and copies, so their lists hold the same documents: the documents in k of them are
as many as the k-th longest. A longer prefix adds a list and asks for one more match; it pays where that saves
more candidates than it meets postings, which it does for rare lists, and rarely does for frequent ones. Frequent
n-grams have their counted lengths, others are taken to have ``RARE``. A document whose
prefix lies outside the frequent list does not lengthen it into that list. A pair must
share min(k) n-grams at places that still leave o - min(k) + 1 n-grams after them.

**Candidates.** Prefix n-grams outside the frequent list occur in at most ``few``
documents: their lists are bounded and are paired inside a hash range. Documents whose
prefix runs into frequent n-grams (members of large groups of copies, or texts made of
shared passages) take a second way. Equal sets become one; a few min-hash stars, verified
like any pair, merge the bulk of each group of near copies; only pairs of different
components are then compared, by a join of the short prefixes that the larger set's
partner needs. No pair inside a merged group is made, and none outside is lost.

**Verification** fetches the sets of candidate documents only, and compares whole sets.

Components come from the verified links by ``connected_components``. Hashes have 64 bits,
so two different n-grams of a pair are taken as equal with a chance of about 2**-64.

Defined results: null, empty and wordless texts have an empty set, link with nothing and
are their own component; a text of fewer than n words is one n-gram; rows with a null id
take no part in links and get a null component; repeated rows of an id each get a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm import arrays as A
from opsmill.operators.documents import connected_components

FEW = 16
FREQUENT_LIMIT = 1_000_000
MOST_MATCHES = 3
VERIFY, RARE = 32.0, 4.0
STARS = 4
BROADCAST_IDS = 2_000_000
FLUSH = 1_000_000
KEYS_A_RANGE = 2_000_000


def ngram_sets(texts: A.Texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; short texts are one n-gram."""
    words = texts.spans(A.NON_SPACE)
    hashes = words.hashes(A.LOWER)
    grams, at = words.windows(hashes, n)
    bounds = np.searchsorted(at, words.first)
    out = []
    for i in range(texts.n):
        if words.n[i] >= n:
            out.append(np.unique(grams[bounds[i]:bounds[i + 1]]))
        elif words.n[i]:
            out.append(A.mix(A.window_sum(hashes, words.first[i:i + 1], int(words.n[i]))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a, b, percent: int):
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class Ranges:
    """Hash ranges: 2**bits of them, and 32-bit keys inside each."""

    def __init__(self, bits: int):
        self.bits = bits

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> A.U64(64 - self.bits)).astype(np.int64), (hashes >> A.U64(32 - self.bits)).astype(np.uint32)

    def joined(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> A.U64(32 - self.bits)

    @staticmethod
    def of(docs: DataFrame) -> "Ranges":
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        return Ranges(int(min(20, max(6, (size // 6 // KEYS_A_RANGE).bit_length()))))


def frequent_ngrams(docs: DataFrame, n: int, ranges: Ranges, few: int, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys (sorted, as ``Ranges.joined``) and counts of n-grams in over ``few`` documents, and the
    threshold used. Counts cover every document."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            where, small = ranges.split(keys)
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            many = counts > 1
            rows = [(int(where[a]), small[a:b][~many[a:b]].tobytes(), small[a:b][many[a:b]].tobytes(), counts[a:b][many[a:b]].astype(np.uint32).tobytes())
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)]
            for lo in range(0, len(rows), 64):
                part = rows[lo:lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), *(pa.array([r[k] for r in part], pa.binary()) for k in (1, 2, 3))],
                                                 names=["range", "once", "many", "counts"])

        for batch in batches:
            for lo, hi in A.slices(batch.column(0)):
                sets = ngram_sets(A.texts_of(batch.column(0).slice(lo, hi - lo)), n)
                held += sets
                size += sum(map(len, sets))
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def add(table: pa.Table) -> pa.Table:
        once = [np.frombuffer(x.as_py(), np.uint32) for x in table["once"]]
        many = [np.frombuffer(x.as_py(), np.uint32) for x in table["many"]]
        counts = [np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]
        # only keys seen twice or more can be frequent
        keys = np.sort(np.concatenate(once + many))
        twice = np.unique(keys[1:][keys[1:] == keys[:-1]]) if len(keys) > 1 else keys[:0]
        twice = np.union1d(twice, np.concatenate(many)) if many else twice
        total = np.zeros(len(twice), np.int64)
        if len(twice):
            for part, weight in [(p, None) for p in once] + list(zip(many, counts, strict=True)):
                at = np.minimum(np.searchsorted(twice, part), len(twice) - 1)
                hit = twice[at] == part
                total += np.bincount(at[hit], weights=None if weight is None else weight[hit], minlength=len(twice)).astype(np.int64)
        keep = total > few
        at = np.uint64(table["range"][0].as_py()) << np.uint64(32)
        return pa.table({"key": pa.array((at | twice[keep].astype(np.uint64)).view(np.int64)), "n": pa.array(total[keep])})

    counted = A.small_batches(docs.select("text")).mapInArrow(lambda batches: A.released(pack(batches)), "range int, once binary, many binary, counts binary").groupBy("range").applyInArrow(add, "key long, n long").checkpoint()
    # the smallest threshold whose list fits
    steps = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    size = sum(r["n"] for r in steps)
    for r in sorted(steps, key=lambda r: r["p"]):
        if size <= limit:
            break
        size -= r["n"]
        few = max(few, 2 ** (r["p"] + 1) - 1)
    got = counted.filter(F.col("n") > few).toPandas()
    order = np.argsort(got["key"].to_numpy().view(np.uint64), kind="stable")
    return got["key"].to_numpy().view(np.uint64)[order], got["n"].to_numpy()[order], few


SIGNATURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()),
    T.StructField("k", T.IntegerType()), T.StructField("hot", T.BooleanType()), T.StructField("rare", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())),
    T.StructField("stars", T.ArrayType(T.LongType()))])


def matches_asked(lengths: np.ndarray, rare: int, least: int, most: int) -> int:
    """The k of least estimated cost, from the list lengths of a set's n-grams in order, of which the first
    ``rare`` are outside the frequent list: at least ``least`` of them are in the prefix, at most ``most``."""
    best, chosen = np.inf, 1
    for k in range(1, max(1, min(MOST_MATCHES, most - least + 1)) + 1):
        prefix = lengths[:least + k - 1]
        often = prefix[rare:]  # in rising order
        left = prefix[:rare].sum() / k + (often[-k] if len(often) >= k else 0)
        cost = prefix.sum() + VERIFY * left
        if cost < best:
            best, chosen = cost, k
    return chosen


def signatures(docs: DataFrame, n: int, percent: int, ranges: Ranges, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Per document: set size, class (hash of the whole set), matches asked for (k), whether the
    prefix runs into frequent n-grams (hot), its n-grams before those (rare), the prefix, and
    star keys of hot documents."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, np.minimum(counts, 2**32 - 1).astype(np.uint32)))  # at most FREQUENT_LIMIT n-grams
    seeds = [A.U64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64) for j in range(STARS)]

    def make():
        import hashlib

        often, documents = shared.value

        def fn(texts: A.Texts, rows) -> dict:
            sets = ngram_sets(texts, n)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            if len(often) and len(every):
                keys = ranges.joined(every)
                place = np.minimum(np.searchsorted(often, keys), len(often) - 1)
                common = often[place] == keys
                length = np.where(common, documents[place], RARE)
            else:
                common, length = np.zeros(len(every), bool), np.full(len(every), RARE)
            at = A.sums(np.fromiter(map(len, sets), np.int64, len(sets)))
            size, k, hot, few_in, prefixes, stars, classes = [], [], [], [], [], [], []
            for i, s in enumerate(sets):
                size.append(len(s))
                if not len(s):
                    k.append(0), hot.append(False), few_in.append(0), prefixes.append(s), stars.append([]), classes.append(None)
                    continue
                own, lists = common[at[i]:at[i + 1]], length[at[i]:at[i + 1]]
                least = len(s) - -(-percent * len(s) // 100) + 1  # prefix for k = 1 and any partner
                order = np.lexsort((s, lists, own)) if own.any() else np.arange(len(s))
                ordered, rare = s[order], len(s) - int(own.sum())
                asked = matches_asked(lists[order], rare, least, len(s) if rare < least else rare)
                hot.append(rare < least)
                k.append(asked)
                prefixes.append(ordered[:least + asked - 1])
                few_in.append(min(rare, least + asked - 1))
                stars.append([int(A.mix(s * m).min().view(np.int64)) for m in seeds] if hot[-1] else [])
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            return {"n": np.array(size, np.int64), "k": np.array(k, np.int32), "hot": np.array(hot, bool), "rare": np.array(few_in, np.int32), "class": pa.array(classes, pa.binary()),
                    "prefix": A.ragged(np.concatenate(prefixes).view(np.int64), np.fromiter(map(len, prefixes), np.int64, len(prefixes)), pa.int64()),
                    "stars": pa.array(stars, pa.list_(pa.int64()))}
        return fn

    return A.scan(docs, ["doc_id"], "text", [(f.name, f.dataType) for f in SIGNATURE.fields[1:]], make)


def bounded_candidates(sig: DataFrame, percent: int, ranges: Ranges) -> DataFrame:
    """(a, b) of pairs that share enough prefix n-grams, by those outside the frequent list.

    Postings travel packed by hash range. A list has at most ``few`` documents (repeats of
    an id aside), so a range is bounded by its postings and their pairs by ``few`` / 2 times that.
    """
    kind = np.dtype([("key", "<u4"), ("doc", "<i8"), ("n", "<u4"), ("at", "<u4"), ("k", "<u2")])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                lists = part.column(3)
                length = np.asarray(pc.list_value_length(lists), np.int64)
                grams = np.asarray(lists.flatten(), np.int64).view(np.uint64)
                if not len(grams):
                    continue
                rows = np.empty(len(grams), kind)
                where, rows["key"] = ranges.split(grams)
                rows["doc"] = np.repeat(np.asarray(part.column(0), np.int64), length)
                rows["n"] = np.repeat(np.asarray(part.column(1), np.int64), length)
                rows["k"] = np.repeat(np.asarray(part.column(2), np.int64), length)
                rows["at"] = A.expand(np.zeros(len(length), np.int64), length)
                order = np.argsort(where, kind="stable")
                where, rows = where[order], rows[order]
                cuts = np.flatnonzero(np.diff(where, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[cuts].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True)], pa.binary())],
                    names=["range", "rows"])

    def pairs(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table["rows"]])
        rows = rows[np.argsort(rows["key"], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1], [True]]))
        length = np.diff(edge)
        rows = rows[np.repeat(length > 1, length)]
        length = length[length > 1]
        left = np.repeat(A.sums(length)[1:], length) - 1 - np.arange(len(rows))  # members after each
        found_a, found_b, found_k = [], [], []
        for back in range(1, int(length.max()) if len(length) else 1):
            i = np.flatnonzero(left >= back)
            a, b = rows[i], rows[i + back]
            na, nb, k = a["n"].astype(np.int64), b["n"].astype(np.int64), np.minimum(a["k"], b["k"]).astype(np.int64)
            o = overlap(na, nb, percent)
            ok = (a["doc"] != b["doc"]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (na - a["at"] > o - k) & (nb - b["at"] > o - k)
            found_a.append(np.minimum(a["doc"][ok], b["doc"][ok]))
            found_b.append(np.maximum(a["doc"][ok], b["doc"][ok]))
            found_k.append(k[ok])
        if not found_a:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "k", "shared")})
        both = np.rec.fromarrays([np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_k)], names="a,b,k")
        both, n = np.unique(both, return_counts=True)
        return pa.table({**{c: pa.array(both[c].copy()) for c in ("a", "b", "k")}, "shared": pa.array(n.astype(np.int64))})

    posts = sig.select("doc_id", "n", "k", F.slice("prefix", 1, F.col("rare")).alias("prefix"))
    return (A.small_batches(posts).mapInArrow(pack, "range int, rows binary").groupBy("range").applyInArrow(pairs, "a long, b long, k long, shared long")
            .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("k").alias("k")).filter("shared >= k").select("a", "b"))


def hot_candidates(hot: DataFrame, percent: int) -> DataFrame:
    """(a, b) of hot documents of different components that share enough prefix n-grams.

    ``hot``: one row per distinct set with its component. In a pair the smaller set's n-gram
    must stand in its shorter prefix (its partner is no smaller), so one side of the join
    is the short prefixes, the other the whole ones, of n-grams in two components or more.
    """
    posts = hot.select("doc_id", "n", "k", "g", F.posexplode("prefix").alias("at", "gram"))
    mixed = posts.groupBy("gram").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select("gram")
    posts = posts.join(mixed, "gram", "left_semi")
    x = posts.filter(f"n - at > ceil({2 * percent} * n / {100 + percent}) - k").select("gram", *[F.col(c).alias(c + "1") for c in ("doc_id", "n", "k", "g", "at")])
    y = posts.select("gram", *[F.col(c).alias(c + "2") for c in ("doc_id", "n", "k", "g", "at")])
    o = f"ceil({percent} * (n1 + n2) / {100 + percent})"
    pair = x.join(y, (x["gram"] == y["gram"]) & F.expr(
        f"g1 != g2 and (n1 < n2 or (n1 = n2 and doc_id1 < doc_id2)) and 100 * n1 >= {percent} * n2 "
        f"and n1 - at1 > {o} - least(k1, k2) and n2 - at2 > {o} - least(k1, k2)"))
    return (pair.groupBy("doc_id1", "doc_id2").agg(F.count(F.lit(1)).alias("shared"), F.first(F.expr("least(k1, k2)")).alias("k"))
            .filter("shared >= k").select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b")))


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, broadcast_ids: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. Only texts of these documents are read."""
    pairs = pairs.select("a", "b").checkpoint()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct().checkpoint()
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids  # the size is measured
    sets = A.scan(docs.join(wanted, docs["doc_id"] == wanted["need"], "left_semi"), ["doc_id"], "text",
                  [("grams", T.ArrayType(T.LongType()))], lambda: lambda texts, rows: {"grams": _lists(ngram_sets(texts, n))})
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("ga", "gb")).cast("long")
    return both.select("a", "b", inter.alias("i"), (F.size("ga") + F.size("gb")).alias("s")).filter(f"100 * i >= {percent} * (s - i)").select("a", "b").distinct()


def _several(groups: DataFrame, broadcast_rows: int) -> DataFrame:
    """The groups with two members or more, as a table of their own: broadcast if its counted size
    allows. Else it joins as a plain shuffled side, which lets Spark split a hot group's rows."""
    own = groups.filter("members > 1").drop("members").checkpoint()
    return F.broadcast(own) if own.count() <= broadcast_rows else own


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return A.ragged(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64), np.fromiter(map(len, sets), np.int64, len(sets)), pa.int64())


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, few: int = FEW,
               frequent_limit: int = FREQUENT_LIMIT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranges = Ranges.of(docs)
    often, counts, _ = frequent_ngrams(docs, n, ranges, few, frequent_limit)
    sig = signatures(docs, n, percent, ranges, often, counts).checkpoint()
    linkable = sig.filter("doc_id is not null and n > 0")

    # equal sets: every document knows the smallest id of its class, which stands for it
    first = _several(linkable.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), broadcast_ids)
    links = linkable.select("doc_id", "class").join(first, "class").filter("doc_id != rep").select(F.col("doc_id").alias("copy"), "rep").distinct().checkpoint()
    light = bounded_candidates(linkable, percent, ranges)
    for side in ("a", "b"):
        light = light.join(links, light[side] == links["copy"], "left").withColumn(side, F.coalesce("rep", side)).drop("copy", "rep")
    light = light.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # hot documents: distinct sets, stars, then pairs across components
    hot = linkable.filter("hot").groupBy("class").agg(F.min_by(F.struct("doc_id", "n", "k", "prefix", "stars"), "doc_id").alias("r")).select("r.*").checkpoint()
    keys = hot.select("doc_id", "n", F.posexplode("stars").alias("j", "key"))
    centre = _several(keys.groupBy("j", "key").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("c"), F.count(F.lit(1)).alias("members")), broadcast_ids)
    stars = (keys.join(centre, ["j", "key"]).filter(f"doc_id != c.doc_id and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
             .select(F.col("doc_id").alias("b"), F.col("c.doc_id").alias("a")).distinct())
    starred = verified(stars, docs, n, percent, broadcast_ids).checkpoint()
    groups = connected_components(starred).select(F.col("node").alias("member"), F.col("label"))
    hot = hot.join(groups, hot["doc_id"] == groups["member"], "left").select("doc_id", "n", "k", "prefix", F.coalesce("label", "doc_id").alias("g"))
    found = verified(light.unionByName(hot_candidates(hot, percent)), docs, n, percent, broadcast_ids).checkpoint()  # read twice below

    label = connected_components(links.select(F.col("copy").alias("a"), F.col("rep").alias("b")).unionByName(starred).unionByName(found)).select(F.col("node").alias("member"), "label")
    return (sig.select("doc_id", "n").join(label, sig["doc_id"] == label["member"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with the smallest id.

    Rows with a null id stay; of repeated rows of the kept id one stays.
    """
    label = components(docs, id_column, text, n, percent).checkpoint()
    gone = label.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    if gone.count() <= BROADCAST_IDS:  # the size is measured; else a join by id
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs[id_column].cast("long") == gone["__gone"], "left_anti")
    again = label.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__again").checkpoint()
    if again.isEmpty():
        return kept
    same = docs[id_column].cast("long") == again["__again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_column]))
