"""Entity resolution across sources: blocking, learned field weights, links.

Pairs are compared only if they share a blocking key. Several passes with different keys each catch
variants that the others miss; a block with more than ``max_pairs`` pairs is refined by the pass's next
key (a hot value never meets all its rows), and what its rows lose there other passes may find.
Each field of a pair agrees exactly, nearly, not at all, or is missing; the weights of these outcomes
are learned without labels by expectation maximisation (Fellegi and Sunter's model) over the counts
of outcome patterns, of which there are at most 4 ** fields, whatever the number of pairs. A
pair's match probability follows from its pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.session import cut_lineage

MISSING, DIFFERENT, NEAR, SAME = range(4)


def text_outcome(a: Column, b: Column, near: int = 2) -> Column:
    """Same text, at most ``near`` edits apart, else different; missing if either is null or empty."""
    gone = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(gone, MISSING).when(a == b, SAME).when(F.levenshtein(a, b, near) >= 0, NEAR).otherwise(DIFFERENT)


def number_outcome(a: Column, b: Column, near: float = 0.01) -> Column:
    """Equal, within a share ``near`` of the larger one, else different; missing if either is null."""
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), MISSING).when(a == b, SAME).when(gap <= F.greatest(F.abs(a), F.abs(b)) * near, NEAR).otherwise(DIFFERENT)


def candidate_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: Sequence[Sequence[Column]], max_pairs: int = 10_000) -> DataFrame:
    """(left id, right id) of rows that share a key of some pass. ``passes`` are lists of key columns over
    the fields that both sides have: the first key blocks, each further one refines blocks of over ``max_pairs`` pairs."""
    out = None
    for keys in passes:
        sides = []
        for df, own, name in ((left, left_id, "l"), (right, right_id, "r")):
            cols = [k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
            sides.append(df.select(F.col(own).alias(name), *cols).filter("k0 is not null and k0 <> ''"))
        a, b = sides
        for depth in range(1, len(keys) + 1):
            on = [f"k{i}" for i in range(depth)]
            if depth > 1:
                a, b = (s.filter(F.col(on[-1]).isNotNull()) for s in (a, b))
            sizes = a.groupBy(*on).agg(F.count(F.lit(1)).alias("nl")).join(b.groupBy(*on).agg(F.count(F.lit(1)).alias("nr")), on)
            sizes = cut_lineage(sizes.withColumn("large", F.col("nl") * F.col("nr") > max_pairs))
            last = depth == len(keys)
            small = sizes if last else sizes.filter("not large")
            found = a.join(small.select(*on), on, "left_semi").join(b, on).select("l", "r")
            out = found if out is None else out.unionByName(found)
            if last:
                break
            large = cut_lineage(sizes.filter("large").select(*on))
            a, b = (s.join(large, on, "left_semi") for s in (a, b))
    return out.distinct()


def learn_weights(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 200, start: float = 0.05) -> tuple[np.ndarray, np.ndarray, float]:
    """m and u probabilities (field x outcome) and the share of matches, by expectation maximisation over
    (pattern, count) rows. A missing field says nothing."""
    code = np.array([p for p, _ in patterns], dtype=np.int64)
    count = np.array([n for _, n in patterns], dtype=np.float64)
    fields = code.shape[1]
    m, u, share = np.tile([1.0, 0.05, 0.15, 0.8], (fields, 1)), np.tile([1.0, 0.85, 0.1, 0.05], (fields, 1)), start
    at = np.arange(fields)
    for _ in range(rounds):
        # expectation: the probability of a match for each pattern
        odds = np.log(share) - np.log1p(-share) + (np.log(m[at, code]) - np.log(u[at, code])).sum(axis=1)
        match = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        # maximisation over the pairs whose field is known
        new_m, new_u = m.copy(), u.copy()
        for f in range(fields):
            for table, weight in ((new_m, match * count), (new_u, (1 - match) * count)):
                seen = np.array([weight[code[:, f] == o].sum() for o in (DIFFERENT, NEAR, SAME)]) + 1e-3
                table[f, 1:] = seen / seen.sum()
        share_new = float(np.clip((match * count).sum() / count.sum(), 1e-9, 1 - 1e-9))
        moved = max(np.abs(new_m - m).max(), np.abs(new_u - u).max(), abs(share_new - share))
        m, u, share = new_m, new_u, share_new
        if moved < 1e-9:
            break
    return m, u, share


def link_entities(left: DataFrame, right: DataFrame, left_id: str, right_id: str, fields: dict[str, str], passes: Sequence[Sequence[Column]],
                  threshold: float = 0.9, max_pairs: int = 10_000, one_to_one: bool = True) -> DataFrame:
    """(left id, right id, probability): pairs whose match probability reaches ``threshold``.

    ``fields`` names the common columns and how they compare (``text`` or ``number``). With
    ``one_to_one`` a pair stays only if each side is the other's best (probability, then smallest
    id). Null ids take no part; without candidate pairs there are no links."""
    a = left.filter(F.col(left_id).isNotNull()).select(F.col(left_id).alias("l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = right.filter(F.col(right_id).isNotNull()).select(F.col(right_id).alias("r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    pairs = candidate_pairs(left.filter(F.col(left_id).isNotNull()), right.filter(F.col(right_id).isNotNull()), left_id, right_id, passes, max_pairs)
    both = pairs.join(a, "l").join(b, "r")
    compared = [(text_outcome if kind == "text" else number_outcome)(F.col(f"l_{f}"), F.col(f"r_{f}")).alias(f"o_{f}") for f, kind in fields.items()]
    names = [f"o_{f}" for f in fields]
    seen = cut_lineage(both.select("l", "r", *compared))
    counts = [([r[n] for n in names], r["n"]) for r in seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 4 ** fields rows
    if not counts:
        return seen.select(F.col("l").alias(left_id), F.col("r").alias(right_id), F.lit(0.0).alias("probability"))
    m, u, share = learn_weights(counts)
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for f, n in enumerate(names):
        weights = np.log(m[f]) - np.log(u[f])
        odds = odds + F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(n))
    scored = seen.select("l", "r", (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("probability")).filter(F.col("probability") >= threshold)
    if one_to_one:
        best_r = scored.groupBy("l").agg(F.min_by("r", F.struct(-F.col("probability"), F.col("r"))).alias("r"))
        best_l = scored.groupBy("r").agg(F.min_by("l", F.struct(-F.col("probability"), F.col("l"))).alias("l"))
        scored = scored.join(best_r, ["l", "r"], "left_semi").join(best_l, ["l", "r"], "left_semi")
    return scored.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "probability")
