"""Registered queries for SURVEY 2.17 (vectors, context, evaluation, cost, synthetic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmill.operators import cost as COST
from opsmill.operators import documents as DOC
from opsmill.operators import evaluate as EV
from opsmill.operators import folds
from opsmill.operators import synth as SY
from opsmill.operators import vectors as VEC
from opsmill.plans.derived import sql_with
from opsmill.plans.registry import r, register
from opsmill.tables import Tables

CENTROIDS_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e),
c AS (SELECT label, list(ax ORDER BY dim) AS cv FROM (SELECT label, dim, avg(x) AS ax FROM ex GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT c.label, e.vec_id, e.label AS vec_label,
  list_dot_product(e.v, c.cv) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.cv, c.cv))) AS sim FROM e, c)
"""


def _centroids(t):
    emb = t.embeddings
    return VEC.centroids(emb, "label", "embedding", "centroid")


@register("v1_cosine_topk", headline=True, sql=CENTROIDS_SQL + """
SELECT label, vec_id, rank, round(sim, 6) AS similarity FROM (
  SELECT label, vec_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0.25)
WHERE rank <= 5
""")
def q_v1(spark, sf):
    t = Tables(spark, sf)
    top = VEC.cosine_topk(t.embeddings, _centroids(t), "vec_id", "embedding", "label", "centroid", k=5, min_similarity=0.25)
    return top.select("label", "vec_id", "rank", r("similarity", 6).alias("similarity"))


@register("v2_ann_search")
def q_v2(spark, sf):
    t = Tables(spark, sf)
    top = VEC.ann_search(t.embeddings, _centroids(t), "vec_id", "embedding", "label", "centroid", k=5)
    return top.select("label", "vec_id", "rank", r("similarity", 6).alias("similarity"))


@register("v2_ann_recall", sql="""
SELECT count(*) * 5 AS exact, true AS recall_reached, true AS few_candidates FROM (SELECT DISTINCT label FROM embeddings)
""")
def q_v2r(spark, sf):
    """Recall of the approximate search against the exact top-k (same queries, k = 5): at least
    0.9 with under a tenth of all (query, vector) pairs as candidates."""
    t = Tables(spark, sf)
    exact = VEC.cosine_topk(t.embeddings, _centroids(t), "vec_id", "embedding", "label", "centroid", k=5, min_similarity=-1.0)
    approx = VEC.ann_search(t.embeddings, _centroids(t), "vec_id", "embedding", "label", "centroid", k=5)
    hit = exact.join(approx.select("label", "vec_id", F.lit(1).alias("hit")), ["label", "vec_id"], "left")
    looked = approx.groupBy("label").agg(F.max("candidates").alias("c")).agg(F.sum("c").alias("looked"), F.count(F.lit(1)).alias("q"))
    all_vectors = t.embeddings.agg(F.count(F.lit(1)).alias("v"))
    out = hit.agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found")).crossJoin(looked).crossJoin(all_vectors)  # one row each
    return out.select("exact", (F.col("found") >= 0.9 * F.col("exact")).alias("recall_reached"), (10 * F.col("looked") < F.col("q") * F.col("v")).alias("few_candidates"))


def _cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0).cast("double"), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x), F.lit(0.0).cast("double"), lambda s, v: s + v))
    nb = F.sqrt(F.aggregate(F.transform(b, lambda x: x.cast("double") * x), F.lit(0.0).cast("double"), lambda s, v: s + v))
    return dot / (na * nb)


@register("v3_composite_rank", sql=CENTROIDS_SQL + """
, own AS (SELECT label, vec_id, sim, vec_id % 365 AS age, CASE WHEN label % 3 = 0 THEN 1.0 ELSE 0.5 END AS w FROM s WHERE label = vec_label),
sc AS (SELECT label, vec_id, 0.6 * round(sim, 6) + 0.25 * exp(-age * ln(2.0) / 30.0) + 0.15 * w AS composite FROM own)
SELECT label, vec_id, round(composite, 6) AS composite, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY composite DESC, vec_id) AS rank FROM sc) WHERE rank <= 3
""")
def q_v3(spark, sf):
    t = Tables(spark, sf)
    c = _centroids(t)
    own = t.embeddings.join(c, "label").select("label", "vec_id", r(_cosine(F.col("embedding"), F.col("centroid")), 6).alias("sim"),
                                               (F.col("vec_id") % 365).alias("age"),
                                               F.when(F.col("label") % 3 == 0, 1.0).otherwise(0.5).alias("w"))
    sc = VEC.composite_rank(own, "sim", "age", "w")
    from opsmill.operators.relational import top_n_per_group
    top = top_n_per_group(sc, "label", 3, [F.col("composite").desc(), F.col("vec_id")], out="rank")
    return top.select("label", "vec_id", r("composite", 6).alias("composite"), "rank")


def _conv_items(t):
    c = t.conversations
    return c.select("conv_id", "turn", ((F.col("turn") + 1) / 8.0).alias("importance"), EV.word_count("text").alias("tokens"))


@register("v5_context_compress", sql="""
WITH items AS (SELECT conv_id, turn, (turn + 1) / 8.0 AS importance,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS tokens FROM conversations),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY -importance, turn) AS rn FROM items WHERE importance >= 0.7 AND tokens <= 4000)
SELECT conv_id, turn, selected, remaining FROM (
  WITH RECURSIVE walk(conv_id, rn, turn, selected, remaining) AS (
    SELECT conv_id, rn, turn, tokens <= 300.0, CASE WHEN tokens <= 300.0 THEN 300.0 - tokens ELSE 300.0 END FROM kept WHERE rn = 1
    UNION ALL
    SELECT k.conv_id, k.rn, k.turn, k.tokens <= w.remaining, CASE WHEN k.tokens <= w.remaining THEN w.remaining - k.tokens ELSE w.remaining END
    FROM walk w JOIN kept k ON k.conv_id = w.conv_id AND k.rn = w.rn + 1)
  SELECT * FROM walk)
""")
def q_v5(spark, sf):
    items = VEC.context_compress(_conv_items(Tables(spark, sf)), "importance", "tokens")
    return folds.token_budget_pack(items, "conv_id", "turn", "importance", "tokens", budget=300)


@register("v6_context_diff_merge", sql="""
WITH base AS (SELECT c_custkey AS k, c_mktsegment AS value FROM customer),
l AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'LEFT' ELSE value END AS value FROM base WHERE k % 11 <> 0),
rt AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'RIGHT' WHEN k % 10 = 0 THEN 'LEFT' ELSE value END AS value FROM base),
j AS (SELECT coalesce(b.k, l.k, rt.k) AS k, b.value AS base, l.value AS lv, rt.value AS rv FROM base b FULL JOIN l USING (k) FULL JOIN rt USING (k))
SELECT CASE WHEN lv IS NOT DISTINCT FROM base AND rv IS NOT DISTINCT FROM base THEN 'unchanged'
  WHEN lv IS DISTINCT FROM base AND rv IS NOT DISTINCT FROM base THEN 'left'
  WHEN lv IS NOT DISTINCT FROM base AND rv IS DISTINCT FROM base THEN 'right'
  WHEN lv IS NOT DISTINCT FROM rv THEN 'both_same' ELSE 'conflict' END AS status, count(*) AS n FROM j GROUP BY 1
""")
def q_v6(spark, sf):
    c = Tables(spark, sf).customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"))
    left = c.filter(F.col("k") % 11 != 0).withColumn("value", F.when(F.col("k") % 5 == 0, "LEFT").otherwise(F.col("value")))
    right = c.withColumn("value", F.when(F.col("k") % 7 == 0, "RIGHT").when(F.col("k") % 10 == 0, "LEFT").otherwise(F.col("value")))
    m = VEC.three_way_merge(c, left, right, "k")
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("v7_vector_clusters")
def q_v7(spark, sf):
    cl = VEC.vector_clusters(Tables(spark, sf).embeddings, "vec_id", "embedding", k=10)
    return cl.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))


@register("v7_cluster_check", sql="SELECT count(*) AS vectors, true AS few_clusters, true AS nearest_centre, true AS tighter_than_one FROM embeddings")
def q_v7_check(spark, sf):
    """What k-means promises: every vector is with its nearest centre (nearly all of them after the last
    step), and clusters are tighter than one cluster of all."""
    t = Tables(spark, sf)
    cl = VEC.vector_clusters(t.embeddings, "vec_id", "embedding", k=10)
    x = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(cl, "vec_id")
    centres = VEC.centroids(x, "cluster", "v", "c")
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, y: s + y)
    all_one = VEC.centroids(x.withColumn("one", F.lit(1)), "one", "v", "mean").select("mean")
    gathered = centres.agg(F.collect_list(F.struct("cluster", "c")).alias("cs")).crossJoin(all_one)  # ten centres and the mean
    y = x.crossJoin(F.broadcast(gathered)).select("cluster", F.transform("cs", lambda k: F.struct(far(F.col("v"), k["c"]).alias("d"), k["cluster"])).alias("d"), far(F.col("v"), F.col("mean")).alias("d0"))
    own = F.aggregate("d", F.lit(0.0), lambda s, k: s + F.when(k["cluster"] == F.col("cluster"), k["d"]).otherwise(0.0))
    z = y.select(own.alias("own"), F.array_min(F.transform("d", lambda k: k["d"])).alias("least"), "d0", "cluster")
    return z.agg(F.count(F.lit(1)).alias("vectors"), (F.countDistinct("cluster") <= 10).alias("few_clusters"), (F.avg((F.col("own") <= F.col("least") + 1e-9).cast("double")) >= 0.9).alias("nearest_centre"),
                 (F.sum("own") < F.sum("d0")).alias("tighter_than_one"))


HYBRID_QUERY = "license software the"


@register("v9_hybrid_search", sql="""
WITH toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM toks),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN ('license', 'software', 'the') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT tf.doc_id, sum(ln((st.n_docs - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl)))
  AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY tf.doc_id),
r1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(-score, 6), doc_id) AS rank FROM bm),
e AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT list(ax ORDER BY dim) AS cv FROM (SELECT dim, avg(x) AS ax FROM (
  SELECT unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e WHERE label = 0) GROUP BY dim)),
r2 AS (SELECT doc_id, row_number() OVER (ORDER BY round(-list_dot_product(v, cv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(cv, cv))), 6), doc_id) AS rank FROM e, c),
u AS (SELECT doc_id, 1.0 / (60 + rank) AS rrf FROM r1 UNION ALL SELECT doc_id, 1.0 / (60 + rank) FROM r2)
SELECT doc_id, round(sum(rrf), 8) AS rrf_score, count(*) AS sources FROM u GROUP BY 1
""")
def q_v9(spark, sf):
    """Keyword ranking of all documents and cosine ranking of all embeddings (the query vector
    is the mean of label 0; vector ids are document ids), fused; neither ranking is cut."""
    from opsmill.operators.relational import ordered_batches

    t = Tables(spark, sf)
    bm = DOC.bm25(t.documents, HYBRID_QUERY).select("doc_id", F.round(-F.col("score"), 6).alias("o"))
    query = _centroids(t).filter("label = 0").select("centroid")
    sims = t.embeddings.crossJoin(F.broadcast(query)).select(F.col("vec_id").alias("doc_id"), F.round(-_cosine(F.col("embedding"), F.col("centroid")), 6).alias("o"))
    ranked = {name: ordered_batches(df, ["o", "doc_id"], 1).select("doc_id", F.col("position").alias("rank")) for name, df in (("keyword", bm), ("vector", sims))}
    f = VEC.reciprocal_rank_fusion(ranked, "doc_id")
    return f.select("doc_id", r("rrf_score", 8).alias("rrf_score"), "sources")


WC_SQL = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@register("v11_conversation_stats", sql=f"""
SELECT conv_id, count(*) AS turns, CAST(count_if(role = 'user') AS BIGINT) AS user_turns, CAST(count_if(role = 'assistant') AS BIGINT) AS assistant_turns,
  CAST(sum({WC_SQL}) AS BIGINT) AS words, round(avg(length(text)), 4) AS avg_chars, CAST(greatest(count_if(role = 'user') - 1, 0) AS BIGINT) AS follow_ups
FROM conversations GROUP BY 1
""")
def q_v11(spark, sf):
    s = EV.conversation_stats(Tables(spark, sf).conversations)
    return s.select("conv_id", "turns", "user_turns", "assistant_turns", "words", r("avg_chars", 4).alias("avg_chars"), "follow_ups")


@register("v12_failure_modes", sql="""
WITH a AS (SELECT CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) > 1500 THEN 'too_long' WHEN length(text) < 20 THEN 'too_short'
  WHEN NOT regexp_matches(trim(text), '[.!?]$') THEN 'truncated' ELSE 'ok' END AS mode FROM conversations WHERE role = 'assistant')
SELECT mode, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY 1
""")
def q_v12(spark, sf):
    f = EV.failure_modes(Tables(spark, sf).conversations)
    return f.select("mode", "n", r("share", 6).alias("share"))


@register("v13_ab_test", sql="""
WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean, var_samp(n_chars) AS var FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1),
a AS (SELECT n AS n_a, mean AS mean_a, var AS var_a FROM g WHERE lang = 'en'), b AS (SELECT n AS n_b, mean AS mean_b, var AS var_b FROM g WHERE lang = 'fr')
SELECT n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b,
  round((mean_b - mean_a) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)), 6) AS cohens_d,
  round((mean_b - mean_a) / sqrt(var_a / n_a + var_b / n_b), 6) AS z, n_a >= 100 AND n_b >= 100 AS enough_samples FROM a, b
""")
def q_v13(spark, sf):
    s = EV.ab_summary(Tables(spark, sf).documents, "lang", "n_chars", "en", "fr")
    return s.select("n_a", "n_b", r("mean_a", 4).alias("mean_a"), r("mean_b", 4).alias("mean_b"), r("cohens_d", 6).alias("cohens_d"),
                    r("z", 6).alias("z"), "enough_samples")


@register("v13_ab_significance", sql="""
WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean, var_samp(n_chars) AS var FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1),
a AS (SELECT n AS n_a, mean AS mean_a, var AS var_a FROM g WHERE lang = 'en'), b AS (SELECT n AS n_b, mean AS mean_b, var AS var_b FROM g WHERE lang = 'fr'),
s AS (SELECT n_a, n_b, (mean_b - mean_a) / sqrt(var_a / n_a + var_b / n_b) AS z FROM a, b),
t AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM s),
p AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS p FROM t)
SELECT n_a, n_b, round(z, 6) AS z, round(p, 6) AS p_value, n_a >= 100 AND n_b >= 100 AND p < 0.05 AS significant FROM p
""")
def q_v13p(spark, sf):
    s = EV.ab_test(Tables(spark, sf).documents, "lang", "n_chars", "en", "fr")
    return s.select("n_a", "n_b", r("z", 6).alias("z"), r("p_value", 6).alias("p_value"), "significant")


@register("v14_rater_agreement", sql="""
WITH x AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*) AS n FROM x),
pa AS (SELECT a AS c, count(*) / (SELECT n FROM n) AS pa FROM x GROUP BY 1), pb AS (SELECT b AS c, count(*) / (SELECT n FROM n) AS pb FROM x GROUP BY 1),
pe AS (SELECT sum(pa * pb) AS pe FROM pa JOIN pb USING (c))
SELECT (SELECT n FROM n) AS samples, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS observed_agreement,
  round((SELECT pe FROM pe), 6) AS expected_agreement,
  round((avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - (SELECT pe FROM pe)) / (1 - (SELECT pe FROM pe)), 6) AS kappa FROM x
""")
def q_v14(spark, sf):
    lab = Tables(spark, sf).labels.select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    k = EV.cohen_kappa(lab, "a", "b")
    return k.select("samples", r("observed_agreement", 6).alias("observed_agreement"),
                    r("expected_agreement", 6).alias("expected_agreement"), r("kappa", 6).alias("kappa"))


@register("v15_rollback_trigger", sql="""
WITH m AS (SELECT ts < TIMESTAMP '2024-01-15' AS base, 1 - avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS success_rate,
  avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate, avg(value) AS cost FROM events GROUP BY 1),
b AS (SELECT * FROM m WHERE base), c AS (SELECT * FROM m WHERE NOT base),
x AS (SELECT list_filter([CASE WHEN c.success_rate < b.success_rate - 0.10 THEN 'success_rate' END,
  CASE WHEN c.error_rate > b.error_rate + 0.05 THEN 'critical_errors' END, CASE WHEN c.cost > b.cost * 1.2 THEN 'cost' END], lambda y: y IS NOT NULL) AS reasons
  FROM b, c)
SELECT array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS rollback FROM x
""")
def q_v15(spark, sf):
    e = Tables(spark, sf).events
    cut = F.lit("2024-01-15").cast("timestamp_ntz")

    def m(df):
        err = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
        return df.agg((1 - err).alias("success_rate"), err.alias("error_rate"), F.avg("value").alias("cost"))
    rb = EV.rollback_trigger(m(e.filter(F.col("ts") < cut)), m(e.filter(F.col("ts") >= cut)))
    return rb.select(F.array_join("reasons", ",").alias("reasons"), "rollback")


PRICES = [("user", 0.5), ("assistant", 1.5), ("system", 0.1)]


@register("v16_token_cost", sql=f"""
WITH u AS (SELECT conv_id, role, {WC_SQL} AS tokens FROM conversations),
p AS (SELECT * FROM (VALUES ('user', 0.5), ('assistant', 1.5), ('system', 0.1)) t(role, price_per_1k))
SELECT conv_id, round(sum(tokens * price_per_1k / 1000.0), 8) AS cost, round(sum(tokens * price_per_1k / 1000.0) / 10.0, 8) AS budget_share
FROM u JOIN p USING (role) GROUP BY 1
""")
def q_v16(spark, sf):
    c = Tables(spark, sf).conversations.select("conv_id", "role", EV.word_count("text").alias("tokens"))
    prices = spark.createDataFrame(PRICES, "role string, price_per_1k double")
    tc = COST.token_cost(c, prices, "role", "tokens", "conv_id", 10.0)
    return tc.select("conv_id", r("cost", 8).alias("cost"), r("budget_share", 8).alias("budget_share"))


@register("v17_tag_allocation", sql=sql_with("usage_cost") + """
SELECT coalesce(cost_center, 'untagged') AS tag, round(sum(amount), 2) AS cost, count(*) AS items, coalesce(cost_center, 'untagged') = 'untagged' AS untagged
FROM usage_cost GROUP BY 1
""")
def q_v17(spark, sf):
    t = COST.tag_allocation(Tables(spark, sf).derived.usage_cost, "cost_center", "amount")
    return t.select("tag", r("cost").alias("cost"), "items", "untagged")


@register("v18_budget_alert", sql=sql_with("usage_cost") + """
SELECT coalesce(cost_center, 'untagged') AS key, strftime(date_trunc('month', day), '%Y-%m-%d') AS month, round(sum(amount), 2) AS actual,
  sum(amount) > 0.8 * 2000000.0 AS alert FROM usage_cost GROUP BY 1, 2
""")
def q_v18(spark, sf):
    b = COST.budget_alerts(Tables(spark, sf).derived.usage_cost, F.coalesce(F.col("cost_center"), F.lit("untagged")), "day", "amount",
                           2000000.0)
    return b.select("key", F.date_format("month", "yyyy-MM-dd").alias("month"), r("actual").alias("actual"), "alert")


@register("v19_lifecycle_tier", sql=sql_with("usage_cost") + """
SELECT CASE WHEN age >= 365 THEN 'expire' WHEN age >= 90 THEN 'glacier' WHEN age >= 30 THEN 'standard_ia' ELSE 'standard' END AS tier,
  count(*) AS objects, round(sum(amount), 2) AS bytes FROM (SELECT datediff('day', day, DATE '1999-01-01') AS age, amount FROM usage_cost) GROUP BY 1
""")
def q_v19(spark, sf):
    u = Tables(spark, sf).derived.usage_cost
    age = F.datediff(F.to_date(F.lit("1999-01-01")), F.col("day"))
    return u.groupBy(COST.lifecycle_tier(age).alias("tier")).agg(F.count(F.lit(1)).alias("objects"), r(F.sum("amount")).alias("bytes"))


@register("v20_utilisation_rightsize", sql=sql_with("usage_cost") + """
, g AS (SELECT resource_id, quantile_cont(amount, 0.95) AS p95, avg(amount) AS mean FROM usage_cost GROUP BY 1)
SELECT CASE WHEN p95 < 20000 THEN 'idle' WHEN mean / p95 < 0.3 THEN 'oversized' ELSE 'right_sized' END AS status, count(*) AS resources
FROM g GROUP BY 1
""")
def q_v20(spark, sf):
    rs = COST.rightsizing(Tables(spark, sf).derived.usage_cost, "resource_id", "amount", 20000.0)
    return rs.groupBy("status").agg(F.count(F.lit(1)).alias("resources"))


@register("v21_cost_anomaly", sql=sql_with("usage_cost") + """
, d AS (SELECT coalesce(cost_center, 'untagged') AS key, day, sum(amount) AS cost FROM usage_cost GROUP BY 1, 2),
z AS (SELECT key, (cost - avg(cost) OVER w) / nullif(stddev_samp(cost) OVER w, 0) AS z FROM d
  WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT key, count(*) AS days, CAST(count_if(coalesce(abs(z) > 3.0, false)) AS BIGINT) AS anomalies FROM z GROUP BY 1
""")
def q_v21(spark, sf):
    u = Tables(spark, sf).derived.usage_cost
    d = u.groupBy(F.coalesce("cost_center", F.lit("untagged")).alias("key"), "day").agg(F.sum("amount").alias("cost"))
    a = COST.cost_anomalies(d, "key", "day", "cost")
    return a.groupBy("key").agg(F.count(F.lit(1)).alias("days"), F.count_if("anomaly").alias("anomalies"))


_SEEDED = "CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|{}'), 1, 15) AS BIGINT)"


@register("v22_synthetic_rows", sql=f"""
SELECT c_custkey, 'user' || CAST({_SEEDED.format('s0e')} % 1000000 AS VARCHAR) || '@example.com' AS email,
  substr(sha256(CAST(c_custkey AS VARCHAR) || 's0'), 1, 8) || '-' || substr(sha256(CAST(c_custkey AS VARCHAR) || 's0'), 9, 4) AS public_id,
  ['active', 'inactive', 'pending'][{_SEEDED.format('s0s')} % 3 + 1] AS status, ({_SEEDED.format('s0a')} % 99901 + 100) / 100.0 AS amount,
  strftime(DATE '2024-01-01' + CAST({_SEEDED.format('s0d')} % 365 AS INTEGER), '%Y-%m-%d') AS created_on FROM customer
""")
def q_v22(spark, sf):
    s = SY.synthetic_rows(Tables(spark, sf).customer.select("c_custkey"), "c_custkey")
    return s.withColumn("created_on", F.date_format("created_on", "yyyy-MM-dd"))


@register("v23_synthetic_relations", sql=f"""
WITH x AS (SELECT c_custkey, unnest(range(1, {_SEEDED.format('r0n')} % 5 + 2)) AS i FROM customer)
SELECT DISTINCT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|r0'), 1, 15) AS BIGINT) % (SELECT count(*) FROM part) AS target FROM x
""")
def q_v23(spark, sf):
    t = Tables(spark, sf)
    n_parts = t.part.count()  # targets are part keys; the count sizes the key space
    return SY.synthetic_relations(t.customer.select("c_custkey"), "c_custkey", n_parts)
