"""Scores, partitions and their evaluation."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.operators.chunks import running_total
from ledgerweave.operators.clusters import best_kmeans, lloyd, nearest, unit
from ledgerweave.operators.graph import reached_by
from ledgerweave.plans.base import ANCHOR_SQL, PAIR_SQL, query, r6, stage, with_
from ledgerweave.plans.events import hash8, hash8_sql
from ledgerweave.plans.networks import DEG_SQL, _spread_sql, graph_degrees, hops, pairs, reach
from ledgerweave.sources.tables import table
from ledgerweave.storage import store

REACH_SQL = f"{_spread_sql(15)}, cc0 AS (SELECT x, sum(v) AS c FROM xs GROUP BY 1), sc AS MATERIALIZED (SELECT dg.addr, own AS y, degree, in_deg, out_deg, round(coalesce(c / (SELECT max(c) FROM cc0), 0), 6) AS score FROM dg LEFT JOIN cc0 ON cc0.x = dg.addr)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, y, degree, in_deg, out_deg, score): every address with its reach and whether it is designated."""

    def make() -> DataFrame:
        return graph_degrees(spark, sf_dir).join(reach(spark, sf_dir), "addr", "left").select("addr", F.col("own").alias("y"), "degree", "in_deg", "out_deg", F.coalesce("score", F.lit(0.0)).alias("score"))

    return stage(spark, sf_dir, "scored", make)


def mean_ranks(values: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, score, n, pos, rank): the average rank of each distinct score, from counts per score.

    ``values`` has keys, score, n (rows) and pos (positives). The counts are cumulated in order of the
    score by chunks, so that no task has to hold or sort all scores of a key.
    """
    per = values.groupBy(*keys, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    run = running_total(per, keys, "n", [F.col(score)])
    return run.select(*keys, score, "n", "pos", (F.col("running") - (F.col("n") - 1) / 2.0).alias("rank"))


def auc_of(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc): chance that a positive outranks a negative, ties counting half."""
    a = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return a.select(*keys, F.when((p > 0) & (q > 0), r6((F.col("s") - p * (p + 1) / 2.0) / (p * q))).alias("auc"))


SCORES = ["score", "degree", "in_deg", "out_deg"]


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("measure"), F.col(s).cast("double").alias("s")) for s in SCORES]))
    hop = hops(spark, sf_dir)
    sets = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("hop") <= 1, "hop_0_1"), F.when((F.col("hop") != 1) | F.col("hop").isNull(), "not_1"))))
    return scored(spark, sf_dir).join(hop, "addr", "left").withColumn("candidates", sets).select("addr", "candidates", each.alias("m"), F.lit(1).alias("n"), F.col("y").cast("int").alias("pos")).select("addr", "candidates", "m.*", "n", "pos")


HOP_SQL = """nb AS (SELECT src AS a, dst AS b FROM pair UNION SELECT dst, src FROM pair), h1 AS (SELECT DISTINCT b AS addr FROM nb WHERE a IN (SELECT addr FROM anchor)), h2 AS (SELECT DISTINCT b AS addr FROM nb WHERE a IN (SELECT addr FROM h1)),
hp AS MATERIALIZED (SELECT addr, CASE WHEN own THEN 0 WHEN addr IN (SELECT addr FROM h1) THEN 1 WHEN addr IN (SELECT addr FROM h2) THEN 2 END AS hop FROM dg)"""
_BASE = with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL, REACH_SQL, HOP_SQL)
_LONG = (
    "lg AS (SELECT sc.addr, candidates, measure, s, y FROM (SELECT addr, y, 'score' AS measure, score::DOUBLE AS s FROM sc UNION ALL SELECT addr, y, 'degree', degree FROM sc UNION ALL SELECT addr, y, 'in_deg', in_deg FROM sc UNION ALL SELECT addr, y, 'out_deg', out_deg FROM sc) sc "
    "JOIN (SELECT addr, 'all' AS candidates FROM hp UNION ALL SELECT addr, 'hop_0_1' FROM hp WHERE hop <= 1 UNION ALL SELECT addr, 'not_1' FROM hp WHERE hop <> 1 OR hop IS NULL) c ON c.addr = sc.addr)"
)


def _auc_sql(rows: str, keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN sum(y::INT) > 0 AND sum(y::INT) < count(*) THEN round((sum(r) FILTER (y) - sum(y::INT) * (sum(y::INT) + 1) / 2) / (sum(y::INT) * (count(*) - sum(y::INT))), 6) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY s) + (count(*) OVER (PARTITION BY {keys}, s) - 1) / 2 AS r FROM {rows}) GROUP BY {keys}"""


@query(_BASE + f", {_LONG} {_auc_sql('lg', 'candidates, measure')}")
def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each measure tells designated addresses, over three sets of candidates."""
    return auc_of(mean_ranks(long_scores(spark, sf_dir), ["candidates", "measure"], "s"), ["candidates", "measure"])


BOOT = 200


@query(_BASE + f""", w AS (SELECT draw, y, score AS s, CASE WHEN u < 3679 THEN 0 WHEN u < 7358 THEN 1 WHEN u < 9197 THEN 2 WHEN u < 9810 THEN 3 ELSE 4 END AS k FROM (SELECT draw, y, score, {hash8_sql("'auc'", 'draw', 'addr')} % 10000 AS u FROM sc CROSS JOIN (SELECT unnest(range({BOOT})) AS draw))),
  g AS (SELECT draw, s, sum(k) AS n, sum(k) FILTER (y) AS p FROM w GROUP BY 1, 2), r AS (SELECT draw, n, coalesce(p, 0) AS p, sum(n) OVER (PARTITION BY draw ORDER BY s) - (n - 1) / 2.0 AS rank FROM g)
  SELECT draw, round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 6) AS auc FROM r GROUP BY 1""")
def q_auc_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled with Poisson weights drawn by hash: each row carries its multiplicity, none is copied."""
    u = hash8(F.lit("auc"), "draw", "addr") % 10000
    k = F.when(u < 3679, 0).when(u < 7358, 1).when(u < 9197, 2).when(u < 9810, 3).otherwise(4)
    w = scored(spark, sf_dir).crossJoin(F.broadcast(spark.range(BOOT).withColumnRenamed("id", "draw"))).select("draw", "score", k.alias("n"), (k * F.col("y").cast("int")).alias("pos"))
    return auc_of(mean_ranks(w, ["draw"], "score"), ["draw"])


@query(_BASE + f""", w AS (SELECT draw, y, measure, s, CASE WHEN u < 3679 THEN 0 WHEN u < 7358 THEN 1 WHEN u < 9197 THEN 2 WHEN u < 9810 THEN 3 ELSE 4 END AS k FROM (SELECT draw, y, measure, s, {hash8_sql("'auc'", 'draw', 'addr')} % 10000 AS u FROM (SELECT addr, y, 'score' AS measure, score::DOUBLE AS s FROM sc UNION ALL SELECT addr, y, 'degree', degree FROM sc) CROSS JOIN (SELECT unnest(range({BOOT})) AS draw))),
  g AS (SELECT draw, measure, s, sum(k) AS n, coalesce(sum(k) FILTER (y), 0) AS p FROM w GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER (PARTITION BY draw, measure ORDER BY s) - (n - 1) / 2.0 AS rank FROM g),
  au AS (SELECT draw, measure, CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 6) END AS auc FROM r GROUP BY 1, 2), dif AS (SELECT draw, max(auc) FILTER (measure = 'score') - max(auc) FILTER (measure = 'degree') AS d FROM au GROUP BY 1)
  SELECT count(d) AS draws, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM dif""")
def q_auc_diff_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference between two measures' AUC, both resampled with the same weights."""
    u = hash8(F.lit("auc"), "draw", "addr") % 10000
    k = F.when(u < 3679, 0).when(u < 7358, 1).when(u < 9197, 2).when(u < 9810, 3).otherwise(4)
    w = scored(spark, sf_dir).crossJoin(F.broadcast(spark.range(BOOT).withColumnRenamed("id", "draw"))).withColumn("k", k)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("s")) for m in ("score", "degree")])).alias("m")
    w = w.select("draw", each, F.col("k").alias("n"), (F.col("k") * F.col("y").cast("int")).alias("pos")).select("draw", "m.*", "n", "pos")
    a = auc_of(mean_ranks(w, ["draw", "measure"], "s"), ["draw", "measure"])
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("auc")))
    d = a.groupBy("draw").agg((of("score") - of("degree")).alias("d"))
    return d.agg(F.count("d").alias("draws"), r6(F.avg("d")).alias("mean"), r6(F.percentile("d", 0.025)).alias("low"), r6(F.percentile("d", 0.975)).alias("high"))


KS = [50, 100, 500, 1000]


@query(_BASE + f", r AS (SELECT y, row_number() OVER (ORDER BY score DESC, addr) AS i FROM sc) SELECT k, count(*) FILTER (y AND i <= k) AS hits, round(count(*) FILTER (y AND i <= k) / (SELECT count(*) FROM sc WHERE y), 8) AS recall FROM r CROSS JOIN (SELECT unnest({KS}) AS k) GROUP BY 1")
def q_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    top = s.orderBy(F.desc("score"), "addr").limit(max(KS)).select("y", F.row_number().over(Window.orderBy(F.desc("score"), "addr")).alias("i"))
    ks = spark.createDataFrame([(k,) for k in KS], "k int")
    n = s.agg(F.count_if("y").alias("of"))
    return top.crossJoin(F.broadcast(ks)).groupBy("k").agg(F.count_if(F.col("y") & (F.col("i") <= F.col("k"))).alias("hits")).crossJoin(n).select("k", "hits", F.round(F.col("hits") / F.col("of"), 8).alias("recall"))


@query(_BASE + " SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (score >= th) AS flagged, count(*) FILTER (score >= th AND y) AS designated FROM sc CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]) AS th) GROUP BY 1")
def q_threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    th = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)])).alias("threshold")
    over = F.col("score") >= F.col("threshold")
    return scored(spark, sf_dir).select("score", "y", th).groupBy("threshold").agg(F.count_if(over).alias("flagged"), F.count_if(over & F.col("y")).alias("designated"))


@query(_BASE + " SELECT hop, count(*) AS n, round(avg(degree), 6) AS mean_degree, round(median(degree), 6) AS median_degree FROM dg JOIN hp USING (addr) GROUP BY 1")
def q_degree_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph_degrees(spark, sf_dir).join(hops(spark, sf_dir), "addr")
    return d.groupBy("hop").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("degree")).alias("mean_degree"), r6(F.median("degree")).alias("median_degree"))


@query(_BASE + ", r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2 AS b FROM sc) SELECT round(corr(a, b), 6) AS spearman FROM r")
def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("score", F.col("degree").cast("double").alias("degree"), F.lit(1).alias("n"), F.lit(0).alias("pos"))
    # each column is ranked over its own distinct values
    a = mean_ranks(s.select(F.lit(0).alias("g"), "score", "n", "pos"), ["g"], "score").select("score", F.col("rank").alias("ra"))
    b = mean_ranks(s.select(F.lit(0).alias("g"), "degree", "n", "pos"), ["g"], "degree").select("degree", F.col("rank").alias("rb"))
    return s.join(a, "score").join(b, "degree").agg(r6(F.corr("ra", "rb")).alias("spearman"))


K = 5


def role(x: Column, seed: str) -> Column:
    return hash8(F.lit(seed), x) % K


def role_sql(x: str, seed: str) -> str:
    return f"{hash8_sql(f"'{seed}'", x)} % {K}"


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): the embeddings' labels, and the label whose mean is nearest to each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("a"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = e.select("a", F.posexplode("e").alias("i", "x")).groupBy("a", "i").agg(F.avg("x").alias("m")).groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("m"))
    all_ = means.agg(F.collect_list(F.struct("a", "m")).alias("means"))  # one row per label
    far = lambda m: F.aggregate(F.zip_with("e", m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = F.array_min(F.transform("means", lambda c: F.struct(far(c["m"]).alias("d"), c["a"].alias("a"))))
    return stage(spark, sf_dir, "partitions", lambda: e.crossJoin(F.broadcast(all_)).select("id", "a", near["a"].alias("b")))


_PART = "ed AS MATERIALIZED (SELECT vec_id AS id, label::BIGINT AS a, embedding::DOUBLE[] AS e FROM embeddings), cm AS MATERIALIZED (SELECT a AS b, list(m ORDER BY i) AS m FROM (SELECT a, i, avg(e[i]) AS m FROM ed, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i) GROUP BY 1, 2) GROUP BY 1), pt AS MATERIALIZED (SELECT id, any_value(a) AS a, arg_min(b, list_distance(e, m)) AS b FROM ed, cm GROUP BY 1), ct AS (SELECT a, b, count(*) AS n FROM pt GROUP BY 1, 2), ca AS (SELECT a, sum(n) AS n FROM ct GROUP BY 1), cb AS (SELECT b, sum(n) AS n FROM ct GROUP BY 1), cn AS (SELECT sum(n)::DOUBLE AS n FROM ct)"


def contingency(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ct = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return ct, ct.groupBy("a").agg(F.sum("n").alias("na")), ct.groupBy("b").agg(F.sum("n").alias("nb")), ct.agg(F.sum("n").cast("double").alias("nn"))


@query(f"WITH {_PART}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS i, (SELECT sum(n * (n - 1) / 2) FROM ca) AS a, (SELECT sum(n * (n - 1) / 2) FROM cb) AS b, (SELECT n * (n - 1) / 2 FROM cn) AS t) SELECT round((i - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM s")
def q_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ari_of(partitions(spark, sf_dir))


def ari_of(p: DataFrame) -> DataFrame:
    """(ari) of two partitions a and b of the same rows."""
    ct, a, b, n = contingency(p)
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    s = ct.agg(two("n").alias("i")).crossJoin(a.agg(two("na").alias("a"))).crossJoin(b.agg(two("nb").alias("b"))).crossJoin(n)
    t = F.col("nn") * (F.col("nn") - 1) / 2
    chance = F.col("a") * F.col("b") / t
    return s.select(r6((F.col("i") - chance) / ((F.col("a") + F.col("b")) / 2 - chance)).alias("ari"))


@query(f"WITH {_PART}, s AS (SELECT (SELECT sum(ct.n / cn.n * ln(ct.n * cn.n / (ca.n * cb.n))) FROM ct JOIN ca USING (a) JOIN cb ON cb.b = ct.b, cn) AS i, (SELECT -sum(ca.n / cn.n * ln(ca.n / cn.n)) FROM ca, cn) AS ha, (SELECT -sum(cb.n / cn.n * ln(cb.n / cn.n)) FROM cb, cn) AS hb) SELECT round(2 * i / (ha + hb), 6) AS nmi FROM s")
def q_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct, a, b, n = contingency(partitions(spark, sf_dir))
    x = ct.join(a, "a").join(b, "b").crossJoin(n)
    i = x.agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("na") * F.col("nb")))).alias("i"))
    h = lambda df, c, o: df.crossJoin(n).agg((-F.sum(F.col(c) / F.col("nn") * F.log(F.col(c) / F.col("nn")))).alias(o))
    return i.crossJoin(h(a, "na", "ha")).crossJoin(h(b, "nb", "hb")).select(r6(2 * F.col("i") / (F.col("ha") + F.col("hb"))).alias("nmi"))


@query(f"WITH {_PART} SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM ct GROUP BY b)) / n, 6) AS purity FROM cn")
def q_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct, _, _, n = contingency(partitions(spark, sf_dir))
    return ct.groupBy("b").agg(F.max("n").alias("m")).agg(F.sum("m").alias("m")).crossJoin(n).select(r6(F.col("m") / F.col("nn")).alias("purity"))


LLOYD_STEPS = 6
STARTS = [[-0.7, -0.6], [0.1, 0.9], [1.3, -0.4], [2.1, 1.7], [0.4, -1.1]]


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, own, in_deg, out_deg, role): clusters of the standardised log degrees, by six steps from fixed centres.

    Addresses of equal degrees are one point with a weight, so the steps run over the distinct degrees.
    """

    def make() -> DataFrame:
        d = graph_degrees(spark, sf_dir).select("addr", "own", "in_deg", "out_deg")
        point = d.groupBy("in_deg", "out_deg").agg(F.count(F.lit(1)).alias("n"))
        kept = store(point.select(F.log1p(F.col("in_deg").cast("double")).alias("i"), F.log1p(F.col("out_deg").cast("double")).alias("o"), "n"), "points")
        w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
        mean = kept.df.agg(w("i").alias("i"), w("o").alias("o")).first()
        sd = kept.df.agg(*[F.sqrt(F.sum(F.col("n") * F.pow(F.col(c) - F.lit(mean[c]), F.lit(2.0))) / F.sum("n")).alias(c) for c in ("i", "o")]).first()
        z = lambda c, x: (x - F.lit(mean[c] or 0.0)) / F.lit(max(sd[c] or 0.0, 1e-9))
        centres = lloyd(kept.df.select(z("i", F.col("i")).alias("x"), z("o", F.col("o")).alias("y"), "n"), ["x", "y"], "n", STARTS, LLOYD_STEPS)
        kept.drop()
        at = d.withColumn("x", z("i", F.log1p(F.col("in_deg").cast("double")))).withColumn("y", z("o", F.log1p(F.col("out_deg").cast("double"))))
        return at.select("addr", "own", "in_deg", "out_deg", nearest(["x", "y"], centres).alias("role"))

    return stage(spark, sf_dir, "roles", make)


def _roles_sql() -> str:
    z = "zr AS MATERIALIZED (SELECT addr, own, in_deg, out_deg, (ln(1 + in_deg) - avg(ln(1 + in_deg)) OVER ()) / greatest(stddev_pop(ln(1 + in_deg)) OVER (), 1e-9) AS x, (ln(1 + out_deg) - avg(ln(1 + out_deg)) OVER ()) / greatest(stddev_pop(ln(1 + out_deg)) OVER (), 1e-9) AS y FROM dg)"
    parts = [z, "k0(k, x, y) AS (VALUES " + ", ".join(f"({k}::BIGINT, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(STARTS)) + ")"]
    for t in range(LLOYD_STEPS):
        near = f"SELECT addr, any_value(zr.x) AS x, any_value(zr.y) AS y, arg_min(k, (zr.x - c.x) ** 2 + (zr.y - c.y) ** 2) AS k FROM zr, k{t} c GROUP BY 1"
        parts.append(f"k{t + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.x, o.x) AS x, coalesce(n.y, o.y) AS y FROM k{t} o LEFT JOIN (SELECT k, avg(x) AS x, avg(y) AS y FROM ({near}) GROUP BY 1) n ON n.k = o.k)")
    parts.append(f"rl AS MATERIALIZED (SELECT addr, any_value(own) AS own, any_value(in_deg) AS in_deg, any_value(out_deg) AS out_deg, arg_min(k, (zr.x - c.x) ** 2 + (zr.y - c.y) ** 2) AS role FROM zr, k{LLOYD_STEPS} c GROUP BY 1)")
    return ", ".join(parts)


_ROLE = _roles_sql()


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_ROLE} SELECT addr, role FROM rl")
def q_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles(spark, sf_dir).select("addr", "role")


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_ROLE}, g AS (SELECT role, count(*) AS n, count(*) FILTER (own) AS s FROM rl GROUP BY 1) SELECT round(max(s / n), 8) AS max_density, round(-sum(CASE WHEN s > 0 THEN s / t * ln(s / t) ELSE 0 END) / ln({K}), 6) AS entropy, round(max(s / t), 6) AS top_share FROM g, (SELECT sum(s) AS t FROM g)")
def q_anchor_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = roles(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("s"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("s").alias("t"))))
    p = F.col("s") / F.col("t")
    return g.agg(F.round(F.max(F.col("s") / F.col("n")), 8).alias("max_density"), r6(-F.sum(F.when(F.col("s") > 0, p * F.log(p)).otherwise(0.0)) / F.log(F.lit(float(K)))).alias("entropy"), r6(F.max(p)).alias("top_share"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_ROLE} SELECT role, count(*) AS n, round(avg(in_deg), 6) AS mean_in, round(avg(out_deg), 6) AS mean_out, count(*) FILTER (own) AS n_own, CASE WHEN greatest(avg(in_deg), avg(out_deg)) >= 8 THEN 'hub' WHEN avg(out_deg) >= 1.5 * avg(in_deg) THEN 'sender' WHEN avg(in_deg) >= 1.5 * avg(out_deg) THEN 'receiver' ELSE 'relay' END AS family FROM rl GROUP BY 1")
def q_role_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, o = F.avg("in_deg"), F.avg("out_deg")
    family = F.when(F.greatest(i, o) >= 8, "hub").when(o >= 1.5 * i, "sender").when(i >= 1.5 * o, "receiver").otherwise("relay")
    return roles(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), r6(i).alias("mean_in"), r6(o).alias("mean_out"), F.count_if("own").alias("n_own"), family.alias("family"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_ROLE} SELECT src AS addr, role, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS share FROM pair JOIN rl ON rl.addr = dst GROUP BY 1, 2")
def q_role_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of roles among the out-neighbours of each address."""
    c = pairs(spark, sf_dir).join(roles(spark, sf_dir).select(F.col("addr").alias("dst"), "role"), "dst").select(F.col("src").alias("addr"), "role").groupBy("addr", "role").agg(F.count(F.lit(1)).alias("n"))
    return c.select("addr", "role", r6(F.col("n") / F.sum("n").over(Window.partitionBy("addr"))).alias("share"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_ROLE}, e AS (SELECT a.role AS ra, b.role AS rb, count(*) AS n FROM pair JOIN rl a ON a.addr = src JOIN rl b ON b.addr = dst GROUP BY 1, 2), m AS (SELECT sum(n)::DOUBLE AS m FROM e), de AS (SELECT ra AS r, sum(n) AS d FROM (SELECT ra, n FROM e UNION ALL SELECT rb, n FROM e) GROUP BY 1) SELECT round((SELECT sum(n) FROM e WHERE ra = rb) / m - (SELECT sum((d / (2 * m.m)) ** 2) FROM de, m), 8) AS modularity FROM m")
def q_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = roles(spark, sf_dir)
    e = pairs(spark, sf_dir).join(r.select(F.col("addr").alias("src"), F.col("role").alias("ra")), "src").join(r.select(F.col("addr").alias("dst"), F.col("role").alias("rb")), "dst")
    e = e.groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("n"))
    m = e.agg(F.sum("n").cast("double").alias("m"), F.sum(F.when(F.col("ra") == F.col("rb"), F.col("n"))).alias("same"))
    d = e.select(F.explode(F.array("ra", "rb")).alias("r"), "n").groupBy("r").agg(F.sum("n").alias("d")).crossJoin(F.broadcast(m))
    a2 = d.agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("a2"))
    return m.crossJoin(a2).select(F.round(F.col("same") / F.col("m") - F.col("a2"), 8).alias("modularity"))


SINK_K, EPS, ITERS = 8, 0.05, 3


def _sinkhorn_sql(balance: float = 1.0) -> str:
    parts = [f"l0 AS (SELECT vec_id AS id, u.k, exp(embedding[u.k + 1]::DOUBLE / {EPS} / 8) AS q FROM embeddings, (SELECT unnest(range({SINK_K})) AS k) u), q0 AS MATERIALIZED (SELECT id, k, q / (SELECT sum(q) FROM l0) AS q FROM l0), nn AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM l0)"]
    for i in range(ITERS):
        parts.append(f"a{i} AS (SELECT id, k, q * pow(1 / ({SINK_K} * sum(q) OVER (PARTITION BY k)), {balance}) AS q FROM q{i}), q{i + 1} AS MATERIALIZED (SELECT id, k, q / (sum(q) OVER (PARTITION BY id) * n) AS q FROM a{i}, nn)")
    return ", ".join(parts)


@query(f"WITH {_sinkhorn_sql()} SELECT id, k, round(q * n, 6) AS q FROM q{ITERS}, nn")
def q_sinkhorn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced assignment of rows to prototypes: three rounds of scaling columns, then rows."""
    return sinkhorn(spark, sf_dir, 1.0)


@query(f"WITH {_sinkhorn_sql(0.5)} SELECT id, k, round(q * n, 6) AS q FROM q{ITERS}, nn")
def q_sinkhorn_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the columns' scale to the power of a half, so that prototypes may differ in size."""
    return sinkhorn(spark, sf_dir, 0.5)


def sinkhorn(spark: SparkSession, sf_dir: str, balance: float) -> DataFrame:
    """(id, k, q). Column sums are aggregates of few rows joined back by broadcast; a row's scores sit in one array."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.exp(F.col("embedding")[k].cast("double") / EPS / 8).alias(f"q{k}") for k in range(SINK_K)])
    cols = [f"q{k}" for k in range(SINK_K)]
    n = e.count()
    for _ in range(ITERS):
        s = e.agg(*[F.sum(c).alias(f"s_{c}") for c in cols])
        e = e.crossJoin(F.broadcast(s)).select("id", *[(F.col(c) * F.pow(1 / (SINK_K * F.col(f"s_{c}")), F.lit(balance))).alias(c) for c in cols])
        row = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        e = e.withColumn("row", row).select("id", *[(F.col(c) / (F.col("row") * n)).alias(c) for c in cols])
    return e.select("id", F.posexplode(F.array(*cols)).alias("k", "q")).select("id", F.col("k").cast("bigint").alias("k"), r6(F.col("q") * n).alias("q"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + ", z AS (SELECT addr, ln(1 + in_deg) AS h FROM dg), e AS (SELECT src, dst, CASE WHEN x >= 0 THEN x ELSE 0.2 * x END AS s, hs FROM (SELECT src, dst, a.h - 0.5 * b.h + 0.1 * ln(1 + CAST(w AS DOUBLE)) AS x, a.h AS hs FROM pair JOIN z a ON a.addr = src JOIN z b ON b.addr = dst)), m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY dst)) AS g FROM e) SELECT dst AS addr, round(sum(g * hs) / sum(g), 6) AS attended FROM m GROUP BY 1")
def q_attention_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attention head with fixed weights: softmax over in-edges of a leaky score, weighted mean of the senders."""
    z = graph_degrees(spark, sf_dir).select("addr", F.log1p(F.col("in_deg").cast("double")).alias("h"))
    e = pairs(spark, sf_dir).join(z.select(F.col("addr").alias("src"), F.col("h").alias("hs")), "src").join(z.select(F.col("addr").alias("dst"), F.col("h").alias("hd")), "dst")
    x = F.col("hs") - 0.5 * F.col("hd") + 0.1 * F.log1p(F.col("w").cast("double"))
    e = e.withColumn("s", F.when(x >= 0, x).otherwise(0.2 * x))
    top = e.groupBy("dst").agg(F.max("s").alias("m"))
    g = F.exp(F.col("s") - F.col("m"))
    return e.join(top, "dst").groupBy(F.col("dst").alias("addr")).agg(r6(F.sum(g * F.col("hs")) / F.sum(g)).alias("attended"))


INITS = 10


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(unit(F.col("embedding"))).alias("features"))


def q_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical k-means on the embeddings: rows of unit length, the best of ten first choices."""
    v = stage(spark, sf_dir, "unit_vectors", lambda: unit_vectors(spark, sf_dir))
    return best_kmeans(v, 9, list(range(INITS))).transform(v).select("vec_id", F.col("prediction").alias("role"))


def q_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplified silhouette (squared Euclidean to the centres) of the unit vectors, for several numbers of roles."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    v = stage(spark, sf_dir, "unit_vectors", lambda: unit_vectors(spark, sf_dir))
    found = [(k, float(ClusteringEvaluator().evaluate(best_kmeans(v, k, list(range(5))).transform(v)))) for k in (6, 9, 12)]
    return spark.createDataFrame(found, "k int, silhouette double")


def q_kmeans_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement (adjusted Rand index) of the roles that five different first choices lead to."""
    v = stage(spark, sf_dir, "unit_vectors", lambda: unit_vectors(spark, sf_dir))
    runs = [store(best_kmeans(v, 9, [s]).transform(v).select("vec_id", F.col("prediction").alias(f"r{s}")), "roles").df for s in range(5)]
    joined = runs[0]
    for r in runs[1:]:
        joined = joined.join(r, "vec_id")
    found = None
    for i in range(5):
        for j in range(i + 1, 5):
            one = ari_of(joined.select(F.col(f"r{i}").alias("a"), F.col(f"r{j}").alias("b"))).select(F.lit(i).alias("first"), F.lit(j).alias("second"), "ari")
            found = one if found is None else found.unionByName(one)
    return found


CASCADE_DRAWS = 3

_PW_SQL = "pw AS (SELECT src, dst, greatest(1e-6, least(1, ln(1 + CAST(w AS DOUBLE)) * 0.1 / ln(1 + 1e8))) AS p FROM pair)"
CASCADE_SQL = f"""dr AS (SELECT unnest(range({CASCADE_DRAWS})) AS draw),
  lv AS MATERIALIZED (SELECT draw, src, dst FROM pw CROSS JOIN dr WHERE {hash8_sql("'live'", 'draw', 'src', 'dst')} < p * 4294967296),
  re(draw, source, node) AS (SELECT draw, src, dst FROM lv UNION SELECT re.draw, source, dst FROM re JOIN lv ON lv.draw = re.draw AND lv.src = re.node),
  hi AS (SELECT node AS addr, count(*) AS hits FROM re WHERE node <> source GROUP BY 1),
  ca AS MATERIALIZED (SELECT addr, coalesce(hits, 0) AS hits, coalesce(hits, 0) / (count(*) OVER () * {CASCADE_DRAWS}) AS coverage FROM dg LEFT JOIN hi USING (addr))"""


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_PW_SQL}, {CASCADE_SQL} SELECT addr, hits, coverage FROM ca")
def q_cascade_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent cascades as reachability over edges that a hashed coin keeps alive, from every address, without a
    limit of steps; an address that no other one reaches has no hits.
    """
    w = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.log1p(F.col("w").cast("double")) * 0.1 / F.log1p(F.lit(1e8))))
    draws = F.broadcast(spark.range(CASCADE_DRAWS).withColumnRenamed("id", "draw"))
    live = pairs(spark, sf_dir).select("src", "dst", w.alias("p")).crossJoin(draws).filter(hash8(F.lit("live"), "draw", "src", "dst") < F.col("p") * 4294967296).select("draw", F.col("src").alias("node"), "dst")
    live = stage(spark, sf_dir, "live", lambda: live)
    hits = stage(spark, sf_dir, "hits", lambda: cascade_hits(live))
    nodes = graph_degrees(spark, sf_dir).select("addr")
    return nodes.join(hits, "addr", "left").select("addr", F.coalesce("hits", F.lit(0)).alias("hits")).withColumn("coverage", F.col("hits") / (nodes.count() * CASCADE_DRAWS))


def cascade_hits(live: DataFrame) -> DataFrame:
    """(addr, hits): from how many other addresses each is reached over live edges (draw, node, dst), summed over draws.

    The draws are disjoint parts of one graph, whose nodes are numbered to keep the rows short.
    """
    ids = store(live.select("draw", F.explode(F.array("node", "dst")).alias("addr")).distinct().withColumn("id", F.monotonically_increasing_id()), "ids").df
    e = live.join(ids.select("draw", F.col("addr").alias("node"), F.col("id").alias("u")), ["draw", "node"]).join(ids.select("draw", F.col("addr").alias("dst"), F.col("id").alias("v")), ["draw", "dst"])
    return reached_by(e).join(ids, F.col("node") == F.col("id")).groupBy("addr").agg(F.sum("n").alias("hits"))


query()(q_kmeans)
query()(q_silhouette)
query()(q_kmeans_stability)
