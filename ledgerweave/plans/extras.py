"""Comparison of outputs, calendar grids, matched controls, agreement of scores, consensus of partitions."""

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ledger import DAY_MS, address, usable_amount
from ledgerweave.operators.factors import factorise
from ledgerweave.operators.graph import betweenness
from ledgerweave.plans.base import ACT_SQL, ANCHOR_SQL, END_MS, T_SQL, W, WEEK_MS, activity, anchors, money, query, r6, stage, transfers, with_
from ledgerweave.plans.custody import _DAY_SQL, BUSY_SQL, appeal
from ledgerweave.plans.events import A_SQL, about, anchored, hash8, hash8_sql, hop1, timing
from ledgerweave.plans.features import structural
from ledgerweave.plans.labelling import CAT_SQL, NEGATIVE, _list, categories
from ledgerweave.plans.networks import DEG_SQL, PAIR_SQL, graph_degrees, pairs
from ledgerweave.plans.scoring import _BASE, CASCADE_SQL, ITERS, K, _auc_sql, _sinkhorn_sql, auc_of, mean_ranks, q_cascade_mc, q_sinkhorn, role, role_sql, scored
from ledgerweave.sources.tables import TRANSFERS, table


@query(f"""WITH {T_SQL}, raw AS (SELECT right(lower(to_hex), 40) AS dst, CAST(value AS DECIMAL(20,6)) AS v, blockTimestamp AS ms FROM {TRANSFERS} WHERE value > 0 AND value <= 1e8 AND blockTimestamp IS NOT NULL AND to_hex IS NOT NULL AND from_hex IS NOT NULL),
  b AS (SELECT ms // {28 * DAY_MS} AS period, CAST(sum(v) AS DOUBLE) AS x FROM raw GROUP BY 1), a AS (SELECT ms // {28 * DAY_MS} AS period, CAST(sum(v) AS DOUBLE) AS x FROM t GROUP BY 1)
  SELECT coalesce(a.period, b.period) AS period, b.x AS before, a.x AS after, round((a.x / b.x - 1) * 100, 6) AS change_pct FROM a FULL JOIN b ON a.period = b.period""")
def q_compare_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume per four weeks before and after repeated deliveries are taken out, and its relative change."""
    raw = table(spark, sf_dir, TRANSFERS).select(address("to_hex").alias("dst"), address("from_hex").alias("src"), usable_amount("value").alias("v"), F.col("blockTimestamp").alias("ms")).dropna()
    per = lambda df, name: df.groupBy(F.floor(F.col("ms") / (28 * DAY_MS)).alias("period")).agg(money(F.sum("v")).alias(name))
    x = per(raw, "before").join(per(transfers(spark, sf_dir), "after"), "period", "full")
    return x.select("period", "before", "after", r6((F.col("after") / F.col("before") - 1) * 100).alias("change_pct"))


@query(f"WITH {T_SQL}, {BUSY_SQL}, dd AS (SELECT {_DAY_SQL} AS day, sum(v) AS v FROM ap GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round(CAST(sum(v) OVER (ORDER BY day) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 8) AS cum_share FROM dd")
def q_daily_cumshare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative share of what the busiest receiver got, by day; one row per day is windowed."""
    d = appeal(spark, sf_dir).groupBy(F.date_from_unix_date(F.floor(F.col("ms") / DAY_MS).cast("int")).alias("day")).agg(F.sum("v").alias("v"))
    run = F.sum("v").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return d.select(F.col("day").cast("string").alias("day"), F.round(money(run) / money(F.sum("v").over(Window.partitionBy())), 8).alias("cum_share"))


WEEK0_MS = 1_578_268_800_000  # 2020-01-06, a Monday


@query(with_(A_SQL) + f"SELECT addr, (ms - {WEEK0_MS}) // {WEEK_MS} AS calendar_week, count(*) AS n, CAST(sum(v) AS DOUBLE) AS volume FROM a GROUP BY 1, 2")
def q_calendar_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by calendar week since 2020-01-06, in long form."""
    return anchored(spark, sf_dir).groupBy("addr", F.floor((F.col("ms") - WEEK0_MS) / WEEK_MS).alias("calendar_week")).agg(F.count(F.lit(1)).alias("n"), money(F.sum("v")).alias("volume"))


@query(with_(ACT_SQL, ANCHOR_SQL) + """SELECT 'transfers' AS relation, count(*) AS n_rows, count(DISTINCT src) AS n_keys FROM t UNION ALL SELECT 'designated', count(*), count(DISTINCT ord) FROM anchor
  UNION ALL SELECT 'designated_active', count(*), count(DISTINCT act.addr) FROM act JOIN anchor ON act.addr = anchor.addr UNION ALL SELECT 'blacklist', count(*), count(DISTINCT right(lower(addr_hex), 40)) FROM tron_usdt_blacklist_added""")
def q_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, name, key: df.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
    anchor = anchors(spark, sf_dir)
    out = count(transfers(spark, sf_dir), "transfers", F.col("src")).union(count(anchor, "designated", F.col("ord")))
    out = out.union(count(about(activity(spark, sf_dir), anchor.select("addr")), "designated_active", F.col("addr")))
    return out.union(count(table(spark, sf_dir, "tron_usdt_blacklist_added"), "blacklist", address("addr_hex")))


_VN = with_(PAIR_SQL, ANCHOR_SQL, CAT_SQL, DEG_SQL) + f", vn AS (SELECT 'degree' AS measure, dg.degree::DOUBLE AS s, own AS y FROM dg LEFT JOIN ac ON ac.addr = dg.addr WHERE own OR ac.category IN {_list(NEGATIVE)}) "


@query(_VN + _auc_sql("vn", "measure"))
def q_verified_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designated addresses against those whose labels vouch for them."""
    d = graph_degrees(spark, sf_dir).join(categories(spark, sf_dir), "addr", "left").filter(F.col("own") | F.col("category").isin(NEGATIVE))
    v = d.select(F.lit("degree").alias("measure"), F.col("degree").cast("double").alias("s"), F.lit(1).alias("n"), F.col("own").cast("int").alias("pos"))
    return auc_of(mean_ranks(v, ["measure"], "s"), ["measure"])


@query(_BASE + f", {CASCADE_SQL}, r AS (SELECT rank() OVER (ORDER BY hits) + (count(*) OVER (PARTITION BY hits) - 1) / 2 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS b FROM ca JOIN sc USING (addr)) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r")
def q_mc_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of expected reach and simulated coverage over all addresses."""
    c = q_cascade_mc(spark, sf_dir).join(scored(spark, sf_dir), "addr").select("hits", "score", F.lit(1).alias("n"), F.lit(0).alias("pos"), F.lit(0).alias("g"))
    a = mean_ranks(c, ["g"], "hits").select("hits", F.col("rank").alias("ra"))
    b = mean_ranks(c, ["g"], "score").select("score", F.col("rank").alias("rb"))
    return c.join(a, "hits").join(b, "score").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("ra", "rb")).alias("spearman"))


@query(_BASE + " SELECT addr, round(ln(1 + 1000 * score) / ln(1001), 6) AS target FROM sc")
def q_log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("addr", r6(F.log1p(F.col("score") * 1000) / F.log(F.lit(1001.0))).alias("target"))


@query(f"WITH {_sinkhorn_sql()}, o AS (SELECT id, k, round(q * n, 6) AS q FROM q{ITERS}, nn) SELECT id, k AS prototype, q AS share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q DESC, k) AS rn FROM o) WHERE rn = 1")
def q_prototype_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prototype with the largest balanced share of each row; of equal ones the first."""
    best = q_sinkhorn(spark, sf_dir).groupBy("id").agg(F.max(F.struct("q", (-F.col("k")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("prototype"), F.col("b.q").alias("share"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + ", z AS (SELECT addr, ln(1 + in_deg) AS a, ln(1 + out_deg) AS b FROM dg), m AS (SELECT src AS addr, avg(z.a) AS a, avg(z.b) AS b FROM pair JOIN z ON z.addr = dst GROUP BY 1) SELECT count(*) AS n, round(avg((z.a - m.a) ** 2 + (z.b - m.b) ** 2), 6) AS loss FROM z JOIN m USING (addr)")
def q_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance of an address's features from the mean of its out-neighbours'."""
    z = graph_degrees(spark, sf_dir).select("addr", F.log1p(F.col("in_deg").cast("double")).alias("a"), F.log1p(F.col("out_deg").cast("double")).alias("b"))
    m = pairs(spark, sf_dir).select("src", F.col("dst").alias("addr")).join(z, "addr").groupBy(F.col("src").alias("addr")).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    d = F.pow(F.col("a") - F.col("ma"), F.lit(2.0)) + F.pow(F.col("b") - F.col("mb"), F.lit(2.0))
    return z.join(m, "addr").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(d)).alias("loss"))


def best_relabelling(counts: dict[tuple[int, int], int], k: int) -> list[int]:
    """For each label the reference label it goes to, by the heaviest one-to-one assignment.

    Subsets of reference labels are gone through in order (2^k states); of equal weights the first
    permutation in dictionary order wins.
    """
    best: dict[int, tuple[int, list[int]]] = {0: (0, [])}
    for label in range(k):
        after: dict[int, tuple[int, list[int]]] = {}
        for used, (weight, path) in best.items():
            for ref in range(k):
                if not used >> ref & 1:
                    cand = (weight + counts.get((label, ref), 0), [*path, ref])
                    old = after.get(used | 1 << ref)
                    if old is None or cand[0] > old[0] or (cand[0] == old[0] and cand[1] < old[1]):
                        after[used | 1 << ref] = cand
        best = after
    return best[(1 << k) - 1][1]


PARTS = 3
_PERMS = ", ".join("(" + ", ".join(map(str, p)) + ")" for p in permutations(range(K)))
_DRIFT_SQL = f"""cp AS (SELECT vec_id AS id, p, CASE WHEN p = 0 OR {hash8_sql("'stay'", 'p', 'vec_id')} % 4 > 0 THEN CASE WHEN p = 0 THEN {role_sql('vec_id', 'base')} ELSE ({role_sql('vec_id', 'base')} + p) % {K} END ELSE {hash8_sql("'drift'", 'p', 'vec_id')} % {K} END AS lab FROM embeddings CROSS JOIN (SELECT unnest(range({PARTS})) AS p)),
cg AS (SELECT b.p, b.lab, a.lab AS ref, count(*) AS n FROM cp a JOIN cp b ON a.id = b.id AND a.p = 0 WHERE b.p > 0 GROUP BY 1, 2, 3), pm({", ".join(f"m{i}" for i in range(K))}) AS (VALUES {_PERMS}),
pl AS (SELECT dense_rank() OVER (ORDER BY {", ".join(f"m{i}" for i in range(K))}) AS pid, u.lab, [{", ".join(f"m{i}" for i in range(K))}][u.lab + 1] AS ref FROM pm, (SELECT unnest(range({K})) AS lab) u),
wt AS (SELECT p, pid, sum(n) AS w FROM cg JOIN pl ON pl.lab = cg.lab AND pl.ref = cg.ref GROUP BY 1, 2), bp AS (SELECT p, pid FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY w DESC, pid) AS rn FROM wt) WHERE rn = 1),
al AS (SELECT id, lab FROM cp WHERE p = 0 UNION ALL SELECT id, pl.ref FROM cp JOIN bp ON bp.p = cp.p JOIN pl ON pl.pid = bp.pid AND pl.lab = cp.lab), vt AS (SELECT id, lab, count(*) AS c FROM al GROUP BY 1, 2)"""


@query(f"WITH {_DRIFT_SQL} SELECT id, lab AS role, round(c / {PARTS}, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, lab) AS rn FROM vt) WHERE rn = 1")
def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partitions aligned to the first and put to a vote; the smaller label wins a tie."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    p = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("p")
    moved = (F.col("p") > 0) & (hash8(F.lit("stay"), "p", "id") % 4 == 0)
    lab = F.when(moved, hash8(F.lit("drift"), "p", "id") % K).otherwise((role(F.col("id"), "base") + F.col("p")) % K)
    cp = stage(spark, sf_dir, "drift", lambda: e.select("id", p).withColumn("lab", lab))
    ref = cp.filter("p = 0").select("id", F.col("lab").alias("ref"))
    counts = cp.filter("p > 0").join(ref, "id").groupBy("p", "lab", "ref").count().collect()  # at most K x K per partition
    maps = {0: list(range(K))}
    for q in range(1, PARTS):
        maps[q] = best_relabelling({(r["lab"], r["ref"]): r["count"] for r in counts if r["p"] == q}, K)
    to = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(x) for x in maps[q]]) for q in range(PARTS)]), F.col("p") + 1), (F.col("lab") + 1).cast("int"))
    votes = cp.select("id", to.alias("role")).groupBy("id", "role").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("id").agg(F.max(F.struct("c", (-F.col("role")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).cast("bigint").alias("role"), r6(F.col("b.c") / PARTS).alias("confidence"))


MATCH_LIMIT = 2_000
BAND = 5


def q_volume_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's nearest unused counterparty by volume in the weeks before its order.

    Candidates come from a band around each anchor's volume (its own and the next fifths of a decade);
    anchors, bounded by the designation list, take turns in hash order.
    """
    a = timing(spark, sf_dir).filter("in_window").select("addr", F.col("signed").alias("event"))
    act = activity(spark, sf_dir).filter(F.col("ms") < END_MS)
    near = (F.col("ms") >= F.col("event") - W * WEEK_MS) & (F.col("ms") < F.col("event"))
    own = about(act, a).filter(near).groupBy("addr", "event").agg(money(F.sum("v")).alias("va"))
    pool = act.join(hop1(spark, sf_dir), "addr", "left_semi")
    dates = own.select("event").distinct()
    volume = pool.join(F.broadcast(dates), near).groupBy(F.col("addr").alias("cand"), "event").agg(money(F.sum("v")).alias("vc"))
    bin_of = lambda v: F.floor(F.log10(v) * BAND)
    spread_ = own.withColumn("bin", F.explode(F.sequence(bin_of(F.col("va")) - 1, bin_of(F.col("va")) + 1)))
    cand = volume.withColumn("bin", bin_of(F.col("vc"))).join(F.broadcast(spread_), ["event", "bin"])
    gap = F.abs(F.log("vc") - F.log("va"))
    place = F.row_number().over(Window.partitionBy("addr").orderBy("gap", "cand"))
    short = cand.withColumn("gap", gap).withColumn("place", place).filter(F.col("place") <= MATCH_LIMIT)
    # an anchor can lose at most as many candidates as there are anchors, so this keeps all it may need
    rows = short.join(a.agg(F.count(F.lit(1)).alias("n_anchor")), F.col("place") <= F.col("n_anchor")).select("addr", "cand", "gap", hash8(F.lit("turn"), "addr").alias("turn")).orderBy("turn", "addr", "gap", "cand").toLocalIterator()
    used, got = set(), {}
    for r in rows:
        if r["addr"] not in got and r["cand"] not in used:
            used.add(r["cand"])
            got[r["addr"]] = (r["addr"], r["cand"], float(r["gap"]))
    return spark.createDataFrame(list(got.values()), "addr string, matched string, gap double")


query()(q_volume_matched)


PIVOTS = 200


def q_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies on whole shortest paths from two hundred pivots, in hash order; a row for each address."""
    nodes = graph_degrees(spark, sf_dir).select("addr")
    pivots = nodes.orderBy(hash8(F.lit("pivot"), "addr"), "addr").limit(PIVOTS).select(F.col("addr").alias("node"))
    b = betweenness(pairs(spark, sf_dir).select("src", "dst"), pivots).withColumnRenamed("node", "addr")
    return nodes.join(b, "addr", "left").select("addr", r6(F.coalesce("score", F.lit(0.0))).alias("score"))


def q_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by non-negative factors of the structural features: the factor with the largest weight."""
    w, _ = factorise(structural(spark, sf_dir), "addr", ["log_in", "log_out", "log_in_val", "log_out_val"], 3, 12)
    top = F.greatest("w0", "w1", "w2")
    return w.select("addr", F.when(F.col("w0") == top, 0).when(F.col("w1") == top, 1).otherwise(2).alias("role"))


query()(q_betweenness)
query()(q_nmf)
