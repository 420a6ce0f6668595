"""Node features: twelve structural and thirty behavioural ones, and their neighbour means."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators.chunks import RANK, latest_before, number_rows
from ledgerweave.plans.base import ACT_SQL, ORACLES, PAIR_SQL, activity, money, pairs, query, r6, stage, transfers

DAY_S = 86_400


def ln1(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def safe(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


_STRUCT_SQL = """g AS (SELECT min(ms) AS lo, (max(ms) - min(ms) + 1000)::DOUBLE AS span FROM t),
f AS MATERIALIZED (SELECT addr, count(*) FILTER (dir = 'in') AS ic, count(*) FILTER (dir = 'out') AS oc, CAST(coalesce(sum(v) FILTER (dir = 'in'), 0) AS DOUBLE) AS iv, CAST(coalesce(sum(v) FILTER (dir = 'out'), 0) AS DOUBLE) AS ov, min(ms) AS a, max(ms) AS b FROM act GROUP BY 1),
s AS MATERIALIZED (SELECT addr, ln(1 + ic) AS log_in, ln(1 + oc) AS log_out, ln(1 + iv) AS log_in_val, ln(1 + ov) AS log_out_val, ln(1 + CASE WHEN ic > 0 THEN iv / ic ELSE 0 END) AS log_mean_in, ln(1 + CASE WHEN oc > 0 THEN ov / oc ELSE 0 END) AS log_mean_out,
  (a - lo) / span AS first_t, (b - lo) / span AS last_t, (b - a) / span AS active_t, ln(1 + (ic + oc) / greatest((b - a) / span, 1e-6)) AS log_freq FROM f, g)"""
_S_COLS = ["log_in", "log_out", "log_in_val", "log_out_val", "log_mean_in", "log_mean_out", "first_t", "last_t", "active_t", "log_freq"]


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir).agg(F.min("ms").alias("lo"), (F.max("ms") - F.min("ms") + 1000).cast("double").alias("span"))
    side = lambda d: F.when(F.col("dir") == d, F.col("v"))
    f = activity(spark, sf_dir).groupBy("addr").agg(
        F.count(side("in")).alias("ic"),
        F.count(side("out")).alias("oc"),
        money(F.coalesce(F.sum(side("in")), F.lit(0))).alias("iv"),
        money(F.coalesce(F.sum(side("out")), F.lit(0))).alias("ov"),
        F.min("ms").alias("a"),
        F.max("ms").alias("b"),
    )
    c = F.col
    return f.crossJoin(F.broadcast(t)).select(
        "addr",
        ln1(c("ic")).alias("log_in"),
        ln1(c("oc")).alias("log_out"),
        ln1(c("iv")).alias("log_in_val"),
        ln1(c("ov")).alias("log_out_val"),
        ln1(safe(c("iv"), c("ic"))).alias("log_mean_in"),
        ln1(safe(c("ov"), c("oc"))).alias("log_mean_out"),
        ((c("a") - c("lo")) / c("span")).alias("first_t"),
        ((c("b") - c("lo")) / c("span")).alias("last_t"),
        ((c("b") - c("a")) / c("span")).alias("active_t"),
        ln1((c("ic") + c("oc")) / F.greatest((c("b") - c("a")) / c("span"), F.lit(1e-6))).alias("log_freq"),
    )


@query(f"WITH {ACT_SQL}, {_STRUCT_SQL} SELECT addr, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM s)) / greatest((SELECT stddev_pop({c}) FROM s), 1e-9), 5) AS {c}" for c in _S_COLS) + " FROM s")
def q_features_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural features, z-scored with the population deviation; the two counts that the reference
    lists twice (degree and number of transfers are the same there) appear once."""
    s = structural(spark, sf_dir)
    z = s.agg(*[F.avg(c).alias(f"m_{c}") for c in _S_COLS], *[F.stddev_pop(c).alias(f"d_{c}") for c in _S_COLS])
    return s.crossJoin(F.broadcast(z)).select("addr", *[F.round((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"d_{c}"), F.lit(1e-9)), 5).alias(c) for c in _S_COLS])


@query(f"""WITH {ACT_SQL}, m AS (SELECT addr, v, row_number() OVER (PARTITION BY addr ORDER BY v) AS i, count(*) OVER (PARTITION BY addr) AS n FROM act)
  SELECT addr, round(ln(1 + CAST(max(v) AS DOUBLE)), 6) AS log_max_amt, round(avg(CASE WHEN v < 100 THEN 1.0 ELSE 0 END), 6) AS share_small, round(avg(CASE WHEN v >= 100 AND v % 100 = 0 THEN 1.0 ELSE 0 END), 6) AS share_round,
  round(ln(1 + CAST(max(v) FILTER (i = n // 2 + 1) AS DOUBLE)), 6) AS log_median_amt FROM m GROUP BY 1""")
def q_features_v3_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts: largest, shares of small and round ones, and the upper median, found by exact rank."""
    a = number_rows(activity(spark, sf_dir).select("addr", "v"), ["addr"], [F.col("v")]).df
    n = a.groupBy("addr").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.avg((F.col("v") < 100).cast("double")).alias("small"), F.avg(((F.col("v") >= 100) & (F.col("v") % 100 == 0)).cast("double")).alias("whole"))
    mid = a.join(n.select("addr", "n"), "addr").filter(F.col(RANK) == F.floor(F.col("n") / 2)).select("addr", F.col("v").alias("mid"))
    return n.join(mid, "addr").select("addr", r6(ln1(F.col("top"))).alias("log_max_amt"), r6(F.col("small")).alias("share_small"), r6(F.col("whole")).alias("share_round"), r6(ln1(F.col("mid"))).alias("log_median_amt"))


@query(f"""WITH {PAIR_SQL}, i AS (SELECT dst AS addr, sum(cnt) AS c, count(*) AS u FROM pair GROUP BY 1), o AS (SELECT src AS addr, sum(cnt) AS c, count(*) AS u FROM pair GROUP BY 1), r AS (SELECT a.src AS addr, count(*) AS r FROM pair a JOIN pair b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
  SELECT coalesce(i.addr, o.addr) AS addr, round(ln(1 + coalesce(i.u, 0)), 6) AS log_uniq_in, round(ln(1 + coalesce(o.u, 0)), 6) AS log_uniq_out, round(coalesce(i.c / i.u, 0) - 1, 6) AS repeat_in, round(coalesce(o.c / o.u, 0) - 1, 6) AS repeat_out,
  round(coalesce(r, 0) / greatest(coalesce(i.u, 0) + coalesce(o.u, 0) - coalesce(r, 0), 1), 6) AS reciprocity FROM i FULL JOIN o ON i.addr = o.addr LEFT JOIN r ON r.addr = coalesce(i.addr, o.addr)""")
def q_features_v3_counterparty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counterparties, repeats (-1 on a side without any) and reciprocity; one pass over the
    pairs in both orientations, so that a pair and its reverse meet under one key."""
    p = pairs(spark, sf_dir)
    both = p.select(F.col("dst").alias("addr"), F.col("src").alias("cp"), F.col("cnt").alias("i"), F.lit(None).cast("bigint").alias("o")).union(p.select("src", "dst", F.lit(None).cast("bigint"), "cnt"))
    met = both.groupBy("addr", "cp").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    a = met.groupBy("addr").agg(F.count("i").alias("ui"), F.count("o").alias("uo"), F.sum("i").alias("ci"), F.sum("o").alias("co"), F.count(F.col("i") + F.col("o")).alias("r"))
    c = F.col
    rep = lambda n, u: r6(safe(F.coalesce(c(n), F.lit(0)), c(u)) - 1)
    return a.select("addr", r6(ln1(c("ui"))).alias("log_uniq_in"), r6(ln1(c("uo"))).alias("log_uniq_out"), rep("ci", "ui").alias("repeat_in"), rep("co", "uo").alias("repeat_out"), r6(c("r") / F.greatest(c("ui") + c("uo") - c("r"), F.lit(1))).alias("reciprocity"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity in time order with the second before and the last inflow before each row."""

    def make() -> DataFrame:
        a = activity(spark, sf_dir).select("addr", "dir", "v", F.floor(F.col("ms") / 1000).alias("s"))
        a = a.withColumn("s_in", F.when(F.col("dir") == "in", F.col("s")))
        return latest_before(a, ["addr"], ["s", "s_in"], [F.col("s"), F.col("dir")])

    return stage(spark, sf_dir, "timed", make)


@query(f"""WITH {ACT_SQL}, x AS (SELECT addr, dir, v, ms // 1000 AS s, max(CASE WHEN dir = 'in' THEN ms // 1000 END) OVER (PARTITION BY addr ORDER BY ms // 1000, dir ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li FROM act),
  y AS (SELECT addr, dir, v, CASE WHEN dir = 'out' THEN (s - li) / 86400.0 END AS lag FROM x)
  SELECT addr, round((iv - ov) / (iv + ov), 6) AS net_flow_ratio, round(CASE WHEN iv > 0 THEN least(5, greatest(0, ov / iv)) ELSE 0 END, 6) AS forward_share, round(coalesce(l, ln(366)), 6) AS log_pass_latency, round(q / greatest(oc, 1), 6) AS share_out_within_1d FROM (
   SELECT addr, CAST(coalesce(sum(v) FILTER (dir = 'in'), 0) AS DOUBLE) AS iv, CAST(coalesce(sum(v) FILTER (dir = 'out'), 0) AS DOUBLE) AS ov, avg(ln(1 + lag)) AS l, count(*) FILTER (lag <= 1) AS q, count(*) FILTER (dir = 'out') AS oc FROM y GROUP BY 1)""")
def q_features_v3_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.when(F.col("dir") == "out", (F.col("s") - F.col("s_in_before")) / DAY_S)
    x = timed(spark, sf_dir).withColumn("lag", lag)
    side = lambda d: money(F.coalesce(F.sum(F.when(F.col("dir") == d, F.col("v"))), F.lit(0)))
    a = x.groupBy("addr").agg(side("in").alias("iv"), side("out").alias("ov"), F.avg(F.log1p("lag")).alias("l"), F.count_if(F.col("lag") <= 1).alias("q"), F.count_if(F.col("dir") == "out").alias("oc"))
    c = F.col
    return a.select(
        "addr",
        r6((c("iv") - c("ov")) / (c("iv") + c("ov"))).alias("net_flow_ratio"),
        r6(F.least(F.lit(5.0), F.greatest(F.lit(0.0), safe(c("ov"), c("iv"))))).alias("forward_share"),
        r6(F.coalesce(c("l"), F.log(F.lit(366.0)))).alias("log_pass_latency"),
        r6(c("q") / F.greatest(c("oc"), F.lit(1))).alias("share_out_within_1d"),
    )


@query(f"""WITH {ACT_SQL}, x AS (SELECT addr, ms // 1000 AS s, (ms // 1000 - lag(ms // 1000) OVER (PARTITION BY addr ORDER BY ms // 1000, dir)) / 86400.0 AS gap FROM act), g AS (SELECT min(ms // 1000) AS lo, max(ms // 1000) - min(ms // 1000) + 1 AS span FROM t),
  a AS (SELECT addr, coalesce(avg(gap), 0) AS m, coalesce(sqrt(greatest(avg(gap * gap) - avg(gap) * avg(gap), 0)), 0) AS d, min(s) AS f, max(s) AS l, count(*) AS n, count(DISTINCT s // 86400) AS days FROM x GROUP BY 1)
  SELECT addr, round(ln(1 + m), 5) AS log_mean_interevent, CASE WHEN m + d > 0 THEN round((d - m) / (d + m), 4) ELSE 0 END AS burstiness, round(ln(1 + (l - f) / 86400.0), 6) AS log_lifetime_days, round(ln(1 + days), 6) AS log_active_days, round(ln(1 + n / days), 6) AS tx_per_active_day,
  round((f - lo) / span, 6) AS first_ts_norm, round((l - lo) / span, 6) AS last_ts_norm FROM a, g""")
def q_features_v3_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = timed(spark, sf_dir).withColumn("gap", (F.col("s") - F.col("s_before")) / DAY_S)
    g = x.agg(F.min("s").alias("lo"), (F.max("s") - F.min("s") + 1).alias("span"))
    a = x.groupBy("addr").agg(F.avg("gap").alias("m"), F.avg(F.col("gap") * F.col("gap")).alias("m2"), F.min("s").alias("f"), F.max("s").alias("l"), F.count(F.lit(1)).alias("n"))
    days = x.select("addr", F.floor(F.col("s") / DAY_S).alias("d")).distinct().groupBy("addr").agg(F.count(F.lit(1)).alias("days"))
    c = F.col
    m = F.coalesce(c("m"), F.lit(0.0))
    d = F.coalesce(F.sqrt(F.greatest(c("m2") - c("m") * c("m"), F.lit(0.0))), F.lit(0.0))
    return a.join(days, "addr").crossJoin(F.broadcast(g)).select(
        "addr",
        F.round(F.log1p(m), 5).alias("log_mean_interevent"),
        F.when(m + d > 0, F.round((d - m) / (d + m), 4)).otherwise(0.0).alias("burstiness"),
        r6(ln1((c("l") - c("f")) / DAY_S)).alias("log_lifetime_days"),
        r6(ln1(c("days"))).alias("log_active_days"),
        r6(ln1(c("n") / c("days"))).alias("tx_per_active_day"),
        r6((c("f") - c("lo")) / c("span")).alias("first_ts_norm"),
        r6((c("l") - c("lo")) / c("span")).alias("last_ts_norm"),
    )


@query(f"""WITH {ACT_SQL}, h AS (SELECT addr, (ms // 1000) % 86400 // 3600 AS h, count(*) AS c FROM act GROUP BY 1, 2), dy AS (SELECT addr, ms // 86400000 AS d, count(*) AS c FROM act GROUP BY 1, 2)
  SELECT a.addr, round(x.top / a.n, 6) AS max_day_share, round(e.e, 6) AS hour_entropy, round(a.w, 6) AS weekend_share FROM (SELECT addr, count(*) AS n, avg(CASE WHEN (ms // 86400000 + 4) % 7 >= 5 THEN 1.0 ELSE 0 END) AS w FROM act GROUP BY 1) a
  JOIN (SELECT addr, max(c) AS top FROM dy GROUP BY 1) x ON x.addr = a.addr JOIN (SELECT addr, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(24) AS e FROM h GROUP BY 1) e ON e.addr = a.addr""")
def q_features_v3_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busiest day, spread over the hours, and the reference's weekend: days 5 and 6 of (epoch day + 4) mod 7,
    which are Friday and Saturday."""
    a = activity(spark, sf_dir).select("addr", F.floor(F.col("ms") / 86_400_000).alias("d"), F.floor(F.floor(F.col("ms") / 1000) % DAY_S / 3600).alias("h"))
    cell = a.groupBy("addr", "d", "h").agg(F.count(F.lit(1)).alias("c"))
    day = cell.groupBy("addr", "d").agg(F.sum("c").alias("c"))
    weekend = F.when((F.col("d") + 4) % 7 >= 5, F.col("c")).otherwise(0)
    per_day = day.groupBy("addr").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.sum(weekend).alias("w"))
    hour = cell.groupBy("addr", "h").agg(F.sum("c").alias("c")).groupBy("addr").agg(((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")) / F.log(F.lit(24.0))).alias("e"))
    return per_day.join(hour, "addr").select("addr", r6(F.col("top") / F.col("n")).alias("max_day_share"), r6(F.col("e")).alias("hour_entropy"), r6(F.col("w") / F.col("n")).alias("weekend_share"))


@query(f"""WITH {ACT_SQL}, r AS (SELECT addr, v, row_number() OVER (PARTITION BY addr ORDER BY v) AS i, count(*) OVER (PARTITION BY addr) AS n FROM act WHERE dir = 'in')
  SELECT addr, round(CASE WHEN any_value(n) < 2 THEN 0 ELSE 2 * CAST(sum(i * v) AS DOUBLE) / (any_value(n) * CAST(sum(v) AS DOUBLE)) - (any_value(n) + 1) / any_value(n) END, 6) AS gini_in FROM r GROUP BY 1""")
def q_features_v3_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inequality of the amounts that each address received, from exact ranks."""
    a = number_rows(activity(spark, sf_dir).filter("dir = 'in'").select("addr", "v"), ["addr"], [F.col("v")]).df
    i = (F.col(RANK) + 1).cast("decimal(12,0)")
    g = a.groupBy("addr").agg(F.count(F.lit(1)).alias("n"), money(F.sum(i * F.col("v"))).alias("iv"), money(F.sum("v")).alias("v"))
    return g.select("addr", r6(F.when(F.col("n") < 2, 0.0).otherwise(2 * F.col("iv") / (F.col("n") * F.col("v")) - (F.col("n") + 1) / F.col("n"))).alias("gini_in"))


#: the thirty behavioural features in their published order
FEATURES = [
    "log_in_cnt", "log_out_cnt", "log_in_val", "log_out_val", "log_mean_in", "log_mean_out", "log_max_amt", "share_small", "share_round", "gini_in",
    "log_median_amt", "log_uniq_in", "log_uniq_out", "repeat_in", "repeat_out", "reciprocity", "net_flow_ratio", "forward_share", "log_pass_latency", "share_out_within_1d",
    "log_mean_interevent", "burstiness", "log_lifetime_days", "log_active_days", "tx_per_active_day", "max_day_share", "hour_entropy", "weekend_share", "first_ts_norm", "last_ts_norm",
]
_PARTS = ["volume", "gini", "counterparty", "flow", "temporal", "calendar"]
_ZERO = ("gini_in",)
_FEAT_SQL = (
    f"b AS (SELECT * FROM (WITH {ACT_SQL}, {_STRUCT_SQL} SELECT addr, round(log_in, 6) AS log_in_cnt, round(log_out, 6) AS log_out_cnt, round(log_in_val, 6) AS log_in_val, round(log_out_val, 6) AS log_out_val, round(log_mean_in, 6) AS log_mean_in, round(log_mean_out, 6) AS log_mean_out FROM s)), "
    + ", ".join(f"p_{n} AS (SELECT * FROM ({ORACLES[f'q_features_v3_{n}']}))" for n in _PARTS)
    + ", feat AS MATERIALIZED (SELECT addr, " + ", ".join(f"coalesce({c}, 0) AS {c}" if c in _ZERO else c for c in FEATURES) + " FROM b " + " ".join(f"LEFT JOIN p_{n} USING (addr)" for n in _PARTS) + ")"
)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, thirty features): everything is grouped by address, so the parts meet under one partitioning."""

    def make() -> DataFrame:
        b = structural(spark, sf_dir).select("addr", r6(F.col("log_in")).alias("log_in_cnt"), r6(F.col("log_out")).alias("log_out_cnt"), *[r6(F.col(c)).alias(c) for c in FEATURES[2:6]])
        for part in (q_features_v3_volume, q_features_v3_gini, q_features_v3_counterparty, q_features_v3_flow, q_features_v3_temporal, q_features_v3_calendar):
            b = b.join(part(spark, sf_dir), "addr", "left")
        return b.select("addr", *[F.coalesce(c, F.lit(0.0)).alias(c) if c in _ZERO else F.col(c) for c in FEATURES])

    return stage(spark, sf_dir, "features", make)


@query(f"WITH {_FEAT_SQL} SELECT * FROM feat")
def q_features_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


def _mean_sql(end: str, other: str, tag: str) -> str:
    return f"{tag}n AS (SELECT {end} AS addr, " + ", ".join(f"avg({c}) AS {tag}_{c}" for c in FEATURES) + f" FROM pr JOIN feat ON feat.addr = {other} GROUP BY 1)"


@query(
    f"WITH {_FEAT_SQL}, pr AS (SELECT * FROM (WITH {PAIR_SQL} SELECT src, dst FROM pair)), {_mean_sql('src', 'dst', 'out')}, {_mean_sql('dst', 'src', 'in')} SELECT feat.addr, "
    + ", ".join([*FEATURES, *[f"round(coalesce({t}_{c}, 0) + 1e-9, 5) AS {t}_{c}" for t in ("out", "in") for c in FEATURES]])
    + " FROM feat LEFT JOIN outn ON outn.addr = feat.addr LEFT JOIN inn ON inn.addr = feat.addr"
)
def q_neighbour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty features next to their means over out- and in-neighbours: ninety columns.

    A billionth is added before rounding, so that means halfway between two values round alike everywhere.
    """
    f = matrix(spark, sf_dir)
    p, out = pairs(spark, sf_dir).select("src", "dst"), f
    for end, other, tag in (("src", "dst", "out"), ("dst", "src", "in")):
        near = p.join(f.withColumnRenamed("addr", other), other).groupBy(F.col(end).alias("addr")).agg(*[F.avg(c).alias(f"{tag}_{c}") for c in FEATURES])
        out = out.join(near, "addr", "left")
    return out.select("addr", *FEATURES, *[F.round(F.coalesce(f"{t}_{c}", F.lit(0.0)) + 1e-9, 5).alias(f"{t}_{c}") for t in ("out", "in") for c in FEATURES])
