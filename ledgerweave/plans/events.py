"""Event studies around dated interventions: timing, weekly series, robustness, resampling."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ledger import DAY_MS
from ledgerweave.operators.lookups import broadcast_if_small, smallest
from ledgerweave.plans.base import (
    ACT_SQL,
    ANCHOR_SQL,
    END_MS,
    FREEZE_SQL,
    W,
    WEEK_MS,
    activity,
    anchors,
    freezes,
    money,
    query,
    r6,
    with_,
)

CUT = END_MS - 90 * DAY_MS


def about(act: DataFrame, dim: DataFrame) -> DataFrame:
    """Activity of the addresses of a small dimension, which has one row per address."""
    return act.join(broadcast_if_small(dim), "addr")


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the anchors before the end of the data, with their order and dates."""
    return about(activity(spark, sf_dir).filter(F.col("ms") < END_MS), anchors(spark, sf_dir))


A_SQL = f"{ACT_SQL}, {ANCHOR_SQL}, a AS MATERIALIZED (SELECT act.*, ord, signed, published FROM act JOIN anchor ON act.addr = anchor.addr WHERE ms < {END_MS})"
WEEKS = f"wks AS (SELECT CAST(unnest(range(-{W}, {W} + 1)) AS BIGINT) AS wk)"


def spine(spark: SparkSession) -> DataFrame:
    return spark.range(-W, W + 1).withColumnRenamed("id", "wk")


def wk(event: str = "signed") -> Column:
    return F.floor((F.col("ms") - F.col(event)) / WEEK_MS)


def wk_sql(event: str = "signed") -> str:
    return f"CAST(floor((ms - {event}) / {WEEK_MS}.0) AS BIGINT)"


@query(with_(ACT_SQL, ANCHOR_SQL) + """, cps AS (SELECT DISTINCT cp AS addr, first_signed FROM (SELECT act.cp, min(signed) AS first_signed FROM act JOIN anchor ON act.addr = anchor.addr WHERE act.ms < signed GROUP BY 1)
  WHERE cp NOT IN (SELECT addr FROM anchor))
  SELECT c.addr, count(*) FILTER (ms < first_signed) AS n_before, count(*) FILTER (ms >= first_signed) AS n_after, CAST(coalesce(sum(v) FILTER (ms < first_signed), 0) AS DOUBLE) AS v_before, CAST(coalesce(sum(v) FILTER (ms >= first_signed), 0) AS DOUBLE) AS v_after
  FROM act JOIN cps c ON act.addr = c.addr GROUP BY 1""")
def q_target_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterparties of anchors before the order: their transfers and volume before and after it."""
    c = counterparties(spark, sf_dir)
    zero = lambda cond: money(F.coalesce(F.sum(F.when(cond, F.col("v"))), F.lit(0)))
    before = F.col("ms") < F.col("first_signed")
    return activity(spark, sf_dir).join(c, "addr").groupBy("addr").agg(F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"), zero(before).alias("v_before"), zero(~before).alias("v_after"))


def counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, first_signed): not designated, in contact with an anchor before its order."""
    anchor = anchors(spark, sf_dir)
    before = about(activity(spark, sf_dir), anchor).filter("ms < signed").groupBy(F.col("cp").alias("addr")).agg(F.min("signed").alias("first_signed"))
    return before.join(broadcast_if_small(anchor.select("addr")), "addr", "left_anti")


TIMING_SQL = f"""pr AS (SELECT addr, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM act GROUP BY 1),
tm AS (SELECT anchor.addr, ord, signed, first_ms, last_ms, n, CAST(floor((signed - last_ms) / {DAY_MS}.0) AS BIGINT) AS lag_days, signed <= {CUT} AND n IS NOT NULL AS in_window FROM anchor LEFT JOIN pr ON anchor.addr = pr.addr)"""


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = anchors(spark, sf_dir)
    profile = about(activity(spark, sf_dir), anchor.select("addr")).groupBy("addr").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))
    lag = F.floor((F.col("signed") - F.col("last_ms")) / DAY_MS)
    return anchor.join(profile, "addr", "left").select("addr", "ord", "signed", "first_ms", "last_ms", "n", lag.alias("lag_days"), ((F.col("signed") <= CUT) & F.col("n").isNotNull()).alias("in_window"))


@query(with_(ACT_SQL, ANCHOR_SQL, TIMING_SQL) + "SELECT * FROM tm")
def q_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing(spark, sf_dir)


@query(with_(ACT_SQL, ANCHOR_SQL, TIMING_SQL) + """SELECT count(*) AS n, round(median(lag_days), 6) AS median_lag, round(avg(CASE WHEN lag_days > 30 THEN 1.0 ELSE 0 END), 6) AS dormant_30,
  round(avg(CASE WHEN lag_days > 90 THEN 1.0 ELSE 0 END), 6) AS dormant_90, round(avg(CASE WHEN last_ms > signed THEN 1.0 ELSE 0 END), 6) AS active_after,
  round(quantile_cont(lag_days, 0.25), 6) AS q25, round(quantile_cont(lag_days, 0.75), 6) AS q75 FROM tm WHERE in_window""")
def q_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: r6(F.avg(F.coalesce(c, F.lit(False)).cast("double")))
    lag = F.col("lag_days").cast("double")
    return timing(spark, sf_dir).filter("in_window").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.median(lag)).alias("median_lag"),
        share(F.col("lag_days") > 30).alias("dormant_30"),
        share(F.col("lag_days") > 90).alias("dormant_90"),
        share(F.col("last_ms") > F.col("signed")).alias("active_after"),
        r6(F.percentile(lag, 0.25)).alias("q25"),
        r6(F.percentile(lag, 0.75)).alias("q75"),
    )


@query(with_(ACT_SQL, ANCHOR_SQL, TIMING_SQL) + "SELECT ord, count(*) AS n_addr, count(n) AS n_active, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_transfers, round(median(lag_days), 6) AS median_lag, min(signed) AS signed FROM tm GROUP BY 1")
def q_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing(spark, sf_dir).groupBy("ord").agg(F.count(F.lit(1)).alias("n_addr"), F.count("n").alias("n_active"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_transfers"), r6(F.median("lag_days")).alias("median_lag"), F.min("signed").alias("signed"))


@query(with_(A_SQL) + """, big AS (SELECT ord FROM anchor GROUP BY 1 ORDER BY count(*) DESC, ord LIMIT 1) SELECT dir, count(*) AS n, CAST(sum(v) AS DOUBLE) AS volume, count(DISTINCT cp) AS n_cp FROM a WHERE ord IN (SELECT ord FROM big) GROUP BY 1""")
def q_largest_order_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = anchors(spark, sf_dir).groupBy("ord").count().orderBy(F.desc("count"), "ord").limit(1).select("ord")
    return anchored(spark, sf_dir).join(F.broadcast(big), "ord", "left_semi").groupBy("dir").agg(F.count(F.lit(1)).alias("n"), money(F.sum("v")).alias("volume"), F.countDistinct("cp").alias("n_cp"))


@query(with_(A_SQL) + "SELECT CAST(sum(v) FILTER (dir = 'in') AS DOUBLE) AS inflow, CAST(sum(v) FILTER (dir = 'out') AS DOUBLE) AS outflow, count(*) FILTER (dir = 'in') AS n_in, count(*) FILTER (dir = 'out') AS n_out, count(DISTINCT cp) FILTER (cp NOT IN (SELECT addr FROM anchor)) AS hop1 FROM a")
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = anchors(spark, sf_dir).select(F.col("addr").alias("cp"), F.lit(True).alias("own"))
    a = anchored(spark, sf_dir).join(broadcast_if_small(dim), "cp", "left")
    side = lambda d: F.when(F.col("dir") == d, F.col("v"))
    return a.agg(
        money(F.sum(side("in"))).alias("inflow"),
        money(F.sum(side("out"))).alias("outflow"),
        F.count(side("in")).alias("n_in"),
        F.count(side("out")).alias("n_out"),
        F.countDistinct(F.when(F.col("own").isNull(), F.col("cp"))).alias("hop1"),
    )


@query(with_(ACT_SQL, ANCHOR_SQL) + "SELECT ord, dir, grouping(ord) AS g_ord, grouping(dir) AS g_dir, count(*) AS n, CAST(sum(v) AS DOUBLE) AS volume FROM act JOIN anchor ON act.addr = anchor.addr GROUP BY GROUPING SETS ((), (ord), (dir), (ord, dir))")
def q_rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = about(activity(spark, sf_dir), anchors(spark, sf_dir))
    return a.cube("ord", "dir").agg(F.grouping("ord").cast("bigint").alias("g_ord"), F.grouping("dir").cast("bigint").alias("g_dir"), F.count(F.lit(1)).alias("n"), money(F.sum("v")).alias("volume"))


SERIES_SQL = f"""{WEEKS}, se AS (SELECT wks.wk, coalesce(sum(v) FILTER (dir = 'in'), 0) AS vin, coalesce(sum(v) FILTER (dir = 'out'), 0) AS vout, count(v) AS n FROM wks LEFT JOIN (SELECT *, {wk_sql()} AS wk FROM a) x ON wks.wk = x.wk GROUP BY 1)"""


def series(spark: SparkSession, rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, wk, vin, vout, n) for every week of the window, weeks without a row being 0."""
    some = rows.filter(F.col("wk").between(-W, W)).groupBy(*keys, "wk").agg(F.sum(F.when(F.col("dir") == "in", F.col("v"))).alias("vin"), F.sum(F.when(F.col("dir") == "out", F.col("v"))).alias("vout"), F.count(F.lit(1)).alias("n"))
    dense = spine(spark) if not keys else rows.select(*keys).distinct().crossJoin(F.broadcast(spine(spark)))
    full = dense.join(some, [*keys, "wk"], "left")
    return full.select(*keys, "wk", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vin", "vout", "n")])


@query(with_(A_SQL, SERIES_SQL) + "SELECT wk, CAST(vin AS DOUBLE) AS inflow, CAST(vout AS DOUBLE) AS outflow, CAST(vin + vout AS DOUBLE) AS volume, n FROM se")
def q_weekly_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, anchored(spark, sf_dir).withColumn("wk", wk()))
    return s.select("wk", money("vin").alias("inflow"), money("vout").alias("outflow"), money(F.col("vin") + F.col("vout")).alias("volume"), "n")


def summary_columns(v: str = "v") -> list[Column]:
    part = lambda lo, hi, n: F.coalesce(F.sum(F.when(F.col("wk").between(lo, hi), F.col(v))), F.lit(0)).cast("double") / n
    pre, late = part(-26, -1, 26), part(7, 26, 20)
    slope = F.regr_slope(F.when(F.col("wk") < 0, F.log10(F.greatest(F.col(v).cast("double"), F.lit(1.0)))), (F.col("wk") + 26).cast("double"))
    return [r6(pre).alias("pre_mean"), r6(part(0, 4, 5)).alias("w0_4"), r6(part(1, 26, 26)).alias("post_mean"), r6(late).alias("post7_26"), r6(late / F.greatest(pre, F.lit(1e-9))).alias("ratio"), r6(slope).alias("trend")]


def summary_sql(v: str = "v") -> str:
    part = lambda lo, hi, n: f"CAST(coalesce(sum({v}) FILTER (wk BETWEEN {lo} AND {hi}), 0) AS DOUBLE) / {n}"
    return f"""round({part(-26, -1, 26)}, 6) AS pre_mean, round({part(0, 4, 5)}, 6) AS w0_4, round({part(1, 26, 26)}, 6) AS post_mean, round({part(7, 26, 20)}, 6) AS post7_26,
      round({part(7, 26, 20)} / greatest({part(-26, -1, 26)}, 1e-9), 6) AS ratio, round(regr_slope(log10(greatest(CAST({v} AS DOUBLE), 1)), CAST(wk + 26 AS DOUBLE)) FILTER (wk < 0), 6) AS trend"""


@query(with_(A_SQL, SERIES_SQL) + f"SELECT {summary_sql()} FROM (SELECT wk, vin + vout AS v FROM se)")
def q_weekly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, anchored(spark, sf_dir).withColumn("wk", wk()))
    return s.select("wk", (F.col("vin") + F.col("vout")).alias("v")).agg(*summary_columns())


@query(with_(A_SQL, WEEKS) + f", x AS (SELECT addr, {wk_sql()} AS wk FROM a) SELECT wks.wk, count(DISTINCT x.addr) AS n_active, round(100.0 * count(DISTINCT x.addr) / (SELECT greatest(count(DISTINCT addr), 1) FROM x WHERE wk BETWEEN -{W} AND {W}), 6) AS share FROM wks LEFT JOIN x ON wks.wk = x.wk GROUP BY 1")
def q_active_share_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = anchored(spark, sf_dir).select("addr", wk().alias("wk")).filter(F.col("wk").between(-W, W)).distinct()
    of = x.agg(F.greatest(F.countDistinct("addr"), F.lit(1)).alias("of"))
    per = x.groupBy("wk").agg(F.count(F.lit(1)).alias("n"))
    return spine(spark).join(per, "wk", "left").crossJoin(F.broadcast(of)).select("wk", F.coalesce("n", F.lit(0)).alias("n_active"), r6(F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("of")).alias("share"))


@query(with_(A_SQL) + f""", x AS (SELECT addr, CAST(coalesce(sum(v) FILTER ({wk_sql()} < 0), 0) AS DOUBLE) AS pre, CAST(coalesce(sum(v) FILTER ({wk_sql()} > 0), 0) AS DOUBLE) AS post FROM a WHERE {wk_sql()} BETWEEN -{W} AND {W} GROUP BY 1)
  SELECT addr, pre, post, CASE WHEN pre + post > 0 THEN round(post / (pre + post), 8) END AS post_share FROM x""")
def q_per_address_post_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = anchored(spark, sf_dir).withColumn("wk", wk()).filter(F.col("wk").between(-W, W))
    part = lambda c: money(F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0)))
    x = x.groupBy("addr").agg(part(F.col("wk") < 0).alias("pre"), part(F.col("wk") > 0).alias("post"))
    return x.withColumn("post_share", F.when(F.col("pre") + F.col("post") > 0, F.round(F.col("post") / (F.col("pre") + F.col("post")), 8)))


@query(with_(A_SQL) + f", x AS (SELECT ord, CAST(sum(v) AS DOUBLE) AS v, count(DISTINCT addr) AS n FROM a WHERE {wk_sql()} BETWEEN -{W} AND -1 GROUP BY 1) SELECT ord, v AS volume, n AS n_addr, round(v / sum(v) OVER (), 8) AS share, row_number() OVER (ORDER BY v DESC, ord) AS place FROM x")
def q_event_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = anchored(spark, sf_dir).filter(wk().between(-W, -1)).groupBy("ord").agg(money(F.sum("v")).alias("volume"), F.countDistinct("addr").alias("n_addr"))
    total = x.agg(F.sum("volume").alias("total"))  # orders are few: ranking them is one small window
    return x.crossJoin(F.broadcast(total)).select("ord", "volume", "n_addr", F.round(F.col("volume") / F.col("total"), 8).alias("share"), F.row_number().over(Window.orderBy(F.desc("volume"), "ord")).cast("bigint").alias("place"))


@query(with_(A_SQL, TIMING_SQL, WEEKS) + f""", cov AS (SELECT addr, signed FROM tm WHERE first_ms <= signed - {W * WEEK_MS} AND {END_MS} >= signed + {W * WEEK_MS}),
  x AS (SELECT DISTINCT a.addr, CAST(floor((ms - a.signed) / {WEEK_MS}.0) AS BIGINT) AS wk FROM a JOIN cov ON a.addr = cov.addr),
  s AS (SELECT wks.wk, 100.0 * count(x.addr) / (SELECT greatest(count(*), 1) FROM cov) AS share FROM wks LEFT JOIN x ON wks.wk = x.wk WHERE wks.wk < 0 GROUP BY 1)
  SELECT (SELECT count(*) FROM cov) AS n_covered, round(regr_slope(share, CAST(wk AS DOUBLE)), 6) AS slope FROM s""")
def q_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend before the order of the share of fully covered anchors that are active."""
    cov = timing(spark, sf_dir).filter((F.col("first_ms") <= F.col("signed") - W * WEEK_MS) & (F.col("signed") + W * WEEK_MS <= END_MS)).select("addr")
    x = anchored(spark, sf_dir).join(broadcast_if_small(cov), "addr", "left_semi").select("addr", wk().alias("wk")).distinct().groupBy("wk").count()
    n = cov.agg(F.count(F.lit(1)).alias("n_covered"))
    s = spine(spark).filter("wk < 0").join(x, "wk", "left").crossJoin(F.broadcast(n))
    share = F.lit(100.0) * F.coalesce("count", F.lit(0)) / F.greatest("n_covered", F.lit(1))
    return s.agg(F.first("n_covered").alias("n_covered"), r6(F.regr_slope(share, F.col("wk").cast("double"))).alias("slope"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, ord, kind, event): the three definitions of an anchor's event date."""
    a = anchors(spark, sf_dir).join(broadcast_if_small(freezes(spark, sf_dir)), "addr", "left")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("event")) for k in ("signed", "published", "frozen")])
    return a.select("addr", "ord", F.explode(kinds).alias("k")).select("addr", "ord", "k.*").filter("event is not null")


DATED_SQL = f"{FREEZE_SQL}, dated AS (SELECT addr, ord, 'signed' AS kind, signed AS event FROM anchor UNION ALL SELECT addr, ord, 'published', published FROM anchor WHERE published IS NOT NULL UNION ALL SELECT anchor.addr, ord, 'frozen', frozen FROM anchor JOIN freeze_ev USING (addr))"


def dense_sql(rows: str, key: str, extra: str = "") -> str:
    return f"dn AS (SELECT k.{key}, wks.wk, coalesce(sum(x.v), 0) AS v FROM (SELECT DISTINCT {key} FROM {rows}) k CROSS JOIN wks LEFT JOIN {rows} x ON x.{key} = k.{key} AND x.wk = wks.wk {extra} GROUP BY 1, 2)"


def dense(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    s = series(spark, rows, key)
    return s.select(key, "wk", (F.col("vin") + F.col("vout")).alias("v"))


@query(with_(ACT_SQL, ANCHOR_SQL, DATED_SQL, WEEKS, f"x AS (SELECT kind, v, CAST(floor((ms - event) / {WEEK_MS}.0) AS BIGINT) AS wk FROM act JOIN dated ON act.addr = dated.addr WHERE ms < {END_MS})", dense_sql("x", "kind")) + f"SELECT kind, {summary_sql()} FROM dn GROUP BY 1")
def q_event_date_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = activity(spark, sf_dir).filter(F.col("ms") < END_MS).join(broadcast_if_small(dated(spark, sf_dir)), "addr").withColumn("wk", wk("event"))
    return dense(spark, rows, "kind").groupBy("kind").agg(*summary_columns())


@query(with_(A_SQL, WEEKS, f"x AS (SELECT o.ord AS left_out, v, {wk_sql()} AS wk FROM a CROSS JOIN (SELECT DISTINCT ord FROM a) o WHERE a.ord <> o.ord)", dense_sql("x", "left_out")) + f"SELECT left_out, {summary_sql()} FROM dn GROUP BY 1")
def q_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study without each order, from sums per order: all orders minus one never repeats the rows."""
    rows = anchored(spark, sf_dir).withColumn("wk", wk()).filter(F.col("wk").between(-W, W))
    per = rows.groupBy("ord", "wk").agg(F.sum("v").alias("v"))
    orders = anchored(spark, sf_dir).select(F.col("ord").alias("left_out")).distinct()
    total = per.groupBy("wk").agg(F.sum("v").alias("all_v"))
    grid = orders.crossJoin(F.broadcast(spine(spark))).join(F.broadcast(total), "wk", "left").join(per.withColumnRenamed("ord", "left_out"), ["left_out", "wk"], "left")
    return grid.select("left_out", "wk", (F.coalesce("all_v", F.lit(0)) - F.coalesce("v", F.lit(0))).alias("v")).groupBy("left_out").agg(*summary_columns())


@query(with_(A_SQL, WEEKS, f"x AS (SELECT ord, v, {wk_sql()} AS wk FROM a)", dense_sql("x", "ord")) + f"SELECT ord, {summary_sql()}, round(CAST(coalesce(sum(v) FILTER (wk BETWEEN -4 AND -1), 0) AS DOUBLE) / greatest(CAST(coalesce(sum(v) FILTER (wk < 0), 0) AS DOUBLE), 1e-9), 6) AS last4_share FROM dn GROUP BY 1")
def q_per_order_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0)).cast("double")
    last = r6(part(F.col("wk").between(-4, -1)) / F.greatest(part(F.col("wk") < 0), F.lit(1e-9))).alias("last4_share")
    return dense(spark, anchored(spark, sf_dir).withColumn("wk", wk()), "ord").groupBy("ord").agg(*summary_columns(), last)


REGIME_MS = 1_696_118_400_000  # 2023-10-01


@query(with_(A_SQL, WEEKS, f"x AS (SELECT CASE WHEN signed < {REGIME_MS} THEN 'early' ELSE 'late' END AS regime, v, {wk_sql()} AS wk FROM a)", dense_sql("x", "regime")) + f"SELECT regime, {summary_sql()} FROM dn GROUP BY 1")
def q_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    regime = F.when(F.col("signed") < REGIME_MS, "early").otherwise("late")
    return dense(spark, anchored(spark, sf_dir).withColumn("wk", wk()).withColumn("regime", regime), "regime").groupBy("regime").agg(*summary_columns())


@query(with_(A_SQL) + f"SELECT DISTINCT addr, ord FROM a WHERE ms >= signed - {W * WEEK_MS} AND ms < signed")
def q_pre_window_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with any transfer in the 26 weeks before their order."""
    anchor = anchors(spark, sf_dir)
    act = activity(spark, sf_dir).filter(F.col("ms") < END_MS).select(F.col("addr").alias("x"), "ms")
    near = (F.col("addr") == F.col("x")) & (F.col("ms") >= F.col("signed") - W * WEEK_MS) & (F.col("ms") < F.col("signed"))
    return anchor.join(act, near, "left_semi").select("addr", "ord")


def hash8(*cols) -> Column:
    """Portable pseudo-random number: the first 8 hex digits of md5 of the parts joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def hash8_sql(*cols: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(cols)})), 1, 8))::BIGINT"


PLACEBOS = 3000  # the surveyed system's own number of placebo addresses per seed
SEEDS = 300


def placebo_rows(spark: SparkSession, sf_dir: str, seeds: int) -> DataFrame:
    """(seed, addr, event): non-designated counterparties with a drawn date, active in the weeks before it."""
    t = timing(spark, sf_dir).filter("in_window").select("addr", "signed")
    dates = t.agg(F.array_sort(F.collect_list(F.struct("signed", "addr"))).alias("dates"))  # bounded by the designation list
    pool = hop1(spark, sf_dir).crossJoin(F.broadcast(spark.range(seeds).withColumnRenamed("id", "seed"))).crossJoin(F.broadcast(dates))
    drawn = pool.filter(F.size("dates") > 0).select("seed", "addr", F.element_at("dates", (hash8("seed", F.lit("date"), "addr") % F.size("dates") + 1).cast("int"))["signed"].alias("event"))
    act = activity(spark, sf_dir).filter(F.col("ms") < END_MS).select(F.col("addr").alias("x"), "ms")
    first = act.groupBy("x").agg(F.min("ms").alias("first_ms"))
    near = (F.col("addr") == F.col("x")) & (F.col("ms") >= F.col("event") - W * WEEK_MS) & (F.col("ms") < F.col("event"))
    ok = drawn.join(act, near, "left_semi").join(first, F.col("addr") == F.col("x")).filter(F.col("first_ms") <= F.col("event"))
    ordered = ok.select("seed", "addr", "event", hash8("seed", F.lit("order"), "addr").alias("h"), F.lit(PLACEBOS).alias("want"))
    return smallest(ordered, ["seed"], ["h", "addr"], "want", "addr").select("seed", "addr", "event")


def hop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = anchors(spark, sf_dir).select("addr")
    return anchored(spark, sf_dir).select(F.col("cp").alias("addr")).distinct().join(broadcast_if_small(dim), "addr", "left_anti")


def placebo_sql(seeds: int) -> str:
    return f"""{TIMING_SQL}, sd AS (SELECT unnest(range({seeds})) AS seed), dt AS (SELECT signed, row_number() OVER (ORDER BY signed, addr) - 1 AS i, count(*) OVER () AS n FROM tm WHERE in_window),
pool AS (SELECT DISTINCT cp AS addr FROM a WHERE cp NOT IN (SELECT addr FROM anchor)),
dr AS (SELECT seed, pool.addr, signed AS event FROM pool CROSS JOIN sd JOIN dt ON i = {hash8_sql("seed", "'date'", "pool.addr")} % n),
fs AS (SELECT addr, min(ms) AS first_ms FROM act WHERE ms < {END_MS} GROUP BY 1),
okp AS (SELECT seed, dr.addr, event, row_number() OVER (PARTITION BY seed ORDER BY {hash8_sql("seed", "'order'", "dr.addr")}, dr.addr) AS place FROM dr JOIN fs ON dr.addr = fs.addr
  WHERE first_ms <= event AND EXISTS (SELECT 1 FROM act WHERE act.addr = dr.addr AND ms >= event - {W * WEEK_MS} AND ms < event)),
x AS (SELECT seed, v, CAST(floor((ms - event) / {WEEK_MS}.0) AS BIGINT) AS wk FROM act JOIN okp ON act.addr = okp.addr WHERE place <= {PLACEBOS} AND ms < {END_MS}), {WEEKS}, {dense_sql("x", "seed")}"""


def placebo_study(spark: SparkSession, sf_dir: str, seeds: int) -> DataFrame:
    events = placebo_rows(spark, sf_dir, seeds)
    rows = activity(spark, sf_dir).filter(F.col("ms") < END_MS).join(events, "addr").withColumn("wk", wk("event"))
    return dense(spark, rows, "seed").groupBy("seed").agg(*summary_columns())


@query(with_(A_SQL, placebo_sql(1)) + f"SELECT seed, {summary_sql()} FROM dn GROUP BY 1")
def q_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placebo_study(spark, sf_dir, 1)


@query(with_(A_SQL, placebo_sql(SEEDS)) + f"SELECT seed, {summary_sql()} FROM dn GROUP BY 1")
def q_placebo_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placebo_study(spark, sf_dir, SEEDS)


BOOT = 2000
_BOOT_SQL = f"""g AS (SELECT ord, sum(v) FILTER ({wk_sql()} BETWEEN 7 AND 26) AS post, sum(v) FILTER ({wk_sql()} BETWEEN -26 AND -1) AS pre FROM a GROUP BY 1),
gi AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS n FROM g), bs AS (SELECT unnest(range({BOOT})) AS b),
pick AS (SELECT b, {hash8_sql("'cluster'", "b", "slot.i")} % slot.n AS i FROM bs CROSS JOIN gi slot),
rb AS (SELECT b, (CAST(coalesce(sum(post), 0) AS DOUBLE) / 20) / greatest(CAST(coalesce(sum(pre), 0) AS DOUBLE) / 26, 1e-9) AS ratio FROM pick JOIN gi USING (i) GROUP BY 1)"""


@query(with_(A_SQL, _BOOT_SQL) + "SELECT count(*) AS draws, round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.5), 6) AS mid, round(quantile_cont(ratio, 0.975), 6) AS high FROM rb")
def q_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of late to early volume when whole orders are drawn with replacement."""
    part = lambda lo, hi: F.sum(F.when(wk().between(lo, hi), F.col("v")))
    g = anchored(spark, sf_dir).groupBy("ord").agg(part(7, 26).alias("post"), part(-26, -1).alias("pre"))
    all_ = Window.orderBy("ord")  # one row per order: the designation list bounds it
    gi = g.select("post", "pre", (F.row_number().over(all_) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    pick = spark.range(BOOT).withColumnRenamed("id", "b").crossJoin(F.broadcast(gi.select(F.col("i").alias("slot"), "n"))).select("b", (hash8(F.lit("cluster"), "b", "slot") % F.col("n")).alias("i"))
    sums = pick.join(F.broadcast(gi.drop("n")), "i").groupBy("b").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("post", "pre")])
    ratio = sums.select(((F.col("post") / 20) / F.greatest(F.col("pre") / 26, F.lit(1e-9))).alias("ratio"))
    return ratio.agg(F.count(F.lit(1)).alias("draws"), *[r6(F.percentile("ratio", p)).alias(n) for n, p in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])


_SHARE_SQL = f"""pa AS (SELECT addr, CAST(CASE WHEN last_ms > signed THEN 1 ELSE 0 END AS DOUBLE) AS y, row_number() OVER (ORDER BY addr) - 1 AS i, count(*) OVER () AS n FROM tm WHERE in_window),
bs AS (SELECT unnest(range({BOOT})) AS b), pick AS (SELECT b, {hash8_sql("'share'", "b", "slot.i")} % slot.n AS i FROM bs CROSS JOIN pa slot), rb AS (SELECT b, avg(y) AS s FROM pick JOIN pa USING (i) GROUP BY 1)"""


@query(with_(ACT_SQL, ANCHOR_SQL, TIMING_SQL, _SHARE_SQL) + "SELECT round((SELECT avg(y) FROM pa), 6) AS share, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, round((SELECT avg(y) - 1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*)) FROM pa), 6) AS normal_low, round((SELECT avg(y) + 1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*)) FROM pa), 6) AS normal_high FROM rb")
def q_bootstrap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of anchors active after their order, with resampled and normal intervals."""
    y = F.when(F.col("last_ms") > F.col("signed"), 1.0).otherwise(0.0)
    pa = timing(spark, sf_dir).filter("in_window").select(y.alias("y"), (F.row_number().over(Window.orderBy("addr")) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    pick = spark.range(BOOT).withColumnRenamed("id", "b").crossJoin(F.broadcast(pa.select(F.col("i").alias("slot"), "n"))).select("b", (hash8(F.lit("share"), "b", "slot") % F.col("n")).alias("i"))
    draws = pick.join(F.broadcast(pa.drop("n")), "i").groupBy("b").agg(F.avg("y").alias("s")).agg(F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high"))
    p = pa.agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n"))
    half = F.lit(1.96) * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return draws.crossJoin(p).select(r6(F.col("p")).alias("share"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), r6(F.col("p") - half).alias("normal_low"), r6(F.col("p") + half).alias("normal_high"))


@query(with_(A_SQL, WEEKS, f"x AS (SELECT ord, v, {wk_sql('s0')} AS wk FROM a JOIN (SELECT ord AS o, min(signed) AS s0, min(published) AS p0 FROM anchor GROUP BY 1) f ON a.ord = f.o WHERE s0 + {W * WEEK_MS} <= {END_MS})", dense_sql("x", "ord")) + f""", pw AS (SELECT ord, CAST(floor((min(published) - min(signed)) / {WEEK_MS}.0) AS BIGINT) AS pub_week FROM anchor GROUP BY 1),
  pre AS (SELECT ord, greatest(CAST(sum(v) FILTER (wk < 0) AS DOUBLE) / 26, 1e-9) AS pre FROM dn GROUP BY 1),
  r AS (SELECT dn.ord, wk, CAST(v AS DOUBLE) / pre AS ratio, max(CAST(v AS DOUBLE) / pre) OVER (PARTITION BY dn.ord ORDER BY wk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM dn JOIN pre ON dn.ord = pre.ord WHERE wk >= 0)
  SELECT r.ord, any_value(pub_week) AS pub_week, round(avg(ratio) FILTER (wk < pub_week), 6) AS between_ratio, round(avg(ratio) FILTER (wk > pub_week), 6) AS after_ratio, round(avg(ratio) FILTER (wk BETWEEN 7 AND 26), 6) AS ratio_7_26, min(wk) FILTER (later < 0.1) AS stays_below FROM r JOIN pw ON r.ord = pw.ord GROUP BY 1""")
def q_publication_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: volume between signing and publication, after it, and when it stays below a tenth."""
    groups = anchors(spark, sf_dir).groupBy("ord").agg(F.min("signed").alias("s0"), F.min("published").alias("p0"))
    rows = anchored(spark, sf_dir).join(F.broadcast(groups), "ord").filter(F.col("s0") + W * WEEK_MS <= END_MS).withColumn("wk", wk("s0"))
    dn = dense(spark, rows, "ord")
    by_ord = Window.partitionBy("ord")
    pre = F.greatest(F.sum(F.when(F.col("wk") < 0, F.col("v"))).over(by_ord).cast("double") / 26, F.lit(1e-9))
    r = dn.withColumn("ratio", F.col("v").cast("double") / pre).filter("wk >= 0")
    r = r.withColumn("later", F.max("ratio").over(by_ord.orderBy("wk").rowsBetween(0, Window.unboundedFollowing)))
    r = r.join(F.broadcast(groups.select("ord", F.floor((F.col("p0") - F.col("s0")) / WEEK_MS).alias("pub_week"))), "ord")
    mean = lambda c: r6(F.avg(F.when(c, F.col("ratio"))))
    return r.groupBy("ord").agg(
        F.first("pub_week").alias("pub_week"),
        mean(F.col("wk") < F.col("pub_week")).alias("between_ratio"),
        mean(F.col("wk") > F.col("pub_week")).alias("after_ratio"),
        mean(F.col("wk").between(7, 26)).alias("ratio_7_26"),
        F.min(F.when(F.col("later") < 0.1, F.col("wk"))).alias("stays_below"),
    )


