"""Enforcement, balances, custody, persistence, concentration and migration."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ledger import DAY_MS
from ledgerweave.operators.chunks import RANK, running_total
from ledgerweave.operators.lookups import broadcast_if_small
from ledgerweave.operators.passage import first_below
from ledgerweave.plans.base import ACT_SQL, ANCHOR_SQL, END_MS, FREEZE_SQL, LABEL_SQL, PAIR_SQL, T_SQL, activity, anchors, freezes, labels, money, pairs, query, r6, stage, transfers, with_
from ledgerweave.plans.events import CUT, SERIES_SQL, about, counterparties, series, summary_columns, summary_sql, wk

HOUR_MS = 3_600_000


def frozen_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(spark, sf_dir).join(broadcast_if_small(freezes(spark, sf_dir)), "addr")


FZ_SQL = f"{FREEZE_SQL}, fz AS MATERIALIZED (SELECT anchor.*, frozen FROM anchor JOIN freeze_ev ON anchor.addr = freeze_ev.addr)"
ENF_SQL = f"""en AS MATERIALIZED (SELECT fz.addr, ord, CAST(floor((frozen - signed) / {DAY_MS}.0) AS BIGINT) AS lag_days,
  coalesce(sum(CASE WHEN ms < frozen THEN CASE dir WHEN 'in' THEN v ELSE -v END END), 0) AS bal, coalesce(sum(v) FILTER (dir = 'in' AND ms >= frozen - {30 * DAY_MS} AND ms < frozen), 0) AS in30, coalesce(sum(v) FILTER (dir = 'out' AND ms >= frozen - {30 * DAY_MS} AND ms < frozen), 0) AS out30,
  count(*) FILTER (ms > frozen) AS n_after, CAST(floor((frozen - max(ms) FILTER (ms < frozen)) / {DAY_MS}.0) AS BIGINT) AS dormancy FROM fz LEFT JOIN act ON act.addr = fz.addr GROUP BY fz.addr, ord, signed, frozen)"""


def enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    fz = frozen_anchors(spark, sf_dir)
    act = about(activity(spark, sf_dir), fz)
    v, before = F.col("v"), F.col("ms") < F.col("frozen")
    recent = before & (F.col("ms") >= F.col("frozen") - 30 * DAY_MS)
    total = lambda c, x=v: F.sum(F.when(c, x))
    per = act.groupBy("addr").agg(
        total(before, F.when(F.col("dir") == "in", v).otherwise(-v)).alias("bal"),
        total(recent & (F.col("dir") == "in")).alias("in30"),
        total(recent & (F.col("dir") == "out")).alias("out30"),
        F.count_if(F.col("ms") > F.col("frozen")).alias("n_after"),
        F.max(F.when(before, F.col("ms"))).alias("last_before"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fz.join(per, "addr", "left").select(
        "addr",
        "ord",
        F.floor((F.col("frozen") - F.col("signed")) / DAY_MS).alias("lag_days"),
        zero("bal"),
        zero("in30"),
        zero("out30"),
        zero("n_after"),
        F.floor((F.col("frozen") - F.col("last_before")) / DAY_MS).alias("dormancy"),
    )


@query(with_(ACT_SQL, ANCHOR_SQL, FZ_SQL, ENF_SQL) + "SELECT addr, ord, lag_days, CAST(bal AS DOUBLE) AS balance, CAST(in30 AS DOUBLE) AS in30, CAST(out30 AS DOUBLE) AS out30, n_after, dormancy FROM en")
def q_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforcement(spark, sf_dir).select("addr", "ord", "lag_days", money("bal").alias("balance"), money("in30").alias("in30"), money("out30").alias("out30"), "n_after", "dormancy")


@query(with_(ACT_SQL, ANCHOR_SQL, FZ_SQL, ENF_SQL) + """SELECT ord, grouping(ord) AS g_ord, count(*) AS n, round(avg(CASE WHEN lag_days < 0 THEN 1.0 ELSE 0 END), 6) AS frozen_before, round(avg(CASE WHEN lag_days BETWEEN 0 AND 30 THEN 1.0 ELSE 0 END), 6) AS within_30,
  round(avg(CASE WHEN bal > 1 THEN 1.0 ELSE 0 END), 6) AS positive, CAST(sum(greatest(bal, 0)) AS DOUBLE) AS held, round(median(lag_days), 6) AS median_lag FROM en GROUP BY ROLLUP (ord)""")
def q_enforcement_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: r6(F.avg(F.coalesce(c, F.lit(False)).cast("double")))
    return enforcement(spark, sf_dir).rollup("ord").agg(
        F.grouping("ord").cast("bigint").alias("g_ord"),
        F.count(F.lit(1)).alias("n"),
        share(F.col("lag_days") < 0).alias("frozen_before"),
        share(F.col("lag_days").between(0, 30)).alias("within_30"),
        share(F.col("bal") > 1).alias("positive"),
        money(F.sum(F.greatest(F.col("bal"), F.lit(0)))).alias("held"),
        r6(F.median("lag_days")).alias("median_lag"),
    )


@query(with_(ACT_SQL, ANCHOR_SQL, FZ_SQL) + "SELECT dir, count(*) AS n, count(DISTINCT fz.addr) AS n_addr, CAST(sum(v) AS DOUBLE) AS volume FROM act JOIN fz ON act.addr = fz.addr WHERE ms > frozen GROUP BY 1")
def q_after_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = about(activity(spark, sf_dir), frozen_anchors(spark, sf_dir)).filter("ms > frozen")
    return a.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("addr").alias("n_addr"), money(F.sum("v")).alias("volume"))


_FS = SERIES_SQL.replace("FROM a)", "FROM af)").replace("ms - signed", "ms - frozen")


@query(with_(ACT_SQL, ANCHOR_SQL, FZ_SQL, f"af AS (SELECT act.*, frozen FROM act JOIN fz ON act.addr = fz.addr WHERE ms < {END_MS})", _FS) + f"SELECT {summary_sql()} FROM (SELECT wk, vin + vout AS v FROM se)")
def q_freeze_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = about(activity(spark, sf_dir).filter(F.col("ms") < END_MS), frozen_anchors(spark, sf_dir)).withColumn("wk", wk("frozen"))
    return series(spark, a).select("wk", (F.col("vin") + F.col("vout")).alias("v")).agg(*summary_columns())


PATH_SQL = """pa AS MATERIALIZED (SELECT act.addr, ord, signed, published, cp, dir, v, ms, tx, li, row_number() OVER (PARTITION BY act.addr ORDER BY ms, tx NULLS FIRST, li NULLS FIRST, cp, dir, v) AS seq,
  sum(CASE dir WHEN 'in' THEN v ELSE -v END) OVER (PARTITION BY act.addr ORDER BY ms, tx NULLS FIRST, li NULLS FIRST, cp, dir, v ROWS UNBOUNDED PRECEDING) AS bal FROM act JOIN anchor ON act.addr = anchor.addr WHERE act.cp <> act.addr)"""


def balance_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors' transfers, loops left out, with their place in time and the balance after each.

    Numbered and summed by chunks: an anchor with a third of all transfers is no single group.
    """

    def make() -> DataFrame:
        a = about(activity(spark, sf_dir), anchors(spark, sf_dir)).filter("cp <> addr")
        a = a.withColumn("delta", F.when(F.col("dir") == "in", F.col("v")).otherwise(-F.col("v")))
        order = [F.col(c).asc_nulls_first() for c in ("ms", "tx", "li", "cp", "dir", "v")]
        run = running_total(a, ["addr"], "delta", order)
        return run.withColumn("seq", F.col(RANK) + 1).withColumnRenamed("running", "bal").drop(RANK, "delta")

    return stage(spark, sf_dir, "balances", make)


@query(with_(ACT_SQL, ANCHOR_SQL, PATH_SQL) + "SELECT addr, seq, ms, CAST(bal AS DOUBLE) AS balance FROM pa")
def q_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance_path(spark, sf_dir).select("addr", "seq", "ms", money("bal").alias("balance"))


@query(with_(ACT_SQL, ANCHOR_SQL, PATH_SQL) + "SELECT addr, CAST(max(bal) AS DOUBLE) AS peak, CAST(arg_max(bal, seq) AS DOUBLE) AS final FROM pa GROUP BY 1")
def q_peak_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance_path(spark, sf_dir).groupBy("addr").agg(money(F.max("bal")).alias("peak"), money(F.max_by("bal", "seq")).alias("final"))


@query(with_(ACT_SQL, ANCHOR_SQL, FREEZE_SQL) + """, mk AS (SELECT addr, 'signed' AS mark, signed AS mark_ms FROM anchor UNION ALL SELECT addr, 'published', published FROM anchor WHERE published IS NOT NULL UNION ALL SELECT anchor.addr, 'frozen', frozen FROM anchor JOIN freeze_ev USING (addr))
  SELECT mk.addr, mark, CAST(coalesce(sum(CASE dir WHEN 'in' THEN v ELSE -v END), 0) AS DOUBLE) AS balance FROM mk LEFT JOIN act ON act.addr = mk.addr AND ms <= mark_ms AND cp <> act.addr GROUP BY 1, 2""")
def q_balance_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance at each mark: one pass over the activity, summing what lies at or before it."""
    a = anchors(spark, sf_dir).join(broadcast_if_small(freezes(spark, sf_dir)), "addr", "left")
    marks = F.array(*[F.struct(F.lit(k).alias("mark"), F.col(k).alias("at")) for k in ("signed", "published", "frozen")])
    marks = a.select("addr", F.explode(marks).alias("m")).select("addr", "m.*").filter("at is not null")
    act = about(activity(spark, sf_dir).filter("cp <> addr"), anchors(spark, sf_dir).select("addr"))
    delta = F.when(F.col("dir") == "in", F.col("v")).otherwise(-F.col("v"))
    on = (F.col("x") == F.col("addr")) & (F.col("ms") <= F.col("at"))
    joined = marks.join(act.select(F.col("addr").alias("x"), "ms", delta.alias("d")), on, "left")
    return joined.groupBy("addr", "mark").agg(money(F.coalesce(F.sum("d"), F.lit(0))).alias("balance"))


SWEEP_SQL = """sw AS MATERIALIZED (SELECT i.addr, i.seq, any_value(i.v) AS v, any_value(i.ms) AS ms, min(o.ms) AS hit FROM pa i LEFT JOIN pa o ON o.addr = i.addr AND o.seq > i.seq AND o.bal < greatest(1, i.bal * 0.01) WHERE i.dir = 'in' GROUP BY 1, 2),
sd AS MATERIALIZED (SELECT addr, count(*) AS n_in, CAST(sum(v) AS DOUBLE) AS inflow, round(CAST(coalesce(sum(v) FILTER (hit - ms <= 86400000), 0) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS sweep_share, round(median((hit - ms) / 3600000.0), 6) AS dwell_hours FROM sw GROUP BY 1)"""


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast inflows leave: the first later time the balance is under a hundredth of what it was."""
    path = balance_path(spark, sf_dir).withColumn("under", F.greatest(F.lit(1), F.col("bal") * F.lit(0.01).cast("decimal(3,2)")))
    hits = first_below(path, "addr", "seq", "bal", "under", "ms").filter("dir = 'in'")
    gone = F.when(F.col("hit") - F.col("ms") <= 24 * HOUR_MS, F.col("v"))
    return hits.groupBy("addr").agg(
        F.count(F.lit(1)).alias("n_in"),
        money(F.sum("v")).alias("inflow"),
        r6(money(F.coalesce(F.sum(gone), F.lit(0))) / money(F.sum("v"))).alias("sweep_share"),
        r6(F.median((F.col("hit") - F.col("ms")) / HOUR_MS)).alias("dwell_hours"),
    )


@query(with_(ACT_SQL, ANCHOR_SQL, PATH_SQL, SWEEP_SQL) + "SELECT * FROM sd")
def q_sweep_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps(spark, sf_dir)


TAG_SQL = f"{LABEL_SQL}, tg AS (SELECT addr, max(CASE WHEN name_tag LIKE '%. User' THEN 1 ELSE 0 END) AS own, max(CASE WHEN label = 'cex' OR label LIKE 'cex:%' THEN 1 ELSE 0 END) AS cex FROM lab GROUP BY 1)"
CUST_SQL = """oc AS (SELECT addr, cp, sum(v) AS v FROM act WHERE dir = 'out' AND cp <> addr GROUP BY 1, 2),
tp AS (SELECT addr, arg_max(cp, (v, cp)) AS top_cp, round(CAST(max(v) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS top_share, count(*) AS n_cp FROM oc WHERE addr IN (SELECT addr FROM anchor) GROUP BY 1),
cu AS MATERIALIZED (SELECT anchor.addr, ord, coalesce(tg.own, 0) = 1 AS own_label, coalesce(top_share >= 0.9 AND rc.cex = 1, false) AS recipient, coalesce(sweep_share >= 0.9 AND dwell_hours <= 24 AND n_cp <= 3, false) AS behaviour FROM anchor LEFT JOIN tg ON anchor.addr = tg.addr LEFT JOIN tp ON anchor.addr = tp.addr LEFT JOIN tg rc ON tp.top_cp = rc.addr LEFT JOIN sd ON anchor.addr = sd.addr)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.max(F.coalesce(F.col("name_tag").endswith(". User"), F.lit(False))).alias("own")
    return labels(spark, sf_dir).groupBy("addr").agg(own, F.max((F.col("label") == "cex") | F.col("label").startswith("cex:")).alias("cex"))


def custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor, tag = anchors(spark, sf_dir), tags(spark, sf_dir)
    out = about(activity(spark, sf_dir).filter("dir = 'out' and cp <> addr"), anchor.select("addr")).groupBy("addr", "cp").agg(F.sum("v").alias("v"))
    top = out.groupBy("addr").agg(F.max(F.struct("v", "cp"))["cp"].alias("top_cp"), r6(money(F.max("v")) / money(F.sum("v"))).alias("top_share"), F.count(F.lit(1)).alias("n_cp"))
    rows = anchor.join(tag.select("addr", "own"), "addr", "left").join(top, "addr", "left")
    rows = rows.join(tag.select(F.col("addr").alias("top_cp"), "cex"), "top_cp", "left").join(sweeps(spark, sf_dir), "addr", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "addr",
        "ord",
        yes(F.col("own")).alias("own_label"),
        yes((F.col("top_share") >= 0.9) & F.col("cex")).alias("recipient"),
        yes((F.col("sweep_share") >= 0.9) & (F.col("dwell_hours") <= 24) & (F.col("n_cp") <= 3)).alias("behaviour"),
    )


@query(with_(ACT_SQL, ANCHOR_SQL, TAG_SQL, PATH_SQL, SWEEP_SQL, CUST_SQL) + "SELECT *, own_label OR recipient OR behaviour AS any_sign FROM cu")
def q_custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody(spark, sf_dir).withColumn("any_sign", F.col("own_label") | F.col("recipient") | F.col("behaviour"))


@query(with_(ACT_SQL, ANCHOR_SQL, TAG_SQL, PATH_SQL, SWEEP_SQL, CUST_SQL) + "SELECT ord, grouping(ord) AS g_ord, count(*) AS n, count(*) FILTER (own_label) AS n_own, count(*) FILTER (recipient) AS n_recipient, count(*) FILTER (behaviour) AS n_behaviour FROM cu GROUP BY GROUPING SETS ((), (ord))")
def q_custody_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody(spark, sf_dir).rollup("ord").agg(F.grouping("ord").cast("bigint").alias("g_ord"), F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for c, n in (("own_label", "n_own"), ("recipient", "n_recipient"), ("behaviour", "n_behaviour"))])


@query(with_(PAIR_SQL, ANCHOR_SQL) + "SELECT src, dst, CAST(w AS DOUBLE) AS volume, place FROM (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM pair WHERE src IN (SELECT addr FROM anchor)) WHERE place <= 2")
def q_top_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = anchors(spark, sf_dir).select(F.col("addr").alias("src"))
    p = pairs(spark, sf_dir).join(broadcast_if_small(dim), "src", "left_semi")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return p.withColumn("place", place.cast("bigint")).filter("place <= 2").select("src", "dst", money("w").alias("volume"), "place")


@query(f"WITH {PAIR_SQL} SELECT src, round(CAST(max(w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 8) AS top_share, count(*) AS n_recipients FROM pair GROUP BY 1")
def q_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("src").agg(F.round(money(F.max("w")) / money(F.sum("w")), 8).alias("top_share"), F.count(F.lit(1)).alias("n_recipients"))


PERS_SQL = f"""cps AS (SELECT cp AS addr, min(signed) AS d FROM act JOIN anchor ON act.addr = anchor.addr WHERE ms < signed AND cp NOT IN (SELECT addr FROM anchor) GROUP BY 1),
pe AS MATERIALIZED (SELECT act.addr, max(ms) AS last_ms, min(d) AS d, sum(v) AS vol, coalesce(sum(v) FILTER (ms > d), 0) AS after_v FROM act JOIN cps ON act.addr = cps.addr WHERE d <= {CUT} GROUP BY 1)"""
_PERS_OUT = f"count(*) AS n, round(avg(CASE WHEN last_ms > d THEN 1.0 ELSE 0 END), 6) AS active_after, round(avg(CASE WHEN last_ms > d + {90 * DAY_MS} THEN 1.0 ELSE 0 END), 6) AS active_90, round(CAST(sum(after_v) AS DOUBLE) / CAST(sum(vol) AS DOUBLE), 6) AS pooled_share, round(median(CAST(after_v AS DOUBLE) / CAST(vol AS DOUBLE)), 6) AS median_share"


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counterparties(spark, sf_dir).filter(F.col("first_signed") <= CUT)
    return activity(spark, sf_dir).join(c, "addr").groupBy("addr").agg(F.max("ms").alias("last_ms"), F.first("first_signed").alias("d"), F.sum("v").alias("vol"), F.coalesce(F.sum(F.when(F.col("ms") > F.col("first_signed"), F.col("v"))), F.lit(0)).alias("after_v"))


def persistence_measures() -> list[Column]:
    share = lambda c: r6(F.avg(c.cast("double")))
    return [
        F.count(F.lit(1)).alias("n"),
        share(F.col("last_ms") > F.col("d")).alias("active_after"),
        share(F.col("last_ms") > F.col("d") + 90 * DAY_MS).alias("active_90"),
        r6(money(F.sum("after_v")) / money(F.sum("vol"))).alias("pooled_share"),
        r6(F.median(money("after_v") / money("vol"))).alias("median_share"),
    ]


@query(with_(ACT_SQL, ANCHOR_SQL, PERS_SQL) + f"SELECT {_PERS_OUT} FROM pe")
def q_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence(spark, sf_dir).agg(*persistence_measures())


@query(with_(ACT_SQL, ANCHOR_SQL, PERS_SQL) + f"SELECT {_PERS_OUT} FROM pe WHERE CAST(vol AS DOUBLE) <= (SELECT quantile_cont(CAST(vol AS DOUBLE), 0.99) FROM pe)")
def q_persistence_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = persistence(spark, sf_dir)
    top = p.agg(F.percentile(money("vol"), 0.99).alias("top"))
    return p.crossJoin(F.broadcast(top)).filter(money("vol") <= F.col("top")).agg(*persistence_measures())


GRID = 100
LOR_SQL = f"""v AS (SELECT dst, sum(w) AS v FROM pair GROUP BY 1), rk AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v DESC, dst) AS r, sum(v) OVER (ORDER BY v DESC, dst ROWS UNBOUNDED PRECEDING) AS c, sum(v) OVER () AS s, count(*) OVER () AS n FROM v)"""


def lorenz(spark: SparkSession, values: DataFrame, key: str, value: str) -> DataFrame:
    """(r, v, c, s, n): rank, value, cumulative, total and number, without a window over all rows.

    Values are sorted by range; each partition cumulates its own and adds the totals before it.
    """
    from ledgerweave.operators.chunks import running_total

    one = values.select(F.lit(0).alias("g"), key, F.col(value).alias("v"))
    run = running_total(one, ["g"], "v", [F.desc("v"), F.col(key)], 50_000)
    total = values.agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return run.crossJoin(F.broadcast(total)).select((F.col("_lw_rank") + 1).alias("r"), "v", F.col("running").alias("c"), "s", "n")


@query(f"WITH {PAIR_SQL}, {LOR_SQL} SELECT r, round(CAST(c AS DOUBLE) / CAST(s AS DOUBLE), 8) AS cum_share FROM rk WHERE r % greatest(n // {GRID}, 1) = 0")
def q_lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairs(spark, sf_dir).groupBy("dst").agg(F.sum("w").alias("v"))
    at = F.col("r") % F.greatest(F.floor(F.col("n") / GRID), F.lit(1)) == 0
    return lorenz(spark, got, "dst", "v").filter(at).select("r", F.round(money("c") / money("s"), 8).alias("cum_share"))


@query(f"WITH {PAIR_SQL}, {LOR_SQL} SELECT round(CAST(max(c) FILTER (r <= 10) AS DOUBLE) / CAST(max(s) AS DOUBLE), 8) AS top_10, round(CAST(max(c) FILTER (r <= 100) AS DOUBLE) / CAST(max(s) AS DOUBLE), 8) AS top_100, round(CAST(max(c) FILTER (r <= greatest(n // 100, 1)) AS DOUBLE) / CAST(max(s) AS DOUBLE), 8) AS top_1pct FROM rk")
def q_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rk = lorenz(spark, pairs(spark, sf_dir).groupBy("dst").agg(F.sum("w").alias("v")), "dst", "v")
    top = lambda c: F.round(money(F.max(F.when(c, F.col("c")))) / money(F.max("s")), 8)
    return rk.agg(top(F.col("r") <= 10).alias("top_10"), top(F.col("r") <= 100).alias("top_100"), top(F.col("r") <= F.greatest(F.floor(F.col("n") / 100), F.lit(1))).alias("top_1pct"))


@query(f"WITH {PAIR_SQL}, r AS (SELECT dst, w, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS i, count(*) OVER (PARTITION BY dst) AS n FROM pair) SELECT dst AS addr, round(CASE WHEN any_value(n) < 2 THEN 0 ELSE 2 * CAST(sum(i * w) AS DOUBLE) / (any_value(n) * CAST(sum(w) AS DOUBLE)) - (any_value(n) + 1) / any_value(n) END, 6) AS gini FROM r GROUP BY 1")
def q_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inequality of what each receiver gets from its senders; ranks by exact offsets, so that a
    receiver with a third of all senders is no single group."""
    from ledgerweave.operators.chunks import RANK, number_rows

    p = number_rows(pairs(spark, sf_dir).select("src", "dst", "w"), ["dst"], [F.col("w"), F.col("src")]).df
    i = (F.col(RANK) + 1).cast("decimal(12,0)")
    g = p.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), money(F.sum(i * F.col("w"))).alias("iw"), money(F.sum("w")).alias("w"))
    return g.select(F.col("dst").alias("addr"), r6(F.when(F.col("n") < 2, 0.0).otherwise(2 * F.col("iw") / (F.col("n") * F.col("w")) - (F.col("n") + 1) / F.col("n"))).alias("gini"))


def month_start(ms: str) -> Column:
    return F.trunc(F.date_from_unix_date(F.floor(F.col(ms) / DAY_MS).cast("int")), "month")


_DAY_SQL = "DATE '1970-01-01' + CAST(ms // 86400000 AS INT)"


@query(with_(ACT_SQL, ANCHOR_SQL) + f""", m AS (SELECT CAST(date_trunc('month', {_DAY_SQL}) AS DATE) AS month, v, addr, addr IN (SELECT addr FROM anchor) AS own FROM act WHERE ms < {END_MS}),
  sp AS (SELECT CAST(unnest(range((SELECT min(month) FROM m), (SELECT max(month) FROM m) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month)
  SELECT CAST(sp.month AS VARCHAR) AS month, CAST(coalesce(sum(v), 0) AS DOUBLE) AS volume, CAST(coalesce(sum(v) FILTER (own), 0) AS DOUBLE) AS designated, count(DISTINCT addr) AS n_active FROM sp LEFT JOIN m ON sp.month = m.month GROUP BY 1""")
def q_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = anchors(spark, sf_dir).select("addr", F.lit(True).alias("own"))
    rows = activity(spark, sf_dir).filter(F.col("ms") < END_MS).join(broadcast_if_small(dim), "addr", "left").withColumn("month", month_start("ms"))
    per = rows.groupBy("month", "addr").agg(F.sum("v").alias("v"), F.first("own").alias("own"))
    per = per.groupBy("month").agg(F.sum("v").alias("volume"), F.sum(F.when(F.col("own"), F.col("v"))).alias("designated"), F.count(F.lit(1)).alias("n_active"))
    span = per.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return span.join(per, "month", "left").select(F.col("month").cast("string").alias("month"), money(zero("volume")).alias("volume"), money(zero("designated")).alias("designated"), zero("n_active").alias("n_active"))


APPEAL_MS = 1_672_531_200_000  # 2023-01-01, the instant windows are counted from
BUSY_SQL = "busy AS (SELECT dst FROM t GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), ap AS MATERIALIZED (SELECT * FROM t WHERE dst IN (SELECT dst FROM busy))"


def appeal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers to the address with most of them."""
    t = transfers(spark, sf_dir)
    busy = t.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select("dst")
    return t.join(broadcast_if_small(busy), "dst", "left_semi")


@query(f"WITH {T_SQL}, {BUSY_SQL}, sp AS (SELECT CAST(unnest(range((SELECT min({_DAY_SQL}) FROM ap), (SELECT max({_DAY_SQL}) FROM ap) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(sp.day AS VARCHAR) AS day, count(v) AS n, count(DISTINCT src) AS donors, CAST(coalesce(sum(v), 0) AS DOUBLE) AS volume FROM sp LEFT JOIN ap ON sp.day = {_DAY_SQL} GROUP BY 1")
def q_daily_appeal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = appeal(spark, sf_dir).withColumn("day", F.date_from_unix_date(F.floor(F.col("ms") / DAY_MS).cast("int")))
    per = rows.groupBy("day", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).groupBy("day").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("donors"), F.sum("v").alias("volume"))
    span = per.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return span.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), zero("n").alias("n"), zero("donors").alias("donors"), money(zero("volume")).alias("volume"))


WINDOWS = [("week1", 0, 7), ("d0_30", 0, 30), ("d0_90", 0, 90), ("d90_365", 90, 365), ("later", 365, 100_000)]
_WIN_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in WINDOWS)


@query(f"WITH {T_SQL}, {BUSY_SQL}, w(label, lo, hi) AS (VALUES {_WIN_SQL}) SELECT label, count(v) AS n, CAST(coalesce(sum(v), 0) AS DOUBLE) AS volume, count(DISTINCT src) AS donors FROM w LEFT JOIN ap ON ms >= {APPEAL_MS} + lo * 86400000::BIGINT AND ms < {APPEAL_MS} + hi * 86400000::BIGINT GROUP BY 1")
def q_appeal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows after an instant: each transfer goes to the labels whose range holds it."""
    day = (F.col("ms") - APPEAL_MS) / DAY_MS
    into = F.array_compact(F.array(*[F.when((day >= a) & (day < b), F.lit(n)) for n, a, b in WINDOWS]))
    per = appeal(spark, sf_dir).select(F.explode(into).alias("label"), "src", "v").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.countDistinct("src").alias("donors"))
    names = spark.createDataFrame([(n,) for n, _, _ in WINDOWS], "label string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return names.join(per, "label", "left").select("label", zero("n").alias("n"), money(zero("v")).alias("volume"), zero("donors").alias("donors"))


@query(f"WITH {T_SQL}, b AS (SELECT CAST(least(greatest(floor((log10(CAST(v AS DOUBLE)) + 1) * 4) + 1, 0), 32) AS BIGINT) AS bin FROM t), sp AS (SELECT unnest(range(0, 33)) AS bin) SELECT sp.bin, count(b.bin) AS n FROM sp LEFT JOIN b ON sp.bin = b.bin GROUP BY 1")
def q_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in 32 bins of a quarter decade from 0.1; bin 0 is what lies below, the last is closed."""
    at = F.floor((F.log10(money("v")) + 1) * 4) + 1
    b = transfers(spark, sf_dir).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(32)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(33).withColumnRenamed("id", "bin").join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_(ACT_SQL, ANCHOR_SQL, FZ_SQL, TAG_SQL) + """, x AS (SELECT CASE WHEN cp IN (SELECT addr FROM anchor) THEN 'anchor' WHEN tg.cex = 1 THEN 'exchange' WHEN tg.addr IS NOT NULL THEN 'labelled' ELSE 'unlabelled' END AS category, v, cp FROM act JOIN fz ON act.addr = fz.addr LEFT JOIN tg ON tg.addr = cp WHERE dir = 'out' AND cp <> act.addr AND ms >= signed AND ms < frozen)
  SELECT category, count(*) AS n, count(DISTINCT cp) AS n_cp, CAST(sum(v) AS DOUBLE) AS volume, round(CAST(sum(v) AS DOUBLE) / CAST(sum(sum(v)) OVER () AS DOUBLE), 8) AS share FROM x GROUP BY 1""")
def q_post_event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where anchors sent what they had between order and freeze."""
    own = anchors(spark, sf_dir).select(F.col("addr").alias("cp"), F.lit(True).alias("own"))
    tag = tags(spark, sf_dir).select(F.col("addr").alias("cp"), "cex")
    out = about(activity(spark, sf_dir).filter("dir = 'out' and cp <> addr"), frozen_anchors(spark, sf_dir)).filter("ms >= signed and ms < frozen")
    kind = F.when(F.col("own"), "anchor").when(F.col("cex"), "exchange").when(F.col("cex").isNotNull(), "labelled").otherwise("unlabelled")
    x = out.join(broadcast_if_small(own), "cp", "left").join(tag, "cp", "left").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cp").alias("n_cp"), F.sum("v").alias("v"))
    return x.select("category", "n", "n_cp", money("v").alias("volume"), F.round(money("v") / money(F.sum("v").over(Window.partitionBy())), 8).alias("share"))


@query(with_(ACT_SQL, ANCHOR_SQL) + ", r AS (SELECT cp AS addr, sum(v) AS got FROM act JOIN anchor ON act.addr = anchor.addr WHERE dir = 'out' GROUP BY 1 ORDER BY got DESC, addr LIMIT 20) SELECT act.addr, count(*) AS n, min(ms) AS first_ms, count(DISTINCT cp) AS n_cp FROM act JOIN r ON act.addr = r.addr GROUP BY 1")
def q_recipient_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty addresses that anchors sent most to."""
    out = about(activity(spark, sf_dir).filter("dir = 'out'"), anchors(spark, sf_dir).select("addr"))
    top = out.groupBy("cp").agg(F.sum("v").alias("got")).orderBy(F.desc("got"), "cp").limit(20).select(F.col("cp").alias("addr"))
    return activity(spark, sf_dir).join(F.broadcast(top), "addr").groupBy("addr").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.countDistinct("cp").alias("n_cp"))


@query(with_(PAIR_SQL, ANCHOR_SQL) + "SELECT (SELECT count(*) FROM t) AS n_all, count(*) AS n_kept, round(count(*) / (SELECT count(*) FROM t), 8) AS ratio FROM t WHERE src IN (SELECT addr FROM anchor) OR dst IN (SELECT addr FROM anchor)")
def q_capture_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = anchors(spark, sf_dir).select("addr")
    mark = lambda df, c: df.join(broadcast_if_small(dim.select(F.col("addr").alias(c), F.lit(1).alias(f"is_{c}"))), c, "left")
    t = mark(mark(transfers(spark, sf_dir).select("src", "dst"), "src"), "dst")
    n = t.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("is_src").isNotNull() | F.col("is_dst").isNotNull()).alias("n_kept"))
    return n.withColumn("ratio", F.round(F.col("n_kept") / F.col("n_all"), 8))


FLOOR = 1.0
MIG_SQL = f"""cut AS (SELECT addr, ord, greatest(signed, coalesce(published, signed)) AS cut FROM anchor),
cps AS MATERIALIZED (SELECT cut.ord, cp, min(cut) AS cut FROM act JOIN cut ON act.addr = cut.addr WHERE ms < cut AND cp NOT IN (SELECT addr FROM anchor) GROUP BY 1, 2),
mv AS MATERIALIZED (SELECT ord, act.addr AS cp, act.cp AS other, coalesce(sum(v) FILTER (ms <= cut), 0) AS pre, coalesce(sum(v) FILTER (ms > cut), 0) AS post FROM act JOIN cps ON act.addr = cps.cp WHERE act.cp NOT IN (SELECT addr FROM anchor) GROUP BY 1, 2, 3),
ov AS MATERIALIZED (SELECT ord, other, count(*) FILTER (pre >= {FLOOR}) AS pre_n, count(*) FILTER (post >= {FLOOR}) AS post_n FROM mv GROUP BY 1, 2)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, other, pre_n, post_n): how many prior counterparties of an order deal with each other address."""
    anchor = anchors(spark, sf_dir)
    cut = anchor.select("addr", "ord", F.greatest("signed", F.coalesce("published", "signed")).alias("cut"))
    dim = broadcast_if_small(anchor.select(F.col("addr").alias("cp")))
    cps = about(activity(spark, sf_dir).join(dim, "cp", "left_anti"), cut).filter("ms < cut").groupBy("ord", F.col("cp").alias("addr")).agg(F.min("cut").alias("cut"))
    # dates of orders, which the designation list bounds, cut time into periods: volumes are summed by period before they meet the orders
    dates = cut.agg(F.array_sort(F.collect_set("cut")).alias("dates"))
    act = activity(spark, sf_dir).select("addr", "cp", "v", "ms").join(dim, "cp", "left_anti").crossJoin(F.broadcast(dates))
    flows = act.groupBy("addr", "cp", F.size(F.filter("dates", lambda d: d < F.col("ms"))).alias("period")).agg(F.sum("v").alias("v"))
    due = cps.crossJoin(F.broadcast(dates)).select("ord", "addr", (F.array_position("dates", F.col("cut")) - 1).alias("at"))
    mv = flows.join(due, "addr").groupBy("ord", "addr", F.col("cp").alias("other")).agg(F.sum(F.when(F.col("period") <= F.col("at"), F.col("v"))).alias("pre"), F.sum(F.when(F.col("period") > F.col("at"), F.col("v"))).alias("post"))
    return mv.groupBy("ord", "other").agg(F.count_if(F.col("pre") >= FLOOR).alias("pre_n"), F.count_if(F.col("post") >= FLOOR).alias("post_n"))


@query(with_(ACT_SQL, ANCHOR_SQL, MIG_SQL) + "SELECT ord, other, pre_n, post_n FROM ov WHERE post_n > 0")
def q_migration_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, sf_dir).filter("post_n > 0")


@query(with_(ACT_SQL, ANCHOR_SQL, MIG_SQL) + "SELECT ord, pre_n = 0 AS newcomer, count(*) AS n, CAST(max(post_n) AS BIGINT) AS most, round(quantile_cont(post_n, 0.5), 6) AS p50, round(quantile_cont(post_n, 0.9), 6) AS p90 FROM ov WHERE post_n > 0 GROUP BY 1, 2")
def q_newcomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlaps(spark, sf_dir).filter("post_n > 0")
    return o.groupBy("ord", (F.col("pre_n") == 0).alias("newcomer")).agg(F.count(F.lit(1)).alias("n"), F.max("post_n").alias("most"), r6(F.percentile("post_n", 0.5)).alias("p50"), r6(F.percentile("post_n", 0.9)).alias("p90"))


SUCC_SQL = """rc AS MATERIALIZED (SELECT l.addr, count(DISTINCT c.cp) FILTER (act.ms < e.signed) AS before_n, count(DISTINCT c.cp) FILTER (act.ms >= e.signed) AS after_n, count(DISTINCT act.cp) AS degree FROM anchor l JOIN act ON act.addr = l.addr
  LEFT JOIN (SELECT DISTINCT act.cp, x.addr AS via, x.signed FROM act JOIN anchor x ON act.addr = x.addr WHERE ms < x.signed) c ON c.cp = act.cp AND c.signed < l.signed AND c.via <> l.addr LEFT JOIN anchor e ON e.addr = c.via GROUP BY 1)"""


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later designated addresses: how many prior counterparties of earlier ones they reached, and their degree.

    The transfers with a counterparty come down to the first and the last, and the designated addresses that
    dealt with it to one list, so that no counterparty multiplies rows.
    """
    anchor = anchors(spark, sf_dir)
    mine = about(activity(spark, sf_dir), anchor.select("addr", "signed"))
    ways = mine.groupBy("addr", "signed", "cp").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    prior = ways.filter("first < signed").groupBy("cp").agg(F.collect_set(F.struct("addr", "signed")).alias("vias"))
    links = ways.join(prior, "cp", "left")
    earlier = lambda v: (v["signed"] < F.col("signed")) & (v["addr"] != F.col("addr"))
    n = lambda c: F.count_if(F.coalesce(F.exists("vias", c), F.lit(False)))
    return links.groupBy("addr").agg(n(lambda v: earlier(v) & (F.col("first") < v["signed"])).alias("before_n"), n(lambda v: earlier(v) & (F.col("last") >= v["signed"])).alias("after_n"), F.count(F.lit(1)).alias("degree"))


@query(with_(ACT_SQL, ANCHOR_SQL, SUCC_SQL) + "SELECT * FROM rc")
def q_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succession(spark, sf_dir)


NULL_SQL = """cpm AS (SELECT act.cp, min(x.signed) AS s0 FROM act JOIN anchor x ON act.addr = x.addr WHERE ms < x.signed GROUP BY 1),
lk AS MATERIALIZED (SELECT act.addr, act.cp, s0 FROM act JOIN cpm ON cpm.cp = act.cp WHERE act.addr NOT IN (SELECT addr FROM anchor) GROUP BY 1, 2, 3 HAVING max(ms) >= s0),
dgx AS MATERIALIZED (SELECT addr, count(DISTINCT cp) AS deg FROM act WHERE addr NOT IN (SELECT addr FROM anchor) GROUP BY 1),
rch AS MATERIALIZED (SELECT t.signed, lk.addr, count(*) AS reach FROM (SELECT DISTINCT signed FROM anchor) t JOIN lk ON s0 < t.signed GROUP BY 1, 2)"""


@query(with_(ACT_SQL, ANCHOR_SQL, SUCC_SQL, NULL_SQL) + """SELECT rc.addr, count(*) AS band, round(100 * avg(CASE WHEN coalesce(reach, 0) < after_n THEN 1.0 ELSE 0 END), 6) AS percentile FROM rc JOIN anchor USING (addr)
  JOIN dgx ON dgx.deg * 2 >= rc.degree AND dgx.deg <= rc.degree * 2 LEFT JOIN rch ON rch.addr = dgx.addr AND rch.signed = anchor.signed GROUP BY 1""")
def q_size_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach of designated addresses against undesignated ones of half to twice their degree.

    An undesignated address reaches a prior counterparty from the first order that made it one, so its reach
    by the date of each order is a count of such firsts. Addresses are counted by degree and reach; only these
    counts meet the designated ones.
    """
    anchor = anchors(spark, sf_dir).select("addr", "signed")
    act = activity(spark, sf_dir)
    first = about(act, anchor).filter("ms < signed").groupBy("cp").agg(F.min("signed").alias("s0"))
    dates = anchor.agg(F.array_sort(F.collect_set("signed")).alias("dates"))
    ways = act.groupBy("addr", "cp").agg(F.max("ms").alias("last")).join(broadcast_if_small(anchor.select("addr")), "addr", "left_anti").join(broadcast_if_small(first), "cp", "left")
    # (addr, deg, thresholds): from which dates on it reached one more
    each = ways.groupBy("addr", F.when(F.col("last") >= F.col("s0"), F.col("s0")).alias("s0")).agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("addr").agg(F.sum("n").alias("deg"), F.collect_list(F.when(F.col("s0").isNotNull(), F.struct("s0", "n"))).alias("steps"))
    linked = each.filter(F.size("steps") > 0).crossJoin(F.broadcast(dates)).select("deg", "steps", F.explode("dates").alias("signed"))
    reach = F.aggregate(F.filter("steps", lambda x: x["s0"] < F.col("signed")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    counts = linked.groupBy("deg", "signed", reach.alias("reach")).agg(F.count(F.lit(1)).alias("n"))
    idle = each.filter(F.size("steps") == 0).groupBy("deg").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(dates)).select("deg", F.explode("dates").alias("signed"), F.lit(0).cast("bigint").alias("reach"), "n")
    r = succession(spark, sf_dir).join(broadcast_if_small(anchor), "addr")
    met = counts.unionByName(idle).join(broadcast_if_small(r), "signed").filter((F.col("deg") * 2 >= F.col("degree")) & (F.col("deg") <= F.col("degree") * 2))
    return met.groupBy("addr").agg(F.sum("n").alias("band"), r6(F.sum(F.when(F.col("reach") < F.col("after_n"), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("percentile"))
