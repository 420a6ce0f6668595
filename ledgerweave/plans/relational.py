"""Scans, decoding, deduplication, pair and node aggregates."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ledger import address, tx_hash
from ledgerweave.plans.base import ACT_SQL, ANCHOR_SQL, D_SQL, FREEZE_SQL, LABEL_SQL, PAIR_SQL, T_SQL, activity, anchors, deliveries, freezes, labels, money, pairs, query, r6, transfers, with_
from ledgerweave.sources.tables import TRANSFERS, table

#: the token contract and its two kinds of event in the raw log (fixed values of the test data)
CONTRACT = "8fa3c405b732ffb1a68f287df1b6c74cfc43bdbd"
TRANSFER_TOPIC = "b106a74eebb70139bf5c5bd143b2b8deb9ff15eab1222980cdb4734fdc4fffa8"


@query(f"""SELECT DISTINCT right(lower(transactionHash), 64) AS tx, logIndex AS li, blockTimestamp AS ms, right(lower(topic1), 40) AS src, right(lower(topic2), 40) AS dst,
  CASE WHEN substr(data, 1, 48) = repeat('0', 48) THEN CAST(('0x' || substr(data, 49, 16))::UBIGINT AS DOUBLE) / 1e6 END AS amount
  FROM tron_events WHERE address = '{CONTRACT}' AND topic0 = '{TRANSFER_TOPIC}' AND topic2 IS NOT NULL""")
def q_hex_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded transfers of the log, once each; an amount beyond 64 bits is an artefact and null."""
    e = table(spark, sf_dir, "tron_events").filter((F.col("address") == CONTRACT) & (F.col("topic0") == TRANSFER_TOPIC) & F.col("topic2").isNotNull())
    amount = F.when(F.substring("data", 1, 48) == "0" * 48, F.conv(F.substring("data", 49, 16), 16, 10).cast("decimal(20,0)").cast("double") / 1e6)
    return e.select(tx_hash("transactionHash").alias("tx"), F.col("logIndex").alias("li"), F.col("blockTimestamp").alias("ms"), address("topic1").alias("src"), address("topic2").alias("dst"), amount.alias("amount")).distinct()


@query(f"WITH {D_SQL} SELECT tx, li, batch_id, value FROM d WHERE tx IS NOT NULL AND li IS NOT NULL")
def q_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).filter("tx is not null and li is not null").select("tx", "li", "batch_id", "value")


@query(f"""SELECT count(*) AS n_rows, count(DISTINCT k) AS n_events, round(1 - count(DISTINCT k) / count(*), 8) AS duplicate_share
  FROM (SELECT right(lower(transactionHash), 64) || '|' || logIndex AS k FROM {TRANSFERS} WHERE transactionHash IS NOT NULL AND logIndex IS NOT NULL)""")
def q_duplicate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, TRANSFERS).select(tx_hash("transactionHash").alias("tx"), "logIndex").filter("tx is not null and logIndex is not null")
    n = ids.groupBy("tx", "logIndex").count().agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_events"))
    return n.withColumn("duplicate_share", F.round(1 - F.col("n_events") / F.col("n_rows"), 8))


@query(f"WITH {D_SQL} SELECT DISTINCT src, dst, value, ms FROM d WHERE src IS NOT NULL AND dst IS NOT NULL")
def q_dedup_fullrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).filter("src is not null and dst is not null").select("src", "dst", "value", "ms").distinct()


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (value > 1e8) AS over_cap, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value IS NULL) AS missing,
  count(*) FILTER (value > 0 AND value <= 1e8) AS usable FROM {TRANSFERS}""")
def q_overflow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, TRANSFERS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value") > 1e8).alias("over_cap"),
        F.count_if(F.col("value") == 0).alias("zero"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if((F.col("value") > 0) & (F.col("value") <= 1e8)).alias("usable"),
    )


@query(f"WITH {T_SQL} SELECT ('0x' || substr(md5(src), 1, 8))::BIGINT % 32 AS bucket, count(DISTINCT src) AS n_senders, count(*) AS n_rows FROM t GROUP BY 1")
def q_hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct senders per hash bucket; no sender is in two buckets, so the counts add up."""
    bucket = F.pmod(F.conv(F.substring(F.md5("src"), 1, 8), 16, 10).cast("bigint"), F.lit(32))
    senders = transfers(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return senders.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_senders"), F.sum("n").alias("n_rows"))


@query(f"WITH {PAIR_SQL} SELECT src, dst, cnt, CAST(w AS DOUBLE) AS w FROM pair")
def q_pair_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("src", "dst", "cnt", money("w").alias("w"))


@query(f"WITH {T_SQL} SELECT DISTINCT src, dst FROM t")
def q_pair_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers(spark, sf_dir).select("src", "dst").distinct()


@query(f"""WITH {T_SQL}, e AS (SELECT src, dst, CAST(sum(v) AS DOUBLE) AS w, avg(CAST(ms AS DOUBLE)) AS m FROM t GROUP BY 1, 2)
  SELECT src, dst, round(ln(1 + w) / (SELECT ln(1 + max(w)) FROM e), 6) AS log_w, round((m - (SELECT min(m) FROM e)) / greatest((SELECT max(m) - min(m) FROM e), 1), 6) AS mean_t,
    round(greatest(1e-6, least(1, 0.1 * ln(1 + w) / ln(1 + 1e8))), 8) AS prop_prob FROM e""")
def q_edge_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = transfers(spark, sf_dir).groupBy("src", "dst").agg(money(F.sum("v")).alias("w"), F.avg(F.col("ms").cast("double")).alias("m"))
    g = e.agg(F.log1p(F.max("w")).alias("top"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    return e.crossJoin(F.broadcast(g)).select(
        "src",
        "dst",
        r6(F.log1p("w") / F.col("top")).alias("log_w"),
        r6((F.col("m") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))).alias("mean_t"),
        F.round(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.log1p("w") * 0.1 / F.log1p(F.lit(1e8)))), 8).alias("prop_prob"),
    )


@query(f"WITH {T_SQL} SELECT src AS addr FROM t UNION SELECT dst FROM t")
def q_node_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir)
    return t.select(F.col("src").alias("addr")).union(t.select("dst")).distinct()


@query(f"WITH {PAIR_SQL} SELECT addr, CAST(sum(o) AS BIGINT) AS out_deg, CAST(sum(i) AS BIGINT) AS in_deg, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS addr, 1 AS o, 0 AS i FROM pair UNION ALL SELECT dst, 0, 1 FROM pair) GROUP BY 1")
def q_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(pairs(spark, sf_dir))


def degrees(p: DataFrame) -> DataFrame:
    """(addr, out_deg, in_deg, degree) over distinct pairs; a loop counts on both sides."""
    ends = p.select(F.explode(F.array(F.struct(F.col("src").alias("addr"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("addr"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.addr").agg(F.sum("e.o").alias("out_deg"), F.sum("e.i").alias("in_deg"), F.sum(F.col("e.o") + F.col("e.i")).alias("degree"))


@query(f"WITH {ACT_SQL} SELECT addr, count(*) FILTER (dir = 'in') AS in_cnt, count(*) FILTER (dir = 'out') AS out_cnt FROM act GROUP BY 1")
def q_transfer_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).groupBy("addr").agg(F.count_if(F.col("dir") == "in").alias("in_cnt"), F.count_if(F.col("dir") == "out").alias("out_cnt"))


@query(f"WITH {ACT_SQL} SELECT addr, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n, CAST(sum(v) AS DOUBLE) AS volume FROM act GROUP BY 1")
def q_activity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).groupBy("addr").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"), money(F.sum("v")).alias("volume"))


@query(f"WITH {ACT_SQL}, c AS (SELECT addr, count(DISTINCT cp) AS n FROM act GROUP BY 1) SELECT count(*) AS n_addr, count(*) FILTER (n = 1) AS n_single, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 8) AS share FROM c")
def q_single_counterparty_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = activity(spark, sf_dir).select("addr", "cp").distinct().groupBy("addr").count()
    return one.agg(F.count(F.lit(1)).alias("n_addr"), F.count_if(F.col("count") == 1).alias("n_single"), F.round(F.avg((F.col("count") == 1).cast("double")), 8).alias("share"))


@query(f"""WITH {D_SQL}, p AS (SELECT src, dst, sum(CAST(value AS DECIMAL(20,6))) AS w FROM d WHERE value >= 0 AND value <= 1e8 AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)
  SELECT count(*) AS n_pairs, count(*) FILTER (w = 0) AS zero_pairs, round(count(*) FILTER (w = 0) / count(*), 8) AS zero_share FROM p""")
def q_zero_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deliveries(spark, sf_dir).filter("value >= 0 and value <= 1e8 and src is not null and dst is not null")
    p = d.groupBy("src", "dst").agg(F.sum(F.col("value").cast("decimal(20,6)")).alias("w"))
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("w") == 0).alias("zero_pairs")).withColumn("zero_share", F.round(F.col("zero_pairs") / F.col("n_pairs"), 8))


@query("""SELECT chain, address, source, raw_json, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY chain, address, source ORDER BY fetched_at DESC NULLS LAST, raw_json DESC NULLS LAST) AS rn FROM label_cache) WHERE rn = 1""")
def q_label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as keyed upserts leave it: the latest row of each key."""
    last = table(spark, sf_dir, "label_cache").groupBy("chain", "address", "source").agg(F.max(F.struct("fetched_at", "raw_json")).alias("r"))
    return last.select("chain", "address", "source", "r.raw_json", "r.fetched_at")


@query("""SELECT order_text, address, signed, last_value(published IGNORE NULLS) OVER (PARTITION BY substr(address, 1, 2) ORDER BY signed NULLS FIRST, address NULLS FIRST, order_text NULLS FIRST, published NULLS FIRST ROWS UNBOUNDED PRECEDING) AS carried FROM designation_list""")
def q_asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the latest publication known so far in its group."""
    w = Window.partitionBy(F.substring("address", 1, 2)).orderBy("signed", "address", "order_text", "published").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "designation_list").select("order_text", "address", "signed", F.last("published", ignorenulls=True).over(w).alias("carried"))


@query(with_(ANCHOR_SQL) + "SELECT addr, ord, signed, published FROM anchor")
def q_base58_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(spark, sf_dir)


@query(with_(LABEL_SQL) + "SELECT DISTINCT addr, label, provider, name_tag FROM lab")
def q_label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).distinct()


@query(f"WITH {FREEZE_SQL} SELECT addr, frozen FROM freeze_ev")
def q_first_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freezes(spark, sf_dir)


@query("""SELECT count(*) AS n_rows, count(amount) AS n_decoded, CAST(sum(amount) AS DOUBLE) / 1e6 AS total FROM (
  SELECT CASE WHEN length(h) >= 16 AND (length(h) < 64 OR substr(right(h, 64), 1, 48) = repeat('0', 48)) THEN CAST(('0x' || right(h, 16))::UBIGINT AS HUGEINT) END AS amount
  FROM (SELECT regexp_replace(lower(data), '^0x', '') AS h FROM (SELECT DISTINCT right(lower(addr_hex), 40) AS a, data FROM tron_usdt_blackfunds_destroyed)))""")
def q_destroyed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destroyed funds: distinct (address, data), last 64 bits of the hex amount."""
    rows = table(spark, sf_dir, "tron_usdt_blackfunds_destroyed").select(address("addr_hex").alias("a"), "data").distinct()
    h = rows.select(F.regexp_replace(F.lower("data"), "^0x", "").alias("h"))
    fits = (F.length("h") >= 16) & ((F.length("h") < 64) | (F.substring(F.right("h", F.lit(64)), 1, 48) == "0" * 48))
    d = h.select(F.when(fits, F.conv(F.right("h", F.lit(16)), 16, 10).cast("decimal(20,0)")).alias("amount"))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count("amount").alias("n_decoded"), (F.sum("amount").cast("double") / 1e6).alias("total"))
