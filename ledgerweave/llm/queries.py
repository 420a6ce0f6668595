"""Queries of the training-data problems (p1, p3, p4, p7, p8, p9) and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.ledger import address, utc_day
from ledgerweave.llm import components as cc
from ledgerweave.llm import distinct, leaks, packing, subjects, topk
from ledgerweave.sources.tables import TRANSFERS, table
from ledgerweave.storage import store

CONTAINER = 1024
#: where the public vocabularies lie, unless the session names another folder
TOKENIZERS, TOKENIZERS_SETTING = "/opt/tokenizers", "spark.ledgerweave.tokenizers"


def p1_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different senders, receivers and addresses of either side by day, load, both and over all."""
    rows = table(spark, sf_dir, TRANSFERS).select(
        utc_day("blockTimestamp").alias("day"), F.col("batch_id").alias("load"), address("from_hex").alias("f"), address("to_hex").alias("t")
    )
    fine = store(distinct.sketches(rows, "day", "load", {"from_hex": "f", "to_hex": "t"}), "sketches")
    return distinct.counts(distinct.rolled_up(fine.df))


def p1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count of p1_distinct beside the exact one, and whether it lies within four standard errors of it."""
    rows = table(spark, sf_dir, TRANSFERS).select(
        utc_day("blockTimestamp").cast("string").alias("day_utc"), "batch_id", address("from_hex").alias("from_hex"), address("to_hex").alias("to_hex")
    )
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("x")) for s, c in (("from_hex", "from_hex"), ("to_hex", "to_hex"), ("either", "from_hex"), ("either", "to_hex"))]))
    each = rows.select("day_utc", "batch_id", sides.alias("e")).select("day_utc", "batch_id", "e.*").filter("x is not null")
    levels = [("day_load", ["day_utc", "batch_id"]), ("day", ["day_utc"]), ("load", ["batch_id"]), ("all", [])]
    null = {"day_utc": F.lit(None).cast("string"), "batch_id": F.lit(None).cast("int")}
    exact = None
    for level, keys in levels:
        n = each.select("side", *keys, "x").distinct().groupBy("side", *keys).agg(F.count(F.lit(1)).alias("n_exact"))
        n = n.select(F.lit(level).alias("level"), *[F.col(k) if k in keys else null[k].alias(k) for k in null], "side", "n_exact")
        exact = n if exact is None else exact.unionByName(n)
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 4 * F.col("n_exact") / F.sqrt(F.lit(float(distinct.REGISTERS)))
    both = (p1_distinct(spark, sf_dir).alias("p").join(exact.alias("e"), F.expr("p.level = e.level and p.side = e.side and p.day_utc <=> e.day_utc and p.batch_id <=> e.batch_id"), "full"))
    return both.select("e.level", "e.day_utc", "e.batch_id", "e.side", "e.n_exact", F.coalesce(near, F.lit(False)).alias("within"))


def top_receivers(transfers: DataFrame, k: int) -> DataFrame:
    return topk.top_k(transfers.select(address("to_hex").alias("to_hex")), "to_hex", k).withColumnRenamed("v", "to_hex")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 values can each hold a 200th of the rows, so the first 200 hold them all."""
    transfers = table(spark, sf_dir, TRANSFERS)
    rows = transfers.count()
    return top_receivers(transfers, 200).filter(F.col("n") * 200 >= rows).select("to_hex")


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_receivers(table(spark, sf_dir, TRANSFERS), 100).withColumnRenamed("n", "n_rows")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, TRANSFERS).select(address("from_hex").alias("f"), address("to_hex").alias("t"))
    return cc.components(pairs, "f", "t").withColumnRenamed("name", "addr_hex")


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions in containers of 1,024 words."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", packing.word_runs("text").alias("n"))
    return packing.pack(sizes, "doc_id", "n", CONTAINER)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in more than one container."""
    spans = packed_words(spark, sf_dir).groupBy("item_id").agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    return spans.filter("low <> high").select(F.col("item_id").alias("doc_id"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing holds, that nothing overlaps or runs over, and that no more than a ninth again of the least bins is used."""
    c = packing.check(packed_words(spark, sf_dir), CONTAINER)
    return c.select("items", "tokens", "over_capacity", "overlaps", (F.col("bins") * 9 <= F.col("least") * 10 + 54).alias("tight"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions in containers of 1,024 tokens of a public tokenizer."""
    import public_tokenizers

    ranks = spark.conf.get(TOKENIZERS_SETTING, TOKENIZERS) + "/byte_bpe_50k.tiktoken"
    sizes = packing.tokenizer_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN)
    return packing.pack(sizes, "item_id", "n_tokens", CONTAINER).withColumnRenamed("item_id", "doc_id")


def leaks_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks.find_leaks(documents, "doc_id", "text", items, "item_id", "text", ["court", "case_no"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks_found(spark, sf_dir).select("doc_id", "item_id")


def p8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the longest run of the item's words, whether the passage is whole and the share of its exact shingles."""
    return leaks_found(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(*[table(spark, sf_dir, t) for t in ("documents", "doc_subject_labels", "subject_areas")])


QUERIES = {
    "p1_distinct": p1_distinct,
    "p1_error": p1_error,
    "p3_found": p3_found,
    "p3_top": p3_top,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p7_check": p7_check,
    "p7_pack": p7_pack,
    "p8_found": p8_found,
    "p8_runs": p8_runs,
    "p9_found": p9_found,
}

_X = f"SELECT right(lower(from_hex), 40) AS f, right(lower(to_hex), 40) AS t FROM {TRANSFERS}"

_LEVELS = [("day_load", "day_utc", "batch_id"), ("day", "day_utc", "NULL"), ("load", "NULL", "batch_id"), ("all", "NULL", "NULL")]

ORACLES = {
    "p1_error": f"""WITH x AS (SELECT CAST(DATE '1970-01-01' + CAST(floor(blockTimestamp / 86400000) AS INT) AS VARCHAR) AS day_utc, batch_id, right(lower(from_hex), 40) AS f, right(lower(to_hex), 40) AS t FROM {TRANSFERS}),
      e AS (SELECT day_utc, batch_id, 'from_hex' AS side, f AS v FROM x UNION ALL SELECT day_utc, batch_id, 'to_hex', t FROM x UNION ALL SELECT day_utc, batch_id, 'either', f FROM x UNION ALL SELECT day_utc, batch_id, 'either', t FROM x)
      """ + " UNION ALL ".join(f"SELECT '{n}' AS level, CAST({d} AS VARCHAR) AS day_utc, CAST({b} AS INT) AS batch_id, side, count(DISTINCT v) AS n_exact, true AS within FROM e WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4" for n, d, b in _LEVELS),
    "p3_found": f"WITH x AS ({_X}) SELECT t AS to_hex FROM x WHERE t IS NOT NULL GROUP BY 1 HAVING count(*) * 200 >= (SELECT count(*) FROM x)",
    "p3_top": f"WITH x AS ({_X}) SELECT t AS to_hex, count(*) AS n_rows FROM x WHERE t IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "p4_found": f"""WITH RECURSIVE x AS ({_X}), e AS MATERIALIZED (SELECT f AS a, t AS b FROM x WHERE f IS NOT NULL AND t IS NOT NULL UNION SELECT t, f FROM x WHERE f IS NOT NULL AND t IS NOT NULL),
      n AS (SELECT DISTINCT a FROM e), cc(addr_hex, grp) USING KEY (addr_hex) AS (SELECT a, a FROM n UNION SELECT r.addr_hex, min(c.grp) FROM cc c JOIN e ON c.addr_hex = e.a JOIN recurring.cc r ON r.addr_hex = e.b WHERE c.grp < r.grp GROUP BY 1)
      SELECT addr_hex, grp FROM cc""",
    "p7_check": r"SELECT count(*) AS items, CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 0)) AS BIGINT) AS tokens, 0::BIGINT AS over_capacity, 0::BIGINT AS overlaps, true AS tight FROM documents",
    "p7_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) > 1024",
}
