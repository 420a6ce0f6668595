"""Label rules, precedence and what follows from them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.plans.base import LABEL_SQL, PAIR_SQL, labels, money, pairs, query, with_

# fixed values: the providers' tags, prefixes and names, and the categories they stand for
SUSPICIOUS_TAGS = [
    "blacklisted", "sanctioned", "ofac", "darknet", "darkmarket", "darknet-market", "mixer", "tornado", "tornado_cash", "tornado-cash", "scam",
    "scammer", "phishing", "phisher", "hack", "hacker", "exploit", "exploited", "ransomware", "fraud", "theft", "thief", "illicit", "ponzi",
    "stealer", "drainer", "terrorism", "terrorist",
]
TAGS = {
    "CEX": [
        "cex", "exchange",
    ],
    "DEX": [
        "dex", "amm",
    ],
    "CONTRACT": [
        "stablecoin", "token-contract", "token_contract",
    ],
    "BRIDGE": [
        "bridge",
    ],
    "PROTOCOL": [
        "protocol", "defi", "lending", "liquid-staking", "staking",
    ],
    "INSTITUTION": [
        "validator", "oracle", "market-maker", "market_maker", "custodian", "payment", "payment-processor", "otc",
    ],
}
NAMED = {
    "CEX": [
        "binance", "coinbase", "kraken", "okx", "okex", "huobi", "htx", "bitfinex", "kucoin", "bybit", "bitstamp", "gemini", "ftx", "mexc",
        "gate.io", "gate", "bitget", "crypto.com", "poloniex", "upbit", "bithumb", "whitebit", "bitflyer", "deribit", "wazirx",
    ],
    "DEX": [
        "uniswap", "sushiswap", "sushi", "curve", "pancake", "pancakeswap", "1inch", "balancer", "dydx", "kyber", "kyberswap", "matcha", "sunswap",
        "justlend",
    ],
    "PROTOCOL": [
        "aave", "lido", "compound", "makerdao", "yearn", "rocketpool", "convex", "frax", "ethena", "morpho", "eigenlayer", "pendle", "gmx",
        "radiant", "spark",
    ],
}
PREFIXES = {"cex": "CEX", "exchange": "CEX", "dex": "DEX", "protocol": "PROTOCOL", "defi": "PROTOCOL", "bridge": "BRIDGE", "token": "CONTRACT"}
NAME_PARTS = [("exchange:", "CEX"), ("mixer:", "SUSPICIOUS"), ("sanctioned:", "SUSPICIOUS"), ("darknet", "SUSPICIOUS"), ("scam", "SUSPICIOUS"), ("phish", "SUSPICIOUS"), ("hack", "SUSPICIOUS"), ("bridge:", "BRIDGE"), ("token:", "CONTRACT"), ("defi:", "PROTOCOL"), ("protocol:", "PROTOCOL"), ("project:", "OTHER")]
#: what the fourth provider's records, a type and a list of labels, are searched for
FOURTH_SUSPICIOUS = ["sanction", "ofac", "blacklist", "scam", "phish", "mixer", "tornado", "hack", "exploit", "fraud", "theft", "ransom", "illicit", "darknet", "ponzi"]
FOURTH_TYPES = {
    "CEX": ["exchange", "cex"],
    "DEX": ["dex", "amm"],
    "CONTRACT": ["token", "stablecoin", "token-contract"],
    "PROTOCOL": ["defi", "protocol", "staking", "lending"],
    "BRIDGE": ["bridge", "cross-chain"],
    "INSTITUTION": ["market maker", "mm", "custodian", "fund", "otc"],
}
RANK = ["SUSPICIOUS", "CEX", "DEX", "PROTOCOL", "BRIDGE", "INSTITUTION", "CONTRACT", "OTHER"]
NEGATIVE = RANK[1:7]


def first_of(rules: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for cond, cat in reversed(rules):
        out = F.when(cond, F.lit(cat)).otherwise(out)
    return out


def category(provider: Column, label: Column, name_tag: Column) -> Column:
    """The category that one provider's record stands for, or null."""
    lab, name = F.lower(F.trim(label)), F.lower(F.trim(F.coalesce(name_tag, F.lit(""))))
    exact = first_of([(lab.isin(SUSPICIOUS_TAGS), "SUSPICIOUS"), *[(lab.isin(t), c) for c, t in TAGS.items()], *[(lab.isin(t), c) for c, t in NAMED.items()]])
    kind = first_of([(lab.startswith(p + ":"), c) for p, c in PREFIXES.items()])
    typed = first_of([((lab == "tokentag") | name.startswith("token:"), "CONTRACT"), *[(lab.isin("entitytag", "fullentitytag") & name.contains(p), c) for p, c in NAME_PARTS]])
    return F.when(provider == "allium", exact).when(provider == "rabby", kind).when((provider == "oklink") & (name != ""), typed)


def fourth_categories(kind: Column, labels: Column) -> Column:
    """The categories, none to two, of the fourth provider's record: its type, and any suspicious word in type or labels.

    Nulls in either count as nothing said.
    """
    clean = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    said = F.concat_ws(" ", clean(kind), F.concat_ws(" ", F.transform(F.coalesce(labels, F.array().cast("array<string>")), clean)))
    suspicious = F.when(said.rlike("|".join(FOURTH_SUSPICIOUS)), "SUSPICIOUS")
    return F.array_compact(F.array(suspicious, first_of([(clean(kind).isin(t), c) for c, t in FOURTH_TYPES.items()])))


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_CAT = (
    "CASE provider WHEN 'allium' THEN CASE WHEN l IN "
    + _list(SUSPICIOUS_TAGS)
    + " THEN 'SUSPICIOUS' "
    + " ".join(f"WHEN l IN {_list(t)} THEN '{c}'" for d in (TAGS, NAMED) for c, t in d.items())
    + " END WHEN 'rabby' THEN CASE "
    + " ".join(f"WHEN starts_with(l, '{p}:') THEN '{c}'" for p, c in PREFIXES.items())
    + " END WHEN 'oklink' THEN CASE WHEN n = '' THEN NULL WHEN l = 'tokentag' OR starts_with(n, 'token:') THEN 'CONTRACT' WHEN l NOT IN ('entitytag', 'fullentitytag') THEN NULL "
    + " ".join(f"WHEN contains(n, '{p}') THEN '{c}'" for p, c in NAME_PARTS)
    + " END END"
)
CAT_SQL = f"""{LABEL_SQL}, lc AS MATERIALIZED (SELECT addr, provider, label, {_CAT} AS category FROM (SELECT *, lower(trim(label)) AS l, lower(trim(coalesce(name_tag, ''))) AS n FROM lab)),
ac AS MATERIALIZED (SELECT addr, coalesce({RANK!r}[min(list_position({RANK!r}, category))], 'UNKNOWN') AS category FROM lc GROUP BY 1)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, category): the foremost category among an address's records."""
    c = labels(spark, sf_dir).withColumn("c", category(F.col("provider"), F.col("label"), F.col("name_tag")))
    rank = first_of([(F.col("c") == n, f"{i}") for i, n in enumerate(RANK)]).cast("int")
    best = c.groupBy("addr").agg(F.min(rank).alias("r"))
    return best.select("addr", F.coalesce(first_of([(F.col("r") == i, n) for i, n in enumerate(RANK)]), F.lit("UNKNOWN")).alias("category"))


@query(with_(CAT_SQL) + "SELECT DISTINCT addr, provider, label, category FROM lc")
def q_label_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("addr", "provider", "label", category(F.col("provider"), F.col("label"), F.col("name_tag")).alias("category")).distinct()


@query(with_(CAT_SQL) + "SELECT addr, category FROM ac")
def q_label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(spark, sf_dir)


@query(with_(PAIR_SQL, CAT_SQL) + ", x AS (SELECT coalesce(category, 'UNLABELLED') AS category, w FROM pair LEFT JOIN ac ON ac.addr = pair.dst) SELECT category, count(*) AS n_pairs, CAST(sum(w) AS DOUBLE) AS volume, round(CAST(sum(w) AS DOUBLE) / (SELECT CAST(sum(w) AS DOUBLE) FROM pair), 8) AS share FROM x GROUP BY 1")
def q_label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    x = p.join(categories(spark, sf_dir).withColumnRenamed("addr", "dst"), "dst", "left").groupBy(F.coalesce("category", F.lit("UNLABELLED")).alias("category")).agg(F.sum("n").alias("n_pairs"), F.sum("w").alias("w"))
    total = p.agg(money(F.sum("w")).alias("tw"))
    return x.crossJoin(F.broadcast(total)).select("category", "n_pairs", money("w").alias("volume"), F.round(money("w") / F.col("tw"), 8).alias("share"))


@query(with_(CAT_SQL) + f"SELECT category IN {_list(NEGATIVE)} AS verified_negative, category = 'SUSPICIOUS' AS suspicious, count(*) AS n FROM ac GROUP BY 1, 2")
def q_verified_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = categories(spark, sf_dir)
    return c.groupBy(F.col("category").isin(NEGATIVE).alias("verified_negative"), (F.col("category") == "SUSPICIOUS").alias("suspicious")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(LABEL_SQL) + "SELECT addr, coalesce(min(split_part(label, ':', 2)) FILTER (label LIKE 'cex:%'), trim(split_part(min(name_tag), '.', 1))) AS name, bool_or(coalesce(name_tag LIKE '%. User', false)) AS deposit FROM lab GROUP BY 1")
def q_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display name: the exchange a record names, else the name tag up to its first full stop."""
    named = F.min(F.when(F.col("label").startswith("cex:"), F.split_part("label", F.lit(":"), F.lit(2))))
    tag = F.trim(F.split_part(F.min("name_tag"), F.lit("."), F.lit(1)))
    return labels(spark, sf_dir).groupBy("addr").agg(F.coalesce(named, tag).alias("name"), F.bool_or(F.coalesce(F.col("name_tag").endswith(". User"), F.lit(False))).alias("deposit"))
