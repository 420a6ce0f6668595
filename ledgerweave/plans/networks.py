"""Networks of transfers: components, removal tests, cores, rankings and reach."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.operators.graph import pagerank, peel, spectral_radius, walk_sum, walk_terms, weak_components
from ledgerweave.operators.lookups import broadcast_if_small, smallest
from ledgerweave.plans.base import ANCHOR_SQL, PAIR_SQL, anchors, money, pairs, query, r6, stage, with_
from ledgerweave.plans.events import hash8, hash8_sql
from ledgerweave.plans.relational import degrees
from ledgerweave.storage import store


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, id, out_deg, in_deg, degree, own); the ids are in the order of the addresses."""
    dim = anchors(spark, sf_dir).select("addr", F.lit(True).alias("own"))

    def make() -> DataFrame:
        d = degrees(pairs(spark, sf_dir)).join(broadcast_if_small(dim), "addr", "left").withColumn("own", F.coalesce("own", F.lit(False)))
        return d.repartitionByRange("addr").sortWithinPartitions("addr").withColumn("id", F.monotonically_increasing_id())

    return stage(spark, sf_dir, "degrees", make)


def numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, cnt, w): the pairs with the ids of their ends."""
    ids = graph_degrees(spark, sf_dir)
    ends = [ids.select(F.col("addr").alias(a), F.col("id").alias(i)) for a, i in (("src", "u"), ("dst", "v"))]
    return stage(spark, sf_dir, "numbered_pairs", lambda: pairs(spark, sf_dir).join(ends[0], "src").join(ends[1], "dst").select("u", "v", "cnt", "w"))


DEG_SQL = "dg AS MATERIALIZED (SELECT addr, sum(o)::BIGINT AS out_deg, sum(i)::BIGINT AS in_deg, count(*) AS degree, addr IN (SELECT addr FROM anchor) AS own FROM (SELECT src AS addr, 1 AS o, 0 AS i FROM pair UNION ALL SELECT dst, 0, 1 FROM pair) GROUP BY 1)"


def matched(d: DataFrame, draws: int) -> DataFrame:
    """(draw, addr): per draw as many undesignated addresses of each degree as designated ones have it.

    Candidates of a degree come in hash order; where a degree has too few, all of them are taken. Each draw
    takes its smallest hashes of a degree in two steps (see ``smallest``), so no task sorts a whole degree.
    """
    want = d.filter("own").groupBy("degree").agg(F.count(F.lit(1)).alias("want"))
    pool = d.filter("not own").select("addr", "degree").join(broadcast_if_small(want), "degree")
    pool = pool.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))))
    pool = pool.withColumn("h", hash8(F.lit("match"), "draw", "addr"))
    return smallest(pool, ["draw", "degree"], ["h", "addr"], "want", "addr").select("draw", "addr")


def matched_sql(draws: int) -> str:
    return f"""mt AS MATERIALIZED (SELECT draw, addr FROM (SELECT draw, addr, want, row_number() OVER (PARTITION BY draw, dg.degree ORDER BY {hash8_sql("'match'", "draw", "addr")}, addr) AS place
  FROM dg JOIN (SELECT degree, count(*) AS want FROM dg WHERE own GROUP BY 1) w ON dg.degree = w.degree CROSS JOIN (SELECT unnest(range({draws})) AS draw) WHERE NOT own) WHERE place <= want)"""


def removal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, addr): designated, as many of highest degree, as many at random, matched by degree."""
    d = graph_degrees(spark, sf_dir)
    n = d.filter("own").count()
    free = d.filter("not own")
    sets = [
        d.filter("own").select(F.lit("designated").alias("set_name"), "addr"),
        free.orderBy(F.desc("degree"), "addr").limit(n).select(F.lit("top").alias("set_name"), "addr"),
        free.orderBy(hash8(F.lit("random"), "addr"), "addr").limit(n).select(F.lit("random").alias("set_name"), "addr"),
        matched(d, 1).select(F.lit("matched").alias("set_name"), "addr"),
    ]
    return stage(spark, sf_dir, "removal_sets", lambda: sets[0].union(sets[1]).union(sets[2]).union(sets[3]))


SETS_SQL = f"""{matched_sql(1)}, rs AS MATERIALIZED (SELECT 'designated' AS set_name, addr FROM dg WHERE own UNION ALL SELECT * FROM (SELECT 'top', addr FROM dg WHERE NOT own ORDER BY degree DESC, addr LIMIT (SELECT count(*) FROM dg WHERE own))
  UNION ALL SELECT * FROM (SELECT 'random', addr FROM dg WHERE NOT own ORDER BY {hash8_sql("'random'", "addr")}, addr LIMIT (SELECT count(*) FROM dg WHERE own)) UNION ALL SELECT 'matched', addr FROM mt)"""
NAMES = ["none", "designated", "top", "random", "matched"]


def set_numbers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES)), "tag bigint, set_name string")


def gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, id) of the removal sets."""
    named = removal_sets(spark, sf_dir).join(F.broadcast(set_numbers(spark)), "set_name")
    return stage(spark, sf_dir, "gone", lambda: graph_degrees(spark, sf_dir).select("addr", "id").join(broadcast_if_small(named), "addr").select("tag", "id"))


def tagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, u, v, cnt, w): the pairs left under each removal set, all sets in one relation."""
    tags = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(NAMES) - 1).cast("bigint"))).alias("tag")
    e = numbered_pairs(spark, sf_dir).select(tags, "u", "v", "cnt", "w")
    for c in ("u", "v"):
        e = e.join(broadcast_if_small(gone(spark, sf_dir).withColumnRenamed("id", c)), ["tag", c], "left_anti")
    return e.select("tag", "u", "v", "cnt", "w")


def surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, u, v, cnt, w)"""
    return tagged_pairs(spark, sf_dir).join(F.broadcast(set_numbers(spark)), "tag").drop("tag")


def kept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, tag, id, addr, degree): the addresses that each set leaves."""
    kept = graph_degrees(spark, sf_dir).select("id", "addr", "degree").crossJoin(F.broadcast(set_numbers(spark)))
    return kept.join(broadcast_if_small(gone(spark, sf_dir)), ["tag", "id"], "left_anti")


TAG = len(NAMES)


def components_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, root) of the whole graph."""
    return stage(spark, sf_dir, "components", lambda: weak_components(numbered_pairs(spark, sf_dir), "u", "v").select(F.col("node").alias("id"), "root"))


def tagged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, id, addr, comp) of all removal sets from one run, the set being part of the node's number.

    The whole graph isn't run again. ``comp`` is the number of the component's least address.
    """

    def make() -> DataFrame:
        e = tagged_pairs(spark, sf_dir).filter("tag > 0").select((F.col("u") * TAG + F.col("tag")).alias("a"), (F.col("v") * TAG + F.col("tag")).alias("b"))
        c = weak_components(e, "a", "b").select((F.col("node") % TAG).alias("tag"), F.floor(F.col("node") / TAG).alias("id"), F.floor(F.col("root") / TAG).alias("root"))
        got = c.unionByName(components_of(spark, sf_dir).select(F.lit(0).cast("bigint").alias("tag"), "id", "root"))
        return kept_nodes(spark, sf_dir).select("set_name", "tag", "id", "addr").join(got, ["tag", "id"], "left").select("set_name", "id", "addr", F.coalesce("root", "id").alias("comp"))

    return stage(spark, sf_dir, "tagged_components", make)


CC_SQL = f"""nm AS (SELECT unnest({NAMES!r}) AS set_name), kn AS MATERIALIZED (SELECT nm.set_name, dg.addr, degree FROM dg CROSS JOIN nm WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.set_name = nm.set_name AND rs.addr = dg.addr)),
ke AS MATERIALIZED (SELECT nm.set_name, src, dst, cnt, w FROM pair CROSS JOIN nm WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.set_name = nm.set_name AND rs.addr IN (src, dst))),
kb AS MATERIALIZED (SELECT set_name, src AS a, dst AS b FROM ke UNION SELECT set_name, dst, src FROM ke),
cc(set_name, addr, comp) USING KEY (set_name, addr) AS (SELECT set_name, addr, addr FROM kn UNION SELECT r.set_name, r.addr, min(c.comp) FROM cc c JOIN kb ON c.set_name = kb.set_name AND c.addr = kb.a JOIN recurring.cc r ON r.set_name = kb.set_name AND r.addr = kb.b WHERE c.comp < r.comp GROUP BY 1, 2),
big AS MATERIALIZED (SELECT set_name, comp, n FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY n DESC, comp) AS rn FROM (SELECT set_name, comp, count(*) AS n FROM cc GROUP BY 1, 2)) WHERE rn = 1)"""
GRAPH = with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL, SETS_SQL, CC_SQL)


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, comp, n) of the largest component; of equal ones that with the least name."""
    sizes = tagged_components(spark, sf_dir).groupBy("set_name", "comp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("set_name").agg(F.min(F.struct((-F.col("n")).alias("m"), "comp")).alias("b")).select("set_name", "b.comp", (-F.col("b.m")).alias("n"))


@query(GRAPH + "SELECT addr, comp FROM cc WHERE set_name = 'none'")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = components_of(spark, sf_dir), graph_degrees(spark, sf_dir).select("id", "addr")
    return c.join(d, "id").join(d.select(F.col("id").alias("root"), F.col("addr").alias("comp")), "root").select("addr", "comp")


@query(GRAPH + "SELECT set_name, count(DISTINCT comp) AS n_components, count(*) AS n_nodes FROM cc GROUP BY 1")
def q_component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_components(spark, sf_dir).groupBy("set_name", "comp").count().groupBy("set_name").agg(F.count(F.lit(1)).alias("n_components"), F.sum("count").alias("n_nodes"))


@query(GRAPH + "SELECT big.set_name, big.n AS lcc, k.n AS kept, round(big.n / k.n, 8) AS lcc_share FROM big JOIN (SELECT set_name, count(*) AS n FROM kn GROUP BY 1) k ON big.set_name = k.set_name")
def q_lcc_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tagged_components(spark, sf_dir).groupBy("set_name").agg(F.count(F.lit(1)).alias("kept"))
    return largest(spark, sf_dir).join(kept, "set_name").select("set_name", F.col("n").alias("lcc"), "kept", F.round(F.col("n") / F.col("kept"), 8).alias("lcc_share"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL, SETS_SQL) + "SELECT * FROM rs")
def q_removal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_sets(spark, sf_dir)


@query(GRAPH + ", s AS (SELECT big.set_name, big.n / k.n AS share FROM big JOIN (SELECT set_name, count(*) AS n FROM kn GROUP BY 1) k ON big.set_name = k.set_name) SELECT set_name, round(100 * (1 - share / (SELECT share FROM s WHERE set_name = 'none')), 6) AS loss_pct FROM s")
def q_removal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tagged_components(spark, sf_dir).groupBy("set_name").agg(F.count(F.lit(1)).alias("kept"))
    s = largest(spark, sf_dir).join(kept, "set_name").select("set_name", (F.col("n") / F.col("kept")).alias("share"))
    base = s.filter("set_name = 'none'").select(F.col("share").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("set_name", r6(F.lit(100.0) * (1 - F.col("share") / F.col("base"))).alias("loss_pct"))


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving pairs with whether both ends lie in the largest component (one end's component tells)."""
    comp = tagged_components(spark, sf_dir).join(F.broadcast(largest(spark, sf_dir).select("set_name", F.col("comp").alias("top"))), "set_name")
    mark = comp.select("set_name", F.col("id").alias("u"), (F.col("comp") == F.col("top")).alias("in_lcc"))
    return surviving(spark, sf_dir).join(mark, ["set_name", "u"])


IN_SQL = "ins AS (SELECT ke.set_name, ke.cnt, ke.w, cc.comp = big.comp AS in_lcc FROM ke JOIN cc ON cc.set_name = ke.set_name AND cc.addr = ke.src JOIN big ON big.set_name = ke.set_name)"


@query(GRAPH + f", {IN_SQL} SELECT set_name, count(*) FILTER (in_lcc) AS pairs_in, round(count(*) FILTER (in_lcc) / (SELECT count(*) FROM pair), 8) AS pair_share, round(CAST(coalesce(sum(w) FILTER (in_lcc), 0) AS DOUBLE) / (SELECT CAST(sum(w) AS DOUBLE) FROM pair), 8) AS value_share FROM ins GROUP BY 1")
def q_value_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("np"), money(F.sum("w")).alias("tw"))
    x = inside(spark, sf_dir).groupBy("set_name").agg(F.count_if("in_lcc").alias("pairs_in"), money(F.coalesce(F.sum(F.when(F.col("in_lcc"), F.col("w"))), F.lit(0))).alias("w"))
    return x.crossJoin(F.broadcast(total)).select("set_name", "pairs_in", F.round(F.col("pairs_in") / F.col("np"), 8).alias("pair_share"), F.round(F.col("w") / F.col("tw"), 8).alias("value_share"))


@query(GRAPH + f", {IN_SQL} SELECT set_name, CAST((SELECT sum(w) FROM pair) - sum(w) AS DOUBLE) AS incident, CAST(coalesce(sum(w) FILTER (NOT in_lcc), 0) AS DOUBLE) AS stranded, CAST(coalesce(sum(w) FILTER (in_lcc), 0) AS DOUBLE) AS live FROM ins GROUP BY 1")
def q_stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value on pairs that lost an end, that survive outside the largest component, and within it."""
    total = pairs(spark, sf_dir).agg(F.sum("w").alias("tw"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    x = inside(spark, sf_dir).groupBy("set_name").agg(F.sum("w").alias("w"), part(~F.col("in_lcc")).alias("stranded"), part(F.col("in_lcc")).alias("live"))
    return x.crossJoin(F.broadcast(total)).select("set_name", money(F.col("tw") - F.col("w")).alias("incident"), money("stranded").alias("stranded"), money("live").alias("live"))


@query(GRAPH + ", l AS (SELECT DISTINCT set_name, a AS addr FROM kb) SELECT set_name, count(*) FILTER (l.addr IS NULL) AS isolated, round(count(*) FILTER (l.addr IS NULL) / count(*), 8) AS share FROM kn LEFT JOIN l USING (set_name, addr) GROUP BY 1")
def q_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tagged_pairs(spark, sf_dir).select("tag", F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("on", F.lit(1))
    x = kept_nodes(spark, sf_dir).join(linked, ["tag", "id"], "left").groupBy("set_name").agg(F.count_if(F.col("on").isNull()).alias("isolated"), F.count(F.lit(1)).alias("n"))
    return x.select("set_name", "isolated", F.round(F.col("isolated") / F.col("n"), 8).alias("share"))


@query(GRAPH + """, ib AS (SELECT addr, comp = (SELECT comp FROM big WHERE set_name = 'none') AS was FROM cc WHERE set_name = 'none'), dr AS (SELECT cc.set_name, cc.addr, degree FROM cc JOIN big USING (set_name) JOIN ib ON ib.addr = cc.addr JOIN kn ON kn.set_name = cc.set_name AND kn.addr = cc.addr WHERE ib.was AND cc.comp <> big.comp)
  SELECT set_name, count(*) AS dropped, round(avg(CASE WHEN degree = 1 THEN 1.0 ELSE 0 END), 8) AS degree_one FROM dr GROUP BY 1""")
def q_dropped_decomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that fall out of the largest component without being removed, and how many hung on one pair."""
    top = largest(spark, sf_dir).select("set_name", F.col("comp").alias("top"))
    c = tagged_components(spark, sf_dir).join(F.broadcast(top), "set_name").withColumn("in_lcc", F.col("comp") == F.col("top"))
    was = c.filter("set_name = 'none' and in_lcc").select("addr")
    d = c.filter("not in_lcc").join(was, "addr", "left_semi").join(graph_degrees(spark, sf_dir).select("addr", "degree"), "addr")
    return d.groupBy("set_name").agg(F.count(F.lit(1)).alias("dropped"), F.round(F.avg((F.col("degree") == 1).cast("double")), 8).alias("degree_one"))


_CORE_SQL = """core(k, src, dst, n, before) AS (SELECT 0, src, dst, count(*) OVER (), -1::BIGINT FROM pair UNION ALL
  SELECT k + 1, src, dst, count(*) OVER (), n FROM (SELECT * FROM core WHERE n <> before) c WHERE src NOT IN (SELECT x FROM (SELECT unnest([src, dst]) AS x FROM core WHERE n <> before) GROUP BY 1 HAVING count(*) <= 1)
    AND dst NOT IN (SELECT x FROM (SELECT unnest([src, dst]) AS x FROM core WHERE n <> before) GROUP BY 1 HAVING count(*) <= 1))"""


@query(f"WITH RECURSIVE {PAIR_SQL}, {_CORE_SQL} SELECT src, dst FROM core WHERE k = (SELECT max(k) FROM core)")
def q_two_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 2-core."""
    return peel(pairs(spark, sf_dir))


@query(with_(PAIR_SQL, ANCHOR_SQL) + """, nb AS (SELECT src AS a, dst AS b FROM pair UNION SELECT dst, src FROM pair), h1 AS (SELECT DISTINCT b AS addr FROM nb WHERE a IN (SELECT addr FROM anchor)),
  h2 AS (SELECT DISTINCT b AS addr FROM nb WHERE a IN (SELECT addr FROM h1)), u AS (SELECT DISTINCT a AS addr FROM nb) SELECT addr, CASE WHEN addr IN (SELECT addr FROM anchor) THEN 0 WHEN addr IN (SELECT addr FROM h1) THEN 1 WHEN addr IN (SELECT addr FROM h2) THEN 2 END AS hop FROM u""")
def q_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops(spark, sf_dir)


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, hop): 0 for anchors, 1 and 2 for those reached over one or two pairs, else null."""
    p = pairs(spark, sf_dir)
    nb = p.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(p.select("dst", "src")).distinct()
    seed = anchors(spark, sf_dir).select(F.col("addr").alias("a"))
    h1 = nb.join(F.broadcast(seed), "a", "left_semi").select(F.col("b").alias("addr")).distinct()
    h2 = nb.join(h1.withColumnRenamed("addr", "a"), "a", "left_semi").select(F.col("b").alias("addr")).distinct()
    at = seed.select(F.col("a").alias("addr"), F.lit(0).alias("hop")).union(h1.withColumn("hop", F.lit(1))).union(h2.withColumn("hop", F.lit(2)))
    return nb.select(F.col("a").alias("addr")).distinct().join(at.groupBy("addr").agg(F.min("hop").alias("hop")), "addr", "left")


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + """, nb AS (SELECT src AS a, dst AS b FROM pair UNION SELECT dst, src FROM pair), k1 AS (SELECT b AS addr FROM nb WHERE a IN (SELECT addr FROM anchor) UNION SELECT addr FROM dg WHERE own)
  SELECT scope, count(*) AS n_pairs, CAST(sum(w) AS DOUBLE) AS volume, count(*) FILTER (src IN (SELECT addr FROM anchor) OR dst IN (SELECT addr FROM anchor)) AS touching FROM (SELECT 'two_hop' AS scope, * FROM pair UNION ALL SELECT 'one_hop', * FROM pair WHERE src IN (SELECT addr FROM k1) AND dst IN (SELECT addr FROM k1)) GROUP BY 1""")
def q_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the graph the induced one-hop neighbourhood of the anchors keeps."""
    near = hops(spark, sf_dir).filter("hop <= 1").select("addr", (F.col("hop") == 0).alias("own"))
    e = pairs(spark, sf_dir)
    for c in ("src", "dst"):
        e = e.join(near.select(F.col("addr").alias(c), F.col("own").alias(f"own_{c}")), c, "left")
    scope = F.array_compact(F.array(F.lit("two_hop"), F.when(F.col("own_src").isNotNull() & F.col("own_dst").isNotNull(), "one_hop")))
    touch = F.coalesce("own_src", F.lit(False)) | F.coalesce("own_dst", F.lit(False))
    return e.withColumn("scope", F.explode(scope)).groupBy("scope").agg(F.count(F.lit(1)).alias("n_pairs"), money(F.sum("w")).alias("volume"), F.count_if(touch).alias("touching"))


DRAWS = 200


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL, matched_sql(5)) + "SELECT * FROM mt")
def q_degree_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(graph_degrees(spark, sf_dir), 5)


def isolated_by(spark: SparkSession, sf_dir: str, sets: DataFrame) -> DataFrame:
    """(draw, n): addresses whose every pair leads to a removed one, looking at incident pairs only."""
    p = pairs(spark, sf_dir).filter("src <> dst").select("src", "dst")
    ways = p.select(F.col("src").alias("addr"), F.col("dst").alias("x")).union(p.select("dst", "src"))
    hit = ways.withColumnRenamed("addr", "other").join(sets.withColumnRenamed("addr", "x"), "x").groupBy("draw", F.col("other").alias("addr")).count()
    d = graph_degrees(spark, sf_dir).select("addr", "degree")
    gone = sets.select("draw", "addr")
    lone = hit.join(d, "addr").filter("count = degree").join(gone, ["draw", "addr"], "left_anti").groupBy("draw").agg(F.count(F.lit(1)).alias("n"))
    return sets.select("draw").distinct().join(lone, "draw", "left").select("draw", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL, matched_sql(DRAWS)) + """, st AS (SELECT draw, addr FROM mt UNION ALL SELECT -1, addr FROM dg WHERE own), wy AS (SELECT src AS addr, dst AS x FROM pair WHERE src <> dst UNION ALL SELECT dst, src FROM pair WHERE src <> dst),
  ht AS (SELECT draw, wy.addr, count(*) AS c FROM wy JOIN st ON st.addr = wy.x GROUP BY 1, 2), lo AS (SELECT ht.draw, count(*) AS n FROM ht JOIN dg ON dg.addr = ht.addr AND dg.degree = c WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.draw = ht.draw AND st.addr = ht.addr) GROUP BY 1),
  al AS (SELECT draw, coalesce(n, 0) AS n FROM (SELECT DISTINCT draw FROM st) LEFT JOIN lo USING (draw)), ob AS (SELECT n AS o FROM al WHERE draw = -1)
  SELECT count(*) AS draws, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, round(quantile_cont(n, 0.025), 6) AS low, round(quantile_cont(n, 0.975), 6) AS high, any_value(o) AS observed, round(100 * avg(CASE WHEN n < o THEN 1.0 ELSE 0 END), 6) AS percentile FROM al CROSS JOIN ob WHERE draw >= 0""")
def q_draw_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated addresses of the designated set against 200 sets matched by degree, all in one job."""
    d = graph_degrees(spark, sf_dir)
    sets = matched(d, DRAWS).union(d.filter("own").select(F.lit(-1).cast("bigint").alias("draw"), "addr"))
    n = isolated_by(spark, sf_dir, sets)
    seen = n.filter("draw = -1").select(F.col("n").alias("o"))
    return n.filter("draw >= 0").crossJoin(F.broadcast(seen)).agg(
        F.count(F.lit(1)).alias("draws"),
        r6(F.avg("n")).alias("mean"),
        r6(F.stddev_samp("n")).alias("sd"),
        r6(F.percentile("n", 0.025)).alias("low"),
        r6(F.percentile("n", 0.975)).alias("high"),
        F.first("o").alias("observed"),
        r6(F.avg((F.col("n") < F.col("o")).cast("double")) * 100).alias("percentile"),
    )


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + ", r AS (SELECT own, row_number() OVER (ORDER BY degree DESC, addr) - 1 AS rk, count(*) OVER () AS n FROM dg) SELECT count(*) AS n_own, round(avg(CASE WHEN rk < n // 100 THEN 1.0 ELSE 0 END), 8) AS in_top_1pct, count(*) FILTER (rk < 1000) AS in_top_1000, round(median(rk), 2) AS median_rank FROM r WHERE own")
def q_degree_rank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the designated addresses: how many stand before each, counted per degree."""
    d = graph_degrees(spark, sf_dir)
    own = d.filter("own").select("addr", "degree")
    hist = d.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    n = hist.agg(F.sum("c").alias("n"))
    above = own.join(hist.select(F.col("degree").alias("g"), "c"), F.col("g") > F.col("degree"), "left").groupBy("addr", "degree").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("above"))
    level = d.join(F.broadcast(own.select("degree").distinct()), "degree").select(F.col("degree").alias("g"), F.col("addr").alias("x"))
    ties = above.join(level, (F.col("g") == F.col("degree")) & (F.col("x") < F.col("addr")), "left").groupBy("addr", "above").agg(F.count("x").alias("t"))
    r = ties.select((F.col("above") + F.col("t")).alias("rk")).crossJoin(F.broadcast(n))
    return r.agg(F.count(F.lit(1)).alias("n_own"), F.round(F.avg((F.col("rk") < F.floor(F.col("n") / 100)).cast("double")), 8).alias("in_top_1pct"), F.count_if(F.col("rk") < 1000).alias("in_top_1000"), F.round(F.median("rk"), 2).alias("median_rank"))


_PAGERANK_SQL = """od AS MATERIALIZED (SELECT src, count(*) AS d FROM pair GROUP BY 1), un AS MATERIALIZED (SELECT x, count(*) OVER ()::DOUBLE AS n, od.src IS NULL AS loose FROM (SELECT src AS x FROM pair UNION SELECT dst FROM pair) LEFT JOIN od ON od.src = x),
  pr(k, x, n, loose, r, change) AS (SELECT 0, x, n, loose, 1.0::DOUBLE / n, 1.0::DOUBLE FROM un UNION ALL
    SELECT k + 1, x, n, loose, nr, sum(abs(nr - r)) OVER () FROM (SELECT k, o.x, n, loose, r, 0.85::DOUBLE * (coalesce(g, 0) + coalesce(sum(CASE WHEN loose THEN r END) OVER (), 0) / n) + 0.15::DOUBLE / n AS nr
      FROM (SELECT * FROM pr WHERE change >= 1e-10 AND k < 100) o LEFT JOIN (SELECT dst AS x, sum(r / d) AS g FROM pr JOIN pair ON pair.src = pr.x JOIN od ON od.src = pr.x GROUP BY 1) i ON i.x = o.x))"""


@query(f"WITH RECURSIVE {PAIR_SQL}, {_PAGERANK_SQL} SELECT x AS addr, round(r * 1e6, 4) AS rank_ppm FROM pr WHERE k = (SELECT max(k) FROM pr)")
def q_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until the ranks change by less than 1e-10 in sum, or a hundred rounds."""
    return pagerank(pairs(spark, sf_dir).select("src", "dst"), 100).select(F.col("node").alias("addr"), F.round(F.col("r") * 1e6, 4).alias("rank_ppm"))


@query(f"WITH RECURSIVE {PAIR_SQL}, {_PAGERANK_SQL}, l AS (SELECT x, r FROM pr WHERE k = (SELECT max(k) FROM pr)) SELECT x AS addr, round(r / ((SELECT max(r) FROM l) + 1e-9), 6) AS rank FROM l")
def q_pagerank_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pagerank(pairs(spark, sf_dir).select("src", "dst"), 100)
    return r.crossJoin(F.broadcast(r.agg(F.max("r").alias("top")))).select(F.col("node").alias("addr"), r6(F.col("r") / (F.col("top") + 1e-9)).alias("rank"))


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + "SELECT addr, round(in_deg / (SELECT max(in_deg) FROM dg), 8) AS centrality FROM dg")
def q_degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degree as a share of the largest."""
    d = graph_degrees(spark, sf_dir)
    return d.crossJoin(F.broadcast(d.agg(F.max("in_deg").alias("top")))).select("addr", F.round(F.col("in_deg") / F.col("top"), 8).alias("centrality"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.log1p(money("w")) * 0.1 / F.log1p(F.lit(1e8))))
    return pairs(spark, sf_dir).select("src", "dst", p.alias("weight"))


def _spread_sql(steps: int, damping: float = 1.0) -> str:
    parts = ["pw AS MATERIALIZED (SELECT src, dst, greatest(1e-6, least(1, ln(1 + CAST(w AS DOUBLE)) * 0.1 / ln(1 + 1e8))) AS p FROM pair), x0 AS (SELECT x, 1.0::DOUBLE AS v FROM (SELECT src AS x FROM pair UNION SELECT dst FROM pair))"]
    for k in range(1, steps + 1):
        parts.append(f"x{k} AS MATERIALIZED (SELECT dst AS x, {damping}::DOUBLE * sum(p * v) AS v FROM pw JOIN x{k - 1} ON x = src GROUP BY 1)")
    parts.append("xs AS (" + " UNION ALL ".join(f"SELECT x, {k} AS k, v FROM x{k}" for k in range(1, steps + 1)) + ")")
    return ", ".join(parts)


@query(f"WITH {PAIR_SQL}, {_spread_sql(15)}, c AS (SELECT x, sum(v) AS c FROM xs GROUP BY 1) SELECT x AS addr, round(c / (SELECT max(c) FROM c), 6) AS score FROM c")
def q_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(spark, sf_dir)


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, score): expected reach over up to 15 steps, as a share of the largest."""
    c = stage(spark, sf_dir, "reach", lambda: walk_terms(weighted(spark, sf_dir), 15).groupBy("node").agg(F.sum("x").alias("c")))
    return c.crossJoin(F.broadcast(c.agg(F.max("c").alias("top")))).select(F.col("node").alias("addr"), r6(F.col("c") / F.col("top")).alias("score"))


_RADIUS_SQL = """pe AS MATERIALIZED (SELECT src, dst, greatest(1e-6, least(1, ln(1 + CAST(w AS DOUBLE)) * 0.1 / ln(1 + 1e8))) AS p FROM pair),
  pm(k, x, v, norm) AS (SELECT 0, x, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT src AS x FROM pair UNION SELECT dst FROM pair) UNION ALL
    SELECT k + 1, x, v, sqrt(sum(v * v) OVER ()) FROM (SELECT k, dst AS x, sum(p * v / norm) AS v FROM pm JOIN pe ON pe.src = pm.x WHERE k < 201 GROUP BY 1, 2)),
  rho AS MATERIALIZED (SELECT coalesce((SELECT any_value(norm) FROM pm WHERE k = 201), 0) AS rho)"""
_KATZ_SQL = """kz(k, x, v) AS (SELECT 0, x, v FROM pm WHERE k = 0 UNION ALL SELECT k + 1, dst, sum(p * v) * any_value(CASE WHEN rho > 0 THEN 0.5 / rho ELSE 0.5 END) FROM kz JOIN pe ON pe.src = kz.x, rho WHERE k < 60 GROUP BY 1, 2), c AS (SELECT x, sum(v) AS c FROM kz WHERE k > 0 GROUP BY 1)"""


@query(f"WITH RECURSIVE {PAIR_SQL}, {_RADIUS_SQL}, {_KATZ_SQL} SELECT x AS addr, round(c / (SELECT max(c) FROM c), 6) AS score FROM c")
def q_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty steps damped by half of what would keep them from dying out."""
    rho = radius(spark, sf_dir).first()["radius"]
    # without a cycle the terms end by themselves, whatever the damping
    c = stage(spark, sf_dir, "katz", lambda: walk_sum(weighted(spark, sf_dir), 60, 0.5 / rho if rho else 0.5))
    return c.crossJoin(F.broadcast(c.agg(F.max("c").alias("top")))).select(F.col("node").alias("addr"), r6(F.col("c") / F.col("top")).alias("score"))


@query(f"WITH {PAIR_SQL}, {_spread_sql(15)}, s AS (SELECT k, sum(v) AS total, max(v) AS top FROM xs GROUP BY 1) SELECT k::BIGINT AS k, round(total, 4) AS total, round(top, 6) AS top, round(total / lag(total) OVER (ORDER BY k), 6) AS growth FROM s")
def q_term_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = walk_terms(weighted(spark, sf_dir), 15).groupBy("k").agg(F.sum("x").alias("total"), F.max("x").alias("top"))
    return s.select("k", F.round("total", 4).alias("total"), r6(F.col("top")).alias("top"), r6(F.col("total") / F.lag("total").over(Window.orderBy("k"))).alias("growth"))


@query(f"WITH RECURSIVE {PAIR_SQL}, {_RADIUS_SQL} SELECT round(rho, 6) AS radius, (SELECT round(max(s), 6) FROM (SELECT sum(p) AS s FROM pe GROUP BY src)) AS max_row_sum FROM rho")
def q_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the norm after 200 steps of the power method, and the largest row sum."""
    rows = weighted(spark, sf_dir).groupBy("src").agg(F.sum("weight").alias("s")).agg(r6(F.max("s")).alias("max_row_sum"))
    return radius(spark, sf_dir).crossJoin(rows).select(r6(F.col("radius")).alias("radius"), "max_row_sum")


def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "radius", lambda: spark.range(1).select(F.lit(spectral_radius(weighted(spark, sf_dir))).alias("radius")))


def _refex_sql() -> str:
    def level(frm: str, cols: list[str], name: str) -> str:
        agg = lambda end, other, tag: f"SELECT {end} AS addr, " + ", ".join(f"avg({c}) AS {tag}_mean_{c}, sign(sum({c})) * ln(1 + abs(sum({c}))) AS {tag}_sum_{c}" for c in cols) + f" FROM pair JOIN {frm} n ON n.addr = pair.{other} GROUP BY 1"
        made = [f"{t}_{k}_{c}" for t in ("o", "i") for k in ("mean", "sum") for c in cols]
        return f"{name} AS MATERIALIZED (SELECT dg.addr, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in made) + f" FROM dg LEFT JOIN ({agg('src', 'dst', 'o')}) o ON o.addr = dg.addr LEFT JOIN ({agg('dst', 'src', 'i')}) i ON i.addr = dg.addr)"

    return f"r0 AS (SELECT addr, in_deg::DOUBLE AS in_deg, out_deg::DOUBLE AS out_deg FROM dg), {level('r0', BASE, 'r1')}, {level('r1', LEVEL1, 'r2')}"


BASE = ["in_deg", "out_deg"]
LEVEL1 = [f"{t}_{k}_{c}" for t in ("o", "i") for k in ("mean", "sum") for c in BASE]
LEVEL2 = [f"{t}_{k}_{c}" for t in ("o", "i") for k in ("mean", "sum") for c in LEVEL1]
_STANDARD = lambda c: f"round(({c} - avg({c}) OVER ()) / greatest(stddev_pop({c}) OVER (), 1e-9), 5) AS {c}"


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + f", {_refex_sql()} SELECT r0.addr, " + ", ".join(_STANDARD(c) for c in [*BASE, *LEVEL1, *LEVEL2]) + " FROM r0 JOIN r1 USING (addr) JOIN r2 USING (addr)")
def q_refex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees with means and signed log sums of them over out- and in-neighbours, and those of these, standardised."""
    base = graph_degrees(spark, sf_dir).select("addr", *[F.col(c).cast("double").alias(c) for c in BASE])
    first = store(neighbour_aggregates(spark, sf_dir, base, BASE), "refex").df
    second = neighbour_aggregates(spark, sf_dir, first.select("addr", *LEVEL1), LEVEL1)
    whole = store(first.join(second.drop(*LEVEL1), "addr"), "refex").df
    columns = [*BASE, *LEVEL1, *LEVEL2]
    z = whole.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns])
    return whole.crossJoin(F.broadcast(z)).select("addr", *[F.round((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"d_{c}"), F.lit(1e-9)), 5).alias(c) for c in columns])


def neighbour_aggregates(spark: SparkSession, sf_dir: str, f: DataFrame, columns: list[str]) -> DataFrame:
    """``f`` (addr, columns) with ``o_``/``i_`` ``mean_``/``sum_`` columns over out- and in-neighbours, 0 where there are none."""
    p, out = pairs(spark, sf_dir).select("src", "dst"), f
    for end, other, tag in (("src", "dst", "o"), ("dst", "src", "i")):
        near = p.join(f.withColumnRenamed("addr", other), other).groupBy(F.col(end).alias("addr"))
        aggs = [[F.avg(c).alias(f"{tag}_mean_{c}"), (F.signum(F.sum(c)) * F.log1p(F.abs(F.sum(c)))).alias(f"{tag}_sum_{c}")] for c in columns]
        out = out.join(near.agg(*[a for pair in aggs for a in pair]), "addr", "left")
    return out.na.fill(0.0)


FAN = 5


@query(f"WITH {PAIR_SQL} SELECT dst, src, place FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY {hash8_sql("'fan'", 'dst', 'src')}, src) AS place FROM pair) WHERE place <= {FAN}")
def q_fanout_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five in-neighbours of each address, in hash order; ranked within a salt first, so that a
    hub's neighbours are cut down before they meet."""
    key = hash8(F.lit("fan"), "dst", "src")
    salted = pairs(spark, sf_dir).select("dst", "src", key.alias("h")).withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(32)))
    first = salted.withColumn("p", F.row_number().over(Window.partitionBy("dst", "salt").orderBy("h", "src"))).filter(F.col("p") <= FAN)
    place = F.row_number().over(Window.partitionBy("dst").orderBy("h", "src")).cast("bigint")
    return first.withColumn("place", place).filter(F.col("place") <= FAN).select("dst", "src", "place")


@query(with_(PAIR_SQL, ANCHOR_SQL, DEG_SQL) + ", k1 AS (SELECT src, dst, cnt FROM pair) SELECT addr, n, row_number() OVER (ORDER BY n DESC, addr) AS place FROM (SELECT addr, CAST(sum(cnt) AS BIGINT) AS n FROM (SELECT src AS addr, cnt FROM k1 UNION ALL SELECT dst, cnt FROM k1) WHERE addr NOT IN (SELECT addr FROM anchor) GROUP BY 1 ORDER BY n DESC, addr LIMIT 100)")
def q_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred undesignated addresses with most transfers."""
    p = pairs(spark, sf_dir)
    ends = p.select(F.col("src").alias("addr"), "cnt").union(p.select("dst", "cnt"))
    dim = anchors(spark, sf_dir).select("addr")
    top = ends.groupBy("addr").agg(F.sum("cnt").alias("n")).join(F.broadcast(dim), "addr", "left_anti").orderBy(F.desc("n"), "addr").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "addr")).cast("bigint"))
