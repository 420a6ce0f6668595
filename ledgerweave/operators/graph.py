"""Graph operators as DataFrame iterations; each round is written to the shared folder.

Operators that take ``compact`` count their edges first; up to that many go through the whole-array kernels
of ``compact.py`` in one task, more through the rounds. Both give the same result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerweave.operators import compact as kernels
from ledgerweave.operators.lookups import broadcast_if_small, lookup
from ledgerweave.storage import Stored, is_within, store

HOT_SHARE = 1000


def _both_ways(e: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    return e.select(F.explode(ends).alias("e")).select("e.x", "e.y")


def weak_components(edges: DataFrame, a: str, b: str, compact: int = kernels.EDGES) -> DataFrame:
    """(node, root): every end of an edge and the least node of its component, by alternating stars.

    A large star hangs the larger neighbours of a node on the least of all, a small star the smaller
    ones; both keep the components, and when nothing changes every node hangs on its root. The least
    neighbour is a partial aggregate, and hubs are joined by broadcast (see ``lookup``). Loops and
    repeated edges don't matter; rows with a null end are left out.
    """
    rows = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).filter(F.col("p").isNotNull() & F.col("q").isNotNull())
    kind = dict(rows.dtypes)["p"]
    if is_within(rows, compact):
        return kernels.in_one_task(rows, kernels.components, f"node {kind}, root {kind}")
    nodes = rows.select(F.explode(F.array("p", "q")).alias("node")).distinct()
    now = store(rows.filter("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), "stars")
    mark: tuple | None = None
    while True:
        size = now.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark == (size["n"], size["h"]) or not size["n"]:
            break
        mark = (size["n"], size["h"])
        limit = max(1, size["n"] // HOT_SHARE)
        near = _both_ways(now.df)
        least = store(near.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("d")).select("x", F.least("x", "m").alias("m"), "d"), "least")
        big = lookup(near.filter("y > x"), "x", least.df, "x", "m", F.col("d") > limit, "lm").select(F.col("y").alias("u"), F.col("lm").alias("v"))
        large = store(big.filter("u <> v").distinct(), "stars")
        below = store(large.df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")), "least")
        small = lookup(large.df, "u", below.df, "u", "m", F.col("d") > limit, "lm").filter("v <> lm").select(F.col("v").alias("u"), F.col("lm").alias("v"))
        after = store(small.unionByName(below.df.select("u", F.col("m").alias("v"))).distinct(), "stars")
        for old in (now, least, large, below):
            old.drop()
        now = after
    return nodes.join(now.df.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))


def peel(edges: DataFrame, passes: int | None = None, compact: int = kernels.EDGES) -> DataFrame:
    """(src, dst) left when nodes of degree <= 1 are taken away, again and again or ``passes`` times.

    ``edges`` are distinct pairs; the two directions of a pair and a loop each count.
    """
    rows = edges.select("src", "dst").distinct()
    if passes is None and is_within(rows, compact):
        return kernels.in_one_task(rows, kernels.core, f"src {rows.dtypes[0][1]}, dst {rows.dtypes[1][1]}")
    now: Stored = store(rows, "core")
    before, k = -1, 0
    while (n := now.df.count()) != before and (passes is None or k < passes):
        degree = now.df.select(F.explode(F.array("src", "dst")).alias("x")).groupBy("x").count()
        weak = degree.filter(F.col("count") <= 1).select("x")
        kept = now.df.join(weak, F.col("src") == F.col("x"), "left_anti").join(weak, F.col("dst") == F.col("x"), "left_anti")
        after = store(kept, "core")
        now.drop()
        now, before, k = after, n, k + 1
    return now.df


def reached_by(edges: DataFrame, block: int = 50_000) -> DataFrame:
    """(node, n): how many other nodes have a path to each node that any has one to.

    ``edges`` has u, v. Every node with an edge is a source; the sources go in blocks of about ``block``, each
    followed level by level until no new node turns up. The levels are written, and deleted with their block.
    """
    e = store(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    sources = e.df.select("u").distinct().count()
    blocks = sources // block + 1
    counts = []
    for k in range(blocks):
        mine = e.df.filter(F.pmod(F.xxhash64("u"), F.lit(blocks)) == k)
        levels = [store(mine.select(F.col("u").alias("source"), F.col("v").alias("node")), "reached")]
        while not levels[-1].df.isEmpty():
            seen = levels[0].df
            for level in levels[1:]:
                seen = seen.unionByName(level.df)
            step = levels[-1].df.join(e.df, F.col("node") == F.col("u")).select("source", F.col("v").alias("node")).filter("source <> node").distinct()
            levels.append(store(step.join(seen, ["source", "node"], "left_anti"), "reached"))
        seen = levels[0].df
        for level in levels[1:]:
            seen = seen.unionByName(level.df)
        counts.append(store(seen.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "reached").df)
        for level in levels:
            level.drop()
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("node").agg(F.sum("n").alias("n"))


class Walker:
    """Edges (src, dst, weight) with numbered ends, ready for many steps.

    Edges out of hubs, nodes with more than a thousandth of all edges, lie apart: their nodes are a
    thousand at most, whose values are broadcast, so that no task gets a hub's edges. The others are
    shuffled by their node. What comes in at a node is summed before the shuffle.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.spark = edges.sparkSession
        self.ids = store(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()), "ids").df
        e = edges.join(self.ids.select(F.col("node").alias("src"), F.col("id").alias("u")), "src").join(self.ids.select(F.col("node").alias("dst"), F.col("id").alias("v")), "dst")
        self.edges = store(e.select("u", "v", "weight"), "edges").df
        limit = max(1, self.edges.count() // HOT_SHARE)
        self.hubs = store(self.edges.groupBy("u").count().filter(F.col("count") > limit).select(F.col("u").alias("id")), "hubs").df
        near = F.broadcast(self.hubs.withColumnRenamed("id", "u"))
        self.of_hubs = store(self.edges.join(near, "u", "left_semi"), "edges").df
        self.of_others = store(self.edges.join(near, "u", "left_anti"), "edges").df

    def step(self, x: DataFrame, scale: float = 1.0) -> DataFrame:
        """(id, x): scale * sum over the edges u -> id of weight * x(u)."""
        at = F.col("u") == F.col("id")
        hot = self.of_hubs.join(F.broadcast(x.join(F.broadcast(self.hubs), "id", "left_semi")), at)
        part = self.of_others.join(x, at).select("v", "weight", "x").unionByName(hot.select("v", "weight", "x"))
        return part.groupBy(F.col("v").alias("id")).agg((F.sum(F.col("weight") * F.col("x")) * scale).alias("x"))

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(self.ids, "id").select("node", *columns)


def _fits(edges: DataFrame, compact: int) -> DataFrame | None:
    """``edges`` as (src, dst, weight) if they are few enough for one task."""
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    return rows if is_within(rows, compact) else None


def walk_terms(edges: DataFrame, steps: int, damping: float = 1.0, compact: int = kernels.EDGES) -> DataFrame:
    """(node, k, x): x_k(j) = damping * sum over i -> j of weight(i, j) x_{k-1}(i), for k = 1 .. steps, from x_0 = 1.

    ``edges`` has src, dst, weight. A node that no walk of k steps ends in has no row for k. Each step is written.
    """
    if (rows := _fits(edges, compact)) is not None:
        got = kernels.in_one_task(rows, kernels.walks(steps, damping, True), f"id {rows.dtypes[0][1]}, k bigint, x double")
        return got.withColumnRenamed("id", "node")
    w = Walker(edges)
    x, out = w.ids.select("id", F.lit(1.0).alias("x")), None
    for k in range(1, steps + 1):
        x = store(w.step(x, damping), "term").df
        term = x.select("id", F.lit(k).cast("bigint").alias("k"), "x")
        out = term if out is None else out.unionByName(term)
    return w.named(out, "k", "x")


def spectral_radius(edges: DataFrame, rounds: int = 200, compact: int = kernels.EDGES) -> float:
    """Growth of the norm in one more step after ``rounds`` steps of the power method, from ones.

    Each step is written and its norm observed on the way; the next step scales by it.
    """
    if (rows := _fits(edges, compact)) is not None:
        got = kernels.in_one_task(rows, kernels.growth(rounds), "radius double").first()
        return got[0] if got else 0.0
    w = Walker(edges)
    x, norm, old = w.ids.select("id", F.lit(1.0).alias("x")), 1.0, None
    for _ in range(rounds + 1):
        seen = Observation()
        now = store(w.step(x, 1.0 / norm).observe(seen, F.sum(F.col("x") * F.col("x")).alias("s")), "power")
        norm = float(seen.get["s"] or 0.0) ** 0.5
        if old:
            old.drop()
        if not norm:
            break
        x, old = now.df, now
    now.drop()
    return norm


def walk_sum(edges: DataFrame, steps: int, damping: float, every: int = 5, compact: int = kernels.EDGES) -> DataFrame:
    """(node, c): the terms of ``walk_terms``, summed; the terms are added up and deleted every few steps."""
    if (rows := _fits(edges, compact)) is not None:
        got = kernels.in_one_task(rows, kernels.walks(steps, damping, False), f"id {rows.dtypes[0][1]}, x double")
        return got.select(F.col("id").alias("node"), F.col("x").alias("c"))
    w = Walker(edges)
    x, total, terms = w.ids.select("id", F.lit(1.0).alias("x")), None, []
    for k in range(1, steps + 1):
        terms.append(store(w.step(x, damping), "term"))
        x = terms[-1].df
        if k % every == 0 or k == steps:
            rows = total.df if total else None
            # the first term of a later block is the last one of the block before, which is counted already
            for term in terms[1:] if total else terms:
                rows = term.df if rows is None else rows.unionByName(term.df)
            after = store(rows.groupBy("id").agg(F.sum("x").alias("x")), "terms")
            for old in [*terms[:-1], *([total] if total else [])]:
                old.drop()
            total, terms = after, terms[-1:]
    return w.named(total.df.withColumnRenamed("x", "c"), "c")


def pagerank(pairs: DataFrame, rounds: int, alpha: float = 0.85, tol: float = 1e-10, compact: int = kernels.EDGES) -> DataFrame:
    """(node, r) from the uniform vector, dangling mass spread evenly, after at most ``rounds`` rounds.

    ``pairs`` has src and dst and may have weight; a node's rank goes to its successors by weight, else evenly.
    It ends when the ranks change by less than ``tol`` in sum. Each round is one job: it is written, and the
    change and the dangling mass are observed on the way.
    """
    given = pairs.withColumn("weight", F.col("weight").cast("double") if "weight" in pairs.columns else F.lit(1.0)).select("src", "dst", "weight")
    out = given.groupBy("src").agg(F.sum("weight").alias("of"))
    edges = given.join(out, "src").select("src", "dst", (F.col("weight") / F.col("of")).alias("weight"))
    if is_within(given, compact):
        return kernels.in_one_task(edges, kernels.ranks(rounds, alpha, tol), f"id {edges.dtypes[0][1]}, r double").withColumnRenamed("id", "node")
    w = Walker(edges)
    n = w.ids.count()
    if not n:
        return w.ids.select("node", F.lit(0.0).alias("r"))
    sends = w.edges.select(F.col("u").alias("id")).distinct().withColumn("loose", F.lit(False))
    first = w.ids.select("id").join(sends, "id", "left").select("id", F.coalesce("loose", F.lit(True)).alias("loose"), F.lit(1.0 / n).alias("r"))

    def keep(df: DataFrame) -> tuple[Stored, float, float]:
        seen = Observation()
        change = F.sum("change" if "change" in df.columns else "r")
        at = store(df.observe(seen, change.alias("change"), F.sum(F.when(F.col("loose"), F.col("r"))).alias("lost")), "rank")
        return at, float(seen.get["change"] or 0.0), float(seen.get["lost"] or 0.0)

    now, _, lost = keep(first)
    for _ in range(rounds):
        got = w.step(now.df.select("id", F.col("r").alias("x")))
        r = alpha * (F.coalesce("x", F.lit(0.0)) + lost / n) + (1 - alpha) / n
        after, change, lost = keep(now.df.select("id", "loose", "r").join(got, "id", "left").select("id", "loose", r.alias("r"), F.abs(r - F.col("r")).alias("change")))
        now.drop()
        now = after
        if change < tol:
            break
    return w.named(now.df, "r")


def betweenness(edges: DataFrame, pivots: DataFrame, depth: int | None = None, rows: int = 20_000_000, compact: int = kernels.PATH_EDGES) -> DataFrame:
    """(node, score): shortest-path dependencies on each node that is reached, summed over ``pivots``.

    ``edges`` (src, dst) count in both directions. Paths are followed from the pivots level by level until no new node
    turns up, or up to ``depth``, with their numbers, then the dependencies are handed back from the last level to the
    first. Every level is written, so that the way back reads what the way out found. The pivots, which are few, go in
    blocks of about ``rows`` pairs of pivot and node, whose levels are deleted with their block.
    """
    if edges.count() <= compact:
        return _betweenness_by_pivot(edges.select("src", "dst").filter("src <> dst"), pivots, depth)
    w = Walker(edges.filter("src <> dst").select("src", "dst", F.lit(1.0).alias("weight")))
    ids, e = w.ids, w.edges
    ends = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    ways = store(e.select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct(), "ways").df
    start = sorted(r["id"] for r in pivots.join(ids, "node").select("id").distinct().collect())
    block, sums = max(1, rows // max(1, ids.count())), []
    for k in range(0, max(1, len(start)), block):
        first = edges.sparkSession.createDataFrame([(i, i, 1.0) for i in start[k : k + block]], "pivot long, node long, paths double")
        written = [store(first, "level")]
        while depth is None or len(written) <= depth:
            step = written[-1].df.join(ways, F.col("node") == F.col("a")).groupBy("pivot", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
            # ways lead both ways, so a neighbour of the last level is new or lies in that level or the one before
            for level in written[-2:]:
                step = step.join(level.df.select("pivot", "node"), ["pivot", "node"], "left_anti")
            written.append(store(step, "level"))
            if written[-1].df.isEmpty():
                break
        levels = [level.df for level in written]
        below, terms = levels[-1].withColumn("share", F.lit(0.0)), []
        for upper in reversed(levels[:-1]):
            back = below.select("pivot", F.col("node").alias("b"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            got = back.join(ways, "b").select("pivot", F.col("a").alias("node"), "part").join(upper, ["pivot", "node"])
            share = got.groupBy("pivot", "node").agg(F.sum(F.col("part") * F.col("paths")).alias("share"))
            written.append(store(upper.join(share, ["pivot", "node"], "left").select("pivot", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "back"))
            below = written[-1].df
            terms.append(below.filter("node <> pivot").select("node", "share"))
        rest = terms[0] if terms else levels[0].select("node", F.lit(0.0).alias("share")).limit(0)
        for term in terms[1:]:
            rest = rest.unionByName(term)
        sums.append(store(rest.groupBy("node").agg(F.sum("share").alias("share")), "shares").df)
        for old in written:
            old.drop()
    out = sums[0]
    for more in sums[1:]:
        out = out.unionByName(more)
    return out.groupBy(F.col("node").alias("id")).agg(F.sum("share").alias("score")).join(ids, "id").select("node", "score")


def _short(c: str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), F.col(c))


def _betweenness_by_pivot(edges: DataFrame, pivots: DataFrame, depth: int | None) -> DataFrame:
    """The graph, whose size was checked, goes to all tasks with short ids; each follows the paths from its pivots.

    The ids are hashes, so that no edge is joined to number its ends. Should two nodes share one, others are taken.
    """
    spark, turn = edges.sparkSession, 0
    while True:
        end = edges.select(F.explode(F.array("src", "dst")).alias("node"))
        names = store(end.groupBy(_short("node", turn).alias("id")).agg(F.min("node").alias("node"), F.max("node").alias("last")), "names")
        if names.df.filter("node <> last").isEmpty():
            break
        names.drop()
        turn += 1
    few = store(pivots.select("node").distinct(), "pivots")
    start = [r["id"] for r in names.df.join(broadcast_if_small(few.df), "node").select("id").collect()]
    few.drop()
    table = edges.select(_short("src", turn).alias("a"), _short("dst", turn).alias("b")).toArrow()
    a, b = (c.to_numpy() for c in table.columns)
    del table
    g = kernels.Paths(a, b)
    at = np.flatnonzero(np.isin(g.ids, np.array(start, np.int64)))
    paths = spark.sparkContext.broadcast(g)
    del a, b, g
    tasks = max(1, min(len(at), spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = paths.value
        total, met = np.zeros(len(g.ids)), np.zeros(len(g.ids), bool)
        for b in batches:
            for task in b.column(0).to_pylist():
                for pivot in at[task::tasks]:
                    g.dependencies(pivot, total, met, depth)
        found = np.flatnonzero(met)
        for i in range(0, len(found), 100_000):
            own = found[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"id": g.ids[own], "score": total[own]})

    shares = spark.range(0, tasks, 1, tasks).mapInArrow(run, "id bigint, score double")
    # written, for Spark takes what comes from so few rows for small and would broadcast it
    scores = store(shares.groupBy("id").agg(F.sum("score").alias("score")), "shares").df
    paths.destroy()
    return scores.join(names.df, "id").select("node", "score")
