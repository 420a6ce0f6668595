"""One group identifier for everything tied together, directly or over others.

Each round propagates minimum labels across the edges, accelerates them by pointer jumping and then
contracts: an edge between two labels replaces the edges between their members. The rounds end when no
edge is left between two labels, so no label can change any more. Every round's labels and edges are
written to the shared folder, and only the vertices that still had an edge take part in the next one.

Vertices are numbered by a 64-bit hash that is checked to be free of collisions (another seed is taken
otherwise), so the rounds move longs and the spelling is joined back once at the end.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.lookups import lookup
from ledgerweave.storage import Stored, store

#: A key is hot if it bears more than this share of the rows; at most twice as many keys can be.
HOT_SHARE = 1000


def _numbered(pairs: DataFrame) -> tuple[Stored, Stored, int]:
    """(id, name) of all vertices and (u, v) of all edges between different ones, each once."""
    for seed in range(8):
        number = (lambda c, s=seed: F.xxhash64(F.col(c)) if s == 0 else F.xxhash64(F.lit(s), F.col(c)))
        rows = pairs.select("a", "b", number("a").alias("ia"), number("b").alias("ib"))
        ends = F.explode(F.array(F.struct(F.col("ia").alias("id"), F.col("a").alias("name")), F.struct(F.col("ib").alias("id"), F.col("b").alias("name"))))
        nodes = store(rows.select(ends.alias("e")).select("e.id", "e.name").distinct(), "nodes")
        if nodes.df.groupBy("id").count().filter("count > 1").limit(1).count() == 0:
            edges = rows.filter("ia <> ib").select(F.least("ia", "ib").alias("u"), F.greatest("ia", "ib").alias("v")).distinct()
            return nodes, store(edges, "edges"), seed
        nodes.drop()
    raise RuntimeError("no seed numbers the vertices without a collision")


def _round(edges: DataFrame, n_edges: int, jumps: int) -> Stored:
    """(x, p, degree): every vertex with an edge and a smaller or equal vertex of its component."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e"))
    near = both.groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("m"), F.count(F.lit(1)).alias("degree"))
    labels = store(near.select("x", F.least("x", "m").alias("p"), "degree"), "labels")
    hot = F.col("degree") > max(1, n_edges // HOT_SHARE)  # p's followers are at most its neighbours
    for _ in range(jumps):
        table = labels.df
        jumped = store(lookup(labels.df, "p", table, "x", "p", hot, "q").select("x", F.col("q").alias("p"), "degree"), "labels")
        labels.drop()
        labels = jumped
        hot = F.col("degree") > max(1, n_edges // HOT_SHARE)
    return labels


def components(pairs: DataFrame, a: str, b: str, jumps: int = 2) -> DataFrame:
    """(name, grp): every value of ``a`` or ``b`` in a row that has both, and the least name of its group.

    A value tied only to itself is a group of one. Rows with a null on either side tie nothing and
    name nothing. Repeated pairs and both directions of a pair count once; extra columns are ignored.
    """
    named = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes, edges, _ = _numbered(named)
    rounds: list[Stored] = []
    while n := edges.df.count():
        labels = _round(edges.df, n, jumps)
        table, limit = labels.df, max(1, n // HOT_SHARE)
        hot = F.col("degree") > limit
        left = lookup(edges.df, "u", table, "x", "p", hot, "pu")
        both = lookup(left, "v", table, "x", "p", hot, "pv").filter("pu <> pv")
        fewer = store(both.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        edges.drop()
        edges = fewer
        rounds.append(labels)
    edges.drop()

    # the last round's labels are final; earlier ones are read through them, from the back
    final: Stored | None = None
    for labels in reversed(rounds):
        own = labels.df.select("x", "p")
        if final is None:
            through = own.withColumnRenamed("p", "root")
        else:
            through = _through(own, "p", final.df, "root").select("x", F.coalesce("root", "p").alias("root"))
        done = store(through, "roots")
        labels.drop()
        if final is not None:
            final.drop()
        final = done
    if final is None:
        return nodes.df.select("name", F.col("name").alias("grp"))
    rooted = store(nodes.df.join(final.df, F.col("id") == F.col("x"), "left").select("name", F.coalesce("root", "id").alias("root")), "rooted")
    nodes.drop()
    final.drop()
    least = rooted.df.groupBy("root").agg(F.min("name").alias("grp")).withColumnRenamed("root", "x")
    return _through(rooted.df, "root", least, "grp").select("name", "grp")


def _through(df: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """``df`` with ``value`` of ``table`` (x, value), its most frequent keys found first and broadcast."""
    rows = df.count()
    hot = df.groupBy(F.col(key).alias("_lw_key")).count().filter(F.col("count") > max(1, rows // HOT_SHARE)).select("_lw_key")
    marked = table.join(F.broadcast(hot), F.col("x") == F.col("_lw_key"), "left").withColumn("_lw_hot", F.col("_lw_key").isNotNull())
    kept = store(marked.select("x", value, "_lw_hot"), "marked").df
    return lookup(df, key, kept, "x", value, F.col("_lw_hot"), value)
