"""Clusters of points by Lloyd's steps and MLlib's k-means."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(columns: list[str], centres: list[list[float]]) -> Column:
    """Number of the nearest centre by Euclidean distance; of equally near ones the first."""
    far = lambda m: sum((F.pow(F.col(c) - F.lit(float(x)), F.lit(2.0)) for c, x in zip(columns[1:], m[1:], strict=True)), F.pow(F.col(columns[0]) - F.lit(float(m[0])), F.lit(2.0)))
    return F.array_min(F.array(*[F.struct(far(m).alias("d"), F.lit(k).cast("bigint").alias("k")) for k, m in enumerate(centres)]))["k"]


def lloyd(points: DataFrame, columns: list[str], weight: str, centres: list[list[float]], steps: int) -> list[list[float]]:
    """Centres after ``steps`` steps from ``centres``; a centre without a point stays. Sums only reach the driver."""
    for _ in range(steps):
        sums = points.groupBy(nearest(columns, centres).alias("k")).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns])
        moved = {r["k"]: [r[c] for c in columns] for r in sums.collect()}  # one row per centre
        centres = [moved.get(k, m) for k, m in enumerate(centres)]
    return centres


def unit(values: Column) -> Column:
    """An array of numbers scaled to length one."""
    x = F.transform(values, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / F.greatest(norm, F.lit(1e-9)))


def best_kmeans(points: DataFrame, k: int, seeds: list[int], rounds: int = 20):
    """The MLlib model of least cost over several first choices of centres; ``points`` has ``features``."""
    from pyspark.ml.clustering import KMeans

    models = [KMeans(k=k, seed=s, maxIter=rounds).fit(points) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost)
