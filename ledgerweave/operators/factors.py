"""Non-negative factors of a tall table by multiplicative updates.

The table X (rows x features) is approximated by W H with few factors. What is small (H, W'X and W'W)
is on the driver; W stays with the rows, and each round is one aggregate over them.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.storage import store


def factorise(df: DataFrame, key: str, features: list[str], k: int, rounds: int, every: int = 4) -> tuple[DataFrame, np.ndarray]:
    """((key, w0 .. wk-1), H). Features must be >= 0; null counts as 0. W starts from hashes of the key."""
    xs, ws = [f"x{i}" for i in range(len(features))], [f"w{j}" for j in range(k)]
    start = [((F.pmod(F.xxhash64(F.lit(j), F.col(key)), F.lit(1000)) + 1) / 1000.0).alias(w) for j, w in enumerate(ws)]
    now = store(df.select(F.col(key), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(x) for f, x in zip(features, xs, strict=True)], *start), "factors").df
    h = np.random.default_rng(5).random((k, len(features))) + 0.1
    for n in range(rounds):
        sums = now.agg(*[F.sum(F.col(w) * F.col(x)) for w in ws for x in xs], *[F.sum(F.col(a) * F.col(b)) for a in ws for b in ws]).first()
        got = np.array([float(v or 0) for v in sums])
        wx, ww = got[: k * len(xs)].reshape(k, -1), got[k * len(xs) :].reshape(k, k)
        h *= wx / np.maximum(ww @ h, 1e-12)
        hh = h @ h.T
        up = [sum((F.col(x) * float(h[j, i]) for i, x in enumerate(xs)), F.lit(0.0)) for j in range(k)]
        down = [sum((F.col(b) * float(hh[j, i]) for i, b in enumerate(ws)), F.lit(0.0)) for j in range(k)]
        now = now.select(key, *xs, *[(F.col(w) * up[j] / F.greatest(down[j], F.lit(1e-12))).alias(w) for j, w in enumerate(ws)])
        if (n + 1) % every == 0:
            now = store(now, "factors").df
    return now.select(key, *ws), h
