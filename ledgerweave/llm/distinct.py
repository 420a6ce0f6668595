"""Distinct counts from registers of minimum exponential hash values.

Each identifier draws, by its hash alone, the points of a Poisson process of rate ``m`` and drops them
into ``m`` registers at random; a register keeps its least point. That least point is exponential with
the number of distinct identifiers as rate, so the sum of the registers is gamma distributed: ``(m - 1)
/ sum`` is an unbiased count with relative standard error ``1 / sqrt(m - 2)``, and gamma quantiles give
its interval. Points come in ascending order, so an identifier stops at the first that exceeds the
largest register. Two sketches merge by elementwise minimum, over days, loads, sides or anything else.

Registers depend on the set of hashes only. A sketch of at most ``m / 2`` identifiers therefore keeps the
hashes themselves, which is smaller and exact, and turns into registers when it grows beyond.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS = 1024
SALTS = 64
FLUSH_BYTES = 32 << 20
BUFFER_ROWS = 400_000
NO_DAY, NO_LOAD = -(1 << 20), -(1 << 20)

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def add(registers: np.ndarray, hashes: np.ndarray) -> None:
    """Drop the points of ``hashes`` (uint64) into ``registers``."""
    m = len(registers)
    at = np.zeros(len(hashes))
    h, step = hashes, 0
    while len(h):
        with np.errstate(over="ignore"):
            a = _mix(h + _GOLDEN * np.uint64(2 * step + 1))
            b = _mix(h + _GOLDEN * np.uint64(2 * step + 2))
        at = at - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        below = at < registers.max()
        h, at = h[below], at[below]
        np.minimum.at(registers, (b[below] % np.uint64(m)).astype(np.int64), at)
        step += 1


class Sketch:
    """Either ``hashes``, sorted and distinct, or ``registers``."""

    __slots__ = ("hashes", "m", "registers")

    def __init__(self, m: int) -> None:
        self.m, self.hashes, self.registers = m, np.empty(0, np.uint64), None

    def add_hashes(self, hashes: np.ndarray) -> None:
        if self.registers is not None:
            add(self.registers, hashes)
            return
        self.hashes = np.unique(np.concatenate([self.hashes, hashes])) if len(self.hashes) else np.unique(hashes)
        if len(self.hashes) > self.m // 2:
            self.registers = np.full(self.m, np.inf)
            add(self.registers, self.hashes)
            self.hashes = np.empty(0, np.uint64)

    def merge(self, other: "Sketch") -> None:
        if other.registers is None:
            self.add_hashes(other.hashes)
            return
        if self.registers is None:
            registers = other.registers.copy()
            add(registers, self.hashes)
            self.registers, self.hashes = registers, np.empty(0, np.uint64)
        else:
            np.minimum(self.registers, other.registers, out=self.registers)

    def bytes(self) -> bytes:
        return struct.pack("<?", self.registers is not None) + (self.hashes if self.registers is None else self.registers).tobytes()

    @classmethod
    def of(cls, data: bytes, m: int) -> "Sketch":
        s = cls(m)
        if data[0]:
            s.registers = np.frombuffer(data, np.float64, offset=1).copy()
        else:
            s.hashes = np.frombuffer(data, np.uint64, offset=1)
        return s

    def count(self, z: float = 1.959964) -> tuple[float, float, float]:
        """The count and its interval; all three equal where the hashes are still there."""
        if self.registers is None:
            return (float(len(self.hashes)),) * 3
        total, m = float(self.registers.sum()), self.m
        quantile = lambda q: m * (1 - 1 / (9 * m) + q / (3 * m**0.5)) ** 3  # noqa: E731  (gamma quantile after Wilson and Hilferty)
        return (m - 1) / total, quantile(-z) / total, quantile(z) / total


KEYS = ["lvl", "day", "load", "side"]
SKETCHES = "lvl int, day int, load int, side int, sketch binary"
_SCHEMA = pa.schema([("lvl", pa.int32()), ("day", pa.int32()), ("load", pa.int32()), ("side", pa.int32()), ("sketch", pa.binary())])
LEVELS = {0: "day_load", 1: "day", 2: "load", 3: "all"}
SIDES = {0: "from_hex", 1: "to_hex", 2: "either"}


def _emit(found: dict[tuple, Sketch]) -> pa.RecordBatch:
    keys = list(found)
    columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(4)]
    return pa.record_batch([*columns, pa.array([found[k].bytes() for k in keys], pa.binary())], schema=_SCHEMA)


class _Table:
    """Sketches by key, to be given out when they take too much room: they merge again later."""

    def __init__(self, m: int) -> None:
        self.m, self.found, self.held = m, {}, 0

    def get(self, key: tuple) -> Sketch:
        s = self.found.get(key)
        if s is None:
            s = self.found[key] = Sketch(self.m)
        return s

    def full(self) -> bool:
        self.held += 1
        if self.held < 512:
            return False
        self.held = 0
        return sum(200 + (8 * self.m if s.registers is not None else s.hashes.nbytes) for s in self.found.values()) > FLUSH_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys = list(self.found)
        for i in range(0, len(keys), 1000):
            yield _emit({k: self.found[k] for k in keys[i : i + 1000]})
        self.found = {}


def _partial(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, rows = _Table(m), [], 0

        def take() -> Iterator[pa.RecordBatch]:
            key, day, load, side, h = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                i = order[a]
                table.get((0, int(day[i]), int(load[i]), int(side[i]))).add_hashes(h[order[a:b]])
                if table.full():
                    yield from table.flush()

        for batch in batches:
            day, load, side, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            key = ((day.astype(np.int64) + (1 << 20)) << 34) + ((load.astype(np.int64) + (1 << 31)) << 1) + side
            waiting.append((key, day, load, side, h.view(np.uint64)))
            rows += len(h)
            if rows >= BUFFER_ROWS:
                yield from take()
                waiting, rows = [], 0
        if waiting:
            yield from take()
        yield from table.flush()

    return run


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)


def _merge(m: int):
    """Merge what comes sorted by key; one sketch at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch, ready = None, None, {}
        for batch in batches:
            for lvl, day, load, side, data in _rows(batch):
                key = (lvl, day, load, side)
                if key != now:
                    if now is not None:
                        ready[now] = sketch
                    if len(ready) >= 500:
                        yield _emit(ready)
                        ready = {}
                    now, sketch = key, Sketch.of(data, m)
                else:
                    sketch.merge(Sketch.of(data, m))
        if now is not None:
            ready[now] = sketch
        if ready:
            yield _emit(ready)

    return run


def _roll_up(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(m)
        for batch in batches:
            for _, day, load, side, data in _rows(batch):
                part = Sketch.of(data, m)
                for s in (side, 2):
                    for key in ((0, day, load, s), (1, day, NO_LOAD, s), (2, NO_DAY, load, s), (3, NO_DAY, NO_LOAD, s)):
                        table.get(key).merge(part)
                if table.full():
                    yield from table.flush()
        yield from table.flush()

    return run


def merged(sketches: DataFrame, m: int) -> DataFrame:
    """One sketch per key, merged in two steps: a key's partial sketches first meet by ``SALTS`` groups."""
    salted = sketches.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.repartition(*KEYS, "salt").sortWithinPartitions(*KEYS).drop("salt").mapInArrow(_merge(m), SKETCHES)
    return first.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_merge(m), SKETCHES)


def sketches(rows: DataFrame, day: str, load: str, sides: dict[str, str], m: int = REGISTERS) -> DataFrame:
    """Mergeable sketches (lvl, day, load, side, sketch) of the finest groups, by day, load and side.

    ``sides`` are two identifier columns. A null identifier is not counted; a null day or load is a group
    of its own. ``day`` is a date, ``load`` an integer.
    """
    names = list(sides.values())
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("v")) for i, c in enumerate(names)]))
    picked = rows.select(
        F.coalesce(F.unix_date(day), F.lit(NO_DAY)).alias("day"), F.coalesce(F.col(load).cast("int"), F.lit(NO_LOAD)).alias("load"), each.alias("s")
    ).filter(F.col("s.v").isNotNull())
    hashed = picked.select("day", "load", F.col("s.side").alias("side"), F.xxhash64("s.v").alias("h"))
    return merged(hashed.mapInArrow(_partial(m), SKETCHES), m)


def rolled_up(fine: DataFrame, m: int = REGISTERS) -> DataFrame:
    """The sketches of all levels (day and load, day, load, all) and sides (each and either)."""
    return merged(fine.mapInArrow(_roll_up(m), SKETCHES), m)


def counts(of: DataFrame, m: int = REGISTERS) -> DataFrame:
    """(level, day_utc, batch_id, side, n_distinct, low, high, rel_error): counts with 95 % intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(*key, *Sketch.of(data, m).count(), not data[0]) for *key, data in _rows(batch)]
            if got:
                lvl, day, load, side, n, low, high, exact = zip(*got, strict=True)
                yield pa.record_batch(
                    [pa.array(lvl, pa.int32()), pa.array(day, pa.int32()), pa.array(load, pa.int32()), pa.array(side, pa.int32()), *[pa.array(x, pa.float64()) for x in (n, low, high)], pa.array(exact, pa.bool_())],
                    names=["lvl", "day", "load", "side", "n", "low", "high", "exact"],
                )

    got = of.mapInArrow(run, "lvl int, day int, load int, side int, n double, low double, high double, exact boolean")
    name = lambda table, c: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))
    return got.select(
        name(LEVELS, "lvl").alias("level"),
        F.when(F.col("day") != NO_DAY, F.date_from_unix_date("day")).cast("string").alias("day_utc"),
        F.when(F.col("load") != NO_LOAD, F.col("load")).alias("batch_id"),
        name(SIDES, "side").alias("side"),
        F.round("n").cast("bigint").alias("n_distinct"),
        F.round("low", 1).alias("low"),
        F.round("high", 1).alias("high"),
        F.when(F.col("exact"), 0.0).otherwise(float((m - 2) ** -0.5)).alias("rel_error"),
    )
