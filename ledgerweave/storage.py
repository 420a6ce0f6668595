"""Written tables that cut lineage.

Every iterative or two-pass operator stores its intermediate relation as Parquet in the folder that
all executors share, named by ``spark.checkpoint.dir``. A lost executor then costs the running tasks
only: everything behind the last written table is read back, never recomputed.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_on_context.isDefined():
        return str(set_on_context.get()).rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="ledgerweave-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ledgerweave/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


class Stored:
    """A written relation: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def store(df: DataFrame, tag: str) -> Stored:
    """Write ``df`` once into the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return Stored(spark, path, df.schema)


def is_file(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def files_state(spark: SparkSession, folder: str) -> int:
    """A number that changes with the names, sizes and times of the files in ``folder``; 0 if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return 0
    found, files = fs.listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(files)))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many plus one."""
    return len(df.select().limit(rows + 1).collect()) <= rows if rows <= 1000 else df.limit(rows + 1).count() <= rows
