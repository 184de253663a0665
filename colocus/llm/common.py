"""Tables, scratch storage and connected components shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting under which Spark removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of two numbers (some 45 MB as a hash table) up to which a table is broadcast.
BROADCAST_ROWS = 700_000

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


_lock, _held = threading.Lock(), {"writers": 0, "before": "false"}


@contextmanager
def _cleaned(spark: SparkSession):
    """CLEANUP is on while any thread is within; the last one to leave restores it."""
    with _lock:
        if not _held["writers"]:
            _held["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _held["writers"] += 1
    try:
        yield
    finally:
        with _lock:
            _held["writers"] -= 1
            if not _held["writers"]:
                spark.conf.set(CLEANUP, _held["before"])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the scratch folder and read it back.

    Cuts the lineage, so that later passes and lost executors do not compute it again. The shuffle
    files of the write, which nothing reads again, go when it ends instead of at some collection on
    the driver.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.select("*").write.parquet(path)  # the setting counts for frames made under it
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of two numbers a row, to be broadcast in a join if it has few rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Letters A-Z in lower case, and a space for all of ASCII but letters and digits.
_WORDS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def ascii_words(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased."""
    return raw.translate(_WORDS).split()


def text_batches(batch, rows: int = 256):
    """Slices of an Arrow batch, so that the Python objects made of it stay few."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def given_back(run):
    """run, a function for mapInArrow, whose task at its end gives the memory it freed back to the system.

    Spark reuses its Python workers: what they hold on to counts against the executor in later stages.
    """

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest reachable node.

    Alternates the two star contractions: every node's larger neighbours move to its smallest
    neighbour, then its smaller ones do. Each round is a few joins of the edge table, never a
    collected group. Self links keep their node; null ends are dropped; an empty table gives none.
    """
    ends = edges.select("a", "b").dropna()
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    now = staged(
        ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "cc",
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        dropped(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class Union:
    """Union-find over 0..n-1, for the links found within one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
