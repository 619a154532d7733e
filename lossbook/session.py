"""Session set-up and the shared folder in which stage tables are written."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

STAGE_FOLDER = "lossbook-stages"
# Dates are UTC. Curves cost CPU per row, not bytes, so shuffled partitions may be small: the
# default of 1 MB per partition would leave most cores idle behind a narrow loan table. The JVM never compiles a method of more
# than 8,000 bytes, so a wide projection that Spark fuses into one such method is interpreted row by row; above the limit
# Spark runs the operators one by one, in methods that are compiled.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
_LOCAL_FOLDER: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "lossbook") -> SparkSession:
    """A session with the settings the engine relies on; the cluster's own settings stay."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    for name, value in SETTINGS.items():
        b = b.config(name, value)
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """The same settings on a session somebody else has built."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`, or the context's own.

    Only a local session may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app_id = sc.applicationId
    if app_id not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app_id] = tempfile.mkdtemp(prefix="lossbook-")
    return _LOCAL_FOLDER[app_id]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{STAGE_FOLDER}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet stage table and return a reader on it.

    Used where a frame feeds several jobs, and for small lookup tables: the reader knows the
    real file size, so Spark broadcasts the table when it is under
    `spark.sql.autoBroadcastJoinThreshold` and uses a shuffled join when it is not.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(staged: DataFrame, rows: int = 50_000, most: int = 250_000, fewer: bool = True) -> DataFrame:
    """A stage table in partitions of about `rows` rows; of up to `most` where that would give over 48 of them.

    Model fits run many short jobs over the same rows. A small table in many partitions makes them wait for tasks, and a reader
    packs narrow files into a few partitions, whose rows a fit keeps and reads whole; such a table is dealt out again.
    Without `fewer` a table in enough partitions stays as it is read.
    """
    n = staged.count()
    wanted = max(1, min(-(-n // rows), max(48, -(-n // most))))
    if staged.rdd.getNumPartitions() < wanted:
        return staged.repartition(wanted)
    return staged.coalesce(wanted) if fewer else staged


_HELD: list[list] = []              # [rows, users] of each frame that is kept
_HOLD = threading.Lock()


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """`rows` kept by the executors, in memory and on disk, while a fit makes its passes over them.

    Rows that `packed` deals out are shuffled once, not by every pass and from the few files they were read from. Fits that run side by
    side on the same rows share them: Spark keeps equal plans once, and the last fit lets them go.
    """
    with _HOLD:
        held = next((h for h in _HELD if h[0].sameSemantics(rows)), None)
        if held is None:
            _HELD.append(held := [rows.persist(), 0])
        held[1] += 1
    try:
        yield rows
    finally:
        with _HOLD:
            held[1] -= 1
            if not held[1]:
                _HELD[:] = [h for h in _HELD if h is not held]
                held[0].unpersist()


def side_by_side(work: Sequence[Callable[[], Any]], at_once: int = 8) -> list:
    """Results of independent pieces of work whose Spark jobs run side by side: small jobs leave cores idle one after the other."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


class Shared:
    """What fits side by side on one training table have in common: whoever needs it first makes it, the others wait.

    If making it fails, the error is its maker's alone, and the next who needs it tries again.
    """

    def __init__(self) -> None:
        self._lock, self._made = threading.Lock(), {}

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        while True:
            with self._lock:
                made, mine = self._made.get(key), key not in self._made
                if mine:
                    made = self._made[key] = Future()
            if not mine:
                if made.exception() is None:
                    return made.result()
                continue
            try:
                made.set_result(make())
                return made.result()
            except BaseException as error:
                with self._lock:
                    del self._made[key]
                made.set_exception(error)
                raise
