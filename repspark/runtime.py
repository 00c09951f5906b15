"""Session helpers: the shared folder, written intermediate tables, table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_ours: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (as in tests), a temporary folder is made and set;
    on a cluster without the setting this raises, since no local folder would reach the executors.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if sc.applicationId in _ours:
        return _ours[sc.applicationId]
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = _ours[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="repspark-")
    sc.setCheckpointDir(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/repspark/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            pass

    atexit.register(drop)
    return path


#: Paths of the written tables that haven't been released, oldest first; while a ``frugal`` part runs, else none are kept here.
_held: list[str] = []
#: Names of the bucketed tables by their paths.
_tables: dict[str, str] = {}
_frugal: list[int] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage is cut and the loss of an executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if not _frugal:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bucketed(df: DataFrame, name: str, by: str, order: list[str]) -> DataFrame:
    """``df`` as a table written within ``frugal``, bucketed by the hash of ``by`` as a shuffle is partitioned, so that joins and groups by it don't move its rows.

    Each task writes a file for each bucket that it has rows of, sorted by ``order``: few, where rows with the same ``by`` lie together already.
    """
    spark = df.sparkSession
    path, buckets = scratch(spark, name), spark.conf.get("spark.sql.shuffle.partitions")
    of = f"repspark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {of} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.insertInto(of)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {of}")
        except Exception:  # the session may be gone
            pass

    atexit.register(drop)
    _held.append(path)
    _tables[path] = of
    out = spark.table(of)
    out._written = path
    return out


@contextmanager
def frugal(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Within it, shuffle files go as soon as a table is written; calling what it gives removes all tables written within it but those named.

    Only for parts in which each table that is kept stands for all that was read to make it.
    """
    since = len(_held)
    _frugal.append(since)

    def release(*keep: DataFrame) -> None:
        kept = {d._written for d in keep}
        for path in [p for p in _held[since:] if p not in kept]:
            if path in _tables:
                spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
            remove(spark, path)
            _held.remove(path)

    try:
        yield release
    finally:
        _frugal.pop()
        for path in _held[since:]:
            _tables.pop(path, None)
        del _held[since:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="repspark-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], list[tuple]], schema: str, tasks: int | None = None) -> DataFrame:
    """``fn`` over each group of ``keys``: a list of values per column in, rows of ``schema`` out.

    Groups lie sorted in the partitions of one shuffle and are read one after another, so many small groups
    share a batch and only one group is held at a time. The shuffle has ``tasks`` partitions, by default the session's
    number, however small they are: the work of a group isn't told by its bytes.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out_schema = _parse(df.sparkSession, schema)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        key = None
        rows: list[tuple] = []

        def pack() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            ks = list(zip(*[cols[k] for k in keys]))
            a = 0
            for i in range(1, len(ks) + 1):
                if i < len(ks) and ks[i] == ks[a]:
                    continue
                part = {n: c[a:i] for n, c in cols.items()}
                if held is not None and ks[a] == key:
                    for n, c in part.items():
                        held[n] += c
                else:
                    if held is not None:
                        rows += fn(held)
                    held, key = part, ks[a]
                a = i
            if len(rows) >= 10_000:
                yield pack()
                rows = []
        if held is not None:
            rows += fn(held)
        if rows:
            yield pack()

    return map_arrow(df.repartition(tasks, *keys).sortWithinPartitions(*keys), run, schema)


def _parse(spark: SparkSession, schema: str) -> StructType:
    return spark.createDataFrame([], schema).schema
