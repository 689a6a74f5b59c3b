"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_ORDERED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Scope:
    """Paths that one call wrote: nobody else releases them."""

    def __init__(self, within: Scope | None = None):
        self.within, self.paths, self._lock = within, [], threading.Lock()

    def add(self, *paths: str) -> None:
        with self._lock:
            self.paths += paths

    def take(self, keep: set[str] = frozenset()) -> list[str]:
        """Its paths but those in ``keep``, which it no longer has."""
        with self._lock:
            taken = [p for p in self.paths if p not in keep]
            self.paths = [p for p in self.paths if p in keep]
        return taken


class _Written:
    """The folder of one application, its bucketed tables, and how to remove them after it stopped."""

    def __init__(self, spark: SparkSession):
        self.root = f"{shared_dir(spark)}/normgraph/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.lasting = Scope()
        self.scopes: list[Scope] = [self.lasting]
        self.tables: dict[str, str] = {}
        where = self.jvm.org.apache.hadoop.fs.Path(self.root)
        files = where.getFileSystem(self.conf)
        files.mkdirs(where)
        files.deleteOnExit(where)  # whatever ends the driver: the JVM removes the folder when it closes

    def delete(self, path: str) -> None:
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.conf).delete(where, True)

    def remove(self, spark: SparkSession, paths: list[str]) -> None:
        for path in paths:
            if path in self.tables:
                spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
            self.delete(path)

    def drop_tables(self) -> None:
        """A catalog may outlive the application: it keeps no table of this one."""
        for path, table in list(self.tables.items()):
            with contextlib.suppress(Exception):  # the session has stopped
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                del self.tables[path]


_written: dict[str, _Written] = {}
_lock = threading.RLock()
#: The scope of the call that runs in this thread; each thread begins without one.
_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it.  Only a local session (as in tests) may
    leave that unset: a folder of our own is made and set.  Elsewhere executors
    would write to disks of their own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            found = have.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = tempfile.mkdtemp(prefix="normgraph-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _of(spark: SparkSession) -> _Written:
    application = spark.sparkContext.applicationId
    with _lock:
        if application not in _written:
            if not _written:
                atexit.register(release_all)
            _written[application] = _Written(spark)
        return _written[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it belongs to the running scope, or else lasts until the driver ends."""
    own = _of(spark)
    path = f"{own.root}/{name}-{uuid.uuid4().hex}"
    (_scope.get() or own.lasting).add(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession, keep: bool = True, lasting: bool = False) -> Iterator[Scope]:
    """What is written in this thread while this lasts belongs together.

    An error removes all of it, and so does a good end unless ``keep``: then the
    enclosing scope gets it, or the application where there is none or
    ``lasting`` asks for it.  Other threads' tables are never touched.
    """
    own, within = _of(spark), _scope.get()
    here = Scope(within)
    with _lock:
        own.scopes.append(here)
    token = _scope.set(here)
    try:
        yield here
    except BaseException:
        keep = False
        raise
    finally:
        _scope.reset(token)
        paths = here.take()
        if keep:
            (own.lasting if lasting or within is None else within).add(*paths)
        with _lock:
            own.scopes.remove(here)
        if not keep:
            own.remove(spark, paths)


def scoped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)`` which leaves nothing behind when it fails."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        with scope(spark):
            return query(spark, *args, **kwargs)

    return run


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    A lost executor then costs a re-read, not a recomputation.  ``codec`` is for
    rows that repeat each other; None takes the session's.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame], codec: str | None = None) -> DataFrame:
    """``make()`` materialized; every table written on the way to it is removed at once, also when it fails."""
    path = new_path(spark, name)
    with scope(spark, keep=False):
        df = make()
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


_ordered: dict[str, tuple[int, str]] = {}


@contextlib.contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """While this lasts, bucketed tables of one file a bucket are read as sorted as they are.

    The last thread of a session that leaves gives its setting back.
    """
    key = str(spark._jsparkSession.sessionUUID())
    with _lock:
        users, had = _ordered.get(key) or (0, spark.conf.get(_ORDERED_BUCKETS))
        _ordered[key] = users + 1, had
        spark.conf.set(_ORDERED_BUCKETS, "true")
    try:
        yield
    finally:
        with _lock:
            users, had = _ordered.pop(key)
            if users > 1:
                _ordered[key] = users - 1, had
            else:
                spark.conf.set(_ORDERED_BUCKETS, had)


def materialize_bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int) -> tuple[DataFrame, str]:
    """``df`` written as a table of ``buckets`` files, dealt and sorted by ``keys``, and its path.

    Tables of the same keys and number of buckets are joined by these keys
    without an exchange, and inside ``ordered_buckets`` without a sort.  Don't
    unite such tables: a columnar union claims their buckets but does not keep
    them, so that sums over it come out in parts.  Read their paths together.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"normgraph_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    with ordered_buckets(spark):
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _of(spark).tables[path] = table
    return spark.table(table), path


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Remove what this thread's scope wrote but what is in ``keep``; outside of any scope, what lasts."""
    own = _written.get(spark.sparkContext.applicationId)
    if own:
        own.remove(spark, (_scope.get() or own.lasting).take(keep))


def written(spark: SparkSession) -> set[str]:
    """Paths of the intermediate tables that are still there."""
    own = _written.get(spark.sparkContext.applicationId)
    with _lock:
        return {p for s in own.scopes for p in s.paths} if own else set()


def release_all() -> None:
    """At the driver's end: the sessions may have stopped, their JVM hasn't."""
    for own in _written.values():
        own.drop_tables()
        with contextlib.suppress(Exception):  # a driver that was killed leaves this to the JVM
            own.delete(own.root)
