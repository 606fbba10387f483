"""Session settings and the shared folder that jobs use to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "marram", **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) a temporary
    folder is set for it; on a cluster the setting is required.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        at = context._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marram-")
        context.setCheckpointDir(found)
        found = context._jsc.sc().getCheckpointDir().get()
    return found


#: Where ``materialize`` notes its paths, for whoever has asked for them in this context.
NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``materialize`` writes inside the block, in order; blocks of other threads have lists of their own.

    What is on the list at the end of a block within another goes on to the outer list.
    """
    outer = NOTED.get()
    token = NOTED.set([])
    try:
        yield NOTED.get()
    finally:
        if outer is not None:
            outer.extend(NOTED.get())
        NOTED.reset(token)


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings that hold inside the block, and what was set before afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by the last columns ``by``, and read it back.

    The written table cuts the lineage like a checkpoint: a lost executor costs
    a re-read, not a recomputation, and later passes read only their columns.
    The files stay until ``forget`` or until the shared folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/marram-{uuid.uuid4().hex}/{label}"
    df.write.partitionBy(*by or []).parquet(path)
    if NOTED.get() is not None:
        NOTED.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str], labels: tuple[str, ...] | None = None) -> None:
    """Delete what ``materialize`` wrote to these paths, with one of the labels only if they are given, and take it off the list.

    For callers that have stored all that was made from it. The driver's JVM is
    asked to collect its garbage too, as Spark keeps the shuffle files of jobs
    that have ended until then.
    """
    spark._jvm.System.gc()
    for path in [x for x in paths if labels is None or x.rsplit("/", 1)[1] in labels]:
        paths.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
