"""Shared helpers: table reads, the shared scratch folder, lineage cuts, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Spark deletes a statement's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="llm-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: later plans survive lost executors.

    Nothing reads the write's shuffles again, so their files go with it: a long chain of cuts holds those of one.
    """
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, True)
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once everything made from them is written; frames of other kinds are left alone."""
    for df in tables:
        path = getattr(df, "cut_path", None) if df is not None else None
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def many(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark sizes rows made by an explode by the few they came from, so the driver would get them all."""
    return df.hint("merge")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; other columns never reach an operator."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters, so that a library call has bounded output."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def buckets(df: DataFrame, per_bucket: int) -> int:
    """How many hash buckets hold about ``per_bucket`` rows each; follows the row count."""
    return max(1, -(-df.count() // per_bucket))
