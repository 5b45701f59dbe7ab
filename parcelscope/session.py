"""Session helpers: settings that are safe on a cluster and small enough for local tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "parcelscope", **conf: str) -> SparkSession:
    """Session with AQE, skew-join handling and UTC; cluster settings win when they are set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Directory for reliable checkpoints: the cluster's setting; a fallback only where it is unset."""
    import tempfile

    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    configured = shared_folder(spark)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parcelscope-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


_STAGED: dict = {}


def stage(spark: SparkSession, scope: str, name: str, build, by: str | None = None):
    """A shared intermediate table, built once per session and input folder.

    Where the cluster names ``spark.checkpoint.dir`` the table is written there as Parquet and read
    back, so later plans start from files and survive lost executors. Without it (tests) the frame
    is persisted. A table staged ``by`` a column is written in buckets of it, as many as a shuffle has
    partitions, so that joins and groups by that column don't shuffle it again; ``build`` gives it laid out so.
    """
    from pyspark.storagelevel import StorageLevel

    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _STAGED:
        shared = shared_folder(spark)
        df = build()
        if shared:
            import zlib
            path = f"{shared.rstrip('/')}/parcelscope/{key[0]}/{zlib.crc32(scope.encode()):08x}/{name}"
            w = df.write.mode("overwrite").option("compression", "zstd")
            if by:
                table = f"parcelscope_{zlib.crc32(str(key).encode()):08x}_{name.lower()}"
                w.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(table)
                _STAGED[key] = spark.table(table)
            else:
                w.parquet(path)
                _STAGED[key] = spark.read.parquet(path)
        else:
            _STAGED[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
    return _STAGED[key]
