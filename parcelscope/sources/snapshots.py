"""Tables replaced by swapping a pointer, and digests of files of any size.

A table folder holds one folder per version and a small file ``CURRENT`` that names the current version first, then the
kept ones. A version is written whole before the pointer is renamed over the old one, so readers see the old rows or the
new rows and never a part; a job that fails or is killed leaves the old table. Where two writers meet, the last pointer
wins and no version in writing is deleted, as only versions that were current once are.
The rename is atomic on file systems that have one (local, HDFS); on object stores it is a copy of one small object.
"""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"
#: Bytes read at a time from a file that is hashed.
BLOCK = 8 << 20
#: Schemes that tasks open through Arrow without further set-up.
STREAMED = ("file", "s3", "s3a", "s3n", "gs", "gcs")


class NoTable(FileNotFoundError):
    """The folder has no current version."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version and the kept earlier ones, newest first; empty where there is no table."""
    pointer = f"{path.rstrip('/')}/{_POINTER}"
    p, fs = _path(spark, pointer)
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    """Name the versions in a file beside the pointer and rename it over the pointer."""
    target, fs = _path(spark, f"{path.rstrip('/')}/{_POINTER}")
    beside, _ = _path(spark, f"{path.rstrip('/')}/.{_POINTER}-{uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write("\n".join(names).encode())
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, keep: int = 1) -> str:
    """Write ``df`` as the new current version of the table and return the version's name.

    ``keep`` earlier versions stay, so plans that still read one can end; ``df`` may read the table itself. A version whose
    write fails is deleted; one of a lost driver stays in the folder, unnamed and unread.
    """
    if keep < 0:
        raise ValueError("keep must not be negative")
    spark, root, name = df.sparkSession, path.rstrip("/"), f"v-{uuid4().hex}"
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.save(f"{root}/{name}")
        before = versions(spark, root)
        _point(spark, root, [name, *before[:keep]])
    except Exception:
        _delete(spark, f"{root}/{name}")
        raise
    for old in before[keep:]:
        _delete(spark, f"{root}/{old}")
    return name


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", back: int = 0) -> DataFrame:
    """The current version, or the one ``back`` versions before it if it is kept."""
    names = versions(spark, path)
    if back >= len(names):
        raise NoTable(f"{path} has {len(names)} versions")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{path.rstrip('/')}/{names[back]}")


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of the files of a folder, empty ones too (a file scan leaves those out); hidden names are left out."""
    root, fs = _path(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(path)
    found = fs.listStatus(root, spark._jvm.org.apache.hadoop.fs.GlobFilter(pattern))
    files = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName()[0] not in "._"]
    return spark.createDataFrame(files, "path string, length long")


def whole_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same for any scheme that Spark reads, each file as one value: for files under 2 GB, Spark's limit."""
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter("length > 0")
    empty = listed_files(spark, path, pattern).filter("length = 0").withColumn("content", F.lit("").cast("binary"))
    return (read.select("path", "length", "content").unionByName(empty)
            .select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def file_digests(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK) -> DataFrame:
    """``file_name, bytes, sha256`` of each file, read in blocks by the tasks: memory does not grow with a file.

    Paths are dealt to tasks by Spark and opened by Arrow's file systems (tested on local files). Files of other schemes are
    read by ``whole_digests``.
    """
    if _path(spark, path)[1].getUri().getScheme() not in STREAMED:
        return whole_digests(spark, path, pattern)

    def digests(batches):
        import hashlib

        from pyarrow import fs as arrow_fs
        opened: dict[str, arrow_fs.FileSystem] = {}

        def stream(uri):
            scheme, _, rest = uri.partition(":")
            host, slash, inner = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "/", rest.lstrip("/"))
            scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
            at = f"{scheme}://{host}/"
            if at not in opened:
                opened[at] = arrow_fs.LocalFileSystem() if scheme == "file" else arrow_fs.FileSystem.from_uri(at)[0]
            # object stores have the bucket in front of the key
            inner = f"{host}/{inner}" if scheme in ("s3", "gs", "gcs") else slash + inner
            return opened[at].open_input_stream(inner)

        for batch in batches:
            names, sums = [], []
            for uri in batch.column("path").to_pylist():
                sha = hashlib.sha256()
                with stream(uri) as f:
                    while part := f.read(block):
                        sha.update(part)
                names.append(uri.rsplit("/", 1)[-1])
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("length"), pa.array(sums, pa.string())], names=["file_name", "bytes", "sha256"])

    return listed_files(spark, path, pattern).repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(digests, "file_name string, bytes long, sha256 string")
