"""Sources and sinks: CSV/Parquet scans, views, SQL, table writes, samples."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_unit
from .schema import flights_schema


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to the dictionary types by name.

    Unknown columns pass through as text. Unparseable numbers (``NA``,
    junk) become NULL instead of failing the job or producing NaN.
    """
    by_name = {f.name: f for f in schema.fields}
    out = []
    for c in df.columns:
        f = by_name.get(c)
        if f is None or isinstance(f.dataType, T.StringType):
            e = F.col(c)
            if f is not None:
                e = F.when(F.col(c) != F.lit("NA"), F.col(c))
            out.append(e.alias(c, metadata=f.metadata) if f is not None else e)
        else:
            out.append(F.col(c).try_cast(f.dataType).alias(c, metadata=f.metadata))
    return df.select(*out)


def _first_lines(batches):
    """Rows (path, header) where the task's block is the beginning of a file; the rest of the block is not read."""
    for b in batches:
        if b.num_rows and b.column("start")[0].as_py() == 0:
            yield b.slice(0, 1).select(["path", "value"]).rename_columns(["path", "header"])
        return


def file_headers(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """(path, header): the first line of every file, found in tasks by one job.

    Blocks are read by a session of their own that gives each a task (blocks
    of several files in one task would hide all headers but the first), and
    a task ends after its first rows."""
    one = spark.newSession()
    one.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    if split_bytes:
        one.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    meta = F.col("_metadata")
    rows = one.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), "value")
    return rows.mapInArrow(_first_lines, "path string, header string")


def _columns(header: str) -> list[str]:
    """Column names of a header line (a first line of a CSV file; names may be quoted)."""
    names = next(csv.reader([header.lstrip("\ufeff")]), [])
    return [n.strip() or f"_c{i}" for i, n in enumerate(names)]


def read_flights_csv(spark: SparkSession, path: str | list[str],
                     schema: T.StructType | None = None, required: Iterable[str] = ()) -> DataFrame:
    """CSV with a header row, typed by the dictionary (no inference pass).

    Columns are matched by *name* from the header, so files may carry any
    subset of the dictionary in any order; a column that some files lack is
    NULL there. Spark takes one header for all files of a read, so files are
    read in groups of equal headers, joined by name. The headers are found
    in tasks by one job, whatever the number of files. A file without any
    known column, or without one of ``required``, fails; empty files have no
    rows. ``FL_DATE`` stays text here and is parsed by
    :func:`skylane.operators.prep.prepare`.
    """
    schema = schema or flights_schema()
    # a row per distinct header; the paths are those Spark has listed on the driver anyway
    groups = file_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("header").collect()
    known = {c.upper() for c in schema.fieldNames()}
    out = None
    for r in groups:
        names = _columns(r["header"])
        if not known & {c.upper() for c in names}:
            raise ValueError(f"no known column in the header of {r['files'][0]}")
        missing = [c for c in required if c not in names]
        if missing:
            raise ValueError(f"no column {missing} in the header of {r['files'][0]}")
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").csv([_path(f) for f in r["files"]])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return _typed(spark.createDataFrame([], T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])) if out is None else out, schema)


def _path(file: str) -> str:
    """A file's path as a reader takes it: decoded, and without wildcards."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*(path if isinstance(path, list) else [path]))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the scan has fewer splits than the
    cluster can run at once (e.g. one small file with one row group).

    The split count comes from file listing (no job). Large inputs — many
    files or row groups — already have more splits than cores and are
    returned unchanged, so no shuffle is added at scale.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:          # no JVM context (e.g. a remote session): leave as is
        return df
    return df.repartition(target) if splits < target else df


def register_view(df: DataFrame, name: str = "flights") -> DataFrame:
    """Replace-if-present table registration (no data copy)."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def save_table(df: DataFrame, path: str, partition_by: Iterable[str] = ("YEAR",),
               mode: str = "overwrite") -> str:
    """Write Parquet, replacing what is there, partitioned for pruning.

    No shuffle: each task sorts its own rows by the partition columns, so
    it writes one file per partition value it holds, and every task stays
    busy (a ``repartition`` by YEAR would send a whole year to one task).
    File size is bounded by ``spark.sql.files.maxRecordsPerFile`` if set.
    """
    cols = [c for c in partition_by if c in df.columns]
    w = (df.sortWithinPartitions(*cols) if cols else df).write.mode(mode)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)
    return path


def hash_sample(df: DataFrame, fraction: float, keys: list[str], seed: int = 42) -> DataFrame:
    """Reproducible simple random sample: keep rows whose key hash < fraction.

    Unlike ``DataFrame.sample`` the chosen rows do not depend on the
    partitioning, so reruns and other cluster sizes select the same rows.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return df.filter(hash_unit(*keys, seed=seed) < F.lit(float(fraction)))
