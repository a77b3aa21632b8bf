"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word of the quality, size and mixing operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one for a session on one machine (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tally-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``: a lost executor costs no
    recomputation of what lies behind the table, and the file is columnar and
    compressed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that each open ``scratch`` has made.
_scratch: list[list[str]] = []


def scratch(operator):
    """Decorate a function that returns a DataFrame: its result is written, then the tables it made on the way go."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        _scratch.append([])
        try:
            out = operator(docs, *args, **kw)
        finally:
            made = _scratch.pop()
        out = materialize(out, operator.__name__)
        spark = docs.sparkSession
        path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        for path in made:
            at = path_of(path)
            at.getFileSystem(conf).delete(at, True)
        return out

    return run


def by_row(docs: DataFrame, tag: str) -> DataFrame:
    """(doc, row): every row as a struct, so that no column name clashes, and a number of its own.

    Where doc_id tells all rows apart it is the number; else, with nulls or
    repeats, the rows are numbered in a written copy, so that they stay the same.
    """
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    doc = F.struct(*docs.columns).alias("doc")
    if n == ids:
        return docs.select(doc, F.col("doc_id").cast("long").alias("row"))
    return materialize(docs.select(doc, F.monotonically_increasing_id().alias("row")), tag)


def numbered(rows: DataFrame, id_column: str, tag: str) -> DataFrame:
    """The columns of ``rows`` and row: ``id_column`` where it tells all rows apart, else a number given in a written copy."""
    n, ids = rows.agg(F.count("*"), F.count_distinct(id_column)).first()
    if n == ids:
        return rows.withColumn("row", F.col(id_column).cast("long"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), tag)


def let(value, body):
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst may copy an expression into every place that uses it; a lambda
    argument is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Return memory that a Python worker has freed to the system: Arrow's pool and the C library keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(function):
    """``function`` over batches; when it has ended, what it has freed goes back to the system.

    A worker waits for its next task, maybe of a stage without Python, beside
    an executor that needs the memory.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors and ``giving_back``."""
    ship(df.sparkSession)
    return df.mapInArrow(giving_back(function), schema)
