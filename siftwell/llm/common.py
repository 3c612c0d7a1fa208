"""What the operators of this subpackage share: words, staged tables, size-checked joins."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java, RE2 and Python alike: a run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a broadcast side may have at most; beyond them the join is left to a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@functools.cache
def _own_dir(application: str) -> str:
    """A temporary folder of an application; a running session does not let spark.checkpoint.dir be set."""
    return tempfile.mkdtemp(prefix="siftwell-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.

    The tables of an application lie together in ``siftwell/<application id>``, which can go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(name: str, kind: str) -> Column:
    """Bytes of a value, about."""
    column = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if kind.startswith("array<") and not re.search("string|binary|array|struct|map", kind[6:]):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 8
    if re.match("array|struct|map", kind):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
    return F.lit(16)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes. No more rows are read than the bound."""
    width = sum((_width(*c) for c in df.dtypes), F.lit(0)).cast("long")
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (size or 0) <= most


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, else df itself: then the join shuffles.

    Measuring runs df, so stage it first if it is dear.
    """
    return F.broadcast(df) if fits(df, rows, most) else df


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo k; 0 marks held-out rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(0)).cast("int")
