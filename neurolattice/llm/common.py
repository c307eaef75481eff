"""What the corpus operators share: reading tables, text buffers, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='neurolattice-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and survives lost executors. The
    shuffle files of the write are removed as soon as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def unwritten(df: DataFrame) -> None:
    """Removes what written() made, once nothing reads it any more."""
    path = getattr(df, "_written", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mod_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls have no bytes."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def each_text(column: pa.Array) -> Iterator[bytes]:
    """The texts' UTF-8 bytes; null counts as empty."""
    offsets, data = text_bytes(column)
    view = data.tobytes() if data.nbytes < 1 << 20 else memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[a:b])


class Memo(dict):
    """A bounded memo: the value of a missing key is made by make; beyond the limit it starts anew."""

    def __init__(self, make, limit: int = 400_000):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: CRC-32 over an array of bytes; its table is made from the reversed polynomial.
CRC_SQL = """crc_table AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; crc_table has to be in scope as a table of one row."""
    raw = f"hex(encode({text}))"
    return f"xor(list_reduce(range(0, (length({raw}) // 2)::BIGINT), lambda c, i: xor(c >> 8, t[1 + (xor(c, ('0x' || substr({raw}, (2 * i + 1)::BIGINT, 2))::BIGINT) & 255)]), 4294967295::BIGINT), 4294967295)"
