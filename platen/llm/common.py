"""What the operators of this subpackage share: staging, joins that stand hot keys, Arrow slices.

Staging writes a table to the folder that the cluster names in ``spark.checkpoint.dir`` and reads it
back. That cuts lineage, and a lost executor costs nothing that was staged. Only where the setting is
absent (tests, one machine) does the session get a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, as the contracts have them.
WORD = r"[^\x20\x09-\x0D]+"

#: A key that carries at least one in HOT of all rows is hot. The counts of keys add up to all rows, so
#: there are at most HOT such keys, whatever the data: that is the size bound of the broadcast.
HOT = 1000

_DIR = "platen.llm.staging"


def staging_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash. Only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors share no other folder")
        found = "file://" + tempfile.mkdtemp(prefix="spark-staging-")
        spark.conf.set(_DIR, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used; it goes when the application ends."""
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of those taken, in any case."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """left inner join right on key, right holding in n how many rows of left have its (unique) key.

    The at most HOT hot keys are broadcast and their rows stay where they are; the others have few rows
    each and meet in a shuffle. ``total``: at least the number of left's rows. n doesn't come out.
    """
    hot = right.filter(F.col(n) * HOT >= F.lit(total)).drop(n)
    cold = right.filter(F.col(n) * HOT < F.lit(total)).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")  # select takes a name or a list of names
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def parts(rows: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` rows."""
    return max(least, -(-rows // each))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice's texts have about ``most`` bytes (one text may have more)."""
    for batch in batches:
        at, held = 0, 0
        size = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        for i, k in enumerate(_lengths(size)):
            if held and held + k > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += k
        if at < batch.num_rows:
            yield batch.slice(at)


def _lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_pylist()


def release() -> None:
    """Gives memory that Arrow has freed back to the machine: workers are used again, and an executor has several."""
    pa.default_memory_pool().release_unused()


def in_arrow(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: int) -> Callable:
    """A function for mapInArrow that applies f to every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            out = f(part)
            if out is not None and out.num_rows:
                yield out
            release()

    return run
