"""What the operators of this subpackage share: table access, checkpoints and byte-level token hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python. Texts are long, so batches are kept small to bound a worker's memory.
BATCH_ROWS = 512
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def few_rows(spark: SparkSession) -> None:
    """From now on Python gets BATCH_ROWS rows at a time. Spark's own number is 10,000, and memory is many times the texts of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(texts: list[str | None], chars: int) -> Iterator[slice]:
    """The texts in order, a few at a time: of so many characters together at most, or one text."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        yield slice(begin, end)
        begin = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    few_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of one's own only where it is unset and Spark is on one machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexmill-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared checkpoint folder, and its place. Unlike a checkpoint, it carries no estimates or constraints
    of its plan on; in a loop of joins those would grow with a power of the rounds."""
    where = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def discard(spark: SparkSession, where: str) -> None:
    """Deletes a written table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle and checkpoint files that no plan refers to any more; it notes them only when the driver's
    garbage is collected, which may be long after. What is still referred to stays, for tasks that are lost and run again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n: the fold of a document; -1, which is no fold, for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(-1))


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(rows: DataFrame, key: Column, stratum: Column, bound: int) -> DataFrame:
    """About `bound` rows of each stratum by a hash of the key; all of a smaller one. Strata must be few (classes)."""
    rows = rows.withColumn("__stratum", stratum)
    rate = rows.groupBy("__stratum").agg((F.lit(float(bound)) / F.count(F.lit(1))).alias("__rate"))
    unit = (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)) / F.lit(1_000_003.0)).alias("__unit")
    return rows.withColumn("__unit", unit).join(F.broadcast(rate), "__stratum").where("__unit < __rate").drop("__stratum", "__unit", "__rate")


def _byte_classes() -> np.ndarray:
    """0 white space, 1 letters, digits and any byte of a longer character, 2 the other signs."""
    out = np.full(256, 2, np.uint8)
    out[[*b" \t\n\v\f\r"]] = 0
    out[[i for i in range(256) if i >= 128 or chr(i).isalnum()]] = 1
    return out


BYTE_CLASS = _byte_classes()
_RNG = np.random.default_rng(20_240_229)
_MIX = _RNG.integers(1, 2**32, 256, dtype=np.uint32)
_POW = np.cumprod(np.full(64, 2_654_435_761, np.uint64) % 2**32 | 1, dtype=np.uint64).astype(np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 32-bit numbers."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, each followed by a line break, and where each text starts."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in data], out=starts[1:])
    return np.frombuffer(b"\n".join([*data, b""]), np.uint8), starts


def token_hashes(texts: list[str | None], runs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of each token of the texts in order, and the index of its text.

    runs: tokens are runs of one byte class, so that signs part from the word they cling to; else whole words.
    """
    raw, starts = joined(texts)
    kind = BYTE_CLASS[raw]
    if not runs:
        kind = np.minimum(kind, 1)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(255)))
    place = np.arange(len(raw), dtype=np.int32)
    place -= np.repeat(edge.astype(np.int32), np.diff(edge, append=len(raw)))
    value = _MIX[raw]
    value *= _POW[place & 63]
    value ^= (place >> 6).astype(np.uint32)
    h = np.add.reduceat(value, edge, dtype=np.uint32)
    keep = kind[edge] > 0
    return mix(h[keep]), np.searchsorted(starts, edge[keep], side="right") - 1
