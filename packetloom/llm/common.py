"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import configure, shared_dir

#: The characters that separate words: space and \x09-\x0D. bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
BUCKETS = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of the text operators: Arrow batches bounded in rows and bytes."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write a table into the folder that the cluster shares and read it back.

    This cuts the lineage: a lost executor costs its running tasks, not what is staged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, col: str) -> str:
    """Write a table into the shared folder, one folder a value of ``col``; its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(col).parquet(path)
    return path


def fold(col: str, mod: int) -> F.Column:
    """True where crc32 of the id as text leaves the remainder 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``; all of a smaller table."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def only_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` without most rows whose key is not in ``ids`` (a column of the same name).

    Keys are hashed to ``BUCKETS`` buckets and the buckets in use are broadcast: never more
    than ``BUCKETS`` numbers. Every wanted row stays, some others do too; a join decides.
    """
    return _by_bucket(df, key, ids, "left_semi")


def other_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``only_ids`` leaves out; none of their keys is in ``ids``."""
    return _by_bucket(df, key, ids, "left_anti")


def _by_bucket(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS))
    used = ids.select(bucket.alias("__bucket")).distinct()
    return df.withColumn("__bucket", bucket).join(F.broadcast(used), "__bucket", how).drop("__bucket")


def shielded(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``used`` renamed, so that none clashes, and what undoes that."""
    names = {c: c if c in used else f"__column_{k}" for k, c in enumerate(df.columns)}
    hidden = df.toDF(*names.values())
    return hidden, lambda out: out.select(*[F.col(new).alias(old) for old, new in names.items()])


class Shared:
    """An object of this package that tasks read by ``value``, broadcast as bytes.

    Broadcasts name classes by their module, which executors may not have; pickled here, classes travel along.
    """

    def __init__(self, spark: SparkSession, held: object) -> None:
        self._bytes, self._held = spark.sparkContext.broadcast(cloudpickle.dumps(held)), None

    def __reduce__(self) -> tuple:
        return _shared, (self._bytes,)

    @property
    def value(self) -> object:
        if self._held is None:
            self._held = cloudpickle.loads(self._bytes.value)
        return self._held

    def unpersist(self) -> None:
        self._bytes.unpersist()


def _shared(data: Broadcast) -> Shared:
    made = Shared.__new__(Shared)
    made._bytes, made._held = data, None
    return made


def sliced(batch: pa.RecordBatch, col: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, "right"))
        yield batch.slice(begin, max(1, end - begin))
        begin = max(begin + 1, end)


class WordHashes(dict):
    """64-bit hashes of words as they are asked for; forgets all at ``limit`` words."""

    def __init__(self, limit: int = 400_000, prepare=None) -> None:
        super().__init__()
        self.limit, self.prepare = limit, prepare

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        plain = self.prepare(word) if self.prepare else word
        self[word] = found = xxhash.xxh3_64_intdigest(plain) | 1 if plain else 0
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers, so that sums of products spread evenly."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words; of the whole sequence where it is shorter."""
    size = len(hashes)
    if not size:
        return hashes
    n = min(n, size)
    total = np.full(size - n + 1, n, np.uint64)
    for k in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[k : size - n + 1 + k]
    return mix(total)


def texts(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [t or "" for t in batch.column(col).to_pylist()]
