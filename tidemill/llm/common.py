"""Shared helpers: column picking, shared storage, bounded memos and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_guard = threading.Lock()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched by exact spelling.

    Extra columns may repeat a name or differ only in case; the first exact match is taken.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    A folder of its own is set only where the session names none and everything runs in one
    process on one machine, as in tests; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
    with _guard:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their heaps shrink to what is in use.

    A JVM gives memory back to the system only then. Without it a heap that joins and sorts of
    earlier stages have grown stays at its full size beside the Python workers of later ones.
    Tasks don't choose their executor, so there are two for every core; requests that meet in one
    JVM are one collection.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    collected = spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done"))
    collected.write.format("noop").mode("overwrite").save()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Bounds what a Python worker gets at once, where the session leaves Spark's default of 10,000 rows: a row is a whole text here."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(rows))


def per_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], most: int = 4 << 20) -> DataFrame:
    """mapInArrow with the schema's column order; make() runs once per task and returns the batch function.

    most: bytes of strings that the function gets at once.
    """
    from pyspark.sql.types import StructType

    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct, prefers_large_types=False)

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        f = make()
        for batch in batches:
            for part in slices(batch, most):
                out = f(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(arrow.names, arrow.types)], schema=arrow)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, struct)


def kept_rows(docs: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Rows of docs, all columns, for which make()'s function of the column's values is true; names may clash."""
    owner, at, names = make.__module__, docs.columns.index(column), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        keep = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part[at]), pa.bool_()))
        give_back()

    small_batches(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def slices(batch: pa.RecordBatch, most: int = 4 << 20, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `most` bytes of strings (a longer row is alone), so that little exists in Python at a time."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if any(f(column.type) for f in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + most, side="right"))), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def as_texts(column: pa.Array) -> pa.Array:
    """The texts with empty ones for nulls, as one array that begins at its buffers' start."""
    return pa.concat_arrays([pc.fill_null(column, "")])


def top_bytes(texts: pa.Array) -> np.ndarray:
    """The largest UTF-8 byte of each text (0 for empty ones): below 0x80 all is ASCII, below 0xCC no character is from U+0300 on."""
    offsets, raw = _bytes_of(texts)
    out = np.zeros(len(texts), np.uint8)
    some = np.nonzero(np.diff(offsets) > 0)[0]
    if len(some):
        out[some] = np.maximum.reduceat(raw[: offsets[-1]], offsets[some])
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


class Runs:
    """The runs between ASCII white space of many texts: text k has unique[code] for code in codes[bounds[k]:bounds[k + 1]].

    Empty runs may occur at a text's ends.
    """

    def __init__(self, texts: pa.Array):
        found = pc.ascii_split_whitespace(texts)
        coded = found.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.unique = coded.dictionary
        sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat holds blocks of these sizes, one after the other; returns the blocks that codes name, joined, and where each ends."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((starts[codes] - ends + n).astype(kind), n)
    return flat[at], ends


def at_bounds(ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds of texts over gathered blocks, from their bounds over runs."""
    return np.concatenate([[0], ends])[bounds]


class Memo(dict):
    """f's results by key. It starts anew beyond `most` entries; keys over `longest` are never kept."""

    def __init__(self, f: Callable, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_kept: dict = {}
_owner: list = [None]


def claim(owner: str) -> None:
    """Called as a task begins: a reused worker forgets what other operators keep, so memory doesn't add up over stages."""
    if _owner[0] != owner:
        _kept.clear()
        _owner[0] = owner
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, so that a reused worker's peak doesn't stay its size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def once(key: tuple, make: Callable):
    """make()'s result, kept in this Python process (a reused worker serves many tasks) until another operator claims it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def narrowed(df: DataFrame, keys: DataFrame, key: str, keep: tuple = (), anti: bool = False, most: int = 500_000, otherwise: DataFrame | None = None) -> DataFrame:
    """Rows of df whose key is among `keys` (anti: isn't), one row per key there; with `keep`, these columns of both.

    Up to `most` keys are broadcast, so that df's rows stay where they are; more are joined by a
    shuffle. otherwise: for anti and many keys, all the other keys, if these are to be joined.
    """
    if keys.limit(most + 1).count() <= most:
        keys = F.broadcast(keys)
    elif anti and otherwise is not None:
        return df.join(otherwise.hint("merge"), key, "left_semi")
    else:
        keys = keys.hint("merge")
    if keep:
        return df.join(keys, key).select(*keep)
    return df.join(keys, key, "left_anti" if anti else "left_semi")


def bit_distance(x, y, words: int):
    """Differing bits of two arrays of 64-bit words; written out, so that it is compiled."""
    return reduce(lambda a, b: a + b, [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(words)])


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Up to `most` rows of each value of `by`, those with the smallest xxhash64 of `key` (ties: smaller key).

    Counts come first: where a value has many rows, only those below a hash that about twice
    `most` rows pass go to the exact ranking, so no value's rows all meet in one task.
    """
    from pyspark.sql import Window

    hashed = rows.withColumn("tidemill_hash", F.xxhash64(key))
    counts = rows.groupBy(by).agg(F.count("*").alias("tidemill_n"))  # one row a value
    near = hashed.join(F.broadcast(counts), by)
    # as a share of all hashes; at 2 * most + 200 expected rows fewer than `most` is out of reach
    share = (F.col("tidemill_hash").cast("double") + 2.0**63) / 2.0**64
    near = near.where(share <= (2.0 * most + 200.0) / F.col("tidemill_n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("tidemill_hash", key))
    return near.withColumn("tidemill_at", rank).where(F.col("tidemill_at") <= most).drop("tidemill_at", "tidemill_hash", "tidemill_n")


def crc32_of(column) -> F.Column:
    """crc32 of an integer id as text."""
    return F.crc32(column.cast("string").cast("binary"))

