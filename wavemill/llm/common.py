"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import joined_by_key  # noqa: F401  (for the operators)
from ..sources.scratch import checkpointed

#: Bytes of a batch of rows on its way to Python, at most (one row at least); JVM and Python each hold a few.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of a batch; batches of long texts would else take most of an executor.

    Sessions belong to applications: the queries and the pipeline call this, the
    operators leave the settings as they find them.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run):
    """A function of batches that hands back the memory it has freed: Python workers live on, and what they keep is lost to the executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return whole


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, so that other columns never clash or travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def batches_of(batch: pa.RecordBatch, column: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``max_bytes`` each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of_batch(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-case white-space words of a batch: index of each word in the distinct list, that list, offsets by row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # Arrow now and then leaves the white space at the very end of an array, so another text stands there.
    split = pc.utf8_split_whitespace(pc.utf8_lower(pa.concat_arrays([texts, pa.array(["end"], pa.large_string())])))
    offsets = np.asarray(split.offsets, dtype=np.int64)[:-1]
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    # Splitting leaves empty pieces at the ends of a text.
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets = kept[offsets]
        flat = flat.filter(pa.array(full))
    return *_coded(flat), offsets


def ascii_words_of_batch(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The same for UTF-8 bytes, where just A-Z are lowered and just space, \\t, \\n, \\v, \\f, \\r separate."""
    rows = [(t or "").encode().lower().split() for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return *_coded(pa.array([w for r in rows for w in r], pa.large_binary())), offsets


def _coded(flat: pa.Array) -> tuple[np.ndarray, list]:
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def word_ngrams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ``<word>`` (and the whole word): pairs of word index and bucket, in no order of words."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    lens = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    who, what = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
        inside = owner[: len(h)] == owner[n - 1 :]
        who.append(owner[: len(h)][inside])
        what.append((mix64(h[inside]) % np.uint64(buckets)).astype(np.int32))
    if whole:
        powers = np.cumprod(np.full(int(lens.max()), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
        starts = np.cumsum(lens) - lens
        h = np.add.reduceat(mix64(codes) * powers[np.arange(len(codes)) - np.repeat(starts, lens)], starts)
        who.append(np.arange(len(words), dtype=np.int32))
        what.append((mix64(h) % np.uint64(buckets)).astype(np.int32))
    return np.concatenate(who), np.concatenate(what)


def joined(big: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int, limit: int = 300_000) -> DataFrame:
    """Join with ``small``, which has ``rows`` rows (counted beforehand): broadcast up to ``limit``, else both sides are shuffled."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


@contextmanager
def chosen_broadcasts(spark: SparkSession):
    """Meanwhile just those joins are broadcast that ask for it.

    Spark else turns every join with a small side into one once it is shuffled.
    The driver builds and keeps a table of some MB for each until it collects its
    garbage, which in work of many small jobs takes most of its heap.
    """
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, between the steps of work in many jobs, and hand back what it has freed.

    Shuffle files, broadcasts and checkpoints that nothing reads any more are
    removed only then; left alone, Spark does so every half hour.
    """
    spark.sparkContext._jvm.System.gc()
    hand_back(spark)


def hand_back(spark: SparkSession) -> bool:
    """Has the driver's JVM return to the system the memory outside its heap that it has freed; says whether the JVM can.

    It is what ``trimmed`` does in Python workers.  Some hundred short jobs
    compile and start hundreds of threads, and the C library keeps what they
    freed (215 MB after 274 jobs), which the system counts as taken.
    The JVM offers this as a management command, on Linux since 17.0.9.
    """
    sc = spark.sparkContext
    lang = sc._jvm.java.lang
    command = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds, given = sc._gateway.new_array(lang.Class, 4), sc._gateway.new_array(lang.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = lang.Class.forName(kind)
    given[0], given[1] = command, "systemTrimNativeHeap"
    # By way of the interface, as the class behind it is closed to callers.
    invoke = lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
    try:
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # another JVM, system or C library
        return False
    return True


def executors_let_go(spark: SparkSession) -> None:
    """Has the executors collect their garbage, after which their JVMs hand back the heap they do not need.

    A heap that one step has filled else stays as large as it ever was, also
    while later steps need the room for Python.  Every core is asked, which on
    an idle cluster reaches all executors; one that is missed goes on as before.
    """
    n = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected.alias("collected")).write.format("noop").mode("overwrite").save()


def least_count(counts: DataFrame, most: int, column: str = "n") -> int:
    """The least count that at most ``most`` rows reach; the driver gets the numbers of rows by count, exact ones to 4096 and 64 for each doubling above."""
    n = F.col(column)
    step = F.when(n <= 4096, n).otherwise(F.floor(F.log2(n) * 64) + 4096 - 12 * 64 + 1)
    rows = counts.groupBy(step.cast("long").alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("least")).collect()
    found, total = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            break
        found = r["least"]
    return found


def heavy_values(values: DataFrame, column: str = "value", most: int = 1 << 16) -> np.ndarray:
    """Sorted by frequency, the commonest ``most`` of the (value, n) rows that ``frequent_in_chunks`` gave; a bounded list."""
    rows = values.groupBy(column).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), column).limit(most).select(column).toPandas()
    return rows[column].to_numpy(dtype=np.int64).view(np.uint64)[::-1].copy()


class ChunkCounter:
    """Values that are frequent within chunks of about ``size`` values; each row gives distinct values."""

    def __init__(self, share: float, least: int, size: int = 2_000_000):
        self.share, self.least, self.size = share, least, size
        self.held, self.n, self.rows = [], 0, 0

    def add(self, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray] | None:
        self.held.append(values)
        self.n += len(values)
        self.rows += rows
        return self.flush() if self.n >= self.size else None

    def flush(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.n:
            return None
        value, n = np.unique(np.concatenate(self.held), return_counts=True)
        keep = n >= max(self.least, self.share * self.rows)
        self.held, self.n, self.rows = [], 0, 0
        return value[keep], n[keep]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) for every end of the ``a, b`` links.

    Each round every node moves to the first node of its closed neighbourhood
    (by number in the first round, then by a hash that changes each round, so
    long paths shrink by a constant factor), and the links are carried along,
    until none is left.  Nothing is collected; each round is checkpointed.  A
    checkpoint keeps what the optimizer knows of its columns, which from round
    to round would grow without end, so this is switched off meanwhile.
    """
    conf, setting = edges.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(setting)
    conf.set(setting, "false")
    try:
        return _contracted(edges)
    finally:
        conf.set(setting, before)


def _contracted(edges: DataFrame) -> DataFrame:
    edges = checkpointed(edges.select("a", "b").where("a <> b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    where, k = checkpointed(nodes.withColumn("at", F.col("node"))), 0
    while not edges.isEmpty():
        rank = (lambda c: F.col(c)) if k == 0 else (lambda c: F.xxhash64(F.col(c), F.lit(k)))  # noqa: B023
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"), F.min(F.struct(rank("a").alias("r"), F.col("a").alias("to"))).alias("own"))
        move = checkpointed(first.select(F.col("a").alias("from"), F.least("m", "own")["to"].alias("to")))
        where = checkpointed(where.join(move, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at")))
        step = edges.join(move, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        step = step.join(move, F.col("b") == F.col("from")).select("a", F.col("to").alias("b")).where("a <> b")
        edges = checkpointed(step.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        k += 1
    least = where.groupBy("at").agg(F.min("node").alias("component"))
    return checkpointed(where.join(least, "at").select("node", "component"))
