"""Shared parts: tables, scratch tables, hashed words, blocks, components."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are worked on in slices of about so many bytes, whatever a batch holds.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1000
BATCH_BYTES = 4 << 20


def once(key: tuple, make: Callable):
    """make(), or what it gave to an earlier task of this worker process under
    this key.  One thing is kept at a time, so workers hold no two operators' tables."""
    import sys

    held = sys.__dict__.get("_ledgerline_kept")
    if held is None or held[0] != key:
        if held is not None:
            sys.__dict__["_ledgerline_kept"] = held = None  # the old one goes first
            gc.collect()
            trim()
        sys.__dict__["_ledgerline_kept"] = held = (key, make())
    return held[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts travel in batches; fewer rows and bytes a batch bound a worker's
    memory, and that of the buffers on the JVM's side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # A query's shuffle files go when it ends, not when the driver happens to collect garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    It is what spark.checkpoint.dir names.  Where that is unset, a session whose
    tasks all run on this machine takes a temporary folder; on a cluster, whose
    executors would each write to a disk of their own, this is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        root = local_folder()
    return f"{root}/ledgerline-{uuid.uuid4().hex}"


@functools.cache
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerline-")


def saved(df: DataFrame) -> DataFrame:
    """Write once, read back: cuts the lineage at a table all executors can reach."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids are broadcast up to so many (2 MB), and joined beyond.
FEW_IDS = 1 << 18


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are counted to be few enough."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def drop_saved(df: DataFrame) -> None:
    """Delete a table that saved() wrote, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getName().startswith("ledgerline-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- words as 64-bit hashes -------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """Hashes words of a byte buffer with one prefix sum; made once a task."""

    def __init__(self) -> None:
        self.byte = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        base = 0x9E3779B97F4A7C15
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(0, dtype=U64)
        self._grow(SLICE_BYTES + 1)
        self.odd = mix(np.arange(7, 71, dtype=U64)) | U64(1)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverses = (np.full(n, x, dtype=U64) for x in (self._base, self._inverse))
            for x in (self.powers, self.inverses):
                x[0] = 1
                np.cumprod(x, out=x)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each maximal run of bytes other than white space.

        data: lower-cased bytes.  Long buffers are hashed in parts cut at
        white space, so memory follows the longest word, not the buffer.
        """
        gap = self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        out = np.empty(len(start), dtype=U64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
            lo, hi = int(start[i]), int(end[j - 1])
            self._grow(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, dtype=U64)
            np.cumsum(self.byte[data[lo:hi]] * self.powers[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * self.inverses[s]
            i = j
        return start, end, mix(out)

    def sequence(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k consecutive words."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        total = np.zeros(n, dtype=U64)
        for j in range(k):
            total += words[j : j + n] * self.odd[j]
        return mix(total)

    def fold(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of each run words[starts[i]:starts[i + 1]], position by position."""
        if not len(starts):
            return np.zeros(0, dtype=U64)
        place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
        return mix(np.add.reduceat(mix(words + place.astype(U64) * U64(0x9E3779B97F4A7C15)), starts))


#: once() of this takes the place of what an operator before has kept.
HASHER = ("hasher",)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows; null texts are empty."""
    for chunk_start, chunk in _chunks(texts):
        chunk = chunk.cast(pa.large_binary()) if not pa.types.is_large_binary(chunk.type) else chunk
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        n = len(chunk)
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
        data = chunk.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            j = min(j, n, i + SLICE_ROWS)
            yield chunk_start + i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def _chunks(texts) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        yield at, chunk
        at += len(chunk)


def word_slices(hasher: Hasher, texts: pa.Array):
    """(first row, rows, lower bytes, start, end, hash, first word of each row and the end).

    A word never reaches over a row's end: rows are cut apart by their offsets.
    """
    for first, n, data, offsets in slices(texts):
        data = hasher.lower[data]
        # A space between rows keeps the last word of one apart from the first of the next.
        padded = np.full(len(data) + n, 0x20, dtype=np.uint8)
        place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))
        padded[place] = data
        rows = offsets + np.arange(n + 1)
        start, end, hashes = hasher.words(padded)
        yield first, n, padded, start, end, hashes, np.searchsorted(start, rows)


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


# --- blocks -----------------------------------------------------------------


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def n_blocks(docs: DataFrame, block_bytes: int, column: str = "text") -> int:
    """So many blocks that each holds about block_bytes of text."""
    return max(4, -(-text_bytes(docs, column) // block_bytes))


def block_of(key: str, blocks: int):
    """Block of a row, dealt by a hash of its key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")


def with_lookups(docs: DataFrame, lookups: DataFrame, blocks: int, apply: Callable, schema: str, block: str = "block") -> DataFrame:
    """Give each block of docs the rows of `lookups` for it, and apply a function.

    docs and lookups both have an int column `block` (its name is a parameter),
    below `blocks`; each block is a task.  apply(lookup table, iterator of
    batches of docs) yields batches.  A block's lookups are keys that its texts
    hold, so they are no larger than its texts, however often a key occurs in
    the whole corpus.  Documents are streamed.
    """
    side = [c for c in lookups.columns if c != block]
    main = [c for c in docs.columns if c != block]
    a = lookups.select(F.col(block).alias("_block"), F.lit(0).alias("_kind"), F.struct(*side).alias("_l"), F.lit(None).cast(docs.select(*main).schema).alias("_d"))
    b = docs.select(F.col(block).alias("_block"), F.lit(1).alias("_kind"), F.lit(None).cast(lookups.select(*side).schema).alias("_l"), F.struct(*main).alias("_d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition holds whole blocks in order, in each the lookups first.
        def pieces():
            for batch in batches:
                block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
                edges = [0, *cut.tolist(), batch.num_rows]
                for i, j in zip(edges, edges[1:]):
                    if j > i:
                        yield int(block[i]), int(kind[i]), batch.slice(i, j - i)

        stream, held = pieces(), []

        def peek():
            if not held:
                held.append(next(stream, None))
            return held[0]

        def flat(batch, column):
            x = batch.column(column)
            return pa.RecordBatch.from_arrays(x.flatten(), schema=pa.schema(list(x.type)))

        while (piece := peek()) is not None:
            block, parts = piece[0], []
            while (piece := peek()) is not None and piece[:2] == (block, 0):
                parts.append(flat(held.pop()[2], 2))

            def of_block(block=block):
                while (p := peek()) is not None and p[:2] == (block, 1):
                    yield flat(held.pop()[2], 3)

            yield from apply(pa.Table.from_batches(parts) if parts else None, of_block())
            while (piece := peek()) is not None and piece[:2] == (block, 1):  # what apply left
                held.pop()

    return a.unionByName(b).repartitionById(blocks, "_block").sortWithinPartitions("_block", "_kind").mapInArrow(run, schema)


def freed(run: Callable) -> Callable:
    """run, with a worker's unused memory given back when its task ends."""

    def whole(*args) -> Iterator[pa.RecordBatch]:
        yield from run(*args)
        trim()

    return whole


def trim() -> None:
    """Give this process's unused memory back."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """At an operator's end: Spark drops broadcasts and shuffles of frames that are
    gone only once the driver has collected its garbage, so let it do that now."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.java.lang.System.gc()


# --- connected components ---------------------------------------------------


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for edges (a, b): component is the least node reachable.

    Alternates large-star and small-star steps; both keep connectivity, and
    what is left when nothing changes are stars around each least node.
    Links stay distributed; minima are pre-aggregated before the shuffle.
    """
    spark = edges.sparkSession
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = saved(step)
        state = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        drop_saved(now)
        now = new
        if last == tuple(state):
            break
        last = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
