"""Exact top-k search by Fagin's threshold algorithm.

Vectors become integers, floor(256 x) of each component.  Queries and
candidates are dealt into blocks by hash; each pair of blocks is a task.  A
candidate block keeps a list per dimension sorted by value.  Queries walk in
tiles: a tile goes down all lists from the ends that its queries' components
favour, twice as far each round, and what it meets is scored exactly, for all
its queries in one product.  A query's bound is the score of a vector that would
stand at every list's present depth.  Its walk stops when the bound is below its
k-th best score (on a tie it goes on, as a smaller id may still win), or when
the tile has met the whole block.  Blocks' results are merged by a window over
k rows a block.

Defined cases: null vectors, vectors with a null or non-finite component and
rows without an id take no part; vectors of a length other than the query's
aren't its candidates; a row with the query's own id is not its candidate;
rows that repeat exactly count once; a query with fewer candidates than k gets
all; vectors of any length are taken whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

K = 5
QUERY_MOD = 50
#: Vectors of a candidate block, and queries of a query block, at least.
BLOCK, QUERIES = 8192, 8192
#: Large tables have larger blocks, as each block is sent to each of the other side's:
#: candidates in no fewer parts than so many, and up to so many components a block
#: (queries, which need no lists, up to twice as many).
PARTS, COMPONENTS = 48, 1 << 21
#: Rows of an Arrow batch, on the way to a task.
BATCH_ROWS = 5000
#: Queries that walk together.
TILE = 128
#: Entries of each list that the first round reads; each further round reads twice as many.
STEP = 8


class Lists:
    """Candidates of a block by id, with one sorted list a dimension.

    Scores are worked out in floating point where that is exact (all sums below
    2^24 or 2^53), else in whole numbers."""

    EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[by_id], vectors[by_id]
        columns = np.ascontiguousarray(vectors.T)
        self.up = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(columns, self.up, axis=1)
        self.most = _most(vectors)
        self.vectors = {np.int64: vectors}

    def kind(self, q: np.ndarray) -> type:
        """The smallest type that holds every score of q exactly."""
        largest = q.shape[1] * self.most * _most(q)
        kind = next((t for t, limit in self.EXACT.items() if largest < limit), np.int64)
        if kind not in self.vectors:
            self.vectors[kind] = self.vectors[np.int64].astype(kind)
        return kind

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of each query (in the type that kind() gave) with each of the rows."""
        return q @ self.vectors[q.dtype.type][rows].T

    def own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, row) of each row with a query's own id."""
        first, end = (np.searchsorted(self.ids, query_ids, side) for side in ("left", "right"))
        size = end - first
        whose = np.repeat(np.arange(len(query_ids)), size)
        return whose, np.arange(len(whose)) + np.repeat(end - np.cumsum(size), size)

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of each query's k best, ties to smaller ids."""
        n, kind = len(self.ids), self.kind(q)
        typed, least = q.astype(kind), np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        rising, falling = np.maximum(q, 0), np.minimum(q, 0)
        place, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        kth, full = np.full(len(q), least, kind), np.zeros(len(q), bool)
        seen, walks, left = np.zeros(n, bool), np.ones(len(q), bool), np.arange(len(q))
        whose, own = self.own(query_ids)
        depth, step = 0, STEP
        while len(left):
            stop = min(n, depth + step)
            up, down = rising[left].any(axis=0), falling[left].any(axis=0)
            met = np.full(n, not (up.any() or down.any()))
            met[self.up[up, n - stop : n - depth]] = True
            met[self.up[down, depth:stop]] = True
            new = met & ~seen
            rows = np.flatnonzero(new)
            seen |= met
            if len(rows):
                s = self.scores(rows, typed[left])
                here = new[own] & walks[whose]
                s[np.searchsorted(left, whose[here]), np.searchsorted(rows, own[here])] = least
                cut = kth[left]
                hit = s >= cut[:, None]
                if len(rows) > k and np.count_nonzero(hit) > 8 * k * len(left):
                    cut = np.maximum(cut, np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k])
                    hit = s >= cut[:, None]
                i, j = np.divmod(np.flatnonzero(hit), len(rows))
                fine = self.ids[rows[j]] != query_ids[left[i]]
                # Of the scores at the cut, those of the k smallest ids matter.
                tie = fine & (s[i, j] == cut[i])
                before = np.append(0, np.cumsum(tie))
                fine &= ~tie | (before[:-1] - before[np.searchsorted(i, np.arange(len(left)))][i] < k)
                i, j = i[fine], j[fine]
                place, ids, scores = np.append(place, left[i]), np.append(ids, self.ids[rows[j]]), np.append(scores, s[i, j].astype(np.int64))
                order = np.lexsort((ids, -scores, place))
                order = order[np.arange(len(order)) - np.searchsorted(place[order], place[order]) < k]
                place, ids, scores = place[order], ids[order], scores[order]
                count = np.bincount(place, minlength=len(q))
                full = count == k
                kth[full] = scores[np.cumsum(count)[full] - 1]
            if stop == n or seen.all():
                break
            depth, step = stop, 2 * step
            # The most that a vector can score which no list has shown yet.
            edge = rising[left] @ self.sorted[:, n - depth] + falling[left] @ self.sorted[:, depth - 1]
            walks[left] = ~full[left] | (edge >= kth[left])
            left = np.flatnonzero(walks)
        return place, ids, scores


def _most(x: np.ndarray) -> int:
    """Largest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's vector, as views of one buffer."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    values = column.flatten().to_numpy().astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(column) else []


def _favourite(q: np.ndarray) -> np.ndarray:
    """Number of each query's strongest component, below 0 where that is negative."""
    if not q.shape[1]:
        return np.zeros(len(q), np.int64)
    strongest = np.abs(q).argmax(axis=1)
    return (strongest + 1) * np.sign(np.take_along_axis(q, strongest[:, None], axis=1)[:, 0])


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left, right):
        queries, q = left.column("vec_id").to_numpy(), _matrix(left.column("v"))
        ids, vectors = right.column("vec_id").to_numpy(), _matrix(right.column("v"))
        out = [np.zeros((3, 0), np.int64)]
        sizes, q_sizes = (np.array([len(v) for v in x], np.int64) for x in (vectors, q))
        for size in np.intersect1d(sizes, q_sizes).tolist():
            rows, own = np.flatnonzero(sizes == size), np.flatnonzero(q_sizes == size)
            lists = Lists(ids[rows], np.stack([vectors[i] for i in rows]))
            wanted = np.stack([q[i] for i in own])
            # Queries that favour the same list most walk together.
            order = np.argsort(_favourite(wanted), kind="stable")
            for at in range(0, len(order), TILE):
                tile = order[at : at + TILE]
                place, found, scores = lists.top(queries[own[tile]], wanted[tile], k)
                out.append(np.stack([queries[own[tile[place]]], found, scores]))
        return pa.table([pa.array(x) for x in np.concatenate(out, axis=1)], schema=schema)

    return run


def _extent(df: DataFrame) -> tuple[int, int]:
    """Rows, and components of the longest vector."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first())


def blocks(n: int, longest: int, m: int, q_longest: int) -> tuple[int, int]:
    """Blocks of n candidates and of m queries."""
    rows = max(BLOCK, min(n // PARTS, COMPONENTS // max(1, longest)))
    q_rows = max(QUERIES, 2 * COMPONENTS // max(1, q_longest))
    return max(1, -(-n // rows)), max(1, -(-m // q_rows))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and embedding."""

    def whole(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", v.alias("v")).distinct()

    small_batches(vectors.sparkSession, BATCH_ROWS)
    vectors, queries = whole(vectors), whole(queries)
    nb, mb = blocks(*_extent(vectors), *_extent(queries))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    a = dealt(queries, "qb", mb, "cb", nb).groupBy("qb", "cb")
    b = dealt(vectors, "cb", nb, "qb", mb).groupBy("qb", "cb")
    found = a.cogroup(b).applyInArrow(_search(k), "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_MOD == 0))


SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {QUERY_MOD} = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from pairs)
select query_id, cast(r as integer) as "rank", vec_id, score from ranked where r <= {K}
"""
