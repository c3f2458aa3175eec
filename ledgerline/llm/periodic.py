"""Periodic runs: every maximal stretch of words that repeats with a period.

A run is a stretch of consecutive words of smallest period q (words q apart are
identical) and of a least length and exponent (length over period) that no
neighbouring word extends.  All texts of a slice are worked on at once, as one
sequence whose symbols are (row, word), with an end of its own to each row:

1. The suffix array by doubling, of which only suffixes that are not yet told
   apart are sorted again; the names of factors of 1, 2, 4, .. words stay, and
   give the length that two places have in common in a step a level, forward
   and backward.  Neighbours in the suffix array have their LCP from it.
2. The longest previous factor of each place: the nearest earlier places above
   and below it in the suffix array, by pointer jumping, with the least LCP on
   the way.  It cuts each row into LZ blocks.
3. Main's extensions: a run that touches a border of blocks has a period that
   the lengths of the blocks beside it bound, so each border is tried with each
   such period: what is in common forward and backward from there is the run.
4. A run within a block is the copy of an earlier one.  Runs are in buckets by
   their last word; each block, from left to right, takes those of its source.

A row without a factor that repeats as long as a run needs (its length less a
period) has no run and ends at step 1.

Defined cases: a null or empty text has no words and no runs; words are runs of
characters other than space and U+0009 to U+000D, in their case; very long
texts are worked on whole, a task's memory follows the longest; rows that
repeat are done each; an empty table gives no rows; kept columns may have any
name but n_words, runs and collapsed, which are made.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, slices, small_batches, table

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Pairs of a border and a period that are extended at once.
PAIRS = 1 << 20
MADE = ["n_words", "runs", "collapsed"]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


# --- the suffix array and what places have in common ------------------------------


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the names of factors of 2 ** k symbols at each place.

    A name is the first place of its class in the order of suffixes.  The last
    symbol must occur once.  Only levels at which two places share a name are given."""
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(symbols[order]) != 0]))
    sizes = np.diff(np.append(first, len(order)))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.repeat(first, sizes)
    open_ = order[np.repeat(sizes > 1, sizes)]
    levels, step = [], 1
    while len(open_):
        levels.append(rank)
        # All that share a name are next to each other, in the order of their names.
        key = rank[open_].astype(np.int64) * (len(rank) + 1) + rank[open_ + step]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(key) != 0]), at, 0))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(old) != 0]), at, 0))
        new = old + head - group
        rank = rank.copy()
        rank[open_] = new
        first = np.flatnonzero(head == at)
        sizes = np.diff(np.append(first, len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
    suffixes = np.empty(len(rank), dtype=np.int64)
    suffixes[rank] = np.arange(len(rank))
    return suffixes, levels


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols are the same from i and from j on; i differs from j."""
    n = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += (levels[k][i + n] == levels[k][j + n]).astype(np.int64) << k
    return n


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols are the same up to i and up to j, both included; i < j."""
    n = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - n - (1 << k) + 1, j - n - (1 << k) + 1
        n += ((a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][b])).astype(np.int64) << k
    return n


def nearest_earlier(suffixes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, common) of the nearest suffix before each one in the array that
    starts earlier; common: what each has in common with the one before it."""
    before, low = np.arange(-1, len(suffixes) - 1), common.copy()
    at = np.arange(len(suffixes))
    while True:
        # All between a suffix and `before` start later; so do those that it steps over.
        at = at[(before[at] >= 0) & (low[at] > 0)]
        at = at[suffixes[before[at]] > suffixes[at]]
        if not len(at):
            break
        there = before[at]
        low[at], before[at] = np.minimum(low[at], low[there]), before[there]
    return np.where(before >= 0, suffixes[before], -1), np.where(before >= 0, low, 0)


def longest_previous(suffixes: np.ndarray, levels: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of each place of `suffixes`, and where it is."""
    common = np.zeros(len(suffixes) + 1, dtype=np.int64)
    common[1:-1] = forward(levels, suffixes[:-1], suffixes[1:])
    up, up_n = nearest_earlier(suffixes, common[:-1])
    down, down_n = (x[::-1] for x in nearest_earlier(suffixes[::-1], common[:0:-1]))
    longest, source = np.zeros(size, dtype=np.int64), np.full(size, -1)
    longest[suffixes] = np.maximum(up_n, down_n)
    source[suffixes] = np.where(up_n >= down_n, up, down)
    return longest, source


# --- runs -------------------------------------------------------------------------


def blocks_of(begin: int, end: int, longest: np.ndarray) -> list[int]:
    """Starts of the LZ blocks of a row, and its end."""
    out, lengths, at = [], longest[begin:end].tolist(), 0
    while at < end - begin:
        out.append(begin + at)
        at += lengths[at] or 1
    return [*out, end]


def _pairs(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, 1 .. counts[index]) of all, about PAIRS at a time."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + PAIRS, "right")) - 1)
        which = np.repeat(np.arange(i, j), counts[i:j])
        yield which, np.arange(sums[j] - sums[i]) - (sums[which] - sums[i]) + 1
        i = j


def at_borders(levels: list[np.ndarray], borders: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(start, end, period) of runs that touch a border of blocks of lengths left and right."""
    found = []

    def take(c, i, j, p):
        """What i and j = i + p have in common, forward from there and backward before."""
        some = (levels[0][i] == levels[0][j]) | (levels[0][i - 1] == levels[0][j - 1])
        c, i, j, p = c[some], i[some], j[some], p[some]
        ahead, behind = forward(levels, i, j), backward(levels, i - 1, j - 1)
        length = ahead + behind + p
        good = length >= np.maximum(least, exponent * p)
        found.append(np.stack([i[good] - behind[good], j[good] + ahead[good], p[good]], axis=1))

    # A period's length or more of the run is right of the border ..
    for which, p in _pairs(right):
        take(which, borders[which], borders[which] + p, p)
    # .. or less: then the block on the left, which has no longer source, bounds the period.
    for which, p in _pairs((left + right) // (exponent - 1)):
        c = borders[which]
        inside = c - p > 0
        which, p, c = which[inside], p[inside], c[inside]
        take(which, c - p, c, p)
    runs = np.concatenate(found)
    # Of the periods of one stretch the smallest is the run's.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])] if len(runs) else runs


def runs_of(symbols: np.ndarray, rows: list[tuple[int, int]], least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) by start and period of each row that has runs.

    rows: (begin, end) of each in symbols, where an end that occurs nowhere else
    follows each; rows must have no symbol in common."""
    suffixes, levels = suffix_levels(symbols)
    # A run's first length - period symbols occur again a period later.
    need = max(least - least // exponent, 1)
    depth = need.bit_length() - 1
    if len(levels) <= depth:
        return {}
    share = np.bincount(levels[depth], minlength=len(symbols))[levels[depth]] > 1
    row_of = np.repeat(np.arange(len(rows)), [end - begin + 1 for begin, end in rows])
    live = np.zeros(len(rows), dtype=bool)
    live[row_of[share]] = True
    longest, source = longest_previous(suffixes[live[row_of[suffixes]]], levels, len(symbols))
    borders, left, right, cut = [], [], [], {}
    for r in np.flatnonzero(live).tolist():
        begin, end = rows[r]
        cut[r] = starts = np.array(blocks_of(begin, end, longest))
        sizes = np.diff(starts)
        borders.append(starts[1:])
        left.append(sizes)
        right.append(np.append(sizes[1:], 0))
    touching = at_borders(levels, *map(np.concatenate, (borders, left, right)), least, exponent)
    by_row: dict[int, list] = defaultdict(list)
    for run in touching.tolist():
        by_row[int(row_of[run[0]])].append(run)
    out = {}
    for r, runs in by_row.items():
        begin, starts = rows[r][0], cut[r].tolist()
        buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for b, e, p in runs:
            buckets[e - 1].append((b, p))
        for s, t in zip(starts, starts[1:]):
            if t - s < least + 2:
                continue
            back = s - int(source[s])
            for last in range(s + least, t - 1):
                if last - back in buckets:
                    buckets[last] += [(b + back, p) for b, p in buckets[last - back] if b + back > s]
        out[r] = sorted((b - begin, last + 1 - b, p) for last, held in buckets.items() for b, p in held)
        out[r].sort(key=lambda x: (x[0], x[2]))
    return out


# --- texts ------------------------------------------------------------------------


def periodic_slice(data: np.ndarray, offsets: np.ndarray, least: int, exponent: int) -> pa.RecordBatch:
    """n_words, runs and collapsed of the texts of a slice."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n, 0x20, dtype=np.uint8)  # a space after each row
    padded[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    begins = offsets + np.arange(n + 1)
    gap = SPACE[padded]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, begins)
    counts = np.diff(first)
    # Words' numbers are those of equal bytes.
    places = pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, places, pa.py_buffer(padded[~gap])]).dictionary_encode()
    number, kinds = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    row_of = np.repeat(np.arange(n), counts)
    symbols = np.full(len(start) + n, -1, dtype=np.int64)
    symbols[np.arange(len(start)) + row_of] = row_of * (kinds + 1) + number
    symbols[np.cumsum(counts + 1) - 1] = np.arange(n) * (kinds + 1) + kinds
    at = (first[:-1] + np.arange(n)).tolist()
    runs = runs_of(symbols, [(a, a + c) for a, c in zip(at, counts.tolist())], least, exponent) if len(start) else {}
    # What stays of the bytes: words that are kept, and a space after each.
    keep = ~gap
    keep[end] = True
    padded[end] = 0x20
    for r, found in runs.items():
        for b, length, p in found:
            lo, hi = first[r] + b + p, first[r] + b + length - 1
            keep[start[lo] : end[hi] + 1] = False
    total = np.concatenate([[0], np.cumsum(keep)])[begins]
    keep[np.flatnonzero(keep)[total[1:][np.diff(total) > 0] - 1]] = False  # a row's last space
    total = np.concatenate([[0], np.cumsum(keep)])[begins]
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(padded[keep])])
    flat = [np.array(runs[r], dtype=np.int64) for r in sorted(runs)]
    sizes = np.zeros(n + 1, dtype=np.int32)
    for r in runs:
        sizes[r + 1] = len(runs[r])
    table_ = np.concatenate(flat) if flat else np.zeros((0, 3), dtype=np.int64)
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table_[:, i])) for i in range(3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays([pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), spans), text.cast(pa.string())], MADE)


def periodic_runs(docs: DataFrame, keep: list[str], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """keep, n_words, runs and collapsed of each row's text.

    runs: start (words from 0), length and period of each run, by start and
    period; collapsed: the words that no run holds after its first period,
    joined by a space.  min_exponent: 2 or more."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run is two periods long at least")
    small_batches(docs.sparkSession, 500)
    keep = [c for c in keep if c not in MADE]
    rows = docs.select(F.col("text").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(0)):
                made = periodic_slice(data, offsets, min_length, min_exponent)
                kept = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*(kept.column(i + 1) for i in range(len(keep))), *made.columns], [*keep, *MADE])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""
    return rows.mapInArrow(freed(run), fields + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """text, or for a tenth of the ids one whose end repeats a stretch of it."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.greatest(F.size(words).cast("long"), F.lit(1))  # no element is made where there are no words
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def most_periodic(runs: Column) -> Column:
    """Of runs by start and period the first of the greatest exponent, exactly."""

    def more(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most_periodic(F.col("runs")).alias("_most"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    most = F.col("_most")
    return out.select("doc_id", "n_runs", *(most[c].alias(c) for c in ("start", "length", "period")), F.floor(1000 * most["length"] / most["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
