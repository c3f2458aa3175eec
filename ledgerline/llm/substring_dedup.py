"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 lower-cased bytes marks a cut after a
word when its low bits are zero; line ends cut too.  Cuts follow from content,
so an insertion moves only the chunks beside it.  A chunk's digest is the hash
of its words.  The first occurrence of a digest (least doc_id, then place)
stays; others are repeats, and a run of neighbouring repeats of at least
`min_words` words is removed from its text, which otherwise stays byte for
byte.  Shorter runs are phrases that recur by chance and stay.

Each part of the input gives one row per digest and block of documents.  A
digest's count and first occurrence are an aggregate of these, and the blocks
that hold it are joined to them, so a chunk that a third of all documents hold
is pre-aggregated, and its blocks are split over tasks by the skew join.

Defined cases: null text: null out, no chunks; empty text: empty; very long
texts are cut whole; a null doc_id counts as a document of the id -1 for the
order of occurrences; rows that repeat a doc_id are one document to the order,
each keeps what that document keeps; an empty table gives no rows; extra
columns pass through, but for n_words, n_removed, n_chunks and n_repeats, which
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASHER, U64, Hasher, block_of, long_array, mix, n_blocks, once, slices, small_batches, table, with_lookups

#: A cut comes after one word in so many, on average.
MEAN_WORDS = 4
#: Bytes that the rolling hash sees.
PAD = 16
#: Words of a run of repeated chunks from which it is removed.
MIN_WORDS = 30
BLOCK_BYTES = 16 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash h = (h << 1) + G[byte] of the last 16 bytes, by doubling."""
    table_ = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)
    h = table_[data]
    w = 1
    while w < PAD:
        new = h.copy()
        new[w:] += h[:-w] << np.uint32(w)
        h = new
        w *= 2
    return h


def chunks(hasher: Hasher, texts: pa.Array):
    """For each slice: (first row, rows, row offsets, word starts, word ends,
    first word of each row, first word of each chunk, chunk digests).  Offsets
    are in the slice's bytes.  A chunk never spans rows."""
    for first, n, data, offsets in slices(texts):
        low = hasher.lower[data]
        # A window of line ends before each row: cuts do not depend on the row before.
        padded = np.full(len(low) + n * PAD, 0x0A, dtype=np.uint8)
        padded[np.arange(len(low)) + np.repeat(np.arange(1, n + 1), np.diff(offsets)) * PAD] = low
        rows = offsets + np.arange(n + 1) * PAD
        start, end, words = hasher.words(padded)
        at = np.searchsorted(start, rows)
        if len(start):
            marks = gear(padded)[end - 1]
            # The low bits of a gear hash see few bytes; bits 12 to 15 see 13 and more.
            cut = ((marks >> np.uint32(12)) & np.uint32(MEAN_WORDS - 1)) == 0
            lines = np.cumsum(padded == 0x0A)
            cut[:-1] |= lines[start[1:]] > lines[end[:-1] - 1]
            begin = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
            begin = np.unique(np.concatenate([begin, at[:-1][at[:-1] < len(start)]]))
            digests = hasher.fold(words, begin)
        else:
            begin, digests = np.zeros(0, np.int64), np.zeros(0, U64)
        shift = np.repeat(np.arange(1, n + 1), np.diff(at)) * PAD
        yield first, n, offsets, start - shift, end - shift, at, begin, digests


def _firsts(blocks: int):
    """A row for each digest and block that a part of the input holds."""

    def run(batches):
        hasher = once(HASHER, Hasher)
        held, size = [], 0

        def out():
            block, h, doc, place, k = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, doc, h, block))
            block, h, doc, place, k = block[order], h[order], doc[order], place[order], k[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (block[1:] != block[:-1])]))
            return pa.RecordBatch.from_arrays([pa.array(block[first]), long_array(h[first]), pa.array(doc[first]), pa.array(place[first]), pa.array(np.add.reduceat(k, first).astype(np.int32))], ["block", "h", "doc", "place", "k"])

        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            block_ids = batch.column(1).to_numpy()
            for first, n, _, _, _, at, begin, digests in chunks(hasher, batch.column(2)):
                row = np.searchsorted(at, begin, "right") - 1
                held.append((block_ids[first + row], digests, ids[first + row], (begin - at[row]).astype(np.int32), np.ones(len(begin), np.int32)))
                size += len(begin)
                if size > 1 << 19:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _cut(columns: list[str], min_words: int):
    t, d = columns.index("text"), columns.index("doc_id")

    def run(lookups, batches):
        hasher = once(HASHER, Hasher)
        if lookups is None:
            known, doc, place = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        else:
            known = lookups.column("h").to_numpy().view(U64)
            order = np.argsort(known)
            known, doc, place = known[order], lookups.column("doc").to_numpy()[order], lookups.column("place").to_numpy()[order]
        for batch in batches:
            texts = batch.column(t)
            raw = texts.cast(pa.large_binary())
            ids = batch.column(d).fill_null(-1).to_numpy()
            out = raw.to_pylist()
            n_chunks, n_repeats, n_words, n_removed = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            for first, n, offsets, start, end, at, begin, digests in chunks(hasher, texts):
                if not len(begin):
                    continue
                row = np.searchsorted(at, begin, "right") - 1
                j = np.minimum(np.searchsorted(known, digests), max(len(known) - 1, 0))
                repeat = np.zeros(len(begin), dtype=bool)
                if len(known):
                    repeat = (known[j] == digests) & ~((doc[j] == ids[first + row]) & (place[j] == begin - at[row]))
                words = np.diff(np.append(begin, len(start)))
                # Runs of neighbouring repeats within a row.
                edge = np.concatenate([[True], (repeat[1:] != repeat[:-1]) | (row[1:] != row[:-1])])
                runs = np.flatnonzero(edge)
                run_words = np.add.reduceat(words, runs)
                cut = repeat[runs] & (run_words >= min_words)
                np.add.at(n_chunks, first + row, 1)
                np.add.at(n_repeats, first + row, repeat)
                np.add.at(n_words, first + row, words)
                last = np.append(runs[1:], len(begin)) - 1
                stretches: dict[int, list[tuple[int, int]]] = {}
                for r, l, w in zip(runs[cut].tolist(), last[cut].tolist(), run_words[cut].tolist()):
                    i = int(row[r])
                    lo = start[begin[r]]
                    after = begin[l + 1] if l + 1 < len(begin) else len(start)
                    # Up to the next word, so that no white space is left double.
                    hi = start[after] if after < at[i + 1] else end[after - 1]
                    stretches.setdefault(i, []).append((int(lo - offsets[i]), int(hi - offsets[i])))
                    n_removed[first + i] += w
                for i, gone in stretches.items():
                    whole, kept, p = out[first + i], [], 0
                    for lo, hi in gone:
                        kept.append(whole[p:lo])
                        p = hi
                    kept.append(whole[p:])
                    out[first + i] = b"".join(kept)
            text = pa.array(out, pa.large_binary()).cast(pa.string())
            done = [text if i == t else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*done, *(pa.array(x) for x in (n_words, n_removed, n_chunks, n_repeats))], [*columns, "n_words", "n_removed", "n_chunks", "n_repeats"])

    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeats removed from text, and n_words (before), n_removed
    (words), n_chunks, n_repeats (chunks that occur earlier)."""
    small_batches(docs.sparkSession)
    blocks = n_blocks(docs, BLOCK_BYTES)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "n_chunks", "n_repeats")]
    block = block_of("doc_id", blocks).alias("_block_")
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), block, "text").mapInArrow(_firsts(blocks), "block int, h long, doc long, place int, k int")
    totals = firsts.groupBy("h").agg(F.sum("k").alias("k"), F.min(F.struct("doc", "place")).alias("first")).where("k > 1")
    lookups = firsts.select(F.col("block").alias("_block_"), "h").join(totals, "h").select("_block_", "h", "first.doc", "first.place")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return with_lookups(docs.select(block, *columns), lookups, blocks, _cut(columns, min_words), f"{fields}, n_words long, n_removed long, n_chunks long, n_repeats long", "_block_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs)
