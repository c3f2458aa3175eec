"""LM scoring by prediction by partial matching.

Training gathers, over all training documents, how often each byte follows
each context of ORDER bytes.  They form a byte-context trie; a shorter context
counts a byte once for each longer context that has it (update exclusion).
Escapes are estimated by a discount: in a context of n counts and q distinct
bytes a byte counted c times has (c - D) / n, the escape D * q / n; after an
escape the longer context's bytes are excluded from the shorter one's counts.  Below the empty context all
bytes that it lacks are alike.  A document's score is the log10 probability of
its lower-cased bytes and an end mark.

The base is a unigram model of words with add-one smoothing over the same
training rows.  Word counts grow with the corpus and are never broadcast: each
block of documents asks for the counts of its own words.

Contexts grow with the corpus too, and none is left out.  Each block of
documents asks for its own (context, byte) pairs, with their counts in its
training rows; the pairs are dealt to buckets by their last LOW + 1 bytes of
context, so a bucket has all counts of its contexts and of their shorter ones,
down to LOW + 1 bytes, and sends each block the code lengths it asked for.  Only
contexts of up to LOW bytes are broadcast: a table bounded by the number of
byte strings of LOW + 1 bytes, not by the corpus.  Words are dealt to buckets by
their hash and answered with their totals in the same pass.  What is shuffled
are packed runs of sorted pairs and words, not a row for each of them.

Defined cases: null texts are empty, an empty text is the end mark alone; a
null doc_id is held out of training; rows that repeat train and score each;
very long texts are scored whole, in slices; no training rows: every byte has
the same probability, the base is that of an empty vocabulary; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASHER, U64, Hasher, block_of, drop_saved, freed, long_array, mix, n_blocks, once, saved, settle, slices, small_batches, table, with_lookups, word_slices

ORDER = 6
LOW = 2
D = 0.3
BLOCK_BYTES = 16 << 20
#: Bytes that UTF-8 never holds stand for a text's start and end.
START, END = 0xFE, 0xFF
#: (context, byte) pairs a row of the scratch tables holds at most, and pairs a task holds before it writes them.
CHUNK = 1 << 13
HELD = 1 << 21
#: Buckets of pairs for each block of texts: one bucket's pairs are in a worker's memory at once.
BUCKETS = 4
#: Kinds of rows of the scratch tables.
WORDS, PAIRS, ROWS, SHORT, SUMS = range(5)
SYMBOLS = 257 - 2
#: A pair's bytes, and blocks that a mark above them tells apart.
PAIR = U64((1 << 8 * (ORDER + 1)) - 1)
MARKS = 1 << min(16, 64 - 8 * (ORDER + 1))


def grams(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): ORDER bytes of context and the byte that follows, for
    each byte and end mark of each row."""
    n = len(offsets) - 1
    size = np.diff(offsets) + 1
    width = ORDER + 1
    at = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(len(data) + n * width, START, dtype=np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + row * width + ORDER] = hasher.lower[data]
    padded[offsets[1:] + np.arange(n) * width + ORDER] = END
    keys = np.zeros(len(padded) - ORDER, dtype=U64)
    for j in range(width):
        keys <<= U64(8)
        keys |= padded[j : len(keys) + j]
    keep = np.ones(len(keys), dtype=bool)
    begins = offsets[1:-1] + np.arange(1, n) * width
    keep[(begins[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return keys[keep], at


def pack(values: np.ndarray) -> bytes:
    """Values by byte planes, compressed: sorted pairs and few distinct counts take little disk."""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _firsts(keys)
    sums = np.cumsum(counts[order])[np.append(first[1:], len(keys)) - 1]
    return keys[first], np.diff(sums, prepend=0)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _merged(held: tuple[np.ndarray, np.ndarray], raw: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """held, and the keys of raw: those of its first list count, those of its second are only there."""
    parts = [held]
    for kind, some in enumerate(raw):
        keys = np.sort(np.concatenate(some)) if some else np.zeros(0, U64)
        first = _firsts(keys)
        parts.append((keys[first], np.diff(np.append(first, len(keys))) * (1 - kind)))
    return _summed(*(np.concatenate(x) for x in zip(*parts)))


def _none() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, U64), np.zeros(0, np.int64)


def _counts(buckets: int, word_buckets: int = 1):
    """Rows (kind, block, key, k, keys, counts): kind WORDS words of a block, by
    bucket (key, from `buckets` on), with occurrences in training rows; kind
    PAIRS pairs of a block, by bucket (key), with theirs; kind ROWS the number of
    training rows; kind SHORT trained pairs of LOW + 1 bytes of context."""
    names = ["kind", "block", "key", "k", "keys", "counts"]

    def out(kind, block, key, k, keys=None, counts=None):
        n = len(block)
        wide = [pa.array(x, pa.binary()) if x is not None else pa.nulls(n, pa.binary()) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(block, pa.int32()), long_array(key), pa.array(k, pa.int64()), *wide], names)

    def packed(kind, block, bucket, keys, counts):
        """Rows of a block's keys, in order of their buckets."""
        first = _firsts(bucket)
        cuts = [(a, min(a + CHUNK, j)) for i, j in zip(first, np.append(first[1:], len(bucket))) for a in range(i, j, CHUNK)]
        for some in (cuts[i : i + 200] for i in range(0, len(cuts), 200)):
            at = np.array([a for a, _ in some])
            yield out(kind, np.full(len(some), block, np.int32), bucket[at].astype(np.int64), np.array([b - a for a, b in some]), [pack(keys[a:b]) for a, b in some], [pack(counts[a:b]) for a, b in some])

    def run(batches):
        hasher = once(HASHER, Hasher)
        rows = 0
        # Words by block: raw ones, and distinct ones with their counts.
        words, n_words, n_distinct = {}, 0, 0
        # Pairs carry their block's place in `places` above their bytes.
        places, raw, n_raw, held = {}, [[], []], 0, _none()

        def gather_words():
            nonlocal n_words, n_distinct
            for of_block in words.values():
                of_block[:] = [[], []], _merged(of_block[1], of_block[0])
            n_words, n_distinct = 0, sum(len(x[1][0]) for x in words.values())

        def word_rows():
            nonlocal words, n_distinct
            for block, (_, (keys, counts)) in words.items():
                yield from packed(WORDS, block, _word_bucket(keys, word_buckets) + buckets, keys, counts.astype(np.uint32))
            words, n_distinct = {}, 0

        def gather():
            nonlocal raw, n_raw, held
            held = _merged(held, raw)
            raw, n_raw = [[], []], 0

        def context_rows():
            nonlocal held, places
            keys, counts = held
            trained = np.unique(keys[counts > 0] & U64((1 << 8 * (LOW + 2)) - 1))
            yield out(SHORT, np.full(len(trained), -1, np.int32), trained, np.ones(len(trained), np.int64))
            numbers = np.array(list(places), np.int32)
            ends = np.searchsorted(keys, np.arange(1, len(numbers), dtype=U64) << U64(8 * (ORDER + 1)))
            for block, keys, counts in zip(numbers, np.split(keys & PAIR, ends), np.split(counts, ends)):
                bucket = _bucket(keys, buckets)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                yield from packed(PAIRS, block, bucket[order], keys[order], counts[order].astype(np.uint32))
            held, places = _none(), {}

        for batch in batches:
            block, out_of = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2)
            rows += int((~out_of).sum())
            for b in np.unique(block):
                if b not in places and len(places) == MARKS:
                    gather()
                    yield from context_rows()
                mark = U64(places.setdefault(b, len(places))) << U64(8 * (ORDER + 1))
                for kind, mine in enumerate(((block == b) & ~out_of, (block == b) & out_of)):
                    if not mine.any():
                        continue
                    some = texts.filter(pa.array(mine))
                    for _, _, _, _, _, hashes, _ in word_slices(hasher, some):
                        words.setdefault(b, [[[], []], _none()])[0][kind].append(hashes)
                        n_words += len(hashes)
                        if n_words > HELD // 2:
                            gather_words()
                            if n_distinct > HELD // 2:
                                yield from word_rows()
                    for _, _, data, offsets in slices(some):
                        raw[kind].append(grams(hasher, data, offsets)[0] | mark)
                        n_raw += len(raw[kind][-1])
                        if n_raw > HELD // 2:
                            gather()
            if len(held[0]) > HELD:
                gather()
                yield from context_rows()
        gather_words()
        yield from word_rows()
        gather()
        if len(held[0]):
            yield from context_rows()
        yield out(ROWS, np.array([-1], np.int32), np.zeros(1, np.int64), np.array([rows]))

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs that share the last LOW + 1 bytes of context share a bucket."""
    return (mix((keys >> U64(8)) & U64((1 << 8 * (LOW + 1)) - 1)) % U64(buckets)).astype(np.int64)


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted words are in order of theirs."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _answers(low, buckets: int):
    """Rows (kind, block, k, keys, found): for the blocks that asked, code lengths
    of each bucket's pairs and totals of each bucket's words; kind SUMS has a word
    bucket's distinct trained words (block -1) and their occurrences (block -2) in k."""
    names = ["kind", "block", "k", "keys", "found"]

    def out(kind, block, k, keys, found):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(block), pa.int32()), pa.array(block, pa.int32()), pa.array(k, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names)

    def of_bucket(bucket, parts, base):
        keys = np.concatenate([unpack(x, k, U64) for _, k, x, _ in parts])
        counts = np.concatenate([unpack(x, k, np.uint32) for _, k, _, x in parts]).astype(np.int64)
        asked, counts = _summed(keys, counts)
        trained = counts > 0
        if bucket < buckets:
            kind, trie = PAIRS, Trie(asked[trained], counts[trained], base)
            found = np.concatenate([trie.code(asked[i : i + HELD]) for i in range(0, len(asked), HELD)]).astype(np.float32)
        else:
            kind, found = WORDS, counts
            yield out(SUMS, [-1, -2], [int(trained.sum()), int(counts.sum())], [None] * 2, [None] * 2)
        ends = np.cumsum([k for _, k, _, _ in parts])
        for i in range(0, len(parts), 100):
            some = parts[i : i + 100]
            theirs = [pack(found[np.searchsorted(asked, keys[end - k : end])]) for (_, k, _, _), end in zip(some, ends[i : i + 100])]
            yield out(kind, [b for b, _, _, _ in some], [k for _, k, _, _ in some], [x for _, _, x, _ in some], theirs)

    def run(batches):
        now, parts, base = None, [], Trie(*low.value, top=LOW)
        for batch in batches:
            for bucket, block, k, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket != now and parts:
                    yield from of_bucket(now, parts, base)
                    parts = []
                now = bucket
                parts.append((block, k, keys, counts))
        if parts:
            yield from of_bucket(now, parts, base)

    return run


class Trie:
    """Code lengths of the byte-context trie, by arrays sorted by key.

    With `low`, a trie of contexts of up to LOW bytes, the keys are all that
    share some last LOW + 1 bytes of context, and shorter contexts are low's.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: Trie | None = None, top: int = ORDER) -> None:
        none = [None] * (top + 1)
        self.top, self.keys, self.counts, self.contexts, self.n, self.q, self.excluded = top, *(list(none) for _ in range(6))
        base = 0
        if low is not None:
            base = low.top + 1
            for mine, theirs in zip((self.keys, self.counts, self.contexts, self.n, self.q, self.excluded), (low.keys, low.counts, low.contexts, low.n, low.q, low.excluded)):
                mine[:base] = theirs
        for k in range(top, base - 1, -1):
            mask = U64((1 << (8 * (k + 1))) - 1)
            short = keys & mask
            order = np.argsort(short, kind="stable")
            short, c = short[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
            keys, counts = short[first], c if k == top else np.diff(np.append(first, len(short)))
            self.keys[k], self.counts[k] = keys, counts
        for k in range(base, top + 1):
            context = self.keys[k] >> U64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
            self.contexts[k] = context[first]
            self.n[k] = np.add.reduceat(self.counts[k], first) if len(first) else np.zeros(0, np.int64)
            self.q[k] = np.diff(np.append(first, len(context)))
            # What this context's bytes count in the next shorter one.
            if k and len(first):
                shorter = self.counts[k - 1][np.searchsorted(self.keys[k - 1], self.keys[k] & U64((1 << (8 * k)) - 1))]
                self.excluded[k] = np.add.reduceat(shorter, first)

    def code(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context, for distinct keys."""
        out = np.empty(len(keys))
        hit = np.zeros(len(keys), dtype=bool)
        longest = self.keys[self.top]
        if len(longest):
            at = np.minimum(np.searchsorted(longest, keys), len(longest) - 1)
            hit = longest[at] == keys
            at = at[hit]
            out[hit] = np.log10((self.counts[self.top][at] - D) / self.n[self.top][np.searchsorted(self.contexts[self.top], keys[hit] >> U64(8))])
        out[~hit] = self.escaped(keys[~hit])
        return out

    def escaped(self, keys: np.ndarray) -> np.ndarray:
        total = np.zeros(len(keys))
        open_ = np.ones(len(keys), dtype=bool)
        gone = np.zeros(len(keys))  # counts and bytes that the longer context excludes
        gone_q = np.zeros(len(keys))
        for k in range(self.top, -1, -1):
            if not len(self.contexts[k]):
                continue
            low = keys & U64((1 << (8 * (k + 1))) - 1)
            place = np.minimum(np.searchsorted(self.contexts[k], low >> U64(8)), len(self.contexts[k]) - 1)
            there = open_ & (self.contexts[k][place] == low >> U64(8))
            n, q = self.n[k][place] - gone, self.q[k][place] - gone_q
            at = np.minimum(np.searchsorted(self.keys[k], low), len(self.keys[k]) - 1)
            hit = there & (self.keys[k][at] == low)
            with np.errstate(divide="ignore", invalid="ignore"):
                total = np.where(hit, total + np.log10((self.counts[k][at] - D) / n), total)
                total = np.where(there & ~hit & (q > 0), total + np.log10(D * q / n), total)
            open_ &= ~hit
            if k:
                gone = np.where(there, self.excluded[k][place] if self.excluded[k] is not None else 0, 0)
                gone_q = np.where(there, self.q[k][place], 0)
        known = int(self.q[0][0]) if len(self.q[0]) else 0
        return np.where(open_, total - np.log10(max(1, SYMBOLS - known)), total)


class Lookup:
    """A hash table from a block's keys to 8-byte values; every key that is asked for must be in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(len(keys) * 3 // 2).bit_length())
        self.shift, self.kind = U64(64 - bits), values.dtype
        # A slot's key plus one (0: free) beside its value: a probe touches one place in memory.
        self.slot = np.zeros((1 << bits, 2), dtype=U64)
        key, value = self.slot.T
        left, wanted = np.arange(len(keys)), values.view(U64)
        self.probes = 0
        while len(left) and self.probes < 12:
            slot, mine = self.slots(keys[left], self.probes), keys[left] + U64(1)
            free = key[slot] == 0
            key[slot[free]] = mine[free]
            won = key[slot] == mine
            value[slot[won]] = wanted[left[won]]
            left = left[~won]
            self.probes += 1
        order = np.argsort(keys[left])
        self.rest, self.rest_values = keys[left][order], values[left][order]

    def slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15 + 2 * probe * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), self.kind)
        # Parts whose arrays stay in a core's cache.
        for i in range(0, len(keys), 1 << 14):
            self._get(keys[i : i + (1 << 14)], out[i : i + (1 << 14)])
        return out

    def _get(self, keys: np.ndarray, out: np.ndarray) -> None:
        left = None
        for probe in range(self.probes):
            there = self.slot.take(self.slots(keys, probe), axis=0)
            values, hit = there[:, 1].view(self.kind), there[:, 0] == keys + U64(1)
            if left is None:
                out[:] = values
                left = np.flatnonzero(~hit)
                keys = keys[left]
            else:
                out[left[hit]] = values[hit]
                left, keys = left[~hit], keys[~hit]
            if not len(left):
                return
        if left is not None:
            out[left] = self.rest_values[np.searchsorted(self.rest, keys)]


def _score(ends: int, train_tokens: int, vocabulary: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(lookups, batches):
        hasher = once(HASHER, Hasher)

        def of_kind(kind, value):
            some = lookups.filter(pc.equal(lookups.column("kind"), kind))
            return [np.concatenate([np.zeros(0, of), *(unpack(x.as_py(), k.as_py(), of) for k, x in zip(some.column("k"), some.column(c)))]) for c, of in (("keys", U64), ("found", value))]

        words = Lookup(*of_kind(WORDS, np.int64))
        keys, codes = of_kind(PAIRS, np.float32)
        pairs = Lookup(keys, codes.astype(np.float64))
        del lookups, keys, codes
        for batch in batches:
            texts = batch.column(2)
            n = batch.num_rows
            n_tokens, n_known, logs, scores = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for first, m, _, _, _, hashes, at in word_slices(hasher, texts):
                c = words.get(hashes)
                for into, values in ((logs, np.log10(c + 1)), (n_known, (c > 0).astype(np.int64))):
                    total = np.concatenate([[0], np.cumsum(values)])
                    into[first : first + m] = total[at[1:]] - total[at[:-1]]
                n_tokens[first : first + m] = np.diff(at) + 1
            for first, m, data, offsets in slices(texts):
                keys, at = grams(hasher, data, offsets)
                total = np.concatenate([[0.0], np.cumsum(pairs.get(keys))])
                scores[first : first + m] = total[at[1:]] - total[at[:-1]]
            base = logs + np.log10(ends + 1) - n_tokens * np.log10(train_tokens + vocabulary + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(n_known + (ends > 0)), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(scores)], names)

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of docs (doc_id, text); held_out: a column of rows that don't train."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    blocks = n_blocks(docs, BLOCK_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select(block_of("doc_id", blocks).alias("block"), "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "text")
    buckets = BUCKETS * blocks
    parts = saved(rows.select("block", "held_out", "text").repartitionById(blocks, "block").mapInArrow(freed(_counts(buckets, blocks)), "kind int, block int, key long, k long, keys binary, counts binary"))
    ends = parts.where(F.col("kind") == ROWS).agg(F.sum("k").alias("n")).first()["n"] or 0
    short = parts.where(F.col("kind") == SHORT).select("key").distinct().groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1)).alias("key")).agg(F.count("*").alias("k")).toArrow()
    # Plain arrays: what is broadcast must not need this package to be read.
    low = spark.sparkContext.broadcast((short.column("key").to_numpy().view(U64), short.column("k").to_numpy()))
    asked = parts.where(F.col("kind").isin(WORDS, PAIRS)).select(F.col("key").cast("int").alias("bucket"), "block", "k", "keys", "counts")
    answers = saved(asked.repartitionById(buckets + blocks, "bucket").sortWithinPartitions("bucket").mapInArrow(freed(_answers(low, buckets)), "kind int, block int, k long, keys binary, found binary"))
    low.destroy()
    drop_saved(parts)
    seen = answers.where(F.col("kind") == SUMS).agg(*(F.coalesce(F.sum(F.when(F.col("block") == b, F.col("k"))), F.lit(0)).alias(c) for b, c in ((-1, "v"), (-2, "n")))).first()
    lookups = answers.where(F.col("kind") != SUMS).select("block", "kind", "k", "keys", "found")
    out = saved(with_lookups(rows, lookups, blocks, freed(_score(ends, seen["n"] + ends, seen["v"] + (ends > 0))), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    drop_saved(answers)
    settle(spark)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
