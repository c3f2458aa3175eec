"""N-gram Jaccard join with signature trees.

Documents are sets of distinct 5-word shingles; two link when the Jaccard
similarity of their sets is at least 0.75.  Steps:

1. Equal sets become one class (digest of 64 bits), with its least known doc_id.
2. Each class is dealt to the buckets of its rarest shingles.  Two classes
   that link share one of them whatever order is used, as long as it is the
   same for all, so heavy shingles come last: a passage that a third of all
   documents share makes no bucket unless it is most of a document.  The first
   shingle that both have stands among the first seventh of the smaller set
   (its strong places), and their sizes differ by a quarter at most: a row
   without a partner that allows it leaves its bucket.
3. Leader links: in a bucket each class is verified against the bucket's
   leader, which joins large groups of near copies in linear work.
4. Signature trees: what a bucket still holds in different components becomes
   leaves of a tree whose nodes hold OR-combined bitmaps and size ranges; a
   dual traversal drops node pairs that lie in one component, whose sizes are
   too different or whose bitmaps cannot overlap enough.  A large bucket is
   several trees, and each pair of trees is a task of its own.  Trees run
   twice.  First each tree of an eighth of the buckets gives only a forest of
   its likeliest pairs, which joins most of what links in linear work.  With
   the components that these links leave, the second run takes all buckets
   and gives every pair between different components.
5. Pairs that remain are verified on whole sets, which are made again from
   the texts of those pairs alone; components of the links.

Defined cases: no words or null text: an empty set, linked with nothing; fewer
than five words: one shingle, the whole sequence; very long texts are whole
sets like others; a null doc_id takes part like another, its component is the
least doc_id that is known; rows that repeat a doc_id and text are one class;
texts that share a doc_id are linked by their words only, not by the id; an
empty table gives no rows; extra columns are ignored, and kept by dedup.
`components` stops with an error if it has not settled after 40 rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HASHER, U64, Hasher, components, drop_saved, few, long_array, mix, once, saved, settle, small_batches, table, word_slices

WORDS = 5
#: Jaccard similarity as a fraction.
NUM, DEN = 3, 4
#: Shingles in at least so many documents are taken last; only the order depends on it.
HEAVY = 32
#: So many of the heaviest shingles are broadcast as (hash, count): 8 MB.
HEAVY_KEPT = 1 << 19
#: Members of a signature tree.
TREE = 256
LEAF = 32
#: Shingles that a task holds before it counts them.
HELD = 1 << 21
#: Rows of a bucket from which it is passed on in parts.
PART = 1 << 16
#: One in so many buckets takes part in the forests; the trees after them take all.
FOREST_ONE_IN = 8
#: Bits of a bitmap for each shingle, and of the widest one.
SHINGLE_BITS = 8
MOST_BITS = 1 << 16


#: A shingle is a hash of 54 bits: 10 more number the rows of a slice, so that
#: one sort makes all its sets.
BITS = 54


class Sets:
    """The sets of a slice's rows: tokens[starts[i]:starts[i + 1]], sorted and distinct."""

    def __init__(self, first: int, tokens: np.ndarray, starts: np.ndarray) -> None:
        self.first, self.tokens, self.starts = first, tokens, starts
        self.sizes = np.diff(starts)

    def row(self, i: int) -> np.ndarray:
        return self.tokens[self.starts[i] : self.starts[i + 1]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of values over each row."""
        total = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values, out=total[1:])
        return (total[self.starts[1:]] - total[self.starts[:-1]]).view(np.int64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(mix(self.tokens ^ U64(0x5851F42D4C957F2D))), self.sums(mix(self.tokens + U64(0x14057B7EF767814F)))


def shingle_sets(hasher: Hasher, texts: pa.Array) -> Iterator[Sets]:
    for first, n, _, _, _, words, at in word_slices(hasher, texts):
        grams = hasher.sequence(words, WORDS)
        row = np.repeat(np.arange(n), np.diff(at))
        whole = row[: len(grams)] == row[WORDS - 1 :] if len(grams) else np.zeros(0, bool)
        rows, hashes = [row[: len(grams)][whole]], [grams[whole]]
        size = np.diff(at)
        for i in np.flatnonzero((size > 0) & (size < WORDS)).tolist():
            rows.append(np.array([i]))
            hashes.append(mix(hasher.fold(words[at[i] : at[i + 1]], np.zeros(1, np.int64)) + U64(size[i])))
        keys = (np.concatenate(rows).astype(U64) << U64(BITS)) | (np.concatenate(hashes) >> U64(64 - BITS))
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        starts = np.searchsorted(keys, np.arange(n + 1, dtype=U64) << U64(BITS))
        yield Sets(first, keys & U64((1 << BITS) - 1), starts)


def prefix_size(n):
    """So many of a set's first shingles meet those of any set it links with."""
    return n - -(-NUM * n // DEN) + 1


def strong_size(n):
    """So many of a set's first shingles meet those of any larger set it links with."""
    return n - -(-2 * NUM * n // (NUM + DEN)) + 1


def _signatures(batches):
    """Two kinds of rows from one pass: documents (doc_id, n, s1, s2), and
    counts (token, k) of shingles that a part of the input holds at least twice."""
    hasher, held, size, seen = once(HASHER, Hasher), [], 0, set()
    names = ["doc_id", "n", "s1", "s2", "token", "k"]

    def counted():
        tokens = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(first, len(tokens)))
        keep = counts > 1
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, long_array(tokens[first[keep]]), pa.array(counts[keep])], names)

    for batch in batches:
        for s in shingle_sets(hasher, batch.column(1)):
            one, two = s.digests()
            none = pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(one)), pa.array(s.sizes), pa.array(one), pa.array(two), none, none], names)
            fresh = unseen(seen, one, s.sizes)
            held.append(s.tokens[np.repeat(fresh, s.sizes)])
            size += len(held[-1])
        if size > HELD:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def unseen(seen: set, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows whose class this part of the input has not met."""
    out = sizes > 0
    for i, x in enumerate(ids.tolist()):
        if x in seen:
            out[i] = False
        seen.add(x)
    return out


def heavy_tokens(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the heaviest shingles over all documents."""
    counts = signed.where("token is not null").groupBy("token").agg(F.sum("k").alias("k"))
    rows = counts.where(F.col("k") >= HEAVY).orderBy(F.desc("k"), "token").limit(HEAVY_KEPT).toArrow()
    tokens = rows.column("token").to_numpy().view(U64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("k").to_numpy()[order]


def _prefixes(heavy):
    def run(batches):
        tokens, counts = heavy.value
        hasher, seen = once(HASHER, Hasher), set()
        for batch in batches:
            for s in shingle_sets(hasher, batch.column(0)):
                ids = s.digests()[0]
                fresh = unseen(seen, ids, s.sizes)
                row = np.repeat(np.arange(len(ids)), s.sizes)
                mine = fresh[row]
                row, t = row[mine], s.tokens[mine]
                if not len(t):
                    continue
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, t), len(tokens) - 1)
                    weight = np.where(tokens[at] == t, counts[at], 0)
                    if weight.any():
                        order = np.lexsort((weight, row))  # stable: by hash within a weight
                        row, t = row[order], t[order]
                width = np.where(fresh, s.sizes, 0)
                place = np.arange(len(t)) - np.repeat(np.cumsum(width) - width, width)
                keep = place < prefix_size(s.sizes)[row]
                strong = place < strong_size(s.sizes)[row]
                yield pa.RecordBatch.from_arrays([long_array(t[keep]), pa.array(ids[row[keep]]), pa.array(s.sizes[row[keep]].astype(np.int32)), pa.array(strong[keep])], ["token", "s1", "n", "strong"])

    return run


def partnered(token: np.ndarray, n: np.ndarray, strong: np.ndarray, before: int) -> np.ndarray:
    """Rows, in order of token and size, that some row of their bucket may link with.

    Of two rows the smaller must be strong, and sizes allow it.  before: size of
    the last strong row of the first bucket that was passed on already, or 0.
    """
    at = np.arange(len(token))
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, len(token))))
    last = np.maximum.accumulate(np.where(strong, at, -1))
    last = np.concatenate([[-1], last[:-1]])
    n = n.astype(np.int64)
    smaller = np.where(last >= begin, n[np.maximum(last, 0)], np.where(begin == 0, before, 0))
    larger = np.zeros(len(token), dtype=bool)
    larger[:-1] = strong[:-1] & (token[1:] == token[:-1]) & (NUM * n[1:] <= DEN * n[:-1])
    return ((smaller > 0) & (DEN * smaller >= NUM * n)) | larger


def _runs(batches):
    """Rows of tokens that two classes share, each with its leader.

    Input is sorted by token, size, class.  The leader is the first class of a
    run, or the first whose size may still link with the row's.
    """
    tail, open_leader, open_strong = None, None, None  # open_*: of the last run, if it was passed on in parts

    def emit(token, s1, n, strong, goes_on):
        nonlocal open_leader, open_strong
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (s1[1:] != s1[:-1])])
        token, s1, n, strong = token[fresh], s1[fresh], n[fresh], strong[fresh]
        before = open_strong[1] if open_strong is not None and open_strong[0] == token[0] else 0
        known = open_leader if open_leader is not None and open_leader[0] == token[0] else None
        keep = partnered(token, n, strong, before)
        if goes_on:
            # The last row's next one is still to come.
            keep[-1] |= strong[-1]
            mine = np.flatnonzero(strong & (token == token[-1]))
            open_strong = (token[-1], int(n[mine[-1]]) if len(mine) else before if token[0] == token[-1] else 0)
        token, s1, n = token[keep], s1[keep], n[keep]
        if not len(token):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, s1, n, s1)], ["token", "s1", "n", "leader"])
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        known = known if known is not None and known[0] == token[0] else None
        last = first + size - 1
        leader = np.repeat(s1[first], size)
        odd = NUM * n[last].astype(np.int64) > DEN * n[first].astype(np.int64)
        if known is not None:
            odd[0] = True
        open_leader = (token[first[-1]], s1[first[-1]], n[first[-1]]) if goes_on else None
        for r in np.flatnonzero(odd).tolist():
            who, width = (known[1], known[2]) if known is not None and r == 0 else (s1[first[r]], n[first[r]])
            for i in range(first[r], last[r] + 1):
                if NUM * int(n[i]) > DEN * int(width):
                    who, width = s1[i], n[i]
                leader[i] = who
            if goes_on and r == len(first) - 1:
                open_leader = (token[first[-1]], who, width)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, s1, n, leader)], ["token", "s1", "n", "leader"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if tail is not None:
            cols = [np.concatenate(x) for x in zip(tail, cols)]
        token = cols[0]
        start = int(np.searchsorted(token, token[-1], "left"))
        # The last run may go on in the next batch; a long one is passed on in parts.
        goes_on = len(token) - start > PART
        if goes_on:
            start = len(token) - 1
        tail = [x[start:] for x in cols]
        if start:
            yield emit(*[x[:start] for x in cols], goes_on)
    if tail is not None:
        yield emit(*tail, False)


def width_of(n: int) -> int:
    """Bits of the bitmap of n shingles: 64 to 65536, SHINGLE_BITS a shingle."""
    bits = 64
    while bits < SHINGLE_BITS * n and bits < MOST_BITS:
        bits *= 2
    return bits


def bitmap(s: np.ndarray) -> bytes:
    """A set's bitmap, compressed; a wider one folds to a narrower by OR."""
    bits = width_of(len(s))
    out = np.zeros(bits, dtype=np.uint8)
    out[(s & U64(bits - 1)).astype(np.int64)] = 1
    return pa.compress(np.packbits(out, bitorder="little").tobytes(), "zstd", asbytes=True)


def unpacked(packed: bytes, n: int) -> bytes:
    return pa.decompress(packed, width_of(n) // 8, "zstd", asbytes=True)


def folded(bits: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(bits, dtype=U64)
    while len(x) > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def _bitmaps(batches):
    """doc_id, class, size and bitmap of each document with words."""
    hasher = once(HASHER, Hasher)
    for batch in batches:
        for s in shingle_sets(hasher, batch.column(1)):
            keep = np.flatnonzero(s.sizes > 0)
            bits = [bitmap(s.row(i)) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep + s.first)), pa.array(s.digests()[0][keep]), pa.array(s.sizes[keep].astype(np.int32)), pa.array(bits, pa.binary())], ["rep", "s1", "n", "bits"])


def _tokens(batches):
    """Class and whole set, as bytes, of each document with words."""
    hasher = once(HASHER, Hasher)
    for batch in batches:
        for s in shingle_sets(hasher, batch.column(0)):
            keep = np.flatnonzero(s.sizes > 0)
            yield pa.RecordBatch.from_arrays([pa.array(s.digests()[0][keep]), pa.array([s.row(i).tobytes() for i in keep.tolist()], pa.binary())], ["s1", "tokens"])


def enough(common: int, a: int, b: int) -> bool:
    """NUM / DEN or more of the union is common."""
    return DEN * common >= NUM * (a + b - common)


def may_link(abits: bytes, bbits: bytes, na: int, nb: int) -> bool:
    """False only if the bitmaps prove too small an overlap."""
    width = min(len(abits), len(bbits)) // 8
    a, b = folded(abits, width), folded(bbits, width)
    alone = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
    return enough(min(na - alone[0], nb - alone[1]), na, nb)


def _verify(batches):
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        keep = []
        for i in range(batch.num_rows):
            a, b = np.frombuffer(c["ta"][i].as_buffer(), dtype=U64), np.frombuffer(c["tb"][i].as_buffer(), dtype=U64)
            common = len(a) + len(b) - len(np.union1d(a, b))
            keep.append(enough(common, len(a), len(b)))
        yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _prune(batches):
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        na, nb = c["na"].to_numpy(), c["nb"].to_numpy()
        keep = [may_link(unpacked(c["ba"][i].as_py(), int(na[i])), unpacked(c["bb"][i].as_py(), int(nb[i])), int(na[i]), int(nb[i])) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([c[x] for x in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def pruned(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of class pairs (a, b), those that sizes and bitmaps leave open; saved."""

    def side(x: str) -> DataFrame:
        return sets.select(F.col("s1").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((DEN * F.col("na") >= NUM * F.col("nb")) & (DEN * F.col("nb") >= NUM * F.col("na")))
    return saved(both.mapInArrow(_prune, "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of saved class pairs (a, b), those that link, by whole sets; saved, and pairs dropped.

    Only documents that stand for a class of a pair are read into sets again.
    """
    wanted = sets.join(few(pairs.select(F.explode(F.array("a", "b")).alias("s1")).distinct()), "s1", "left_semi").select("rep", "s1")
    known = few(wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.join(known, "doc_id", "left_semi").select("text").union(docs.where("doc_id is null").select("text"))
    whole = texts.select("text").mapInArrow(_tokens, "s1 long, tokens binary").join(few(wanted.select("s1")), "s1", "left_semi").dropDuplicates(["s1"])
    links = pairs.join(whole.toDF("a", "ta"), "a").join(whole.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")
    links = saved(links)
    drop_saved(pairs)
    return links


# --- signature trees --------------------------------------------------------


class Node:
    """OR of the members' bitmaps, their size range, the most shingles that
    share a bit, and the component if it is one for all."""

    __slots__ = ("rows", "kids", "bits", "low", "high", "shared", "comp")

    def __init__(self, rows, kids, bits, low, high, shared, comp):
        self.rows, self.kids, self.bits, self.low, self.high, self.shared, self.comp = rows, kids, bits, low, high, shared, comp


def build_tree(n: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> Node:
    """Leaves of LEAF rows in order of component and size, nodes of two."""
    shared = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    order = np.lexsort((n, comp))
    level = []
    for i in range(0, len(order), LEAF):
        r = order[i : i + LEAF]
        level.append(Node(r, None, np.bitwise_or.reduce(bits[r], axis=0), n[r].min(), n[r].max(), shared[r].max(), comp[r[0]] if (comp[r] == comp[r[0]]).all() else None))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            k = level[i : i + 2]
            up.append(k[0] if len(k) == 1 else Node(None, k, k[0].bits | k[1].bits, min(k[0].low, k[1].low), max(k[0].high, k[1].high), max(k[0].shared, k[1].shared), k[0].comp if k[0].comp == k[1].comp else None))
        level = up
    return level[0]


def dual(x: Node, y: Node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that no bound rules out."""
    stack = [(x, y)]
    while stack:
        a, b = stack.pop()
        if a.comp is not None and a.comp == b.comp:
            continue
        if DEN * a.high < NUM * b.low or DEN * b.high < NUM * a.low:
            continue
        most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.shared, b.shared)
        if not enough(min(most, a.high, b.high), a.low, b.low):
            continue
        if a is b:
            if a.kids:
                p, q = a.kids
                stack += [(p, p), (p, q), (q, q)]
            else:
                yield a.rows, b.rows
        elif a.kids and (not b.kids or a.high - a.low >= b.high - b.low):
            stack += [(k, b) for k in a.kids]
        elif b.kids:
            stack += [(a, k) for k in b.kids]
        else:
            yield a.rows, b.rows


def likely(x, p: np.ndarray, y, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of two leaves' rows the whole bitmaps leave open, and the similarity they allow."""
    a, b = x.bits[p][:, None, :], y.bits[q][None, :, :]
    na, nb = x.n[p][:, None], y.n[q][None, :]
    common = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=2, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=2, dtype=np.int64))
    alike = (DEN * common >= NUM * (na + nb - common)) & (x.comp[p][:, None] != y.comp[q][None, :]) & (x.s1[p][:, None] != y.s1[q][None, :])
    return alike, common / (na + nb - common)


def likeliest_forest(one: np.ndarray, two: np.ndarray, score: np.ndarray) -> list[int]:
    """Pairs that join all components (one, two) that any pair joins, by falling score."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    order = np.argsort(-score, kind="stable")
    lo, hi = np.minimum(one, two)[order], np.maximum(one, two)[order]
    first = np.sort(np.unique(np.stack([lo, hi]), axis=1, return_index=True)[1])
    kept = []
    for i in first.tolist():
        a, b = find(int(lo[i])), find(int(hi[i]))
        if a != b:
            root[a] = b
            kept.append(int(order[i]))
    return kept


class Side:
    """Rows of a part with their bitmaps folded to one width, and their tree."""

    def __init__(self, rows: np.ndarray, n, comp, s1, bits, width: int) -> None:
        self.n, self.comp, self.s1 = n[rows], comp[rows], s1[rows]
        self.bits = np.stack([folded(bits[i], width) for i in rows.tolist()])
        self.tree = build_tree(self.n, self.comp, self.bits)


def _forest(key, t):
    """Of a tree's pairs, a forest that joins what they join."""
    a, b, one, two, score = _open_pairs(key, t)
    kept = likeliest_forest(one, two, score)
    return _pair_table(a[kept], b[kept])


def _trees(key, t):
    a, b, *_ = _open_pairs(key, t)
    return _pair_table(a, b)


def _pair_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})


def _open_pairs(key, t):
    """Pairs of classes from one tree, or from two trees of a bucket, with
    their components and the similarity that their bitmaps allow.

    Sizes that may link have bitmaps of one width or of neighbouring widths,
    so rows are compared width by width.
    """
    n, comp, s1, part = (t.column(c).to_numpy() for c in ("n", "comp", "s1", "part"))
    n = n.astype(np.int64)
    bits = [unpacked(b, k) for b, k in zip(t.column("bits").to_pylist(), n.tolist())]
    width = np.array([len(b) // 8 for b in bits])
    i, j = key[1].as_py(), key[2].as_py()
    found = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0)]]
    for w in np.unique(width).tolist():
        sides = {}
        for p in {i, j}:
            for factor in (1, 2):
                rows = np.flatnonzero((part == p) & (width == factor * w))
                if len(rows):
                    sides[p, factor] = Side(rows, n, comp, s1, bits, w)
        pairs = [((i, 1), (j, 1)), ((i, 1), (j, 2))] + ([((i, 2), (j, 1))] if i != j else [])
        for left, right in pairs:
            if left not in sides or right not in sides:
                continue
            x, y = sides[left], sides[right]
            for p, q in dual(x.tree, y.tree):
                alike, score = likely(x, p, y, q)
                r, c = np.nonzero(alike)
                for out, new in zip(found, (x.s1[p[r]], y.s1[q[c]], x.comp[p[r]], y.comp[q[c]], score[r, c])):
                    out.append(new)
    return [np.concatenate(x) for x in found]


def tree_pairs(runs: DataFrame, sets: DataFrame, comps: DataFrame, forest: bool = False) -> DataFrame:
    """Class pairs of buckets that still hold several components, saved.

    forest: only of some buckets, of each tree by itself, and no more than
    join its components.
    """
    if forest:
        runs = runs.where(F.pmod(F.xxhash64("token"), F.lit(FOREST_ONE_IN)) == 0)
    rows = runs.select("token", "s1", "n").join(comps.select(F.col("node").alias("s1"), "component"), "s1", "left").select("token", "s1", "n", F.coalesce("component", "s1").alias("comp"))
    # Equal buckets of different tokens do the same work: one of them is kept.
    open_ = (
        rows.groupBy("token")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.sum(F.xxhash64("s1").cast("decimal(38,0)")).alias("h"))
        .where("lo <> hi")
        .groupBy("k", "h")
        .agg(F.min("token").alias("token"))
        .select("token", "k")
    )
    trees = F.ceil(F.col("k") / TREE).cast("int")
    part = F.pmod(F.xxhash64("s1", F.lit(7)), F.col("trees")).cast("int")
    rows = rows.join(open_.withColumn("trees", trees), "token").withColumn("part", part)
    dealt = rows.join(sets.select("s1", "bits"), "s1")
    pair = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    if forest:
        pair = F.array(F.struct(F.col("part").alias("i"), F.col("part").alias("j")))
    dealt = dealt.withColumn("p", F.explode(pair)).select("token", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "part", "s1", "n", "comp", "bits")
    return saved(dealt.groupBy("token", "i", "j").applyInArrow(_forest if forest else _trees, "a long, b long").distinct())


# --- the operator -----------------------------------------------------------


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved: (doc_id, n, s1, s2) of every row, and (s1, component, component_id)
    of the classes that some link reaches."""
    spark = docs.sparkSession
    small_batches(spark)
    both = saved(docs.mapInArrow(_signatures, "doc_id long, n long, s1 long, s2 long, token long, k long"))
    heavy = spark.sparkContext.broadcast(heavy_tokens(both))
    signed = saved(both.where("n is not null").select("doc_id", "n", "s1", "s2"))
    drop_saved(both)
    classes = signed.where("n > 0").groupBy("s1").agg(F.min("doc_id").alias("rep"))
    prefixes = docs.select("text").mapInArrow(_prefixes(heavy), "token long, s1 long, n int, strong boolean")
    runs = saved(prefixes.repartition("token").sortWithinPartitions("token", "n", "s1").mapInArrow(_runs, "token long, s1 long, n int, leader long"))
    heavy.destroy()
    wanted = classes.join(runs.select("s1").distinct(), "s1", "left_semi")
    bitmaps = lambda rows: rows.mapInArrow(_bitmaps, "rep long, s1 long, n int, bits binary")
    of_known = bitmaps(docs).join(few(wanted.where("rep is not null")), ["rep", "s1"], "left_semi")
    # A class none of whose rows has an id takes part too; its rows are told by their sets.
    of_none = bitmaps(docs.where("doc_id is null")).join(few(wanted.where("rep is null").select("s1")), "s1", "left_semi")
    sets = saved(of_known.unionByName(of_none).dropDuplicates(["s1"]))
    star = runs.where("s1 <> leader").select(F.least("s1", "leader").alias("a"), F.greatest("s1", "leader").alias("b")).distinct()
    links = verified(pruned(star, sets), sets, docs)
    comps = components(links)
    drop_saved(links)
    for forest in (True, False):
        links = verified(tree_pairs(runs, sets, comps, forest), sets, docs)
        new = components(comps.toDF("a", "b").union(links))
        drop_saved(links)
        drop_saved(comps)
        comps = new
    drop_saved(runs)
    drop_saved(sets)
    least = comps.join(classes, comps["node"] == classes["s1"]).groupBy("component").agg(F.min("rep").alias("component_id"))
    found = saved(comps.join(least, "component").select(F.col("node").alias("s1"), "component", "component_id"))
    drop_saved(comps)
    return signed, found


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1, root (class that stands for the component), component_id of every row; saved."""
    signed, found = _classes(docs)
    least = signed.where("n > 0").groupBy("s1").agg(F.min("doc_id").alias("rep"))
    out = signed.join(least, "s1", "left").join(found, "s1", "left")
    out = saved(out.select("doc_id", "n", "s1", F.when(F.col("n") > 0, F.coalesce("component", "s1")).alias("root"), F.coalesce("component_id", "rep", "doc_id").alias("component_id")))
    drop_saved(signed)
    drop_saved(found)
    settle(docs.sparkSession)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows = _members(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _row_class(batches):
    """The class of each row, after its columns; null for empty sets."""
    hasher = once(HASHER, Hasher)
    for batch in batches:
        for s in shingle_sets(hasher, batch.column("text")):
            part = batch.slice(s.first, len(s.sizes))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.digests()[0], mask=s.sizes == 0)], [*batch.schema.names, "_class"])


def dedup(docs: DataFrame) -> DataFrame:
    """Rows of docs without near copies: of each component one row of its least
    doc_id stays.  Rows without words stay; of rows without an id one stays
    where a component has no other."""
    rows = _members(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kept = rows.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("k"))
    one = few(kept.where("k = 1").select("doc_id"))
    id_ = docs["doc_id"].cast("long")
    plain = docs.join(one, id_ == one["doc_id"], "left_semi")
    # Rows that share their id with others, or have none, are told apart by their texts.
    again = few(kept.where("k > 1").select("doc_id"))
    odd = docs.join(again, id_ == again["doc_id"], "left_semi").unionByName(docs.where("doc_id is null"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    roots = rows.where("root is not null and (doc_id is null or doc_id = component_id)").select(F.col("s1").alias("_class"), F.col("root").alias("_root"), F.col("component_id").alias("_least")).distinct()
    marked = odd.mapInArrow(_row_class, f"{fields}, _class long").join(few(roots), "_class", "left")
    empty = marked.where("_class is null").select(*docs.columns)
    first = F.row_number().over(Window.partitionBy("_root").orderBy("_class"))
    least = marked.where("_class is not null and doc_id <=> _least").withColumn("_place", first).where("_place = 1").select(*docs.columns)
    return plain.unionByName(empty).unionByName(least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
