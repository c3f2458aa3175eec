"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words.
An item of m shingles is searched in windows of m shingles.

1. Anchors: places where a shingle of the document is one of an item's.  A
   window of L shingles and similarity 0.75 or more to an item of m has
   3/7 (L + m) of them at least, so every window with so many, at any start, is
   fingerprinted, and no other can be similar enough.  Only places are joined
   and grouped; the few texts that have enough are read again for their words.
2. SimHash: a window's fingerprint has bit b set if more than half of its
   shingle hashes (counted as often as they occur) have.
3. Multi-index: fingerprints are cut into RADIUS + 1 blocks; two within RADIUS
   bits agree in a block at least, so a join on (item, block, value) finds all.
4. Exact: similarity is sum of min / sum of max of shingle counts.

Result: a row per document and item that leaks into it, with the best window
(highest similarity, then least start, then least text where an id has several).
Defined cases: null or empty texts, items of under five words and rows with null
ids give no rows; very long texts are searched whole; rows that repeat count
once; an id with several texts, of documents or items, leaks if one of them
does; an empty table gives no rows; extra columns are ignored, and kept by clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, saved, settle, table

WORDS = 5
NUM, DEN = 3, 4
#: Similarity 0.75 is an expected distance of 11 of 64 bits; 23 is four deviations more.
RADIUS = 23
#: Shingles of all items up to which the item side is broadcast: about 16 MB.
BROADCAST_SHINGLES = 500_000


def words(column: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(column)), "[^\\p{L}\\p{N}]+"), "")


def shingles(expr: str) -> Column:
    """Hashes of all five-word runs of an array of words, in order."""
    return F.expr(f"if(size({expr}) < {WORDS}, cast(array() as array<bigint>), transform(sequence(0, size({expr}) - {WORDS}), p -> xxhash64(slice({expr}, p + 1, {WORDS}))))")


def fingerprint(hashes: str) -> Column:
    """Bit b is set if more than half of the hashes have it.

    One walk counts all bits: the lanes of a few numbers are counters, of 8 bits
    for arrays that these can count below the sign, of 16 and 32 for longer ones.
    Counter j holds bits j, j + width, ...  The expression is kept small, as plans
    copy it many times."""
    width = f"if(size({hashes}) < 128, 8, if(size({hashes}) < 32768, 16, 32))"
    unit = f"if(size({hashes}) < 128, {sum(1 << i for i in range(0, 64, 8))}L, if(size({hashes}) < 32768, {sum(1 << i for i in range(0, 64, 16))}L, {sum(1 << i for i in range(0, 64, 32))}L))"
    count = f"aggregate({hashes}, array_repeat(0L, {width}), (_a, _h) -> transform(_a, (_x, _i) -> _x + (shiftrightunsigned(_h, _i) & {unit})))"
    lane = "shiftrightunsigned(_c[_b % size(_c)], _b - _b % size(_c)) & (shiftleft(1L, size(_c)) - 1)"
    return F.expr(f"transform(array({count}), _c -> aggregate(sequence(0, 63), 0L, (_f, _b) -> _f | if(2 * ({lane}) > size({hashes}), shiftleft(1L, _b), 0L)))[0]")


def blocks(fp: str) -> Column:
    """RADIUS + 1 structs (block, value) that together hold the 64 bits."""
    n = RADIUS + 1
    edges = [i * 64 // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fp}, {lo}) & {(1 << (hi - lo)) - 1}L").alias("value")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word, from 0), n_shingles, distance, similarity."""
    # An item is a text; its id may have several.
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("w"))
        .where(F.col("item_id").isNotNull() & (F.size("w") >= WORDS))
        .distinct()
        .select("item_id", F.xxhash64("item_id", "w").alias("item"), shingles("w").alias("item_hashes"))
        .select("*", F.size("item_hashes").alias("m"), fingerprint("item_hashes").alias("item_fp"))
    )
    grams = items.select("item", "m", F.explode(F.array_distinct("item_hashes")).alias("h"))
    small = (items.agg(F.sum("m").alias("n")).first()["n"] or 0) <= BROADCAST_SHINGLES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # No filter on the words: it would be pushed below and split each text twice.
    split = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("w"))
    # Places are exploded before they are hashed, so that each shingle is hashed in compiled code.
    at = F.expr(f"explode(if(size(w) < {WORDS}, cast(array() as array<int>), sequence(0, size(w) - {WORDS})))")
    gram = F.xxhash64(*(F.expr(f"get(w, p + {i})") for i in range(WORDS)))
    places = split.select("doc_id", F.xxhash64("w").alias("text_id"), (F.size("w") - (WORDS - 1)).alias("n"), "w", at.alias("p")).select("doc_id", "text_id", "n", "p", gram.alias("h"))
    size = F.least("m", "n")
    need = F.expr(f"cast(({NUM} * (size + m) + {NUM + DEN - 1}) div {NUM + DEN} as int)")
    runs = places.join(side(grams), "h").groupBy("doc_id", "text_id", "n", "item", "m").agg(F.array_sort(F.collect_set("p")).alias("a"))
    runs = saved(runs.withColumn("size", size).withColumn("need", need).where(F.size("a") >= F.col("need")))
    # A window's first anchor is a[i]: it starts after the one before, and reaches the need-th from there.
    low = "greatest(0, if(i = 0, 0, a[i - 1] + 1), a[i + need - 1] - size + 1)"
    high = "least(a[i], n - size)"
    starts = runs.select("doc_id", "text_id", "item", "size", F.expr(f"explode(flatten(transform(sequence(0, size(a) - need), i -> if({low} > {high}, array(), sequence({low}, {high})))))").alias("start"))
    texts = split.join(few(runs.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.xxhash64("w").alias("text_id"), shingles("w").alias("all_hashes")).dropDuplicates(["doc_id", "text_id"])
    windows = starts.join(texts, ["doc_id", "text_id"]).select("doc_id", "text_id", "item", "start", F.expr("slice(all_hashes, start + 1, size)").alias("hashes")).withColumn("fp", fingerprint("hashes"))
    keys = ["item", "block", "value"]
    mine = windows.select("*", F.inline(blocks("fp")))
    theirs = items.select("item", "item_id", "item_hashes", "item_fp", "m", F.inline(blocks("item_fp")))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = mine.join(side(theirs), keys).where(distance <= RADIUS)
    # A pair that agrees in several blocks is taken at the first of them.
    edges = [i * 64 // (RADIUS + 1) for i in range(RADIUS + 2)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    differs = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*(F.when(differs.bitwiseAND(F.lit(x).cast("long")) == 0, F.lit(i)) for i, x in enumerate(signed)))
    pairs = pairs.where(F.col("block") == first)
    each = "aggregate(array_distinct(hashes), 0, (n, x) -> n + least(size(filter(hashes, y -> y = x)), size(filter(item_hashes, y -> y = x))))"
    # Without repeats on one side, each shingle in common counts once.
    common = F.expr(f"if(size(array_distinct(hashes)) = size(hashes) or size(array_distinct(item_hashes)) = size(item_hashes), size(array_intersect(hashes, item_hashes)), {each})")
    scored = pairs.select("doc_id", "text_id", "item_id", "start", F.col("m").alias("n_shingles"), distance.alias("distance"), common.alias("common"), (F.size("hashes") + F.col("m")).alias("both"))
    good = scored.where(DEN * F.col("common") >= NUM * (F.col("both") - F.col("common"))).withColumn("similarity", F.col("common") / (F.col("both") - F.col("common")))
    best = good.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n_shingles", "distance", "similarity"), F.struct("similarity", -F.col("start"), "text_id")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n_shingles").alias("n_shingles"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that an item leaks into.  The leaks, a few columns of a
    few documents, are saved and broadcast if few; else the documents are joined."""
    found = few(saved(leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()))
    settle(docs.sparkSession)
    return docs.join(found, docs["doc_id"].cast("long") == found["_leak"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
