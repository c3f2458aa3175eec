"""A Merkle tree of a data set: leaves, roots and every leaf's authentication path.

A group's leaves (a source's rows by doc_id) hang under nodes of ARITY children
up to its subroot, the groups' subroots under the root.  Leaves are numbered in
their group without a task that holds it: rows are ranged by (group, order),
counted a part, and a row's number is its part's offset and its place there.

Within an aligned block of ARITY ** HEIGHT leaves a path is emitted for each
leaf by fractal traversal: a stack of existing subtrees, one a level, holds the
siblings of the leaf at hand, while desired subtrees, which take their places,
grow by one leaf for each path that is emitted.  The uppermost existing subtree
comes from a first pass that hashes each block; leaves of the others are read
ahead, ARITY ** (HEIGHT - 1) of them, so a task holds a few hundred digests
whatever a block, group or part holds.  What is above a block is a sixteenth of
a block's count a level; its paths are joined level by level and given to a
block with its subtree, before its leaves.

Defined cases: a null in a field is "-"; a null group is a group, the first; a
null in the order column comes first; rows of one order value are ordered by
their leaves, rows that are equal in all fields are leaves each; a group of one
leaf is its own subroot, a single group's subroot is the root, and neither has
siblings there; an empty table gives no rows; very long texts are hashed in
one row's memory; columns not named in `keep` and fields do not go on, and a
kept one may have any name but those that are made (leaf, changed, subroot,
root, proof), which win.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_saved, saved, small_batches, table

ARITY = 16
#: Levels of a block: it holds ARITY ** HEIGHT leaves.
HEIGHT = 3
#: Rows that a task of a pass over the blocks has, about.
TASK_ROWS = 1 << 16
#: Rows of a table of parts or groups that is broadcast once it is counted.
FEW = 1 << 12
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
MADE = ["leaf", "changed", "subroot", "root", "proof"]


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field of a leaf: its bytes' count and its value, so that no two rows run together."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


# --- numbers of rows in their groups --------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows (with a group `g`) and pos in the group, n of it, and the row's place
    `at` in all; and how many there are.  The order must tell all unequal rows apart."""
    ranged = saved(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    counts = saved(ranged.groupBy(part, "g").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    # A row a part: the rows before it in all.
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_start"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # A group has a row for each part it lies in.
    of_group = Window.partitionBy("g")
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "g", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.sum("_n").over(of_group).alias("n"))
    offsets = saved(offsets.join(few(parts), "_part"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    out = ranged.withColumn("_part", part).join(few(offsets), ["_part", "g"])
    return out.withColumn("pos", F.col("_offset") + F.col("_id") - F.col("_first")).withColumn("at", F.col("_base") + F.col("_id") - F.col("_start")).drop("_part", "_id", "_first", "_offset", "_base", "_start"), total


# --- above the blocks -----------------------------------------------------------


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(g, digest) of each group's uppermost node, and the runs of each level.

    nodes: g, idx, m (nodes of the group at this level), digest."""
    tops, levels = [], []
    most = nodes.agg(F.max("m").alias("m")).first()["m"] or 0
    while True:
        tops.append(nodes.where("m = 1").select("g", "digest"))
        if most <= 1:
            break
        runs = nodes.where("m > 1").groupBy("g", F.expr(f"idx div {ARITY}").alias("up"), F.ceil(F.col("m") / ARITY).alias("m")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        runs = saved(runs.withColumn("digest", F.sha2(F.concat_ws("", "kids.digest"), 256)))
        levels.append(runs)
        nodes, most = runs.select("g", F.col("up").alias("idx"), "m", "digest"), -(-most // ARITY)
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out, levels


def paths(levels: list[DataFrame]) -> DataFrame | None:
    """(g, idx, path) of the lowest level's nodes from climb's runs, from the top down."""
    above = None
    for runs in reversed(levels):
        kid = runs.select("g", "up", F.col("kids.digest").alias("digests"), F.posexplode("kids").alias("place", "kid"))
        others = F.concat_ws("", F.filter("digests", lambda _, i: i != F.col("place")))
        here = kid.select("g", F.col("kid.idx").alias("idx"), "up", F.array(F.struct(F.col("place").cast("int").alias("place"), others.alias("siblings"))).alias("step"))
        if above is None:
            above = here.select("g", "idx", F.col("step").alias("path"))
        else:
            upper = above.select("g", F.col("idx").alias("up"), "path")
            above = here.join(upper, ["g", "up"], "left").select("g", "idx", F.when(F.col("path").isNull(), F.col("step")).otherwise(F.concat("step", "path")).alias("path"))
    return above


# --- within blocks ----------------------------------------------------------------


def depth_of(n: int) -> int:
    """Levels of a block of a group of n leaves."""
    d = 0
    while ARITY**d < n and d < HEIGHT:
        d += 1
    return d


class TreeHash:
    """A block's uppermost subtree and root from its leaves in order."""

    def __init__(self, depth: int) -> None:
        self.depth, self.stack = depth, [[] for _ in range(depth + 1)]

    def add(self, node: str, level: int = 0) -> None:
        self.stack[level].append(node)
        if level < self.depth - 1 and len(self.stack[level]) == ARITY:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.stack[level] = self.stack[level], []
        self.add(digest(run), level + 1)

    def end(self) -> tuple[list[str], str]:
        for level in range(self.depth - 1):
            if self.stack[level]:
                self.close(level)
        top = self.stack[max(self.depth - 1, 0)]
        return (top, digest(top)) if self.depth else ([], top[0])


def others(run: list[str]) -> list[str]:
    """What stands beside each node of a run, joined."""
    return ["".join(run[:i] + run[i + 1 :]) for i in range(len(run))]


class Traversal:
    """Authentication paths of a block's leaves, which are fed in order."""

    def __init__(self, depth: int, top: list[str]) -> None:
        self.depth, self.fed, self.given = depth, 0, 0
        self.lag = ARITY ** (depth - 1) if depth > 1 else 0
        #: existing[l]: siblings of each of the l-th level's nodes about the leaf at hand.
        self.existing: list[list[str]] = [[] for _ in range(depth - 1)] + ([others(top)] if depth else [])
        #: desired[l]: the subtree of the level that grows; ready[l]: those that are full.
        self.desired: list[list[str]] = [[] for _ in range(depth - 1)]
        self.ready: list[deque[list[str]]] = [deque() for _ in range(depth - 1)]

    def feed(self, leaf: str) -> list[tuple[int, str]] | None:
        """One leaf for the desired subtrees; the next path, if its siblings are known."""
        self.fed += 1
        if self.depth > 1:
            self._grow(0, leaf)
        return self.emit() if self.fed - self.given > self.lag or self.depth < 2 else None

    def _grow(self, level: int, node: str) -> None:
        self.desired[level].append(node)
        if len(self.desired[level]) == ARITY:
            self._fill(level)

    def _fill(self, level: int) -> None:
        run, self.desired[level] = self.desired[level], []
        self.ready[level].append(others(run))
        if level < self.depth - 2:
            self._grow(level + 1, digest(run))

    def end(self) -> Iterator[list[tuple[int, str]]]:
        """The paths that are left."""
        for level in range(self.depth - 1):
            if self.desired[level]:
                self._fill(level)
        while self.given < self.fed:
            yield self.emit()

    def emit(self) -> list[tuple[int, str]]:
        at, out = self.given, []
        for level in range(self.depth):
            if level < self.depth - 1 and at % ARITY ** (level + 1) == 0:
                self.existing[level] = self.ready[level].popleft()
            place = at // ARITY**level % ARITY
            out.append((place, self.existing[level][place]))
        self.given += 1
        return out


def block_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, g, block, n, top, digest) of each block; its leaves come in order."""
    now, tree, out = None, None, []

    def ended():
        top, root = tree.end()
        out.append((*now, top, root))

    def written():
        cols = list(zip(*out))
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["task", "g", "block", "n", "top", "digest"])

    for batch in batches:
        for *block, leaf in zip(*(batch.column(c).to_pylist() for c in ("task", "g", "block", "n", "leaf"))):
            if block != now:
                if now is not None:
                    ended()
                now, tree = block, TreeHash(depth_of(block[3]))
            tree.add(leaf.hex())
        if len(out) >= 64:
            yield written()
            out.clear()
    if now is not None:
        ended()
    if out:
        yield written()


def traversed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with their paths, in the order in which they come; a block's head is its first row."""
    walk, head, waiting = None, None, deque()
    places, siblings, offsets, roots = [], [], [0], []

    def take(path):
        for place, text in path:
            places.append(place)
            siblings.append(text)
        for step in head["path"]:
            places.append(step["place"])
            siblings.append(step["siblings"])
        offsets.append(len(places))
        roots.append((head["subroot"], head["root"]))

    def ready():
        while waiting and waiting[0].num_rows < len(offsets):
            batch = waiting.popleft()
            n = batch.num_rows
            cut = offsets[n]
            proof = pa.ListArray.from_arrays(pa.array(offsets[: n + 1], pa.int32()), pa.StructArray.from_arrays([pa.array(places[:cut], pa.int32()), pa.array(siblings[:cut], pa.string())], ["place", "siblings"]))
            sub, root = zip(*roots[:n])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("leaf"), batch.column("changed"), pa.array(sub), pa.array(root), proof], ["row", *MADE])
            del places[:cut], siblings[:cut], roots[:n]
            offsets[:] = [x - cut for x in offsets[n:]]

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        leaves, n = batch.column("leaf").to_pylist(), batch.column("n").to_pylist()
        heads = batch.column("head")
        if kind.any():
            waiting.append(batch.filter(pa.array(kind == 1)))
        for i, is_leaf in enumerate(kind.tolist()):
            if is_leaf:
                path = walk.feed(leaves[i].hex())
                if path is not None:
                    take(path)
            else:
                if walk is not None:
                    for path in walk.end():
                        take(path)
                head = heads[i].as_py()
                walk = Traversal(depth_of(n[i]), head["top"])
        yield from ready()
    if walk is not None:
        for path in walk.end():
            take(path)
    yield from ready()


# --- the manifest -------------------------------------------------------------------


def _built(docs: DataFrame, keep: list[str], group: Column, order: Column, leaf: Column, changed: Column | None):
    """(numbered leaves, tasks, saved heads of blocks, roots a group)."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    g = group.cast("string")
    keep = [c for c in keep if c not in MADE]
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    # Texts are read and hashed once; from here on a row is its digests.
    leaves = saved(docs.select(F.when(g.isNull(), "").otherwise(F.concat(F.lit("="), g)).alias("g"), order.alias("o"), F.unhex(leaf).alias("leaf"), F.unhex(changed if changed is not None else F.lit(None).cast("string")).alias("changed"), row.alias("row")))
    rows, total = numbered(leaves, ["o", "leaf"])
    size = ARITY**HEIGHT
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    # A block goes to the task of its first leaf, so tasks are even whatever groups hold.
    task = F.floor((F.col("at") - F.col("pos") % size) * tasks / max(total, 1)).cast("int")
    rows = rows.withColumn("block", F.expr(f"pos div {size}")).withColumn("task", task)
    blocks = saved(rows.select("task", "g", "block", "pos", "n", "leaf").repartitionById(tasks, F.col("task")).sortWithinPartitions("g", "pos").select("task", "g", "block", "n", "leaf").mapInArrow(block_tops, "task int, g string, block long, n long, top array<string>, digest string"))
    subroots, levels = climb(blocks.select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / size).alias("m"), "digest"))
    subroots = saved(subroots)
    ranked, groups = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest"), ["o"])
    ranked = saved(ranked.select("g", F.col("pos").alias("idx"), F.col("n").alias("m"), "digest", "o"))
    root, upper = climb(ranked)
    none = F.array().cast("array<struct<place:int,siblings:string>>")
    whole = root.first()
    tops = ranked.select(F.col("o").alias("g"), "idx", F.col("digest").alias("subroot"), F.lit(whole and whole["digest"]).cast("string").alias("root"))
    above = paths(upper)
    tops = tops.withColumn("over", none).drop("idx") if above is None else tops.join(above.select("idx", F.col("path").alias("over")), "idx", "left").withColumn("over", F.coalesce("over", none)).drop("idx")
    tops = saved(tops)
    within = paths(levels)
    heads = blocks.withColumn("path", none) if within is None else blocks.join(within.select("g", F.col("idx").alias("block"), "path"), ["g", "block"], "left").withColumn("path", F.coalesce("path", none))
    heads = saved(heads.join(few(tops), "g").select("task", "g", "block", "n", F.struct("top", F.concat("path", "over").alias("path"), "subroot", "root").alias("head")))
    for done in (leaves, blocks, subroots, ranked, *levels, *upper):
        drop_saved(done)
    return rows, tasks, heads, tops, keep


def authenticated(docs: DataFrame, keep: list[str], group: Column, order: Column, leaf: Column, changed: Column | None = None) -> DataFrame:
    """keep, leaf, changed, subroot, root and proof of each row.

    group, order: columns of docs; leaf: its digest in hex; changed: another
    digest of the row that goes through with it (what a check finds, say).
    proof: from the leaf's run up to the root's, the place of the node in its
    run and its siblings' digests, joined from left to right."""
    rows, tasks, heads, _, keep = _built(docs, keep, group, order, leaf, changed)
    one = rows.select("task", "g", "block", F.lit(1).alias("kind"), "pos", "n", "leaf", "changed", "row")
    kinds = {f.name: f.dataType for f in one.schema} | {"head": heads.schema["head"].dataType}
    both = one.withColumn("head", F.lit(None).cast(kinds["head"])).unionByName(heads.select("task", "g", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"), "n", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("leaf", "changed", "row")), "head"))
    both = both.repartitionById(tasks, F.col("task")).sortWithinPartitions("g", "block", "kind", "pos").select("kind", "n", "leaf", "changed", "row", "head")
    out = both.mapInArrow(traversed, f"row {kinds['row'].simpleString()}, leaf binary, changed binary, subroot string, root string, proof array<struct<place:int,siblings:string>>")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "changed")), "subroot", "root", "proof")


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: list[str] = FIELDS) -> DataFrame:
    """Each group's subroot and the root: what is kept to check a data set by."""
    _, _, heads, tops, _ = _built(docs, [], F.col(group), F.col(order), leaf_of(*map(F.col, fields)), None)
    n = heads.groupBy("g").agg(F.max("n").alias("n_rows"))
    return tops.join(n, "g").select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group), "n_rows", "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(node: Column, step: Column) -> Column:
        left, others_ = step["place"] * 64, step["siblings"]
        return F.sha2(F.concat(others_.substr(F.lit(1), left), node, others_.substr(left + 1, F.length(others_))), 256)

    return F.aggregate(proof, leaf, up)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose crc32 of doc_id 5 divides are checked in lower case; the others, and a null doc_id, as they are."""
    docs = table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in FIELDS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(*cols[:-1], lower))
    found = authenticated(docs.select(*FIELDS), ["doc_id"], F.col("source"), F.col("doc_id"), leaf_of(*cols), changed)
    root = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = found.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof.siblings"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 9) -> str:
    """All levels written out, up to ARITY ** levels leaves a source and sources."""
    enc = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    leaf = lambda text: "sha256(" + " || ".join(map(enc, [*FIELDS[:-1], text])) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    # The digest's bytes over a table of 256 values, each of eight shifts.
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)), lambda c, b: {bit.replace('range(8)', '[0, 1, 2, 3, 4, 5, 6, 7]::bigint[]')}))"
    parts = [
        f"leaves as (select doc_id, source, {leaf('text')} leaf, case when doc_id is not null and {crc} % 5 = 0 then {leaf(low)} end changed from documents)",
        "a0 as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 id, count(*) over (partition by source) m from leaves)",
        "s0 as (select row_number() over (order by doc_id nulls first, leaf) row_id, coalesce(changed, leaf) tested, * from a0)",
    ]

    def tower(name: str, start: str, group: str) -> None:
        parts.append(f"{name}0 as ({start})")
        for i in range(levels):
            parts.append(f"{name}{i + 1} as (select {group}, id // {ARITY} id, any_value((m + {ARITY - 1}) // {ARITY}) m, sha256(string_agg(d, '' order by id)) d from {name}{i} where m > 1 group by {group}, id // {ARITY})")

    tower("t", "select source, id, m, leaf d from s0", "source")
    subs = " union all ".join(f"select source, d from t{i} where m = 1" for i in range(levels + 1))
    parts.append(f"subs as (select source, d, row_number() over (order by source nulls first) - 1 id, count(*) over () m from ({subs}))")
    tower("u", "select 0 one, id, m, d from subs", "one")
    parts.append("root as (" + " union all ".join(f"select d from u{i} where m = 1" for i in range(levels + 1)) + ")")
    parts.append("p0 as (select s0.*, subs.d subroot, subs.id sub_id, '' proof, tested node from s0 join subs on s0.source is not distinct from subs.source)")
    last = "p0"
    for name, key, join in (("t", "id", "n.source is not distinct from p.source and "), ("u", "sub_id", "")):
        for i in range(levels):
            at, run = f"(p.{key} // {ARITY**i})", f"(p.{key} // {ARITY ** (i + 1)})"
            step = f"{name}p{i}"
            parts.append(f"{step}k as (select {'source,' if name == 't' else ''} id // {ARITY} run, list(d order by id) ds from {name}{i} where m > 1 group by all)")
            parts.append(
                f"{step} as (select p.* replace (case when n.ds is null then p.proof else p.proof || array_to_string(list_filter(n.ds, lambda d, j: j <> {at} % {ARITY} + 1), '') end as proof, "
                f"case when n.ds is null then p.node else sha256(array_to_string(list_transform(n.ds, lambda d, j: case when j = {at} % {ARITY} + 1 then p.node else d end), '')) end as node) "
                f"from {last} p left join {step}k n on {join}n.run = {run})"
            )
            last = step
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, root.d root, sha256(proof) proof_sha256, node folded_root, node = root.d verified from {last} p cross join root"


SQL = _sql()
