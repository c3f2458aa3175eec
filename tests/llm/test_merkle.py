"""The Merkle manifest against a tree that is built whole."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
COLS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((at % 16, run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def whole(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for j, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = proof(trees[s], j) + proof(top, i)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = text.translate(LOWER)
            node = leaf((*r[:4], text))
            for _, left, right in steps:
                node = H([*left, node, *right])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(x for _, a, b in steps for x in a + b), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents():
    rng = random.Random(5)
    rows = []
    for source, n in (("a", 1), ("b", 2), (None, 17), ("", 16), ("é", 257), ("z", 300), ("hot", 4500)):
        rows += [[len(rows) + i, source, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Ab c", "ß ÄA", "x" * rng.randrange(40)])] for i in range(n)]
    rows += [rows[-1], rows[0], [None, "b", "en", 3, "No Id"], [rows[-1][0], "hot", "fr", 1, "Tie"]]
    rows += [[100_000 + i, f"s{i:03d}", "en", i, "Text"] for i in range(40)]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("merkle")
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("g", F.lit("x")).write.parquet(f"{root}/documents.parquet")
    return rows, str(root)


def test_query_against_whole_trees(spark, tables):
    rows, root = tables
    got = merkle.query(spark, root).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == whole(rows)


def test_query_against_sql(spark, tables):
    _, root = tables
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{root}/documents.parquet/*.parquet'")
    want = db.execute(merkle.SQL).fetchall()
    assert sorted(map(tuple, merkle.query(spark, root).collect()), key=str) == sorted(want, key=str)


def test_manifest_and_one_wrong_byte(spark, tables):
    rows, root = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    found = {r["source"]: r for r in merkle.manifest(docs).collect()}
    want = {r[1]: 0 for r in rows}
    for r in rows:
        want[r[1]] += 1
    assert {s: r["n_rows"] for s, r in found.items()} == want
    assert {r["root"] for r in found.values()} == {whole(rows)[0][3]}
    other = merkle.manifest(docs.withColumn("text", F.when(F.col("source") == "z", F.concat("text", F.lit("."))).otherwise(F.col("text")))).collect()
    changed = {r["source"] for r in other if r["subroot"] != found[r["source"]]["subroot"]}
    assert changed == {"z"} and {r["root"] for r in other} != {whole(rows)[0][3]}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 33])
def test_few_rows(spark, tmp_path, n):
    rows = [(i, "s", None, 1, f"T{i}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == (whole(rows) if n else [])


def test_traversal_holds_few_digests():
    """A block's paths with at most two subtrees a level at hand."""
    leaves = [H([str(i)]) for i in range(4096 - 5)]
    levels = tree(leaves)
    build = merkle.TreeHash(3)
    for x in leaves:
        build.add(x)
    top, root = build.end()
    assert (top, root) == (levels[2], levels[3][0])
    walk, got, held = merkle.Traversal(3, top), [], 0
    for x in leaves:
        path = walk.feed(x)
        got += [path] if path else []
        held = max(held, *(len(q) for q in walk.ready))
    got += list(walk.end())
    assert held <= 18
    assert got == [[(p, "".join(a + b)) for p, a, b in proof(levels, i)] for i in range(len(leaves))]
