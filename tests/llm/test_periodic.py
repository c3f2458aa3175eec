"""Runs by LZ blocks against every period of every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, exponent=3):
    """For each period the maximal stretches that keep it; of one stretch the smallest period."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((b, e - b, p) for (b, e), p in found.items()), key=lambda r: (r[0], r[2]))


def run(words, least, exponent):
    """runs_of of one row and of the row between two others."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    one = np.array([*(ids[w] for w in words), len(ids)])
    k = len(ids) + 1
    got = periodic.runs_of(one, [(0, len(words))], least, exponent).get(0, [])
    three = np.concatenate([one, one + k, one + 2 * k])
    m = len(one)
    many = periodic.runs_of(three, [(i * m, i * m + m - 1) for i in range(3)], least, exponent)
    assert [many.get(i, []) for i in range(3)] == [got] * 3
    return got


@pytest.mark.parametrize("least,exponent", [(2, 2), (5, 2), (6, 3), (24, 3), (3, 3), (8, 4)])
def test_runs_of_strings(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(400):
        n = rng.randint(1, 90)
        kind = rng.random()
        words = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(n)]
        if kind < 0.5:  # stretches that repeat, and copies of them further on
            unit = [rng.randrange(3) for _ in range(rng.randint(1, 7))]
            block = (unit * 12)[: rng.randint(3, 40)]
            words = words[: n // 3] + block + words[n // 3 :] + block + [9] + block[: rng.randint(0, len(block))]
        assert run(words, least, exponent) == brute(words, least, exponent), words


def test_runs_of_fibonacci_and_long_repeats():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b, [0] * 700, [0, 1] * 400 + [2] + [0, 1] * 400, ([0] * 30 + [1]) * 20, ([0, 1, 2] * 10 + [3]) * 15):
        for least, exponent in ((2, 2), (24, 3)):
            assert run(words, least, exponent) == brute(words, least, exponent)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def documents():
    rng = random.Random(3)
    rows = [(None, None), (None, "x " * 50), (1, ""), (2, None), (3, " \t\n"), (4, "no break " * 30), (5, "Aa aA " * 20)]
    for i in range(300):
        n = rng.randint(0, 200)
        words = [rng.choice(["a", "b", "é", "word", "Word", f"w{rng.randrange(50)}"]) for _ in range(n)]
        if i % 3 == 0:
            line = [f"l{rng.randrange(9)}" for _ in range(rng.randint(1, 12))]
            words[n // 2 : n // 2] = line * rng.randint(2, 14)
        rows.append((10 + i, rng.choice([" ", "\n", " \t "]).join(words)))
    return [*rows, rows[-1], rows[0], (900, " ".join(f"v{rng.randrange(500)}" for _ in range(4000)) + " again" * 900)]


def test_query_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("_text", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.query(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 60


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([("a", "1 2 1 2 1 2", 5), ("b", None, 6)], "n_words string, text string, k int")
    got = periodic.periodic_runs(docs, ["k", "n_words", "text"], 4, 2).collect()
    assert got[0].asDict(True) == {"k": 5, "text": "1 2 1 2 1 2", "n_words": 6, "runs": [{"start": 0, "length": 6, "period": 2}], "collapsed": "1 2"}
    assert got[1].asDict(True) == {"k": 6, "text": None, "n_words": 0, "runs": [], "collapsed": ""}
    assert periodic.periodic_runs(docs.where("k < 0"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, ["k"], 4, 1)
