"""License notices: gates, spans and base phrases against plain scans."""

import math
import random
import re
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def example(pattern, rng):
    """A text that a pattern matches."""

    def made(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "w"
            elif name == "ANY":
                out += rng.choice("ab ")
            elif name == "IN":
                sets = [x for x in arg if str(x[0]) != "NEGATE"]
                if any(str(x[0]) == "NEGATE" for x in arg):
                    out += "w"
                else:
                    kind, value = rng.choice(sets)
                    out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
            elif name == "BRANCH":
                out += made(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                lo, hi, inner = arg
                out += "".join(made(inner) for _ in range(rng.randint(lo, min(hi, lo + 3))))
            elif name not in ("ASSERT", "ASSERT_NOT"):
                raise AssertionError(name)
        return out

    return made(parser.parse(pattern))


def plain(text):
    """n_words, base places and hits without a gate, each hit against each other."""
    words = WORD.findall((text or "").translate(LOWER))
    line = " ".join(words)
    base = [(i, BASE[p]) for p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    hits = [(m.start(), m.end(), i) for i, r in enumerate(licenses.rules()) if not r.base for m in r.pattern.finditer(line)]
    of = licenses.rules()

    def hidden(x, y):
        """x lies within y, which comes before it."""
        if x == y or not (y[0] <= x[0] and x[1] <= y[1]):
            return False
        a, b = of[x[2]].priority, of[y[2]].priority
        return b > a or b == a and (x[:2] != y[:2] or y[2] < x[2])

    # Lying within is transitive: what hides is itself hidden only by one that hides all that it does.
    kept = [x for x in hits if not any(hidden(x, y) for y in hits)]
    return len(words), base, kept


def expected(doc_id, text):
    n, base, kept = plain(text)
    of, sure = licenses.rules(), {}
    for _, _, i in kept:
        sure[of[i].label] = max(sure.get(of[i].label, 0), of[i].weight)
    for r in of[:3]:
        if r.label in {x for _, x in base}:
            sure[r.label] = max(sure.get(r.label, 0), r.weight)
    places = [i for i, _ in base]
    return (doc_id, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(sure)), 1 - math.prod(1 - sure[x] for x in sorted(sure)))


def corpus():
    rng = random.Random(2)
    filler = ["the", "mit", "Licht", "über", "replace", "simple", "bsd", "gpl", "v2", "license", "copyright", "2020", "cc", "by", "©"]
    rows = [None, "", " \n\x00", "CC BY cc-by CC  by", "ccby cc,by", "ALL rights. Reserved all rights reserved", "é" * 9000, "cc by " * 500]
    rows.append("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0. MIT mit der Lizenz")
    for r in licenses.rules():
        before, after = (" ".join(rng.choices(filler, k=rng.randint(0, 6))) for _ in range(2))
        rows.append(f"{before} {example(r.pattern.pattern, rng)}, {after}".title())
    for _ in range(60):
        rows.append(rng.choice([". ", " ", "-"]).join(example(rng.choice(licenses.rules()).pattern.pattern, rng) for _ in range(rng.randint(2, 6))))
    return [*rows, rows[-1]]


def test_each_rule_has_its_keyword_and_an_example():
    rng = random.Random(1)
    assert len(licenses.rules()) > 200
    for r in licenses.rules():
        for _ in range(30):
            text = example(r.pattern.pattern, rng)
            assert r.pattern.fullmatch(text), (r, text)
            assert f" {r.keyword}" in f" {text}", (r, text)


def test_query_against_plain_scan(spark, tmp_path):
    rows = list(enumerate(corpus()))
    rows[0] = (None, None)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("n_words", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in licenses.query(spark, str(tmp_path)).collect()), key=str)
    want = sorted((expected(*r) for r in rows), key=str)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert all(math.isclose(a[-1], b[-1], abs_tol=1e-12) and 0 <= a[-1] <= 1 for a, b in zip(got, want))


def test_labels():
    def labels(text):
        n, hits = licenses.scan(text.encode())
        return sorted({licenses.rules()[i].label for _, _, i in hits})

    assert labels("mit der Zeit, und mit Mut") == []
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc-4.0"]
    assert labels("the GNU General Public License, version 3") == ["gpl", "gpl-3.0"]
    assert labels("GNU Lesser General Public License v2.1") == ["gpl", "lgpl-2.1"]
    assert labels("BSD 3-Clause License") == ["bsd-3-clause"]
    assert labels("SPDX-License-Identifier: MIT") == ["spdx"]


def test_spans_are_words():
    n, hits = licenses.scan("Ünder – the \"MIT License\", 2020".encode())
    of = licenses.rules()
    assert n == 6 and [(a, b, of[i].label) for a, b, i in hits] == [(2, 5, "mit")]


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([("a", "CC BY", 5)], "hits string, text string, k int")
    got = licenses.scan_licenses(docs, ["k", "hits", "text"]).collect()
    assert got[0]["k"] == 5 and got[0]["text"] == "CC BY" and [(h["label"], h["start"], h["end"]) for h in got[0]["hits"]] == [("cc-by", 0, 2)]
    assert licenses.scan_licenses(docs.where("k < 0"), ["k"]).count() == 0


@pytest.mark.parametrize("text", ["redistribution and use " * 300, "copyright " * 2000, "licensed under the " * 1000, "neither the name of " + "x " * 4000])
def test_no_pattern_is_slow(text):
    import time

    t = time.time()
    licenses.scan(text.encode())
    assert time.time() - t < 2
