"""License notices by ordered signature rules.

A text's words (lower case, one space between them) are met by hundreds of
patterns.  One automaton of all keywords passes over a text first, so patterns
run only on texts that hold their keyword; a text without one, as most are,
meets none.  Hits that overlap are resolved by priority and containment: a hit
within the span of one of higher priority goes, and so does one within a span
of its own priority, of equal spans the one of the later rule.  Spans that only
overlap both stay.  Base phrases stand for themselves: each of their places is
told, none hides another rule's hit or is hidden by it.

Defined cases: a null or empty text has no words, no hits and score 0; words
are runs of ASCII letters and digits and of all characters beyond ASCII; very
long texts are scanned whole; rows that repeat are scanned each; an empty table
gives no rows; kept columns may have any name but n_words and hits, which are made.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .license_rules import BASE, RULES, SHORT

MADE = ["n_words", "hits"]
HIT = "array<struct<label:string,rule:int,priority:int,weight:double,base:boolean,start:long,end:long>>"
#: Lower case, and a space for each byte that is in no word.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    weight: float
    keyword: str
    pattern: re.Pattern
    priority: int
    base: bool


@functools.cache
def rules() -> list[Rule]:
    out, priority = [], 0
    for base, text in ((True, BASE), (False, RULES)):
        for line in text.strip().splitlines():
            if line.startswith("["):
                priority = int(line[1 : line.index("]")])
            elif line:
                label, weight, keyword, pattern = line.split(" | ")
                for short, whole in SHORT.items():
                    pattern = pattern.replace(short, whole)
                out.append(Rule(label, float(weight), keyword, re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])"), priority, base))
    return out


@functools.cache
def gate():
    """An automaton whose finds are the rules of a keyword that starts a word."""
    import ahocorasick

    by: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        by.setdefault(f" {rule.keyword}", []).append(i)
    out = ahocorasick.Automaton()
    for keyword, which in by.items():
        out.add_word(keyword, tuple(which))
    out.make_automaton()
    return out


def resolved(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule) those that stay, by start."""
    all_rules, kept = rules(), []
    by: dict[int, list[tuple[int, int, int]]] = {}
    for hit in hits:
        by.setdefault(all_rules[hit[2]].priority, []).append(hit)
    for priority in sorted(by, reverse=True):
        i, reach, over = 0, -1, sorted(kept)
        for hit in sorted(by[priority], key=lambda h: (h[0], -h[1], h[2])):
            while i < len(over) and over[i][0] <= hit[0]:
                reach, i = max(reach, over[i][1]), i + 1
            if reach < hit[1]:
                kept.append(hit)
                reach = hit[1]
    return sorted(kept)


def scan(text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of words, and (first word, word after the last, rule) of each hit, by place."""
    words = text.translate(WORDS).split()
    line = b" ".join(words).decode()
    some = {i for _, which in gate().iter(f" {line}") for i in which}
    found, base, all_rules = [], [], rules()
    for i in sorted(some):
        (base if all_rules[i].base else found).extend((m.start(), m.end(), i) for m in all_rules[i].pattern.finditer(line))
    hits = sorted(base + resolved(found))
    # Letters to words: each stretch of the text is counted once.
    place, at, n = {}, 0, 0
    for x in sorted({p for h in hits for p in h[:2]}):
        n += line.count(" ", at, x)
        place[x], at = n, x
    return len(words), [(place[a], place[b] + 1, i) for a, b, i in hits]


def scan_licenses(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words and hits of each row's text: hits by place, `end` after the last word."""
    small_batches(docs.sparkSession, 1000)
    keep = [c for c in keep if c not in MADE]
    rows = docs.select(F.col("text").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rules = rules()
        for batch in batches:
            counts, hits = [], []
            for text in batch.column(0).cast(pa.binary()):
                n, found = scan(text.as_py() or b"")
                counts.append(n)
                hits.append([{"label": (r := all_rules[i]).label, "rule": i, "priority": r.priority, "weight": r.weight, "base": r.base, "start": a, "end": b} for a, b, i in found])
            kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(hits, kind)], [*keep, *MADE])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""
    return rows.mapInArrow(run, f"{fields}n_words long, hits {HIT}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: that one of the labels found is right, each as sure as its surest hit and on its own."""
    found = scan_licenses(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    base = F.filter("hits", lambda h: h["base"])
    label = lambda hits: F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"])))
    found = found.withColumn("_base", base).withColumn("_labels", label(F.col("hits")))
    doubt = F.transform("_labels", lambda name: 1 - F.array_max(F.transform(F.filter("hits", lambda h: h["label"] == name), lambda h: h["weight"])))
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.start").alias("first_word"), F.array_max("_base.start").alias("last_word"),
        F.array_join(label(F.col("_base")), ",").alias("base_labels"), F.array_join("_labels", ",").alias("labels"),
        (1 - F.aggregate(doubt, F.lit(1.0), lambda a, x: a * x)).alias("score"),
    )
