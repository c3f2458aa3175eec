"""Toxicity: a learned lexicon, matched by Levenshtein automata on its trie.

Fit: words and word beginnings (stems) whose share of toxic documents is far
above that of others become a lexicon of weighted terms.  Match: the lexicon is
a trie; the automaton of words within 1 edit (2 for long terms; a swap of
neighbours is one edit) is intersected with it and made deterministic as words
ask for it, so a word costs one table step a letter and most end after a few.
Score: each match counts with its weight (exact, or what misspellings of that
term meant in the training rows), less inside quotation marks or near a
reporting word, more near an address; a logistic model of the greatest and the
summed evidence gives the score.

labels, lang, source and doc_id never enter a score.  Training rows: labelled
rows whose crc32(doc_id as text) mod 4 is not 2, at most about FIT_ROWS of
them, taken by a hash of the doc_id.  That sample bounds all that the fit
holds: a term needs several toxic rows of it, so no feature or term is cut off.

Defined cases: null and empty texts get the score of a text without a match;
very long texts are read whole, with all their words; no labelled rows: an
empty lexicon and the score 0; an empty table of documents gives no rows; null
labels or ids don't train; a doc_id that repeats in labels counts by its
greatest label, one that repeats in documents trains by each row; rows that
repeat and ties score alike; extra columns are ignored by the fit and kept by
score and reject, but for `score` and `predicted`, which score replaces.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, settle, small_batches, table

#: Documented bound of the fit: labelled rows.
FIT_ROWS = 200_000
SUPPORT = 3
#: Log odds from which a feature is a term.
ODDS = 2.2
#: Log likelihood ratio that chance alone does not reach.  Of 6, 9, 11, 13, 15 and 18 it had the best F1 on a
#: third of the training rows of sf0.1, fitted on the others (0.836, 0.874, 0.879, 0.879, 0.892, 0.878).
SURPRISE = 15.0
#: Share of SURPRISE from which a feature is fetched: a word that may stand for its stem.
NEAR = 0.8
STEMS = range(4, 9)
CUT = 0.3
#: Words on either side that are a match's context, and letters in which a quotation is looked for.
WINDOW = 6
QUOTE_LETTERS = 200

TOKEN = re.compile(r"[^\W_]+(?:[@$*!|'’][^\W_]+)*")
LEET = str.maketrans("013457@$!|", "oieastasii")
#: Cue words, fixed values: who reports what another said, and who addresses the reader.
REPORTS = frozenset("said says wrote writes quoted quotes quote called word words term terms dit écrit cité mot mots sagte schrieb zitat wort wörter dijo escribió cita palabra palabras".split())
ADDRESSES = frozenset("you your you're youre yourself u ur tu te toi vous du dich dir ihr euch usted eres ti".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "»": "«"}


def normal(token: str) -> str:
    """A lowered token as a word: letters for the figures and signs that stand for them."""
    return token if token.isalpha() else token.translate(LEET)


def words_of(text: str) -> list[str]:
    return [normal(w) for w in TOKEN.findall(text.lower()) if not w.isdigit()]


def features_of(words: set[str]) -> set[str]:
    """A word itself, and its beginnings marked by a star."""
    out = set(words)
    for w in words:
        for k in STEMS:
            if len(w) >= k:
                out.add(w[:k] + "*")
    return out


# --- the automaton ----------------------------------------------------------


def edits(term: str) -> int:
    n = len(term.rstrip("*"))
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Trie of terms intersected with Levenshtein automata, determinised on demand.

    An item is a trie node, the edits so far and a letter that a swap still waits
    for, packed in one number; a state is its items in order, as bytes.
    """

    LIMIT = 200_000
    EDITS, LETTER, NODE = 21, (1 << 21) - 1, 24

    def __init__(self, terms: list[str]) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.allowed = [edits(t) for t in terms]
        self.reach = [0]
        for i, t in enumerate(terms):
            node, path = 0, [0]
            for c in t.rstrip("*"):
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({}), self.word.append(-1), self.stem.append(-1), self.reach.append(0)
                node = self.kids[node][c]
                path.append(node)
            if t.endswith("*"):
                self.stem[node] = i
            else:
                self.word[node] = i
            for p in path:
                self.reach[p] = max(self.reach[p], self.allowed[i])
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.items: list[bytes] = []
        self.steps: list[dict[str, int]] = []
        self.stems: list[tuple[int, int] | None] = []
        self.ends: list[tuple[int, int] | None] = []
        self.add(b"")  # state 0 is dead
        self.start = self.add(self.close([0]))

    def unpack(self, x: int) -> tuple[int, int, int]:
        return x >> self.NODE, (x >> self.EDITS) & 7, x & self.LETTER

    def pack(self, node: int, e: int, letter: int = 0) -> int:
        return node << self.NODE | e << self.EDITS | letter

    def close(self, stack: list[int]) -> bytes:
        """With the trie's letters that the word left out."""
        least: dict[int, int] = {}
        reach, kids = self.reach, self.kids
        while stack:
            x = stack.pop()
            n, e, p = self.unpack(x)
            k = self.pack(n, 0, p)
            if e > reach[n] or least.get(k, 9) <= e:
                continue
            least[k] = e
            if not p:
                stack += [self.pack(kid, e + 1) for kid in kids[n].values()]
        return array("Q", sorted(k | e << self.EDITS for k, e in least.items())).tobytes()

    def add(self, items: bytes) -> int:
        if items in self.ids:
            return self.ids[items]
        at = self.ids[items] = len(self.items)
        self.items.append(items)
        self.steps.append({})
        whole = [self.unpack(x) for x in array("Q", items)]
        for kind, out in ((self.stem, self.stems), (self.word, self.ends)):
            hits = [(e, kind[n]) for n, e, p in whole if not p and kind[n] >= 0 and e <= self.allowed[kind[n]]]
            out.append(min(hits) if hits else None)
        return at

    def step(self, state: int, c: str) -> int:
        out, letter = [], ord(c)
        for x in array("Q", self.items[state]):
            n, e, p = self.unpack(x)
            if p:
                if p == letter:
                    out.append(self.pack(n, e))
                continue
            kids = self.kids[n]
            if c in kids:
                out.append(self.pack(kids[c], e))
            if e < self.reach[n]:
                out.append(self.pack(n, e + 1))
                for y, k in kids.items():
                    out.append(self.pack(k, e + 1))
                    if y != c and c in self.kids[k]:
                        out.append(self.pack(self.kids[k][c], e + 1, ord(y)))
        to = self.add(self.close(out))
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the least one on ties."""
        if len(self.items) > self.LIMIT:
            self.reset()
        s, best = self.start, None
        for c in word:
            t = self.steps[s].get(c)
            s = self.step(s, c) if t is None else t
            if not s:
                return best
            if (hit := self.stems[s]) is not None and (best is None or hit < best):
                best = hit
                if not hit[0]:
                    return best
        hit = self.ends[s]
        return hit if hit is not None and (best is None or hit <= best) else best


# --- evidence ---------------------------------------------------------------


def quoted(text: str, at: int) -> bool:
    """Whether a quotation holds the place that opens and closes within QUOTE_LETTERS of it."""
    before, after = text[max(0, at - QUOTE_LETTERS) : at], text[at : at + QUOTE_LETTERS]
    for a, b in QUOTES.items():
        if a == b:
            if before.count(a) % 2 and b in after:
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    return False


class Matcher:
    """Matches of a text, with the factor of their context.

    Stretches without white space in which nothing matches are remembered, so
    that a text is mostly a difference of sets; once there are LIMIT of them,
    new ones are matched anew.
    """

    LIMIT = 400_000

    def __init__(self, terms: list[str]) -> None:
        self.automaton = Automaton(terms)
        self.dull: set[str] = set()
        self.known: dict[str, tuple[int, int]] = {}

    def token(self, w: str) -> tuple[int, int] | None:
        if w in self.known:
            return self.known[w]
        hit = None if w.isdigit() else self.automaton.match(normal(w))
        if hit is not None:
            if len(self.known) > self.LIMIT:
                self.known.clear()
            self.known[w] = hit
        return hit

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        low = text.lower()  # places are those of the lowered text, which may be longer
        found = {}
        for stretch in set(low.split()).difference(self.dull):
            mine = {w: hit for w in TOKEN.findall(stretch) if (hit := self.token(w)) is not None}
            if mine:
                found.update(mine)
            elif len(self.dull) < self.LIMIT:
                self.dull.add(stretch)
        if not found:
            return []
        tokens = [w for w in TOKEN.findall(low) if not w.isdigit()]
        starts = [m.start() for m in TOKEN.finditer(low) if not m.group().isdigit()] if any(q in low for q in QUOTES) else None
        out = []
        for i, w in enumerate(tokens):
            if w in found:
                near = set(map(normal, tokens[max(0, i - WINDOW) : i + WINDOW + 1]))
                reported = not near.isdisjoint(REPORTS)
                factor = 1.0
                if starts and quoted(low, starts[i]):
                    factor = 0.25 if reported else 0.5
                elif reported:
                    factor = 0.7
                elif not near.isdisjoint(ADDRESSES):
                    factor = 1.25
                out.append((*found[w], factor))
        return out


def evidence(hits: list[tuple[int, int, float]], exact: list[float], fuzzy: list[float]) -> tuple[float, float]:
    values = [max(0.0, (exact if not e else fuzzy)[t]) * f for e, t, f in hits]
    return (max(values), math.log1p(sum(values))) if values else (0.0, 0.0)


def odds(pos: float, neg: float, p: int, n: int) -> float:
    return math.log((pos + 0.5) / (p + 1)) - math.log((neg + 1) / (n + 1))


def surprise(pos: int, neg: int, p: int, n: int) -> float:
    """Log likelihood ratio of a feature's own toxic share against that of all rows.

    Among so many rare words some are in toxic rows only by chance; e^-SURPRISE
    times the features that are looked at is less than one such word.
    """
    rate, k = p / (p + n), pos + neg
    return pos * math.log(pos / (k * rate)) + (neg * math.log(neg / (k * (1 - rate))) if neg else 0.0)


def choose(counts: dict[str, tuple[int, int]], p: int, n: int) -> dict[str, tuple[int, int]]:
    """Terms of the features: stems that stand for their words come first."""
    good = {f: c for f, c in counts.items() if c[0] >= SUPPORT and odds(*c, p, n) >= ODDS and surprise(*c, p, n) >= SURPRISE}
    kept: dict[str, tuple[int, int]] = {}
    for f in sorted(good, key=lambda f: (not f.endswith("*"), len(f), f)):
        stem = f.rstrip("*")
        above = [s for k in STEMS if k <= len(stem) and (s := stem[:k] + "*") != f and s in kept]
        if not above:
            kept[f] = good[f]
        elif f.endswith("*") and good[f][0] >= kept[above[-1]][0]:
            del kept[above[-1]]  # as common and longer
            kept[f] = good[f]
        elif odds(*good[f], p, n) > odds(*kept[above[-1]], p, n) + 0.5:
            kept[f] = good[f]
    # A stem that is one word only is that word.
    for f in [f for f in kept if f.endswith("*")]:
        word = f[:-1]
        if counts.get(word, (0, 0))[0] >= 0.9 * kept[f][0]:
            del kept[f]
            kept[word] = counts[word]
    return {f: kept[f] for f in sorted(kept)}


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps; the last column is the intercept and has no penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + ridge, x.T @ (q - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counter(wanted=None):
    """Rows of each feature, or of each that is wanted, that a part of the input holds."""

    def run(batches):
        counts: Counter = Counter()
        names = frozenset(wanted.value.to_pylist()) if wanted else None
        dull: set[str] = set()
        for batch in batches:
            for text in batch.column(0):
                words = set(words_of(text.as_py() or ""))
                if wanted:
                    found: set[str] = set()
                    for w in words - dull:
                        mine = features_of({w}) & names
                        if mine:
                            found |= mine
                        elif len(dull) < Matcher.LIMIT:
                            dull.add(w)
                    counts.update(found)
                else:
                    counts.update(features_of(words))
                if len(counts) > 200_000:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return run


def _counted(counts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "k"])


def _train_hits(model, name: str):
    def run(batches):
        matcher = once(("terms", name), lambda: Matcher(model.value))
        for batch in batches:
            found = [matcher.hits(t.as_py() or "") for t in batch.column(0)]
            kinds = [[[t, e, int(round(f * 100))] for e, t, f in h] for h in found]
            flat = [[v for x in k for v in x] for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(flat, pa.list_(pa.int32()))], ["toxic", "hits"])

    return run


def near_terms(names: pa.Array, pos: np.ndarray, neg: np.ndarray, p: int, n: int) -> dict[str, tuple[int, int]]:
    """Counts of the features that are terms, or may stand for a stem that is one."""
    k, rate = pos + neg, p / (p + n)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = pos * np.log(pos / (k * rate)) + np.where(neg > 0, neg * np.log(neg / (k * (1 - rate))), 0.0)
    keep = far >= NEAR * SURPRISE - 1e-9
    return {f: (int(a), int(b)) for f, a, b in zip(names.filter(pa.array(keep)).to_pylist(), pos[keep], neg[keep])}


def least_support(p: int, n: int) -> int:
    """So many toxic rows a feature needs: with fewer its surprise is too low even without others."""
    return max(SUPPORT, math.ceil(NEAR * SURPRISE / -math.log(p / (p + n))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Terms, their weights and the logistic model; a few thousand numbers.

    The sampled labels are few enough to be broadcast, so texts are never
    shuffled: each pass reads the documents and keeps the labelled ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    train = train.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = train.count()
    if size > fit_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(fit_rows / size * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(train), "doc_id").select("text", "toxic")
    sizes = {r["toxic"]: r["k"] for r in rows.groupBy("toxic").agg(F.count("*").alias("k")).collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not n:
        return {"terms": [], "name": "", "exact": [], "fuzzy": [], "w": None}

    def counted(toxic: int, wanted=None) -> DataFrame:
        return rows.where(F.col("toxic") == toxic).select("text").mapInArrow(_counter(wanted), "feature string, k long").groupBy("feature").agg(F.sum("k").alias("k"))

    # Counts stay in columns; only features near enough to a term become Python's.
    pos = counted(1).where(F.col("k") >= least_support(p, n)).toArrow()
    names = pos.column("feature").combine_chunks()
    wanted = sc.broadcast(names)
    neg = counted(0, wanted).toArrow()
    wanted.destroy()
    place = pc.index_in(names, neg.column("feature").combine_chunks()).to_numpy(zero_copy_only=False)
    others = np.append(neg.column("k").to_numpy(), 0)[np.nan_to_num(place, nan=-1).astype(np.int64)]
    counts = near_terms(names, pos.column("k").to_numpy(), others, p, n)
    del pos, neg, names
    counts = choose(counts, p, n)
    terms, name = list(counts), uuid.uuid4().hex
    lexicon = sc.broadcast(terms)
    found = rows.mapInArrow(_train_hits(lexicon, name), "toxic int, hits array<int>").toArrow()
    lexicon.destroy()
    labels_of = found.column("toxic").to_numpy()
    lists = found.column("hits").combine_chunks()
    ends = np.cumsum(np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy().reshape(-1, 3)  # term, edits, context in hundredths
    of = np.split(flat, ends[:-1] // 3) if len(ends) else []
    exact = [odds(*counts[t], p, n) for t in terms]
    near = np.zeros((len(terms), 2))
    for label, h in zip(labels_of, of):
        near[np.unique(h[h[:, 1] > 0, 0]), 0 if label else 1] += 1
    fuzzy = [0.6 * exact[t] if not near[t].sum() else min(exact[t], odds(*near[t], p, n)) for t in range(len(terms))]
    # Without the row's own share in the counts, as for a row that is new.
    less = [odds(max(0, counts[t][0] - 1), counts[t][1], p, n) if counts[t][0] - 1 >= SUPPORT - 1 else 0.0 for t in terms]
    kinds = {y: np.maximum(0.0, np.array([less if y else exact, fuzzy])).reshape(2, -1) for y in (0, 1)}
    x, y = np.zeros((len(of), 3)), labels_of.astype(float)
    x[:, 2] = 1.0
    for i, h in enumerate(of):
        if len(h):
            values = kinds[int(labels_of[i] == 1)][(h[:, 1] > 0).astype(int), h[:, 0]] * h[:, 2] / 100
            x[i, :2] = values.max(), math.log1p(values.sum())
    order = np.lexsort((y, *x.T))
    w = logistic(x[order], y[order])
    del found, lists, flat, of
    settle(spark)
    return {"terms": terms, "name": name, "exact": exact, "fuzzy": fuzzy, "w": w.tolist()}


def _score(model, reject: bool = False):
    """Rows with their score after the text's other columns, or the rows that are not toxic."""

    def run(batches):
        m = model.value
        matcher = once(("terms", m["name"]), lambda: Matcher(m["terms"]))
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1):
                if m["w"] is None:
                    scores.append(0.0)
                    continue
                top, total = evidence(matcher.hits(text.as_py() or ""), m["exact"], m["fuzzy"])
                z = m["w"][0] * top + m["w"][1] * total + m["w"][2]
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            kept, names = batch.columns[:-1], batch.schema.names[:-1]
            if reject:
                yield pa.RecordBatch.from_arrays(kept, names).filter(pa.array([x < CUT for x in scores], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*names, "score"])

    return run


def _scored(docs: DataFrame, model: dict, keep: list[str], reject: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.col("text").alias("_scored"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), reject), fields if reject else f"{fields}, score double")


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep, score (0 to 1), predicted of each row's text."""
    return _scored(docs, model, [c for c in keep if c not in ("score", "predicted")], False).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    return _scored(docs, fit(docs, labels), docs.columns, True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return score(docs, model, ["doc_id"]).select("doc_id", held, "score", "predicted")
