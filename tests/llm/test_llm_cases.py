"""Results against brute force, and the cases each operator defines: empty
tables, repeated rows, clashing columns, very long texts."""

import collections
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chat_format, common, decontamination, html_text, jaccard_join, ppm, substring_dedup, token_counts, topk, toxicity

M = (1 << 64) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators use for themselves or give out.
CLASH = ["block", "_block", "score", "predicted", "n_tokens", "ids_sha256", "decoded_sha256", "n_words", "n_removed", "n_chunks", "n_repeats", "s1", "rep", "token", "h", "p", "w", "host", "path", "rank", "n"]


def frame(spark, rows, ids=None):
    data = [(i, t, *[-1] * len(CLASH)) for i, t in zip(ids if ids is not None else range(len(rows)), rows)]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASH))


def texts(seed=1, n=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 90))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "other"
            rows.append(" ".join(copy))
    return [*rows, "", None, "one two", "İ said “ok”", rows[0]]


# --- substring dedup --------------------------------------------------------------


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def chunks_of(text):
    """(first word, words) of each chunk of a text, one byte at a time."""
    low = b"\n" * 16 + text.translate(LOWER).encode()
    spaces = b" \t\n\x0b\x0c\r"
    words, i = [], 16
    while i < len(low):
        if low[i] in spaces:
            i += 1
            continue
        j = i
        while j < len(low) and low[j] not in spaces:
            j += 1
        words.append((i, j))
        i = j
    gear = [mix(b + 1) >> 32 for b in range(256)]
    out, begin = [], 0
    for k, (a, b) in enumerate(words):
        h = 0
        for c in low[b - 16 : b]:
            h = (h * 2 + gear[c]) & 0xFFFFFFFF
        line = k + 1 < len(words) and b"\n" in low[b : words[k + 1][0]]
        if (h >> 12) & 3 == 0 or line or k + 1 == len(words):
            out.append((begin, k + 1))
            begin = k + 1
    return [(a, b, tuple(low[x:y] for x, y in words[a:b])) for a, b in out], [(x - 16, y - 16) for x, y in words]


def brute_dedup(rows, least):
    """Texts without runs of repeated chunks of so many words, and removed words."""
    seen = {}
    for i, t in rows:
        for a, _, c in chunks_of(t or "")[0]:
            seen.setdefault(c, []).append((i, a))
    out = []
    for i, t in rows:
        if t is None:
            out.append((None, 0))
            continue
        found, words = chunks_of(t)
        raw, repeat = t.encode(), [len(seen[c]) > 1 and min(seen[c]) != (i, a) for a, _, c in found]
        kept, p, removed, k = [], 0, 0, 0
        while k < len(found):
            j = k
            while j < len(found) and repeat[j]:
                j += 1
            n = found[j - 1][1] - found[k][0] if j > k else 0
            if n >= least:
                lo = words[found[k][0]][0]
                hi = words[found[j][0]][0] if j < len(found) else words[found[j - 1][1] - 1][1]
                kept.append(raw[p:lo])
                p, removed = hi, removed + n
            k = max(j, k + 1)
        out.append((b"".join([*kept, raw[p:]]).decode(), removed))
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(3)
    passages = [" ".join(f"p{rng.randrange(300)}" for _ in range(n)) for n in (35, 60, 90)]
    rows = []
    for i in range(60):
        w = [f"d{i}x{rng.randrange(99)}" for _ in range(rng.randint(5, 60))]
        for _ in range(rng.choice([0, 1, 2])):
            w.insert(rng.randrange(len(w)), rng.choice(passages).title() if rng.random() < 0.3 else rng.choice(passages))
        rows.append(rng.choice([" ", "\n", " \t "]).join(w))
    rows += ["", None, rows[4], passages[1], "long " * 40000]
    ids = [*range(len(rows) - 1), 4]  # the last one shares an id with another text
    want = brute_dedup(list(zip(ids, rows)), 30)
    got = substring_dedup.remove_repeats(frame(spark, rows, ids).repartition(7).withColumn("place", F.lit(1)))
    assert collections.Counter((r["text"], r["n_removed"]) for r in got.collect()) == collections.Counter(want)
    assert got.columns[:2] == ["doc_id", "text"] and {"block", "score", "place"} <= set(got.columns) and got.columns.count("n_words") == 1
    assert [r["block"] for r in got.limit(3).collect()] == [-1] * 3


# --- HTML ---------------------------------------------------------------------------


def test_html_odd_pages():
    def read(page):
        found = html_text.blocks(page)
        return html_text.text_at(found, html_text.main_path(found)[0])

    assert read("<p title=it's ok>Hello</p><p>don't</p>") == "Hello don't"
    assert read("<body><form><article><p>Story text here</p></article><input></form></body>") == "Story text here"
    assert read('<article><p class="form-factor">A factor.</p><div class="related-work">Work.</div></article>') == "A factor. Work."
    assert read('<a href="x>unclosed') == "unclosed"
    assert read("a < b and <b>c</b> > d") == "a < b and c > d"
    assert read('<div class="comments"><article><p>first!</p></article></div><article><h1>T</h1><p>Body</p></article>') == "T Body"
    assert read('<article><p>short</p></article><div class="ad">an advert much longer than the story is</div>') == "short"
    assert read('<article><p>x y</p><div class="share-links"><a href="/">tell all</a></div></article>') == "x y"


def test_html_is_linear():
    import time

    def seconds(page):
        t = time.perf_counter()
        html_text.all_blocks(page)
        return time.perf_counter() - t

    for piece in ('<a href="x ', "<a b='", "<a ", "<!-- ", "<script ", "<a\t= = ", "</", "&lt"):
        assert seconds(piece * (1_000_000 // len(piece))) < 5, piece


def test_html_votes_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        body = " ".join(f"t{rng.randrange(50)}" for _ in range(rng.randint(3, 30)))
        shape = rng.choice(["<main><div class='c{}'><p>{}</p></div></main><div class=side-note>{}</div>", "<div class=x{}><p>{}</p></div><p>{}</p>", "<div><div class=y{}>{}<br>{}</div></div>"])
        rows.append((i, rng.choice(["https://A.x/1", "http://a.x:80/2", "https://b.y", None]), f"<body>{shape.format(i % 3, body, 'tail ' * (i % 4))}</body>"))
    votes = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
    host = lambda u: "" if u is None else re.match(r"\w+://([^/:?#]*)", u)[1].lower()
    for _, u, h in rows:
        path, size = html_text.main_path(html_text.blocks(h))
        if path:
            v = votes[host(u)][path]
            v[0] += 1
            v[1] += size
    best = {k: max(v, key=lambda p: (*v[p], p)) for k, v in votes.items()}
    want = {i: html_text.text_at(html_text.blocks(h), best.get(host(u))) for i, u, h in rows}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("path", F.lit("mine"))
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == want
    old = html_text.BROADCAST_BYTES
    try:
        html_text.BROADCAST_BYTES = 0  # joined instead
        assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == want
    finally:
        html_text.BROADCAST_BYTES = old


# --- chats ----------------------------------------------------------------------------

SCHEMA = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 0, "maximum": 10}, "b": {"type": ["string", "null"], "enum": ["x", "y", None]},
    "c": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}}}, "maxItems": 2},
    "d": {"type": "number"}, "f": {"const": 5}}}


def holds(s, v):
    """A schema held against a value, brute force."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}

    def is_(t):
        if isinstance(v, bool):
            return t == "boolean"
        return isinstance(v, kinds[t]) or t == "integer" and isinstance(v, float) and v == int(v)

    ts = s.get("type", [])
    if ts and not any(map(is_, [ts] if isinstance(ts, str) else ts)):
        return False
    if "enum" in s and v not in s["enum"] or "const" in s and v != s["const"]:
        return False
    if isinstance(v, dict):
        props = s.get("properties", {})
        if any(r not in v for r in s.get("required", [])) or s.get("additionalProperties") is False and set(v) - set(props):
            return False
        return all(holds(p, v[k]) for k, p in props.items() if k in v)
    if isinstance(v, list):
        return len(v) <= s.get("maxItems", 99) and all(holds(s.get("items", {}), x) for x in v)
    if isinstance(v, str):
        return len(v) >= s.get("minLength", 0) and re.search(s.get("pattern", ""), v) is not None
    return not (isinstance(v, (int, float)) and not isinstance(v, bool)) or s.get("minimum", v) <= v <= s.get("maximum", v)


def test_chat_schemas_against_brute_force(spark):
    rng = random.Random(9)
    values = {"a": [1, 1.0, 1.5, 11, "1", None, True], "b": ["x", None, "q", 1], "c": [[{"k": "ab"}], [{"k": "a"}], [{"k": "AB"}], [{}], [1], [{"k": "ab"}] * 3, {}], "d": [1, 2.5, "x"], "f": [5, 6], "z": [1]}
    args = [{k: rng.choice(v) for k, v in values.items() if rng.random() < p} for p in (0.2, 0.5, 0.7) for _ in range(60)] + [[1], None, 3]
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": SCHEMA}, {"name": "g", "parameters": {"anyOf": [], "type": "object"}}]}))]
    rows.append((1, 1, "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "f", "arguments": a} for i, a in enumerate(args)] + [{"id": "open", "name": "g", "arguments": {}}, {"id": "no", "name": "g", "arguments": 1}]})))
    out = {r["call_id"]: r["valid"] for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()}
    assert out.pop("open") is None and out.pop("no") is False
    assert out == {f"c{i}": holds(SCHEMA, a) for i, a in enumerate(args)}
    assert len({holds(SCHEMA, a) for a in args}) == 2


def test_chat_order_extends_the_links(spark):
    """A random conversation: each event comes after all that it depends on."""
    rng = random.Random(11)
    calls = [[f"t{t}c{i}" for i in range(rng.randint(0, 3))] for t in range(8)]
    rows = [(7, t, "assistant", json.dumps({"content": "x", "tool_calls": [{"id": c, "name": "f", "arguments": {"i": i}} for i, c in enumerate(cs)]})) for t, cs in enumerate(calls)]
    rows += [(7, rng.randrange(9), "tool", json.dumps({"tool_call_id": c, "content": f"r{k}"})) for cs in calls for c in cs for k in range(rng.choice([0, 1, 2]))]
    rows += [(7, 3, "user", "hello"), (7, 3, "user", "hello"), (7, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": "?"}))]
    rng.shuffle(rows)
    keys = ["order_turn", "order_phase", "order_seq", "order_own", "json"]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy(*keys).collect()
    at = {r["call_id"]: i for i, r in enumerate(out) if r["kind"] == "call"}
    assert set(at) == {c for cs in calls for c in cs}
    for i, r in enumerate(out):
        if r["kind"] == "result" and r["call_id"] in at:
            assert at[r["call_id"]] < i and r["status"] == "linked"
        if r["kind"] == "call":
            message = next(j for j, m in enumerate(out) if m["kind"] == "message" and m["turn"] == r["turn"])
            assert message < i
    assert [r["turn"] for r in out if r["kind"] == "message"] == sorted(r["turn"] for r in out if r["kind"] == "message")
    assert [at[c] for cs in calls for c in cs] == sorted(at.values())
    same = collections.Counter(tuple(r[k] for k in keys) for r in out)
    assert {k for k, n in same.items() if n > 1} == {(3, 0, 0, 3, '{"content":"hello","role":"user"}')}
    assert next(r["status"] for r in out if r["call_id"] == "nobody") == "orphan"


# --- near copies ------------------------------------------------------------------------


def sets_of(rows):
    out = []
    for t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def groups_of(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def edited(rng, n=150):
    """Groups of texts at all similarities about the threshold."""
    rows = []
    while len(rows) < n:
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(5, 70))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 15))):
                k, at = rng.randrange(3), rng.randrange(len(w))
                w[at : at + (k != 0)] = [f"v{rng.randrange(5000)}"] * (k != 1)
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_against_brute_force(spark, seed):
    rows = edited(random.Random(seed))
    root = groups_of(rows)
    least = {r: min(i for i, x in enumerate(root) if x == r) for r in root}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, rows).repartition(5)).collect()}
    assert got == {i: least[r] for i, r in enumerate(root)}


def test_jaccard_trees_find_what_leaders_miss(spark, monkeypatch):
    """Without leader links the trees find every link; without trees some are lost."""
    rows = edited(random.Random(5), 120)
    root = groups_of(rows)
    want = {i: min(j for j, x in enumerate(root) if x == r) for i, r in enumerate(root)}
    run = lambda: {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    empty = spark.createDataFrame([], "a long, b long")
    with monkeypatch.context() as m:
        first = []
        m.setattr(jaccard_join, "pruned", lambda star, sets: first.append(1) or common.saved(empty))
        assert run() == want and first
    with monkeypatch.context() as m:
        m.setattr(jaccard_join, "tree_pairs", lambda *a, **k: common.saved(empty))
        without = run()
    assert all(without[i] >= want[i] for i in want)


def test_partners_by_hand():
    import numpy as np

    token, n = np.array([1, 1, 1, 2, 2, 3, 3]), np.array([8, 10, 30, 8, 10, 8, 20], dtype=np.int32)
    strong = np.array([True, False, True, False, False, True, True])
    assert jaccard_join.partnered(token, n, strong, 0).tolist() == [True, True, False, False, False, False, False]
    assert jaccard_join.partnered(token, n, strong, 7)[:3].tolist() == [True, True, False]


def test_large_buckets_go_in_parts(monkeypatch):
    """However a bucket is parted, no row goes that has a partner, and leaders are of the bucket."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted({(int(rng.integers(1, 6)), int(rng.integers(5, 60)), int(rng.integers(1, 500)), bool(rng.random() < 0.4)) for _ in range(300)}, key=lambda r: r[:3])
    rows = [r for i, r in enumerate(rows) if not i or rows[i - 1][0] != r[0] or rows[i - 1][2] != r[2]]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows])], ["token", "s1", "n", "strong"])

    def fits(a, b):
        small, large = sorted((a, b), key=lambda r: r[1])
        return a[0] == b[0] and a is not b and 4 * small[1] >= 3 * large[1] and (small[3] if a[1] != b[1] else a[3] or b[3])

    needed = {(a[0], a[2]) for a in rows for b in rows if fits(a, b) and (a[3] and b[3] or a[1] != b[1])}
    for part, size in ((1 << 16, 400), (5, 400), (5, 3), (1, 1)):
        monkeypatch.setattr(jaccard_join, "PART", part)
        out = [r for b in jaccard_join._runs([batch.slice(i, size) for i in range(0, len(rows), size)]) for r in b.to_pylist()]
        got = {(r["token"], r["s1"]) for r in out}
        assert needed <= got
        if part > 100:
            assert len(got) < len(rows)
        of = {(r[0], r[2]) for r in rows}
        assert all((r["token"], r["leader"]) in of for r in out)


def test_a_shared_id_links_nothing(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    near = lambda t, k: " ".join([*t.split()[:-1], f"new{k}"])
    df = frame(spark, [a, b, near(a, 1), near(b, 2)], [5, 5, 8, 9])
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()) == [(5, 5), (5, 5), (8, 5), (9, 5)]
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.dedup(df).collect()) == [(5, a), (5, b)]


def test_dedup_of_odd_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = frame(spark, [a, a, a, b, b, "", "", None, a], [4, 4, None, None, None, 6, 6, None, 9])
    got = jaccard_join.dedup(df)
    assert got.columns == df.columns
    want = [(4, a), (6, ""), (6, ""), (None, b), (None, None)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter(want)


# --- decontamination ---------------------------------------------------------------------


def brute_leaks(docs, items):
    """Every item-sized window of every document."""
    grams = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)]
    out = {}
    for d, t in docs:
        s = grams(t)
        for i, x in items:
            m = grams(x)
            for a in range(max(1, len(s) - len(m) + 1) if s and m else 0):
                k = collections.Counter(s[a : a + len(m)])
                o = sum((k & collections.Counter(m)).values())
                u = sum(k.values()) + len(m) - o
                if d is not None and i is not None and 4 * o >= 3 * u:
                    out[d, i] = max(out.get((d, i), 0), o / u)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_every_window(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(rng.randint(5, 45)))) for i in range(12)]
    items += [(3, " ".join(f"q{rng.randrange(60)}" for _ in range(30))), (13, "tiny item"), (None, items[0][1]), (14, " ".join(["same"] * 20))]
    docs = []
    for d in range(60):
        w = [f"d{rng.randrange(60)}" for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            x = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                k, at = rng.randrange(3), rng.randrange(len(x))
                x[at : at + (k != 0)] = [f"q{rng.randrange(60)}"] * (k != 1)
                x = x or ["q"]
            at = rng.randint(0, len(w))
            w[at:at] = x
        docs.append((d % 50, rng.choice([" ", ", "]).join(w)))
    docs += [(70, None), (71, ""), (72, "same " * 500)]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, item long, fp int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(df, bench).collect()}
    assert got == pytest.approx(brute_leaks(docs, items)) and len(got) >= 5


def test_the_join_beyond_the_broadcast(spark, monkeypatch):
    rows, items = texts(2), spark.createDataFrame([(i, t) for i, t in enumerate(texts(2, 8)[:8])], "item_id long, text string")
    key = lambda: sorted(map(tuple, decontamination.leaks(frame(spark, rows), items).collect()))
    want = key()
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(common, "FEW_IDS", 0)
    assert key() == want and want


def test_simhash_blocks_keep_the_radius():
    """Fingerprints within RADIUS agree in a block: what the multi-index rests on."""
    n = decontamination.RADIUS + 1
    edges = [i * 64 // n for i in range(n + 1)]
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), decontamination.RADIUS):
            b ^= 1 << i
        assert any((a ^ b) >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in zip(edges, edges[1:]))


def test_fingerprints_of_any_length(spark):
    rng = random.Random(2)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 255, 256, 700)]
    got = [r["f"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<long>").orderBy("i").select(decontamination.fingerprint("h").alias("f")).collect()]
    for r, f in zip(rows, got):
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r) > len(r))
        assert f == (want - (1 << 64) if want >> 63 else want)


# --- toxicity -------------------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    """Trained on some rows, right about others; every planted term is learnt without a cap."""
    rng = random.Random(8)
    bad = [f"{a}{b}" for a in ("grob", "snark", "flim", "dreck", "zund") for b in ("ling", "hound", "weasel", "brain")]
    rows, labels = [], []
    for i in range(1600):
        w = [f"n{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append(" ".join(w))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), lab)
    out = toxicity.score(frame(spark, rows), model, ["doc_id", "text", *CLASH])
    assert out.columns.count("score") == out.columns.count("predicted") == 1 and "block" in out.columns
    import zlib

    held = [r for r in out.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["predicted"] == labels[r["doc_id"]][1] for r in held)
    assert len(held) > 300 and right >= 0.97 * len(held)
    assert toxicity.reject(frame(spark, rows), lab).columns == ["doc_id", "text", *CLASH]


def test_toxicity_places_and_ties(spark):
    m = toxicity.Matcher(["blockhead"])
    plain, quoted = m.hits("you blockhead"), m.hits('İİİİ said "you blockhead" here')
    assert plain[0][2] == 1.25 and quoted[0][2] == 0.25
    long = "x " * 200_000 + "blockhead"
    assert len(m.hits(long)) == 1 and m.hits("") == [] and m.hits("123 456") == []
    m.LIMIT = 0  # nothing is remembered
    assert m.hits("you blokhead, you!") == [(1, 0, 1.25)]


# --- language models, tokens ------------------------------------------------------------------


def test_ppm_rows_that_repeat(spark):
    rows = texts(4, 10)
    held = F.col("doc_id") % 3 == 0
    one = {r["doc_id"]: r for r in ppm.score(frame(spark, rows), held).collect()}
    ids = [*range(len(rows)), 5, 7]
    again = ppm.score(frame(spark, [*rows, rows[5], rows[7]], ids), held).collect()
    assert len(again) == len(ids)
    for i in (5, 7):
        a, b = [r["score"] for r in again if r["doc_id"] == i]
        assert a == b
    assert {r["train_tokens"] for r in again} != {one[1]["train_tokens"]}  # they train too
    nobody = ppm.score(frame(spark, rows), F.lit(True)).collect()
    assert {r["n_known"] for r in nobody} == {0} and {r["train_tokens"] for r in nobody} == {0}


def test_bpe_long_texts_go_through_the_tree(spark, monkeypatch):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    joins = []
    real = bpe.Codec.concatenated
    monkeypatch.setattr(bpe.Codec, "concatenated", lambda self, *a: joins.append(1) or real(self, *a))
    rng = random.Random(3)
    codec = bpe.Codec()
    for words in (["the", "and", "n't", "été", "1234", "!!", "\n\n", "日本語"], ["x" * 9000, "y"], ["a"]):
        for glue in (" ", "", "  \n"):
            text = glue.join(rng.choice(words) for _ in range(8000 if len(words) > 2 else 12)) + "<|endoftext|>" + " tail" * 5000
            joins.clear()
            assert codec.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids and joins
            assert codec.decode(codec.encode(text)) == text


def test_bpe_joins_need_their_windows(monkeypatch):
    """Halves put together as they are would be wrong: the window is what mends them."""
    codec = bpe.Codec(long_text=40, text_leaf=16)
    text = "understanding international organisations " * 20
    want = codec.flat(text, False).tolist()
    assert codec.encode(text, False).tolist() == want
    monkeypatch.setattr(bpe.Codec, "concatenated", lambda self, a, b, unsplit: (a[0] + b[0], bpe.np.concatenate([a[1], b[1]])))
    assert codec.encode(text, False).tolist() != want


# --- all of them --------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (
        decontamination.leaks(docs, bench), decontamination.leaks(frame(spark, ["a b c d e f g"]), bench.where("item_id < 0")), decontamination.clean(docs, bench), topk.top_k(vectors, vectors),
        bpe.encode_documents(docs, ["doc_id"]), ppm.score(docs, F.lit(False)), token_counts.token_counts(docs), toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]), toxicity.reject(docs, labels),
        substring_dedup.remove_repeats(docs), html_text.extract(pages), chat_format.format_chats(chats), jaccard_join.jaccard_components(docs), jaccard_join.dedup(docs),
    ):
        assert out.count() == 0


def test_clashing_columns_and_repeats(spark):
    rows = [*texts(6, 6), "y" * 5000]
    ids = [*range(len(rows) - 1), 0]
    df = frame(spark, rows, ids)
    counts = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(df).collect())
    assert len(counts) == len(rows) and [i for i, _ in counts].count(0) == 2
    out = bpe.encode_documents(df, ["doc_id", *CLASH])
    assert out.columns.count("n_tokens") == 1 and out.where("n_tokens < 0").count() == 0 and out.where("block = -1").count() == len(rows)
    assert bpe.encode_documents(df, ["doc_id"], with_ids=True).where("size(ids) <> n_tokens").count() == 0
    v = spark.createDataFrame([(i % 4, [float(i % 2), 1.0], 0, 0) for i in range(12)], "vec_id long, embedding array<float>, score int, rank int")
    assert topk.top_k(v, v.where("vec_id = 0")).columns == ["query_id", "rank", "vec_id", "score"]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_path(Session())


def test_once_keeps_one_thing():
    made = []
    assert common.once(("a", 1), lambda: made.append(1) or "x") == common.once(("a", 1), lambda: made.append(2) or "y") == "x"
    assert common.once(("b", 1), lambda: "z") == "z" and common.once(("a", 1), lambda: "again") == "again"


# --- the pipeline ------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import zlib

    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(12)
    bad = ["grobling", "snarkhound"]
    rows = []
    for i in range(500):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 70))]
        if i % 5 == 0:
            w[3] = rng.choice(bad)
        rows.append(" ".join(w))
    passage, item = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(70)) for c in "pq")
    for i in (11, 21, 31):
        rows[i] += " " + passage
    rows[42] = rows[41][:-3] + "end"  # a near copy
    rows[43] = rows[41]
    rows[52] += " " + item
    rows += ["", None, " ".join(f"z{i}" for i in range(30000))]
    labels = [(i, int(i % 5 == 0 and i < 500)) for i in range(len(rows)) if i % 3]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in enumerate(rows) if not set(bad) & set((t or "").split())]
    root = groups_of([t for _, t in left])
    left = [x for k, x in enumerate(left) if root[k] == k or not sets_of([x[1]])[0]]
    cut = brute_dedup(left, substring_dedup.MIN_WORDS)
    left = [(i, t) for (i, _), (t, _) in zip(left, cut)]
    gone = {d for d, _ in brute_leaks([(i, t) for i, t in left if len(t or "") < 10000], [(0, item)])}
    left = [(i, t) for i, t in left if i not in gone]
    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert set(got) == {i for i, _ in left} and 52 not in got and 43 not in got and 42 not in got and 5 not in got
    assert got[31]["text"] != rows[31] and got[500]["text"] == "" and got[501]["text"] is None
    for i, t in left:
        assert got[i]["text"] == t and got[i]["ids"] == whole.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_chars"] == len(t or "")
    assert got[11].asDict().keys() == {*corpus_pipeline.COLUMNS, "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    assert zlib.crc32(b"x")  # the split is by crc32, as the operator's
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_links_through_rows_without_an_id(spark):
    """Null ids in the middle of chains lose no link; classes without any id have none to tell."""
    rng = random.Random(12)
    rows, ids = [], []
    for c in range(25):
        words = [f"c{c}w{i}" for i in range(60)]
        for step in range(rng.randint(2, 5)):
            rows.append(" ".join(words))
            ids.append(None if c == 0 or step % 2 else len(rows) * 3)
            for _ in range(2):
                words[rng.randrange(step * 12, step * 12 + 12)] = f"z{rng.randrange(9999)}"
    rows += [rows[1], "", "few words"]
    ids += [None, None, None]
    sets = []
    for t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, len(s), least.get(g)) for i, s, g in zip(ids, sets, group)), key=str)
    docs = frame(spark, rows, ids)
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=str) == want
    assert any(i is None and least.get(g) is not None for i, g in zip(ids, group)) and len(set(group)) < len(rows) - 20
    # One row of each group stays, that of the least id that is known.
    kept = sorted((r["doc_id"] for r in jaccard_join.dedup(docs).collect()), key=str)
    alone = sum(1 for g in set(group) if g not in least and sets[g]) + sum(not s for s in sets)
    assert kept == sorted([*least.values(), *[None] * alone], key=str)


def test_bpe_query_against_the_tokenizers_library(spark, tmp_path):
    """Counts and digests of the query's rows, of texts short and long, as the library gives them."""
    import hashlib
    import struct

    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(21)
    rows = [*texts(4, 12), "a" * 9000, "é<|endoftext|>ü <|endoftext|>", "\r\n\t  x  　y", " ".join(f"w{rng.randrange(99)}" for _ in range(6000)), "😀" * 50, "<|endoftext"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("ids_sha256", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, text in enumerate(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.query(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want
