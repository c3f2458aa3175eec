"""Each operator against a brute-force version, with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chat_format, decontamination, html_text, jaccard_join, ppm, substring_dedup, token_counts, topk, toxicity
from ledgerline.llm.common import Hasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=1):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    rows += ["", None, "One two", "one  TWO", "a b c d", " ".join(["again"] * 3000), "x" * 9000]
    return rows


def frame(spark, rows, extra=True):
    data = [(i, t, i, i) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, n long, token long")


def test_jaccard_components(spark):
    rows = texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    sets = []
    for t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(rows))}


def test_jaccard_large_bucket(spark, monkeypatch):
    """Several trees a bucket find the links that one finds."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"z{rng.randrange(9999)}"
        rows.append(" ".join(w))
    one = {tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    monkeypatch.setattr(jaccard_join, "TREE", 7)
    monkeypatch.setattr(jaccard_join, "HEAVY", 10**9)
    assert one == {tuple(r) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(frame(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_tree_concatenation_is_exact():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole, codec = Tokenizer.from_file(path("byte_bpe_50k.json")), bpe.Codec(long=64, leaf=16)
    rng = random.Random(2)
    for alphabet in ("ab", "thereinandon", "éèç", "0123", "!?#", " \t\n", "日本"):
        for _ in range(12):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 1500))) + " x <|endoftext|>" * rng.randint(0, 1)
            ids = whole.encode(s, add_special_tokens=False).ids
            assert codec.encode(s).tolist() == ids
            assert codec.decode(np.array(ids, dtype=np.uint32)) == whole.decode(ids, skip_special_tokens=False)


def test_bpe_documents(spark):
    rows = texts()
    codec = bpe.Codec()
    out = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, rows), ["doc_id"]).collect()}
    for i, t in enumerate(rows):
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert out[i]["n_tokens"] == len(codec.encode(t or ""))
    ids = bpe.encode_ids(frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(ids).collect()} == {i: t or "" for i, t in enumerate(rows)}


def test_ppm_and_base(spark):
    rows = texts()[:60] + ["", None]
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = {r["doc_id"]: r for r in ppm.score(frame(spark, rows), held).collect()}
    import zlib

    train = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 7 != 2]
    c, top = collections.Counter(), collections.defaultdict(collections.Counter)
    o = ppm.ORDER
    for i in train:
        t = (rows[i] or "").translate(LOWER)
        c.update([*WORD.findall(t), ""])
        b = bytes([254] * o) + t.encode() + bytes([255])
        for p in range(o, len(b)):
            top[b[p - o : p]][b[p]] += 1
    ctx = [collections.defaultdict(collections.Counter) for _ in range(o)] + [top]
    for k in range(o - 1, -1, -1):
        for a, counts in ctx[k + 1].items():
            for y in counts:
                ctx[k][a[1:]][y] += 1
    n, v = sum(c.values()), len(c)
    for i in range(len(rows)):
        t = (rows[i] or "").translate(LOWER)
        w = [*WORD.findall(t), ""]
        assert out[i]["train_tokens"] == n and out[i]["n_tokens"] == len(w) and out[i]["n_known"] == sum(c[x] > 0 for x in w)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
        b, total = bytes([254] * o) + t.encode() + bytes([255]), 0.0
        for p in range(o, len(b)):
            gone = set()
            for k in range(o, -1, -1):
                live = {x: y for x, y in ctx[k].get(b[p - k : p], {}).items() if x not in gone}
                if b[p] in live:
                    total += math.log10((live[b[p]] - ppm.D) / sum(live.values()))
                    break
                if live:
                    total += math.log10(ppm.D * len(live) / sum(live.values()))
                gone |= set(live)
            else:
                total -= math.log10(255 - len(gone))
        assert out[i]["score"] == pytest.approx(total, abs=1e-2)


def test_ppm_keeps_every_context(spark, monkeypatch):
    """A cap on contexts, or small writes and many blocks, leave the scores as they are."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2

    def scores():
        return {r["doc_id"]: r["score"] for r in ppm.score(frame(spark, texts()[:60]), held).collect()}

    want = scores()
    monkeypatch.setattr(ppm, "NODES", 50, raising=False)
    assert scores() == pytest.approx(want, abs=1e-3)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 2000)
    assert scores() == pytest.approx(want, abs=1e-3)


def test_ppm_counts_in_small_writes(monkeypatch):
    """What tasks write adds up to the same counts, however little they hold at once."""
    import pyarrow as pa

    rows = texts()[:60]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 5 for i in range(60)], pa.int32()), pa.array([i % 3 == 0 for i in range(60)]), pa.array(rows)], ["block", "held_out", "text"])

    def counted():
        total = collections.Counter()
        for out in ppm._counts(3)([batch.slice(i, 20) for i in (0, 20, 40)]):
            for r in out.to_pylist():
                if r["kind"] == 1:
                    keys = ppm.unpack(r["keys"], r["k"], np.uint64)
                    assert (ppm._bucket(keys, 3) == r["key"]).all() and len(keys) == r["k"]
                    for key, k in zip(keys.tolist(), ppm.unpack(r["counts"], r["k"], np.uint32).tolist()):
                        total[r["block"], key] += k
        return total

    want = counted()
    assert sum(want.values()) == sum(len(t.encode()) + 1 for i, t in enumerate(rows) if i % 3)
    for name, value in (("HELD", 2000), ("CHUNK", 16), ("MARKS", 2)):
        monkeypatch.setattr(ppm, name, value)
    assert counted() == want


def test_ppm_words_travel_packed(monkeypatch):
    """A block's words are packed runs, not a row each, and add up to the same counts and totals."""
    import pyarrow as pa

    rows = [*texts()[:60], None]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 5 for i in range(61)], pa.int32()), pa.array([i % 3 == 0 for i in range(61)]), pa.array(rows)], ["block", "held_out", "text"])
    hasher, want = Hasher(), collections.Counter()
    for i, t in enumerate(rows):
        for h in hasher.words(np.frombuffer((t or "").translate(LOWER).encode(), np.uint8))[2].tolist():
            want[i % 5, h] += i % 3 > 0
    totals = collections.Counter()
    for (_, h), c in want.items():
        totals[h] += c

    def check():
        got, parts = collections.Counter(), []
        for out in ppm._counts(3, 2)([batch.slice(i, 20) for i in (0, 20, 40, 60)]):
            parts += [r for r in out.to_pylist() if r["kind"] == ppm.WORDS]
        for r in parts:
            keys = ppm.unpack(r["keys"], r["k"], np.uint64)
            assert (ppm._word_bucket(keys, 2) + 3 == r["key"]).all() and len(keys) == r["k"] <= ppm.CHUNK
            for h, c in zip(keys.tolist(), ppm.unpack(r["counts"], r["k"], np.uint32).tolist()):
                got[r["block"], h] += c
        assert got == want and set(got) == set(want)
        parts.sort(key=lambda r: r["key"])
        asked = pa.RecordBatch.from_pylist([{"bucket": r["key"], **{c: r[c] for c in ("block", "k", "keys", "counts")}} for r in parts])
        low = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        found, sums = {}, collections.Counter()
        for out in ppm._answers(low, 3)([asked]):
            for r in out.to_pylist():
                if r["kind"] == ppm.SUMS:
                    sums[r["block"]] += r["k"]
                else:
                    assert r["kind"] == ppm.WORDS
                    found |= {(r["block"], h): c for h, c in zip(ppm.unpack(r["keys"], r["k"], np.uint64).tolist(), ppm.unpack(r["found"], r["k"], np.int64).tolist())}
        assert found == {(b, h): totals[h] for b, h in want}
        assert sums == {-1: sum(c > 0 for c in totals.values()), -2: sum(totals.values())}
        return len(parts)

    assert check() <= 5 * 2
    for name, value in (("HELD", 500), ("CHUNK", 16), ("MARKS", 2)):
        monkeypatch.setattr(ppm, name, value)
    assert check() > 5 * 2


def test_ppm_lookup():
    """Every key has its value, those that no probe placed too, with values of either kind."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 56, 50_000, dtype=np.uint64))
    for values in (np.arange(len(keys)) - 7, rng.random(len(keys))):
        for twice in (keys, np.append(keys, keys[:99])):
            t = ppm.Lookup(twice, np.append(values, values[:99])[: len(twice)])
            at = rng.integers(0, len(keys), 120_000)
            assert (t.get(keys[at]) == values[at]).all() and t.get(keys[at]).dtype == values.dtype
    t = ppm.Lookup(keys, values)
    t.slot[:], t.probes, t.rest, t.rest_values = 0, 2, keys, values
    assert (t.get(keys[at]) == values[at]).all()
    assert len(ppm.Lookup(keys[:0], values[:0]).get(keys[:0])) == 0


def test_ppm_sees_six_bytes(spark):
    """Only the sixth byte back tells these endings apart."""
    rows = ["xbcdef1", "ybcdef2"] * 20 + ["xbcdef1", "xbcdef2"]
    out = {r["doc_id"]: r["score"] for r in ppm.score(frame(spark, rows), F.col("doc_id") >= 40).collect()}
    assert out[40] > out[41] + 1


def test_token_counts():
    scores = token_counts.piece_scores()
    pieces = token_counts.PieceTrie(scores)
    rng = random.Random(3)
    words = list({bytes(rng.choice(b"theandingor \xc3\xa9") for _ in range(rng.randint(1, 20))) for _ in range(500)})
    got = token_counts.counts_of(words, pieces)
    for w in words:
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            best.append(max((best[j][0] + scores[w[j:i]], best[j][1] - 1) for j in range(i) if w[j:i] in scores))
        assert got[w] == -best[-1][1]


def test_token_counts_edges(spark):
    out = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(frame(spark, ["", None, "a", "a a"])).collect()}
    assert out[0] == out[1] == (0, 0) and out[2] == (1, 1) and out[3][0] == 2


def test_toxicity_learns_and_matches(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(["plain", "word", "tree", "house", "green", "walk"]) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(30)] = rng.choice(["blockhead", "numbskull", "dunderpate"])
        rows.append(" ".join(w))
        labels.append((i, 1 if bad else 0, "x"))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, lang string"))
    new = ["you are a blokhead", "you are a nubmskull", "a tree and a house", "", None]
    got = [r["predicted"] for r in toxicity.score(frame(spark, new), model, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == [1, 1, 0, 0, 0]
    calm, loud = toxicity.score(frame(spark, ['she said the word "blockhead" was rude', "you blockhead"]), model, ["doc_id"]).orderBy("doc_id").collect()
    assert calm["score"] < loud["score"]
    none = toxicity.fit(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(frame(spark, [None, "x"]), none, ["doc_id"]).collect()] == [0.0, 0.0]


def test_automaton_against_distances():
    def distance(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    terms = ["idiot", "clown", "worthless", "scum"]
    automaton, rng = toxicity.Automaton(terms), random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k, i = rng.randrange(3), rng.randrange(len(w)) if w else 0
            w[i : i + (k != 1)] = [rng.choice("idotclwnrhesumx")] * (k != 0)
        w = "".join(w)
        fits = [(distance(w, t), j) for j, t in enumerate(terms) if distance(w, t) <= toxicity.edits(t)]
        assert automaton.match(w) == (min(fits) if fits else None), w


def test_substring_dedup(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(80))
    rows = [" ".join(f"d{i}x{rng.randrange(9999)}" for _ in range(100)) for i in range(30)]
    for i in (3, 9, 20):
        w = rows[i].split()
        rows[i] = " ".join([*w[: i + 10], passage, *w[i + 10 :]])
    rows += ["", None]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        if i in (9, 20):
            assert 50 <= got[i]["n_removed"] <= 80 and all(w in got[i]["text"] for w in rows[i].split() if w[0] == "d")
        else:
            assert got[i]["text"] == t and got[i]["n_removed"] == 0
        assert got[i]["token"] == i
    assert substring_dedup.remove_repeats(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(300)}" for _ in range(20 + i))) for i in range(6)] + [(6, "too short"), (7, None), (None, "a b c d e f"), (0, None)]
    rows = [" ".join(f"d{rng.randrange(300)}" for _ in range(60)) for _ in range(12)]
    rows[2] += " " + items[1][1].upper() + "! and more"
    w = items[4][1].split()
    w[11] = "other"
    rows[5] = " ".join(w) + " " + rows[5]
    rows += ["", None, items[3][1]]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(frame(spark, rows), bench).collect()}

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for d, t in enumerate(rows):
        s = grams(t)
        for i, x in items[:6]:
            m = grams(x)
            best = max((o / (len(k) + len(m) - o) for a in range(max(1, len(s) - len(m) + 1)) for k in [s[a : a + len(m)]] for o in [sum((collections.Counter(k) & collections.Counter(m)).values())]), default=0)
            if best >= 0.75:
                want[d, i] = best
    assert got == pytest.approx(want) and {(2, 1), (14, 3)} <= set(got)
    assert decontamination.clean(frame(spark, rows), bench).count() == len(rows) - len({d for d, _ in want})


def test_decontamination_between_alignments(spark):
    """A passage with words put in is found by a window that no shared shingle is aligned with."""
    item = [f"q{i}" for i in range(52)]
    copy = ["first", *item[1:26], "put", "in", *item[26:51], "last"]
    rows = [" ".join(copy), " ".join(["x1", "x2", *copy, "y1", "y2"]), " ".join(item[:20]), " ".join([*item] * 3)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_shingles"], r["similarity"]) for r in decontamination.leaks(frame(spark, rows), bench).collect()}
    assert got == {0: (1, 48, pytest.approx(42 / 54)), 1: (3, 48, pytest.approx(42 / 54)), 3: (0, 48, 1.0)}


def test_topk(spark):
    rng = np.random.default_rng(9)
    v = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], 0) for i in range(300)]
    v += [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, v[0][1], 0), (0, v[0][1], 0), (None, v[1][1], 0), (304, [0.0] * 6, 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 304")).collect()}
    whole = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in v if i is not None and e and None not in e and np.isfinite(e).all()}
    want = {}
    for q in [i for i in whole if i % 50 == 0 or i == 304]:
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_html(spark):
    page = '<html><head><title>t</title></head><body><header>Site</header><nav><a href="/">Menu</a></nav><div class="wrap"><article class="p-{}"><h1>Head &amp; tail</h1><p>One <i>two</i>three<br>four {}<p>Second para<div class="user-comments"><p>first!</p></div><form>f</form></article></div><aside>side</aside><script>var a="</p>";</script><footer>foot</footer></body></html>'
    rows = [(i, f"https://Host{i % 2}.example/{i}", page.format(i, "words " * 20), "x") for i in range(6)] + [(6, None, None, "x"), (7, "", "", "x"), (8, "https://h", "plain &lt;text", "x")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[0] == "Head & tail One twothree four " + " ".join(["words"] * 20) + " Second para"
    assert len({got[i] for i in range(6)}) == 1 and got[6] == got[7] == "" and got[8] == "plain <text"


def test_html_keeps_whole_articles():
    lead, body = "lead " * 60, "body " * 130
    page = f"<body><nav>menu</nav><article><h1>Title</h1><div class=lead>{lead}</div><div class=body>{body}</div></article></body>"
    found = html_text.blocks(page)
    path = html_text.main_path(found)[0]
    assert path == "body>article" and html_text.text_at(found, path).split() == ["Title", *lead.split(), *body.split()]
    quote = html_text.blocks(f"<body><article><p>{lead}</p><blockquote>{body}</blockquote></article></body>")
    assert html_text.main_path(quote)[0] == "body>article"
    other = html_text.blocks(f"<body><article>note</article><div class=story>{body}</div></body>")
    assert html_text.text_at(other, path).split() == ["note", *body.split()]


def test_chat(spark):
    rows = [
        (1, 0, "system", '{"tools":[{"name":"f","parameters":{"required":["a"],"properties":{"a":{"type":"integer"}}}}]}', 0),
        (1, 3, "assistant", '{"content":"c","tool_calls":[{"id":"1","name":"f","arguments":{"b":"x","a":1}},{"id":"2","name":"f","arguments":{"a":"no"}},{"id":"3","name":"g","arguments":{}}]}', 0),
        (1, 2, "tool", '{"tool_call_id":"1","content":"42"}', 0),
        (1, 4, "tool", '{"tool_call_id":"9","content":{"z":1,"k":[1,2]}}', 0),
        (2, 0, None, None, 0), (None, 0, "user", "", 0), (3, 0, "user", "{broken", 0), (3, 0, "user", "{broken", 0),
    ]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, json int")).orderBy("conv_id", "order_turn", "order_phase", "order_seq").collect()
    one = [(r["kind"], r["call_id"], r["status"], r["valid"]) for r in out if r["conv_id"] == 1]
    assert one == [("message", None, "plain", None), ("message", None, "plain", None), ("call", "1", "linked", True), ("call", "2", "open", False), ("call", "3", "open", None), ("result", "1", "linked", None), ("result", "9", "orphan", None)]
    assert '{"arguments":{"a":1,"b":"x"},"id":"1","name":"f"}' in {r["json"] for r in out}
    assert sum(r["conv_id"] == 3 for r in out) == 2 and len(out) == 11
