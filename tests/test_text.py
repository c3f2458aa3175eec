from pyspark.sql import functions as F

from ledgerline.functions import text as T


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_resolve_path(spark):
    got = column(spark, ["src/{old => new}/a.py", "src/{ => sub}/a.py", "src/{sub => }/a.py", "old.py => new.py"], T.resolve_path)
    assert got == ["src/new/a.py", "src/sub/a.py", "src/a.py", "new.py"]


def test_excluded(spark):
    bad = ["vendor/x.py", "Dist/x.js", "a/build", "app.min.js", "src/gen/x.go", "Cargo.lock", "", None]
    assert all(column(spark, bad, T.is_excluded))
    assert not any(column(spark, ["Vendor/x.py", "src/general/x.go", "src/outlook/a.py"], T.is_excluded))


def test_language(spark):
    assert column(spark, ["a/b.PY", "Makefile", ".bashrc", "a.d/readme", "x.h", "x.m"], T.classify_language) == ["python", "other", "other", "other", "c", "objc"]
    assert column(spark, ["yaml", "other", "sql", "shell"], T.is_source) == [False, False, True, True]


def test_commit_class(spark):
    bodies = ["fix: x", "Fixes #1 and add y", "docs: fix typo", "patch: x", "feat(ui)!: z", "Add tests", "prefix update", "Added x", "fixing x", "patch x", "s\nfix: b"]
    assert column(spark, bodies, T.classify_commit) == ["bugfix"] * 4 + [None if x is None else x for x in ["feature", "feature"]] + [None] * 5


def test_message_features(spark):
    body = "Fix a bug\n\n- one\n- two\n"
    row = spark.createDataFrame([(body,)], "x string").select(*(c.alias(n) for n, c in T.message_features(F.col("x")).items())).first()
    assert row.asDict() == {"chars": 23.0, "words": 5.0, "lines": 5.0, "has_bullets": 1.0, "unique_word_ratio": 1.0}


def test_mentions(spark):
    bodies = ["used claude", "move cursor left", "cursor ai helped", "GPT-4", "gpt-4o"]
    flags = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, x string").orderBy("i").select(*(c.alias(n) for n, c in T.mention_flags(F.col("x")).items())).collect()
    assert [{k for k, v in r.asDict().items() if v} for r in flags] == [{"claude"}, set(), {"cursor"}, {"gpt"}, set()]


def test_months(spark):
    assert column(spark, ["\n2026-0", "2026-07"], T.clean_ym) == ["2026", "2026-07"]
    assert column(spark, ["2022-11"], T.ym_ord) == [T.anchor_ord("2022-11")]
