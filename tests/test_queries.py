from pathlib import Path

import duckdb
import pytest

from ledgerline.plans import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in SF.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, str(SF)).toPandas(), db.execute(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(df):
        return sorted(tuple("-" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))

    assert rows(got) == rows(want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_streaming_rollup(spark, tmp_path):
    import os

    from ledgerline.streaming import rollup

    (tmp_path / "in").mkdir()
    os.symlink(SF / "events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(str(SF / "events.parquet"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = rollup.run_available(spark, rollup.monthly(stream, ["event_type"], "ts"), "rolled", str(tmp_path / "ck"))
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(r[0], r[1], r[2]) for r in rollup.monthly(batch, ["event_type"], "ts").collect()}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("few", [1, 2, 4])
def test_slopes_of_tiers_of_few_developers(spark, tmp_path, few):
    """A fixed tier of fewer developers than the operator asks for has what SQL gives it."""
    import os

    db = duckdb.connect()
    for f in SF.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
        if f.stem != "lineitem":
            os.symlink(f, tmp_path / f.name)
    devs = [r[0] for r in db.execute(f"{queries.PE} select dev from pe where p_ai is not null order by p_ai, dev").fetchall()]
    low = devs[:: len(devs) // few][:few]
    db.execute(f"copy (select l.* replace (case when o_custkey in ({', '.join(map(str, low))}) then 1 else l_quantity end as l_quantity) from lineitem l join orders on o_orderkey = l_orderkey) to '{tmp_path}/lineitem.parquet'")
    db.execute(f"create or replace view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    for name in ("tier_slopes", "placebo_tiers"):
        want = {r[:2]: r[2:] for r in db.execute(f"select scheme, tier, n, slope, se, ci_lo, ci_hi from ({queries.SQL[name]})").fetchall()}
        got = {tuple(r)[:2]: tuple(r)[2:] for r in queries.QUERIES[name](spark, str(tmp_path)).select("scheme", "tier", "n", "slope", "se", "ci_lo", "ci_hi").collect()}
        assert got.keys() == want.keys() and (name != "tier_slopes" or want["tier_absolute", "low"][0] == few)
        for k in want:
            # With two rows the error is rounding over zero: no number, or an infinite one.
            some = slice(0, 2 if want[k][0] == 2 else 5)
            assert got[k][some] == pytest.approx(want[k][some], abs=1e-5, nan_ok=True), (name, k)
