"""Queries against their SQL over tables with what only larger ones have: repeated places, moments next to midnight."""

import datetime
import random

import duckdb
import pytest

from subsida.plans import registry


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    d = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    con.execute(f"copy (select i::BIGINT as s_suppkey, 'S' || i as s_name, (i % 25)::INTEGER as s_nationkey, i * 1.5 as s_acctbal from range(60) a(p), range(60) b(r), (select p * 7 + r * 1000 as i)) to '{d}/supplier.parquet' (format parquet)")
    rng, day = random.Random(3), datetime.datetime(2024, 1, 2)
    near = [us for n in range(40) for us in (n * 86400 * 10**6 + k for k in (-9000, -8000, -20, -3, -2, -1, 0, 1, 2, 5))]
    far = [rng.randrange(-(10**15), 10**15) for _ in range(200_000)]
    con.execute("create table events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    con.execute("insert into events select row_number() over () - 1, make_timestamp(epoch_us(?::TIMESTAMP) + u), 1, 1.0 from (select unnest(?::BIGINT[]) as u)", [day, near + far])
    con.execute(f"copy events to '{d}/events.parquet' (format parquet)")
    con.execute("drop table events")
    for t in ("supplier", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con, str(d)


@pytest.mark.parametrize("name", ["cov_layers", "dyear_convert", "olc10"])
def test_equal_to_sql(spark, db, name):
    con, d = db
    df = registry.QUERIES[name](spark, d)
    got = sorted(map(tuple, df.collect()))
    want = sorted(con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall())
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:5] == []
