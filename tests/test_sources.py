"""Matrices on disk, options, list files, import formats, exports, modules and streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from subsida import streaming
from subsida.operators import difference, filters, joins
from subsida.plans import modules
from subsida.sources import options, readers, sinks
from subsida.sources import stm as st
from subsida.sources.simulate import simulate


def small(spark):
    p = spark.createDataFrame([("d", i, f"P{i}", None, 53.0 + i / 100, 5.0, 0.0, 0.0, 0.0, None) for i in range(4)], st.SCHEMAS["points"])
    e = spark.createDataFrame([("d", k, f"E{k}", 2000.0 + k, None) for k in range(3)], st.SCHEMAS["epochs"])
    o = spark.createDataFrame([("d", i, k, "Up", float(10 * i + k)) for i in range(4) for k in range(3) if (i, k) != (1, 1)], st.SCHEMAS["obs"])
    return st.create(spark, "d", "lev", "campaign", "prj", points=p, epochs=e, obs=o)


def test_matrix_round_trip_and_partial_reads(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    st.write(small(spark), path)
    m = st.read(spark, path)
    assert (m.dataset_id, m.technique, m.obs_types) == ("d", "lev", ["Up"]) and m["obs"].count() == 11
    assert st.read(spark, path, points=[1, 2], epochs=[1])["obs"].collect()[0].v == 21.0
    assert st.read(spark, path, "NODATA")["obs"].count() == 0 and st.read(spark, path, "OBSDATA")["points"].count() == 0
    assert "PushedFilters: [In(pnt, [1,2])" in st.read(spark, path, points=[1, 2])["obs"]._jdf.queryExecution().toString()
    st.patch(spark, path, spark.createDataFrame([("d", 1, 1, "Up", 99.0), ("d", 0, 0, "Up", -1.0)], st.SCHEMAS["obs"]))
    again = {(r.pnt, r.epoch): r.v for r in st.read(spark, path)["obs"].collect()}
    assert len(again) == 12 and again[1, 1] == 99.0 and again[0, 0] == -1.0 and again[3, 2] == 32.0
    assert [r.pnt for r in st.wide(st.read(spark, path)["obs"], [0, 1, 2]).orderBy("pnt").collect()] == [0, 1, 2, 3]
    child = st.create(spark, "c", "displ", parents=[m])
    assert child["lineage"].count() == 1
    with pytest.raises(ValueError):
        st.create(spark, "x", "sonar")


def test_options_and_list_files(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert options.merge({"a": 1, "b": 2}, ["b", 3, "typo", 4]) == {"a": 1, "b": 3}
    assert options.merge(modules.SelectOptions(), {"epoch_tolerance": 0.2}).epoch_tolerance == 0.2
    f = tmp_path / "list.txt"
    f.write_text("# comment\n\nall.mat\n[one]\na.mat\n% no\n b.mat \n[two]\nc.mat\n")
    assert options.input_files(spark, str(f)) == ["all.mat", "a.mat", "b.mat", "c.mat"]
    assert options.input_files(spark, str(f), "ONE") == ["a.mat", "b.mat"]
    assert options.input_files(spark, ["x", "y"]) == ["x", "y"]
    assert [os.path.basename(p) for p in options.input_files(spark, f"{tmp_path}/*.txt")] == ["list.txt"]


def test_update_flags(spark, tmp_path):
    a, b = tmp_path / "in", tmp_path / "out"
    a.write_text("1")
    assert options.needs_run(spark, [str(a)], str(b), "create")
    b.write_text("2")
    os.utime(b, (time.time() + 10, time.time() + 10))
    assert not options.needs_run(spark, [str(a)], str(b), "update") and options.needs_run(spark, [str(a)], str(b), "overwrite")
    os.utime(a, (time.time() + 20, time.time() + 20))
    assert options.needs_run(spark, [str(a)], str(b), "update")
    with pytest.raises(FileExistsError):
        options.needs_run(spark, [str(a)], str(b), "create")


def test_gnss_files_to_daily_means(spark, tmp_path):
    rows = ["time,a,b,c,d,e,f,h"]
    for day in (1, 2):
        for h in range(24 if day == 1 else 10):
            rows.append(f"2020-01-{day:02d} {h:02d}:00:00,53,0,{1 + 0.0001 * (h % 5)},5,30,{2 + 0.0001 * (h % 3)},{40 + 0.001 * (h % 7)}")
    rows.insert(3, rows[2])  # a repeated time
    (tmp_path / "ABCD.csv").write_text("\n".join(rows))
    s = readers.gnss_csv(spark, str(tmp_path / "ABCD.csv"))
    assert s.select("station").distinct().collect()[0][0] == "ABCD" and s.count() == 35
    d = modules.gnss_to_daily(s, crit=1e-6).collect()
    assert len(d) == 1 and d[0].cnt == 24 and abs(d[0].u_mm - 1e3 * sum(0.001 * (h % 7) for h in range(24)) / 24) < 1e-6


def test_insar_file(spark, tmp_path):
    fixed = ["pnt_id", "cls", "area", "az", "rg", "pnt_lat", "pnt_lon", "x", "y", "pnt_incidence_angle", "coh", "dem", "pnt_height", "s", "l", "sl", "ly", "sly", "sd"]
    head = fixed + ["d01022015", "d13032015"]
    line = lambda n, inc, a, b: ",".join([n, "1", "0", "0", "0", "53.1", "5.5", "1", "2", str(inc), "0.9", "0", "12.0", *["0"] * 6, str(a), str(b)])
    (tmp_path / "i.csv").write_text("\n".join([",".join(head), line("a", 30.0, 1.5, 2.5), line("b", 40.0, "", 4.5)]))
    terrain = spark.createDataFrame([("a", 2.0), ("b", -327.7)], "pnt_name string, terrain double")
    m = modules.insar_to_stm(spark, "i", str(tmp_path / "i.csv"), 190.0, terrain)
    assert m.attrs["mode"] == "Dsc" and m["obs"].count() == 3 and m["sens"].count() == 6
    assert {r.pnt_name: r.attrs["regime"] for r in m["points"].collect()} == {"a": "1", "b": None}


def test_levelling(spark):
    pts = spark.createDataFrame([(1, "A", 53.0, 5.0, 0.0), (2, "B", 53.1, 5.1, 0.0), (3, "SYN_BM", 53.2, 5.2, 0.0), (4, "D", None, 5.2, 0.0)], "pnt long, pnt_name string, lat double, lon double, h double")
    e = [("p", 10957.0, 1, 2, 0.5, 0, 0.0, 0.0, 1.0), ("p", 11322.0, 1, 2, 0.4, 0, 0.0, 0.0, 1.0), ("p", 11322.0, 1, 3, 0.4, 0, 0.0, 0.0, 1.0), ("bad", 11687.0, 1, 2, 9.9, 3, 0.0, 0.0, 1.0)]
    edges = spark.createDataFrame(e, readers.EDGES).withColumn("dyear", F.lit(2000.0) + (F.col("epoch_days") - 10957.5) / 365.25)
    m = modules.levelling_to_stm(spark, "lev", pts, edges, {"flags": (0,)})
    assert {(r.pnt, r.epoch): r.v for r in m["obs"].collect()} == {(1, 0): 0.0, (2, 0): 500.0, (1, 1): 0.0, (2, 1): 400.0}
    mixed = edges.withColumn("s_east", F.lit(0.5))
    with pytest.raises(Exception, match="both horizontal and vertical"):
        modules.levelling_to_stm(spark, "lev", pts, mixed)["obs"].collect()


def test_weather_events_and_parameters(spark, tmp_path):
    (tmp_path / "knmi.txt").write_text("# header\n# STN,YYYYMMDD,   HH,    T,    P\n\n  235,20200101,    1,   50,10100\n  235,20200101,    2,   70,10200\n  235,20200102,    1,   90,     \n")
    h = readers.meteo_hourly(spark, str(tmp_path / "knmi.txt"))
    day = {str(r.day): (r.t, r.p) for r in readers.daily_meteo(h).collect()}
    assert day["2020-01-01"] == (pytest.approx(6.0), pytest.approx(1015.0)) and day["2020-01-02"] == (pytest.approx(9.0), None)
    assert readers.meteo_at(h).where("day = '2020-01-02'").first().t_week == pytest.approx(7.0)
    (tmp_path / "ev.csv").write_text("station,date,type,name,remarks\n0645,2013-05-13T00:00Z,REC,UNKNOWN   ,x\n")
    ev = readers.events_csv(spark, str(tmp_path / "ev.csv")).first()
    assert ev.year == pytest.approx(2000 + (56425 - 51544.5) / 365.25) and ev.name == "UNKNOWN"
    (tmp_path / "par.csv").write_text("system,mode,s20,s2s,Rs\nS1,Asc,1.5,2,3\n")
    assert readers.stochastic_parameters(spark, str(tmp_path / "par.csv")).first().model == "tudinsar4(s20=1.5,s2s=2,Rs=3)"


def test_outlines(spark, tmp_path):
    import struct

    assert readers.outline([[0, 0], [2, 1]]) == [[(0, 0), (2, 0), (2, 1), (0, 1)]]
    assert len(readers.outline([[0, 0], [1, 0], [1, 1], [float("nan")] * 2, [5, 5], [6, 5], [6, 6]])) == 2
    assert readers.outline("0 0\n1 0\n1 1\n0 0\n\n5 5\n6 5\n6 6", "coo") == [[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]]
    kml = "<kml><Placemark><name>a</name><coordinates>5,53,0 6,53,0 6,54,0 5,53,0</coordinates></Placemark></kml>"
    assert readers.outline(kml, "kml") == [[(5, 53), (6, 53), (6, 54)]]
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    assert readers.read_outline(spark, str(tmp_path / "a.shp")) == [ring[:-1]]
    with pytest.raises(ValueError):
        readers.outline("{}", "json")


def test_polygon_with_hole_and_boundary(spark):
    outer, hole = [(20.0, 20.0), (60.0, 20.0), (60.0, 70.0), (20.0, 70.0)], [(30.0, 30.0), (40.0, 30.0), (40.0, 50.0), (30.0, 50.0)]
    pts = [(20.0, 30.0, True), (60.0, 70.0, True), (35.0, 40.0, False), (30.0, 40.0, True), (25.0, 25.0, True), (19.9, 30.0, False), (50.0, 71.0, False)]
    df = spark.createDataFrame(pts, "x double, y double, want boolean").withColumn("got", filters.in_polygon(F.col("x"), F.col("y"), [outer, hole]))
    assert all(r.want == r.got for r in df.collect())
    assert df.where(filters.in_polygon(F.col("x"), F.col("y"), [])).count() == len(pts)
    assert df.where(filters.in_periods(F.col("x"), [(20.0, 25.0), (60.0, float("inf"))])).count() == 3


def test_export(spark, tmp_path):
    p = spark.createDataFrame([(1, "A", 53.0, 5.0), (2, "B", 53.1, 5.1)], "pnt long, pnt_name string, lat double, lon double")
    o = spark.createDataFrame([(1, 0, "Up", 1.234, 4.0), (1, 1, "Up", -2.0, 9.0), (2, 0, "Up", 0.0, 1.0)], "pnt long, epoch int, obs_type string, v double, var double")
    out = sinks.export_csv(p, o, [(0, 2000.0), (1, 2001.5)], str(tmp_path), "ds", ["Up"])
    rows = spark.read.csv(out[0], header=True).collect()
    assert len(rows) == 1 and rows[0].asDict() == {"ID": "A", "Lon [deg]": "5.0", "Lat [deg]": "53.0", "2000 [mm]": "1.23", "2001.5 [mm]": "-2.0", "std 2000 [mm]": "2.0", "std 2001.5 [mm]": "3.0"}
    with pytest.raises(ValueError):
        sinks.export_table(p, o, [(0, 2000.0)], unit="ft")
    assert {r.bin: r.n for r in sinks.histogram(o, "v", -5.0, 5.0, 2).collect()} == {1: 1, 2: 2}


def test_selection_and_reduction(spark):
    pts = spark.createDataFrame([("lev", 0, 53.0, 5.0, 0.0, 0.0), ("gps", 0, 53.0, 5.0, 100.0, 0.0), ("gps", 1, 53.1, 5.0, 9000.0, 0.0)], "dataset_id string, pnt long, lat double, lon double, n double, e double")
    eps = spark.createDataFrame([("lev", 0, 2000.0), ("gps", 0, 2000.05), ("gps", 1, 2003.0)], "dataset_id string, epoch long, dyear double")
    prj = modules.select(pts, eps, {"points_per_km2": 0.05})
    assert prj["eval_points"].where("not added").count() == 2 and {r.n_datasets for r in prj["eval_points"].where("not added").collect()} == {1, 2}
    assert [r.dyear for r in prj["eval_epochs"].orderBy("dyear").collect()] == pytest.approx([2000.025, 2000.76875, 2001.5125, 2002.25625, 2003.0])
    assert {(r.dataset_id, r.epoch): r.eval_epoch for r in prj["xref_epochs"].collect()} == {("lev", 0): 0, ("gps", 0): 0, ("gps", 1): 4}
    obs = spark.createDataFrame([("lev", 0, 0, 1.0), ("gps", 1, 1, 2.0)], "dataset_id string, pnt long, epoch long, v double")
    assert modules.reduce_by_index(obs, prj).count() == 2
    near = modules.reduce_by_distance(spark.createDataFrame([(7, 60.0, 0.0), (8, 5000.0, 0.0)], "pnt long, n double, e double"), prj["eval_points"].where("not added"), 200.0)
    assert {r.pnt: r.pnt_id == " " for r in near.collect()} == {7: False, 8: True}


def test_gnss_and_insar_reduction(spark):
    daily = spark.createDataFrame([("s", 2000 + i / 365.25, 1.0 * i, 0.0, 0.0) for i in range(60)], "station string, dyear double, n_mm double, e_mm double, u_mm double")
    epochs = spark.createDataFrame([(0, 2000.0), (1, 2000.101), (2, 2005.0)], "eval_epoch long, dyear double")
    assert {r.eval_epoch: r.n_mm for r in modules.reduce_gnss(daily, epochs).collect()} == {0: 0.0, 1: 37.0}
    pts = spark.createDataFrame([(i, 10.0 * i, 0.0, 1 + i % 2, 1) for i in range(4)], "pnt long, n double, e double, regime int, pnt_class int")
    obs = spark.createDataFrame([(i, k, float(k * (1 + i % 2))) for i in range(4) for k in range(8)], "pnt long, epoch long, v double")
    reduced, chosen = modules.reduce_insar(pts, obs, spark.createDataFrame([(1, 0.0, 0.0)], "eval_pnt long, n double, e double"), [2000.0 + k / 4 for k in range(8)], 500.0, [["constant"], ["linear"]], ["WN(sigma=1)"])
    assert reduced.where("epoch = 4").first().shallow == pytest.approx(8 - 4)  # total is the mean of regime 2 alone
    assert chosen.first().models == "linear" and chosen.first().vel == pytest.approx(4.0)  # of the deep series


def test_decomposition_module(spark):
    import math

    daily = spark.createDataFrame([("s", 2000 + i / 100, 0.02 * i, 1.0, math.sin(2 * math.pi * i / 100)) for i in range(300)], "station string, dyear double, n_mm double, e_mm double, u_mm double")
    ev = spark.createDataFrame([("s", 2001.5)], "station string, year double")
    par, summary, comp = modules.decompose(daily, ev, ["s"], common_mode=True, model="linear", periods=(1.0,))
    assert par.where("par = 'Jump1'").count() == 3 and summary.count() == 3 and comp.count() == 900
    assert {r.component: r.vel for r in summary.collect()}["north"] == pytest.approx(2.0, abs=1e-6)


def test_difference_of_matrices(spark):
    obs, _ = simulate(spark, "small", range(2003, 2006))
    a = obs.where("dataset_id = 'lev'").select("pnt", "epoch", "obs_type", "v", "dyear")
    assert difference.difference_stats(difference.difference(a, a), rounds=2).where("part = 'residual'").first().max == 0
    assert difference.difference(a, a.withColumn("v", F.col("v") + 1)).agg(F.min("v"), F.max("v")).first() == (pytest.approx(-1), pytest.approx(-1))
    with pytest.raises(Exception, match="not comparable"):
        difference.difference(a, a.withColumn("dyear", F.col("dyear") + 1)).collect()


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} {h:02d}:00:00", float(h)) for d in (1, 2, 3) for h in (0, 1, 2, 12)]
    spark.createDataFrame(rows, "pnt long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "s"))
    schema = "pnt long, ts timestamp, value double"
    for name, make, n in (("d", lambda s: streaming.daily_means(s, lateness="0 seconds"), 2), ("g", lambda s: streaming.gap_sessions(s, "3 hours", lateness="0 seconds"), 5)):
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "s"))).writeStream.outputMode("append").format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"out_{name}").count() >= n


def test_tolerances_are_strict(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "a long, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (8, -1.0, 0.0)], "b long, x double, y double")
    assert joins.nearest_in_space(a, b, 1.0, "a", "b").count() == 0
    assert [(r.a, r.near_b) for r in joins.nearest_in_space(a, b, 1.001, "a", "b", "left").orderBy("a").collect()] == [(1, 7), (2, None)]
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "t long, s long")
    assert {(r.t, r.s) for r in joins.one_to_one(pairs, "t", "s").collect()} == {(1, 6), (2, 6)}
