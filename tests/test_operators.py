"""Operators without a SQL twin in the registry, checked against brute force."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from envspark.operators import latest_per_key, positional_index, top_k_per_key
from envspark.operators.merge import cascade_delete, insert_ignore_ordered, keyed_merge, keyed_update
from envspark.operators.spatial import knn_join, within_km_join


def _hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(x))


def test_positional_index_matches_row_number(spark):
    rows = [(k, f"2024-01-0{1 + (i % 5)} {i % 24:02d}:{i % 60:02d}:00", i) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t string, id int").withColumn("t", F.to_timestamp_ntz("t"))
    got = positional_index(df, ["k"], ["t", "id"]).select("k", "id", "pos")
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1).select("k", "id", "pos")
    assert sorted(got.collect()) == sorted(exp.collect())


def test_latest_and_top_k(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 5, None), (2, 5, "e")], "k int, t int, v string")
    last = {r["k"]: r["v"] for r in latest_per_key(df, ["k"], ["t", "v"]).collect()}
    assert last == {1: "b", 2: "e"}  # tie on t broken by v, NULL sorts lowest
    top = top_k_per_key(df, ["k"], [F.col("t").desc(), F.col("v").desc_nulls_last()], 2).filter("k = 1").orderBy("rn")
    assert [r["v"] for r in top.collect()] == ["b", "c"]


def test_within_km_join_equals_brute_force(spark):
    random.seed(1)
    left = [(i, random.uniform(8, 24), random.uniform(102, 110)) for i in range(300)]
    right = [(j, random.uniform(8, 24), random.uniform(102, 110)) for j in range(40)]
    L = spark.createDataFrame(left, "gid int, lat double, lng double")
    R = spark.createDataFrame(right, "sid int, lat double, lng double")
    got = {(r["gid"], r["sid"]) for r in within_km_join(L, R, 60.0).collect()}
    exp = {(g, s) for g, a, b in left for s, c, d in right if _hav(a, b, c, d) < 60.0}
    assert got == exp and len(exp) > 0


def test_knn_join_equals_brute_force(spark):
    random.seed(2)
    pts = [(i, h, random.uniform(8, 24), random.uniform(102, 110)) for h in range(3) for i in range(25)]
    df = spark.createDataFrame(pts, "id int, h int, lat double, lng double")
    got = knn_join(df, df, 3, left_id="id", right_id="id", partition_keys=["h"], exclude_self=True, cell_deg=0.2)
    g = {(r["h"], r["id"], r["rank"]): r["r_id"] for r in got.collect()}
    for h in range(3):
        sub = [p for p in pts if p[1] == h]
        for i, _, a, b in sub:
            ranked = sorted(((_hav(a, b, c, d), j) for j, _, c, d in sub if j != i))[:3]
            for rank, (_, j) in enumerate(ranked, 1):
                assert g[(h, i, rank)] == j


def test_merge_family(spark):
    ex = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, "C", 1)], "k int, v string, _seq int")
    assert dict(keyed_merge(ex, new, ["k"]).collect()) == {1: "a", 2: "BB", 3: "C"}
    ins = insert_ignore_ordered(ex, new.withColumnRenamed("_seq", "o"), ["k"], ["o"])
    assert [(r["k"], r["v"]) for r in ins.collect()] == [(3, "C")]
    upd = keyed_update(ex, spark.createDataFrame([(2, "z")], "k int, v string"), ["k"], ["v"])
    assert dict(upd.collect()) == {1: "a", 2: "z"}
    kids = spark.createDataFrame([(10, 1), (11, 2)], "id int, parent int")
    assert [r["id"] for r in cascade_delete(kids, ex.filter("k = 2"), "parent", "k").collect()] == [11]


def test_fact_table_layout_prunes_days(spark, tmp_path):
    from envspark.sources.binding import aq_observations
    from envspark.sources.tables import read_fact_table, write_fact_table
    from tests.conftest import SF_SMALL

    aq = aq_observations(spark, SF_SMALL)
    path = str(tmp_path / "aq")
    write_fact_table(aq, path)
    week = read_fact_table(spark, path, since="2024-01-24", until="2024-01-30")
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_date" in plan
    exp = aq.filter((F.to_date("observed_at") >= "2024-01-24") & (F.to_date("observed_at") <= "2024-01-30")).count()
    assert week.count() == exp > 0


def test_partitioned_upsert_is_idempotent(spark, tmp_path):
    from envspark.streaming.jobs import upsert_partitioned

    path = str(tmp_path / "t")
    b1 = spark.createDataFrame([(1, "2024-01-01", 10, 1), (2, "2024-01-02", 20, 1)], "k int, d string, v int, _seq int")
    b2 = spark.createDataFrame([(2, "2024-01-02", 21, 2), (3, "2024-01-02", 30, 2)], "k int, d string, v int, _seq int")
    upsert_partitioned(b1, path, ["k"], "d")
    upsert_partitioned(b2, path, ["k"], "d")
    first = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", F.col("d").cast("string")).collect())
    upsert_partitioned(b2, path, ["k"], "d")  # a replayed micro-batch
    again = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", F.col("d").cast("string")).collect())
    assert first == again == [(1, 10, "2024-01-01"), (2, 21, "2024-01-02"), (3, 30, "2024-01-02")]


def test_streams_over_many_unordered_files(spark, tmp_path):
    """Four files in shuffled time order give four micro-batches and the same tables as one file."""
    from envspark.streaming.jobs import stream_grid_ingest, stream_hourly
    from tests.conftest import SF_SMALL

    one = str(tmp_path)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(4, "event_id").write.parquet(f"{one}/events.parquet")
    for job, keys in ((stream_grid_ingest, ["grid_point_id", "observed_at"]), (stream_hourly, ["station_id", "hour"])):
        a, b = ({tuple(r) for r in job(spark, d).select(*keys, *rest).collect()} for d, rest in (
            (SF_SMALL, ["reading_id"] if job is stream_grid_ingest else ["aqi_avg", "samples"]),
            (one, ["reading_id"] if job is stream_grid_ingest else ["aqi_avg", "samples"])))
        assert a == b and a


def test_knn_join_far_points_poles_and_date_line(spark):
    random.seed(5)
    spread = [(i, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(60)]
    line = [(100 + i, random.uniform(-2, 2), random.choice([-1, 1]) * random.uniform(179.5, 180)) for i in range(20)]
    pole = [(200 + i, random.uniform(89, 90), random.uniform(-180, 180)) for i in range(10)]
    packed = [(300 + i, 10 + i * 1e-4, 106 + (i % 7) * 1e-4) for i in range(40)]
    pts = spread + line + pole + packed
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    for k, cell in ((3, None), (1, 0.5)):
        got = knn_join(df, df, k, left_id="id", right_id="id", exclude_self=True, cell_deg=cell)
        g = {(r["id"], r["rank"]): r["dist_km"] for r in got.collect()}
        for i, a, b in pts:
            for rank, d in enumerate(sorted(_hav(a, b, c, e) for j, c, e in pts if j != i)[:k], 1):
                assert abs(g[(i, rank)] - d) < 1e-6
    assert knn_join(df, df.limit(2), 5, left_id="id", right_id="id").count() == 2 * len(pts)  # fewer than k exist
    near = knn_join(df, df, 3, left_id="id", right_id="id", exclude_self=True, max_km=50.0)
    want = sum(min(3, sum(_hav(a, b, c, e) <= 50.0 for j, c, e in pts if j != i)) for i, a, b in pts)
    assert near.count() == want


def test_within_km_join_wraps_and_takes_poles(spark):
    random.seed(6)
    pts = [(i, random.uniform(-3, 3), random.choice([-1, 1]) * random.uniform(179, 180)) for i in range(60)]
    pts += [(100 + i, random.choice([-1, 1]) * random.uniform(88, 90), random.uniform(-180, 180)) for i in range(60)]
    a, b = spark.createDataFrame(pts, "gid int, lat double, lng double"), spark.createDataFrame(pts, "sid int, lat double, lng double")
    got = sorted((r["gid"], r["sid"]) for r in within_km_join(a, b, 80.0).collect())
    assert got == sorted((g, s) for g, x, y in pts for s, u, v in pts if _hav(x, y, u, v) < 80.0)


def test_running_totals_and_exact_percentiles(spark, monkeypatch):
    from envspark.operators import positional

    monkeypatch.setattr(positional, "ROWS_PER_RANGE", 40)  # one hot key over many ranges
    random.seed(7)
    rows = [(k, random.choice([1.5, 2.0, 7.25, random.random()]), i) for i in range(900) for k in ([None] if i % 9 == 0 else ["hot"] if i % 3 else ["a"])]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    got = {r["id"]: r["before"] for r in positional.running_total(df, ["k"], ["v", "id"], F.col("id").cast("long")).collect()}
    for k in {r[0] for r in rows}:
        total = 0
        for _, v, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            assert got[i] == total
            total += i
    q = positional.exact_percentiles(df, ["k"], "v", {"q1": 0.25, "q3": 0.75})
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"))
    assert sorted(map(str, q.collect())) == sorted(map(str, want.collect()))
    assert "percentile" not in q._jdf.queryExecution().executedPlan().toString()
