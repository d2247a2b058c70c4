"""What only shows on other tables than the given ones: joins of exploded rows, and signs of zero."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe import catalog

DATA = "/root/testdata/sf0.001"

EXPLODED = ["a02_object_confusion_mask", "a03_object_confusion_sweep_rule", "a04_object_sweep", "a18_combined_confusion", "a19_full_confusion", "j05_footprint_match", "j09_overlap_rejection", "j10_any_overlap", "j04_angular_antijoin", "a38_paint"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", EXPLODED)
def test_exploded_rows_are_not_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for i, line in enumerate(plan):
        if "BroadcastExchange HashedRelation" in line:
            end = next((k for k in range(i + 1, len(plan)) if deep[k] <= deep[i]), len(plan))
            assert not any("Generate explode(sequence" in below for below in plan[i:end])


def test_values_that_round_to_zero_keep_their_sign_in_tiles(spark, tmp_path):
    flux = [0.5] * 64
    flux[:6] = [0.4999999, 0.5000001, 0.25, 0.75, 0.0, 1.0]
    flux[6:] = [0.3 + 0.4 * i / 57 for i in range(58)]
    flux[34], flux[35] = 0.5, 0.50000006
    spark.createDataFrame([(1, flux, 3)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[:3]: r[3] for r in db.sql("select image_id, tr, tc, data from (" + catalog.ORACLES["s01_tile_scan"] + ")").fetchall()}
    got = {(r["image_id"], r["tr"], r["tc"]): r["data"] for r in catalog.QUERIES["s01_tile_scan"](spark, str(tmp_path)).collect()}
    assert {k: list(map(repr, v)) for k, v in got.items()} == {k: list(map(repr, v)) for k, v in want.items()}
    assert any(x == 0 and math.copysign(1, x) < 0 for v in want.values() for x in v)


def test_guarded_rows_of_one_partition_go_to_several_tasks(spark):
    from lumenframe.operators.tasks import guarded

    def where(row):
        from pyspark import TaskContext

        return float(TaskContext.get().partitionId())

    rows = spark.range(400).coalesce(1).withColumnRenamed("id", "k")
    got = guarded(rows, "k", where, 5.0).collect()
    assert sorted(r["k"] for r in got) == list(range(400))
    assert len({r["value"] for r in got}) > 4


def test_rows_in_a_loop_that_provably_never_ends_do_not_wait(spark):
    import time

    from lumenframe.operators.tasks import guarded

    def work(row):
        x, y = 1, 0.0
        while row["k"] % 3 == 0:
            pass
        while row["k"] % 3 == 1:
            x, y = (x * 5 + 3) % 16, -y
        return float(row["k"])

    start = time.time()
    got = {r["k"]: (r["value"], r["error"]) for r in guarded(spark.range(12).withColumnRenamed("id", "k"), "k", work, 60.0).collect()}
    assert got == {k: (None, "timeout") if k % 3 < 2 else (float(k), None) for k in range(12)}
    assert time.time() - start < 50


def test_rows_that_are_only_slow_get_all_of_their_seconds(spark):
    from lumenframe.operators.tasks import guarded

    def work(row):
        import os
        import signal
        import subprocess
        import threading

        class Count:
            n = 0

            def __eq__(self, other):
                self.n += 1
                return self.n > 300_000

        k, x, n, seen, it, c = row["k"], 0, 0, [], iter(range(1_000_000)), Count()
        if k == 0:
            while x < 2_000_000:
                x = x + 1
        elif k == 1:
            while len(seen) < 300_000:
                seen += [0]
        elif k == 2:  # the condition's effects are in C and in an object
            while 999_999 not in it:
                pass
            while c != 0:
                pass
        elif k == 3:
            threading.Timer(0.3, lambda: row.update(on=True)).start()
            while not row.get("on"):
                pass
            row["on"] = False
            threading.Timer(0.3, lambda: row.update(on=True)).start()
            while row["on"] == 0:
                pass
        elif k == 4:
            row["on"] = False
            before = signal.signal(signal.SIGUSR1, lambda *_: row.update(on=True))
            child = subprocess.Popen(["sh", "-c", f"sleep 0.3; kill -USR1 {os.getpid()}"])
            while row["on"] == 0:
                pass
            child.wait()
            signal.signal(signal.SIGUSR1, before)
        elif k == 5:  # each state is met twice, by a value that the state has
            while n < 2:
                x = (x + 1) % 50_000
                n = n + (x == 0)
        elif k == 6:
            while seen is not it:
                seen, n = seen if n < 300_000 else it, n + 1
        return float(k)

    got = {r["k"]: (r["value"], r["error"]) for r in guarded(spark.range(7).withColumnRenamed("id", "k"), "k", work, 60.0).collect()}
    assert got == {k: (float(k), None) for k in range(7)}


def test_a_loop_that_changes_or_calls_something_is_left_to_the_alarm(spark):
    from lumenframe.operators.tasks import guarded

    def work(row):
        import time

        n = 0
        while row["k"] == 0:
            n += 1
        while row["k"] == 1:
            time.sleep(0.01)
        while row["k"] == 2:
            try:
                n = 1 // 0
            except ZeroDivisionError:
                pass
        return time.monotonic()

    got = {r["k"]: r["error"] for r in guarded(spark.range(4).withColumnRenamed("id", "k"), "k", work, 0.5).collect()}
    assert got == {0: "timeout", 1: "timeout", 2: "timeout", 3: None}


def test_parts_of_a_template_are_never_rows(spark):
    from lumenframe.operators.raster import trail_template

    objects = spark.createDataFrame([(1, 8.0, 0.0), (2, 0.0, 0.0), (3, 1e12, 30.0), (4, None, 0.0), (None, 8.0, 0.0), (5, 8.0, float("nan")), (1, 8.0, 90.0)], "row_pos long, trail_length double, beta double")
    psf = spark.createDataFrame([(u, v, 1.0 if u == v == 1 else 0.0) for u in range(3) for v in range(3)], "u int, v int, value double")
    out = trail_template(objects, psf, 9, 4.0)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["row_pos"], r["r"], r["c"]): r["value"] for r in out.collect()}
    assert {k[0] for k in got} == {1, 2, 3}
    assert got[2, 4, 4] == 1.0
    for k in (1, 2, 3):
        assert abs(sum(x for at, x in got.items() if at[0] == k) - 1) < 1e-9
    # Two objects of one row_pos, a bar and a post, meet in the middle of one stamp.
    assert got[1, 4, 4] == max(x for at, x in got.items() if at[0] == 1)
    assert abs(got[1, 4, 2] - got[1, 2, 4]) < 1e-9 and got[1, 4, 2] > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["a03_object_confusion_sweep_rule", "a04_object_sweep", "a18_combined_confusion", "a19_full_confusion"])
def test_what_grows_with_objects_or_pixels_is_not_broadcast(spark, name):
    out = catalog.QUERIES[name](spark, DATA)
    out.collect()  # sizes are known then
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    keys = [line.split("[")[1].split("]")[0] for line in plan.splitlines() if "BroadcastHashJoin [" in line]
    assert keys and not [k for k in keys if any(x in k for x in ("row_pos", "p_partkey", "label", "r#"))]


def test_objects_of_one_number_are_counted_once_each(spark):
    from lumenframe.operators import objects as O

    cat = spark.createDataFrame([(i, 1, 5.0, 5.0, 0.0, 4.0, False) for i in (1, 2)], "image_id long, row_pos long, x double, y double, beta double, trail_length double, stack_detection boolean")
    px = spark.createDataFrame([(i, 5, 5, 1) for i in (1, 2)], "image_id long, r int, c int, label int")
    assert O.confusion(cat, px, 3.0).collect() == [(2, 0, 0)]
    none = spark.createDataFrame([], "image_id long, r int, c int")
    assert O.combined(cat, px, 3.0, none).collect() == [(2, 0, 0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_objects_and_pixels_are_joined_once(spark):
    out = catalog.QUERIES["a19_full_confusion"](spark, DATA)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert len([line for line in plan if "SortMergeJoin [" in line and " cr#" in line]) == 1
    assert len([line for line in plan if "FileScan parquet [l_" in line]) == 2


def test_confusion_of_covered_pixels_is_that_of_marked_ones(spark):
    from pyspark.sql import functions as F

    from lumenframe.operators import components as K
    from lumenframe.operators import objects as O

    cat = spark.createDataFrame([(1, 1, 5.0, 5.0, 0.0, 4.0), (1, 2, 6.0, 5.0, 90.0, 4.0), (1, 3, 90.0, 90.0, 0.0, 4.0), (2, 4, 5.0, 5.0, 0.0, 4.0)], "image_id long, row_pos long, x double, y double, beta double, trail_length double")
    px = spark.createDataFrame(
        [(1, 5, 5, 0.9), (1, 5, 6, 0.2), (1, 5, 7, None), (1, 40, 40, 0.8), (1, 41, 41, 0.1), (1, 89, 90, float("nan")), (2, 60, 60, 0.7), (3, 5, 5, 0.9), (3, 9, 9, 0.3), (None, 5, 5, 0.9)],
        "image_id long, r int, c int, p double",
    )
    truth = O.overlaps(cat, px, 3.0).select("image_id", "r", "c", F.lit(True).alias("gt")).distinct()
    marked = px.join(truth, ["image_id", "r", "c"], "left").na.fill(False, ["gt"])
    labelled = K.label_components(O.of_objects(px.filter("p >= 0.5"), cat), 2)
    want = O.full_confusion(cat, marked, labelled, 3.0, 0.5)
    got = O.covered_confusion(cat, px, 3.0, 2, 0.5)
    assert got.columns == want.columns
    assert got.collect() == want.collect() == [(2, 2, 2, 2, 4, 1, 2)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pixels_of_trails_are_not_shuffled_to_match_footprints(spark):
    plan = catalog.QUERIES["j05_footprint_match"](spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning(" in line]
    assert dealt and not [line for line in dealt if " c#" in line]


def test_footprint_match_of_odd_parts_is_that_of_sql(spark, tmp_path):
    odd = [(k, 1 + k % 50) for k in range(0, 24_000, 4)]
    odd += [(100 * k, -4) for k in range(1, 40)] + [(8, 50), (8, 3), (None, 5), (12, None)]  # sizes without a footprint, equal keys, nulls
    spark.createDataFrame(odd, "p_partkey long, p_size int").withColumn("p_retailprice", F.lit(900.0)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = db.sql(catalog.ORACLES["j05_footprint_match"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["j05_footprint_match"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_sources_left_out_are_never_first(spark):
    from lumenframe.operators import objects as O
    from lumenframe.operators import sky as Y

    spans = lambda k: [(k * 7 % 40, k * 5 % 30, k * 5 % 30 + k * 11 % 9), (k * 7 % 40 + 1, 4, 4 + k % 13)][: 1 + (k % 3 == 0)]
    src = spark.createDataFrame([(k % 2, k // 2, spans(k % 60)) for k in range(400)], "image_id long, src_pos long, spans array<struct<y: int, x0: int, x1: int>>")
    cat = spark.createDataFrame([(k % 2, k, k * 13 % 44 - 2.0, k * 17 % 44 - 2.0, k * 29 % 180.0, k % 25 * 1.0) for k in range(200)], "image_id long, row_pos long, x double, y double, beta double, trail_length double")
    assert Y.possible_firsts(src).select("src_pos").distinct().count() < 150
    for least in (1, 3, 6):
        want = Y.footprint_hits(cat, O.trail_pixels(cat, 5.0, 40, 40), src, 0.05, least).collect()
        got = Y.trail_hits(cat, 5.0, 40, 40, src, 0.05, least).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        assert any(r["src_pos"] is not None for r in want)
