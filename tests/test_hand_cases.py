"""Cases small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import photometry as X
from lumenframe.operators import components as K
from lumenframe.operators import curves as C
from lumenframe.operators import histograms as H
from lumenframe.operators import objects as O
from lumenframe.operators import pixels as P
from lumenframe.operators import sampling as S
from lumenframe.operators import sky as Y
from lumenframe.operators import tiles as T
from lumenframe.sources import readers as R
from lumenframe.streaming import histograms as SH


def pixels(spark, cells, image=1):
    return spark.createDataFrame([(image, r, c, p) for r, c, p in cells], "image_id long, r int, c int, p double")


@pytest.mark.parametrize(("cells", "gap", "n"), [([(0, 0), (0, 5)], 2, 1), ([(0, 0), (0, 6)], 2, 2), ([(0, 0), (0, 2)], 1, 2), ([(0, 0), (1, 1)], 0, 1)])
def test_gap_bridging(spark, cells, gap, n):
    out = K.label_components(pixels(spark, [(r, c, 0.9) for r, c in cells]), gap)
    assert out.select("label").distinct().count() == n


def test_component_roots_against_brute_force():
    import numpy as np

    for seed in range(60):
        rng = np.random.default_rng(seed)
        r, c = np.nonzero(rng.random((12, 14)) < 0.12)
        for gap in range(4):
            reach = K.reach_of(gap)
            root = list(range(len(r)))
            for i in range(len(r)):
                for j in range(i):
                    if max(abs(r[i] - r[j]), abs(c[i] - c[j])) <= reach and root[i] != root[j]:
                        a, b = root[i], root[j]
                        root = [min(a, b) if x in (a, b) else x for x in root]
            got = K.component_roots(r, c, reach)
            assert len({*zip(got.tolist(), root, strict=True)}) == len(set(root)) == len(set(got.tolist()))


def three_components(spark):
    px = pixels(spark, [(10, 10, 0.9), (10, 30, 0.9), (60, 60, 0.9)])
    return K.label_components(px, 1)


def objects(spark, rows):
    return spark.createDataFrame([(1, i, x, y, b, n) for i, (x, y, b, n) in enumerate(rows)], "image_id long, row_pos long, x long, y long, beta double, trail_length double")


def counts(df):
    return tuple(df.first()[c] for c in ("obj_tp", "obj_fp", "obj_fn"))


def test_one_object_over_two_components(spark):
    lab, cat = three_components(spark), objects(spark, [(20, 10, 0.0, 30.0)])
    empty = lab.select("image_id", "r", "c").limit(0)
    assert counts(O.confusion(cat, lab, 3.0)) == (1, 2, 0)
    assert counts(O.confusion(cat, lab, 3.0, empty)) == (1, 1, 0)
    assert counts(O.confusion(cat, lab, 3.0, empty, per_threshold=True)) == (1, 2, 0)
    px = pixels(spark, [(10, 10, 0.9), (10, 30, 0.9), (60, 60, 0.4)])
    got = {r["thr_idx"]: (r["obj_tp"], r["obj_fp"], r["obj_fn"]) for r in O.sweep(cat, px, 3.0, 1, [0.3, 0.5], empty).collect()}
    assert got == {0: (1, 2, 0), 1: (1, 1, 0)}


def test_two_objects_over_one_component(spark):
    lab, cat = three_components(spark), objects(spark, [(10, 10, 0.0, 4.0), (11, 10, 0.0, 6.0)])
    got = O.match(cat, O.edges(cat, lab, 3.0)).orderBy("row_pos").collect()
    assert [(r["nn_detected"], r["tp"]) for r in got] == [(True, True), (True, False)]
    assert counts(O.confusion(cat, lab, 3.0)) == (1, 2, 1)


def test_images_without_objects_count_nothing(spark):
    lab = three_components(spark).withColumn("image_id", F.col("image_id") + 5)
    assert counts(O.confusion(objects(spark, [(1, 1, 0.0, 4.0)]), lab, 3.0)) == (0, 0, 1)


def test_last_bin_is_closed(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"), F.lit(True).alias("nn_detected"), F.lit(False).alias("stack_detection"))
    n = {r["bin"]: r["n"] for r in H.detection_histogram(df, "v", 10).collect()}
    assert n[9] == 2 and sum(n.values()) == 11


def test_medians(spark):
    df = spark.createDataFrame([(1, 0, float(v)) for v in (1, 2, 3, 10)], "image_id long, r int, flux double")
    assert P.robust_stats(df).first()["med"] == 2.5
    assert P.row_median_stats(df).first()["med"] == 2.0


def test_empty_counts_give_zero_scores(spark):
    row = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long").select(*P.scores("tp", "fp", "fn")).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)


def test_top_mean_rounds_up_or_down(spark):
    values = F.array(*[F.lit(float(v)) for v in range(1, 22)])
    up, down = spark.range(1).select(K.top_mean(values, 0.05), K.top_mean(values, 0.05, up=False)).first()
    assert (up, down) == (20.5, 21.0)


def test_auc_of_constant_predictor_and_of_one_class(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False)], "p double, gt boolean")
    assert P.histogram_auc(df, anchored=True).first()["auc"] == pytest.approx(0.5)
    one = df.filter("gt")
    assert P.histogram_auc(one, empty=0.5).first()["auc"] == 0.5
    assert P.histogram_auc(one).first()["auc"] is None


def test_partial_area_interpolates(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 1.0), (3, 1.0, 1.0)], "pos int, fpr double, tpr double")
    assert C.partial_auc(pts, 0.25).first()["area"] == pytest.approx(0.0625)
    assert C.partial_auc(pts).first()["area"] == pytest.approx(0.75)


def test_moving_average_and_running_best(spark):
    df = spark.createDataFrame([(1, 3, 4.0), (1, 1, 1.0), (1, 2, 2.0)], "k int, step int, v double")
    assert C.moving_average(df, "k", "step", "v", 0.5).first()["ema"] == pytest.approx(2.75)
    got = C.running_best(df, "v", "step").orderBy("step").collect()
    assert [r["improved"] for r in got] == [True, True, True]


def test_first_source_in_order_wins(spark):
    px = spark.createDataFrame([(1, 7, 5, c) for c in range(6)], "image_id long, row_pos long, r int, c int")
    src = spark.sql("select 1L image_id, 3L src_pos, array(named_struct('y',5,'x0',4,'x1',9)) spans union all select 1L, 8L, array(named_struct('y',5,'x0',0,'x1',9))")
    cat = spark.createDataFrame([(7,)], "row_pos long")
    assert Y.footprint_hits(cat, px, src).first()["src_pos"] == 3
    assert Y.footprint_hits(cat, px, src, least=3).first()["src_pos"] == 8


def test_sky_antijoin_at_the_pole_and_across_zero(spark):
    pre = spark.createDataFrame([(0.00001, 0.0), (10.0, 89.9)], "ra double, dec double")
    post = spark.createDataFrame([(1, 359.99999, 0.0), (2, 10.04, 89.9), (3, 10.2, 89.9)], "id int, ra double, dec double")
    assert [r["id"] for r in Y.unmatched(post, pre).collect()] == [3]


def test_tiles_round_trip_and_incomplete_panels(spark):
    px = pixels(spark, [(r, c, float(r * 5 + c)) for r in range(5) for c in range(5)])
    tiles = T.tile_arrays(px, 2)
    back = T.reassemble(tiles, 5, 5, 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
    assert T.reassemble(tiles.filter("tr > 0"), 5, 5, 2).count() == 0


def test_counts_of_mixture(spark):
    assert S.mixture_counts({"a": 3, "b": 0, "c": 9}, {"a": 1, "b": 1, "c": 2}, 8, "c") == {"a": 2, "b": 0, "c": 6}


def test_split_rounds_half_to_even(spark):
    df = spark.range(5).select(F.col("id").alias("k"))
    assert S.split(df, F.col("k"), "k", 0.5, "rint").filter("split = 'train'").count() == 2


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: y"):
        R.require(spark.range(1).select(F.col("id").alias("x")), ["x", "y"])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "wcs_none")], "visit bigint, detector int, reason string")
    R.append_csv(df, str(tmp_path / "bad"))
    R.append_csv(df.limit(0), str(tmp_path / "bad"))
    R.append_csv(df, str(tmp_path / "bad"))
    assert R.read_csv(spark, str(tmp_path / "bad"), R.BAD_VISITS).count() == 2


def test_angles(spark):
    row = spark.range(1).select(X.wrap_degrees(F.lit(540.0)), X.position_angle(F.lit(-1.0), F.lit(0.0)), X.ensure_radians(F.lit(180.0))).first()
    assert abs(abs(row[0]) - 180) < 1e-9 and row[1] == pytest.approx(270) and row[2] == pytest.approx(3.14159265)


def test_streamed_histogram_equals_batch(spark, tmp_path):
    px = spark.createDataFrame([(i / 40, i % 3 == 0) for i in range(40)], "p double, gt boolean")
    px.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = SH.write_histogram(SH.pixel_histogram(stream, 16), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    want = P.histogram(px, P.sweep_bin(16))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_greedy_order_against_a_loop(spark):
    import random

    rng = random.Random(4)
    links = sorted({(rng.randrange(4), rng.randrange(30), rng.randrange(12)) for _ in range(150)})
    taken, want = set(), {}
    for image, row, label in sorted(links, key=lambda x: (x[0], x[1])):
        want.setdefault((image, row), set())
        if (image, label) not in taken:
            want[image, row].add(label)
    free, done = {}, set()
    for image, row in sorted(want):
        mine = {x for i, r, x in links if (i, r) == (image, row)}
        free[image, row] = len({x for x in mine if (image, x) not in done})
        done |= {(image, x) for x in mine}
    got = O.consume(spark.createDataFrame(links, "image_id long, row_pos long, label int")).collect()
    assert {(r["image_id"], r["row_pos"]): r["n_free"] for r in got} == free


def test_sweep_equals_one_threshold_after_the_other(spark):
    import random

    rng = random.Random(9)
    cells = {(rng.randrange(40), rng.randrange(40)): rng.randrange(1, 11) / 10 for _ in range(260)}
    px = pixels(spark, [(r, c, p) for (r, c), p in cells.items()])
    cat = objects(spark, [(rng.randrange(40), rng.randrange(40), float(rng.randrange(180)), float(rng.randrange(4, 20))) for _ in range(12)])
    mask = px.filter("(r + c) % 7 = 0").select("image_id", "r", "c")
    steps = [0.2, 0.45, 0.7, 1.0]
    got = {r["thr_idx"]: (r["obj_tp"], r["obj_fp"], r["obj_fn"]) for r in O.sweep(cat, px, 3.0, 2, steps, mask).collect()}
    plain = {r["thr_idx"]: (r["obj_tp"], r["obj_fp"], r["obj_fn"]) for r in O.sweep(cat, px, 3.0, 2, steps).collect()}
    for i, t in enumerate(steps):
        lab = K.label_components(px.filter(F.col("p") >= t), 2)
        assert got[i] == counts(O.confusion(cat, lab, 3.0, mask, per_threshold=True))
        assert plain[i] == counts(O.confusion(cat, lab, 3.0))


def test_partial_area_beyond_and_before_the_points(spark):
    pts = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.5, 0.8)], "pos int, fpr double, tpr double")
    assert C.partial_auc(pts, 1.0).first()["area"] == pytest.approx(0.645)
    assert C.partial_auc(pts, 0.1).first()["area"] == pytest.approx(0.025)
    assert C.partial_auc(pts, 0.2).first()["area"] == pytest.approx(0.05)
    assert C.partial_auc(pts).first()["area"] == pytest.approx(0.245)
    assert C.partial_auc(pts, 0.0).first()["area"] == 0.0


def test_ranked_values_narrow_down(spark, monkeypatch):
    import random

    monkeypatch.setattr(P, "RANK_ROWS", 5)
    monkeypatch.setattr(P, "RANK_BINS", 8)
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 1e30, -7.0, 3.0]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    for k in (0, 1, 77, 150, 298, 299):
        assert P.ranked_value(df, F.col("v"), lambda n, k=k: k) == sorted(values)[k]
    assert P.ranked_value(df.limit(0), F.col("v"), lambda n: 0) is None


def test_running_best_over_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(C, "RANGE", 10)
    rng = random.Random(2)
    values = [rng.randrange(50) / 10 for _ in range(95)]
    df = spark.createDataFrame(list(enumerate(values)), "step long, v double")
    got = C.running_best(df, "v", "step").orderBy("step").collect()
    assert [r["best"] for r in got] == [max(values[: i + 1]) for i in range(95)]
    assert [r["improved"] for r in got] == [i == 0 or v > max(values[:i]) for i, v in enumerate(values)]


def test_repeated_pixels_share_a_label(spark):
    out = K.label_components(pixels(spark, [(3, 3, 0.9), (3, 3, 0.8), (9, 9, 0.7)]), 0).collect()
    assert sorted((r["r"], r["label"]) for r in out) == [(3, 1), (3, 1), (9, 2)]


def test_painting_takes_the_reach_of_the_gap(spark):
    px = pixels(spark, [(5, 5, 0.9), (5, 7, 0.01), (5, 8, 0.02), (7, 7, 0.03), (8, 5, 0.04)])
    got = {(r["r"], r["c"]): r["p"] for r in K.paint(px, 0.5, 2).collect()}
    assert got == {(5, 5): 0.9, (5, 7): 0.9, (5, 8): 0.02, (7, 7): 0.9, (8, 5): 0.04}


def test_disk_probe_where_the_direction_is_unknown(spark):
    cat = spark.createDataFrame([(1, 0, 10, 10, None, 9.0), (1, 1, 30, 30, 0.0, 9.0), (1, 2, 30, 30, float("nan"), 9.0), (1, 3, 200, -4, 0.0, 2.0)], "image_id long, row_pos long, x long, y long, beta double, trail_length double")
    px = pixels(spark, [(12, 10, 0.9), (30, 34, 0.9), (0, 127, 0.9)])
    got = {r["row_pos"]: r["nn_detected"] for r in O.any_overlap(cat, px, 1, 128, 128).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True}
    assert {r["row_pos"]: r["nn_detected"] for r in O.any_overlap(cat, px, 2, 128, 128).collect()} == {0: True, 1: True, 2: True, 3: True}


def test_magnitude_modes_agree(spark):
    one = spark.range(1)
    length, psf, limit = F.lit(20.0), F.lit(4.0), F.lit(24.0)
    first = one.select(*[c.alias(n) for n, c in X.injection("psf_mag", F.lit(22.0), length, psf, limit).items()]).first()
    for mode, value in (("snr", first["SNR"]), ("surface_brightness", first["mag"]), ("integrated_mag", first["integrated_mag"])):
        again = one.select(*[c.alias(n) for n, c in X.injection(mode, F.lit(value), length, psf, limit).items()]).first()
        assert all(again[c] == pytest.approx(first[c]) for c in ("mag", "integrated_mag", "PSF_mag", "SNR"))
    with pytest.raises(ValueError, match="unknown mode"):
        X.injection("other", F.lit(1.0), length, psf, limit)


def test_sky_and_pixel_are_inverse(spark):
    df = spark.createDataFrame([(0.0, 0.0), (150.0, -300.0), (-4000.0, 10.0)], "x double, y double")
    ra, dec = Y.tangent_sky(F.col("x"), F.col("y"), 10.0, 60.0, 0.2)
    px, py = Y.tangent_pixel(F.col("ra"), F.col("dec"), 10.0, 60.0, 0.2)
    for r in df.withColumn("ra", ra).withColumn("dec", dec).select("x", "y", px.alias("px"), py.alias("py")).collect():
        assert r["px"] == pytest.approx(r["x"], abs=1e-5) and r["py"] == pytest.approx(r["y"], abs=1e-5)
