"""Numeric cases, rejects and facade calls."""

import math
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae import api, schemas
from tesserae.errors import InvalidArgument
from tesserae.functions import fields, geometry, grid, samples
from tesserae.operators import graph, kernels, stats

REPO = Path(__file__).parent.parent


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lits(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def test_euler_round_trip(spark):
    q = geometry.from_euler(*lits(0.3, -0.7, 1.2))
    assert values(spark, *geometry.to_euler(q)) == pytest.approx([0.3, -0.7, 1.2], abs=1e-12)
    assert values(spark, *geometry.to_euler_degrees(geometry.from_euler_degrees(*lits(30, -45, 120)))) == pytest.approx([30, -45, 120], abs=1e-9)
    assert values(spark, geometry.to_euler(geometry.from_euler(*lits(0.4, math.pi / 2, 0.9)))[0]) == [0.0]
    axis, angle = geometry.to_axis_angle(geometry.quarter_turn())
    assert values(spark, *axis, angle) == pytest.approx([1, 0, 0, math.pi / 2])


def test_pose_acts(spark):
    pose = lits(0, 1, 0, 0), lits(0, 0, 1)
    assert values(spark, *geometry.act(pose, lits(0, 1, 0))) == pytest.approx([0, -1, 1])
    back = geometry.compose(geometry.invert(pose), pose)
    assert values(spark, *back[0], *back[1]) == pytest.approx([1, 0, 0, 0, 0, 0, 0])


@pytest.mark.parametrize("twist", [(0.1, -0.2, 0.3, 0.2, -0.1, 0.4), (1, 2, 3, 0, 0, 1e-8), (1, 2, 3, 0, 0, 0), (0, 0, 0, 1, 2, 1)])
def test_exp_log(spark, twist):
    rows, (q, t) = geometry.settled(spark.range(1), "p", *geometry.exp(lits(*twist[:3]), lits(*twist[3:])))
    linear, angular = geometry.log((q, t))
    assert list(rows.select(*(c.alias(f"c{i}") for i, c in enumerate((*linear, *angular)))).first()) == pytest.approx(twist, abs=1e-9)


def test_interpolation(spark):
    a, b = (lits(1, 0, 0, 0), lits(0, 0, 0)), (geometry.quarter_turn(), lits(1, 0, 0))
    rows, (q, t) = geometry.interpolated(spark.range(1), "h", a, b, F.lit(0.5))
    got = list(rows.select(*q, *t).first())
    assert got == pytest.approx([math.cos(math.pi / 8), math.sin(math.pi / 8), 0, 0, 0.5, 0, 0], abs=1e-12)


def test_adjoint_carries_twists(spark):
    pose = geometry.from_euler(*lits(0.3, -0.7, 1.2)), lits(1, 2, 3)
    v, w = lits(0.1, 0.2, 0.3), lits(-1, 0.5, 2)
    m = values(spark, *geometry.adjoint(pose))
    twist = [0.1, 0.2, 0.3, -1, 0.5, 2]
    linear, angular = geometry.transform_twist(pose, v, w)
    assert values(spark, *linear, *angular) == pytest.approx([sum(m[i * 6 + j] * twist[j] for j in range(6)) for i in range(6)])


def test_screws(spark):
    direction, point, pitch = geometry.screw_axis(lits(0, 0, 2), lits(0, 0, 1))
    assert values(spark, *direction, *point, pitch) == [0, 0, 1, 0, 0, 0, 2]
    assert values(spark, geometry.screw_pitch(lits(1, 0, 0), lits(0, 0, 0))) == [None]


def test_frames_must_chain(spark):
    pose = geometry.identity()
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        values(spark, *geometry.compose_frames(pose, pose, F.lit("a"), F.lit("b"))[0])


def test_grid_of_levels(spark):
    w, t = F.lit(5).cast("bigint"), F.lit(2).cast("bigint")
    assert values(spark, grid.tiles_along(w, t, 0), grid.tiles_along(w, t, 1), grid.tiles_along(w, t, 3), grid.tiles_along(w, F.lit(0))) == [3, 1, 0, 0]
    with pytest.raises(Exception, match="OUT_OF_RANGE"):
        values(spark, grid.region_in(F.lit(9), F.lit(0), w, w, t, t))


def test_metadata_errors(spark):
    f = F.create_map(F.lit("image.camera.model"), F.lit("pinhole"), *(F.lit(x) for k in ("focal_length_x", "focal_length_y", "principal_x", "principal_y") for x in (f"image.camera.{k}", "x")))
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        values(spark, fields.camera(f))
    with pytest.raises(Exception, match="NOT_FOUND"):
        values(spark, fields.required(f, "image.a.b"))
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        values(spark, fields.with_key(f, F.lit("image.crs.body"), F.lit("1")))
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        values(spark, samples.parse_pixel_type(F.lit("int64")))
    assert values(spark, fields.camera(F.create_map(F.lit("image.camera.model"), F.lit("m")))) == [None]


def test_judged_graph(spark):
    entities = spark.createDataFrame([(0, "observation", 0), (0, "data-object", 0), (0, "product", 0), (0, "product", 1), (0, "process-record", 0), (1, "product", 5)], "scene_id long, entity_type string, entity_id long")
    edges = [("observation", 0, "produces", "data-object", 0), ("data-object", 0, "derived-from", "product", 0), ("product", 0, "derived-from", "product", 1), ("product", 1, "derived-from", "product", 0), ("product", 0, "derived-from", "product", 1), ("observation", 0, "derived-from", "product", 0), ("product", 0, "derived-from", "product", 5), ("observation", 9, "derived-from", "product", 9)]
    rows = spark.createDataFrame([(0, i, *e) for i, e in enumerate(edges)], "scene_id long, ordinal long, src_type string, src_id long, kind string, dst_type string, dst_id long")
    got = [r.reason for r in graph.judged_relationships(rows, entities).orderBy("ordinal").collect()]
    assert got == [None, None, None, None, "duplicate", "invalid-domain", "not-found", "not-found"]
    used = spark.createDataFrame([(0, 0, 0, "used", "product", 0), (0, 1, 0, "generated", "product", 0), (0, 2, 0, "used", "product", 0), (0, 3, 4, "used", "product", 0)], "scene_id long, ordinal long, process_id long, kind string, entity_type string, entity_id long")
    assert [r.reason for r in graph.judged_provenance(used, entities).orderBy("ordinal").collect()] == [None, None, "duplicate", "not-found"]
    assert [r.id for r in graph.with_ids(rows, "ordinal", ["scene_id"]).orderBy("ordinal").collect()] == list(range(8))
    assert graph.members(rows, entities, "dst_type", "dst_id", invert=True).count() == 2


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_predictor_windows(spark, bits):
    rows = spark.createDataFrame([(i % 3, i, (i * 2654435761) % (1 << bits)) for i in range(60)], "r long, x long, v long")
    out = kernels.predictor_undo(kernels.predictor_apply(rows, ["r"], "x", "v", bits), ["r"], "x", "residual", bits)
    assert out.where("sample <> v").count() == 0


def test_facade(spark, tmp_path):
    rows = api.constant_image(spark, str(tmp_path / "c.tif"), 40, 20, 7.9, "UInt16", 3, 16)
    api.write(rows, width="40", height="20", compression="Deflate", predictor="2")
    images = api.read_images(spark, str(tmp_path / "c.tif"))
    assert api.tile_list(images).first().tiles == 6
    assert '"width":40' in api.info(images).first().json and api.metadata(images).first().json
    assert (api.tile(spark, f"{tmp_path}/c.tif", 0, 2, 1) == 7).all()
    pixels = api.read_pixels(spark, str(tmp_path / "c.tif"))
    stats, histogram = api.tile_statistics(pixels, 16, 16)
    assert {(r.min_value, r.max_value) for r in stats.collect()} == {(7.0, 7.0)} and stats.agg(F.sum("n")).first()[0] == 40 * 20 * 3
    assert histogram.agg(F.sum("n")).first()[0] == 40 * 20 * 3
    assert api.thumbnail(pixels, images, 4, 2).count() == 4 * 2 * 3
    assert api.parse_size("12x34") == (12, 34)
    for bad in ("12", "0x3", "axb"):
        with pytest.raises(InvalidArgument):
            api.parse_size(bad)


def test_stands_without_the_optional_folder(tmp_path):
    """A copy without the training-data operators imports and lists its queries."""
    import shutil

    shutil.copytree(REPO / "tesserae", tmp_path / "tesserae", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries())[0])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0 and "axis_validation" in run.stdout, run.stderr


def test_storage_trees_refuse(spark):
    from tesserae.operators import storage

    row = (0, 0, 10, 10, 1, "UInt8", "None", 8, 8, None, None, {"image.spice.frame": "J2000"})
    schema = f"scene_id int, id bigint, width bigint, height bigint, channel_count int, pixel_type string, compression string, tile_w bigint, tile_h bigint, camera {schemas.CAMERA}, crs {schemas.CRS}, fields map<string,string>"
    good = spark.createDataFrame([row], schema)
    assert storage.images(storage.serialised(good)).first().fields == {"image.spice.frame": "J2000"}
    for change in ({"channel_count": 513}, {"pixel_type": "UInt16", "compression": "Jpeg"}, {"compression": "Odd"}):
        bad = good
        for name, value in change.items():
            bad = bad.withColumn(name, F.lit(value))
        with pytest.raises(Exception, match="INVALID_ARGUMENT"):
            storage.serialised(bad).collect()
    tree = storage.serialised(good)
    for key, value in (("imageWidth", "wide"), ("pixelType", "odd"), ("image.scene.object_type", "odd")):
        broken = tree.withColumn("fields", fields.upsert(F.col("fields"), F.lit(key), F.lit(value)))
        with pytest.raises(Exception, match="INVALID_ARGUMENT"):
            storage.images(broken).collect()


def test_parameters_and_identifiers(spark):
    m = F.create_map(F.lit("k1"), F.lit(0.5))
    assert values(spark, fields.parameter(m, "k1")) == [0.5]
    with pytest.raises(Exception, match="NOT_FOUND"):
        values(spark, fields.parameter(m, "k2"))
    with pytest.raises(Exception, match="NOT_IMPLEMENTED"):
        values(spark, fields.crs_identifier())


def test_statistics_of_odd_samples(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [0.0, 1.0, nan, inf, -inf, None]), (2, [nan, None]), (3, [5.0])], "k int, v array<double>")
    by_array = {(r.k, r.bin): (r.n, r.label) for r in stats.array_histogram(rows, ["k"], "v").collect()}
    flat = rows.select("k", F.explode("v").alias("value"))
    assert by_array == {(r.k, r.bin): (r.n, r.label) for r in stats.histogram(flat, ["k"]).collect()} == {(1, 0): (1, 0), (1, 63): (1, 0), (3, 0): (1, 5)}
    assert {r.k: (r.min_value, r.max_value, r.n) for r in stats.channel_stats(flat, ["k"]).collect()} == {1: (0.0, 1.0, 2), 3: (5.0, 5.0, 1)}
    times = spark.createDataFrame([("a", float(x)) for x in (3, 1, 2, 4)] + [("b", 7.0), ("c", 2.0), ("c", 1.0), ("c", 3.0)], "k string, ms double")
    assert {r.k: (r.median_ms, r.min_ms, r.max_ms) for r in stats.timing_summary(times, ["k"], "ms").collect()} == {"a": (3.0, 1.0, 4.0), "b": (7.0, 7.0, 7.0), "c": (2.0, 1.0, 3.0)}
