"""Expected values of the reference's own tests, re-typed (see FIXTURES.md part A)."""

import json

import pytest
from pyspark.sql import functions as F

from tilework.functions import clip, geom, grid, linear, paths, utm
from tilework.operators import encode, raster, tiling

CITIES = [("San Francisco", -122.42, 37.78), ("Berlin", 13.41, 52.52), ("Lima", -77.03, 12.04)]


def cities(spark):
    return spark.createDataFrame([(i, n, x, y) for i, (n, x, y) in enumerate(CITIES)], "id long, name string, lon double, lat double")


def test_points_by_tile(spark):
    pts = cities(spark).withColumn("geom", geom.point("lon", "lat"))
    rows = tiling.assign_tiles(pts, [1]).select("x", "y", "name").collect()
    assert {(r["x"], r["y"], r["name"]) for r in rows} == {(0, 0, "San Francisco"), (0, 0, "Lima"), (1, 0, "Berlin")}
    rows = tiling.assign_tiles(pts, [0], "wgs84").select("x", "y", "name").collect()
    assert {(r["x"], r["y"], r["name"]) for r in rows} == {(0, 0, "San Francisco"), (0, 0, "Lima"), (1, 0, "Berlin")}


def line(spark, points):
    df = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in points])], "id long, p array<struct<x:double,y:double>>")
    return df.select("id", geom.line("p").alias("geom"))


def test_line_is_clipped_by_hemisphere(spark):
    a = tiling.assign_tiles(line(spark, [(-180, 32), (180, 32)]), [0], "wgs84")
    c = clip.clipped(a, "geom", tiling.lonlat_envelope(0.0, "wgs84"))
    got = {r["x"]: [(p["x"], p["y"]) for p in r["p"]] for r in c.select("x", geom.points("geom").alias("p")).collect()}
    assert got == {0: [(-180, 32), (0, 32)], 1: [(0, 32), (180, 32)]}


def test_world_polygon_is_clipped(spark):
    df = spark.range(1).select(F.lit(1).alias("id"), geom.box(F.lit(-180.0), F.lit(-90.0), F.lit(180.0), F.lit(90.0)).alias("geom"))
    c = clip.clipped(tiling.assign_tiles(df, [0], "wgs84"), "geom", tiling.lonlat_envelope(0.0, "wgs84"))
    got = {r["x"]: tuple(r["b"]) for r in c.select("x", geom.bbox("geom").alias("b")).collect()}
    assert got == {0: (-180, -90, 0, 90), 1: (0, -90, 180, 90)}


def test_topojson_decodes_to_the_points(spark):
    a = tiling.assign_tiles(cities(spark).withColumn("geom", geom.point("lon", "lat")), [1]).withColumn("props", F.lit("{}"))
    bodies = {(r["x"], r["y"]): json.loads(r["body"]) for r in encode.topojson_tiles(a).collect()}
    assert {k: len(v["objects"]["vectile"]["geometries"]) for k, v in bodies.items()} == {(0, 0): 2, (1, 0): 1}
    t = bodies[(1, 0)]
    q = t["objects"]["vectile"]["geometries"][0]["coordinates"]
    x, y = (q[i] * t["transform"]["scale"][i] + t["transform"]["translate"][i] for i in (0, 1))
    assert abs(x - 13.41) < 1 and abs(y - 52.52) < 1


def test_topojson_line_and_merge(spark):
    a = tiling.assign_tiles(line(spark, [(-180, 32), (180, 32)]), [0]).withColumn("props", F.lit("{}"))
    t = encode.topojson_tiles(a).withColumn("layer", F.lit("vectile_test"))
    u = t.withColumn("layer", F.lit("vectile_copy"))
    merged = json.loads(encode.merge_topojson(t.unionByName(u)).first()["body"])
    assert sorted(merged["objects"]) == ["vectile_copy", "vectile_test"]
    assert len(merged["arcs"]) == 2 and {o["geometries"][0]["arcs"][0] for o in merged["objects"].values()} == {0, 1}
    arc, tr = merged["arcs"][0], merged["transform"]
    x0 = arc[0][0] * tr["scale"][0] + tr["translate"][0]
    x1 = (arc[0][0] + arc[1][0]) * tr["scale"][0] + tr["translate"][0]
    assert abs(x0 + 180) < 2 and abs(x1 - 180) < 2


def test_quantised_line(spark):
    env = F.struct(*[F.lit(v).alias(k) for k, v in (("xmin", -180.0), ("ymin", -90.0), ("xmax", 180.0), ("ymax", 90.0))])
    q = line(spark, [(-179, 32), (179, 32)]).select(geom.points(geom.round_coords(geom.quantize("geom", env), 0)).alias("p")).first()["p"]
    assert [(round(p["x"] * 360 / 4096 - 180), round(p["y"] * 180 / 4096 - 90)) for p in q] == [(-179, 32), (179, 32)]


def test_shift_and_mask(spark):
    g = line(spark, [(0.1, 0.2), (0.3, 0.4)])
    s = g.select(geom.points(geom.transform_coords("geom", lambda x, y: x + 1, lambda x, y: y + 1)).alias("p")).first()["p"]
    assert [(p["x"], p["y"]) for p in s] == [(1.1, 1.2), (1.3, 1.4)]
    m = g.select(geom.points(clip.mask_coords("geom")).alias("p")).first()["p"]
    assert all(abs(a - b) < 1e-8 for p, q in zip(m, [(0.1, 0.2), (0.3, 0.4)], strict=True) for a, b in zip((p["x"], p["y"]), q, strict=True))
    assert m[0]["x"] != 0.1


@pytest.mark.parametrize("text, want", [("#f90", (255, 153, 0, 255)), ("#ff9900", (255, 153, 0, 255)), ("#ff9900ff", (255, 153, 0, 255)), ("#f908", (255, 153, 0, 136)), ("#0000", (0, 0, 0, 0)), ("#ffff", (255,) * 4), ("#000f", (0, 0, 0, 255))])
def test_colours(spark, text, want):
    assert raster.parse_color(text) == want
    c = spark.range(1).select(raster.color_struct(F.lit(text)).alias("c")).first()["c"]
    assert tuple(c) == want


@pytest.mark.parametrize("bad", [True, None, 1337, [93], "blue", "#f", "#ff", "#fffff", "#fffffff", "#fffffffff", "#nope", "#9999999999"])
def test_bad_colours(bad):
    with pytest.raises((TypeError, ValueError)):
        raster.parse_color(bad)


def bitmap(spark, pixels):
    rows = [(0, 0, 0, i % 3, i // 3, *(v / 255.0 for v in p)) for i, p in enumerate(pixels)]
    return spark.createDataFrame(rows, "z int, x int, y int, px int, py int, r double, g double, b double, a double")


F_, C_, N9, K_, NIL = (255, 255, 255, 255), (204, 204, 204, 255), (153, 153, 153, 255), (0, 0, 0, 255), (0, 0, 0, 0)


def stack_pixels(spark, stack, layers):
    tiles = spark.createDataFrame([(0, 0, 0)], "z int, x int, y int")
    out = raster.to_bytes(raster.composite_stack(stack, layers, tiles, 3)).collect()
    return {(r["px"], r["py"]): (r["r"], r["g"], r["b"], r["a"]) for r in out}


@pytest.fixture(scope="module")
def layers(spark):
    return {
        "base": bitmap(spark, [C_] * 9),
        "halos": bitmap(spark, [F_, F_, K_, F_, F_, K_, K_, K_, K_]),
        "outlines": bitmap(spark, [NIL] + [N9] * 7 + [NIL]),
        "streets": bitmap(spark, [NIL, NIL, F_, NIL, F_, NIL, F_, NIL, NIL]),
    }


STACKS = [
    ([{"src": "base"}, [{"src": "outlines"}, {"src": "streets"}]], [C_, N9, F_, N9, F_, N9, F_, N9, C_]),
    ([{"src": "base"}, [{"src": "outlines", "mask": "halos"}, {"src": "streets"}]], [C_, N9, F_, N9, F_, C_, F_, C_, C_]),
    ([{"color": "#ccc"}, [{"src": "outlines", "mask": "halos"}, {"src": "streets"}]], [C_, N9, F_, N9, F_, C_, F_, C_, C_]),
    ([{"color": "#ccc"}, [{"color": "#999", "mask": "halos"}, {"src": "streets"}]], [N9, N9, F_, N9, F_, C_, F_, C_, C_]),
    ([[{"color": "#999", "mask": "halos"}, {"src": "streets"}]], [N9, N9, F_, N9, F_, NIL, F_, NIL, NIL]),
]


@pytest.mark.parametrize("stack, want", STACKS)
def test_stacks(spark, layers, stack, want):
    got = stack_pixels(spark, stack, layers)
    assert [got[i % 3, i // 3] for i in range(9)] == want


@pytest.mark.parametrize("stack", [{"src": "streets", "color": "#999", "mask": "halos"}, {"mask": "halos"}, {}])
def test_bad_stacks(spark, layers, stack):
    with pytest.raises(ValueError):
        stack_pixels(spark, stack, layers)


def test_alpha_stack(spark):
    gray, wipe = (128, 128, 128, 255), [(255, 255, 255, a) for a in (0, 0, 0, 128, 128, 128, 255, 255, 255)]
    got = stack_pixels(spark, [[{"src": "gray"}, {"src": "wipe"}]], {"gray": bitmap(spark, [gray] * 9), "wipe": bitmap(spark, wipe)})
    assert [got[0, y][0] for y in range(3)] == [0x80, 0xC0, 0xFF] and all(v[3] == 255 for v in got.values())
    over = stack_pixels(spark, [{"src": "wipe"}], {"wipe": bitmap(spark, wipe)})
    assert [over[0, y][3] for y in range(3)] == [0, 0x80, 0xFF]


def test_keys_and_paths(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("v")).first()["v"]
    lit = [F.lit("memcache_osm"), F.lit(0), F.lit(0), F.lit(0), F.lit("PNG")]
    assert f(paths.tile_store_key(*lit, revision=4)) == "/4/memcache_osm/0/0/0.PNG"
    assert f(paths.tile_store_key(*lit, prefix="cool_prefix", revision=1)) == "cool_prefix/1/memcache_osm/0/0/0.PNG"
    long_ = f(paths.tile_store_key(F.lit("x" * 300), *lit[1:], revision=1))
    assert len(long_) == 240
    t = [F.lit("l"), F.lit(12), F.lit(656), F.lit(1582), F.lit("PNG")]
    assert f(paths.tile_disk_path(*t)) == "l/12/000/656/001/582.png"
    assert f(paths.tile_disk_path(*t, layout="portable")) == "l/12/656/1582.png"
    assert f(paths.quadtile(F.lit(12), F.lit(656), F.lit(1582))) == "0023010212220"
    p = f(paths.parse_tile_path(F.lit("/a/b/3/-1/2.json")))
    assert tuple(p) == ("a/b", 3, -1, 2, "json")
    assert tuple(f(paths.parse_tile_path(F.lit("/osm/")))) == ("osm", None, None, None, "html")
    assert f(paths.parse_tile_path(F.lit("nonsense"))) is None
    assert grid.metatile_size(4, 4, 64) == (1152, 1152)


def test_utm_and_linear(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("v")).first()["v"]
    assert f(utm.utm_grid(F.lit(-72.3), F.lit(18.5))) == "18Q"
    assert f(utm.mgrs(F.lit(780950), F.lit(2052283), F.lit("18Q"), 3)) == "18Q YF 80 52"
    g = linear.LinearGrid((4.0, 2.0, 1.0), left=100.0, top=500.0)
    assert g.base_zoom == 2 and g.zoom_of(2.0) == 1
    assert tuple(f(g.corner_tile(F.lit(100.0 + 256), F.lit(500.0 - 512), F.lit(2)))) == (1, 2)
    with pytest.raises(ValueError):
        linear.LinearGrid((4.0, 2.0))


def test_counts_sum_to_parents(spark, sf):
    from tilework.plans import fixtures as fx

    rows = tiling.tile_counts(fx.points(spark, sf), range(5)).collect()
    by = {(r["z"], r["x"], r["y"]): r["n"] for r in rows}
    for (z, x, y), n in by.items():
        if z < 4:
            assert n == sum(by.get((z + 1, 2 * x + i, 2 * y + j), 0) for i in (0, 1) for j in (0, 1))
    plan = tiling.assign_tiles(fx.boxes(spark, sf).select("id", "geom"), [4], exact=False)
    tiles = plan.select("z", "x", "y").distinct()
    text = tiling.keep_tiles(plan.hint("merge"), tiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_lines_meet_a_box_where_clipping_leaves_something(spark):
    import random

    from pyspark.sql import functions as F

    from tilework.functions import clip

    pick = random.Random(5)
    rows = []
    for i in range(400):
        parts = [[[(pick.randint(-6, 6) / 2, pick.randint(-6, 6) / 2) for _ in range(pick.randint(1, 5))]] for _ in range(pick.randint(1, 2))]
        rows.append((i, ("LineString" if len(parts) == 1 else "MultiLineString", parts)))
    df = spark.createDataFrame(rows, "id int, geom struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>")
    env = F.struct(*[F.lit(v).alias(k) for k, v in (("xmin", -1.0), ("ymin", -0.5), ("xmax", 1.5), ("ymax", 1.0))])
    got = df.select(clip.meets("geom", env).alias("a"), clip.clip("geom", env)["kind"].isNotNull().alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and 50 < sum(r["a"] for r in got) < 350
