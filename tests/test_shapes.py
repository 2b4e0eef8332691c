"""Shapes against brute force: thinning, validity, clipping of concave polygons, binary forms, searches."""

import hashlib
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.functions import clip, geom, shapes, wkb
from tilework.operators import tiling

SCHEMA = f"id long, geom {geom.GEOM}"


def flat(kind, parts):
    rings = [r for p in parts for r in p]
    return kind, [x for r in rings for x, _ in r], [y for r in rings for _, y in r], [len(r) for r in rings]


def random_shape(rng, lo=-5.0, hi=40.0, size=6.0):
    kind = rng.choice(["Point", "LineString", "Polygon", "MultiPoint"])
    at = (rng.uniform(lo, hi), rng.uniform(lo, hi))
    near = lambda: (at[0] + rng.uniform(-size, size), at[1] + rng.uniform(-size, size))
    if kind == "Point":
        return kind, [[[at]]]
    if kind == "MultiPoint":
        return kind, [[[near()]] for _ in range(3)]
    if kind == "LineString":
        return kind, [[[near() for _ in range(rng.randint(2, 4))]]]
    a, b = sorted((at[0], near()[0])), sorted((at[1], near()[1]))
    return kind, [[[(a[0], b[0]), (a[1], b[0]), (a[1], b[1]), (a[0], b[1]), (a[0], b[0])]]]


def samples(kind, parts, n=60):
    """Points all over a shape, for a distance by brute force."""
    out = []
    for p in parts:
        for r in p:
            pts = np.array(r)
            out.append(pts)
            for a, b in zip(pts[:-1], pts[1:], strict=True) if "Point" not in kind else ():
                out.append(a + np.linspace(0, 1, n)[:, None] * (b - a))
        if "Polygon" in kind:
            (x0, y0), (x1, y1) = np.min(p[0], axis=0), np.max(p[0], axis=0)
            gx, gy = np.meshgrid(np.linspace(x0, x1, 25), np.linspace(y0, y1, 25))
            out.append(np.stack([gx.ravel(), gy.ravel()], axis=1))
    return np.vstack(out)


def test_distance_of_shapes_against_samples():
    rng, seen = random.Random(3), {True: 0, False: 0}
    for _ in range(300):
        (ka, a), (kb, b) = random_shape(rng, 0, 12), random_shape(rng, 0, 12)
        sa, sb = samples(ka, a), samples(kb, b)
        least = np.sqrt(((sa[:, None, :] - sb) ** 2).sum(axis=2).min())
        got = shapes.within(ka, shapes.edges(*flat(ka, a)), kb, shapes.edges(*flat(kb, b)), 1.5)
        if abs(least - 1.5) > 0.4:  # samples are coarse
            assert got == (least < 1.5)
            seen[got] += 1
    assert min(seen.values()) > 50


@pytest.mark.parametrize("task_rows", [3, 20_000])
def test_thinning_of_shapes_against_one_pass(spark, task_rows):
    rng = random.Random(11)
    rows = [(i, random_shape(rng, -170.0, 80.0, 3.0)) for i in range(250)] + [(300, ("Point", [[[(10.0, 10.0)]]]))] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("note", F.lit("n"))
    a = tiling.assign_tiles(df, [1, 2]).cache()
    got = tiling.thin_by_spacing(a, 5, geom="geom", task_rows=task_rows)
    assert got.columns == a.columns
    tiles = {}
    for r in a.select(*tiling.KEY, "id", *tiling._shape(F.col("geom"))).orderBy("id").collect():
        tiles.setdefault((r["z"], r["x"], r["y"]), []).append((r["id"], (r["_kind"], shapes.edges(r["_kind"], r["_xs"], r["_ys"], r["_lens"]))))
    want = []
    for key, features in tiles.items():
        kept = []
        for i, s in features:
            if not any(shapes.within(*s, *k, 5) for _, k in kept):
                kept.append((i, s))
        want += [(*key, i) for i, _ in kept]
    assert sorted(tuple(r) for r in got.select(*tiling.KEY, "id").collect()) == sorted(want) and len(want) < a.count() * 0.9


# ---- validity --------------------------------------------------------------------------------------------------------


def star(rng, n, cx=0.0, cy=0.0, lo=2.0, hi=9.0):
    turns = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    pts = [(cx + rng.uniform(lo, hi) * np.cos(t), cy + rng.uniform(lo, hi) * np.sin(t)) for t in turns]
    return [*pts, pts[0]]


def crosses(a, b, c, d):
    t = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return t(a, b, c) * t(a, b, d) <= 0 and t(c, d, a) * t(c, d, b) <= 0


def test_validity_against_all_pairs_of_segments():
    rng, seen = random.Random(8), {True: 0, False: 0}
    for _ in range(400):
        ring = star(rng, rng.randint(4, 9))
        if rng.random() < 0.6:
            i, j = rng.sample(range(1, len(ring) - 1), 2)
            ring[i], ring[j] = ring[j], ring[i]
        s = list(zip(ring[:-1], ring[1:], strict=True))
        want = not any(crosses(*s[i], *s[j]) for i in range(len(s)) for j in range(i + 2, len(s)) if (i, j) != (0, len(s) - 1))
        got = shapes.simple_polygon([np.array(ring)])
        assert got == want
        seen[got] += 1
    assert min(seen.values()) > 50


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


@pytest.mark.parametrize(
    ("rings", "valid"),
    [
        ([SQUARE], True), ([[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]], False), ([SQUARE[:4]], False), ([[(0, 0), (1, 1), (0, 0)]], False),
        ([[(0, 0), (10, 0), (5, 0), (5, 5), (0, 0)]], False), ([[(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (0, 0)]], True),
        ([SQUARE, [(2, 2), (2, 4), (4, 4), (2, 2)]], True), ([SQUARE, [(0, 5), (2, 4), (2, 6), (0, 5)]], True), ([SQUARE, [(0, 4), (2, 5), (0, 6), (0, 4)]], False),
        ([SQUARE, [(8, 8), (8, 12), (12, 12), (8, 8)]], False), ([SQUARE, [(20, 2), (20, 4), (24, 4), (20, 2)]], False), ([SQUARE, [(0, 5), (5, 0), (5, 5), (0, 5)]], False),
        ([SQUARE, [(2, 2), (2, 8), (8, 8), (8, 2), (2, 2)], [(3, 3), (3, 4), (4, 4), (3, 3)]], False), ([SQUARE, [(1, 1), (1, 2), (2, 2), (1, 1)], [(2, 2), (2, 3), (3, 3), (2, 2)]], True),
        ([[(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)]], False),
    ],
)
def test_valid_polygons(rings, valid):
    assert shapes.simple_polygon([np.array(r, float) for r in rings]) == valid


def test_usable_rows(spark):
    bow = [[[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]]
    square = [[[(float(x), float(y)) for x, y in SQUARE]]]
    rows = [(1, ("Polygon", square)), (2, ("Polygon", bow)), (3, ("LineString", bow)), (4, None), (5, ("MultiPolygon", square + bow)), (6, ("Point", [[[(float("nan"), 0.0)]]])), (7, ("Polygon", []))]
    assert {r["id"] for r in shapes.usable(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 3}


# ---- clipping --------------------------------------------------------------------------------------------------------


def area_by_grid(polygons, box, n=160):
    xs, ys = (np.linspace(box[i], box[i + 2], n, endpoint=False) + (box[i + 2] - box[i]) / n / 2 for i in (0, 1))
    s = [np.hstack([r[:-1], r[1:]]) for p in polygons for r in p]
    s = np.vstack(s) if s else np.empty((0, 4))
    return sum(shapes.inside(x, y, s) for x in xs for y in ys) * (box[2] - box[0]) * (box[3] - box[1]) / n / n


def ridge(rng, n):
    """A simple polygon with a jagged upper side."""
    pts = [(0.0, -6.0), (float(n), -6.0), *[(float(i), rng.uniform(-2, 8)) for i in range(n, -1, -1)]]
    return np.array([*pts, pts[0]])


def test_concave_polygons_are_cut_apart():
    rng, several, holes = random.Random(21), 0, 0
    for k in range(40):
        n = rng.randint(6, 14)
        hole = np.array([(2, -4.5), (4, -4.5), (4, -3), (2, -3), (2, -4.5)], float)
        rings = [ridge(rng, n)[:: rng.choice([1, -1])]] + ([hole] if k % 2 else [])
        if not shapes.simple_polygon(rings):
            rings = rings[:1]
        box = np.array([rng.uniform(0, 3), rng.choice([-5.0, rng.uniform(-2, 3)]), n - rng.uniform(0, 2), rng.uniform(3.5, 7)])
        got = clip.clip_polygon(rings, box)
        assert all(((r >= box[:2]) & (r <= box[2:])).all() and (r[0] == r[-1]).all() for p in got for r in p)
        assert all(clip.signed_area(p[0]) > 0 and all(clip.signed_area(h) < 0 for h in p[1:]) for p in got)
        total = sum(clip.signed_area(r) for p in got for r in p)
        # the grid's error is a cell or so along the edges
        assert abs(total - area_by_grid([rings], box, 80)) < 1.5 and abs(total - area_by_grid(got, box, 80)) < 1.5
        assert all(shapes.simple_polygon(p) for p in got)
        several, holes = several + (len(got) > 1), holes + any(len(p) > 1 for p in got)
    assert several > 2 and holes > 2, (several, holes)
    comb = np.array([(0, 0), (10, 0), (10, 5), (8, 5), (8, 1), (6, 1), (6, 5), (4, 5), (4, 1), (2, 1), (2, 5), (0, 5), (0, 0)], float)
    teeth = clip.clip_polygon([comb], (0.0, 3.0, 10.0, 6.0))
    assert sorted((p[0][:, 0].min(), p[0][:, 0].max()) for p in teeth) == [(0, 2), (4, 6), (8, 10)] and all(len(p) == 1 for p in teeth)
    assert clip.clip_polygon([comb], (2.0, 2.0, 4.0, 4.0)) == []  # only touched
    frame = [np.array(SQUARE, float), np.array([(2, 2), (2, 8), (8, 8), (8, 2), (2, 2)], float)]
    assert len(clip.clip_polygon(frame, (4.0, -1.0, 6.0, 11.0))) == 2 and clip.clip_polygon(frame, (3.0, 3.0, 7.0, 7.0)) == []


def test_polygons_meet_a_box_where_clipping_leaves_something(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        cx, cy = rng.uniform(-15, 15), rng.uniform(-15, 15)
        rings = [star(rng, 7, cx, cy)] + ([star(rng, 5, cx, cy, 0.5, 1.9)] if i % 2 else [])
        rows.append((i, ("Polygon", [[[tuple(map(float, p)) for p in r] for r in rings]])))
    env = F.struct(*[F.lit(v).alias(k) for k, v in (("xmin", -0.5), ("ymin", -0.5), ("xmax", 0.7), ("ymax", 0.5))])
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select(clip.meets("geom", env).alias("a"), clip.clip("geom", env)["kind"].isNotNull().alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and 10 < sum(r["a"] for r in got) < 190
    plan = tiling.assign_tiles(df, [3])._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


# ---- binary form -----------------------------------------------------------------------------------------------------


def test_published_binary_forms_and_round_trip(spark):
    point = bytes.fromhex("0101000000000000000000F03F0000000000000040")  # POINT(1 2)
    line = bytes.fromhex("01020000000200000000000000000000000000000000000000000000000000F03F000000000000F03F")  # LINESTRING(0 0, 1 1)
    assert wkb.decoded(point) == ("Point", [[[{"x": 1.0, "y": 2.0}]]])
    assert wkb.decoded(bytes.fromhex("00000000013FF00000000000004000000000000000")) == wkb.decoded(point)  # big-endian
    rng = random.Random(4)
    rows = [(1, ("Point", [[[(1.0, 2.0)]]])), (2, ("LineString", [[[(0.0, 0.0), (1.0, 1.0)]]])), (3, None)]
    rows += [(10 + i, random_shape(rng)) for i in range(30)]
    rows += [(50, ("MultiPolygon", [[star(rng, 5), star(rng, 4)], [star(rng, 6)]])), (51, ("MultiLineString", [[star(rng, 3)], [star(rng, 4)]]))]
    rows = [(i, g and (g[0], [[[(float(x), float(y)) for x, y in r] for r in p] for p in g[1]])) for i, g in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("b", wkb.to_wkb("geom"))
    got = {r["id"]: r for r in df.select("*", wkb.from_wkb("b").alias("back"), wkb.feature_id("geom").alias("own"), wkb.feature_id("geom", F.when(F.col("id") == 2, "two")).alias("given")).collect()}
    assert bytes(got[1]["b"]) == point and bytes(got[2]["b"]) == line and got[3]["b"] is None
    assert got[1]["own"] == hashlib.md5(point).hexdigest()[:10] and got[2]["given"] == "two" and got[3]["own"] is None
    assert all(r["back"] == r["geom"] for i, r in got.items() if i != 3)
    with pytest.raises(ValueError, match="follow"):
        wkb.decoded(point + b"x")
    with pytest.raises((struct.error, KeyError, ValueError)):
        wkb.decoded(b"\x01\x07\x00\x00\x00\x00\x00\x00\x00")


# ---- searches --------------------------------------------------------------------------------------------------------


def test_search_joins_no_more_rows_for_more_features(spark):
    from tilework.functions import grid

    rng = random.Random(6)
    tiles = spark.createDataFrame([(z, rng.randrange(2**z), rng.randrange(2**z)) for z in (5, 6, 9) for _ in range(30)], "z int, x int, y int").distinct()
    half = grid.CIRCUMFERENCE / 2
    for n, spread in ((1, 1.0), (40, 1.0), (3000, 0.02)):
        pts = [(rng.uniform(-half, half) * spread, rng.uniform(-half, half) * spread) for _ in range(n)] + [(0.0, 0.0)] * 5 + [(None, 1.0)]
        got = {(r["z"], r["x"], r["y"]): r["level"] for r in tiling.expand_search(tiles, spark.createDataFrame(pts, "mx double, my double")).collect()}
        xy = np.array([p for p in pts if p[0] is not None])
        for (z, x, y), level in got.items():
            span = grid.CIRCUMFERENCE / 2**z
            x0, y1 = x * span - half, half - y * span
            want = None
            for k in range(20):
                g = span * (8**k - 1) / 2
                if (span * 8**k) ** 2 >= 1.61e15 * 64:
                    break
                if ((xy[:, 0] >= x0 - g) & (xy[:, 0] <= x0 + span + g) & (xy[:, 1] >= y1 - span - g) & (xy[:, 1] <= y1 + g)).any():
                    want = k
                    break
            assert level == want, (z, x, y)
        assert len(got) == tiles.count()
    # a level's cells over a box are nine, so what is looked up grows with tiles alone
    few, many = (tiling._lookups(tiles.where("z = 9"), 9, 4).count() for _ in range(2))
    assert few == many <= 9 * 4 * tiles.where("z = 9").count()


def test_progress_and_ties(spark):
    rows = [(i % 3, i % 7, i) for i in range(500)]
    got = tiling.with_progress(spark.createDataFrame(rows, "z int, x int, y int"), ["z", "x", "y"])
    want = {r: i for i, r in enumerate(sorted(rows))}
    assert {(r["z"], r["x"], r["y"]): r["offset"] for r in got.collect()} == want and got.first()["total"] == 500
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("_range")[0]


def clipped_run_by_run(line, box):
    """Segment by segment, with fractions: the runs of a line inside a box."""
    runs = []
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        dx, dy, t0, t1 = Fraction(bx) - Fraction(ax), Fraction(by) - Fraction(ay), Fraction(0), Fraction(1)
        for p, q in ((-dx, Fraction(ax) - Fraction(box[0])), (dx, Fraction(box[2]) - Fraction(ax)), (-dy, Fraction(ay) - Fraction(box[1])), (dy, Fraction(box[3]) - Fraction(ay))):
            if p == 0:
                t1 = t1 if q >= 0 else Fraction(-1)
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 <= t1:
            a, b = ((Fraction(ax) + t * dx, Fraction(ay) + t * dy) for t in (t0, t1))
            if runs and runs[-1][-1] == a:
                runs[-1].append(b)
            else:
                runs.append([a, b])
    runs = [[p for i, p in enumerate(r) if not i or p != r[i - 1]] for r in runs]
    real = [r for r in runs if len(r) > 1]
    return real or [r * 2 for r in runs[:1]]


def test_lines_of_a_batch_are_clipped_as_one_by_one(spark):
    random.seed(11)
    spot = lambda: (float(random.randint(-8, 8)), float(random.randint(-8, 8)))
    rows = []
    for i in range(400):
        lines = [[spot() for _ in range(random.choice([0, 1, 2, 3, 9]))] for _ in range(random.choice([0, 1, 1, 3]))]
        for line in lines[:1] if i % 3 == 0 else []:
            line.extend(line[-1:])  # a segment without length
        x, y = random.randint(-6, 4), random.randint(-6, 4)
        rows.append((i, "LineString" if len(lines) == 1 else "MultiLineString", lines, float(x), float(y), float(x + random.choice([0, 2, 4])), float(y + random.choice([0, 4]))))
    rows += [(400, None, [[(0.0, 0.0), (1.0, 1.0)]], -1.0, -1.0, 2.0, 2.0), (401, "LineString", None, -1.0, -1.0, 2.0, 2.0), (402, "LineString", [[(0.0, 0.0), (1.0, 1.0)]], None, -1.0, 2.0, 2.0)]
    rows += [(403, "Point", [[(1.0, 1.0)]], 0.0, 0.0, 2.0, 2.0), (404, "Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]], 0.0, 0.0, 9.0, 9.0)]
    shaped = [(i, k, None if p is None else [[[{"x": x, "y": y} for x, y in line]] for line in p], *b) for i, k, p, *b in rows]
    df = spark.createDataFrame(shaped, "id long, kind string, parts array<array<array<struct<x:double,y:double>>>>, xmin double, ymin double, xmax double, ymax double").coalesce(1)
    df = df.withColumn("geom", F.struct("kind", "parts"))
    env = F.struct("xmin", "ymin", "xmax", "ymax")
    found = clip.clipped(df.select("id", "geom", "xmin", "ymin", "xmax", "ymax"), "geom", env)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the filter on what is left doesn't clip once more
    got = {r["id"]: r["geom"] for r in found.collect()}
    for i, kind, lines, *box in rows[:400]:
        want = [r for line in lines for r in clipped_run_by_run(line, box)]
        if not want:
            assert i not in got, i
            continue
        assert got[i]["kind"] == ("LineString" if len(want) == 1 else "MultiLineString")
        assert [len(p) for p in got[i]["parts"]] == [1] * len(want)
        have = [[(p["x"], p["y"]) for p in part[0]] for part in got[i]["parts"]]
        assert [len(r) for r in have] == [len(r) for r in want], (i, have, want)
        assert all(abs(float(u) - v) < 1e-9 for a, b in zip(want, have) for p, q in zip(a, b) for u, v in zip(p, q))
    assert set(got) - set(range(400)) == {403, 404} and got[403]["kind"] == "Point" and len(got[404]["parts"][0][0]) == 4
    assert clip.clipped(df.where("id < 0"), "geom", env).count() == 0
