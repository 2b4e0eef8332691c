"""Clipping, simplifying and masking of geometries: vectorised Python over Arrow batches, where higher-order
functions can't say it. Row-wise helpers stay small; Spark deals out the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilework.functions.geom import GEOM_TYPE, _c
from tilework.functions.shapes import inside

Ring = np.ndarray  # (n, 2)
ARROW_GEOM = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])


def _geometries(kinds: list, parts: list) -> pa.Array:
    return pa.array([{"kind": k, "parts": p} for k, p in zip(kinds, parts, strict=True)], ARROW_GEOM)


def _ring(points) -> Ring:
    return np.array([(p["x"], p["y"]) for p in points], dtype=float).reshape(-1, 2)


def _rows(ring: Ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def signed_area(ring: Ring) -> float:
    """Positive for a ring that runs counter-clockwise."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _crossing(a, b, axis: int, limit: float) -> tuple[float, float]:
    """Where the segment from a to b meets a line parallel to an axis, on that line exactly."""
    for end in (a, b):
        if end[axis] == limit:
            return float(end[0]), float(end[1])
    t = (limit - a[axis]) / (b[axis] - a[axis])
    at = [float(a[0] + t * (b[0] - a[0])), float(a[1] + t * (b[1] - a[1]))]
    at[axis] = limit
    return at[0], at[1]


def cut_rings(rings: list[Ring], axis: int, limit: float, above: bool) -> list[Ring]:
    """The part of a polygon on one side of a line parallel to an axis. rings: closed, the inside to their left.

    What is left of a ring are chains from where it comes in to where it goes out. Along the line, ways out and ways in
    take turns, the inside between them, so in the order along the line each way out leads on to the way in of the same number, whichever
    ring that belongs to: a ring falls into as many as there are pieces, and a hole that is cut joins its outside."""
    out, chains = [], []
    for ring in rings:
        pts = ring[:-1]
        keep = pts[:, axis] >= limit if above else pts[:, axis] <= limit
        if keep.all():
            out.append(ring)
            continue
        n = len(pts)
        for start in np.flatnonzero(keep & ~np.roll(keep, 1)):
            end = start
            while keep[(end + 1) % n]:
                end += 1
            body = [tuple(map(float, pts[i % n])) for i in range(start, end + 1)]
            chains.append([_crossing(pts[start - 1], pts[start], axis, limit), *body, _crossing(pts[end % n], pts[(end + 1) % n], axis, limit)])
    ways_in = sorted(range(len(chains)), key=lambda c: chains[c][0][1 - axis])
    ways_out = sorted(range(len(chains)), key=lambda c: chains[c][-1][1 - axis])
    onward = dict(zip(ways_out, ways_in, strict=True))
    while onward:
        at, points = next(iter(onward)), []
        while at in onward:
            points += chains[at]
            at = onward.pop(at)
        points = [p for p, q in zip(points, points[1:] + points[:1], strict=True) if p != q]
        if len(points) > 2:
            ring = np.array(points + points[:1], dtype=float)
            if signed_area(ring):
                out.append(ring)
    return out


def clip_polygon(rings: list[Ring], box) -> list[list[Ring]]:
    """The polygons that are left of one inside a box: outsides counter-clockwise, holes clockwise with the outside that has them."""
    if all(((r >= box[:2]) & (r <= box[2:])).all() for r in rings):
        return [rings]
    left = []
    for i, r in enumerate(rings):
        r = r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]])
        if len(r) >= 4 and (area := signed_area(r)):
            left.append(r if (area > 0) == (i == 0) else r[::-1])
    for axis, limit, above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        left = cut_rings(left, axis, limit, above)
    outer = [[r] for r in left if signed_area(r) > 0]
    for hole in (r for r in left if signed_area(r) < 0):
        edges = [np.hstack([p[0][:-1], p[0][1:]]) for p in outer]
        held = [sum(inside(x, y, e) for x, y in hole[:-1]) for e in edges] if len(outer) > 1 else [1]
        if outer:
            outer[int(np.argmax(held))].append(hole)
    return outer


def clip_geometry(kind: str, parts, box) -> tuple[str, list] | None:
    """(kind, parts) of points or polygons inside box, or None."""
    if kind in ("Point", "MultiPoint"):
        kept = [p for p in parts for q in [p[0][0]] if box[0] <= q["x"] <= box[2] and box[1] <= q["y"] <= box[3]]
        return (kind if len(kept) == len(parts) or len(kept) > 1 else "Point", kept) if kept else None
    out = [[_rows(r) for r in polygon] for p in parts for polygon in clip_polygon([_ring(r) for r in p], box)]
    return ("Polygon" if len(out) == 1 else "MultiPolygon", out) if out else None


def _nested(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Values as lists of so many each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def clip_lines(parts: pa.Array, boxes: np.ndarray) -> pa.Array:
    """All lines of a batch inside their rows' boxes (rows of xmin, ymin, xmax, ymax): Liang-Barsky on every segment at once.

    Touching runs are joined, a run without length is left only where its line has no other. A row without a run is null."""
    lists, lines = parts.value_lengths().to_numpy(zero_copy_only=False), parts.flatten()
    first = lines.offsets.to_numpy()[:-1]
    rings = lines.values.take(pa.array(first))  # a line's points are its part's one ring
    sizes, points = rings.value_lengths().to_numpy(zero_copy_only=False), rings.flatten()
    xy = np.column_stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)])
    line = np.repeat(np.arange(len(sizes)), sizes)
    row = np.repeat(np.arange(len(lists)), lists)
    start = np.flatnonzero(line[1:] == line[:-1])  # the points that a segment starts from
    a, b, at = xy[start], xy[start + 1], line[start]
    box, d = boxes[row[at]], b - a
    t0, t1, off = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(a), dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, q in ((-d[:, 0], a[:, 0] - box[:, 0]), (d[:, 0], box[:, 2] - a[:, 0]), (-d[:, 1], a[:, 1] - box[:, 1]), (d[:, 1], box[:, 3] - a[:, 1])):
            t = q / p
            off |= (p == 0) & (q < 0)
            t0, t1 = np.where((p < 0) & (t > t0), t, t0), np.where((p > 0) & (t < t1), t, t1)
    on = ~off & (t0 <= t1)
    a, b, d, at, t0, t1 = a[on], b[on], d[on], at[on], t0[on, None], t1[on, None]
    a, b = np.where(t0 > 0, a + t0 * d, a), np.where(t1 < 1, a + t1 * d, b)
    # runs: segments of a line that each start where the one before ended
    opens = np.ones(len(a), dtype=bool)
    opens[1:] = (at[1:] != at[:-1]) | (a[1:] != b[:-1]).any(axis=1)
    run = np.cumsum(opens) - 1
    long = (a != b).any(axis=1)
    head = np.flatnonzero(opens)
    steps = np.bincount(run[long], minlength=len(head))
    of = at[head]
    real = np.bincount(of[steps > 0], minlength=len(sizes)) > 0
    foremost = np.ones(len(head), dtype=bool)
    foremost[1:] = of[1:] != of[:-1]
    kept = np.where(real[of], steps > 0, foremost) if len(head) else foremost
    # a run's points: its first start and the ends of its segments with length, or the start twice
    spots = np.flatnonzero(kept[run] & long)
    flat = np.concatenate([a[head[kept]], a[head[kept & (steps == 0)]], b[spots]])
    owner = np.concatenate([np.flatnonzero(kept), np.flatnonzero(kept & (steps == 0)), run[spots]])
    flat = flat[np.argsort(owner, kind="stable")]
    count = np.maximum(steps[kept], 1) + 1
    runs = np.bincount(row[of[kept]], minlength=len(lists))
    xs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    nested = _nested(_nested(_nested(xs, count), np.ones(len(count), dtype=int)), runs)
    kind = pa.array(np.where(runs == 1, "LineString", "MultiLineString").astype(object), pa.string(), mask=runs == 0)
    return pa.StructArray.from_arrays([kind, pc.if_else(pa.array(runs > 0), nested, pa.scalar(None, nested.type))], ["kind", "parts"])


def _clip_batch(kind: pa.Array, parts: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    there = pc.and_(pc.is_valid(kind), pc.is_valid(parts))
    for c in (x0, y0, x1, y1):
        there = pc.and_(there, pc.is_valid(c))
    lined = pc.and_(there, pc.fill_null(pc.is_in(kind, pa.array(["LineString", "MultiLineString"])), False))
    at, rest = (np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (lined, pc.and_not(there, lined)))
    boxes = np.column_stack([c.to_numpy(zero_copy_only=False) for c in (x0, y0, x1, y1)]).astype(float)
    shapes = zip(kind.take(pa.array(rest)).to_pylist(), parts.take(pa.array(rest)).to_pylist(), boxes[rest].tolist(), strict=True)
    out = [clip_geometry(k, p, b) for k, p, b in shapes]
    done = [clip_lines(parts.take(pa.array(at)), boxes[at]).cast(ARROW_GEOM), _geometries([o and o[0] for o in out], [o and o[1] for o in out])]
    place = np.full(len(kind), -1)
    place[at], place[rest] = np.arange(len(at)), len(at) + np.arange(len(rest))
    return pa.concat_arrays(done).take(pa.array(place, mask=place < 0))


_clip = F.arrow_udf(_clip_batch, GEOM_TYPE)
#: The same for ``clipped``: a filter on its result isn't pushed below it, which would clip every row twice.
_clip_once = F.arrow_udf(_clip_batch, GEOM_TYPE).asNondeterministic()


def _sides(geom: Column, env: Column) -> list[Column]:
    return [geom["kind"], geom["parts"], *[env[side].cast("double") for side in ("xmin", "ymin", "xmax", "ymax")]]


def clip(geom, env) -> Column:
    """The part of a geometry inside a box; its kind is null where nothing is left (see ``clipped``). A null geometry or
    side of the box gives null."""
    return _clip(*_sides(_c(geom), _c(env)))


def _edge_meets(e: Column):
    """Whether a segment (struct a, b) meets a box, edges included: Liang-Barsky's test, without Python."""

    def meets(s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        sides = [(-dx, a["x"] - e["xmin"]), (dx, e["xmax"] - a["x"]), (-dy, a["y"] - e["ymin"]), (dy, e["ymax"] - a["y"])]
        enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in sides])
        leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in sides])
        beside = [(p == 0) & (q < 0) for p, q in sides]
        return ~(beside[0] | beside[1] | beside[2] | beside[3]) & (enter <= leave)

    return meets


def segments(ring: Column) -> Column:
    """Array of struct(a, b) of a line's or closed ring's neighbouring points."""
    return F.filter(F.transform(ring, lambda p, i: F.struct(F.get(ring, i - 1).alias("a"), p.alias("b"))), lambda s: s["a"].isNotNull())


def contains_point(part: Column, x: Column, y: Column) -> Column:
    """Whether a polygon (array of rings) has a point inside: a ray to the right crosses an odd number of its edges."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    count = F.aggregate(part, F.lit(0), lambda n, ring: n + F.size(F.filter(segments(ring), crossed)))
    return count % 2 == 1


def meets(geom, env) -> Column:
    """Whether a geometry meets a box, edges included, without Python. Points: one lies inside. Lines: a segment meets
    the box. Polygons: an edge does, or none does and the box lies inside (then so does any of its corners).

    The shape and the box are bound to a lambda's argument, so that both are computed once a row: an envelope's own
    expression would else be put into the test of every segment."""
    return F.exists(F.array(F.struct(_c(geom).alias("g"), _c(env).alias("e"))), lambda v: _meets(v["g"], v["e"]))


def _meets(g: Column, e: Column) -> Column:
    edge = _edge_meets(e)
    near = lambda p: p["x"].between(e["xmin"], e["xmax"]) & p["y"].between(e["ymin"], e["ymax"])
    points = F.exists(g["parts"], lambda part: F.exists(part, lambda ring: F.exists(ring, near)))
    edges = F.exists(g["parts"], lambda part: F.exists(part, lambda ring: F.exists(segments(ring), edge)))
    inside = F.exists(g["parts"], lambda part: contains_point(part, e["xmin"], e["ymin"]))
    kind = g["kind"]
    return F.when(kind.isin("Point", "MultiPoint"), points).when(kind.isin("LineString", "MultiLineString"), edges).otherwise(edges | inside)


def clipped(df, geom: str, env: Column):
    """V04 on a DataFrame: geom becomes its part inside env, rows without one are dropped; ``clipped`` says so."""
    out = df.withColumn(geom, _clip_once(*_sides(F.col(geom), env)))
    return out.where(F.col(geom)["kind"].isNotNull()).withColumn("clipped", F.lit(True))


def clip_points(df, geom: str, env: Column):
    """V04 for tables of single points only: a filter, without Python."""
    p = F.col(geom)["parts"][0][0][0]
    return df.where(p["x"].between(env["xmin"], env["xmax"]) & p["y"].between(env["ymin"], env["ymax"])).withColumn("clipped", F.lit(True))


def simplify_ring(ring: Ring, tolerance: float, closed: bool) -> Ring:
    """Douglas-Peucker. A closed ring keeps at least four points: its farthest ones if need be."""
    n = len(ring)
    if n <= (4 if closed else 2):
        return ring
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    if closed:  # a second anchor, as far from the first as can be
        far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
        keep[far] = True
        stack = [(0, far), (far, n - 1)]
    else:
        stack = [(0, n - 1)]
    spare: list[tuple[float, int]] = []
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b], ring[b] - ring[a]
        length = float(d @ d)
        t = np.clip(((p - ring[a]) @ d) / length, 0, 1) if length else np.zeros(len(p))
        gap = np.hypot(*(p - ring[a] - t[:, None] * d).T)
        at = int(gap.argmax())
        if gap[at] > tolerance:
            keep[a + 1 + at] = True
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
        else:
            spare.append((float(gap[at]), a + 1 + at))
    if closed:
        for _, i in sorted(spare, reverse=True):
            if keep.sum() >= 4:
                break
            keep[i] = True
    return ring[keep]


@F.arrow_udf(GEOM_TYPE)
def _simplify(kind: pa.Array, parts: pa.Array, tolerance: pa.Array) -> pa.Array:
    out, kinds = [], kind.to_pylist()
    for k, a, t in zip(kinds, parts.to_pylist(), tolerance.to_pylist(), strict=True):
        if k is None or a is None or t is None or np.isnan(t) or "Point" in k:
            out.append(a)
        else:
            out.append([[_rows(simplify_ring(_ring(r), round(float(t), 2), "Polygon" in k)) for r in p] for p in a])
    return _geometries(kinds, out)


def simplify(geom, tolerance) -> Column:
    """Thinner lines and rings within a tolerance (2 decimals); points, and null tolerances, change nothing."""
    g = _c(geom)
    return _simplify(g["kind"], g["parts"], _c(tolerance).cast("double"))


@F.arrow_udf(GEOM_TYPE)
def _mask(kind: pa.Array, parts: pa.Array) -> pa.Array:
    """All coordinates of the batch are masked as one array and put back in their nesting."""
    parts = parts.to_pylist()
    flat = np.array([v for a in parts if a is not None for p in a for r in p for q in r for v in (q["x"], q["y"])], dtype=float)
    values = iter((flat.view(np.int64) & ~np.int64(0xFFFFFF)).view(float).tolist())
    out = [None if a is None else [[[{"x": next(values), "y": next(values)} for _ in r] for r in p] for p in a] for a in parts]
    return _geometries(kind.to_pylist(), out)


def mask_coords(geom) -> Column:
    """Every coordinate without its three least significant bytes (26 bits of fraction stay; compresses better)."""
    return _mask(_c(geom)["kind"], _c(geom)["parts"])
