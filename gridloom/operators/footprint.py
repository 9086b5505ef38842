"""Outlines of valid areas: cells, segments, rings, and their measures.

Cells and segments are plain aggregations over pixels, spread over the cluster. Joining a raster's segments to rings is
sequential and done per raster; where the vertices within straight borders don't matter, ``rings(merge=True)`` unites runs
on the cluster first, and a task gets a segment per bend instead of one per pixel.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Corners of a cell, clockwise from the top left, with their weights in its code. Edge k joins corner k and the next.
CORNERS = ((0.0, 0.0, 8), (1.0, 0.0, 4), (1.0, 1.0, 2), (0.0, 1.0, 1))


def edge_middle(k: int) -> tuple[float, float]:
    """(x, y) of the middle of edge k, from the cell's top left corner."""
    (x0, y0, _), (x1, y1, _) = CORNERS[k], CORNERS[(k + 1) % 4]
    return (x0 + x1) / 2, (y0 + y1) / 2


def pieces(code: int) -> list[tuple[int, int]]:
    """Which edges a cell's outline joins, from the corners that are valid.

    An edge is crossed where just one of its corners is valid. Two crossed edges are joined. Four are a saddle, two valid
    corners across from each other: they are bridged, so each invalid corner is cut off by a piece between its two edges.
    """
    valid = [bool(code & w) for _, _, w in CORNERS]
    crossed = [k for k in range(4) if valid[k] != valid[(k + 1) % 4]]
    if len(crossed) < 4:
        return [(crossed[0], crossed[1])] if crossed else []
    return [tuple(sorted(((k - 1) % 4, k))) for k in range(4) if not valid[k]]


def straight(code: int) -> int:
    """The code whose one piece stands for a saddle where compatibility is asked for: both lose a valid corner's cut."""
    return {5: 6, 10: 9}.get(code, code)


def cells(mask: DataFrame, *by: str) -> DataFrame:
    """Code of every cell that touches a valid pixel, in (row, col) of the raster padded by one pixel.

    Each valid pixel adds its weight to the four cells around it; one aggregation with partial sums.
    """
    corners = F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(w).alias("w")) for dr, dc, w in ((1, 1, 8), (1, 0, 4), (0, 0, 2), (0, 1, 1))])
    return mask.where("valid").select(*by, F.inline(corners)).groupBy(*by, "row", "col").agg(F.sum("w").cast("int").alias("code"))


def segments(cell: DataFrame, compat: bool = False) -> DataFrame:
    """x0, y0, x1, y1 in pixels, from the lower edge number to the higher; ``compat`` resolves a saddle as one straight
    piece, which is lossy."""
    codes = {k: pieces(straight(k) if compat else k) for k in range(1, 15)}
    middle = [edge_middle(k) for k in range(4)]
    segment = lambda i, j: F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*middle[i], *middle[j]), strict=True)])
    by_code = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.array(*[segment(i, j) for i, j in v]))])
    keep = [c for c in cell.columns if c != "code"]
    s = cell.where("code between 1 and 14").select(*keep, F.explode(by_code[F.col("code")]).alias("e"))
    return s.select(*[c for c in keep if c not in ("row", "col")], *[(F.col("col" if n[0] == "x" else "row") + F.col(f"e.{n}")).alias(n) for n in ("x0", "y0", "x1", "y1")])


def merge_runs(segment: DataFrame, *by: str) -> DataFrame:
    """Segments with straight runs made one segment each, so long borders are few rows; diagonal ones stay as they are.

    Runs are found line by line, within a window per raster and line: a row number that grows like the position marks a run.
    """
    level, upright = segment.where("y0 = y1"), segment.where("x0 = x1")
    out = segment.where("x0 <> x1 and y0 <> y1").select(*by, "x0", "y0", "x1", "y1")
    for part, along, line in ((level, "x", "y"), (upright, "y", "x")):
        ordered = part.select(*by, F.col(f"{line}0").alias("line"), F.least(f"{along}0", f"{along}1").alias("lo"), F.greatest(f"{along}0", f"{along}1").alias("hi"))
        w = Window.partitionBy(*by, "line").orderBy("lo")
        runs = ordered.withColumn("run", F.col("lo") - F.row_number().over(w)).groupBy(*by, "line", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        place = {f"{along}0": "lo", f"{along}1": "hi", f"{line}0": "line", f"{line}1": "line"}
        out = out.unionByName(runs.select(*by, *[F.col(place[n]).alias(n) for n in ("x0", "y0", "x1", "y1")]))
    return out


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], *ring[:1]], strict=True))) / 2 if len(ring) > 2 else 0.0


def join_rings(pieces: list[tuple[float, float, float, float]], compat: bool = False) -> list[list[tuple[float, float]]]:
    """Closed rings of the segments, by area (largest first), then by number of vertices.

    Every end point has an even number of segments. A walk uses each segment once; where four meet, it turns to the one
    that came with the same cell first. ``compat`` then drops rings that agree in size and area, as two equal islands do.
    """
    around: dict[tuple[float, float], list[int]] = {}
    for i, (x0, y0, x1, y1) in enumerate(pieces):
        around.setdefault((x0, y0), []).append(i)
        around.setdefault((x1, y1), []).append(i)
    used = [False] * len(pieces)
    rings = []
    for start in sorted(around):
        for first in around[start]:
            if used[first]:
                continue
            ring, at, i = [start], start, first
            while True:
                used[i] = True
                x0, y0, x1, y1 = pieces[i]
                at = (x1, y1) if (x0, y0) == at else (x0, y0)
                if at == start:
                    break
                ring.append(at)
                i = next((k for k in around[at] if not used[k]), -1)
                if i < 0:
                    break
            if len(ring) > 2:
                rings.append(ring)
    if compat:
        seen: set[tuple[int, int]] = set()
        kept = []
        for r in rings:
            if (key := (len(r), round(area(r) * 1e6))) not in seen:
                seen.add(key)
                kept.append(r)
        rings = kept
    return sorted(rings, key=lambda r: (-area(r), len(r)))


_RINGS = "ring_id int, n_vertices int, area double, pts array<struct<x:double,y:double>>"


def rings(segment: DataFrame, by: str = "raster_id", compat: bool = False, merge: bool = False) -> DataFrame:
    """A row per ring of each raster; a raster's segments are gathered, as their chain is one sequence.

    ``merge`` unites straight runs first: the same areas, fewer vertices.
    """
    kind = dict(segment.dtypes)[by]
    segment = merge_runs(segment, by) if merge else segment

    def run(pdf):
        import pandas as pd

        pieces = list(zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"], strict=True))
        found = join_rings(sorted(pieces), compat)
        return pd.DataFrame({
            by: [pdf[by].iloc[0]] * len(found), "ring_id": range(1, len(found) + 1), "n_vertices": [len(r) for r in found], "area": [area(r) for r in found],
            "pts": [[{"x": float(x), "y": float(y)} for x, y in r] for r in found],
        })

    return segment.groupBy(by).applyInPandas(run, f"{by} {kind}, {_RINGS}")


def outer_only(ring: DataFrame, by: str = "raster_id") -> DataFrame:
    """The largest ring of each raster; of equal areas, the last."""
    w = Window.partitionBy(by).orderBy(F.desc("area"), F.desc("ring_id"))
    return ring.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def full_extent(width: Column, height: Column) -> Column:
    zero, w, h = F.lit(0.0), width.cast("double"), height.cast("double")
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])


def measures(points: DataFrame, *by: str) -> DataFrame:
    """Area, bounding box, centroid and vertex count from rows (seq, x, y) of rings without their closing point.

    The centroid is the mean of the vertices with the first counted again as the closing one.
    """
    w = Window.partitionBy(*by).orderBy("seq")
    whole = Window.partitionBy(*by)
    first = lambda c: F.min_by(c, "seq").over(whole)
    nxt = points.withColumns({
        "fx": first("x"), "fy": first("y"),
    }).withColumns({"x1": F.coalesce(F.lead("x").over(w), F.col("fx")), "y1": F.coalesce(F.lead("y").over(w), F.col("fy"))})
    n = F.count("*")
    return nxt.groupBy(*by).agg(
        n.alias("n_vertices"), (F.abs(F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y"))) / 2).alias("area"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        ((F.sum("x") + F.min("fx")) / (n + 1)).alias("centroid_x"), ((F.sum("y") + F.min("fy")) / (n + 1)).alias("centroid_y"),
    )


def ring_area(pts: Column) -> Column:
    """Area of an array of points, within the row."""
    after = F.concat(F.slice(pts, F.lit(2), F.size(pts) - 1), F.slice(pts, F.lit(1), F.lit(1)))
    return F.abs(F.aggregate(F.zip_with(pts, after, lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda s, v: s + v)) / 2


def bbox_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes (min_x, min_y, max_x, max_y) over their union; 0 where they don't meet."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    size = lambda q: (q["max_x"] - q["min_x"]) * (q["max_y"] - q["min_y"])
    union = size(a) + size(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def close(a: dict[str, Column], b: dict[str, Column], tolerance: float) -> Column:
    """Whether two rings' measures agree: area and centroid within the tolerance, boxes almost the same."""
    near = F.lit(True)
    for k in ("area", "centroid_x", "centroid_y"):
        near = near & (F.abs(a[k] - b[k]) <= tolerance)
    return near & (bbox_iou(a, b) >= 0.999)


def rings_of_geojson(text: str) -> list[list[tuple[float, float]]]:
    """All rings of a FeatureCollection, Feature or geometry (Polygon or MultiPolygon), without their closing points."""
    out: list[list[tuple[float, float]]] = []
    work = [json.loads(text)]
    while work:
        g = work.pop(0)
        if g is None:
            continue
        kind = g.get("type")
        if kind == "FeatureCollection":
            work = [f.get("geometry") for f in g["features"]] + work
        elif kind == "Feature":
            work.insert(0, g.get("geometry"))
        elif kind in ("Polygon", "MultiPolygon"):
            for polygon in g["coordinates"] if kind == "MultiPolygon" else [g["coordinates"]]:
                for ring in polygon:
                    points = [(float(p[0]), float(p[1])) for p in ring]
                    out.append(points[:-1] if len(points) > 1 and points[0] == points[-1] else points)
        else:
            raise ValueError(f"no outline: {kind}")
    return out


def hausdorff(a: Column, b: Column) -> Column:
    """Symmetric vertex-to-vertex distance of two point arrays, within the row."""

    def one(p: Column, q: Column) -> Column:
        nearest = F.transform(p, lambda u: F.array_min(F.transform(q, lambda v: F.sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)))))
        return F.array_max(nearest)

    return F.greatest(one(a, b), one(b, a))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on an open line; end points stay."""
    if tolerance <= 0 or len(points) < 3:
        return points
    keep = {0, len(points) - 1}
    work = [(0, len(points) - 1)]
    while work:
        lo, hi = work.pop()
        (ax, ay), (bx, by) = points[lo], points[hi]
        dx, dy = bx - ax, by - ay
        norm = dx * dx + dy * dy
        far, at = -1.0, -1
        for i in range(lo + 1, hi):
            px, py = points[i]
            t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / norm)) if norm else 0.0
            d = math.hypot(px - ax - t * dx, py - ay - t * dy)
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            work += [(lo, at), (at, hi)]
    return [points[i] for i in sorted(keep)]


def simplify_ring(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    return simplify([*ring, ring[0]], tolerance)[:-1] if len(ring) > 3 else ring


# Texts of a footprint.


def _closed(pts: Column) -> Column:
    return F.concat(pts, F.slice(pts, F.lit(1), F.lit(1)))


def geojson(ring: DataFrame, by: str = "raster_id", properties: tuple[str, ...] = (), epsg: int | None = None) -> DataFrame:
    """One FeatureCollection a raster: a MultiPolygon in which each ring is a polygon of its own.

    ``epsg``: the system that the points are in, null for pixels and what isn't known.
    """
    polygon = F.array(F.transform(_closed(F.col("pts")), lambda p: F.array(p.x, p.y)))
    grouped = ring.groupBy(by, *properties).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_id", polygon.alias("p")))), lambda s: s.p).alias("coordinates"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), "coordinates")
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties, F.lit(epsg).cast("int").alias("epsg")).alias("properties"))
    return grouped.select(by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")), {"ignoreNullFields": "false"}).alias("geojson"))


EMPTY_GEOJSON = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None, "properties": {"empty": True}}]})


def wkt(rings_of: Column, compat: bool = False) -> Column:
    """Text of an array of rings (arrays of points). ``compat`` leaves out the inner brackets of a single polygon."""
    text = lambda pts: F.array_join(F.transform(_closed(pts), lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", ")
    one = F.concat(F.lit("POLYGON(" if compat else "POLYGON(("), text(rings_of[0]), F.lit(")" if compat else "))"))
    many = F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(rings_of, lambda r: F.concat(F.lit("(("), text(r), F.lit("))"))), ", "), F.lit(")"))
    return F.when(F.size(rings_of) == 0, "POLYGON EMPTY").when(F.size(rings_of) == 1, one).otherwise(many)


def flat(rings_of: Column) -> Column:
    """``x y x y ...`` of all rings."""
    return F.array_join(F.flatten(F.transform(F.flatten(F.transform(rings_of, _closed)), lambda p: F.array(p.x.cast("string"), p.y.cast("string")))), " ")
