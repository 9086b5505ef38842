import io
import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import bands, cog, footprint, layout, resample, tiles, validity, windows
from gridloom.sources import sidecar, tiff


def pixels(spark, a):
    rows = [(int(r), int(c), 1, None if math.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "row long, col long, band int, value double")


def scalar_resample(a, s, method):
    """A plain loop over output pixels and taps."""
    h, w = max(1, a.shape[0] // s), max(1, a.shape[1] // s)
    out = np.full((h, w), np.nan)
    for r in range(h):
        for c in range(w):
            if method == "nearest":
                out[r, c] = a[r * s, c * s]
                continue
            if method == "average":
                block = a[r * s : (r + 1) * s, c * s : (c + 1) * s]
                out[r, c] = np.nan if np.isnan(block).all() else np.nanmean(block)
                continue
            y, x = (min(k * s + (s - 1) / 2, n - 1) for k, n in ((r, a.shape[0]), (c, a.shape[1])))
            total = weight = 0.0
            for j in (0, 1) if method == "bilinear" else (-1, 0, 1, 2):
                for i in (0, 1) if method == "bilinear" else (-1, 0, 1, 2):
                    sy, sx = min(max(int(y) + j, 0), a.shape[0] - 1), min(max(int(x) + i, 0), a.shape[1] - 1)

                    def kernel(t):
                        t = abs(t)
                        return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0

                    if method == "bilinear":
                        wt = (y - int(y) if j else 1 - (y - int(y))) * (x - int(x) if i else 1 - (x - int(x)))
                    else:
                        wt = kernel(y - sy) * kernel(x - sx)
                    if not math.isnan(a[sy, sx]):
                        total, weight = total + a[sy, sx] * wt, weight + wt
            out[r, c] = total / weight if weight else np.nan
    return out


@pytest.mark.parametrize("method", ["nearest", "average", "bilinear", "cubic"])
@pytest.mark.parametrize("scale", [2, 3, 4])
def test_resampling_against_a_plain_loop(spark, method, scale):
    a = np.random.default_rng(scale).normal(size=(13, 11))
    a[2, 3] = a[7, 7] = np.nan
    want = scalar_resample(a, scale, method)
    got = np.full(want.shape, np.nan)
    for r in resample.downsample(pixels(spark, a), scale, method, 11, 13).collect():
        got[r.row, r.col] = np.nan if r.value is None else r.value
    np.testing.assert_allclose(got, want, atol=1e-9)
    tile = cog.shrink(np.where(np.isnan(a), -1e6, a)[:, :, None], scale, method, -1e6)[:, :, 0]
    np.testing.assert_allclose(np.where(tile == -1e6, np.nan, tile), want, atol=1e-9)


def test_names_levels_and_options():
    assert resample.method_of("AVG") == "average"
    assert resample.overview_levels(2048, 100, 512) == [2, 4]
    assert resample.overview_levels(100, 100, 512) == []
    assert layout.check_options(256, "ZIP") == "deflate"
    for bad in ({"block": 100}, {"codec": "x"}, {"deflate_level": 10}, {"jpeg_quality": 0}, {"lerc_error": -1}):
        with pytest.raises(ValueError):
            layout.check_options(**bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(-2, 42), st.integers(-2, 42), st.integers(-1, 42), st.integers(-1, 42))
def test_windows_are_inside_or_refused(w, h, c, r, ww, hh):
    inside = 0 <= c < w and 0 <= r < h and ww > 0 and hh > 0 and c + ww <= w and r + hh <= h
    if inside:
        assert windows.by_pixels(w, h, c, r, ww, hh) == windows.Window(c, r, ww, hh)
    else:
        with pytest.raises(ValueError):
            windows.by_pixels(w, h, c, r, ww, hh)


def test_map_window_and_affine():
    a = windows.Affine(10.0, 0.5, 0.1, 300.0, 0.2, -0.5)
    assert a.to_pixel(*a.to_map(7, 3)) == pytest.approx((7, 3))
    north_up = windows.Affine(0.0, 1.0, 0.0, 10.0, 0.0, -1.0)
    assert windows.by_map(north_up, 10, 10, 8.5, 1.5, 2.5, 7.5) == windows.Window(2, 2, 7, 7)
    with pytest.raises(ValueError):
        windows.by_map(north_up, 10, 10, 20, 20, 30, 30)


def test_shift_georef(spark):
    row = spark.sql("select 5 as width, 5 as height, named_struct('ox', 1d, 'pw', 2d, 'skx', 0d, 'oy', 9d, 'sky', 0d, 'ph', -2d) as affine, array(2d,0d,0d,1d,0d,-2d,0d,9d) as matrix, array(named_struct('col', 3d, 'row', 2d)) as tiepoints")
    r = windows.shift_georef(row, windows.Window(2, 1, 3, 3)).first()
    assert (r.affine.ox, r.affine.oy, r.matrix[3], r.matrix[7], r.tiepoints[0].col, r.tiepoints[0].row) == (5.0, 7.0, 5.0, 7.0, 1.0, 1.0)


def mask_frame(spark, a):
    return spark.createDataFrame([("m", int(r), int(c), bool(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "raster_id string, row long, col long, valid boolean")


def trace(spark, a, **kw):
    return footprint.rings(footprint.segments(footprint.cells(mask_frame(spark, a), "raster_id"), **kw), **kw).orderBy("ring_id").collect()


def test_two_equal_islands_and_a_diagonal_pair(spark):
    a = np.zeros((8, 8), bool)
    a[1:3, 1:3] = a[5:7, 5:7] = True
    assert len(trace(spark, a)) == 2
    assert len(trace(spark, a, compat=True)) == 1
    d = np.zeros((4, 4), bool)
    d[1, 1] = d[2, 2] = True
    joined = trace(spark, d)  # a saddle is a bridge: one ring around both
    assert [r.area for r in joined] == [pytest.approx(1.5)]


def test_masked_golden_shape(spark):
    """A 64 x 48 raster with a hole: an outer ring of 224 vertices and a hole of 88."""
    y, x = np.mgrid[0:48, 0:64]
    got = trace(spark, ~((x >= 20) & (x < 44) & (y >= 14) & (y < 34)))
    assert [r.n_vertices for r in got] == [224, 88]
    xs = [p.x for p in got[0].pts]
    assert (min(xs), max(xs)) == (0.5, 64.5)


def test_sar_golden_shape(spark):
    y, x = np.mgrid[0:60, 0:80]
    got = trace(spark, ~((x < 8) | (y < 8) | (x >= 72) | (y >= 52)))
    assert [r.n_vertices for r in got] == [216]
    lon = [10 + 0.02 * p.x for p in got[0].pts]
    lat = [30 - 0.02 * p.y for p in got[0].pts]
    assert (min(lon), min(lat), max(lon), max(lat)) == pytest.approx((10.17, 28.95, 11.45, 29.83))


def test_outputs_of_a_footprint(spark):
    a = np.zeros((4, 4), bool)
    a[1:3, 1:3] = True
    ring = footprint.rings(footprint.segments(footprint.cells(mask_frame(spark, a), "raster_id")))
    g = json.loads(footprint.geojson(ring).first().geojson)
    polygon = g["features"][0]["geometry"]["coordinates"][0][0]
    assert polygon[0] == polygon[-1] and len(polygon) == ring.first().n_vertices + 1
    t = ring.groupBy("raster_id").agg(F.collect_list("pts").alias("r")).select(footprint.wkt(F.col("r")).alias("w"), footprint.wkt(F.col("r"), True).alias("c"), footprint.flat(F.col("r")).alias("f")).first()
    assert t.w.startswith("POLYGON((") and t.c.startswith("POLYGON(") and not t.c.startswith("POLYGON((")
    assert len(t.f.split()) == 2 * len(polygon)
    assert footprint.outer_only(ring).count() == 1
    assert len(footprint.simplify_ring([(0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)], 0.1)) == 4


def test_spline_golden_box():
    # Tie points of a published outline.
    ties = [(0, 0, 10, 30), (39, 0, 11, 30), (0, 29, 10, 29), (39, 29, 11, 29), (20, 15, 10.5, 29.5)]
    x, y = geo.Spline.of(ties)(np.array([0, 40, 40, 0]), np.array([0, 0, 30, 30]))
    assert (x.min(), y.min(), x.max(), y.max()) == pytest.approx((10.0, 28.9645742, 11.0263423, 30.0), abs=1e-6)
    assert geo.Spline.of(ties[:3]) is None


def test_grid_affine_and_mercator(spark):
    g = geo.Grid.of([(0, 0, 0, 10), (10, 0, 10, 10), (0, 10, 0, 0), (10, 10, 10, 0)])
    assert [float(v) for v in g(5, 5)] == [5, 5]
    assert [float(v) for v in g(-3, 20)] == [0, 0]
    assert geo.Grid.of([(0, 0, 0, 10), (10, 0, 10, 10), (0, 10, 0, 0)]) is None
    pts = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (10.0, 0.0, 1.0, 0.0), (0.0, 10.0, 0.0, -1.0), (10.0, 10.0, 1.0, -1.0)], "col double, row double, x double, y double")
    f = geo.fit_affine(pts).first()
    assert (f.ox, f.pw, f.skx, f.oy, f.sky, f.ph) == pytest.approx((0, 0.1, 0, 0, 0, -0.1))
    lon, lat, known = geo.to_lonlat(3857, 7449552.776673075, 2857827.613526296)
    assert known and (float(lon), float(lat)) == pytest.approx((66.920471191, 24.854042167), abs=1e-5)
    assert geo.to_lonlat(27700, 1, 2) == (1, 2, False)


@pytest.mark.parametrize("epsg", [32642, 32733])
def test_utm_round_trip(epsg):
    lon0 = (epsg % 100) * 6 - 183
    lon, lat = np.array([lon0 - 2.9, lon0, lon0 + 2.5]), np.array([10.0, 45.0, 71.0]) * (-1 if epsg > 32700 else 1)
    x, y, _ = geo.from_lonlat(epsg, lon, lat)
    assert x[1] == pytest.approx(500_000)
    back = geo.to_lonlat(epsg, x, y)
    np.testing.assert_allclose(back[0], lon, atol=1e-9)
    np.testing.assert_allclose(back[1], lat, atol=1e-9)
    if epsg == 32642:  # the meridian arc to 45 degrees north, scaled
        assert y[1] == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_utm_orders():
    """Both orders agree within a zone, in any shape; an order that isn't there is an error, not a system that isn't known."""
    x, y = np.meshgrid(np.linspace(100_000, 900_000, 9), np.linspace(0, 9_000_000, 10))
    for four, six in zip(geo.to_lonlat(25832, x, y, 4), geo.to_lonlat(25832, x, y)):
        np.testing.assert_allclose(four, six, atol=1e-9)
    assert float(geo.to_lonlat(32642, 500_000, 0, 4)[0]) == 69
    with pytest.raises(KeyError):
        geo.to_lonlat(32642, x, y, 5)


def test_reproject_nulls_and_other_columns(spark):
    """Null gives null and NaN stays NaN, in a system that passes through as well; other columns stay as they are."""
    rows = [("a", 500_000.0, 0.0, [1]), ("b", None, 1.0, None), ("c", math.nan, 1.0, []), (None, 2.0, None, [2])]
    df = spark.createDataFrame(rows, "`odd name` string, x double, y double, v array<int>")
    got = [tuple(r) for r in geo.reproject(df, 32642).collect()]
    assert [repr(r[:4]) for r in got] == [repr(r) for r in rows]
    assert got[0][4:] == (69.0, 0.0, True) and got[1][4:] == got[3][4:] == (None, None, True)
    assert math.isnan(got[2][4]) and math.isnan(got[2][5])
    assert [repr(tuple(r)[4:]) for r in geo.reproject(df, 4326).collect()] == ["(500000.0, 0.0, True)", "(None, 1.0, True)", "(nan, 1.0, True)", "(2.0, None, True)"]
    whole = spark.createDataFrame([(500_000, 0), (None, 1)], "x long, y long")
    assert [tuple(r)[2:] for r in geo.reproject(whole, 32642).collect()] == [(69.0, 0.0, True), (None, None, True)]
    assert geo.reproject(df.where("x < 0"), 32642).count() == 0


def test_rpc_inverse_and_terrain():
    from gridloom.plans.catalog import rpc_example

    m = geo.Rpc(rpc_example())
    lon, lat = m.inverse([100.0, 700.0], [200.0, 900.0])
    line, samp = m.forward(lat, lon, np.full(2, 200.0))
    np.testing.assert_allclose(samp, [100, 700], atol=1e-6)
    np.testing.assert_allclose(line, [200, 900], atol=1e-6)
    flat = m.on_terrain([100.0], [200.0], lambda a, b: np.full(a.shape, 200.0))
    np.testing.assert_allclose(flat[0], lon[:1], atol=1e-9)
    dem = np.add.outer(np.arange(4.0), 2 * np.arange(5.0))
    assert geo.bilinear_lookup(dem, 1.5, 2.25) == pytest.approx(5.25)
    assert np.isnan(geo.bilinear_lookup(dem, 9, 0))


def test_bands(spark):
    with pytest.raises(ValueError):
        bands.check([], 3)
    with pytest.raises(ValueError):
        bands.check([4], 3)
    p = spark.createDataFrame([(0, 0, b, float(b)) for b in (1, 2, 3)], "row long, col long, band int, value double")
    assert sorted((r.band, r.value) for r in bands.select(p, [3, 1, 3]).collect()) == [(1, 3.0), (2, 1.0), (3, 3.0)]


def test_validity_rules(spark):
    v = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.0,), (5.0,)], "v double")
    col = lambda e: [r[0] for r in v.select(e).collect()]
    assert col(validity.by_nonzero(F.col("v"))) == [False, False, False, False, True]
    assert col(validity.by_nodata(F.col("v"), float("nan"))) == [False, False, True, True, True]
    assert col(validity.by_nodata(F.col("v"), 5.0)) == [False, True, True, True, False]
    assert col(validity.by_alpha(F.col("v")))[:1] == [False]


# Files.


def make(a, options, **kw):
    out = io.BytesIO()
    cog.write(out, a, options, **kw)
    return out.getvalue()


@pytest.mark.parametrize("codec", ["none", "deflate", "lzw", "zstd"])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32", "float64"])
def test_write_and_read_again(codec, dtype):
    a = np.random.default_rng(1).integers(0, 200, (70, 90, 3)).astype(dtype)
    data = make(a, cog.Options(codec=codec, block=32), photometric="rgb", nodata="7", epsg=32642, affine=(10.0, 0.5, 0.0, 20.0, 0.0, -0.5))
    f = io.BytesIO(data)
    file = tiff.parse(f)
    base = file.images[0]
    assert file.ghost and [d.width for d in file.images] == [90, 45, 22]
    assert (base.epsg, base.nodata, base.affine) == (32642, "7", (10.0, 0.5, 0.0, 20.0, 0.0, -0.5))
    np.testing.assert_array_equal(tiff.read_window(f, base, 0, 0, 90, 70), a)
    np.testing.assert_array_equal(tiff.read_window(f, base, 5, 40, 33, 20, [3, 1]), a[40:60, 5:38, [2, 0]])
    np.testing.assert_array_equal(tiff.read_window(f, file.images[1], 0, 0, 45, 35), cog.shrink(a, 2, "average", 7.0))


def test_planar_masked_and_rotated():
    a = np.random.default_rng(2).integers(0, 3, (64, 64, 3)).astype(np.uint8)
    mask = np.where(a[:, :, :1] > 0, 255, 0).astype(np.uint8)
    data = make(a, cog.Options(block=16, planar=True), photometric="rgb", mask=mask, affine=(1.0, 2.0, 0.1, 3.0, 0.2, -2.0))
    f = io.BytesIO(data)
    file = tiff.parse(f)
    assert len(file.masks) == len(file.images) == 3
    assert file.images[0].planar and file.images[0].affine == (1.0, 2.0, 0.1, 3.0, 0.2, -2.0)
    np.testing.assert_array_equal(tiff.read_window(f, file.images[0], 0, 0, 64, 64, [2]), a[:, :, 1:2])
    np.testing.assert_array_equal(tiff.read_window(f, file.masks[0], 0, 0, 64, 64), mask)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_lzw_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_long_and_packbits():
    data = np.random.default_rng(0).integers(0, 9, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.packbits_decode(b"\x02abc\xfdz\x80\x00q") == b"abczzzzq"


def test_missing_codec_is_named():
    with pytest.raises(NotImplementedError, match="lerc"):
        tiff.decompress("lerc", b"")


def test_source_filters_and_conversion(spark, tmp_path):
    a = np.arange(64 * 80 * 3, dtype=np.uint16).reshape(64, 80, 3)
    src, dst = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    with open(src, "wb") as f:
        f.write(make(a, cog.Options(block=32, codec="lzw"), photometric="rgb", affine=(0.0, 1.0, 0.0, 64.0, 0.0, -1.0)))
    tiff.register(spark)
    df = spark.read.format("geotiff").option("path", src).load()
    got = df.where("layer = 0 and row_off >= 32").collect()
    assert len(got) == 3 and {r.row_off for r in got} == {32}
    tile = np.frombuffer(bytes(got[0].data), "<u2").reshape(32, 32, 3)
    np.testing.assert_array_equal(tile, a[32:64, got[0].col_off : got[0].col_off + 32])
    assert df.where("layer = 1").count() == 2
    row = tiff.profiles(spark.createDataFrame([(src,), (str(tmp_path / "none.tif"),)], "path string")).orderBy("error").collect()
    assert row[0].width == 80 and row[0].tiled and row[1].error
    cog.convert(src, dst, cog.Options(block=16, codec="deflate", bands=[3, 1], window=(10, 20, 40, 30)))
    with open(dst, "rb") as f:
        base = tiff.parse(f).images[0]
        np.testing.assert_array_equal(tiff.read_window(f, base, 0, 0, 40, 30), a[20:50, 10:50, [2, 0]])
        assert base.affine[:4:3] == (10.0, 44.0)


def test_batch_and_stream(spark, tmp_path):
    from gridloom.streaming import ingest

    inbox = tmp_path / "in"
    inbox.mkdir()
    for n in "ab":
        (inbox / f"{n}.tif").write_bytes(make(np.ones((20, 20, 1), np.uint8), cog.Options(block=16)))
    (inbox / "bad.tif").write_bytes(b"no image")
    out = str(tmp_path)

    def job(path, output):
        cog.convert(path, f"{out}/{output}", cog.Options(block=16))

    q = ingest.convert_arrivals(spark, str(inbox), f"{out}/cp", job, f"{out}/results")
    q.awaitTermination(120)
    counts = {r.status: r.n for r in layout.batch_counts(spark.read.parquet(f"{out}/results")).collect()}
    assert counts == {"ok": 2, "failed": 1}


def test_sidecars(spark):
    w = spark.createDataFrame([("10\n0\n0\n-10\n300005\n2600035\n",)], "t string").select(sidecar.world_file(F.col("t")).alias("a")).first().a
    assert (w.ox, w.pw, w.oy, w.ph) == (300000.0, 10.0, 2600040.0, -10.0)
    xml = '<gml:RectifiedGrid srsName="urn:ogc:def:crs:EPSG::32642"><gml:origin><gml:Point><gml:pos>300005 2600035</gml:pos></gml:Point></gml:origin><gml:offsetVector>10 0</gml:offsetVector><gml:offsetVector>0 -10</gml:offsetVector></gml:RectifiedGrid>'
    g = spark.createDataFrame([(xml,)], "t string").select(sidecar.gml_georef(F.col("t")).alias("g")).first().g
    assert (g.epsg, g.affine.ox, g.affine.oy, g.affine.pw, g.affine.ph) == (32642, 300000.0, 2600040.0, 10.0, -10.0)
    names = spark.createDataFrame([("a.TIF", b"II*\0"), ("b.bin", b"\0\0\0\x0cjP  \r\n\x87\n"), ("http://x/c.jp2?k=1", b"")], "path string, content binary")
    assert [r[0] for r in names.select(sidecar.sniff(F.col("content"), F.col("path"))).collect()] == ["GTiff", "JP2OpenJPEG", "JP2OpenJPEG"]


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_jp2_header_without_a_codec(spark):
    siz = struct.pack(">HHIIIIIIIIH", 47, 0, 120, 80, 0, 0, 120, 80, 0, 0, 3) + bytes([7, 1, 1] * 3)
    code = b"\xff\x4f\xff\x51" + siz
    data = box(b"jP  ", b"\r\n\x87\n") + box(b"jp2h", box(b"colr", b"\x01\0\0" + struct.pack(">I", 16))) + box(b"asoc", box(b"xml ", b"<a/>")) + box(b"jp2c", code)
    h = sidecar.jp2_header(data)
    assert (h["width"], h["height"], h["bands"], h["bits"], h["photometric"]) == (120, 80, 3, 8, "rgb")
    assert sidecar.jp2_xml(data) == "<a/>"
    rows = sidecar.read_headers(spark.createDataFrame([("x.jp2", data), ("y.jp2", b"12345678")], "path string, content binary")).orderBy("path").collect()
    assert rows[0].width == 120 and rows[1].error


def test_tile_grid_and_pad(spark):
    g = tiles.grid(spark, 10, 7, 4).collect()
    assert len(g) == 6 and g[-1].cols == 2 and g[-1].rows == 3
    p = spark.createDataFrame([(r, c, 1, 1.0) for r in range(7) for c in range(10)], "row long, col long, band int, value double")
    assert tiles.pad(p, 10, 7, 4).count() == 12 * 8


def test_reports(spark):
    from gridloom.sources import rasters

    c, lv = rasters.catalog(spark), rasters.levels(spark)
    text = {r.raster_id: r.report for r in layout.info_text(layout.info(c, lv)).collect()}
    assert "Overview 2: 512 x 512" in text["good_cog"]
    found = layout.issues(c, lv)
    report = {r.raster_id: r.report for r in layout.validation_text(c, found).collect()}
    assert "no overviews" in report["no_georef"] and report["no_georef"].startswith("COG validation: FAILED\nFile: no_georef\n  [ERROR] ")
    assert report["good_cog"].startswith("COG validation: PASSED")
    assert {r.raster_id for r in layout.verdicts(c, found).collect() if r.valid} >= {"good_cog", "masked"}


@pytest.mark.parametrize("planar", [False, True])
def test_aligned_blocks_are_copied_not_coded(tmp_path, monkeypatch, planar):
    a = np.random.default_rng(8).integers(0, 99, (70, 64, 3)).astype(np.uint8)
    src, dst = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    with open(src, "wb") as f:
        f.write(make(a, cog.Options(block=16, planar=planar), photometric="rgb"))
    coded = []
    real = tiff.compress
    monkeypatch.setattr(tiff, "compress", lambda codec, data, level=6: coded.append(1) or real(codec, data, level))

    def run(**kw):
        coded.clear()
        cog.convert(src, dst, cog.Options(block=16, planar=planar, overviews=[], **kw))
        with open(dst, "rb") as f:
            base = tiff.parse(f).images[0]
            return len(coded), tiff.read_window(f, base, 0, 0, base.width, base.height)

    planes = 3 if planar else 1
    n, got = run()
    assert n == 4 * planes  # only the ragged lowest row of blocks
    np.testing.assert_array_equal(got, a)
    n, got = run(window=(16, 32, 32, 32))
    assert n == 0
    np.testing.assert_array_equal(got, a[32:64, 16:48])
    n, got = run(window=(8, 32, 32, 32))
    assert n == 4 * planes
    np.testing.assert_array_equal(got, a[32:64, 8:40])
    n, got = run(bands=[3, 1], window=(0, 0, 32, 32))
    assert n == (0 if planar else 4)
    np.testing.assert_array_equal(got, a[:32, :32, [2, 0]])


def layers_of(path):
    with open(path, "rb") as f:
        file = tiff.parse(f)
        return [tiff.read_window(f, d, 0, 0, d.width, d.height) for d in file.images], [tiff.read_window(f, d, 0, 0, d.width, d.height) for d in file.masks]


def marked(tmp_path, size=(70, 90), codec="deflate", block=16):
    """A file whose overviews and mask overviews are no shrunken base, so that a copy can be told from a new one."""
    rng = np.random.default_rng(9)
    options = cog.Options(block=block, codec=codec)
    scratch = cog.Scratch()
    a = rng.integers(0, 200, (*size, 3)).astype(np.uint8)
    small = {s: rng.integers(0, 200, (size[0] // s, size[1] // s, 3)).astype(np.uint8) for s in (2, 4)}
    mask = {s: np.where(rng.random((size[0] // s, size[1] // s, 1)) > 0.4, 255, 0).astype(np.uint8) for s in (1, 2, 4)}
    made = cog.encode_all(cog.Pixels(a), cog.Pixels(mask[1]), options, scratch, None, [2, 4], lambda s: cog.Pixels(small[s]), lambda s: cog.Pixels(mask[s]))
    path = str(tmp_path / f"marked-{codec}.tif")
    with open(path, "wb") as f:
        cog.join(f, made, scratch, photometric="rgb", affine=(0.0, 1.0, 0.0, 0.0, 0.0, -1.0))
    return path, a, small, mask


@pytest.mark.parametrize("codec", ["deflate", "lzw"])
def test_overviews_and_masks_of_the_source_are_kept(tmp_path, codec):
    """Copied blocks and blocks coded anew alike: every layer comes out as it went in."""
    path, a, small, mask = marked(tmp_path, codec=codec)
    out = str(tmp_path / "out.tif")
    cog.convert(path, out, cog.Options(block=16))
    images, masks = layers_of(out)
    for got, want in zip(images + masks, [a, small[2], small[4], mask[1], mask[2], mask[4]], strict=True):
        np.testing.assert_array_equal(got, want)
    cog.convert(path, out, cog.Options(block=16, fresh=True))
    images, masks = layers_of(out)
    np.testing.assert_array_equal(images[1], cog.shrink(a, 2, "average"))
    np.testing.assert_array_equal(masks[1], mask[1][::2, ::2][:35, :45])


def test_a_remux_codes_only_ragged_edges(tmp_path, monkeypatch):
    path, *_ = marked(tmp_path, size=(64, 64))
    coded = []
    real = tiff.compress
    monkeypatch.setattr(tiff, "compress", lambda codec, data, level=6: coded.append(1) or real(codec, data, level))
    cog.convert(path, str(tmp_path / "same.tif"), cog.Options(block=16))
    assert not coded


def test_a_crop_takes_overviews_where_its_window_fits(tmp_path):
    path, a, small, mask = marked(tmp_path)
    out = str(tmp_path / "out.tif")
    cog.convert(path, out, cog.Options(block=16, window=(8, 12, 40, 36)))
    images, masks = layers_of(out)
    np.testing.assert_array_equal(images[0], a[12:48, 8:48])
    np.testing.assert_array_equal(images[1], small[2][6:24, 4:24])
    np.testing.assert_array_equal(images[2], small[4][3:12, 2:12])
    np.testing.assert_array_equal(masks[1], mask[2][6:24, 4:24])
    cog.convert(path, out, cog.Options(block=16, window=(7, 12, 40, 36)))
    images, masks = layers_of(out)
    np.testing.assert_array_equal(images[1], cog.shrink(a[12:48, 7:47], 2, "average"))
    np.testing.assert_array_equal(masks[1], mask[1][12:48, 7:47][::2, ::2])


@pytest.mark.parametrize("method", ["nearest", "average", "bilinear", "cubic"])
@pytest.mark.parametrize("scales", [[2, 4, 8], [3, 5]])
def test_overviews_made_by_windows_are_those_of_whole_images(method, scales, monkeypatch):
    monkeypatch.setattr(cog, "SAMPLES", 1)  # a block at a time
    a = np.random.default_rng(3).integers(0, 4000, (75, 101, 2)).astype(np.uint16)
    file = tiff.parse(f := io.BytesIO(make(a, cog.Options(block=16, overviews=scales, resampling=method), nodata="0")))
    level, before = a, 1
    for s, d in zip(scales, file.images[1:], strict=True):
        level, before = (cog.shrink(level, 2, method, 0.0) if s == 2 * before else cog.shrink(a, s, method, 0.0)), s
        np.testing.assert_array_equal(tiff.read_window(f, d, 0, 0, d.width, d.height), level)


def test_files_from_a_table_of_tiles(spark, tmp_path):
    """Ragged edges, two rasters of one base name, a missing tile, repeated runs, an empty table."""
    a = {"x/a.tif": np.random.default_rng(1).normal(size=(40, 52, 2)), "y/a.tif": np.arange(20 * 16, dtype=float).reshape(20, 16, 1).repeat(2, axis=2)}
    rows = [
        (k, r, c, min(16, v.shape[0] - r), min(16, v.shape[1] - c), 2, "float64", v[r : r + 16, c : c + 16].tobytes())
        for k, v in a.items() for r in range(0, v.shape[0], 16) for c in range(0, v.shape[1], 16)
    ]
    schema = "raster_id string, row_off int, col_off int, rows int, cols int, bands int, dtype string, data binary"
    rows += [("gap", 0, 0, 16, 16, 1, "uint8", bytes(256)), ("gap", 16, 16, 16, 16, 1, "uint8", bytes(256)), (None, 0, 0, 1, 1, 1, "uint8", b"1")]
    table = spark.createDataFrame(rows, schema).repartition(3)
    for _ in range(2):
        made = {r.raster_id: r for r in cog.write_tiles(table, str(tmp_path / "out"), cog.Options(block=16)).collect()}
    assert set(made) == {*a, "gap"} and made["gap"].error and made["gap"].path is None
    for k, v in a.items():
        images, _ = layers_of(made[k].path)
        np.testing.assert_array_equal(images[0], v)
        assert (made[k].width, made[k].height) == v.shape[1::-1]
        if len(images) > 1:
            np.testing.assert_allclose(images[1], cog.shrink(v, 2, "average"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(made[k].path.rsplit("/", 1)[-1] for k in a)
    assert cog.write_tiles(table.where("false"), str(tmp_path / "none"), cog.Options(block=16)).count() == 0


def test_an_interrupted_conversion_leaves_no_file(spark, tmp_path, monkeypatch):
    """A conversion that dies half way leaves nothing under the output's name, and the next batch makes it whole."""
    from gridloom import api

    path, a, *_ = marked(tmp_path)
    folder = tmp_path / "out"
    folder.mkdir()
    target = str(folder / "marked-deflate.tif")
    monkeypatch.setattr(cog, "join", lambda out, *a, **k: out.write(b"II*") and (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        cog.convert(path, target, cog.Options(block=16))
    monkeypatch.undo()
    (folder / "other.tif.123.part").write_bytes(b"left by a lost executor")
    assert [p.name for p in folder.iterdir()] == ["other.tif.123.part"]
    paths = spark.createDataFrame([(path,)], "path string")
    assert [r.status for r in api.batch(spark, paths, str(folder), options=cog.Options(block=16)).collect()] == ["ok"]
    np.testing.assert_array_equal(layers_of(target)[0][0], a)
    assert [r.status for r in api.batch(spark, paths, str(folder), options=cog.Options(block=16)).collect()] == ["skipped"]


def test_the_source_lists_masks_and_many_files(spark, tmp_path, monkeypatch):
    path, a, small, mask = marked(tmp_path)
    tiff.register(spark)
    kinds = {(r.layer, r.kind) for r in spark.read.format("geotiff").option("path", path).load().collect()}
    assert kinds == {(0, "image"), (1, "overview"), (2, "overview"), (3, "mask"), (4, "mask"), (5, "mask")}
    import shutil

    paths = []
    for i in range(tiff.GeoTiffReader.LISTED + 3):  # more than the driver reads itself
        (tmp_path / f"d{i}").mkdir()
        paths.append(str(tmp_path / f"d{i}" / "a.tif"))
        shutil.copy(path, paths[-1])
    df = spark.read.format("geotiff").option("paths", ",".join(paths)).load()
    assert df.where("layer = 5").select("raster_id").distinct().count() == len(paths)


def test_merged_runs_give_the_same_areas(spark):
    rng = np.random.default_rng(4)
    a = np.kron(rng.random((5, 6)) > 0.4, np.ones((4, 4))).astype(bool)
    segment = footprint.segments(footprint.cells(mask_frame(spark, a), "raster_id"))
    plain, merged = (footprint.rings(segment, merge=m).orderBy("ring_id").collect() for m in (False, True))
    assert sorted(r.area for r in plain) == sorted(r.area for r in merged)
    assert sum(r.n_vertices for r in merged) < sum(r.n_vertices for r in plain) / 1.5


@pytest.mark.parametrize("code", range(16))
def test_pieces_of_a_cell(code):
    """Each crossed edge is met once, and no piece passes between two valid corners."""
    valid = [bool(code & w) for _, _, w in footprint.CORNERS]
    crossed = [k for k in range(4) if valid[k] != valid[(k + 1) % 4]]
    assert sorted(e for p in footprint.pieces(code) for e in p) == crossed
    if len(crossed) == 4:  # the cut corners are those that aren't valid
        corner = {(0, 3): 0, (0, 1): 1, (1, 2): 2, (2, 3): 3}
        assert not any(valid[corner[p]] for p in footprint.pieces(code))


def test_rings_of_geojson_and_their_measures():
    from gridloom import api

    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    for g in ({"type": "Polygon", "coordinates": [square]}, {"type": "MultiPolygon", "coordinates": [[square]]}):
        for text in (json.dumps(g), json.dumps({"type": "Feature", "geometry": g}), json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g}]})):
            m = api.metrics_of_geojson(text)
            assert (m["n_vertices"], m["area"], m["max_x"]) == (4, 16.0, 4.0)
    assert api.metrics_of_geojson(footprint.EMPTY_GEOJSON) is None


def smooth(h, w, bands):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([128 + 60 * np.sin(x / (9 + i)) + 50 * np.cos(y / (7 + 2 * i)) for i in range(bands)], axis=2).astype(np.uint8)


def jvm_image(spark, data):
    """What the JVM's own codec makes of a JPEG stream: (rows, cols, bands)."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    h, w = image.getHeight(), image.getWidth()
    rgb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), dtype=np.int64).reshape(h, w)
    return np.stack([rgb >> s & 255 for s in (16, 8, 0)], axis=2).astype(np.uint8)


def test_jpeg_against_another_codec(spark):
    """Streams made here are read by the JVM's codec, and its streams, with colours at half size, are read here."""
    from gridloom.sources import jpeg

    a = smooth(61, 83, 3)
    made = jpeg.encode(a, 92, True)
    theirs = jvm_image(spark, made)
    ours = jpeg.to_rgb(jpeg.decode(made))
    assert np.abs(theirs.astype(int) - ours).max() <= 3 and np.abs(ours.astype(int) - a).mean() < 2
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(83, 61, 1)
    packed = (a[:, :, 0].astype(int) << 16 | a[:, :, 1].astype(int) << 8 | a[:, :, 2]).ravel().tolist()
    for i, v in enumerate(packed):
        image.setRGB(i % 83, i // 83, v)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    assert np.abs(jpeg.to_rgb(jpeg.decode(data)).astype(int) - jvm_image(spark, data)).mean() < 2.5


@pytest.mark.parametrize("bands, planar", [(1, False), (3, False), (4, False), (6, True)])
def test_jpeg_files(tmp_path, bands, planar):
    a, mask = smooth(50, 70, bands), np.where(smooth(50, 70, 1) > 100, 255, 0).astype(np.uint8)
    data = make(a, cog.Options(codec="jpeg", block=16, quality=95, planar=planar), photometric="rgb" if bands == 3 else "minisblack", mask=mask)
    file = tiff.parse(f := io.BytesIO(data))
    got = tiff.read_window(f, file.images[0], 0, 0, 70, 50)
    assert np.abs(got.astype(int) - a).mean() < 2.5 and got.dtype == np.uint8
    assert np.abs(tiff.read_window(f, file.images[1], 0, 0, 35, 25).astype(int) - cog.shrink(a, 2, "average")).mean() < 3
    np.testing.assert_array_equal(tiff.read_window(f, file.masks[0], 0, 0, 70, 50), mask)
    path, out = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    with open(path, "wb") as g:
        g.write(data)
    cog.convert(path, out, cog.Options(block=16, codec="deflate"))
    images, masks = layers_of(out)
    np.testing.assert_array_equal(images[0], got)
    np.testing.assert_array_equal(masks[0], mask)
    cog.convert(path, out, cog.Options(block=16, codec="jpeg", quality=95, planar=planar))  # whole blocks are copied, not coded again
    np.testing.assert_array_equal(layers_of(out)[0][0][:48, :64], got[:48, :64])


def test_jpeg_refuses_what_it_cannot_hold():
    with pytest.raises(ValueError, match="8 bits"):
        make(np.zeros((20, 20, 1), np.uint16), cog.Options(codec="jpeg", block=16))
    with pytest.raises(ValueError, match="quality"):
        make(np.zeros((20, 20, 1), np.uint8), cog.Options(codec="jpeg", block=16, quality=0))


def test_projections_against_published_examples():
    """Worked examples of Snyder's manual and of the EPSG guidance notes."""
    from gridloom.functions import projections as pr

    clarke = (6_378_206.4, 1 / 294.978698214)
    near = lambda got, want, tol: np.testing.assert_allclose(got, want, atol=tol)
    near(pr.LambertConic(lon0=-96, lat0=23, lat1=33, lat2=45, body=clarke).forward(-75, 35), (1_894_410.9, 1_564_649.5), 0.1)
    near(pr.AlbersConic(lon0=-96, lat0=23, lat1=29.5, lat2=45.5, body=clarke).forward(-75, 35), (1_885_472.7, 1_535_925.0), 0.1)
    near(pr.PolarStereographic(lon0=70, lat0=-90, lat1=-71, east=6e6, north=6e6).forward(120, -75), (7_255_380.79, 7_053_389.56), 0.01)
    near(pr.by_epsg(3035).forward(5, 50), (3_962_799.45, 2_999_718.85), 0.01)


@pytest.mark.parametrize("epsg", [2154, 3031, 3034, 3035, 3413, 3976, 3995, 5070, 25832, 26917, 32733, 3857, 4258])
def test_projections_there_and_back(epsg):
    rng = np.random.default_rng(epsg)
    lat0, lon0 = {2154: (46, 3), 3031: (-80, 0), 3976: (-75, 100), 3413: (75, -45), 3995: (80, 170), 5070: (38, -96), 26917: (40, -81), 32733: (-20, 15)}.get(epsg, (52, 9))
    lat, lon = lat0 + rng.uniform(-6, 6, 50), (lon0 + rng.uniform(-4, 4, 50) + 180) % 360 - 180
    x, y, known = geo.from_lonlat(epsg, lon, lat)
    back = geo.to_lonlat(epsg, x, y)
    assert known and back[2]
    np.testing.assert_allclose(back[0], lon, atol=1e-9)
    np.testing.assert_allclose(back[1], lat, atol=1e-9)


def test_rules_of_files_and_of_catalogues_agree(spark, tmp_path):
    """The whole-file functions and the operators over a catalogue find the same in the same files."""
    from gridloom import api

    rng = np.random.default_rng(0)
    a = rng.integers(0, 9, (70, 90, 3)).astype(np.uint8)
    files = {
        "good": make(a, cog.Options(block=16), photometric="rgb", affine=(0.0, 1.0, 0.0, 0.0, 0.0, -1.0)), "bare": make(a, cog.Options(block=48, overviews=[], codec="lzw"), photometric="rgb"),
        "masked": make(a, cog.Options(block=16), photometric="rgb", mask=np.where(a[:, :, :1] > 2, 255, 0).astype(np.uint8)), "nodata": make(a[:, :, :1], cog.Options(block=16), nodata="3"),
        "grey": make(a[:, :, :1], cog.Options(block=32)), "alpha": make(np.concatenate([a, a[:, :, :1]], axis=2), cog.Options(block=16), photometric="rgb", extra=["unassociatedalpha"]),
        "not_smaller": make(a, cog.Options(block=16, overviews=[1, 2]), photometric="rgb"),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
    paths = [str(tmp_path / f"{n}.tif") for n in files]
    c, lv = layout.of_profiles(tiff.profiles(spark.createDataFrame([(p,) for p in paths], "path string")))
    found = {}
    for r in layout.issues(c, lv).collect():
        found.setdefault(r.raster_id, []).append((r.level, r.message))
    for p in paths:
        assert sorted(found.get(p, [])) == sorted(api.validate(p)), p
    has = validity.match_masks(c, lv).select("raster_id", "has_mask")
    for black in (False, True):
        kinds = {r.raster_id: r.validity for r in validity.choose(c.join(has, "raster_id"), black_rgb=black).collect()}
        for p in paths:
            assert kinds[p] == api.footprint(p, api.FootprintOptions(black_rgb=black))["validity"], p
