import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from gridloom import api, cli
from gridloom.operators import cog
from gridloom.sources import tiff

PLACE = (-1.0, 0.01, 0.0, 1.0, 0.0, -0.01)


@pytest.fixture
def files(tmp_path):
    def put(name, a, **kw):
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            cog.write(f, a, cog.Options(block=16), **kw)
        return path

    y, x = np.mgrid[0:48, 0:64]
    rgba = np.full((48, 64, 4), 200, np.uint8)
    rgba[:, :, 3] = np.where((x >= 20) & (x < 44) & (y >= 14) & (y < 34), 0, 255)
    sy, sx = np.mgrid[0:60, 0:80]
    sar = np.where((sx < 8) | (sy < 8) | (sx >= 72) | (sy >= 52), 0, 1200 + (sx + sy) % 50).astype(np.uint16)[:, :, None]
    # Tie points of a published outline, whose box and rings the tests below expect.
    ties = [(0, 0, 0, 10, 30, 0), (39, 0, 0, 11, 30, 0), (0, 29, 0, 10, 29, 0), (39, 29, 0, 11, 29, 0), (20, 15, 0, 10.5, 29.5, 0)]
    return {
        "full": put("full.tif", np.full((48, 64, 3), (180, 90, 30), np.uint8), photometric="rgb", epsg=4326, affine=PLACE),
        "rgba": put("rgba.tif", rgba, photometric="rgb", extra=["associatedalpha"], epsg=4326, affine=PLACE),
        "sar": put("sar.tif", sar, epsg=4326, affine=(10.0, 0.02, 0.0, 30.0, 0.0, -0.02)),
        "gcp": put("gcp.tif", np.full((30, 40, 1), 200, np.uint8), tiepoints=[tuple(map(float, t)) for t in ties]),
        "dir": str(tmp_path),
    }


def test_golden_footprints(files):
    r = api.footprint(files["full"])
    assert (r["ring_count"], r["vertex_count"], r["validity"], r["georef"]) == (1, 4, "full", "affine")
    m = api.ring_metrics(r["rings"][0])
    assert (m["min_x"], m["min_y"], m["max_x"], m["max_y"]) == pytest.approx((-1, 0.52, -0.36, 1))
    r = api.footprint(files["rgba"])
    assert [len(x) for x in r["rings"]] == [224, 88] and r["validity"] == "alpha"
    m = api.ring_metrics(r["rings"][0])
    assert (m["min_x"], m["min_y"], m["max_x"], m["max_y"]) == pytest.approx((-0.995, 0.515, -0.355, 0.995))
    r = api.footprint(files["sar"])
    assert [len(x) for x in r["rings"]] == [216] and r["validity"] == "nonzero"
    r = api.footprint(files["gcp"], api.FootprintOptions(source="full"))
    m = api.ring_metrics(r["rings"][0])
    assert r["georef"] == "gcp_tps" and (m["min_x"], m["min_y"], m["max_x"], m["max_y"]) == pytest.approx((10.0, 28.9645742, 11.0263423, 30.0), abs=1e-6)


def test_footprint_choices(files):
    body = json.loads(api.footprint(files["rgba"])["body"])
    assert body["features"][0]["properties"]["validity_source"] == "alpha" and len(body["features"][0]["geometry"]["coordinates"]) == 2
    assert api.footprint(files["rgba"], api.FootprintOptions(outer_only=True))["ring_count"] == 1
    assert api.footprint(files["rgba"], api.FootprintOptions(format="wkt"))["body"].startswith("MULTIPOLYGON(((")
    assert api.footprint(files["full"], api.FootprintOptions(format="wkt", compat=True))["body"].startswith("POLYGON(-1.0 ")
    assert api.footprint(files["sar"], api.FootprintOptions(threshold=1e9))["body"].count("null") >= 1
    part = api.footprint(files["rgba"], api.FootprintOptions(window=(50, 0, 10, 10), georef="pixel"))
    assert part["rings"] == [[(50.0, 0.0), (60.0, 0.0), (60.0, 10.0), (50.0, 10.0)]]
    assert api.footprint(files["rgba"], api.FootprintOptions(simplify_degrees=0.02))["vertex_count"] < 40
    with pytest.raises(ValueError):
        api.footprint(files["full"], api.FootprintOptions(source="nodata"))
    with pytest.raises(ValueError):
        api.footprint(files["full"], api.FootprintOptions(georef="rpc"))


def test_validate_and_crop(files, tmp_path):
    assert api.is_valid(files["full"]) and api.validate(files["full"]) == []
    flat = str(tmp_path / "flat.tif")
    api.convert(files["full"], flat, cog.Options(block=48, overviews=[]))
    assert ("error", "no overviews") in api.validate(flat) and ("warning", "tile size 48x48 is not a power of two") in api.validate(flat)
    out = str(tmp_path / "crop.tif")
    api.crop(files["rgba"], out, coordinates=(-0.895, 0.895, -0.705, 0.705), options=cog.Options(block=16))
    p = api.info(out)
    assert (p["width"], p["height"], p["affine"]["ox"], len(p["mask_ifds"])) == (20, 20, pytest.approx(-0.9), 2)
    with pytest.raises(ValueError):
        api.crop(files["rgba"], out, pixels=(60, 0, 10, 10))
    api.select_bands(files["rgba"], out, [3, 1], cog.Options(block=16))
    assert api.info(out)["bands"] == 2 and api.info(out)["extra_samples"] == []


def test_command_line(files, tmp_path, capsys):
    assert cli.main(["info", files["full"]]) == 0 and '"width": 64' in capsys.readouterr().out
    assert cli.main(["validate", files["full"]]) == 0
    assert cli.main(["cog", files["full"], str(tmp_path / "o.tif"), "-b", "16", "--no-overviews", "--json"]) == 0
    assert cli.main(["validate", str(tmp_path / "o.tif")]) == 1
    assert cli.main(["crop", files["full"], str(tmp_path / "c.tif"), "--srcwin", "1", "2", "30", "20", "-b", "16"]) == 0
    assert cli.main(["band", files["full"], str(tmp_path / "b.tif"), "-B", "3", "-B", "1", "-b", "16"]) == 0
    capsys.readouterr()
    assert cli.main(["footprint", files["sar"], "--format", "flat"]) == 0 and len(capsys.readouterr().out.split()) == 2 * 217


def test_batches(spark, files, tmp_path):
    paths = spark.createDataFrame([(files[k],) for k in ("full", "rgba", "sar")] + [(files["dir"] + "/none.tif",), ("notes.txt",)], "path string")
    out = str(tmp_path / "out")
    first = {r.path.rsplit("/")[-1]: r for r in api.batch(spark, paths, out, "footprint", api.FootprintOptions()).collect()}
    assert {k: r.status for k, r in first.items()} == {"full.tif": "ok", "rgba.tif": "ok", "sar.tif": "ok", "none.tif": "failed"} and first["none.tif"].error
    assert {r.status for r in api.batch(spark, paths.where("path like '%full%'"), out, "footprint", api.FootprintOptions()).collect()} == {"skipped"}


def test_http_ranges(files):
    with open(files["rgba"], "rb") as f:
        data = f.read()

    class Handler(BaseHTTPRequestHandler):
        ranged = True

        def do_GET(self):
            lo, hi = self.headers["Range"].removeprefix("bytes=").split("-")
            body = data[int(lo) : int(hi) + 1 if hi else None] if self.ranged else data
            self.send_response(206 if self.ranged else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/rgba.tif"
    for ranged in (True, False):
        Handler.ranged = ranged
        with tiff.open_file(url) as f:
            base = tiff.parse(f).images[0]
            assert tiff.read_window(f, base, 0, 0, 64, 48).shape == (48, 64, 4)
        assert api.info(url)["width"] == 64
    server.shutdown()
