"""JPEG 2000: the decoder against a published vector and images coded in tests, and conversion, masks and footprints of such files."""

import jp2
import numpy as np
import pytest

from gridloom.sources import jpeg2000 as j2


def picture(h, w, bands=1, top=255, dtype=np.uint8, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    a = np.stack([np.sin(x / (5 + i)) + np.cos(y / (7 + i)) + rng.normal(scale=0.1, size=(h, w)) for i in range(bands)], axis=2)
    low = -top - 1 if np.dtype(dtype).kind == "i" else 0
    return np.clip((a + 2.3) / 4.6 * (top - low) + low, low, top).astype(dtype)


def test_published_vector():
    """The standard's test sequence of the arithmetic coder."""
    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    coder = j2.Arithmetic(coded, [0], [0])
    bits = "".join(str(coder.bit(0)) for _ in range(256))
    assert int(bits, 2) == int("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF", 16)


@pytest.mark.parametrize("kw", [
    {}, {"levels": 0}, {"levels": 5}, {"tile": 24}, {"tile": 17, "levels": 2}, {"precinct": 4, "levels": 2}, {"precinct": 5, "tile": 40, "progression": 2}, {"progression": 1}, {"precinct": 4, "progression": 3},
    {"progression": 4, "precinct": 4}, {"origin": (3, 5), "tile": 21}, {"block_size": 3, "boxes": False},
])
@pytest.mark.parametrize("bands", [1, 3])
def test_lossless_images_come_back(kw, bands):
    a = picture(45, 61, bands)
    image = j2.Image(jp2.encode(a, colours=bands == 3, **kw))
    assert (image.width, image.height, image.components, image.bits) == (61, 45, bands, 8)
    np.testing.assert_array_equal(image.read(0, 0, 61, 45), a)
    np.testing.assert_array_equal(image.read(13, 7, 20, 31), a[7:38, 13:33])


@pytest.mark.parametrize("bits, dtype", [(12, np.uint16), (16, np.uint16), (12, np.int16), (8, np.int8)])
def test_depths_and_signs(bits, dtype):
    a = picture(30, 33, 1, (1 << (bits - (np.dtype(dtype).kind == "i"))) - 1, dtype)
    image = j2.Image(jp2.encode(a, bits=bits))
    got = image.read(0, 0, 33, 30)
    assert got.dtype == dtype
    np.testing.assert_array_equal(got, a)


@pytest.mark.parametrize("kw", [{}, {"tile": 32}, {"origin": (5, 2), "levels": 2}])
@pytest.mark.parametrize("bands", [1, 3])
def test_lossy_images_come_close(kw, bands):
    a = picture(50, 47, bands)
    got = j2.Image(jp2.encode(a, reversible=False, colours=bands == 3, **kw)).read(0, 0, 47, 50)
    assert np.abs(got.astype(int) - a).max() <= 1


def test_windows_decode_only_their_blocks(monkeypatch):
    a = picture(128, 128)
    image = j2.Image(jp2.encode(a, levels=3))
    decoded = []
    real = j2.decode_block
    monkeypatch.setattr(j2, "decode_block", lambda *x: decoded.append(1) or real(*x))
    np.testing.assert_array_equal(image.read(0, 0, 128, 128), a)
    every = len(decoded)
    decoded.clear()
    np.testing.assert_array_equal(image.read(64, 32, 16, 16), a[32:48, 64:80])
    assert 0 < len(decoded) < every / 2


def test_reduced_images_are_the_lowest_bands():
    a = picture(64, 80)
    image = j2.Image(jp2.encode(a, levels=3))
    flat = j2.Image(jp2.encode(np.full((33, 41, 1), 77, np.uint8), levels=3))
    for reduce in (1, 2, 3):
        w, h = image.size(reduce)
        got = image.read(0, 0, w, h, reduce)
        low = a[:, :, 0].astype(int) - 128
        for k in range(reduce):
            low = jp2._analyse(jp2._analyse(low, 0, True).T, 0, True).T[::2, ::2]
        np.testing.assert_array_equal(got[:, :, 0], np.clip(low + 128, 0, 255))
        np.testing.assert_array_equal(image.read(3, 2, 4, 5, reduce), got[2:7, 3:7])
        assert (flat.read(0, 0, *flat.size(reduce), reduce) == 77).all()


def test_what_is_not_supported_is_named():
    data = bytearray(jp2.encode(picture(8, 8), levels=1, boxes=False))
    at = data.index(b"\xff\x52")
    data[at + 12] = 1
    with pytest.raises(NotImplementedError, match="bypass"):
        j2.Image(bytes(data)).read(0, 0, 8, 8)
    with pytest.raises(ValueError, match="code stream"):
        j2.Image(b"no image")


def box(kind, body):
    import struct

    return struct.pack(">I4s", 8 + len(body), kind) + body


GML = '<gml:RectifiedGrid srsName="urn:ogc:def:crs:EPSG::32642"><gml:origin><gml:Point><gml:pos>300005 2599995</gml:pos></gml:Point></gml:origin><gml:offsetVector>10 0</gml:offsetVector><gml:offsetVector>0 -10</gml:offsetVector></gml:RectifiedGrid>'


def saved(path, a, gml=False, **kw):
    data = jp2.encode(a, **kw)
    if gml:
        at = data.rindex(b"jp2c") - 4
        data = data[:at] + box(b"asoc", box(b"xml ", GML.encode())) + data[at:]
    path.write_bytes(data)
    return str(path)


def layers(path):
    from gridloom.sources import tiff

    with open(path, "rb") as f:
        file = tiff.parse(f)
        return file, [tiff.read_window(f, d, 0, 0, d.width, d.height) for d in file.images], [tiff.read_window(f, d, 0, 0, d.width, d.height) for d in file.masks]


def test_conversion_of_colours(tmp_path):
    """Planes, overviews decoded at their sizes, georeferencing from the file's own GML."""
    from gridloom import api

    a = picture(72, 96, 3)
    path, out = saved(tmp_path / "a.jp2", a, gml=True, levels=3, colours=True), str(tmp_path / "o.tif")
    api.convert(path, out, api.Options(block=16))
    file, images, masks = layers(out)
    image = j2.Image(open(path, "rb").read())
    assert file.images[0].planar and not masks and file.images[0].epsg == 32642 and file.images[0].affine[:2] == (300_000.0, 10.0)
    np.testing.assert_array_equal(images[0], a)
    for n, got in enumerate(images[1:], 1):
        np.testing.assert_array_equal(got, image.read(0, 0, *image.size(n), n)[: got.shape[0], : got.shape[1]])
    assert len(images) == 4 and api.is_valid(out)
    api.convert(path, out, api.Options(block=16, fresh=True))
    from gridloom.operators import cog

    np.testing.assert_array_equal(layers(out)[1][1], cog.shrink(a, 2, "average"))


def test_crops_and_bands(tmp_path):
    from gridloom import api
    from gridloom.operators import cog

    a = picture(72, 96, 3)
    path, out = saved(tmp_path / "a.jp2", a, gml=True, levels=2), str(tmp_path / "o.tif")
    api.crop(path, out, pixels=(8, 12, 40, 36), options=api.Options(block=16))
    file, images, _ = layers(out)
    np.testing.assert_array_equal(images[0], a[12:48, 8:48])
    assert file.images[0].affine[:4:3] == (300_080.0, 2_599_880.0)
    image = j2.Image(open(path, "rb").read())
    np.testing.assert_array_equal(images[1], image.read(4, 6, 20, 18, 1))
    api.crop(path, out, pixels=(7, 12, 40, 36), options=api.Options(block=16))
    np.testing.assert_array_equal(layers(out)[1][1], cog.shrink(a[12:48, 7:47], 2, "average"))
    api.crop(path, out, coordinates=(300_080, 2_599_880, 300_480, 2_599_520), options=api.Options(block=16))
    np.testing.assert_array_equal(layers(out)[1][0], a[12:48, 8:48])
    api.select_bands(path, out, [3, 1], api.Options(block=16))
    np.testing.assert_array_equal(layers(out)[1][0], a[:, :, [2, 0]])


def test_a_fourth_band_of_colours_becomes_a_mask(tmp_path):
    from gridloom import api

    a = picture(40, 50, 4)
    a[10:20, 5:30, 3] = 0
    path, out = saved(tmp_path / "a.jp2", a), str(tmp_path / "o.tif")
    api.convert(path, out, api.Options(block=16))
    _, images, masks = layers(out)
    np.testing.assert_array_equal(images[0], a)
    np.testing.assert_array_equal(masks[0][:, :, 0], np.where(a[:, :, 3] > 0, 255, 0))
    np.testing.assert_array_equal(masks[1], masks[0][::2, ::2])
    got = api.footprint(path, api.FootprintOptions(all_rings=True))
    assert got["validity"] == "alpha" and got["ring_count"] == len(api.trace(a[:, :, 3] > 0))


def test_footprints_and_their_rules(tmp_path):
    from gridloom import api

    grey = np.zeros((30, 40, 1), np.uint8)
    grey[5:20, 8:31] = 9
    path = saved(tmp_path / "a.jp2", grey, gml=True)
    got = api.footprint(path, api.FootprintOptions(to_wgs84=False))
    assert (got["validity"], got["georef"], got["ring_count"]) == ("mask", "affine", 1)
    m = api.ring_metrics(got["rings"][0])
    assert (m["min_x"], m["max_x"]) == (300_085.0, 300_315.0)  # outlines run half a pixel inside the padded grid
    assert api.footprint(path, api.FootprintOptions(window=(10, 6, 12, 10)))["vertex_count"] == 4
    wide = saved(tmp_path / "b.jp2", grey.astype(np.uint16), bits=16)
    assert api.footprint(wide)["validity"] == "nonzero" and api.footprint(wide)["georef"] == "pixel"
    assert api.footprint(saved(tmp_path / "c.jp2", grey.astype(np.uint16), bits=12))["vertex_count"] == 4
    colours = np.repeat(grey, 3, axis=2)
    path = saved(tmp_path / "d.jp2", colours)
    assert api.footprint(path)["validity"] == "full"
    assert api.footprint(path, api.FootprintOptions(black_rgb=True))["validity"] == "black_rgb"
    with pytest.raises(ValueError, match="nodata"):
        api.footprint(path, api.FootprintOptions(source="nodata"))
    (tmp_path / "d.j2w").write_text("10\n0\n0\n-10\n300005\n2599995\n")
    assert api.info(path)["affine"]["ox"] == 300_000.0


def test_regions_are_spread_over_tasks(spark, tmp_path):

    a = picture(50, 70, 2)
    path = saved(tmp_path / "a.j2k", a, boxes=False)
    rows = j2.decode_regions(spark, path, size=32)
    assert rows.count() == 6
    got = np.zeros_like(a)
    for r in rows.collect():
        got[r.row_off : r.row_off + r.rows, r.col_off : r.col_off + r.cols] = np.frombuffer(bytes(r.data), np.uint8).reshape(r.rows, r.cols, 2)
    np.testing.assert_array_equal(got, a)
    small = j2.decode_regions(spark, path, reduce=1, size=64).first()
    assert (small.rows, small.cols, small.layer) == (25, 35, 1)
