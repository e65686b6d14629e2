import io
import struct

import numpy as np
import pytest

from gridlake.sources import codecs, tiff


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaabcabcabc" * 700, bytes(np.random.default_rng(1).integers(0, 256, 30000, dtype="u1")), bytes(range(256)) * 40])
def test_codecs_return_what_went_in(data):
    for codec in (codecs.NONE, codecs.DEFLATE, codecs.LZW, codecs.PACKBITS):
        assert codecs.decompress(codecs.compress(data, codec), codec, len(data)) == data


def test_jpeg_and_odd_predictors_are_refused():
    for f in (lambda: codecs.decompress(b"", 7), lambda: codecs.undo_predictor(b"", 42, 1, 1, 8), lambda: codecs.undo_predictor(b"", 2, 1, 1, 12)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("kind,predictor", [("u1", 2), ("u2", 2), ("i2", 2), ("u4", 2), ("f4", 3), ("f4", 1), ("f8", 3)])
@pytest.mark.parametrize("block", [None, 16])
@pytest.mark.parametrize("compression", [codecs.NONE, codecs.DEFLATE, codecs.LZW, codecs.PACKBITS])
def test_round_trip(tmp_path, kind, predictor, block, compression):
    rng = np.random.default_rng(7)
    image = (rng.random((37, 29, 3)) * 200).astype(kind)
    path = str(tmp_path / "a.tif")
    tiff.write_tiff(path, image, block, compression, predictor)
    reader = tiff.TiffReader({"path": path})
    got = np.full(image.shape, np.nan, np.float32)
    for p in reader.partitions():
        for batch in reader.read(p):
            for r in batch.to_pylist():
                got[r["row0"] : r["row0"] + r["height"], r["col0"] : r["col0"] + r["width"], r["band"]] = np.array(r["values"], np.float32).reshape(r["height"], r["width"])
    assert np.array_equal(got, image.astype(np.float32))


def test_header_facts(tmp_path, spark):
    image = np.arange(25 * 25, dtype="f4").reshape(25, 25)
    path = str(tmp_path / "b.tif")
    xml = '<GDALMetadata><Item name="STATISTICS_MINIMUM" sample="0">0.5</Item><Item name="STATISTICS_MAXIMUM" sample="0">624</Item></GDALMetadata>'
    tiff.write_tiff(path, image, 16, gt=(10.0, 0.009, 0, 0.225, 0, -0.009), epsg=32735, nodata="0", overviews=[image[::2, ::2]], big_endian=True, description=xml)
    rows = tiff.read_info(spark, path).orderBy("level").collect()
    assert [(r.width, r.height, r.dtype) for r in rows] == [(25, 25, "float32"), (13, 13, "float32")]
    assert rows[0].epsg == 32735 and rows[0].nodata == 0 and rows[0].big_endian and (rows[0].stats_min, rows[0].stats_max) == (0.5, 624.0)
    assert np.allclose(rows[0].gt, [10.0, 0.009, 0, 0.225, 0, -0.009]) and np.isclose(rows[1].gt[1], 0.009 * 25 / 13)
    cells = tiff.cells(tiff.read_blocks(spark, path).where("level = 0"))
    assert cells.count() == 625 and cells.where("value is null").count() == 1
    assert cells.where("row = 3 and col = 20").first().value == image[3, 20]


def test_pruning_reaches_the_reader(tmp_path, spark):
    path = str(tmp_path / "c.tif")
    tiff.write_tiff(path, np.zeros((64, 64, 2), "u1"), 16)
    blocks = tiff.read_blocks(spark, path).where("bx = 1 and by in (0, 2) and band = 1")
    assert sorted((r.bx, r.by, r.band) for r in blocks.collect()) == [(1, 0, 1), (1, 2, 1)]
    assert tiff.read_blocks(spark, path).where("bx = 9").count() == 0


def test_far_chains_are_followed_and_broken_files_refused(tmp_path):
    image = np.zeros((600, 600), "f4")
    path = tmp_path / "far.tif"
    tiff.write_tiff(str(path), image, overviews=[image[::2, ::2], image[::4, ::4]])
    with open(path, "rb") as f:
        assert len(tiff.read_levels(f)) == 3
    for bad in (b"", b"II*\0", b"XX" + b"\0" * 20, b"II" + struct.pack("<HI", 99, 8) + b"\0" * 16):
        with pytest.raises(ValueError):
            tiff.read_levels(io.BytesIO(bad))
    with pytest.raises(ValueError):
        tiff.resolve_paths("ftp://x/y.tif", None)
    with pytest.raises(ValueError):
        tiff.resolve_paths(str(path), str(tmp_path / "elsewhere"))


def test_ranges_merge():
    assert [len(g) for g in tiff.merged([(0, 10, 0), (10, 10, 1), (60_000, 5, 2), (92_000, 5, 3)])] == [2, 2]


def test_web_files_and_pages(tmp_path, spark):
    """Blocks over range requests equal those of the file; a page is fetched once."""
    import http.server
    import threading

    from gridlake.sources import ranges

    image = np.random.default_rng(3).integers(0, 255, (90, 70)).astype("u1")
    path = tmp_path / "w.tif"
    tiff.write_tiff(str(path), image, 16, overviews=[image[::2, ::2]])
    data = path.read_bytes()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            part = data[first : last + 1]
            self.send_response(206 if part else 416)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/w.tif"
    key = lambda rows: sorted((r.level, r.band, r.bx, r.by, r["values"]) for r in rows)
    want = key(tiff.read_blocks(spark, str(path)).collect())
    assert key(tiff.read_blocks(spark, url).collect()) == want
    assert key(tiff.read_whole(spark, str(path)).collect()) == want
    named = tiff.read_blocks(spark, url, blocks="1:2,0:0,99:1").where("level = 0").collect()
    assert sorted((r.bx, r.by) for r in named) == [(0, 0), (1, 2)]
    server.shutdown()
    source = ranges.Source(ranges.LocalFile(str(path)), ranges.Pages(1 << 20))
    for place, n in ((0, 10), (5, 50), (len(data) - 3, 100), (100, 4000)):
        source.seek(place)
        assert source.read(n) == data[place : place + n]
    assert source.fetches == 1
    small = ranges.Pages(100)
    for k in range(5):
        small.put(k, bytes(40))
    assert list(small.held) == [3, 4] and small.bytes == 80
    assert ranges.range_body(200, b"abcdef", 2, 3) == b"cde" and ranges.range_body(206, b"cde", 2, 3) == b"cde"
    with pytest.raises(OSError):
        ranges.range_body(500, b"", 0, 1)


def test_cells_become_the_file_of_their_array(tmp_path, spark, monkeypatch):
    """Blocks are made by tasks and pass the driver a few at a time; a block without a cell has no rows."""
    monkeypatch.setattr(tiff, "BLOCKS_AT_ONCE", 3)
    monkeypatch.setattr(tiff, "CELLS_PER_TASK", 700)
    image = np.random.default_rng(3).random((75, 37)).astype("f4")
    image[::7, ::3] = -1
    rows = [(r, c, None if image[r, c] == -1 else float(image[r, c])) for r in range(75) for c in range(37) if not (16 <= r < 32 and c >= 32)]
    cells = spark.createDataFrame(rows, "row int, col int, value float").repartition(3)
    gt = (10.0, 0.01, 0, 2.0, 0, -0.01)
    one, other = str(tmp_path / "d.tif"), str(tmp_path / "e.tif")
    tiff.write_cells(one, cells, 37, 75, 16, levels=2, gt=gt, epsg=4326, nodata=-1.0)
    tiff.write_tiff(other, image, 16, 8, 3, gt=gt, epsg=4326, nodata="-1", overviews=[image[::2, ::2]])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d.tif", "e.tif"]
    infos = [[r[1:] for r in tiff.read_info(spark, p).orderBy("level").collect()] for p in (one, other)]
    assert infos[0] == infos[1]
    got, want = ({(r.level, r.row, r.col): r.value for r in tiff.cells(tiff.read_blocks(spark, p)).collect()} for p in (one, other))
    assert {k for k in want if k not in got} == {(0, r, c) for r in range(16, 32) for c in range(32, 37)}
    assert all(got[k] == want[k] for k in got if k[0] == 0)
    assert all(got[k] == want[k] for k in got if not (k[0] == 1 and 8 <= k[1] < 16 and k[2] >= 16))
