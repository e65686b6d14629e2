"""Cloud-optimised GeoTIFF as a Python data source: `spark.read.format("gridlake_tiff").option("path", ...)`.

Rows are blocks: one per block and band with its cells packed as floats, so Spark moves few, large records and explodes
them late (cells()). Filters on level, band, bx and by are taken over by the reader, which then neither reads nor decodes
other blocks; blocks near each other in the file are fetched together. The option `blocks` ("bx:by,bx:by") names blocks one by one. Headers are
read once, when the partitions are planned, and travel with them. Files are local, or http(s) URLs that answer range requests; read_whole()
takes files from any store that Spark reads. Missing values are null from here on."""

from __future__ import annotations

import glob
import io
import os
import re
import shutil
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridlake.sources import codecs, ranges

HEAD = 256 * 1024
FOLLOW, MOST_FOLLOWS = 128 * 1024, 8
GAP = 32 * 1024
BLOCKS_PER_PARTITION = 64
BLOCKS_AT_ONCE = 4096  # blocks that pass the driver at a time where a file is written from cells
CELLS_PER_TASK = 1 << 20
PLACES = (273, 279, 324, 325)  # tags of where blocks lie
#: TIFF field types and their sizes.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
DTYPES = {1: "uint", 2: "int", 3: "float"}

LEVELS = (
    "source_id string, level int, width int, height int, bands int, bits int, sample_format int, dtype string, compression int, predictor int, tiled boolean, "
    "block_w int, block_h int, photometric int, epsg int, gt array<double>, nodata float, stats_min double, stats_max double, big_endian boolean"
)
BLOCKS = "source_id string, level int, band int, bx int, by int, row0 int, col0 int, width int, height int, values array<float>"
BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


@dataclass
class Level:
    """One image of a file."""

    tags: dict[int, tuple] = field(default_factory=dict)
    big_endian: bool = False

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if self.tags.get(tag) else default

    width = property(lambda s: s.one(256, 0))
    height = property(lambda s: s.one(257, 0))
    bits = property(lambda s: s.one(258, 1))
    compression = property(lambda s: s.one(259, 1))
    samples = property(lambda s: s.one(277, 1))
    planar = property(lambda s: s.one(284, 1))
    predictor = property(lambda s: s.one(317, 1))
    sample_format = property(lambda s: s.one(339, 1))
    tiled = property(lambda s: 324 in s.tags)
    is_mask = property(lambda s: bool(s.one(254, 0) & 4))

    @property
    def block(self) -> tuple[int, int]:
        return (self.one(322), self.one(323)) if self.tiled else (self.width, min(self.one(278, self.height), self.height))

    @property
    def blocks_across(self) -> tuple[int, int]:
        w, h = self.block
        return -(-self.width // w), -(-self.height // h)

    @property
    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.tags.get(324 if self.tiled else 273, ()), self.tags.get(325 if self.tiled else 279, ())))

    @property
    def nodata(self) -> float | None:
        try:
            return float(np.float32(self.text(42113)))
        except ValueError:
            return None

    def text(self, tag: int) -> str:
        return bytes(self.tags.get(tag, ())).split(b"\0")[0].decode("latin-1").strip() if self.tags.get(tag) else ""

    @property
    def gt(self) -> list[float] | None:
        """A matrix if there is one, else pixel scale and the first tie point."""
        if len(m := self.tags.get(34264, ())) >= 8:
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        scale, tie = self.tags.get(33550, ()), self.tags.get(33922, ())
        if len(scale) < 2 or len(tie) < 6:
            return None
        return [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]]

    @property
    def epsg(self) -> int | None:
        """Projected before geographic; user-defined codes don't count."""
        keys, found = self.tags.get(34735, ()), {}
        for k in range(4, len(keys) - 3, 4):
            if keys[k + 1] == 0 and keys[k + 3] != 32767:
                found[keys[k]] = keys[k + 3]
        return found.get(3072) or found.get(2048)

    def stat(self, name: str) -> float | None:
        found = re.search(rf'name="STATISTICS_{name}"[^>]*>([^<]+)<', self.text(42112))
        return float(found[1]) if found else None


class Window:
    """The part of a file that has been read so far."""

    def __init__(self, f):
        self.f, self.start, self.data, self.reads = f, 0, f.read(HEAD), 1

    def at(self, offset: int, n: int) -> bytes | None:
        k = offset - self.start
        return self.data[k : k + n] if 0 <= k and k + n <= len(self.data) else None

    def move(self, offset: int) -> None:
        self.f.seek(offset)
        self.start, self.data, self.reads = offset, self.f.read(FOLLOW), self.reads + 1


def read_levels(f) -> list[Level]:
    """The chain of images; masks are left out. A chain that leaves the window is followed a few times; values outside are fetched."""
    window = Window(f)
    order = {b"II": "<", b"MM": ">"}.get(window.data[:2])
    if order is None or len(window.data) < 8:
        raise ValueError("this is no TIFF")
    version = struct.unpack(order + "H", window.data[2:4])[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version} is not known")
    big = version == 43
    place = struct.unpack(order + ("Q" if big else "I"), window.data[8:16] if big else window.data[4:8])[0]
    count_code, entry, pointer = ("Q", 20, "Q") if big else ("H", 12, "I")
    head, point = struct.calcsize("=" + count_code), struct.calcsize("=" + pointer)
    levels, seen, follows = [], set(), 0
    while place and place not in seen:
        seen.add(place)
        raw = window.at(place, head)
        if raw is None or window.at(place, head + struct.unpack(order + count_code, raw)[0] * entry + point) is None:
            if follows == MOST_FOLLOWS:
                break
            follows += 1
            window.move(place)
            raw = window.at(place, head)
            if raw is None or window.at(place, head + struct.unpack(order + count_code, raw)[0] * entry + point) is None:
                break
        n = struct.unpack(order + count_code, raw)[0]
        level = Level(big_endian=order == ">")
        for k in range(n):
            e = window.at(place + head + k * entry, entry)
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + pointer, e[4 : 4 + point])[0]
            size = TYPE_SIZES.get(kind, 0) * count
            if not size:
                continue
            if size <= point:
                data = e[4 + point : 4 + point + size]
            else:
                offset = struct.unpack(order + pointer, e[4 + point :])[0]
                data = window.at(offset, size)
                if data is None:
                    f.seek(offset)
                    data = f.read(size)
            if kind in (2, 7):
                level.tags[tag] = tuple(data)
            elif kind in TYPE_CODES and len(data) == size:
                level.tags[tag] = struct.unpack(f"{order}{count}{TYPE_CODES[kind]}", data)
        if level.width and not level.is_mask:
            levels.append(level)
        place = struct.unpack(order + pointer, window.at(place + head + n * entry, point))[0]
    if not levels:
        raise ValueError("there is no image in this file")
    return levels


def resolve_paths(path: str, root: str | None) -> list[str]:
    """Files of a path, pattern or file:// URL; with a root, what lies outside is refused. A web address stands for itself."""
    if path.startswith(("http://", "https://")):
        if root is not None:
            raise ValueError("a file lies outside the root")
        return [path]
    if re.match(r"^[a-z][a-z0-9+.-]*://", path) and not path.startswith("file://"):
        raise ValueError(f"the scheme of {path} is not read")
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "*.tif*"))) if os.path.isdir(path) else sorted(glob.glob(path))
    found = [os.path.realpath(p) for p in found]
    if root is not None and any(os.path.commonpath([os.path.realpath(root), p]) != os.path.realpath(root) for p in found):
        raise ValueError("a file lies outside the root")
    if not found:
        raise FileNotFoundError(path)
    return found


def merged(ranges: list[tuple[int, int, int]], gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Groups of (offset, length, index) that one read may serve."""
    groups: list[list[tuple[int, int, int]]] = []
    reach = 0
    for r in sorted(ranges):
        if groups and r[0] <= reach + gap:
            groups[-1].append(r)
        else:
            groups.append([r])
            reach = 0
        reach = max(reach, r[0] + r[1])
    return groups


@dataclass
class BlockRange(InputPartition):
    """Blocks of one level, with all of the header that reading them takes."""

    path: str
    number: int
    level: Level
    nodata: float | None
    bands: tuple[int, ...]
    asked: tuple[tuple[int, int, int], ...]  # offset, length, index of each block's bytes

    def __init__(self, path, number, level, nodata, bands, asked):
        super().__init__(None)
        self.path, self.number, self.level, self.nodata, self.bands, self.asked = path, number, level, nodata, bands, asked


def planned(path: str, levels: list[Level], wanted, pairs: set | None = None) -> list[BlockRange]:
    """Partitions of a file's blocks for which wanted(name, value) holds; with pairs, of those (bx, by) only."""
    out = []
    for k, level in enumerate(levels):
        if not wanted("level", k):
            continue
        across, down = level.blocks_across
        bands = tuple(b for b in range(level.samples) if wanted("band", b))
        places = sorted(by * across + bx for bx, by in pairs if 0 <= bx < across and 0 <= by < down) if pairs is not None else range(across * down)
        kept = [i for i in places if wanted("bx", i % across) and wanted("by", i // across)]
        ranges_, planes = level.ranges, bands if level.planar == 2 else (0,)
        nodata = level.nodata if level.nodata is not None else levels[0].nodata
        light = Level({t: v for t, v in level.tags.items() if t not in PLACES}, level.big_endian)
        light.tags |= {t: () for t in PLACES if t in level.tags}
        for a in range(0, len(kept) if bands else 0, BLOCKS_PER_PARTITION):
            asked = [(*ranges_[p * across * down + i], p * across * down + i) for i in kept[a : a + BLOCKS_PER_PARTITION] for p in planes]
            out.append(BlockRange(path, k, light, nodata, bands, tuple(r for r in asked if r[1])))
    return out


def level_rows(path: str, levels: list[Level]):
    """A LEVELS row for each level."""
    base = levels[0]
    for k, v in enumerate(levels):
        gt = v.gt or (base.gt and [g * (base.width / v.width) if i in (1, 2, 4, 5) else g for i, g in enumerate(base.gt)])
        w, h = v.block
        nodata = v.nodata if v.nodata is not None else base.nodata
        yield (path, k, v.width, v.height, v.samples, v.bits, v.sample_format, f"{DTYPES.get(v.sample_format, 'unknown')}{v.bits}", v.compression, v.predictor, v.tiled, w, h, v.one(262), v.epsg or base.epsg, gt, nodata, v.stat("MINIMUM"), v.stat("MAXIMUM"), v.big_endian)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "blocks")
        self.paths = resolve_paths(options["path"], options.get("root"))
        self.limits: dict[str, list[float]] = {}
        self.chosen: dict[str, set[int]] = {}
        named = options.get("blocks")
        self.pairs = None if named is None else {tuple(map(int, b.split(":"))) for b in named.split(",") if b}

    def pushFilters(self, filters):  # noqa: N802
        """Bounds on level, band, bx and by are kept here; what else there is Spark filters."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if self.table != "blocks" or name not in ("level", "band", "bx", "by"):
                yield f
                continue
            low, high = self.limits.setdefault(name, [-np.inf, np.inf])
            if isinstance(f, EqualTo):
                self.limits[name] = [max(low, f.value), min(high, f.value)]
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.limits[name] = [max(low, f.value + isinstance(f, GreaterThan)), high]
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.limits[name] = [low, min(high, f.value - isinstance(f, LessThan))]
            elif isinstance(f, In):
                self.chosen[name] = self.chosen.get(name, set(f.value)) & set(f.value)
            else:
                yield f

    def _wanted(self, name: str, value: int) -> bool:
        low, high = self.limits.get(name, (-np.inf, np.inf))
        return low <= value <= high and value in self.chosen.get(name, (value,))

    def partitions(self):
        if self.table == "levels":
            return [BlockRange(p, 0, Level(), None, (), ()) for p in self.paths]
        out = []
        for path in self.paths:
            with ranges.open_source(path) as f:
                out += planned(path, read_levels(f), self._wanted, self.pairs)
        return out or [BlockRange("", 0, Level(), None, (), ())]

    def read(self, partition):
        if not partition.path:
            return
        with ranges.open_source(partition.path) as f:
            if self.table == "levels":
                yield from level_rows(partition.path, read_levels(f))
            else:
                yield from read_range(f, partition)


def read_range(f, part: BlockRange):
    """Record batches of a partition's blocks, one for each run of bytes read."""
    level = part.level
    w, h = level.block
    across, down = level.blocks_across
    planes = level.samples if level.planar == 2 else 1
    per_cell = 1 if level.planar == 2 else level.samples
    for group in merged(list(part.asked)):
        f.seek(group[0][0])
        data = f.read(max(o + n for o, n, _ in group) - group[0][0])
        rows = []
        for offset, n, index in group:
            plane, i = divmod(index, across * down)
            bx, by = i % across, i // across
            high = min(h, level.height - by * h)
            tall = h if level.tiled else high
            raw = codecs.decompress(data[offset - group[0][0] : offset - group[0][0] + n], level.compression, w * tall * per_cell * level.bits // 8)
            raw = codecs.undo_predictor(raw, level.predictor, w, per_cell, level.bits, level.big_endian)
            values = codecs.to_floats(raw, level.bits, level.sample_format, level.big_endian)
            cells = np.full(w * tall * per_cell, np.nan, np.float32)
            cells[: len(values)] = values[: len(cells)]
            cells = cells.reshape(tall, w, per_cell)[:high, : min(w, level.width - bx * w)]
            for band in (plane,) if planes > 1 else part.bands:
                flat = cells[:, :, 0 if planes > 1 else band].ravel()
                missing = np.isnan(flat) if part.nodata is None else np.isnan(flat) | (flat == np.float32(part.nodata))
                rows.append((part.path, part.number, band, bx, by, by * h, bx * w, cells.shape[1], cells.shape[0], pa.array(flat, mask=missing)))
        if rows:
            columns = list(zip(*rows))
            types = [pa.string(), *[pa.int32()] * 8]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            lengths = np.cumsum([0, *(len(v) for v in columns[9])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(lengths), pa.concat_arrays(columns[9])))
            yield pa.RecordBatch.from_arrays(arrays, names=BLOCK_NAMES)


class TiffSource(DataSource):
    @classmethod
    def name(cls):
        return "gridlake_tiff"

    def schema(self):
        return LEVELS if self.options.get("table") == "levels" else BLOCKS

    def reader(self, schema):
        return TiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


def read_blocks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("gridlake_tiff").options(path=path, **options).load()


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each level."""
    return read_blocks(spark, path, table="levels")


def read_whole(spark: SparkSession, path: str, level: int | None = None, band: int | None = None) -> DataFrame:
    """Blocks of small files in any store that Spark reads (a path or pattern): each file comes as a whole and is taken apart where it arrives."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                f = io.BytesIO(content)
                asked = {"level": level, "band": band}
                for part in planned(name, read_levels(f), lambda k, v: asked.get(k) in (None, v)):  # noqa: B023
                    yield from read_range(f, part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def cells(blocks: DataFrame) -> DataFrame:
    """(source_id, level, band, row, col, value) of blocks."""
    out = blocks.select("source_id", "level", "band", "row0", "col0", "width", F.posexplode("values").alias("_k", "value"))
    return out.select("source_id", "level", "band", (F.col("row0") + F.floor(F.col("_k") / F.col("width"))).cast("int").alias("row"), (F.col("col0") + F.col("_k") % F.col("width")).cast("int").alias("col"), "value")


def write_tiff(path: str, image: np.ndarray, block: int | None = None, compression: int = 1, predictor: int = 1, gt=None, epsg: int | None = None, nodata: str | None = None, overviews=(), big_endian: bool = False, description: str | None = None) -> None:
    """A GeoTIFF of an array (rows, columns[, bands]) and coarser arrays; tiles of `block`, or one strip. For fixtures and exports."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 0))
    link = 4
    for n, array in enumerate((image, *overviews)):
        array = array if array.ndim == 3 else array[:, :, None]
        rows, columns, bands = array.shape
        bits, kind = array.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
        w, h = (block, block) if block else (columns, rows)
        offsets, counts = [], []
        for r in range(0, rows, h):
            for c in range(0, columns, w):
                part = array[r : r + h, c : c + w]
                if block:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                data = codecs.predict(part.astype(part.dtype.newbyteorder("<")).tobytes(), predictor, part.shape[1], bands, bits) if predictor > 1 else part.astype(part.dtype.newbyteorder(order)).tobytes()
                data = codecs.compress(data, compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        tags = _tags(n, columns, rows, bits, bands, kind, compression, predictor, gt, epsg, nodata, description)
        tags |= {322: ("H", [w]), 323: ("H", [h]), 324: ("I", offsets), 325: ("I", counts)} if block else {273: ("I", offsets), 278: ("I", [h]), 279: ("I", counts)}
        start = len(out)
        out[link : link + 4] = struct.pack(order + "I", start)
        out += _directory(tags, start, order, "H", "I")
        link = start + 2 + 12 * len(tags)
    with open(path, "wb") as f:
        f.write(out)


def _tags(n: int, columns: int, rows: int, bits: int, bands: int, kind: int, compression: int, predictor: int, gt, epsg: int | None, nodata: str | None, description: str | None) -> dict[int, tuple]:
    """Tags of the n-th image but for its blocks; what holds for the file stands in the first one."""
    tags = {256: ("I", [columns]), 257: ("I", [rows]), 258: ("H", [bits] * bands), 259: ("H", [compression]), 262: ("H", [1]), 277: ("H", [bands]), 284: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind] * bands)}
    if n:
        return tags | {254: ("I", [1])}
    if gt:
        tags |= {33550: ("d", [gt[1], -gt[5], 0.0]), 33922: ("d", [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])}
    if epsg:
        geographic = 4000 <= epsg < 5000
        tags[34735] = ("H", [1, 1, 0, 1, 2048 if geographic else 3072, 0, 1, epsg])
    for tag, text in ((42112, description), (42113, nodata)):
        if text is not None:
            tags[tag] = ("s", text.encode() + b"\0")
    return tags


def _directory(tags: dict[int, tuple], start: int, order: str, count_code: str, pointer: str) -> bytes:
    """An image's directory at `start` with its values behind it; it names no next one yet."""
    body, extra, point = bytearray(), bytearray(), struct.calcsize("=" + pointer)
    after = start + struct.calcsize("=" + count_code) + (4 + 2 * point) * len(tags) + point
    for tag, (code, values) in sorted(tags.items()):
        data = bytes(values) if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        body += struct.pack(order + "HH" + pointer, tag, {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}[code], len(values))
        if len(data) <= point:
            body += data.ljust(point, b"\0")
        else:
            body += struct.pack(order + pointer, after + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    return struct.pack(order + count_code, len(tags)) + body + struct.pack(order + pointer, 0) + extra


def _encode_task(block: int, compression: int, predictor: int, nodata: float):
    """(level, index, data) of blocks, from rows (level, index, place, value) sorted by level and index; the last block at hand waits for the next batch."""

    def run(batches):
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)]

        def encoded(parts):
            level, index, place, value = parts
            cuts = np.flatnonzero((np.diff(level) != 0) | (np.diff(index) != 0)) + 1
            starts = np.concatenate([[0], cuts])
            data = []
            for a, b in zip(starts, np.append(cuts, len(level))):
                cells = np.full(block * block, nodata, "<f4")
                cells[place[a:b]] = value[a:b]
                raw = cells.tobytes()
                data.append(codecs.compress(codecs.predict(raw, predictor, block, 1, 32) if predictor > 1 else raw, compression))
            return pa.RecordBatch.from_arrays([pa.array(level[starts]), pa.array(index[starts]), pa.array(data, pa.binary())], names=["level", "index", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "index", "place", "value")]
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            last = np.flatnonzero((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]))[0]
            held = [c[last:] for c in columns]
            if last:
                yield encoded([c[:last] for c in columns])
        if len(held[0]):
            yield encoded(held)

    return run


def write_cells(path: str, cells: DataFrame, width: int, height: int, block: int, compression: int = codecs.DEFLATE, predictor: int = 3, levels: int = 1, gt=None, epsg: int | None = None, nodata: float = -1.0) -> None:
    """A Big TIFF of one band of floats from cells (row, col, value), each further level with every second row and column of the one before.

    Blocks are made where Spark has the cells, and stored beside the file; the driver appends BLOCKS_AT_ONCE of them at a time and keeps
    only their places. A block without any cell has no bytes. For fixtures and exports; executors must see the file's folder."""
    spark, parts, shapes = cells.sparkSession, None, []
    for k in range(levels):
        across, down = -(-width // (block << k)), -(-height // (block << k))
        shapes.append((-(-width // (1 << k)), -(-height // (1 << k)), across * down))
        row, col = F.shiftright(F.col("row").cast("int"), k), F.shiftright(F.col("col").cast("int"), k)
        index = F.floor(row / block).cast("long") * across + F.floor(col / block).cast("long")
        mine = cells.where((F.col("row") % (1 << k) == 0) & (F.col("col") % (1 << k) == 0))
        mine = mine.select(F.lit(k).alias("level"), index.alias("index"), ((row % block) * block + col % block).cast("int").alias("place"), F.coalesce(F.col("value").cast("float"), F.lit(nodata).cast("float")).alias("value"))
        parts = mine if parts is None else parts.unionAll(mine)
    tasks = -(-sum(total for *_, total in shapes) * block * block // CELLS_PER_TASK)
    dealt = parts.repartitionByRange(tasks, "level", "index").sortWithinPartitions("level", "index")
    blocks = f"file://{os.path.abspath(path)}.blocks"
    schema = "level int, index long, data binary"
    try:
        dealt.mapInArrow(_encode_task(block, compression, predictor, nodata), schema).write.mode("overwrite").parquet(blocks)
        stored = spark.read.schema(schema).parquet(blocks)
        with open(path, "wb") as f:
            f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
            link = 8
            for k, (columns, rows, total) in enumerate(shapes):
                offsets, counts = np.zeros(total, np.int64), np.zeros(total, np.int64)
                for start in range(0, total, BLOCKS_AT_ONCE):
                    some = stored.where((F.col("level") == k) & (F.col("index") >= start) & (F.col("index") < start + BLOCKS_AT_ONCE)).toArrow()
                    for i, data in zip(some.column("index").to_pylist(), some.column("data").to_pylist()):
                        offsets[i], counts[i] = f.tell(), len(data)
                        f.write(data + b"\0" * (len(data) % 2))
                tags = _tags(k, columns, rows, 32, 1, 3, compression, predictor, gt, epsg, f"{nodata:g}", None)
                tags |= {322: ("H", [block]), 323: ("H", [block]), 324: ("Q", offsets.tolist()), 325: ("I", counts.tolist())}
                start = f.tell()
                f.write(_directory(tags, start, "<", "Q", "Q"))
                f.seek(link)
                f.write(struct.pack("<Q", start))
                f.seek(0, os.SEEK_END)
                link = start + 8 + 20 * len(tags)
    finally:
        shutil.rmtree(blocks.removeprefix("file://"), ignore_errors=True)
