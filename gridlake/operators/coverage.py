"""Polygons to cells: exact coverage shares, and scanline fill by cell centres, as runs that are exploded late.

Zones are zone_id and polygons in cell units. Rows of a run that has one share (the interior) stay one record until
the join needs cells, so a large zone travels as a few numbers for each of its rows. Work and memory follow the cells
that a zone's edges cross, not the raster's width nor the zone's area."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SHARE = 1e-9
RUNS = "row int, col0 int, length int, w double"
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row, col0, length, w
Ring = tuple[np.ndarray, np.ndarray, int, int]  # x, y, number of its polygon, number in the polygon (0: exterior)
NO_RUNS: Runs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def rings_of(polygons) -> list[Ring]:
    """Rings of polygons given as lists of points with x and y."""
    return [(np.array([p["x"] for p in ring], float), np.array([p["y"] for p in ring], float), i, k) for i, polygon in enumerate(polygons or []) for k, ring in enumerate(polygon)]


def _rings_of_column(column: pa.Array):
    """The rings of each zone of an Arrow column, without a Python object for each point; null has none."""
    zones = column.offsets.to_numpy()
    polygons = column.values
    rings = polygons.values
    points = rings.values
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    of_polygon, of_ring, null = polygons.offsets.to_numpy(), rings.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for z, (a, b) in enumerate(zip(zones, zones[1:])):
        found: list[Ring] = []
        for i in range(a, a if null[z] else b):
            for k, r in enumerate(range(of_polygon[i], of_polygon[i + 1])):
                found.append((x[of_ring[r] : of_ring[r + 1]], y[of_ring[r] : of_ring[r + 1]], i - a, k))
        yield found


def _closed_area(xs: np.ndarray, ys: np.ndarray) -> float:
    return float(np.dot(xs, np.roll(ys, -1)) - np.dot(np.roll(xs, -1), ys)) / 2


def _whole_numbers(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edge, number) of the whole numbers in [0, most] that lie strictly between a and b of each edge."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    first = np.maximum(np.floor(low) + 1, 0).astype(np.int64)
    count = np.maximum(np.minimum(np.ceil(high) - 1, most).astype(np.int64) - first + 1, 0)
    edge = np.repeat(np.arange(len(a)), count)
    nth = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
    return edge, first[edge] + nth


def shares(rings: list[Ring], width: int, height: int) -> Runs:
    """Runs of cells with the share of each that is covered. Exteriors count positive and holes negative whatever their
    winding; shares of several polygons add up and are clamped to 1.

    Edges are cut where they cross from cell to cell. A cut that falls by d covers d of every cell to its right in its row, and of the cell that it
    runs through the part to its right; sums along the rows give the shares."""
    x0, y0, x1, y1 = ([] for _ in range(4))
    for xs, ys, _, k in rings:
        if len(xs) < 3 or not (np.isfinite(xs).all() and np.isfinite(ys).all()):
            continue
        turn = (k == 0) != (_closed_area(xs, ys) < 0)
        begin, end = ((xs, ys), (np.roll(xs, -1), np.roll(ys, -1))) if turn else ((np.roll(xs, -1), np.roll(ys, -1)), (xs, ys))
        for into, values in zip((x0, y0, x1, y1), (*begin, *end)):
            into.append(values)
    if not x0:
        return NO_RUNS
    x0, y0, x1, y1 = (np.concatenate(v) for v in (x0, y0, x1, y1))
    keep = (y0 != y1) & (np.maximum(y0, y1) > 0) & (np.minimum(y0, y1) < height)
    x0, y0, x1, y1 = (v[keep] for v in (x0, y0, x1, y1))
    if not len(x0):
        return NO_RUNS

    across, down = _whole_numbers(x0, x1, width), _whole_numbers(y0, y1, height)
    n = len(x0)
    edge = np.concatenate([np.arange(n), np.arange(n), across[0], down[0]])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.concatenate([np.zeros(n), np.ones(n), ((across[1] - x0[across[0]]) / (x1 - x0)[across[0]]), ((down[1] - y0[down[0]]) / (y1 - y0)[down[0]])])
    order = np.lexsort((t, edge))
    edge, t = edge[order], np.clip(t[order], 0, 1)
    same = edge[1:] == edge[:-1]
    e, s, t = edge[:-1][same], t[:-1][same], t[1:][same]
    fall = (s - t) * (y1 - y0)[e]
    middle = (s + t) / 2
    x, y = x0[e] + (x1 - x0)[e] * middle, y0[e] + (y1 - y0)[e] * middle
    row, x = np.floor(y).astype(np.int64), np.clip(x, 0, width)
    col = np.floor(x).astype(np.int64)
    inside = (fall != 0) & (row >= 0) & (row < height) & (col < width)
    row, col, fall, x = row[inside], col[inside], fall[inside], x[inside]
    if not len(row):
        return NO_RUNS

    # one record for each (row, col): what holds from it on, and what holds in it alone
    step = np.concatenate([np.zeros(len(row)), fall])
    part = np.concatenate([fall * (col + 1 - x), np.zeros(len(row))])
    row, col = np.concatenate([row, row]), np.concatenate([col, col + 1])
    order = np.lexsort((col, row))
    row, col, step, part = row[order], col[order], step[order], part[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1])])
    first = np.flatnonzero(new)
    row, col, step, part = row[first], col[first], np.add.reduceat(step, first), np.add.reduceat(part, first)
    total = np.cumsum(step)
    starts = np.concatenate([[True], row[1:] != row[:-1]])
    before = (total - step)[starts]
    base = total - before[np.cumsum(starts) - 1]
    last = np.append(starts[1:], True)
    until = np.where(last, width, np.append(col[1:], 0))
    single = (row, col, np.ones(len(row), np.int64), base + part)
    rest = (row, col + 1, until - col - 1, base)
    runs = [np.concatenate(v) for v in zip(single, rest)]
    return _joined(*runs, width)


def _joined(row, col, length, w, width: int) -> Runs:
    """Runs in order, without empty ones, neighbours of one share made one."""
    w = np.round(np.clip(w, 0, 1), 12)  # sums along a row leave whole shares a few units of rounding off
    kept = (length > 0) & (w >= LEAST_SHARE) & (col < width)
    row, col, length, w = row[kept], col[kept], length[kept], w[kept]
    order = np.lexsort((col, row))
    row, col, length, w = row[order], col[order], length[order], w[order]
    if not len(row):
        return NO_RUNS
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1] + length[:-1]) | (np.abs(w[1:] - w[:-1]) > 1e-12)])
    first = np.flatnonzero(new)
    return row[first], col[first], np.add.reduceat(length, first), w[first]


def filled(rings: list[Ring], width: int, height: int) -> Runs:
    """Runs of the cells whose centre is inside (even-odd for each polygon, left edges in, right edges out)."""
    begin, end = [], []  # (row, col)
    for one in {i for _, _, i, _ in rings}:
        mine = [(x, y) for x, y, i, _ in rings if i == one and len(x) >= 3]
        if not mine:
            continue
        x0, y0 = (np.concatenate([r[k] for r in mine]) for k in range(2))
        x1, y1 = (np.concatenate([np.roll(r[k], -1) for r in mine]) for k in range(2))
        # rows whose centre an edge passes: y0 <= row + 0.5 < y1, or the other way round
        low, high = np.ceil(np.minimum(y0, y1) - 0.5), np.ceil(np.maximum(y0, y1) - 0.5)
        low, high = np.clip(low, 0, height).astype(np.int64), np.clip(high, 0, height).astype(np.int64)
        e = np.repeat(np.arange(len(x0)), high - low)
        if not len(e):
            continue
        row = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        x = x0[e] + (x1 - x0)[e] * (row + 0.5 - y0[e]) / (y1 - y0)[e]
        order = np.lexsort((x, row))
        row, col = row[order], np.clip(np.ceil(x[order] - 0.5), 0, width).astype(np.int64)
        begin.append((row[::2], col[::2]))
        end.append((row[1::2], col[1::2]))
    if not begin:
        return NO_RUNS
    row, col = (np.concatenate([v[k] for v in begin + end]) for k in range(2))
    turn = np.concatenate([np.ones(sum(len(v[0]) for v in begin), np.int64), -np.ones(sum(len(v[0]) for v in end), np.int64)])
    order = np.lexsort((-turn, col, row))
    row, col, depth = row[order], col[order], np.cumsum(turn[order])
    length = np.append(np.where(row[1:] == row[:-1], col[1:] - col[:-1], 0), 0)
    return _joined(row, col, length, (depth > 0).astype(float), width)


def coverage_runs(zones: DataFrame, width: int, height: int, exact: bool = True) -> DataFrame:
    """The frame's columns but polygons, with RUNS, for zones with polygons in cell units."""
    one = shares if exact else filled
    others = [f for f in zones.schema.fields if f.name != "polygons"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), RUNS])
    types = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches):
        for batch in batches:
            for z, rings in enumerate(_rings_of_column(batch.column("polygons"))):
                runs = one(rings, width, height)
                for start in range(0, len(runs[0]), 50_000):
                    part = [v[start : start + 50_000] for v in runs]
                    same = [pa.repeat(batch.column(f.name)[z], len(part[0])) for f in others]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(v, t) for v, t in zip(part, types))], names=[*(f.name for f in others), "row", "col0", "length", "w"])

    return zones.select(*(f.name for f in others), "polygons").mapInArrow(run, schema)


def cells_of(runs: DataFrame) -> DataFrame:
    """Cells (row, col, w) of coverage runs, with what else they carry."""
    others = [c for c in runs.columns if c not in ("row", "col0", "length", "w")]
    return runs.select(*others, "row", F.explode(F.sequence("col0", F.col("col0") + F.col("length") - 1)).alias("col"), "w")
