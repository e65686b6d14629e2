"""Colour ramps: viridis from every fifth entry of the public table, the others as sixteen entries.

A ramp is a list of (r, g, b); colours between two entries are interpolated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every fifth of the 256 entries of the public matplotlib table; those between are interpolated.
VIRIDIS = (
    (68, 1, 84), (70, 8, 92), (71, 16, 99), (72, 23, 105), (72, 29, 111), (72, 36, 117), (71, 42, 122), (70, 48, 126), (69, 55, 129), (67, 61, 132), (65, 66, 135), (63, 72, 137), (61, 78, 138),
    (58, 83, 139), (56, 89, 140), (53, 94, 141), (51, 99, 141), (49, 104, 142), (46, 109, 142), (44, 113, 142), (42, 118, 142), (41, 123, 142), (39, 128, 142), (37, 132, 142), (35, 137, 142), (33, 142, 141),
    (32, 146, 140), (31, 151, 139), (30, 156, 137), (31, 161, 136), (33, 165, 133), (36, 170, 131), (40, 174, 128), (46, 179, 124), (53, 183, 121), (61, 188, 116), (70, 192, 111), (80, 196, 106), (90, 200, 100),
    (101, 203, 94), (112, 207, 87), (124, 210, 80), (137, 213, 72), (149, 216, 64), (162, 218, 55), (176, 221, 47), (189, 223, 38), (202, 225, 31), (216, 226, 25), (229, 228, 25), (241, 229, 29), (253, 231, 37),
)
#: Sixteen entries each.
PLASMA = (
    (13, 8, 135), (65, 4, 157), (106, 0, 168), (140, 1, 168), (168, 13, 157), (190, 42, 140), (208, 67, 120), (223, 91, 99),
    (234, 115, 78), (242, 139, 58), (248, 163, 40), (251, 188, 26), (252, 212, 18), (250, 237, 18), (240, 249, 33), (240, 249, 33),
)
TURBO = (
    (48, 18, 59), (70, 60, 170), (49, 104, 222), (29, 147, 232), (34, 183, 202), (56, 211, 162), (90, 231, 119), (132, 244, 79),
    (175, 248, 51), (213, 241, 41), (242, 220, 48), (254, 189, 56), (248, 148, 49), (231, 101, 37), (202, 56, 20), (172, 10, 1),
)
HOT = (
    (11, 0, 0), (43, 0, 0), (85, 0, 0), (128, 0, 0), (171, 0, 0), (213, 0, 0), (255, 0, 0), (255, 43, 0),
    (255, 85, 0), (255, 128, 0), (255, 171, 0), (255, 213, 0), (255, 255, 0), (255, 255, 64), (255, 255, 170), (255, 255, 255),
)
#: ColorBrewer's sequential and diverging classes; the last one repeats up to sixteen entries.
CLASSES = {
    "rdylbu": ("#a50026", "#d73027", "#f46d43", "#fdae61", "#fee090", "#ffffbf", "#e0f3f8", "#abd9e9", "#74add1", "#4575b4", "#313695"),
    "spectral": ("#9e0142", "#d53e4f", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#e6f598", "#abdda4", "#66c2a5", "#3288bd", "#5e4fa2"),
    "reds": ("#fff5f0", "#fee0d2", "#fcbba1", "#fc9272", "#fb6a4a", "#ef3b2c", "#cb181d", "#a50f15", "#67000d"),
    "blues": ("#f7fbff", "#deebf7", "#c6dbef", "#9ecae1", "#6baed6", "#4292c6", "#2171b5", "#08519c", "#08306b"),
    "greens": ("#f7fcf5", "#e5f5e0", "#c7e9c0", "#a1d99b", "#74c476", "#41ab5d", "#238b45", "#006d2c", "#00441b"),
    "ylgnbu": ("#ffffd9", "#edf8b1", "#c7e9b4", "#7fcdbb", "#41b6c4", "#1d91c0", "#225ea8", "#253494", "#081d58"),
}
ENTRIES = 16
ALIASES = {"gray": "greys", "grayscale": "greys"}


def parse_hex(text: str) -> tuple[int, int, int]:
    if len(text) != 7 or text[0] != "#":
        raise ValueError(f"{text!r} is not #rrggbb")
    return tuple(int(text[i : i + 2], 16) for i in (1, 3, 5))


def ramp(name: str) -> list[tuple[int, int, int]]:
    """A named ramp: 256 entries for viridis, sixteen for the others."""
    name = ALIASES.get(name.lower(), name.lower())
    if name == "viridis":
        pairs = zip(VIRIDIS, VIRIDIS[1:])
        return [tuple(round(a + (b - a) * k / 5) for a, b in zip(p, q)) for p, q in pairs for k in range(5)] + [VIRIDIS[-1]]
    if name == "greys":
        return [(17 * k,) * 3 for k in range(ENTRIES)]
    own = {"plasma": PLASMA, "turbo": TURBO, "hot": HOT}
    if name in own:
        return list(own[name])
    if name not in CLASSES:
        raise ValueError(f"there is no ramp {name!r}")
    colours = [parse_hex(c) for c in CLASSES[name]]
    return colours + colours[-1:] * (ENTRIES - len(colours))


def sample(colours: list[tuple[int, int, int]], t: Column) -> Column:
    """struct r, g, b of the ramp at t in [0, 1]; interpolated, rounded half up."""
    n = len(colours)
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t.cast("double"))) * (n - 1)
    low = F.least(F.floor(at).cast("int"), F.lit(n - 2))
    channel = {c: F.expr(f"array({', '.join(str(rgb[k]) for rgb in colours)})") for k, c in enumerate("rgb")}
    mixed = lambda t: F.get(t, low) + (F.get(t, low + 1) - F.get(t, low)) * (at - low)
    return F.struct(*(F.round(mixed(t)).cast("int").alias(c) for c, t in channel.items()))
