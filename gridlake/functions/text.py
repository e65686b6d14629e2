"""Small text functions: sizes, media types, fingerprints, templates, timing headers and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_size(text: Column) -> Column:
    """Bytes of "256M", "64k", "1G" or a plain number; null otherwise."""
    number = F.regexp_extract(text, r"^\s*(\d+)\s*([KkMmGg]?)[Bb]?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*(\d+)\s*([KkMmGg]?)[Bb]?\s*$", 2))
    shift = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(number != "", F.expr("0L") + number.try_cast("long") * shift)


def media_type(text: Column) -> Column:
    return F.lower(F.trim(F.get(F.split(text, ";"), F.lit(0))))


def fingerprint(secret: Column) -> Column:
    """128 bits of SHA-256 in hex; no secret is "anon"."""
    return F.when(secret.isNull() | (secret == ""), "anon").otherwise(F.substring(F.sha2(secret, 256), 1, 32))


def fill_template(template: Column, ids: Column) -> Column:
    """URLs with {id} for a single id or {ids} for all."""
    return F.replace(F.replace(template, F.lit("{ids}"), F.array_join(ids, ",")), F.lit("{id}"), F.coalesce(F.get(ids, F.lit(0)), F.lit("")))


def registry_line(line: Column) -> dict[str, Column]:
    """name=url;key=value;... of a provider registry."""
    parts = F.split(line, ";")
    head = F.get(parts, F.lit(0))
    options = F.array_join(F.slice(parts, 2, F.size(parts)), ";")
    return {"name": F.trim(F.substring_index(head, "=", 1)), "url": F.trim(F.regexp_replace(head, r"^[^=]*=", "")), "options": F.str_to_map(options, F.lit(";"), F.lit("="))}


def server_timing(header: Column) -> Column:
    """array<struct<phase, ms>> of a Server-Timing header; metrics without a duration are left out."""
    parts = F.transform(F.split(header, ","), lambda x: F.trim(x))
    read = F.transform(parts, lambda p: F.struct(F.trim(F.get(F.split(p, ";"), 0)).alias("phase"), F.regexp_extract(p, r"dur=([0-9.]+)", 1).try_cast("double").alias("ms")))
    return F.filter(read, lambda s: s["ms"].isNotNull())


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """ts, method, uri, status, bytes of access-log lines `ts method "uri" status bytes ...`; others are left out."""
    pattern = r'^(\S+) (\S+) "([^"]*)" (\d+) (\d+)'
    part = lambda k: F.regexp_extract(column, pattern, k)
    good = lines.where(F.col(column).rlike(pattern))
    return good.select(part(1).alias("ts"), part(2).alias("method"), part(3).alias("uri"), part(4).cast("int").alias("status"), part(5).cast("long").alias("bytes"))


def source_url(name: Column, server: str) -> Column:
    """Where a source's name points: URLs stay, file names go under the server."""
    return F.when(name.rlike("^(https?|file)://"), name).otherwise(F.concat(F.lit(server.rstrip("/") + "/"), F.url_encode(name)))


def query_string(params: Column) -> Column:
    """k=v&k=v of a map, keys in order; null values are left out."""
    entries = F.array_sort(F.filter(F.map_entries(params), lambda e: e["value"].isNotNull()))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


#: Names of a TIFF's photometric interpretations.
PHOTOMETRIC = {0: "miniswhite", 1: "minisblack", 2: "rgb", 3: "palette", 4: "mask", 6: "ycbcr"}


def photometric(code: Column) -> Column:
    name = F.lit("other")
    for k, v in PHOTOMETRIC.items():
        name = F.when(code == k, v).otherwise(name)
    return name


def server_timing_header(phases: Column) -> Column:
    """The header of array<struct<phase, ms>>."""
    return F.array_join(F.transform(phases, lambda p: F.concat(p["phase"], F.lit(";dur="), F.format_number(p["ms"], 3))), ", ")
