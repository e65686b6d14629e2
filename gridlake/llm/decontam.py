"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become arrays of word hashes, then hashes of K = 5 words. Of every W = 6 neighbouring ones the least is kept, so
every 10 words that a document shares with an item keep a common fingerprint at the same place (K + W - 1 = 10). Document and
benchmark fingerprints are joined; around each hit the neighbouring words, carried with the fingerprint, are compared and
the hit is extended by up to five words to either side. A stretch of 10 equal words or more is an occurrence of item
windows; the union of the stretches is what is hit. Items of fewer than 10 words are one window each and are joined on
the hash of all their words, all lengths in one pass. Item fingerprints are broadcast only if their number, counted first, is at most
`broadcast_rows`; else Spark joins by shuffle.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Defined results: null and empty texts have no words and
no hit, null items no window; repeated documents are judged each and repeated items count by item_id; items without an item_id are left out; empty tables give no rows, or no hits; extra columns are kept by flag() unless they clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import lower_ascii, scratch, stored

K = 5
W = 6
WINDOW = K + W - 1
PLACE_BITS = 30  # of a packed fingerprint; the rest are bits of the hash
BROADCAST_ROWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_CELLS = 1 << 18
TALLY = -(1 << 62)  # no fingerprint: those have fewer bits


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def hashes(text: Column) -> Column:
    """Hash of each word of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _grams(h: Column) -> Column:
    """Packed (hash, place) of every K words; place counts words from 0."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (K - 1), F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(*(F.get(h, i + k) for k in range(K))), PLACE_BITS).bitwiseOR(i.cast("long")))


def _winnow(grams: Column) -> Column:
    least = F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - (W - 1), F.lit(0))), lambda x, i: F.least(*(F.get(grams, i + k) for k in range(W))))
    return F.array_distinct(least)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _fingerprint(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _around(h: Column, place: Column) -> Column:
    """The words from W - 1 before a fingerprint to W - 1 after it; null beyond the text's ends."""
    return F.array(*(F.when(place + k >= 0, F.get(h, F.greatest(place + k, F.lit(0)))) for k in range(1 - W, K + W - 1)))


def _cells(prints: DataFrame, limit: int) -> Column | None:
    """A bitmap of the items' fingerprints as a literal, if there are at most `limit` (counted first)."""
    rows = prints.select("fp").distinct().limit(limit + 1).toArrow().column("fp").to_pylist()
    if len(rows) > limit:
        return None
    return _bitmap(rows)


def _bitmap(rows: list[int]) -> Column:
    size = max(64, min(MOST_CELLS, 1 << (32 * len(rows)).bit_length()))
    words = [0] * (size // 64)
    for fp in rows:
        cell = fp & (size - 1)
        words[cell >> 6] |= 1 << (cell & 63)
    return F.array(*(F.lit(w - (1 << 64) if w >> 63 else w) for w in words))


def _held(value: Column, cells: Column) -> Column:
    """Whether a bitmap has the value's cell."""
    cell = value.bitwiseAND(F.size(cells).cast("long") * 64 - 1)
    word = F.get(cells, F.shiftright(cell, 6).cast("int"))
    return F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", word, cell.bitwiseAND(F.lit(63)).cast("int"))) == 1


def _winnowed(hashed: DataFrame, cells: Column | None = None, tally: bool = False) -> DataFrame:
    """One row per fingerprint: the frame's columns but h, and fp, place, around; with cells, only those that the bitmap has.

    With tally, each text adds a row with the fingerprint TALLY and its number of words as place."""
    kept = [c for c in hashed.columns if c != "h"]
    with_grams = hashed.withColumn("g", F.when(F.size("h") >= WINDOW, _grams(F.col("h"))).otherwise(F.array().cast("array<long>")))
    packed = _winnow(F.col("g"))
    if cells is not None:
        with_cells = with_grams.withColumn("g", packed).withColumn("cells", cells)
        with_grams, packed = with_cells, F.filter("g", lambda p: _held(_fingerprint(p), F.col("cells")))
    rows = F.transform(packed, lambda p: F.struct(_fingerprint(p).alias("fp"), _place(p).alias("place"), _around(F.col("h"), _place(p)).alias("around")))
    if tally:
        rows = F.concat(rows, F.array(F.struct(F.lit(TALLY).alias("fp"), F.size("h").alias("place"), F.array().cast("array<long>").alias("around"))))
    return with_grams.select(*kept, F.inline(rows))


def _short_hits(hashed: DataFrame, short: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """Hits of the items that have fewer words than a window: every run of so many words whose hash the items' bitmap has, in one pass."""
    whole = lambda h, i, m: F.xxhash64(F.lit(m), *(F.get(h, i + k) for k in range(m)))
    lengths = [r["m"] for r in short.select(F.size("h").alias("m")).distinct().collect()]  # at most WINDOW - 1
    if not lengths:
        return None
    keyed = reduce(lambda rest, m: F.when(F.size("h") == m, whole(F.col("h"), F.lit(0), m)).otherwise(rest), lengths, F.lit(None).cast("long"))
    keys = stored(short.select("item_id", F.size("h").alias("m"), keyed.alias("key")).distinct(), "decontam-short")
    known = keys.select("key").distinct().limit(broadcast_rows + 1).toArrow().column("key").to_pylist()
    few = len(known) <= broadcast_rows
    spots = hashed.withColumn("cells", _bitmap(known)) if few else hashed

    def places(m: int) -> Column:
        at = F.transform(F.slice("h", 1, F.greatest(F.size("h") - (m - 1), F.lit(0))), lambda x, i: F.struct(F.lit(m).alias("m"), i.alias("first"), whole(F.col("h"), i, m).alias("key")))
        return F.filter(at, lambda p: _held(p["key"], F.col("cells"))) if few else at

    spots = spots.select("row", F.inline(F.concat(*map(places, lengths))))
    return spots.join(F.broadcast(keys) if few else keys, ["m", "key"]).select("row", "item_id", "first", (F.col("first") + F.col("m")).alias("end"))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, item_id, first, end) of every stretch of document words that item windows cover; docs has row and text.

    Each document also has a row with a null item_id, whose end is its number of words. The table is stored."""
    items = stored(benchmark.select(F.col("item_id").cast("string").alias("item_id"), hashes(F.col("text")).alias("h")).where("item_id is not null and size(h) > 0"), "decontam-items")
    prints = stored(_winnowed(items).select("item_id", "fp", F.col("around").alias("item_around")).distinct(), "decontam-prints")
    hashed = docs.select("row", hashes(F.col("text")).alias("h"))
    marker = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("item_id"), F.lit(TALLY).alias("fp"), F.array().cast("array<long>").alias("item_around"))

    cells = _cells(prints, broadcast_rows)
    table = prints.unionAll(marker)
    pairs = _winnowed(hashed, cells, tally=True).join(table if cells is None else F.broadcast(table), "fp")
    same = lambda k: F.coalesce(F.get("around", F.lit(k)) == F.get("item_around", F.lit(k)), F.lit(False))
    left = right = F.lit(0)
    for k in range(W - 1, 0, -1):  # equal words next to the K in the middle, inside out
        left = F.when(same(W - 1 - k), 1 + left).otherwise(0)
        right = F.when(same(W - 2 + K + k), 1 + right).otherwise(0)
    middle = F.lit(True)
    for k in range(K):
        middle = middle & same(W - 1 + k)
    total = F.col("fp") == TALLY
    stretch = pairs.where(total | middle).select("row", "item_id", F.when(total, 0).otherwise(F.col("place") - left).alias("first"), F.when(total, F.col("place")).otherwise(F.col("place") + K + right).alias("end"), total.alias("total"))
    found = stretch.where(F.col("total") | (F.col("end") - F.col("first") >= WINDOW)).drop("total")

    short = _short_hits(hashed, items.where(F.size("h") < WINDOW), broadcast_rows)
    return stored(found if short is None else found.unionByName(short), "decontam-hits", keep=True)


def _covered(stretches: Column) -> Column:
    """How many places an ascending array of (first, end) covers."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["first"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(stretches, start, step, lambda s: s["n"])


def judge(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each distinct document (row: doc_id and hash of the text): copies, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    with scratch(docs.sparkSession):
        found = hits(docs.select(key.alias("row"), "text"), benchmark, broadcast_rows)
    total = found.where("item_id is null and first = 0").groupBy("row").agg(F.count("*").alias("copies"), F.max("end").alias("n_words"))
    stretches = found.where("item_id is not null")
    spans = stretches.groupBy("row", "first").agg(F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    items = stretches.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = total.join(spans.join(items, "row"), "row", "left")
    n_hit = F.coalesce(_covered(F.col("spans")).cast("long"), F.lit(0).cast("long"))
    return out.select(
        "row", "copies", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )


def flag(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and spans (the stretches' words, end exclusive)."""
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans").withColumn("_hash", F.xxhash64("text"))
    judged = judge(docs, benchmark, broadcast_rows).drop("copies").withColumnRenamed("row", "_row")
    same = F.col("_row.id").eqNullSafe(F.col("doc_id")) & (F.col("_row.hash") == F.col("_hash"))
    return docs.join(judged, same, "left").drop("_row", "_hash")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    each = judged.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("row.id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS t FROM item WHERE len(w) > 0),
size AS (SELECT DISTINCT m FROM win),
spot AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS t FROM fold, size WHERE len(w) >= m),
hit AS (SELECT spot.doc_id, spot.i, spot.m, win.item_id FROM spot JOIN win ON win.t = spot.t AND win.m = spot.m),
place AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT fold.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(place.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(place.n, 0) > 0 AS contaminated
FROM fold LEFT JOIN place USING (doc_id) LEFT JOIN items USING (doc_id)
"""
