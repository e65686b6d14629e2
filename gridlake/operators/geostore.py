"""Named geometries in versioned tables: upserts and deletes with the last change winning, strict lookups, access checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_IDS = 512
ID_PATTERN = r"^[A-Za-z0-9_.:-]{1,128}$"
PROVIDER_PATTERN = r"^[A-Za-z0-9_-]{1,64}$"


def valid_id(c: Column) -> Column:
    return c.rlike(ID_PATTERN) & ~F.contains(c, F.lit(".."))


def valid_provider(c: Column) -> Column:
    return c.rlike(PROVIDER_PATTERN)


def parse_ids(text: Column) -> Column:
    """Sorted distinct ids of a comma-separated list; null if there are too many (before duplicates go) or one is not valid."""
    ids = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    good = (F.size(ids) > 0) & (F.size(ids) <= MOST_IDS) & F.forall(ids, valid_id)
    return F.when(good, F.array_sort(F.array_distinct(ids)))


def last_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return changes.withColumn("_n", place).where("_n = 1").drop("_n")


def upsert(store: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """store after changes (the store's columns and order): what changed replaces what was there, as one whole."""
    newest = last_changes(changes, keys, order)
    return store.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*store.columns))


def delete(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def missing_ids(requests: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that the store lacks; a request with any is refused as a whole."""
    return requests.join(store.select(*keys).distinct(), keys, "left_anti")


def resolve(requests: DataFrame, store: DataFrame, keys: list[str], request: str) -> DataFrame:
    """Rows of the requests all of whose keys exist."""
    refused = missing_ids(requests, store, keys).select(request).distinct()
    return requests.join(refused, request, "left_anti").join(store, keys)


def union_geometry(resolved: DataFrame, request: str) -> DataFrame:
    """Each request's polygons, put together."""
    return resolved.groupBy(request).agg(F.flatten(F.collect_list("polygons")).alias("polygons"))


def allowed(asked: Column, granted: Column) -> Column:
    """All that is asked is granted; ids are compared as text."""
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    return F.size(F.array_except(text(asked), text(granted))) == 0


def resolve_status(code: Column) -> Column:
    return F.when(code.between(200, 299), "ok").when(code.isin(401, 403), "forbidden").when(code == 404, "not found").otherwise("upstream")


def cacheable(code: Column) -> Column:
    """Answers and refusals are kept; outages are not."""
    return code.between(200, 299) | code.isin(401, 403, 404)


def live(entries: DataFrame, stored_at: str, now: Column, ttl_seconds: int) -> DataFrame:
    return entries.where(F.unix_timestamp(now) - F.unix_timestamp(stored_at) < ttl_seconds)


def reference_problem(literal: Column, provider: Column, ids: Column) -> Column:
    """Why a clip can't be told from its parameters, null if it can: a provider and ids go together, and never with a literal shape."""
    both = provider.isNotNull() & ids.isNotNull()
    return (
        F.when(provider.isNotNull() & ids.isNull(), "a provider needs ids").when(ids.isNotNull() & provider.isNull(), "ids need a provider").when(both & literal.isNotNull(), "a shape and a provider both name the clip")
    )


def answer_allows(body: Column, asked: Column) -> Column:
    """Whether the body of a 2xx access answer grants all that was asked: nothing or no JSON says yes; a boolean, `allowed`, or a list (bare, `allowed` or `ids`) says which."""
    text = F.trim(F.coalesce(body, F.lit("")))
    member = lambda path: F.get_json_object(text, path)
    flag = F.coalesce(F.when(text.isin("true", "false"), text), member("$.allowed"))
    listed = lambda t: F.from_json(F.when(t.startswith("["), t), "array<string>")
    have = F.coalesce(listed(member("$.allowed")), listed(member("$.ids")), listed(text))
    return F.when(flag == "true", True).when(flag == "false", False).when(have.isNotNull(), F.size(F.array_except(asked, have)) == 0).otherwise(True)


def cache_key(*parts: Column) -> Column:
    """Parts joined by a character that names and ids can't hold."""
    return F.concat_ws("|", *parts)


def id_list(ids: Column) -> Column:
    """Ids given as an array, as the comma-separated text of a request."""
    return F.array_join(F.transform(ids, lambda i: F.trim(i.cast("string"))), ",")
