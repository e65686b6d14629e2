"""Load-run analytics: nearest-rank percentiles, status tallies, phase shares, log attribution and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def nearest_rank(column: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def percentiles(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"), *(nearest_rank(column, q).alias(k) for k, q in PERCENTILES.items()))


def cdf(df: DataFrame, keys: list[str], column: str, points: int = 50) -> DataFrame:
    """The nearest-rank quantiles at 1/points ... 1, a row each."""
    at = [(k + 1) / points for k in range(points)]
    wide = df.groupBy(*keys).agg(F.array(*(F.struct(F.lit(q).alias("q"), nearest_rank(column, q).alias("v")) for q in at)).alias("c"))
    return wide.select(*keys, F.inline("c"))


def tally(df: DataFrame, key: str, bytes_: str) -> DataFrame:
    """requests and bytes of each status or kind."""
    return df.groupBy(key).agg(F.count("*").alias("requests"), F.sum(bytes_).alias("bytes"))


def phase_shares(df: DataFrame, phase: str, column: str) -> DataFrame:
    """Median of each phase, and its share of the medians' sum."""
    medians = df.groupBy(phase).agg(nearest_rank(column, 0.5).alias("p50"), F.count("*").alias("n"))
    return medians.withColumn("share", F.col("p50") / F.sum("p50").over(Window.partitionBy()))


def attribute(log: DataFrame, windows: DataFrame) -> DataFrame:
    """Log lines (ts, key) with the window (name, prefix, t0, t1) they fall in, both ends included.

    The windows' time buckets are exploded first, so the join is on (prefix, hour) and only checks ends."""
    hour = 3600
    spread = windows.withColumn("_hour", F.explode(F.sequence(F.floor(F.unix_timestamp("t0") / hour), F.floor(F.unix_timestamp("t1") / hour))))
    lines = log.withColumn("_hour", F.floor(F.unix_timestamp("ts") / hour))
    return lines.join(spread, ["prefix", "_hour"]).where("ts >= t0 and ts <= t1").drop("_hour")


def unattributed(log: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    return log.join(attribute(log, windows).select(key).distinct(), key, "left_anti")


def saturated(p50_lag: Column, p99_lag: Column, p50_service: Column) -> Column:
    """Whether a run could not keep its rate."""
    return (p99_lag > 10) & (p99_lag > p50_service) | (p50_lag > p50_service)


def approx_equal(a: Column, b: Column, rel: float) -> Column:
    """Within rel of the larger magnitude (1 at least); nulls equal nulls, NaN equals NaN."""
    both = a.isNull() & b.isNull() | F.coalesce(F.isnan(a) & F.isnan(b), F.lit(False))
    return both | F.coalesce(F.abs(a - b) <= rel * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), F.lit(False))


def compare_runs(base: DataFrame, head: DataFrame, key: str, metric: str, share: float = 0.05) -> DataFrame:
    """Both runs' metric by key, the change, and a flag beyond the share."""
    joined = base.select(key, F.col(metric).alias("base")).join(head.select(key, F.col(metric).alias("head")), key)
    change = F.col("head") / F.col("base") - 1
    return joined.withColumn("change", change).withColumn("flag", F.when(change > share, "slower").when(change < -share, "faster").otherwise("same"))


def newest_clean(runs: DataFrame, branch: str, started: str, clean: Column) -> DataFrame:
    """The last clean run of each branch."""
    place = F.row_number().over(Window.partitionBy(branch).orderBy(F.desc(started)))
    return runs.where(clean).withColumn("_n", place).where("_n = 1").drop("_n")


def verdicts(a: DataFrame, b: DataFrame, key: str, value: str, rel: float, known: float) -> DataFrame:
    """pass, known (within a wider tolerance) or fail for each request that either side answered."""
    joined = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    verdict = F.when(approx_equal(F.col("a"), F.col("b"), rel), "pass").when(approx_equal(F.col("a"), F.col("b"), known), "known").otherwise("fail")
    return joined.withColumn("verdict", verdict)


def keep_within(entries: DataFrame, keys: list[str], order: list[Column], size: str, capacity: int) -> DataFrame:
    """The entries that a byte-bounded cache keeps: in the given order of worth, while their running size fits."""
    running = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("running", running).where(F.col("running") <= capacity)


def spans(rows: DataFrame, request: str, phase: str, ms: str, order: str) -> DataFrame:
    """Time of each phase of each request, spans of one name added up, with the place at which the name was first seen."""
    summed = rows.groupBy(request, phase).agg(F.sum(ms).alias("ms"), F.min(order).alias("_first"))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy(request).orderBy("_first", phase)) - 1).drop("_first")


def interpolated(column: str, q: float) -> Column:
    """Percentile between the two nearest ranks."""
    return F.expr(f"percentile({column}, {q})")


def summary(samples: DataFrame, keys: list[str], wall_s: Column, served: Column, latency: str = "service_ms", bytes_: str = "bytes") -> DataFrame:
    """Requests, errors, rates and latencies of each run; only what was served counts for rates, bytes and latencies."""
    ok = samples.withColumn("_ok", F.coalesce(served, F.lit(False))).withColumn("_ms", F.when(F.col("_ok"), F.col(latency)))
    out = ok.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if("_ok").alias("ok"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col(bytes_))), F.lit(0)).alias("bytes"),
        *(nearest_rank("_ms", q).alias(k) for k, q in PERCENTILES.items()), F.first(wall_s).alias("wall_s"),
    )
    rate = lambda c: F.when(F.col("wall_s") > 0, c / F.col("wall_s")).otherwise(0.0)
    return out.withColumn("errors", F.col("requests") - F.col("ok")).withColumn("achieved_rps", rate(F.col("ok"))).withColumn("mb_per_s", rate(F.col("bytes") / 1e6))


def soak(summaries: DataFrame) -> DataFrame:
    """Kilobytes of each served request beside a summary's latencies."""
    return summaries.withColumn("kb_per_request", F.when(F.col("ok") > 0, F.col("bytes") / F.col("ok") / 1024).otherwise(0.0))


def accounted(phases: DataFrame, service: DataFrame, key: str) -> DataFrame:
    """The phases' medians added up, beside the service median, and what share of it they explain."""
    total = phases.groupBy(key).agg(F.sum("p50").alias("accounted"))
    return total.join(service.select(key, F.col("p50").alias("service")), key).withColumn("share", F.when(F.col("service") > 0, F.col("accounted") / F.col("service")))


def near_floor(p50: Column, floor_p50: Column, times: float = 3.0) -> Column:
    """Whether a median tells more of the path than of the server."""
    return F.coalesce(p50 < floor_p50 * times, F.lit(False))


def index_row(summaries: DataFrame, keys: list[str], metrics: list[str], digits: int = 2) -> DataFrame:
    """One map of key/metric to rounded value for a whole run."""
    name = lambda m: F.concat_ws("/", *keys, F.lit(m))
    pairs = summaries.select(F.inline(F.array(*(F.struct(name(m).alias("k"), F.round(F.col(m), digits).alias("v")) for m in metrics))))
    return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metrics"))


def comparable(base: Column, head: Column) -> Column:
    """Why two runs can't be compared, null if they can; each side is a struct with dataset and cpu."""
    return F.when(~base["dataset"].eqNullSafe(head["dataset"]), "another data set").when(~base["cpu"].eqNullSafe(head["cpu"]), "another processor")


def arrivals(n: Column, rate: Column, started: Column) -> Column:
    """When the n-th request of an open loop is due, whatever became of those before."""
    return started + n / rate


def stops(sent: Column, elapsed_s: Column, most: int | None = None, seconds: float | None = None) -> Column:
    """Whether a load run is over, by its number of requests or its duration."""
    over = F.lit(False)
    if most is not None:
        over = over | (sent >= most)
    return over if seconds is None else over | (elapsed_s >= seconds)
