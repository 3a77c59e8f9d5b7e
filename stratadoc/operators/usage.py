"""Usage: counters by day and hour, filters, quotas, undo and the dashboard's series. Counters are
aggregates of signed event rows, never a document that is rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAILY_LIMIT = 20


def by_day(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.filter(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def by_hour(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.filter(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "HH").alias("hour")).agg(F.count("*").alias("n"))


def filter_use(requests: DataFrame, facets: tuple[str, ...] = ("agency", "jurisdiction", "state", "locality")) -> DataFrame:
    """``(filter, n)``: how many requests use each facet, and how many none."""
    given = [F.when(F.coalesce(f"filter_{f}", F.lit("")) != "", F.lit(f)) for f in facets]
    used = F.array_compact(F.array(*given))
    return requests.select(F.explode(F.when(F.size(used) > 0, used).otherwise(F.array(F.lit("unfiltered")))).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))


def series(counts: DataFrame, last: Column, days: int = 30) -> DataFrame:
    """``(day, n)``: the ``days`` days up to ``last``, 0 where nothing was counted."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def totals(counts: DataFrame, last: Column) -> DataFrame:
    """Total of the last seven days and of all days."""
    day = F.to_date("day")
    return counts.agg(F.coalesce(F.sum(F.when((day > F.date_sub(last, 7)) & (day <= last), F.col("n"))), F.lit(0)).alias("week"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def net_counts(deltas: DataFrame, keys: list[str], delta: str = "delta") -> DataFrame:
    """Counters from signed deltas, undone ones subtracted, never below 0."""
    return deltas.groupBy(*keys).agg(F.greatest(F.sum(delta), F.lit(0)).alias("n"))


def within_quota(events: DataFrame, client: str, ts: str, tie: str, limit: int = DAILY_LIMIT, exempt: tuple[object, ...] = (), parts: int = 32) -> DataFrame:
    """``events`` with ``allowed``: the first ``limit`` of each client and day by ``ts`` and ``tie``, all of exempt clients.

    The last allowed event of a client's day is found in two steps, the first ``limit`` of each of ``parts`` parts and
    then of those, where every task keeps no more than that; events are then compared with it. So a client with a
    large share of all events is neither sorted nor held in one task.
    """
    day, at = F.to_date(ts).alias("_day"), F.struct(ts, tie).alias("_at")
    dealt = events.select(F.col(client).alias("_client"), day, at, F.pmod(F.xxhash64(tie), F.lit(parts)).alias("_part"))
    first = F.row_number().over(Window.partitionBy("_client", "_day", "_part").orderBy("_at"))
    some = dealt.withColumn("_n", first).filter(F.col("_n") <= limit).drop("_n")
    place = F.row_number().over(Window.partitionBy("_client", "_day").orderBy("_at"))
    last = some.withColumn("_n", place).filter(F.col("_n") <= limit).groupBy("_client", "_day").agg(F.max("_at").alias("_last"))
    joined = events.withColumn("_today", F.to_date(ts)).join(last, F.col(client).eqNullSafe(F.col("_client")) & F.col("_today").eqNullSafe(F.col("_day")), "left")
    free = F.coalesce(F.col(client).isin(*exempt), F.lit(False)) if exempt else F.lit(False)
    return joined.withColumn("allowed", free | (F.struct(ts, tie) <= F.col("_last"))).drop("_today", "_client", "_day", "_last")
