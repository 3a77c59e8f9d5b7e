"""Scoring a run of labelled queries, and comparing it with a run before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``results`` (``n, status, agencies, response``) against ``expected`` (``n, expected_status,
    expected_agencies``): correct if the status is the expected one and, unless that is FAIL, an expected
    agency is among the sources'. Unlisted items are expected OK with no agencies."""
    joined = results.join(expected.select("n", "expected_status", "expected_agencies"), "n", "left")
    wanted = F.coalesce("expected_status", F.lit("OK"))
    status_ok = F.col("status") == wanted
    agency_ok = (wanted == "FAIL") | F.coalesce(F.arrays_overlap("expected_agencies", "agencies"), F.lit(False))
    spurious = F.col("response").contains("^^^FAIL^^^") & F.col("response").rlike(r"\^\^\^\d+\^\^\^")
    return joined.withColumns(
        {"expected_status": wanted, "status_correct": status_ok, "agency_correct": agency_ok, "correct": status_ok & agency_ok, "spurious_fail": F.coalesce(spurious, F.lit(False))}
    )


def summary(judgements: DataFrame) -> DataFrame:
    """One row: items, correct ones, whole percent, mean times (half to even), and the lists of the run."""
    def listed(condition):
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("n")))).cast("array<string>"), ",")

    right = F.sum(F.col("correct").cast("int"))
    return judgements.agg(
        F.count("*").alias("items"), right.alias("correct"), F.floor(right * 100 / F.count("*")).cast("int").alias("percent"),
        F.bround(F.avg("time_s"), 1).alias("mean_time"), F.bround(F.avg("ttfl_s"), 2).alias("mean_ttfl"),
        listed(~F.col("correct")).alias("failed"), listed(F.col("spurious_fail")).alias("spurious"), listed(F.col("status_correct") & ~F.col("agency_correct")).alias("wrong_agency"),
    )


def slowest(judgements: DataFrame, column: str = "time_s", k: int = 5) -> DataFrame:
    return judgements.orderBy(F.desc(column), "n").limit(k).select("n", column)


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(n, change)``: items improved or regressed since the run before; one it lacks and that is correct now is improved."""
    joined = now.select("n", F.col("correct").alias("_now")).join(before.select("n", F.col("correct").alias("_then")), "n", "left")
    then = F.coalesce("_then", F.lit(False))
    change = F.when(F.col("_now") & ~then, "improved").when(~F.col("_now") & then, "regressed")
    return joined.select("n", change.alias("change")).filter(F.col("change").isNotNull())
