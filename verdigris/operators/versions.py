"""Version ranges, hops and as-of resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def in_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    """The half-open range (low, high]."""
    return rows.where((F.col("sortable") > low) & (F.col("sortable") <= high))


def classified(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """An empty list, or a null classification, passes."""
    if not wanted:
        return rows
    return rows.where(F.col("classification").isNull() | F.col("classification").isin(wanted))


def resolve(requests: DataFrame, versions: DataFrame, direction: str) -> DataFrame:
    """As-of lookup: each (request_id, framework, requested) with its version.

    ``exact``, ``floor`` (highest at or below) or ``ceil`` (lowest at or above,
    else the highest of all, flagged as ahead of the catalogue).  A framework's
    versions are one short sorted list, so a request meets one row, not all
    versions.
    """
    lists = versions.groupBy("framework").agg(F.sort_array(F.collect_set("sortable")).alias("all"))
    at = F.col("requested")
    below, above = F.array_max(F.filter("all", lambda v: v <= at)), F.array_min(F.filter("all", lambda v: v >= at))
    resolved = {"exact": F.when(above == at, above), "floor": below, "ceil": F.coalesce(above, F.array_max("all"))}[direction]
    ahead = above.isNull() & F.col("all").isNotNull() if direction == "ceil" else F.lit(False)
    return requests.join(lists, "framework", "left").select(
        "request_id", "framework", "requested", resolved.alias("resolved"),
        F.coalesce(resolved != at, F.lit(False)).alias("rounded"), ahead.alias("ahead_of_catalogue"),
    )


def hops(versions: DataFrame, key: str = "sortable") -> DataFrame:
    """Consecutive versions of each framework."""
    w = Window.partitionBy("framework").orderBy(key)
    return versions.select("framework", F.col(key).alias("hop_from"), F.lead(key).over(w).alias("hop_to")).where("hop_to is not null")


def on_path(contexts: DataFrame, versions: DataFrame) -> DataFrame:
    """(context_id, framework, sortable): the versions in each context's range (from, to].

    A range join without comparing all pairs: a framework's versions are one
    short sorted list, of which a context keeps its part.
    """
    lists = versions.groupBy("framework").agg(F.sort_array(F.collect_set("sortable")).alias("all"))
    inside = F.filter("all", lambda v: (v > F.col("from_sortable")) & (v <= F.col("to_sortable")))
    return contexts.join(lists, "framework").select("context_id", "framework", F.explode(inside).alias("sortable"))


def checked_range(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Each requested range (request_id, framework, low, high) with what is wrong with it, null if nothing is.

    ``reversed``, else ``unknown_from``, else ``unknown_to``, else ``too_few``
    (less than two versions).
    """
    lists = versions.groupBy("framework").agg(F.collect_set("sortable").alias("all"))
    met = requests.join(lists, "framework", "left").withColumn("all", F.coalesce("all", F.array().cast("array<bigint>")))
    inside = F.size(F.filter("all", lambda v: (v >= F.col("low")) & (v <= F.col("high"))))
    fault = (
        F.when(F.col("low") > F.col("high"), "reversed").when(~F.array_contains("all", F.col("low")), "unknown_from")
        .when(~F.array_contains("all", F.col("high")), "unknown_to").when(inside < 2, "too_few")
    )
    return met.select("request_id", "framework", "low", "high", fault.alias("fault"))
