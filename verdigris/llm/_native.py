"""Helpers for expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: White space of the word rule: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row.

    A lambda of a higher-order function re-evaluates every outer expression
    that it names for each element; binding the value as a lambda variable
    itself avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in but]


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` that also bears column names with dots."""
    safe = lambda c: c.replace(".", "\u2024")
    out = T.StructType([T.StructField(safe(f.name), f.dataType) for f in schema.fields])
    return df.toDF(*map(safe, df.columns)).mapInArrow(run, out).toDF(*schema.names)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: an eager reliable checkpoint in the shared folder that the session names.

    Without a named folder only a local session gets one of its own; on a
    cluster the executors could not read it.
    """
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdigris-ckpt-"))
    return df.checkpoint(eager=True)


#: Bytes of a table that a join may broadcast.
SMALL = 16 << 20


def meet(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that is often small: broadcast if measured at ``SMALL`` bytes or less, else shuffled.

    ``few`` is checkpointed, measured, and read from the checkpoint.
    """
    few = cut(few)
    if fits(few):
        return rows.join(F.broadcast(few), on, how)
    return rows.join(few, on, how)


def fits(few: DataFrame) -> bool:
    """Whether a table takes at most ``SMALL`` bytes as text, with 32 bytes more a row."""
    return (few.agg(F.sum(F.octet_length(F.to_json(F.struct(*columns(few)))) + 32).alias("n")).first()["n"] or 0) <= SMALL
