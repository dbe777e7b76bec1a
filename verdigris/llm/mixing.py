"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Sources in code point order (null last) weigh 1, 2, 3, repeating.  Their
targets share all words by weight, none over ``LIMIT`` times its source's
size; what is over is shared again by weight.  A source gives ``floor(target /
size)`` whole copies of each document; the words that remain are a draw
without replacement from the source.  Documents are dealt to output shards by
a hash, and the draw is split down a tree whose leaves are the shards: at each
node one multivariate-hypergeometric draw, seeded by seed, source and node,
deals the node's quota to its at most ``FANOUT`` children by their sizes, so
the quotas of the shards add up exactly.  A draw is a sequence of univariate
ones, exact at any size: the library's where the units of a draw are few
enough for it, else by rejection from the same distribution.  In a shard the documents of a source
stand in the order of a hash, a random permutation, and are taken in that
order until the quota is met.  The one document where a shard's quota ends is
taken whole or left out: of these, in the order of a hash of the shard, a
source takes as many as its quotas held of them together, and only the last
of the source is taken in part.  So a shard misses its quota by less than a
document and a source its target not at all.  ``__place`` orders a shard for
its local shuffle.

Defined results
    Size: words ``[^\\x20\\x09-\\x0D]+``; 0 for null or empty texts, of which
    nothing is taken.  A null source is a source of its own, the last.  Empty
    table, or no words at all: targets of 0.  Repeated rows are rows like any
    other; as they tie in their shard's order, which of them is taken first is
    no difference.  The same input gives the same result on every run.  Other
    columns pass through; internal columns have names with ``__``.

Scale
    A hot source is dealt to all shards; a group of the window is one source
    in one shard, about ``SHARD`` documents at most.  The tree's groups have
    at most ``FANOUT`` rows; the ends of quotas, one per source and shard, are
    ordered in groups of about the square root of the shards.  The table of
    sources is ordered by ranges: running sums within a range, and over the
    ranges' sums (one row to a range) between them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._native import SPACE, columns, cut

LIMIT = 3
FANOUT = 256
#: Documents to a shard.
SHARD = 512
#: Units of a draw that the library's sampler takes.
_MOST = 10**9


def size_of(text: Column) -> Column:
    """Number of words."""
    t = F.coalesce(text, F.lit(""))
    ends = t.rlike(r"^[\x20\x09-\x0D]").cast("int") + t.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, SPACE, -1)) - ends).cast("long")


def _running(rows: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """``rows`` in ``order`` with sums over all rows before each (``order`` is unique), without one task for all."""
    placed = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    whole = placed.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = Window.orderBy("__range")  # one row for each range
    starts = whole.select("__range", *[before(ranges, f"__{n}").alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order)
    met = placed.join(F.broadcast(starts), "__range")  # one row for each partition
    return met.select(*rows.columns, *[(F.col(f"__{n}") + before(inside, c)).alias(n) for n, c in sums.items()])


def targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(s, source_size) with target, whole copies and the words that remain.

    Target ``t`` is ``min(most, level * w)``; ``level`` is the one at which the
    targets add up to all words, found in the order of ``most / w``.
    """
    one = sizes.select("s", F.col("source_size").cast("decimal(38,0)").alias("source_size"), F.lit(1).cast("long").alias("one"))
    ranked = cut(
        _running(one, ["s"], rank="one")
        .withColumn("w", F.col("rank") % 3 + 1)
        .withColumn("most", limit * F.col("source_size"))
        .withColumn("room", F.col("most").cast("double") / F.col("w"))
        .select("s", "source_size", "w", "most", "room")
    )
    total = ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w"))
    level = (
        _running(ranked, ["room", "s"], used="most", used_w="w")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("level", (F.col("total") - F.col("used")).cast("double") / (F.col("all_w") - F.col("used_w")))
        .where("level <= room")
        .agg(F.min_by("level", F.struct("room", "s")).alias("level"))
    )
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("w"))
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size.cast("double"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - (F.col("whole") * size).cast("double")).cast("long")
    return (
        ranked.crossJoin(F.broadcast(level))  # one row
        .select("s", size.cast("long").alias("source_size"), F.coalesce(target, F.lit(0.0)).alias("target"))
        .withColumn("whole", whole)
        .withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("source_size"))))
        .select("s", "source_size", "target", "whole", "rest")
    )


def _log_ratio(a: int, d: np.ndarray) -> np.ndarray:
    """``log((a + d)! / a!) - d log(a + 1)`` without the loss of two large logarithms (Stirling's series)."""
    x, y = a + 1.0, a + 1.0 + d
    series = lambda v: 1 / (12 * v) - 1 / (360 * v**3) + 1 / (1260 * v**5)
    return (y - 0.5) * np.log1p(d / x) - d + series(y) - series(x)


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` units, drawn without replacement from ``good + bad``, are good; exact at any size."""
    good, bad, n = int(good), int(bad), int(n)
    if good + bad < _MOST:
        return int(rng.hypergeometric(good, bad, n))
    if n > good + bad - n:  # count those left instead
        return good - hypergeometric(good, bad, good + bad - n, rng)
    if good > bad:
        return n - hypergeometric(bad, good, n, rng)
    if good > n:  # the roles of drawn and good are alike
        good, bad, n = n, good + bad - n, good
    # now good <= n <= half of all; a unit of the good ones is drawn with chance n / all
    all_ = good + bad
    low, high = max(0, n - bad), good
    mode = (n + 1) * (good + 1) // (all_ + 2)
    sd = math.sqrt(max(n / all_ * (1 - n / all_) * good * (all_ - good) / (all_ - 1), 0.0) + 0.5)
    parts = ((mode, 1), (good - mode, -1), (n - mode, -1), (bad - n + mode, 1))
    slope = math.log(((good - mode + 1) * (n - mode + 1)) / ((mode + 1) * (bad - n + mode + 1)))

    def log_weight(x: np.ndarray) -> np.ndarray:
        """Log of the probability of ``x`` over that of the mode."""
        d = (x - mode).astype(np.float64)
        return d * slope - sum(_log_ratio(a, sign * d) for a, sign in parts)

    if sd < 1000:
        x = np.arange(max(low, mode - int(12 * sd) - 12), min(high, mode + int(12 * sd) + 12) + 1)
        weight = np.cumsum(np.exp(log_weight(x)))
        return int(x[np.searchsorted(weight, rng.random() * weight[-1], "right")])
    # ratio of uniforms under a table of this width, which lies over any such distribution
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    centre = n * good / all_ + 0.5
    while True:
        u = 1 - rng.random(64)
        x = np.floor(centre + width * (rng.random(64) - 0.5) / u)
        inside = (x >= low) & (x <= high)
        x, u = x[inside].astype(np.int64), u[inside]
        taken = x[2 * np.log(u) <= log_weight(x)]
        if len(taken):
            return int(taken[0])


def draw(sizes: np.ndarray, quota: int, seed: int) -> np.ndarray:
    """A multivariate-hypergeometric draw of ``quota`` units, one colour after another."""
    rng = np.random.default_rng(seed & (2**63 - 1))
    out, left, after = np.zeros(len(sizes), np.int64), int(quota), sum(map(int, sizes))
    for i, size in enumerate(map(int, sizes)):
        after -= size
        out[i] = hypergeometric(size, after, left, rng) if left else 0
        left -= int(out[i])
    return out


def _split(children: pd.DataFrame) -> pd.DataFrame:
    children = children.sort_values("node")
    first = children.iloc[0]
    sizes = children["size"].to_numpy(np.int64)
    out = draw(sizes, int(first["quota"]), int(first["seed"]))
    return pd.DataFrame({"s": children["s"], "node": children["node"], "quota": out})


def quotas(blocks: DataFrame, rest: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(s, node, quota): the words each shard draws of each source."""
    depth = max(1, math.ceil(math.log(max(shards, 2), FANOUT) - 1e-9))
    given = rest.select("s", F.lit(0).cast("long").alias("node"), F.col("rest").alias("quota"))
    for level in range(depth):
        width = FANOUT ** (depth - 1 - level)
        children = blocks.groupBy("s", F.floor(F.col("shard") / width).cast("long").alias("node")).agg(F.sum("size").alias("size"))
        parents = given.select("s", F.col("node").alias("parent"), "quota", F.xxhash64(F.lit(seed), F.lit(level), "s", "node").alias("seed"))
        given = (
            children.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long"))
            .join(parents, ["s", "parent"])
            .groupBy("s", "parent")
            .applyInPandas(_split, "s string, node long, quota long")
        )
    return given


def settle(ends: DataFrame, shards: int) -> DataFrame:
    """(s, shard, give): the words taken of each document where a quota ends (its size z, quota p).

    Along a hash, whole ones as long as the source's sum of ``p`` lasts.  First
    groups of shards are given their words, then the shards of each group.
    """
    width = max(1, math.isqrt(shards))
    none = F.lit(0).cast("long")
    hashed = ends.withColumn("u", F.xxhash64(F.lit(3), "s", "shard")).withColumn("g", F.pmod("u", F.lit(width).cast("long")))

    def give(of: Window, order: list[str], left) -> Column:
        before = F.coalesce(F.sum("z").over(of.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), none)
        return F.least(F.col("z"), F.greatest(none, left - before))

    source = Window.partitionBy("s")
    groups = hashed.groupBy("s", "g").agg(F.sum("z").alias("z"), F.sum("p").alias("p"))
    groups = groups.select("s", "g", give(source, ["g"], F.sum("p").over(source)).alias("left"))
    return hashed.join(groups, ["s", "g"]).select("s", "shard", give(Window.partitionBy("s", "g"), ["u", "shard"], F.col("left")).alias("give"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, shard_rows: int = SHARD) -> DataFrame:
    """The documents with what the mix takes of them, in columns with ``__``.

    ``__size``, ``__source_size``, ``__target``, ``__whole`` copies and
    ``__part`` words more (``__taken`` in all), ``__shard`` and ``__place``.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    body = F.coalesce(F.col(text), F.lit(""))
    known = docs.select(
        "*",
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("__s"),
        size_of(F.col(text)).alias("__size"),
        F.xxhash64(F.lit(seed), F.col(key), body).alias("__h"),
    ).withColumn("__shard", F.pmod(F.xxhash64(F.lit(1), "__h"), F.lit(shards).cast("long")))
    small = cut(known.select("__s", "__shard", "__h", "__size"))
    blocks = cut(small.groupBy(F.col("__s").alias("s"), F.col("__shard").alias("shard")).agg(F.sum("__size").alias("size")))
    plan = cut(targets(blocks.groupBy("s").agg(F.sum("size").alias("source_size"))))
    shares = cut(
        quotas(blocks, plan, shards, seed)
        .join(plan, "s")
        .select(
            F.col("s").alias("__s"), F.col("node").alias("__shard"), F.col("quota").alias("__quota"), F.col("source_size").alias("__source_size"),
            F.col("target").alias("__target"), F.col("whole").alias("__whole"),
        )
    )
    order = Window.partitionBy("__s", "__shard").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    part = F.least(F.col("__size"), F.greatest(F.lit(0).cast("long"), F.col("__quota") - F.coalesce(F.sum("__size").over(order), F.lit(0).cast("long"))))
    at_end = (F.col("__part") > 0) & (F.col("__part") < F.col("__size"))
    ends = small.join(shares.select("__s", "__shard", "__quota"), ["__s", "__shard"]).withColumn("__part", part).where(at_end)
    gives = settle(ends.select(F.col("__s").alias("s"), F.col("__shard").alias("shard"), F.col("__size").alias("z"), F.col("__part").alias("p")), shards)
    shares = cut(shares.join(gives.select(F.col("s").alias("__s"), F.col("shard").alias("__shard"), F.col("give").alias("__give")), ["__s", "__shard"], "left"))
    return (
        known.join(shares, ["__s", "__shard"])
        .withColumn("__part", part)
        .withColumn("__part", F.when(at_end, F.col("__give")).otherwise(F.col("__part")))
        .withColumn("__taken", F.col("__whole") * F.col("__size") + F.col("__part"))
        .withColumn("__place", F.xxhash64(F.lit(2), "__h"))
        .drop("__s", "__h", "__quota", "__give")
    )


def materialise(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """One row per copy that the mix takes, a part holding the first words of its text.

    Adds ``shard``, ``place``, ``copy`` and ``taken`` (words of this copy), in
    the place of columns that were so named.
    """
    added = ("shard", "place", "copy", "taken")
    mixed = mix(docs, text=text, **how)
    last = F.col("__copy") == F.col("__whole")
    head = F.array_join(F.slice(F.filter(F.split(F.col(text), SPACE), lambda w: w != ""), 1, F.col("__part").cast("int")), " ")
    copies = mixed.withColumn(
        "__copy", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("__whole")), lambda i: (i < F.col("__whole")) | (F.col("__part") > 0)))
    ).where("__size > 0")
    return copies.select(
        *[F.when(last & (F.col("__part") < F.col("__size")), head).otherwise(F.col(text)).alias(text) if c == text else own for c, own in zip([c for c in docs.columns if c not in added], columns(docs, added))],
        F.col("__shard").alias("shard"),
        F.col("__place").alias("place"),
        F.col("__copy").alias("copy"),
        F.when(last, F.col("__part")).otherwise(F.col("__size")).alias("taken"),
    )
