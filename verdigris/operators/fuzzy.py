"""Service names: exact, case-insensitive, alphanumeric, then fuzzy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.lineage import cut

THRESHOLD, ALTERNATIVES = 0.68, 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
#: What one task holds: names of a tree, requests that meet it, requests and nodes walked at once; paths of the first, narrow walk.
BLOCK, PART, CHUNK, FRONTIER, BEAM = 1 << 17, 2048, 256, 1 << 21, 16


def plain(name: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def layered(*layers: DataFrame) -> DataFrame:
    """One catalogue (service, target) of several, first to last: a later layer's entry stands for an earlier one of the same plain name."""
    every = None
    for i, layer in enumerate(layers):
        rows = layer.select("service", "target", F.lit(i).alias("layer"), plain(F.col("service")).alias("key"))
        every = rows if every is None else every.unionByName(rows)
    best = every.where("key <> ''").groupBy("key").agg(F.max_by(F.struct("service", "target"), F.struct("layer", "service")).alias("b"))
    return best.select("b.service", "b.target")


def pinned_first(requests: DataFrame, pins: DataFrame, found: DataFrame) -> DataFrame:
    """Resolved requests, those that a pin (name, service) names answered by it at once."""
    pinned = requests.join(pins.withColumnRenamed("service", "pin"), "name").select("request_id", "name", F.col("pin").alias("service"), F.lit("pinned").alias("method"))
    return pinned.unionByName(found.join(pinned.select("request_id"), "request_id", "left_anti").select("request_id", "name", "service", "method"))


def by_level(requests: DataFrame, services: DataFrame) -> DataFrame:
    """Each request with the best of its equal, case-insensitive or alphanumeric namesakes."""
    s = services.select("service", plain(F.col("service")).alias("key")).distinct()
    level = F.when(F.col("name") == F.col("service"), 1).when(F.lower("name") == F.lower("service"), 2).otherwise(3)
    met = requests.withColumn("key", plain(F.col("name"))).where("key <> ''").join(s, "key")
    best = met.groupBy("request_id", "name").agg(F.min(F.struct(level.alias("level"), "service")).alias("b"))
    method = F.when(F.col("b.level") == 1, "exact").when(F.col("b.level") == 2, "case_insensitive").otherwise("alphanumeric_normalized")
    return best.select("request_id", "name", F.col("b.service").alias("service"), method.alias("method"))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full
    for c in b:
        met = row & at.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return (row ^ full).bit_count()


def indel(a: str, b: str) -> float:
    """1 - (insertions + deletions) / (lengths): twice the longest common subsequence over both lengths."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def _numbers(keys: list[str]) -> np.ndarray:
    """Plain names of one length as rows of places in the alphabet."""
    flat = np.frombuffer("".join(keys).encode("ascii"), np.uint8).reshape(len(keys), -1)
    return np.where(flat >= ord("a"), flat - ord("a"), flat - ord("0") + 26).astype(np.int64)


def tree(keys: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Prefix tree of sorted, distinct plain names of one length: for each level the letters of its nodes, and the first and the end of the children of each node above."""
    table, above, levels = _numbers(keys), np.zeros(1, np.int64), []
    new = np.zeros(len(keys), bool)
    new[0] = True
    for column in table.T:
        new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        first = np.searchsorted(starts, above)
        levels.append((column[starts], first, np.append(first[1:], len(starts))))
        above = starts
    return levels


def _leading(who: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by ``who``, then by ``order`` (the last key first), and the rank of each within its ``who``."""
    at = np.lexsort((*order, who))
    ordered = who[at]
    return at, np.arange(len(at)) - np.searchsorted(ordered, ordered)


def _walk(levels, asked: list[str], bound: np.ndarray, beam: int = 0):
    """(who, leaf, similarity): the leaves whose similarity reaches the bound of the one who asks; None where that needs too many nodes at once.

    Each node has the row of ``common`` for its prefix, so names share the work
    for what they have in common.  A node is left as soon as not even a match
    of all that is to come reaches the bound.  With ``beam`` only the best
    paths are followed: some leaves, not all.
    """
    longest, depth = max(map(len, asked)), len(levels)
    kind = np.uint64 if longest <= 64 else object
    full = np.array([(1 << len(a)) - 1 for a in asked], kind)
    bits = [[0] * len(ALPHABET) for _ in asked]
    for i, a in enumerate(asked):
        for j, c in enumerate(a):
            bits[i][ALPHABET.index(c)] |= 1 << j
    masks, size = np.array(bits, kind), np.array([len(a) for a in asked])
    ones = np.bitwise_count if kind is np.uint64 else np.frompyfunc(int.bit_count, 1, 1)
    who, node, row = np.arange(len(asked)), np.zeros(len(asked), np.int64), full
    score = np.zeros(len(asked))
    for level, (letter, first, end) in enumerate(levels, 1):
        many = end[node] - first[node]
        if len(asked) > 1 and many.sum() > FRONTIER:
            return None
        node = np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        who, row = np.repeat(who, many), np.repeat(row, many)
        met = row & masks[who, letter[node]]
        row = ((row + met) | (row - met)) & full[who]
        alike = ones(row ^ full[who]).astype(np.int64)
        score = 2 * np.minimum(alike + depth - level, size[who]) / (size[who] + depth)
        kept = np.flatnonzero(score >= bound[who])
        if beam:
            at, rank = _leading(who[kept], -alike[kept])
            kept = kept[at[rank < beam]]
        who, node, row, score = who[kept], node[kept], row[kept], score[kept]
    return who, node, score


def closest(asked: list[str], keys: list[str], services: list[str], threshold: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(who, service, similarity): places of the n best services of each who asks, ties by name; ``keys`` have one length.

    A narrow walk finds n services, the least similar of which bounds the whole one.
    """
    place = sorted(range(len(keys)), key=lambda i: (keys[i], services[i]))
    starts = [i for i, p in enumerate(place) if i == 0 or keys[p] != keys[place[i - 1]]]
    many, starts = np.diff([*starts, len(place)]), np.array(starts)
    by_name = np.empty(len(keys), np.int64)
    by_name[sorted(range(len(keys)), key=lambda i: services[i])] = np.arange(len(keys))
    place, levels = np.array(place), tree([keys[place[i]] for i in starts])

    def best(some: list[str]):
        who, leaf, score = _walk(levels, some, np.full(len(some), threshold), BEAM)
        who, score = np.repeat(who, many[leaf]), np.repeat(score, many[leaf])
        at, rank = _leading(who, -score)
        bound = np.full(len(some), threshold)
        bound[who[at[rank == n - 1]]] = score[at[rank == n - 1]]
        found = _walk(levels, some, bound)
        if found is None:
            half = len(some) // 2
            one, two = best(some[:half]), best(some[half:])
            return np.append(one[0], two[0] + half), np.append(one[1], two[1]), np.append(one[2], two[2])
        who, leaf, score = found
        service = np.repeat(starts[leaf] - np.cumsum(many[leaf]) + many[leaf], many[leaf]) + np.arange(many[leaf].sum())
        who, service, score = np.repeat(who, many[leaf]), place[service], np.repeat(score, many[leaf])
        at, rank = _leading(who, by_name[service], -score)
        at = at[rank < n]
        return who[at], service[at], score[at]

    parts = [(i, best(asked[i : i + CHUNK])) for i in range(0, len(asked), CHUNK)]
    return tuple(np.concatenate([b[k] + (i if k == 0 else 0) for i, b in parts]) for k in range(3))


def resolve(requests: DataFrame, services: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All levels; fuzzy for requests that the others leave, with score and alternatives.

    Equal plain names are met once.  The catalogue is dealt into blocks of names
    of one length, each a prefix tree in its task; a part of the requests meets
    those blocks whose length allows the threshold, 2 min / (sum) >= threshold,
    and takes the best of each.
    """
    n = ALTERNATIVES + 1
    found = by_level(requests, services).select("*", F.lit(None).cast("double").alias("similarity"), F.lit("").alias("alternatives"))
    rest = requests.join(found.select("request_id"), "request_id", "left_anti").withColumn("key", plain(F.col("name"))).where("key <> ''")
    keys = cut(rest.select("key").distinct())
    of_key = Window.partitionBy("skey").orderBy("service")
    # of namesakes no more than n can be among the best
    named = services.select("service", plain(F.col("service")).alias("skey")).where("skey <> ''").withColumn("rn", F.row_number().over(of_key)).where(F.col("rn") <= n).drop("rn")
    named = cut(named.withColumn("size", F.length("skey")))
    blocks, parts = -(-named.count() // BLOCK) or 1, -(-keys.count() // PART) or 1
    dealt = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    low, high = F.ceil(F.length("key") * threshold / (2 - threshold)) - 1, F.floor(F.length("key") * (2 - threshold) / threshold) + 1
    asked = keys.withColumn("part", dealt("key", parts)).withColumn("size", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    asked = asked.join(named.select("size").distinct(), "size", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    stock = named.withColumn("block", dealt("skey", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ask, names, rows = left["key"].tolist(), right["service"].tolist(), ([], [], [])
        if ask and names:
            who, service, score = closest(ask, right["skey"].tolist(), names, threshold, n)
            rows = [ask[i] for i in who], [names[i] for i in service], score
        return pd.DataFrame({c: pd.Series(x, dtype=kind) for c, x, kind in zip(("key", "service", "similarity"), rows, (object, object, float))})

    cells = ["size", "block", "part"]
    scored = asked.groupBy(*cells).cogroup(stock.groupBy(*cells)).applyInPandas(meet, "key string, service string, similarity double")
    w = Window.partitionBy("key").orderBy(F.desc("similarity"), "service")
    top = rest.join(scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n), "key")
    best = top.groupBy("request_id", "name").agg(
        F.min_by("service", "rn").alias("service"), F.max("similarity").alias("similarity"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "service")))), lambda x: x["service"]), ",").alias("alternatives"),
    )
    return found.unionByName(best.withColumn("method", F.lit("fuzzy")))
