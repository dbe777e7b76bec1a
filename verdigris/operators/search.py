"""Ranked retrieval: BM25, cosine, reciprocal-rank fusion and near-duplicates of a statement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from verdigris.lineage import cut


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: list[str], k: int, key: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top k documents (id, score, rank) for the terms of a query, ties by id.

    Texts are read and cut into terms once; what both the totals and the hits
    read is a checkpoint of the counts.
    """
    terms = sorted(set(query))
    sized = cut(
        docs.select(key, tokens(F.col(text)).alias("ts")).select(
            key, F.size("ts").alias("dl"), *[F.size(_only(t)).alias(f"tf{i}") for i, t in enumerate(terms)]
        )
    )
    total = sized.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    )

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    score = F.round(sum((part(i) for i in range(len(terms))), F.lit(0.0)), 6)
    hits = sized.where(sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0)
    return ranked(hits.crossJoin(F.broadcast(total)).select(F.col(key).alias("id"), score.alias("score")), k)  # one row


def _only(term: str) -> Column:
    return F.filter("ts", lambda x: x == F.lit(term))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, then id, with their rank from 1."""
    order = [F.desc("score"), F.asc("id")]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for empty, unequal or zero vectors."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(~F.coalesce(usable, F.lit(False)), 0.0).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def nearest(vectors: DataFrame, query: DataFrame, k: int, least: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Top k vectors by cosine with one query vector (a single row)."""
    q = query.select(F.col(vector).alias("q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(q)).select(F.col(key).alias("id"), F.round(cosine(F.col(vector), F.col("q")), 6).alias("score"))
    return ranked(scored.where(F.col("score") >= least), k)


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion; ties go to the earlier list, then the better rank."""
    tagged = [x.select("id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = tagged[0]
    for x in tagged[1:]:
        both = both.unionByName(x)
    score = F.round(F.sum(1.0 / (k + F.col("rank"))), 9)
    return both.groupBy("id").agg(score.alias("score"), F.min(F.struct("list", "rank")).alias("first")).select(
        "id", "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank")
    )


def postings(docs: DataFrame, terms: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(term, id, tf, dl) of the wanted terms: an inverted index, which queries join on its terms."""
    cut_up = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("ts"))
    words = cut_up.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(terms, "term", "left_semi")
    return words.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


#: Queries and documents that one task scores together.
QUERIES, DOCUMENTS = 8192, 8192


def dealt(rows: DataFrame, own: str, key: str, n: int, other: str, m: int) -> DataFrame:
    """Rows in ``n`` parts by their key, each met by ``m`` parts of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def best_by_terms(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, id, score) of the documents that may be among the k best of a query but itself: no worse than the k-th of this block by more than rounding.

    ``asked``: (query, term); ``held``: (term, id, part), the weight of a term in a document.
    """
    term, at = held["term"].to_numpy(), np.argsort(held["term"].to_numpy(), kind="stable")
    ids, doc = np.unique(held["id"].to_numpy(), return_inverse=True)
    term, doc, part = term[at], doc[at], held["part"].to_numpy()[at]
    found = [(asked["query"].to_numpy()[:0], ids[:0], np.zeros(0))]
    for query, terms in asked.groupby("query")["term"]:
        first, end = np.searchsorted(term, terms.to_numpy()), np.searchsorted(term, terms.to_numpy(), "right")
        many = end - first
        of = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        score = np.bincount(doc[of], part[of], len(ids))
        score[ids == query] = 0
        least = np.partition(score, -k)[-k] - 2e-6 if len(ids) > k else 0.0
        kept = np.flatnonzero((score > 0) & (score >= least))
        found.append((np.full(len(kept), query, found[0][0].dtype), ids[kept], score[kept]))
    return pd.DataFrame(dict(zip(("query", "id", "score"), map(np.concatenate, zip(*found)))))


def bm25_each(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score, rank): the top k documents (id, text) for each query (query, text) but itself, ties by id.

    Queries and documents have integer keys.  Frequent terms bring a query to
    nearly all documents, so these pairs stay within a task, a bounded block of
    queries and of documents, which only the best of the block leave.
    """
    wanted = cut(queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    index = cut(postings(docs, wanted.select("term").distinct()))
    total = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"))
    df = cut(index.groupBy("term").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id()))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    held = index.join(df, "term").crossJoin(F.broadcast(total)).select(F.col("number").alias("term"), "id", part.alias("part"))  # one row
    asked = wanted.join(df, "term").select("query", F.col("number").alias("term"))
    n, m = -(-wanted.select("query").distinct().count() // QUERIES) or 1, -(-docs.count() // DOCUMENTS) or 1
    cells, kinds = ["asks", "holds"], {c: f.schema[c].dataType.simpleString() for c, f in (("query", queries), ("id", docs))}
    left = dealt(asked, "asks", "query", n, "holds", m).repartition(n * m, *cells).groupBy(*cells)
    right = dealt(held, "holds", "id", m, "asks", n).repartition(n * m, *cells).groupBy(*cells)
    met = left.cogroup(right).applyInPandas(lambda x, y: best_by_terms(x, y, k), f"query {kinds['query']}, id {kinds['id']}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return met.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries and rows of one product of blocks, and rows of it that are multiplied at once.
ASKED, HELD, AT_ONCE = 2048, 16384, 2048


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from left to right as ``cosine`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total = total + a[:, i] * b[:, i]
    return total


def _matrices(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the places of the vectors that have it, and the vectors; none that is empty."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            places.setdefault(len(v), []).append(i)
    return {n: (np.array(at), np.array([vectors[i] for i in at], np.float64)) for n, at in places.items()}


def close_pairs(asked: list, held: list, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place asked, place held, cosine) of the pairs whose cosine is about ``least`` or more; the cosine is that of ``cosine``, not rounded."""
    found, given = [], _matrices(held)
    for n, (at, a) in _matrices(asked).items():
        if n not in given:
            continue
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = a / np.sqrt((a * a).sum(axis=1))[:, None]
            for i in range(0, len(given[n][0]), AT_ONCE):
                here, b = given[n][0][i : i + AT_ONCE], given[n][1][i : i + AT_ONCE]
                q, r = np.nonzero(unit @ (b / np.sqrt((b * b).sum(axis=1))[:, None]).T >= least - 2e-6)
                for j in range(0, len(q), 1 << 17):
                    x, y = q[j : j + (1 << 17)], r[j : j + (1 << 17)]
                    u, v = a[x], b[y]
                    found.append((at[x], here[y], _sequential(u, v) / (np.sqrt(_sequential(u, u)) * np.sqrt(_sequential(v, v)))))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def within(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(query, id, score): every pair of a query and a row (id, embedding) with a cosine of at least ``least`` > 0.

    All pairs are compared, as matrix products of bounded blocks: only pairs
    that are close leave a task.  The scores are those of ``cosine``.
    """
    kind = rows.schema["id"].dataType.simpleString()
    asked, held = cut(queries.select("id", "embedding")), rows.select("id", "embedding")
    n, m = -(-asked.count() // ASKED) or 1, -(-held.count() // HELD) or 1

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, r, cos = close_pairs(left["embedding"].tolist(), right["embedding"].tolist(), least)
        other = left["id"].to_numpy()[q] != right["id"].to_numpy()[r]
        return pd.DataFrame({"query": left["id"].to_numpy()[q[other]], "id": right["id"].to_numpy()[r[other]], "cosine": cos[other]})

    cells = ["asks", "holds"]
    left = dealt(asked, "asks", "id", n, "holds", m).repartition(n * m, *cells).groupBy(*cells)
    right = dealt(held, "holds", "id", m, "asks", n).repartition(n * m, *cells).groupBy(*cells)
    met = left.cogroup(right).applyInPandas(meet, f"query {kind}, id {kind}, cosine double")
    return met.select("query", "id", F.round("cosine", 6).alias("score")).where(F.col("score") >= least)


def near_duplicate(candidates: DataFrame, known: DataFrame, least: float = 0.92, hits: int = 5) -> DataFrame:
    """Each candidate (id, statement, embedding) with the known row it repeats and the pass that said so.

    Pass 1: the same statement, the lowest id.  Pass 2: the best cosine of at
    least ``least`` over the whole vector index (rows with ``indexed``), ties by
    id.  Pass 3: of the best ``hits`` rows by BM25 for the statement the first
    with a cosine of at least ``least``.  As pass 3 asks for both, the cosines
    come first and only candidates that have such a row are scored.
    """
    same = candidates.join(known.select(F.col("id").alias("known_id"), "statement"), "statement").where(F.col("id") != F.col("known_id"))
    exact = same.groupBy("id").agg(F.min("known_id").alias("known_id")).select("id", "known_id", F.lit(1).alias("pass"), F.lit(1.0).alias("score"))
    exact = cut(exact)
    rest = candidates.join(exact, "id", "left_anti")
    close = cut(within(rest, known, least).select(F.col("query").alias("id"), F.col("id").alias("known_id"), "score").join(known.select(F.col("id").alias("known_id"), "indexed"), "known_id"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "known_id")).alias("b")
    vector = cut(close.where("indexed").groupBy("id").agg(best).select("id", "b.known_id", F.lit(2).alias("pass"), (-F.col("b.minus")).alias("score")))
    unsettled = cut(close.join(vector, "id", "left_anti").select("id", "known_id", "score"))
    asked = rest.join(unsettled.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query"), F.col("statement").alias("text"))
    found = bm25_each(asked, known.select("id", F.col("statement").alias("text")), hits).select(F.col("query").alias("id"), F.col("id").alias("known_id"), "rank")
    ranked_hits = found.join(unsettled, ["id", "known_id"]).groupBy("id").agg(F.min(F.struct("rank", "known_id", "score")).alias("b"))
    lexical = ranked_hits.select("id", "b.known_id", F.lit(3).alias("pass"), "b.score")
    return exact.unionByName(vector).unionByName(lexical)
