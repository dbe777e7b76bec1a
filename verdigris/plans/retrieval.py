"""Retrieval queries: BM25, vectors, fusion, recipe search, near-duplicates, service names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.operators import fuzzy, search
from verdigris.sources.graph import Graph

TERMS, TOP_K, MAX_RESULTS, LEAST = ["the", "and", "der", "tion"], 50, 5, 0.30


def _bm25(g: Graph) -> DataFrame:
    return search.bm25(g.table("documents").select(F.col("doc_id").alias("id"), "text"), TERMS, TOP_K)


def _vectors(g: Graph) -> DataFrame:
    e = g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.nearest(e, e.where("id = 0").select("embedding"), TOP_K, LEAST)


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(Graph(spark, sf_dir))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(Graph(spark, sf_dir))


def cosine_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with empty, short and zero vectors among the operands."""
    e, k = F.col("embedding"), F.col("vec_id") % 5
    other = F.when(k == 1, F.slice(e, 1, 0)).when(k == 2, F.slice(e, 1, 10)).when(k == 3, F.transform(e, lambda x: x * 0)).otherwise(F.reverse(e))
    return Graph(spark, sf_dir).table("embeddings").select("vec_id", F.round(search.cosine(e, other), 6).alias("cosine"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return search.fuse([_bm25(g), _vectors(g)])


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits that exist, with what they are, best first (the limit is its feature)."""
    g = Graph(spark, sf_dir)
    order = [F.desc("score"), F.asc("first_list"), F.asc("first_rank")]
    top = search.fuse([_bm25(g), _vectors(g)]).orderBy(*order).limit(MAX_RESULTS)
    return top.join(g.table("documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("id", "score", "lang", "source")


def recipe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes by name and by kind, fused; composite and required-parameter filters come after fusion."""
    g = Graph(spark, sf_dir)
    p = g.table("part")
    by_name = search.bm25(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), ["small", "bolt"], TOP_K)
    by_kind = search.bm25(p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_brand").alias("text")), ["economy", "7"], TOP_K)
    fused = search.fuse([by_name, by_kind])
    composite = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"))
    needs = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("id"))
    return fused.join(composite, "id", "left_semi").join(needs, "id", "left_anti").select("id", "score")


def near_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th statement as a submission, with the row it repeats: as it is, or edited and with a vector near a neighbour's.

    Two of three rows are in the vector index, all are in the text index.
    """
    g = Graph(spark, sf_dir)
    rows = g.table("embeddings").join(g.table("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("statement")), "vec_id").select(F.col("vec_id").alias("id"), "statement", "embedding")
    way = F.floor(F.col("id") / 20) % 4
    other = rows.select(F.col("id").alias("from"), F.col("statement").alias("said"), F.transform("embedding", lambda x: x.cast("double") * 2 + 0.01).alias("near"))
    asked = rows.where("id % 20 = 0").withColumn("way", way).join(other, F.col("from") == F.col("id") + F.col("way"), "left")
    statement = F.when(F.col("way") == 0, F.col("statement")).when(F.col("way") == 2, F.concat("said", F.lit(" edited"))).otherwise(F.concat(F.lit("edited "), "statement"))
    vector = F.when(F.col("way").isin(1, 2), F.col("near")).otherwise(F.col("embedding").cast("array<double>"))
    candidates = asked.select("id", statement.alias("statement"), vector.alias("embedding"))
    return search.near_duplicate(candidates, rows.withColumn("indexed", F.col("id") % 3 != 0))


def _names(g: Graph) -> DataFrame:
    """Requested service names: exact, other case, other separators, one letter off, unknown."""
    n, k = F.col("s_name"), F.col("s_suppkey") % 5
    name = F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.replace(n, F.lit("#"), F.lit("-"))).when(k == 3, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit("unknown"), F.reverse(n)))
    return g.table("supplier").select(F.col("s_suppkey").alias("request_id"), name.alias("name"))


def service_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, case-insensitive and alphanumeric matches of service names."""
    g = Graph(spark, sf_dir)
    return fuzzy.by_level(_names(g), g.table("supplier").select(F.col("s_name").alias("service")))


def fuzzy_service_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels, the fuzzy one with its score and alternatives."""
    g = Graph(spark, sf_dir)
    return fuzzy.resolve(_names(g), g.table("supplier").select(F.col("s_name").alias("service")))


QUERIES = {
    "bm25_search": bm25_search,
    "vector_topk": vector_topk,
    "cosine_guards": cosine_guards,
    "rrf_fusion": rrf_fusion,
    "hybrid_search": hybrid_search,
    "recipe_search": recipe_search,
    "near_duplicate": near_duplicate,
    "service_match": service_match,
    "fuzzy_service_match": fuzzy_service_match,
}


def _bm25_sql(name: str, table: str, id_: str, text: str, terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(terms)))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = lambda i: (
        f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END"
    )
    score = " + ".join(["0.0::DOUBLE", *[part(i) for i in range(len(terms))]])
    any_ = " + ".join(f"tf{i}" for i in range(len(terms)))
    return f"""{name}_t AS (SELECT {id_} AS id, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM {table}),
{name}_s AS (SELECT id, len(ts) AS dl, {tf} FROM {name}_t), {name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM {name}_s),
{name}_r AS (SELECT id, round({score}, 6) AS score FROM {name}_s, {name}_c WHERE {any_} > 0),
{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {name}_r QUALIFY rank <= 50)"""


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"{_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"


_VEC = f"""q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), vec_r AS (SELECT vec_id AS id, round({_cos('embedding', 'q')}, 6) AS score FROM embeddings, q),
vec AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vec_r WHERE score >= 0.3 QUALIFY rank <= 50)"""


def _fuse_sql(one: str, two: str) -> str:
    return f"""u AS (SELECT id, rank, 0 AS list FROM {one} UNION ALL SELECT id, rank, 1 FROM {two}),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list) AS first_list, min_by(rank, list) AS first_rank FROM u GROUP BY 1)"""


_DOCS = "WITH " + _bm25_sql("bm", "documents", "doc_id", "text", TERMS)
ORACLES = {
    "bm25_search": _DOCS + " SELECT id, score, rank FROM bm",
    "vector_topk": f"WITH {_VEC} SELECT id, score, rank FROM vec",
    "cosine_guards": f"""WITH o AS (SELECT vec_id, embedding AS a, CASE vec_id % 5 WHEN 1 THEN embedding[1:0] WHEN 2 THEN embedding[1:10] WHEN 3 THEN list_transform(embedding, lambda x: (x * 0)::FLOAT) ELSE list_reverse(embedding) END AS b FROM embeddings)
SELECT vec_id, round(CASE WHEN len(a) = 0 OR len(a) <> len(b) THEN 0.0::DOUBLE WHEN sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}) = 0 THEN 0.0 ELSE {_cos('a', 'b')} END, 6) AS cosine FROM o""",
    "rrf_fusion": f"{_DOCS}, {_VEC}, {_fuse_sql('bm', 'vec')} SELECT id, score, first_list, first_rank FROM fused",
    "hybrid_search": f"""{_DOCS}, {_VEC}, {_fuse_sql('bm', 'vec')}, t AS (SELECT * FROM fused ORDER BY score DESC, first_list, first_rank LIMIT 5) SELECT id, score, lang, source FROM t JOIN documents ON doc_id = id""",
    "recipe_search": "WITH " + _bm25_sql("a", "part", "p_partkey", "p_name", ["small", "bolt"]) + ", " + _bm25_sql("b", "part", "p_partkey", "p_type || ' ' || p_brand", ["economy", "7"]) + f""",
{_fuse_sql('a', 'b')} SELECT id, score FROM fused JOIN part ON p_partkey = id WHERE p_size % 2 = 0 AND p_size % 3 <> 0""",
    "near_duplicate": f"""WITH r AS (SELECT vec_id AS id, text AS statement, embedding, vec_id % 3 <> 0 AS indexed FROM embeddings JOIN documents ON doc_id = vec_id),
cand AS (SELECT q.id, CASE way WHEN 0 THEN q.statement WHEN 2 THEN o.statement || ' edited' ELSE 'edited ' || q.statement END AS statement,
    CASE WHEN way IN (1, 2) THEN list_transform(o.embedding, lambda x: x::DOUBLE * 2 + 0.01::DOUBLE) ELSE q.embedding::DOUBLE[] END AS embedding
  FROM (SELECT *, id // 20 % 4 AS way FROM r WHERE id % 20 = 0) q LEFT JOIN r o ON o.id = q.id + q.way),
p AS (SELECT c.id, min(k.id) AS known_id, 1 AS pass, 1.0::DOUBLE AS score FROM cand c JOIN r k ON c.statement = k.statement WHERE c.id <> k.id GROUP BY 1),
n AS (SELECT c.id, k.id AS known_id, indexed, round({_cos('c.embedding', 'k.embedding')}, 6) AS score FROM cand c JOIN r k ON c.id <> k.id WHERE c.id NOT IN (SELECT id FROM p)),
v AS (SELECT id, known_id, 2 AS pass, score FROM n WHERE indexed AND score >= 0.92 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, known_id) = 1),
l AS (SELECT * FROM n WHERE score >= 0.92 AND id NOT IN (SELECT id FROM v)),
d AS (SELECT id, list_filter(string_split_regex(lower(statement), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM r),
w AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT id, dl, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
a AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
qt AS (SELECT DISTINCT id AS query, unnest(list_filter(string_split_regex(lower(statement), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM cand WHERE id IN (SELECT id FROM l)),
s AS (SELECT query, tf.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm
  FROM qt JOIN tf USING (term) JOIN df USING (term), a WHERE tf.id <> query GROUP BY ALL),
t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY bm DESC, id) AS rank FROM s QUALIFY rank <= 5),
x AS (SELECT l.id, known_id, 3 AS pass, score FROM t JOIN l ON t.query = l.id AND t.id = l.known_id QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY rank) = 1)
SELECT id, known_id, CAST(pass AS INTEGER) AS pass, score FROM (FROM p UNION ALL FROM v UNION ALL FROM x)""",
    "service_match": """WITH n AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) WHEN 2 THEN replace(s_name, '#', '-') WHEN 3 THEN 'x' || s_name ELSE 'unknown' || reverse(s_name) END AS name FROM supplier),
m AS (SELECT request_id, name, s_name AS service, CASE WHEN name = s_name THEN 1 WHEN lower(name) = lower(s_name) THEN 2 ELSE 3 END AS level
  FROM n JOIN supplier ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'))
SELECT request_id, name, service, CASE level WHEN 1 THEN 'exact' WHEN 2 THEN 'case_insensitive' ELSE 'alphanumeric_normalized' END AS method
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY level, service) AS rn FROM m) WHERE rn = 1""",
}
