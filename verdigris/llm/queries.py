"""One thin query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, language_id, lm_score, mixing, near_dedup, pii, quality, secret_scan, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda i: F.filter(pii.SPANS, lambda s: s["kind"] == i)
    base = F.filter(pii.SPANS, lambda s: s["kind"] < len(pii.KINDS))
    return docs.select(
        "doc_id",
        *[F.size(of_kind(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.names(base), 256).alias("base_sha256"),
        pii.names(F.col(pii.SPANS)).alias("spans"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, _table(spark, sf_dir, "labels"))
    q = F.col("__quality")
    return judged.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality.base_failed().alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col(secret_scan.SPANS)
    return found.select(
        "doc_id",
        *[F.size(F.filter(spans, _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(secret_scan.KINDS[:3])],
        F.sha2(secret_scan.names(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secret_scan.names(spans).alias("spans"),
    )


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken", "shard", "place")])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep_text=False
    )
    runs, items = F.col(decontaminate.RUNS), F.col(decontaminate.ITEMS)
    hit = F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))
    return found.select(
        "doc_id",
        F.col(decontaminate.WORDS).alias("n_words"),
        hit["n"].alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source as host, nothing declared) and pages, each with their own host priors."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    languages, model = language_id.fit(docs)
    of_docs = language_id.identify(docs.select("doc_id", "source", "text"), languages, model, "text", "source")
    of_pages = language_id.identify(
        pages.select("page_id", url_filter.url_host(F.col("url")).alias("host"), "html"), languages, model, "html", "host", markup=True
    )
    return of_docs.unionByName(of_pages, allowMissingColumns=True).select("doc_id", "page_id", "lang", "probability", "text_lang")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
}
