"""Quality rules with risk-controlled thresholds.

Base rules reject texts of few words and texts whose words mostly repeat.
Beyond them, four signals are compared with cutoffs that labelled holdouts
select, per stratum (the language).  For a cutoff, the hypothesis "it rejects
more than ``alpha`` of the good texts" is tested on the stratum's labelled
good texts with the exact binomial tail ``P(Bin(n, alpha) <= k)``, ``k`` being
the good texts beyond the cutoff.  A cutoff is certified if that is at most
``delta`` divided by the number of all tests (strata x signals x grid,
Bonferroni).  So, with probability ``1 - delta``, no certified cutoff of any
stratum falsely rejects more than ``alpha`` of its good texts, and all signals
together at most ``risk = signals * alpha``.  Of the certified cutoffs the one
of the most gain is taken, the highest at a tie: the labelled bad texts that
it rejects less ``COST`` times the good ones.  None is taken without a gain.

Every stratum answers for itself: it has its own certified cutoffs or none,
whatever other strata have.  A stratum with so few good texts that no cutoff
could be certified even if it were alone and rejected none of them is not
tested, and does not count among the tests; that depends on ``n`` only, not on
what the cutoffs do, so the bound stands.

Defined results
    null or empty text: no words, all counts 0, rejected by the base rule.
    A null stratum is a stratum of its own.  A stratum without labels, or with
    too few to certify a cutoff: only the base rules reject.  Null labels are
    ignored; of several labels of a document the lowest counts.  A repeated
    row is judged like any other and stays repeated.  Empty table: no rows.
    Columns of the input are untouched, whatever their names.

Scale
    Texts are measured once, in place: ``judge`` checkpoints the counts,
    ``keep`` the rows with their counts.  Calibration shuffles one row of four
    small numbers per labelled document, then counts per (stratum, signal,
    bin).  Any number of strata is tested.  The certified cutoffs are one row
    per stratum that has any; they are broadcast if they take ``SMALL`` bytes
    at most, else joined by stratum, where a hot stratum can be split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._native import columns, cut, let, meet, words

#: Cutoffs tried for every signal.
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SIGNALS = ("symbols", "repeats", "lines", "shouting")
#: Bad texts that must be rejected to outweigh one good text.
COST = 20


def _repeated_words(ws: Column, n: int = 3) -> Column:
    """Words inside n-word windows that occur twice or more in ``ws``."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(ws) - n),
        lambda i: F.struct(F.concat_ws(" ", *[F.get(ws, i + j) for j in range(n)]).alias("w"), i.alias("i")),
    )
    in_order = lambda s: F.filter(
        s, lambda x, j: (F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"])
    )
    covered = let(
        F.sort_array(windows),
        lambda s: F.size(F.array_distinct(F.flatten(F.transform(in_order(s), lambda x: F.array(*[x["i"] + j for j in range(n)]))))),
    )
    return F.when(F.size(ws) < n, F.lit(0)).otherwise(covered).cast("long")


def _measures(text: Column) -> Column:
    """Struct of the counts of a non-null text, made in one pass over its words and lines."""

    def of(ws, lines):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(ws).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(text, r"[^A-Z!]+", "")).cast("long").alias("n_shouting"),
        )

    # \A[space]*\z keeps only lines without a word
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"\A[\x20\x09-\x0D]*\z"))
    return let(words(text), lambda ws: let(lines, lambda ls: of(ws, ls)))


def measured(docs: DataFrame, text: str = "text", into: str = "__quality") -> DataFrame:
    """Adds a struct column with the counts of each text."""
    # A generator, so that filters on the counts are not pushed below it, where they would count again.
    return docs.select("*", F.explode(F.array(let(F.coalesce(F.col(text), F.lit("")), _measures))).alias(into))


def base_failed(m: str = "__quality") -> Column:
    n, r = F.col(m)["n_words"], F.col(m)["n_repeat_words"]
    return (n < 50) | (100 * r > 50 * n)


def signals(m: str = "__quality") -> dict[str, Column]:
    c = F.col(m)
    share = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"),
        "lines": share("n_dup_lines", "n_lines"),
        "shouting": share("n_shouting", "word_chars"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) by the recurrence of its terms, in logarithms; 1 where k is at or over the mean."""
    odds, log_q = math.log(p / (1 - p)), math.log1p(-p)
    first = n * F.lit(log_q)
    steps = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda a, i: let(
            a["log"] + F.log((n - i + 1) / i) + F.lit(odds),
            lambda x: F.struct(x.alias("log"), (a["sum"] + F.exp(x)).alias("sum")),
        ),
    )["sum"]
    return F.when(k >= n * F.lit(p), F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(steps)


def calibrate(rows: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(``__stratum``, ``__cutoffs``) of measured rows: the certified cutoff of each signal, null where it has none."""
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("good"))
    m = rows.select(F.col(key).alias("k"), _stratum(stratum).alias("stratum"), "__quality")
    cutoffs_below = lambda value: F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: g < value))
    binned = F.array(*[F.struct(F.lit(name).alias("signal"), cutoffs_below(value).alias("bin")) for name, value in signals().items()])
    tested = (
        m.where(~base_failed())
        .select("k", "stratum", binned.alias("b"))
        .join(labels, "k")
        .select("stratum", "good", F.explode("b").alias("b"))
        .groupBy("stratum", "good", "b.signal", "b.bin")
        .count()
        .groupBy("stratum", "signal")
        .agg(F.collect_list(F.struct("good", "bin", "count")).alias("bins"))  # at most 2 labels x (grid + 1) entries
    )
    beyond = lambda good, g: F.aggregate(
        F.filter("bins", lambda x: (x["good"] == good) & (x["bin"] > g)), F.lit(0).cast("long"), lambda a, x: a + x["count"]
    )
    alpha, each = risk / len(SIGNALS), len(SIGNALS) * len(GRID)
    able = cut(tested.withColumn("n", beyond(1, F.lit(-1))).where(F.col("n") * F.lit(math.log1p(-alpha)) <= math.log(delta / each)))
    strata = able.agg(F.count_distinct("stratum").alias("strata"))
    certified = (
        able.select("stratum", "signal", "n", F.posexplode(F.array(*map(F.lit, GRID))).alias("g", "cutoff"), "bins")
        .select("stratum", "signal", "cutoff", "n", beyond(1, F.col("g")).alias("k"), beyond(0, F.col("g")).alias("caught"))
        .crossJoin(F.broadcast(strata))  # one row
        .withColumn("p", binomial_tail(F.col("n"), F.col("k"), alpha))
        .withColumn("gain", F.col("caught") - COST * F.col("k"))
        .where((F.col("gain") > 0) & (F.col("p") <= delta / (F.col("strata") * each)))
        .groupBy("stratum", "signal")
        .agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))
    )
    of = [F.max(F.when(F.col("signal") == name, F.col("cutoff"))) for name in SIGNALS]
    return certified.groupBy(F.col("stratum").alias("__stratum")).agg(F.array(*of).alias("__cutoffs"))


def _stratum(name: str) -> Column:
    """A key that tells null from every text."""
    return F.when(F.col(name).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def verdict(rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang", m: str = "__quality") -> DataFrame:
    """Adds ``__kept``: neither a base rule nor a certified cutoff of its own stratum rejects."""
    beyond = [F.coalesce(value > F.get("__cutoffs", F.lit(i)), F.lit(False)) for i, value in enumerate(signals(m).values())]
    rejected = beyond[0] | beyond[1] | beyond[2] | beyond[3]
    judged = meet(rows.withColumn("__stratum", _stratum(stratum)), cutoffs, ["__stratum"], "left")
    return judged.withColumn("__kept", ~base_failed(m) & ~rejected).drop("__stratum", "__cutoffs")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """The documents without their texts, with the counts in ``__quality`` and the verdict in ``__kept``."""
    rows = cut(measured(docs, text).select(*columns(docs, (text,)), "__quality"))
    return verdict(rows, calibrate(rows, labels, key, stratum, **how), stratum)


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    rows = cut(measured(docs, text))
    return verdict(rows, calibrate(rows, labels, key, stratum, **how), stratum).where("__kept").select(*columns(docs))
