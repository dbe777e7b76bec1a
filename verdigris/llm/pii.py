"""Personal data: base patterns, and terms that disclose what they find.

Base kinds are e-mail addresses, IPv4 addresses, card numbers and phone
numbers; matches of a kind are leftmost and non-overlapping, and a match that
fails its check is dropped without another try.

Method: the values found are the protected entities.  Words (runs of letters
and digits, lower-cased, of any length) near a mention, ``REACH`` characters
on each side, are its context terms; that window is what co-occurrence means
here.  With ``n(t)`` the occurrences of term ``t`` in the corpus, ``n(e)`` the
mentions of entity ``e``, ``n(t, e)`` the mentions of ``e`` whose context has
``t`` and ``N`` the words of the corpus, ``PMI(t; e) = log(n(t, e) N / (n(t)
n(e)))`` is the information that ``t`` gives about ``e`` and ``IC(e) = log(N /
n(e))`` all there is to know.  A term whose share ``PMI / IC`` exceeds
``threshold``, with at least ``support`` contexts, is a span of kind ``term``
wherever it stands, near a mention or not, in any text.  ``sanitise``
generalises every span to its kind.

Defined results
    null or empty text: no spans.  Offsets are code points, end exclusive.
    Repeated rows and equal texts get equal spans, each its own row; null or
    repeated keys do no harm, as texts are known by two hashes.  Spans may
    overlap; ``sanitise`` merges overlapping ones and names the merged span
    after the first, of two that start together after the lower kind.  Empty
    table: no rows.  Other columns are untouched; internal columns have names
    with ``__``.

Scale
    Four readings of the texts where they lie: base spans and contexts, which
    are checkpointed; counts of the context terms; the texts that have a
    disclosing term; the texts themselves.  Words of all texts pass a sieve of
    one bit per hash of a wanted term (1 MB at most; with more terms it only
    lets more words through) and are summed map-side.  What was found meets
    the texts by a broadcast, if it takes ``SMALL`` bytes at most, else by a
    shuffle of each text.  Work on a text is linear in its length but for
    sums over its matches, which are made in chunks: for ``n`` matches
    ``(n / CHUNK)**2 / 2`` small steps beside ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._native import columns, cut, let, meet

#: The patterns of the base kinds.  Possessive forms and
#: look-behinds match the same spans as the plain ones, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
REACH = 64
SPANS = "__spans"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_WORD = r"[\p{L}\p{N}]"
_BETWEEN = r"[^\p{L}\p{N}]+"
#: Entries of a running sum, and characters of a text, handled together.
CHUNK, PAGE = 128, 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _checks(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def running(values: Column, zero: Column, op) -> Column:
    """``op`` over all values before each; an array grows within a chunk only."""
    none = F.array().cast("array<int>")

    def scan(of, start):
        return F.aggregate(
            of, F.struct(start.alias("at"), none.alias("out")), lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        )["out"]

    def over(chunks):
        return let(scan(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero), lambda starts: F.flatten(F.zip_with(chunks, starts, scan)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(values) == 0, none).otherwise(let(parts, over))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points.

    The pieces between the matches and the matches themselves give the
    offsets by summing their lengths.
    """

    def place(found, pieces):
        steps = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        ends = lambda before, m, i: F.get(before, i) + F.length(F.get(pieces, i)) + F.length(m)
        return let(
            let(steps, lambda n: running(n, F.lit(0), lambda a, x: a + x)),
            lambda before: F.transform(found, lambda m, i: F.struct((ends(before, m, i) - F.length(m)).alias("start"), ends(before, m, i).alias("end"), m.alias("value"))),
        )

    none = F.expr("array()").cast("array<struct<start:int,end:int,value:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: place(found, pieces))),
    )


def pages(text: Column) -> Column:
    """A text as pieces of PAGE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def between(of: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` of a text in pages, without a walk from its beginning."""
    first, last = F.floor(start / PAGE).cast("int"), F.floor((end - 1) / PAGE).cast("int")
    there = F.array_join(F.slice(of, first + 1, last - first + 1), "")
    return F.when(end <= start, F.lit("")).otherwise(F.substring(there, start % PAGE + 1, end - start))


def _base(text: Column) -> Column:
    """All base spans of a non-null text as (kind, start, end, value), by kind then start."""
    none = F.expr("array()").cast("array<struct<kind:int,start:int,end:int,value:string>>")
    may = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
    }
    parts = []
    for i, kind in enumerate(KINDS):
        pattern, likely = may[kind]
        parts.append(F.when(likely, F.transform(_passing(located(text, pattern), kind), _tag(i))).otherwise(none))
    return F.concat(*parts)


def _passing(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _checks(kind, s["value"]))


def _tag(i: int):
    return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base spans of every row as ``__spans``."""
    return docs.select("*", F.explode(F.array(let(F.coalesce(F.col(text), F.lit("")), _base))).alias(SPANS))


def _context(of: Column, size: Column, start: Column, end: Column) -> Column:
    """Whole words within REACH characters of a mention, lower-cased, each once."""
    left, right = F.greatest(start - REACH, F.lit(0)), F.least(end + REACH, size)
    # a word that the window cuts is not a term
    before = F.when(left > 0, F.regexp_replace(between(of, left, start), rf"^{_WORD}+", "")).otherwise(between(of, left, start))
    after = F.when(right < size, F.regexp_replace(between(of, end, right), rf"{_WORD}+$", "")).otherwise(between(of, end, right))
    return F.array_distinct(F.concat(_vocabulary(before), _vocabulary(after)))


def _vocabulary(body: Column) -> Column:
    """Lower-cased runs of letters and digits of a text."""
    return F.filter(F.transform(F.split(body, _BETWEEN), F.lower), lambda w: w != "")


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _ids(text: str) -> list[Column]:
    return [F.xxhash64(_body(text)).alias("__k1"), F.xxhash64(_body(text), F.lit(1)).alias("__k2")]


def found(docs: DataFrame, text: str = "text", threshold: float = 0.9, support: int = 3) -> DataFrame:
    """(``__k1``, ``__k2``, ``__base``, ``__terms``): base spans and disclosing terms of the texts that have any."""
    mention = lambda of, size: F.transform(
        SPANS, lambda m: F.struct(F.concat_ws(":", m["kind"], F.lower(m["value"])).alias("entity"), _context(of, size, m["start"], m["end"]).alias("terms"))
    )
    mentions = F.when(F.size(SPANS) > 0, let(pages(F.col("__text")), lambda of: let(F.length("__text"), lambda size: mention(of, size))))
    read = cut(
        detect(docs.select(*_ids(text), _body(text).alias("__text")), "__text").select(
            "__k1", "__k2", F.size(F.regexp_extract_all("__text", F.lit(f"{_WORD}+"), F.lit(0))).alias("__words"), SPANS, mentions.alias("__mentions")
        )
    )
    total = read.agg(F.sum("__words").cast("double").alias("N"))
    near = read.select(F.explode("__mentions").alias("m")).select("m.entity", "m.terms")
    n_e = near.groupBy("entity").agg(F.count("*").alias("n_e"))
    n_te = cut(near.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support))

    wanted = cut(n_te.select("term").distinct())
    n_t = _passing_words(docs, text, wanted, distinct=False).groupBy("term").agg(F.count("*").alias("n_t"))
    share = 1 + F.log(F.col("n_te") / F.greatest("n_t", "n_te")) / F.log(F.col("N") / F.col("n_e"))
    strong = (
        n_te.join(n_e, "entity")
        .join(n_t, "term")
        .crossJoin(F.broadcast(total))  # one row
        .where((F.col("N") > F.col("n_e")) & (share > threshold))
        .select("term")
        .distinct()
    )
    strong = cut(strong)
    terms = meet(_passing_words(docs, text, strong, distinct=True), strong, ["term"]).groupBy("__k1", "__k2").agg(F.collect_set("term").alias("__terms"))
    base = read.where(F.size(SPANS) > 0).select("__k1", "__k2", F.col(SPANS).alias("__base")).dropDuplicates(["__k1", "__k2"])
    return base.join(terms, ["__k1", "__k2"], "full_outer")


def _passing_words(docs: DataFrame, text: str, terms: DataFrame, distinct: bool) -> DataFrame:
    """(``__k1``, ``__k2``, term): the words of every text that pass the sieve of ``terms``, once each or as often as they stand."""
    sieve, bits = _sieve(terms)
    words = F.filter(_vocabulary(F.col("__text")), lambda w: _in_sieve(w, bits))
    rows = docs.select(*_ids(text), _body(text).alias("__text")).crossJoin(F.broadcast(sieve))  # one row
    return rows.select("__k1", "__k2", F.explode(F.array_distinct(words) if distinct else words).alias("term"))


def _sieve(terms: DataFrame) -> tuple[DataFrame, int]:
    """One row, ``__sieve``: the bits of the terms' hashes in an array of longs; and the number of bits."""
    longs = 1 << min(17, max(10, (terms.count() // 4).bit_length()))
    set_ = (
        terms.select(F.pmod(F.xxhash64("term"), F.lit(64 * longs).cast("long")).alias("h"))
        .groupBy(F.shiftright("h", 6).alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    )
    filled = terms.sparkSession.range(longs).join(set_, F.col("id") == F.col("at"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    ordered = filled.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: x["bits"]).alias("__sieve")), 64 * longs


def _in_sieve(word: Column, bits: int) -> Column:
    return let(
        F.pmod(F.xxhash64(word), F.lit(bits).cast("long")),
        lambda h: F.call_function("shiftright", F.get("__sieve", F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1,
    )


def _term_spans(text: Column, terms: Column) -> Column:
    """Every place of the terms in a text, as spans."""
    return F.transform(
        F.filter(located(text, f"{_WORD}+"), lambda s: F.array_contains(terms, F.lower(s["value"]))),
        lambda s: F.struct(F.lit(len(KINDS)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")),
    )


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows with all their spans in ``__spans``, ordered by kind and start."""
    met = meet(docs.select(*columns(docs), *_ids(text)), found(docs, text, **how), ["__k1", "__k2"], "left")
    none = F.expr("array()").cast("array<struct<kind:int,start:int,end:int,value:string>>")
    terms = F.when(F.col("__terms").isNull(), none).otherwise(let(_body(text), lambda t: _term_spans(t, F.col("__terms"))))
    # A generator, so that what reads the spans does not find them again.
    return met.select(*columns(docs), F.explode(F.array(F.sort_array(F.concat(F.coalesce("__base", none), terms)))).alias(SPANS))


def names(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows with every span of the text replaced by its kind in brackets."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])

    def rewrite(body, spans):
        ends = F.transform(spans, lambda s: s["end"])
        reach = let(ends, lambda e: running(e, F.lit(0), lambda a, x: F.greatest(a, x)))
        piece = lambda of, s, at: F.when(s["start"] >= at, F.concat(between(of, at, s["start"]), F.get(marks, s["kind"]))).otherwise("")
        return let(
            reach,
            lambda at: let(
                pages(body),
                lambda of: F.concat(
                    F.array_join(F.transform(spans, lambda s, i: piece(of, s, F.get(at, i))), ""), between(of, F.array_max(ends), F.length(body))
                ),
            ),
        )

    by_start = F.sort_array(F.transform(SPANS, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    clean = F.when(F.size(SPANS) == 0, F.col(text)).otherwise(let(by_start, lambda spans: rewrite(F.col(text), spans)))
    return annotate(docs, key, text, **how).withColumn(text, clean).select(*columns(docs))
