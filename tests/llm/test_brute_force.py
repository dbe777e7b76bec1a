"""Operators against plain Python on the smallest tables and on made-up texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from verdigris.llm import _native, _text, decontaminate, language_id, lm_score, mixing, near_dedup, pii, quality, queries, secret_scan, substring_dedup

from .conftest import prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (13 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark, sf_dir, texts):
    for r in queries.op1_pii(spark, sf_dir).collect():
        want = base_pii(texts[r.doc_id])
        assert r.base_sha256 == sha(want)
        assert (r.spans.split(",") if r.spans else [])[: len(want)] == want


def test_pii_base_on_hard_texts(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("a1.@-+ ()5%_9é") for _ in range(120)) for _ in range(300)]
    made += ["x@y.z_a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "300.1.1.1.1", "0001.2.3.4", "4111 1111 1111 1111-4111111111111111", "+1 (555) 123-4567)", "9" * 4000, "a." * 3000 + "@", "+1" * 2000]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.annotate(docs).select("text", pii.names(F.filter(pii.SPANS, lambda s: s["kind"] < 4)).alias("n")).collect():
        assert r.n == ",".join(base_pii(r.text)), r.text[:80]


def test_pii_terms_and_sanitise(spark):
    secret = "reach Zyxwvut at zy@ex.org now"
    rows = [(i, f"{prose(40, i)} {secret} {prose(40, 100 + i)}") for i in range(6)] + [(50 + i, prose(80, 200 + i)) for i in range(40)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zy@ex.org" not in out[i] and "Zyxwvut" not in out[i] and "[EMAIL]" in out[i] and "[TERM]" in out[i] for i in range(6))
    assert all(out[50 + i] == rows[6 + i][1] for i in range(40))


def disclosing_terms(texts, reach=64, threshold=0.9, support=3):
    """Brute force of the method: terms by the information that they give about an entity."""
    word = regex.compile(r"[\p{L}\p{N}]+")
    n_t = Counter(w.lower() for t in texts for w in word.findall(t))
    total = sum(n_t.values())
    n_e, n_te = Counter(), Counter()
    for t in texts:
        for s in base_pii(t):
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            entity = f"{list(PII).index(kind)}:{t[a:b].lower()}"
            left, right = max(a - reach, 0), min(b + reach, len(t))
            before, after = t[left:a], t[b:right]
            if left > 0:
                before = regex.sub(r"^[\p{L}\p{N}]+", "", before)
            if right < len(t):
                after = regex.sub(r"[\p{L}\p{N}]+$", "", after)
            n_e[entity] += 1
            for w in {w.lower() for w in word.findall(before) + word.findall(after)}:
                n_te[entity, w] += 1
    share = lambda e, w, n: 1 + math.log(n / max(n_t[w], n)) / math.log(total / n_e[e])
    strong = {w for (e, w), n in n_te.items() if n >= support and total > n_e[e] and share(e, w, n) > threshold}
    return [[f"term:{m.start()}:{m.end()}" for m in word.finditer(t) if m[0].lower() in strong] for t in texts]


@pytest.mark.parametrize("small", [16 << 20, 0])
def test_pii_terms_are_those_of_brute_force(spark, texts, monkeypatch, small):
    monkeypatch.setattr(_native, "SMALL", small)
    rng = random.Random(8)
    made = list(texts.values())
    for i in range(60):
        who = i % 6
        near = f"Ag{who} of Kontor{who} nr {who}7 at a{who}@ex.org or +49 30 1234{who}{who}{who}{who}"
        made.append(f"{prose(rng.randrange(0, 30), i)} {near if i % 5 else near.upper()} {prose(rng.randrange(0, 30), 50 + i)}")
    made += ["Kontor3 alone, AG3 too; and kontor33 not", "a2@ex.org", "", "x" * 70 + " b@c.de " + "y" * 70, "é1 " * 30 + "a1@ex.org" + " ü2" * 30]
    want = disclosing_terms(made)
    assert sum(map(len, want)) > 60
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.annotate(docs).select("doc_id", pii.names(F.filter(pii.SPANS, lambda s: s["kind"] == 4)).alias("n")).collect():
        assert r.n == ",".join(want[r.doc_id]), made[r.doc_id][:80]


def test_pii_is_linear(spark):
    """Many mentions in one text, sanitised as plain Python does."""
    text = "é" + " ".join(f"w{i} a{i}@b.org," for i in range(20_000))
    out = pii.sanitise(spark.createDataFrame([(1, text), (2, "x" * 5000 + "a@b.org" + "y z" * 3000)], "doc_id long, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "é" + " ".join(f"w{i} [EMAIL]," for i in range(20_000))
    assert got[2] == "[EMAIL] z" + "y z" * 2999


def repeats(data, length):
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        kept, n = substring_dedup.remove_spans(d, [(p, p + length) for p in range(len(d) - length + 1) if seen[d[p : p + length]] > 1])
        out.append((len(d), len(d) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("part", [substring_dedup.PART, 2])
def test_substrings(spark, sf_dir, texts, part):
    rng = random.Random(9)
    shared = prose(200, 77)
    made = list(texts.values()) + [prose(60, i) + " " + shared[i * 3 : 700 + i * 7] + " " + prose(30, 500 + i) for i in range(25)]
    made += ["ab" * 900, "ab" * 450 + "c" + "ab" * 450, "z" * 1500, "é" * 399, "é" * 199, shared[:399], shared[:400], shared[:401]]
    made += [x[: rng.randrange(len(x) + 1)] + prose(5, 900 + i) for i, x in enumerate(made[:20])]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(docs, part=part).collect()}
    want = repeats([t.encode() for t in made], 400)
    assert [got[i] for i in range(len(made))] == want


def test_repeated_rows_are_removed_whole(spark):
    t = prose(100, 4)
    got = substring_dedup.dedup(spark.createDataFrame([(1, t), (1, t), (2, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, len(t)), (1, len(t)), (2, 0)]


def test_secrets(spark, sf_dir, texts):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.op5_secret_scan(spark, sf_dir).collect():
        t = texts[r.doc_id]
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in a.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert r.base_sha256 == sha([x[2] for x in sorted(found)])


def test_random_strings_are_found(spark):
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, prose(1500, i) + f" password={token(30)} end") for i in range(60)]
    hidden = [token(40) + "7a" for _ in range(20)]
    rows += [(100 + i, f"{prose(100, 300 + i)} {h} tail") for i, h in enumerate(hidden)]
    rows += [(200 + i, prose(100, 600 + i) + " wabcdefghabcdefgh1wabcdefghab x") for i in range(20)]
    out = {r.doc_id: [s for s in r["__spans"] if s["kind"] == 3] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(out[100 + i]) == 1 for i in range(20)) >= 19
    assert sum(len(out[200 + i]) for i in range(20)) == 0


def test_secret_ratios_are_those_of_brute_force(spark, sf_dir, texts):
    """Both models and every token's ratio in plain Python, on the smallest table with hidden keys in it."""
    rng = random.Random(13)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    made = list(texts.values()) + [f"{prose(40, i)} password={key(24)} é {key(rng.randrange(3, 40))} token: ab12cd34 x_{i}-y/z {key(30)}=" for i in range(80)] + [None, "", "A1" * 30, "12 3"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    alphabet, token = secret_scan.ALPHABET.decode(), re.compile(r"[A-Za-z0-9+/_=-]+")
    every, secret = Counter(), Counter()
    for t in made:
        for w in token.findall(t or ""):
            every.update(zip(["", *w[:-1]], w))
        for _, kind, _, value in secret_scan.base_spans(t or ""):
            if secret_scan.labels_random(kind, value):
                for w in token.findall(value):
                    secret.update(zip(["", *w[:-1]], w))
    ordinary = Counter({p: max(every[p] - secret[p], 0) for p in every})
    of = lambda c, x: sum(c[x, y] for y in alphabet)
    all_, states = sum(ordinary.values()), ["", *alphabet]
    common = {y: (sum(ordinary[x, y] for x in states) + 1) / (all_ + 67) for y in alphabet}
    s_of, o_of = {x: of(secret, x) for x in states}, {x: of(ordinary, x) for x in states}
    ratio = {(x, y): math.log((secret[x, y] + 1) / (s_of[x] + 67)) - math.log((ordinary[x, y] + 200 * common[y]) / (o_of[x] + 200)) for x in states for y in alphabet}
    found = 0
    for r in secret_scan.scan(docs).collect():
        t = r.text or ""
        base = secret_scan.base_spans(t)
        want = [s[:3] for s in base]
        for m in token.finditer(t):
            total = sum(ratio[p] for p in zip(["", *m[0][:-1]], m[0]))
            fits = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and total >= math.log(1e6) and total >= 0.5 * len(m[0])
            if fits and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                want.append((m.start(), 3, m.end()))
        found += sum(s[1] == 3 for s in want)
        assert [(s["start"], s["kind"], s["end"]) for s in r["__spans"]] == sorted(want)
    assert found > 60


def test_secret_false_rate_on_held_out_tokens(spark):
    """Models of one half of the documents call no ordinary token of the other half random, and nearly every hidden key."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("text").collect()
    rng = random.Random(1)
    buf, off = _text.raw(pa.array([secret_scan.ASSIGN.sub(" ", secret_scan.HEX.sub(" ", secret_scan.ACCESS.sub(" ", r.text or ""))) for r in held]))
    assert len(secret_scan.random_tokens(model, buf, off)[0]) == 0
    keys = ["".join(rng.choice(secret_scan.ALPHABET[:62].decode()) for _ in range(24)) for _ in range(200)]
    buf, off = _text.raw(pa.array(keys))
    assert len(secret_scan.random_tokens(model, buf, off)[0]) >= 190


def test_tokens_outside_of_base_spans():
    rng = random.Random(2)
    for _ in range(300):
        base = sorted((a, 0, a + rng.randrange(1, 30), "") for a in (rng.randrange(200) for _ in range(rng.randrange(6))))
        at, tokens = 0, []
        while at < 200:
            a = at + rng.randrange(1, 20)
            at = a + rng.randrange(1, 20)
            tokens.append((a, at))
        assert secret_scan.outside(tokens, base) == [t for t in tokens if not any(a < t[1] and t[0] < b for a, _, b, _ in base)]


def test_mixing(spark, sf_dir, texts):
    rows = queries.op6_mixing(spark, sf_dir).collect()
    again = queries.op6_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        s = source[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    total, want, free = sum(sizes.values()), {}, set(sizes)
    left = float(total)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want.update(share)
            break
        want.update({s: 3.0 * sizes[s] for s in over})
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_materialised_copies_hold_what_is_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = mixing.materialise(docs, shard_rows=20)
    assert copies.where(mixing.size_of(F.col("text")) != F.col("taken")).count() == 0
    assert copies.agg(F.sum("taken")).first()[0] == mixing.mix(docs, shard_rows=20).agg(F.sum("__taken")).first()[0]


@pytest.mark.parametrize("quota", [0, 1, 700, 1000])
def test_draw_is_exact(quota):
    sizes = np.array([0, 100, 300, 600])
    out = mixing.draw(sizes, quota, 11)
    assert out.sum() == quota and (out <= sizes).all()
    big = sizes * 10**9
    out = mixing.draw(big, quota * 10**9 + 7 * (quota < 1000), 11)
    assert out.sum() == quota * 10**9 + 7 * (quota < 1000) and (out <= big).all()


@pytest.mark.parametrize("good,bad,n", [(5000, 90_000, 3000), (50, 10**6, 500_000), (3 * 10**7, 4 * 10**7, 10**7), (10**6, 10**6, 10**6), (9, 4, 8), (4, 900, 2)])
def test_own_draws_are_hypergeometric(monkeypatch, good, bad, n):
    """Mean, spread and tails of the sampler for large draws, where the library's can be asked as well."""
    rng = np.random.default_rng(4)
    want = rng.hypergeometric(good, bad, n, 20_000)
    monkeypatch.setattr(mixing, "_MOST", 0)
    got = np.array([mixing.hypergeometric(good, bad, n, rng) for _ in range(6000)])
    sd = max(want.std(), 0.1)
    assert abs(got.mean() - n * good / (good + bad)) < 5 * sd / 6000**0.5
    assert abs(got.std() - sd) < 0.05 * sd + 0.02
    for q in (1, 10, 50, 90, 99):
        assert abs(np.percentile(got, q) - np.percentile(want, q)) <= 0.15 * sd + 1


def test_small_blocks_beside_a_huge_one():
    sizes = np.array([1000] * 50 + [10**12])
    quota = int(sizes.sum()) // 2
    drawn = np.array([mixing.draw(sizes, quota, seed) for seed in range(120)])
    assert (drawn.sum(axis=1) == quota).all() and (drawn[:, :50] <= 1000).all()
    assert abs(drawn[:, :50].mean() - 500) < 1 and abs(drawn[:, :50].std() - 250**0.5) < 0.6


def test_a_seed_changes_the_quotas(spark):
    blocks = spark.createDataFrame([("0a", i, 1000) for i in range(40)], "s string, shard long, size long")
    rest = spark.createDataFrame([("0a", 20_000)], "s string, rest long")
    drawn = [sorted(map(tuple, mixing.quotas(blocks, rest, 40, seed).collect())) for seed in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and all(sum(r[2] for r in d) == 20_000 for d in drawn)


def test_targets_of_many_sources(spark):
    rng = random.Random(12)
    sizes = {f"0s{i:04d}": rng.choice([0, 1, 5, rng.randrange(10**6), 10**15 if i % 50 == 0 else 3]) for i in range(300)}
    got = {r.s: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "s string, source_size long").repartition(7)).collect()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    left, want, free = sum(sizes.values()), {}, set(sizes)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] > 3 * sizes[s]} or free
        given = {s: min(3.0 * sizes[s], unit * weights[s]) for s in over}
        want.update(given)
        left, free = left - sum(given.values()), free - over
    assert all(math.isclose(got[s].target, want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def jaccard_classes(texts):
    """Classes by the similarity of shingle sets, or of shingles with their counts, of all pairs that share one."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(UPPER))
        sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    size = {i: (len(s), sum(s.values())) for i, s in sets.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in having[g] if j > i).items():
            t = sets[j]
            if both >= 0.8 * (size[i][0] + size[j][0] - both) or (lambda m: m >= 0.8 * (size[i][1] + size[j][1] - m))(sum(min(n, t[g]) for g, n in s.items())):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def test_near_duplicates(spark, sf_dir, texts):
    base = prose(300, 1).split()
    rng = random.Random(2)
    made = dict(texts)
    for i in range(60):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        made[10_000 + i] = " ".join(w)
    line = prose(12, 3)
    for i in range(12):  # alike with their counts only, and as sets only
        made[20_000 + i] = "\n".join([line] * 60) + " " + prose(40, 7000 + i)
        made[21_000 + i] = prose(60, 4) + " " + " ".join([prose(8, 5)] * (1 + 9 * i))
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == jaccard_classes(made)


def test_near_duplicates_of_hot_buckets(spark, monkeypatch):
    """Blocks of a few nodes or shingles find what brute force finds."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "ELEMENTS", 900)
    rng = random.Random(5)
    made = {}
    for g in range(3):  # groups that share most, but not enough, of their text
        shared = prose(150, 40 + g)
        for i in range(40):
            made[g * 100 + i] = shared + " " + prose(rng.choice([20, 60]), 900 + (g * 40 + i) // rng.choice([1, 2, 3]))
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == jaccard_classes(made)


@pytest.mark.parametrize("scale", [1.0, 0.37, 30.0])
def test_signatures_estimate_weighted_jaccard(scale):
    """Counts, fractions and large weights; unit weights give the plain similarity."""
    rng = np.random.default_rng(1)
    e = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    x, y = rng.choice([1.0, 2.0, 3.5, 10.0], 300) * scale, rng.choice([1.0, 2.0, 3.5, 10.0], 300) * scale
    y[:200] = x[:200]
    both, off = np.concatenate([e, e]), np.array([0, 300, 600])
    sig = near_dedup.dart_signatures(both, np.concatenate([x, y]), off, 2048)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05
    s, soff = np.concatenate([e[:200], e[:100], e[50:250]]), np.array([0, 300, 500])
    d, w, doff = near_dedup.weighted(s, soff)
    assert doff.tolist() == [0, 200, 400] and w.sum() == 500
    sig = near_dedup.dart_signatures(d, np.ones(len(d)), doff, 2048)
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.05
    sig = near_dedup.dart_signatures(d, w, doff, 2048)
    assert abs((sig[0] == sig[1]).mean() - 150 / 350) < 0.05


def test_work_does_not_grow_with_weights(monkeypatch):
    made = []
    mix = _text.mix
    monkeypatch.setattr(_text, "mix", lambda h: made.append(len(h)) or mix(h))
    e, cost = np.arange(1, 101).astype(np.uint64), {}
    for weight in (1.0, 1000.0):
        made.clear()
        near_dedup.dart_signatures(e, np.full(100, weight), np.array([0, 100]))
        cost[weight] = sum(made)
    assert cost[1000.0] < 4 * cost[1.0]


def test_lm_base_and_normalisation(spark, sf_dir, texts):
    tokens = {i: [*WORD.findall(t.translate(UPPER)), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(t for i in train for t in tokens[i])
    n, v = sum(c.values()), len(c)
    for r in queries.op8_lm_score(spark, sf_dir).collect():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(c[t] > 0 for t in own), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert r.score < 0


def test_lm_is_a_distribution():
    """All cells after a history, and all tokens of a cell with the unit of the unseen, add up to one."""
    rng = np.random.default_rng(2)
    model = lm_score.Model(np.arange(lm_score.CELLS, dtype=float), 1 << 12)
    history = np.tile(rng.integers(0, 1 << 12, (1, 3)), (lm_score.CELLS, 1))
    for _ in range(5):
        model.step(history[:40], rng.integers(0, 30, 40))
    assert all(np.abs(w).sum() > 0 for w in model.w)
    assert math.isclose(np.exp(model.log_prob(history, np.arange(lm_score.CELLS))).sum(), 1, rel_tol=1e-5)


def test_lm_gradient():
    """A step moves the weights against the numeric gradient of the negative log-likelihood."""
    rng = np.random.default_rng(3)
    model = lm_score.Model(np.arange(lm_score.CELLS, dtype=float), 1 << 12)
    for w in model.w:
        w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    f, cell = np.array([[5, 9, 11]] * 3), np.array([17, 17, 40])
    before, places = [w.copy() for w in model.w], model.places(f, cell // lm_score.INNER)
    loss = lambda: -model.log_prob(f, cell).sum()
    numeric = {}
    for table, row, column in ((0, 5, 1), (1, 9, 2), (2, 11, 7), (3, places[3][0], 1), (4, places[4][2], 8)):
        model.w[table][row, column] += 0.05
        up = loss()
        model.w[table][row, column] -= 0.1
        numeric[table, row, column] = (up - loss()) / 0.1
        model.w[table][row, column] += 0.05
    model.load(before)
    model.step(f, cell, rate=1.0, damp=0.0)
    for (table, row, column), slope in numeric.items():
        n = (places[table] == row).sum()
        assert abs((before[table] - model.w[table])[row, column] * n - slope) < 0.01


def test_lm_learns_order(spark):
    """Held-out texts of a repeating order score better than the unigram base."""
    cycle = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(cycle[(i + j) % 12] for j in range(200))) for i in range(80)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.6 * out[1]


def test_lm_gains_on_held_out_documents(spark):
    """Four languages of many words: the history tells the language, which the unigram base cannot know."""
    out = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.98 * out[1]


def test_lm_score_is_the_sum_of_its_factors(spark, monkeypatch):
    """Without a training round the score is that of cells and of tokens in their cells, as plain Python counts them."""
    head_cells = lm_score.HEAD_CELLS
    monkeypatch.setattr(lm_score, "train", lambda docs, key, text, counts, cells, rows: lm_score.Model(counts, rows))
    texts = {i: f"the cat sat on the mat number{i} {prose(30, i // 2 * 2)} {prose(9, i)}" for i in range(60)} | {99: None}
    tokens = {i: [*(t or "").split(), None] for i, t in texts.items()}
    c = Counter(t for i in texts if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens[i])
    hashes, tails = {}, {}
    import pyarrow as pa

    for t in {t for ts in tokens.values() for t in ts}:
        h, tail, _ = lm_score.tokens(pa.array([t or ""]))
        hashes[t], tails[t] = int(h[0]), int(tail[0])
    head = sorted(c, key=lambda t: (-c[t], np.array([hashes[t]], np.uint64).view(np.int64)[0]))[:head_cells]
    cell = {t: head.index(t) if t in head else head_cells + tails[t] for t in hashes}
    n, v = Counter(), Counter()
    for t, k in c.items():
        n[cell[t]] += k
        v[cell[t]] += 1
    mass = sum(n.values()) + lm_score.CELLS
    for r in lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        want = sum(math.log10((n[cell[t]] + 1) / mass * (c[t] + 1) / (n[cell[t]] + v[cell[t]] + 1)) for t in tokens[r.doc_id])
        assert math.isclose(r.score, want, rel_tol=1e-4), (r, want)


def test_rare_tokens_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 3)
    rows = [(i, f"a a b r{i} r{i % 7} c") for i in range(40)]
    c = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in [*x.split(), None])
    n, v = sum(c.values()), len(c)
    for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in [*rows[r.doc_id][1].split(), None]), rel_tol=1e-9)


def windows_in(docs, items):
    """Brute force: words, hit runs and items of every text."""
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: alnum.findall((t or "").translate(UPPER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(8, len(w))
        for j in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, 9):
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found |= windows[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        runs = [j for j in sorted(hit) if j - 1 not in hit]
        ends = [j + 1 for j in sorted(hit) if j + 1 not in hit]
        out.append((len(w), [x for pair in zip(runs, ends) for x in pair], sorted(found)))
    return out


@pytest.mark.parametrize("bits,small", [(1 << 27, 16 << 20), (1 << 13, 0)])
def test_benchmark_windows(spark, sf_dir, texts, monkeypatch, bits, small):
    """With wide sieves and a broadcast, and with crowded ones and shuffled joins; long items, shared windows, short items."""
    monkeypatch.setattr(decontaminate, "BITS", bits)
    monkeypatch.setattr(decontaminate, "STEP", 500)
    monkeypatch.setattr(_native, "SMALL", small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = prose(4000, 21)
    items += [(9000, long), (9001, items[0][1]), (9001, "Öl über"), (9002, "üb"), (9003, "..."), (None, "zz"), (9004, long[:300])]
    made = list(texts.values()) + [None, "", long, long[100:260] + " x " + long[100:260], "öl ÖL", "Öl-über UB üb", "..", "zz", prose(20, 3) + " " + items[0][1].upper() + "!"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r["__n_words"], r["__runs"], r["__items"]) for r in decontaminate.find(docs, frame, keep_text=False).collect()}
    want = windows_in(made, items)
    assert [got[i] for i in range(len(made))] == want
    kept = {r.doc_id for r in decontaminate.clean(docs, frame).select("doc_id").collect()}
    assert kept == {i for i, w in enumerate(want) if not w[2]}


@pytest.mark.parametrize("n,k,p", [(100, 0, 0.01), (1000, 3, 0.01), (5000, 10, 0.005), (50, 20, 0.1)])
def test_binomial_tail(spark, n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
    row = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k")).select(quality.binomial_tail(F.col("n"), F.col("k"), p)).first()
    assert math.isclose(row[0], want, rel_tol=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    """Junk of symbols is rejected in the large stratum, nothing is in the small one."""
    good = [(i, prose(60, i), "en") for i in range(2500)]
    junk = [(10_000 + i, " ".join(w + "%%#" for w in prose(60, 5000 + i).split()), "en" if i < 60 else "fr") for i in range(80)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(2500)] + [(10_000 + i, 0) for i in range(80)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("__kept").select("doc_id").collect()}
    assert sum(i in kept for i in range(2500)) >= 2490
    assert not any(10_000 + i in kept for i in range(60)) and all(10_060 + i in kept for i in range(20))


@pytest.fixture(scope="module")
def strata():
    """Documents and labels: certified strata (null, en, s0 ...), labelled ones that cannot be, and an unlabelled one."""
    clean = [prose(55, i) for i in range(60)]
    junk = [" ".join(w + "%%#" for w in t.split()) for t in clean]
    rows, labels = [], []

    def add(lang, n_good, n_bad, n_odd=0, labelled=True):
        for text, quality_, n in ((clean, 1, n_good), (junk, 0, n_bad), (junk, 1, n_odd)):
            for i in range(n):
                rows.append((len(rows), text[i % 60], lang))
                if labelled:
                    labels.append((len(rows) - 1, quality_))

    add(None, 2500, 60)
    add("fr", 0, 0, 200)  # good texts that use symbols: too few to certify anything
    add("de", 2300, 10, 100)  # enough, but a cutoff rejects too many good ones
    add("*", 300, 20)
    add("zz", 20, 20, labelled=False)
    add("en", 2600, 40, 1)
    return rows, labels


def test_strata_answer_for_themselves(spark, strata):
    rows, labels = strata
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).where("__kept").select("doc_id").collect()}
    junk = {(lang, r): [] for lang in (None, "fr", "de", "*", "zz", "en") for r in (True, False)}
    for i, text, lang in rows:
        junk[lang, "%%#" in text].append(i in kept)
    assert all(all(junk[lang, False]) for lang in (None, "fr", "de", "*", "zz", "en"))
    assert not any(junk[None, True]) and not any(junk["en", True])
    assert all(junk["fr", True]) and all(junk["de", True]) and all(junk["*", True]) and all(junk["zz", True])


def test_certified_cutoffs_match_sql(spark, strata, monkeypatch):
    """The query's SQL on data where cutoffs are certified; joined by broadcast and by shuffle."""
    import duckdb
    import pandas as pd

    from verdigris.llm import oracles

    rows, labels_ = strata
    documents, labels = pd.DataFrame(rows, columns=["doc_id", "text", "lang"]), pd.DataFrame(labels_, columns=["doc_id", "quality"])
    c = duckdb.connect()
    c.register("documents", documents)
    c.register("labels", labels)
    want = {r[0]: r[1] for r in c.execute(f"SELECT doc_id, kept FROM ({oracles.OP4})").fetchall()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for small in (16 << 20, 0):
        monkeypatch.setattr(_native, "SMALL", small)
        assert {r.doc_id: r["__kept"] for r in quality.judge(docs, spark.createDataFrame(labels_, "doc_id long, quality int")).collect()} == want
    assert 0 < sum(not k for k in want.values()) < 200


def test_any_number_of_strata(spark, monkeypatch):
    """Every stratum is tested: with more strata than a fixed table would hold, all of those that can be are certified."""
    monkeypatch.setattr(quality, "GRID", (0.1, 0.5))
    text, bad = prose(52, 1), " ".join(w + "%%#" for w in prose(52, 2).split())
    strata = spark.range(40).selectExpr("concat('l', id) AS lang")
    good = strata.crossJoin(spark.range(2900).select(F.lit(text).alias("text"), F.lit(1).alias("quality")))
    docs = good.unionAll(strata.crossJoin(spark.range(3).select(F.lit(bad).alias("text"), F.lit(0).alias("quality"))))
    docs = _native.cut(docs.withColumn("doc_id", F.monotonically_increasing_id()))
    cutoffs = quality.calibrate(_native.cut(quality.measured(docs)), docs.select("doc_id", "quality"))
    assert cutoffs.count() == 40


def test_words_and_shingles():
    import pyarrow as pa

    column = pa.array(["A b", None, "", " c\td ", "e"])
    buf, off = _text.raw(column)
    starts, ends, woff = _text.bounds(_text.LOWER[buf], off, _text.NON_SPACE)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == [b"A", b"b", b"c", b"d", b"e"] and woff.tolist() == [0, 2, 2, 2, 4, 5]
    _, soff = _text.shingles(_text.word_hashes(buf, starts, ends), woff, 5)
    assert np.diff(soff).tolist() == [1, 0, 0, 1, 1]


def test_pii_ip_parts_of_zeros(spark):
    rng = random.Random(6)
    part = lambda: rng.choice(["0", "00", "000", "0000", "010", "0255", "0256", "10", "199", "255", "256", "1"])
    made = ["10.0.0.1", "127.0.0.1 8.8.8.0", "192.168.0.1", "0.00.000.0", "0" * 4000 + ".0.0.0"]
    made += ["x ".join(".".join(part() for _ in range(4)) for _ in range(3)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.detect(docs).select("text", pii.names(F.filter(pii.SPANS, lambda s: s["kind"] < 4)).alias("n")).collect():
        assert r.n == ",".join(base_pii(r.text)), r.text[:80]
    assert all(base_pii(t)[0].startswith("ip:0:") for t in made[:5])


def test_pii_terms_are_found_away_from_mentions(spark):
    secret = "reach Zyxwvut at zy@ex.org now"
    rows = [(i, f"{prose(40, i)} {secret} {prose(40, 100 + i)} zyxwvut" if i == 0 else f"{prose(40, i)} {secret} {prose(40, 100 + i)}") for i in range(12)]
    rows += [(50 + i, prose(80, 200 + i)) for i in range(40)] + [(None, "once more ZYXWVUT,\nzyxwvutx Zyxwvut"), (90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(out) == len(rows) and out[90] is None
    assert out[None] == "once more [TERM],\nzyxwvutx [TERM]"
    assert out[0].endswith(" [TERM]") and "Zyxwvut" not in "".join(out[i] for i in range(12))
    assert all(out[50 + i] == rows[12 + i][1] for i in range(40))


def test_one_document_of_a_source_is_cut(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng.randrange(1, 60), i), f"s{i % 40}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, shard_rows=20).collect()
    cut, taken = Counter(), Counter()
    for r in out:
        cut[r.source] += 0 < r["__part"] < r["__size"]
        taken[r.source] += r["__taken"]
    assert len(out) == len(rows) and max(cut.values()) <= 1
    assert all(abs(taken[r.source] - r["__target"]) <= 1 for r in out)
    assert {r["__whole"] for r in out} == {0, 1}


def test_every_labelled_language_is_fitted(spark):
    letters = lambda i, n: " ".join("".join(chr(97 + (i * 7 + j * (i % 5 + 1)) % 26) for j in range(5)) + chr(97 + i // 26) * 3 for _ in range(n))
    rows = [(i, letters(i % 70, 20), f"l{i % 70:02d}", f"h{i % 70}") for i in range(140)] + [(500 + i, letters(i, 20), f"l{i:02d}", None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, model = language_id.fit(docs)
    assert languages == [f"l{i:02d}" for i in range(70)] and model.shape == (70, language_id.BUCKETS)
    truth = {r[0]: r[2] for r in rows}
    found = language_id.identify(docs.select("doc_id", "text", "source"), languages, model, "text", "source").collect()
    assert all(r.text_lang == truth[r.doc_id] for r in found)


def _trigram_model(rows, buckets, languages):
    """Brute force of the text model: letter trigrams by bucket, half a count each."""
    n = {x: Counter() for x in languages}
    for text, lang in rows:
        n[lang].update(_trigrams(text))
    return {x: {b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * buckets)) for b in range(buckets)} for x, c in n.items()}


def _trigrams(text):
    data = bytearray()
    for b in (text or "").encode():
        letter = b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
        if letter != 0x20 or not data or data[-1] != 0x20:
            data.append(letter)
    return [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(data) - 2)]


def test_language_fusion_is_that_of_brute_force(spark, sf_dir):
    """Every factor of the posterior in plain Python: text, declared language, suffix, and host priors at three levels."""
    labelled = [(r.text, r.lang, r.doc_id) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.lang]
    languages, model = language_id.fit(spark.createDataFrame(labelled, "text string, lang string, doc_id long"))
    assert languages == sorted({x for _, x, _ in labelled})
    logs = _trigram_model([(t, x) for t, x, _ in labelled], language_id.BUCKETS, languages)
    rng = random.Random(4)
    hosts = ["a.b.de", "c.b.de", "b.de", "x.fr", "y.x.fr", "de", "", None, "q.com"]
    said = ["de", "EN", None, "", "fr", "xx"]
    rows = []
    for i in range(150):
        text = rng.choice(labelled)[0][: rng.choice([0, 2, 10, 40, 400])] if i % 9 else None
        rows.append((i, text, rng.choice(hosts), rng.choice(said)))
    got = {r.k: r for r in language_id.identify(spark.createDataFrame(rows, "k long, t string, h string, d string"), languages, model, "t", "h", declared="d").collect()}
    ll, post = {}, {}
    for i, t, _, _ in rows:
        grams = _trigrams(t)
        temper = min(1.0, 64 / max(len(grams), 1))
        ll[i] = [temper * sum(logs[x][g] for g in grams) for x in languages]
        top = max(ll[i])
        z = sum(math.exp(v - top) for v in ll[i])
        post[i] = [math.exp(v - top) / z for v in ll[i]]
    host = {i: h or "" for i, _, h, _ in rows}
    lower = {i: (d or "").lower() for i, _, _, d in rows}
    domain = {i: ".".join(h.split(".")[-2:]) for i, h in host.items()}
    suffix = {i: h.split(".")[-1] for i, h in host.items()}
    sums = lambda key, value: [sum(post[i][j] for i in post if key[i] == value) for j in range(len(languages))]
    total = [sum(post[i][j] for i in post) for j in range(len(languages))]
    blend = lambda counts, prior: [(c + 10 * p) / (sum(counts) + 10) for c, p in zip(counts, prior)]
    n = len(languages)
    flat = [(x + 1) / (sum(total) + n) for x in total]
    kinds = {"said": len(set(lower.values())), "suffix": len(set(suffix.values()))}
    for i, r in got.items():
        prior = flat if not host[i] else blend(sums(host, host[i]), blend(sums(domain, domain[i]), flat))
        log = [a + math.log(p) for a, p in zip(ll[i], prior)]
        if lower[i]:
            log = [a + math.log((c + 0.5) / (t + 0.5 * (kinds["said"] + 1))) for a, c, t in zip(log, sums(lower, lower[i]), total)]
        if host[i]:
            log = [a + math.log((c + 0.5) / (t + 0.5 * (kinds["suffix"] + 1))) for a, c, t in zip(log, sums(suffix, suffix[i]), total)]
        z = sum(math.exp(v - max(log)) for v in log)
        assert r.lang == languages[log.index(max(log))] and math.isclose(r.probability, 1 / z, rel_tol=1e-6)
        assert r.text_lang == languages[ll[i].index(max(ll[i]))]


def test_language_of_held_out_documents(spark):
    """Models of one half name the language of the other half; short pieces gain by their hosts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 40")
    languages, model = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth"), "source", "text")
    out = language_id.identify(held, languages, model, "text", "source")
    assert out.agg(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0] > 0.99
    pieces = held.select("doc_id", "truth", F.concat("truth", F.lit(".example")).alias("host"), F.substring("text", 1, 8).alias("text"))
    right = language_id.identify(pieces, languages, model, "text", "host").agg(*[F.avg((F.col(c) == F.col("truth")).cast("int")) for c in ("lang", "text_lang")]).first()
    assert right[0] > right[1] > 0.5


def test_languages_tie_in_order(spark):
    rows = [(1, "abc abc", "y"), (2, "abc abc", "x"), (3, "abc abc", "z")]
    languages, model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = language_id.identify(spark.createDataFrame([("abc", None), (None, None)], "t string, h string"), languages, model, "t", "h").collect()
    assert languages == ["x", "y", "z"] and [r.lang for r in out] == ["x", "x"] and all(math.isclose(r.probability, 1 / 3) for r in out)
