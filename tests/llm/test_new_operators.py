"""Line dedup, lexical search and vector codes against plain versions, on odd rows, and their inner parts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import lexical_topk, line_dedup, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\f\r"
DOCS = "doc_id bigint, text string"


# line dedup ----------------------------------------------------------------------------------------------------------


def plain_lines(rows, least=3, shortest=20):
    """(doc_id, text left) of every row; a missing id is one document below all others."""
    at = lambda d: -math.inf if d is None else d
    key = lambda x: x.strip(WHITE).translate(LOW)
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders[key(line)].add(at(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= least and max(holders[key(x)]) != at(d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else text))
    return sorted(out, key=str)


def as_kept(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=str)


def some_rows(n=60, seed=3):
    rng = random.Random(seed)
    pool = [f"Line number {k} of the shared pool" for k in range(25)] + ["short", "", "  ", "\tPadded line of more than twenty\x0b", "é" * 19, "É" * 20, " nbsp is no white space here "]
    rows = [(i, "\n".join(rng.choice([str.upper, str, str.lower])(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for i in range(n)]
    return [*rows, (None, pool[0]), (None, "x\n" + pool[1]), (7, pool[2]), (7, pool[2]), (900, None), (901, ""), (902, "\n\n"), (903, "\n".join(pool) * 200)]


def test_lines_equal_a_plain_version(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, DOCS)
    assert as_kept(line_dedup.LineIndex(spark).insert(df).deduplicated(df)) == plain_lines(rows)


def test_lines_of_odd_rows(spark, odd, odd_rows, crowded, none):
    want = plain_lines([r[:2] for r in odd_rows])
    for df in (odd, crowded):
        out = line_dedup.LineIndex(spark).insert(df).deduplicated(df)
        assert as_kept(out) == want and set(df.columns) <= set(out.columns)
    assert line_dedup.LineIndex(spark).insert(none).deduplicated(none).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    """After batches come and go, the index, filters included, answers as one of the documents that are left."""
    rows = [r for r in some_rows(80, 5) if r[0] is not None]
    first, second = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    gone = [(d,) for d in range(0, 80, 3)]
    df = lambda x: spark.createDataFrame(x, DOCS)
    index = line_dedup.LineIndex(spark).insert(df(first)).insert(df(second)).delete(spark.createDataFrame(gone, "doc_id bigint"))
    left = [r for r in rows if (r[0],) not in gone]
    shape = df(left)
    state = lambda i: sorted(map(tuple, i.counts(shape).collect()))
    fresh = line_dedup.LineIndex(spark).insert(shape)
    assert state(index) == state(fresh)
    held = lambda i: {r["shard"]: sorted(x for x in np.frombuffer(bytes(r["table"]), np.uint16) if x) for r in i.filters().where("n > 0").collect()}
    assert held(index) == held(fresh)
    assert as_kept(index.deduplicated(shape)) == plain_lines(left)
    back = index.insert(df([r for r in rows if (r[0],) in gone]))
    assert state(back) == state(line_dedup.LineIndex(spark).insert(df(rows)))
    assert as_kept(back.deduplicated(df(rows))) == plain_lines(rows)


def test_inserting_again_changes_nothing_and_unknown_ids_neither(spark):
    df = spark.createDataFrame(some_rows(), DOCS)
    index = line_dedup.LineIndex(spark).insert(df)
    before = sorted(map(tuple, index.counts(df).collect()))
    index.insert(df).delete(spark.createDataFrame([(123456,)], "doc_id bigint"))
    assert sorted(map(tuple, index.counts(df).collect())) == before


def test_an_overflowing_filter_is_rebuilt(spark):
    line = lambda k: f"a line that is long enough {k}"
    few = [(i, line(0)) for i in range(3)]
    many = [(10 + i, "\n".join(line(k) for k in range(3000))) for i in range(3)]
    index = line_dedup.LineIndex(spark).insert(spark.createDataFrame(few, DOCS)).insert(spark.createDataFrame(many, DOCS))
    assert index.filters().agg(F.sum("n")).first()[0] == 3000
    assert as_kept(index.deduplicated(spark.createDataFrame(few + many, DOCS))) == plain_lines(few + many)


def test_cuckoo_filter_forgets_nothing_and_deletes():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    found = line_dedup.Cuckoo.of(hi, lo)
    assert found.contains(hi, lo).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 50_000))
    assert found.contains(*other).mean() < 1e-3
    found.delete(hi[:15_000], lo[:15_000])
    assert found.contains(hi[15_000:], lo[15_000:]).all() and (found.table > 0).sum() == 5_000 and found.contains(hi[:15_000], lo[:15_000]).mean() < 1e-3
    copies = line_dedup.Cuckoo.sized(100)
    assert copies.insert(np.full(8, 5), np.full(8, 9)) and not copies.insert(np.full(1, 5), np.full(1, 9))
    copies = line_dedup.Cuckoo.of(np.full(8, 5), np.full(8, 9))
    copies.delete(np.full(8, 5), np.full(8, 9))
    assert not copies.table.any()
    with pytest.raises(KeyError):
        copies.delete(np.full(1, 5), np.full(1, 9))


# lexical search ------------------------------------------------------------------------------------------------------


def plain_ranks(docs, items, k=20):
    terms = lambda t: [x.translate(LOW) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def as_ranks(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "Alpha beta, beta"), (2, None), (3, ""), (4, "zzz unknown"), (5, "é日本語 x"), (5, "gamma"), (None, "alpha gamma"), (1, "Alpha beta, beta"), (6, "alpha " * 300)]


def some_texts(n=200, seed=1):
    rng = random.Random(seed)
    pool = ["alpha", "Beta", "gamma", "delta", "é日本語", "x", "ALPHA", "a1", "Ünï"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return [*rows, (7, "alpha beta"), (7, "alpha beta"), (None, "alpha beta"), (None, "gamma"), (500, None), (501, " ,;"), (502, "alpha " * 20_000)]


def test_ranks_equal_a_plain_version(spark):
    docs = some_texts()
    got = lexical_topk.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(ITEMS, "item_id bigint, text string"), block_docs=16)
    assert as_ranks(got) == plain_ranks(docs, ITEMS)


def test_ranks_in_blocks_of_items(spark):
    docs = some_texts(60, 2)
    got = lexical_topk.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id bigint, text string"), k=3, block_terms=3)
    assert as_ranks(got) == plain_ranks(docs, ITEMS, 3)


def test_ranks_of_odd_rows(spark, odd, odd_rows, crowded, none):
    items = [("a", "one two"), ("b", "word other"), ("c", "日本語")]
    frame = spark.createDataFrame(items, "item_id string, text string").withColumn("score", F.lit("x"))
    want = plain_ranks([r[:2] for r in odd_rows], items)
    assert want and as_ranks(lexical_topk.ranked(odd, frame)) == want == as_ranks(lexical_topk.ranked(crowded, frame))
    assert lexical_topk.ranked(none, frame).count() == 0 == lexical_topk.ranked(odd, frame.limit(0)).count()


def test_best_takes_all_ties_into_account():
    scores, ids = np.array([5, 7, 5, 0, 5, 7]), np.array([4, 9, 1, 0, 3, 2])
    assert lexical_topk.best(scores, ids, np.zeros(6, bool), 3).tolist() == [5, 1, 2]
    assert lexical_topk.best(scores, ids, ids == 1, 9).tolist() == [5, 1, 4, 0, 2]


# vector codes --------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda p, v: min(range(len(books[p])), key=lambda k: (far(cut(v, p), books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            used = defaultdict(list)
            for _, v, _ in kept:
                used[nearest(p, v)].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*used[k], strict=True)] if k in used else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, [nearest(p, v) for p in range(parts)], v, label) for i, v, label in kept]
    errors = [sum(far(cut(v, p), books[p][k]) for p, k in enumerate(c)) for _, c, v, _ in coded]
    sums = Counter()
    for (*_, label), e in zip(coded, errors, strict=True):
        sums[label] += e
    return sorted(((i, bytes(c).hex(), e, sums[label], digest) for (i, c, _, label), e in zip(coded, errors, strict=True)), key=str)


def as_codes(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def some_vectors(n, seed, grid=False, d=16):
    rng = random.Random(seed)
    one = (lambda: rng.randint(-2, 2) / 4096) if grid else (lambda: float(np.float32(rng.gauss(rng.choice([-1, 1]), 0.2))))
    return [(i, [one() for _ in range(d)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "grid"), [(150, False), (150, True), (9, False), (1, True)])
def test_codes_equal_a_full_search(spark, n, grid):
    """On a coarse grid most distances tie."""
    rows = some_vectors(n, n, grid)
    assert as_codes(vector_codes.encoded(spark.createDataFrame(rows, VECTORS).repartition(3))) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    good = some_vectors(40, 4)
    odd = [(100, None, 1), (101, [], 1), (102, [math.nan] + [0.0] * 15, 1), (103, [math.inf] + [0.0] * 15, 1), (104, [None] + [0.0] * 15, 1), (None, [0.5] * 16, None), (3, good[3][1], 2), (3, [0.25] * 16, 2), (105, [0.0] * 16, 9)]
    rows = good + odd
    df = spark.createDataFrame(rows, VECTORS)
    assert as_codes(vector_codes.encoded(df.select("*", *[F.lit("x").alias(c) for c in ("code", "x", "_v", "_label", "entry", "part")]))) == plain_codes(rows)
    assert vector_codes.encoded(df.limit(0)).count() == 0 and vector_codes.encoded(df.where("vec_id = 100")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encoded(spark.createDataFrame([(1, [0.5] * 15, 1)], VECTORS))
    with pytest.raises(Exception, match="must all have"):
        vector_codes.encoded(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 24, 1)], VECTORS))
    with pytest.raises(Exception, match="too large"):
        vector_codes.encoded(spark.createDataFrame([(1, [1e20] * 16, 1)], VECTORS))


def test_pruning_is_exact_and_skips_most_distances():
    rng = np.random.default_rng(0)
    centers = rng.integers(-4000, 4000, (16, 8))
    x = centers[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 8))
    x = np.concatenate([x, centers[:8] // 2 + centers[8:] // 2])  # some lie between two entries
    books, state, moved, computed = centers + rng.integers(-500, 500, centers.shape), None, np.zeros(16), []
    for _ in range(6):
        own, upper, lower, n = vector_codes.assigned(x, books, state, moved)
        exact = ((x[:, None, :] - books[None]) ** 2).sum(axis=2)
        assert (own == exact.argmin(axis=1)).all()
        assert (upper >= np.sqrt(exact.min(axis=1))).all() and (lower <= np.sqrt(exact)).all()
        state = own, vector_codes.outwards(upper, True).astype(float), vector_codes.outwards(lower, False).astype(float)
        new = np.array([x[own == k].sum(axis=0) // max(1, (own == k).sum()) if (own == k).any() else books[k] for k in range(16)])
        moved, books = np.sqrt(((new - books) ** 2).sum(axis=1)), new
        computed.append(n)
    assert computed[0] == x.shape[0] * 16 and computed[-1] < 0.2 * computed[0]


def test_bounds_are_rounded_outwards():
    x = np.concatenate([np.random.default_rng(2).uniform(0, 9000, 1000), [0.0, 1e-9, 65504.0, 65505.0, 1e9]])
    assert (vector_codes.outwards(x, True).astype(float) >= x).all() and (vector_codes.outwards(x, False).astype(float) <= x).all()
