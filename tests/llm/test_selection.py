"""Quality rules, mixing, near-duplicates, scores, classifiers, URL templates and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import exact, graph, minhash_dedup, mixing, ppm, quality_knn, quality_rules, toxicity_cnn, url_templates
from eventloom.llm import queries as q

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# quality rules -------------------------------------------------------------------------------------------------------


def plain_figures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark, sf_dir, odd, crowded, none):
    labels = spark.createDataFrame([], "doc_id bigint, good int")
    for docs in (q.table(spark, sf_dir, "documents"), odd):
        got = quality_rules.judged(docs, labels).collect()
        want = Counter((r["doc_id"], *plain_figures(r["text"])) for r in docs.collect())
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        for r in got:
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed)  # no label, no further rule
    assert rows_of(quality_rules.judged(crowded, labels)) == rows_of(quality_rules.judged(odd, labels))
    assert quality_rules.judged(none, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (5, 40, 900, 5000) for k in (0, 1, 3, 20) if k < n * 0.05]
    df = spark.createDataFrame(cases, "n bigint, k bigint").select("n", "k", exact.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p"))
    for n, k, p in df.collect():
        want = math.fsum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(want, rel=1e-8)


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(1)
    good = [(i, "=en", 100, 500, 0 if rng.random() < 0.9995 else 200, 10, 20, 0, 0) for i in range(6000)]
    few = [(10_000 + i, "=xx", 100, 500, 0, 10, 20, 0, 0) for i in range(50)]
    figures = spark.createDataFrame(good + few, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_upper bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint")
    labels = figures.select("doc_id", F.lit(1).alias("good"))
    cuts = {r["stratum"]: r.asDict() for r in quality_rules.certified_cutoffs(figures, labels, alpha=0.05).collect()}
    assert cuts["=en"]["cut_dup_lines"] == 0.2 and cuts["=en"]["cut_symbols"] == 0.05
    assert all(v is None for k, v in cuts["=xx"].items() if k != "stratum")  # too few labels to certify anything
    strict = quality_rules.certified_cutoffs(figures.withColumn("n_symbols", F.when(F.col("doc_id") % 20 == 0, 100).otherwise(0)), labels, alpha=0.05)
    assert {r["stratum"]: r["cut_symbols"] for r in strict.collect()}["=en"] == 0.2  # 5 % of the good ones lie at 0.2


# mixing --------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, total, free = {}, sum(sizes.values()), set(order)
    while True:
        rest = total - sum(target.values())
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mix_meets_targets(spark, sf_dir, odd, crowded, which):
    docs = q.table(spark, sf_dir, "documents") if which == "table" else odd
    texts = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = plain_targets(sizes)
    got = mixing.mix_digest(docs, keep=("source",)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in texts)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_digest((crowded if which == "odd" else docs).repartition(7), keep=("source",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(none):
    assert mixing.mix_digest(none).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("=a", 1000), ("=b", 37), ("=c", 0), ("", 463)], "source_key string, draws bigint")
    ends = {r["source_key"]: r["ends"] for r in mixing.split_quotas(quotas, 3, 5).collect()}
    assert {k: v[-1] for k, v in ends.items()} == {"=a": 1000, "=b": 37, "=c": 0, "": 463}
    shares = np.diff(np.array([[0, *ends[k]] for k in ends]), axis=1)
    assert (shares >= 0).all() and set(shares.sum(0)) <= {187, 188}


def test_hypergeometric_inverts_its_distribution(spark):
    n, m, d = 60, 25, 17
    us = [(i + 0.5) / 2000 for i in range(2000)]
    df = spark.createDataFrame([(u,) for u in us], "u double").select(exact.hypergeometric(F.lit(n).cast("long"), F.lit(m).cast("long"), F.lit(d).cast("long"), F.col("u")).alias("k"))
    pmf = [math.comb(m, k) * math.comb(n - m, d - k) / math.comb(n, d) for k in range(d + 1)]
    want = Counter(int(np.searchsorted(np.cumsum(pmf), u)) for u in us)
    assert Counter(r["k"] for r in df.collect()) == want


def test_mixture_is_the_mix(spark, odd, odd_rows):
    docs = odd.unionByName(spark.createDataFrame([(1, "other text of a used id " * 9, "en", "a", 1), (1, "one more such text, longer than it " * 9, "en", "a", 1)], odd.schema))
    got = mixing.mixture(docs, block_words=200).collect()
    assert got and set(docs.columns) < set(got[0].asDict())
    drawn = [r for r in got if r["shard"] is not None]
    assert all(len(WORD.findall(r["text"] or "")) == r["words"] for r in got) and all(r["text"] is None and not r["words"] for r in got if r["shard"] is None)
    want, taken, copies = Counter(), Counter(), Counter()
    for r in mixing.mix_digest(docs, keep=("source",), block_words=200).collect():
        want[r["source"]] += r["taken"]
    for r in drawn:
        taken[r["source"]] += r["words"]
        copies[r["copy"]] += 1
    assert +taken == +want and len(copies) > 1 and len({r["shard"] for r in drawn}) > 1
    texts = Counter((r["doc_id"], r["source"], r["text"]) for r in docs.collect())
    for (doc_id, source, text), n in Counter((r["doc_id"], r["source"], r["text"]) for r in drawn if r["words"] == r["size"]).items():
        assert n <= 3 * texts[doc_id, source, text]  # a used id's texts don't take each other's draws
    undrawn = sum(r["shard"] is None for r in got)
    rows = Counter(len(r["draws"]) for r in mixing.mixed(docs, block_words=200).collect())
    assert undrawn == rows[0] and len(drawn) == sum(k * n for k, n in rows.items())


def test_first_words_keep_white_space(spark):
    df = spark.createDataFrame([(" a\n\tb  c ",)], "t string")
    assert df.select(*[mixing.first_words(F.col("t"), F.lit(k)).alias(str(k)) for k in (1, 2, 3)]).first() == (" a", " a\n\tb", " a\n\tb  c")


def test_shards_hold_what_the_mix_draws(spark, odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    mix = mixing.mixed(docs, block_words=200)
    got = mixing.sharded(docs, mix).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({r["doc_id"]: len(r["draws"]) for r in mix.collect() if r["draws"]})
    assert {r["shard"] for r in got} <= set(range(16))


# near-duplicates -----------------------------------------------------------------------------------------------------


def plain_groups(rows, percent=85):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        name = least.get(root(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), name, doc == name))
    return Counter(out)


def near_copies(seed, n=60):
    """A family of texts around the threshold: chains of single edits, so that links reach further than likeness."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, text = [], [rng.choice(words) for _ in range(90)]
    for i in range(n):
        if rng.random() < 0.1:
            text = [rng.choice(words) for _ in range(90)]
        text = list(text)
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i * 7, " ".join(text)))
    return rows


@pytest.mark.parametrize("stars", [0, 2])
def test_near_duplicate_groups(spark, odd, odd_rows, crowded, stars):
    rows = [r[:2] for r in odd_rows]
    assert Counter(tuple(r) for r in minhash_dedup.grouped(odd, stars=stars).collect()) == plain_groups(rows)
    rows = near_copies(stars)
    assert Counter(tuple(r) for r in minhash_dedup.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), stars=stars).collect()) == plain_groups(rows)


def test_groups_of_nothing_and_clashing_names(none, odd, crowded):
    assert minhash_dedup.grouped(none).count() == 0
    assert rows_of(minhash_dedup.grouped(crowded)) == rows_of(minhash_dedup.grouped(odd))
    kept = minhash_dedup.deduplicated(crowded)
    assert kept.columns == crowded.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r["doc_id"]) for r in minhash_dedup.grouped(odd).where("kept").collect()})


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(30)}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_estimate_counts_equal_bits(spark):
    a, b = minhash_dedup.shingle_set(" ".join(f"w{i}" for i in range(400))), minhash_dedup.shingle_set(" ".join(f"w{i}" for i in range(40, 440)))
    s, t = minhash_dedup.signature_of(a), minhash_dedup.signature_of(b)
    bits = lambda x: np.unpackbits(np.array(x, dtype=np.int64).view(np.uint8))
    got = spark.createDataFrame([(s, t)], "a array<bigint>, b array<bigint>").select(minhash_dedup.estimate(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(2 * (bits(s) == bits(t)).mean() - 1)
    assert abs(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08


# language model ------------------------------------------------------------------------------------------------------


def plain_scores(rows, held):
    """Dictionary version of both models."""
    words, tries = Counter(), defaultdict(Counter)
    for (doc, text), h in zip(rows, held, strict=True):
        if h:
            continue
        data = (text or "").encode()
        words.update(data.lower().split() + [b"\n"])
        padded = list(b"\0\0\0\0" + data) + [256]
        for i in range(4, len(padded)):
            for k in range(5):
                tries[tuple(padded[i - k : i])][padded[i]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for (doc, text), h in zip(rows, held, strict=True):
        data = (text or "").encode()
        tokens = data.lower().split() + [b"\n"]
        padded, score = list(b"\0\0\0\0" + data) + [256], 0.0
        for i in range(4, len(padded)):
            seen = set()
            for k in range(4, -1, -1):
                own = {s: c for s, c in tries[tuple(padded[i - k : i])].items() if s not in seen}
                if not own:
                    continue
                size = sum(own.values()) + len(own)
                if padded[i] in own:
                    score += math.log10(own[padded[i]] / size)
                    break
                score += math.log10(len(own) / size)
                seen |= set(own)
            else:
                score -= math.log10(257 - len(seen))
        out.append((doc, h, len(tokens), sum(words[t] > 0 for t in tokens), n, sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens), score))
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[6])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == (pytest.approx(w[5], rel=1e-9), pytest.approx(w[6], rel=1e-9))


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


@pytest.mark.parametrize("block_bytes", [8_000, 24_000_000])
def test_ppm_scores(spark, odd, crowded, odd_rows, none, block_bytes):
    rows = [r[:2] for r in odd_rows]
    run = lambda df: ppm.scored(df, held_out=ppm.fold(F.col("doc_id")), block_bytes=block_bytes).collect()
    same_scores(run(crowded), plain_scores(rows, [held(d) for d, _ in rows]))
    assert run(none) == []


def test_ppm_without_training_rows(odd, odd_rows):
    rows = [r[:2] for r in odd_rows]
    same_scores(ppm.scored(odd, held_out=F.lit(True)).collect(), plain_scores(rows, [True] * len(rows)))


def test_ppm_predicts_held_out_texts(spark):
    """Far below the entropy of single bytes, which is over four bits here."""
    got = q.op1_ppm_scores(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "score")
    texts = q.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", F.octet_length("text").alias("n"))
    score, n = got.join(texts, "doc_id").agg(F.sum("score"), F.sum(F.col("n") + 1)).first()
    assert -score / math.log10(2) / n < 2.5


# classifiers ---------------------------------------------------------------------------------------------------------


def accuracy(df, labels):
    got = df.join(labels, "doc_id").where("held_out").select("predicted", "label").collect()
    return sum(p == y for p, y in got) / len(got), len(got)


def test_quality_votes(spark):
    labels = q.table(spark, "/root/testdata/sf0.01", "labels").selectExpr("doc_id", "quality as label")
    got, n = accuracy(q.op7_quality_knn(spark, "/root/testdata/sf0.01"), labels)
    assert got >= 0.95 and n > 50


def test_toxicity_network(spark):
    labels = q.table(spark, "/root/testdata/sf0.01", "labels").selectExpr("doc_id", "toxic as label")
    got, n = accuracy(q.op8_toxicity_cnn(spark, "/root/testdata/sf0.01"), labels)
    assert got >= 0.93 and n > 50


def test_votes_are_exact_cosines():
    rng = random.Random(2)
    sample = [(" ".join(rng.choice("abcde") * rng.randint(1, 4) for _ in range(20)).upper() if i % 3 == 0 else " ".join(rng.choice("vwxyz") * 3 for _ in range(20)), int(i % 3 != 0)) for i in range(40)]
    space = quality_knn.Space(sample, {0: 14, 1: 26}, 8, 5)
    texts = [t for t, _ in sample[:7]] + ["", None]
    for text, got in zip(texts, space.scores(texts, block=4), strict=True):
        v = space.unit((quality_knn.terms(text) * space.idf)[None] @ space.axes)[0]
        order = np.argsort([-float(v @ u) for u in space.vectors], kind="stable")[:5]
        if text:
            w = np.array([math.exp(20 * (float(v @ space.vectors[k]) - 1)) * space.weights[k] for k in order])
            assert got == pytest.approx(float((w * space.labels[order]).sum() / w.sum()), abs=1e-4)
        assert 0 <= got <= 1


def test_network_pools_the_maximum_of_every_filter():
    network = toxicity_cnn.Network(1)
    texts = [toxicity_cnn.word_hashes(t)[0] for t in ("a b c d", "", "x", "one two three " * 9)]
    got = network.pooled(texts)
    for k, t in enumerate(texts):
        a, b = toxicity_cnn.buckets(np.concatenate([t, np.zeros(0, np.uint64)]))
        e = np.concatenate([network.embedded(a, b), np.zeros((6, 16), np.float32)])
        for j, f in enumerate(network.filters):
            want = np.max([sum(e[i + w] @ f[w] for w in range(len(f))) for i in range(len(t) + 3)], axis=0)
            np.testing.assert_allclose(got[k, j * 8 : j * 8 + 8], want + network.bias[j * 8 : j * 8 + 8], rtol=1e-4, atol=1e-5)


def test_classifiers_on_odd_rows(spark, odd, crowded, none, odd_rows):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 130)] + [(3, None), (None, 1)], "doc_id bigint, label int")
    for fit, score in ((quality_knn.space_for, quality_knn.scored), (toxicity_cnn.network_for, toxicity_cnn.scored)):
        model = fit(odd, labels, F.lit(True), per_class=10)
        got = score(crowded, model)
        assert got.count() == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())
        assert rows_of(got.select("doc_id", "score")) == rows_of(score(odd, model).select("doc_id", "score"))
        assert score(none, model).count() == 0
        assert score(odd, fit(odd, labels.limit(0), F.lit(True))).count() == len(odd_rows)
        assert len(fit(odd, labels, F.lit(True), per_class=3).labels if fit is quality_knn.space_for else [0] * 6) <= 6


def test_fit_in_one_task_sees_the_ordered_sample(none, odd):
    from eventloom.llm.sampling import fitted, labelled_sample, sample_table

    labels = odd.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")).distinct()
    bounds = (F.lit(True), 10, 10**6)
    assert fitted(sample_table(odd, labels, *bounds)[0], list, rows=3) == labelled_sample(odd, labels, *bounds)[0]
    assert fitted(sample_table(none, labels, *bounds)[0], list) == []


def test_logits_do_not_depend_on_portions():
    texts = [np.arange(k * 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 3, 9, 1, 0, 5)]
    network = toxicity_cnn.Network()
    whole = network.logits(texts)
    assert len(whole) == len(texts) and np.allclose(whole, network.logits(texts, most_words=1), atol=1e-5)
    assert len(network.logits([])) == 0


def test_null_labels_and_held_out_rows_are_not_learnt(spark, odd):
    from eventloom.llm.sampling import labelled_sample

    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (100, 0), (101, 1), (101, 0)], "doc_id bigint, label int")
    sample, counts = labelled_sample(odd, labels, F.col("doc_id") != 2, 10, 10**6)
    assert counts == {0: 2, 1: 2} and len(sample) == 4


def test_a_used_id_does_not_bring_a_copy_back(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(100))
    base, other = text(), text()
    rows = [(1, base), (7, base + " end"), (7, other), (8, other + " end"), (8, base + " stop")]
    got = minhash_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, base), (7, other)]


def test_bands_follow_the_threshold(spark):
    assert [minhash_dedup.bands_for(p) for p in (85, 80)] == [25, 37]
    with pytest.raises(ValueError):
        minhash_dedup.bands_for(20)
    rng = random.Random(9)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-23] + [f"x{i}" for i in range(23)]))]  # 77 of 123 shingles
    got = minhash_dedup.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=60)
    assert sum(r["kept"] for r in got.collect()) == 40


# URL templates -------------------------------------------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    best = max((r for r in url_templates.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7", "x://a.com?q=1/en/", "https://b.org/es/\n1#x", "http://example.net/de/8?x", "http://net/de/", "http://xcom/en/1", "a://b://c/en/"]


def test_rules_of_urls(spark, sf_dir):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(1, "http://c.com/en/1")] * 2, "page_id bigint, url string").unionByName(q.table(spark, sf_dir, "pages").select("page_id", "url"))
    want = Counter()
    for r in pages.collect():
        host, path, rule = plain_rule(r["url"])
        want[r["page_id"], host, path, rule and rule[0] + rule[1]] += 1
    got = url_templates.judged(pages.withColumns({"host": F.lit("x"), "template": F.lit("y"), "n": F.lit(1)})).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    verdicts = {h + p: v for h, p, v in url_templates.RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block") for r in got)
    assert url_templates.judged(pages.limit(0)).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [(f"http://h.test/spam/{i}", 1) for i in range(20)] + [(f"http://h.test/blog/{i}.html", 0) for i in range(20)] + [("http://h.test/spam/777", None), ("http://h.test/blog/5", None), ("http://h.test/new/1", None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, bad int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_templates.judged(pages, labelled=F.col("bad")).collect()}
    assert got[40] == ("/spam/{n}", "block") and got[41][1] == "allow" and got[42] == ("/{few}/{n}", "allow")
    assert got[25] == ("/blog/{n}.html", "allow")


def test_many_children_become_a_wildcard(spark):
    pages = spark.createDataFrame([(i, f"http://h.test/u/name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/x") for i in range(100)], "page_id bigint, url string")
    assert {r["template"] for r in url_templates.judged(pages).collect()} == {"/{few}/{any}/{few}"}


def test_a_large_level_keeps_its_labelled_branches(spark):
    word = lambda i: "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + "w"
    rows = [(f"http://h.test/spam/{i}", 1) for i in range(30)] + [(f"http://h.test/{word(k)}/{i}", 0) for k in range(70) for i in range(6)]
    rows += [(f"http://h.test/few{word(k)}/1", None) for k in range(70)] + [("http://h.test/spam/777", None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, bad int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_templates.judged(pages, labelled=F.col("bad")).collect()}
    assert got[len(rows) - 1] == ("/spam/{n}", "block") and got[30] == ("/{merged}/{n}", "allow")
    assert {got[i][0] for i in range(450, 520)} == {"/{any}/{n}"}


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs, kept = q.table(spark, sf_dir, "documents"), {}
    for name, stage in p.STAGES:
        out = p.written(stage(spark, docs, sf_dir), name)
        before, after = ({r["doc_id"]: r for r in df.collect()} for df in (docs, out))
        if name == "near_duplicates":
            want = {d for d, _, _, keep in plain_groups([(r["doc_id"], r["text"]) for r in before.values()], 80) if keep}
            assert set(after) == want
        if name == "secrets":
            assert set(after) == set(before) and all("AKIA" not in r["text"] for r in after.values())
        if name != "mixing":
            assert out.columns == docs.columns and set(after) <= set(before)
        kept[name], docs = set(after), out
    assert kept["mixing"] == kept["secrets"]
    assert {r["doc_id"] for r in p.run(spark, sf_dir).collect()} == kept["mixing"]


def test_a_block_gives_a_row_a_member_not_a_row_a_pair():
    base = [f"w{k}" for k in range(140)]
    texts = [" ".join(f"x{i}" if k == 7 * (i % 20) or k == 7 * (i // 20) else w for k, w in enumerate(base)) for i in range(120)]
    sets = [minhash_dedup.shingle_set(t) for t in texts]
    bands = minhash_dedup.bands_for(80)
    nodes, n = [minhash_dedup.set_key(s) for s in sets], len(sets)
    cell = {"bucket": 5, "low": 1, "i": 0, "high": 1, "j": 0}
    same = [5] + [0] * (bands - 1)
    columns = {**{c: [v] * n for c, v in cell.items()}, "own": [0] * n, "size_class": [1] * n, "node": nodes, "label": nodes, "n": [len(s) for s in sets], "signature": [minhash_dedup.signature_of(s) for s in sets], "buckets": [same] * n}
    found = minhash_dedup.block_candidates(pa.table(columns), 80, 0.6)
    pairs = {frozenset((a, b)) for a, others in zip(found["node"].to_pylist(), found["others"].to_pylist(), strict=True) for b in others}
    linked = {frozenset((nodes[i], nodes[j])) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert found.num_rows <= n < len(pairs) and linked <= pairs
    links = minhash_dedup.block_links(found.append_column("shingles", pa.array([sets[nodes.index(x)].view(np.int64).tolist() for x in found["node"].to_pylist()])), 80)
    got = {frozenset(p) for p in zip(links["u"].to_pylist(), links["v"].to_pylist(), strict=True)}
    assert got <= linked and len(got) < n

    def parts(edges):
        root = {x: x for x in nodes}
        for _ in range(n):
            for e in edges:
                a, b = sorted(e)
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert linked and parts(got) == parts(linked)
