"""Sizes and shapes beyond the usual: repeated text, hot keys, deep paths, many blocks, odd rows in every stage."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, exact, mixing, quality_rules, sampling, secrets, suffix_decontam, toxicity_cnn, url_templates
from eventloom.llm import queries as q

# spans and windows ---------------------------------------------------------------------------------------------------


def test_many_secrets_in_one_text_take_linear_time():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(20_000))
    began = time.perf_counter()
    base, more = secrets.spans_of(text, 20, 20)
    assert len(base) == 20_000 and not more and time.perf_counter() - began < 20


def test_uncovered_parts_equal_a_mark_a_character():
    rng = random.Random(2)
    for _ in range(300):
        spans = sorted((s := rng.randrange(40), 0, s + rng.randrange(1, 9)) for _ in range(rng.randrange(6)))
        start, end = sorted(rng.sample(range(45), 2))
        free = [all(not s <= i < e for s, _, e in spans) for i in range(50)]
        want = [(m.start(), m.end()) for m in re.finditer("1+", "".join("1" if start <= i < end and free[i] else "0" for i in range(50)))]
        assert secrets.uncovered(start, end, secrets.covered(spans)) == want


def test_repeated_words_against_a_repeated_item_are_no_product():
    began = time.perf_counter()
    machine = suffix_decontam.TestSuffixes([("x", [b"same"] * 10_000), ("y", [b"same"] * 15)], 13)
    tests = machine.search(np.ones(20_000, dtype=np.uint32))[13]
    assert (tests >= 0).sum() == 20_000 - 12 and machine.owner[13][tests[0]] == ["x", "y"]
    found = machine.matches(tests[tests >= 0], 13)
    assert found[0] == (0, 0, 0, 10_000) and found[-1][1] + found[-1][3] == 20_000 and len(found) < 5
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_verbatim_and_cannot_be_longer(seed):
    rng = random.Random(seed)
    words = lambda n: [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
    items = [(str(i), words(rng.randrange(3, 25))) for i in range(6)]
    machine, text = suffix_decontam.TestSuffixes(items, 4), words(120)
    ids = np.array([machine.number.get(w, 0) for w in text], dtype=np.uint32)
    tests = machine.search(ids).get(4, np.full(len(ids), -1))
    covered = set()
    at = np.flatnonzero(tests >= 0)
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        for item, p, place, n in machine.matches(tests[run], 4) if len(run) else []:
            start = int(run[0]) + p
            assert text[start : start + n] == items[item][1][place : place + n] and n >= 4
            longer = text[start : start + n + 1]
            assert len(longer) == n or not any(w[i : i + n + 1] == longer for _, w in items for i in range(len(w) - n))
            covered |= set(range(start, start + n))
    windows = {tuple(w[i : i + 4]) for _, w in items if len(w) >= 4 for i in range(len(w) - 3)}
    assert covered == {i + k for i in range(len(text) - 3) if tuple(text[i : i + 4]) in windows for k in range(4)}


# hot keys and shared folders -----------------------------------------------------------------------------------------


def test_salted_joins_equal_plain_ones(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, x int")
    hot = common.Hot(left.where("k is not null").groupBy("k").agg(F.count("*").alias("n")), "k", most=20)
    dealt = hot.dealt(left, "i")
    assert dealt.where("k = 'hot'").select("_salt").distinct().count() > 5
    got = dealt.join(hot.copied(right), ["k", "_salt"]).drop("_salt")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k").collect()))


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))


def test_intermediates_are_deleted(spark):
    with common.intermediates(spark):
        table = common.written(spark.range(3).toDF("x"), "test")
        assert table.count() == 3
    with pytest.raises(Exception):
        spark.read.schema(table.schema).parquet(table.inputFiles()[0]).count()


# rules and tails -----------------------------------------------------------------------------------------------------


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    """A partition of 40 MB within one batch's number of rows."""
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))
    plain, most = common.slices, 2 * common.BATCH_BYTES

    def checked(batch, column, most_bytes):
        assert batch.nbytes <= most, f"a batch of {batch.nbytes} bytes"
        return plain(batch, column, most_bytes)

    monkeypatch.setattr(common, "slices", checked)
    got = common.row_map(docs, {"size": "bigint"}, lambda texts: [[len(t) for t in texts]], "text").agg(F.sum("size"), F.count_distinct("doc_id")).first()
    assert tuple(got) == (40_000_000, 4000)


def test_a_session_keeps_its_own_batches(spark):
    before = spark.conf.getAll.get(common.BATCH_SETTING)
    try:
        spark.conf.set(common.BATCH_SETTING, "1m")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(common.BATCH_SETTING) if before is None else spark.conf.set(common.BATCH_SETTING, before)


def test_binomial_tail_beyond_a_hundred_thousand_terms(spark):
    n, k, p = 40_000_000, 399_000, 0.01
    got = spark.createDataFrame([(n, k)], "n bigint, k bigint").select(exact.binomial_tail(F.col("n"), F.col("k"), p)).first()[0]
    at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    assert got == pytest.approx(math.fsum(math.exp(at(i)) for i in range(k - 15_000, k + 1)), rel=1e-5)


def test_certified_rules_reject_and_hold_on_other_labels(spark):
    """Cutoffs from one half of the labels; on the other half few good ones fall, and most of the junk does."""
    rng = random.Random(3)
    row = lambda i, junk: (i, "=en", 100, 500, rng.randrange(120, 400) if junk or rng.random() < 0.002 else rng.randrange(20), 10, 20, rng.randrange(8, 19) if junk else 0, 0)
    rows = [row(i, i % 5 == 0) for i in range(6000)]
    figures = spark.createDataFrame(rows, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_upper bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint")
    labels = figures.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("good"))
    cuts = quality_rules.certified_cutoffs(figures, labels.where("doc_id < 3000")).first()
    over = lambda r: any(value > cuts[f"cut_{name}"] for name, value in (("symbols", r[4] / r[3]), ("dup_lines", r[7] / r[6])) if cuts[f"cut_{name}"] is not None)
    other = [r for r in rows if r[0] >= 3000]
    good, junk = [r for r in other if r[0] % 5], [r for r in other if not r[0] % 5]
    assert sum(map(over, good)) <= 0.01 * len(good) and sum(map(over, junk)) > 0.9 * len(junk)


def test_the_path_adds_one_cutoff_a_step():
    steps = quality_rules.path()
    assert steps[0] == {} and steps[-1] == {name: cuts[0] for name, (_, cuts) in quality_rules.RULES.items()}
    for a, b in zip(steps, steps[1:]):
        changed = {k for k in b if a.get(k) != b[k]}
        assert len(changed) == 1 and all(a.get(k, math.inf) > b[k] for k in changed)


# samples -------------------------------------------------------------------------------------------------------------


def test_one_long_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "word " * (10_000 if i == 0 else 3)) for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, label int")
    sample, counts = sampling.sample_table(docs, labels, F.lit(True), 10, 10**6, most_text=1000)
    assert sorted(r["doc_id"] for r in sample.collect()) == list(range(1, 8)) and counts == {0: 4, 1: 4}
    only_long = labels.where("doc_id = 0 or label = 1")
    with pytest.raises(Exception, match="both classes are labelled"):
        toxicity_cnn.network_for(docs.withColumn("text", F.when(F.col("doc_id") == 0, F.repeat(F.lit("word "), 300_000)).otherwise(F.col("text"))), only_long, F.lit(True))
    assert toxicity_cnn.network_for(docs.limit(0), labels, F.lit(True)) is None


def test_thresholds_lean_on_the_common_one():
    rng = random.Random(4)
    sample = [(("bad " if y else "good ") + " ".join(rng.choice(["the", "of", "tree", "lake"]) for _ in range(12)), y) for y in (0, 1) for _ in range(80)]
    network = toxicity_cnn.trained(sample, {0: 80, 1: 80})
    languages = [toxicity_cnn.word_hashes(t)[1] for t, _ in sample]
    unseen = [k for k in range(len(toxicity_cnn.LANGUAGES)) if k not in languages]
    assert len(unseen) > 1 and len({network.thresholds[k] for k in unseen}) == 1
    scores = toxicity_cnn.text_scores(network, ["bad tree of the lake", "good tree of the lake"])
    assert scores[0] >= 0.7 > scores[1]


# URL trees -----------------------------------------------------------------------------------------------------------


def plain_tree(rows, most_children=64, support=5, z=1.96):
    """{(host, segments): template} level by level, over distinct paths."""
    paths = defaultdict(lambda: [0, 0])
    for host, segments, bad in rows:
        own = paths[host, segments]
        own[0] += bad or 0
        own[1] += bad is not None
    template = {p: "" for p in paths}
    for level in range(max((len(s) for _, s in paths), default=0)):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for (host, segments), (b, m) in paths.items():
            if level < len(segments):
                child = nodes[host, template[host, segments]][segments[level]]
                child[0] += b
                child[1] += m
        names = {}
        for node, children in nodes.items():
            few = sum(m < support and not c.startswith("{") for c, (_, m) in children.items())
            enough = [v for v in children.values() if v[1] >= support]
            all_b, all_m = sum(b for b, _ in enough), sum(m for _, m in enough)
            for c, (b, m) in children.items():
                if c.startswith("{"):
                    name = c
                elif m < support:
                    name = "{any}" if few > most_children else "{few}"
                elif all_m == m:
                    name = c
                else:
                    pooled, others = all_b / all_m, all_m - m
                    apart = abs(b / m - (all_b - b) / others) > z * math.sqrt(pooled * (1 - pooled) * (1 / m + 1 / others))
                    name = c if apart else "{merged}"
                names[node, c] = name
        template = {(h, s): t + "/" + names[(h, t), s[level]] if level < len(s) else t for (h, s), t in template.items()}
    return template


@pytest.mark.parametrize("seed", range(2))
def test_tree_equals_the_plain_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        depth = rng.choice([0, 1, 2, 3, 11])
        segments = tuple(rng.choice(["en", "spam", "blog", "{n}", f"w{rng.randrange(90)}"]) for _ in range(depth))
        bad = None if rng.random() < 0.3 else int(rng.random() < (0.9 if "spam" in segments[:2] else 0.1))
        rows.append(("hot.test" if rng.random() < 0.4 else f"h{rng.randrange(4)}.test", segments, bad))
    urls = spark.createDataFrame([(h, list(s), b) for h, s, b in rows], "host string, segments array<string>, blocked int")
    got = {(r["host"], tuple(r["segments"])): r["template"] for r in url_templates.template_tree(urls, most_children=20).collect()}
    assert got == plain_tree(rows, most_children=20) and len(set(got.values())) > 10


def test_whole_paths_count_however_deep(spark):
    deep = "/".join("abcdefghij")
    rows = [(f"http://h.test/{deep}/{'spam' if i % 2 else 'fine'}/{i}", i % 2) for i in range(60)] + [(f"http://h.test/{deep}/spam/777", None), (f"http://h.test/{deep}/fine/777", None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_templates.judged(pages, labelled=F.col("bad")).collect()}
    assert got[60] == "block" and got[61] == "allow"


# mixing --------------------------------------------------------------------------------------------------------------


def test_more_blocks_than_a_group_holds(spark):
    rows = [(i, "a b c", "big" if i % 3 else "small") for i in range(15_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = mixing.mixed(docs, block_words=2, levels=5).select("source", "doc_id", "size", "target", "draws").collect()
    taken, shards = Counter(), Counter()
    for r in mix:
        assert sum(d["words"] for d in r["draws"]) <= 3 * r["size"]
        for d in r["draws"]:
            taken[r["source"]] += d["words"]
            shards[d["shard"]] += 1
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in mix)
    assert set(shards) == set(range(32)) and max(shards.values()) < 1.3 * min(shards.values())  # the root's draws are halved five times


def exchanged_bytes(node):
    """Bytes that the exchanges of a plan wrote, once it has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged_bytes(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged_bytes(node.plan())
    own = node.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(exchanged_bytes(node.children().apply(i)) for i in range(node.children().size()))


def test_the_mix_shuffles_its_texts_once(spark, tmp_path):
    """Ids alone are too many to broadcast here, as they are in a large table; the sources are not."""
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.random()) for _ in range(rng.randint(20, 80))), "xyz"[i % 3]) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        out = mixing.mixture(docs, block_words=1000)
        got = out.collect()
        moved = exchanged_bytes(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 1.3 * sum(len(r["text"] or "") + 150 for r in got)
    want = Counter((r["doc_id"], d["copy"], d["shard"], d["words"]) for r in mixing.mixed(docs, block_words=1000).collect() for d in r["draws"])
    assert Counter((r["doc_id"], r["copy"], r["shard"], r["words"]) for r in got if r["shard"] is not None) == want
    assert len({c for _, c, _, _ in want}) > 1 and any(r["shard"] is None for r in got)


# stages --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["toxicity", "decontamination", "secrets", "mixing"])
def test_stages_take_odd_rows(spark, sf_dir, odd, odd_rows, none, crowded, name):
    import corpus_pipeline as p

    stage = dict(p.STAGES)[name]
    out, wide = stage(spark, odd, sf_dir), stage(spark, crowded, sf_dir)
    assert stage(spark, none, sf_dir).count() == 0
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert rows(out) == rows(wide)
    ids = Counter(r[0] for r in odd_rows)
    if name == "mixing":
        assert set(r["doc_id"] for r in out.select("doc_id").collect()) == set(ids)
        return
    assert out.columns == odd.columns and wide.columns == crowded.columns
    texts = Counter((r[0], r[1]) for r in odd_rows)
    if name == "toxicity":
        model = q.toxicity_network(odd, q.table(spark, sf_dir, "labels"))
        score = dict(zip(texts, toxicity_cnn.text_scores(model, [t for _, t in texts]), strict=True))
        assert rows(out) == Counter({k: n for k, n in texts.items() if score[k] < toxicity_cnn.CUT})
    elif name == "secrets":
        want = Counter((d, secrets.redacted(t, sum(secrets.spans_of(t, 20, 20), [])) if t else t) for d, t, *_ in odd_rows)
        assert rows(out) == want
    else:
        assert rows(out) == texts  # nothing of it is in the benchmark


# SQL -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    import duckdb

    def run(sf_dir, sql):
        connection = duckdb.connect()
        for t in ("documents", "labels", "benchmark"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        found = connection.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), Counter(tuple(row[i] for i in order) for row in found.fetchall())

    return run


@pytest.mark.parametrize("name", ["op4_minhash_dedup", "op6_decontamination", "op9_mixing"])
def test_queries_equal_their_sql(spark, sf_dir, duck, name):
    got = q.queries()[name](spark, sf_dir)
    names, want = duck(sf_dir, q.oracle_sql()[name])
    assert sorted(got.columns) == names and Counter(map(tuple, got.select(*names).collect())) == want


def test_active_rules_equal_their_sql(spark, duck):
    """A looser bound, so that languages with a few dozen labels have rules."""
    from eventloom.llm.oracles import op5

    sf_dir = "/root/testdata/sf0.01"
    labels = q.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    got = quality_rules.judged(q.table(spark, sf_dir, "documents"), labels, alpha=0.1, delta=0.5)
    names, want = duck(sf_dir, op5(0.1, 0.5))
    rows = Counter(map(tuple, got.select(*names).collect()))
    assert rows == want and any(not r[names.index("base_failed")] and not r[names.index("kept")] for r in rows)


def test_shards_are_the_leaves_of_the_tree(spark):
    """Turning the tree off changes the query's result: the shards of the draws are the leaves' quotas."""
    docs = spark.createDataFrame([(i, "a b c d", "xyz"[i % 3]) for i in range(600)], "doc_id bigint, text string, source string")
    rows = mixing.mixed(docs, block_words=16, levels=3).select("source", "draws").collect()
    per = Counter(d["shard"] for r in rows for d in r["draws"])
    assert set(per) == set(range(8)) and mixing.mix_digest(docs, block_words=16, levels=3).select("shards").distinct().count() > 8
