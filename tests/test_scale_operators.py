"""Operators that replaced pairwise or whole-group work, against plain versions, with one key holding a third of all rows."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.contracts import ContractError
from eventloom.operators import filters, joins, models, ranking, rates, resample, ridge
from eventloom.plans import catalog, forward
from eventloom.sources import lineage


@pytest.fixture(scope="module")
def hot_rows():
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 17}", rng.randrange(300), i, rng.choice([None, *range(20)])) for i in range(900)]
    return rows + [(None, 5, 1000, 1)]


@pytest.fixture(scope="module")
def intervals():
    rng = random.Random(4)
    out = [("hot" if i % 3 == 0 else f"k{i % 17}", s := rng.randrange(300), rng.choice([None, s, s + rng.randrange(1, 40)]), i) for i in range(150)]
    return out + [(None, 0, None, 999)]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_equals_all_pairs(spark, hot_rows, intervals, closed, how):
    left = spark.createDataFrame(hot_rows, "k string, t int, i int, v int").unionByName(spark.createDataFrame([("hot", None, 2000, 1), ("hot", 7, 0, 1), ("hot", 7, 0, 1)], "k string, t int, i int, v int"))
    right = spark.createDataFrame(intervals, "k string, s int, e int, n int")
    want = []
    for k, t, i, _ in left.collect():
        inside = [(s, n) for q, s, e, n in intervals if q == k is not None and t is not None and s <= t and (e is None or (t <= e if closed else t < e))]
        if inside or how == "left":
            want.append((i, max(inside)[1] if inside else None))
    got = joins.interval_join(left, right, ["k"], F.col("t"), "s", "e", ["n"], closed=closed, how=how)
    assert got.columns == ["k", "t", "i", "v", "s", "e", "n"]
    assert sorted(map(str, ((r["i"], r["n"]) for r in got.collect()))) == sorted(map(str, want))


def test_disjoint_intervals_and_clashes(spark):
    left = spark.createDataFrame([("a", t) for t in (None, 0, 1, 4, 5, 9, 30)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5, 5, "empty"), ("a", 5, 9, "y"), ("a", 20, None, "z")], "k string, s int, e int, n string")
    got = {r["t"]: r["n"] for r in joins.disjoint_interval_join(left, right, ["k"], F.col("t"), "s", "e", how="left").collect()}
    assert got == {None: None, 0: None, 1: "x", 4: "x", 5: "y", 9: None, 30: "z"}
    with pytest.raises(ContractError):
        joins.disjoint_interval_join(left, right.withColumnRenamed("n", "t"), ["k"], F.col("t"), "s", "e")


def test_nearest_equals_all_pairs(spark, hot_rows):
    left, right = hot_rows[:400], [(k, t, i) for k, t, i, _ in hot_rows[400:]]
    got = joins.nearest_within(spark.createDataFrame([(k, t, i) for k, t, i, _ in left], "k string, a int, i int"), spark.createDataFrame(right, "k string, b int, j int"), ["k"], "i", "a", "b", ["j"], 6)
    want = {}
    for k, t, i, _ in left:
        near = [(abs(t - u), j) for q, u, j in right if q == k is not None and abs(t - u) <= 6]
        if near:
            want[i] = min(near)
    assert {r["i"]: (r["gap"], r["j"]) for r in got.collect()} == want


def test_decayed_mean_of_a_long_stream(spark):
    rows = [("a", t, 1.0 if t < 500 else None, 1.0) for t in range(1100)] + [("b", 0, None, 1.0), ("b", 3, 2.0, 1.0), ("b", 5, 4.0, 3.0)]
    got = {(r["k"], r["t"]): r["filtered"] for r in filters.decayed_mean(spark.createDataFrame(rows, "k string, t int, v double, w double"), ["k"], "t", "v", "w", 0.5).collect()}
    assert got["a", 1099] == pytest.approx(1.0) and got["b", 0] is None and got["b", 5] == pytest.approx((2 * 0.25 + 4 * 3) / 3.25)


def test_ewma_carries_over_seasons_and_batches(spark, hot_rows):
    df = spark.createDataFrame(hot_rows, "k string, t int, i int, v int").withColumn("s", F.floor(F.col("t") / 100))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = {r["i"]: r["v_ewma"] for r in filters.ewma_before(df, ["k"], ["t", "i"], "s", "v").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for k, t, i, v in hot_rows:
        by[k].append((t, i, v))
    for rows in by.values():
        m, last = 0.0, None
        for t, i, v in sorted(rows, key=lambda r: r[:2]):
            m = 0.75 * m if last not in (None, t // 100) else m
            assert got[i] == pytest.approx(m)
            m, last = 0.9 * m + 0.1 * (v or 0), t // 100


def test_quantiles_and_ranks_without_groups(spark, hot_rows):
    df = spark.createDataFrame(hot_rows, "k string, t int, i int, v int")
    values = [r[3] for r in hot_rows if r[3] is not None]
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.83, "e": 1.0}
    got = rates.quantiles(df, (), "v", shares).first()
    assert [got[n] for n in shares] == pytest.approx([float(np.quantile(values, q)) for q in shares.values()])
    by = {r["k"]: r["c"] for r in rates.quantiles(df, ["k"], "v", {"c": 0.5}).collect()}
    assert by["hot"] == pytest.approx(float(np.median([r[3] for r in hot_rows if r[0] == "hot" and r[3] is not None])))
    for descending in (True, False):
        for r in ranking.rank_within(df, (), "v", F.lit(True), descending=descending).collect():
            assert r["rank"] == (None if r["v"] is None else 1 + sum(x > r["v"] if descending else x < r["v"] for x in values))
    assert rates.quantiles(df.limit(0), (), "v", {"c": 0.5}).collect()[0]["c"] is None


# additive fits -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def design_rows(spark):
    rng = random.Random(5)
    effect = {f"p{k}": rng.gauss(0, 2) for k in range(12)}
    design, response = [], []
    for i in range(240):
        members = rng.sample(sorted(effect), 4)
        design += [(i, "plus" if j < 2 else "minus", m, 1.0) for j, m in enumerate(members)]
        y = sum(effect[m] for m in members[:2]) - sum(effect[m] for m in members[2:])
        response.append((i, i % 4, i % 20, y + rng.gauss(0, 1)))
    return spark.createDataFrame(design, "row int, block string, entity string, val double"), spark.createDataFrame(response, "row int, fold int, game int, y double")


def test_gram_entries_equal_the_products(spark, design_rows):
    design, _ = design_rows
    twice = design.unionByName(design.where("row = 3").limit(1))  # a member that comes twice counts twice
    x = defaultdict(lambda: defaultdict(float))
    for r in twice.collect():
        x[r["row"]][r["block"], r["entity"]] += r["val"]
    want = defaultdict(float)
    for row in x.values():
        for i, v in row.items():
            for j, u in row.items():
                if j <= i:
                    want[i, j] += v * u
    got = {((r[0], r[1]), (r[2], r[3])): r[4] for r in ridge.gram_entries(twice, "row").collect()}
    assert got == pytest.approx(dict(want))


def test_folds_add_up_and_penalties_are_searched(design_rows):
    design, response = design_rows
    whole = ridge.NormalEquations.of(design, response.drop("fold", "game"), "row", "y")
    folds = ridge.grouped_equations(design, response, "row", "y", "fold", whole.columns)
    total = folds[0] + folds[1] + folds[2] + folds[3]
    for name in ("gram", "xy", "exposure"):
        np.testing.assert_allclose(getattr(total, name), getattr(whole, name), atol=1e-9)
    start = {"plus": 5000.0, "minus": 5000.0}
    found, error = ridge.coordinate_search(list(folds.values()), start)
    assert error < ridge.cross_validated(list(folds.values()), [start])[0][1]
    for block in found:  # no neighbour of the last step is better
        for by in (1.1, 1 / 1.1):
            assert ridge.cross_validated(list(folds.values()), [found | {block: found[block] * by}])[0][1] >= error * (1 - 1e-3)
    fits = ridge.rolling_fits({2020 + k: folds[k] for k in (0, 1, 3)}, 2, found)
    assert list(fits) == [2021] and np.allclose(fits[2021][0], (folds[0] + folds[1]).solve(found)[0])
    assert all(-1 <= v <= 1 for v in ridge.half_stability(folds[0] + folds[1], folds[2] + folds[3], found).values())


def test_bootstrap_refits_resume(spark, design_rows, tmp_path, monkeypatch):
    design, response = design_rows
    run = lambda draws: ridge.bootstrap_fits(spark, design, response, "row", "y", "game", draws, {"plus": 3.0, "minus": 3.0}, 7, str(tmp_path))
    first = {tuple(r[:2]): r["beta"] for r in run([0]).where("draw = 0").select("block", "entity", "beta").collect()}
    solved = []
    solve = ridge.NormalEquations.solve
    monkeypatch.setattr(ridge.NormalEquations, "solve", lambda self, *a, **k: solved.append(1) or solve(self, *a, **k))
    both = run([0, 1])
    assert len(solved) == 1 and both.where("draw = 1").count() == len(first)
    assert {tuple(r[:2]): r["beta"] for r in both.where("draw = 0").select("block", "entity", "beta").collect()} == first
    bands = resample.interval(both, ["block", "entity"], "beta").collect()
    assert len(bands) == len(first) and all(r["low"] <= r["mean"] <= r["high"] for r in bands)
    drawn = {r["game"]: r["w"] for r in response.select("game", resample.poisson_weight(resample.unit(F.lit(7), F.lit(1), F.col("game"))).alias("w")).distinct().collect()}
    weighted = ridge.NormalEquations.of(design, response.join(spark.createDataFrame(list(drawn.items()), "game int, weight int").withColumn("weight", F.col("weight").cast("double")), "game"), "row", "y")
    beta, _ = solve(weighted, {"plus": 3.0, "minus": 3.0})
    again = {tuple(r[:2]): r["beta"] for r in both.where("draw = 1").select("block", "entity", "beta").collect()}
    assert [again[c] for c in weighted.columns] == pytest.approx(list(beta))


def test_registered_ridge_solves_its_normal_equations(spark, sf_dir):
    """The query's coefficients, put back into the normal equations of the same rows."""
    design, response = catalog.order_design(spark, sf_dir), catalog.order_response(spark, sf_dir)
    found = ridge.NormalEquations.of(design, response, "l_orderkey", "y")
    penalties = {"supplier": 10.0, "line": 5.0}
    beta, mean = found.solve(penalties)
    assert found.residual(beta, penalties) < 1e-6
    want, _ = found.recentered(beta, mean, ["supplier", "line"])
    got = {(r["block"], r["entity"]): r["beta"] for r in catalog.block_ridge(spark, sf_dir).collect()}
    assert [got[c] for c in found.columns] == pytest.approx(list(want), abs=1e-6)


def test_elo_equals_a_plain_loop(spark, sf_dir):
    games = catalog.supplier_games(spark, sf_dir)
    ratings, out, last = defaultdict(dict), [], {}
    rows = sorted(games.collect(), key=lambda r: (r["league"], r["day"], r["home"], r["away"]))
    days = defaultdict(list)
    for r in rows:
        days[r["league"], r["day"]].append(r)
    assert max(map(len, days.values())) > 1
    for (league, day), own in sorted(days.items()):
        known = ratings[league]
        if last.get(league, own[0]["season"]) != own[0]["season"]:
            for t in known:
                known[t] = 1500 + 0.75 * (known[t] - 1500)
        last[league] = own[0]["season"]
        change = defaultdict(float)
        for r in own:
            h, a = known.get(r["home"], 1500.0), known.get(r["away"], 1500.0)
            out.append((league, day, r["home"], r["away"], round(h, 6), round(a, 6)))
            step = 20 * ((1.0 if r["margin"] > 0 else 0.5 if r["margin"] == 0 else 0.0) - 1 / (1 + 10 ** ((a - h - 60) / 400)))
            change[r["home"]] += step
            change[r["away"]] -= step
        for t, c in change.items():
            known[t] = known.get(t, 1500.0) + c
    got = sorted((r["league"], r["day"], r["home"], r["away"], r["home_before"], r["away_before"]) for r in catalog.elo_batched(spark, sf_dir).collect())
    assert len(got) == len(out)
    for g, w in zip(got, sorted(out), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-5)


# models and lineage --------------------------------------------------------------------------------------------------


def test_clusters_are_kept_only_if_stable(spark):
    rng = random.Random(6)
    panel = spark.createDataFrame([(i, 10.0 * (i % 3) + rng.gauss(0, 0.2), 7.0 * (i % 3 == 1) + rng.gauss(0, 0.2)) for i in range(90)], "i int, a double, b double")
    found = models.stable_cluster_count(panel, ["a", "b"], [2, 3])
    assert found[0]["k"] == 3 and found[0]["stable"] and found[0]["stability"] == pytest.approx(1.0)
    labels = spark.createDataFrame([(i % 3, (i + 1) % 3, i // 30) for i in range(90)], "a int, same int, other int")
    assert models.adjusted_rand(labels, "a", "same") == pytest.approx(1.0) and abs(models.adjusted_rand(labels, "a", "other")) < 0.05


def test_stack_sees_no_fold_of_its_own(spark):
    rng = random.Random(7)
    rows = [(i, i % 3, x := rng.gauss(0, 1), z := rng.gauss(0, 1), 2 * x - z + rng.gauss(0, 0.1)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, fold int, x double, z double, y double")
    fit = lambda c: lambda train: models.weighted_ridge(train, c, "y", None, 1e-6)
    out = models.stacked(df, "fold", range(3), ["i"], {"one": fit(["x"]), "two": fit(["z"])}, lambda train, names: models.weighted_ridge(train, names, "y", None, 1e-6), "y")
    assert out.columns == ["i", "fold", "y", "one", "two", "predicted"] and out.count() == 60
    error = lambda c: math.sqrt(out.agg(F.avg((F.col("y") - F.col(c)) ** 2)).first()[0])
    assert error("predicted") < min(error("one"), error("two"))


def test_peak_bands_choose_anew_in_every_draw(spark):
    draws = spark.createDataFrame([(d, e, y, float((e == "a") * (y == 2 + d) * 9 + (e == "b") * 2), 1.0) for d in range(3) for e in "ab" for y in range(6)], "draw int, entity string, year int, v double, w double")
    got = {r["entity"]: r.asDict() for r in resample.peak_bands(draws, "entity", "draw", "year", "v", "w", 2, [1]).collect()}
    assert got["a"]["rank_p50"] == 1 and got["a"]["p_top1"] == 1.0 and got["b"]["rank_p50"] == 2


def test_pinned_artifacts(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    good = {"path": "a.txt", "sha256": lineage.file_sha256(tmp_path / "a.txt")}
    assert lineage.pinned_problems({"status": "accepted", "artifacts": {"a": good}}, tmp_path) == []
    bad = lineage.pinned_problems({"status": "draft", "artifacts": {"a": good | {"sha256": "0"}, "b": {"path": "b", "sha256": "1"}, "c": {}}}, tmp_path)
    assert [b.split(":")[0] for b in bad] == ["status 'draft' is none of ['accepted']", "a", "b", "c"]
    assert lineage.pinned_problems({"status": "accepted"}, tmp_path) == ["no artifacts"]


def test_the_rest_works_without_the_text_operators(tmp_path):
    """A copy without the two folders, with and without the pipeline's file, still lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "eventloom", tmp_path / "eventloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
        n, m, text = said.stdout.split()
        assert int(n) > 100 and int(m) > 90 and text == "False"
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_lineup_replay_equals_a_plain_loop(spark, sf_dir):
    years = defaultdict(lambda: defaultdict(set))
    for r in catalog.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), "l_orderkey", "l_suppkey").collect():
        years[r["y"]][r["l_orderkey"]].add(r["l_suppkey"])
    want = []
    for year, orders in years.items():
        on = set(sorted(set().union(*orders.values()))[:5])
        begun, n, ok = None, 0, len(on) == 5
        for key in sorted(orders):
            outs, ins = {p for p in orders[key] if p % 2}, {p for p in orders[key] if p % 2 == 0}
            if len(outs) != len(ins) or not outs <= on or ins & on:
                ok = False
                continue
            want.append((year, n, tuple(sorted(on)), begun, key, ok))
            on, begun, n = (on - outs) | ins, key, n + 1
        want.append((year, n, tuple(sorted(on)), begun, None, ok))
    got = [(r["year"], r["stint"], tuple(r["players"]), r["start"], r["end"], r["ok"]) for r in catalog.lineup_replay(spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > len(years)


# growth --------------------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_takes_a_digest_a_draw_and_converts_none(spark):
    rows = spark.createDataFrame([(i // 3, i % 2, None if i % 7 == 0 else i / 10) for i in range(300)] + [(None, 1, 2.0)], "game int, season int, v double")
    weight = resample.poisson_weight(resample.unit(F.lit(7), F.col("draw"), F.col("season"), F.col("game")))
    draws = rows.select("season", "game").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("w", weight)
    multiplicities = {(r["season"], r["game"], r["draw"]): r["multiplicity"] for r in resample.cluster_draws(rows, ["season"], "game", 40, 7).collect()}
    assert multiplicities == {(r["season"], r["game"], r["draw"]): r["w"] for r in draws.collect()}
    want = {}
    for d in range(40):
        own = [(multiplicities[r["season"], r["game"], d], r["v"]) for r in rows.collect() if r["v"] is not None]
        want[d] = sum(w * v for w, v in own) / sum(w for w, _ in own)
    got = resample.bootstrap_means(rows, ["season"], "game", "v", 40, 7)
    assert {r["draw"]: r["mean"] for r in got.collect()} == pytest.approx(want)
    assert plan_of(got).count("md5(") == 1 and "conv(" not in plan_of(got)


def test_html_ratings_parse_each_page_once_and_on_many_tasks(spark, sf_dir):
    plan = catalog.QUERIES["html_ratings"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Repartition" in plan[plan.index("MapInPandas") :]


def test_dealing_by_size_bounds_the_rows_of_a_task(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    assert filters.dealt_by_size(df, ["k"], 3000) is df
    dealt = filters.dealt_by_size(df, ["k"], 100)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 30 and max(r["count"] for r in sizes) < 300
    grouped = dealt.groupBy("k").agg(F.count("*").alias("n"))
    assert grouped.rdd.getNumPartitions() == 30 and grouped.count() == 1500  # the grouping keeps the dealing
    seen = []
    monkeypatch.setattr(filters, "dealt_by_size", lambda df, keys, *a: seen.append(list(keys)) or df)
    for name in ("gram_moments", "gram_entries", "matchup_points_saved"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [["l_orderkey"], ["l_orderkey"], ["l_orderkey", "l_linenumber", "l_suppkey"]]


def test_pairs_are_numbers_without_lambdas(spark, design_rows):
    design, _ = design_rows
    assert "lambda" not in plan_of(ridge.gram_entries(design, "row"))


def test_supplied_rows_are_read_back(spark, sf_dir):
    rows = forward.supplied(spark, sf_dir)
    assert "Join" not in plan_of(rows) and rows.count() == rows.distinct().count() > 0
