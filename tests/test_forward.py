"""Walk-forward fits, season variances, prior modes, lineups by the clock and windows that look ahead, against dense and plain versions."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.contracts import ContractError
from eventloom.operators import clock_lineups, filters, joins, packed, resample, ridge, walk_forward
from eventloom.plans import catalog

PENALTIES = [{"o": 20.0, "d": 20.0}, {"o": 2.0, "d": 5.0}, {"o": 500.0, "d": 300.0}]


@pytest.fixture(scope="module")
def league(spark, tmp_path_factory):
    """(rows, response, design): five seasons of games; 160 entities a side, so that the matrix has several tiles."""
    rng = random.Random(8)
    skill = [rng.gauss(0, 1) for _ in range(160)]
    rows = []
    for season in range(2001, 2006):
        for game in range(25):
            for n in range(30):
                o, d = rng.sample(range(150 if season < 2005 else 160), 3), rng.sample(range(150 if season < 2005 else 160), 3)
                rows.append((f"{season}-{game}-{n}", season, season * 100 + game, [f"p{x:03d}" for x in o], [f"p{x:03d}" for x in d], 1 if n % 2 else -1, 1.0 + n % 3, sum(skill[x] for x in o) - 0.5 * sum(skill[x] for x in d) + rng.gauss(0, 2)))
    path = str(tmp_path_factory.mktemp("league") / "rows")
    spark.createDataFrame(rows, "row string, season int, game int, o array<string>, d array<string>, sign int, weight double, y double").write.parquet(path)
    df = spark.read.parquet(path)
    return rows, df, ridge.lineup_design(df, "row", {"o": F.col("o"), "d": F.col("d")})


def dense(rows, columns, seasons, weighted=False):
    at = {c: i for i, c in enumerate(columns)}
    own = [r for r in rows if r[1] in seasons]
    x = np.zeros((len(own), len(columns)))
    for k, r in enumerate(own):
        for block, members in (("o", r[3]), ("d", r[4])):
            for e in members:
                x[k, at[block, e]] += 1
    y, w = np.array([r[7] for r in own]), np.array([r[6] for r in own]) if weighted else np.ones(len(own))
    return own, x, y, w


@pytest.fixture(scope="module")
def sums(league, tmp_path_factory):
    _, df, design = league
    return packed.SeasonSums.build(design, df.drop("weight"), "row", "y", "season", str(tmp_path_factory.mktemp("sums")))


@pytest.mark.parametrize("window", [(2001, 2001), (2002, 2004), (2001, 2005), (2005, 2005)])
def test_windows_are_differences_of_prefix_sums(league, sums, window):
    rows, *_ = league
    found = sums.window(*window)
    _, x, y, _ = dense(rows, found.columns, range(window[0], window[1] + 1))
    assert len(found.columns) > packed.TILE
    assert np.allclose(found.gram, x.T @ x) and np.allclose(found.xy, x.T @ y) and np.allclose(found.exposure, x.sum(axis=0)) and found.n == len(y) and np.isclose(found.y_sum, y.sum())
    entries = {(r["i"], r["j"]): r["value"] for r in sums.window_entries(*window).collect()}
    want = np.tril(x.T @ x)
    i, j = np.nonzero(want)
    assert entries == pytest.approx(dict(zip(zip(i.tolist(), j.tolist(), strict=True), want[i, j].tolist(), strict=True)))


def test_weighted_sums(league, tmp_path):
    rows, df, design = league
    found = packed.SeasonSums.build(design, df, "row", "y", "season", str(tmp_path)).window(2002, 2003)
    _, x, y, w = dense(rows, found.columns, (2002, 2003), True)
    assert np.allclose(found.gram, x.T @ (x * w[:, None])) and np.allclose(found.xy, x.T @ (w * y)) and np.isclose(found.n, w.sum()) and np.isclose(found.yy, (w * y * y).sum())


def plain_margins(rows, columns, train, test, penalties):
    """{game: (actual, predicted, unknown)} of a dense ridge on the train seasons."""
    _, x, y, _ = dense(rows, columns, train)
    seen = x.sum(axis=0) > 0
    mean = y.mean()
    d = np.array([penalties[b] for b, _ in columns])
    beta = np.zeros(len(columns))
    beta[seen] = np.linalg.solve(x[:, seen].T @ x[:, seen] + np.diag(d[seen]), x[:, seen].T @ (y - mean))
    own, z, y, _ = dense(rows, columns, [test])
    out: dict = {}
    for r, features, actual in zip(own, z, y, strict=True):
        a, p, u = out.get(r[2], (0.0, 0.0, 0))
        out[r[2]] = a + r[5] * actual, p + r[5] * (mean + features @ beta), u + int(features[~seen].sum())
    return out


def test_walk_forward_equals_dense_fits(league, sums, spark, tmp_path):
    rows, df, design = league
    fits = walk_forward.window_fits(sums, PENALTIES, [2004, 2005], 3)
    losses = walk_forward.retrodicted(design, df, fits, "row", "y", "season", "game", F.col("sign"))
    got = {(r["season"], r["candidate"], r["game"]): (r["actual"], r["predicted"], r["unknown"]) for r in losses.collect()}
    want = {(t, c, g): v for t in (2004, 2005) for c, p in enumerate(PENALTIES) for g, v in plain_margins(rows, sums.columns, range(t - 3, t), t, p).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(k[0] == 2005 and v[2] > 0 for k, v in got.items()) and all(v[2] == 0 for k, v in got.items() if k[0] == 2004)
    with pytest.raises(ContractError, match="2000"):
        walk_forward.window_fits(sums, PENALTIES, [2003], 3)


def test_comparison_counts_folds_and_draws(league, sums, spark):
    rows, df, design = league
    losses = walk_forward.retrodicted(design, df, walk_forward.window_fits(sums, PENALTIES, [2003, 2004, 2005], 2), "row", "y", "season", "game", F.col("sign"))
    got = {r["candidate"]: r for r in walk_forward.compare(losses, "season", "game", PENALTIES, draws=300).collect()}
    errors = {c: {t: [(a - p) ** 2 for a, p, _ in plain_margins(rows, sums.columns, range(t - 2, t), t, PENALTIES[c]).values()] for t in (2003, 2004, 2005)} for c in range(3)}
    for c in range(3):
        rmse = [np.sqrt(np.mean(errors[c][t])) for t in (2003, 2004, 2005)]
        base = [np.sqrt(np.mean(errors[0][t])) for t in (2003, 2004, 2005)]
        assert got[c]["rmse"] == pytest.approx(np.mean(rmse)) and got[c]["wins"] == sum(a < b for a, b in zip(rmse, base, strict=True)) and got[c]["gain"] == pytest.approx((np.mean(base) - np.mean(rmse)) / np.mean(base))
    rng = np.random.default_rng(0)
    for c in (1, 2):  # the share of draws agrees with drawing games with replacement within seasons
        delta = [np.array(errors[c][t]) - np.array(errors[0][t]) for t in (2003, 2004, 2005)]
        share = np.mean([np.concatenate([rng.choice(d, len(d)) for d in delta]).mean() < 0 for _ in range(2000)])
        assert abs(got[c]["better"] - share) < 0.1
    assert got[0]["verdict"] == "baseline" and got[0]["better"] == 0.5


def test_verdicts():
    assert walk_forward.verdict(0.99, 2, 2, 0.1) == "too_few_folds"
    assert walk_forward.verdict(0.95, 3, 4, 0.01) == "worth_confirmation"
    assert walk_forward.verdict(0.95, 2, 4, 0.01) == "promising" == walk_forward.verdict(0.99, 4, 4, 0.009)
    assert walk_forward.verdict(0.89, 4, 4, 0.5) == "not_shown" == walk_forward.verdict(0.95, 1, 4, 0.5)


def test_selection_is_confirmed_once(league, sums):
    rows, df, design = league
    run = lambda default, **k: walk_forward.select_then_confirm(sums, design, df, "row", "y", "season", "game", default, PENALTIES, **{"selection": (2001, 2002, 2003), "confirmation": (2002, 2004, 2005), "sign": F.col("sign")} | k)
    rmse = lambda train, t, p: np.sqrt(np.mean([(a - q) ** 2 for a, q, _ in plain_margins(rows, sums.columns, train, t, p).values()]))
    first = [rmse((2001, 2002), 2003, p) for p in PENALTIES]
    best = int(np.argmin(first))
    for default in ({"o": 1e6, "d": 1e6}, PENALTIES[best]):
        got = [r.asDict() for r in run(default).collect()]
        assert [r["rmse"] for r in got[:3]] == pytest.approx(first) and [r["chosen"] for r in got[:3]] == [k == best for k in range(3)]
        a, b = rmse((2002, 2003, 2004), 2005, default), rmse((2002, 2003, 2004), 2005, PENALTIES[best])
        assert [r["rmse"] for r in got[3:]] == pytest.approx([a, b]) and got[4]["chosen"] == (b < a or default == PENALTIES[best]) != got[3]["chosen"]
    with pytest.raises(ContractError, match="follow"):
        run(PENALTIES[0], confirmation=(2001, 2002, 2003))
    with pytest.raises(ContractError, match="precede"):
        run(PENALTIES[0], selection=(2001, 2003, 2003))
    with pytest.raises(ContractError, match="positive"):
        run({"o": 0.0, "d": 1.0})


def test_season_variances_equal_a_dense_sandwich_and_resume(league, spark, tmp_path, monkeypatch):
    rows, df, design = league
    penalties, path = {"o": 20.0, "d": 10.0}, str(tmp_path / "variances")
    fit = []
    of = ridge.NormalEquations.of
    monkeypatch.setattr(packed.NormalEquations, "of", lambda *a, **k: fit.append(1) or of(*a, **k))
    run = lambda seasons=None: packed.season_variances(design, df.drop("weight"), "row", "y", "season", "game", penalties, "o", "d", path, seasons)
    assert run([2001]).count() == 150 and len(fit) == 1
    got = {(r["season"], r["entity"]): r for r in run([2001, 2005]).collect()}
    assert len(fit) == 2  # only the missing season
    for season in (2001, 2005):
        columns = sorted({(b, e) for r in rows if r[1] == season for b, m in (("o", r[3]), ("d", r[4])) for e in m})
        own, x, y, _ = dense(rows, columns, [season])
        bread = np.linalg.inv(x.T @ x + np.diag([penalties[b] for b, _ in columns]))
        residual = y - y.mean() - x @ (bread @ (x.T @ (y - y.mean())))
        scores: dict = {}
        for r, features, e in zip(own, x, residual, strict=True):
            scores[r[2]] = scores.get(r[2], 0) + features * e
        cov = 1e4 * bread @ sum(np.outer(s, s) for s in scores.values()) @ bread
        at = {c: i for i, c in enumerate(columns)}
        for e in {e for _, e in columns}:
            a, b, r = at["o", e], at["d", e], got[season, e]
            assert (r["variance_plus"], r["variance_minus"], r["covariance"]) == pytest.approx((cov[a, a], cov[b, b], -cov[a, b]))
            assert r["variance_net"] == pytest.approx(cov[a, a] + cov[b, b] - 2 * cov[a, b])


def test_tables_solve_what_matrices_do(league, spark, tmp_path, monkeypatch):
    """Beyond DENSE_COLUMNS coefficients no matrix is fetched: windows, penalties, variances and the plain ridge are the same."""
    _, df, design = league
    response, penalties = df.drop("weight"), {"o": 20.0, "d": 10.0}
    dense = packed.SeasonSums.build(design, response, "row", "y", "season", str(tmp_path / "dense"))
    variances = lambda path: {(r["season"], r["entity"]): r for r in packed.season_variances(design, response, "row", "y", "season", "game", penalties, "o", "d", str(path), [2001, 2005]).collect()}
    want = variances(tmp_path / "a")
    monkeypatch.setattr(packed, "DENSE_COLUMNS", 50)
    monkeypatch.setattr(packed, "matrix", lambda *a: pytest.fail("a matrix was fetched"))
    tiled = packed.SeasonSums(spark, str(tmp_path / "dense"))
    for window in ((2001, 2002), (2003, 2005)):
        monkeypatch.setattr(packed, "DENSE_COLUMNS", 2000)
        monkeypatch.undo()
        a = dense.window(*window)
        monkeypatch.setattr(packed, "DENSE_COLUMNS", 50)
        monkeypatch.setattr(packed, "matrix", lambda *a: pytest.fail("a matrix was fetched"))
        b = tiled.window(*window)
        assert b.gram is None and np.allclose(b.times(np.eye(len(b.columns))[:, :3]), a.gram[:, :3]) and np.allclose(b.diagonal(), np.diag(a.gram))
        for (x, m), (z, n) in zip(a.solutions(PENALTIES), b.solutions(PENALTIES), strict=True):
            assert np.allclose(x, z, atol=1e-10) and m == pytest.approx(n)
        beta, mean = b.solve(penalties)
        assert b.residual(beta, penalties) < 1e-8 and b.squared_error(beta, mean) == pytest.approx(a.squared_error(beta, mean))
    got = variances(tmp_path / "b")
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert [got[k][c] for c in ("variance_plus", "variance_minus", "covariance", "variance_net")] == pytest.approx([r[c] for c in ("variance_plus", "variance_minus", "covariance", "variance_net")])


def test_rows_are_gathered_across_batches(spark):
    """Rows without entries stay, entries of other seasons or of no row go, also where a row's entries go on in the next batch."""
    response = spark.createDataFrame([(f"r{n:02d}", 2001 + n % 3, n // 4, float(n)) for n in range(30)], "row string, season int, game int, y double")
    entries = [(f"r{n:02d}", "b", f"e{k}", 1.0 + k) for n in range(0, 40, 2) for k in range(1 + n % 9)]
    design = spark.createDataFrame(entries, "row string, block string, entity string, val double")
    columns = ridge.columns_of(design)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = packed.gathered_rows(design, response, "row", "y", "season", "game", columns, [2003, 2001]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {f"r{n:02d}": (0 if n % 3 == 2 else 1, n // 4, float(n), sorted((f"e{k}", 1.0 + k) for r, _, e, v in entries if r == f"r{n:02d}" for k in [int(e[1:])])) for n in range(30) if n % 3 != 1}
    assert {r["row"]: (r["_k"], r["_cluster"], r["_y"], sorted((columns[i][1], v) for i, v in zip(r["i"], r["val"], strict=True))) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("tiled", [False, True])
def test_season_variances_read_the_design_twice_in_all(spark, tmp_path, monkeypatch, tiled):
    """Once for its columns and once to gather its rows, not several times a season."""
    rows = [(f"{s}-{n}", s, n // 3, f"p{(n * 7) % 11}", float((n * n) % 13)) for s in range(2001, 2005) for n in range(40)]
    df = spark.createDataFrame(rows, "row string, season int, game int, p string, y double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    design = ridge.lineup_design(df, "row", {"o": F.array("p")})
    design = design.mapInArrow(counted, design.schema)
    if tiled:
        monkeypatch.setattr(packed, "DENSE_COLUMNS", 4)
    got = packed.season_variances(design, df, "row", "y", "season", "game", {"o": 5.0}, "o", "none", str(tmp_path / "v")).collect()
    assert len(got) == 4 * 11 and read.value <= 2 * len(rows)
    for r in got[::5]:
        own = [x for x in rows if x[1] == r["season"]]
        mean = sum(x[4] for x in own) / len(own)
        mine = [x for x in own if x[3] == r["entity"]]
        beta = sum(x[4] - mean for x in mine) / (len(mine) + 5.0)
        games: dict = {}
        for x in mine:
            games[x[2]] = games.get(x[2], 0.0) + x[4] - mean - beta
        assert r["variance_plus"] == pytest.approx(1e4 * sum(v * v for v in games.values()) / (len(mine) + 5.0) ** 2) and r["variance_minus"] is None


def test_components_are_joined_and_binned():
    label = np.arange(8)
    packed._join(label, np.array([5, 7, 3]), np.array([2, 5, 1]))
    assert label.tolist() == [0, 1, 2, 1, 4, 2, 6, 2]
    bins, places = packed._bins(label, 3)
    assert all(len(set(bins[label == k])) == 1 for k in set(label)) and max(np.bincount(bins)) == 3
    assert len(set(zip(bins.tolist(), places.tolist(), strict=True))) == 8


@pytest.mark.parametrize("fraction", [0.02, 0.9])
def test_clusters_products_are_whole(spark, fraction):
    """Sparse and dense vectors, several tiles and strips, cluster ids of text, one null."""
    rng = np.random.default_rng(int(100 * fraction))
    n, p = 40, 700
    x = rng.normal(size=(n, p)) * (rng.random((n, p)) < fraction)
    rows = [(int(1 + c % 2), f"c{c}" if c else None, int(i), float(x[c, i])) for c, i in zip(*np.nonzero(x), strict=True)]
    vectors = spark.createDataFrame(rows, "season int, c string, i int, score double")
    for strips in (1, 3):
        got = np.zeros((2, p, p))
        for r in packed.entries(packed.outer_tiles(vectors, "season", "c", strips)).collect():
            got[r["group"] - 1, r["i"], r["j"]] += r["value"]
        assert all(np.allclose(got[s], np.tril(x[s::2].T @ x[s::2])) for s in (0, 1))


@pytest.mark.parametrize("scale", [None, 1.0, 1e5])
def test_entries_come_from_products_without_tiles_between(spark, scale):
    """Broken numbers, whole ones whose sums fit single precision, and whole ones whose sums do not; a null group; each pair of strips is a task."""
    rng = np.random.default_rng(5)
    n, p = 40, 600
    x = rng.normal(size=(n, p)) if scale is None else np.rint(rng.normal(size=(n, p)) * 9) * scale + (scale > 1) * rng.integers(0, 7, (n, p))
    x *= rng.random((n, p)) < 0.8
    rows = [(2001 if c % 2 else None, f"c{c}", int(i), float(x[c, i])) for c, i in zip(*np.nonzero(x), strict=True)]
    found = packed.outer_entries(spark.createDataFrame(rows, "season int, c string, i int, score double"), "season", "c")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "binary" not in plan and "bj" not in plan and found.select(F.spark_partition_id()).rdd.getNumPartitions() == 2 * 10
    got = np.zeros((2, p, p))
    for r in found.collect():
        at = int(r["group"] == 2001), r["i"], r["j"]
        assert r["j"] <= r["i"] and r["value"] != 0 and got[at] == 0
        got[at] = r["value"]
    for s in (0, 1):
        want = np.tril(x[s::2].T @ x[s::2])
        assert np.allclose(got[s], want) and (scale is None or np.array_equal(got[s], want))


def test_cluster_meat_rounds_without_decimals(spark, sf_dir):
    """Its rows are nearly all pairs of suppliers: tiles as rows in between and decimals for each row took most of its time."""
    plan = catalog.QUERIES["cluster_meat"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "bj" not in plan and "RepartitionBy" in plan and "< 4.0E11" in plan


def test_prior_modes_equal_dense_fits(league, sums):
    rows, *_ = league
    found = sums.window(2001, 2004)
    _, x, y, _ = dense(rows, found.columns, range(2001, 2005))
    rng = np.random.default_rng(3)
    prior, confidence = rng.normal(0, 1, len(found.columns)), rng.uniform(0, 50, len(found.columns))
    penalties = {"o": 20.0, "d": 40.0}
    d = np.diag([penalties[b] for b, _ in found.columns])
    solve = lambda r, extra=0.0: np.linalg.solve(x.T @ x + d + extra, r)
    assert np.allclose(found.with_prior(penalties, prior, "zero")[0], solve(x.T @ (y - y.mean())))
    assert np.allclose(found.with_prior(penalties, prior, "target", 0.5)[0], solve(x.T @ (y - y.mean()) + 0.5 * d @ prior))
    rest = y - x @ (0.5 * prior)
    beta, mean = found.with_prior(penalties, prior, "offset", 0.5)
    assert np.allclose(beta, 0.5 * prior + solve(x.T @ (rest - rest.mean()))) and mean == pytest.approx(rest.mean())
    assert np.allclose(found.with_prior(penalties, prior, "dummy", 1.0, confidence)[0], solve(x.T @ (y - y.mean()) + confidence * prior, np.diag(confidence)))
    per_entity = np.diag(d) * rng.uniform(0.5, 2, len(prior))
    assert np.allclose(found.solve(per_entity, prior)[0], np.linalg.solve(x.T @ x + np.diag(per_entity), x.T @ (y - y.mean()) + per_entity * prior))
    with pytest.raises(ContractError, match="prior mode"):
        found.with_prior(penalties, prior, "dummy")
    ratings = {c: 100.0 * v for c, v in zip(found.columns, prior, strict=True) if c[1] < "p100"}
    center, coverage = found.prior_center(ratings, ["o", "d"])
    for block in "od":
        own = np.array([b == block and e < "p100" for b, e in found.columns])
        assert np.average(center[own], weights=found.exposure[own]) == pytest.approx(0) and coverage[block] == pytest.approx(found.exposure[own].sum() / found.exposure[[b == block for b, _ in found.columns]].sum())
        assert not center[[b == block and e >= "p100" for b, e in found.columns]].any()


def test_annual_fits_are_prior_and_update(sums):
    prior = np.full(len(sums.columns), 0.25)
    got = walk_forward.annual_fits(sums, PENALTIES[0], {2002: prior}).where("season in (2001, 2002)").collect()
    assert all(r["beta"] == pytest.approx(r["prior"] + r["update"]) for r in got) and {r["prior"] for r in got if r["season"] == 2001} == {0.0} and {r["prior"] for r in got if r["season"] == 2002} == {0.25}
    own = sums.window(2002, 2002)
    want = dict(zip(own.columns, own.solve(PENALTIES[0], prior)[0], strict=True))
    assert all(r["beta"] == pytest.approx(want[r["block"], r["entity"]]) for r in got if r["season"] == 2002)


def test_designs_take_numbers(spark):
    df = spark.createDataFrame([("a", [1, 2], 1.0, -3.0), ("b", [2], 0.0, 2.0)], "row string, o array<int>, home double, margin double")
    got = {tuple(r) for r in ridge.lineup_design(df, "row", {"o": F.col("o")}, F.col("home"), {"margin": F.col("margin"), "late": F.col("margin") * F.col("home")}).collect()}
    assert got == {("a", "o", "1", 1.0), ("a", "o", "2", 1.0), ("b", "o", "2", 1.0), ("a", "home", "home", 1.0), ("a", "margin", "margin", -3.0), ("b", "margin", "margin", 2.0), ("a", "late", "late", -3.0)}


def test_poisson_blocks_are_poisson_and_rerun(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("s"), F.col("id").alias("c"), F.lit(1.0).alias("v"), F.col("id").cast("double").alias("x"))
    run = lambda: {(r["s"], r["draw"]): (r["weight"], r["v"], r["x"]) for r in resample.poisson_blocks(df, ["s"], "c", ["v", "x"], 23, 5).collect()}
    got = run()
    assert got == run() and len(got) == 46 and all(w == v for w, v, _ in got.values())
    weights = np.array([w for w, *_ in got.values()])
    assert abs(weights.mean() - 2000) < 3 * np.sqrt(2000 / 46) and 20 < weights.std() < 80


# lineups by the clock ------------------------------------------------------------------------------------------------

GAMES = "game string, home string, away string, seconds double"
MOMENTS = "game string, team string, at double, outs array<int>, ins array<int>"


def replay(spark, moments, official=None, starters=None, resets=None, games=(("g", "h", "a", 100.0),), **k):
    base = [("g", "h", [1, 2, 3, 4, 5]), ("g", "a", [11, 12, 13, 14, 15])] if starters is None else starters
    official = [("g", p, 100.0) for p in (1, 2, 3, 4, 5, 11, 12, 13, 14, 15)] if official is None else official
    made = spark.createDataFrame(resets, "game string, team string, at double, players array<int>") if resets else None
    stints, accounts = clock_lineups.replay_by_clock(spark.createDataFrame(list(games), GAMES), spark.createDataFrame(base, "game string, team string, players array<int>"), spark.createDataFrame(moments, MOMENTS), spark.createDataFrame(official, "game string, player int, seconds double"), "game", resets=made, **k)
    return [r.asDict() for r in stints.orderBy("game", "stint").collect()], {r["game"]: r.asDict() for r in accounts.collect()}


def test_clock_replay_closes_stints_at_moments(spark):
    moments = [("g", "h", 40.0, [1], [6]), ("g", "a", 40.0, [11], [16]), ("g", "h", 70.0, [6, 2], [1, 7]), ("g", "h", 70.0, [], [])]
    official = [("g", p, float(s)) for p, s in ((1, 70), (6, 30), (2, 70), (7, 33), (3, 100), (4, 100), (5, 100), (11, 40), (16, 60), (12, 100), (13, 100), (14, 100), (15, 100))]
    stints, accounts = replay(spark, moments, official)
    assert [(s["start"], s["end"], s["home_players"], s["away_players"]) for s in stints] == [(0, 40, [1, 2, 3, 4, 5], [11, 12, 13, 14, 15]), (40, 70, [2, 3, 4, 5, 6], [12, 13, 14, 15, 16]), (70, 100, [1, 3, 4, 5, 7], [12, 13, 14, 15, 16])]
    assert accounts["g"] == {"game": "g", "starters_ok": True, "errors": 0, "stints": 3, "covered": 100.0, "seconds": 100.0, "gap": 3.0, "passed": True}
    assert replay(spark, moments, official, tolerance=2.0)[0] == [] and not replay(spark, moments, official, tolerance=2.0)[1]["g"]["passed"]


@pytest.mark.parametrize(("moment", "errors"), [(("g", "h", 40.0, [9], [6]), 2), (("g", "h", 40.0, [1], [2]), 2), (("g", "h", 140.0, [1], [6]), 1), (("g", "h", -1.0, [1], [6]), 1), (("g", "x", 40.0, [1], [6]), 1), (("g", "h", None, [1], [6]), 1), (("g", "h", 40.0, [1, 2], [6]), 1)])
def test_clock_replay_rejects_what_does_not_apply(spark, moment, errors):
    stints, accounts = replay(spark, [moment])
    assert stints == [] and accounts["g"]["errors"] == errors and not accounts["g"]["passed"]


def test_clock_replay_nets_out_and_resets(spark):
    stints, accounts = replay(spark, [("g", "h", 40.0, [1, 6], [6, 1])], resets=[("g", "h", 50.0, [1, 2, 3, 4, 6]), ("g", "a", 50.0, [11, 12, 13, 14, 15])], official=[("g", p, 100.0) for p in (1, 2, 3, 4, 11, 12, 13, 14, 15)] + [("g", 5, 50.0), ("g", 6, 50.0)])
    assert accounts["g"]["passed"] and [s["end"] for s in stints] == [40.0, 50.0, 100.0] and stints[-1]["home_players"] == [1, 2, 3, 4, 6]
    _, accounts = replay(spark, [("g", "h", 40.0, [], [])], resets=[("g", "h", 50.0, None)])
    assert accounts["g"]["errors"] == 1


def test_clock_gate_counts_games(spark):
    games = [("g", "h", "a", 100.0), ("no starters", "h", "a", 100.0), ("odd", "h", "a", None)]
    starters = [("g", "h", [1, 2, 3, 4, 5]), ("g", "a", [11, 12, 13, 14, 15]), ("odd", "h", [1, 2, 3, 4]), ("odd", "a", None)]
    _, accounts = replay(spark, [("elsewhere", "h", 3.0, [1], [2])], games=games, starters=starters)
    assert {g: a["passed"] for g, a in accounts.items()} == {"g": True, "no starters": False, "odd": False}
    frame = spark.createDataFrame([tuple(a.values()) for a in accounts.values()], "game string, starters_ok boolean, errors long, stints long, covered double, seconds double, gap double, passed boolean")
    gate = clock_lineups.quarantine_gate(frame)
    assert (gate["games"], gate["rejected"], gate["without_starters"], gate["passed"]) == (3, 2, 2, False) and clock_lineups.quarantine_gate(frame, 0.7)["passed"]
    with pytest.raises(ContractError, match="kept out"):
        clock_lineups.published_stints(frame, frame)
    assert not clock_lineups.quarantine_gate(frame.limit(0))["passed"]


def test_folds_keep_keys_together_above_joins(spark):
    """The joins look dealt by the key, and become broadcasts at run time, as most of their rows are filtered away."""
    from pyspark.sql.types import LongType, StructField, StructType

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        rows = spark.range(40_000).select((F.col("id") % 50).alias("g"), F.col("id").alias("t"))
        small = spark.range(100_000).where("rand(3) < 0.01").select((F.col("id") % 50).alias("g")).distinct()
        joined = rows.join(small, "g")
        both = joined.unionByName(joined.withColumn("t", F.col("t") + 40_000))
        for df in (joined, both):
            out = filters.ordered_fold(df, ["g"], ["t"], ["t"], lambda: 0, lambda n, _: (n + 1, (n + 1,)), StructType([StructField("n", LongType())]))
            counts = out.groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()
            assert len(counts) == 50 and all(r["c"] == r["n"] for r in counts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# looking ahead -------------------------------------------------------------------------------------------------------


def test_one_key_of_many_rows_is_one_pass(spark):
    """Frames that end behind the row are evaluated anew for every row: with those, this takes hours."""
    rows = spark.range(200_000).select(F.lit("k").alias("g"), F.col("id"), F.when(F.col("id") % 1000 == 7, "x").alias("s"))
    began = time.monotonic()
    owned = filters.owner_sequence(rows, ["g"], ["id"], F.col("s")).groupBy("known_by").count()
    assert {r["known_by"]: r["count"] for r in owned.collect()} == {"own": 200, "before": 199_793, "after": 7}
    assert filters.filled_between(rows, ["g"], ["id"], "s").where("s is null").count() == 7 + 992
    left, right = rows.select("g", F.col("id").alias("l"), F.col("id").cast("double").alias("t")), rows.where("s is not null").select("g", F.col("id").alias("r"), F.col("id").cast("double").alias("u"))
    near = joins.nearest_within(left, right, ["g"], "l", "t", "u", ["r"], 10.0)
    assert near.count() == 199 * 21 + 18 and near.where("gap > 10").count() == 0
    inside = right.select("g", F.col("u").alias("lo"), (F.col("u") + 5).alias("hi"))
    assert joins.outside_intervals(left, inside, ["g"], F.col("t"), "lo", "hi").count() == 200_000 - 200 * 5
    assert time.monotonic() - began < 120


def test_outside_intervals_that_overlap(spark):
    rng = random.Random(1)
    spans = [(g, a := rng.randint(0, 60), a + rng.randint(-3, 15)) for g in "ab" for _ in range(8)] + [("a", None, 5), ("a", 3, None), (None, 0, 99)]
    points = [(g, t) for g in "abc" for t in range(-2, 80)] + [("a", None), (None, 5)]
    out = joins.outside_intervals(spark.createDataFrame(points, "g string, t int"), spark.createDataFrame(spans, "g string, lo int, hi int"), ["g"], F.col("t"), "lo", "hi")
    want = [p for p in points if p[0] is None or p[1] is None or not any(g == p[0] and lo is not None and hi is not None and lo <= p[1] < hi for g, lo, hi in spans)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_looking_ahead_with_ties_and_nulls(spark):
    rng = random.Random(4)
    left = [("g", k, float(rng.choice(range(20)))) for k in range(40)]
    right = [("g", 100 + k, float(rng.choice(range(20)))) for k in range(15)]
    got = {r["l"]: (r["r"], r["gap"]) for r in joins.nearest_within(spark.createDataFrame(left, "g string, l int, t double"), spark.createDataFrame(right, "g string, r int, u double"), ["g"], "l", "t", "u", ["r"], 2.0).collect()}
    want = {}
    for _, k, t in left:
        near = sorted((abs(u - t), r) for _, r, u in right if abs(u - t) <= 2.0)
        if near:
            want[k] = near[0][1], near[0][0]
    assert got == want
    states = [("g", n, s) for n, s in enumerate([None, "x", None, None, "x", None, "y", None])]
    filled = filters.filled_between(spark.createDataFrame(states, "g string, n int, s string"), ["g"], ["n"], "s")
    assert [r["s"] for r in filled.orderBy("n").collect()] == [None, "x", "x", "x", "x", None, "y", None]
    assert list(itertools.islice((r["known_by"] for r in filters.owner_sequence(spark.createDataFrame(states, "g string, n int, s string"), ["g"], ["n"], F.col("s")).orderBy("n").collect()), 3)) == ["after", "own", "before"]
