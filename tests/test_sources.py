"""Readers, lineage and streaming on files written by the tests."""

from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from eventloom import contracts
from eventloom.contracts import ContractError
from eventloom.sources import lineage, readers
from eventloom.streaming import live


def test_seasons_and_vintages_of_parquet(spark, tmp_path):
    for season, columns in ((2023, "1 as gameId, 2.0 as shotValue"), (2024, "2 as gameId")):
        spark.sql(f"select {columns}").coalesce(1).toPandas().to_parquet(_file(tmp_path, season, "regular"))
    got = readers.season_parquet(spark, f"{tmp_path}/src", ["gameId"], contracts.schema(shotValue="double", extra="string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, None, 2023, "regular"), (2, None, None, 2024, "regular")]
    assert lineage.parquet_contract(spark, f"{tmp_path}/src/season=2024", {"gameId": "int", "shotValue": "double"})


def _file(root, season, kind):
    folder = root / "src" / f"season={season}"
    folder.mkdir(parents=True)
    return folder / f"{kind}.parquet"


def test_csv_vintages(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PLAYER_ID, Poss \n1,10\n2,x\n")
    (tmp_path / "b.csv").write_text("PlayerId,Poss,Other\n3,5,1\n")
    got = readers.csv_vintages(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], contracts.schema(PLAYER_ID="long", Poss="double"), {"PLAYER_ID": ["PlayerId"]})
    assert sorted(map(tuple, got.collect())) == [(1, 10.0), (2, None), (3, 5.0)]
    (tmp_path / "c.csv").write_text("a,b\n1,2\n1,2,3\n")
    assert tuple(readers.csv_contract(spark, f"{tmp_path}/c.csv", ["a", "b"]).first()) == (2, 1, True)


def test_nested_json(spark, tmp_path):
    doc = {"game": {"gameId": "g", "actions": [{"n": 1, "x": "a"}, {"n": 2, "x": None}]}}
    with gzip.open(tmp_path / "live.json.gz", "wt") as f:
        json.dump(doc, f, indent=1)
    assert sorted((r["gameId"], r["n"]) for r in readers.json_actions(spark, f"{tmp_path}/live.json.gz", ["n"]).collect()) == [("g", 1), ("g", 2)]
    with pytest.raises(contracts.ContractError):
        readers.json_actions(spark, f"{tmp_path}/live.json.gz", ["z"])
    box = {"game": {"gameId": "g", "homeTeam": {"teamId": 1, "players": [{"p": 1}]}, "awayTeam": {"teamId": 2, "players": [{"p": 2}, {"p": 3}]}}}
    (tmp_path / "box.json").write_text(json.dumps(box))
    assert sorted((r["side"], r["teamId"], r["p"]) for r in readers.json_boxscores(spark, f"{tmp_path}/box.json").collect()) == [("away", 2, 2), ("away", 2, 3), ("home", 1, 1)]
    pairs = spark.createDataFrame([("g", [(1, 0.5), (2, 0.6)], [(1, "x"), (3, "y")])], "g string, w array<struct<id:int,p:double>>, plays array<struct<id:int,t:string>>")
    assert [tuple(r) for r in readers.paired_arrays(pairs, ["g"], F.col("w"), F.col("plays"), "id").collect()] == [("g", 1, 0.5, "x")]


def test_archives(spark, tmp_path):
    body = b"id,v\n1,2.5\n2,\n"
    with tarfile.open(tmp_path / "a.tar.xz", "w:xz") as tar:
        info = tarfile.TarInfo("season/matchups.csv")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    got = readers.archive_csv(spark, f"{tmp_path}/a.tar.xz", r"matchups\.csv$", contracts.schema(id="long", v="double"))
    assert sorted(map(tuple, got.collect())) == [(1, 2.5), (2, None)]


def test_html_tables(spark):
    page = "<table id='r'><tr><th>Name</th><th>Off</th><th>Net</th></tr><tr><td>A <b>B</b></td><td>+1,000.5</td><td>1000.5</td></tr><tr><td>C</td><td>1</td><td>5</td></tr></table><table><tr><td>z</td></tr></table>"
    rows = readers.html_tables(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string"), "page_id", "html", "r")
    typed = readers.typed_cells(rows, ["name", "off", "net"], ["off", "net"])
    assert [(r["name"], r["off"]) for r in typed.orderBy("row").collect()] == [("A B", 1000.5), ("C", 1.0)]
    assert readers.consistent(typed, ["off"], "net", 0.11).count() == 1


def test_lineage(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    assert lineage.row_set_hash(df, ["id"]) == lineage.row_set_hash(df.repartition(7).select("v", "id"), ["id"]) != lineage.row_set_hash(df.where("id > 0"), ["id"])
    path = lineage.write_atomic_json({"b": 1, "a": 2}, tmp_path / "m" / "x.json")
    assert path.read_text().index('"a"') < path.read_text().index('"b"') and len(lineage.file_sha256(path)) == 64
    assert lineage.snapshot_id([("a", "h", 1), ("b", "h", 2)]) == lineage.snapshot_id([("b", "h", 2), ("a", "h", 1)])
    lineage.register(spark, f"{tmp_path}/reg", spark.createDataFrame([("k", 1, "old")], "k string, at int, v string"))
    lineage.register(spark, f"{tmp_path}/reg", spark.createDataFrame([("k", 2, "new")], "k string, at int, v string"))
    assert [tuple(r) for r in lineage.latest(spark.read.parquet(f"{tmp_path}/reg"), ["k"], ["at"]).collect()] == [("k", 2, "new")]
    lineage.sharded_json(df, "id", 4, f"{tmp_path}/web")
    assert spark.read.json(f"{tmp_path}/web/shard=1").count() == 13


def test_splice_and_overlap(spark):
    old = spark.createDataFrame([(i, 2020 + i % 2, float(i)) for i in range(10)], "id int, y int, v double")
    new = old.withColumn("v", F.col("v") * 2).where("id < 8")
    got = lineage.overlap(old, new, ["id", "y"], "v").first()
    assert got["n"] == 8 and got["coverage"] == 0.8 and got["correlation"] == pytest.approx(1.0) and got["sd_ratio"] == pytest.approx(2.0)
    assert lineage.spliced(old, new, "y", 2021).count() == 9
    names = spark.createDataFrame([(1, "B", 1), (1, "A", 2), (1, "B", 3)], "id int, name string, at int")
    assert tuple(lineage.canonical_names(names, "id", "name", ["at"]).first()) == (1, "B", "A|B", 2)


def run_stream(spark, tmp_path, batches, schema, build, mode="append"):
    source, name = tmp_path / "in", f"t{abs(hash(str(tmp_path)))}"
    source.mkdir()
    query = build(spark.readStream.schema(schema).json(str(source))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows in enumerate(batches):
            (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
            query.processAllAvailable()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        query.stop()


def test_last_of_windows_in_a_stream(spark, tmp_path):
    row = lambda t, n, v: {"k": "a", "ts": f"2024-01-01T00:{t}", "n": n, "v": v}
    batches = [[row("00:01", 1, 1.0), row("00:20", 2, 2.0)], [row("05:00", 3, 3.0)], [row("00:10", 4, 9.0)], [row("20:00", 5, 4.0)]]
    got = run_stream(spark, tmp_path, batches, "k string, ts timestamp, n int, v double", lambda s: live.last_of_windows(s, "k", "ts", "n", "v"))
    assert sorted((r[3], r[4]) for r in got) == [(2.0, 2), (3.0, 1)]


def test_runs_in_a_stream(spark, tmp_path):
    row = lambda n, e: {"k": 1, "n": n, "e": e, "v": 1.0}
    batches = [[row(1, "a"), row(2, "a")], [row(3, "a"), row(4, "b")], [row(5, "c")]]
    got = run_stream(spark, tmp_path, batches, "k bigint, n bigint, e string, v double", lambda s: live.runs(s, "k", "n", "e", "v"))
    assert sorted(got) == [(1, 1, "a", 1, 3, 3, 3.0), (1, 2, "b", 4, 4, 1, 1.0)]


def test_hashes_of_row_sets_add_up(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("v"), (F.col("id") % 3).cast("string").alias("s"))
    whole = lineage.row_set_sums(df)
    assert whole == lineage.row_set_sums(df.repartition(9, "s").select("s", "v", "id")) == lineage.merged_sums([lineage.row_set_sums(df.where("id < 77")), lineage.row_set_sums(df.where("id >= 77"))])
    assert lineage.row_set_hash(df) != lineage.row_set_hash(df.unionAll(df.limit(1))) and lineage.row_set_hash(df) != lineage.row_set_hash(df.withColumn("v", F.coalesce("v", F.lit(0.0))))
    two = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert lineage.row_set_hash(two.limit(1)) != lineage.row_set_hash(two.where("x = 'a'")) and lineage.row_set_sums(two.limit(0)) == (0, 0)


def test_publication_survives_a_failed_write(spark, tmp_path):
    root, df = str(tmp_path / "table"), spark.range(10).withColumn("v", F.col("id") * 2)
    with pytest.raises(ContractError, match="nothing is published"):
        lineage.published(spark, root)
    first = lineage.publish(df, root, status="accepted")
    bad = df.withColumn("v", F.when(F.col("id") < 9, F.col("v")).otherwise(F.raise_error("broken").cast("bigint")))
    with pytest.raises(Exception, match="broken"):
        lineage.publish(bad, root)
    assert lineage.published(spark, root, verify=True).count() == 10 and lineage.read_manifest(spark, f"{root}/current.json") == first
    second = lineage.publish(df.where("id > 4"), root, status="draft")
    assert lineage.published(spark, root, verify=True).count() == 5 and second["previous"] == [first["version"]]
    third = lineage.publish(df.where("id > 8"), root, status="accepted")
    assert sorted(p.name for p in (tmp_path / "table" / "versions").iterdir()) == sorted([second["version"], third["version"]])
    assert not list((tmp_path / "table").glob("*.partial"))


def test_bundles_pin_what_is_accepted(spark, tmp_path):
    one, two, target = str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "bundle.json")
    lineage.publish(spark.range(5), one, status="accepted")
    with pytest.raises(ContractError, match="two: nothing"):
        lineage.bundle(spark, {"one": one, "two": two}, target)
    lineage.publish(spark.range(7), two, status="draft")
    with pytest.raises(ContractError, match="two: status 'draft'"):
        lineage.bundle(spark, {"one": one, "two": two}, target)
    lineage.publish(spark.range(7), two, status="accepted")
    made = lineage.bundle(spark, {"one": one, "two": two}, target)
    assert lineage.read_manifest(spark, target) == made and [made["tables"][t]["rows"] for t in ("one", "two")] == [5, 7]
    spark.range(6).write.mode("overwrite").parquet(made["tables"]["two"]["path"])
    with pytest.raises(ContractError, match="not those"):
        lineage.bundle(spark, {"one": one, "two": two}, target)


def test_splices_below_a_gate_are_refused(spark):
    old = spark.range(60).select((F.col("id") % 12).alias("k"), (2018 + F.col("id") % 5).cast("int").alias("y"), (F.col("id") * 1.0).alias("v"))
    new = old.withColumn("v", F.col("v") + 0.1)
    assert lineage.spliced_if_alike(old, new, ["k"], "y", 2020, "v").where("y >= 2020 and v <> round(v)").count() == 36
    for change, gate in ((new.where("k < 6"), "coverage"), (new.withColumn("v", -F.col("v")), "correlation"), (new.withColumn("v", 2 * F.col("v")), "sd_ratio"), (new.limit(3), "keys")):
        with pytest.raises(ContractError, match=gate):
            lineage.spliced_if_alike(old, change, ["k"], "y", 2020, "v")
