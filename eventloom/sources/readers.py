"""Readers of the lake's files: Parquet by season, CSV vintages, nested JSON, archives, HTML tables."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterable, Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contracts import conform, require, stripped
from ..functions.scalars import first_number_in
from ..operators.filters import dealt_by


def season_parquet(spark: SparkSession, pattern: str, columns: Sequence[str], optional: StructType | None = None) -> DataFrame:
    """Columns of `source/season=YYYY/<kind>.parquet` files with season_start and season_type from the path.

    Vintages are merged; an optional column that none has is null.
    """
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    path = F.col("_metadata.file_path")
    df = df.select(*[c for c in df.columns if c != "season"], F.regexp_extract(path, r"season=([0-9]+)", 1).cast("int").alias("season_start"), F.regexp_extract(path, r"([^/]+)\.parquet$", 1).alias("season_type"))
    require(df, columns)
    more = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in (optional.fields if optional else [])]
    return df.select(*columns, *more, "season_start", "season_type")


def csv_vintages(spark: SparkSession, paths: str | Sequence[str], target: StructType, aliases: dict[str, Sequence[str]] = {}) -> DataFrame:  # noqa: B006
    """CSV files of several vintages with the target's columns; aliases: name -> older headers, first one there wins."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        df = stripped(spark.read.option("header", "true").csv(path))
        for name, older in aliases.items():
            there = [c for c in (name, *older) if c in df.columns]
            if there:
                df = df.withColumn(name, F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in there]))
        part = conform(df, target)
        out = part if out is None else out.unionByName(part)
    return out


def csv_contract(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """One row: rows, rows of another width, whether the header is the contract's."""
    first = spark.read.option("header", "true").csv(path).columns
    schema = ", ".join([*(f"`{c}` string" for c in first), "_bad string"])
    rows = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(path)
    parsed = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in first])) >= 0  # asks for all columns, so that the whole width is parsed
    return rows.agg(F.count_if(parsed).alias("n_rows"), F.count_if(parsed & F.col("_bad").isNotNull()).alias("n_bad_width")).withColumn("header_ok", F.lit(list(first) == list(header)))


def json_actions(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Rows of `game.actions[]` of multi-line JSON documents (gzip too), with gameId."""
    doc = spark.read.option("multiLine", "true").json(path)
    rows = doc.select(F.col("game.gameId").alias("gameId"), F.explode("game.actions").alias("a")).select("gameId", "a.*")
    return require(rows, required)


def json_boxscores(spark: SparkSession, path: str) -> DataFrame:
    """Players of the home and the away team of box-score documents: gameId, side, teamId, then the player's fields.

    Documents without an id or with other than two teams are left out.
    """
    doc = spark.read.option("multiLine", "true").json(path)
    teams = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"game.{s}Team.teamId").alias("teamId"), F.col(f"game.{s}Team.players").alias("players")) for s in ("home", "away")])
    both = doc.where("game.gameId is not null and game.homeTeam is not null and game.awayTeam is not null").select(F.col("game.gameId").alias("gameId"), F.explode(teams).alias("t"))
    return both.select("gameId", "t.side", "t.teamId", F.explode("t.players").alias("p")).select("gameId", "side", "teamId", "p.*")


def paired_arrays(df: DataFrame, keys: Sequence[str], left: Column, right: Column, on: str) -> DataFrame:
    """Two arrays of one document joined by a field: keys, on, the left fields, the right fields."""
    a = df.select(*keys, F.explode(left).alias("l")).select(*keys, "l.*")
    b = df.select(*keys, F.explode(right).alias("r")).select(*keys, "r.*")
    return a.join(b, [*keys, on])


def archive_csv(spark: SparkSession, path: str, member: str, target: StructType) -> DataFrame:
    """Rows of one CSV member of .tar.xz (or .tar.gz) archives, read through Spark, an archive a task.

    An archive is held by its task while its member is parsed; members are seasons of a few MB.
    """
    names = [f.name for f in target.fields]

    def members(frames: Iterable):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for info in tar.getmembers():
                        if re.search(member, info.name):
                            yield pd.read_csv(tar.extractfile(info), dtype=str, keep_default_na=False).reindex(columns=names)

    text = StructType([f for f in StructType.fromDDL(", ".join(f"`{n}` string" for n in names)).fields])
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, text)
    return conform(found.select(*[F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]), target)


class _Table(HTMLParser):
    """Cells of the tables of a page, as (table id, row, cells)."""

    def __init__(self):
        super().__init__()
        self.rows, self.table, self.cells, self.text = [], [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table.append(dict(attrs).get("id") or "")
        elif tag == "tr" and self.table:
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.text = []

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = None
        elif tag == "tr" and self.cells is not None:
            self.rows.append((self.table[-1] if self.table else "", self.cells))
            self.cells = None
        elif tag == "table" and self.table:
            self.table.pop()


def html_tables(pages: DataFrame, key: str, html: str, table_id: str | None = None) -> DataFrame:
    """(key, table_id, row, cells) of the tables of each page, or of the one with an id; null pages have none.

    Pages are dealt over the tasks first: parsing costs far more than reading, and pages made of a small file would be one task's.
    """
    import pandas as pd

    def parse(frames):
        for frame in frames:
            out = []
            for k, page in zip(frame[key], frame[html], strict=True):
                parser = _Table()
                parser.feed(page or "")
                out += [(k, t, n, cells) for n, (t, cells) in enumerate(parser.rows) if table_id is None or t == table_id]
            yield pd.DataFrame(out, columns=[key, "table_id", "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return dealt_by(pages.select(key, html), [key, html]).mapInPandas(parse, f"{key} {kind}, table_id string, row int, cells array<string>")


def typed_cells(rows: DataFrame, names: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Cells by place, numbers parsed; header rows (no number in any of `numbers`) go."""
    out = rows.select(*[c for c in rows.columns if c != "cells"], *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    out = out.withColumns({n: first_number_in(F.col(n)) for n in numbers})
    return out.where(F.coalesce(*numbers).isNotNull())


def consistent(df: DataFrame, parts: Sequence[str], total: str, tolerance: float) -> DataFrame:
    """Rows whose parts add up to the total within a tolerance."""
    return df.where(adds_up(parts, total, tolerance))


def adds_up(parts: Sequence[str], total: str, tolerance: float) -> Column:
    """Whether the parts add up to the total within a tolerance; null if one of them is."""
    return F.abs(sum((F.col(p) for p in parts), F.lit(0.0)) - F.col(total)) <= tolerance


def page_number(html: Column, pattern: str) -> Column:
    """A number that a pattern's first group finds in a page; null if it finds none."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")).try_cast("double")


def jdbc_rows(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in ranges of a numeric column, so that no cursor streams through one process."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()
