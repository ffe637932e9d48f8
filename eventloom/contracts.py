"""Schemas, required columns and conformance of tables from several vintages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


class ContractError(ValueError):
    """A table does not keep what its contract says."""


def schema(**columns: DataType | str) -> StructType:
    short = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "bool": BooleanType(), "date": DateType()}
    return StructType([StructField(name, short[kind] if isinstance(kind, str) else kind) for name, kind in columns.items()])


GAME_DIM = schema(
    game_id="string", season_start="int", season_end="int", season_label="string", season_type="string", game_date="date", home_team_id="long",
    away_team_id="long", home_score="long", away_score="long", home_win="bool", max_period="int", home_margin="long",
)
SUBSTITUTIONS = schema(game_id="string", period="int", clock="string", team_id="long", player_id="long", direction="string")
POSSESSIONS = schema(
    possession_id="string", game_id="string", possession_number="int", period="int", start_order_number="long", end_order_number="long",
    start_seconds_elapsed="double", end_seconds_elapsed="double", offense_team_id="long", defense_team_id="long", offense_is_home="bool", points="double",
)
LINEUPS = tuple(f"{side}{k}" for side in "ah" for k in range(1, 6))
LEGACY_POSSESSIONS = schema(home_poss="bool", pts="int", **dict.fromkeys(LINEUPS, "long"), season="int", date="date", period="int", num="int", gameid="string")
LEGACY_KEY = ("gameid", "period", "num")


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def first_number(df: DataFrame, aliases: Sequence[str]) -> Column:
    """The first of several header vintages that parses as a number; null if none is there."""
    found = [F.col(f"`{a}`").try_cast("double") for a in aliases if a in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def conform(df: DataFrame, target: StructType) -> DataFrame:
    """df with the target's columns and types: unreadable values and missing columns become null, nested values JSON text."""
    out = []
    for field in target.fields:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(df.schema[field.name].dataType, (ArrayType, MapType, StructType)) and isinstance(field.dataType, StringType):
            value = F.to_json(F.col(f"`{field.name}`"))
        else:
            value = F.col(f"`{field.name}`").try_cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def stripped(df: DataFrame) -> DataFrame:
    """Header names without blanks around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN means missing at the border; inside, missing is null only."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])
