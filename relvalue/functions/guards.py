"""Type guards: what does not hold a usable value becomes null."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def non_empty(c: Column) -> Column:
    """The string, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select ``columns`` (name -> type) in order, guarded; columns the feed lacks become null."""
    guards = {
        "DOUBLE": "CASE WHEN NOT isnan({0}) AND abs({0}) < double('Infinity') THEN {0} END",
        "STRING": "nullif({0}, '')",
        "ARRAY<STRING>": "coalesce({0}, CAST(array() AS ARRAY<STRING>))",
    }
    present = set(df.columns)
    return df.selectExpr(*[
        guards.get(kind, "{0}").format(f"CAST({name if name in present else 'NULL'} AS {kind})") + f" AS {name}"
        for name, kind in columns.items()
    ])


def variant_number(v: Column, field: str) -> Column:
    """A field of a JSON variant if it is a finite JSON number, else null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return finite(F.when(is_number, F.try_variant_get(v, f"$.{field}", "double")))


def variant_string(v: Column, field: str) -> Column:
    """A field of a JSON variant if it is a non-empty JSON string, else null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    return non_empty(F.when(kind == "STRING", F.try_variant_get(v, f"$.{field}", "string")))


def variant_strings(v: Column, field: str) -> Column:
    """A field of a JSON variant if it is a JSON array, else an empty array."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, f"$.{field}", "array<string>"))
    return F.coalesce(items, F.array().cast("array<string>"))
