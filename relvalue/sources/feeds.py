"""The three inputs of an analysis."""

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Feeds:
    listing: DataFrame
    flow: DataFrame
    market: DataFrame
