"""Relative-value analytics on Spark: roll up, match quotes, score, screen, report."""

from relvalue.operators.screen import ScreenSpec, screen
from relvalue.plans.screener import ScreenerResult, build_screener, entities, published, score

__all__ = ["ScreenSpec", "ScreenerResult", "build_screener", "entities", "published", "score", "screen"]
