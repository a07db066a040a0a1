"""String helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from relvalue.schemas import LISTING_LINK, QUOTE_LINK

PARENT_PREFIX = "parent#"


def without_parent_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^" + PARENT_PREFIX, "")


def pretty_parent(c: Column) -> Column:
    """``parent#alpha-beta_v2`` -> ``Alpha Beta V2``; letters after the first keep their case."""
    words = F.split(without_parent_prefix(c), "[-_]")
    titled = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(titled, " ")


def haystack(name: Column, symbol: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, F.coalesce(symbol, F.lit(""))))


def entity_link(slug: Column, gecko_id: Column) -> Column:
    by_slug = F.concat(F.lit(LISTING_LINK), without_parent_prefix(slug))
    return F.when(gecko_id.isNotNull(), F.concat(F.lit(QUOTE_LINK), gecko_id)).otherwise(by_slug)


def collation_key(c: Column) -> Column:
    """Sort key for names: case folded, compared by the rules of the Unicode collation."""
    return F.collate(F.lower(F.coalesce(c, F.lit(""))), "UNICODE")
