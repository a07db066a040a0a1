"""Score formulas as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.maths import clamp


def growth_score(change: Column) -> Column:
    """Percent momentum on a 0-100 scale, 50 neutral."""
    return clamp(50 + change * 0.5, 0.0, 100.0)


def dilution_score(dilution: Column) -> Column:
    """Fully diluted / current value on a 0-100 scale, fully circulating = 100."""
    return F.when(dilution > 0, clamp(100 - (dilution - 1) * 33.3, 0.0, 100.0))


def adjustment(score: Column) -> Column:
    """A secondary score as points around neutral; unknown adds nothing."""
    return F.coalesce((score - 50) / 50 * S.MAX_ADJUSTMENT, F.lit(0.0))


def whole(score: Column) -> Column:
    return F.round(score).cast("int")


def value_label(score: Column) -> Column:
    """Band of the unrounded score."""
    names = (
        S.LABEL_UNDERVALUED,
        S.LABEL_MILDLY_UNDERVALUED,
        S.LABEL_FAIR,
        S.LABEL_MILDLY_OVERVALUED,
    )
    label = F.when(score.isNull(), S.LABEL_HOLD)
    for floor, name in zip(S.SCORE_BANDS, names):
        label = label.when(score >= floor, name)
    return label.otherwise(S.LABEL_OVERVALUED)


def holder_share(holder: Column, revenue: Column, fees: Column) -> Column:
    """Holder revenue over revenue, else over fees, else 1; bounded to 0-1."""
    base = F.when(revenue > 0, revenue).when(fees > 0, fees)
    share = F.when(base.isNull(), 1.0).otherwise(clamp(holder / base, 0.0, 1.0))
    return F.when(holder > 0, share)
