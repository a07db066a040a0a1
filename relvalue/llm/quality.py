"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers.

For each language, and for each source in it, the centre and covariance of five transformed statistics are
estimated by minimum covariance determinant: from several starts, concentration steps keep the share ``core``
of documents nearest to the centre and estimate anew from them, until the determinant stops falling; the
least one counts. A document whose Mahalanobis distance is beyond the cutoff is rejected.

Few documents make a poor covariance, and very few a poor centre. So what a source says of itself is weighed against
its language, and a language's covariance against that within all languages, by weights that grow smoothly
with the number of documents: there is no size at which verdicts switch. All steps are aggregates over
all documents; what is joined back has one row for each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.hashing import runs, word_hashes
from relvalue.llm.rowkey import row_key
from relvalue.llm.scratch import Scratch

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What part of a group is taken to be sound: the estimates stand up to nearly as many outliers in one group.
CORE = 0.5
#: Concentration steps of one start at most; the determinant stops falling well before.
STEPS = 15
#: Numbers of documents at which a group's own covariance, and a source's own centre, weigh as much as what they are weighed against.
HALF_COVARIANCE, HALF_CENTRE = 50, 5
#: The chi-square quantile of five statistics that one in about seven million exceeds.
CUTOFF = 40.0
#: Least standard deviation of each transformed statistic, and of whatever they combine to, in these units: log words, log word length, log(1 + symbols a hundred words), log(1 + repeated lines), log(1 + per cent of repeated words).
FLOORS = (0.6, 0.12, 0.4, 0.6, 1.0)
DIM = len(FLOORS)
STEP = 64  # histogram cells in a unit


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """The five statistics of a text in UTF-8."""
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = runs(word_hashes(words), 3)
    repeated = 0
    if len(triples):
        _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        found = zip(*(measures(x) for x in strings(column(batch, "text"))))
        others = [column(batch, c) for c in ("_row", "_row2", "doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*others, *(pa.array(x, pa.int64()) for x in found)], ["_row", "_row2", "doc_id", "lang", "source", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """_row and _row2 (hashes of id and text), doc_id, lang, source, the five statistics and base_failed for each document."""
    text = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    found = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), text("lang"), text("source"), "text").mapInArrow(
        _measured, "_row long, _row2 long, doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATISTICS))
    n = F.col("n_words")
    return found.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))


def transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")), F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= z / (a + i)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(max(mid, 1e-9), k) < p else (low, mid)
    return high


def consistency(core: float) -> float:
    """What the covariance of the innermost ``core`` of normal data is too small by."""
    return core / chi2_cdf(chi2_quantile(core, DIM), DIM + 2)


XS = [f"x{i}" for i in range(DIM)]
CENTRE = [f"m{i}" for i in range(DIM)]
COVARIANCE = [f"c{i}_{j}" for i in range(DIM) for j in range(DIM)]
INVERSE = [f"i{i}_{j}" for i in range(DIM) for j in range(DIM)]
#: Quantiles at which the starts have their centre, and by what they widen the quartile ranges.
STARTS = ((0.5, 1.0), (0.25, 1.0), (0.75, 1.0), (0.5, 0.5))
FITTED = "_key string, start int, " + ", ".join(f"{c} double" for c in CENTRE + COVARIANCE + INVERSE) + ", determinant double"


def _distance() -> Column:
    gap = [F.col(x) - F.col(m) for x, m in zip(XS, CENTRE)]
    return sum((gap[i] * gap[j] * F.col(f"i{i}_{j}") for i in range(DIM) for j in range(DIM)), F.lit(0.0))


def _upto(n: np.ndarray, share: float) -> int:
    """The cell that holds the ``share`` of all rows, from the rows in each cell."""
    return int(np.searchsorted(np.cumsum(n), share * n.sum()))


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with at least the floors' spread in every direction, also where statistics go together."""
    unit = np.array(FLOORS)
    values, vectors = np.linalg.eigh(cov / np.outer(unit, unit))
    return (vectors * np.maximum(values, 1)) @ vectors.T * np.outer(unit, unit)


def _row(key: str, start: int, mean: np.ndarray, cov: np.ndarray, determinant: float | None = None) -> list:
    return [key, start, *mean, *cov.reshape(-1), *np.linalg.inv(cov).reshape(-1), np.linalg.det(cov) if determinant is None else determinant]


def _start(frame: pd.DataFrame) -> pd.DataFrame:
    """From the histograms of a group: the starts, each a centre and a diagonal covariance."""
    by = []
    for i in range(DIM):
        cells = frame[frame["i"] == i].sort_values("cell")
        by.append([(cells["cell"].iloc[_upto(cells["n"].to_numpy(), p)] + 1) / STEP for p in (0.25, 0.5, 0.75)])
    quartiles = np.array(by)
    spread = np.maximum((quartiles[:, 2] - quartiles[:, 0]) / 1.349, FLOORS)
    rows = []
    for k, (share, widen) in enumerate(STARTS):
        rows.append(_row(frame["_key"].iloc[0], k, quartiles[:, int(4 * share) - 1], np.diag(np.square(spread * widen)), math.inf))
    return pd.DataFrame(rows, columns=["_key", "start", *CENTRE, *COVARIANCE, *INVERSE, "determinant"])


def _fit(core: float):
    """From counts, sums and sums of products by cell of distance: centre and covariance of a group's innermost cells."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell")
        total = frame.iloc[: _upto(frame["n"].to_numpy(), core) + 1].drop(columns=["_key", "start", "cell"]).sum()
        n = total["n"]
        mean = np.array([total[f"s{i}"] for i in range(DIM)]) / n
        cov = np.array([[total[f"p{min(i, j)}_{max(i, j)}"] for j in range(DIM)] for i in range(DIM)]) / n - np.outer(mean, mean)
        row = _row(frame["_key"].iloc[0], int(frame["start"].iloc[0]), mean, floored(cov * consistency(core)))
        return pd.DataFrame([row], columns=["_key", "start", *CENTRE, *COVARIANCE, *INVERSE, "determinant"])

    return run


def estimates(points: DataFrame, scratch: Scratch, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Centre and covariance for each ``_key`` of ``points`` (_key, x0..x4): the least determinant that concentration steps from all starts reach.

    Rows are aggregated by cells of a histogram before a group comes together, so a group is at most
    some thousand cells, whatever the number of its documents; the core is exact to a cell.
    """
    n = F.count(F.lit(1)).alias("n")
    each = points.select("_key", F.posexplode(F.array(*XS)).alias("i", "x")).groupBy("_key", "i", F.floor(F.col("x") * STEP).alias("cell")).agg(n)
    now = scratch.keep(each.groupBy("_key").applyInPandas(_start, FITTED), "fit_0")
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(XS)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
    settled = None
    for step in range(1, steps + 1):
        far = points.join(now, "_key").select("_key", "start", *XS, F.floor(F.log2(1 + F.greatest(F.lit(0.0), _distance())) * STEP).alias("cell"))
        cells = far.groupBy("_key", "start", "cell").agg(n, *sums, *products)
        after = scratch.keep(cells.groupBy("_key", "start").applyInPandas(_fit(core), FITTED), f"fit_{step}")
        before = now.select("_key", "start", F.col("determinant").alias("before"))
        falling = after.join(before, ["_key", "start"]).where(F.col("determinant") < F.col("before") * (1 - 1e-3)).select("_key", "start")
        falling = scratch.keep(falling, f"falling_{step}")
        if step < steps:
            still = now.join(falling, ["_key", "start"], "left_anti")
            settled = still if settled is None else settled.unionByName(still)
            now = after.join(falling, ["_key", "start"], "left_semi")
        if step == steps or falling.isEmpty():
            break
    settled = now if settled is None else settled.unionByName(now)
    columns = ("start", *CENTRE, *COVARIANCE, "determinant")
    best = settled.where(F.col("determinant") < math.inf).groupBy("_key").agg(F.min(F.struct("determinant", "start", *CENTRE, *COVARIANCE)).alias("best"))
    return scratch.keep(best.select("_key", *(F.col(f"best.{c}").alias(c) for c in columns)), "fitted")


def weighed(n: float, half: float) -> float:
    """The weight of an estimate from ``n`` documents; none where there are no more of them than statistics."""
    extra = max(0.0, n - DIM)
    return extra / (extra + half)


def blended(own: np.ndarray, other: np.ndarray, n: float) -> np.ndarray:
    """A covariance weighed against a broader one; of the sum, what few documents say of how statistics go together counts less."""
    w = weighed(n, HALF_COVARIANCE)
    mixed = w * own + (1 - w) * other
    return w * mixed + (1 - w) * np.diag(np.diag(mixed))


def _judging(pooled: np.ndarray):
    """From the estimates of a source and of its language: the centre and inverse covariance that judge the source's documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                centre, cov = (np.array([r[f"l_{c}"] for c in names]) for names in (CENTRE, COVARIANCE))
                cov = blended(cov.reshape(DIM, DIM), pooled, r["n_lang"])
                if r["s_m0"] is not None and not math.isnan(r["s_m0"]):
                    mine, spread = (np.array([r[f"s_{c}"] for c in names]) for names in (CENTRE, COVARIANCE))
                    w = weighed(r["n"], HALF_CENTRE)
                    centre, cov = w * mine + (1 - w) * centre, blended(spread.reshape(DIM, DIM), cov, r["n"])
                rows.append([r["_lang"], r["_source"], *centre, *np.linalg.inv(floored(cov)).reshape(-1)])
            yield pd.DataFrame(rows, columns=["_lang", "_source", *CENTRE, *INVERSE])

    return run


def judge(docs: DataFrame, cutoff: float = CUTOFF, core: float = CORE) -> DataFrame:
    """_row, _row2, doc_id, the statistics, base_failed, distance and kept for each row of ``docs`` (doc_id, text, lang, source).

    Documents that pass the base rules make up the groups, languages and the sources of each. A group of any size is judged: by its own
    centre, but for sources of so few documents that their language's counts as well, and by a covariance that leans
    on broader groups the more the fewer documents there are. Null languages and sources count as empty
    ones, null texts as empty texts, which fail the base rules. Missing lang or source columns
    count as null. Repeated rows each keep their row. An empty table, or one whose documents all fail the base rules, has no distances.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = statistics(docs)
    lang, source = F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")
    points = scratch.keep(measured.select("*", lang, source, *(x.alias(c) for c, x in zip(XS, transformed()))).drop("lang", "source"), "points")
    sound = points.where(~F.col("base_failed"))
    groups = sound.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    keys = {"_l": F.concat_ws("\x1f", F.lit("l"), "_lang"), "_s": F.when((F.col("n") > DIM) & (F.col("n") < F.col("n_lang")), F.concat_ws("\x1f", F.lit("s"), "_lang", "_source"))}
    groups = scratch.keep(groups.join(sizes, "_lang").withColumns(keys), "groups")
    # A source that is all of its language says nothing of its own, one of few documents not enough.
    keyed = sound.join(groups.select("_lang", "_source", "_l", "_s"), ["_lang", "_source"])
    own = scratch.keep(keyed.select(F.explode(F.array_compact(F.array("_l", "_s"))).alias("_key"), *XS), "own")
    fitted = estimates(own, scratch, core)
    named = lambda prefix: fitted.select(F.col("_key").alias(f"_{prefix}"), *(F.col(c).alias(f"{prefix}_{c}") for c in (*CENTRE, *COVARIANCE)))
    languages = sizes.select(F.concat_ws("\x1f", F.lit("l"), "_lang").alias("_key"), "n_lang").join(fitted, "_key")
    within = languages.agg(*((F.sum(F.col("n_lang") * F.col(c)) / F.sum("n_lang")).alias(c) for c in COVARIANCE)).first()
    pooled = np.array([math.nan if x is None else x for x in within]).reshape(DIM, DIM)
    judging = groups.join(named("l"), "_l").join(named("s"), "_s", "left").mapInPandas(
        _judging(pooled), "_lang string, _source string, " + ", ".join(f"{c} double" for c in CENTRE + INVERSE))
    judging = scratch.keep(judging, "judging")
    distance = F.when(~F.col("base_failed"), _distance()).alias("distance")
    judged = points.join(judging, ["_lang", "_source"], "left").select("_row", "_row2", "doc_id", *STATISTICS, "base_failed", distance)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
