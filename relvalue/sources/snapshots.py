"""Read landed JSON snapshots.

Layout: ``<root>/<source>/snapshot_ts=<yyyy-MM-ddTHH-mm-ss>/*.json`` for the sources listing,
fees, revenue, holder_revenue, volume and market, the time in UTC; market files lie in
``page=<n>`` folders.
A feed lands in one of two forms; the text order of its files' paths, then the order in a file, is the
order of its rows.

* ``*.json``: a document a file, an array of rows (or an object that holds it). One task reads a file.
* ``*.jsonl`` (or ``.ndjson``, ``.txt``): a row a line. Files are read by byte ranges, so one file of any size is read by many tasks.
"""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.guards import variant_number, variant_string, variant_strings
from relvalue.sources.feeds import Feeds

SOURCES = tuple(S.TTL_SECONDS)

_FLOW_FIELDS = ("total7d", "total14dto7d", "total30d", "total60dto30d", "total1y")
_ROWS_PER_FILE = 1 << 40
_ARRAYS, _LINES = "*.json", "*.{jsonl,ndjson,txt}"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its text, its path and the base of its row positions. Scans skip empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", _ARRAYS).load(path)
    # One row per file, without its content: a small table whatever the size of the feed.
    order = files.select("path").distinct().withColumn("nth", F.row_number().over(Window.orderBy("path")).cast("bigint"))
    return files.join(order, "path").withColumns({"text": F.col("content").cast("string"), "base": (F.col("nth") - 1) * _ROWS_PER_FILE})


def _has_lines(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds the line form; one that holds both has no order and is refused."""
    forms = [bool(spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).inputFiles()) for names in (_ARRAYS, _LINES)]
    if all(forms):
        raise ValueError(f"both arrays and lines in {path}")
    return forms[1]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that isn't blank: its text, its path and ``pos``, as if each file were an array of its lines.

    A task knows a line's block of the file and its place there; the lines in the blocks before it are a sum
    over a small table, a row for each block. Both scans cut the files into the same blocks.
    """
    rows = spark.read.option("pathGlobFilter", _LINES).text(path)
    numbered = rows.where("value RLIKE '\\\\S'").select(
        *rows.columns, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    blocks = numbered.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")).cast("bigint"))  # one row per file
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(files, "path").select(
        "path", "block", ((F.col("file") - 1) * _ROWS_PER_FILE + F.col("before") - F.col("first")).alias("start"))
    return numbered.join(starts, ["path", "block"]).withColumn("pos", F.col("start") + F.col("nth")).drop("block", "nth", "start").withColumnRenamed("value", "text")


def _line_rows(lines: DataFrame) -> DataFrame:
    """The lines with their JSON as ``v``; one that is none fails the job."""
    parsed = F.coalesce(F.try_parse_json("text"), F.raise_error(F.concat(F.lit("not readable as JSON: "), F.col("path"))))
    return lines.withColumn("v", parsed)


def _required(documents: DataFrame, path: str) -> DataFrame:
    """The documents, in a plan that fails if a file is empty; no file at all fails at once."""
    expected = len(documents.inputFiles())
    if not expected:
        raise FileNotFoundError(f"no JSON file in {path}")
    # This side yields no row; its one job is to compare the files read with the files listed.
    checked = documents.agg(F.count_distinct("path").alias("n")).where(
        F.when(F.col("n") != expected, F.raise_error(F.lit(f"empty file in {path}")).cast("boolean")).otherwise(False)
    )
    return documents.unionByName(checked.select(F.lit(None).cast("string").alias("path")), allowMissingColumns=True)


def _typed(columns: dict[str, str], skip: set[str]) -> list[Column]:
    """Fields of the variant ``v``, each kept only if it has the type its column asks for."""
    readers = {"DOUBLE": variant_number, "STRING": variant_string, "ARRAY<STRING>": variant_strings}
    return [readers[kind](F.col("v"), name).alias(name) for name, kind in columns.items() if name not in skip]


def _array_rows(documents: DataFrame, items: Column, *keep: str) -> DataFrame:
    return documents.select(*keep, "base", F.posexplode(items).alias("index", "v")).withColumn(
        "pos", F.col("base") + F.col("index")
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """The entity listing: a JSON array, or its lines. Anything else fails the job."""
    if _has_lines(spark, path):
        return _line_rows(_required(_lines(spark, path), path)).select("pos", *_typed(S.LISTING, {"pos"}))
    items = F.coalesce(
        F.from_json("text", "array<variant>"), F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("path")))
    )
    rows = _array_rows(_required(_documents(spark, path), path), items)
    return rows.select("pos", *_typed(S.LISTING, {"pos"}))


def read_flow_feed(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """One flow feed: ``{"protocols": [...]}``, or the array's lines. No such key means no rows; unreadable JSON fails the job."""
    if _has_lines(spark, path):
        return _flow_columns(_line_rows(_required(_lines(spark, path), path)), metric)
    parsed = F.from_json(
        "text", "struct<protocols: array<variant>, unreadable: string>", {"columnNameOfCorruptRecord": "unreadable"}
    )
    documents = _required(_documents(spark, path), path).withColumn("parsed", parsed)
    failed = F.raise_error(F.concat(F.lit("not readable as JSON: "), F.col("path")))
    usable = F.col("parsed").isNotNull() & F.col("parsed.unreadable").isNull()
    return _flow_columns(_array_rows(documents, F.when(usable, F.col("parsed.protocols")).otherwise(failed)), metric)


def _flow_columns(rows: DataFrame, metric: str) -> DataFrame:
    return rows.select(
        F.lit(metric).alias("metric"),
        F.lit(S.METRICS.index(metric)).alias("list_ord"),
        "pos",
        variant_string(F.col("v"), "slug").alias("slug"),
        variant_string(F.col("v"), "parentProtocol").alias("parent"),
        *[variant_number(F.col("v"), name).alias(name) for name in _FLOW_FIELDS],
    )


def read_flows(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The four flow feeds in long form; ``paths`` names a folder per metric."""
    flows = None
    for metric in S.METRICS:
        feed = read_flow_feed(spark, paths[metric], metric)
        flows = feed if flows is None else flows.unionByName(feed)
    return flows


def read_market(spark: SparkSession, path: str | None) -> DataFrame:
    """The paged market feed. The first page that is missing or unreadable ends it; all earlier pages count.

    The feed is optional: without a folder there are no quotes. Any other failure to read it is one.
    """
    columns = _typed(S.MARKET, {"page", "pos"})
    nothing = spark.createDataFrame([], S.ddl(S.MARKET))
    if path is None:
        return nothing
    try:
        lines = _has_lines(spark, path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return nothing
        raise
    if lines:
        read = _lines(spark, path).withColumn("v", F.try_parse_json("text"))
        bad = F.col("v").isNull()
    else:
        read = _documents(spark, path).withColumn("items", F.from_json("text", "array<variant>"))
        bad = F.col("items").isNull()
    page = F.col("page").cast("bigint").alias("id")
    landed = read.select(page).distinct()
    unreadable = read.where(bad).select(page)
    # The page after a landed one (or the first) that did not land itself; there always is one.
    following = landed.select((F.col("id") + 1).alias("id")).unionByName(spark.range(1, 2))
    first_gap = following.join(landed, "id", "left_anti").unionByName(unreadable).select(F.min("id")).scalar()
    good = read.where(F.col("page") < first_gap)
    rows = good if lines else _array_rows(good, F.col("items"), "page")
    return rows.select(F.col("page").cast("int").alias("page"), "pos", *columns)


# --- snapshots -----------------------------------------------------------------


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(source, snapshot_ts) of every landed snapshot. Lists files without reading them."""
    found = None
    for source in SOURCES:
        try:
            files = spark.read.format("binaryFile").load(f"{root}/{source}")
        except AnalysisException:
            continue
        if "snapshot_ts" not in files.columns:
            continue
        one = files.select(F.lit(source).alias("source"), F.col("snapshot_ts").cast("string").alias("snapshot_ts"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise FileNotFoundError(f"no snapshots in {root}")
    return found.distinct()


def freshness_of(found: DataFrame, now: Column) -> DataFrame:
    """Newest snapshot per source of ``found`` (source, snapshot_ts), its age, the age allowed, and whether that is exceeded."""
    taken = F.to_timestamp(F.concat("snapshot_ts", F.lit("Z")), "yyyy-MM-dd'T'HH-mm-ssX")
    age = F.unix_timestamp(now) - F.unix_timestamp(taken)
    ttl = F.create_map(*[F.lit(x) for pair in S.TTL_SECONDS.items() for x in pair])
    return (
        found.groupBy("source").agg(F.max("snapshot_ts").alias("snapshot_ts"))
        .select("source", "snapshot_ts", age.alias("age_seconds"), ttl[F.col("source")].alias("ttl_seconds"))
        .withColumn("is_expired", F.col("age_seconds") > F.col("ttl_seconds"))
    )


def freshness(spark: SparkSession, root: str, now: Column | None = None) -> DataFrame:
    """Newest snapshot per source, its age, the age allowed, and whether that is exceeded."""
    return freshness_of(snapshots(spark, root), F.current_timestamp() if now is None else now)


def _feeds(spark: SparkSession, root: str, taken: dict[str, str]) -> Feeds:
    def folder(source: str) -> str:
        if source not in taken:
            raise FileNotFoundError(f"no snapshot of {source} in {root}")
        return f"{root}/{source}/snapshot_ts={taken[source]}"

    return Feeds(
        listing=read_listing(spark, folder("listing")),
        flow=read_flows(spark, {m: folder(m) for m in S.METRICS}),
        market=read_market(spark, folder("market") if "market" in taken else None),
    )


def read_latest(spark: SparkSession, root: str) -> Feeds:
    """The newest snapshot of every source. All but the market feed are required."""
    return _feeds(spark, root, {r.source: r.snapshot_ts for r in freshness(spark, root).collect()})  # one row per source: six


def versions(spark: SparkSession, root: str, snapshot_ts: str, named: Sequence[str] | None = None) -> dict[str, str]:
    """source -> snapshot to read at this time: exactly this time's for sources that are ``named``, the newest up to it for others.

    Without names all sources count as named, but for the market feed, which is taken less often.
    """
    exact = tuple(s for s in SOURCES if s != "market") if named is None else tuple(named)
    upto = snapshots(spark, root).where(F.col("snapshot_ts") <= snapshot_ts)
    newest = upto.groupBy("source").agg(F.max("snapshot_ts").alias("snapshot_ts")).collect()  # one row per source
    return {r.source: r.snapshot_ts for r in newest if r.snapshot_ts == snapshot_ts or r.source not in exact}


def read_versions(spark: SparkSession, root: str, taken: dict[str, str]) -> Feeds:
    """Exactly these snapshots. All but the market feed are required."""
    return _feeds(spark, root, taken)


def read_snapshot(spark: SparkSession, root: str, snapshot_ts: str) -> Feeds:
    """Exactly the snapshots of this time; the market feed, which is taken less often, the newest up to it."""
    return _feeds(spark, root, versions(spark, root, snapshot_ts))
