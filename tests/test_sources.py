"""Landed files: type guards, broken feeds, pages, freshness, publishing, refresh."""

import glob
import json
import os
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.operators.materialize import materialize, owned, shared_dir
from relvalue.operators.screen import ScreenSpec, passes, screen
from relvalue.plans.screener import build_screener, published
from relvalue.plans.report import headed, report
from relvalue.sources import pointers, sinks, snapshots
from relvalue.streaming.refresh import is_due, refresh
from rows import flow, listing, market

TS = "2026-07-15T03-00-00"


def land(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


def land_all(root, ts=TS, slug="a"):
    land(f"{root}/listing/snapshot_ts={ts}", "listing.json", [
        {"slug": slug, "name": "Alpha", "symbol": "AL", "category": "Dexs", "chains": ["X", "Y"], "mcap": 5e9, "tvl": 7},
    ])
    for metric in ("fees", "revenue", "holder_revenue", "volume"):
        land(f"{root}/{metric}/snapshot_ts={ts}", "feed.json", {"protocols": [{"slug": slug, "total1y": 1e6, "total30d": 5e4}]})
    land(f"{root}/market/snapshot_ts={ts}/page=1", "page.json", [{"id": "al", "symbol": "al", "market_cap": 6e9}])


def test_listing_types(spark, tmp_path):
    land(tmp_path, "a.json", (
        '[{"slug": "a", "name": 7, "symbol": "", "mcap": "123", "tvl": 1e400, "chains": "no", "category": "Dexs"},'
        ' {"slug": "b", "mcap": 12, "tvl": -1.5, "change_1d": 0.25, "chains": ["E"], "gecko_id": null},'
        ' null, 5, {"slug": 9}]'
    ))
    rows = {r.pos: r for r in snapshots.read_listing(spark, str(tmp_path)).collect()}
    assert len(rows) == 5
    a, b = rows[0], rows[1]
    assert (a.slug, a.name, a.symbol, a.mcap, a.tvl, a.chains, a.category) == ("a", None, None, None, None, [], "Dexs")
    assert (b.mcap, b.tvl, b.change_1d, b.chains, b.gecko_id) == (12.0, -1.5, 0.25, ["E"], None)
    assert rows[2].slug is None and rows[4].slug is None


def test_files_keep_their_order(spark, tmp_path):
    for number in (10, 9):
        land(tmp_path, f"part-{number:05d}.json", [{"slug": f"{number}-0"}, {"slug": f"{number}-1"}])
    rows = snapshots.read_listing(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.slug for r in rows] == ["9-0", "9-1", "10-0", "10-1"]


def test_files_as_spark_names_them_and_dates(spark, tmp_path):
    land(tmp_path / "spark", "part-00001-0a-c000.json", [{"slug": "c"}, {"slug": "d"}])
    land(tmp_path / "spark", "part-00000-ff-c000.json", [{"slug": "a"}, {"slug": "b"}])
    rows = snapshots.read_listing(spark, str(tmp_path / "spark")).orderBy("pos").collect()
    assert [r.slug for r in rows] == ["a", "b", "c", "d"] and len({r.pos for r in rows}) == 4
    land(tmp_path / "date", "listing-20260715.json", [{"slug": "a"}])
    assert snapshots.read_listing(spark, str(tmp_path / "date")).first().slug == "a"


@pytest.mark.parametrize("content", ['[{"slug": "a"', "", '{"error": 1}'])
def test_broken_listing_fails(spark, tmp_path, content):
    land(tmp_path, "a.json", content)
    with pytest.raises(PySparkException):
        snapshots.read_listing(spark, str(tmp_path)).collect()


def test_missing_listing_fails(spark, tmp_path):
    with pytest.raises((PySparkException, FileNotFoundError)):
        snapshots.read_listing(spark, str(tmp_path / "nowhere")).collect()
    with pytest.raises(FileNotFoundError):
        snapshots.read_listing(spark, str(tmp_path))


def test_flow_feed(spark, tmp_path):
    land(tmp_path / "ok", "a.json", {"protocols": [{"slug": "a", "parentProtocol": "parent#p", "total7d": 1, "total1y": "9"}]})
    row = snapshots.read_flow_feed(spark, str(tmp_path / "ok"), "revenue").first()
    assert (row.metric, row.list_ord, row.pos, row.slug, row.parent, row.total7d, row.total1y) == (
        "revenue", 1, 0, "a", "parent#p", 1.0, None
    )
    land(tmp_path / "empty", "a.json", {"other": 1})
    assert snapshots.read_flow_feed(spark, str(tmp_path / "empty"), "fees").count() == 0
    land(tmp_path / "broken", "a.json", '{"protocols": [')
    with pytest.raises(PySparkException):
        snapshots.read_flow_feed(spark, str(tmp_path / "broken"), "fees").collect()


@pytest.mark.parametrize(
    "pages, kept",
    [
        ({p: "ok" for p in range(1, 13)}, set(range(1, 13))),
        ({1: "ok", 2: "ok", 4: "ok"}, {1, 2}),
        ({1: "ok", 2: '[{"id": ', 3: "ok"}, {1}),
        ({2: "ok"}, set()),
        ({1: "", 2: "ok"}, set()),
    ],
)
def test_market_pages(spark, tmp_path, pages, kept):
    for page, content in pages.items():
        land(tmp_path / f"page={page}", "p.json", [{"id": f"q{page}", "market_cap": 1}] if content == "ok" else content)
    rows = snapshots.read_market(spark, str(tmp_path)).collect()
    assert {r.page for r in rows} == kept and {r.id for r in rows} == {f"q{p}" for p in kept}


def test_market_is_optional(spark, tmp_path):
    assert snapshots.read_market(spark, None).count() == 0
    assert snapshots.read_market(spark, str(tmp_path / "nowhere")).count() == 0


def test_freshness_and_latest(spark, tmp_path):
    root = str(tmp_path)
    land_all(root, "2026-07-15T01-00-00", slug="old")
    land_all(root, TS, slug="new")
    now = F.to_timestamp(F.lit("2026-07-15 04:00:00"))
    rows = {r.source: r for r in snapshots.freshness(spark, root, now).collect()}
    assert set(rows) == set(snapshots.SOURCES)
    assert rows["fees"].snapshot_ts == TS and rows["fees"].age_seconds == 3600 and rows["fees"].is_expired
    assert rows["market"].ttl_seconds == 21600 and not rows["market"].is_expired
    feeds = snapshots.read_latest(spark, root)
    assert feeds.listing.first().slug == "new"
    assert feeds.flow.count() == 4 and feeds.market.first().id == "al"


def tiny_result(spark):
    return build_screener(
        listing(spark, dict(slug="a", category="Dexs", mcap=5e9, tvl=7.0), dict(slug="b", tvl=1.0)),
        flow(spark, dict(metric="fees", slug="a", total1y=1e6, total30d=5e4)),
        market(spark, dict(id="q", symbol="q", market_cap=1.0)),
    )


def read_json(folder):
    return [json.loads(line) for f in sorted(glob.glob(f"{folder}/*.json")) for line in open(f)]


def test_publish(spark, tmp_path):
    target = str(tmp_path / "out")
    result = tiny_result(spark)
    assert sinks.publish_run(spark, lambda: result, target)
    shown = headed(report(published(result.rows)))
    assert len(shown.columns) == 15 and shown.first()["시총"] == "$5.00B"
    run = f"{target}/{read_json(f'{target}/current')[0]['run']}"
    rows = sorted(read_json(f"{run}/rows"), key=lambda r: r["rank"])
    assert [(r["rank"], r["slug"]) for r in rows] == [(1, "a"), (2, "b")]
    assert rows[0]["multiples"]["pf"] == 5000.0 and rows[0]["geckoId"] is None
    assert set(rows[0]["valueCapture"]) == {"score", "label", "holderRevenueShare", "signals", "risks"}
    assert [r["category"] for r in read_json(f"{run}/categories")] == ["Dexs"]
    meta = read_json(f"{run}/meta")[0]
    assert meta["fdvCoverage"] == 0 and meta["total"] == 1 and meta["updatedAt"].endswith("Z")
    assert os.path.exists(f"{run}/meta/_SUCCESS")


def test_failed_run_leaves_one_error(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")

    def broken():
        raise RuntimeError("feed is down")

    assert not sinks.publish_run(spark, broken, target)
    (failed,) = os.listdir(target)
    assert failed.startswith("failed-")
    assert read_json(f"{target}/{failed}") == [{"error": sinks.FAILURE, "detail": "feed is down"}]

    # a good run, then one that fails in its last write: readers keep the good one
    result = tiny_result(spark)
    assert sinks.publish_run(spark, lambda: result, target)
    pointer = read_json(f"{target}/current")
    write = sinks._write

    def fails_late(df, folder):
        if folder.endswith("/meta"):
            raise OSError("disk full")
        write(df, folder)

    monkeypatch.setattr(sinks, "_write", fails_late)
    with pytest.raises(OSError):
        sinks.publish(result, target)
    assert read_json(f"{target}/current") == pointer


def test_refresh(spark, tmp_path):
    root, ready, target = (str(tmp_path / x) for x in ("landing", "ready", "out"))
    land_all(root)
    land(f"{root}/listing/snapshot_ts=2026-07-15T04-00-00", "listing.json", [{"slug": "half", "mcap": 5e9}])  # not complete
    land(ready, "2.json", {"snapshot_ts": TS, "root": root})
    query = refresh(spark, ready, target, checkpoint=str(tmp_path / "state"))
    query.awaitTermination(120)
    shown = f"{target}/snapshot_ts={TS}"
    rows = read_json(f"{shown}/{read_json(f'{shown}/current')[0]['run']}/rows")
    assert [(r["slug"], r["name"], r["symbol"], r["mcap"]) for r in rows] == [("a", "Alpha", "AL", 5e9)]
    assert sorted(os.listdir(target)) == ["_manifests", f"snapshot_ts={TS}"]
    refresh(spark, ready, target, checkpoint=str(tmp_path / "state")).awaitTermination(120)


def test_failed_refresh_is_served_again(spark, tmp_path):
    root, ready, target = (str(tmp_path / x) for x in ("landing", "ready", "out"))
    land(ready, "1.json", {"snapshot_ts": TS, "root": root})
    query = refresh(spark, ready, target, checkpoint=str(tmp_path / "state"))
    with pytest.raises(PySparkException):
        query.awaitTermination(120)
    assert not os.path.exists(target)  # no snapshot, so no run to fail
    land_all(root)
    land(f"{root}/listing/snapshot_ts={TS}", "listing.json", "{")
    with pytest.raises(PySparkException):
        refresh(spark, ready, target, checkpoint=str(tmp_path / "state")).awaitTermination(120)
    assert all(name.startswith("failed-") for name in os.listdir(f"{target}/snapshot_ts={TS}"))
    land_all(root)
    refresh(spark, ready, target, checkpoint=str(tmp_path / "state")).awaitTermination(120)
    assert "current" in os.listdir(f"{target}/snapshot_ts={TS}")


def test_materialize_uses_the_named_folder(spark):
    before = set(os.listdir(shared_dir(spark)))
    table = materialize(spark.range(3), "numbers")
    assert table.count() == 3
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert any(name.startswith("numbers-") for name in set(os.listdir(shared_dir(spark))) - before)


# --- lines -------------------------------------------------------------------------------------


def entries(n):
    return [{"slug": f"s{i}", "name": "é" * (i % 40), "mcap": i} for i in range(n)]


def as_lines(rows):
    return "".join(json.dumps(r) + ("\n\n" if i % 7 == 0 else "\r\n" if i % 5 == 0 else "\n") for i, r in enumerate(rows))


def test_lines_are_read_by_many_tasks_at_the_positions_of_arrays(spark, tmp_path):
    parts = [entries(20_000), entries(3), entries(9_000)]
    for i, rows in enumerate(parts):
        land(tmp_path / "arrays", f"part-{i}.json", rows)
        land(tmp_path / "lines", f"part-{i}.jsonl", as_lines(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        lines = snapshots.read_listing(spark, str(tmp_path / "lines"))
        blocks = spark.read.text(str(tmp_path / "lines" / "part-0.jsonl")).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert len(blocks) > 4  # one file
        got = [tuple(r) for r in lines.select("pos", "slug", "name", "mcap").orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = snapshots.read_listing(spark, str(tmp_path / "arrays")).select("pos", "slug", "name", "mcap").orderBy("pos").collect()
    assert got == [tuple(r) for r in want] and len(got) == 29_003


def test_lines_of_all_feeds(spark, tmp_path):
    land(tmp_path / "flow", "a.jsonl", as_lines([{"slug": "a", "parentProtocol": "parent#p", "total7d": 1, "total1y": "9"}, {"slug": "b"}]))
    rows = snapshots.read_flow_feed(spark, str(tmp_path / "flow"), "revenue").orderBy("pos").collect()
    assert [(r.metric, r.pos, r.slug, r.parent, r.total7d, r.total1y) for r in rows] == [("revenue", 0, "a", "parent#p", 1.0, None), ("revenue", 1, "b", None, None, None)]
    for page, text in {1: '{"id": "a"}\n{"id": "b"}', 2: '{"id": "c"}\n', 3: '{"id": "d"}\n{"id": ', 4: '{"id": "e"}'}.items():
        land(tmp_path / "market" / f"page={page}", "p.jsonl", text)
    quotes = snapshots.read_market(spark, str(tmp_path / "market")).orderBy("page", "pos").collect()
    assert [(r.page, r.id) for r in quotes] == [(1, "a"), (1, "b"), (2, "c")]  # a line that is no JSON ends the feed at its page


@pytest.mark.parametrize("content", ['{"slug": "a"}\nnot json\n', "", "\n\n"])
def test_broken_lines_fail(spark, tmp_path, content):
    land(tmp_path, "b.jsonl", content)
    land(tmp_path, "a.jsonl", '{"slug": "b"}')
    with pytest.raises(PySparkException):
        snapshots.read_listing(spark, str(tmp_path)).collect()


def test_two_forms_in_a_folder_fail(spark, tmp_path):
    land(tmp_path, "a.jsonl", '{"slug": "b"}')
    land(tmp_path, "a.json", '[{"slug": "b"}]')
    with pytest.raises(ValueError):
        snapshots.read_listing(spark, str(tmp_path))


# --- pointers, owned intermediates, counts, pruned screens ---------------------------------------


def test_a_pointer_is_always_there(spark, tmp_path):
    """A reader polls through twenty publishes, with a torn pointer among them."""
    folder = str(tmp_path / "current")
    pointers.append_pointer(spark, folder, {"run": "run-0"})
    seen, stop = [], threading.Event()

    def poll():
        while not stop.is_set():
            seen.append(pointers.newest_pointer(spark, folder))

    reader = threading.Thread(target=poll)
    reader.start()
    for i in range(1, 21):
        if i == 10:  # a writer that died half way
            land(folder, f"{11:012d}.json", '{"run": "ru')
        pointers.append_pointer(spark, folder, {"run": f"run-{i}"})
    stop.set()
    reader.join()
    numbers = [int(p["run"].removeprefix("run-")) for p in seen]  # never None
    assert len(numbers) > 20 and numbers == sorted(numbers)
    assert pointers.newest_pointer(spark, folder) == {"run": "run-20"}
    assert sum(n.endswith(".json") and not n.startswith(".") for n in os.listdir(folder)) == pointers.KEPT


def test_pointers_are_never_overwritten(spark, tmp_path):
    folder = str(tmp_path / "current")
    writers = [threading.Thread(target=pointers.append_pointer, args=(spark, folder, {"run": str(i)})) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    names = sorted(n for n in os.listdir(folder) if n.endswith(".json"))
    assert names == [f"{i:012d}.json" for i in range(1, 5)]
    assert {json.load(open(f"{folder}/{n}"))["run"] for n in names} == {"0", "1", "2", "3"}


def test_failed_publish_keeps_the_run(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    result = tiny_result(spark)
    assert sinks.publish_run(spark, lambda: result, target)
    before = sinks.current_run(spark, target)
    monkeypatch.setattr(sinks, "append_pointer", lambda *a: (_ for _ in ()).throw(OSError("no more space")))
    assert not sinks.publish_run(spark, lambda: result, target)
    assert sinks.current_run(spark, target) == before
    assert sinks.open_published(spark, target).rows.count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.open_published(spark, str(tmp_path / "nothing"))


def test_nothing_is_left_after_a_publish(spark, tmp_path):
    before = set(os.listdir(shared_dir(spark)))
    assert sinks.publish_run(spark, lambda: tiny_result(spark), str(tmp_path / "out"))
    assert set(os.listdir(shared_dir(spark))) == before
    with pytest.raises(RuntimeError), owned(spark):
        materialize(spark.range(3), "numbers")
        raise RuntimeError
    assert set(os.listdir(shared_dir(spark))) == before


def test_counts_come_from_the_write(spark):
    """No job reads the scored rows again for the metadata, and the counts are those of a scan."""
    spec = ScreenSpec().preset("undervalued")
    result = build_screener(
        listing(spark, *[dict(slug=f"s{i}", category="Dexs", mcap=5e5 * i, tvl=1e8) for i in range(40)]),
        flow(spark, *[dict(metric="fees", slug=f"s{i}", total1y=1e6 * (i % 5 + 1), total30d=5e4) for i in range(40)]),
        market(spark, dict(id="q", symbol="q", market_cap=1.0)), spec=spec,
    )
    row = result.meta.first()
    scan = "Scan parquet" in result.meta._jdf.queryExecution().executedPlan().toString()
    shown = published(result.rows)
    assert not scan and (row.fdv_coverage, row.shown, row.total, row.preset) == (0, shown.where(passes(spec)).count(), shown.count(), "undervalued")
    assert row.total == 38 and row.shown > 0


def scanned(df):
    """Rows that a frame's scan hands on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_screens_skip_row_groups(spark, tmp_path):
    result = build_screener(
        listing(spark, *[dict(slug=f"s{i}", category="Dexs", mcap=1e6 * (i + 1), tvl=1e7) for i in range(400)]),
        flow(spark, *[dict(metric=m, slug=f"s{i}", total1y=3e5, total30d=5e4) for i in range(400) for m in ("fees", "revenue")]),
        market(spark, dict(id="q", symbol="q", market_cap=1.0)),
    )
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        sinks.publish(result, str(tmp_path))
    finally:
        spark.conf.unset(key)
    rows = sinks.open_published(spark, str(tmp_path)).rows
    everything, some = screen(rows, ScreenSpec().preset("all")), screen(rows, ScreenSpec().preset("undervalued"))
    assert scanned(everything) == 400 and 0 < some.count() < 200
    assert some.count() <= scanned(some) < 250
    assert {r.slug for r in some.collect()} == {r.slug for r in result.rows.where("value_score >= 80 and not low_activity").collect()}


# --- freshness that acts ---------------------------------------------------------------------------


def served(target):
    return sorted((d, len([x for x in os.listdir(f"{target}/{d}") if x.startswith("run-")])) for d in os.listdir(target) if d.startswith("snapshot_ts="))


def test_refresh_builds_what_changed_or_expired(spark, tmp_path):
    root, ready, target, state = (str(tmp_path / x) for x in ("landing", "ready", "out", "state"))
    now = [1784084400.0]  # 2026-07-15 03:00

    def notice(name, ts, sources=None):
        land(ready, name, {"snapshot_ts": ts, "root": root} | ({"sources": sources} if sources is not None else {}))
        refresh(spark, ready, target, state, clock=lambda: now[0]).awaitTermination(120)

    land_all(root)
    notice("1.json", TS)
    assert served(target) == [(f"snapshot_ts={TS}", 1)]
    # the same snapshots once more: no run
    notice("2.json", "2026-07-15T03-10-00", sources=[])
    assert served(target) == [(f"snapshot_ts={TS}", 1)]
    # one source has changed
    later = "2026-07-15T03-20-00"
    land(f"{root}/fees/snapshot_ts={later}", "feed.json", {"protocols": [{"slug": "a", "total1y": 2e6, "total30d": 5e4}]})
    notice("3.json", later, sources=["fees"])
    assert served(target) == [(f"snapshot_ts={TS}", 1), (f"snapshot_ts={later}", 1)]
    run = sinks.open_published(spark, f"{target}/snapshot_ts={later}")
    assert run.rows.first().fees_annual == 2e6
    assert {(r.source, r.snapshot_ts) for r in run.sources.collect()} == {(s, later if s == "fees" else TS) for s in S.TTL_SECONDS}
    # nothing has changed, but the run is older than fees may be
    now[0] += S.TTL_SECONDS["fees"] + 1
    notice("4.json", "2026-07-15T03-50-00", sources=[])
    assert served(target)[-1] == ("snapshot_ts=2026-07-15T03-50-00", 1)
    ages = {r.source: (r.age_seconds, r.is_expired) for r in sinks.open_published(spark, f"{target}/snapshot_ts=2026-07-15T03-50-00").sources.collect()}
    assert ages["listing"] == (1801, True) and ages["market"] == (1801, False) and ages["fees"] == (601, False)


def test_due():
    taken = {"fees": "t1", "market": "t0"}
    manifest = {"root": "r", "snapshots": taken, "built_at": 1000.0}
    assert is_due(None, "r", taken, 0)
    assert not is_due(manifest, "r", dict(taken), 1000.0 + S.TTL_SECONDS["fees"])
    assert is_due(manifest, "r", taken, 1001.0 + S.TTL_SECONDS["fees"])
    assert is_due(manifest, "r", taken | {"market": "t2"}, 1001.0) and is_due(manifest, "other", taken, 1001.0)
