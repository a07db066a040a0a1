"""Builders of small inputs."""

from relvalue import schemas as S


def entity_frame(spark, rows):
    """Entities from dicts; the name defaults to the slug, all else to null, the position to the row number."""
    values = []
    for i, row in enumerate(rows):
        full = {name: None for name in S.ENTITY} | {"name": row["slug"], "chains": [], "first_pos": i} | row
        values.append(tuple(
            float(v) if S.ENTITY[name] == "DOUBLE" and v is not None else v for name, v in full.items()
        ))
    return spark.createDataFrame(values, S.ddl(S.ENTITY))


def feed_frame(spark, columns, rows):
    values = []
    for i, row in enumerate(rows):
        full = {name: None for name in columns} | {"pos": i} | row
        values.append(tuple(float(v) if columns[n] == "DOUBLE" and v is not None else v for n, v in full.items()))
    return spark.createDataFrame(values, S.ddl(columns))


def listing(spark, *rows):
    return feed_frame(spark, S.LISTING, rows)


def flow(spark, *rows):
    rows = [{"list_ord": S.METRICS.index(r["metric"])} | r for r in rows]
    return feed_frame(spark, S.FLOW, rows)


def market(spark, *rows):
    return feed_frame(spark, S.MARKET, [{"page": 1} | r for r in rows])


def peers(sector, count=6, base=10):
    return [
        dict(slug=f"{sector}-peer-{i}", category=sector, mcap=1e9, fees_annual=1e9 / (base + i), fees30d=1e6, tvl=5e8)
        for i in range(count)
    ]
