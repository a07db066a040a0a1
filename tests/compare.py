"""Compare every registered query with its SQL: python tests/compare.py <folder> [query ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float) and math.isfinite(v):
            return repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(columns, rows, con, sql):
    """None if both sides hold the same columns and rows, bit for bit; else what differs."""
    got_rows = [tuple(r) for r in rows]
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want_rows = result.fetchall()
    if sorted(columns) != sorted(want_names):
        return f"columns {sorted(columns)} != {sorted(want_names)}"
    got, want = canonical(got_rows, columns), canonical(want_rows, want_names)
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows, expected {len(want)}; spark only {extra}; sql only {missing}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        df = query(spark, folder)
        built = time.time()
        rows = df.collect()
        done = time.time()
        wrong = difference(df.columns, rows, con, entry.oracle_sql()[name])
        failed += wrong is not None
        print(
            f"{name}: {'ok' if wrong is None else wrong} ({len(rows)} rows; build {built - started:.1f}s, "
            f"run {done - built:.1f}s, sql {time.time() - done:.1f}s)",
            flush=True,
        )
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
