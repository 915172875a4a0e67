"""Compares queries with their SQL on one set of tables, as sorted rows by column name."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, sf_dir: str, query, sql: str, con=None) -> str | None:
    """None where both give the same columns and rows, else a short account of the first difference."""
    con = con or connect(sf_dir)
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}; {[x for x in mine if x not in theirs[:5000]][:2]} {[x for x in theirs if x not in mine[:5000]][:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[0]}" if bad else None


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    from cashtide.plans import catalog

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, found, sql = connect(sf_dir), catalog.queries(), catalog.oracle_sql()
    for k in names or found:
        t = time.time()
        try:
            said = differences(spark, sf_dir, found[k], sql[k], con) if k in sql else f"rows only: {found[k](spark, sf_dir).count()}"
            n = con.execute(f"SELECT count(*) FROM ({sql[k]})").fetchone()[0] if k in sql else 0
            said = f"ok, {n} rows" if said is None else said
        except Exception as e:  # noqa: BLE001 - a report of all queries
            said = f"{type(e).__name__} {str(e)[:700]}"
        print(k, said, round(time.time() - t, 1), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
