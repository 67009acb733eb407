"""Side-by-side comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings candidates source_files tools evaluations raw_records judges eval_items mix_targets".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            source = f"{p}/*.parquet" if os.path.isdir(p) else p
            assert glob.glob(source)
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{source}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (decimal.Decimal, int, float)):
        f = float(v)
        return "nan" if f != f else f
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), round(x, 6) if isinstance(x, float) else x) for x in r))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, _sorted([tuple(_plain(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect()])


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], _sorted([tuple(_plain(r[i]) for i in order) for r in cur.fetchall()])


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if equal, 'close' if doubles differ in their last digits only, else what differs first."""
    a_names, a = spark_rows(query(spark, sf_dir))
    b_names, b = duck_rows(con, sql)
    if a_names != b_names:
        return f"columns {a_names} {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)} {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    close = False
    for x, y in zip(a, b):
        for n, u, v in zip(a_names, x, y):
            if u != v:
                if isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1, abs(u)):
                    close = True
                else:
                    return f"{n}: {x} {y}"
    return "close" if close else ""
