"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime as dt
import decimal
import json
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return json.dumps([canon(x) for x in v])
    return str(v)


def normalise(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(canon(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(rows, key=lambda t: tuple((x is None, x or "") for x in t))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def run_oracle(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return normalise(cols, cur.fetchall())


def run_spark(df):
    return normalise(df.columns, [tuple(r) for r in df.collect()])
