"""Rows of a query beside those of its SQL, as plain values in one order."""

import datetime
import decimal
import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def order(row):
    return tuple((x is not None, str(type(x)), x) if x is not None else (False, "", "") for x in row)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=order)


def duck_rows(sql, sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            db.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = db.execute(sql)
    columns = [d[0] for d in got.description]
    rows = [dict(zip(columns, r)) for r in got.fetchall()]
    names = sorted(columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in rows), key=order)
