"""A query's rows against those that DuckDB finds on the same tables."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def difference(df, sql: str, sf_dir: str = SF) -> str:
    """What is not alike, or nothing."""
    got = database(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    told = {d[0]: str(d[1]) for d in got.description}
    odd = [(c, k, told[c]) for c, k in df.dtypes if k in kinds and not (k == "bigint" and told[c] in ("BIGINT", "NUMBER")) and told[c] not in (kinds[k], "NUMBER", "STRING", "bool", "DATETIME")]
    order = sorted(names)
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if ours != theirs:
        return f"{sum(ours.values())} rows against {sum(theirs.values())}; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
    return f"types {odd}" if odd else ""
