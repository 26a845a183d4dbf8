"""Compare registered queries with their SQL twins: python tests/oracle.py [folder] [name...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


_KINDS = {"bigint": "int64", "int": "int32", "double": "float64", "string": "str", "boolean": "bool"}
_DUCK = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "VARCHAR": "str", "BOOLEAN": "bool"}


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    from reelgate.catalogue import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if ours else "no rows"
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: _DUCK.get(str(c[1]), str(c[1])) for c in result.description}
    theirs = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine = {c: _KINDS.get(k, k) for c, k in df.dtypes}
    if mine != kinds:
        differ = {c: (mine[c], kinds[c]) for c in mine if mine[c] != kinds[c]}
        types = f"types {differ}; "
    else:
        types = ""
    if ours == theirs:
        return types or None
    only_ours = sorted(set(ours) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(ours))[:3]
    return f"{types}rows {len(ours)} / {len(theirs)}; ours {only_ours}; theirs {only_theirs}"


if __name__ == "__main__":
    from reelgate.catalogue import ORACLES, QUERIES
    from reelgate.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(folder)
    wanted = sys.argv[2:] or list(QUERIES)
    bad = 0
    for query in wanted:
        begin = time.time()
        try:
            problem = compare(session, duck, folder, query)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        note = "" if query in ORACLES else " (rows only)"
        print(f"{mark} {query}{note} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
