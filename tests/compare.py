"""Run a query and its SQL over the same tables and compare columns, types and rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN",
          "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark_df, con, sql: str, show: int = 3) -> list[str]:
    rel = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in rel.description}
    sql_cols = [d[0] for d in rel.description]
    sql_rows = rel.fetchall()
    out = []
    if sorted(sql_cols) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(sql_cols)}"]
    for name, kind in spark_df.dtypes:
        if _KINDS.get(kind, kind) != sql_types[name]:
            out.append(f"type of {name}: {kind} vs {sql_types[name]}")
    names = sorted(sql_cols)
    at = [sql_cols.index(n) for n in names]
    a = sorted(repr(tuple(row[n] for n in names)) for row in spark_df.collect())
    b = sorted(repr(tuple(row[i] for i in at)) for row in sql_rows)
    if len(a) != len(b):
        out.append(f"{len(a)} rows vs {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out += [f"only Spark: {x}" for x in sorted(sa - sb)[:show]]
        out += [f"only SQL:   {x}" for x in sorted(sb - sa)[:show]]
        if sa == sb:
            out.append("rows differ in how often they occur")
    return out
