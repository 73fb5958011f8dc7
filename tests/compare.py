"""Run a registered query and its checking SQL and compare the rows."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def kind(value):
    return "bool" if isinstance(value, bool) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, con, sql):
    """None if equal, else a description of the first differences."""
    result = con.execute(sql)
    names, expected = rows_of([d[0] for d in result.description], result.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns {got_names} != {names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}: {got[:2]} / {expected[:2]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{dict(zip(names, a))} != {dict(zip(names, b))}"
        if [kind(x) for x in a] != [kind(x) for x in b]:
            return f"types {[kind(x) for x in a]} != {[kind(x) for x in b]}"
    return None
