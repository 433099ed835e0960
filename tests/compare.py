"""Row-by-row comparison of a Spark result with DuckDB's result of its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).iterdir()):
        where = p if p.is_file() else p / "*.parquet"
        con.execute(f"create view {p.name.removesuffix('.parquet')} as select * from read_parquet('{where}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x) is not str), str(x)) for x in r))


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Same columns, same rows; the number of rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, result.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            same = abs(x - y) <= 2e-6 * max(1, abs(y)) if isinstance(x, float) and y is not None else x == y or (x is not None and y is not None and not isinstance(x, str | bool) and float(x) == float(y))
            assert same, (a, b)
    return len(mine)
