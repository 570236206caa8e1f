"""Holds a query against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return repr(round(float(x), 6))
    return repr(float(x)) if isinstance(x, int) else str(x)


def rows(table):
    d = table.select(sorted(table.column_names)).to_pydict()
    return sorted(zip(*[[plain(x) for x in d[k]] for k in d]))


def assert_same(df, connection, sql):
    ours, theirs = df.toArrow(), connection.execute(sql).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)
