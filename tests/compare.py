"""A registered query against its DuckDB counterpart."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return found


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k].lower())
    return [columns[k].lower() for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


def differ(frame, connection, oracle):
    """None, or what differs first."""
    got = rows(frame.columns, frame.collect())
    cursor = connection.execute(oracle)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    return next((f"{a} and {b}" for a, b in zip(got[1], want[1]) if a != b), None)
