"""INSERT, UPDATE, DELETE and MERGE as DataFrames: the new state of the table, to be written where the caller wants.

Nothing is changed in place; the statements run as one query on the table's current rows, in any format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import tree as t
from ..plans.emit import Emitter, quote, quote_table
from ..plans.lexer import SqlError


def apply(engine, node: t.Node, dialect: str, params=None) -> DataFrame:
    spark, e = engine.spark, Emitter(dialect, params)
    table = quote_table(node.table)
    columns = spark.table(table).columns
    alias = quote(node.table.alias or node.table.parts[-1])
    if isinstance(node, t.Insert):
        rows = spark.sql(e.query(node.query))
        names = node.columns or columns
        if len(rows.columns) != len(names):
            raise SqlError(f"{len(rows.columns)} values for {len(names)} columns")
        told = {n.lower(): c for n, c in zip(names, rows.toDF(*(f"c{k}" for k in range(len(names)))).columns)}
        rows = rows.toDF(*(f"c{k}" for k in range(len(names))))
        schema = spark.table(table).schema
        rows = rows.selectExpr(*(f"cast({told.get(f.name.lower(), 'NULL')} AS {f.dataType.simpleString()}) AS {quote(f.name)}" for f in schema))
        return rows if node.overwrite else spark.table(table).unionAll(rows)
    if isinstance(node, t.Delete):
        where = e.expr(node.where) if node.where is not None else "true"
        if node.using is not None:
            return spark.sql(f"SELECT * FROM {table} AS {alias} WHERE NOT EXISTS (SELECT 1 FROM {e.relation(node.using)} WHERE {where})")
        return spark.sql(f"SELECT * FROM {table} AS {alias} WHERE NOT coalesce({where}, false)")
    if isinstance(node, t.Update):
        changes = {n.lower(): e.expr(v) for n, v in node.changes}
        missing = set(changes) - {c.lower() for c in columns}
        if missing:
            raise SqlError(f"no column {sorted(missing)[0]}")
        where = e.expr(node.where) if node.where is not None else "true"
        if node.source is None:
            items = (f"CASE WHEN {where} THEN {changes[c.lower()]} ELSE {alias}.{quote(c)} END AS {quote(c)}" if c.lower() in changes else f"{alias}.{quote(c)}" for c in columns)
            return spark.sql(f"SELECT {', '.join(items)} FROM {table} AS {alias}")
        source = e.relation(node.source)
        values = ", ".join(f"'{c}', {v}" for c, v in changes.items())
        # One matching row of the source gives the values. A row is its own key: equal rows meet the same change.
        key = lambda of: f"struct({', '.join(f'{of}.{quote(c)}' for c in columns)})"
        hits = f"SELECT {key(alias)} AS hit__, any_value(named_struct({values})) AS new__ FROM {table} AS {alias}, {source} WHERE {where} GROUP BY {key(alias)}"
        items = (f"CASE WHEN hit__ IS NOT NULL THEN new__.{quote(c.lower())} ELSE u.{quote(c)} END AS {quote(c)}" if c.lower() in changes else f"u.{quote(c)}" for c in columns)
        return spark.sql(f"SELECT {', '.join(items)} FROM {table} AS u LEFT JOIN ({hits}) ON {key('u')} <=> hit__")
    return merge(engine, node, e, table, alias, columns)


def merge(engine, node: t.Merge, e: Emitter, table: str, alias: str, columns: list[str]) -> DataFrame:
    """A full outer join of table and source on the condition, and for each row the first branch that fits."""
    spark, source = engine.spark, e.relation(node.source)
    other = quote(getattr(node.source, "alias", None) or node.source.parts[-1])
    branches, live = {c.lower(): [] for c in columns}, []
    both, only_table, only_source = "t__ IS NOT NULL AND s__ IS NOT NULL", "t__ IS NOT NULL AND s__ IS NULL", "t__ IS NULL"
    own = lambda c: f"{alias}.{quote(c)}"
    for when in node.whens:
        state = both if when.matched else only_table if when.by_source else only_source
        test = f"{state} AND coalesce({e.expr(when.condition)}, false)" if when.condition is not None else state
        changes = {n.lower(): e.expr(v) for n, v in when.changes}
        if when.action == "INSERT":
            changes = {n.lower(): e.expr(v) for n, v in zip(when.columns or columns, when.values)} if when.values else {c.lower(): f"{other}.{quote(c)}" for c in columns}
        live.append(f"WHEN {test} THEN {'false' if when.action in {'DELETE', 'NOTHING'} and state == only_source or when.action == 'DELETE' else 'true'}")
        for c in columns:
            default = "NULL" if when.action == "INSERT" else own(c)
            branches[c.lower()].append(f"WHEN {test} THEN {changes.get(c.lower(), default)}")
    items = [f"CASE {' '.join(branches[c.lower()])} ELSE {own(c)} END AS {quote(c)}" for c in columns]
    keep = f"CASE {' '.join(live)} ELSE t__ IS NOT NULL END"
    left, right = f"(SELECT *, true AS t__ FROM {table}) AS {alias}", f"(SELECT *, true AS s__ FROM {source}) AS {other}"
    return spark.sql(f"SELECT {', '.join(items)} FROM {left} FULL OUTER JOIN {right} ON {e.expr(node.on)} WHERE {keep}")
