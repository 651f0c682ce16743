"""Row-set comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def difference(df, con, sql: str) -> str | None:
    """What differs in columns, types or rows; None if nothing does."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if SPARK_TO_DUCK.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} against {types[name]}"
    cols = sorted(df.columns)
    ours = Counter(tuple(map(_cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    theirs = Counter(tuple(map(_cell, r)) for r in rel.select(quoted).fetchall())
    if ours == theirs:
        return None
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; ours only {list((ours - theirs).items())[:3]};" \
           f" SQL only {list((theirs - ours).items())[:3]}"
