"""Run registered queries next to their SQL and compare row for row.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def compare(df, db, sql):
    """None when equal, else what differs."""
    spark_names = sorted(df.columns)
    found = Counter(tuple(plain(r[c]) for c in spark_names) for r in df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != spark_names:
        return f"columns {spark_names} / {sorted(names)}"
    kinds = dict(zip(names, (str(d[1]) for d in result.description)))
    order = [names.index(c) for c in spark_names]
    wanted = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [(c, t, kinds[c]) for c, t in df.dtypes if types.get(t) != kinds[c]]
    if wrong:
        return f"types {wrong}"
    if found != wanted:
        left, right = found - wanted, wanted - found
        return (
            f"rows {sum(found.values())} / {sum(wanted.values())}, only spark {sum(left.values())}: "
            f"{str(sorted(left, key=str)[:2])[:600]} only sql {sum(right.values())}: {str(sorted(right, key=str)[:2])[:600]}"
        )
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from postweave.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(fn(spark, sf_dir), db, sqls[name])
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
