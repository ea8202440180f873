"""Driver contract: entry() runs; every registered query has an oracle."""

import re

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and all(r["status"] and r["key"] for r in rows)
    shown = [r["next_interview"] for r in rows]
    assert shown == sorted(shown, key=lambda x: (x == "", x))  # the flagship comes in its order


def test_every_query_has_an_oracle():
    own = {n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own and own <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())
