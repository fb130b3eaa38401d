"""Every query with an oracle against DuckDB on the smallest tables; the others have to give rows."""

import math

import duckdb
import pytest

from spotloom.plans import catalogue, deeper, further, more, recovery  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, bool):
            return x
        return float(x) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_oracle(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    want = plain(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert got == want


#: a selection by significance, which may leave none
MAY_BE_EMPTY = {"spa11_selected"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.columns and (df.count() > 0 or name in MAY_BE_EMPTY)


def test_tasks_of_dealt_counts_follow_the_lines(spark, sf_dir):
    """Each task adds up so many lines, so that its memory doesn't grow with the table."""
    from spotloom.plans.views import Views

    v = Views(spark, sf_dir)
    got, tasks = v.dealt_counts(lines=200)
    assert tasks >= v.table("lineitem").count() / 200 and got.rdd.getNumPartitions() == tasks
    assert sorted(got.collect()) == sorted(v.counts.collect())
