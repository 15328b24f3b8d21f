from __future__ import annotations

import os
from collections import Counter

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_tables
def test_entry_returns_ranked_rows(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 10


@needs_tables
@pytest.mark.parametrize("name", __spark_entry__.oracle_sql())
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v).replace("+00:00", "")
    found = __spark_entry__.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    got = found.select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@needs_tables
def test_every_page_names_its_class(spark):
    known = __spark_entry__.queries()
    rows = known["name_members"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    copies = Counter(r.rep for r in rows)
    assert all(copies[r.rep] == r.copies for r in known["name_classes"](spark, SF).collect())
    pairs = known["near_dup_pairs"](spark, SF).collect()
    assert {x for r in pairs for x in (r.a, r.b)} <= set(copies)
