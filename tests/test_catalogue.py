"""Every query of the catalogue against its SQL."""

import math
import os

import duckdb
import pytest

from marginalia.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(shown(r[c]) for c in cols) for r in got.collect()) == want


def test_queries_without_sql_have_tests_of_their_own():
    assert set(catalogue.queries()) - set(SQL) == {"twister_shuffle", "ivf_search", "recursive_chunks", "mmr_select", "kcenter_select", "label_prototypes_kmeans", "disagreement_bucket", "diversity_bucket", "retrieve_diverse", "self_consistency_plan"}
