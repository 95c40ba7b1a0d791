"""Every registered query against its SQL, on the smallest tables that give rows.

``python tests/oracle.py sf0.01`` does the same on larger tables.
"""

import os

import pytest

from oracle import compare, connect, plan_flags
from sungrid.queries import REGISTRY

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Too few hours of the smallest tables have all columns.
NEED_LARGER = {"corr_pearson", "corr_kendall", "corr_spearman", "mutual_information", "top_correlations", "cv_search_multi", "mutual_information_knn",
               "cv_losses", "cv_search", "ensemble_mean", "optimal_lag", "daily_lags", "linreg_multi", "linreg_multi_series", "linreg_qr", "cv_halving"}


@pytest.fixture(scope="module")
def con():
    return {d: connect(d) for d in (SMALL, LARGER)}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    run, sql = REGISTRY[name]
    sf_dir = LARGER if name in NEED_LARGER else SMALL
    df = run(spark, sf_dir)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(name, df, con[sf_dir], sql) is None
    assert plan_flags(df) == [] or name in ("rank_configs",)  # ranks five rows


def test_every_query_has_a_callable_and_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
