"""Queries against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cribrum.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
#: One query of each family; the driver compares all of them.
CHOSEN = [
    "labelled_entities", "agg6_batch_stats", "agg8_variance_explained", "jon1_lookup_cascade", "flt3_funnel", "flt7_containment_gate", "flt10_quantile_labels", "win1_rank_norm",
    "win3_ordinal_rank", "win5_fractional_rank", "met1_auroc", "met2_average_precision", "met3_pr_trapezoid", "met5_best_f1", "met11_correlations", "met12_signed_rank_statistic",
    "jon6_nearest_reference", "jon8_similarity_join", "jon10_nearest_neighbours", "jon12_radius_join", "win7_argmax_group", "win9_argmax_strict", "agg27_largest_component", "str3_resume", "snk6_finish_groups",
    "jon8_similar_pairs", "jon11_ordered_pairs", "win13_pair_to_row_score", "agg10_distribution", "flt7_reference_flags", "flt15_final_gate", "met15_fold_pairs", "src5_batch_log", "src6_header_search", "src12_row_ids", "snk3_roll_up",
]


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    return value if isinstance(value, (int, bool, type(None))) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    result = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    expected = sorted((tuple(norm(dict(zip(names, row))[c]) for c in cols) for row in result.fetchall()), key=str)
    assert got == expected


def test_contract_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
