"""Queries against their SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from lexiloom.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
#: A query of every kind; the others run the same operators.
NAMES = """fingerprint_exact fingerprint_lower hygiene_filter english_heuristic first_user_turn paraphrase_valid trigger_substitution framing_one_per_row
confusion_metrics wilson slice_metrics_grouping_sets auc average_precision threshold_under_budget benign_threshold recall_at_fpr design_effect frontier_sweep
joint_bootstrap_diff twoway_cell_diff interaction_diff share_t1_t3 holm containment_edges near_dup_components component_ledger cross_domain_removal
dedup_prefer_test embedding_pairs stratified_split random_group_split largest_remainder_alloc cell_sample_pool partition_ledger largest_groups event_windows""".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    cur = db.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=repr)
