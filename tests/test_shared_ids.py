"""Queries against their SQL where users share a subject: ids of five digits, of which the subject keeps four."""

import duckdb
import pytest

from tideline import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: The users of the smallest tables, in order: three alone, then those of S1000, S1001, S1002, S9999 and S2000.
USERS = (3, 45, 777, 1000, 10000, 10001, 1001, 10015, 10019, 1002, 10020, 9999, 99990, 20000, 20009)
#: Purchases that leave two scores to S0045, S0777 and S2000.
LACKS = "user_id = 45 and v = 3 or user_id = 777 and v = 2 or user_id = 20000 and v > 1 or user_id = 20009 and v < 3"
NAMES = ("agg_01_collapse_conflicts", "agg_09_qc_pairs", "agg_09_qc_visits", "agg_10_delta_summary", "agg_11_cohens_d_by_feature", "agg_12_paired_deltas", "agg_12_paired_t", "agg_12_paired_ttest", "agg_14_clinical_effects", "agg_14_reference_effects", "agg_17_adjacent_pair_effects", "agg_20_single_feature_baselines", "agg_22_coefficient_summary", "bootstrap_ci_md5")


@pytest.fixture(scope="module")
def shared(sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("shared")
    c = duckdb.connect()
    c.execute(f"create table e as select event_id, ts, {list(USERS)}[1 + user_id] user_id, event_type, value, props, least(3, 1 + (day(ts) - 1) // 10) v from '{sf}/events.parquet'")
    c.execute(f"copy (select * exclude v from e where not (event_type = 'purchase' and ({LACKS})) order by event_id) to '{path}/events.parquet' (format parquet)")
    return str(path)


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r if not isinstance(x, float)] + [x for x in r if isinstance(x, float)])


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, shared):
    df = QUERIES[name](spark, shared)
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    c.execute(f"create view events as select * from '{shared}/events.parquet'")
    found = c.execute(ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = ordered([tuple(r[at.index(x)] for x in columns) for r in found.fetchall()])
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and y is not None else x == y
