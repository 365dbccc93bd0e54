"""Registered queries against DuckDB on the smallest tables, and the contract of the entry file."""
import pytest

import __spark_entry__ as entry
from tests import oracle

CHEAP = """a1_read_ticks a4_compact a7_import_days a9_check_manifest e20_coverage_runs d2_bars_covered c2_overlay d6_scorecard d10_metrics
d12_promotion d14_filter_analysis e28_rolling_bounds t6_bench_states c11_fifo_total e36_average_cost e29_risk_scale c19_reconcile h5_size_order
b10_entry_risk h18_intent_key h19_audit_chain d28_sentiment a10_parse_ohlc a16_learner_store c8_excursions e31_cooldown t2_drop_replays t3_gaps t7_quote_throttle""".split()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, sf, con, name):
    msg, rows = oracle.compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name])
    assert not msg, msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"symbol", "t", "close", "ofi"} <= set(df.columns)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180
