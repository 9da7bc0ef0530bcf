"""Plans of the queries: what reaches the scan, shuffles, joins, Python."""

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.plans.inspect import plan_of

SF = "/root/testdata/sf0.001"
#: Their other side has a row for each replica or voter, or one row.
SMALL_SIDES = {"append_entries", "compaction_reclaim", "compaction_select", "election", "follower_logs", "log_divergence", "log_entries_after", "log_truncate", "manifest_live", "replica_last_info", "replica_tail", "term_at", "vote_grant", "wal_max_seq", "wal_valid_prefix"}
#: A fold in order, as a stream of Arrow batches.
FOLDS = {"run_segments", "sparse_block_index", "block_lookup"}


def test_reads_what_the_text_says(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").where("event_id <= 10 and user_id in (1, 2)").groupBy("user_id").agg(F.sum("value"))
    p = plan_of(df)
    ((columns, pushed),) = p.scans
    assert columns == ["event_id", "user_id", "value"] and "LessThanOrEqual(event_id,10)" in pushed
    assert p.shuffles == 1 and p.joins == p.python == p.nested_loops == 0


@pytest.mark.parametrize("name", ["compact_by_key", "compact_by_run"])
def test_versions_after_the_horizon_do_not_move(spark, name):
    p = plan_of(catalog.QUERIES[name](spark, SF))
    assert p.shuffles == 1 and not p.joins and not p.nodes["Window"] and len(p.scans) == 2
    assert all("props" not in columns and any("event_id" in f for f in pushed) for columns, pushed in p.scans)


@pytest.mark.parametrize("name", ["snapshot_as_of", "get_at", "snapshot_diff", "tombstone_mask", "changes_between", "version_history"])
def test_one_pass_and_one_shuffle(spark, name):
    p = plan_of(catalog.QUERIES[name](spark, SF))
    ((columns, pushed),) = p.scans
    assert "props" not in columns and "ts" not in columns
    assert p.shuffles <= 1 and not p.joins and not p.python
    if name in ("snapshot_as_of", "get_at", "snapshot_diff", "changes_between"):
        assert any("(event_id," in f and "LessThanOrEqual" in f for f in pushed)
    if name == "get_at":
        assert any(f.startswith("In(user_id") for f in pushed)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"log_files_recovered", "run_files_read", "stream_latest", "store_compacted", "store_reopened", "store_runs"}))
def test_stays_in_the_jvm_without_nested_loops(spark, name):
    p = plan_of(catalog.QUERIES[name](spark, SF))
    assert not p.rowwise_python and not p.nodes["CartesianProduct"]
    assert name in FOLDS or not p.python
    assert name in SMALL_SIDES or not p.nested_loops
