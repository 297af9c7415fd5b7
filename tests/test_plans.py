"""Physical-plan properties that matter at scale."""

from pyspark.sql import functions as F

from taffeta.plans import catalog
from taffeta.sources.tables import load_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_strategy_lookup_broadcasts_fixed_catalog(spark, sf_small):
    p = plan_of(catalog.QUERIES["resolve_strategy"](spark, sf_small))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_no_single_partition_exchange_on_row_data(spark, sf_small):
    for name in ("prefix_pairs", "split_by_record", "cap_per_station", "debounce_events", "ngram_model"):
        p = catalog.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in p, name


def test_prompt_grid_is_a_generator_not_a_join(spark, sf_small):
    p = plan_of(catalog.QUERIES["prompt_grid"](spark, sf_small))
    assert "Generate" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns_and_pushes_filters(spark, sf_small):
    df = load_table(spark, sf_small, "documents", spread_small=False).where(F.col("doc_id") < 10).select("doc_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in p
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in p


def test_dedup_shuffles_records_not_pairs(spark, sf_small):
    p = catalog.QUERIES["prefix_pairs"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    # exactly one hash exchange (records), the Generate of pairs runs after it
    assert p.count("Exchange hashpartitioning") == 1


def test_no_query_plans_a_cross_join(spark, sf_small):
    import __spark_entry__ as E
    offenders = []
    for name, q in E.queries().items():
        p = q(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in p or "NestedLoopJoin" in p:
            offenders.append(name)
    assert offenders == []
