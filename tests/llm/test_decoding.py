"""How many rows of a Parquet file tasks decode at once, by Spark's own counts."""

import pytest

from quern.llm import common, shard_tree, token_store

SIZE = "spark.sql.parquet.columnarReaderBatchSize"


def decoded(spark, run):
    """Rows and batches of each read of a Parquet file that run() makes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    runs, out = store.executionsList(), []
    for k in range(before, runs.size()):
        told, nodes = store.executionMetrics(runs.apply(k).executionId()), store.planGraph(runs.apply(k).executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "ColumnarToRow":
                values = {(m := node.metrics().apply(i)).name(): told.get(m.accumulatorId()) for i in range(node.metrics().size())}
                out.append(tuple(int(values[x].get().replace(",", "")) for x in ("number of output rows", "number of input batches") if values[x].isDefined()))
    return [x for x in out if len(x) == 2]


@pytest.mark.parametrize("query", [token_store.op2_token_store, shard_tree.op3_shard_tree])
def test_few_rows_of_documents_are_decoded_at_once(spark, tmp_path, query):
    n = 6 * common.DECODED
    spark.range(n).selectExpr("id doc_id", "concat('text ', id) text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get(SIZE)
    spark.conf.unset(SIZE)
    try:
        reads = decoded(spark, lambda: query(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set(SIZE, held)
    whole = [(rows, batches) for rows, batches in reads if rows >= n]  # a read for ranges and a read for rows count as one of twice the rows
    assert whole
    assert all(rows <= batches * common.DECODED for rows, batches in whole)
