import tempfile
import uuid

import pytest

from pitchside.operators.grid import accumulate
from pitchside.operators.summary import season_summary
from pitchside.streaming import CELL_TABLE_SCHEMA, running_heatmap, running_season_summary, start_complete

from conftest import rows


def test_running_heatmap_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="pitchside-cells-")
    batch1 = [("a", "home_team", 2, 2, 0, 0, 3, 1), ("a", "home_team", 2, 2, 0, 1, 0, 0),
              ("b", "opp_team", 2, 2, 0, 0, 4, 1)]
    batch2 = [("c", "home_team", 2, 2, 0, 0, 1, 1), ("c", "home_team", 2, 2, 0, 1, 2, 1)]
    spark.createDataFrame(batch1, CELL_TABLE_SCHEMA).write.mode("append").parquet(src)
    spark.createDataFrame(batch2, CELL_TABLE_SCHEMA).write.mode("append").parquet(src)
    stream = spark.readStream.schema(CELL_TABLE_SCHEMA).parquet(src)
    # the checkpoint lives below spark.checkpoint.dir under the query name, so a
    # re-run of the same name would resume the old stream: use a fresh name
    name = f"heatmap_test_{uuid.uuid4().hex[:8]}"
    query = start_complete(running_heatmap(stream), name, sink="memory")
    query.awaitTermination(120)
    got = rows(spark.sql(f"SELECT * FROM {name}"), "side", "cell_row", "cell_col", "hits")
    want = rows(accumulate(spark.createDataFrame(batch1 + batch2, CELL_TABLE_SCHEMA), by=["side"]),
                "side", "cell_row", "cell_col", "hits")
    assert got == want == [("home_team", 0, 0, 2), ("home_team", 0, 1, 1), ("opp_team", 0, 0, 1)]


def test_running_summary_equals_batch_in_files(spark):
    src, out = tempfile.mkdtemp(prefix="pitchside-tm-"), tempfile.mkdtemp(prefix="pitchside-sum-") + "/t"
    schema = "date timestamp, team string, goals int, xg double"
    measures = {"goals": "sum", "xg": "mean"}
    for part in ([("2024-03-01 00:00:00", " A ", 2, 1.5), ("2023-03-01 00:00:00", "A", 9, 9.0)], [("2024-04-01 00:00:00", "A", 1, 0.5), ("2024-04-01 00:00:00", "B", None, None)]):
        spark.createDataFrame(part, "date string, team string, goals int, xg double").selectExpr("CAST(date AS timestamp) AS date", "team", "goals", "xg").write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    with pytest.raises(ValueError, match="path"):
        start_complete(running_season_summary(stream, measures, 2024), "nowhere")
    start_complete(running_season_summary(stream, measures, 2024), f"summary_{uuid.uuid4().hex[:8]}", path=out).awaitTermination(120)
    want = rows(season_summary(spark.read.parquet(src), measures, 2024), "team", "goals", "xg")
    assert rows(spark.read.parquet(out), "team", "goals", "xg") == want == [("A", 3, 1.0), ("B", 0, None)]
