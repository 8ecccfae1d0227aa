"""Streamed versions of documents: three micro-batches, restarts from the checkpoint, late input, forgotten documents."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clausework.streaming import folder, versions

FIRST = "第１条（目的）\n目的を定める。\n第２条（適用）\n従業員に適用する。\n第３条（休日）\n日曜とする。"
SECOND = "第１条（目的）\n目的を定める。\n第２条（定義）\n定義する。\n第３条（適用）\n従業員に適用する。\n第４条（休日）\n土曜とする。"
THIRD = "第１条（適用）\n従業員に適用する。\n第２条（休日）\n土曜とする。"
SCHEMA = "doc_id long, at timestamp, text string"


def day(n):
    return datetime(2024, 1, n)


@pytest.fixture
def arrive(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = set()

    def put(rows, idle=10**9):
        """What a stream that is started on its checkpoint makes of rows that have arrived, in one batch: timers of processing time ask for another one for ever."""
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = versions.changes(docs, idle).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        assert out.awaitTermination(60)
        rows = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        new = rows - seen
        seen.update(rows)
        return {(r[0], r[1].day, *r[2:]) for r in new}

    yield put
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_versions_against_the_state(arrive):
    assert arrive([(1, day(1), FIRST), (2, day(1), None)]) == {(1, 1, "目的", "added", None, 1), (1, 1, "適用", "added", None, 2), (1, 1, "休日", "added", None, 3)}
    assert arrive([(1, day(3), SECOND), (2, day(2), THIRD)]) == {(1, 3, "定義", "added", None, 2), (1, 3, "適用", "renumbered", 2, 3), (1, 3, "休日", "changed", 3, 4), (2, 2, "適用", "added", None, 1), (2, 2, "休日", "added", None, 2)}
    assert arrive([(1, day(2), FIRST), (1, day(4), THIRD), (2, day(2), FIRST)]) == {(1, 2, None, "late", None, None), (2, 2, None, "late", None, None), (1, 4, "目的", "deleted", 1, None), (1, 4, "定義", "deleted", 2, None), (1, 4, "適用", "renumbered", 3, 1), (1, 4, "休日", "renumbered", 4, 2)}


def test_idle_documents_are_forgotten(arrive):
    arrive([(1, day(1), FIRST)], idle=1)
    arrive([(9, day(1), "")], idle=1)  # the timer of document 1 runs out
    assert len(arrive([(1, day(2), FIRST)], idle=1)) == 3


def test_articles_of_a_text():
    assert versions.articles("第１条（甲）\n一。\n２　二。\n第２条（甲）\n三。") == [("甲", 1, "一。\n二。"), ("甲#2", 2, "三。")] and versions.articles(None) == []


def test_lines_that_arrive(spark, tmp_path):
    spark.createDataFrame([(1, "第１条（甲）\n一。")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = folder.arriving_lines(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.read.parquet(str(tmp_path / "out")).agg(F.count("*")).first()[0] == 2
