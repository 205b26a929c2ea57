from datetime import datetime as D

import pytest
from pyspark.errors import StreamingQueryException

from arborseek.operators.changes import Ledger
from arborseek.streaming.ingest import chunk_stream, ingest


def test_older_file_times_arrive_late(spark, tmp_path):
    schema = "doc_id string, mtime timestamp, body string"
    data, ledger, seen = str(tmp_path / "in"), Ledger(spark, str(tmp_path / "ledger")), []
    for row in (("a", D(2025, 1, 9), "x"), ("b", D(2024, 1, 1), "y")):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(data)
        ingest(chunk_stream(spark, data, schema), ledger, lambda df, run: seen.extend(r["doc_id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["a", "b"]


@pytest.mark.parametrize("step", ["before", "after"])
def test_a_replayed_batch_neither_empties_the_ledger_nor_repeats(spark, tmp_path, monkeypatch, step):
    schema = "doc_id string, mtime timestamp, key int, row string"
    data, ledger, out = str(tmp_path / "in"), Ledger(spark, str(tmp_path / "ledger")), {}
    spark.createDataFrame([("a", D(2025, 1, 9), 1, "x"), ("b", None, 2, "y")], schema).coalesce(1).write.parquet(data)
    go = lambda: ingest(chunk_stream(spark, data, schema), ledger, lambda df, run: out.update({run: sorted(tuple(r) for r in df.select("doc_id", "key", "row").collect())}), str(tmp_path / "cp")).awaitTermination()
    commit = Ledger.commit

    def killed(*a):
        if step == "after":
            commit(*a)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", killed)
        with pytest.raises(StreamingQueryException):
            go()
    go()
    assert list(out.values()) == [[("a", 1, "x"), ("b", 2, "y")]] and ledger.pairs().count() == 2
    spark.createDataFrame([("a", D(2025, 1, 9), 1, "x"), ("c", None, 3, "z")], schema).coalesce(1).write.mode("append").parquet(data)
    go()
    assert list(out.values())[1] == [("c", 3, "z")] and ledger.pairs().count() == 3


def test_a_new_checkpoint_is_another_stream(spark, tmp_path):
    schema = "doc_id string, mtime timestamp"
    data, ledger, out = str(tmp_path / "in"), Ledger(spark, str(tmp_path / "ledger")), {}
    for n, name in enumerate("ab"):
        spark.createDataFrame([(name, None)], schema).coalesce(1).write.mode("append").parquet(data)
        ingest(chunk_stream(spark, data, schema), ledger, lambda df, run: out.update({run: [r["doc_id"] for r in df.collect()]}), str(tmp_path / f"cp{n}")).awaitTermination()
    assert list(out.values()) == [["a"], ["b"]]
