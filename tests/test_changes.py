from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from arborseek.operators import changes as module
from arborseek.operators.changes import Ledger, changes, clean_path, document_changes, reread_from, run_once, unprocessed

RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string, n_files int"
LOG = "run_id long, abs_path string, tree string, path string, mtime timestamp, op string, doc_id string"
CHUNKS = "doc_id string, path string, mtime timestamp, body string"


def test_clean_path(spark):
    cases = {"a/b.md": "a/b.md", "a//b.md": "a/b.md", "./a/b.md": "a/b.md", "a\\b.md": "a/b.md", "a/./b/../c.md": "a/c.md", "../a": "a", "/a/": "a", "": "", "./.": "", "..x/.y": "..x/.y", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", clean_path("p")).collect()} == cases


def test_document_changes(spark):
    t = [D(2025, 1, 1, 0, 0, i, 500000) for i in range(10)]
    s = [x.replace(microsecond=0) for x in t]
    runs = spark.createDataFrame([(1, t[0], t[1], "committed", 1), (1, t[0], t[1], "committed", 1), (2, t[2], t[3], "failed", None), (3, t[4], None, "committed", None), (4, t[5], None, None, None)], RUNS)
    log = spark.createDataFrame(
        [
            (1, "", "x", "same.md", s[1], "put", "clash"),
            (1, "", "x", ".//same.md", s[1], "put", "clash"),  # another spelling
            (1, "", "x", "older.md", s[5], "put", None),
            (1, "", "x", "unfinished.md", s[1], "put", None),
            (2, "", "x", "unfinished.md", s[2], "put", None),  # its run failed
            (4, "", "x", "open.md", s[2], "put", None),
            (1, "", "x", "gone.md", s[1], "put", None),
            (1, "", "x", "dropped.md", s[1], "put", None),
            (3, "", "x", "dropped.md", None, "drop", None),
            (1, "", "x", "back\\again.md", s[1], "put", None),
            (3, "", "x", "back/again.md", None, "drop", None),
            (1, "", None, "no-tree.md", s[1], "put", None),
        ],
        LOG,
    )
    chunks = spark.createDataFrame(
        [("x:same.md", "same.md", t[0], "a"), ("x:same.md", "same.md", t[1], None), ("x:same.md", "same.md", None, ""), ("x:older.md", "", t[2], ""), ("x:unfinished.md", "", t[2], ""), ("x:open.md", "", t[2], ""), ("x:back/again.md", "", t[1], ""), (None, "", t[1], "")],
        CHUNKS,
    )
    got = {tuple(r) for r in document_changes(chunks, log, runs).collect()}
    assert got == {("x:older.md", "modified"), ("x:unfinished.md", "modified"), ("x:open.md", "added"), ("x:gone.md", "removed"), ("x:back/again.md", "added")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], CHUNKS)
    assert document_changes(none, spark.createDataFrame([], LOG), spark.createDataFrame([], RUNS)).count() == 0
    pairs = spark.createDataFrame([("a", None), ("b", D(2025, 1, 1))], "key string, version timestamp")
    assert {tuple(r) for r in changes(pairs, pairs.limit(0)).collect()} == {("a", "added"), ("b", "added")}
    assert changes(pairs, pairs).count() == 0  # a null version agrees with a null version


def test_reread_from_the_oldest_open_run(spark):
    t = [D(2025, 1, 1, i) for i in range(10)]
    runs = spark.createDataFrame([(1, t[0], t[1], "committed", 1), (2, t[2], None, None, 1), (3, t[3], t[6], "failed", 1), (4, t[5], t[7], "committed", 1), (5, t[8], None, None, 1)], RUNS)
    assert reread_from(runs) == t[2]
    assert reread_from(runs.where("run_id = 2")) is None
    assert reread_from(runs.limit(0)) is None


def test_ledger_survives_failure_and_repeats_nothing(spark, tmp_path):
    t = [D(2025, 1, 1, i) for i in range(10)]
    source = lambda *rows: spark.createDataFrame(rows, "key string, version timestamp, body string")
    ledger = Ledger(spark, str(tmp_path))
    first = source(("a", t[1], "x"), ("b", t[2], "y"))
    assert unprocessed(first, ledger.pairs(), ledger.since()).count() == 2
    # a run that fails before its marker leaves only pairs
    spark.createDataFrame([("a", t[1])], "key string, version timestamp").write.parquet(f"{tmp_path}/pairs/0-broken")
    assert unprocessed(first, ledger.pairs(), ledger.since()).count() == 2
    ledger.commit(1, first, t[0])
    ledger.commit(1, first, t[0])  # repeated
    assert ledger.pairs().count() == 2
    assert ledger.since() == t[0]
    # a transaction open at run 1 commits a row stamped before b; a row with no version; b changes
    second = source(("a", t[1], "x"), ("b", t[3], "z"), ("late", t[1], ""), ("none", None, None))
    new = unprocessed(second, ledger.pairs(), ledger.since())
    assert {r["key"] for r in new.collect()} == {"b", "late", "none"}
    ledger.commit(2, new, t[3])
    assert unprocessed(second, ledger.pairs(), ledger.since()).count() == 0


def test_hot_key_and_clashing_columns(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").alias("version"), F.lit(1).alias("change_kind"), F.lit(2).alias("now"))
    known = spark.createDataFrame([("hot", D(1970, 1, 1, 0, 49, 59))], "key string, version timestamp")
    assert changes(rows, known).count() == 0


SOURCE = "key string, version timestamp, body string, written timestamp"


@pytest.mark.parametrize("dies", ["process", "pairs", "marker", "checkpoint", "never"])
def test_a_run_killed_after_any_step_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, dies):
    t, kind = [D(2025, 1, 1, i) for i in range(10)], dies
    source = spark.createDataFrame([("a", t[1], "x", t[1]), ("b", None, "y", t[2])], SOURCE)
    ledger, out = Ledger(spark, str(tmp_path)), {}

    def process(new, run):
        out[run] = sorted(r["key"] for r in new.collect())
        if dies == "process":
            raise RuntimeError

    def killed(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        if dies == "pairs":
            m.setattr(ledger, "_mark", killed)
        if dies == "marker":
            m.setattr(ledger, "_put", killed)
        if dies in ("process", "pairs", "marker"):
            with pytest.raises(RuntimeError):
                run_once(source, ledger, 1, process, t[3])
            assert ledger.pairs().count() == 0 and not ledger.has(1)
        if dies == "checkpoint":  # the marker is there, and the engine replays the batch all the same
            run_once(source, ledger, 1, process, t[3])
    dies = "never"
    assert run_once(source, ledger, 1, process, t[3]) != (kind == "checkpoint")
    assert out == {1: ["a", "b"]} and ledger.pairs().count() == 2
    assert not run_once(source, ledger, 1, process, t[3]) and ledger.pairs().count() == 2
    run_once(source, ledger, 2, process, t[4])
    assert out[2] == [] and ledger.pairs().count() == 2


def test_rereading_from_the_oldest_open_transaction(spark, tmp_path):
    t = [D(2025, 1, 1, i) for i in range(10)]
    ledger, out = Ledger(spark, str(tmp_path)), {}
    process = lambda new, run: out.update({run: sorted(r["key"] for r in new.collect())})
    first = [("a", t[1], "x", t[1]), ("b", t[1], "y", t[3])]
    ledger.begin("slow", t[2])
    run_once(spark.createDataFrame(first, SOURCE), ledger, 1, process, t[4], stamp="written")
    assert ledger.since() == t[2]
    ledger.end("slow")
    # the slow transaction's row is stamped before b; a has an unseen version but was written before the bound
    second = [*first, ("late", t[0], "", t[2]), ("a", t[5], "", t[1])]
    run_once(spark.createDataFrame(second, SOURCE), ledger, 2, process, t[5], stamp="written")
    assert out == {1: ["a", "b"], 2: ["late"]} and ledger.since() == t[5]
    # without a stamp everything is reread
    run_once(spark.createDataFrame(second, SOURCE), ledger, 3, process, t[6])
    assert out[3] == ["a"]


def test_what_is_recorded_is_what_was_processed(spark, tmp_path):
    path, ledger, out = str(tmp_path / "in"), Ledger(spark, str(tmp_path / "ledger")), {}
    schema = "key string, version timestamp"
    spark.createDataFrame([("a", D(2025, 1, 1))], schema).write.parquet(path)

    def process(new, run):
        out[run] = sorted(r["key"] for r in new.collect())
        if run == 1:  # the source moves on while the run is at work
            spark.createDataFrame([("b", D(2025, 1, 2))], schema).write.mode("append").parquet(path)

    read = lambda: spark.read.schema(schema).parquet(path)
    run_once(read(), ledger, 1, process, D(2025, 1, 3))
    run_once(read(), ledger, 2, process, D(2025, 1, 4))
    assert out == {1: ["a"], 2: ["b"]}


def test_compaction_keeps_pairs_runs_and_bound(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    for i in range(3):
        ledger.commit(i, spark.createDataFrame([(f"k{i}", D(2025, 1, 1)), ("k", None)], "key string, version timestamp"), D(2025, 1, 1 + i))
    ledger.compact()
    assert len(ledger._marks()) == 1 and ledger.pairs().count() == 4 and ledger.since() == D(2025, 1, 3)
    assert all(ledger.has(i) for i in range(3))
    ledger.commit(3, spark.createDataFrame([("k3", None)], "key string, version timestamp"), D(2025, 1, 9))
    assert ledger.pairs().count() == 5 and ledger.since() == D(2025, 1, 9)


def test_runs_compact_the_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "COMPACT", 2)
    ledger, out = Ledger(spark, str(tmp_path)), {}
    for i in range(6):
        rows = spark.createDataFrame([(f"k{k}", D(2025, 1, 1)) for k in range(i + 1)], "key string, version timestamp")
        run_once(rows, ledger, i, lambda new, run: out.update({run: [r["key"] for r in new.collect()]}), D(2025, 1, 1 + i))
    assert out == {i: [f"k{i}"] for i in range(6)} and len(ledger._marks()) <= 3 and ledger.pairs().count() == 6 and ledger.since() == D(2025, 1, 6)


def test_null_and_clashing_keys(spark):
    rows = spark.createDataFrame([("a", None, 1), (None, None, 2), ("b", D(2025, 1, 1), 3)], "key string, version timestamp, __fresh int")
    known = spark.createDataFrame([("a", None), ("c", None), (None, None)], "key string, version timestamp")
    assert {tuple(r) for r in changes(rows, known).collect()} == {("b", "added"), ("c", "removed")}
