from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborseek.operators import similar
from arborseek.operators.index import Index
from arborseek.plans import catalog, retrieval

CHUNKS = "id string, doc_id string, parent_id string, hierarchy array<string>, depth int, tags array<string>, path string, tree string, body string, position int, byte_start long, byte_end long, sibling_count int, mtime timestamp"
BODIES = ["alpha\nbeta\ngamma\ndelta", "one\n\ntwo\nthrée\nfour", "", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Chunks of one tree: the bodies above, then sixty of one document that share words."""
    bodies = BODIES + [f"cache w{i} w{i} {'cache ' * (i % 3)}" for i in range(60)]
    rows = [(f"t:d{i:02}", f"t:d{i:02}", None, ["Title"], 0, [], f"d{i:02}.md", "t", b, 0, 0, 10, 1, datetime(2025, 1, 1)) for i, b in enumerate(bodies)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{at}/chunks.parquet")
    return at


def test_range_merge_takes_every_line(spark, folder):
    got = sorted((r["id"], r["start"], r["end"]) for r in retrieval.range_merge(spark, folder).where("id < 't:d04'").collect())
    assert got == [("t:d00", 0, 23), ("t:d01", 0, 4), ("t:d01", 5, 21)]


def test_json_of_every_chunk(spark, folder):
    got = {r["id"]: r["json"] for r in catalog.json_results(spark, folder).collect()}
    assert got == {i: f'{{"id":"{i}","doc_id":"{i}","depth":0}}' for i in (f"t:d{k:02}" for k in range(64))}


def test_snippet_of_every_hit(spark, folder):
    got = {r["id"]: r["snippet"] for r in retrieval.snippet(spark, folder).collect()}
    assert len(got) == 60 and all(s.startswith("<b>cache</b> w") for s in got.values())


def test_batched_terms_answers_every_term(spark, tmp_path):
    words = [f"w{i:03}" for i in range(210)]
    texts = {"t:a": " ".join(words), "t:b": " ".join([*words, "w000 w000 longer"]), "t:c": "w001", "t:d": "w001"}
    rows = [(i, i, None, [], 0, [], "p.md", "t", b, 0, 0, 10, 1, datetime(2025, 1, 1)) for i, b in texts.items()]
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["term"]: r["id"] for r in retrieval.batched_terms(spark, str(tmp_path)).collect()}
    assert got == {w: "t:a" for w in words} | {"w000": "t:b", "w001": "t:c", "longer": "t:b"}


def test_more_like_each_agrees_with_one_source(spark, folder):
    index = retrieval._index(spark, folder)
    ids = ["t:d00", "t:d05", "t:d30"]
    got = similar.more_like_each(index.chunks.where(index.chunks.id.isin(*ids)), index).collect()
    for source in ids:
        one = similar.more_like(similar.source_of_chunk(index, source), index, exclude=(source,)).select("id", F.round("score", 5).alias("score"))
        want = [(r["id"], r["score"]) for r in one.orderBy(F.desc("score"), "id").limit(10).collect()]
        assert want and sorted((-r["score"], r["id"]) for r in got if r["source"] == source) == [(-s, i) for i, s in want]
    assert "more_like_each" in retrieval.QUERIES


def records_shuffled(df) -> int:
    """Records that the exchanges of a plan have written, after it ran."""
    waiting, total = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


def test_more_like_each_keeps_pairs_in_their_task(spark, folder):
    """All 64 chunks share a title: more than 4,000 pairs, of which each task gives one a source. Without broadcasts, as for large tables."""
    index = retrieval._index(spark, folder)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = similar.more_like_each(index.chunks, index, top=1)
        assert len(got.collect()) == 64
        assert 64 <= records_shuffled(got) <= 64 * index.chunks.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_more_like_each_in_blocks_and_without_a_document(spark, tmp_path):
    texts = {"t:a": "apple berry", "t:a#one": "apple berry cherry", "t:b": "apple berry", "t:c": "apple berry", "t:d": "cherry"}
    rows = [(i, None if i == "t:c" else i.partition("#")[0], None, None, 0, None, None, "t", b, 0, 0, 10, 1, datetime(2025, 1, 1)) for i, b in texts.items()]
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{tmp_path}/chunks.parquet")
    index = Index.of_words(retrieval._rows(spark, str(tmp_path)))
    one, many = (sorted(map(tuple, similar.more_like_each(index.words, index, top=2, block_terms=n).collect())) for n in (1000, 1))
    assert one == many
    # t:a leaves out its own section; equal scores stand by id
    assert {s: [i for x, i, _ in sorted(one, key=lambda r: (r[0], -r[2], r[1])) if x == s] for s in texts} == {
        "t:a": ["t:b", "t:c"], "t:a#one": ["t:d", "t:a"], "t:b": ["t:a", "t:c"], "t:c": ["t:a", "t:b"], "t:d": ["t:a#one"],
    }
    assert {r["id"] for r in similar.more_like_each(index.words, index, similar.SimilarParams(boost=-1.0)).where("source = 't:d'").collect()} == {"t:a#one"}
    assert similar.more_like_each(index.words.where("id = 't:z'"), index).count() == 0
