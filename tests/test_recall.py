"""The composed recall: every stage changes the result, and missing parts degrade it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from memlake.functions.text import extract_salient
from memlake.operators import recall as rc
from memlake.operators import vector as ve
from memlake.operators.bm25 import KeywordIndex, bm25

NOW = "2024-03-01 00:00:00"


@pytest.fixture(scope="module")
def world(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for key, value in zip(before, ("false", "1", "false")):  # many small plans: compiling them would take most of the time
        spark.conf.set(key, value)
    yield make(spark)
    for key, value in before.items():
        spark.conf.set(key, value)


def make(spark):
    rows = [
        (1, "Deploy plan", "The deploy plan uses staging first and then the alpha cluster with 42 nodes", "note", 0.2, 5),
        (2, "Deploy plan", "The deploy plan uses staging first and then the beta cluster", "note", 0.9, 40),
        (3, "Weekly notes", "Sarah wrote about the deploy of staging", "insight", 0.1, 20),
        (4, "Budget", "Money and costs of the staging cluster. " + "Filler words go here. " * 80 + "The needle clause stands here", "note", 0.5, 30),
        (5, "Sarah", "Nothing to see of it", "note", 0.5, 10),
        (6, "Old deploy", "deploy deploy staging", "note", 0.5, 1),
        (7, "Linked note", "Words without any tie", "note", 0.5, 50),
        (8, "Dormant", "deploy staging plan", "note", 1.0, 59)]
    notes = spark.createDataFrame(rows, "id long, title string, content string, kind string, strength double, day int").select(
        "id", "title", "content", "kind", F.when(F.col("id") == 8, "dormant").otherwise("active").alias("state"), F.lit(None).cast("long").alias("superseded_by"), "strength",
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)").alias("created_at"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)").alias("updated_at"),
        F.lit("f.md").alias("filename"), F.lit("").alias("agent_id"), F.lit(0.9).alias("confidence"))
    vec = {1: [1.0, 0.1, 0.0], 2: [0.9, 0.3, 0.0], 3: [0.5, 0.5, 0.2], 4: [0.4, 0.2, 0.9], 5: [0.0, 1.0, 0.0], 6: [0.7, 0.0, 0.7], 7: [0.0, 0.0, 1.0], 8: [1.0, 0.0, 0.0]}
    chunks = spark.createDataFrame([(i * 10, i, v, "The needle clause stands here" if i == 4 else "The deploy plan") for i, v in vec.items()], "chunk_id long, id long, embedding array<double>, text string")
    titles = spark.createDataFrame([(i, v) for i, v in vec.items()], "id long, embedding array<double>")
    parts = dict(
        chunks=chunks, titles=titles,
        entities=spark.createDataFrame([(1, "Sarah"), (2, "Budget")], "entity_id long, name string"), mentions=spark.createDataFrame([(1, 3, "Sarah"), (1, 5, "Sarah")], "entity_id long, id long, name string"),
        links=spark.createDataFrame([(5, 7, 0.9), (1, 7, 0.8), (2, 7, 0.8), (3, 7, 0.7)], "src long, dst long, similarity double"),
        facts=spark.createDataFrame([("deploy plan", "is", "beta", 2, True), ("deploy plan", "is", "alpha", 1, False)], "subject string, attribute string, value string, id long, current boolean"),
        ranks=spark.createDataFrame([(4, 8.0), (6, 3.0)], "id long, pagerank double"), logits=spark.createDataFrame([(1, 5, 4.0), (1, 6, 2.0), (1, 1, -3.0)], "query_id long, id long, logit double"))
    queries = spark.createDataFrame([(1, 'what is the latest "deploy plan" of Sarah for 42 staging machines', [1.0, 0.2, 0.1])], "query_id long, q string, embedding array<double>")
    index = KeywordIndex.build(notes, "id", "content")

    def run(off=(), queries=queries, drop=(), **more):
        given = {k: v for k, v in parts.items() if k not in drop}
        hits = rc.recall(queries, notes, index, F.lit(NOW).cast("timestamp"), off=frozenset(off), **{**given, **more})
        return [tuple(r) for r in hits.orderBy("place").collect()]

    run.parts, run.queries = parts, queries
    return run, run()


#: Those whose effect the small world shows surely; a run of all parts takes some ten seconds.
@pytest.mark.parametrize("stage", ["title", "facts", "recency", "rerank"])
def test_every_stage_changes_the_result(world, stage):
    run, whole = world
    assert run(off=[stage]) != whole


def test_models_drive_the_stages_that_need_them(world):
    """A toy embedder and re-ranker in place of vectors and logits: R1, R7, R16 and R19 change the result."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def toy(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [1.0 if ord(t.lower()[:1] or " ") % 7 == i else 0.01 for i in range(7)])  # texts of one first letter are alike

    @pandas_udf("double")
    def judge(q: pd.Series, content: pd.Series) -> pd.Series:
        return content.map(lambda c: 5.0 if "Nothing" in c else 2.0 if "Words" in c else -4.0)

    run, _ = world
    chunks = run.parts["chunks"].drop("embedding")
    queries = run.queries.drop("embedding")
    with_models = lambda off=(), **more: run(off=off, queries=queries, drop=("chunks", "titles", "logits"), **{"chunks": chunks, "embedder": toy, "reranker": judge, "k": 4, **more})
    whole = with_models()
    assert not whole[0][-2] and whole[0] and len(whole) == 4
    for stage in ("semantic", "semantic_title", "rerank"):
        assert with_models(off=[stage]) != whole, stage
    assert with_models(off=["rerank", "mmr"]) != with_models(off=["rerank"])


def test_hits_are_live_ranked_and_explained(world, spark):
    run, whole = world
    ids = [r[2] if isinstance(r[2], int) else r[1] for r in whole]
    assert 8 not in ids and len(whole) >= 6
    assert len(run(operators={"kind": "insight"})) == 1
    with pytest.raises(ValueError):
        run(off=["nothing"])


def test_a_query_without_a_vector_is_degraded(world, spark):
    run, _ = world
    q = spark.createDataFrame([(1, "deploy plan", None), (2, "deploy plan", [1.0, 0.0, 0.0])], "query_id long, q string, embedding array<double>")
    rows = rc.channel_weights(q).orderBy("query_id").collect()
    assert rows[0]["degraded"] and not rows[1]["degraded"] and rows[0]["w_semantic"] == 0
    assert abs(rows[0]["w_keyword"] + rows[0]["w_graph"] - 1) < 1e-9 and abs(rows[1]["w_semantic"] - 0.3) < 1e-9
    off = rc.channel_weights(q, frozenset(["semantic"])).orderBy("query_id").collect()
    assert not off[0]["degraded"] and off[0]["w_keyword"] == off[1]["w_keyword"] == 0.5
    assert all(r[-1] for r in run(drop=["chunks"]))


def test_salient_terms(spark):
    texts = ["Sarah met Bob in 2023. Then PostgreSQL broke, didn't it? 'a phrase here' and 'word' \"Two  Words\"", "iPhone 12345 v8 The And", None, "— Sarah said. \"x\""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", extract_salient(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got[0]["names"] == ["bob", "postgresql", "two", "words"] and got[0]["numerals"] == ["2023"] and "two  words" in got[0]["phrases"] and "a phrase here" not in got[1]["phrases"]
    assert got[1]["names"] == ["iphone"] and got[1]["numerals"] == [] and got[2]["names"] == [] and got[3]["names"] == []


def test_knn_by_blocks_equals_one_block(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(6)]) for i in range(300)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("cosine", "one_minus_l2"):
        one, many = ([tuple(r) for r in ve.knn(asked, df, 5, metric=metric, block=b, skip_self=True).select("query_id", "id", F.round("similarity", 9), "rank").collect()] for b in (1000, 20))
        assert sorted(one) == sorted(many) and len(one) == 500
    assert ve.knn(asked.limit(0), df, 5).count() == 0


def _postings(index):
    return {(r["id"], r["term"], r["tf"], r["doc_len"]) for r in index.postings().collect()}


def test_index_is_read_by_bucket(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, "the of")], "doc_id long, text string")
    index = KeywordIndex.build(docs)
    one = index.postings(spark.createDataFrame([("beta",)], "term string"))
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", scan) and index.stats().first()["n_docs"] == 2
    assert [(r["id"], r["tf"]) for r in one.collect()] == [(1, 2)]
    assert _postings(index) == {(1, "alpha", 1, 3), (1, "beta", 2, 3), (2, "alpha", 1, 1)}


def test_index_epochs_equal_a_new_index(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 30))) for i in range(200)}
    frame = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    index = KeywordIndex.build(frame(texts), buckets=8)
    for epoch in range(3):
        changed = {i: " ".join(rng.choices(words, k=20)) for i in rng.sample(range(260), 30)} | {epoch: ""}
        deleted = rng.sample(sorted(set(texts) - set(changed)), 10)
        index = index.update(frame(changed), spark.createDataFrame([(i,) for i in deleted], "doc_id long"))
        texts = {i: t for i, t in (texts | changed).items() if i not in deleted}
    again = KeywordIndex(spark, index.root, index.epochs - 1, 8).update(frame(changed), spark.createDataFrame([(i,) for i in deleted], "doc_id long"))  # a retry
    assert again.epochs == index.epochs == 4
    fresh = KeywordIndex.build(frame(texts), buckets=8)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=5))) for i in range(20)], "query_id long, q string")
    best = [{(r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in bm25(asked, x, 5, prune_from=0).collect()} for x in (fresh, index, index.compact(), KeywordIndex.open(spark, index.root, 8))]
    assert best[0] == best[1] == best[2] == best[3] and len(best[0]) == 100
    assert _postings(index) == _postings(fresh) == _postings(index.compact())


def test_pruned_scores_equal_plain_ones(spark):
    """Zipf-like words: most postings belong to words too weak to matter; held against every score by plain Python."""
    import math
    from collections import Counter

    rng = random.Random(5)
    vocabulary = [f"w{i}x" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [rng.choices(vocabulary, weights, k=rng.randint(5, 60)) for _ in range(600)]
    asked = [rng.choices(vocabulary, weights, k=6) + [rng.choice(t)] for t in texts[:25]] + [["w0x"], ["unknown"]]
    index = KeywordIndex.build(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), buckets=4)
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in bm25(spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "query_id long, q string"), index, 3, probe=5, prune_from=0).collect()}
    df, mean = Counter(w for t in texts for w in set(t)), sum(map(len, texts)) / len(texts)
    want = {}
    for i, q in enumerate(asked):
        scores = []
        for j, t in enumerate(texts):
            tf, s = Counter(t), 0.0
            for w, n in Counter(q).items():
                if tf[w]:
                    raw = math.log((600 - df[w] + 0.5) / (df[w] + 0.5))
                    s += n * raw * (0.25 if raw < 0 else 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean))
            if s:
                scores.append((-round(s, 9), j, s))
        best = max((s for *_, s in scores), default=0)
        for rank, (_, j, s) in enumerate(sorted(scores)[:3]):
            if best <= 0 or s > 0.1 * best:
                want[i, rank + 1] = (j, round(s, 6))
    assert got == want
