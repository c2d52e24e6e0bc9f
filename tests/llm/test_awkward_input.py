"""Clashing names, shared offsets, contradictory labels, repeated ids."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from worksight.llm import mixing, neighbours, toxicity


def test_mixing_with_columns_of_any_name(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, 1 + i % 9, f"k{i}", i * 10, "t", "h", "x") for i in range(200)]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, size long")
    odd = spark.createDataFrame(rows, "doc_id long, source string, size long, key string, n long, target string, h string, _size string")
    odd = odd.withColumns({x: F.lit("own") for x in ("b", "total", "copies", "ahead", "row", "id", "_place", "source_size")})
    want = {r["doc_id"]: (r["copies"], r["target"], r["source_size"]) for r in mixing.mix(plain).collect()}
    got = mixing.mix(odd)
    assert set(got.columns) == set(odd.columns)
    for r in got.collect():
        assert want[r["doc_id"]] == (r["copies"], r["target"], r["source_size"])
        assert (r["key"], r["n"], r["h"], r["_size"], r["b"], r["row"]) == (f"k{r['doc_id']}", r["doc_id"] * 10, "h", "x", "own", "own")


def test_one_large_shared_coordinate_leaves_few_pairs():
    """An offset that all candidates share is taken off before quantising, so the bound still prunes."""
    rng = np.random.default_rng(1)
    found, queries = rng.normal(size=(4096, 768)), rng.normal(size=(256, 768))
    found[:, 5] += 1000
    queries[:, 5] += 1000
    tracemalloc.start()
    q, v, score = neighbours.best_of_tile(queries, found, np.ones((256, 4096), bool), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * 2 ** 20 and len(q) < 0.3 * 256 * 4096
    exact = queries @ found.T
    best = np.argsort(-exact, axis=1)[:, :20]
    pairs = set(zip(q.tolist(), v.tolist()))
    assert all((i, int(j)) in pairs for i in range(256) for j in best[i])
    assert np.allclose(score, exact[q, v])


def test_equal_vectors_are_multiplied_in_slices(spark):
    found = np.ones((4096, 768))
    tracemalloc.start()
    q, _, score = neighbours.best_of_tile(found[:256], found, np.ones((256, 4096), bool), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q) == 256 * 4096 and (score == 768).all() and peak < 400 * 2 ** 20
    df = spark.createDataFrame([(i, [1.0] * 40) for i in range(200)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, k=3, every=100, block=64).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2)]


def test_contradictory_labels_and_rare_features(spark):
    rng = random.Random(5)
    mild = "such a day and the garden with some rather long words that show what letters follow".split()
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(mild) for _ in range(40)]
        if i % 3 == 0:                 # sixty toxic words, each in a few rows only
            words[rng.randrange(40)] = f"vile{'abcdefghij'[i // 3 % 10]}{'klmnop'[i // 30 % 6]}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    one = toxicity.fit(df, known, F.lit(True))
    two = toxicity.fit(df.repartition(5), known.repartition(7), F.lit(True))
    assert list(one.wanted) == list(two.wanted) and np.allclose(one.weights, two.weights, atol=1e-6)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, one).collect()}
    assert np.mean([(scores[i] > 0.5) == bool(t) for i, t in labels]) > 0.97


def test_one_row_of_each_component_stays(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(2)
    base = ["w" + str(rng.randrange(10 ** 6)) for _ in range(80)]

    def near(i):
        return " ".join([*base[:-1], f"end{i}"])
    other = " ".join("o" + str(rng.randrange(10 ** 6)) for _ in range(50))
    rows = [(1, near(0)), (1, near(1)), (1, near(2)), (None, near(3)), (None, near(4)), (2, other), (2, other), (None, None), (3, None),
            (3, None), (4, ""), (5, "short text"), (1, "short text of another kind that has no like in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_label": F.lit("x"), "kept": F.lit(1)})
    got = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len([x for x in left if x[1] and x[1].startswith("w")]) == 1 and (2, other) in left
    assert sorted(map(str, left)) == sorted(map(str, {x for x in left}))
    assert {x for x in left if not (x[1] or "").startswith("w")} == {x for x in rows if not (x[1] or "").startswith("w")}


def test_null_ids_yield_to_others(spark, tmp_path):
    import corpus_pipeline
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (9, text + " more"), (None, text + " less")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()] == [9]
