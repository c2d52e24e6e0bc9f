"""Pair joins against brute force, with salting forced and with large groups."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worksight.constants import ENGLISH_STOP_WORDS
from worksight.functions.geo import forward_steps
from worksight.operators import duplicates as D, proximity as G


def tfidf_pairs(texts: dict[str, str], threshold=0.55):
    stop, bags = set(ENGLISH_STOP_WORDS), {}
    for key, text in texts.items():
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        bags[key] = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
    df = Counter(t for bag in bags.values() for t in bag)
    vectors = {}
    for key, bag in bags.items():
        v = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[key] = {t: x / norm for t, x in v.items()}
    out = {}
    for a, b in itertools.combinations(sorted(texts), 2):
        s = sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items())
        if s >= threshold:
            out[a, b] = round(s, 3)
    return out


def some_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["road", "school", "bridge", "water", "tank", "hall", "ward", "north", "south", "repair", "new",
             "the", "of", "x", "élan", "дом", "2021", "drain_pipe"]
    texts = {f"P{i:03d}": " ".join(rng.choices(words, k=rng.randint(0, 7))) for i in range(n)}
    texts["P001"] = texts["P002"] = "The ROAD to water tank"
    texts["P003"] = "the of a"
    return texts


@pytest.mark.parametrize("rows_per_task", [20_000, 2])
@pytest.mark.parametrize("threshold", [0.55, 0.8])
def test_duplicate_pairs_equal_brute_force(spark, rows_per_task, threshold):
    texts = some_texts(120)
    docs = spark.createDataFrame(list(texts.items()), "project_id string, body string")
    got = D.duplicate_pairs(docs, "project_id", F.col("body"), threshold=threshold, rows_per_task=rows_per_task)
    rows = got.collect()
    assert len(rows) == len({(r.project_id_1, r.project_id_2) for r in rows})
    want = tfidf_pairs(texts, threshold)
    assert {(r.project_id_1, r.project_id_2): r.similarity_score for r in rows} == pytest.approx(want, abs=1.1e-3)
    assert set(want) == {(r.project_id_1, r.project_id_2) for r in rows}


def test_duplicate_risk_is_the_best_partner(spark):
    texts = some_texts(80, seed=9)
    docs = spark.createDataFrame(list(texts.items()), "project_id string, body string")
    best = dict.fromkeys(texts, 0.0)
    for pair, s in tfidf_pairs(texts).items():
        for p in pair:
            best[p] = max(best[p], s)
    rows = D.duplicate_risk(docs, text=F.col("body")).collect()
    assert {r.project_id: r.duplicate_match_score for r in rows} == pytest.approx(best, abs=1.1e-3)
    assert all(r.duplicate_anomaly == (best[r.project_id] > 0) for r in rows)
    assert all(r.duplicate_risk_score == pytest.approx(min(100, r.duplicate_match_score * 100)) for r in rows)


def test_a_third_of_all_texts_are_copies(spark):
    docs = spark.range(6000).selectExpr(
        "concat('P', id) as project_id",
        "case when id % 3 = 0 then 'community hall ward' else concat('w', id, ' v', id * 7) end as body")
    groups = D.similar_texts(docs, "project_id", F.col("body")).collect()
    assert [(r.group_1, r.copies_1, r.copies_2, r.similarity_score) for r in groups] == [("P0", 2000, 2000, 1.0)]
    assert D.duplicate_risk(docs, text=F.col("body")).where("duplicate_anomaly").count() == 2000


def test_few_or_empty_texts(spark):
    four = spark.createDataFrame([(f"P{i}", "same text") for i in range(4)], "project_id string, body string")
    assert D.duplicate_pairs(four, text=F.col("body")).count() == 0
    rows = D.duplicate_risk(four, text=F.col("body")).collect()
    assert len(rows) == 4 and not any(r.duplicate_anomaly or r.duplicate_match_score for r in rows)
    blank = spark.createDataFrame([(f"P{i}", "a the") for i in range(9)], "project_id string, body string")
    assert D.duplicate_pairs(blank, text=F.col("body")).count() == 0
    assert D.duplicate_risk(blank, text=F.col("body")).where("duplicate_anomaly").count() == 0


def test_pair_names(spark, make_projects):
    rows = [dict(project_name=n, project_type="road") for n in ("alpha one", "alpha one", "beta", "gamma", "delta")]
    got = D.duplicate_pairs(make_projects(*rows), name="project_name").collect()
    assert [(r.project_id_1, r.project_name_1, r.project_id_2, r.project_name_2, r.similarity_score) for r in got] == [
        ("P0", "alpha one", "P1", "alpha one", 1.0)]


@pytest.mark.parametrize("rows_per_task", [20_000, 2])
def test_rare_words_shared_by_chance_make_no_candidates(spark, rows_per_task):
    rng = random.Random(11)
    texts = {i: " ".join(f"w{int(rng.paretovariate(0.35)) % 3000}" for _ in range(60)) for i in range(150)}
    texts |= {200 + i: texts[i] + f" w{i} end" for i in range(10)}
    docs = spark.createDataFrame(list(texts.items()), "id long, body string")
    groups = D.text_groups(D.text_members(docs, "id", F.col("body"), ()))
    counted = D.count_terms(groups)
    terms = D.tfidf_terms(counted, D.shared_terms(counted), F.lit(len(texts))).where("holders > 1").localCheckpoint()
    candidates = {tuple(r) for r in D.candidate_groups(terms, 0.55, rows_per_task).collect()}
    found = {(r.group_1, r.group_2) for r in D.similar_groups(terms, 0.55, rows_per_task).collect()}
    assert {(i, 200 + i) for i in range(10)} <= found <= candidates
    assert len(candidates) <= 2 * len(found)


# --- sites ---------------------------------------------------------------------

def haversine(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    x = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))


def some_sites():
    rng = random.Random(5)
    centres = [(12.5, 77.5), (89.9999, 10.0), (-89.9999, -170.0), (0.0, 180.0), (0.0, -180.0), (45.0, 0.0)]
    sites = [(la + rng.uniform(-0.004, 0.004), lo + rng.uniform(-0.004, 0.004)) for la, lo in centres for _ in range(25)]
    sites = [(max(-90.0, min(90.0, la)), lo) for la, lo in sites] + [(12.5, 77.5)] * 6
    return {f"P{i:03d}": s for i, s in enumerate(sites)}


@pytest.mark.parametrize("threshold", [0.3, 1.0, 0.005])
@pytest.mark.parametrize("rows_per_task", [20_000, 3])
def test_geo_pairs_equal_brute_force(spark, make_projects, threshold, rows_per_task):
    sites = some_sites()
    projects = make_projects(*[dict(project_id=p, latitude=s[0], longitude=s[1]) for p, s in sites.items()],
                             dict(project_id="none"), dict(project_id="half", latitude=12.5))
    want = {(a, b): round(haversine(sites[a], sites[b]), 3) for a, b in itertools.combinations(sorted(sites), 2)
            if haversine(sites[a], sites[b]) <= threshold}
    rows = G.geo_pairs(projects, threshold, rows_per_task=rows_per_task).collect()
    assert len(rows) == len(want)
    got = {(r.project_id_1, r.project_id_2): r.distance_km for r in rows}
    assert got == pytest.approx(want, abs=1.1e-3) and set(got) == set(want)


def test_a_site_visits_the_cells_in_reach_only(spark):
    rng = random.Random(8)
    at = [(rng.uniform(10, 11), rng.uniform(70, 71)) for _ in range(2000)]
    steps = forward_steps(F.col("latitude"), F.col("longitude"), 0.3)
    rows = spark.createDataFrame(at, "latitude double, longitude double").select(F.size(steps).alias("n"))
    assert rows.agg(F.avg("n")).first()[0] < 6                                  # all around: 14


def test_geo_risk(make_projects):
    spot = [dict(latitude=10.0, longitude=20.0)] * 3
    rows = [*spot, dict(latitude=10.0 + 0.15 / 111.19492664, longitude=20.0), dict(latitude=50.0, longitude=20.0), {}]
    got = {r.project_id: r for r in G.geo_risk(make_projects(*rows)).collect()}
    assert (got["P0"].geo_overlap_count, got["P0"].geo_nearest_km, got["P0"].geo_risk_score) == (3, 0.0, 100.0)
    assert (got["P3"].geo_overlap_count, got["P3"].geo_nearest_km, got["P3"].geo_risk_score) == (3, 0.15, 65.0)
    assert not got["P4"].geo_anomaly and got["P4"].geo_risk_score == 0.0 and got["P4"].geo_nearest_km is None
    assert not got["P5"].geo_anomaly and got["P5"].geo_overlap_count == 0
    assert G.geo_pairs(make_projects(*spot)).count() == 0                      # fewer than five located rows


def test_a_third_of_all_projects_on_one_spot(spark):
    projects = spark.range(9000).selectExpr(
        "concat('P', id) as project_id", "'n' as project_name",
        "case when id % 3 = 0 then 1.0D else id * 0.01D % 80 end as latitude", "2.0D + id % 3 as longitude")
    top = G.geo_risk(projects).where("geo_overlap_count > 2000").agg(
        F.count("*"), F.min("geo_overlap_count"), F.max("geo_overlap_count")).first()
    assert tuple(top) == (3000, 2999, 2999)


def test_closest(make_projects):
    rows = [dict(latitude=10.0 + i * i * 1e-4, longitude=20.0) for i in range(8)]
    got = G.closest_overlaps(G.geo_pairs(make_projects(*rows)), 2).collect()
    assert [(r.project_id_1, r.project_id_2) for r in got] == [("P0", "P1"), ("P1", "P2")]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_closest_pairs_equal_the_listing(make_projects, k):
    rows = [dict(latitude=10.0 + (i % 7) * 4e-4, longitude=20.0 + (i % 3) * 3e-4, project_name=f"n{i}") for i in range(60)]
    projects = make_projects(*rows, {})
    assert G.closest_pairs(projects, k).collect() == G.closest_overlaps(G.geo_pairs(projects), k).collect()


def test_closest_pairs_of_few_projects_is_empty(make_projects):
    assert G.closest_pairs(make_projects(*[dict(latitude=1.0, longitude=2.0)] * 3)).count() == 0


def test_closest_pairs_of_a_crowded_spot_form_no_listing(spark):
    projects = spark.range(10_000).selectExpr("format_string('P%05d', id) as project_id", "'n' as project_name",
                                              "1.0D as latitude", "2.0D as longitude")
    got = G.closest_pairs(projects, 20)
    assert [(r.project_id_1, r.project_id_2) for r in got.collect()] == [("P00000", f"P{i:05d}") for i in range(1, 21)]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_most_similar_pairs_head_the_listing(spark, k):
    rows = [(f"P{i:03d}", f"hall roof {'abcdef'[i % 6] * 3} {'uvw'[i % 3] * 2} site" if i % 4 else f"road {i % 5} bridge",
             "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "project_id string, project_name string, project_type string")
    order = [F.col("similarity_score").desc(), "project_id_1", "project_id_2"]
    want = D.duplicate_pairs(docs).orderBy(*order).limit(k).collect()
    assert D.most_similar_pairs(docs, k=k).select(*want[0].asDict()).collect() == want


def test_least_table_with_pairs_is_a_parameter(spark):
    docs = spark.createDataFrame([(f"P{i}", "hall", "x", 1.0, 1.0) for i in range(3)], "project_id string, "
                                 "project_name string, project_type string, latitude double, longitude double")
    assert D.duplicate_pairs(docs).count() == 0 and D.duplicate_pairs(docs, min_rows=2).count() == 3
    assert not any(r.geo_anomaly for r in G.geo_risk(docs).collect())
    assert all(r.geo_anomaly for r in G.geo_risk(docs, min_rows=2).collect())


def test_hits_are_the_rows_of_the_risk_that_have_a_match(spark):
    texts = some_texts(80, seed=9)
    docs = spark.createDataFrame(list(texts.items()), "project_id string, body string")
    want = D.duplicate_risk(docs, text=F.col("body")).where("duplicate_anomaly")
    got = D.duplicate_hits(docs, text=F.col("body"))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert D.duplicate_hits(docs, text=F.col("body"), min_rows=81).count() == 0


def test_terms_of_one_text_do_not_move_one_by_one(spark):
    texts = some_texts(80, seed=9)
    docs = spark.createDataFrame([(k, f"{t} only{k}") for k, t in texts.items()], "id string, body string")
    groups = D.text_groups(D.text_members(docs, "id", F.col("body"), ()))
    counted = D.count_terms(groups)
    shared = D.shared_terms(counted)
    want = D.tfidf_terms(counted, shared, F.lit(80)).where("holders > 1").orderBy("group", "term_id").collect()
    got = D.shared_vectors(counted, shared, F.lit(80)).orderBy("group", "term_id").collect()
    assert [(r.group, r.term_id, r.holders) for r in got] == [(r.group, r.term_id, r.holders) for r in want]
    assert [r.weight for r in got] == pytest.approx([r.weight for r in want])
    left = {}                   # from the last term of a text to the first
    for r in reversed(sorted(got, key=lambda r: (r.group, -r.rest_with))):
        left[r.group] = left.get(r.group, 0.0) + r.weight ** 2
        assert r.rest_with == pytest.approx(math.sqrt(left[r.group]))


def test_tasks_of_a_listing_follow_its_pairs(spark):
    docs = spark.range(600).selectExpr("id as project_id", "concat('hall ward', id % 2, ' road', id % 2) as body")
    got = D.duplicate_pairs(docs, text=F.col("body"), rows_per_task=50)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == got.count() == 2 * 300 * 299 // 2
    assert max(sizes) <= 6 * 50 * 100


def test_frequent_terms_are_numbered_where_they_lie(spark, monkeypatch):
    docs = spark.createDataFrame(list(some_texts(80, seed=5).items()), "id string, body string")
    counted = D.count_terms(D.text_groups(D.text_members(docs, "id", F.col("body"), ()))).localCheckpoint()
    shared = D.shared_terms(counted)
    columns = ["group", "term", "tf", "df", "holders", "term_id"]
    alone = {"df": F.coalesce("df", "copies"), "holders": F.coalesce("holders", F.lit(1))}
    want = counted.join(shared, ["hash", "term"], "left").withColumns(alone).select(*columns)
    want = sorted(want.collect(), key=str)
    monkeypatch.setattr(D, "FREQUENT", 4)
    assert 0 < shared.where("holders > 4").count() < shared.count()
    for most in (100, 0):
        monkeypatch.setattr(D, "BROADCAST_KEYS", most)
        assert sorted(D._numbered(counted, shared).select(*columns).collect(), key=str) == want


def test_texts_with_little_in_common_leave_no_vectors(spark):
    texts = {f"P{i:03}": f"road works lot{i} bay{i} gate{i} mast{i}" for i in range(60)} | {"Q1": "blue bridge north", "Q2": "blue bridge south north"}
    docs = spark.createDataFrame(list(texts.items()), "project_id string, body string")
    _, _, terms = D._prepare(docs, "project_id", F.col("body"), (), 5, 0.55)
    assert {r["group"] for r in terms.select("group").distinct().collect()} == {"Q1", "Q2"}
    assert [r.project_id for r in D.duplicate_hits(docs, text=F.col("body")).orderBy("project_id").collect()] == ["Q1", "Q2"]
