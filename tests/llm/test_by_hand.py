"""Operators without SQL against plain Python."""

import base64
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus_operators import components, scan_by_hand
from worksight.llm import minhash, quality, sharding, statistics, token_counts, token_files, toxicity


def words(rng, n):
    return ["".join(rng.choice(["an", "er", "ou", "st", "li", "mo"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]


# Near-duplicates: the last round.

def template_rows(n, seed=1):
    """Texts of one template; what is not shared by all is partly shared by two."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    body, rows = [word() for _ in range(60)], []
    for i in range(0, n, 2):
        both = [word() for _ in range(rng.randint(4, 12))]
        for j in (0, 1):
            rows.append((i + j, " ".join(body[:30] + both + [word() for _ in range(rng.randint(1, 9))] + body[30:])))
    return rows


def sets_of(rows, k):
    return {i: {tuple(t.split()[x:x + k]) for x in range(len(t.split()) - k + 1)} for i, t in rows}


@pytest.mark.parametrize("rows_per_task", [3, 2_000])
def test_rare_pairs_miss_nothing(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(minhash, "PAIRED_ROWS_PER_TASK", rows_per_task)
    rows = template_rows(120)
    sets = sets_of(rows, 4)
    texts = spark.createDataFrame(rows, "cls long, text string")
    rest = spark.createDataFrame([(i, i % 50, len(s)) for i, s in sets.items()], "cls long, label long, size long")
    found = [(r["a"], r["b"]) for r in minhash.rare_pairs(rest, texts, 4, 80).collect()]
    similar = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if a % 50 != b % 50
               and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar and similar <= set(found) and len(found) == len(set(found))
    assert all(a < b and a % 50 != b % 50 for a, b in found)


def test_a_template_forms_no_pairs(spark):
    """Texts that share 60 % with thousands of others and more with nobody."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    body, rows = [word() for _ in range(75)], []
    for i in range(0, 1000, 2):
        both = [word() for _ in range(12)]
        rows += [(i + j, " ".join(body[:40] + both + [word() for _ in range(12)] + body[40:])) for j in (0, 1)]
    texts = spark.createDataFrame(rows, "cls long, text string")
    rest = texts.select("cls", F.col("cls").alias("label"), F.lit(len(rows[0][1].split()) - 3).cast("long").alias("size"))
    assert minhash.rare_pairs(rest, texts, 4, 80).count() == 0


def test_near_duplicates_of_a_template(spark):
    rows = template_rows(160, seed=5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(components(rows, 4, 80))


# Sharding.

def test_sharding_with_many_ranges(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x" * 60)).otherwise(
        F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 5 + 1).cast("int"))).alias("text"))
    few, many = (sharding.shard(df, 4, carry=["doc_id"], cells_per_shard=8, cell_size=size).collect() for size in (1 << 28, 2000))
    for got, even in ((few, 1.4), (many, 1.05)):          # a range is the grain of the shards
        assert sorted(r["doc_id"] for r in got) == list(range(5000))
        loads, slots = Counter(), {}
        for r in got:
            loads[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert max(loads.values()) < even * min(loads.values())
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


# Toxicity: the likeliest way through the lattice by trying all, and the score of the restored text.

def likeliest(token, logp):
    """Letters of the best of all choices of a letter or of none for each sign."""
    head, tail = len(token) - len(token.lstrip("!")), len(token.rstrip("!"))
    ways = []
    for x in token:
        letters = [(x, 0.0)] if "a" <= x <= "z" or ord(x) > 127 else [(y, toxicity.COST_LEET) for y in toxicity.LEET.get(x, "")]
        ways.append([None, *letters])
    best = (-math.inf, "")
    for choice in itertools.product(*ways):
        total, a, b, before, out = 0.0, 0, 0, "", ""
        for i, (sign, taken) in enumerate(zip(token, choice, strict=True)):
            edge = not head <= i < tail
            if taken is None:
                if sign != before and "a" <= sign <= "z":
                    break
                if edge or sign != before:
                    total -= toxicity.COST_SEPARATOR if edge or sign in toxicity.SEPARATORS else toxicity.COST_DROP
                else:
                    run = any(token[j:j + 3] == sign * 3 for j in range(max(i - 2, 0), i + 1))
                    total -= toxicity.COST_RUN if run else toxicity.COST_DOUBLE
                before = before if sign in toxicity.SEPARATORS else sign
            else:
                letter, cost = taken
                k = 27 if ord(letter) > 127 else ord(letter) - 96
                total += logp[a][b][k] - cost
                a, b, before, out = b, k, sign, out + letter
        else:
            total += logp[a][b][0]
            best = max(best, (total, out))
    return best[1]


def test_decoding_by_trying_all_ways():
    rng = random.Random(7)
    counts = np.random.default_rng(7).integers(0, 400, (28, 28, 28)).astype(float)
    channel = toxicity.Channel(counts)
    alphabet = "aabbst1!|0@$.-é"
    tokens = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["aaa", "tttt1!!", "!!a!!", "s.s.s", "b--b"]
    for token in tokens:
        assert channel.decode(token) == likeliest(token, channel.logp), token


def test_score_of_restored_text(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        text = words(rng, 30)
        if i % 4 == 0:
            text[i % 30] = rng.choice(["grumblefoot", "snarkwort", "gr.u.mb.le.foot", "sn4rkw0rt", "s n a r k w o r t"])
        rows.append((i, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, "Grumblefoot! " * 3000), (1003, rows[0][1]), (1004, "étranger sn4rkw0rt")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.lit(True))
    weight, channel = dict(zip(model.wanted.tolist(), model.weights, strict=True)), toxicity.Channel(model.counts)

    def hashes(word):
        data = np.frombuffer(word, np.uint8)
        _, h, n = toxicity.features(data, np.array([0, len(data)]))
        return Counter(dict(zip(h.tolist(), n.tolist(), strict=True)))

    def by_hand(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        restored = toxicity.restore(data, np.array([0, len(data)]), channel)[0].tobytes().lower()
        total = Counter()
        for word, n in Counter(re.findall(rb"[a-z\x80-\xff]+", restored)).items():
            total.update({h: n * m for h, m in hashes(word).items()})
        x = model.intercept + sum(weight[h] * math.log1p(n) for h, n in total.items() if h in weight)
        return 1 / (1 + math.exp(-x))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(weight) > 3 and set(got) == {i for i, _ in rows} and got[1000] == got[1001] and got[1003] == got[0]
    for i, text in rows:
        assert got[i] == pytest.approx(by_hand(text), abs=1e-9), i


# Token counts.

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_hand(spark, rule):
    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("by_hand", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", "\n", "a\n\n\nb  \n c", "é\n日本語 line\r\n\tx", "same\nrow", "same\nrow", " ".join(words(rng, 20_000)) + "\nend"]
    texts += ["\n".join(" ".join(words(rng, rng.randint(0, 6))) for _ in range(rng.randint(1, 9))) + "\n" * rng.randint(0, 4) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(df, path, pattern, rule=rule).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, at, sections = text or "", 0, []
        for line in text.split("\n"):
            sections.append((at, at + len(line.encode())))
            at += len(line.encode()) + 1
        counts, crossing, outside, start = [0] * len(sections), 0, 0, 0
        tokens = encoding.encode_ordinary(text)
        for token in tokens:
            stop = start + len(encoding.decode_single_token_bytes(token))
            touched = [(min(stop, b) - max(start, a), s) for s, (a, b) in enumerate(sections) if min(stop, b) > max(start, a)]
            crossing += len(touched) > 1
            if not touched:
                outside += 1
            elif rule == "first":
                counts[touched[0][1]] += 1
            elif rule == "last":
                counts[touched[-1][1]] += 1
            else:
                counts[max(touched, key=lambda x: (x[0], -x[1]))[1]] += 1
            start = stop
        r = got[i]
        assert (r["n_tokens"], r["n_sections"], r["n_crossing"], r["n_outside"]) == (len(tokens), len(sections), crossing, outside), i
        assert r["section_tokens"] == counts, i


# Quality.

def test_rules_row_by_row(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40)) if i % 3 else "BUY!!! " * rng.randint(3, 30) + str(i)) for i in range(240)]
    rows += [(500, None), (501, ""), (502, rows[1][1]), (503, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    measured = statistics.add_statistics(df, keep=["doc_id"])
    model = quality.fit(measured.join(labels, "doc_id"), "quality")
    assert model.rules
    ops = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    for r in measured.withColumn("score", model.score()).collect():
        x = model.intercept + sum(w for rule, w in model.rules if all(ops[op](r[name], cut) for name, op, cut in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-12)
        if r["doc_id"] < 240:
            assert (r["score"] >= 0.5) == (r["doc_id"] % 3 > 0)


# The pipeline, stage by stage, each on the rows that the one before kept.

def test_pipeline_by_hand(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 14))) for i in range(5)]
    rows = []
    for i in range(200):
        text = words(rng, rng.randint(30, 60))
        if i % 5 == 0:
            for _ in range(3):
                text[rng.randrange(30)] = rng.choice(["grumblefoot", "snarkwort"])
        elif i % 7 == 0:
            text[5:5] = items[i % 5][1].split()
        elif i % 6 == 0 and rows:
            text = [*rows[-1][1].split()[:-1], "changed"]
        rows.append((i, " ".join(text), ["a", "b", None][i % 3], "kept"))
    rows += [(200, None, "a", "kept"), (201, "", "b", "kept"), (202, "one", "b", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    toxic = lambda text: not {"grumblefoot", "snarkwort"}.isdisjoint((text or "").split())
    spark.createDataFrame([(x[0], int(toxic(x[1]))) for x in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = list(map(tuple, docs.collect()))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet" if not i else f"{tmp_path}/{i - 1}"), str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        after = list(map(tuple, kept.select(*docs.columns[:3 if name == "sharding" else 4]).collect()))
        if name == "toxicity":
            want = [x for x in before if not toxic(x[1])]
        elif name == "minhash_near_dedup":
            want = [x for x, (id, _, least) in zip(before, components(before, 5, 80), strict=True) if id == least]
            assert len(want) < len(before)
        elif name == "benchmark_decontamination":
            want = [x for x, (_, _, hit, _) in zip(before, scan_by_hand(before, items, 10), strict=True) if not hit]
            assert len(want) < len(before)
        elif name == "source_mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
            size, taken = Counter(), Counter()
            for x in before:
                size[x[2]] += len((x[1] or "").split())
            for x in after:
                taken[x[2]] += len((x[1] or "").split())
            per = 1.5 * sum(size.values())
            weights, target, free = {"a": 5, "b": 2, None: 1}, {}, {"a", "b", None}
            while True:
                each = (per - sum(target.values())) / sum(weights[s] for s in free)
                over = {s for s in free if weights[s] * each > 2 * size[s]}
                if not over:
                    break
                target |= {s: 2 * size[s] for s in over}
                free -= over
            target |= {s: weights[s] * each for s in free}
            assert all(abs(taken[s] - target[s]) <= 60 for s in target)
            want = after
        else:
            want = [x[:3] for x in before]
            by_shard = {}
            for r in kept.collect():
                by_shard.setdefault(r["shard"], []).append(r["slot"])
            assert all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and set(by_shard) <= set(range(16))
        assert sorted(after, key=str) == sorted(want, key=str), name
        before = after


def test_ids_of_an_arrow_column():
    public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    model = tokenizers.Tokenizer.from_file(path)
    texts = ["  Roads, roads... and ROADS!  ", None, "", " \n\t", "it's a.b.c x'' <|endoftext|>. caf\u00e9!?", "(roads) 3.5% \x0b and\x0c", "and"]
    for kind in (pa.string(), pa.large_string()):
        got = token_files.Encoder(path)(pa.array(texts, kind))
        assert [x.tolist() for x in got] == [model.encode(t or "", add_special_tokens=False).ids for t in texts]
