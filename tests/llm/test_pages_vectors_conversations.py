"""HTML extraction, whitening and the conversation trie against brute force, with the awkward cases."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.llm import html_text, queries, trie, whitening

# ---------------------------------------------------------------- HTML extraction

LONG = "A paragraph with enough words to be the text of an article and not a label"
PAGES = [
    (None, ""),
    ("", ""),
    (" \n\t ", ""),
    ("no markup &amp; no lines", "no markup & no lines"),
    ("<script>var a='<p>x</p>'</script><style>p{}</style>", ""),
    ("<nav><a href=/>Home</a></nav><footer>&copy; x</footer>", ""),
    (f"<header><a href=/>Logo</a></header><div class='cookie-notice'>{LONG}</div><div id=content><h1>Head &lt;1&gt;</h1>"
     f"<p>{LONG}\n  with\tspace<br>and a <a href=x>link</a>.</p><p>Short.</p><ul><li>one<li>two</ul><p>{LONG} &#8211; end</p></div>"
     f"<div id='reader-comments'><p>{LONG} {LONG}</p></div><aside>{LONG}</aside><form>Name <input> <p>{LONG}</form><footer>x</footer>",
     f"Head <1>\n{LONG} with space and a link.\nShort.\none\ntwo\n{LONG} – end"),
    (f"<body><div class=ad>{LONG}</div><article><h1>T</h1><p><b>{LONG}<br><p>x</article><footer>{LONG}", f"T\n{LONG}\nx"),
    (f"<main><article><header><h1>T</h1></header><p>{LONG}</p><section class='comments'><article class='comment'>{LONG}</article>"
     f"</section></article></main><div class=side-bar>{LONG}</div>", f"T\n{LONG}"),
    (f"<body><div><a href=1>Start page</a> <a href=2>About us</a></div><h1>Head</h1><p>{LONG}</p><p>tiny</p><p>{LONG}</p>"
     f"<div>Imprint <a href=3>and many words inside of a long link</a></div>", f"Head\n{LONG}\ntiny\n{LONG}"),
    (f"<![if x]><p>{LONG}</p><![endif]></div></span><!-- <p>no</p> --><p>unclosed <i>it", f"{LONG}\nunclosed it"),
    (f"<p>{LONG}</p>" * 3000, "\n".join([LONG] * 3000)),
    ("<div>" * 3000 + LONG, LONG),
    (f"<article><p>{'word ' * 100_000}</p></article>", ("word " * 100_000).strip()),
    (f"<article><p>{LONG}<span class='ad'>buy <span>this</span> now</span> on</p></article>", f"{LONG}\non"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"u{i}", h, "t", 7) for i, (h, _) in enumerate(PAGES)] + [(6, "u6", PAGES[6][0], "t", 7), (None, None, "<p>x", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")


def test_pages_of_many_forms(pages):
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()),
                 key=lambda x: (x[0] is None, x[0] or 0))
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)]
    want = want[:7] + [want[6]] + want[7:] + [(None, None, "x", 1)]
    for g, w in zip(got, want, strict=True):
        assert g == w
    assert html_text.extract(pages.limit(0)).collect() == []


def test_pages_of_the_tables(spark):
    """Articles cut out by their tags and split at block tags give the same texts."""
    folder = "/root/testdata/sf0.01"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.op11_html_extraction(spark, folder).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search("<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(x for x in blocks if x)


def test_ratios_and_clusters():
    assert html_text.cluster_threshold(np.array([1.0, 2, 1, 30, 31, 2])) == 30
    assert html_text.cluster_threshold(np.array([5.0])) == 5
    parser = html_text.PageLines()
    parser.feed(f"<nav>{LONG}</nav><p>{LONG}</p><p>{LONG}</p>")
    lines = parser.finish()
    smooth = html_text.smoothed_ratios(lines)
    assert len(lines) == 3 and 0 < smooth[0] < min(smooth[1:])


# ---------------------------------------------------------------- whitening

def whitened_by_hand(rows):
    keep = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in keep]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[sum((n * r[a] - s[a]) * (n * r[b] - s[b]) for r in x) / n ** 3 for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(cov)
    deviation = {i: sum((n * v - t) ** 2 for v, t in zip(r, s)) for (i, _), r in zip(keep, x)}
    z = (np.array(x) - np.array([t // n for t in s]) - np.array([t % n / n for t in s])) @ u[:, ::-1] / np.sqrt(e[::-1])
    return keep, n, deviation, z, e[::-1] / e.sum()


def vector_rows(n=300, d=9):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32).astype(float)
    v[:, 0] += 5000                      # far from zero
    v[:, 1] *= 300                       # more bits than the others
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    rows += [(1000 + i, rows[5][1]) for i in range(100)]
    return rows


def test_whitening_by_hand(spark):
    good = vector_rows()
    bad = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 7), (2003, [float("nan")] * 9), (2004, [float("inf")] + [0.0] * 8),
           (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad], "vec_id long, embedding array<float>, n int, whitened double")
    got = whitening.whiten(df.repartition(3), components=32).collect()
    keep, n, deviation, z, share = whitened_by_hand([(i, [float(np.float32(x)) for x in v]) for i, v in good])
    assert len(got) == n * 9 and {r["n"] for r in got} == {n}
    place = {i: k for k, (i, _) in enumerate(keep)}
    table = np.zeros_like(z)
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]]
        table[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        assert 0 <= r["identity_error"] < 1e-7      # rounding times the fixture's spread of variances
    table *= np.sign((table * z).sum(axis=0))
    assert np.abs(table - z).max() < 1e-7
    assert np.abs(np.cov(table.T, bias=True) - np.eye(9)).max() < 1e-7


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(5)
    for width, n in ((1, 7), (12, 200), (62, 130)):
        y = rng.integers(0, 1 << width, (n, 4), dtype=np.int64)
        width = max(int(y.max()).bit_length(), 1)
        into = np.zeros((width, -(-width // whitening.LIMB), 4, 4), np.int64)
        whitening.add_products(whitening.bit_planes(y, width), into)
        for a in range(4):
            for b in range(a, 4):
                got = sum(int(into[p, k, a, b]) << (p + whitening.LIMB * k) for p in range(width) for k in range(into.shape[1]))
                assert got == sum(int(r[a]) * int(r[b]) for r in y)
    for value in (0, 5, -7, 12345678901234567890123, -(1 << 140)):
        assert whitening._whole(dict(zip(whitening._NAMES, whitening._limbs(value)))) == value


def test_whitening_of_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    equal = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(None, [1.0, 2.0])], schema)).collect()
    assert len(equal) == 12 and all((r["whitened"], r["explained"], r["deviation"], r["identity_error"]) == (0, 0, 0, 0) for r in equal)
    few = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(4)], schema)).collect()
    assert [round(r["explained"], 9) for r in few if r["vec_id"] == 0] == [1, 0, 0] and few[0]["identity_error"] < 1e-9
    large = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 0.5])], schema)).collect()
    assert len(large) == 6 and all(r["deviation"] is None for r in large if r["vec_id"] < 3)


def test_one_large_coordinate_in_many_dimensions(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 96))
    v[:, 3] = 1e6 + rng.normal(size=200)
    got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"))
    assert got.count() == 200 * 32 and got.first()["identity_error"] < 1e-4


# ---------------------------------------------------------------- conversation trie

def trie_by_hand(turns, heads=True):
    """Nodes from the list of all prefixes, subtree by subtree."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, mark, role, text))
    seq = {k: [x[3:] for x in sorted(v)] for k, v in own.items()}
    if heads:
        built = {}
        for k, v in seq.items():
            h = zlib.crc32(str(k).encode()) % 9
            base = k - int(math.fmod(k, 5))
            built[k] = tuple(seq.get(base, [])[:h] + v[h:])
    else:
        built = {k: tuple(v) for k, v in seq.items()}
    members = defaultdict(list)
    for k, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(k)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, who in members.items():
        subtree, todo = [], [p]
        while todo:
            subtree.append(todo.pop())
            todo += children[subtree[-1]]
        ends = ",".join(map(str, sorted(k for k in who if len(built[k]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]),
                    sum(not children[q] for q in subtree),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in subtree if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, shard int, depth string"


def conversations():
    rng = random.Random(9)
    texts = ["", None, "é", "hello", "long text " * 50, "a:b", "1"]
    rows = []
    for conv in [*range(-12, 300), 10_007, 10_005, 2 ** 40, 2 ** 40 + 1, -2 ** 50]:
        if conv % 7 == 3:
            continue
        for t in range(rng.randint(1, 12)):
            rows.append((conv, t if t or conv % 3 else None, rng.choice(["user", "assistant", None, ""]),
                         texts[0] if t < 2 else rng.choice(texts)))
    rows += [(50, 3, "user", "tie"), (50, 3, "user", "tie"), (50, 3, "bot", "tie")]
    rows += [(20 + 5 * i, t, "user", f"same {t}") for i in range(40) for t in range(100, 103)]
    rows += [(None, 0, "user", "nobody")]
    return rows


@pytest.mark.parametrize("heads", [True, False])
def test_trie_by_hand(spark, heads):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)
    got = trie.prefix_trie((trie.with_shared_heads if heads else trie.plain)(df), block_bits=2)   # several blocks each
    assert got.columns == TRIE
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_hand(rows, heads)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(7, t, "user", f"t{t % 11}") for t in range(1500)]
    rows += [(c, t, "user", f"t{t % 11}") for c in range(1000, 1700) for t in range(3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    got = sorted((tuple(r) for r in trie.prefix_trie(trie.plain(df)).collect()), key=str)
    # The long chain has 1,501 nodes; ``trie_by_hand`` walks each one's subtree, so only ends and the first nodes are compared.
    by_depth = {r[1]: r for r in got}
    assert len(got) == len(by_depth) == 1501
    assert by_depth[0][:5] == (7, 0, None, 701, 1) and by_depth[0][6] == 700 * 6 and by_depth[3][6] == 700 * 2
    assert by_depth[4][3] == 1 and by_depth[1500][4] == 0 and by_depth[0][5] == 1
    ends = ",".join(map(str, range(1000, 1700)))
    assert by_depth[3][7] == hashlib.sha256(ends.encode()).hexdigest()
    assert by_depth[1500][7] == hashlib.sha256(b"7").hexdigest()


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.with_shared_heads(empty)).collect() == []
    only_null = spark.createDataFrame([(None, 1, "a", "b", 1, "x")], TURNS)
    assert trie.prefix_trie(trie.plain(only_null)).collect() == []
    one = trie.prefix_trie(trie.plain(spark.createDataFrame([(3, None, None, None, 1, "x")], TURNS))).collect()
    assert sorted((r["depth"], r["n_children"], r["n_leaves"]) for r in one) == [(0, 1, 1), (1, 0, 1)]
