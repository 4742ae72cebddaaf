"""URL filter, embedding near-duplicates and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattloom.llm import embed_dedup
from wattloom.llm.common import components
from wattloom.llm.mixing import targets_by_weight
from wattloom.llm.queries import QUERIES, URL_RULES, WEIGHTS
from wattloom.llm.url_filter import host_of, judge, listed, matched, mine, path_of, tokens


def brute_rule(host, path):
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en/1", "http://a.example.com/EN/1", "http://com", "http://x.net/es/?a=1", "http://x.net?/es/", "http://È.Com/", "a://b://c/d", "http://x.org/de/7#t", "http://x.org/de/7#t"]


def test_urls(spark, sf):
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    got = judge(d, "url", URL_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r["host"], r["path"]) == split_url(r["url"])
        want = brute_rule(r["host"], r["path"])
        assert r["rule"] == (want[0] if want else None) and r["verdict"] in ("allow", "block")
        if want:
            assert r["verdict"] == want[1]
    assert judge(d.where("false"), "url", URL_RULES).count() == 0
    for r in QUERIES["op5_url_filter"](spark, sf).collect():
        want = brute_rule(r["host"], r["path"])
        assert r["rule"] == (want[0] if want else None)


def test_mined_rules(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a", "c"], "allow")] * 9 + [(["b", "c"], "allow")] + [([], "allow")]
    d = spark.createDataFrame(rows, "t array<string>, y string")
    rules = mine(d, "t", "y", support=0.05, confidence=0.85)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    assert got[("b",), "block"] == pytest.approx(8 / 9) and got[("c",), "allow"] == 1.0 and got[("a", "b"), "block"] == 1.0
    assert ("a", "c") not in {k for k, _ in got}  # c alone is as sure
    m = {tuple(r["t"]): r["mined"]["verdict"] if r["mined"] else None for r in matched(spark.createDataFrame([(["a", "b"],), (["x"],), (["b", "c"],)], "t array<string>"), "t", rules).collect()}
    assert m == {("a", "b"): "block", ("x",): None, ("b", "c"): "allow"}


def test_long_path_that_many_urls_repeat(spark):
    long = "http://a.net/es/" + "/".join("w" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(40))
    rows = [(k, long) for k in range(60)] + [(100 + k, f"http://b{k}.com/x") for k in range(60)] + [(900, "http://c.org/wab/q"), (901, "http://c.org/q")]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id int, url string"), "url", URL_RULES).collect()}
    assert len(got) == len(rows) and got[0]["verdict"] == "block" and got[100]["verdict"] == "allow"
    assert got[900]["verdict"] == "block" and got[900]["mined"]["confidence"] == 1.0 and got[901]["verdict"] == "allow" and got[901]["mined"] is None


def test_query_urls_and_verdicts(spark, sf):
    """Host, path and rule of each URL of the table, and the verdicts of the others by brute force over the rules."""
    url = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_url_filter"](spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(url)
    d = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = {r["page_id"]: r for r in d.select("page_id", tokens(F.coalesce("url", F.lit("")), host, path).alias("t"), listed(host, path, URL_RULES).alias("l")).collect()}
    labelled = spark.createDataFrame([(r["t"], r["l"]["verdict"]) for r in own.values() if r["l"]], "t array<string>, y string")
    rules = mine(labelled, "t", "y").collect()
    for r in got:
        assert (r["host"], r["path"]) == split_url(url[r["page_id"]])
        if r["rule"] is None:
            fit = [x for x in rules if all(set(m) & set(own[r["page_id"]]["t"]) for m in x["members"])]
            best = max(fit, key=lambda x: (x["confidence"], x["support"], -x["rule_id"]), default=None)
            assert r["verdict"] == (best["verdict"] if best else "allow")


def brute_links(ids, vecs, t=0.9):
    out = {}
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vecs]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(vecs, ok)]
    n = len(ids)
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]) and unit[i] @ unit[j] >= t] for i in range(n)]
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[ids[i]] = (len(near[i]), min(ids[j] for j in seen))
    return out


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 40)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    vecs = [(centres[i % 12] + rng.normal(size=24) * (0.02 + 0.5 * (i % 7) / 7)).astype(np.float32).tolist() for i in range(300)]
    vecs += [vecs[0]] * 3 + [None, [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [], (np.array(vecs[1]) * 5).tolist()]
    ids = rng.permutation(len(vecs)).tolist()
    d = spark.createDataFrame([(int(i), v, 0) for i, v in zip(ids, vecs)], "vec_id bigint, embedding array<float>, n int")
    got = embed_dedup.near_duplicates(d).collect()
    want = brute_links(ids, vecs)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.near_duplicates(d.where("false")).count() == 0


def test_one_id_on_two_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (9, [-1.0, 0.0]), (None, [0.0, -1.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    want = [(2, 1, 2), (3, 1, 3), (5, 1, 2), (5, 1, 3), (9, 0, 9), (None, 0, None)]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)


def test_vectors_of_any_finite_size(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e200, 1e190]), (3, [2.0, 0.0]), (4, [0.0, 1e-300]), (5, [0.0, 3.0]), (6, [1e308, -1e308])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for threshold in (0.9, 1.0):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(d, threshold=threshold).collect()}
        assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.count())
        if name == "near duplicates":
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert len(set(ids)) == len(ids)
    assert seen[0] > seen[1] > seen[2] == seen[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    r = pieces.agg(F.sum("length").alias("n"), F.max("sequence_id").alias("s")).first()
    assert (r["n"] - 1) // 2048 == r["s"]


EDGES = [
    (None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
    (2, "word " * 30000, "en", "a", 150000), *[(None, f"null id number {k} and some words of it", None, None, 40) for k in range(12)],
    *[(7, f"one id number {k} and some words of it", "de", "b", 39) for k in range(12)], (8, "password = hunter2hunter2 in a text", "en", "b", 34), (9, "É <|endoftext|> 漢字", "zz", "c", 17),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_empty_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, uses int, spans string, row bigint"
    docs = spark.createDataFrame([(*r, 5, 6, "clash", 1) for r in EDGES], kind)
    got = stage(spark, docs, sf)
    rows = [tuple(r) for r in got.collect()]
    if name != "packing":
        assert got.columns == corpus_pipeline.COLUMNS
    assert stage(spark, docs.where("false"), sf).count() == 0
    if name == "quality classifier":
        assert set(rows) <= set(EDGES)
    elif name == "near duplicates":  # one of the four texts without words, one of all that are near copies
        assert len({r[1] for r in rows}) == len(rows) and sum(not r[1] for r in rows) == 1
    elif name == "secret scan":
        assert len(rows) == len(EDGES) and all("hunter2" not in (r[1] or "") for r in rows)
        assert sorted(repr(r) for r in rows if r[0] != 8) == sorted(repr(r) for r in EDGES if r[0] != 8)
    elif name == "mixing":
        n = {r: rows.count(r) for r in set(rows)}
        assert set(n) <= set(EDGES) and all(n[r] <= 3 * EDGES.count(r) for r in n)
        words = lambda r: len((r[1] or "").split())
        sizes = {s: sum(words(r) for r in EDGES if r[3] == s) for s in ("a", "b", "c", None)}
        want = targets_by_weight(sizes, WEIGHTS)
        for s in ("b", "c", None):
            assert abs(sum(words(r) for r in rows if r[3] == s) - want[s]) <= 10
    else:
        ids = [(r[0], r[4]) for r in rows if r[1] == 0]
        assert len(ids) == len(EDGES) and sorted(str(i) for i, _ in ids) == sorted(str(r[0]) for r in EDGES)
        assert sum(r[2] for r in rows) == sum(n for _, n in ids)
