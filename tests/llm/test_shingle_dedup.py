"""Near-duplicates by shingle similarity, and the pipeline's stage on them, against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from wattloom.llm import shingle_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """The least place that each place is joined with over links at a similarity of 0.8."""
    s = [shingles(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] == s[j] or len(s[i] & s[j]) * 100 >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))]


def planted(seed=3):
    """Texts with near copies at many distances, chains, a line that most have, copies, short and empty ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(12)]
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for k in range(25):
        base = [word() for _ in range(rnd.randint(5, 160))] + (line if k % 2 else [])
        texts.append(" ".join(base))
        for _ in range(6):
            if rnd.random() < 0.3:
                base = base[:]  # a chain: the next copy is one of this one
            copy = base[:]
            for _ in range(rnd.randint(0, 1 + len(base) // 30)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rnd.random() < 0.3:
                base = copy
    group = [word() for _ in range(120)]
    for _ in range(60):
        copy = group[:]
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    return texts + texts[6:9]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    texts = planted()
    want = brute(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    for block in (shingle_dedup.BLOCK, 7):
        monkeypatch.setattr(shingle_dedup, "BLOCK", block)
        got = {r["row"]: r["root"] for r in shingle_dedup.near_copies(d, "text", "row").collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert 30 < len(set(want)) < len(texts) - 60
    assert shingle_dedup.near_copies(d.where("false"), "text", "row").count() == 0


def test_stage_drops_edited_copies(spark, sf):
    texts = planted(4)
    want = brute(texts)
    d = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    d = d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, sf).collect())
    assert got == sorted(1000 + k for k in set(want))


def test_stage_keeps_one_row_of_each_component(spark, sf):
    """A third of the rows share an id, others have none; ids repeat over components."""
    texts = planted(5)
    want = brute(texts)
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, t) for k, t in enumerate(texts)] + [(7, texts[6])] * 20 + [(None, texts[10])] * 20
    root = want + [want[6]] * 20 + [want[10]] * 20
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    d = d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, d, sf).collect()]
    assert len(got) == len(set(root))
    of = {(t or "").lower(): r for (_, t), r in zip(rows, root)}
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, 1 << 62), 1 << 62 if i is None else i)
    assert {of[(t or "").lower()]: 1 << 62 if i is None else i for i, t in got} == least
