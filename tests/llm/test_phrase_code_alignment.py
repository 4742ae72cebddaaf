"""Operators 11 to 13: edge frames and the test tables against brute force or SQL."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as PT
from hypothesis import given, settings
from hypothesis import strategies as st

from wattloom.llm import substring_dedup, token_alignment
from wattloom.llm.oracle import SQL
from wattloom.llm.perfect_hash import PerfectHash, build
from wattloom.llm.queries import QUERIES
from wattloom.llm.substring_dedup import remove_repeats
from wattloom.llm.token_alignment import Part, align_documents, aligner, pair_counts
from wattloom.llm.vector_codes import Cells, cell_width, encode, limit

PATHS = (PT.path("byte_bpe_50k.json"), PT.path("piece_bpe_32k.model"))
ODD = "one two\x00 three <|endoftext|> <s> <0x0A>\n\n four\tdon't  x  y　z é🙂 1234"
SENTENCE = " ".join(f"w{k}" for k in range(40))
EDGE = [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, SENTENCE), (5, "x " + SENTENCE[4:] + " y"), (5, SENTENCE), (None, SENTENCE), (None, None), (6, "wort " * 500), (7, ODD), (8, "▁ sign ▁"), (9, "a"), (9, "a"),
    (10, " ".join(f"w{k}" for k in range(12))), (11, "new " + " ".join(f"w{k}" for k in range(20, 33)) + " new"), (12, "wort " * 14), (0, "w39 w38"), (13, "  lead and  double "), (14, "\x1c a \x85b c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 3, "clash", 0.5) for i, t in EDGE], "doc_id bigint, text string, part int, key string, n_words double")


def repeats(rows):
    """Phrase by phrase."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - 12):
            p = tuple(w[k : k + 13])
            first[p] = min(i, first.get(p, i))
    out = []
    for (key, _), i, w in zip(rows, ids, words):
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((key, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return Counter(out)


def test_repeats_on_edge_rows(docs):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs).collect())
    assert got == repeats(EDGE)
    assert {r[2] for r in got if r[0] == 11} == {13} and {r[2] for r in got if r[0] == 12} == {14} and {r[2] for r in got if r[0] is None} == {0, 40}
    assert remove_repeats(docs.where("false")).count() == 0


def test_repeats_in_a_large_group_and_within_a_document(spark):
    """A passage that every document holds, one twice, and parts with more words than a part's codes have letters."""
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(i, f"{common} own{i} {' '.join(f'{i}x{k}' for k in range(30))} {common if i % 3 == 0 else ''}") for i in range(300)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == repeats(rows)


def test_automaton_tells_apart_phrases_of_one_hash():
    """Phrases that share their first 64 bits are told apart by the other 32."""
    part = substring_dedup.Part(pa.table({"key": pa.array([9]), "text": pa.array([SENTENCE.encode()])}))
    at = part.phrases(13)[:2]
    w, c = part.grams(at, 13, 1), (part.grams(at, 13, 2) >> np.uint64(32)).astype(np.uint32)
    made = pa.table({"w": pa.array(np.array([w[0], w[0]]).view(np.int64)), "c": pa.array(np.array([c[0] ^ np.uint32(1), c[0]]).view(np.int32)), "first": pa.array([1, 2])})
    find, coded, first = substring_dedup.automaton(part, made)
    text = "".join(coded[k] for k in part.words.tolist())
    assert [(end // 2, first[k]) for end, k in find.iter(text)] == [(12, 2)]


def test_letters_of_many_words_and_words_of_any_bytes():
    """A part's words are coded at once; words are cut at the contract's six bytes and at no other."""
    coded = substring_dedup.codes(np.arange(0, 9000, 2), 9000)
    words = np.random.default_rng(1).integers(0, 9000, 500)
    assert substring_dedup.in_letters(words, coded) == "".join(coded[k] for k in words.tolist())
    raw = b"".join(bytes([65, k, 66, k, k]) for k in range(256))
    assert substring_dedup._words(raw) == re.findall(rb"[^\x20\x09-\x0D]+", raw)


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_vector_codes"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cur.fetchall())


# ---- vector codes


def codes(rows, parts=4, rounds=4):
    """Every part against every entry; rows of (key, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    if not kept:
        return Counter()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dims, most = len(kept[0][1]), limit(len(kept[0][1]))
    x = np.array([[min(most, max(-most, int(np.floor(v * 1024)))) for v in r[1]] for r in kept], np.int64).reshape(len(kept), dims)
    cut = [dims * k // parts for k in range(parts + 1)]
    books = [x[:256, a:z].copy() for a, z in zip(cut, cut[1:])]
    for k in range(rounds + 1):
        far = [((x[:, None, a:z] - b[None]) ** 2).sum(2) for b, a, z in zip(books, cut, cut[1:])]
        near = [f.argmin(1) for f in far]
        if k < rounds:
            for b, n, a, z in zip(books, near, cut, cut[1:]):
                for e in set(n.tolist()):
                    b[e] = x[n == e, a:z].sum(0) // (n == e).sum()
    error = sum(f.min(1) for f in far)
    label = defaultdict(int)
    for r, e in zip(kept, error.tolist()):
        label[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return Counter((r[0], "".join(f"{n[k]:02x}" for n in near), int(e), label[r[2]], sha) for k, (r, e) in enumerate(zip(kept, error)))


def coded(df, **more):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in encode(df, **more).collect())


def test_codes_on_edge_rows(spark):
    rng = np.random.default_rng(4)
    far = rng.normal(size=(300, 10)).round(3)
    rows = [(k, v.tolist(), None if k % 5 == 0 else k % 3) for k, v in enumerate(far)]
    rows += [(3, None, 1), (4, [], 1), (5, [None] * 10, 1), (6, [float("nan")] * 10, 1), (7, [float("inf"), *[0.0] * 9], 1), (8, [1.0] * 9, 1), (None, far[0].tolist(), 1), (9, far[1].tolist(), 2), (9, far[1].tolist(), 2), (400, [1e30, *[-1e30] * 9], 7)]
    kind = "vec_id bigint, embedding array<double>, label int, part int, entry string, code string, error int"
    df = spark.createDataFrame([(*r, 1, "clash", "clash", 2) for r in rows], kind).repartition(7)
    assert coded(df) == codes(rows)
    few = rows[:20]
    assert coded(df.where("vec_id < 20 and size(embedding) = 10").limit(0)) == Counter()
    assert coded(spark.createDataFrame(few, kind.split(", part")[0])) == codes(few)


def test_cells_keep_every_nearest_entry():
    """A hot cell, ties, entries far away, and more cells than the memo keeps."""
    rng = np.random.default_rng(2)
    book = rng.integers(-200, 200, (64, 6))
    book[7] = book[3]
    x = np.concatenate([rng.integers(-300, 300, (3000, 6)), book, np.repeat(book[:1], 500, 0), rng.integers(-(10**6), 10**6, (50, 6))])
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    cells = Cells(book)
    for _ in range(2):
        entry, gap = cells.nearest(x)
        assert (entry == far.argmin(1)).all() and (gap == far.min(1)).all()
    assert cell_width(book) > 1 and 0 < len(cells.memo) < len(x)
    assert np.mean([len(v) for v in cells.memo.values()]) < len(book) / 2


# ---- alignment


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=30, deadline=None)
def test_perfect_hash(keys, others):
    k = np.array(sorted(keys), np.uint64)
    h = PerfectHash(build(k))
    at = h.index(k)
    assert len(h) == len(k) and sorted(at.tolist()) == list(range(len(k)))
    stored = np.empty_like(k)
    stored[at] = k
    assert (h.verified(np.array([x for x in others if x not in keys], np.uint64), stored) == -1).all()


def aligned(text):
    """(a, b, groups, links) from whole texts, by the libraries alone."""
    own = aligner(*PATHS)
    if not text:
        return [], [], [], []
    raw, a, b = (" " + text).encode(), own.a.whole.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    spelled = own.a.whole.id_to_token
    inverse = {c: k for k, c in _letters().items()}
    bytes_a = [bytes(inverse[c] for c in spelled(x)) for x in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(own.b.id_to_piece, b)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    end_a, end_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
    links = [(x, y) for x, e, m in zip(a, end_a, bytes_a) for y, f, n in zip(b, end_b, bytes_b) if max(e - len(m), f - len(n)) < min(e, f)]
    groups, i, j = [], 0, 0
    for end in sorted(set(end_a) & set(end_b)):
        u, v = end_a.index(end) + 1, end_b.index(end) + 1
        groups.append((a[i:u], b[j:v]))
        i, j = u, v
    return a, b, groups, links


def _letters():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {k: chr(k) if k in plain else chr(next(rest)) for k in range(256)}


def alignment(rows):
    found = [(k, aligned(t)) for k, t in rows]
    count = Counter(x for _, f in found for x in f[3])
    high = defaultdict(int)
    for (_, b), n in count.items():
        high[b] = max(high[b], n)
    said = lambda g: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
    return Counter((k, len(a), len(b), len(g), len(x), sum(count[y] == high[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(said(g).encode()).hexdigest() if a else "") for k, (a, b, g, x) in found), count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_on_edge_rows(docs):
    rows = [r for r in EDGE if r[0] != 6] + [(6, "wort " * 500)]
    want, count = alignment(rows)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in align_documents(docs, paths=PATHS).collect()) == want
    assert {((r["a"], r["b"])): r["links"] for r in pair_counts(docs, paths=PATHS).collect()} == dict(count)
    assert {r[1:] for r in want if r[0] in (1, 2, 8)} == {(0, 0, 0, 0, 0, 0, "")}
    assert align_documents(docs.where("false"), paths=PATHS).count() == 0


def test_alignment_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1500]
    df = spark.createDataFrame(short, "doc_id bigint, text string")
    assert Counter(tuple(r[c] for c in COLUMNS) for r in align_documents(df, paths=PATHS).collect()) == alignment(short)[0]
    assert QUERIES["op13_token_alignment"](spark, sf).select(*COLUMNS).distinct().count() == len(rows)


def test_alignment_reads_and_encodes_texts_once(spark, sf, monkeypatch):
    """The second pass takes a part's runs and links as the first stored them."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    assert not [f for f in align_documents(df, paths=PATHS).inputFiles() if "documents.parquet" in f]

    rows = [(1, None), (2, "▁"), (3, "plain words, and 12 more words"), (4, " a  b\n\nc "), (5, "words\nand don't"), (6, "")]
    table = pa.table({"part": pa.array([9] * 6, pa.int32()), "key": [k for k, _ in rows], "text": pa.array([t and t.encode() for _, t in rows], pa.binary())})
    for some in (table, table.slice(0, 2)):  # the second has no pair at all
        found = token_alignment._first(PATHS, 4)(some)
        held, asked = found.slice(found.num_rows - 1), found.slice(0, found.num_rows - 1)
        own = alignment(rows[: some.num_rows])
        high = defaultdict(int)
        for (_, b), n in own[1].items():
            high[b] = max(high[b], n)
        flags = [bytes(int(n == high[int(k) & (2**32 - 1)]) for k, n in zip(np.frombuffer(x, "<u8"), np.frombuffer(y, "<i8"))) for x, y in zip(asked["keys"].to_pylist(), asked["counts"].to_pylist())]
        answers = pa.table({"part": asked["part"], "keys": asked["keys"], "totals": asked["counts"], "best": pa.array(flags, pa.binary())})
        with monkeypatch.context() as m:
            m.setattr(token_alignment, "aligner", None)
            got = token_alignment._measured(held, answers)
        assert Counter(tuple(r.values()) for r in got.to_pylist()) == own[0]
    with pytest.raises(ValueError):
        token_alignment._measured(found.slice(found.num_rows - 1), pa.table({"keys": [b"\0" * 8], "totals": [b"\0" * 8], "best": [b"\0"]}))


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Word", "don't", "'s", "é", "é", "12", "<|endoftext|>", "<s>", "<0x41>", " ", "　", " ", "\x1c", "\x85", "​", "🙂", "中文", "!?", "a.b", "x\ny", "1", "\x00", "ﬁ", "_"]), max_size=24).map("".join))
@settings(max_examples=80, deadline=None)
def test_pieces_add_up_to_the_whole_text(text):
    """Tokens of the pieces, one after another, are the tokens of the whole text."""
    part = Part(pa.table({"key": pa.array([1]), "text": pa.array([text.encode()])}), PATHS)
    a, b, groups, links = aligned(text)
    runs, doc = part.runs, part.docs[0].tolist()
    assert [int(runs.counts[doc, k].sum()) for k in range(3)] == [len(a), len(b), len(groups)]
    assert [(int(x) >> 32, int(x) & (2**32 - 1)) for k in doc for x in runs.links[runs.ends[k] : runs.ends[k + 1]]] == links
    assert "".join(runs.said[k] for k in doc)[:-1] == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
