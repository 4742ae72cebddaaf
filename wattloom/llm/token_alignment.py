"""Two tokenizers' tokens over the same texts, aligned by byte ranges (operator 13).

The first pass aligns the documents, counts id pairs within each part and stores what the parts' runs of text link.
Shards of the pairs, by the second tokenizer's id, then hash their distinct pairs minimally and perfectly; counts
become dense vectors that the hash indexes, which are summed in a tree.  The second pass reads the stored links and
looks its parts' pairs up, each key verified; no text is encoded twice for it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import dealt, ship, stored
from wattloom.llm.perfect_hash import PerfectHash, build

#: Leaves of the tree that sums counts; parts of the documents for each shard of the pairs.
LEAVES, PARTS_A_SHARD = 8, 2
#: Bytes of texts in a part: the larger, the fewer runs are aligned again elsewhere.
PART = 8 << 20
#: An id of the first tokenizer takes the high half of a pair's key.
HALF = np.uint64(32)

#: No token of either tokenizer spans a single space between two signs that no library takes for white space.
_border = re.compile(r"(?<=\S) (?=\S)").split
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Composed Latin letters, digits and ASCII signs but the apostrophe: both tokenizers cut between runs of one class
#: (Aligner checks that no piece of the second mixes them).
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_simple = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*").fullmatch
_runs = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n").findall
#: Where white space isn't single or is at an end; elsewhere every space is a border.
_care = re.compile(r"\s\s|\A\s|\s\Z").search


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        from wattloom.llm.tokens import _LETTER, Encoder

        self.a = Encoder(path_a)
        self.a.whole.encode_special_tokens = True
        byte_of = {c: b for b, c in _LETTER.items()}
        spelled = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.whole.get_vocab(True).items()}
        self.bytes_a = [spelled.get(k, b"") for k in range(max(spelled) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        self.by_class = True
        for k in range(self.b.get_piece_size()):
            s = self.b.id_to_piece(k)
            byte = _BYTE_PIECE.fullmatch(s)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else s.replace("▁", " ").encode())
            bare = s.lstrip("▁")
            self.by_class &= bool(byte) or self.b.is_control(k) or self.b.is_unknown(k) or not _simple(bare) or len(_runs(bare)) == 1
        self.line = len(self.b.encode("\n"))  # set before a run, it takes the space that the model adds
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        #: What a token says in a list of groups: its id and what follows it, another, the other side, or another group.
        self.said = [f"{k}{sign}" for k in range(max(len(self.bytes_a), len(self.bytes_b))) for sign in ",|;"]

    def cut(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct runs, numbers of the pieces' runs one after another, runs of each piece).  The tokens of a piece's
        runs, the first with its space, one after another are those of a space and the piece."""
        known = Numbers()
        simple = np.array([self.by_class and m is not None for m in map(_simple, pieces)], bool)
        found = _runs("".join([" " + p for p, plain in zip(pieces, simple.tolist()) if plain]))
        number = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        first = np.flatnonzero(np.array([t[0] == " " for t in known], bool)[number]) if len(number) else number
        whole = np.array([known[" " + p] for p, plain in zip(pieces, simple.tolist()) if not plain], np.int64)
        sizes = np.ones(len(pieces), np.int64)
        sizes[simple] = np.diff(first, append=len(number))
        of = np.repeat(simple, sizes)
        flat = np.empty(len(of), np.int64)
        flat[of], flat[~of] = number, whole
        return list(known), flat, sizes

    def tokens(self, runs: list[str], raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each run) of either tokenizer."""
        # a space starts a token of the first, so the runs that have one are encoded as one text
        spaced = [k for k, t in enumerate(runs) if t[0] == " "]
        whole = np.array(self.a.whole.encode_batch_fast(["".join([runs[k] for k in spaced])], add_special_tokens=False)[0].ids, np.int64)
        size = np.array(list(map(len, raws)), np.int64)
        cut = np.searchsorted(np.cumsum(self.sizes[0][whole]), np.cumsum(size[spaced]), side="right")  # tokens up to each run's end
        others = [k for k, t in enumerate(runs) if t[0] != " "]
        apart = [np.frombuffer(self.a.encode(raws[k]), "<u4") for k in others]
        n_a = np.zeros(len(runs), np.int64)
        n_a[spaced], n_a[others] = np.diff(cut, prepend=0), [len(x) for x in apart]
        a = np.empty(int(n_a.sum()), np.int64)
        has_space = np.zeros(len(runs), bool)
        has_space[spaced] = True
        of = np.repeat(has_space, n_a)
        a[of], a[~of] = whole, np.concatenate([np.zeros(0, np.int64), *apart])
        found = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in runs], num_threads=1) if runs else []
        for k in others:
            found[k] = found[k][self.line :]
        n_b = np.array(list(map(len, found)), np.int64)
        return [(a, n_a), (np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum())), n_b)]


class Aligned:
    """Distinct runs of text, aligned: for each its counts (tokens of either side, groups, links), its links one after
    another, and what its groups say.  `bad` marks runs that either tokenizer doesn't give back byte by byte."""

    def __init__(self, own: Aligner, runs: list[str]):
        raws = [t.encode("utf-8", "replace") for t in runs]
        size = np.array(list(map(len, raws)), np.int64)
        both, self.bad = own.tokens(runs, raws), np.zeros(len(runs), bool)
        for (ids, n), spelled, sizes in zip(both, (own.bytes_a, own.bytes_b), own.sizes):
            if b"".join([spelled[k] for k in ids.tolist()]) != b"".join(raws):
                cut = np.cumsum([0, *n])
                self.bad |= [b"".join([spelled[k] for k in ids[x:y].tolist()]) != raw for x, y, raw in zip(cut, cut[1:], raws)]
            self.bad |= np.bincount(np.repeat(np.arange(len(n)), n), sizes[ids], len(n)).astype(np.int64) != size
        (a, n_a), (b, n_b) = [(ids[np.repeat(~self.bad, n)], np.where(self.bad, 0, n)) for ids, n in both]
        run_a = np.repeat(np.arange(len(runs)), n_a)
        end_a, end_b = np.cumsum(own.sizes[0][a]), np.cumsum(own.sizes[1][b])
        # runs lie one after another; between two ends of either side lies the overlap of one pair of tokens
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self.links = (a[at_a] << 32 | b[at_b]).astype(np.uint64)
        n_links = np.bincount(run_a[at_a], minlength=len(runs)) if len(ends) else np.zeros(len(runs), np.int64)
        self.ends = np.append(0, np.cumsum(n_links))
        last_a, last_b = end_a[at_a] == ends, end_b[at_b] == ends  # each end is one of either side or of both
        shared_a, shared_b = (last_a & last_b)[last_a], (last_a & last_b)[last_b]
        self.counts = np.column_stack([n_a, n_b, np.bincount(run_a[shared_a], minlength=len(runs)), n_links]).astype(np.int64)
        group = np.concatenate([2 * (np.cumsum(shared_a) - shared_a), 2 * (np.cumsum(shared_b) - shared_b) + 1])
        sign = np.concatenate([np.where(shared_a, 1, 0), np.where(shared_b, 2, 0)])
        said = (3 * np.concatenate([a, b]) + sign)[np.argsort(group, kind="stable")]
        words, cut = [own.said[k] for k in said.tolist()], np.append(0, np.cumsum(n_a + n_b)).tolist()
        self.said = ["".join(words[x:y]) for x, y in zip(cut, cut[1:])]


@lru_cache(4)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and Python worker."""
    return Aligner(path_a, path_b)


class Numbers(dict):
    """A number for each new text, from 0."""

    def __missing__(self, text: str) -> int:
        self[text] = k = len(self)
        return k


def _pieces(texts: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct pieces that no token crosses the border of, and each text's pieces by number.  None of a text that
    holds the sign which reads as a space in the second's tokens."""
    docs = [np.zeros(0, np.int64)] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return [], docs
    raw = b" " + b" ".join([texts[k] for k in full])  # a piece goes with the space before it
    starts = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
    pieces, numbers = [x[1:].decode("utf-8", "replace") for x in found.dictionary.to_pylist()], found.indices.to_numpy().astype(np.int64)
    # white space that isn't single, or is at an end of the text, shows in the pieces next to it
    odd = np.array([0 if x.isalnum() else 2 if "▁" in x else 1 if not x or _care(x) else 0 for x in pieces], np.uint8)
    cuts = np.searchsorted(starts, np.cumsum([0, *[len(texts[k]) + 1 for k in full]]))
    more, own = Numbers(), len(pieces)
    for k, x, how in zip(full, np.split(numbers, cuts[1:-1]), np.maximum.reduceat(odd[numbers], cuts[:-1]).tolist()):
        if how == 1:
            docs[k] = np.array([own + more[t] for t in _border(texts[k].decode("utf-8", "replace"))], np.int64)
        elif not how:
            docs[k] = x
    pieces += more
    used = np.zeros(len(pieces), bool)
    used[np.concatenate(docs)] = True
    new = np.cumsum(used) - 1
    return [pieces[k] for k in np.flatnonzero(used).tolist()], [new[x] for x in docs]


def _spans(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the values up to each end from the one before."""
    return np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(np.uint32)))


class Part:
    """One part's documents: their distinct runs, aligned, and each document's runs by number."""

    def __init__(self, table: pa.Table, paths: tuple[str, str]):
        own = aligner(*paths)
        self.keys = table.column("key")
        pieces, docs = _pieces([t or b"" for t in table.column("text").to_pylist()])
        runs, flat, sizes = own.cut(pieces)
        self.runs = Aligned(own, runs)
        starts = np.cumsum(sizes) - sizes
        self.docs = []
        for x in docs:
            n = sizes[x]
            each = flat[np.repeat(starts[x] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            self.docs.append(each if not self.runs.bad[each].any() else each[:0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs in order, links of each; the runs' links as places among these, links of each run).  Runs that
        only occur in documents without tokens have none."""
        used = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.docs]), minlength=len(self.runs.bad))
        sizes = np.diff(self.runs.ends)
        times = np.repeat(used, sizes)
        keys, where = np.unique(self.runs.links[times > 0], return_inverse=True)
        return keys, np.bincount(where, times[times > 0], len(keys)).astype(np.int64), where, np.where(used > 0, sizes, 0)

    def rows(self) -> dict[str, pa.Array]:
        """What the documents' own alignment says of each."""
        flat, ends = np.concatenate([np.zeros(0, np.int64), *self.docs]), np.cumsum(list(map(len, self.docs)), dtype=np.int64)
        names = ["n_a", "n_b", "n_groups", "n_links"]
        said = [hashlib.sha256("".join([self.runs.said[k] for k in x.tolist()])[:-1].encode()).hexdigest() if len(x) else "" for x in self.docs]
        return {**{n: pa.array(_spans(self.runs.counts[flat, k], ends)) for k, n in enumerate(names)}, "groups_sha256": pa.array(said, pa.string()), "runs": _lists(flat, ends)}


_FIRST = "part int, shard int, leaf int, keys binary, counts binary, docs binary, links binary"


def _held(columns: dict) -> bytes:
    """The columns as a compressed Arrow stream."""
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(column) -> pa.Table:
    return pa.ipc.open_stream(column[0].as_py()).read_all()


def _blobs(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [x[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]


def _first(paths: tuple[str, str], shards: int):
    """A row a shard with the part's distinct pairs and their counts, and one with its documents and its runs' links."""

    def run(table: pa.Table) -> pa.Table:
        part = Part(table, paths)
        keys, n, links, sizes = part.pairs()
        docs, links = _held({"key": part.keys, **part.rows()}), _held({"links": _lists(links, np.cumsum(sizes))})
        shard = (keys & np.uint64(2**32 - 1)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        keys, n, shard = keys[order], n[order], shard[order]
        cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else [], len(shard)).astype(np.int64)
        rows = len(cuts) - 1
        of = table.column("part")[0].as_py()
        return pa.table({
            "part": pa.array([of] * (rows + 1), pa.int32()), "shard": pa.array([*shard[cuts[:-1]].tolist(), None], pa.int32()), "leaf": pa.array([of % LEAVES] * rows + [None], pa.int32()),
            "keys": pa.array([*_blobs(keys, cuts), None], pa.binary()), "counts": pa.array([*_blobs(n, cuts), None], pa.binary()),
            "docs": pa.array([None] * rows + [docs], pa.binary()), "links": pa.array([None] * rows + [links], pa.binary()),
        })

    return run


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _leaf(table: pa.Table) -> pa.Table:
    """The distinct pairs of a shard's leaf with their sums."""
    keys, where = np.unique(_joined(table.column("keys"), "<u8"), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, where, _joined(table.column("counts"), "<i8"))
    return pa.table({"shard": table.column("shard")[:1], "leaf": table.column("leaf")[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})


def _hashed(table: pa.Table) -> pa.Table:
    """A shard's perfect hash, and its keys in the order of the hash."""
    keys = np.unique(_joined(table.column("keys"), "<u8"))
    raw = build(keys)
    ordered = np.empty_like(keys)
    ordered[PerfectHash(raw).index(keys)] = keys
    return pa.table({"shard": table.column("shard")[:1], "hash": pa.array([raw], pa.binary()), "known": pa.array([ordered.tobytes()], pa.binary())})


def _dense(leaves: pa.Table, hashed: pa.Table) -> pa.Table:
    """A leaf's counts as the vector that the shard's hash indexes."""
    if not leaves.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})
    h = PerfectHash(hashed.column("hash")[0].as_py())
    out = []
    for keys, counts in zip(leaves.column("keys").to_pylist(), leaves.column("counts").to_pylist()):
        v = np.zeros(len(h), np.int64)
        v[h.index(np.frombuffer(keys, "<u8"))] = np.frombuffer(counts, "<i8")
        out.append(v.tobytes())
    return pa.table({"shard": leaves.column("shard"), "vector": pa.array(out, pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), "<i8") for v in table.column("vector"))
    return pa.table({"shard": table.column("shard")[:1], "total": pa.array([total.tobytes()], pa.binary())})


def _answers(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """What each part asks of a shard: the totals of its pairs, and whether one is its second id's highest."""
    names = ["part", "keys", "totals", "best"]
    if not asked.num_rows:
        return pa.table([pa.array([], k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=names)
    h, known, total = PerfectHash(counted.column("hash")[0].as_py()), _joined(counted.column("known"), "<u8"), _joined(counted.column("total"), "<i8")
    _, of = np.unique(known & np.uint64(2**32 - 1), return_inverse=True)  # a second id lies in one shard with all its pairs
    high = np.zeros(of.max() + 1, np.int64)
    np.maximum.at(high, of, total)
    best = (total == high[of]).astype(np.uint8)
    totals, flags = [], []
    for raw in asked.column("keys").to_pylist():
        at = h.verified(np.frombuffer(raw, "<u8"), known)
        if (at < 0).any():
            raise ValueError("a pair of the second pass isn't one of the first")
        totals.append(total[at].tobytes())
        flags.append(best[at].tobytes())
    return pa.table([asked.column("part"), asked.column("keys"), pa.array(totals, pa.binary()), pa.array(flags, pa.binary())], names=names)


def _measured(table: pa.Table, answers: pa.Table) -> pa.Table:
    """A part's documents with the sums of what the shards answered for their links."""
    docs, links = _read(table.column("docs")), _read(table.column("links")).column("links").combine_chunks()
    keys, totals, best = _joined(answers.column("keys"), "<u8"), _joined(answers.column("totals"), "<i8"), _joined(answers.column("best"), np.uint8)
    at, order = links.values.to_numpy().astype(np.int64), np.argsort(keys)
    if len(keys) != at.max(initial=-1) + 1:
        raise ValueError("a part's pairs aren't those that its links are of")
    runs = docs.column("runs").combine_chunks()
    flat, ends, to = runs.values.to_numpy(), runs.offsets.to_numpy()[1:], links.offsets.to_numpy()[1:]
    sums = {n: pa.array(_spans(_spans(x[order][at], to)[flat], ends)) for n, x in (("n_best", best.astype(np.int64)), ("count_sum", totals))}
    own = docs.select(["key", "n_a", "n_b", "n_groups", "n_links"])
    return pa.table({**dict(zip(own.column_names, own.columns)), **sums, "groups_sha256": docs.column("groups_sha256")})


def _stages(df: DataFrame, text: str, key: str, paths: tuple[str, str]):
    ship(df.sparkSession)
    docs, parts = dealt(df, text, key, PART)
    shards = max(16, parts // PARTS_A_SHARD)
    first = stored(docs.groupBy("part").applyInArrow(_first(paths, shards), _FIRST), "alignment-pairs")
    partial = first.where(F.col("shard").isNotNull()).select("part", "shard", "leaf", "keys", "counts")
    held = first.where(F.col("docs").isNotNull()).select("part", "docs", "links").repartition(parts, "part")
    leaves = stored(partial.groupBy("shard", "leaf").applyInArrow(_leaf, "shard int, leaf int, keys binary, counts binary"), "alignment-leaves")
    hashed = stored(leaves.groupBy("shard").applyInArrow(_hashed, "shard int, hash binary, known binary"), "alignment-hash")
    vectors = leaves.groupBy("shard").cogroup(hashed.groupBy("shard")).applyInArrow(_dense, "shard int, vector binary")
    total = vectors.groupBy("shard").applyInArrow(_summed, "shard int, total binary")
    return held, partial, stored(hashed.join(total, "shard"), "alignment-counts")


def pair_counts(df: DataFrame, text: str = "text", key: str = "doc_id", *, paths: tuple[str, str]) -> DataFrame:
    """(a, b, links): how many links over all documents hold the ids a and b linked."""

    def run(batches):
        for batch in batches:
            for known, total in zip(batch.column("known").to_pylist(), batch.column("total").to_pylist()):
                k = np.frombuffer(known, "<u8")
                yield pa.RecordBatch.from_arrays([pa.array((k >> HALF).astype(np.int64)), pa.array((k & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(np.frombuffer(total, "<i8"))], names=["a", "b", "links"])

    return _stages(df, text, key, paths)[2].select("known", "total").mapInArrow(run, "a bigint, b bigint, links bigint")


def align_documents(df: DataFrame, text: str = "text", key: str = "doc_id", *, paths: tuple[str, str]) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of df.  paths: the byte-level
    BPE file, which encodes a space and the text, and the piece model, which adds that space itself.

    A null or empty text, and one that either tokenizer doesn't give back byte by byte, has no tokens: zeros, and an
    empty digest.  Special tokens' strings are plain text.  Rows that repeat, and null or repeated keys, are documents
    of their own, each of which counts; an empty table gives no row.  Keys are integers.  A very long text is cut at
    single spaces as any other, and a run without one is aligned in one piece.

    The first pass shuffles the documents by part and stores, for each part, a row a shard with its distinct pairs, and one with its documents' runs
    by number and the runs' links as places among the part's pairs; the second shuffles that last row alone.  A shard
    holds the pairs of two parts at most on average, whatever the input; no id has more pairs than the other vocabulary has ids."""
    held, partial, counted = _stages(df, text, key, paths)
    answers = partial.groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(_answers, "part int, keys binary, totals binary, best binary")
    kinds = "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return held.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_measured, kinds).withColumnRenamed("key", key)
