"""Substring dedup by repeated-phrase automata (operator 11).

A phrase is WINDOW words in a row.  Which phrases recur is found in two steps, each a pre-aggregated shuffle of
hashes: every phrase holds the least of its ANCHOR-word grams, so a phrase can recur only where its anchor does;
phrases whose anchor recurs are then counted themselves, and the least document id of each is kept.  Whole texts count along, so that
a copy of an earlier text goes as one and hands on nothing of its own.  Each part of the
documents gets the recurring phrases that it holds, compiles them into an Aho-Corasick automaton over its own words,
and streams all of its documents through it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import compress, count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import dealt, ship

#: Words of a phrase; words of an anchor.
WINDOW, ANCHOR = 13, 6
#: The id that a document without one counts as: none is larger.
LAST = 2**63 - 1

#: The words of a text: split() of bytes cuts at runs of \x20 and \x09 to \x0D, and at nothing else.
_words = bytes.split
_SEEDS = np.random.default_rng(20250311).integers(1, 2**63, (3, WINDOW), dtype=np.uint64) * 2 + 1


class Part:
    """The documents of one part: word numbers, one after another, and where each document starts."""

    def __init__(self, table: pa.Table):
        self.keys = table.column("key").to_pylist()
        own = [LAST if k is None else k for k in self.keys]
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)  # a number for each new word, from 0
        number = self.vocabulary.__getitem__
        each, digests = [], []
        for t in table.column("text"):
            text = t.as_py() or b""
            words = _words(text)
            each.append(np.fromiter(map(number, words), np.int64, len(words)))
            digests.append(xxhash.xxh3_128_digest(text))
        self.text = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.words = np.concatenate(each) if each else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(each)), self.sizes)
        self.ids = np.array(own, np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        self.hashes = hashes[self.words] if len(self.words) else np.zeros(0, np.uint64)

    def texts(self) -> tuple[np.ndarray, ...]:
        """64 and 32 bits of each text's hash, the least and the largest id with it, and 1 or 2: whether a row has it or more;
        texts below WINDOW words aren't asked for."""
        long = np.flatnonzero(self.sizes >= WINDOW)
        w, c, ids = self.text[long, 0], (self.text[long, 1] >> np.uint64(32)).astype(np.uint32), self.ids[long]
        order = np.lexsort((ids, c, w))
        w, c, ids = w[order], c[order], ids[order]
        new = _runs(w, c)
        ends = _ends(new, len(w))
        return w[new], c[new], ids[new], ids[ends - 1], np.minimum(ends - new, 2)

    def copies(self, table: pa.Table) -> np.ndarray:
        """Whether each document's text is that of a document with a smaller id, as rows (w, c, first) tell."""
        first = dict(zip(zip(table.column("w").to_pylist(), table.column("c").to_pylist()), table.column("first").to_pylist()))
        w, c = self.text[:, 0].view(np.int64).tolist(), (self.text[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()
        return np.array([first.get(x, LAST) < own for x, own in zip(zip(w, c), self.ids.tolist())], bool)

    def phrases(self, size: int, without: np.ndarray | None = None) -> np.ndarray:
        """The places where `size` words of one document start; `without` marks documents to pass over."""
        at = np.arange(max(0, len(self.words) - size + 1))
        at = at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at
        return at if without is None else at[~without[self.doc[at]]]

    def grams(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        """A hash of the `size` words from each place on."""
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out += self.hashes[at + k] * _SEEDS[seed, k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """Of each phrase the least of its grams of ANCHOR words."""
        if not len(at):
            return np.zeros(0, np.uint64)
        grams = self.grams(np.arange(len(self.words) - ANCHOR + 1), ANCHOR, 0)
        least = grams[at]
        for k in range(1, WINDOW - ANCHOR + 1):
            np.minimum(least, grams[at + k], out=least)
        return least


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value starts in columns that are sorted together."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _ends(starts: np.ndarray, size: int) -> np.ndarray:
    """Where the runs end that start there."""
    return np.append(starts[1:], size)[: len(starts)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(table: pa.Table) -> pa.Table:
    """Each anchor of the part, and 1 or 2: whether one document or more hold it.  And each text, with its least id."""
    part = Part(table)
    at = part.phrases(WINDOW)
    anchor, doc = part.anchors(at), part.doc[at]
    new = _runs(anchor, doc)  # neighbours mostly share theirs
    anchor, doc = anchor[new], doc[new]
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    new = _runs(anchor, doc)
    anchor = anchor[new]
    new = _runs(anchor)
    n = np.minimum(_ends(new, len(anchor)) - new, 2)
    w, c, least, _, rows = part.texts()
    return pa.table({
        "part": pa.array(np.full(len(new) + len(w), table.column("part")[0].as_py()), pa.int32()), "w": _signed(np.concatenate([anchor[new], w])),
        "c": pa.array(np.concatenate([np.zeros(len(new), np.int32), c.view(np.int32)])), "n": pa.array(np.concatenate([n, rows]), pa.int64()),
        "lo": pa.concat_arrays([pa.nulls(len(new), pa.int64()), pa.array(least, pa.int64())]),
    })


def _candidates(table: pa.Table, recurring: pa.Table) -> pa.Table:
    """Each phrase of the part whose anchor recurs, but for copies of earlier texts, and each text that recurs: 64 and
    32 bits of hash, the least and the largest id."""
    names = ["part", "w", "c", "lo", "hi"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    if not table.num_rows or not recurring.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    part = Part(table)
    is_text = pc.is_valid(recurring.column("first"))
    texts, recurring = recurring.filter(is_text), recurring.filter(pc.invert(is_text))
    at = part.phrases(WINDOW, part.copies(texts))
    known = np.sort(recurring.column("w").to_numpy().view(np.uint64))
    anchor = part.anchors(at)
    if len(known):
        near = np.searchsorted(known, anchor)
        at = at[known[np.minimum(near, len(known) - 1)] == anchor]
    else:
        at = at[:0]
    w, c, ids = part.grams(at, WINDOW, 1), (part.grams(at, WINDOW, 2) >> np.uint64(32)).astype(np.uint32), part.ids[part.doc[at]]
    order = np.lexsort((ids, c, w))
    w, c, ids = w[order], c[order], ids[order]
    new = _runs(w, c)
    last = _ends(new, len(w)) - 1
    tw, tc, least, most, _ = part.texts()
    asked = set(zip(texts.column("w").to_pylist(), texts.column("c").to_pylist()))
    keep = np.array([x in asked for x in zip(tw.view(np.int64).tolist(), tc.view(np.int32).tolist())], bool)
    both = lambda x, y: np.concatenate([x, y[keep]])
    out = [_signed(both(w[new], tw)), pa.array(both(c[new].view(np.int32), tc.view(np.int32))), pa.array(both(ids[new], least)), pa.array(both(ids[last], most))]
    return pa.table([pa.array(np.full(len(out[0]), table.column("part")[0].as_py()), pa.int32()), *out], names=names)


def codes(used: np.ndarray, size: int) -> list[str]:
    """Two letters for each word number below `size`: the numbers in `used` get their own, all others share one pair.
    First letters are no second letters, so a match starts and ends with a word.  Few letters, as the library looks
    through a node's children one by one."""
    base = int(np.ceil(np.sqrt(len(used) + 1)))
    out = [chr(33) + chr(33 + base)] * size
    for k, word in enumerate(used.tolist(), 1):
        high, low = divmod(k, base)
        out[word] = chr(33 + high) + chr(33 + base + 1 + low)
    return out


def in_letters(words: np.ndarray, coded: list[str]) -> str:
    """The codes of the words, one after another: those of word k are letters 2k and 2k + 1."""
    return np.frombuffer("".join(coded).encode("utf-32-le"), "<u8")[words].tobytes().decode("utf-32-le")


def automaton(part: Part, recurring: pa.Table, without: np.ndarray | None = None) -> tuple[ahocorasick.Automaton | None, list[str], np.ndarray]:
    """The part's recurring phrases as an automaton over coded words, the codes, and each phrase's least document id."""
    if not recurring.num_rows or not len(part.words):
        return None, [], np.zeros(0, np.int64)
    w, c, first = recurring.column("w").to_numpy().view(np.uint64), recurring.column("c").to_numpy().view(np.uint32), recurring.column("first").to_numpy()
    order = np.lexsort((c, w))
    w, c, first = w[order], c[order], first[order]
    at = part.phrases(WINDOW, without)
    own = part.grams(at, WINDOW, 1)
    near = np.searchsorted(w, own)
    keep = w[np.minimum(near, len(w) - 1)] == own
    at, near, own = at[keep], near[keep], own[keep]
    check = (part.grams(at, WINDOW, 2) >> np.uint64(32)).astype(np.uint32)
    while (miss := c[near] != check).any():  # phrases that share the 64 bits lie side by side
        near[miss] += 1
        keep = (near < len(w)) & (w[np.minimum(near, len(w) - 1)] == own)
        at, near, own, check = at[keep], near[keep], own[keep], check[keep]
    phrase, where = np.unique(near, return_index=True)
    if not len(phrase):
        return None, [], first
    places = at[where]
    words = part.words[places[:, None] + np.arange(WINDOW)]
    coded = codes(np.unique(words), len(part.vocabulary))
    out, text = ahocorasick.Automaton(ahocorasick.STORE_INTS), in_letters(words.reshape(-1), coded)
    for k, at in zip(phrase.tolist(), range(0, len(text), 2 * WINDOW)):
        out.add_word(text[at : at + 2 * WINDOW], k)
    out.make_automaton()
    return out, coded, first


def _located(table: pa.Table, recurring: pa.Table) -> pa.Table:
    """Every document of the part, streamed through the part's automaton."""
    part = Part(table)
    copies = part.copies(recurring)
    find, coded, first = automaton(part, recurring, copies)
    least, letters = first.tolist(), "" if find is None else in_letters(part.words, coded)
    removed, digests = [], []
    for text, start, size, own, copy in zip(table.column("text"), part.starts.tolist(), part.sizes.tolist(), part.ids.tolist(), copies.tolist()):
        words = [] if copy else _words(text.as_py() or b"")
        ends: list[int] = []
        if find is not None and len(words) >= WINDOW:
            ends = [end for end, k in find.iter(letters[2 * start : 2 * (start + size)]) if least[k] < own]
        if ends:
            last = np.array(ends, np.int64) // 2
            step = np.zeros(size + 1, np.int64)
            np.add.at(step, last - (WINDOW - 1), 1)
            np.add.at(step, last + 1, -1)
            words = list(compress(words, (np.cumsum(step)[:size] == 0).tolist()))
        removed.append(size - len(words))
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"key": pa.array(part.keys, pa.int64()), "n_words": pa.array(part.sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row of df: each word goes that lies in a phrase of WINDOW words
    which also starts in a document with a smaller key, as the input has it.

    The documents are shuffled once, by part of some megabytes; that shuffle serves all three passes.  Anchors and
    phrases are distinct within a part before they are shuffled, so one that a third of all documents hold has a row
    a part.  A null text has no words; a text below WINDOW words keeps all; rows with one key, and rows that repeat,
    are documents of their own and no source for each other; a null key counts as larger than any other; an empty
    table gives no row.  Keys are integers.  Further columns are left out."""
    ship(df.sparkSession)
    docs, _ = dealt(df, text, key)
    by = docs.groupBy("part")
    a = by.applyInArrow(_anchor_rows, "part int, w bigint, c int, n bigint, lo bigint")
    same = Window.partitionBy("w", "c")
    recurs = a.withColumns({"s": F.sum("n").over(same), "first": F.min("lo").over(same)}).where("s >= 2").select("part", "w", "c", "first")
    p = by.cogroup(recurs.groupBy("part")).applyInArrow(_candidates, "part int, w bigint, c int, lo bigint, hi bigint")
    first = p.withColumn("first", F.min("lo").over(same)).where("hi > first").select("part", "w", "c", "first")
    out = by.cogroup(first.groupBy("part")).applyInArrow(_located, "key bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumnRenamed("key", key)
