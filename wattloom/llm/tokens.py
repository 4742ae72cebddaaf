"""Ids of whole texts by the tokenizers library, run by run with a bounded memo.

The library's own call normalises and splits every text anew, which costs ten times what its BPE model
does.  In a text of ASCII and plain Latin letters alone, the runs of letters, digits or signs that it splits a
text into are found by one expression over bytes; a run is looked up, and only a new one goes to the model.
Any other text is cut at white space into pieces whose ids don't depend on what lies around them, and a piece
that holds anything unusual goes through the library's full encode().  Many texts together (encode_all) have the
same runs found by comparing bytes as vectors, and each distinct run is looked up once.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

#: Bytes that the memo of runs, and each memo of pieces, may take for its present and for its past entries; and
#: what an entry takes besides its two strings.  Texts together have a memo of runs of their own.
RUNS, PIECES, ENTRY, RUNS_TOGETHER = 64 << 20, 4 << 20, 160, 128 << 20
#: A longer text isn't encoded together with others (Arrow counts the bytes of ids in 32 bits).
LONG = 256 << 20

#: The bytes of ASCII text and of Latin letters below U+0250, and what of these keeps a text from the plain way.
_USUAL = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_NO_LETTERS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"\xc9")
_PLAIN_WORD_ENDS = re.compile(rb"'(?:[stmd]|re|ve|ll)|[A-Za-z\x80-\xff]+|[0-9]|[^\sA-Za-z0-9\x80-\xff]+")
_PLAIN_BYTE_LEVEL = re.compile(rb"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
_RUNS_SINGLE_DIGITS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]|[^A-Za-z0-9\x80-\xff]+")
_RUNS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff]+")
#: Pieces with a contraction sign, a control byte or the start of a special token take the full encode().
_UNUSUAL = re.compile(rb"['\x00-\x20\x7f]|<\|")
#: In a text without any of these, every space and every newline stands alone between signs or letters, and
#: the byte-level file's split has a border before each.
_CARE = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_BORDER = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")


def _byte_chars() -> str:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1 stays, the
    others follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    keep = set(plain)
    return "".join(chr(b) if b in keep else chr(next(rest)) for b in range(256))


_LETTER = dict(enumerate(_byte_chars()))

#: What a byte is in the byte-level file's split: an end of text, a letter, a digit, a sign or white space.
_END, _ALPHA, _DIGIT, _SIGN, _SPACE = range(5)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*b"\t\n\x0b\x0c\r "]] = _SPACE
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _ALPHA
_KIND[0] = _END


def _run_starts(raw: bytes) -> np.ndarray:
    """Where the runs of _PLAIN_BYTE_LEVEL start in texts that each end with a zero byte, which is a run of its own."""
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND.take(b)
    start = np.ones(len(b), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    # the last white space before anything else stands alone, or goes with what follows if it is a space
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    start[last] = True
    start[last[b[last] == 32] + 1] = False
    for at in np.flatnonzero(b == 39).tolist():
        if at and (kind[at - 1] == _SIGN or b[at - 1] == 32):
            continue  # within a run of signs, or behind a space that goes with it
        n = 2 if raw[at + 1] in b"stmd" else 3 if raw[at + 1 : at + 3] in (b"re", b"ve", b"ll") else 0
        if n:
            start[at + 1 : at + n] = False
            start[at] = start[at + n] = True
    return np.flatnonzero(start)


class _Memo(dict):
    """make(piece) by piece.  Full, its entries become the past ones; what is asked for again comes back from there."""

    def __init__(self, make, most: int):
        self.make, self.most, self.held, self.past = make, most, 0, {}

    def __missing__(self, piece):
        ids = self.past.get(piece)
        if ids is None:
            ids = self.make(piece)
        self.held += len(piece) + len(ids) + ENTRY
        if self.held > self.most:
            self.past = dict(self)
            self.clear()
            self.held = 0
        self[piece] = ids
        return ids


def _odd(text: bytes) -> bool:
    """Whether the text holds more than ASCII and plain Latin letters, or what may be a special token."""
    if text.translate(None, _USUAL) or b"<|" in text:
        return True
    if text.isascii():
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return True
    return any(x in text for x in _NO_LETTERS)


class Encoder:
    """encode(utf8) -> ids as little-endian unsigned 32-bit integers, equal to the library's for the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.lower = self.model.end_of_word_suffix is not None  # the file with word ends drops case and white space
        self.runs = _RUNS_SINGLE_DIGITS if self.lower else _RUNS
        self.plain = (_PLAIN_WORD_ENDS if self.lower else _PLAIN_BYTE_LEVEL).findall
        self.run_ids = _Memo(self._run, RUNS // 2)
        self.run_ids_together = _Memo(self._run, RUNS_TOGETHER // 2)
        self.pieces = _Memo(lambda piece: self._piece(piece, b""), PIECES // 2)
        self.spaced = _Memo(lambda piece: self._piece(piece, b" "), PIECES // 2)
        self.newline = self._full(b"\n") if not self.lower else b""

    def _full(self, piece: bytes) -> bytes:
        return array("I", self.whole.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _run(self, run: bytes) -> bytes:
        if self.lower and not run.isascii():
            run = run.decode().lower().encode()
        if run.isascii() and (plain := run.decode()).isprintable():  # these stand for themselves, but for the space
            spelled = plain.replace(" ", _LETTER[32])
        else:
            spelled = run.decode("latin-1").translate(_LETTER)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _piece(self, piece: bytes, before: bytes) -> bytes:
        if piece.isalpha():
            return self.run_ids[before + piece]
        if (word := piece[:-1]).isalpha() and (sign := piece[-1:]) in b".,;:!?)|%*&$#":
            return self.run_ids[before + word] + self.run_ids[sign]
        if _UNUSUAL.search(piece):
            return self._full(before + piece)
        runs = []
        for run in self.runs.findall(piece):
            if not run.isascii():
                try:
                    s = run.decode()
                except UnicodeDecodeError:
                    return self._full(before + piece)
                # letters below U+0250 are composed already and change case one by one
                if not s.isalpha() or max(s) >= "\u0250" or "\u0130" in s:
                    return self._full(before + piece)
            runs.append(run)
        if before and runs:
            runs[0] = before + runs[0]
        return b"".join([self.run_ids[run] for run in runs])

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        if not _odd(text):
            return b"".join(map(self.run_ids.__getitem__, self.plain(text.lower() if self.lower else text)))
        if self.lower:  # a special token stands as it is written, so its piece keeps its case
            return b"".join([self._full(p) if b"<|" in p else self.pieces[p.lower()] for p in text.split()])
        if text[0] in b" \n" or text[-1] in b" \n" or any(x in text for x in _CARE):
            return b"".join(map(self._cut_with_care, self._blocks(text)))
        out = []
        for k, line in enumerate(text.split(b"\n")):
            if k:
                out.append(self.newline)
            first, *rest = line.split(b" ")
            out.append(self.pieces[first])
            out.extend(map(self.spaced.__getitem__, rest))
        return b"".join(out)

    def encode_all(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, with `end` after each; how many each has, with the end).  Texts of some MB together, or one."""
        last = end.to_bytes(4, "little")
        odd = {k: self.encode(t) for k, t in enumerate(texts) if self.lower or len(t) > LONG or _odd(t)}
        raw = b"\0".join([b"" if k in odd else t for k, t in enumerate(texts)] if odd else texts) + b"\0"
        starts = np.append(_run_starts(raw), len(raw)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        _, to, data = runs.dictionary.buffers()
        to, data = np.frombuffer(to, np.int32, len(runs.dictionary) + 1).tolist(), data.to_pybytes()
        known = self.run_ids_together
        own = pa.array([known[run] if run != b"\0" else last for run in map(data.__getitem__, map(slice, to, to[1:]))], pa.binary()).take(runs.indices)
        ids = np.frombuffer(own.buffers()[2], "<u4", own.buffers()[2].size // 4)
        to = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1) // 4
        ends = to[1:][np.frombuffer(raw, np.uint8)[starts[:-1]] == 0]
        ids, counts = ids[: ends[-1]], np.diff(ends, prepend=0).astype(np.int64)
        if odd:
            at = ends - 1  # the odd texts' ids go before their end
            more = [np.frombuffer(x, "<u4") for x in odd.values()]
            sizes = np.array(list(map(len, more)))
            ids = np.insert(ids, np.repeat(at[list(odd)], sizes), np.concatenate(more))
            counts[list(odd)] += sizes
        return ids, counts

    def _blocks(self, text: bytes):
        """Cuts before a space between two ASCII signs or letters: there no run of white space is split."""
        at = 0
        for m in _BORDER.finditer(text):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _cut_with_care(self, block: bytes) -> bytes:
        if block[:1] == b" " and block[1:2].isalnum() and block.isascii() and not block[1:].split(None, 1)[1:] and not block[-1:].isspace():
            return self.spaced[block[1:]]
        return self._full(block) if block else b""


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
