"""Token ids of many texts with the ``tokenizers`` library, one call per new word instead of one per text.

A byte-level vocabulary never merges across the border between a non-blank and a following blank, nor
before the last blank of a run.  Texts of single or double blanks can therefore be cut there, and the ids
of a piece can be kept for its next use; every other text is encoded as a whole.
"""

from __future__ import annotations

import re
from itertools import chain, islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kept import kept

_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ["".join(x) for x in ((a, b, c) for a in " \n" for b in " \n" for c in " \n")]
_ENDS = {a + b for a in " \n" for b in " \n"}
_PIECES = 500_000  # pieces kept per worker, about 200 MB at most


def encoder(path: str, most: int | None = None) -> "Encoder":
    """The encoder of this worker, kept between tasks; it keeps about ``most`` pieces."""
    return kept(("encoder", path, most), lambda: Encoder(path, most))


def divisible(text: str) -> bool:
    """Whether cutting at blanks and line ends leaves the ids as they are."""
    if any(c in text for c in _RUNS) or (len(text) > 1 and text[-1] in " \n" and text[-2] in " \n"):
        return False
    return not any(c in text for c in _OTHER[: 8 if text.isascii() else None])


class Encoder:
    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        # control strings that the vocabulary names (such as an end of text) are one id wherever they stand
        self.control = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced: dict[str, bytes] = {}  # a piece after a blank, or (with the line end before it) at the start of a line
        self.marks: dict[str, bytes] = {}  # runs of marks behind a letter
        self.line_end = self.whole("\n")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.blank_first = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that begin with a blank
        self.blank_first[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True
        self.cuts = bool(re.search(r'"type"\s*:\s*"ByteLevel"', self.tokenizer.to_str()[:200_000])) and len(self.line_end) == 4

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def learn(self, new: list[str], before: str) -> None:
        """Encode new pieces, many in one call: behind blanks as words of one text, else as its lines."""
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            raw = self.whole(before + " ".join(part)) if before else b""
            # a piece holds no blank, so the token that begins with one begins a piece
            begin = (np.flatnonzero(self.blank_first[np.frombuffer(raw, "<u4")]) * 4).tolist()
            stop = [*begin[1:], len(raw)]
            if len(begin) != len(part):
                raw = self.whole(before + ("\n" + before).join(part))
                ends = np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(self.line_end, "<u4")[0]) * 4
                begin = [0, *(ends + 4).tolist()]
                stop = [*ends.tolist(), len(raw)]
            ids = map(raw.__getitem__, map(slice, begin, stop))
            self.spaced.update(zip(part, ids) if before else (("\n" + p, self.line_end + i) for p, i in zip(part, ids)))

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        most = self.most or _PIECES
        if len(self.spaced) > most:  # those of this slice go first, then the early ones
            now = {p: self.spaced[p] for p in pieces if p in self.spaced}
            others = (x for x in self.spaced.items() if x[0] not in now)
            self.spaced = dict(islice(chain(now.items(), others), most // 2))
        if len(self.marks) > 10_000:
            self.marks.clear()
        found = list(map(self.spaced.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        # marks behind a letter are a token run of its own, so the word is looked up without them
        cores = []
        for i in missing:
            p = pieces[i]
            core = p.rstrip(punctuation)
            cores.append(core if core != p and core[-1:].isalpha() and core[-1] < "\u0250" else p)
        new = set(cores).difference(self.spaced)
        if "" in new:
            new.remove("")
            self.spaced[""] = self.whole(" ")
        if "\n" in new:
            new.remove("\n")
            self.spaced["\n"] = self.line_end
        self.learn([p for p in new if p[0] != "\n"], " ")
        self.learn([p[1:] for p in new if p[0] == "\n"], "")
        for i, core in zip(missing, cores):
            tail = pieces[i][len(core) :]
            if tail and tail not in self.marks:
                self.marks[tail] = self.whole(tail)
            found[i] = self.spaced[core] + self.marks[tail] if tail else self.spaced[core]
        return found

    def pieced(self, texts: list[str]) -> list[bytes]:
        """The ids of divisible texts: every different piece is looked up once, Arrow puts the ids in a row."""
        pieces = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        at = pieces.offsets.to_numpy()
        words = pieces.values.dictionary_encode()
        ids = pa.array(self.ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, offsets, raw = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[at].tolist()
        data = raw.to_pybytes() if raw else b""
        return [data[a + 4 : b] for a, b in zip(ends, ends[1:])]  # without the line end before the text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text; call with a bounded slice of texts."""
        if not self.cuts:
            return [self.whole(t) for t in texts]
        plain_cut = divisible("\0".join(texts)) and not any(t[-2:] in _ENDS for t in texts)  # mostly all texts are; then one look is enough
        cut = [(plain_cut or divisible(t)) and not any(c in t for c in self.control) for t in texts]
        found = iter(self.pieced([t for t, c in zip(texts, cut) if c]))
        return [next(found) if c else self.whole(t) for t, c in zip(texts, cut)]


def text_slices(column: pa.Array, limit: int = 1 << 20):
    """``(first row, texts)`` in slices of about ``limit`` characters; null counts as empty."""
    part, size, first = [], 0, 0
    for i, value in enumerate(column):
        t = value.as_py() or ""
        if part and size + len(t) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(t)
        size += len(t)
    if part:
        yield first, part
