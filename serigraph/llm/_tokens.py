"""Token ids of whole texts from those of their parts, each of which a tokenizer encodes once while it is kept."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of encoded parts and their ids from which on a worker forgets some, however few they are.
KEPT_BYTES = 100 << 20
#: Kinds of UTF-16 units. From NUMBER on each unit may be told to be a part of its own.
WHITE, LETTER, OTHER, ODD, WHOLE, NUMBER, END = range(7)
#: Ends a text: a lone surrogate, which no text holds.
STOP = "\udc00".encode("utf-16-le", "surrogatepass")
#: Letters after an apostrophe that are a part with it.
TAILS = ("s", "t", "m", "d", "re", "ve", "ll")


def kinds() -> np.ndarray:
    """The kind of each UTF-16 unit; visible characters up to U+024F have a fixed one, others and control characters are odd."""
    out = np.full(1 << 16, ODD, np.uint8)
    for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)):
        out[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER
    out[[*range(0x09, 0x0E), 0x20]] = WHITE
    return out


def units_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-16 units of UTF-8 texts, a STOP after each, and where the stops are."""
    raw = [t.decode().encode("utf-16-le") for t in texts]
    return np.frombuffer(b"".join(x for r in raw for x in (r, STOP)), "<u2"), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 2 + 1) - 1


def between(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first:last."""
    size = last - first
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - size), size)


def odd_places(units: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the tokenizer has to see what stands around: odd characters, and what may begin a token of its own."""
    bars = np.flatnonzero(units == ord("|"))
    bars = bars[bars > 0]
    return np.union1d(np.flatnonzero(kind == ODD), bars[units[bars - 1] == ord("<")])


def split_tails(start: np.ndarray, units: np.ndarray, kind: np.ndarray, at: np.ndarray) -> None:
    """Make a part of each apostrophe of at, each of which begins a part, and the letters of a tail after it."""
    for tail in TAILS:
        fits = at[at + len(tail) < len(units)]
        for i, letter in enumerate(tail):
            fits = fits[(units[fits + 1 + i] == ord(letter)) & (kind[fits + 1 + i] == LETTER)]
        start[fits + 1] = False
        rest = fits + 1 + len(tail)
        rest = rest[rest < len(units)]
        start[rest[kind[rest] == LETTER]] = True


class KnownParts:
    """Parts as UTF-16, with their ids in a row; those of a STOP are given."""

    def __init__(self, tokenizer_file: str, stop_ids: list[int]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.strings = pa.array([STOP], pa.large_binary())
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.array([len(stop_ids)]), np.array(stop_ids, "<u4")
        self.met, self.run = np.zeros(1, np.int64), 0  # the last run that met each part

    def encoded(self, strings: list[str]) -> list[bytes]:
        found = []
        for i in range(0, len(strings), 20_000):
            found += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings[i : i + 20_000], add_special_tokens=False)]
        return found

    def encoded_apart(self, strings: list[str], gap: str, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> list[bytes]:
        """Ids of strings, a gap before each: many are encoded as one text and told apart by the ids that begin or end one."""
        found = []
        for i in range(0, len(strings), 2_000):
            some = strings[i : i + 2_000]
            (whole,) = self.encoded([gap + gap.join(some)])
            ids = np.frombuffer(whole, "<u4")
            cuts = (np.flatnonzero(begins[ids]) if ends is None else np.flatnonzero(ends[ids]) + 1) * 4
            if len(cuts) == len(some):
                cuts = [*cuts.tolist(), len(whole)] if ends is None else [0, *cuts.tolist()]
                found += [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                found += self.encoded([gap + s for s in some])
        return found

    def ids(self, parts: pa.LargeBinaryArray, encode: Callable[[list[str]], list[bytes]], kept: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and where each part's end; encode gives those of parts not known. Beyond kept parts, some are forgotten."""
        coded = parts.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.strings)
        new = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        place = place.fill_null(0).to_numpy().astype(np.int64)
        self.run += 1
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            found = encode([s.decode("utf-16-le") for s in fresh.to_pylist()])
            length = np.fromiter(map(len, found), np.int64, len(found)) // 4
            place[new] = len(self.strings) + np.arange(len(new))
            self.strings = pa.concat_arrays([self.strings, fresh])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(length) - length])
            self.lengths, self.met = np.concatenate([self.lengths, length]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        self.met[place] = self.run
        at = place[coded.indices.to_numpy()]
        size = self.lengths[at]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        kind = np.int32 if max(n, len(self.flat)) < 1 << 31 else np.int64
        ids = self.flat[np.arange(n, dtype=kind) + np.repeat((self.starts[at] - (total - size)).astype(kind), size)]
        if len(self.strings) > kept or self.strings.nbytes + self.flat.nbytes > KEPT_BYTES:
            self.keep_half()
        return ids, total

    def keep_half(self) -> None:
        """Forget the parts that were not met for the longest time, but none of this run."""
        some = np.flatnonzero(self.met >= min(int(np.median(self.met)) + 1, self.run))
        self.flat = self.flat[between(self.starts[some], self.starts[some] + self.lengths[some])]
        self.strings, self.lengths, self.met = self.strings.take(pa.array(some)), self.lengths[some], self.met[some]
        self.starts = np.cumsum(self.lengths) - self.lengths


def parts_of(units: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """The strings of units that begin at starts."""
    offsets = np.append(starts, len(units)).astype(np.int64) * 2
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(units)])
