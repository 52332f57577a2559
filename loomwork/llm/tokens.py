"""Exact, cached encoding with a public byte-level BPE vocabulary.

The vocabulary's pre-tokenizer always starts a new piece at a single blank that
a non-blank character follows, and, in texts of the Latin script, wherever
letters meet other characters (apostrophes aside). So a text can be cut there,
each distinct piece encoded once by the tokenizers library, and the ids strung
together. What doesn't fit these rules is encoded whole.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa

from loomwork.llm import spans

#: Places of the table of pieces, as a power of 2, and the ids it holds.
_SLOTS, _POOL = 21, 6_000_000
#: A blank beside another white-space character, or at either end.
_UNSAFE = re.compile(r" \s|\A | \Z")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = f"\\t\\n\\x21-\\x26\\x28-\\x7e{_LETTERS}"
_ALL_PLAIN = re.compile(f"[ {_PLAIN}]*")
#: Pieces of plain texts: letters, a lone line end before a letter, other runs,
#: and any other white space with all that follows up to a blank.
_PIECES = re.compile(f" ?[{_LETTERS}]+|\\n(?=[{_LETTERS}])| ?[^{_LETTERS}\\s]+|\\s+[^ ]*")
#: The same for all texts: what lies between blanks stays whole if any of it isn't plain.
_MIXED = re.compile(f" ?[{_PLAIN}]*[^ {_PLAIN}][^ ]*|{_PIECES.pattern}")


def _plainly_unsafe(text: str) -> bool:
    """`_UNSAFE` for texts whose only white space is blanks, tabs and line ends."""
    return text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or " \t" in text


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids as bytes; keeps at most about ``kept`` pieces."""

    def __init__(self, vocabulary: str, end_id: int | None = None, kept: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")
        self.kept = kept
        #: pieces in two generations: when the younger is full, the older goes, but for what is used again
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: a piece's hash, the place of its ids in the pool, and their number
        self.keys, self.place, self.size = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32), np.zeros(1 << _SLOTS, np.uint16)
        self.pool, self.used = np.zeros(0, np.uint32), 0
        self.line_end = int.from_bytes(self._whole(["\n"])[0], "little")

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn(self, plain: set[str], other: set[str]) -> None:
        """Encode new pieces, those of plain texts as lines of one text, in which a lone line end is a piece of its own."""
        # pieces of plain texts hold white space only at their start
        lines = [x for x in plain if x[0] > "\n"]
        single = [*other, *plain.difference(lines)]
        self.pieces.update(zip(single, self._whole(single), strict=True))
        for at in range(0, len(lines), 8192):
            part = lines[at : at + 8192]
            ids = np.frombuffer(self._whole(["\n".join(part)])[0], "<u4")
            raw = ids.tobytes()
            ends = (4 * np.flatnonzero(ids == self.line_end)).tolist()
            slices_ = map(slice, [0, *[x + 4 for x in ends]], [*ends, len(raw)])
            self.pieces.update(zip(part, map(raw.__getitem__, slices_), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        if len(self.pieces) > self.kept // 2:
            self.older, self.pieces = self.pieces, {}
        known = self.pieces
        plain: set[str] = set()
        other: set[str] = set()
        whole: list[str] = []
        found: list[list[bytes | None] | None] = []
        gaps: list[tuple[list, int, str]] = []
        for text in texts:
            if not text:
                found.append([])
                continue
            simple = _ALL_PLAIN.fullmatch(text) and not _plainly_unsafe(text)
            if not simple and _UNSAFE.search(text):
                found.append(None)
                whole.append(text)
                continue
            parts = (_PIECES if simple else _MIXED).findall(text)
            ids = list(map(known.get, parts))
            if None in ids:
                new = [(ids, i, parts[i]) for i, x in enumerate(ids) if x is None]
                (plain if simple else other).update([x[2] for x in new])
                gaps += new
            found.append(ids)
        again = [x for x in (*plain, *other) if x in self.older]
        known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(plain.difference(again), other.difference(again, plain))
        for ids, i, part in gaps:
            ids[i] = known[part]
        uncut, end = iter(self._whole(whole)), self.end
        return [next(uncut) + end if ids is None else b"".join(ids) + end for ids in found]


    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of plain texts, strung together, and how many each has."""
        found, sizes = [], []
        for at in range(0, len(pieces), 8192):
            part = pieces[at : at + 8192]
            if "\n" in part:
                raw = self._whole(part)
                found += [np.frombuffer(x, "<u4") for x in raw]
                sizes.append(np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw)))
                continue
            ids = np.frombuffer(self._whole(["\n".join(part)])[0], "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            found.append(np.delete(ids, ends))
            sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
        return np.concatenate(found), np.concatenate(sizes)

    def encode_column(self, column) -> list[bytes]:
        """Ids of each text of an Arrow string column; null counts as empty.

        Plain texts are cut all at once, each distinct piece of the batch is
        looked up once by its 64-bit hash, and new ones are encoded together.
        Other texts go through `encode`. The table of pieces has a fixed size:
        a new piece takes the place of another, which only costs time.
        """
        data, offsets = spans.texts(column)
        n = len(offsets) - 1
        simple = _simple(data, offsets)
        out: list[bytes] = [b""] * n
        rest = np.flatnonzero(~simple).tolist()
        for i, ids in zip(rest, self.encode(column.take(pa.array(rest, pa.int64())).to_pylist()) if rest else (), strict=True):
            out[i] = ids
        if len(rest) == n:
            return out
        starts, ends = _cut(data, offsets, simple)
        owner = spans.owners(offsets, starts)
        keys = spans.hashes(data, starts, ends)
        if self.used > _POOL // 2:
            self.keys[:], self.used = 0, 0
        slot = keys >> np.uint64(64 - _SLOTS)
        place, sizes = self.place[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            raw, first = data.tobytes(), miss[first]
            ids, counts = self._ids([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), _POOL), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(counts) - counts
            place[miss], sizes[miss] = at[back], counts[back]
            self.used += len(ids)
            short = counts < 1 << 16
            slot = new[short] >> np.uint64(64 - _SLOTS)
            self.keys[slot], self.place[slot], self.size[slot] = new[short], at[short], counts[short]
        total = np.cumsum(sizes)
        at = np.repeat(place - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        flat = self.pool[at].astype("<u4").tobytes()
        counts = np.bincount(owner, sizes, n).astype(np.int64)
        stops = 4 * np.cumsum(counts)
        for i in np.flatnonzero(simple).tolist():
            out[i] = flat[stops[i] - 4 * counts[i] : stops[i]] + self.end
        return out


#: Classes of bytes in plain texts: letters (with all bytes of two-byte Latin ones), others, and what makes a text not plain.
_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_OTHER[0x21:0x7F] = True
_OTHER[0x27] = False
_OTHER &= ~_LETTER
_ODD = ~(_LETTER | _OTHER)
_ODD[[0x0A, 0x20]] = False


def _simple(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has only plain characters, single blanks inside, and line ends only before letters."""
    n = len(offsets) - 1
    if not len(data):
        return np.ones(n, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.append(data[1:], 0)
    last, space = edge[1:], data == 0x20
    odd = _ODD[data]
    odd |= space & (edge[:-1] | last | (after == 0x20) | (after == 0x0A))
    odd |= (data == 0x0A) & (last | ~_LETTER[after])
    odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data == 0xC9) & (after >= 0x90)
    out = np.ones(n, bool)
    out[spans.owners(offsets, np.flatnonzero(odd))] = False
    return out


def _cut(data: np.ndarray, offsets: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pieces of simple texts: runs of letters or of others with the blank before them, and line ends."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    letter, space, line = _LETTER[data], data == 0x20, data == 0x0A
    before = lambda x: np.concatenate([[False], x[:-1]])
    begins = edge[:-1] | space | line | before(line) | ((letter != before(letter)) & ~before(space))
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    own = simple[spans.owners(offsets, starts)] if len(starts) else np.zeros(0, bool)
    return starts[own], ends[own]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, end_id: int | None = None) -> Encoder:
    """This worker's encoder; made once and kept between tasks."""
    key = (vocabulary, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, end_id)
    return _ENCODERS[key]


#: Gives what numpy has freed back to the system, where the C library can: workers live on from stage to stage.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batch, most: int = 256):
    """Smaller record batches, so that a few long texts don't pile up at once."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
