"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import os
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are held at once.
SLICE = 1 << 20
#: The vocabulary file used when none is named.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _PLAIN = _bytes(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "), _bytes(string.ascii_letters.encode() + string.digits.encode())
#: First bytes of pairs that are letters: U+00C0 to U+027F, but for two signs, and U+0400 to U+047F.
_PAIRS, _SIGNS = _bytes(b"\xc3\xc4\xc5\xc6\xc7\xc8\xc9\xd0\xd1"), [0xC397, 0xC3B7]
#: White space of two and of three bytes.
_SPACE_2 = [0xC285, 0xC2A0]
_SPACE_3 = [0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
#: Words that are one piece of the vocabulary's pattern.
_LETTERS = "^ [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f\u0400-\u047f]+$"


def _byte_names() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


_NAMES = _byte_names()


def _joined(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes with the ``tokenizers`` library, each different word once.

    A byte-level vocabulary cuts a text before a blank or a line feed that stands between two other characters, and,
    if its pattern is the usual one, between a letter or digit and a mark. What lies between has the same ids in every text.
    Such words are looked up in a bounded table; a full one keeps the words that were met again. Where other white
    space stands nothing is cut, so that it is in a longer word. The table is a column of words and an array with the ids of
    one after the other: a word takes some 30 bytes, and all words at hand are looked up at once.
    Ids are little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str | None = None, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(path))
        self.limit = limit
        self.marks = _bytes(self._marks())
        self.words, self.pool, self.ends = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.zeros(1, np.int64)
        #: words of the table that later texts have, too
        self.again = np.zeros(0, bool)

    def _marks(self) -> bytes:
        """Marks before which the pattern always cuts after a letter or digit; those of added tokens are none."""
        from tokenizers import models, pre_tokenizers

        cuts = self.library.pre_tokenizer
        usual = isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        if not usual or self.library.normalizer is not None or not isinstance(self.library.model, models.BPE):
            return b""
        added = {c for x in self.library.get_added_tokens_decoder().values() for c in x.content}
        return "".join(c for c in string.punctuation if c != "'" and c not in added).encode()

    @property
    def known(self) -> list[str]:
        """The words of the table without the blank before them; those that follow none are written with one."""
        return self._named(self.words.to_pylist())

    @staticmethod
    def _named(words: Iterable[str]) -> list[str]:
        """The names of words; the words, if names are given."""
        return [x[1:] if x[0] == " " else x if x[0] == "\n" else " " + x for x in words]

    def _add(self, words: list[str], ids: list[np.ndarray], lengths: list[int]) -> None:
        """Words that have so many of ``ids`` each, one after the other."""
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.pool = np.concatenate([self.pool, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int64)])
        self.again = np.append(self.again, np.zeros(len(words), bool))

    def _make_room(self, at: np.ndarray) -> np.ndarray:
        """Words met again stay in a full table, or those of ``at`` alone if they are too many; the new places of ``at``."""
        used = at >= 0
        self.again[at[used]] = True
        if len(self.words) <= self.limit:
            return at
        if 2 * self.again.sum() > self.limit:
            self.again[:] = False
            self.again[at[used]] = True
        places = np.flatnonzero(self.again)
        at = np.where(used, np.searchsorted(places, at), -1)
        lengths = np.diff(self.ends)[places]
        self.pool = _joined(self.pool, self.ends[places], lengths)
        self.words, self.ends = self.words.take(pa.array(places)), np.append(0, np.cumsum(lengths))
        self.again = np.zeros(len(places), bool)
        return at

    def _find(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the table, or -1."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._whole(texts)]

    def _learn(self, words: Iterable[str]) -> None:
        """Adds words, named as in ``known``."""
        words = pa.array(self._named(words), pa.large_string())
        alone = pc.match_substring_regex(words, _LETTERS) if self.marks.any() else pa.array(np.zeros(len(words), bool))
        # such a word is one piece, so the model itself takes it, written in the names of its bytes
        letters, others = words.filter(alone).to_pylist(), words.filter(pc.invert(alone)).to_pylist()
        pieces = "\n".join(letters).encode().decode("latin-1").translate(_NAMES).split(_NAMES[10]) if letters else []
        found = [[x.id for x in self.library.model.tokenize(piece)] for piece in pieces]
        self._add(letters, [np.fromiter(chain.from_iterable(found), "<u4")], [len(x) for x in found])
        ids = self._whole(others)
        self._add(others, ids, [len(x) for x in ids])

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts, which together are the texts, and where in the bytes each text begins and the last ends."""
        _, places, buffer = texts.buffers()
        rows = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8)[rows[0]:rows[-1]] if buffer is not None else np.zeros(0, np.uint8)
        rows = rows - rows[0]
        padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])

        def number(at: np.ndarray, n: int) -> np.ndarray:
            out = padded[at + 3].astype(np.int32)
            for i in range(1, n):
                out = out << 8 | padded[at + 3 + i]
            return out

        edge = np.zeros(len(data) + 1, bool)
        edge[rows] = True
        at = np.flatnonzero((data == 32) | (data == 10))
        at = at[~(edge[at] | edge[at + 1])]
        at = at[~(_SPACE[data[at - 1]] | _SPACE[data[at + 1]])]
        wide = (data[at - 1] >= 0x80) | (data[at + 1] >= 0x80)
        odd = at[wide]
        spaces = np.isin(number(odd - 2, 2), _SPACE_2) | np.isin(number(odd + 1, 2), _SPACE_2)
        spaces |= np.isin(number(odd - 3, 3), _SPACE_3) | np.isin(number(odd + 1, 3), _SPACE_3)
        wide[wide] = spaces
        marks = np.flatnonzero(self.marks[data])
        marks = marks[~edge[marks]]
        pair = number(marks - 2, 2)
        after = _PLAIN[pair & 0xFF] | (_PAIRS[pair >> 8] & ((pair & 0xFF) >= 0x80) & ~np.isin(pair, _SIGNS))
        edge[at[~wide]] = True
        edge[marks[after]] = True
        starts = np.flatnonzero(edge)
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data)))
        return words, rows

    def arrays(self, texts: pa.Array, end: list[int] | None = None) -> list[np.ndarray]:
        """The ids of each text, and ``end`` after them; null is empty."""
        words, rows = self._words(pc.fill_null(texts.cast(pa.large_string()), ""))
        starts = np.frombuffer(words.buffers()[1], np.int64)[:len(words)]
        row = np.searchsorted(rows, starts, side="right") - 1
        # the first word of a text follows neither blank nor word
        first = starts == rows[row]
        at = self._find(words)
        at[first] = -1
        at = self._make_room(at)
        new = np.flatnonzero(~first & (at < 0))
        if len(new):
            missing = words.take(pa.array(new))
            size = len(self.words)
            self._learn(self._named(missing.unique().to_pylist()))
            at[new] = size + pc.index_in(missing, self.words[size:]).to_numpy()
        heads = self._whole(words.filter(pa.array(first)).to_pylist())
        at[first] = len(self.words) + np.arange(len(heads))
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in heads], dtype=np.int64)])
        lengths = ends[at + 1] - ends[at]
        ids = _joined(np.concatenate([self.pool, *heads]), ends[at], lengths)
        upto = np.cumsum(np.bincount(row, lengths, len(texts)).astype(np.int64))
        if end:
            ids = np.insert(ids, np.repeat(upto, len(end)), np.tile(np.array(end, "<u4"), len(texts)))
            upto += len(end) * np.arange(1, len(texts) + 1)
        return np.split(ids, upto[:-1])[:len(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.arrays(pa.array(texts, pa.large_string()))]


@lru_cache(maxsize=1)
def _encoder(path: str | None) -> Encoder:
    """The encoder of this Python worker: a task takes over the words that those before it looked up."""
    return Encoder(path)


def encoded(batches: Iterable[pa.RecordBatch], path: str | None, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with a text column, and the ids of each text followed by ``end_id``; null is empty."""
    from knotmeter.llm.common import slices

    encoder = _encoder(path)
    for batch in slices(batches, limit=SLICE):
        yield batch, encoder.arrays(batch.column(batch.schema.get_field_index("text")), [end_id])
