"""Token ids of whole texts, by columns, with a bounded cache of words.

The vocabulary's rules never join characters across ASCII white space, so a
text's ids are the ids of its white-space-separated words in order. Arrow cuts
a group of texts into words and numbers the distinct ones; only those are
looked at, as columns too. A word of plain letters, with closing punctuation or
without, is also the ids of its letters and then of its punctuation; new letters
are encoded many at a time, as one string, and cut where a token ends a word.
All other words are encoded by themselves, and texts that hold the opening of a
special token go through whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 300_000  # of letters, and of other words
CACHE_BYTES = 16_000_000  # of their ids and of themselves
GROUP_BYTES = 4_000_000
BATCH_BYTES = 10_000  # in one call of the library
BLOCK_WORDS = 1 << 18
_ENCODERS: dict[str, WordEncoder] = {}

_BYTES = np.arange(256)
_LETTER = np.isin(_BYTES, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_AFTER_C3 = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & (_BYTES != 0x97) & (_BYTES != 0xB7)  # with C3 before: Latin-1 letters in UTF-8
_MARK = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_LETTER & ~np.isin(_BYTES, np.frombuffer(b"'0123456789", np.uint8))
_LOWER = (_BYTES + 32 * ((_BYTES >= 0x41) & (_BYTES <= 0x5A) | (_BYTES >= 0x80) & (_BYTES <= 0x9E))).astype(np.uint8)  # of letters' bytes


def _before(counts: np.ndarray) -> np.ndarray:
    """Sums of the counts before each, and of all."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[starts[i]:starts[i] + counts[i]]`` one after the other."""
    at = _before(counts)
    return values[np.arange(at[-1]) + np.repeat(starts - at[:-1], counts)]


def _strings(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.DictionaryArray:
    offsets = _before(counts).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(_runs(data, starts, counts))]).dictionary_encode()


def _slices(strings: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive rows of at most ``most`` bytes, or one row."""
    bounds, at = _before(pc.binary_length(strings).fill_null(0).to_numpy()), 0
    while at < len(strings):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield strings.slice(at, end - at)
        at = end


class WordCache:
    """Ids of words met lately; ``encode`` gives counts and ids of new ones."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], width: np.dtype):
        self.encode = encode
        self.words, self.counts, self.ids = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, width)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and number of those of each of the (distinct) words."""
        at = pc.index_in(words, value_set=self.words)
        new, place = words.filter(pc.is_null(at)), at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            place[place < 0] = len(self.words) + np.arange(len(new))
            counts, ids = self.encode(new)
            self.words, self.counts, self.ids = pa.concat_arrays([self.words, new]), np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        out = self.ids, _before(self.counts)[place], self.counts[place]
        if len(self.words) > CACHE_WORDS or self.words.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.words, self.counts, self.ids = words, out[2], _runs(*out)
        return out


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # Lower-case letters need no normaliser; without one the library is three times as fast.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters = WordCache(self._letters, self.width)
        self.others = WordCache(self._each, self.width)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for some in _slices(words, BATCH_BYTES):
            own = [np.array(x.ids, self.width) for x in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            counts += map(len, own)
            ids += own
        return np.array(counts, np.int64), np.concatenate(ids)

    def _letters(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for some in _slices(stems, BATCH_BYTES):
            own = np.array(self.plain.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids, self.width)
            cuts = np.flatnonzero(self.ends[own]) + 1
            if len(cuts) != len(some):  # a vocabulary without word ends
                return self._each(stems)
            counts.append(np.diff(cuts, prepend=0))
            ids.append(own)
        return np.concatenate(counts), np.concatenate(ids)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each (distinct) word: counts, and all ids."""
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
        data = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
        at = at.astype(np.int64) - at[0]
        start, size = at[:-1], np.diff(at)
        letter = _LETTER[data]
        wide = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
        letter[:-1] |= wide
        letter[1:] |= wide
        upto = _before(letter)
        n = upto[at[1:]] - upto[start]
        marks = _before(_MARK[data])
        plain = (upto[start + n] - upto[start] == n) & (n + marks[at[1:]] - marks[start] == size)  # letters, then marks
        n[~plain] = 0
        head, tail = n > 0, size > n
        stems, others = _strings(_LOWER[data], start[head], n[head]), _strings(data, (start + n)[tail], (size - n)[tail])
        stem_ids, stem_at, stem_n = self.letters.look(stems.dictionary)
        other_ids, other_at, other_n = self.others.look(others.dictionary)
        starts, counts = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        k, m = stems.indices.to_numpy(), others.indices.to_numpy()
        starts[head, 0], counts[head, 0] = stem_at[k], stem_n[k]
        starts[tail, 1], counts[tail, 1] = other_at[m] + len(stem_ids), other_n[m]
        return counts.sum(1), _runs(np.concatenate([stem_ids, other_ids]), starts.ravel(), counts.ravel())

    def _texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        words = lists.flatten().dictionary_encode()
        codes, bounds = words.indices.to_numpy(), lists.offsets.to_numpy()
        counts, ids = self._words(words.dictionary)
        starts = _before(counts)[:-1]
        at = _before(counts[codes])
        out = np.empty(at[-1], self.width)
        for a in range(0, len(codes), BLOCK_WORDS):
            c = codes[a:a + BLOCK_WORDS]
            out[at[a]:at[a + len(c)]] = _runs(ids, starts[c], counts[c])
        ends = at[bounds]
        sizes = np.diff(ends)
        parts, done = [], 0
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            own = self._ids(texts[i].as_py())
            parts += [out[done:ends[i]], own]
            done, sizes[i] = ends[i], len(own)
        return sizes, np.concatenate([*parts, out[done:]]) if parts else out

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' ids without special tokens (null: none), by groups of rows in order: the number of each text's ids, and all ids."""
        for some in _slices(texts, GROUP_BYTES):
            yield self._texts(some.fill_null("").cast(pa.string()))

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text without special tokens."""
        return [x for counts, ids in self.encode_column(pa.array(texts, pa.string())) for x in np.split(ids, _before(counts)[1:-1])]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts, and their ids with ``end_id`` after each text."""
    bounds = _before(counts + 1)
    out, own = np.full(bounds[-1], end_id, ids.dtype), np.ones(bounds[-1], bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    return bounds, out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
