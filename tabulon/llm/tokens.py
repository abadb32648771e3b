"""Token ids of whole texts with the tokenizers library, each distinct white-space-delimited chunk encoded once.

The vocabularies served here treat a chunk between ASCII white space without regard to its neighbours, so the ids of
a text are those of its chunks in order. Each worker keeps the ids of the chunks that it has met, by a 64-bit hash.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa

from tabulon.llm.kernels import buffers, span_hashes, word_bounds

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s\x80-\U0010ffff]*)")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class ChunkTokenizer:
    """Ids of texts, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, cache_chunks: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = cache_chunks
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        self.chars = _byte_chars()
        # The direct way to the model holds for lower-casing byte-level vocabularies with word ends only.
        self.direct = "lower" in str(self.tok.normalizer).lower() and getattr(self.tok.model, "end_of_word_suffix", None) == "</w>"
        self.words: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _model(self, piece: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize("".join(self.chars[b] for b in piece.encode()))]

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(chunks)
        slow = []
        for i, c in enumerate(chunks):
            m = _PLAIN.fullmatch(c) if self.direct else None
            if m and "'" not in m[2] and "<|" not in m[2]:
                tail = m[2]
                ids = self._model(m[1].lower())
                if tail:
                    if (t := self.words.get(tail)) is None:
                        t = self.tok.encode(tail, add_special_tokens=False).ids
                        if len(self.words) < 10_000:
                            self.words[tail] = t
                    ids = ids + t
                out[i] = ids
            else:
                slow.append(i)
        for i, e in zip(slow, self.tok.encode_batch_fast([chunks[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, h: np.ndarray, chunks: list[str]) -> None:
        """Adds chunks with the sorted hashes h."""
        ids = self._encode(chunks)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), self.dtype, int(n.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        to = np.searchsorted(self.keys, h)
        self.keys, self.at, self.len = np.insert(self.keys, to, h), np.insert(self.at, to, at), np.insert(self.len, to, n)

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large_string, no nulls) in order, and the n + 1 offsets of the texts in them."""
        data, off = buffers(arr)
        start, end, woff = word_bounds(data, off)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        coded = pa.array(span_hashes(data, start, end, lower=False)).dictionary_encode()
        inv, u = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(u)
        if len(self.keys) + len(u) > self.most and len(self.keys) > self.most // 4:
            self._clear()
        su = u[order]
        pos = np.searchsorted(self.keys, su)
        have = np.zeros(len(su), bool)
        if len(self.keys):
            have = self.keys[np.minimum(pos, len(self.keys) - 1)] == su
        if not have.all():
            first = np.empty(len(u), np.int64)
            first[inv[::-1]] = np.arange(len(inv) - 1, -1, -1)
            new = first[order[~have]]
            raw = data.tobytes()
            self._learn(su[~have], [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            pos = np.searchsorted(self.keys, su)
        at, n = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
        at[order], n[order] = self.at[pos], self.len[pos]
        n, at = n[inv], at[inv]
        cum = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at - cum[:-1], n) + np.arange(cum[-1])]
        return ids, cum[woff]


_loaded: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """This worker's tokenizer of the file; kept between tasks."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def with_end(ids: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each text, and the new offsets."""
    to = off + np.arange(len(off))
    out = np.empty(int(to[-1]), ids.dtype)
    keep = np.ones(len(out), bool)
    keep[to[1:] - 1] = False
    out[keep] = ids
    out[~keep] = end
    return out, to


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
