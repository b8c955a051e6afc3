"""Byte-pair merges of many words at once, from a public tokenizer's own vocabulary and merge list.

A word's symbols are a row of a matrix. In each round every row that can still merge replaces its leftmost pair of the
lowest rank, which is what a queue per word does; only the two pairs beside it get new ranks. Words that a normaliser could
treat by more than case and composition go through the tokenizer itself, as do special tokens.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_NONE, _BITS = np.int32(1 << 30), 19
#: Letters whose lower case depends on context or is longer than one character, scripts past Latin, and the bracket of special tokens.
_ODD = regex.compile(r"[Σİ\u0250-\U0010FFFF]|<\|")
_STOPS = frozenset(".,!;:?")
_ROWS, _LONGEST = 8192, 48


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class WordMerges:
    """Ids of pre-split, lower-cased words with the ``</w>`` mark on the last symbol."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters, end = model["vocab"], _byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, _NONE, np.int32)
        self.reach = 1
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 20 | vocab[b]
            slot, n = int(self._slot(np.array([key], np.int64))[0]), 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & (1 << _BITS) - 1, n + 1
            self.keys[slot], self.ranks[slot], self.reach = key, rank, max(self.reach, n)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; pads are negative and have none."""
        key = np.where((a < 0) | (b < 0), np.int64(-2), a.astype(np.int64) << 20 | b)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0) & (key >= 0))
        for n in range(1, self.reach):
            if not len(open_):
                break
            at = (slot[open_] + n) & (1 << _BITS) - 1
            held = self.keys[at]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def words(self, parts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each non-empty part."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.array(list(map(len, parts)), np.int64)
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), _ROWS):
            chunk = order[at : at + _ROWS]
            size = sizes[chunk]
            wide = int(size.max()) + 1
            cols = np.arange(wide)
            flat = np.frombuffer(b"".join([parts[i] for i in chunk.tolist()]), np.uint8)
            rows = np.full((len(chunk), wide), -1, np.int32)
            rows[cols < size[:, None]] = self.inner[flat]
            rows[np.arange(len(chunk)), size - 1] = self.last[flat[np.cumsum(size) - 1]]
            ranks = self.rank(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(chunk), wide - 1)
            ids = chunk
            while len(ids):
                n = np.arange(len(ids))
                best = ranks.argmin(axis=1)
                low = ranks[n, best]
                done = low == _NONE
                if done.any():
                    full = rows[done]
                    real = full >= 0
                    flat_ids, ends = full[real].astype("<u4").tobytes(), (4 * np.cumsum(real.sum(axis=1))).tolist()
                    for i, a, b in zip(ids[done].tolist(), [0, *ends], ends):
                        out[i] = flat_ids[a:b]
                    go = ~done
                    ids, rows, ranks, best, low = ids[go], rows[go], ranks[go], best[go], low[go]
                    if not len(ids):
                        break
                    n = np.arange(len(ids))
                    keep = max(2, int((rows >= 0).sum(axis=1).max()) + 1)
                    rows, ranks = rows[:, :keep], ranks[:, : keep - 1]
                after = np.arange(rows.shape[1] - 1) > best[:, None]
                rows = np.concatenate([np.where(after, rows[:, 1:], rows[:, :-1]), np.full((len(ids), 1), -1, np.int32)], axis=1)
                rows[n, best] = self.made[low]
                ranks = np.concatenate([np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1]), np.full((len(ids), 1), _NONE, np.int32)], axis=1)
                left = np.maximum(best - 1, 0)
                fresh = self.rank(np.concatenate([np.where(best > 0, rows[n, left], -1), rows[n, best]]), np.concatenate([rows[n, best], rows[n, best + 1]]))
                ranks[n, left] = np.where(best > 0, fresh[: len(ids)], ranks[n, left])
                ranks[n, best] = fresh[len(ids) :]
        return out

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each token between white space, as the tokenizer gives them."""
        text = b"\n".join(tokens).decode()
        odd = set()
        if _ODD.search(text) or max(map(len, tokens), default=0) > _LONGEST:
            odd = {i for i, t in enumerate(tokens) if len(t) > _LONGEST or _ODD.search(t.decode())}
            text = "\n".join(["" if i in odd else t.decode() for i, t in enumerate(tokens)])
        whole = unicodedata.normalize("NFC", text).lower().split("\n") if tokens else []
        split = {}
        for i, plain in enumerate(map(str.isalpha, whole)):
            if not plain:
                s = whole[i]
                split[i] = (s[:-1], s[-1]) if s[-1:] in _STOPS and s[:-1].isalpha() else _SPLIT.findall(s)
        # a token that isn't split is a part; one that is can't equal a part
        distinct = list(set().union(whole, *split.values()).difference(whole[i] for i in split) | set().union(*split.values()))
        ids = dict(zip(distinct, self.words(list(map(str.encode, distinct)))))
        get = ids.__getitem__
        out = list(map(ids.get, whole))
        for i, parts in split.items():
            out[i] = b"".join(map(get, parts))
        rest = sorted(odd)
        for i, e in zip(rest, self.whole.encode_batch_fast([tokens[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out
