"""Byte-pair encoding of whole chunks of text at once, with the ids of the tokenizers library.

For vocabularies with word ends whose normalizer lower-cases and whose words are runs of
letters, single digits and runs of other characters: the distinct words of a chunk are
encoded side by side, in every round the best merge of each word, so no word is encoded
twice. Space-separated pieces that hold anything but ASCII and Latin-1 letters, or quotes
and markup with rules of their own, go through the library itself. The tests hold both
against the library's ids.
"""

from __future__ import annotations

import json

import numpy as np

from lodestone.llm import common

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
#: Bytes that leave a piece to the library: controls, quotes of contractions, the mark that begins special tokens.
_OWN = [c for c in range(32) if not 9 <= c <= 13] + [0x27, 0x3C, 0x7F]
#: Longer words are left to the library.
WORD_BYTES = 48
#: Pieces of the library's share that a worker remembers.
REMEMBERED = 50_000

_KIND = np.full(256, _OTHER, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER


class Encoder:
    made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, list[int]] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        # the level shows each byte as one character: ASCII as they are written, the rest by characters that contain them
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        for c in range(0x800):
            if not 0xD800 <= c < 0xE000:
                for byte, shown in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]):
                    self.inner[byte] = vocab[shown]
        text_of = {i: t for t, i in vocab.items()}
        for c in range(256):
            self.final[c] = vocab[text_of[int(self.inner[c])] + suffix]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 20
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        left = np.arange(len(keys))
        place = self._hash(keys)
        while len(left):
            free = self.slots[place[left]] < 0
            _, one = np.unique(place[left], return_index=True)
            first = np.zeros(len(left), bool)
            first[one] = True
            put = left[free & first]
            self.slots[place[put]], self.ranks[place[put]] = keys[put], put
            left = left[~(free & first)]
            taken = self.slots[place[left]] != keys[left]
            left = left[taken]  # a merge that is listed twice keeps its first rank
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number beyond all ranks."""
        out = np.full(len(keys), len(self.merged), np.int64)
        place = self._hash(keys)
        have = self.slots[place]
        hit = have == keys
        out[hit] = self.ranks[place[hit]]
        left = np.flatnonzero(~hit & (have >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            have = self.slots[place[left]]
            hit = have == keys[left]
            out[left[hit]] = self.ranks[place[left[hit]]]
            left = left[~hit & (have >= 0)]
        return out

    def merge(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as symbols in order, with the word of each symbol; result: ids and cuts."""
        none = len(self.merged)
        ids, owners = [], []
        while len(symbols):
            same = word[1:] == word[:-1]
            rank = np.full(len(symbols), none, np.int64)
            at = np.flatnonzero(same)
            rank[at] = self.rank(symbols[at] << 20 | symbols[at + 1])
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.concatenate([begin, [len(symbols)]]))
            spread = np.repeat(best, sizes)
            done = spread == none
            ids.append(symbols[done])
            owners.append(word[done])
            mark = (rank == spread) & ~done
            # of equal pairs that overlap, every other one from the left
            chain = np.flatnonzero(mark[1:] & mark[:-1])
            for i in chain.tolist():
                if mark[i]:
                    mark[i + 1] = False
            at = np.flatnonzero(mark)
            symbols[at] = self.merged[rank[at]]
            drop = done
            drop[at + 1] = True
            symbols, word = symbols[~drop], word[~drop]
        ids_, owner = np.concatenate(ids or [np.empty(0, np.int64)]), np.concatenate(owners or [np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return ids_[order], np.searchsorted(owner[order], np.arange(words + 1))

    def slow(self, piece: bytes) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[piece] = self.library.encode(piece.decode(), add_special_tokens=False).ids
        return found

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row as uint32, and where each text's begin."""
        texts = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(texts + 1, np.int64)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        kind = _KIND[data]
        odd = data >= 128
        odd |= np.isin(data, _OWN)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        plain = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[plain], after[plain]
        for at in (lead, lead + 1):
            odd[at] = False
            kind[at] = _LETTER
        low[lead + 1] = np.where(after <= 0x9E, after + 0x20, after)
        fresh = np.zeros(len(data), bool)
        fresh[offsets[:-1][np.diff(offsets) > 0]] = True
        begin_piece = (kind != _SPACE) & fresh
        begin_piece[1:] |= (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)
        begin = begin_piece | ((kind != _SPACE) & (kind == _DIGIT))
        begin[1:] |= (kind[1:] != _SPACE) & (kind[1:] != kind[:-1])
        final = np.zeros(len(data), bool)
        final[:-1] = (kind[:-1] != _SPACE) & (begin[1:] | (kind[1:] == _SPACE))
        final[-1] = kind[-1] != _SPACE
        starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(texts + 1, np.int64)
        piece_at = np.flatnonzero(begin_piece)
        piece = np.searchsorted(piece_at, starts, side="right") - 1
        last = np.flatnonzero(np.concatenate([piece[1:] != piece[:-1], [True]]))
        piece_end = ends[last]
        odds = np.concatenate([[0], np.cumsum(odd)])
        strange = odds[piece_end] > odds[piece_at]
        longest = np.maximum.reduceat(ends - starts, np.concatenate([[0], last[:-1] + 1]))
        strange |= longest > WORD_BYTES
        keep = ~strange[piece]
        starts, ends = starts[keep], ends[keep]
        hashes = common.word_hashes(low, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends[first] - starts[first]
        word = np.repeat(np.arange(len(first)), size)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        spelled = low[starts[first][word] + inside]
        symbols = np.where(inside == size[word] - 1, self.final[spelled], self.inner[spelled])
        ids, cuts = self.merge(symbols, word, len(first))
        # what the library encodes comes in as further entries, in the order of the text
        raw = data.tobytes() if strange.any() else b""
        own = [self.slow(raw[a:b]) for a, b in zip(piece_at[strange].tolist(), piece_end[strange].tolist())]
        entry = np.concatenate([which.ravel(), len(first) + np.arange(len(own))])
        at = np.concatenate([starts, piece_at[strange]])
        order = np.argsort(at, kind="stable")
        entry, at = entry[order], at[order]
        ids = np.concatenate([ids, np.array([i for o in own for i in o], np.int64)])
        cuts = np.concatenate([cuts, cuts[-1] + np.cumsum([len(o) for o in own], dtype=np.int64)])
        counts = np.diff(cuts)[entry]
        total = np.concatenate([[0], np.cumsum(counts)])
        gather = np.arange(total[-1]) + np.repeat(cuts[:-1][entry] - total[:-1], counts)
        return ids[gather].astype("<u4"), total[np.searchsorted(at, offsets)]
