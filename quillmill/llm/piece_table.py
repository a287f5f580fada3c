"""A bounded table from short pieces of text to their runs of ids, looked up many at a time.

A piece is a delimiter byte (space or \\n) and what follows it up to the next, or the single mark that
ends such a word after a letter or digit. Pieces of at most ``KEY_BYTES`` bytes are their own keys,
as three 64-bit numbers, so that no two pieces are ever taken for one another; the hash only says
where to look. Texts with a zero byte and longer pieces are the caller's.
"""

from __future__ import annotations

import string

import numpy as np

KEY_BYTES = 24
#: Marks that are cut from a word; the apostrophe doesn't always part from what stands before it.
MARKS = string.punctuation.replace("'", "")
_DELIMITER, _MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DELIMITER[[32, 10]] = _MARK[[*MARKS.encode()]] = _LETTER[[*(string.ascii_letters + string.digits).encode()]] = True
#: Second bytes of U+00C0 to U+00FF, which are letters but for two.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def cut(octets: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces begin, their lengths, and the keys of those that aren't longer than ``KEY_BYTES``."""
    padded = np.frombuffer(octets + bytes(40 - len(octets) % 8), np.uint8)
    at = np.flatnonzero(_DELIMITER[padded])
    ends = np.append(at[1:], len(octets))
    marks = np.flatnonzero(_MARK[padded[ends - 1]])
    last = ends[marks] - 1
    # Of a piece that is a mark only, the byte before it is its delimiter.
    before, second = padded[last - 1], padded[last - 2]
    last = last[_LETTER[before] | (_LATIN[before] & (second == 0xC3))]
    at = np.sort(np.concatenate([at, last]), kind="stable")
    length = np.diff(at, append=len(octets))
    words, word, shift = padded.view("<u8"), at >> 3, ((at & 7) << 3).astype(np.uint64)
    back, keys = np.uint64(63) - shift, np.empty((len(at), 3), np.uint64)
    here = words[word]
    for k in range(3):
        after = words[np.minimum(word + k + 1, len(words) - 1)]
        keys[:, k] = ((here >> shift) | ((after << np.uint64(1)) << back)) & _MASKS[np.clip(length - 8 * k, 0, 8)]
        here = after
    return at, length, keys


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one run after another."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class PieceTable:
    """Open addressing; when ``most`` pieces are held, those not met again since the last time are dropped."""

    def __init__(self, most: int):
        self.most = most
        self._empty(most)

    def _empty(self, room: int) -> None:
        self.bits = max(4, (4 * max(room, self.most) // 3).bit_length())
        self.rows = np.zeros((1 << self.bits, 3), np.uint64)
        self.runs = np.zeros((1 << self.bits, 2), np.int32)
        self.met = np.zeros(1 << self.bits, bool)
        self.ids, self.end, self.count = np.empty(1024, np.uint32), 0, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _FACTORS[0] ^ keys[:, 1] * _FACTORS[1] ^ keys[:, 2] * _FACTORS[2]
        h = (h ^ (h >> np.uint64(29))) * _FACTORS[3]
        return ((h ^ (h >> np.uint64(32))) * _FACTORS[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether the key is there."""
        slot, there = self._slots(keys), np.zeros(len(keys), bool)
        left, at, want = np.arange(len(keys)), slot, keys
        while len(left):
            rows = self.rows[at]
            same = (rows[:, 0] == want[:, 0]) & (rows[:, 1] == want[:, 1]) & (rows[:, 2] == want[:, 2])
            there[left[same]] = True
            on = ~same & (rows[:, 0] != 0)
            left = left[on]
            at = slot[left] = (at[on] + 1) & (len(self.rows) - 1)
            want = want[on]
        return slot, there

    def place(self, ids: np.ndarray) -> int:
        """Puts ids behind all runs, where they stay until others are placed or added."""
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.end : self.end + len(ids)] = ids
        return self.end

    def add(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray, needed: np.ndarray) -> bool:
        """Distinct keys that aren't there, with their ids one run after another. True if others' slots changed.

        ``needed`` are slots that are kept in any case.
        """
        anew = self.count + len(keys) > self.most
        if anew:
            kept = np.flatnonzero(self.met)
            if 2 * len(kept) > self.most:
                kept = np.unique(needed)
            old, runs = self.rows[kept], self.runs[kept].astype(np.int64)
            old_ids = self.ids[spread(runs[:, 0], runs[:, 1])]
            self._empty(len(kept) + len(keys))
            self._put(old, old_ids, runs[:, 1])
        self._put(keys, ids, length)
        return anew

    def _put(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        start = self.place(ids) + np.cumsum(length) - length
        self.end += len(ids)
        self.count += len(keys)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.rows[slot, 0] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.rows[slot[own]] = keys[left[own]]
            self.runs[slot[own], 0], self.runs[slot[own], 1] = start[left[own]], length[left[own]]
            rest = np.ones(len(left), bool)
            rest[own] = False
            slot, left = (slot[rest] + 1) & (len(self.rows) - 1), left[rest]
