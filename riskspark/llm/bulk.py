"""The lazily determinised transducer of ``bpe``, run for many pieces in lockstep.

States, transitions and checked pairs lie in arrays.  All pieces read their next byte together; the
transitions no piece has taken before are determinised together: their paths step through the
vocabulary trie, the pairs of tokens not met before are checked one by one, and equal path lists become one
state.  Results and definitions are those of ``bpe.Transducer``, which takes the pieces that are too long.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)


class Table:
    """Open-addressing map of non-negative 64-bit keys to 32-bit values, for whole arrays of keys."""

    def __init__(self, room: int = 1 << 12):
        self._clear(room)

    def _clear(self, room: int) -> None:
        self.used, self.mask = 0, room - 1
        self.shift = np.uint64(64 - room.bit_length() + 1)
        self.keys, self.values = np.full(room, _EMPTY), np.zeros(room, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (held != _EMPTY)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not there yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys != _EMPTY
            old_keys, old_values, room = self.keys[old], self.values[old], len(self.keys)
            while 2 * (self.used + len(keys)) > room:
                room *= 2
            self._clear(room)
            self.put(old_keys, old_values)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == _EMPTY]
            self.keys[slot[free]] = keys[free]  # of several that want one slot the last gets it
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.used += len(keys)


class _Rows:
    """Growing array."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.zeros(max(len(more), len(self.data)) + len(more), self.data.dtype)])
        self.data[self.n:self.n + len(more)] = more
        self.n += len(more)


class BulkTransducer:
    """Encodes lists of pieces; ``machine`` is the ``bpe.Transducer`` whose vocabulary and pair rule it uses."""

    def __init__(self, machine, max_states: int = 120_000, max_pairs: int = 250_000):
        self.machine, self.max_states, self.max_pairs = machine, max_states, max_pairs
        edges = [(node << 8 | byte, child) for node, row in enumerate(machine.kids) for byte, child in row.items()]
        self.trie = Table()
        self.trie.put(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32))
        self.token_at = np.array(machine.token_at, np.int64)
        self.inner = np.array([bool(row) for row in machine.kids])
        self.size = np.zeros(max(machine.size, default=0) + 1, np.int64)
        for tok, n in machine.size.items():
            self.size[tok] = n
        self.pairs = Table()
        self.reset()

    def reset(self) -> None:
        """Forget all states but the start."""
        self.steps, self.known = Table(), Table()
        self.paths, self.first, self.count, self.end, self.check = (_Rows(t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
        self._states(np.zeros(1, np.int64), np.array([1]), np.array([-1]))

    def forget(self) -> None:
        self.reset()
        self.pairs = Table()

    def _states(self, flat: np.ndarray, count: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the states with these path lists (``count`` each, one after the other), new ones added."""
        first = np.cumsum(count) - count
        place = (np.arange(len(flat)) - np.repeat(first, count)).astype(np.uint64)
        marks = []
        for seed in (1, 2):
            v = (flat.astype(np.uint64) + place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)) * _MIX
            v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            v = (v ^ (v >> np.uint64(29))) * _MIX
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v ^ (v >> np.uint64(32)), dtype=np.uint64)])
            marks.append(total[first + count] - total[first])
        name = (marks[0] >> np.uint64(1)).astype(np.int64)
        uniq, at, back = np.unique(name, return_index=True, return_inverse=True)
        number = self.known.get(uniq)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self.first.n + np.arange(len(new))
            self.known.put(uniq[new], number[new])
            take = at[new]
            pick = np.repeat(first[take], count[take]) + (np.arange(count[take].sum()) - np.repeat(np.cumsum(count[take]) - count[take], count[take]))
            self.first.add(self.paths.n + np.cumsum(count[take]) - count[take])
            self.paths.add(flat[pick])
            self.count.add(count[take])
            self.end.add(end[take])
            self.check.add(marks[1][take])
        out = number[back].astype(np.int64)
        if (self.check.data[out] != marks[1]).any():
            raise RuntimeError("two path lists with one 63-bit name")  # 1 in 10^7 runs of a million states
        return out

    def _valid(self, pair: np.ndarray) -> np.ndarray:
        """Which (token it comes after) + 1 << 24 | token may stand."""
        known = self.pairs.get(pair)
        new = np.unique(pair[known < 0])
        if len(new):
            may = self.machine.may_follow
            self.pairs.put(new, np.array([may((p >> 24) - 1, p & 0xFFFFFF) for p in new.tolist()], np.int32))
            known = self.pairs.get(pair)
        return known == 1

    def _determinise(self, keys: np.ndarray) -> np.ndarray:
        """States behind different keys (state << 8 | byte) that no piece has taken before."""
        state, byte = keys >> 8, keys & 255
        n = self.count.data[state]
        owner = np.repeat(np.arange(len(keys)), n)
        path = self.paths.data[np.repeat(self.first.data[state] - (np.cumsum(n) - n), n) + np.arange(len(owner))]
        child = self.trie.get((path & 0xFFFFFF) << 8 | byte[owner]).astype(np.int64)
        alive = child >= 0
        owner, path, child = owner[alive], path[alive], child[alive]
        after, tok = path >> 24 << 24, self.token_at[child]
        end = np.full(len(keys), -1)
        todo = np.flatnonzero(tok >= 0)
        while len(todo):  # a prefix has one encoding: the first path whose token may stand ends it
            lead = np.ones(len(todo), bool)
            lead[1:] = owner[todo[1:]] != owner[todo[:-1]]
            ask = todo[lead]
            ok = self._valid(after[ask] | tok[ask])
            end[owner[ask[ok]]] = tok[ask[ok]]
            todo = todo[~lead]
            todo = todo[end[owner[todo]] < 0]
        goes = self.inner[child]
        closed = np.flatnonzero(end >= 0)
        owner = np.concatenate([owner[goes], closed])
        flat = np.concatenate([after[goes] | child[goes], (end[closed] + 1) << 24])
        order = np.argsort(owner, kind="stable")
        out = self._states(flat[order], np.bincount(owner, minlength=len(keys)), end)
        self.steps.put(keys, out.astype(np.int32))
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece (none empty)."""
        if self.first.n > self.max_states:
            self.reset()
        if self.pairs.used > self.max_pairs:
            self.pairs = Table()
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        start = (np.cumsum(lengths) - lengths)[order]
        longest = int(size[0]) if len(size) else 0
        ends = np.zeros((longest, len(size)), np.int32)
        state = np.zeros(len(size), np.int64)
        for i in range(longest):
            n = int(np.searchsorted(-size, -i, side="left"))  # pieces with more than i bytes
            key = state[:n] << 8 | data[start[:n] + i]
            step = self.steps.get(key).astype(np.int64)
            new = np.flatnonzero(step < 0)
            if len(new):
                uniq, back = np.unique(key[new], return_inverse=True)
                step[new] = self._determinise(uniq)[back]
            state[:n] = step
            ends[i, :n] = self.end.data[step]
        # every piece read backwards: the token that ends it, then the one that ends what stands before
        at, row, rounds = size.copy(), np.arange(len(size)), []
        while len(row):
            tok = ends[at[row] - 1, row]
            rounds.append((row, tok))
            at[row] -= self.size[tok]
            row = row[at[row] > 0]
        n = np.zeros(len(size), np.int64)
        for r, _ in rounds:
            n[r] += 1
        stop = np.cumsum(n)
        flat = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        for back, (r, tok) in enumerate(rounds):
            flat[stop[r] - 1 - back] = tok
        ids, out = flat.tolist(), [None] * len(pieces)
        for place, a, b in zip(order.tolist(), (stop - n).tolist(), stop.tolist()):
            out[place] = ids[a:b]
        return out
