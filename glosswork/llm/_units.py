"""Ids of texts by way of units that no token crosses; a worker remembers the ids of the units it has seen."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Different units whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Characters of remembered units, on average, and of one that is remembered for longer than until the next clearing.
UNIT_CHARS, LONGEST = 40, 200


class _Numbers(dict):
    """The number of each unit; one that is asked for first gets the next number and waits in `fresh` for its ids."""

    def __init__(self, units: list[str]):
        super().__init__(zip(units, range(len(units)), strict=True))
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class Units:
    def __init__(self, split: Callable[[str], list[str]], learn: Callable[[list[str]], tuple[list[list[int]], list[int]]], remembered: int = REMEMBERED, decode: Callable[[list[list[int]]], list[str]] | None = None):
        """split: a text's units, whose ids one after another are the text's; learn: the ids of units, and a flag for each; decode: the text of each of many lists of ids."""
        self.split, self.learn, self.remembered, self.decode = split, learn, remembered, decode
        self._number, self._text, self._chars = _Numbers([]), [], 0
        self._ids, self._used = np.zeros(1 << 20, np.uint32), 0
        self._begin, self._size, self._flag, self._uses = (np.zeros(0, np.int64) for _ in range(4))

    def _gather(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units numbered n, one unit after another, and each unit's offset among them."""
        size = self._size[n]
        before = np.concatenate([[0], np.cumsum(size)])
        return self._ids[np.repeat(self._begin[n] - before[:-1], size) + np.arange(before[-1])], before

    def _clear(self) -> None:
        """Forget what was used once since the last time; of what was used more often, half of what may be remembered stays at most."""
        units = list(self._number)
        kept = np.argsort(-self._uses, kind="stable")[: self.remembered // 2]
        kept = kept[self._uses[kept] > 1]
        kept = np.array([k for k in np.sort(kept).tolist() if len(units[k]) <= LONGEST], np.int64)
        ids, before = self._gather(kept)
        units = [units[k] for k in kept.tolist()]
        self._number, self._chars = _Numbers(units), sum(map(len, units))
        if self.decode:
            self._text = [self._text[k] for k in kept.tolist()]
        self._ids, self._used = np.concatenate([ids, np.zeros(1 << 20, np.uint32)]), len(ids)
        self._begin, self._size, self._flag = before[:-1], self._size[kept], self._flag[kept]
        self._uses = np.zeros(len(kept), np.int64)

    def _learn(self) -> None:
        units, self._number.fresh = self._number.fresh, []
        new, flags = self.learn(units)
        if self.decode:
            self._text += self.decode(new)
        size = np.fromiter(map(len, new), np.int64, len(new))
        total = int(size.sum())
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + total] = np.fromiter((i for x in new for i in x), np.uint32, total)
        self._begin = np.concatenate([self._begin, self._used + np.cumsum(size) - size])
        self._size = np.concatenate([self._size, size])
        self._flag = np.concatenate([self._flag, np.array(flags, np.int64)])
        self._uses = np.concatenate([self._uses, np.zeros(len(units), np.int64)])
        self._used += total
        self._chars += sum(map(len, units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """All ids one after another, each text's offset among them, the sum of its units' flags, and what its ids decode to."""
        if len(self._number) > self.remembered or self._chars > UNIT_CHARS * self.remembered:
            self._clear()
        flat: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                flat += self.split(text)
            ends.append(len(flat))
        n, ends_ = np.fromiter(map(self._number.__getitem__, flat), np.int64, len(flat)), np.array(ends, np.int64)
        if self._number.fresh:
            self._learn()
        self._uses += np.bincount(n, minlength=len(self._uses))
        ids, before = self._gather(n)
        flags = np.concatenate([[0], np.cumsum(self._flag[n])])
        back: list[str] = []
        if self.decode:
            told = list(map(self._text.__getitem__, n.tolist()))
            back = ["".join(told[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        return ids, before[ends_], flags[ends_[1:]] - flags[ends_[:-1]], back
