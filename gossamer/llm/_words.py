"""A worker's bounded memory of words and of what an operator derives from each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A word memory forgets everything and starts anew beyond so many words.
MOST = 300_000


class Memory:
    """Numbers words; derive(words) gives their values, one after the other, and how many each word has."""

    def __init__(self, derive: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST):
        self.derive, self.most = derive, most
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = self.at = self.size = None

    def codes(self, split: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's words; they hold until the next call."""
        known: set[str] = set()
        for x in split:
            known.update(x)
        new = [w for w in known if w not in self.code]
        if self.code and len(self.code) + len(new) > self.most:
            self.forget()
            new = list(known)
        if new or self.flat is None:
            flat, size = self.derive(new)
            at = np.cumsum(size) - size
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            if self.flat is None:
                self.flat, self.at, self.size = flat, at, size
            else:
                self.at = np.concatenate((self.at, at + len(self.flat)))
                self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
        of = self.code.__getitem__
        return [np.fromiter(map(of, x), np.int64, len(x)) for x in split]

    def values(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the words with these numbers, one after the other, and how many each has."""
        size = self.size[codes]
        ends = np.cumsum(size)
        where = np.repeat(self.at[codes] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[where], size
