"""Similarity of texts whose words are sorted: by what has to be inserted and deleted to make one of the other."""

from __future__ import annotations

import re

import numpy as np


def sorted_words(text: str | None) -> str:
    """Lower-case words of letters, digits and underscores of any script, sorted and joined by blanks."""
    return " ".join(sorted(re.sub(r"\W", " ", text or "").strip().lower().split()))


class Block:
    """Many strings side by side as one bit vector, so that a text meets all of them in one walk over its characters."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        # A bit for each character, and one after each string that takes up its carry.
        codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)[:-1])).astype(np.int64) if texts else np.empty(0, np.int64)
        self.size = len(codes)
        guards = np.zeros(self.size, bool)
        guards[self.starts + self.lengths] = True
        self.inside = self.number(~guards)
        held = codes[~guards]
        self.masks = {chr(c): self.number((codes == c) & ~guards) for c in np.unique(held)}

    @staticmethod
    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def common(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence of the text and each string."""
        inside, v = self.inside, self.inside
        for c in text:
            mask = self.masks.get(c)
            if mask:
                u = v & mask
                v = ((v + u) | (v - u)) & inside
        rest = np.unpackbits(np.frombuffer(v.to_bytes(-(-self.size // 8), "little"), np.uint8), bitorder="little")[: self.size]
        return self.lengths - np.add.reduceat(rest, self.starts, dtype=np.int64) if len(self.starts) else self.lengths

    def scores(self, text: str) -> np.ndarray:
        """100 times the share of characters of both that the longest common subsequence keeps."""
        both = self.lengths + len(text)
        return (1 - (both - 2 * self.common(text)) / np.maximum(both, 1)) * 100


def shortest_share(threshold: float) -> float:
    """How long the shorter text must be, as a share of the longer, for a rounded score from the threshold on."""
    t = max(0.0, (threshold - 0.5) / 100)
    return t / (2 - t)
