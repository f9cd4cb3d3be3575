"""Vectorised words of a batch of texts: positions, documents and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _GOLD)


_coefficients = stream(256, 7)


def _coefficients_to(n: int) -> np.ndarray:
    global _coefficients
    if n > len(_coefficients):
        _coefficients = stream(2 * n, 7)
    return _coefficients


_letters: tuple[np.ndarray, np.ndarray] | None = None


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the code points below 65536: is it a letter or a digit; its lower case, if that is one such code point."""
    global _letters
    if _letters is None:
        every = [chr(c) for c in range(65536)]
        lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(every)], dtype=np.uint32)
        _letters = np.array([c.isalnum() for c in every]), lower
    return _letters


class Grid:
    """The words of texts, runs without ASCII white space, or with plain=True runs of letters and digits in lower case: chars (code points, texts joined by a line feed), begin and end of each word, doc_at (first
    word of each text, and the number of words at the end), text_at (start of each text in chars)."""

    def __init__(self, texts: list[str], lower: bool = False, plain: bool = False):
        self.chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if plain:
            is_letter, to_lower = letter_tables()
            low = np.minimum(self.chars, 65535)
            self.chars = np.where(self.chars < 65536, to_lower[low], self.chars)
        elif lower:
            self.chars = np.where((self.chars >= 65) & (self.chars <= 90), self.chars + np.uint32(32), self.chars)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)].astype(np.int64)
        self.lengths = lengths
        gap = np.empty(len(self.chars) + 2, dtype=bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = ~(is_letter[low] | (self.chars >= 65536)) if plain else (self.chars == 32) | ((self.chars >= 9) & (self.chars <= 13))
        self.begin = np.flatnonzero(gap[:-1] & ~gap[1:]) if len(self.chars) else np.empty(0, dtype=np.int64)
        self.end = np.flatnonzero(~gap[:-1] & gap[1:]) if len(self.chars) else np.empty(0, dtype=np.int64)
        self.end = self.end[: len(self.begin)]
        self.doc_at = np.append(np.searchsorted(self.begin, self.text_at), len(self.begin))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a multilinear hash of its code points, then mixed with its length."""
        if not len(self.begin):
            return np.empty(0, dtype=np.uint64)
        size = self.end - self.begin
        inside = np.repeat(self.begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        place = inside - np.repeat(self.begin, size)
        with np.errstate(over="ignore"):
            terms = (self.chars[inside].astype(np.uint64) + np.uint64(1)) * _coefficients_to(int(size.max()))[place]
            total = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(size)[:-1])))
            return mix(total + size.astype(np.uint64) * _GOLD)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text; with fewer words, of the whole sequence; without, none."""
    k = len(words)
    if not k:
        return np.empty(0, dtype=np.uint64)
    width = min(n, k)
    with np.errstate(over="ignore"):
        total = np.full(k - width + 1, np.uint64(width), dtype=np.uint64)
        for i in range(width):
            total = mix(total * _GOLD + words[i : k - width + 1 + i])
    return np.unique(total)


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40, weight: np.ndarray | None = None) -> tuple[float, ...]:
    """Logistic regression of weighted rows by Newton's method; all but the bias (column 0) are drawn to 0."""
    w = np.ones(len(y)) if weight is None else weight
    out = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        out = out - np.linalg.solve(hessian, x.T @ (w * (p - y)) + pull * out)
    return tuple(float(v) for v in out)
