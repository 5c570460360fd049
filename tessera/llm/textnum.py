"""Word and n-gram hashes of many texts at once, in flat numpy arrays.

The texts of a batch lie in one byte array, parted by line feeds that belong to none of them.  A word is a
run of bytes outside ``\\x20 \\x09-\\x0D``; its hash is a difference of prefix sums of byte * B**-i, carried on
modulo 2**64 and scaled back by B**start, so it takes the same few array passes for any number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(MULT), -1, 2**64))
#: Bytes hashed at once; the power tables grow to this, or to the longest text.
SPAN = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and MULT ** -i for i < n."""
    if len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for k, x in (("up", MULT), ("down", INVERSE)):
                a = np.full(n, x, np.uint64)
                a[0] = 1
                _powers[k] = np.cumprod(a)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits (fixed values: the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Arrays over a batch: ``data`` bytes; per text ``first``, ``last`` (bytes); per word ``start``, ``end``, ``doc``, ``hash``."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        self.texts = [t or "" for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in self.texts]
        if lower:  # of bytes: only A-Z change
            raw = [x.lower() for x in raw]
        self.n, self.raw = len(raw), raw
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        size = np.array([len(x) for x in raw], np.int64)
        self.last = np.cumsum(size + 1) - 1
        self.first = self.last - size
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte is a space, so words are closed
        self.doc = np.searchsorted(self.last, self.start, side="right")
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * down[: len(self.data)], out=sums[1:])
        self.sums, self.up = sums, up
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end."""
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.bincount(self.doc, minlength=self.n)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text where ``mask`` holds."""
        n = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return n[self.last] - n[self.first]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the first word, text, hash) of each k consecutive words of one text."""
        if len(self.hash) < k:
            return self.doc[:0], self.doc[:0], self.hash[:0]
        h = self.hash[: len(self.hash) - k + 1].copy()
        first = h.copy()
        for i in range(1, k):
            h = mix(h * MULT + self.hash[i : len(self.hash) - k + 1 + i])
        if k == 2:  # a word twice in a row is one gram whatever the word
            h[first == self.hash[1:]] = 0
        whole = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :])
        return whole, self.doc[whole], h[whole]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash), in order and without repeats, of the k-word shingles of each text; fewer words are one shingle."""
        doc, h = self.word_grams(k)
        words = self.counts()
        for n in range(1, min(k, int(words.max(initial=0)) + 1)):
            if (words == n).any():
                d, x = self.word_grams(n)
                own = words[d] == n
                doc, h = np.r_[doc, d[own]], np.r_[h, mix(x[own] + np.uint64(n))]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(doc) else np.zeros(0, bool)
        return doc[new], h[new]

    def word_grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.windows(k)[1:]

    def char_grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of each k consecutive characters of one text; up to 3 characters make the code exactly."""
        chars = np.frombuffer(("\n".join(self.texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        m = len(chars) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        code = chars[:m].copy()
        for i in range(1, k):
            code *= np.uint64(1 << 21 | 1) if i >= 3 else np.uint64(1 << 21)
            code += chars[i : m + i]
        size = np.array([len(t) + 1 for t in self.texts], np.int64)
        doc = np.repeat(np.arange(self.n), size)[:m]
        inside = np.cumsum(size)[doc] - 1 - np.arange(m) >= k
        return doc[inside], code[inside]


#: Rows of an Arrow batch that an operator works on, and gives back, at once.
ROWS = 512


def slices(s):
    """Parts of a series, so that what is made of a whole Arrow batch is never held."""
    return (s.iloc[i : i + ROWS] for i in range(0, len(s), ROWS)) if len(s) else [s]


def batches(texts: list[str | None], lower: bool = False) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, Texts) for runs of about SPAN bytes; a longer text is a run of its own."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= SPAN):
            size += len(texts[j] or "")
            j += 1
        yield i, Texts(texts[i:j], lower)
        i = j
