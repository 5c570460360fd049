"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A text is cut into pieces by the vocabulary's pattern; pieces that a worker hasn't met yet are encoded
together.  Their symbols lie in one flat array; a round looks every adjacent pair up by binary search over the
sorted pair keys, finds each piece's lowest rank with one segmented minimum, and merges all places that hold
it (of overlapping ones the left).  Pieces without a mergeable pair leave the array.  Every merge of such a
vocabulary makes a token of its own, so no pair that a merge gives rise to can rank below it, and a round does
what merging its places one by one would.

Ids are kept as little-endian unsigned 32-bit numbers in a binary column.  Strings of special tokens in a text
become their ids, as the tokenizers library does with add_special_tokens=False; a null text is an empty one.
Texts are encoded whole, of any length; rows keep their columns, order and repeats; empty tables stay empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textnum import slices

#: Fixed value: the pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers, beyond which it starts anew, and characters of a piece that is worth it.
REMEMBERED, SHORT = 300_000, 48
#: Characters cut into pieces at once.
CUT = 1 << 20
NONE = np.int64(1 << 40)


def byte_symbols() -> dict[str, int]:
    """Fixed value: the character that stands for each byte in a vocabulary file: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Sorted pair keys with rank and merged id, the id of each byte, the bytes of each id, special strings."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    of_byte: np.ndarray
    table: list[bytes]
    special: dict[str, int]
    seen: dict[str, bytes] = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizers file of a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, byte = spec["model"]["vocab"], byte_symbols()
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        keys = np.array([of[a] << 32 | of[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        merged = np.array([of[a + b] for a, b in pairs], np.int64)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        table = [b""] * (1 + max([*of.values(), *special.values()]))
        for token, i in of.items():
            table[i] = bytes(byte[c] for c in token)
        for token, i in special.items():
            table[i] = token.encode()
        return cls(keys[order], order.astype(np.int64), merged[order], np.array([of[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64), table, special)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, none of them empty."""
        size = np.array([len(w) for w in words], np.int64)
        sym, word = self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            key = sym[inner] << 32 | sym[inner + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[inner[hit]], into[inner[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            over = least == NONE
            if over.any():
                done.append((word[over], sym[over]))
                stay = ~over
                sym, word, rank, into, least = sym[stay], word[stay], rank[stay], into[stay], least[stay]
            place = rank == least
            # of a run of overlapping places every second goes
            i = np.flatnonzero(place)
            start = np.r_[True, np.diff(i) > 1] if len(i) else np.zeros(0, bool)
            i = i[(np.arange(len(i)) - np.flatnonzero(start)[np.cumsum(start) - 1]) % 2 == 0] if len(i) else i
            sym[i] = into[i]
            left = np.ones(len(sym), bool)
            left[i + 1] = False
            sym, word = sym[left], word[left]
        owner, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        import regex

        find = regex.compile(PATTERN).findall
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        out: list[bytes] = []
        i = 0
        while i < len(texts):  # some texts at a time, or a long one
            pieces, size = [], 0
            while i + len(pieces) < len(texts) and (not pieces or size < CUT):
                t = texts[i + len(pieces)] or ""
                size += len(t)
                parts = cut(t)
                own = find(parts[0])
                for k in range(1, len(parts), 2):
                    own.append(parts[k])
                    own += find(parts[k + 1])
                pieces.append(own)
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            new = {x for own in pieces for x in own} - self.seen.keys()
            for s in new & self.special.keys():
                self.seen[s] = np.array([self.special[s]], "<u4").tobytes()
            new = sorted(new - self.special.keys())
            self.seen.update(zip(new, (x.tobytes() for x in self.merge([x.encode() for x in new]))))
            got = self.seen.__getitem__
            out += [b"".join(map(got, own)) for own in pieces]
            for x in new:  # so what is remembered is bounded in bytes too
                if len(x) > SHORT:
                    del self.seen[x]
            i += len(pieces)
        return out

    def decode(self, ids: list[bytes | None]) -> list[str]:
        """The texts that ids stand for; bytes that aren't UTF-8 become U+FFFD, ids out of range nothing."""
        get, n = self.table.__getitem__, len(self.table)
        out = []
        for x in ids:
            a = np.frombuffer(x or b"", "<u4")
            out.append(b"".join(map(get, a[a < n].tolist())).decode("utf-8", "replace"))
        return out

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}


def encoder(docs: DataFrame, vocabulary: Vocabulary):
    """A function of a text column to its ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size, which is fixed

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for b in batches for x in slices(b)):
            yield pd.Series(shared.value.encode(s.tolist()), dtype=object)

    return of


def decoder(docs: DataFrame, vocabulary: Vocabulary):
    """A function of an id column to its text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for b in batches for x in slices(b)):
            yield pd.Series(shared.value.decode(s.tolist()), dtype=object)

    return of


def coder(docs: DataFrame, vocabulary: Vocabulary):
    """A function of a text column to (its ids, the text that they stand for), in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("ids binary, decoded string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in (x for b in batches for x in slices(b)):
            texts = dict.fromkeys(s.tolist())  # rows alike, as laps of a text are, are coded once
            ids = shared.value.encode(list(texts))
            known = dict(zip(texts, zip(ids, shared.value.decode(ids))))
            yield pd.DataFrame({"ids": pd.Series([known[t][0] for t in s], dtype=object), "decoded": pd.Series([known[t][1] for t in s], dtype=object)})

    return of


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column."""
    return docs.withColumn(to, encoder(docs, vocabulary)(F.col(text)))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id column."""
    return rows.withColumn(to, decoder(rows, vocabulary)(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with columns ids and decoded, which take the place of any of that name."""
    return docs.withColumn("__c", coder(docs, vocabulary)(F.col(text))).withColumns({"ids": F.col("__c.ids"), "decoded": F.col("__c.decoded")}).drop("__c")
