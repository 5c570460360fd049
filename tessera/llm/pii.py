"""Surrogates for personal data: detected entities are replaced by others of their type, gender, script and format.

An entity's variable characters are a number in a domain that its format fixes (digits stay digits, letters keep
case, script and vowel or consonant, an octet its width, a card its check digit, a given name its list).  The
surrogate is the image under a keyed permutation of that domain: a Feistel cipher over the domain's numbers, made
to leave none in place.  So the same entity gets the same surrogate everywhere, however its separators are written,
and entities of a domain never share one.  What a permutation can't promise, that no surrogate is shared across domains or is
someone's original in the corpus, is checked over the corpus' distinct entities, and those that clash are re-keyed; where
a format has too few values for its entities, theirs get longer ones.  What clashes even then is an error, not a result.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card and account numbers, social security numbers,
IBANs, access keys, long hexadecimal tokens, values of password and token fields, and persons' names by title or
known given name, then also their bare mentions in the same text.

Cases: a null text stays null and an empty one empty; of overlapping entities the one found first in the order of
``ORDER``, and then the first in the text, stands, but a number within a token or key is part of that; a name's
possessive ending and initials stay; rows keep their columns, order, ids and repeats; long texts are
searched whole; empty tables stay empty; a column named as the result is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt, prod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textnum import slices
from tessera.runtime import Stored, store

ROUNDS = 6
#: Rounds of re-keying beyond those in an entity's own format, each to a wider one.
WIDER = 16
#: Characters of a text that are moved as one number.
LONG = 96

# Given names by script and gender, and titles with the gender they tell.
GIVEN = {
    ("latin", "f"): "Alice Anna Anne Barbara Carla Carmen Charlotte Claire Clara Claudia Elena Emily Emma Eva Greta Hannah Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Mary Monika Nina Olivia Patricia Paula Rosa Sarah Sofia Susan Ursula".split(),
    ("latin", "m"): "Adam Albert Alexander Andreas Antonio Bernard Carlos Charles Christian Daniel David Diego Edward Felix Francis Frank Georg George Hans Henry Hugo Jacques James Jean John Jonas José Juan Karl Louis Luis Marco Martin Michael Miguel Oliver Pablo Paul Peter Pierre Robert Stefan Thomas Walter William".split(),
    ("cyrillic", "f"): "Алла Анна Валентина Вера Галина Екатерина Елена Ирина Лариса Людмила Мария Наталья Нина Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Евгений Иван Игорь Михаил Николай Олег Павел Сергей Юрий".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Señora Sra Señorita Doña Signora Госпожа".split(),
    "m": "Mr Sir Lord Herr Monsieur Señor Sr Don Signor Господин".split(),
    "": "Dr Prof Doktor Professor Docteur Doctor".split(),
}
LETTER_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")

GENDER_OF = {t: g for g, own in TITLES.items() for t in own}
LIST_OF = {n: k for k, own in GIVEN.items() for n in own}
CLASS_OF = {c: s for s in LETTER_CLASSES for c in s}

EMAIL = re.compile(r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
#: Where a number of seven digits and more may stand; what it is, the patterns below tell.
NUMBER = re.compile(r"[+(]?\d[\d ().\-/]{5,}\d")
IP = re.compile(r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\.?\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)")
SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?!\w)"
    r"|(?<![\w.])\+(?:[ .\-()]{0,2}\d){8,15}(?![\w])|(?<![\w.])0\d(?:[ .\-]\d\d){4}(?!\w)"  # by country code; in pairs
)
CARD = re.compile(r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
IBAN_START = re.compile(r"\b[A-Z]{2}\d{2} ?[A-Z0-9]{4}")
KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")
HEX = re.compile(r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)")
FIELD = re.compile(r"""\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([^\s"',;<>]{6,})""", re.I)
#: Capital letters of all scripts.
UPPER = f"[{''.join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ('Lu', 'Lt'))}]"
WORD = rf"{UPPER}(?:\w|['’](?!s\b)(?=\w)|-(?={UPPER}))+"
GAP = rf"[ \u00a0](?:{UPPER}\.[ \u00a0])*"
TITLE = "|".join(sorted(GENDER_OF, key=len, reverse=True))
TITLED = re.compile(rf"\b((?:{TITLE})(?:\.?[ \u00a0](?:{TITLE})\b)*)\.?{GAP}({WORD})(?:{GAP}({WORD}))?")
NAMED = re.compile(rf"\b({'|'.join(sorted(LIST_OF, key=len, reverse=True))}){GAP}({WORD})")
BARE = re.compile(rf"\b{WORD}")
#: Which kind stands where two overlap.
ORDER = ["email", "key", "iban", "ipv6", "ip", "card", "ssn", "phone", "secret", "given", "family"]


def luhn(digits: str) -> int:
    """The digit that closes a card number."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_rest(country: str, account: str) -> int:
    """The check digits of an IBAN."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


#: The setting that holds a session's key; its name has Spark's own pages hide it.
KEY_SETTING = "spark.tessera.pii.secret"


def session_key(spark: SparkSession) -> bytes:
    """The key in KEY_SETTING; without one, a random key for this session, so that no one can restore the data from the code."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


@dataclass
class Surrogates:
    """The keyed permutations; a secret of a corpus."""

    key: bytes
    known: dict = field(default_factory=dict, repr=False)
    wide: int = 0  # by how much formats are wider than the originals'; those of a fixed length and many values never are

    def _f(self, tag: str, i: int, x: int, size: int) -> int:
        h = hashlib.shake_256(hashlib.sha256(self.key).digest() + f"{tag}\0{i}\0{x:x}".encode("utf-8", "surrogatepass"))
        return int.from_bytes(h.digest(16 + size.bit_length() // 8), "big") % size

    def _cipher(self, x: int, n: int, tag: str, back: bool) -> int:
        """A Feistel cipher over a square no smaller than n, walked until it falls below n."""
        side = isqrt(n - 1) + 1
        while True:
            a, b = divmod(x, side)
            for i in range(ROUNDS):
                if back:
                    a, b = (b - self._f(tag, ROUNDS - 1 - i, a, side)) % side, a
                else:
                    a, b = b, (a + self._f(tag, i, b, side)) % side
            x = a * side + b
            if x < n:
                return x

    def move(self, x: int, n: int, tag: str) -> int:
        """A permutation of range(n) that leaves nothing in place: one step on a keyed cycle through all."""
        if n < 2:
            return x
        return self._cipher((self._cipher(x, n, tag, False) + 1) % n, n, tag, True)

    def spell(self, text: str, tag: str, alphabet=None) -> str:
        """Another text of the same format: each character varies in its class, or stays if it has none."""
        if len(text) > LONG:  # part by part, each under the parts before it, which keeps long texts distinct too
            parts = [text[i : i + LONG] for i in range(0, len(text), LONG)]
            seen, out = hashlib.sha256(tag.encode()), []
            for p in parts:
                out.append(self.spell(p, f"{tag}\0{len(text)}\0{seen.hexdigest()}", alphabet))
                seen.update(p.encode("utf-8", "surrogatepass"))
            return "".join(out)
        own = [(alphabet or plain_class)(c) for c in text]
        sizes = [len(s) if s else 1 for s in own]
        x = 0
        for c, s, n in zip(text, own, sizes):
            x = x * n + (s.index(c) if s else 0)
        shape = "".join(s[0] if s else c for c, s in zip(text, own))
        x = self.move(x, prod(sizes), f"{tag}\0{shape}")
        out = []
        for c, s, n in zip(reversed(text), reversed(own), reversed(sizes)):
            x, at = divmod(x, n)
            out.append(s[at] if s else c)
        return "".join(reversed(out))

    def of(self, kind: str, value: str) -> str:
        got = self.known.get((kind, value))
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[kind, value] = getattr(self, "_" + kind.partition(" ")[0])(value, kind.partition(" ")[2])
        return got

    def _email(self, v: str, _) -> str:
        low = v.lower()
        local, _, host = low.partition("@")
        labels = host.split(".")
        own = [i for i, x in enumerate(labels[:-1]) if x != "example"] or [0]
        # the local part and the host's labels as one text, so that their distinctness is one
        moved = self.spell("\0".join([local + "a" * self.wide, *(labels[i] for i in own)]), "email").split("\0")
        for i, x in zip(own, moved[1:]):
            labels[i] = x
        out = f"{moved[0]}@{'.'.join(labels)}"
        return "".join(b.upper() if a.isupper() else b for a, b in zip(v, out)) if len(out) == len(v) else out

    def _digits(self, v: str, tag: str, keep: int = 0, strict: bool = False, more: int = 0) -> str:
        """Moves the digits after the first ``keep``, and lays them out as in ``v``, with ``more`` at the end."""
        d = re.sub(r"\D", "", v)
        body = d[keep:] + "0" * more
        if strict and len(body) == 10:  # area and exchange don't begin with 0 or 1
            classes = iter([("23456789" if c in "23456789" else "01") if i in (0, 3) else "0123456789" for i, c in enumerate(body)])
            body = self.spell(body, tag, lambda c: next(classes))
        else:
            body = self.spell(body, tag)
        new = iter(d[:keep] + body)
        return "".join([next(new) if c.isdigit() else c for c in v] + list(new))

    def _phone(self, v: str, _) -> str:
        n, country = len(re.sub(r"\D", "", v)), re.match(r"\+(\d{1,3})[ .\-(]", v)
        return self._digits(v, "phone", len(country[1]) if country else max(0, n - 10), True, self.wide)

    def _ssn(self, v: str, _) -> str:
        return self._digits(v, "ssn")

    def _ip(self, v: str, _) -> str:
        parts = [int(x) for x in v.split(".")]
        spans = [(0, 256) if self.wide else (0, 10) if x < 10 else (10, 100) if x < 100 else (100, 256) for x in parts]
        x = 0
        for p, (lo, hi) in zip(parts, spans):
            x = x * (hi - lo) + p - lo
        x = self.move(x, prod(hi - lo for lo, hi in spans), f"ip\0{spans}")
        out = []
        for lo, hi in reversed(spans):
            x, at = divmod(x, hi - lo)
            out.append(str(lo + at))
        return ".".join(reversed(out))

    def _ipv6(self, v: str, _) -> str:
        # an address is one number, however it is written: each of its eight fields keeps its number of digits, and zero stays;
        # wider, first the digits vary, then zeros too
        full = ipaddress.IPv6Address(v).exploded
        fields = [int(x, 16) for x in full.split(":")]
        if self.wide > 1:
            v, spans = full, [(0, 1 << 16)] * 8
        else:
            spans = [(1 if self.wide else 16 ** (len(f"{x:x}") - 1), 1 << 16 if self.wide else 16 ** len(f"{x:x}")) if x else (0, 1) for x in fields]
        x = 0
        for f, (lo, hi) in zip(fields, spans):
            x = x * (hi - lo) + f - lo
        x, new = self.move(x, prod(hi - lo for lo, hi in spans), f"ipv6\0{spans}"), []
        for lo, hi in reversed(spans):
            x, at = divmod(x, hi - lo)
            new.append(lo + at)
        new.reverse()
        head, _, tail = v.partition("::")
        n_tail = len(tail.split(":")) if tail else 0
        own = iter(new[: len(head.split(":")) if head else 0] + new[8 - n_tail :] if "::" in v else new)
        out = re.sub("[0-9A-Fa-f]+", lambda m: f"{next(own):0{len(m[0])}x}", v)
        return out.upper() if v != v.lower() else out

    def _card(self, v: str, _) -> str:
        d = re.sub(r"\D", "", v)
        off = (int(d[-1]) - luhn(d[:-1])) % 10  # 0 for a valid number; what it is off by stays
        body = d[0] + self.spell(d[1:-1], f"card\0{d[0]}\0{off}")
        new = iter(body + str((luhn(body) + off) % 10))
        return "".join(next(new) if c.isdigit() else c for c in v)

    def _iban(self, v: str, _) -> str:
        d = v.replace(" ", "")
        body = self.spell(d[4:], f"iban\0{d[:2]}")
        new = iter(f"{d[:2]}{iban_rest(d[:2], body):02d}{body}")
        return "".join(c if c == " " else next(new) for c in v)

    def _key(self, v: str, _) -> str:
        return v[:4] + self.spell(v[4:], f"key\0{v[:4]}")

    def _secret(self, v: str, _) -> str:
        own, varies = "", any(len(plain_class(c)) > 1 for c in v)
        if self.wide or not varies:  # drawn for this one; where no sign varies, all become letters
            own = "\0" + hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()
            v = (v if varies else "a" * len(v)) + "0" * self.wide
        for digits in ("0123456789abcdef", "0123456789ABCDEF"):
            if set(v) <= set(digits) and not v.isdigit():
                return self.spell(v, "hex" + own, lambda c: digits)
        return self.spell(v, "secret" + own)

    def _given(self, v: str, gender: str) -> str:
        if v in LIST_OF:
            own = GIVEN[LIST_OF[v]]
            return own[self.move(own.index(v), len(own), f"given\0{LIST_OF[v]}")]
        return self._coined(v, "given")  # whatever title it had here, so that it is one person's throughout

    def _family(self, v: str, _) -> str:
        if v in LIST_OF and not self.wide:  # among themselves, as a coined name is never one of these
            own = GIVEN[LIST_OF[v]]
            return own[self.move(own.index(v), len(own), f"family\0{LIST_OF[v]}")]
        return self._coined(v, "family")

    def _coined(self, v: str, tag: str) -> str:
        """A pronounceable name: vowels for vowels; a Cyrillic ending, which tells the gender, stays.  A permutation of the names that aren't known given names."""
        stay = len(v) - 2 if len(v) > 3 and v[-1] in CLASS_OF and CLASS_OF[v[-1].lower()] in LETTER_CLASSES[2:] else len(v)
        if self.wide or not any(len(name_class(small(c))) > 1 for c in v[:stay]):  # drawn for this one
            v, end, tag = longer(v, stay, self.wide), len(v) - stay, f"{tag}\0{v}"
            stay = len(v) - end
        while True:
            head = self.spell("".join(map(small, v[:stay])), tag, name_class)
            v = "".join(b.upper() if a.isupper() else b for a, b in zip(v, head)) + v[stay:]
            if v not in LIST_OF:
                return v


@dataclass
class Rekeyed(Surrogates):
    """Surrogates under the key of a round and as much wider as ``steps[kind, original]`` tells, for the entities in it."""

    steps: dict = field(default_factory=dict, repr=False)
    rounds: dict = field(default_factory=dict, repr=False)

    def of(self, kind: str, value: str) -> str:
        step = self.steps.get((kind.partition(" ")[0], value))
        if not step:
            return super().of(kind, value)
        if step not in self.rounds:
            self.rounds[step] = Surrogates(self.key + b"\0%d" % step[0], wide=step[1])
        return self.rounds[step].of(kind, value)


@lru_cache(maxsize=1 << 14)
def neighbours(c: str, name: bool = False) -> str:
    """Letters and digits beside one in its script: those of its category among 32 code points; in names only such as have a
    capital of their own, or none at all, and not those of LETTER_CLASSES."""
    kind, first = unicodedata.category(c), ord(c) // 32 * 32
    if kind[0] != "L" and kind != "Nd":
        return ""
    own = [x for x in map(chr, range(first, first + 32)) if unicodedata.category(x) == kind]
    if name:
        own = [x for x in own if x not in CLASS_OF and len(x.upper()) == 1 and (x.upper() == x or x.upper().lower() == x) and (x.upper() == x) == (c.upper() == c)]
    return "".join(own) if c in own else ""


def plain_class(c: str) -> str:
    if "0" <= c <= "9":
        return "0123456789"
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return neighbours(c) if ord(c) > 127 else ""


def small(c: str) -> str:
    return c.lower() if len(c.lower()) == 1 else c


def name_class(c: str) -> str:
    return CLASS_OF.get(c) or neighbours(c, True)


def longer(v: str, stay: int, n: int) -> str:
    """A name with ``n`` times two of its letters that vary before what stays of it; where none varies, all become Latin ones."""
    own = [c for c in v[:stay] if len(name_class(small(c))) > 1]
    more = "".join(own[-2:]) or "na"
    head = v[:stay] if own else "N" + "a" * (stay - 1)
    return head + (more.upper() if v.isupper() else more.lower()) * n + v[stay:]


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and apart from each other."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if "KIA" in text or "ASIA" in text:
        found += [(*m.span(), "key") for m in KEY.finditer(text)]
    if IBAN_START.search(text):
        for m in IBAN.finditer(text):
            d = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1:
                found.append((*m.span(), "iban"))
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in FIELD.finditer(text)]
    found += [(*m.span(), "secret") for m in HEX.finditer(text)]
    if ":" in text:
        found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if is_ipv6(m[0])]
    for at in NUMBER.finditer(text):
        lo, hi = max(0, at.start() - 1), at.end() + 2  # with what stands around it
        for kind, pattern in (("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
            for m in pattern.finditer(text, lo, hi):
                if kind != "ip" or all(int(x) < 256 for x in m.groups()):
                    found.append((*m.span(), kind))
    found += names(text)
    tokens = sorted({(lo, hi) for lo, hi, kind in found if kind == "secret"})
    out: list[tuple[int, int, str]] = []
    for lo, hi, kind in sorted(set(found), key=lambda x: (ORDER.index(x[2].partition(" ")[0]), x[0], -x[1])):
        if kind in ("ip", "card", "ssn", "phone"):
            around = tokens[max(0, bisect(tokens, (lo, len(text))) - 1) :][:1]
            if any(a <= lo and hi <= b and hi - lo < b - a for a, b in around):
                continue
        at = bisect(out, (lo,))
        if (at == 0 or out[at - 1][1] <= lo) and (at == len(out) or hi <= out[at][0]):
            out.insert(at, (lo, hi, kind))
    return out


def is_ipv6(v: str) -> bool:
    """Whether it is an address, and not two words of letters with colons between."""
    try:
        return ipaddress.IPv6Address(v) > ipaddress.IPv6Address("::ffff") and any(c.isdigit() for c in v)
    except ValueError:
        return False


def names(text: str) -> list[tuple[int, int, str]]:
    found, known = [], {}
    for m in TITLED.finditer(text):
        gender = next((g for t in re.findall(TITLE, m[1]) if (g := GENDER_OF[t])), "")
        if m[3]:
            found += [(*m.span(2), f"given {gender}"), (*m.span(3), "family")]
            known[m[2]], known[m[3]] = f"given {gender}", "family"
        else:
            kind = f"given {gender}" if m[2] in LIST_OF else "family"
            found.append((*m.span(2), kind))
            known[m[2]] = kind
    for m in NAMED.finditer(text):
        found += [(*m.span(1), "given "), (*m.span(2), "family")]
        known.setdefault(m[1], "given ")
        known.setdefault(m[2], "family")
    if known:  # bare mentions, also as a part of a double name
        for m in BARE.finditer(text):
            if m[0] in known:
                found.append((*m.span(), known[m[0]]))
            else:
                found += [(m.start() + p.start(), m.start() + p.end(), known[p[0]]) for p in re.finditer(r"[^-]+", m[0]) if p[0] in known]
    return found


def replace(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with its entities replaced, and (kind, original, surrogate) for each in order."""
    if not text:
        return text, []
    out, at, told = [], 0, []
    for lo, hi, kind in detect(text):
        new = surrogates.of(kind, text[lo:hi])
        out += [text[at:lo], new]
        at = hi
        told.append((kind.partition(" ")[0], text[lo:hi], new))
    return "".join([*out, text[at:]]) if told else text, told


def replaced(docs: DataFrame, key: bytes, text: str = "text", steps: dict | None = None) -> Column:
    """A struct column: the text, and kinds, originals and surrogates of its entities; those in ``steps`` are re-keyed."""
    shared = docs.sparkSession.sparkContext.broadcast(steps or {})

    @F.pandas_udf("text string, kinds array<string>, originals array<string>, surrogates array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Rekeyed(key, steps=shared.value)
        for s in (x for b in batches for x in slices(b)):
            rows = [replace(t, own) for t in s]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in rows], dtype=object)} | {n: pd.Series([[x[i] for x in told] for _, told in rows], dtype=object) for i, n in enumerate(("kinds", "originals", "surrogates"))})

    return of(F.col(text))


def entities(done: DataFrame, name: str) -> DataFrame:
    """(kind, original, surrogate), as written, of the distinct entities."""
    return done.select(F.explode(F.arrays_zip(f"{name}.kinds", f"{name}.originals", f"{name}.surrogates")).alias("e")).select(F.col("e.kinds").alias("kind"), F.col("e.originals").alias("original"), F.col("e.surrogates").alias("surrogate")).distinct()


def clashes(told: DataFrame) -> DataFrame:
    """(kind, original) of ``entities`` whose surrogate another entity has too (all but the least of them) or is, or that stayed as they are.

    Spellings of a number or address, and a phone number with and without its country, are one entity.  Known given names
    aren't told: their surrogates are known given names, which people share.
    """

    @F.pandas_udf("string")
    def address(kind: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([ipaddress.IPv6Address(x).exploded if k == "ipv6" else x for k, x in zip(kind, v)], dtype=object)

    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    canon = lambda c: F.when(F.col("kind") == "phone", F.substring(digits(c), -10, 10)).when(F.col("kind").isin("card", "ssn"), digits(c)).when(F.col("kind") == "email", F.lower(c)).when(F.col("kind") == "iban", F.regexp_replace(c, " ", "")).otherwise(address("kind", c))
    told = store(told.withColumns({"a": canon(F.col("original")), "b": canon(F.col("surrogate"))}), "entities")
    own = told.filter(~((F.col("kind") == "given") & F.col("original").isin(list(LIST_OF))))
    shared = own.groupBy("kind", "b").agg(F.min("a").alias("first"), F.max("a").alias("last")).filter("first <> last").select("kind", "b", "first")
    real = own.join(told.select("kind", F.col("a").alias("b")).distinct(), ["kind", "b"], "left_semi").select("kind", "a")  # its own or another's
    return own.join(own.join(shared, ["kind", "b"]).filter("a <> first").select("kind", "a").unionAll(real).distinct(), ["kind", "a"], "left_semi").select("kind", "original").distinct()


def clashing(done: DataFrame, name: str) -> DataFrame:
    """``clashes`` of the struct of ``replaced`` in ``done``."""
    return clashes(entities(done, name))


def rekeyed(told: DataFrame, key: bytes, steps: dict) -> DataFrame:
    """``entities`` with new surrogates for those in ``steps``."""
    shared = told.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("string")
    def of(kind: pd.Series, original: pd.Series, surrogate: pd.Series) -> pd.Series:
        own = Rekeyed(key, steps=shared.value)
        return pd.Series([own.of(k, a) if (k, a) in own.steps else b for k, a, b in zip(kind, original, surrogate)], dtype=object)

    return told.withColumn("surrogate", of("kind", "original", "surrogate"))


def settled(docs: DataFrame, key: bytes, name: str, rounds: int = 8) -> DataFrame:
    """``docs`` with the struct of ``replaced`` as ``name`` and without ``text``; clashing entities are re-keyed, round by round.

    Rounds go over the distinct entities, and only those that clash come to the driver; if any did, texts are read a second time at
    the end.  What clashes after ``rounds``, as its format has too few values, gets surrogates of wider formats, and what
    clashes after WIDER of these is an error.
    """
    spark = docs.sparkSession
    made = lambda steps: Stored(spark, docs.withColumn(name, replaced(docs, key, steps=steps)).drop(*({"text"} - {name})), "replaced")
    steps: dict[tuple[str, str], tuple[int, int]] = {}
    done = made(steps)
    told = Stored(spark, entities(done.df, name), "told")
    for t in range(1, rounds + WIDER + 2):
        bad = [(r.kind, r.original) for r in clashes(rekeyed(told.df, key, steps) if steps else told.df).collect()]
        if not bad:
            break
        if t == 1:
            done.drop()
        if t > rounds + WIDER:
            told.drop()
            raise RuntimeError(f"{len(bad)} entities of kinds {sorted({k for k, _ in bad})} have no surrogate of their own after {t - 1} rounds")
        steps |= dict.fromkeys(bad, (t, max(0, t - rounds)))
    told.drop()
    return (made(steps) if steps else done).df


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with ``text`` replaced."""
    return settled(docs, key, "__p").withColumn("text", F.col("__p.text")).select(docs.columns)


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, originals, real): surrogates under ``key`` alone that several entities share, or that are an original somewhere
    in the corpus; ``settled`` re-keys these.

    Formats of numbers are compared by their digits.  Distinct entities are aggregated before they are dealt out.
    """
    canon = lambda c: F.when(F.col("kind").isin("phone", "card", "ssn"), F.regexp_replace(c, "[^0-9]", "")).otherwise(F.when(F.col("kind") == "email", F.lower(c)).otherwise(c))
    told = docs.select(replaced(docs, key).alias("p")).select(F.explode(F.arrays_zip("p.kinds", "p.originals", "p.surrogates")).alias("e"))
    pairs = told.select(F.col("e.kinds").alias("kind"), "e.originals", "e.surrogates").select("kind", canon(F.col("originals")).alias("original"), canon(F.col("surrogates")).alias("surrogate")).distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("original").alias("originals"))
    real = pairs.select("kind", F.col("original").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    return shared.join(real, ["kind", "surrogate"], "left").withColumn("real", F.coalesce("real", F.lit(False))).filter("originals > 1 or real")
