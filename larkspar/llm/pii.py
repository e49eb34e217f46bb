"""Personal data by a semi-Markov conditional random field (op9).

Base spans are exact patterns (emails, IPv4 addresses, payment cards, phone numbers) found in linear time. The model adds what the patterns miss: secrets after a key word (kind secret),
long account numbers (kind account: bare numbers of 16 to 19 digits that are no card), emails that are spelled around (name at host dot org), addresses with an IPv6 form, phones without a plus sign, cards with other
separators.

It works on islands: runs of neighbouring words with a digit or an at sign, key words with a separator and a value, and what stands around a spelled at or dot. An
island is cut into atoms (letters and digits together, single other characters). A segment is up to MAX_ATOMS atoms (a secret: a whole value) that could be an entity at all: _Walk
has the forms. Features of the whole segment (its shape, digit count, Luhn sum, octets, separators, the key word before it, what stands at either side) score it for each kind, atoms outside any
segment score 0, and dynamic programming over the island finds the segmentation with the highest total, choosing boundaries and kinds together. Base spans are constraints
of that lattice: no other segment may overlap them, and they always stay.

Entities are bounded, so time is linear in the text. The program runs forward and keeps, for each place that some segment has reached, the best way there; where no
segment crosses a place, what is best before it is final and leaves memory. So an island may be as long as the text.

The model is trained by gradient ascent on the conditional likelihood (forward and backward over the same lattice) of TRAIN seeded synthetic islands, once an
application, in a task of its own; its weights are a few hundred numbers.

Null or empty text: no spans. Offsets are code points of the whole text. Repeated rows get equal results; an empty table gives no rows. Other columns are ignored,
or passed through by find() with the columns it adds.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspar.llm.common import map_texts, table, without

#: Kinds of the patterns, and those that only the model finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "account")
#: The longest form but secrets is a spelled email of a few words; a full IPv6 address has 15 atoms.
MAX_ATOMS, TRAIN, EPOCHS, RATE, DECAY = 28, 2000, 12, 0.3, 1e-4
#: Groups of digits that a card or phone may have.
MAX_GROUPS = 7
#: Characters of a secret, at least and at most; characters a key word may take; characters a spelled email may take on either side of its at or dot.
SECRET, KEY_SPACE, AROUND = (8, 512), 48, 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: Neighbouring words with a digit or an at sign.
_ISLAND = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+")
_ATOM = re.compile(r"[^\W_]+|[\s\S]")
_SEPARATOR = re.compile(r"[:=]")
_KEY = re.compile(r"(?i)(password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer|key)(?:[_-][a-z0-9]{1,20}){0,2}[\"'\]]?[ \t]{0,3}$")
_VALUE = re.compile(r"=?>?[ \t]{0,3}(?:Bearer )?[\"'`]?([^\s\"'`<>,;]+)")
_SPELLED = re.compile(r"(?i)[(\[{<] ?(?:at|dot) ?[)\]}>]|(?<= )dot(?= )")
_WORD_START = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")
#: Common top-level domains, and words that stand for a value.
_TOP = frozenset("com org net edu gov info io de fr es uk eu it nl ch at".split())
_FILLER = re.compile(r"(?i)example|changeme|placeholder|your|none|null|true|false|x{4}|\*{3}|\.{3}|\$\{|\(")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            yield start, low
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern spans, by kind as listed, then start."""
    if not _HINT.search(text):
        return []
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _shape(s: str) -> str:
    """Runs of letters as a, of digits as their length, other characters as they are."""
    return re.sub(r"[^\W\d_]+|[0-9]+", lambda m: str(len(m[0])) if m[0][0] in "0123456789" else "a", s)


def _edges(text: str, start: int, end: int) -> list[str]:
    before, after = text[start - 1 : start], text[end : end + 1]
    f = []
    if before.isalnum() or before in ("-", ".", "@", "+", ":", "/") and before:
        f.append(f"cut:{'a' if before.isalnum() else before}")
    if after.isalnum() or after in ("-", "@", ":", "/", "%") and after or after in (".", ",") and text[end + 1 : end + 2].isdigit():
        f.append(f"cut>{'a' if after.isalnum() else after}")
    if text[max(0, start - 2) : start].strip(" ").isdecimal() and before == " ":
        f.append("row<")
    if after == " " and text[end + 1 : end + 2].isdecimal():
        f.append("row>")
    return f or ["whole"]


def _number(text: str, start: int, end: int) -> list[str]:
    s = text[start:end]
    groups = re.findall("[0-9]+", s)
    digits, shape, seps = "".join(groups), _shape(s), {c for c in s if not c.isalnum()}
    f = [f"first:{s[0] if s[0] in '+(' else '0'}", f"digits:{len(digits)}", f"groups:{min(len(groups), 7)}", *(f"in:{c}" for c in sorted(seps))]
    if len(seps) == 1:
        f.append(f"only:{min(seps)}")
    if len(groups) == 1:
        f.append(f"bare:{min(len(digits), 16)}")
    if re.fullmatch("4-4-4-4|4 4 4 4|4\\.4\\.4\\.4|4/4/4/4|16|4-6-5|4 6 5", shape):
        f.append("card groups")
    if len(digits) in (15, 16, 19) and luhn(digits):
        f.append("luhn")
    if re.fullmatch(r"(\+?1[ -.])?(\(3\)|3)[ .-]?3[ .-]4", shape):
        f.append("area code")
    if re.fullmatch(r"(4-2-2|2-2-4|4/2/2|2/2/4|2\.2\.4)( .*)?", shape):
        f.append("date")
    return f


def _hex(text: str, start: int, end: int) -> list[str]:
    s = text[start:end]
    parts = s.split(":")
    f = [f"colons:{min(len(parts) - 1, 8)}", f"filled:{sum(map(bool, parts))}"]
    if "::" in s:
        f.append("shortened" if s.count("::") == 1 else "twice shortened")
    if len(parts) == 8:
        f.append("eight")
    if all(len(x) == 2 for x in parts):
        f.append("pairs")
    if max(map(len, parts)) > 2:
        f.append("wide")
    return f


def _email(text: str, start: int, end: int) -> list[str]:
    s = text[start:end].lower()
    local, _, host = s.partition("@")
    return [f"dots:{min(host.count('.'), 3)}", f"top:{host.rsplit('.', 1)[-1] in _TOP}", f"beyond:{not s.isascii()}", f"short:{len(local) < 2}"]


_MARKS = re.compile(r" ?[(\[{<] ?at ?[)\]}>] ?| at |@"), re.compile(r" ?[(\[{<] ?dot ?[)\]}>] ?| dot |\.")


def _spelled(text: str, start: int, end: int) -> list[str]:
    s = text[start:end].lower()
    at = _MARKS[0].search(s)
    local, host = (s[: at.start()], s[at.end() :]) if at else (s, "")
    labels = _MARKS[1].split(host)
    names = _MARKS[1].split(local)
    f = [f"at:{at[0].strip()[:1] if at else ''}", f"labels:{min(len(labels), 4)}", f"top:{labels[-1] in _TOP}", f"names:{min(len(names), 4)}", f"words:{min(3, max(x.count(' ') for x in [*names, *labels]))}"]
    dots = {x[0].strip()[:1] for x in _MARKS[1].finditer(host)}
    return [*f, *(f"dot:{c}" for c in sorted(dots))]


def _secret(text: str, start: int, end: int, key: str) -> list[str]:
    s = text[start:end]
    lower, upper, digit = (bool(re.search(x, s)) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    f = [f"key:{key}", f"length:{min(len(s) // 8, 6)}", f"mix:{lower:d}{upper:d}{digit:d}", f"distinct:{min(10, 10 * len(set(s.lower())) // min(len(s), 16))}"]
    if re.fullmatch("[0-9a-fA-F]+", s):
        f.append("hexadecimal")
    if text[start - 1 : start] in ("'", '"', "`") and start:
        f.append("quoted")
    if _FILLER.search(s):
        f.append("filler")
    if re.search(r"[()\[\]{}/\\]", s):
        f.append("code")
    if re.fullmatch(r"[a-z]+|[A-Z]?[a-z]+([._-][A-Za-z]+)*\.?", s):
        f.append("word")
    return f


_SEEN = {"number": _number, "hex": _hex, "email": _email, "spelled": _spelled}


def features(text: str, start: int, end: int, form: str, key: str = "") -> list[str]:
    """What the model sees of a whole segment of a form."""
    own = _secret(text, start, end, key) if form == "secret" else _SEEN[form](text, start, end)
    return [form, *(f"{form} {x}" for x in own + _edges(text, start, end))]


@dataclass
class Island:
    """A stretch of text to be cut into segments. values: (start, end, key word) of what follows a key word; spelled: whether an at or dot is spelled there."""

    start: int
    end: int
    values: list[tuple[int, int, str]] = field(default_factory=list)
    spelled: bool = False


def islands(text: str) -> list[Island]:
    """The islands of a text, in order, none overlapping another."""
    found = [Island(*m.span()) for m in _ISLAND.finditer(text)] if _HINT.search(text) else []
    done = 0
    for m in _SEPARATOR.finditer(text):
        if m.start() < done:
            continue  # part of a value
        low = max(0, m.start() - KEY_SPACE)
        key = _KEY.search(text[low : m.start()])
        value = _VALUE.match(text, m.end(), m.end() + 16 + SECRET[1]) if key else None
        if key and value:
            a, z = value.start(1), value.end(1)
            while z > a and not (text[z - 1].isalnum() or text[z - 1] in "=/+_-"):
                z -= 1
            if z - a >= SECRET[0]:
                done = z
                found.append(Island(low + key.start(), z, [(a, z, re.sub("[_-]", "", key[1].lower()))]))
    for m in _SPELLED.finditer(text):
        a, z = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if a:
            word = _WORD_START.search(text, a, m.start())
            a = word.start() if word else m.start()
        found.append(Island(a, z, spelled=True))
    found.sort(key=lambda x: (x.start, x.end))
    out: list[Island] = []
    for x in found:
        if out and x.start < out[-1].end:
            last = out[-1]
            last.end, last.spelled = max(last.end, x.end), last.spelled or x.spelled
            last.values += x.values
        else:
            out.append(x)
    return out


_NUMBER, _LOCAL_MARKS, _SPELLED_MARKS = frozenset(" .-()/+"), frozenset("._%+-@"), frozenset(" .-_+@()[]{}<>")
_HEX = re.compile("[0-9a-fA-F]{1,4}")


def candidates(text: str, island: Island, barred: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, int, list]]:  # type: ignore[assignment]
    """For each atom of an island: its number, start and end, and the segments that start there: (number of the atom after, end, form, key word).

    barred: sorted, disjoint spans that no segment may overlap."""
    ahead: deque[tuple[int, int, bool]] = deque()
    atoms = _ATOM.finditer(text, island.start, island.end)
    values = {a: (z, key) for a, z, key in island.values}
    longest, k, i, more = MAX_ATOMS, 0, 0, True
    while True:
        while more and len(ahead) <= longest:
            m = next(atoms, None)
            if m is None:
                more = False
                break
            while k < len(barred) and barred[k][1] <= m.start():
                k += 1
            ahead.append((m.start(), m.end(), not (k < len(barred) and barred[k][0] < m.end())))
        if not ahead:
            return
        start, end, free = ahead[0]
        out: list[tuple[int, int, str, str]] = []
        if free:
            if start in values:
                z, key = values[start]
                j = 0
                while more and ahead[-1][1] < z:  # a value may have more atoms than other entities
                    m = next(atoms)
                    while k < len(barred) and barred[k][1] <= m.start():
                        k += 1
                    ahead.append((m.start(), m.end(), not (k < len(barred) and barred[k][0] < m.end())))
                while j < len(ahead) and ahead[j][1] <= z and ahead[j][2]:
                    j += 1
                if j and ahead[j - 1][1] == z:
                    out.append((i + j, z, "secret", key))
            out += _walk(text, i, ahead, island.spelled)
        yield i, start, end, out
        ahead.popleft()
        i += 1


def _walk(text: str, i: int, ahead: deque[tuple[int, int, bool]], spelled: bool) -> list[tuple[int, int, str, str]]:
    """The segments from the first atom ahead that have a number's, an IPv6 address's or an email's form. Each form ends at the first atom it can't hold."""
    out = []
    c = text[ahead[0][0]]
    number, colon, mail, words = c in "0123456789+(", c in "0123456789abcdefABCDEF:", c.isalnum(), spelled and c.isalnum()
    digits = groups = marks = colons = ats = dots = at_words = dot_words = 0
    for j, (a, z, free) in enumerate(ahead):
        if j >= MAX_ATOMS or not free or not (number or colon or mail or words):
            break
        atom = text[a:z]
        is_word = atom[0].isalnum()
        if number:
            if is_word:
                digits, groups, marks = digits + z - a, groups + 1, 0
                number = digits <= 19 and groups <= MAX_GROUPS and atom.isdecimal() and atom.isascii()
            else:
                marks += 1
                number = atom in _NUMBER and marks <= 2 and (j == 0 or atom != "+")
            if number and is_word and digits >= 7 and (j or digits >= 16):
                out.append((i + j + 1, z, "number", ""))
        if colon:
            colons += atom == ":"
            colon = (atom == ":" or bool(_HEX.fullmatch(atom))) and colons <= 8
            if colon and is_word and colons >= 3:
                out.append((i + j + 1, z, "hex", ""))
        if mail:
            mail = is_word or atom in _LOCAL_MARKS
            ats += atom == "@"
            dots += ats > 0 and atom == "."
            mail &= ats <= 1
            if mail and is_word and ats and dots:
                out.append((i + j + 1, z, "email", ""))
        if words:
            low = atom.lower()
            words = is_word or atom in _SPELLED_MARKS
            at_words += low == "at" or atom == "@"
            dot_words += at_words > 0 and (low == "dot" or atom == ".")
            words &= at_words <= 1
            if words and is_word and at_words and dot_words and low not in ("at", "dot") and not mail:
                out.append((i + j + 1, z, "spelled", ""))
    return out


class Model:
    """names: the features' numbers; weights: a row a feature, a column a kind."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def score(self, f: list[str]) -> np.ndarray:
        return self.weights[[self.names[x] for x in f if x in self.names]].sum(axis=0)

    def spans(self, text: str, island: Island, barred: list[tuple[int, int]] = ()) -> Iterator[tuple[str, int, int]]:  # type: ignore[assignment]
        """The best segmentation. A way is (its score, its last segment and the way before it); segments that score nothing above 0 can't be part of the best."""
        now: tuple[float, tuple | None] = (0.0, None)
        ahead: dict[int, tuple[float, tuple]] = {}
        for i, start, _, found in candidates(text, island, barred):
            got = ahead.pop(i, None)
            if got and got[0] > now[0]:
                now = got
            if not ahead and now[1]:
                yield from _way(now[1])
                now = (0.0, None)
            for j, end, form, key in found:
                scores = self.score(features(text, start, end, form, key))
                t = int(scores.argmax())
                if scores[t] > 0 and now[0] + scores[t] > ahead.get(j, (0.0,))[0]:
                    ahead[j] = (now[0] + float(scores[t]), ((ALL_KINDS[t], start, end), now[1]))
        last = max([now, *ahead.values()], key=lambda x: x[0])
        if last[1]:
            yield from _way(last[1])


def _way(link: tuple | None) -> list[tuple[str, int, int]]:
    out = []
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


class Lattice:
    """All candidate segments of a short text, for training: (first atom, atom after), places and features."""

    def __init__(self, text: str):
        self.segments: list[tuple[int, int]] = []
        self.places: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        self.n = 0
        for island in islands(text):
            for i, start, _, found in candidates(text, island):
                for j, end, form, key in found:
                    self.segments.append((self.n + i, self.n + j))
                    self.places.append((start, end))
                    self.features.append(features(text, start, end, form, key))
            self.n += 1 + sum(1 for _ in _ATOM.finditer(text, island.start, island.end))


def _islands(seed: int, n: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Synthetic texts with their spans: personal data in many forms, and numbers and words that are none. Base spans are among them, as the model must tell their kinds apart too."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[r.integers(0, len(x))]
    word = lambda a=3, b=9: "".join(map(chr, r.integers(97, 123, r.integers(a, b))))
    string = lambda letters, a, b: "".join(letters[k] for k in r.integers(0, len(letters), r.integers(a, b)))
    small, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    mixed = small + small.upper() + "0123456789"
    top = lambda: pick("com", "org", "net", "de", "fr", "io")

    def card() -> str:
        x = pick("4", "5", "6") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        s = pick("", " ", "-", ".", "/")
        return s.join(x[i : i + 4] for i in range(0, 16, 4))

    def account() -> str:
        x = "0"
        while len(x) < 16 or luhn(x):
            x = d(int(r.integers(16, 20)))
        return x

    def phone() -> str:
        return pick(f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}")

    def ip() -> str:
        v6 = [f"{x:x}" for x in r.integers(0, 65536, 8)]
        left = int(r.integers(1, 5))
        return pick(".".join(map(str, r.integers(0, 256, 4))), ":".join(v6), f"{':'.join(v6[:left])}::{':'.join(v6[left : left + int(r.integers(2 if left < 2 else 1, 8 - left))])}")

    def email() -> str:
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" {at} ", " {dot} "), ("@", " dot "), (" at ", " (dot) "))
        spelled = f"{word()}{pick('', dot + word())}{at}{word()}{pick('', '', dot + word())}{dot}{top()}"
        return pick(spelled, spelled, f"{word()}.{d(2)}@{word()}.{word(2, 4)}", f"{word()}é{word()}@{word()}.{word()}.{top()}", f"{word()}_{d(3)}@{word()}-{word()}.{top()}", f"{word()}@{word()}.{top()}")

    def secret() -> tuple[str, str]:
        name = pick("token", "password", "secret", "api_key", "apikey", "API_KEY", "client_secret", "access_key", "passwd", "pwd", "auth_token", "private_key", "TOKEN", "Password")
        value = pick(string(hexes, 24, 65), string(hexes.upper(), 24, 65), string(mixed, 16, 48), string(mixed, 8, 16) + d(2), f"sk-{string(mixed, 20, 40)}", f"{word(4, 7).title()}{pick('!', '_', '#')}{d(4)}", f"{string(mixed, 20, 30)}/{string(mixed, 10, 20)}+{string(mixed, 4, 9)}==", "-".join(string(hexes, k, k + 1) for k in (8, 4, 4, 4, 12)))
        q = pick("", '"', '"', "'")
        return f"{name}{pick(' = ', '=', ': ', ':', ' => ')}{q}", value + q

    def none() -> str:
        return pick(
            f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"${d(3)},{d(3)}.{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", d(int(r.integers(1, 16))), f"{d(2)}.{d(6)}", f"{d(1)}.{d(16)}", f"{d(3)} {d(3)} {d(3)}", f"#{d(8)}", f"{word()}{d(4)}{word()}{d(5)}", f"@{word()}{d(2)}",
            f"{d(1)}.{d(1)}.{d(2)}.{d(4)}", f"{d(4)}/{d(4)}", f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{word()}={d(6)}{word()}{d(6)}", f"{d(12)} {d(5)}", f"{d(4)} {d(4)} {d(4)}", d(20), f"{d(3)}-{d(2)}-{d(4)}", f"{word()}@{word()} {d(3)}", f"+{d(2)}%", f"{d(2)}-{d(2)}-{d(4)}", ":".join(f"{x:02x}" for x in r.integers(0, 256, 6)),
            f"token = {word(4, 8)}_{word(4, 8)}()", f"password: {word(8, 12)}", f"secret: {word(8, 14)}.", f"key = '{word(4, 9)}-{word(4, 9)}'", f"token = {word()}.{word()}.{word()}", "password = changeme123", "api_key = ${API_KEY_2}", f"api_key = your-{word()}-key", f"key: {d(4)}-{d(2)}-{d(2)}T{d(2)}", f"token: {word(3, 6)}[{d(2)}].{word()}", f"auth: /{word()}/{word()}/{d(2)}", "token = xxxxxxxxxxxx", f"key={word(8, 12)}&{word()}={d(3)}",
            " ".join(str(r.integers(0, 10 ** int(r.integers(1, 5)))) for _ in range(r.integers(5, 12))), " ".join(d(int(r.integers(1, 5))) for _ in range(r.integers(5, 12))), ":".join(f"{x:x}" for x in r.integers(0, 65536, int(r.integers(9, 24)))), f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}",
            f"{word()} at {word()} and dot {word()}", f"at the {word()} dot {word()} {word()}", f"{word()} dot {word()} at {word()}", f"look at {word()} {word()} {word()} dot {word()}", f"a {word()} dot {word()}",
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "account": account}
    for _ in range(n):
        text, spans = pick("", "", f"{d(2)} ", f"{word()}{d(1)} ", "(", f"{word()}:", f"{word()} {word()} ", f"write to "), []
        for _ in range(r.integers(1, 4)):
            kind = pick(*ALL_KINDS, "", "", "", "")
            if kind == "secret":
                before, piece = secret()
                bare = piece.rstrip("\"'")
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(bare)))
                text += before
            else:
                piece = make[kind]() if kind else none()
                if kind:
                    spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + pick(" ", " ", ", ", "; ", ". ", f" {word()} {word()} ")
        yield text.rstrip(), spans


def train(n: int = TRAIN, epochs: int = EPOCHS, seed: int = 9) -> Model:
    """Maximises the regularised conditional likelihood of synthetic islands by stochastic gradient steps."""
    data = []
    names: dict[str, int] = {}
    for text, spans in _islands(seed, n):
        lattice = Lattice(text)
        place = {p: k for k, p in enumerate(lattice.places)}
        if lost := [(kind, text[s:e]) for kind, s, e in spans if (s, e) not in place]:
            raise ValueError(f"no segment for {lost} of {text!r}")
        gold = [(place[s, e], ALL_KINDS.index(kind)) for kind, s, e in spans]
        if lattice.segments:
            data.append((lattice, [np.array([names.setdefault(f, len(names)) for f in fs]) for fs in lattice.features], gold))
    w = np.zeros((len(names), len(ALL_KINDS)))
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in order.permutation(len(data)):
            lattice, fs, gold = data[k]
            scores = np.array([w[f].sum(axis=0) for f in fs])
            gradient = -_marginals(lattice, scores)
            for seg, t in gold:
                gradient[seg, t] += 1
            step = RATE / (1 + epoch)
            for i in np.flatnonzero(np.abs(gradient).max(axis=1) > 1e-3):
                w[fs[i]] += step * (gradient[i] - DECAY * w[fs[i]])
    return Model(names, w)


def _marginals(lattice: Lattice, scores: np.ndarray) -> np.ndarray:
    """Each segment's and kind's probability, by the forward and backward recursions."""
    n = max(j for _, j in lattice.segments)
    total = np.logaddexp.reduce(scores, axis=1)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(lattice.segments):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[lattice.segments[k][0]] + total[k] for k in ending[j])]) if j in ending else forward[j - 1]
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[lattice.segments[k][1]] + total[k] for k in starting[i])]) if i in starting else backward[i + 1]
    ends = np.array(lattice.segments)
    return np.exp(scores + (forward[ends[:, 0]] + backward[ends[:, 1]] - forward[n])[:, None])


@lru_cache(2)
def _trained(application: str, spark: SparkSession) -> Model:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            m = train()
            yield pd.DataFrame({"name": list(m.names), "place": list(m.names.values()), "weights": m.weights.tolist()})

    rows = spark.range(1, numPartitions=1).mapInPandas(run, "name string, place int, weights array<double>").orderBy("place").collect()
    return Model({r["name"]: r["place"] for r in rows}, np.array([r["weights"] for r in rows]))


def trained(spark: SparkSession) -> Model:
    """The model, trained in a task at its first use in an application."""
    return _trained(spark.sparkContext.applicationId, spark)


def _disjoint(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind as listed, then start."""
    base = base_spans(text)
    found, barred, k = list(base), _disjoint(base), 0
    for island in islands(text):
        while k < len(barred) and barred[k][1] <= island.start:
            k += 1
        last = k
        while last < len(barred) and barred[last][0] < island.end:
            last += 1
        found += model.spans(text, island, barred[k:last])
        k = max(k, last - 1)  # the last may reach beyond the island
    rank = {kind: i for i, kind in enumerate(ALL_KINDS)}
    return base, sorted(found, key=lambda x: (rank[x[0]], x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"


def find(docs: DataFrame, columns: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The named columns of docs (all, if none are named) with FIELDS: the counts by kind are of base spans, n_spans of all, n_added of the model's."""
    model = model or trained(docs.sparkSession)
    own = without(docs, *(f.split()[0] for f in FIELDS.split(", ")))
    columns = own.columns if columns is None else columns
    own = own.select(*columns, *([] if "text" in columns else ["text"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist():
                base, spans = all_spans((text or b"").decode("utf-8", "replace"), model)
                out.append((*(sum(x[0] == kind for x in base) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), len(spans) - len(base)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [*columns, *(f.split()[0] for f in FIELDS.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(columns)])
    return map_texts(own, rows, f"{schema}, {FIELDS}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), ["doc_id"])
