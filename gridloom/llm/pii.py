"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments (digits, separators, check sums, words before), and dynamic programming over
segments of bounded length chooses boundaries and kinds together. It is trained here, by maximum likelihood, on sentences
made from a fixed seed: data of every kind in many notations, among dates, prices, versions and other harmless numbers.
Only stretches with digits, ``@``, an unbroken run of RUN or more letters and digits, or a value behind a word such as
``password=`` are searched, so its work follows the number of candidates, not the text's length. Such a run is one token,
so a key of any length is one segment.

An entity is bounded: at most LONGEST tokens, BLANKS blanks and DIGITS digits outside long runs. A segment is a candidate if
it has MIN_DIGITS digits, a long run, ``@``, or is such a value. The search goes through a stretch token by token and holds
only the part of the best path that later tokens may still change, so a text may be of any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")
_ORDER = {k: i for i, k in enumerate(KINDS)}
LONGEST, BLANKS, DIGITS, MIN_DIGITS = 24, 6, 40, 6  # of a segment, see above
RUN = 16  # letters and digits in a row that are one token

# The four fixed patterns. Possessive forms match the same spans in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, "email", b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGIT.findall(m.group())) if m.end() - m.start() < 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[1]], s[2]))


# Candidate segments.

_TOKEN = re.compile(rf"[A-Za-z0-9]{{{RUN},}}|[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
_TRIGGER = re.compile(rf"[0-9@]|[A-Za-z0-9]{{{RUN},}}")
#: A word that announces a secret, and what stands between it and its value.
_ANNOUNCED = re.compile(r"(?:[Pp]assw(?:or)?d|PASSWORD|[Pp]wd|[Pp]assphrase|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])[\"']?[ ]?[=:][ ]?[\"']?(?=[^\s\"'])")
_CLOSING = set("\"',;)]}")
_WORD = re.compile(r"[^\W\d_]+")


def _triggers(text: str):
    """(start, end) of what makes its word worth a search, ascending by start."""
    announced = _ANNOUNCED.finditer(text) if "=" in text or ":" in text else iter(())
    value = next(announced, None)
    at = 0
    while m := _TRIGGER.search(text, at):
        while value and value.start() <= m.start():
            yield value.start(), value.end() + 1
            value = next(announced, None)
        yield m.span()
        at = m.end()
        while at < len(text) and not text[at].isspace():
            at += 1
    while value:
        yield value.start(), value.end() + 1
        value = next(announced, None)


def stretches(text: str):
    """Maximal runs of neighbouring words with a digit, an at sign, a long run or an announced value, as (start, end)."""
    n = len(text)
    lo = hi = -1
    for a, b in _triggers(text):
        if b <= hi:
            continue
        while a > max(hi, 0) and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        if lo >= 0 and a - hi <= 1:
            hi = b
        else:
            if lo >= 0:
                yield lo, hi
            lo, hi = a, b
    if lo >= 0:
        yield lo, hi


_HELD = 4096  # tokens of a stretch that are held before the oldest go


def candidates(text: str, before: str):
    """For each token of a stretch, in order: (start, end, segments that end with it), a segment being (its first token,
    features). Only the last tokens are held."""
    outside = [w.lower() for w in _WORD.findall(before[-40:])][-2:]
    announced = (m.end() for m in _ANNOUNCED.finditer(text))
    value = next(announced, -1)
    found = _TOKEN.finditer(text)
    tokens, starts, digits, blanks, runs, signs, values = [], [], [0], [0], [0], [0], []
    base = 0  # number of the first token held

    def push(m) -> None:
        nonlocal value
        t = m.group()
        run = len(t) >= RUN
        tokens.append(t)
        starts.append(m.start())
        digits.append(digits[-1] + (len(t) if not run and t[0] in "0123456789" else 0))
        blanks.append(blanks[-1] + t.isspace())
        runs.append(runs[-1] + run)
        signs.append(signs[-1] + (t == "@"))
        while 0 <= value < m.start():
            value = next(announced, -1)
        values.append(value == m.start())

    m = next(found, None)
    while m:
        push(m)
        end = m.end()
        m = next(found, None)
        right = m.group() if m else " "
        j = len(tokens)
        ends_well = tokens[-1][0].isascii() and tokens[-1][0].isalnum()
        closes = right.isspace() or right in _CLOSING
        out = []
        if ends_well or closes:
            for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
                if blanks[j] - blanks[i] > BLANKS or digits[j] - digits[i] > DIGITS:
                    break
                first = tokens[i][0]
                given = values[i] and closes and blanks[j] == blanks[i] and end - starts[i] >= 6
                if not given:
                    if not ends_well or not (first.isascii() and first.isalnum() or first in "+("):
                        continue
                    if digits[j] - digits[i] < MIN_DIGITS and runs[j] == runs[i] and not (j - i >= 5 and signs[j] > signs[i]):
                        continue
                left = tokens[i - 1] if i else " "
                if i == 0:
                    near = outside if not base else []
                else:
                    near = [t.lower() for t in tokens[max(0, i - 5) : i] if t[0].isalpha()][-2:] or (outside if i + base < 4 else [])
                out.append((i + base, features(text[starts[i] : end], left, right, tuple(near)) + (("given",) if given else ())))
        yield starts[-1], end, out
        if j >= _HELD:
            gone = j - 2 * LONGEST
            base += gone
            for held in (tokens, starts, digits, blanks, runs, signs, values):
                del held[:gone]


class Lattice:
    """Tokens of one short stretch and the segments that could be data, each with its features."""

    def __init__(self, text: str, before: str):
        self.tokens: list[tuple[int, int]] = []
        self.segments: list[tuple[int, int, tuple[str, ...]]] = []  # first token, end token, features
        for start, end, segments in candidates(text, before):
            self.tokens.append((start, end))
            self.segments += [(i, len(self.tokens), f) for i, f in segments]


def _shape(s: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: "9" * min(len(m.group()), 5), s)
    out = re.sub(r"[A-Z]+", lambda m: "A" * min(len(m.group()), 3), out)
    return re.sub(r"[a-z]+", "a", out)


@lru_cache(20_000)
def features(s: str, left: str, right: str, words: tuple[str, ...]) -> tuple[str, ...]:
    """Features of a whole segment."""
    digits = "".join(c for c in s if c in "0123456789")
    letters = sum(c.isalpha() for c in s)
    n = len(digits)
    seps = "".join(sorted({c for c in s if not c.isalnum()}))
    groups = tuple(len(g) for g in re.findall(r"[0-9]+", s))
    out = [
        "bias",
        f"n={min(n, 24)}",
        f"seps={seps}",
        f"letters={min(letters, 3) if not s.isascii() or letters < 4 else 4}",
        f"first={'9' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}",
        f"edges={_edge(left)}{_edge(right)}",
        f"numeric={letters == 0}",
    ]
    if letters == 0:
        out += [f"groups={groups[:6]}", f"luhn={n}{luhn(digits)}" if 12 <= n <= 19 else "luhn=-"]
        if s.count(".") == 3 and len(groups) == 4:
            out.append(f"octets={all(int(g) < 256 for g in s.split('.') if g.isdigit() and len(g) < 10) and max(groups) <= 3}")
        out.append(f"one_sep={len(seps) <= 1}")
    else:
        bare = s.replace(" ", "")
        if "@" in s:
            out.append(f"email={bool(re.fullmatch(r'[^@ ]+@[^@ ]+[.][A-Za-z]{2,}', s))}")
        if len(bare) >= 14:
            out.append(f"iban={bool(re.fullmatch(r'[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}', bare)) and _iban(bare)}")
        run = max((len(x) for x in re.findall(r"[A-Za-z0-9_/+]+", s)), default=0)
        changes = len(re.findall(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]", s))
        kind = "word" if re.fullmatch(r"[A-Z]?[a-z]+", s) else "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "upper" if s.isupper() else "mixed" if s.isalnum() else "other"
        out.append(f"cases={min(len(re.findall(r'(?<=[a-z])[A-Z]', s)), 6)}{n > 0}")
        out += [f"run={run // 4 if run < 40 else 10}", f"changes={min(changes, 5)}", f"alnum={s.isalnum()}", f"code={kind}{min(len(s) // 4, 10)}{changes > 2}"]
    if len(s) <= 24:
        out.append(f"shape={_shape(s)}")
    out += [f"word={w}" for w in words]
    return tuple(out)


def _edge(t: str) -> str:
    return " " if t.isspace() else "9" if t[0].isdigit() else "a" if t[0].isalpha() else t[0]


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Field:
    """Weights by feature, one for each kind; a token outside segments scores 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.none = np.zeros(len(KINDS))

    def scores(self, feats: tuple[str, ...]) -> np.ndarray:
        return sum((self.weights[f] for f in feats if f in self.weights), self.none)

    def best(self, stretch) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the best segmentation: characters within the stretch, from its ``candidates``.

        Of equal sums, the one with fewer segments towards the end. What the last LONGEST tokens have in common of their
        best paths is settled and leaves the memory.
        """
        out: list[tuple[int, int, str]] = []
        # Of tokens since ``base``: their limits, the best sum up to each, and the segment that ends there, if any.
        base, limits, value, back = 0, [], [0.0], [None]

        def path(j: int, stop: int):
            """Segments of the best path to token j, last first, and the places it goes through."""
            spans, places = [], {j}
            while j > stop:
                if back[j - base] is None:
                    j -= 1
                else:
                    i, k = back[j - base]
                    spans.append((limits[i - base][0], limits[j - 1 - base][1], KINDS[k]))
                    j = i
                places.add(j)
            return spans, places

        for start, end, segments in stretch:
            limits.append((start, end))
            top, at = value[-1], None
            for i, feats in segments:
                s = self.scores(feats)
                k = int(s.argmax())
                if value[i - base] + s[k] > top:
                    top, at = value[i - base] + s[k], (i, k)
            value.append(top)
            back.append(at)
            n = base + len(limits)
            if len(limits) >= _HELD:
                shared = set.intersection(*(path(j, base)[1] for j in range(n - LONGEST, n + 1)))
                settled = max(shared)
                out += path(settled, base)[0][::-1]
                gone = settled - base
                base = settled
                del limits[:gone], value[:gone], back[:gone]
        return out + path(base + len(limits), base)[0][::-1]

    def gradient(self, lattice: Lattice, gold: dict[tuple[int, int], int]) -> dict[str, np.ndarray]:
        """Observed less expected feature counts, by forward and backward sums over segmentations."""
        n = len(lattice.tokens)
        starting: list[list] = [[] for _ in range(n + 1)]
        ending: list[list] = [[] for _ in range(n + 1)]
        for i, j, feats in lattice.segments:
            s = self.scores(feats)
            top = float(s.max())
            item = (i, j, feats, s, top + math.log(float(np.exp(s - top).sum())))
            starting[i].append(item)
            ending[j].append(item)

        def add(x: float, y: float) -> float:
            return max(x, y) + math.log1p(math.exp(-abs(x - y)))

        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            a[j] = a[j - 1]
            for i, _, _, _, total in ending[j]:
                a[j] = add(a[j], a[i] + total)
        for i in range(n - 1, -1, -1):
            b[i] = b[i + 1]
            for _, j, _, _, total in starting[i]:
                b[i] = add(b[i], b[j] + total)
        out: dict[str, np.ndarray] = {}
        for items in starting:
            for i, j, feats, s, _ in items:
                g = -np.exp(np.minimum(a[i] + s + b[j] - a[n], 0.0))
                if (i, j) in gold:
                    g[gold[i, j]] += 1
                if np.abs(g).max() > 1e-4:
                    for f in feats:
                        out[f] = out[f] + g if f in out else g.copy()
        return out


# Training sentences.


def _digits(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _pick(r, items):
    return items[int(r.integers(len(items)))]


def _with_check(r, n: int) -> str:
    body = _pick(r, "3456") + _digits(r, n - 2)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _grouped(s: str, sep: str, size: int = 4) -> str:
    return sep.join(s[i : i + size] for i in range(0, len(s), size))


def _make_iban(r) -> str:
    country, body = _pick(r, ["DE", "FR", "ES", "GB", "NL", "IT"]), _digits(r, int(r.integers(14, 23)))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    s = f"{country}{check:02d}{body}"
    return s if r.random() < 0.5 else _grouped(s, " ")


def _one(r, kind: str) -> str:
    d = lambda n: _digits(r, n)
    if kind == "email":
        name = _pick(r, ["anna", "j", "kim.lee", "info", "x_y", "mo-ra", "bestel"]) + _pick(r, ["", d(2), "." + d(2)])
        return name + "@" + _pick(r, ["mail", "web", "host-", "a"]) + _pick(r, ["", d(1)]) + _pick(r, [".example.com", ".org", ".co.uk", ".de", ".example.net"])
    if kind == "ip":
        return ".".join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        s = _with_check(r, int(_pick(r, [13, 14, 15, 16, 16, 16, 19])))
        return _pick(r, [s, s, _grouped(s, " "), _grouped(s, "-"), _grouped(s, ".")])
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return _pick(r, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {d(7)}", f"+{d(2)}{d(9)}", f"{a}.{b}.{c}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{_pick(r, ['49', '33', '34'])} {a} {d(6)}", f"1-{a}-{b}-{c}"])
    if kind == "iban":
        return _make_iban(r)
    if kind == "ssn":
        return f"{d(3)}-{d(2)}-{d(4)}"
    upper, lower, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    code = lambda alphabet, n: "".join(_pick(r, alphabet) for _ in range(n))
    both = upper + lower + "0123456789"
    return _pick(r, [
        "AKIA" + code(upper + "0123456789", 16), code(hexa, int(r.integers(16, 65))), code(both, int(r.integers(20, 65))),
        _pick(r, ["ghp_", "sk_live_", "pk_test_", "glpat-", "xoxb-"]) + code(_pick(r, [both, both, upper + lower]), int(r.integers(20, 41))),
    ])


def _password(r) -> str:
    """A short secret, to stand behind a word that announces it."""
    word = "".join(_pick(r, "bdfghklmnprstvz") + _pick(r, "aeiou") + _pick(r, ["", "n", "r", "t"]) for _ in range(int(r.integers(2, 4))))
    return _pick(r, [word + _digits(r, 1) + word[:3], word.capitalize() + _digits(r, int(r.integers(2, 5))), word + _pick(r, "!#$_") + _digits(r, 2), _digits(r, 3) + word + _pick(r, "!?*")])


def _harmless(r) -> str:
    d = lambda n: _digits(r, n)
    return _pick(r, [
        f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(1)}", d(4), f"{d(1)},{d(3)},{d(3)}", f"${d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}",
        f"{d(3)} {d(3)}", d(7), d(8), d(6), f"{d(2)}%", f"#{d(6)}", f"no.{d(5)}", f"{d(4)}-{d(4)}", f"{d(4)} {d(4)}", f"v{d(2)}.{d(2)}.{d(4)}", f"{d(3)}.{d(3)},{d(2)}", f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}",
        _long_word(r), _long_word(r), f"abc{d(3)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{300 + int(d(2))}.{d(3)}.{d(3)}.{d(2)}", _bad_card(r), f"{d(5)} {d(5)} {d(5)}", f"@{d(2)} {d(2)}", "a @ b", f"page{d(2)}@{d(1)}",
    ])


def _long_word(r) -> str:
    """A word, name or run of words without blanks, of RUN or more letters."""
    parts = []
    while sum(map(len, parts)) < RUN:
        parts.append("".join(_pick(r, "bdfgklmnprstvz") + _pick(r, "aeiou") + _pick(r, ["", "", "n", "r", "s", "ch"]) for _ in range(int(r.integers(1, 4)))))
    word = "".join(parts)
    return _pick(r, [word, word, word.capitalize(), word.upper(), "".join(p.capitalize() for p in parts), word + _digits(r, int(r.integers(1, 5)))])


def _bad_card(r) -> str:
    s = _with_check(r, 16)
    return s[:-1] + str((int(s[-1]) + int(r.integers(1, 10))) % 10)


_BEFORE = {
    "email": ["mail", "contact", "write to"], "ip": ["ip", "from", "host"], "card": ["card", "visa", "paid by"], "phone": ["call", "tel", "phone"],
    "iban": ["iban", "account", "pay to"], "secret": ["key", "token =", "password=", "secret:"], "ssn": ["ssn", "social", "number"],
}


def training_set(n: int = 700, seed: int = 11) -> list[tuple[str, str, list[tuple[int, int, str]]]]:
    """(stretch, text before it, spans in it): about half the pieces are harmless."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        before = _pick(r, ["", "the edhe", "of thonin", "und eine", "le queau"])
        for k in range(int(r.integers(1, 4))):
            if r.random() < 0.12:
                glue = _pick(r, ["password=", "password: ", "pwd=", "Password: ", "secret=", "token: ", 'token = "', "api_key=", "passwd: "])
                hidden = r.random() < 0.6
                piece = _password(r) if hidden else _long_word(r)[: int(r.integers(4, 12))].lower().rstrip("0123456789")
                text += glue
                if hidden:
                    spans.append((len(text), len(text) + len(piece), "secret"))
                text += piece + ('"' if glue[-1] == '"' else "")
            elif r.random() < 0.5:
                kind = _pick(r, KINDS)
                if k == 0 and r.random() < 0.3:
                    before = _pick(r, _BEFORE[kind])
                piece = _one(r, kind)
                glue = "password=" if kind == "secret" and r.random() < 0.3 else _pick(r, ["", "", "", '"', "("])
                text += glue
                spans.append((len(text), len(text) + len(piece), kind))
                text += piece + _pick(r, ["", "", "", ".", ",", ")"])
            else:
                text += _harmless(r) + _pick(r, ["", "", ".", ","])
            text += " "
        out.append((text.rstrip(), before, spans))
    return out


def train(rows: list | None = None, epochs: int = 6, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps (Adagrad), a sentence at a time, with a small penalty."""
    field, square = Field({}), {}
    data = []
    for text, before, spans in rows if rows is not None else training_set():
        lattice = Lattice(text, before)
        start = {a: i for i, (a, _) in enumerate(lattice.tokens)}
        end = {b: i + 1 for i, (_, b) in enumerate(lattice.tokens)}
        gold = {(start[a], end[b]): KINDS.index(k) for a, b, k in spans if a in start and b in end}
        data.append((lattice, gold))
    for _ in range(epochs):
        for lattice, gold in data:
            for f, g in field.gradient(lattice, gold).items():
                w = field.weights.setdefault(f, np.zeros(len(KINDS)))
                g = g - decay * w
                square[f] = square.get(f, 1e-8) + g * g
                w += rate * g / np.sqrt(square[f])
    return field


@lru_cache(1)
def trained() -> Field:
    """The field trained on the made sentences, once a process; the same in every process."""
    return train()


def find(text: str | None, field: Field) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and the field's that overlap none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    added, k = [], 0
    for lo, hi in stretches(text):
        for a, b, kind in field.best(candidates(text[lo:hi], text[max(0, lo - 40) : lo])):
            added.append((lo + a, kind, lo + b))
    ends: list[tuple[int, int]] = []
    for a, _, b in base:  # merged, so that one look backwards is enough
        if ends and a < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    more = []
    for a, kind, b in added:
        while k < len(ends) and ends[k][1] <= a:
            k += 1
        if k == len(ends) or ends[k][0] >= b:
            more.append((a, kind, b))
    return base, sorted(base + more, key=lambda s: (s[0], _ORDER[s[1]], s[2]))


def written(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def detect(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans.

    Null and empty texts have no spans. Texts are searched whole. Offsets are in code points. Of segmentations with equal
    sums the one found first counts, so a text always has the same spans. Repeated rows are searched each; rows with null id
    too; other columns are ignored; an empty table gives none.
    """
    weights = (field or trained()).weights

    def run(batches):
        import pyarrow as pa

        own = Field(weights)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [find(t, own) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in BASE_KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([written(b) for b, _ in found], pa.string()), pa.array([written(s) for _, s in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans"],
                )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_spans string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; all columns and rows stay, null texts too."""
    weights = (field or trained()).weights

    def run(batches):
        import pyarrow as pa

        own = Field(weights)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [cover(t, find(t, own)[1]) for t in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, part.column(at).type))

    return docs.mapInArrow(run, docs.schema)


def cover(text: str | None, spans: list) -> str | None:
    """The text with spans replaced; of spans that overlap, the first names the whole stretch they cover."""
    if text is None:
        return None
    out, at, k = [], 0, 0
    while k < len(spans):
        a, kind, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


def op8(spark, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
