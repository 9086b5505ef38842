"""Exact tokenisation with the ``tokenizers`` library, a word at a time with a bounded cache.

Both vocabularies split a text into pre-tokens before merging, so a text's ids are those of its units one after another
for any cut that is a pre-token boundary in every context. Cut points used here:

* ``word`` (white space is dropped): every run of white space.
* ``byte`` (byte level, a blank opens the next pre-token): before a blank that is followed by a non-blank character.

Frequent units come from the cache. A unit that is plain letters and punctuation is cut into its pre-tokens here and
goes straight to the library's BPE model; any other unit takes the library's whole pipeline.
"""

from __future__ import annotations

import re

import numpy as np

_ODD = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"(?= \S)")
_DOUBLE = re.compile(r" (?:\s|\Z)")
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[.,;:!?*$%&#|()\[\]\"-]+"
#: Pre-tokens of a plain unit, in order.
_PLAIN = {
    "word": re.compile(f"({_LETTERS})({_MARKS})?"),
    "byte": re.compile(f"( ?{_LETTERS})({_MARKS})?(?:(\n)({_LETTERS})({_MARKS})?)?"),
}


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself where printable, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_STAND_IN = _byte_characters()


def word_units(text: str) -> list[str]:
    return [text] if _ODD.search(text) else text.split()


def byte_units(text: str) -> list[str]:
    if not text:
        return []
    if _DOUBLE.search(text):
        return [u for u in _CUT.split(text) if u]
    head, *rest = text.split(" ")
    rest = [" " + w for w in rest]
    return [head, *rest] if head else rest


class Units(dict):
    """Ids of units seen so far. Full, it keeps what it has, and starts anew once a fifth of the look-ups miss."""

    def __init__(self, compute, cap: int, longest: int):
        super().__init__()
        self.compute, self.cap, self.longest, self.late = compute, cap, longest, 0

    def __missing__(self, unit: str) -> bytes:
        ids = self.compute(unit)
        if len(unit) <= self.longest:
            # The second half is for bare words: with them at hand, a word with marks is put together quickly.
            if len(self) < (self.cap if unit[-1].isalpha() else self.cap // 2):
                self[unit] = ids
            else:
                self.late += 1
        return ids

    def renew(self, looked_up: int) -> None:
        if self.late > max(self.cap, looked_up // 5):
            self.clear()
        if looked_up > 5 * self.cap:
            self.late = 0


class CachedEncoder:
    """Texts to little-endian id bytes. ``cap`` bounds the cached units, ``longest`` the length of a cached unit.

    ``special_as_text``: the string of a special token in a text is ordinary text, as the notes that come with the
    vocabularies load them, so no document can forge the end of another. Without it such a string is its one id.
    """

    def __init__(self, path: str, kind: str, dtype: str = "<u2", cap: int = 300_000, longest: int = 32, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.units = {"word": word_units, "byte": byte_units}[kind]
        self.plain, self.lower = _PLAIN[kind].fullmatch, kind == "word"
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError(f"ids do not fit {dtype}")
        self.id_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.merge = self.tokenizer.model.tokenize
        self.cache = Units(self._unit, cap, longest)
        self.marks: dict[str, bytes] = {}
        self.looked_up = 0

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token of plain letters or marks."""
        shown = part.encode().decode("latin-1").translate(_STAND_IN) if not part.isascii() or part[0] in " \n" else part
        return b"".join([self.id_bytes[t.id] for t in self.merge(shown)])

    def _unit(self, unit: str) -> bytes:
        m = self.plain(unit)
        if m is None:
            return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        word, marks, *more = m.groups()
        if marks is None and not any(more):
            return self._part(word.lower() if self.lower else word)
        out = self.cache[word.lower() if self.lower else word]
        for part in (marks, *more):
            if part:
                if len(part) > 2:
                    out += self._part(part)
                else:
                    if part not in self.marks:
                        self.marks[part] = self._part(part)
                    out += self.marks[part]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; None counts as empty."""
        if not text:
            return b""
        if any(t in text for t in self.special):  # it may stand within a unit, or cut one
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        units = self.units(text)
        self.looked_up += len(units)
        out = b"".join(map(self.cache.__getitem__, units))
        if self.looked_up > 6 * self.cache.cap:
            self.cache.renew(self.looked_up)
            self.looked_up = 0
        return out


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, kind: str) -> CachedEncoder:
    """One encoder a Python worker: tasks that follow find its cache warm."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = CachedEncoder(path, kind)
    return _ENCODERS[path, kind]
