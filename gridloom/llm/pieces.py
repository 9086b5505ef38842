"""SentencePiece encoding and decoding in batches of equal-length words.

A text's words (each with the marker characters before it) are independent, as no piece has a marker after another
character. Words that are not in the cache are grouped by length and advance together: rolling hashes of all their
substrings probe the sorted hashes of the pieces, which gives a table (word, start, length) of piece ids. Over this table

* ``viterbi`` finds the segmentation with the largest sum of scores: vectorised maxima over start positions store
  back-pointers, one step a character;
* ``merges`` joins, in every word at once, the adjacent pair with the best score, until none is a piece. That is how a
  model of type BPE encodes; no search for a best sum gives the same ids.

Words beyond LONG characters go alone: the same search from start to start, and merges from a heap of pairs, so the work
grows with the length (times its logarithm) and not with its square.

Characters without a piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common

MARK = "\u2581"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+\\Z")
LONG = 64
_UNKNOWN_PENALTY = 10.0  # as the library has it, below the least score


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields; bytes, integers, or 4 or 8 raw bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The vocabulary of a model file."""

    #: Fixed numbers of the model format: piece types and model types.
    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
    UNIGRAM, BPE = 1, 2

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.text, self.kind, scores = [], [], []
        self.model_type, self.dummy_prefix, self.unknown = self.UNIGRAM, True, 0
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece[2], "<f4")[0] if 2 in piece else 0.0)
                self.kind.append(piece.get(3, self.NORMAL))
            elif number == 2:
                self.model_type = dict(fields(value)).get(3, self.UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                self.dummy_prefix = bool(spec.get(3, 1))
        self.scores = np.array(scores, dtype=np.float64)
        normal = [i for i, k in enumerate(self.kind) if k in (self.NORMAL, self.USER)]
        if any(re.search(f"[^{MARK}]{MARK}", self.text[i]) for i in normal):
            raise ValueError("a piece goes beyond a word")
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == self.BYTE}
        self.longest = max(len(self.text[i]) for i in normal)
        codes = [np.array([ord(c) for c in self.text[i]], dtype=np.uint64) for i in normal]
        keys = np.array([self._key(c) for c in codes], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # Which of 2**22 values the keys' top bits take: most substrings that are no piece end here, without a search.
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.codes = np.zeros((len(normal), self.longest), dtype=np.uint64)
        for row, k in enumerate(order):
            self.codes[row, : len(codes[k])] = codes[k]
        self.worst = float(self.scores[normal].min()) - _UNKNOWN_PENALTY
        self.surface = [bytes([int(t[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else t.replace(MARK, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]

    @staticmethod
    def _key(codes: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = h * _BASE + c + np.uint64(1)
        return h

    def table(self, words: np.ndarray) -> np.ndarray:
        """ids[w, start, length - 1] of the pieces in words of one length (rows of code points), -1 for none."""
        n, size = words.shape
        most = min(size, self.longest)
        found = np.full((n, size, most), -1, dtype=np.int32)
        with np.errstate(over="ignore"):
            prefix = np.zeros((n, size + 1), dtype=np.uint64)
            for j in range(size):
                prefix[:, j + 1] = prefix[:, j] * _BASE + words[:, j] + np.uint64(1)
            power = np.uint64(1)
            for length in range(1, most + 1):
                power = power * _BASE
                h = prefix[:, length:] - prefix[:, :-length] * power
                w, i = np.nonzero(self.seen[(h >> np.uint64(42)).view(np.int64)])
                if len(w):
                    some = h[w, i]
                    row = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
                    hit = self.keys[row] == some
                    w, i, row = w[hit], i[hit], row[hit]
                    same = np.ones(len(w), bool)  # a hash that agrees is followed up character by character
                    for k in range(length):
                        same &= self.codes[row, k] == words[w, i + k]
                    if length < self.longest:
                        same &= self.codes[row, length] == 0
                    found[w[same], i[same], length - 1] = self.ids[row[same]]
        return found

    def viterbi(self, words: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Each word's best segmentation by sum of scores, over its table of pieces.

        Of equal sums, the earlier start of the last piece.
        """
        n, size = words.shape
        if size > LONG:
            return [self._one(words[k : k + 1], ids[k : k + 1], self._best_sum) for k in range(n)]
        score = np.where(ids >= 0, self.scores[ids], -np.inf)
        alone = ids[:, :, 0] < 0
        score[:, :, 0] = np.where(alone, self.worst, score[:, :, 0])
        best, back = np.zeros((n, size + 1)), np.zeros((n, size + 1), dtype=np.int64)
        for j in range(1, size + 1):
            lo = max(0, j - self.longest)
            starts = np.arange(lo, j)
            sums = best[:, lo:j] + score[:, starts, j - starts - 1]
            k = sums.argmax(axis=1)
            best[:, j], back[:, j] = sums[np.arange(n), k], lo + k
        w, j = np.arange(n), np.full(n, size)
        steps = []
        while len(w):
            i = back[w, j]
            steps.append((w, i, j))
            w, j = w[i > 0], i[i > 0]
        w, i, j = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((i, w))
        return self._flat(words, ids, w[order], i[order], j[order])

    def merges(self, words: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Each word by merging: always the best-scored adjacent pair, of equal ones the leftmost."""
        n, size = words.shape
        if size > LONG:
            return [self._one(words[k : k + 1], ids[k : k + 1], self._merged) for k in range(n)]
        end = np.tile(np.arange(1, size + 2), (n, 1))  # of the symbol that starts here; 0: none starts here
        end[:, size] = 0
        place = np.arange(size)
        live = np.arange(n)
        while len(live) and size > 1:
            e = end[live]
            stop = np.take_along_axis(e, np.minimum(e[:, :size], size), axis=1)  # end of the pair
            length = stop - place
            ok = (e[:, :size] > 0) & (stop > 0) & (length <= ids.shape[2])
            pair = np.where(ok, ids[live[:, None], place, np.clip(length - 1, 0, ids.shape[2] - 1)], -1)
            score = np.where(pair >= 0, self.scores[pair], -np.inf)
            k = score.argmax(axis=1)
            some = np.isfinite(score[np.arange(len(live)), k])
            live, k, e, stop = live[some], k[some], e[some], stop[some]
            row = np.arange(len(live))
            end[live, e[row, k]] = 0
            end[live, k] = stop[row, k]
        w, i = np.nonzero(end[:, :size])
        return self._flat(words, ids, w, i, end[w, i])

    def _one(self, word: np.ndarray, ids: np.ndarray, method) -> bytes:
        """One long word, by a method that gives the ends of its segments."""
        ends = np.array(method(ids[0]), dtype=np.int64)
        return self._flat(word, ids, np.zeros(len(ends), np.int64), np.concatenate(([0], ends[:-1])), ends)[0]

    def _best_sum(self, ids: np.ndarray) -> list[int]:
        """``viterbi`` for one word: each start passes its sum on; of equal sums the first to come stays."""
        size = len(ids)
        best, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
        for lo in range(0, size, 4096):
            part = ids[lo : lo + 4096].copy()
            score = np.where(part >= 0, self.scores[part], -np.inf)
            score[:, 0] = np.where(part[:, 0] < 0, self.worst, score[:, 0])
            at, length = np.nonzero(score > -np.inf)
            for i, n, s in zip((at + lo).tolist(), (length + 1).tolist(), score[at, length].tolist(), strict=True):
                total = best[i] + s
                if total > best[i + n]:
                    best[i + n], back[i + n] = total, i
        ends, j = [], size
        while j:
            ends.append(j)
            j = back[j]
        return ends[::-1]

    def _merged(self, ids: np.ndarray) -> list[int]:
        """``merges`` for one word: pairs wait in a heap by score and place; one whose halves have changed is passed over."""
        size, most = ids.shape
        end = list(range(1, size + 1))  # of the symbol that starts here; 0: none starts here
        before = list(range(-1, size - 1))
        scores, heap = self.scores, []

        def push(i: int, middle: int) -> None:
            stop = end[middle]
            if stop - i <= most and (piece := ids[i, stop - i - 1]) >= 0:
                heapq.heappush(heap, (-scores[piece], i, middle, stop))

        for i in range(size - 1):
            push(i, i + 1)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < size:
                before[stop] = i
                push(i, stop)
            if i:
                push(before[i], i)
        return [e for e in end if e]

    def _flat(self, words: np.ndarray, ids: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers, from its segments (w, i, j) in order."""
        got = ids[w, i, j - i - 1]
        edge = np.searchsorted(w, np.arange(len(words) + 1))
        data = got.astype("<u4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in itertools.pairwise(edge.tolist())]
        for word in np.unique(w[got < 0]).tolist():
            flat: list[int] = []
            for at in range(edge[word], edge[word + 1]):
                if got[at] >= 0:
                    flat.append(int(got[at]))
                elif self.bytes:
                    flat += [self.bytes[b] for b in chr(int(words[word, i[at]])).encode()]
                else:
                    flat.append(self.unknown)
            out[word] = struct.pack(f"<{len(flat)}I", *flat)
        return out


class _Known(dict):
    """Ids of words that are kept; of any other, those of the texts at hand."""

    over: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.over[word]


class Encoder:
    """Encodes texts by one or more methods over one table of substrings.

    Ids of words seen are kept, up to ``cap`` of them; a full cache stays as it is, and starts anew when more words miss
    it than it holds, within ten times as many look-ups.
    """

    def __init__(self, pieces: Pieces, methods: tuple[str, ...], cap: int = 200_000, longest: int = 40):
        self.pieces, self.cap, self.longest = pieces, cap, longest
        self.segment = [{"viterbi": pieces.viterbi, "merges": pieces.merges}[m] for m in methods]
        self.known = [_Known() for _ in methods]
        self.late = self.looked_up = 0

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return _WORD.findall((MARK if self.pieces.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each method, the ids of each text as little-endian 32-bit integers; None counts as empty."""
        cut = [self.words(t) if t else [] for t in texts]
        new = self._new(set().union(*cut).difference(self.known[0]))
        words = [w for w in new[0] if len(w) <= self.longest]
        room = max(0, self.cap - len(self.known[0]))
        out = []
        for known, more in zip(self.known, new, strict=True):
            known.update({w: more[w] for w in words[:room]})
            known.over = more
            out.append([b"".join(map(known.__getitem__, x)) for x in cut])
            known.over = {}
        self.late += max(0, len(words) - room)
        self.looked_up += sum(map(len, cut))
        if self.late > self.cap and self.looked_up < 10 * self.cap:
            for known in self.known:
                known.clear()
        if self.late > self.cap or self.looked_up > 10 * self.cap:
            self.late = self.looked_up = 0
        return out

    def _new(self, words: set[str]) -> list[dict[str, bytes]]:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: list[dict[str, bytes]] = [{} for _ in self.segment]
        for size, group in by_length.items():
            step = max(1, 200_000 // (size * min(size, self.pieces.longest)))  # bounds the table of substrings
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), size).astype(np.uint64)
                table = self.pieces.table(codes)
                for segment, to in zip(self.segment, out, strict=True):
                    to.update(zip(part, segment(codes, table), strict=True))
        return out


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of some ids: surfaces one after another, bytes as UTF-8, without the prefix blank."""
    data = b"".join(map(pieces.surface.__getitem__, ids.tolist()))
    if pieces.dummy_prefix and data[:1] == b" ":
        data = data[1:]
    return data.decode("utf-8", errors="replace")


_LOADED: dict[tuple, Encoder] = {}


def _loaded(path: str, methods: tuple[str | None, ...]) -> Encoder:
    """One encoder a Python worker. The method None is the model type's own."""
    if (path, methods) not in _LOADED:
        pieces = Pieces(path)
        own = "merges" if pieces.model_type == Pieces.BPE else "viterbi"
        _LOADED[path, methods] = Encoder(pieces, tuple(m or own for m in methods))
    return _LOADED[path, methods]


def encode_documents(docs: DataFrame, model_path: str, method: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, 32-bit little endian) of each row, by ``method``: the model type's own if None.

    Null and empty texts have no ids. Texts are encoded whole. Repeated rows are encoded each; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        encoder = _loaded(model_path, (method,))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.encode(part.column(1).to_pylist())[0], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def run(batches):
        import pyarrow as pa

        pieces = _loaded(model_path, (None,)).pieces
        for batch in batches:
            texts = [None if b is None else decode(pieces, np.frombuffer(b, "<u4")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both encodings of each whole text, decoded again.

    doc_id, n_viterbi, viterbi_crc32 (the best sum of scores), n_ids, ids_crc32 (the model type's own ids), same_text
    (both decode to the text itself). Null and empty texts have no ids; a null text decodes to an empty one and counts as
    the same. Of equal sums the earlier start of the last piece wins, of equal pairs the leftmost. Repeated rows and rows
    with null id give a row each; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        encoder = _loaded(model_path, ("viterbi", None))
        pieces = encoder.pieces
        names = ["doc_id", "n_viterbi", "viterbi_crc32", "n_ids", "ids_crc32", "same_text"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                out = []
                for t, v, o in zip(texts, *encoder.encode(texts), strict=True):
                    same = all(decode(pieces, np.frombuffer(x, "<u4")) == (t or "") for x in (v, o))
                    out.append((len(v) // 4, zlib.crc32(v), len(o) // 4, zlib.crc32(o), same))
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([x[4] for x in out], pa.bool_())], names=names)

    schema = "doc_id long, n_viterbi long, viterbi_crc32 long, n_ids long, ids_crc32 long, same_text boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
