"""Toxicity by compression distance: two Zstandard dictionaries, one of toxic and one of ordinary text.

A whole text, A-Z lower-cased and blanks united, is read in overlapping windows of WINDOW bytes, some ten words. Each
window is compressed with either dictionary; how many bytes fewer the toxic one takes is the window's distance. Windows
are cut by bytes, so text without blanks, in any script, is read like any other. A document's score is a logistic
function of its distances: the largest, and how many lie beyond a threshold that few windows of ordinary text reach. The
threshold and the weights are calibrated on distances under dictionaries that were trained without the document at hand,
and so that 0.7 is the score that separates best.

Both dictionaries are trained by ``zstandard.train_dictionary`` on whole texts. Most of either class's text resembles the
other's, and what the two share says nothing. So a class's own part is trained on what is left of its texts when the byte
sequences of length GRAM are taken out that also occur in the other class, or in next to no other text of its own; and
both end in one part trained on ordinary text, at the same distance from the window: what is common costs the same.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common

#: Bounds of the training sample: documents of either class, and bytes of all their texts.
TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_BYTES = 2000, 5000, 32_000_000
WINDOW, STEP, GRAM = 80, 40, 5
#: Bytes of a class's own part and of the common part; segment and match length of the dictionary builder.
_OWN, _COMMON, _SEGMENT, _MATCH = 2048, 15_000, 24, 8
#: Bytes of ordinary lines, taken evenly from all, that the common part is trained on: the trainer takes 12 times as much memory.
_COMMON_SAMPLE = 4_000_000
#: Share of an ordinary text's windows that may reach the window threshold.
_REACH = 0.01
_TABLE = 23  # bits of a hashed byte sequence
_SHARE = 0.005  # of a class's documents that a byte sequence must occur in
#: Stands behind each text: the compressor leaves the last bytes of its input unmatched.
_EDGE = bytes(b for b in range(1, 20) if b not in (9, 10, 13))
_BLANKS = re.compile(rb"[^a-z0-9\x80-\xff]+")
THRESHOLD = 0.7
_N, _BINS, FOLDS = 6, 24, 3


def plain(text: str | bytes | None) -> bytes:
    """The text's bytes, A-Z lower-cased, runs of ASCII characters that are neither letters nor digits as one blank."""
    if not text:
        return b""
    return _BLANKS.sub(b" ", (text.encode() if isinstance(text, str) else text).lower()).strip()


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows of ``plain`` text that cover all of it; none of an empty text."""
    if not data:
        return []
    data = b" " + data + b" " + _EDGE
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    """Scores texts in one process."""

    def __init__(self, model: Model):
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=5, target_length=64, strategy=zstd.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
        )

        def compressor(content: bytes):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return zstd.ZstdCompressor(dict_data=d, compression_params=params).compress

        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)
        self.threshold, self.weights = model.threshold, np.array(model.weights)

    def distances(self, text) -> np.ndarray:
        """Bytes saved by the toxic dictionary, for each window of the text."""
        toxic, ordinary = self.toxic, self.ordinary
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(plain(text))], dtype=np.int64)

    def histogram(self, text) -> np.ndarray:
        """How many windows have which distance, from -_BINS to _BINS; beyond that, the outermost."""
        return np.bincount(np.clip(self.distances(text), -_BINS, _BINS) + _BINS, minlength=2 * _BINS + 1)

    def score(self, text) -> float:
        h = self.histogram(text)
        if not h.any():
            return 0.0  # nothing to judge
        return float(1 / (1 + np.exp(-np.clip(_features(h[None], self.threshold)[0] @ self.weights, -35, 35))))


def _features(h: np.ndarray, threshold: int) -> np.ndarray:
    """A row a document, from the histograms of its windows' distances."""
    at = np.arange(-_BINS, _BINS + 1)
    n = np.maximum(h.sum(axis=1), 1)
    top = np.where(h > 0, at, -_BINS).max(axis=1)
    beyond = h * (at >= threshold)
    count, total = beyond.sum(axis=1), beyond @ at
    return np.stack([np.ones(len(h)), top, np.log1p(total), np.log1p(100 * total / n), np.log1p(100 * count / n), np.log(n)], axis=1)


def _lines(texts: list[bytes]) -> list[list[bytes]]:
    """Each text's lines, less those that an earlier text has: copies of a document or passage count once."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        mine = dict.fromkeys(x for line in t.split(b"\n") if (x := plain(line)) and x not in seen)
        seen.update(mine)
        out.append([b" " + x + b" " for x in mine])
    return out


def _grams(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position on: a place in a table of 2 ** _TABLE."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | a[k : k + n]
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE)).view(np.int64)


def _there(docs: list[list[bytes]]) -> np.ndarray:
    """For each place of the table, in which folds a document has a byte sequence there, as bits. The table is so wide
    that few sequences share a place."""
    out = np.zeros(1 << _TABLE, np.uint8)
    for i, lines in enumerate(docs):
        out[_grams(b"\n".join(lines))] |= np.uint8(1 << i % FOLDS)
    return out


def _left(docs: list[list[bytes]], other: np.ndarray) -> list[list[bytes]]:
    """What is left of a class's documents, without each fold in turn and then of all: stretches covered by byte sequences
    that at least _SHARE of the documents have, and two of them, and no document of the other class."""
    counts = np.zeros((FOLDS, 1 << _TABLE), np.uint8)  # of documents, up to 255
    for i, lines in enumerate(docs):
        row, at = counts[i % FOLDS], _grams(b"\n".join(lines))
        row[at] += row[at] < 255  # once a place, however often it is listed
    wanted = np.zeros(1 << _TABLE, np.uint8)  # for which of the lots below, as bits
    lots = (*range(FOLDS), None)
    for n, leave in enumerate(lots):
        folds = [f for f in range(FOLDS) if f != leave]
        least = max(2, math.ceil(_SHARE * sum(i % FOLDS != leave for i in range(len(docs)))))
        total = np.zeros(1 << _TABLE, np.uint16)
        for f in folds:
            total += counts[f]
        wanted |= ((total >= least) & (other & np.uint8(sum(1 << f for f in folds)) == 0)).astype(np.uint8) << n
    out: list[list[bytes]] = [[] for _ in lots]
    for i, lines in enumerate(docs):
        data = b"\n".join(lines)
        g = wanted[_grams(data)]
        for n, leave in enumerate(lots):
            if i % FOLDS != leave and (new := g >> n & 1 == 1).any():
                change = np.zeros(len(data) + 1, np.int32)
                change[: len(g)] += new
                change[GRAM : GRAM + len(g)] -= new
                keep = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0])))).tolist()
                out[n].append(b"\n".join([data[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)]))
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes, filled up with blanks; the samples themselves where they are too few to train on."""
    import zstandard as zstd

    try:
        made = zstd.train_dictionary(size + 256, samples, k=_SEGMENT, d=_MATCH).as_bytes()
    except (zstd.ZstdError, ValueError):
        made = b"\n".join(samples)
    return made[-size:].rjust(size)


def _models(docs: tuple[list, list]) -> list[Model]:
    """Models without weights from the documents (lines of the ordinary and of the toxic): without each fold, and of all."""
    ordinary = [x for lines in docs[0] for x in lines]
    shared = _dictionary(ordinary[:: max(1, math.ceil(sum(map(len, ordinary)) / _COMMON_SAMPLE))], _COMMON)
    there = tuple(map(_there, docs))
    left = [_left(docs[k], there[1 - k]) for k in (0, 1)]
    return [Model(_dictionary(bad, _OWN) + shared, _dictionary(plain, _OWN) + shared, 3, (0.0,) * _N) for plain, bad in zip(*left, strict=True)]


def train(texts: list[str | bytes], toxic: list[int], measure=None) -> Model:
    """A model from labelled texts. Thresholds and weights are calibrated on distances of each text under dictionaries that
    were trained without it, in turn; the dictionaries of the model are trained on all.

    ``measure(models, folds)`` gives the histogram of each text under the model of its fold; here, unless it is given.
    """
    data = [t.encode() if isinstance(t, str) else t for t in texts]
    y = np.array(toxic, dtype=int)
    docs = tuple(_lines([t for t, k in zip(data, y, strict=True) if k == c]) for c in (0, 1))
    folds = np.zeros(len(y), int)
    for c in (0, 1):
        folds[y == c] = np.arange((y == c).sum()) % FOLDS
    *models, final = _models(docs)
    if measure is None:
        scorers = [m.scorer() for m in models]
        h = np.array([scorers[f].histogram(t) for f, t in zip(folds, data, strict=True)])
    else:
        h = measure(models, folds)
    return _calibrate(final, h.reshape(-1, 2 * _BINS + 1), y)


def _calibrate(model: Model, h: np.ndarray, y: np.ndarray) -> Model:
    """The window threshold, then logistic weights by Newton's method, moved so that THRESHOLD separates best."""
    has = h.any(axis=1)
    h, y = h[has], y[has].astype(float)
    usual = h[y == 0].sum(axis=0)
    reach = usual[::-1].cumsum()[::-1]  # windows of ordinary texts at each distance or beyond
    model.threshold = next((k for k in range(2, _BINS) if reach[k + _BINS] <= _REACH * usual.sum()), _BINS)
    if not len(y) or y.min() == y.max():
        return model
    x, w = _features(h, model.threshold), np.zeros(_N)
    penalty = np.diag([1e-3] + [0.1] * (_N - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    wrong = np.arange(1, len(y) + 1) - hits
    gain = hits - 3 * wrong  # a clean document lost counts as three toxic ones missed
    best = int(np.argmax(gain))
    after = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (z[order[best]] + after) / 2
    model.weights = tuple(float(v) for v in w)
    return model


def held_out(doc_id) -> F.Column:
    """Whether a document's labels may not be learnt from; a null id has none to learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a sample of the labelled rows that are not held out: at most TOXIC_DOCS and ORDINARY_DOCS of them, whole
    texts, together at most SAMPLE_BYTES.

    The sample is chosen by a hash of the id, so ties can't change it; a text that would go beyond the bytes left is
    passed over. Labels that are null or of null ids are ignored; a document labelled twice is toxic if either label says
    so; of documents that share an id one text is taken; null texts count as empty. Without labels, or with one kind of
    them, the score is 0.5 for every text that isn't empty.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "toxic")
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("h", F.xxhash64("id", F.lit(1)))
    marked = common.materialise(marked, "labels")
    sample = marked.where("toxic = 1").orderBy("h", "id").limit(TOXIC_DOCS).unionByName(marked.where("toxic = 0").orderBy("h", "id").limit(ORDINARY_DOCS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    rows = common.materialise(rows, "sample")
    chosen, room = [], SAMPLE_BYTES
    for r in rows.select("id", F.length("text").alias("n")).orderBy("h", "id").collect():  # two numbers a row of the sample
        if r.n <= room:
            room -= r.n
            chosen.append((r.id,))
    some = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long")), "id", "left_semi")
    found = sorted(some.collect(), key=lambda r: (r.h, r.id))
    ids, y, data = [r.id for r in found], [int(r.toxic) for r in found], [bytes(r.text) for r in found]
    del found

    def measure(models: list[Model], folds: np.ndarray) -> np.ndarray:
        def run(batches):
            import pyarrow as pa

            scorers = [m.scorer() for m in models]
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    h = [scorers[f].histogram(t).astype("<i8").tobytes() for f, t in zip(*(part.column(i).to_pylist() for i in (1, 2)), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.binary())], names=["id", "h"])

        fold = docs.sparkSession.createDataFrame(list(zip(ids, folds.tolist(), strict=True)), "id long, fold int")
        dealt = rows.join(F.broadcast(fold), "id").select("id", "fold", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)
        got = {r.id: r.h for r in dealt.mapInArrow(run, "id long, h binary").collect()}  # a few numbers a row of the sample
        return np.array([np.frombuffer(got[i], "<i8") for i in ids]).reshape(-1, 2 * _BINS + 1)

    return train(data, y, measure if ids else None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of each row; whole texts. Null texts and texts without letters or digits score 0.

    Repeated rows are scored each, alike; rows with null ids too. An empty table gives none; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        scorer = model.scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                scores = [scorer.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns as they are; null and empty texts stay."""

    def run(batches):
        import pyarrow as pa

        scorer = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield part.filter(pa.array([scorer.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
