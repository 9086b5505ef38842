"""Packing along a space-filling curve: documents that resemble each other share training sequences.

Each document's token counts are hashed with signs into a vector, projected by a fixed random matrix to a few
dimensions, squashed to a grid cell and numbered by the Hilbert curve through that grid. Documents are range-sorted by
this number and laid one after another; the stream is cut every ``length`` tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common, tokens

HASHED, DIMS, BITS = 256, 4, 12


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (Skilling's transposition), as int64."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """Token ids to the key along the curve; the same for every task and every run."""

    def __init__(self, vocabulary: int, hashed: int = HASHED, dims: int = DIMS, bits: int = BITS):
        ids = np.arange(vocabulary, dtype=np.uint64)
        mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) ^ (ids >> np.uint64(7))
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        self.slot = ((mixed >> np.uint64(40)) % np.uint64(hashed)).astype(np.int64)
        self.sign = np.where((mixed >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)
        self.matrix = np.random.default_rng(20240101).standard_normal((hashed, dims))
        self.hashed, self.bits = hashed, bits

    def vector(self, ids: np.ndarray) -> np.ndarray:
        v = np.bincount(self.slot[ids], weights=self.sign[ids], minlength=self.hashed)
        v = np.sign(v) * np.sqrt(np.abs(v))
        return v / (np.sqrt(v @ v) or 1.0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        near = vectors @ self.matrix
        unit = 1 / (1 + np.exp(-1.702 * near))  # close to the normal distribution, so cells fill evenly
        cells = np.minimum((unit * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
        return hilbert_key(cells, self.bits)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve_key, ids (2 bytes an id, end id last). Null text is an empty one; other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        encoder = tokens.encoder(tokenizer_path, "word")
        curve = Curve(len(encoder.id_bytes))
        end = encoder.id_bytes[end_id]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = [encoder.encode(t) for t in part.column(1).to_pylist()]
                vectors = np.array([curve.vector(np.frombuffer(d, encoder.dtype)) for d in data])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(curve.keys(vectors)), pa.array([d + end for d in data], pa.binary())],
                    names=["doc_id", "curve_key", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, curve_key long, ids binary"
    )


def tail_lengths(n: int, length: int) -> list[int]:
    """How the last n < length tokens of a stream are cut: powers of two, which need no padding."""
    return [1 << b for b in range(length.bit_length(), -1, -1) if n >> b & 1]


def pack(encoded: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    Documents are dealt in ranges of (curve key, doc_id, ids), so one very frequent key is spread over tasks. Each task
    lays its range out as one stream and cuts it every ``length`` tokens; what is left at its end is cut into powers of
    two, so nothing is padded. A document may span sequences; repeated rows and rows with null id are documents of their
    own. An empty table gives no piece. Only one sequence and one document are in memory at a time.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, curve_key, ids.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, curve_key long, ids binary"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "curve_key"]
        types = pa.schema([(k, pa.int64()) for k in names] + [("ids", pa.binary())])
        done, open_, used, sequence = [], [], 0, first

        def close(pieces, lengths):
            """Pieces of a stream of sum(lengths) tokens, cut anew at these lengths."""
            nonlocal sequence
            room, offset = lengths[0], 0
            rest = list(lengths[1:])
            for doc_id, start, data, total, key in pieces:
                while len(data):
                    take = data[:room]
                    done.append((doc_id, start, len(take), zlib.crc32(take.astype("<u4").tobytes()), total, sequence, offset, lengths[len(lengths) - len(rest) - 1], key, take.tobytes()))
                    data, start, offset, room = data[room:], start + len(take), offset + len(take), room - len(take)
                    if not room:
                        sequence += 1
                        room, offset = (rest.pop(0) if rest else 0), 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=types)
            done.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in batch.slice(lo, 256).to_pylist():
                    data, at = np.frombuffer(row["ids"], "<u2"), 0
                    total = len(data)
                    while at < total:
                        take = data[at : at + length - used]
                        open_.append((row["doc_id"], at, take, total, row["curve_key"]))
                        at, used = at + len(take), used + len(take)
                        if used == length:
                            close(open_, [length])
                            open_, used = [], 0
                        if len(done) >= 4096:
                            yield flush()
        if open_:
            close(open_, tail_lengths(used, length))
        if done:
            yield flush()

    dealt = encoded.repartitionByRange(common.tasks_for(encoded), "curve_key", "doc_id", F.xxhash64("ids")).sortWithinPartitions("curve_key", "doc_id", "ids")
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Encode, order along the curve, and pack. The encoded table is written once, so sorting does not encode anew."""
    return pack(common.materialise(encode(docs, tokenizer_path, end_id), "encoded"), length)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
