"""Token-id output: one concatenated id array a shard, document boundaries in Elias-Fano code.

A shard is two files. ``.ids`` holds the ids of its documents one after another (little endian, 2 bytes where the
vocabulary allows). ``.ef`` holds two monotone sequences in Elias-Fano code: the start of each document plus the end of
the last, and the documents' ids less the first. A sequence of n values up to u takes n * (2 + log2(u / n)) bits: the low
bits packed, the high bits as a unary bit vector. ``select`` finds the i-th value from the place of every 256th one bit,
which is all that is made at load; a reader that goes through a shard selects the first value of each run and takes its
neighbours from the same bits. No table of 64-bit offsets is made.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common, tokens

_MAGIC = b"GLEF0001"
_SAMPLE, _STRETCH = 256, 65_536


class EliasFano:
    """A non-decreasing sequence of integers from 0 up."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # The select structure: for each _SAMPLE-th one bit, its place among the high bits. Places are found a stretch of
        # high bits at a time; what stays is n / _SAMPLE numbers of 32 bits, if the high bits are that few.
        self.sample = np.zeros(-(-n // _SAMPLE), dtype=np.uint32 if len(high) < 1 << 29 else np.uint64)
        seen = 0
        for lo in range(0, len(high), _STRETCH):
            at = np.flatnonzero(np.unpackbits(high[lo : lo + _STRETCH], bitorder="little"))
            first = -seen % _SAMPLE
            some = at[first::_SAMPLE]
            k = (seen + first) // _SAMPLE
            self.sample[k : k + len(some)] = some + 8 * lo
            seen += len(at)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values must not decrease, from 0 up")
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values & ((1 << low_bits) - 1)).astype(np.uint64)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        high = np.zeros((top >> low_bits) + n + 1, dtype=np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, f) -> EliasFano:
        n, low_bits, a, b = struct.unpack("<QBQQ", f.read(25))
        return cls(n, low_bits, np.frombuffer(f.read(a), np.uint8), np.frombuffer(f.read(b), np.uint8))

    def _lows(self, lo: int, hi: int) -> np.ndarray:
        w = self.low_bits
        if not w:
            return np.zeros(hi - lo, dtype=np.int64)
        first, last = lo * w // 8, (hi * w + 7) // 8
        bits = np.unpackbits(self.low[first:last], bitorder="little")[lo * w - first * 8 :][: (hi - lo) * w]
        return bits.reshape(-1, w).astype(np.int64) @ (1 << np.arange(w, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from 0; reads the high bits from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        seen = i - i % _SAMPLE
        place = int(self.sample[i // _SAMPLE])
        byte = place // 8
        word = int(self.high[byte]) >> place % 8 << place % 8
        while seen + word.bit_count() <= i:
            seen += word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(i - seen):
            word &= word - 1
        bit = (word & -word).bit_length() - 1
        return ((byte * 8 + bit - i) << self.low_bits) | int(self._lows(i, i + 1)[0])

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1 at once: a run of neighbours from one select."""
        if lo >= hi:
            return np.zeros(0, dtype=np.int64)
        first, last = lo // _SAMPLE, hi // _SAMPLE + 1
        byte = int(self.sample[first]) // 8
        end = int(self.sample[last]) // 8 + 1 if last < len(self.sample) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + byte * 8
        at = at[at >= int(self.sample[first])][lo - first * _SAMPLE : hi - first * _SAMPLE]
        return ((at - np.arange(lo, hi)) << self.low_bits) | self._lows(lo, hi)


def write_shard(fs, stem: str, docs, dtype: str) -> dict:
    """Write documents (id or None, id bytes) in the order given, ids ascending with None first."""
    ids, ends, n_null = [], [0], 0
    width = np.dtype(dtype).itemsize
    with fs.open_output_stream(stem + ".ids") as out:
        for doc_id, data in docs:
            out.write(data)
            ends.append(ends[-1] + len(data) // width)
            if doc_id is None:
                n_null += 1
            else:
                ids.append(doc_id)
    first = ids[0] if ids else 0
    with fs.open_output_stream(stem + ".ef") as out:
        out.write(_MAGIC + struct.pack("<QqB", n_null, first, width))
        out.write(EliasFano.of(np.array(ends)).to_bytes())
        out.write(EliasFano.of(np.array(ids, dtype=np.int64) - first).to_bytes())
    return {"n_docs": len(ends) - 1, "n_tokens": ends[-1], "first": first, "null_first": n_null}


class Shard:
    """A shard that was written: offsets by select, ids by a ranged read."""

    def __init__(self, fs, stem: str):
        self.fs, self.stem = fs, stem
        with fs.open_input_stream(stem + ".ef") as f:
            data = io.BytesIO(f.read())
        if data.read(8) != _MAGIC:
            raise ValueError(f"{stem}.ef is no boundary file")
        self.n_null, self.first, self.width = struct.unpack("<QqB", data.read(17))
        self.ends, self.ids = EliasFano.read(data), EliasFano.read(data)

    def __len__(self) -> int:
        return self.ends.n - 1

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        a, b = max(lo - self.n_null, 0), max(hi - self.n_null, 0)
        return [None] * (min(hi, self.n_null) - min(lo, self.n_null)) + (self.ids.slice(a, b) + self.first).tolist()

    def document(self, i: int) -> np.ndarray:
        start, end = self.ends.select(i), self.ends.select(i + 1)
        with self.fs.open_input_file(self.stem + ".ids") as f:
            f.seek(start * self.width)
            return np.frombuffer(f.read((end - start) * self.width), dtype=f"<u{self.width}")

    def scan(self, step: int = 1024):
        """(doc id, start, ids) of every document, in order; a few documents are in memory at a time."""
        with self.fs.open_input_stream(self.stem + ".ids") as f:
            for lo in range(0, len(self), step):
                hi = min(lo + step, len(self))
                at = self.ends.slice(lo, hi + 1)
                for doc_id, a, b in zip(self.doc_ids(lo, hi), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    yield doc_id, a, np.frombuffer(f.read((b - a) * self.width), dtype=f"<u{self.width}")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Encode all texts and write shards in ascending order of id; returns a row per shard, in that order, and the folder.

    Rows are range-partitioned and sorted by id; each task writes one shard, so shards ascend too. Null texts count as
    empty (only the end id), null ids come first, rows with equal ids stay rows of their own (in the order of
    a hash of their texts). Other columns are ignored. An empty table gives no shard. Texts stream through, whole. A task
    that is run again writes under a new name and only the name it returns counts, so lost executors do no harm.
    Returned per shard: stem (where the two files are), n_docs, n_tokens, base (tokens in the shards before).
    """
    spark = docs.sparkSession
    root = common.new_dir(spark, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(common.tasks_for(rows), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = common.local_fs(root)
        fs.create_dir(base, recursive=True)
        encode = tokens.encoder(tokenizer_path, "byte")
        end = encode.id_bytes[end_id]
        stem = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"

        def rows():
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        yield doc_id, encode.encode(text) + end

        made = write_shard(fs, stem, rows(), encode.dtype.str)
        if made["n_docs"]:
            yield pa.RecordBatch.from_pylist([made | {"stem": stem, "pid": TaskContext.get().partitionId()}])

    schema = "n_docs long, n_tokens long, first long, null_first long, stem string, pid long"
    # One small row a task, as many as Spark itself keeps on the driver for its tasks.
    with common.small_batches(spark):
        made = sorted(dealt.mapInArrow(run, schema).collect(), key=lambda r: r.pid)
    out, base = [], 0
    for r in made:
        out.append((r.stem, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return spark.createDataFrame(out, "stem string, n_docs long, n_tokens long, base long"), root


def read(shards: DataFrame, root: str) -> DataFrame:
    """Documents from the files: doc_id, start (over all shards), n_tokens, ids_crc32 of the ids as 32-bit integers."""
    n = max(1, shards.count())

    def run(batches):
        import pyarrow as pa

        fs, _ = common.local_fs(root)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        schema = pa.schema([(k, pa.int64()) for k in names])
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for doc_id, start, ids in Shard(fs, row["stem"]).scan():
                    out.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return shards.repartition(n, "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return read(*write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
