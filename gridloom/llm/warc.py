"""WARC archives of individually compressed records that share a Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed; each record
after it is one Zstandard frame, so any record can be read alone, given the dictionary. The dictionary is trained on the
first records of its own archive, a bounded number of bytes. Records with equal payloads are written once: the one with
the largest page id is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common

#: Fixed values of the formats.
_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAMPLE_BYTES, _DICTIONARY_BYTES, _LEVEL = 3_000_000, 65_536, 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record's bytes: a response, or a revisit of page ``refers_to``, which has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]):
    """A dictionary from records; their bytes as they stand where they are too few to train on."""
    import zstandard as zstd

    # Cover's segment and match lengths are given, so nothing is searched for.
    if len(samples) >= 16:
        try:
            return zstd.train_dictionary(_DICTIONARY_BYTES, samples, k=512, d=8)
        except zstd.ZstdError:
            pass
    return zstd.ZstdCompressionDict(b"".join(samples)[-_DICTIONARY_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def write_archive(out, records, level: int = _LEVEL) -> int:
    """Write records (an iterator of bytes) to an open stream; returns how many."""
    import zstandard as zstd

    held, size, n, frames = [], 0, 0, None
    for data in records:
        n += 1
        if frames is not None:
            out.write(frames.compress(data))
            continue
        held.append(data)
        size += len(data)
        if size >= _SAMPLE_BYTES:
            frames = _start(out, held, level)
            held = []
    if frames is None and held:
        _start(out, held, level)
    return n


def _start(out, held: list[bytes], level: int):
    import zstandard as zstd

    dictionary = train([x[:131_072] for x in held])  # of a very long record, its start is enough to learn from
    content = zstd.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    out.write(struct.pack("<II", _SKIPPABLE, len(content)) + content)
    frames = zstd.ZstdCompressor(level=level, dict_data=dictionary)
    for data in held:
        out.write(frames.compress(data))
    return frames


def read_archive(f):
    """(header fields, HTTP header, payload) of each record, one in memory at a time."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", f.read(8))
    if magic != _SKIPPABLE:
        raise ValueError("no dictionary frame")
    content = zstd.ZstdDecompressor().decompress(f.read(size))
    kind = zstd.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=kind)).stream_reader(f, read_across_frames=True)
    buffer = b""

    def fill(n: int) -> bytes:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < n:
            data = reader.read(max(n - have, 65_536))
            if not data:
                break
            parts.append(data)
            have += len(data)
        buffer = b"".join(parts)
        return buffer

    while True:
        n = 4096
        while b"\r\n\r\n" not in fill(n) and len(buffer) >= n:
            n *= 2
        if not buffer:
            return
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        if len(fill(length + 4)) < length + 4:
            raise ValueError("the archive ends within a record")
        block, buffer = buffer[:length], buffer[length + 4 :]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, http, payload


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: what to write. Only ids and digests are grouped; payloads move once.

    Groups of equal payloads are counted with partial sums, and only groups of two or more go on. The two joins are
    between shuffled tables, so adaptive execution splits a very large group.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    ids = rows.where(F.length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("sha"))
    kept = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    kept = common.materialise(kept.drop("n"), "copies")
    revisits = ids.join(kept, "sha").where("page_id is null or page_id < refers_to").distinct()
    revisits = common.materialise(revisits, "revisits").select(F.col("page_id").alias("id"), F.col("sha").alias("of"), "refers_to")
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.sha1("payload") == F.col("of")), "left").select("page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", **names) -> tuple[DataFrame, str]:
    """Write an archive per task; returns a row per archive (path, n_records) and the folder.

    Null html is an empty payload, a null url gives no target, a null page id comes back as null; of equal payloads with
    null ids, those are revisits. Repeated rows with the largest id are responses each. Other columns are ignored; empty
    tables give no archive. A task that runs again writes under a new name, and only names that tasks return count.
    """
    spark = pages.sparkSession
    root = common.new_dir(spark, "warc")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = common.local_fs(root)

        def rows():
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    for r in batch.slice(lo, 64).to_pylist():
                        yield record(r["page_id"], r["url"], r["payload"], r["refers_to"], date)

        records = rows()
        first = next(records, None)
        if first is None:
            return
        fs.create_dir(base, recursive=True)
        path = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"

        def all_records():
            yield first
            yield from records

        with fs.open_output_stream(path) as out:
            n = write_archive(out, all_records())
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}])

    # One small row a task, as many as Spark itself keeps on the driver for its tasks.
    with common.small_batches(spark):
        made = [(r.path, r.n_records) for r in plan(pages, **names).mapInArrow(run, "path string, n_records long").collect()]
    return spark.createDataFrame(made, "path string, n_records long"), root


def read(archives: DataFrame, root: str) -> DataFrame:
    """Records from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest and length are taken from the payload that was read, and must agree with its header.
    """
    n = max(1, archives.count())

    def page(urn: str) -> int | None:
        value = urn.removeprefix("<urn:x-page:").rstrip(">")
        return None if value == "none" else int(value)

    def run(batches):
        import pyarrow as pa

        fs, _ = common.local_fs(root)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with fs.open_input_stream(row["path"]) as f:
                    for fields, http, payload in read_archive(f):
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(http.split(b"Content-Length: ")[1])
                        to = fields.get("WARC-Refers-To")
                        if to is None and (payload_digest(payload), len(payload)) != (digest, length):
                            raise ValueError(f"{row['path']}: a payload is damaged")
                        out.append((page(fields["WARC-Record-ID"]), length, digest, fields["WARC-Type"], page(to) if to else None, fields.get("WARC-Target-URI")))
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return archives.repartition(n, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op5(spark, sf_dir: str) -> DataFrame:
    return read(*write(common.table(spark, sf_dir, "pages"))).drop("url")


#: A digit of the digest is five bits, from two neighbouring hexadecimal ones.
OP5_SQL = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), x AS (
  SELECT page_id, n, top, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1)) - 1) AS v FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((v[5 * k // 4 + 1] * 16 + v[5 * k // 4 + 2]) >> (3 - 5 * k % 4)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM x
"""
