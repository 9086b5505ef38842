"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

``narrow`` fingerprints are 64 bits wide, each bit the majority among the hashes of all shingles. They are cut into m
blocks; two fingerprints that differ in at most k bits agree in at least m - k whole blocks, so they meet under the key
of some m - k blocks. m grows with the table, which keeps buckets small: the search is exact at every size.

``wide`` fingerprints are for similarities far below 1, which 64 bits can't tell apart: signs of a Walsh-Hadamard
transform of the signed, hashed set of shingles. Similar documents differ in a known share of bits; keys are blocks of
them, as many as it takes for pairs at the threshold to share one. The distance over 512 bits, with SIGMAS standard
deviations to spare, only names candidates: within each group that candidates connect, the sets of shingles themselves
are compared, and links are exact.

Equal fingerprints are one node. A bucket never emits its pairs: a search from node to node gives a spanning forest of
the links in it. Buckets beyond LIMIT nodes are cut into chunks and compared chunk by chunk, in tasks of their own.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common
from gridloom.llm.xxh64 import hash_ranges

LIMIT = 8192
_SMALL = 12
_BUCKETS = 4096  # of the hashed set, and so the bits that one transform gives; wider prints take several
_WIDE = 512  # bits of a wide fingerprint that are compared
_MISS = 0.005
SIGMAS = 4  # beyond the mean distance of a pair at the threshold that a candidate may differ
GROUP_ROWS, GROUP_BYTES = 2048, 4_000_000  # rows, and bytes of text, of a group that are compared at once


def shingles(texts: list[bytes | None], words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of some texts as ranges of one buffer: (buffer, start, end, shingles per text).

    Words are what white space (blank, \\t to \\r) separates, A-Z lower-cased; a text of fewer words is one shingle.
    """
    parts, starts, ends, counts = [], [], [], []
    base = 0
    for text in texts:
        joined = b" ".join(text.lower().split()) if text else b""
        if not joined:
            counts.append(0)
            continue
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        first = np.concatenate(([0], blanks + 1))
        last = np.concatenate((blanks, [len(joined)]))
        n = max(1, len(first) - words + 1)
        starts.append(first[:n] + base)
        ends.append((last[words - 1 :] if len(last) >= words else last[-1:]) + base)
        counts.append(n)
        parts.append(joined)
        base += len(joined)
    none = np.zeros(0, np.int64)
    return b"".join(parts), np.concatenate(starts or [none]), np.concatenate(ends or [none]), np.array(counts, np.int64)


def narrow_fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    """64-bit fingerprints, as uint64; 0 without words."""
    buffer, start, end, counts = shingles(texts, words)
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    for lo in range(0, len(start), 100_000):
        h = hash_ranges(buffer, start[lo : lo + 100_000], end[lo : lo + 100_000])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[lo : lo + 100_000]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, ascending, and the text that each belongs to."""
    buffer, start, end, counts = shingles(texts, words)
    owner = np.repeat(np.arange(len(texts)), counts)
    h = hash_ranges(buffer, start, end)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    return h[first], owner[first]


def wide_fingerprints(texts: list[bytes | None], words: int, bits: int) -> np.ndarray:
    """Fingerprints of the sets of shingles, as rows of bits / 8 bytes, and 8 that tell sets of equal bits apart.

    All zero without words.
    """
    h, owner = shingle_sets(texts, words)
    digest = np.zeros(len(texts), np.uint64)
    np.add.at(digest, owner, (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15))
    parts = []
    for k in range(0, bits, _BUCKETS):
        if k:  # another transform, of the same set hashed anew
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        parts.append(_signs(h, owner, len(texts), k // _BUCKETS)[:, : (bits - k) // 8])
    return np.concatenate((*parts, digest.view(np.uint8).reshape(-1, 8)), axis=1)


def _signs(h: np.ndarray, owner: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Signs of a Walsh-Hadamard transform of each hashed set, in a fixed random order, as rows of bytes."""
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    x = np.bincount(owner * _BUCKETS + (h % np.uint64(_BUCKETS)).astype(np.int64), weights=sign, minlength=n * _BUCKETS)
    x = x.reshape(n, _BUCKETS).astype(np.float32)
    step = 1
    while step < _BUCKETS:
        x = x.reshape(n, -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    rows = np.random.default_rng(7 + seed).permutation(_BUCKETS)
    return np.packbits(x.reshape(n, _BUCKETS)[:, rows] > 0, axis=1, bitorder="little")


class Narrow:
    """Keys of 64-bit fingerprints: m blocks, every choice of m - distance of them."""

    def __init__(self, nodes: int, distance: int):
        self.distance, self.lanes = distance, 1
        m = distance + 2
        # Agreeing blocks have 64 * (m - distance) / m bits; more of them keep buckets small in larger tables.
        while m < 2 * distance and 64 * (m - distance) / m < math.log2(max(nodes, 2)) - 3:
            m += 1
        edge = [64 * i // m for i in range(m + 1)]
        block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
        self.masks = [sum(block[i] for i in some) for some in itertools.combinations(range(m), m - distance)]

    def keys(self, prints: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(prints).view(np.uint64).ravel()
        return np.stack([(x & np.uint64(mask)) for mask in self.masks], axis=1).view(np.int64)

    bytes = 8


class Wide:
    """Keys of wide fingerprints: blocks whose number makes a pair at the threshold share one, whatever the table's size.

    Blocks get wider with the table, so that buckets stay small, and then it takes more of them, and more bits.
    """

    def __init__(self, nodes: int, similarity: float):
        cosine = 2 * similarity / (1 + similarity)
        differ = math.acos(cosine) / math.pi  # share of bits in which such a pair differs
        self.width = max(12, math.ceil(math.log2(max(nodes, 2)) - 6))
        self.blocks = math.ceil(math.log(_MISS) / math.log(1 - (1 - differ) ** self.width))
        self.bits = max(_WIDE, -(-self.blocks * self.width // 8) * 8)
        spare = SIGMAS * math.sqrt(_WIDE * differ * (1 - differ))
        self.distance, self.lanes, self.bytes = math.ceil(differ * _WIDE + spare), _WIDE // 64, self.bits // 8 + 8

    def keys(self, prints: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(prints, axis=1, bitorder="little")[:, : self.blocks * self.width]
        return bits.reshape(len(prints), self.blocks, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows: each row that is reached leaves the rest, so no pair is met twice."""
    rest, out = np.arange(len(prints)), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1, dtype=np.int32) <= distance
            if near.any():
                hit = rest[near]
                out += [(x, y) for y in hit.tolist()]
                front += hit.tolist()
                rest = rest[~near]
    return out


_LINKS = "a long, b long, t int, key long, chunk int, print binary"


def _link(distance: int, lanes: int, keys: list[str], limit: int | None):
    """mapInArrow over rows sorted by ``keys``: links (a, b), and the nodes of runs beyond ``limit`` by chunk."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("key", pa.int64()), ("chunk", pa.int32()), ("print", pa.binary())])

        def links(a, b):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(n, f.type) for f in list(schema)[2:]]], schema=schema)

        def overflow(key, chunk, nodes, prints):
            n = len(nodes)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(n, pa.int64()), pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int64()), pa.array([chunk] * n, pa.int32()), pa.array([p.tobytes() for p in prints], pa.binary())], schema=schema)

        held_key, held_nodes, held_prints, chunk = None, [], [], 0

        def finish():
            if held_key is None or not held_nodes:
                return
            nodes, prints = np.concatenate(held_nodes), np.concatenate(held_prints)
            if chunk:
                yield overflow(held_key, chunk, nodes, prints)
            elif len(nodes) > 1 and (found := _forest(prints, distance)):
                i, j = np.array(found).T
                yield links(nodes[i], nodes[j])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k)), dtype=np.int64) for k in keys], axis=1)
            nodes = np.asarray(batch.column(batch.schema.get_field_index("node")), dtype=np.int64)
            raw = b"".join(batch.column(batch.schema.get_field_index("print")).to_pylist())
            prints = np.frombuffer(raw, np.uint64).reshape(n, lanes)
            edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [n]))
            size = np.diff(edge)
            # Short runs that lie within this batch, all at once: compare with the next row, the one after, ...
            inner = np.ones(len(size), bool)
            inner[0] = inner[-1] = False
            small = inner & (size <= _SMALL) & (size > 1)
            run_of = np.repeat(np.arange(len(size)), size)
            for lag in range(1, _SMALL):
                some = np.flatnonzero(small[run_of[: n - lag]] & (run_of[: n - lag] == run_of[lag:])) if n > lag else []
                if not len(some):
                    break
                near = np.bitwise_count(prints[some] ^ prints[some + lag]).sum(axis=1, dtype=np.int32) <= distance
                if near.any():
                    yield links(nodes[some[near]], nodes[some[near] + lag])
            for r in np.flatnonzero(~inner | (size > _SMALL)).tolist():
                lo, hi = edge[r], edge[r + 1]
                k = tuple(key[lo].tolist())
                if k != held_key:
                    yield from finish()
                    held_key, held_nodes, held_prints, chunk = k, [], [], 0
                for at in range(lo, hi, limit or max(1, hi - lo)):
                    upto = min(hi, at + (limit or hi - lo))
                    if limit and sum(map(len, held_nodes)) + upto - at > limit:
                        yield overflow(held_key, chunk, np.concatenate(held_nodes), np.concatenate(held_prints))
                        held_nodes, held_prints, chunk = [], [], chunk + 1
                    held_nodes.append(nodes[at:upto])
                    held_prints.append(prints[at:upto].copy())
        yield from finish()

    return run


def fingerprints(docs: DataFrame, words: int, wide: Wide | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, print (8 bytes, or a wide one's) of each row; null and empty texts have the print zero.

    A row is known by doc_id and text_hash together: ids may repeat, with other texts.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(2)
            size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
            group = size.cumsum() // 1_000_000  # about a megabyte at a time; a longer text by itself
            edge = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(size)])) if len(size) else [0]
            for lo, hi in itertools.pairwise(edge):
                for at in range(lo, hi, 256):
                    part = texts.slice(at, min(256, hi - at)).to_pylist()
                    if wide is None:
                        got = narrow_fingerprints(part, words).view(np.uint8).reshape(-1, 8)
                    else:
                        got = wide_fingerprints(part, words, wide.bits)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array([x.tobytes() for x in got], pa.binary())], names=["doc_id", "text_hash", "print"]
                    )

    rows = _texts(docs, id_col, text_col).select("doc_id", "text_hash", "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, print binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def links(nodes: DataFrame, plan: Narrow | Wide, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of nodes within the distance, enough of them to connect all that are linked."""

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                prints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = plan.keys(prints)
                b = keys.shape[1]
                short = pa.array([p.tobytes() for p in prints[:, : plan.lanes * 8]], pa.binary())
                repeat = pa.array(np.repeat(np.arange(part.num_rows), b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(b, dtype=np.int32), part.num_rows)), pa.array(keys.ravel()), part.column(0).take(repeat), short.take(repeat)],
                    names=["t", "key", "node", "print"],
                )

    rows = nodes.select("node", "print").mapInArrow(keyed, "t int, key long, node long, print binary")
    found = rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_link(plan.distance, plan.lanes, ["t", "key"], limit), _LINKS)
    found = common.materialise(found, "links")
    edges = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select("t", "key", F.col("a").alias("node"), "chunk", "print")
    if large.limit(1).count():
        chunks = large.groupBy("t", "key").agg(F.max("chunk").alias("last"))
        paired = large.join(chunks, ["t", "key"]).select(
            "t", "key", "node", "print", F.col("chunk").alias("c"), F.explode(F.sequence(F.lit(0), "last")).alias("d")
        ).select("t", "key", "node", "print", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"))
        on = ["t", "key", "lo", "hi"]
        more = paired.repartition(*on).sortWithinPartitions(*on).mapInArrow(_link(plan.distance, plan.lanes, on, None), _LINKS)
        edges = edges.unionByName(more.select("a", "b"))
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def thinned(edges: DataFrame, rows: int = 20_000) -> DataFrame:
    """Fewer edges that connect the same nodes: every task keeps a spanning forest of about ``rows`` of them."""

    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            keep = []
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = root(a), root(b)
                if a != b:
                    up[b] = a
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    edges = common.materialise(edges.select("a", "b"), "edges")
    return edges.repartition(max(1, -(-edges.count() // rows))).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of an edge, by smallest labels and pointer jumping.

    Each round writes two small tables. Sums per node are partial first, and the joins are between tables as written, so
    adaptive execution splits a node with very many links.
    """
    both = common.materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        theirs = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = common.materialise(labels.join(theirs, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was")), "labels")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("to"))
        after = common.materialise(hooked.join(jump, "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("was")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of a Jaccard similarity of ``similarity`` or more."""
    rest = np.flatnonzero([len(x) > 0 for x in sets])  # an empty set is similar to none
    if len(rest) < 2:
        return []
    size = np.array([len(x) for x in sets])
    known, flat = np.unique(np.concatenate([sets[i] for i in rest]), return_inverse=True)
    mark = np.zeros(len(known), np.int32)
    of = np.split(flat, np.cumsum(size[rest])[:-1])
    of = dict(zip(rest.tolist(), of, strict=True))
    held, live = rest, np.ones(len(rest), bool)  # sets laid out in ``flat``, and those of them not yet reached
    start = np.cumsum(size[held]) - size[held]
    out = []
    while live.any():
        front = [int(held[live.argmax()])]
        live[live.argmax()] = False
        while front and live.any():
            x = front.pop()
            if 2 * live.sum() < len(held):
                held = held[live]
                flat, live = np.concatenate([of[i] for i in held.tolist()]), np.ones(len(held), bool)
                start = np.cumsum(size[held]) - size[held]
            mark[of[x]] = 1
            both = np.add.reduceat(mark[flat], start)
            mark[of[x]] = 0
            near = live & (both >= similarity * (size[held] + size[x] - both) - 1e-9)
            hit = held[near].tolist()
            out += [(x, y) for y in hit]
            front += hit
            live &= ~near
    return out


def _compare(similarity: float):
    """mapInArrow over rows sorted by component, lo, hi: links (a, b) among the sets of each run."""

    def run(batches):
        import pyarrow as pa

        key, nodes, sets = None, [], []

        def finish():
            if len(nodes) > 1 and (found := similar(sets, similarity)):
                i, j = np.array(found).T
                of = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(of[i]), pa.array(of[j])], names=["a", "b"])

        for batch in batches:
            for c, lo, hi, node, raw in zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("component", "lo", "hi", "node", "set")], strict=True):
                if key != (c, lo, hi):
                    yield from finish()
                    key, nodes, sets = (c, lo, hi), [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
        yield from finish()

    return run


def exact_links(docs: DataFrame, groups: DataFrame, words: int, similarity: float, rows: int = GROUP_ROWS) -> DataFrame:
    """Pairs (a, b) of nodes whose sets of shingles are similar, enough to connect all such ones of a group.

    ``docs`` has doc_id, text_hash and text (binary); ``groups`` has node, component, and the doc_id and text_hash of the
    row that stands for the node. Only texts of groups are read into sets, each once. A group beyond ``rows`` rows or GROUP_BYTES is dealt into chunks, and every two chunks are compared in a task
    of their own.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                h, owner = shingle_sets(part.column(1).to_pylist(), words)
                edge = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in itertools.pairwise(edge)], pa.binary())], names=["node", "set"])

    groups = common.materialise(groups, "groups")
    of = common.broadcast_small(groups.select("node", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")))
    members = docs.join(of, (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    weight = members.select("node", F.octet_length("text").alias("bytes")).join(common.broadcast_small(groups.select("node", "component")), "node")
    weight = weight.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / rows, F.sum("bytes") / GROUP_BYTES)).cast("int").alias("chunks"))
    weight = common.materialise(weight, "weights")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cells = groups.join(common.broadcast_small(weight), "component").select(
        "node", "component", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("chunks"), F.lit(1)) - 1)).alias("d")
    ).select("node", "component", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"))
    cells = common.materialise(cells, "cells")
    on = ["component", "lo", "hi"]
    sets = members.select("node", "text").mapInArrow(run, "node long, set binary").join(common.broadcast_small(cells), "node")
    found = sets.repartition(*on).sortWithinPartitions(*on).mapInArrow(_compare(similarity), "a long, b long")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, words: int, distance: int | None, similarity: float, id_col: str, text_col: str, limit: int) -> DataFrame:
    """doc_id, text_hash, print of each row, and ``first``: the smallest (doc_id, text_hash) of its group."""
    rows = docs.count()
    wide = Wide(rows, similarity) if distance is None else None
    prints = common.materialise(fingerprints(docs, words, wide, id_col, text_col), "prints")
    nodes = prints.where("doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    # Numbers of nodes are written with them, so no later stage can number them otherwise.
    nodes = common.materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "print", "row"), "nodes")
    found = links(nodes, wide or Narrow(rows, distance), limit)
    of = components(thinned(found) if wide else found)
    if wide:
        groups = nodes.join(of.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("node", "component", "row.doc_id", "row.text_hash")
        with common.small_batches(docs.sparkSession):
            of = components(common.materialise(exact_links(_texts(docs, id_col, text_col), groups, words, similarity), "similar"))
    linked = common.materialise(nodes.select("node", "row").join(of.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("node", "component", "row"), "linked")
    first = linked.groupBy("component").agg(F.min("row").alias("first"))
    named = linked.select("node", "component").join(first, "component").select(F.col("node").alias("n"), "first")
    named = nodes.join(named, F.col("node") == F.col("n"), "left").select(F.col("print").alias("p"), F.coalesce("first", "row").alias("first"))
    named = common.materialise(named, "components")
    return prints.join(named, F.col("print") == F.col("p"), "left").select("doc_id", "text_hash", "print", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(
    docs: DataFrame, words: int = 5, distance: int | None = None, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """doc_id, print, component_id (the smallest doc_id that links lead to, its own included) of each row.

    With ``distance``: 64-bit fingerprints over all shingles, linked up to that many differing bits; exact. Without:
    sets of shingles, linked at a Jaccard similarity of ``similarity`` or more. No other pair is linked, and a pair is
    overlooked only where its wide fingerprints share no block (probability 0.005 at the threshold, less above, at every
    size of the table).

    Null and empty texts share the print zero and so are linked with each other. Rows that share a doc_id are linked by
    their texts like any other rows. Rows with null id link nothing and have a null component. Other columns are ignored;
    an empty table gives none.
    """
    return _grouped(docs, words, distance, similarity, id_col, text_col, limit).select("doc_id", "print", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id; all columns as they are.

    A text goes only if its group has another one that stays. Of rows that share id and text one stays; rows that share an
    id and have texts of their own all stay; rows with null id do too. Null and empty texts are one group.
    """
    found = common.materialise(_grouped(docs, words, None, similarity, id_col, text_col, LIMIT).select("doc_id", "text_hash", "first"), "groups")
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash"))
    gone = common.materialise(found.where(other).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    again = found.where(~other).groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    again = common.materialise(again, "again")

    def same(rows: DataFrame):
        return (docs[id_col] == rows["gone_id"]) & (F.xxhash64(docs[text_col].cast("binary")) == rows["gone_hash"])

    if not again.limit(1).count():
        return docs.join(common.broadcast_small(gone), same(gone), "left_anti")
    left = docs.join(common.broadcast_small(both := common.materialise(gone.unionByName(again), "gone")), same(both), "left_anti")
    once = docs.join(common.broadcast_small(again), same(again), "left_semi").dropDuplicates([id_col, text_col])
    return left.unionByName(once)


def op6(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"), words=4, distance=4)
    digits = F.lower(F.hex("print"))
    big_endian = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    return found.select("doc_id", big_endian.alias("fingerprint"), "component_id")
