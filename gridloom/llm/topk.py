"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

The rows are cut into blocks. In a block, a component's impact is its size, quantised to a few levels; the posting
segment (level, dimension) lists the rows whose component there has that impact. A batch of queries goes through the
segments by falling level, adding query weight times component. What a row still lacks is bounded by Cauchy and Schwarz:
the query's length times the length of the row's components that were not met yet, which is known exactly. A row whose
bound is below the k-th best score known is no member. Once few rows are left, and only then, those are scored exactly;
after the last level nothing is lacking and all sums are exact.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.llm import common

#: Rows of a block, queries that go through a block at once, and queries for which a task reads each block once.
BLOCK, BATCH, GROUP = 16_384, 256, 2048
#: Levels of impact: shares of a block's postings that stand at or above each.
LEVELS = (0.12, 0.25, 0.36, 0.46, 0.56, 0.68, 0.82, 1.0)
#: Rows scored first for a threshold, and the share of (row, query) pairs that may be left for exact scores.
SEEDS, LEFT = 512, 0.02


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """row, vec_id, v: a number for the row itself, its id, and floor(scale * component); each row that takes part.

    Rows of one id, equal or not, are rows of their own. Null ids, null vectors and vectors with a null or non-finite
    component take no part. Row numbers are written with the rows, so no later stage can number them otherwise.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & fit)
    return common.materialise(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")), "vectors")


class Block:
    """Rows of one length: numbers and ids of the rows, components, and posting segments by level and dimension."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.numbers, self.ids, self.rows = numbers[order], ids[order], rows[order]
        size = np.sort(np.abs(self.rows), axis=None)[::-1]
        edges = [int(size[min(len(size) - 1, int(len(size) * share))]) for share in LEVELS[:-1]] + [0] if len(size) else [0] * len(LEVELS)
        level = np.searchsorted(-np.array(edges), -np.abs(self.rows.T), side="left").astype(np.int8)
        # Segments one after another, by level, then dimension, then row; zero components need no posting.
        self.at = np.zeros((len(LEVELS), self.rows.shape[1], 2), np.int64)
        parts, end = [], 0
        for n in range(len(LEVELS)):
            for d in range(self.rows.shape[1]):
                part = np.flatnonzero((level[d] == n) & (self.rows[:, d] != 0))
                self.at[n, d] = end, end + len(part)
                end += len(part)
                parts.append(part)
        self.postings = np.concatenate(parts or [np.zeros(0)]).astype(np.uint16)

    def save(self, fs, path: str) -> None:
        small = np.int16 if int(np.abs(self.rows).max(initial=0)) < 2**15 else np.int64
        data = io.BytesIO()
        np.savez(data, numbers=self.numbers, ids=self.ids, rows=self.rows.astype(small), at=self.at, postings=self.postings)
        with fs.open_output_stream(path) as out:
            out.write(data.getvalue())

    @classmethod
    def load(cls, fs, path: str) -> Block:
        with fs.open_input_stream(path) as f:
            data = np.load(io.BytesIO(f.read()))
        self = cls.__new__(cls)
        self.__dict__ |= {k: data[k] for k in data.files}
        return self

    def exact(self, rows, queries: np.ndarray) -> np.ndarray:
        """Inner products of some rows and queries (one a column), as whole numbers."""
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * len(queries)
        if most < 2**53:
            return (self.rows[rows].astype(np.float64) @ queries.astype(np.float64)).astype(np.int64)
        return self.rows[rows].astype(np.int64) @ queries

    def candidates(self, queries: np.ndarray, worst: np.ndarray) -> list[np.ndarray]:
        """For each query (a column), the rows whose score can be ``worst`` or more; a superset, with all that are."""
        n, q = len(self.ids), queries.shape[1]
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * len(queries)
        if most >= 2**52:  # sums that would not be exact
            return [np.arange(n)] * q
        kind = np.float32 if most < 2**23 else np.float64
        weights, sums = queries.astype(kind), np.zeros((n, q), kind)
        rows = self.rows.astype(kind)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=0))
        lacking = (self.rows.astype(np.float64) ** 2).sum(axis=1)
        slack = 1.0 + 1e-5
        for level in range(len(LEVELS)):
            for d in range(len(queries)):
                part = self.postings[self.at[level, d, 0] : self.at[level, d, 1]]
                if len(part):
                    x = rows[part, d]
                    sums[part] += x[:, None] * weights[d]
                    lacking[part] -= x.astype(np.float64) ** 2
            rest = (np.sqrt(np.maximum(lacking, 0.0)) * slack).astype(kind)
            possible = sums + rest[:, None] * (length * slack).astype(kind) >= (worst - 0.5).astype(kind)
            if level == len(LEVELS) - 1 or np.count_nonzero(possible) <= LEFT * n * q:
                break
        by_query = np.argwhere(possible.T)
        cut = np.searchsorted(by_query[:, 0], np.arange(q + 1))
        return [by_query[a:b, 1] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, worst: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) for each query of rows other than its own, which has the number ``own``, that can be among its
        k best.

        ``worst``: the k-th best score known so far, -inf where fewer than k are known.
        """
        worst = worst.copy()
        if len(self.ids) > 2 * SEEDS and not np.isfinite(worst).all():
            seeds = self.exact(slice(0, SEEDS), queries).astype(np.float64)
            seeds[self.numbers[:SEEDS, None] == own[None, :]] = -np.inf
            worst = np.maximum(worst, np.partition(seeds, SEEDS - k, axis=0)[SEEDS - k])
        worst = np.where(np.isfinite(worst), worst, -1e30)
        out = []
        for i, rows in enumerate(self.candidates(queries, worst)):
            rows = rows[self.numbers[rows] != own[i]]
            out.append((self.ids[rows], self.exact(rows, queries[:, i])))
        return out


def build(rows: DataFrame) -> tuple[list[tuple[int, str]], str]:
    """Write index blocks of ``rows`` (row, vec_id, v) to the shared folder; (length, path) of each, and the folder.

    A task that runs again writes under new names; only the names that tasks return count.
    """
    spark = rows.sparkSession
    root = common.new_dir(spark, "topk")

    def run(batches):
        import pyarrow as pa

        fs, base = common.local_fs(root)
        held: dict[int, list] = {}

        def save(dim):
            fs.create_dir(base, recursive=True)
            path = f"{base}/{dim}-{uuid.uuid4().hex}.npz"
            Block(*map(np.concatenate, zip(*held.pop(dim), strict=True))).save(fs, path)
            return pa.RecordBatch.from_pylist([{"dim": dim, "path": path}])

        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(lists.value_lengths())
            flat, offsets = np.asarray(lists.flatten(), np.int64), np.concatenate(([0], lengths.cumsum()))
            numbers, ids = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                for lo in range(0, len(own), 1024):
                    part = own[lo : lo + 1024]
                    vectors = flat[offsets[part][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((numbers[part], ids[part], vectors))
                    if sum(len(h[0]) for h in held[dim]) + 1024 > BLOCK:
                        yield save(dim)
        for dim in sorted(held):
            yield save(dim)

    # One small row a block of thousands of vectors.
    return [(r.dim, r.path) for r in rows.mapInArrow(run, "dim long, path string").collect()], root


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row, the k best other rows of ``rows`` by inner product.

    Both tables have row, vec_id and v (see ``integers``). Ties go to the smaller vec_id; a query has fewer results where
    fewer rows of its length exist. Rows that share an id are searched and found each; of a query only its own row is left
    out. Each task takes up to GROUP queries through all blocks, one block in memory at a time, and carries what it has
    found into the next block. Nothing is approximate; empty tables give no rows.
    """
    blocks, root = build(rows.select("row", "vec_id", "v"))
    n = max(1, queries.count())

    def run(batches):
        import pyarrow as pa

        fs, _ = common.local_fs(root)

        def found(group: pa.Table):
            own, ids = (np.asarray(group.column(i).to_numpy(), np.int64) for i in (0, 1))
            vectors = [np.array(v, dtype=np.int64) for v in group.column(2).to_pylist()]
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            for dim in {len(v) for v in vectors}:
                mine = [i for i, v in enumerate(vectors) if len(v) == dim]
                for path in [p for d, p in blocks if d == dim]:
                    block = Block.load(fs, path)
                    for lo in range(0, len(mine), BATCH):
                        part = mine[lo : lo + BATCH]
                        worst = np.array([float(best[i][1][-1]) if len(best[i][1]) == k else -np.inf for i in part])
                        matrix = np.stack([vectors[i] for i in part], axis=1)
                        for i, (more, got) in zip(part, block.search(matrix, own[part], k, worst), strict=True):
                            have, scores = np.concatenate((best[i][0], more)), np.concatenate((best[i][1], got))
                            order = np.lexsort((have, -scores))[:k]
                            best[i] = have[order], scores[order]
            count = [len(s) for _, s in best]
            rank = np.concatenate([np.arange(1, c + 1) for c in count])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, count), pa.int64()), pa.array(rank, pa.int32()), pa.array(np.concatenate([h for h, _ in best]), pa.int64()), pa.array(np.concatenate([s for _, s in best]), pa.int64())],
                names=["query_id", "rank", "vec_id", "score"],
            )

        held, have = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                held.append(batch.slice(lo, BATCH))
                have += held[-1].num_rows
                if have >= GROUP:
                    yield found(pa.Table.from_batches(held))
                    held, have = [], 0
        if have:
            yield found(pa.Table.from_batches(held))

    dealt = queries.select("row", "vec_id", "v").repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // GROUP)), "row")
    return dealt.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def op3(spark, sf_dir: str) -> DataFrame:
    rows = integers(common.table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("vec_id % 20 = 0"), 20)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.row <> q.row AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
