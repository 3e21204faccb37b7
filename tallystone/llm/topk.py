"""Exact top-k inner products with a three-phase uniform threshold.

The components of the vectors are dealt to ``parts`` column groups; each group knows its own list of partial
scores for a query. Phase 1 gathers the groups' local top lists and scores their entries exactly, which gives a
k-th best score that the answer can't fall below. Phase 2 sends that cutoff, divided evenly among the groups, to
all rows: a row of which every partial score is below its share can't reach the cutoff. Phase 3 resolves the
remaining entries exactly.

The local lists of phase 1 are those of one row in ``CUTOFF_EVERY``: the k-th best of fewer rows is never above
that of all, so the cutoff stays safe, and phase 1 costs a fraction of a pass. Vectors are never shuffled: each
task holds the queries of a round, whose bytes are bounded, and hands on at most k entries for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.blas import one_thread
from tallystone.llm.scratch import Scratch

SCALE = 256
PARTS = 4
#: Rows of which one gives local lists.
CUTOFF_EVERY = 16
#: Bytes of the queries of a round, as float32.
ROUND_BYTES = 16 << 20
#: Rows and queries whose products are made at once, and entries that a task gathers before it cuts them.
TILE_ROWS, TILE_QUERIES, HELD = 512, 1024, 1 << 20
_LONG = (-(2**63), 2**63 - 1)
#: Bytes of a score that a long doesn't hold: products of doubles have at most 2,100 bits.
WIDE = 320


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, small, large): floor(scale * x) of each component, as array<smallint> or, where one doesn't fit,
    as array<double>; uid tells rows of equal ids apart. Rows that take no part are gone: null and empty vectors,
    and those with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    wide = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("size(v) > 0")
    fine = wide.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = fine.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform("v", lambda x: _floor(x * F.lit(float(scale)))).alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) < 32768.0)
    return whole.select("uid", "vec_id", F.when(fits, F.col("v").cast("array<smallint>")).alias("small"), F.when(~fits, F.col("v")).alias("large"))


def _floor(x: Column) -> Column:
    """floor() of a double as a double: Spark's own gives a long, which large values don't fit."""
    return F.when(F.abs(x) >= F.lit(4503599627370496.0), x).otherwise(F.floor(x).cast("double"))


@dataclass
class Rows:
    uid: np.ndarray
    vec_id: np.ndarray  # null: the largest long
    named: np.ndarray  # whether vec_id isn't null
    values: np.ndarray  # integral doubles, filled up with zeros

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, width: int | None = None) -> Rows:
        """Vectors of a batch (uid, vec_id, small, large) as rows of ``width`` columns, the longest's if None."""
        ids, small, large = batch.column("vec_id"), batch.column("small"), batch.column("large")
        if isinstance(batch, pa.Table):
            ids, small, large = (c.combine_chunks() for c in (ids, small, large))
        lengths = [np.diff(c.offsets.to_numpy()) for c in (small, large)]
        widest = max((int(n.max(initial=0)) for n in lengths), default=0) if width is None else width
        out = np.zeros((batch.num_rows, widest))
        for column, n in zip((small, large), lengths, strict=True):
            flat, begin = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
            held = np.flatnonzero(n * column.is_valid().to_numpy(zero_copy_only=False))
            for size in np.unique(n[held]).tolist():
                own = held[n[held] == size]
                out[own, : min(size, widest)] = flat[begin[own][:, None] + np.arange(min(size, widest))]
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        return cls(batch.column("uid").to_numpy(), ids.fill_null(_LONG[1]).to_numpy(), named, out)


def _groups(width: int, parts: int) -> list[slice]:
    edges = np.linspace(0, width, min(parts, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which inner products of rows of ``a`` and ``b``, and all sums on the way, are exact."""
    most = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _typed(x: np.ndarray, kind: type) -> np.ndarray:
    return x.astype(kind) if kind is not object else np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each query: higher score first, then smaller id."""
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, query))
    q = query[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = q[1:] != q[:-1]
    place = np.arange(len(q))
    rank = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return order[rank < k]


def local_lists(partials: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (row, column) of the entries in some group's list of the k largest partial scores of a column."""
    rows, columns = partials[0].shape
    if rows <= k or partials[0].dtype == object:
        return tuple(x.ravel() for x in np.indices((rows, columns)))
    listed = np.zeros((rows, columns), bool)
    for partial in partials:
        np.put_along_axis(listed, np.argpartition(partial, rows - k, axis=0)[rows - k :], True, axis=0)
    return np.nonzero(listed)


def reaching(partials: list[np.ndarray], score: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phases 2 and 3: (row, column) of the entries that some group's share of the column's cutoff lets through, and
    whose whole score reaches it. Shares are rounded up, which whole partial scores allow."""
    parts = len(partials)
    if partials[0].dtype == object:
        share = np.array([-(-int(c) // parts) if c > -np.inf else c for c in cutoff], dtype=object)
        let = np.zeros(score.shape, bool)
        for p in partials:
            let |= np.asarray(p >= share, bool)
        return np.nonzero(let & np.asarray(score >= cutoff, bool))
    share = np.ceil(cutoff / parts).astype(score.dtype)
    high = partials[0].copy()
    for p in partials[1:]:
        np.maximum(high, p, out=high)
    return np.nonzero((high >= share) & (score >= cutoff.astype(score.dtype)))


class Search:
    """The best entries so far of each query of a round, over the rows of a task."""

    def __init__(self, queries: Rows, k: int, parts: int, floors: np.ndarray | None):
        self.queries, self.k, self.parts = queries, k, parts
        #: phase 1 has none yet
        self.phase = 1 if floors is None else 2
        self.cutoff = np.full(len(queries.uid), -np.inf, object) if floors is None else floors
        self.order = np.argsort(queries.uid)
        self.entries: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.typed: dict[type, np.ndarray] = {}

    def add(self, rows: Rows) -> None:
        kind = _kind(rows.values, self.queries.values)
        if kind not in self.typed:
            self.typed = {kind: _typed(self.queries.values, kind)}
        queries, values = self.typed[kind], _typed(rows.values, kind)
        cutoff = self.cutoff if kind is object else self.cutoff.astype(np.float64)
        groups = _groups(values.shape[1], self.parts)
        for a in range(0, len(values), TILE_ROWS):
            tile = slice(a, a + TILE_ROWS)
            own_row, own_query = self._own(rows.uid[tile])
            for b in range(0, len(queries), TILE_QUERIES):
                some = slice(b, b + TILE_QUERIES)
                partials = [values[tile, g] @ queries[some, g].T for g in groups]
                score = partials[0].copy()
                for p in partials[1:]:
                    score += p
                row, column = local_lists(partials, self.k) if self.phase == 1 else reaching(partials, score, cutoff[some])
                if not len(row):
                    continue
                found = score[row, column]
                mine = np.isin(row * len(self.queries.uid) + column + b, own_row * len(self.queries.uid) + own_query)
                row, column, found = row[~mine], column[~mine] + b, found[~mine]
                self.entries.append((column, rows.uid[tile][row], rows.vec_id[tile][row], rows.named[tile][row], found))
                self.held += len(row)
                if self.held > HELD:
                    self._cut()

    def _own(self, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) where a row is the query itself."""
        known = self.queries.uid[self.order]
        at = np.minimum(np.searchsorted(known, uid), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == uid) if len(known) else np.zeros(0, np.int64)
        return hit, self.order[at[hit]] if len(known) else hit

    def _cut(self) -> None:
        if not self.entries:
            return
        kinds = {e[4].dtype for e in self.entries}
        to = object if np.dtype(object) in kinds else np.float64
        columns = [np.concatenate([e[i] for e in self.entries]) for i in range(4)]
        score = np.concatenate([np.array([int(x) for x in e[4]], object) if to is object else e[4].astype(to) for e in self.entries])
        keep = _best(columns[0], columns[2], score, self.k)
        self.entries = [(*(c[keep] for c in columns), score[keep])]
        self.held = len(keep)

    def batch(self) -> pa.RecordBatch:
        """(quid, query_id, uid, vec_id, score, beyond): what the task hands on; ``beyond`` orders scores that a long
        doesn't hold, which are given as the nearest long."""
        self._cut()
        column, uid, vec_id, named, score = self.entries[0] if self.entries else (np.zeros(0, np.int64),) * 5
        exact = [int(x) for x in score.tolist()]
        near = [min(max(x, _LONG[0]), _LONG[1]) for x in exact]
        beyond = [(x + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big") if n in _LONG else None for x, n in zip(exact, near, strict=True)]
        arrays = [pa.array(self.queries.uid[column]), pa.array(self.queries.vec_id[column]), pa.array(uid), pa.array(vec_id, mask=~named.astype(bool)), pa.array(near, pa.int64()), pa.array(beyond, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["quid", "query_id", "uid", "vec_id", "score", "beyond"])


ENTRIES = "quid long, query_id long, uid long, vec_id long, score long, beyond binary"


def entry_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast, k: int, parts: int) -> Iterator[pa.RecordBatch]:
    queries, floors = shared.value
    search = Search(queries, k, parts, floors)
    with one_thread():
        for batch in batches:
            search.add(Rows.of(batch, queries.values.shape[1]))
    yield search.batch()


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query with their ranks; each task cuts its own list before the shuffle."""
    order = Window.partitionBy("quid").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), F.col("vec_id").asc_nulls_last(), "uid")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(entries: DataFrame, k: int, queries: Rows) -> np.ndarray:
    """The k-th best score of each query, minus infinity where there are fewer; as many numbers as queries."""
    out = np.full(len(queries.uid), -np.inf, object)
    place = {u: i for i, u in enumerate(queries.uid.tolist())}
    for r in _ranked(entries, k).where(F.col("rank") == k).select("quid", "score", "beyond").collect():
        out[place[r["quid"]]] = r["score"] if r["beyond"] is None else int.from_bytes(r["beyond"], "big") - (1 << (8 * WIDE - 1))
    return out


def exact_top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, parts: int = PARTS, round_bytes: int = ROUND_BYTES, cutoff_every: int = CUTOFF_EVERY
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query vector.

    Vectors are quantised to floor(scale * x). Queries are the rows whose id is divisible by ``every``,
    candidates are all rows but the query's own: of rows with one id each is a row of its own, as a query and as a
    candidate. Ties go to the smaller id, rows without an id come last; a query with fewer candidates than k gets
    all. Null and empty vectors and those with null or non-finite components take no part. Vectors of different
    lengths are compared as if the shorter ended in zeros. Scores beyond a long are ranked exactly and given as the
    nearest long. An empty table gives an empty table; other columns don't matter.

    Queries go through in rounds of about ``round_bytes`` (as float32), dealt by hash, which the driver sends to
    all tasks; a task hands on at most k entries a query and phase.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(quantised(vectors, id_col=id_col, vector_col=vector_col, scale=scale), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    width = F.max(F.greatest(F.size("small"), F.size("large")))
    n, width = asked.agg(F.count("*"), width).first()
    rounds = max(1, -(-n * (width or 0) * 4 // round_bytes))
    dealt = lambda i: F.pmod(F.xxhash64("uid"), F.lit(rounds)) == i
    some = rows.where(F.pmod(F.xxhash64("uid", F.lit("cutoff")), F.lit(cutoff_every)) == 0)
    done: list[DataFrame] = []
    for i in range(rounds if n else 0):
        queries = Rows.of(asked.where(dealt(i)).toArrow())
        first = spark.sparkContext.broadcast((queries, None))
        floors = _floors(some.mapInArrow(lambda it, b=first: entry_batches(it, b, k, parts), ENTRIES), k, queries)
        second = spark.sparkContext.broadcast((queries, floors))
        found = scratch.save(rows.mapInArrow(lambda it, b=second: entry_batches(it, b, k, parts), ENTRIES), f"round-{i}")
        first.destroy()
        second.destroy()
        done.append(found)
    if not done:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    entries = spark.read.schema(ENTRIES).parquet(*[scratch.folder(f"round-{i}") for i in range(len(done))])
    return _ranked(entries, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same result for DuckDB.
TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
