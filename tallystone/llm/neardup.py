"""Near-duplicate classes by DartMinHash signatures, banding, exact checks and connected components.

DartMinHash (weighted minwise hashing): every element owns the region [0, weight) x [0, infinity) of a
board. Hashing throws the same darts at the same places for every document; a document keeps the darts that
land in its regions, and for each of ``k`` coordinates the dart of least rank. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Only darts of a rank below about
k ln(k) / total weight are looked at, so the cost is that of reading the elements once plus a fixed number of
darts, not elements times coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.graph import components
from tallystone.llm.scratch import Scratch
from tallystone.llm.texthash import U64, chunks, mix64, row_keys, salted, shingle_cells, string_buffers, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 25 bands of 5 coordinates: a pair of similarity 0.8 misses all bands with probability 5e-5.
BANDS, BAND_ROWS = 25, 5
#: Pairs whose signatures agree in less than this share aren't checked exactly: 4.2 standard deviations below 0.8.
ESTIMATE_FLOOR = 0.65
#: Documents in a block of the comparison of what is left of a large bucket.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Bytes of text that a worker hashes at once.
CHUNK_BYTES = 1 << 20
#: Cells whose darts are thrown at once.
CELLS = 1 << 19


class DartMinHash:
    """Weighted minwise signatures of ``k`` coordinates.

    Elements come as unit cells: an element of weight w has ceil(w) cells with hashes of their own, the last
    of which may be covered in part (``cover`` below 1).
    """

    def __init__(self, k: int):
        self.k = k

    def sketch(self, cells: np.ndarray, rows: np.ndarray, cover: np.ndarray | None = None) -> np.ndarray:
        """(rows, k) uint64: the earliest dart of each coordinate; 0 throughout for rows without cells."""
        count = np.diff(rows)
        out = np.zeros((len(count), self.k), U64)
        todo = np.flatnonzero(count > 0)
        weight = count.astype(np.float64)
        if cover is not None and len(todo):
            weight[todo] = np.add.reduceat(cover, rows[:-1][todo])
            todo = todo[weight[todo] > 0]
        reach = self.k * (math.log(max(self.k, 2)) + 3.0)
        while len(todo):
            out[todo], missed = self._throw(cells, rows, cover, todo, reach / weight[todo])
            todo, reach = todo[missed], reach * 2
        return out

    def _throw(self, cells: np.ndarray, rows: np.ndarray, cover: np.ndarray | None, which: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Darts of rank below ``limit`` (one a row) for the rows ``which``; also which rows lack a coordinate.

        Cells are thrown in pieces; only the darts that win their coordinate so far go from piece to piece.
        """
        count = np.diff(rows)[which]
        begin = np.cumsum(count) - count
        best, sketch = np.full(len(which) * self.k, np.inf), np.zeros(len(which) * self.k, U64)
        for a in range(0, int(count.sum()), CELLS):
            b = min(a + CELLS, int(count.sum()))
            row = np.searchsorted(begin, np.arange(a, b), side="right") - 1
            at = rows[which][row] + np.arange(a, b) - begin[row]
            for slot, rank, dart in self._darts(cells[at], row, None if cover is None else cover[at], limit):
                np.minimum.at(best, slot, rank)
                won = rank == best[slot]
                sketch[slot[won]] = dart[won] | U64(1)
        lacks = np.isinf(best).reshape(len(which), self.k).any(axis=1)
        return sketch.reshape(len(which), self.k), lacks

    def _darts(self, own: np.ndarray, row: np.ndarray, part: np.ndarray | None, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(coordinate of a row, rank, hash) of the darts of some cells, those of the n-th throw together."""
        rank, step = np.zeros(len(own)), 0
        while len(own):
            # ranks of a cell's darts are a Poisson process: gaps are exponential
            bits = salted(own, 3 * step)
            gap = ((bits >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
            near = gap > np.exp(-np.minimum(limit[row] - rank, 700.0))
            own, row, rank = own[near], row[near], rank[near] - np.log(gap[near])
            dart = salted(own, 3 * step + 1)
            slot = row * self.k + (salted(own, 3 * step + 2) >> U64(33)).astype(np.int64) % self.k
            if part is None:
                yield slot, rank, dart
            else:
                part = part[near]
                hit = (mix64(dart) >> U64(11)).astype(np.float64) * 2.0**-53 < part
                yield slot[hit], rank[hit], dart[hit]
            step += 1


def band_keys(sketch: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """(rows, bands) int64; equal keys mean equal coordinates of the same band."""
    out = np.zeros((len(sketch), bands), U64)
    for j in range(band_rows):
        out = mix64(out + sketch[:, j : bands * band_rows : band_rows])
    return mix64(out + np.arange(bands, dtype=np.int64).astype(U64)).view(np.int64)


def _lanes(sketch: np.ndarray) -> np.ndarray:
    return (sketch >> U64(48)).astype(np.uint16)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


SKETCH_SCHEMA = "doc_id long, k1 long, k2 long, bands array<long>, sig binary"


def sketch_batches(batches: Iterator[pa.RecordBatch], shingle_words: int, bands: int, band_rows: int) -> Iterator[pa.RecordBatch]:
    darts = DartMinHash(bands * band_rows)
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for a, b in chunks(offsets, CHUNK_BYTES):
            own = offsets[a : b + 1] - offsets[a]
            text = data[offsets[a] : offsets[b]]
            words, _, _, rows = word_hashes(text, own)
            k1, k2 = row_keys(words, rows, text, own)
            cells, at = shingle_cells(words, rows, shingle_words)
            sketch = darts.sketch(cells, at)
            some = np.diff(at) > 0
            keys, lanes = band_keys(sketch, bands, band_rows), _lanes(sketch)
            held = np.concatenate([np.zeros(1, np.int32), np.cumsum(some * bands).astype(np.int32)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(held), pa.array(keys[some].ravel())),
                    _binary([x.tobytes() if s else b"" for x, s in zip(lanes, some.tolist(), strict=True)]),
                ],
                names=["doc_id", "k1", "k2", "bands", "sig"],
            )


def bag_batches(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    """The cells of each text as sorted 32-bit hashes."""
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for a, b in chunks(offsets, CHUNK_BYTES):
            words, _, _, rows = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            cells, at = shingle_cells(words, rows, shingle_words)
            short = (cells >> U64(32)).astype(np.uint32)
            bags = [np.unique(short[x:y]).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _binary(bags), pa.array([len(x) for x in bags], pa.int64())], names=["doc_id", "bag", "size"])


def jaccard(x: bytes, y: bytes) -> float:
    """Similarity of two bags; 0 if both are empty."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def agreement_batches(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
            keep[i] = len(x) and np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)) >= floor
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def similar_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [jaccard(x.as_py(), y.as_py()) >= threshold for x, y in zip(batch.column("ba"), batch.column("bb"), strict=True)]
        yield batch.filter(pa.array(keep, type=pa.bool_())).select(["a", "b"])


def cross_batches(batches: Iterator[pa.RecordBatch], floor: float, band_rows: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a bucket, as many as it takes to join the components that they link.

    Only pairs of different components are looked at, likeliest first: a pair that shares several buckets in
    the first of them, and a pair whose components an earlier link of the blocks has joined not at all.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            some, every = row["some"], row["every"]
            x, y = (np.frombuffer(b"".join(r["sig"] for r in s), np.uint16).reshape(len(s), -1) for s in (some, every))
            xd, yd = (np.array([r["doc"] for r in s], np.int64) for s in (some, every))
            xc, yc = (np.array([r["comp"] for r in s], np.int64) for s in (some, every))
            above: dict[int, int] = {}

            def top(c: int, above: dict[int, int] = above) -> int:
                while c in above:
                    c = above[c]
                return c

            links = []
            for i in range(len(some)):
                same = y == x[i]
                agree = same.mean(axis=1)
                good = np.flatnonzero((agree >= floor) & (yc != xc[i]) & ((yc == row["main"]) | (yd > xd[i])))
                if not len(good):
                    continue
                first = same[good].reshape(len(good), -1, band_rows).all(axis=2).argmax(axis=1) == row["band"]
                good = good[first]
                for j in good[np.argsort(-agree[good], kind="stable")].tolist():
                    own, other = top(int(xc[i])), top(int(yc[j]))
                    if own != other and jaccard(some[i]["bag"], every[j]["bag"]) >= threshold:
                        above[max(own, other)] = min(own, other)
                        links.append((int(xd[i]), int(yd[j])))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in links], pa.int64()), pa.array([max(p) for p in links], pa.int64())], names=["a", "b"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """DartMinHash signatures: doc_id, the 128-bit key of the word sequence, band keys and 16-bit lanes."""
    return _texts(docs, id_col, text_col).mapInArrow(lambda it: sketch_batches(it, shingle_words, bands, band_rows), SKETCH_SCHEMA)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, floor: float = ESTIMATE_FLOOR
) -> DataFrame:
    """(doc_id, class_id), one row per document: class_id is the least doc_id of its near-duplicate class.

    Words are runs of letters, digits and underscores of the lower-cased text; shingles of ``shingle_words``
    words count as often as they occur, and two documents are linked if the weighted Jaccard similarity of
    their shingle counts is at least ``threshold``; classes are the connected components of the links.
    Candidates come from equal bands of DartMinHash signatures, and every link is checked exactly.

    Large groups: texts of equal words are one node throughout. Each bucket first links its members to its
    one of them only (another one in each bucket). What then still lies in several components of one bucket is
    compared in blocks of bounded size, those outside of the bucket's largest component against the rest, so
    no link between documents that share a bucket is lost and no work is spent inside of a component.

    Null texts count as empty. Texts without words are linked to texts of equal bytes only (all empty texts
    are one class). Rows of equal doc_id are one document. Rows without a doc_id come back with a null class.
    An empty table gives an empty table; other columns of ``docs`` don't matter, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = _texts(docs, id_col, text_col)
    sketch = scratch.save(sketches(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, bands=bands, band_rows=band_rows), "sketch")
    known = sketch.where("doc_id is not null")

    # texts of equal words: the least id stands for all
    heads = scratch.save(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("head")), "heads")
    member = known.select("doc_id", "k1", "k2").join(heads, ["k1", "k2"]).select("doc_id", "head")
    of_heads = known.withColumnRenamed("doc_id", "head").join(heads, ["k1", "k2", "head"], "left_semi").dropDuplicates(["k1", "k2", "head"])
    nodes = scratch.save(of_heads.select(F.col("head").alias("doc"), "bands", "sig"), "nodes")

    # buckets of more than one node
    banded = nodes.select("doc", F.posexplode("bands").alias("band", "bucket"))
    # the member that the others are compared with differs from bucket to bucket of the same documents
    buckets = banded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc", "bucket"), F.col("doc"))).alias("least"), F.count("*").alias("n"))
    buckets = buckets.where("n > 1").select("bucket", F.col("least.doc").alias("center"), "n")
    shared = scratch.save(banded.join(buckets, "bucket"), "shared")
    sig_a, sig_b = nodes.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), nodes.select(F.col("doc").alias("b"), F.col("sig").alias("sb"))
    stars = shared.where("doc <> center").select(F.least("center", "doc").alias("a"), F.greatest("center", "doc").alias("b")).distinct()
    likely = scratch.save(stars.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: agreement_batches(it, floor), "a long, b long"), "likely")

    # the shingles of documents that may have a link
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(shared.where("n > 2").select("doc")).distinct()
    bags = scratch.save(texts.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: bag_batches(it, shingle_words), "doc_id long, bag binary, size long"), "bags")
    bag_a, bag_b = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("ba")), bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bb"))

    def links(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(bag_a, "a").join(bag_b, "b").select("a", "b", "ba", "bb")
        return scratch.save(both.mapInArrow(lambda it: similar_batches(it, threshold), "a long, b long"), name)

    comps = components(links(likely, "links"), scratch, "first")

    # buckets that hold several components still
    mine = shared.where("n > 2").select("bucket", "band", "doc")
    mine = mine.join(comps.withColumnRenamed("node", "doc"), "doc", "left").join(bags.select(F.col("doc_id").alias("doc"), "size"), "doc")
    mine = scratch.save(mine.select("bucket", "band", "doc", F.coalesce("comp", "doc").alias("comp"), "size"), "mine")
    sizes = mine.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    most = F.max(F.struct("c", "comp", "s"))
    mixed = sizes.groupBy("bucket").agg(most.alias("most"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    mixed = mixed.select("bucket", F.col("most.comp").alias("main"), "n", "s", (F.col("n") - F.col("most.c")).alias("out_n"), (F.col("s") - F.col("most.s")).alias("out_s"))
    mixed = scratch.save(mixed.where("out_n > 0"), "mixed")
    rows = mine.drop("size").join(mixed, "bucket").join(nodes.select("doc", "sig"), "doc").join(bags.select(F.col("doc_id").alias("doc"), "bag"), "doc")
    blocks = lambda n, s: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_BYTES)))
    spread = lambda n, s: F.pmod(F.xxhash64("doc"), blocks(n, s))
    entry = F.struct("doc", "comp", "sig", "bag")
    every = rows.withColumn("block", spread(F.col("n"), F.col("s"))).repartition("bucket", "block").groupBy("bucket", "block").agg(F.collect_list(entry).alias("every"))
    some = rows.where("comp <> main").withColumn("blocks", blocks(F.col("n"), F.col("s"))).withColumn("own", spread(F.col("out_n"), F.col("out_s")))
    some = some.repartition("bucket", "own").groupBy("bucket", "band", "main", "own", "blocks").agg(F.collect_list(entry).alias("some"))
    # one row for each pair of blocks, dealt by bucket and block: the pairs of one bucket are the work of many tasks
    paired = some.select("bucket", "band", "main", "some", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    crossed = paired.join(every, ["bucket", "block"]).select("band", "main", "some", "every")
    late = scratch.save(crossed.mapInArrow(lambda it: cross_batches(it, floor, band_rows, threshold), "a long, b long").distinct(), "late")
    left, right = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    merged = late.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    again = components(merged, scratch, "second")

    final = comps.select("node", "comp").union(again.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    final = final.join(again.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    final = scratch.save(final.distinct(), "final")
    classes = member.join(final.withColumnRenamed("node", "head"), "head", "left").select("doc_id", F.coalesce("comp", "head").alias("class_id"))
    without = texts.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).unionByName(without)


def keep_representatives(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text, ...) whose doc_id is the class_id of their class, or null."""
    kept = near_duplicates(docs, **options).where("doc_id = class_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
