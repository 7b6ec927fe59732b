"""Dense vectors of documents: truncated SVD of the TF-IDF matrix by a randomised range finder.

The matrix is kept by documents. Words that most documents have are a bounded
table, whose vectors go to the documents where they are. A word of a single
document needs no vector at all: it only adds its squared weight to that
document. Vectors of the other words are exchanged, once per block of
documents. The driver sees the bounded table and square matrices of the
sketch width, whatever the corpus and vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tenantlens.operators.documents import document_terms
from tenantlens.operators.search import dot
from tenantlens.sources.sinks import materialize

DOC = ["document_id", "org_id"]
FREQUENT = 1 << 17  # words in the bounded table
BLOCK = 1 << 18  # documents whose rare words are summed together
STEP = 1 << 16  # pairs multiplied at a time
PARTS = "id long, block long, docs array<long>, ws array<double>, v array<double>"


@dataclass
class Embedding:
    """Coordinates of the documents, singular values (largest first) and the squared norm of the whole matrix."""

    vectors: DataFrame
    values: np.ndarray
    energy: float

    def error(self) -> float:
        """Frobenius norm of what the vectors leave out, as a share of the matrix."""
        return float(np.sqrt(max(0.0, 1 - (self.values ** 2).sum() / self.energy))) if self.energy else 0.0


def _normal(seeds: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A fixed standard normal vector for each term, from its hash alone."""
    out = np.empty((len(seeds), width))
    for i, h in enumerate(seeds.tolist()):
        out[i] = np.random.default_rng([seed, h & 0xFFFFFFFFFFFFFFFF]).standard_normal(width)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    return _numbers(column.flatten()), np.repeat(np.arange(len(column)), _numbers(pc.fill_null(pc.list_value_length(column), 0)))


def _block(column: pa.Array, width: int) -> np.ndarray:
    return _numbers(column.flatten()).reshape(-1, width)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _rows(block: np.ndarray) -> pa.Array:
    return _lists(block.ravel(), np.arange(len(block) + 1) * block.shape[1])


def _starts(keys: np.ndarray) -> np.ndarray:
    """Places where ascending keys change."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)


def _add(out: np.ndarray, keys: np.ndarray, vectors: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Adds ``x`` times the vector ``at`` to row ``keys`` (ascending) of ``out``, pair by pair, a bounded number at a time."""
    for s in range(0, len(keys), STEP):
        k = keys[s:s + STEP]
        starts = _starts(k)
        out[k[starts]] += np.add.reduceat(vectors[at[s:s + STEP]] * x[s:s + STEP, None], starts, axis=0)


def _total(grams: DataFrame, width: int) -> np.ndarray:
    """Sum of square matrices, one a row."""
    out = np.zeros(width * width)
    for r in grams.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    out = out.reshape(width, width)
    return (out + out.T) / 2


def _gram(vectors: DataFrame, width: int, by: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of all vectors times ``by``; each task hands on one matrix."""
    by = np.eye(width) if by is None else by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            block = _block(b.column(0), width) @ by
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([_rows(total.reshape(1, -1))], names=["v"])

    return _total(vectors.select("v").mapInArrow(run, "v array<double>"), width)


def _whitener(gram: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Matrix that makes the columns of a block orthonormal; directions without weight become zero."""
    values, basis = np.linalg.eigh(gram)
    keep = values > tolerance * max(values[-1], 0.0)
    return basis * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _orthonormal(vectors: DataFrame, width: int) -> np.ndarray:
    """Matrix that makes the columns of all vectors orthonormal, in two passes: one loses digits on close columns."""
    first = _whitener(_gram(vectors, width))
    return first @ _whitener(_gram(vectors, width, first))


def _placed(rows: DataFrame, top: list, frequent: bool) -> DataFrame:
    """The frequent terms of every row by their place in the table, or a row for every other one."""
    table = rows.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(table.value, pa.string())
        for b in batches:
            doc, terms, tfs = b.column(0), b.column(1), b.column(2)
            flat, (x, row) = pc.cast(terms.flatten(), pa.string()), _flat(tfs)
            place = pc.index_in(flat, words)
            known = _numbers(place.is_valid())
            if frequent:
                bounds = np.searchsorted(row[known], np.arange(len(b) + 1))
                out = [doc, _lists(_numbers(place.drop_null()).astype(np.int32), bounds), _lists(x[known].astype(float), bounds)]
                yield pa.RecordBatch.from_arrays(out, names=["doc", "at", "x"])
            else:
                out = [doc.take(pa.array(row[~known])), flat.filter(pa.array(~known)), pa.array(x[~known].astype(float))]
                yield pa.RecordBatch.from_arrays(out, names=["doc", "term", "tf"])

    return rows.select("doc", "terms", "tfs").mapInArrow(run, "doc long, at array<int>, x array<double>" if frequent else "doc long, term string, tf double")


def _matrix(rows: DataFrame, vocabulary: DataFrame, width: int, seed: int, frequent: int) -> tuple[DataFrame, np.ndarray]:
    """The matrix by documents, staged, and the factors of the frequent terms.

    ``at`` and ``x`` are a document's frequent terms, ``ids`` and ``ws`` the
    others that more documents have; ``h`` is the squared norm of the terms no
    other document has, ``e`` that of all; ``v`` is the sketch.
    """
    most = materialize(vocabulary.orderBy(F.col("n").desc(), "term").limit(frequent).withColumn("seed", F.xxhash64("term")))
    table = most.toArrow()
    top, scale = table["term"].to_pylist(), _numbers(table["scale"].combine_chunks()).astype(float)
    told = rows.sparkSession.sparkContext.broadcast((scale, _normal(_numbers(table["seed"].combine_chunks()), width, seed) * scale[:, None]))
    rest = materialize(vocabulary.join(F.broadcast(most), "term", "left_anti").select(
        "term", "scale", F.when(F.col("n") > 1, F.monotonically_increasing_id()).otherwise(-1).alias("id"), F.xxhash64("term").alias("seed")))
    rare = _placed(rows, top, False).join(rest, "term").select("doc", F.struct("id", "seed", (F.col("tf") * F.col("scale")).alias("w")).alias("t"))
    rare = rare.repartition("doc").groupBy("doc").agg(F.collect_list("t").alias("t")).select("doc", "t.id", "t.seed", "t.w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, normal = told.value
        for b in batches:
            n, (at, row), (x, _) = len(b), _flat(b.column(1)), _flat(b.column(2))
            (ids, other), (seeds, _), (w, _) = (_flat(b.column(i)) for i in (3, 4, 5))
            v, w = np.zeros((n, width)), w.astype(float)
            _add(v, row, normal, at, x)
            drawn, which = np.unique(seeds.astype(np.int64), return_inverse=True)
            _add(v, other, _normal(drawn, width, seed), which, w)
            alone = ids == -1
            h = np.bincount(other[alone], w[alone] ** 2, n).astype(float)  # of nothing, it counts in integers
            e = np.bincount(other, w ** 2, n) + np.bincount(row, (x * scale[at]) ** 2, n).astype(float)
            bounds = np.searchsorted(other[~alone], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), _lists(ids[~alone].astype(np.int64), bounds), _lists(w[~alone], bounds), pa.array(h), pa.array(e), _rows(v)],
                names=["doc", "at", "x", "ids", "ws", "h", "e", "v"])

    whole = _placed(rows, top, True).join(rare, "doc", "left")
    cells = whole.mapInArrow(run, "doc long, at array<int>, x array<double>, ids array<long>, ws array<double>, h double, e double, v array<double>")
    return materialize(cells.where("e > 0")), scale


def _frequent_sums(cells: DataFrame, by: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transposed matrix times the vectors for the frequent terms, and the outer products for the terms of one document.

    Each task hands on a bounded table; its last rows are the outer products.
    """
    width, n = len(by), len(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + width, width))
        for b in batches:
            (at, row), (x, _) = _flat(b.column(0)), _flat(b.column(1))
            q, order = _block(b.column(3), width) @ by, np.argsort(at, kind="stable")
            _add(total, at[order], q, row[order], x[order])
            total[n:] += (q * _numbers(b.column(2))[:, None]).T @ q
        found = np.flatnonzero(total.any(axis=1))
        for s in range(0, len(found), STEP):
            yield pa.RecordBatch.from_arrays([pa.array(found[s:s + STEP]), _rows(total[found[s:s + STEP]])], names=["id", "v"])

    parts = cells.select("at", "x", "h", "v").mapInArrow(run, "id long, v array<double>")
    table = _summed(parts, "id", width).toArrow().combine_chunks()
    out = np.zeros((n + width, width))
    for b in table.to_batches():
        out[_numbers(b.column(0))] = _block(b.column(1), width)
    return out[:n] * scale[:, None], out[n:]


def _summed(parts: DataFrame, key: str, width: int) -> DataFrame:
    sums = parts.groupBy(key).agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    return sums.select(key, F.array(*[f"s{i}" for i in range(width)]).alias("v"))


def _rare_parts(cells: DataFrame, by: np.ndarray, members: bool) -> DataFrame:
    """Sums of the vectors of a block of documents for each rare term; with ``members``, the documents and weights behind each."""
    width = len(by)

    def sums(block: int, docs: list, vectors: list, ids: list, rows: list, ws: list) -> Iterator[pa.RecordBatch]:
        doc, q, key, row, w = (np.concatenate(c) for c in (docs, vectors, ids, rows, ws))
        order = np.argsort(key, kind="stable")
        key, row, w = key[order], row[order], w[order]
        starts, ends = _starts(key), 0
        while ends < len(starts):  # whole terms, about as many pairs as are multiplied at a time
            first, ends = ends, max(ends + 1, np.searchsorted(starts, starts[ends] + STEP))
            lo, hi = starts[first], starts[ends] if ends < len(starts) else len(key)
            cut, n = starts[first:ends] - lo, ends - first
            bounds = np.append(cut, hi - lo) if members else np.zeros(n + 1, int)
            kept = slice(lo, hi) if members else slice(0, 0)
            v = np.add.reduceat(q[row[lo:hi]] * w[lo:hi, None], cut, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[starts[first:ends]]), pa.array(np.full(n, block)), _lists(doc[row[kept]], bounds), _lists(w[kept], bounds), _rows(v)],
                                             names=["id", "block", "docs", "ws", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [[], [], [], [], []], 0, TaskContext.get().partitionId()
        for b in batches:
            (ids, row), (w, _) = _flat(b.column(1)), _flat(b.column(2))
            for c, new in zip(held, (_numbers(b.column(0)), _block(b.column(3), width) @ by, ids, row + n, w), strict=True):
                c.append(new)
            n += len(b)
            if n >= BLOCK + BLOCK // 2:
                yield from sums(block, *held)
                held, n, block = [[], [], [], [], []], 0, block + (1 << 32)
        if n:
            yield from sums(block, *held)

    return cells.select("doc", "ids", "ws", "v").mapInArrow(run, PARTS)


def _met(parts: DataFrame, width: int, back: bool) -> DataFrame:
    """Sums of the parts of every term: their outer products, as one row of each task without documents, and with ``back`` every part again with the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, left = np.zeros((width, width)), None

        def close(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            starts = _starts(_numbers(b.column(0)))
            z = np.add.reduceat(_block(b.column(4), width), starts, axis=0)
            total[:] += z.T @ z
            if back:
                again = np.repeat(z, np.diff(np.append(starts, len(b))), axis=0)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], _rows(again)], names=b.schema.names)

        for b in batches:
            if left is not None:
                b = pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
            if len(b):
                last = int(_starts(_numbers(b.column(0)))[-1])  # the last term may go on in the next batch
                left = b.slice(last)
                if last:
                    yield from close(b.slice(0, last))
        if left is not None:
            yield from close(left)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.float64())), _rows(total.reshape(1, -1))],
                                         names=["id", "block", "docs", "ws", "v"])

    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(run, PARTS)


def _handed_back(met: DataFrame, width: int, tasks: int) -> DataFrame:
    """The sums of the rare terms, times their weights, summed by document; matrices pass through as document -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total = {}, np.zeros((1024, width))

        def out() -> Iterator[pa.RecordBatch]:
            docs = np.fromiter(places, np.int64, len(places))
            for s in range(0, len(docs), STEP):
                e = min(s + STEP, len(docs))
                yield pa.RecordBatch.from_arrays([pa.array(docs[s:e]), _rows(total[s:e])], names=["doc", "v"])

        for b in batches:
            matrix = _numbers(b.column(0)) < 0
            for m in b.filter(pa.array(matrix)).column(3).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([-1]), _rows(np.array([m]))], names=["doc", "v"])
            b = b.filter(pa.array(~matrix))
            if not len(b):
                continue
            (doc, row), (w, _) = _flat(b.column(1)), _flat(b.column(2))
            found, which = np.unique(doc, return_inverse=True)
            at = np.fromiter((places.setdefault(d, len(places)) for d in found.tolist()), np.int64, len(found))
            if len(places) > len(total):
                total = np.concatenate([total, np.zeros((max(len(total), len(places) - len(total)), width))])
            order = np.argsort(which, kind="stable")
            part = np.zeros((len(found), width))
            _add(part, which[order], _block(b.column(3), width), row[order], w[order])
            total[at] += part
            if len(places) >= 2 * BLOCK:
                yield from out()
                places, total = {}, np.zeros((1024, width))
        yield from out()

    return materialize(met.select("block", "docs", "ws", "v").repartition(tasks, "block").mapInArrow(run, "doc long, v array<double>"))


def _frequent_product(cells: DataFrame, by: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """Per document, the weighted sum of the frequent terms' vectors, plus what the terms no other document has add to its own vector."""
    width = len(by)
    told = cells.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (at, row), (x, _) = _flat(b.column(1)), _flat(b.column(2))
            v = (_block(b.column(4), width) @ by) * _numbers(b.column(3))[:, None]
            _add(v, row, told.value, at, x)
            yield pa.RecordBatch.from_arrays([b.column(0), _rows(v)], names=["doc", "v"])

    return cells.select("doc", "at", "x", "h", "v").mapInArrow(run, "doc long, v array<double>")


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""
    width = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _rows(_block(b.column(1), width) @ matrix)], names=["doc", "v"])

    return vectors.select("doc", "v").mapInArrow(run, "doc long, v array<double>")


def _decompose(rows: DataFrame, vocabulary: DataFrame, *, dims: int = 64, oversample: int = 10, turns: int = 1, seed: int = 7, frequent: int = FREQUENT) -> Embedding:
    """Of staged rows (doc, document_id, org_id, terms, tfs), one a document, and (term, n, scale): documents with the term, factor of its weights."""
    width = dims + oversample
    matrix, scale = _matrix(rows, vocabulary, width, seed, frequent)
    blocks = max(4, -(-rows.count() // BLOCK))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, blocks)
    energy = matrix.agg(F.sum("e")).first()[0] or 0.0
    vectors, cells = matrix.select("doc", "v"), matrix
    for turn in range(turns + 1):
        by = _orthonormal(vectors, width)
        top, squares = _frequent_sums(cells.coalesce(tasks), by, scale)
        squares += top.T @ top
        met = _met(_rare_parts(cells.coalesce(blocks), by, turn < turns), width, turn < turns)
        if turn == turns:
            squares += _total(met, width)
            break
        back = _handed_back(met, width, 4 * tasks)
        squares += _total(back.where("doc < 0"), width)
        whitener = _whitener(squares)
        new = _frequent_product(cells, by, top * scale[:, None]).unionByName(back.where("doc >= 0"))
        vectors = materialize(_times(_summed(new, "doc", width), whitener))
        cells = matrix.drop("v").join(vectors, "doc")
    squares, basis = np.linalg.eigh(squares)
    order = np.argsort(-squares)[:dims]
    values, basis = np.sqrt(np.maximum(squares[order], 0.0)), basis[:, order]
    basis = basis * np.where(np.abs(basis.max(axis=0)) >= np.abs(basis.min(axis=0)), 1.0, -1.0)
    found = _times(vectors, by @ (basis * values)).withColumnRenamed("v", "embedding")
    return Embedding(rows.select("doc", *DOC).join(found, "doc").drop("doc"), values, energy)


def decompose(weights: DataFrame, **options) -> Embedding:
    """Leading ``dims`` coordinates of every document of ``weights`` (document_id, org_id, term, weight).

    ``turns`` power iterations sharpen the range. Rows with a NULL document or
    weight do not count; a document without weights has no vector. Singular
    vectors have no sign of their own: the largest entry of each one's mixture is made positive.
    """
    known = weights.where("document_id is not null and term is not null and weight is not null and weight != 0")
    pairs = known.groupBy(*DOC, "term").agg(F.sum("weight").alias("weight"))
    lists = pairs.groupBy(*DOC).agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    rows = materialize(lists.select(F.monotonically_increasing_id().alias("doc"), *DOC, F.col("t.term").alias("terms"), F.col("t.weight").alias("tfs")))
    vocabulary = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("scale")))
    return _decompose(rows, vocabulary, **options)


def embed_dense(docs: DataFrame, *, dims: int = 64, **options) -> DataFrame:
    """(document_id, org_id, embedding): unit vectors of the whole texts, NULL for texts without a weighted word."""
    terms, vocabulary = document_terms(docs)
    found = _decompose(terms, vocabulary, dims=dims, **options).vectors
    v, length = F.col("embedding"), F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    unit = F.when(length > 1e-9, F.transform(v, lambda x: x / length))
    rows = docs.select(*DOC).distinct()
    same = rows.document_id.eqNullSafe(found.document_id) & rows.org_id.eqNullSafe(found.org_id)
    return rows.join(found, same, "left").select(rows.document_id, rows.org_id, unit.alias("embedding"))
