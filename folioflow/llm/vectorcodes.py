"""Product codes of vectors: each part is the number of its nearest codebook entry.

The nearest entry is sought in a geometric near-neighbour access tree over the
entries of a codebook. A node has split points; every other entry belongs to its
nearest one, and for each split point and each child the node stores the range of
distances from that point to the child's entries. A query's distances to the split
points rule out every child that, by one of these ranges, can hold nothing as near
as the best entry so far. Distances are floats with an upper bound of their error
on the safe side; entries that lie within that error of the best one are told apart
by integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.rows import of_batches
from folioflow.operators.skew import lookup_join
from folioflow.session import kept

# Fixed by the definition of the code.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Split points of a node, and the number of entries that are not split any further.
FANOUT, LEAF = 16, 64
# Vectors that search a tree together.
TOGETHER = 4096


@dataclass
class _Node:
    splits: np.ndarray
    # Per child its entries: an array, or a node.
    children: list
    # Least and greatest distance from a split point (row) to the entries of a child (column).
    low: np.ndarray
    high: np.ndarray


class Gnat:
    """Nearest entries of one codebook part, exactly; of equally near ones the first."""

    def __init__(self, entries: np.ndarray):
        self.exact, first = np.unique(entries.astype(np.int64), axis=0, return_index=True)
        order = np.argsort(first)
        self.exact, self.first = self.exact[order], first[order]
        self.points = self.exact.astype(np.float64)
        self.norms = (self.points**2).sum(1)
        # Relative error of sums of so many products, on the safe side.
        self.error = 4.0 * (self.points.shape[1] + 4) * 2.0**-53
        self.root = self._node(np.arange(len(self.exact)))

    def _from(self, entry: int, others: np.ndarray) -> np.ndarray:
        gaps = self.exact[others] - self.exact[entry]
        return np.sqrt((gaps * gaps).sum(1).astype(np.float64))

    def _node(self, members: np.ndarray) -> _Node | np.ndarray:
        if len(members) <= LEAF:
            return members
        # Split points far apart: each is the entry that is farthest from those before.
        splits, away = [0], [self._from(members[0], members)]
        while len(splits) < FANOUT:
            splits.append(int(np.argmax(np.min(away, axis=0))))
            away.append(self._from(members[splits[-1]], members))
        away = np.array(away)
        rest = np.setdiff1d(np.arange(len(members)), splits)
        owner = np.argmin(away[:, rest], axis=0)
        low, high = np.full((FANOUT, FANOUT), np.inf), np.full((FANOUT, FANOUT), -np.inf)
        children = []
        for child in range(FANOUT):
            own = rest[owner == child]
            if len(own):
                low[:, child] = away[:, own].min(1) * (1 - 1e-12)
                high[:, child] = away[:, own].max(1) * (1 + 1e-12)
            children.append(self._node(members[own]))
        return _Node(members[splits], children, low, high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and the squared distance, as integers, for every row of whole numbers."""
        found = [self._search(queries[i : i + TOGETHER].astype(np.int64)) for i in range(0, len(queries), TOGETHER)]
        return tuple(np.concatenate(column) for column in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def _search(self, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        queries = exact.astype(np.float64)
        norms = (queries**2).sum(1)
        # Squared distances to the entries that were looked at, and how far the best may lie.
        squares = np.full((len(queries), len(self.points)), np.inf)
        slack = (norms + self.norms.max()) * self.error
        reach = np.full(len(queries), np.inf)
        self._visit(self.root, np.arange(len(queries)), queries, norms, slack, squares, reach)
        near = squares <= (squares.min(1) + 2 * slack)[:, None]
        best = np.argmax(near, axis=1)
        for row in np.flatnonzero(near.sum(1) > 1).tolist():
            few = np.flatnonzero(near[row])
            gaps = self.exact[few] - exact[row]
            best[row] = few[np.argmin((gaps * gaps).sum(1))]
        gaps = exact - self.exact[best]
        return self.first[best], (gaps * gaps).sum(1)

    def _measure(self, entries: np.ndarray, asked: np.ndarray, queries, norms, slack, squares, reach) -> np.ndarray:
        found = norms[asked, None] + self.norms[entries] - 2 * (queries[asked] @ self.points[entries].T)
        squares[asked[:, None], entries] = found
        upper = np.sqrt(np.maximum(found.min(1) + slack[asked], 0)) * (1 + 1e-12)
        reach[asked] = np.minimum(reach[asked], upper)
        return found

    def _visit(self, node, asked: np.ndarray, queries, norms, slack, squares, reach) -> None:
        rest = queries, norms, slack, squares, reach
        if isinstance(node, np.ndarray):
            if len(node) and len(asked):
                self._measure(node, asked, *rest)
            return
        if not len(asked):
            return
        found = self._measure(node.splits, asked, *rest)
        least = np.sqrt(np.maximum(found - slack[asked, None], 0)) * (1 - 1e-12)
        most = np.sqrt(np.maximum(found + slack[asked, None], 0)) * (1 + 1e-12)
        own = np.argmin(found, axis=1)
        # The child of the nearest split point first: it shortens the reach for all others.
        for child, below in enumerate(node.children):
            self._visit(below, asked[own == child], *rest)
        bound = reach[asked, None]
        alive = np.ones(found.shape, bool)
        for i in range(len(node.splits)):
            alive &= (least[:, i : i + 1] - node.high[i] <= bound) & (node.low[i] - most[:, i : i + 1] <= bound)
        alive[np.arange(len(asked)), own] = False
        for child, below in enumerate(node.children):
            self._visit(below, asked[alive[:, child]], *rest)


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("int"))


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, whole): vectors as integers, floor(1024 x), stored; see `vector_codes` for what is left out."""
    x = F.col(vector)
    sized = rows.select("vec_id", "label", x.alias("_x")).filter(
        x.isNotNull() & (F.size(x) >= PARTS) & (F.size(x) % PARTS == 0)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    )
    first = sized.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", F.size("_x").alias("n"))).alias("f")).first()
    dims = first.f.n if first.f else PARTS
    # Squared distances of whole vectors have to be longs.
    most = (math.isqrt(2**62 // dims) // 2) / SCALE
    fits = ~F.exists("_x", lambda v: F.abs(v.cast("double")) >= min(most, 2**31 / SCALE - 1))
    return kept(sized.filter((F.size("_x") == dims) & fits).select("vec_id", "label", _whole(F.col("_x")).alias("whole")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_books(whole: DataFrame) -> np.ndarray:
    """(part, entry, component) of the vectors with the smallest vec_ids: at most ENTRIES rows come here."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()
    width = len(rows[0].whole) // PARTS if rows else 0
    table = np.array([r.whole for r in rows], np.int64).reshape(len(rows), PARTS, width)
    return table.transpose(1, 0, 2)


def _parts_of(books: np.ndarray):
    """A function of a batch's matrix: per part its columns, the nearest entries, and the squared distances."""
    trees: list[Gnat] = []

    def of(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if not trees:
            trees.extend(Gnat(book) for book in books)
        width = books.shape[2]
        for part, tree in enumerate(trees):
            columns = matrix[:, part * width : (part + 1) * width]
            yield part, columns, *tree.nearest(columns)

    return of


def _moved(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry as the floor of the mean of the parts that are nearest to it; unused ones stay.

    Tasks send one row of sums for each entry, so at most parts x entries rows
    arrive here, however many vectors there are.
    """
    width, nearest = books.shape[2], _parts_of(books)
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, columns, entry, _ in nearest(_matrix(batch.column(0))):
                order = np.argsort(entry, kind="stable")
                used, starts = np.unique(entry[order], return_index=True)
                total[part, used] += np.add.reduceat(columns[order].astype(np.int64), starts)
                count[part] += np.bincount(entry, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "n", *names])

    schema = ", ".join(f"{name} long" for name in ["part", "entry", "n", *names])
    added = whole.select("whole").mapInArrow(sums, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col(s).cast("decimal(38,0)")) for s in names]).alias("sums")
    )
    books = books.copy()
    for row in added.collect():
        books[row.part, row.entry] = [int(total) // row.n for total in row.sums]
    return books



def _coded(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """(label, vec_id, code, error) of every vector."""
    nearest = _parts_of(books)

    def batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code, error = np.zeros((rows.num_rows, PARTS), np.uint8), np.zeros(rows.num_rows, np.int64)
        for part, _, entry, square in nearest(_matrix(rows.column(2))):
            code[:, part] = entry
            error += square
        digits = code.tobytes().hex()
        codes = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, label {whole.schema['label'].dataType.simpleString()}, code string, error long"
    return whole.select("vec_id", "label", "whole").mapInArrow(of_batches(batch), schema)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_codebooks(whole: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component): the first vectors' parts, moved `rounds` times to the mean of what is nearest."""
    books = _first_books(whole)
    for _ in range(rounds if books.size else 0):
        books = _moved(whole, books)
    return books


def vector_codes(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Left out are vectors that are null, hold a null or non-finite component, are not
    as long as that of the smallest vec_id or can't be cut into four equal parts, and
    those so large that squared distances would be no longs (131,072 and beyond at 64
    components). Vectors without a vec_id are coded and come last among the first
    entries; rows that share a vec_id are coded each for itself, the smaller vector
    first. With fewer vectors than entries the codebooks are shorter; with none the
    result is empty. Labels are compared by value, nulls together. Other columns are
    not read. The codebooks, 4 x 256 entries, are all that the driver holds; vectors
    are read six times from a stored table and only sums are shuffled.
    """
    whole = whole_vectors(rows, vector)
    books = train_codebooks(whole)
    if not books.size:
        coded = whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = kept(_coded(whole, books))
    label = F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label"), F.col("label").isNull().alias("_none")
    marked = coded.select("vec_id", "code", "error", *label)
    errors = marked.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"))
    return lookup_join(marked, errors, ["_label", "_none"], "left", ["vec_id"]).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
