"""Approximate nearest neighbours by a forest of random-projection trees.

The first levels of the trees are grown on a bounded sample and go to every task. Leaves that
the whole table fills beyond their size are split further where their vectors are, round by
round, so that a leaf holds about as many vectors at any size of the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vectorloom.llm.common import arrow_stage, table
from vectorloom.session import materialize

NEIGHBOURS = 20
SAMPLE = 65_536  # vectors that the forest is grown on, at most; every vector is indexed
TREES = 12
LEAF = 256  # sampled vectors in a leaf, at most
LEAVES = 220  # leaves that a query visits in all trees together; more, by the square root, beyond SAMPLE
SPLIT = 4096  # vectors of an overfull leaf that its split is grown on, about
WAYS = 256  # leaves that an overfull leaf is split into at once, about
_BITS = 12  # of a leaf's number for its place in the leaf that it was split from
BLOCK = 2048  # vectors, and queries, of a leaf that meet in one piece
_FANCY = 192  # points that a split is fitted on
_HELD = 400_000  # pairs that a task holds at most


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: a node's normal, offset and children; a negative child
    ``-1 - leaf`` is a leaf. ``roots`` has a node or leaf per tree. ``ceiling`` is the
    largest squared norm; shorter vectors get a coordinate that makes up for it, so that the
    nearest by angle are those of the largest inner product."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: tuple[int, ...]
    leaves: int
    ceiling: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.ceiling - np.square(vectors).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def leaf_of(self, lifted: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of every vector in one tree."""
        node = np.full(len(lifted), self.roots[tree])
        active = np.flatnonzero(node >= 0)
        while len(active):
            at = node[active]
            side = np.einsum("ij,ij->i", lifted[active], self.normals[at]) > self.offsets[at]
            node[active] = self.children[at, side.astype(int)]
            active = active[node[active] >= 0]
        return -1 - node


def grow_forest(
    sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5, ceiling: float | None = None
) -> Forest:
    """Grow trees on sampled vectors. A split is the plane between two centres of a few
    rounds of 2-means from random points; where that leaves a side nearly empty, it goes
    through the median of a random projection."""
    if ceiling is None:
        ceiling = float(np.square(sample).sum(axis=1).max()) if len(sample) else 0.0
    forest = Forest(np.empty((0, 0)), np.empty(0), np.empty((0, 2), int), (), 0, ceiling)
    points = forest.lifted(sample)
    random = np.random.default_rng(seed)
    normals, offsets, children, leaves = [], [], [], 0

    def split(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        near = points[rows if len(rows) <= _FANCY else random.choice(rows, _FANCY, replace=False)]
        a, b = near[random.choice(len(near), 2, replace=False)]
        for _ in range(4):
            side = near @ (a - b) > (a - b) @ (a + b) / 2
            if side.all() or not side.any():
                break
            a, b = near[side].mean(axis=0), near[~side].mean(axis=0)
        normal, offset = a - b, (a - b) @ (a + b) / 2
        above = points[rows] @ normal > offset
        if not 0.1 < above.mean() < 0.9:
            normal = random.normal(size=points.shape[1])
            values = points[rows] @ normal
            offset = float(np.median(values))
            above = values > offset
        return normal, offset, above

    roots = []
    for _ in range(trees):
        todo: list[tuple[np.ndarray, tuple[int, int] | None]] = [(np.arange(len(points)), None)]
        while todo:
            rows, place = todo.pop()
            number = None
            if len(rows) > leaf:
                normal, offset, above = split(rows)
                if above.any() and not above.all():
                    number = len(normals)
                    length = np.linalg.norm(normal)
                    normals.append(normal / length)
                    offsets.append(offset / length)
                    children.append([0, 0])
                    todo += [(rows[~above], (number, 0)), (rows[above], (number, 1))]
            if number is None:
                number = -1 - leaves
                leaves += 1
            if place is None:
                roots.append(number)
            else:
                children[place[0]][place[1]] = number
    width = points.shape[1]
    return Forest(
        np.array(normals).reshape(-1, width), np.array(offsets), np.array(children, int).reshape(-1, 2), tuple(roots), leaves, ceiling
    )


def visited_leaves(forest: Forest, queries: np.ndarray, sizes: np.ndarray, leaves: int, least: int) -> list[list[tuple[int, float]]]:
    """For each query the leaves that one priority queue over all trees reaches first, with
    their priorities.

    The priority of a node is the sum of the squared distances to the planes that the query
    would have to cross to get there. The search goes on until ``leaves`` leaves are seen and, so that no query
    is left short, those of some tree hold ``least`` vectors.
    """
    result = []
    tops = [(0.0, k, root) for k, root in enumerate(forest.roots)]
    for begin in range(0, len(queries), 64):
        block = np.column_stack([queries[begin : begin + 64], np.zeros(len(queries[begin : begin + 64]))])
        margins = block @ forest.normals.T - forest.offsets if len(forest.normals) else np.empty((len(block), 0))
        for margin in margins:
            queue, found = list(tops), []
            held = [0] * len(forest.roots)
            enough = False
            while queue and not (len(found) >= leaves and enough):
                bound, tree, node = heapq.heappop(queue)
                while node >= 0:
                    m = margin[node]
                    near, far = (1, 0) if m > 0 else (0, 1)
                    heapq.heappush(queue, (bound + m * m, tree, int(forest.children[node, far])))
                    node = int(forest.children[node, near])
                found.append((-1 - node, bound))
                held[tree] += sizes[-1 - node]
                enough = enough or held[tree] >= least
            result.append(found)
    return result


def leaf_bounds(tree: Forest, queries: np.ndarray) -> np.ndarray:
    """The priority of every leaf of one tree (columns) for each query."""
    result = np.zeros((len(queries), tree.leaves))
    if not len(tree.normals):
        return result
    margins = np.column_stack([queries, np.zeros(len(queries))]) @ tree.normals.T - tree.offsets
    reached = np.zeros_like(margins)
    for node, children in enumerate(tree.children):  # a node stands before its children
        crossed = np.square(margins[:, node])
        for child, far in zip(children, (margins[:, node] > 0, margins[:, node] <= 0)):
            bound = reached[:, node] + np.where(far, crossed, 0.0)
            if child < 0:
                result[:, -1 - child] = bound
            else:
                reached[:, child] = bound
    return result


# --- Arrow stages ---------------------------------------------------------------------


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype(np.float32).ravel()))


def _assign(forest):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lifted = forest.value.lifted(_matrix(part.column(2)))
                for tree in range(len(forest.value.roots)):
                    leaf = forest.value.leaf_of(lifted, tree)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf.astype(np.int64)), *part.columns], names=["leaf", "class", "least", "vector"]
                    )

    return run


def _visit(forest, sizes, leaves: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = visited_leaves(forest.value, _matrix(part.column(1)), sizes.value, leaves, least)
                rows = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                flat = [x for f in found for x in f]
                columns = [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.float64())]
                chosen = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*columns, *chosen.columns], names=["leaf", "bound", "class", "vector"])

    return run


_TREE = "leaf long, normals binary, offsets binary, children binary, root int, leaves int"
_ROW = "leaf long, asks int, bound double, class long, least long, vector array<float>"


def _split(ceiling: float, leaf: int, ways: int):
    """The tree that splits the overfull leaf whose sampled vectors are given."""

    def run(key, rows):
        points = np.array(rows["vector"].tolist(), np.float64)
        share = max(leaf / rows["count"].iloc[0], 1 / ways)
        tree = grow_forest(points, 1, max(int(len(points) * share), 1), abs(int(key[0])) % 65_537, ceiling)
        fields = [key[0], tree.normals.tobytes(), tree.offsets.tobytes(), tree.children.astype(np.int64).tobytes()]
        return pd.DataFrame([[*fields, tree.roots[0], tree.leaves]], columns=[f.split()[0] for f in _TREE.split(", ")])

    return run


def _descend(ceiling: float, per: int):
    """Rows sorted by leaf, the tree that splits it first, to rows in the leaves it is split
    into: a vector goes to one, a query to the ``per`` nearest. Without a tree rows stay."""

    def read(row: dict) -> Forest:
        offsets = np.frombuffer(row["offsets"])
        normals = np.frombuffer(row["normals"]).reshape(len(offsets), -1)
        children = np.frombuffer(row["children"], np.int64).reshape(-1, 2)
        return Forest(normals, offsets, children, (row["root"],), row["leaves"], ceiling)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "asks")])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if keys[a, 0] != cell:
                    cell, tree = keys[a, 0], None
                if keys[a, 1] < 0:
                    tree = read(part.slice(0, 1).to_pylist()[0])
                    continue
                for at in range(0, part.num_rows, 1024):
                    piece = part.slice(at, 1024)
                    bound = piece.column("bound").to_numpy(zero_copy_only=False)
                    rows, place = np.arange(piece.num_rows), np.zeros(piece.num_rows, np.int64)
                    if tree is not None and keys[a, 1] == 0:
                        place = tree.leaf_of(tree.lifted(_matrix(piece.column("vector"))), 0) + 1
                    elif tree is not None:
                        bounds = leaf_bounds(tree, _matrix(piece.column("vector")))
                        near = np.argsort(bounds, axis=1, kind="stable")[:, :per]
                        rows, place = np.repeat(rows, near.shape[1]), near.ravel() + 1
                        bound = bound[rows] + np.take_along_axis(bounds, near, 1).ravel()
                    taken = piece.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((cell << _BITS) + place), taken.column("asks"), pa.array(bound),
                         taken.column("class"), taken.column("least"), taken.column("vector")],
                        names=[f.split()[0] for f in _ROW.split(", ")],
                    )

    return run


def nearest_of(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the queries, rows of their ``k`` nearest vectors (ties to the smaller
    ``least``) and the inner products, each summed the same way wherever the rows stand."""
    rough = queries @ vectors.T
    if rough.shape[1] > k:
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k]
        q, v = np.nonzero(rough >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
    else:
        q, v = np.nonzero(np.ones(rough.shape, bool))
    exact = (queries[q] * vectors[v]).sum(axis=1)
    order = np.lexsort((least[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    kept = rank < k
    return q[kept], v[kept], exact[kept]


def _search(k: int):
    """Rows sorted by cell, vectors before queries, to the nearest of each query in the cells
    of a task. What a task has found is cut to the nearest now and then."""

    def shortened(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        query, class_, least, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((class_, least, -score, query))
        query, class_, least, score = query[order], class_[order], least[order], score[order]
        once = np.r_[True, (query[1:] != query[:-1]) | (class_[1:] != class_[:-1])]
        query, class_, least, score = query[once], class_[once], least[once], score[once]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        kept = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < k
        return [(query[kept], class_[kept], least[kept], score[kept])]

    def batch_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [pa.array(c) for c in found[0]]
        return pa.RecordBatch.from_arrays(columns, names=["query", "class", "least", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, ...]] = []
        cell = None
        held: list[pa.RecordBatch] = []
        index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                own, is_query = tuple(keys[a, :3].tolist()), bool(keys[a, 3])
                part = batch.slice(a, b - a)
                if own != cell:
                    cell, held, index = own, [], None
                if not is_query:
                    held.append(part)
                    continue
                if index is None and held:
                    every = pa.Table.from_batches(held).combine_chunks()
                    index = tuple(
                        every.column(n).to_numpy() for n in ("class", "least")
                    ) + (_matrix(every.column("vector").combine_chunks()),)
                if index is None:
                    continue
                classes = part.column(4).to_numpy(zero_copy_only=False)
                q, v, score = nearest_of(_matrix(part.column(6)), index[2], index[1], k)
                best.append((classes[q], index[0][v], index[1][v], score))
                if sum(len(b[0]) for b in best) > _HELD:
                    best = shortened(best)
                    if len(best[0][0]) > _HELD // 2:
                        yield batch_of(best)
                        best = []
        if best:
            yield batch_of(shortened(best))

    return run


# --- on tables ------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _split_overfull(index: DataFrame, visits: DataFrame, ceiling: float, leaf: int, leaves: int, per: int, split: int, ways: int):
    """Index and visits after the leaves of more than ``2 * leaf`` vectors are split, round by
    round until there are none. A query keeps the ``leaves`` leaves of the least priority, of
    all trees together. Leaves that cannot be split stay as they are."""
    for turn in range((63 - 20) // _BITS):
        counts = index.groupBy("leaf").count().filter(F.col("count") > 2 * leaf)
        full = materialize(counts, "full")
        if full.isEmpty():
            break
        share = F.xxhash64("class", F.lit(turn + 2)).bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24)
        drawn = index.join(full, "leaf").filter(share * F.col("count") < split).select("leaf", "count", "vector")
        trees = materialize(drawn.groupBy("leaf").applyInPandas(_split(ceiling, leaf, ways), _TREE).filter("leaves > 1"), "splits")
        if trees.isEmpty():
            break
        # the rows of a leaf are dealt to as many tasks as it is large, each of which gets its tree
        dealt = full.select("leaf", F.ceil(F.col("count") / 65_536).cast("int").alias("shares"))
        names = [f.split()[0] for f in _ROW.split(", ")]
        fields = [f for f in _TREE.split(", ") if not f.startswith("leaf ")]
        blank = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields]
        both = index.withColumns({"asks": F.lit(0), "bound": F.lit(0.0)}).select(*names).unionByName(
            visits.withColumns({"asks": F.lit(1), "least": F.lit(0).cast("long")}).select(*names)
        )
        both = both.join(dealt, "leaf", "left").withColumn("share", F.pmod(F.xxhash64("class"), F.coalesce("shares", F.lit(1))).cast("int"))
        first = trees.join(dealt, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        empty = {"bound": F.lit(0.0), "class": F.lit(0).cast("long"), "least": F.lit(0).cast("long")}
        first = first.withColumns({"asks": F.lit(-1), **empty, "vector": F.lit(None).cast("array<float>")})
        columns = ["share", *names, *(f.split()[0] for f in fields)]
        rows = first.select(*columns).unionByName(both.select("share", *names, *blank).select(*columns))
        rows = rows.repartition("leaf", "share").sortWithinPartitions("leaf", "share", "asks")
        rows = materialize(arrow_stage(rows, _descend(ceiling, per), _ROW), "descended")
        index = rows.filter("asks = 0").select("leaf", "class", "least", "vector")
        nearest_first = Window.partitionBy("class").orderBy("bound", "leaf")
        kept = rows.filter("asks = 1").select("leaf", "bound", "class", "vector")
        kept = kept.withColumn("place", F.row_number().over(nearest_first)).filter(F.col("place") <= leaves).drop("place")
        visits = materialize(kept, "visits")
    return index, visits


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, *,
    sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES, block: int = BLOCK,
    split: int = SPLIT, ways: int = WAYS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` vectors of the largest inner product
    that the forest finds for each row of ``vectors`` with ``is_query``.

    Every usable row is indexed in every tree; the forest is grown on at most ``sample``
    vectors chosen by a hash, and leaves of more than ``2 * leaf`` vectors are split further.
    A query visits ``leaves`` leaves, and in a table of ``m`` times ``sample`` vectors the square
    root of ``m`` times as many, so the share of the table that it meets falls as that grows. Scores are inner products in double precision, ties go to the
    smaller id, a query's own id is left out. Rows whose vector is null, zero, or holds a null
    or a non-finite component take no part, nor do rows with a null id or of another width
    than most rows. Repeated rows count once. Fewer candidates than ``k`` are all returned;
    none, and an empty table, give no rows.

    Equal vectors are one class with its ``k + 1`` smallest ids, for no other copy can be
    among the nearest; so copies neither meet in a task nor are compared twice. A leaf with
    many vectors or many queries is cut into blocks that are searched apart.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), is_query.alias("asks")
    ).filter(F.col("id").isNotNull() & usable(F.col(vector_col)))
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths.width if widths else 0
    rows = rows.filter(F.size("vector") == width).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    rows = rows.withColumn("class", F.xxhash64("vector"))
    by_id = Window.partitionBy("class").orderBy("id")
    copies = rows.select("class", "id", "vector").distinct()
    copies = copies.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    classes = materialize(
        copies.groupBy("class").agg(
            F.min("id").alias("least"), F.sort_array(F.collect_list("id")).alias("ids"), F.min(F.struct("id", "vector")).alias("first")
        ).select("class", "least", "ids", F.col("first.vector").alias("vector")),
        "classes",
    )
    askers = materialize(rows.filter(F.coalesce("asks", F.lit(False))).select("id", "class").distinct(), "askers")
    grown = classes.orderBy(F.xxhash64("class", F.lit(1)), "class").limit(sample).select("vector").toArrow()["vector"]
    points = _matrix(grown.combine_chunks()) if len(grown) else np.empty((0, width))
    forest = grow_forest(points, trees, leaf)
    sent = spark.sparkContext.broadcast(forest)
    index = materialize(
        arrow_stage(classes.select("class", "least", "vector"), _assign(sent), "leaf long, class long, least long, vector array<float>"),
        "index",
    )
    sizes = np.zeros(max(forest.leaves, 1), np.int64)
    for row in index.groupBy("leaf").count().collect():  # as many rows as the sample has leaves
        sizes[row.leaf] = row["count"]
    asked = classes.join(askers.select("class").distinct(), "class", "left_semi").select("class", "vector")
    visits = materialize(
        arrow_stage(
            asked, _visit(sent, spark.sparkContext.broadcast(sizes), leaves, k + 1), "leaf long, bound double, class long, vector array<float>"
        ),
        "visits",
    )
    if sizes.max() > 2 * leaf:
        growth = max(int(sizes.sum()) / max(len(forest.roots), 1) / max(len(points), 1), 1.0) ** 0.5
        index, visits = _split_overfull(
            index, visits, forest.ceiling, leaf, math.ceil(leaves * growth), math.ceil(4 * growth), split, ways
        )
    # both sides of a leaf that is still full are cut into blocks; the counts have one row per leaf
    leafs = index.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(
        visits.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("sets")), "leaf"
    )
    own = F.pmod(F.col("class"), F.lit(1_000_003)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leafs = materialize(leafs, "leafs")
    left = index.join(leafs, "leaf").select(
        "leaf", (own % F.col("parts")).alias("part"), every("sets").alias("set"), F.lit(0).alias("asks"), "class", "least", "vector"
    )
    right = visits.join(leafs, "leaf").select(
        "leaf", every("parts").alias("part"), (own % F.col("sets")).alias("set"), F.lit(1).alias("asks"), "class",
        F.lit(0).cast("long").alias("least"), "vector",
    )
    cells = left.unionByName(right).repartition("leaf", "part", "set").sortWithinPartitions("leaf", "part", "set", "asks")
    found = arrow_stage(cells, _search(k + 1), "query long, class long, least long, score double").distinct()
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
    ids = found.select("query", "class", "score").join(classes.select("class", "ids"), "class")
    ids = ids.select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    lists = ids.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")
    )
    joined = askers.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(lists, "query")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(others).alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "n.vec_id", "n.score"
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
