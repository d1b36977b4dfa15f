"""Approximate nearest neighbours by a forest of random-projection trees.

Every row is indexed in one cell of each tree. The trees are fitted on a bounded sample; cells that then hold more than
MOST rows get a tree of their own, fitted on a sample of the cell, until none does, so cells do not grow with the table;
the number that a query must visit for the same recall does, by less than the table. A query takes cells of all trees from one
priority queue, by the largest margin on the way, and the rows in them are reranked exactly, by sums in the order of the
components. The first cells of a query give the score that a row of its other cells must reach to be among the nearest, and
only such rows leave these. How many cells it takes is set by queries whose true neighbours are found by comparing them
with all rows. Nearness is the largest inner product: rows get one more component
that makes all norms equal, so that it is an angle. Equal vectors are indexed once with their smallest ids, as no query
can return more of them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import read, small, stage

#: Vectors that the trees of a dimension, or the tree of a cell, are fitted on, at most; queries that set the number of cells to visit.
SAMPLE, TRIALS = 20_000, 200
#: Trees; wanted rows in a cell, about, and at most; sample vectors in a leaf, at least; wanted recall; neighbours of a query.
TREES, LEAF, MOST, LEAST, RECALL, NEAREST = 10, 512, 2_048, 64, 0.96, 20
#: Dimensions that get a forest; the others begin with one cell each.
FORESTS = 16
#: Rows or queries of one cell that one task compares, about.
BLOCK = 8_000
#: Nearest cells of a query that set the least score for the rows of its other cells.
FIRST = 10
_P = np.uint64(0x9E3779B97F4A7C15)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


class Forest:
    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 11) -> None:
        """points: augmented vectors."""
        self.rng, self.leaf = np.random.default_rng(seed), leaf
        self.normals, self.offsets, self.children, self.roots, self.leaves = [], [], [], [], 0
        for _ in range(trees):
            self.roots.append(self._grow(points, np.arange(len(points))))
        self.normals = np.array(self.normals).reshape(-1, points.shape[1])
        self.offsets, self.children = np.array(self.offsets), np.array(self.children, int).reshape(-1, 2)

    def _grow(self, points: np.ndarray, own: np.ndarray) -> int:
        """Index of the new node, or -1 - leaf."""
        for _ in range(4 if len(own) > self.leaf else 0):
            a, b = points[self.rng.choice(own, 2, replace=False)]
            normal = a - b
            along = points[own] @ normal
            middle = float(np.median(along))
            left, right = own[along <= middle], own[along > middle]
            if len(left) and len(right):
                scale = max(float(np.linalg.norm(normal)), 1e-12)
                node = len(self.normals)
                self.normals.append(normal / scale)
                self.offsets.append(middle / scale)
                self.children.append((0, 0))
                self.children[node] = (self._grow(points, left), self._grow(points, right))
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), int)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                along = np.einsum("ij,ij->i", points[inner], self.normals[node]) - self.offsets[node]
                at[inner] = self.children[node, (along > 0).astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, queries: np.ndarray, visits: int, before: np.ndarray | None = None) -> list[list[tuple[int, float]]]:
        """(leaf, margin) for each query, nearest first: one queue of all trees, by the largest margin on the way to a
        node, which is before at the roots."""
        margins = queries @ self.normals.T - self.offsets
        found = []
        for q, margin in enumerate(margins):
            queue, got = [(-np.inf if before is None else float(before[q]), root) for root in self.roots], []
            heapq.heapify(queue)
            while queue and len(got) < visits:
                far, node = heapq.heappop(queue)
                if node < 0:
                    got.append((-1 - node, far))
                    continue
                m = float(margin[node])
                left, right = (int(x) for x in self.children[node])
                heapq.heappush(queue, (max(far, m), left))
                heapq.heappush(queue, (max(far, -m), right))
            found.append(got)
        return found


def _cells(parent: int, leaves: np.ndarray) -> np.ndarray:
    """Names of a cell's own cells."""
    h = (np.uint64(parent & (2**64 - 1)) ^ (leaves.astype(np.uint64) + np.uint64(1))) * _P
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _augmented(vectors: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """vectors with the component that lifts each to the largest norm (its square is most)."""
    return np.column_stack([vectors, np.sqrt(np.maximum(most - (vectors**2).sum(1), 0))])


def _asked(vectors: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """Query vectors on the sphere of the augmented rows."""
    return np.column_stack([vectors * (np.sqrt(most) / np.sqrt((vectors**2).sum(1)))[:, None], np.zeros(len(vectors))])


def valid(table: DataFrame) -> DataFrame:
    """row (of its own for each row), vec_id, dim, embedding: without null ids and vectors that are null, zero or hold
    null or non-finite components."""
    single = dict(table.dtypes)["embedding"] == "array<float>"
    wide = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    rows = table.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    return sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("dim"), "embedding")


def _top_exact(asked: np.ndarray, least: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors of at least its least score, by sums of products in the order
    of the components; ties go to the lesser place in order. The matrix product only leaves out what is too far by more
    than its rounding."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    longest = np.sqrt((vectors**2).sum(1).max())
    for a in range(0, len(asked), 256):
        own = asked[a : a + 256]
        near, take = own @ vectors.T, min(k, len(vectors))
        slack = 8 * (own.shape[1] + 2) * np.finfo(float).eps * np.sqrt((own**2).sum(1)) * longest
        limit = np.maximum(np.partition(near, len(vectors) - take, axis=1)[:, len(vectors) - take], least[a : a + 256]) - slack
        q, v = np.nonzero(near >= limit[:, None])
        score = np.zeros(len(q))
        for j in range(own.shape[1]):
            score += own[q, j] * vectors[v, j]
        best = np.lexsort((order[v], -score, q))
        q, v, score = q[best], v[best], score[best]
        kept = (np.arange(len(q)) - np.searchsorted(q, q) < take) & (score >= least[q + a])
        out.append((q[kept] + a, v[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _compare(queries: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """query, rep, first, score: the k nearest members of each query, without those below its least score."""
    q = v = np.zeros(0, int)
    score = np.zeros(0)
    if queries.num_rows and members.num_rows:
        order = np.empty(members.num_rows, int)
        order[np.lexsort((members["rep"].to_numpy(), members["first"].to_numpy()))] = np.arange(members.num_rows)
        q, v, score = _top_exact(_matrix(queries["embedding"]), queries["least"].to_numpy(), _matrix(members["embedding"]), order, k)
    at = pa.array(v)
    return pa.table({"query": queries["query"].take(pa.array(q)), "rep": members["rep"].take(at), "first": members["first"].take(at), "score": pa.array(score, pa.float64())})


class Index:
    """members: dim, cell, rep. forests: those of the first level; levels: tables of the trees of cells (dim, cell, tree)."""

    def __init__(self, distinct: DataFrame, trees: int) -> None:
        self.spark, self.distinct, self.levels = distinct.sparkSession, distinct, []
        facts = distinct.groupBy("dim").agg(F.count("*").alias("n"), F.first("most").alias("most")).where(F.col("n") > LEAF)
        facts = facts.orderBy(F.desc("n"), "dim").limit(FORESTS).collect()
        forests = {}
        for r in facts:
            points = _augmented(_matrix(_sample(distinct.where(F.col("dim") == r["dim"]), r["n"], SAMPLE // len(facts)).select("embedding").toArrow()["embedding"]), r["most"])
            forests[r["dim"]] = Forest(points, trees, max(LEAST, LEAF * len(points) // r["n"]))
        self.forests = self.spark.sparkContext.broadcast(forests)
        shared = self.forests

        def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dim, own in _by_dim(b):
                    forest = shared.value.get(dim)
                    leaf = forest.route(_augmented(_matrix(own["embedding"]), own["most"].to_numpy())) if forest else np.zeros((own.num_rows, 1), int)
                    which = pa.array(np.repeat(np.arange(own.num_rows), leaf.shape[1]))
                    yield pa.RecordBatch.from_arrays([own["dim"].take(which), pa.array(_cells(dim, leaf.ravel())), own["rep"].take(which)], ["dim", "cell", "rep"])

        self.members = stage(distinct.select("dim", "most", "rep", "embedding").mapInArrow(index, "dim int, cell long, rep long"), "ann-cells")
        while self._refine():
            pass

    def _refine(self) -> bool:
        """Trees for the cells of more than MOST rows, if any are left that can be split."""
        counts = self.members.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        large = stage(counts.where(F.col("n") > MOST), "ann-large")
        if large.limit(1).count() == 0:
            return False
        vectors = self.distinct.select("rep", "most", "embedding")
        inside = self.members.join(small(large), ["dim", "cell"])
        share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
        spot = F.pmod(F.xxhash64("rep", "cell"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = inside.where(spot < share).join(vectors, "rep")

        def fit(own: pa.Table) -> pa.Table:
            points = _augmented(_matrix(own["embedding"]), own["most"].to_numpy())
            tree = Forest(points, 1, max(LEAST, LEAF * len(points) // own["n"][0].as_py()), seed=own["cell"][0].as_py() % 2**32)
            return pa.table({"dim": own["dim"][:1], "cell": own["cell"][:1], "leaves": pa.array([tree.leaves], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        trees = drawn.select("dim", "cell", "n", "most", "embedding").groupBy("dim", "cell").applyInArrow(fit, "dim int, cell long, leaves int, tree binary")
        trees = stage(trees.where("leaves > 1"), "ann-trees")
        if trees.limit(1).count() == 0:
            return False
        self.levels.append(trees)
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
        cut = stage(trees.select("dim", "cell").join(large, ["dim", "cell"]).select("dim", "cell", parts.alias("parts")), "ann-parts")
        rows = self.members.join(small(cut), ["dim", "cell"]).join(vectors, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        of_parts = trees.join(small(cut), ["dim", "cell"]).select("dim", "cell", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def route(own: pa.Table, tree: pa.Table) -> pa.Table:
            leaf = pickle.loads(tree["tree"][0].as_py()).route(_augmented(_matrix(own["embedding"]), own["most"].to_numpy()))[:, 0] if own.num_rows else np.zeros(0, int)
            return pa.table({"dim": own["dim"], "cell": pa.array(_cells(tree["cell"][0].as_py(), leaf)), "rep": own["rep"]})

        keys = ["dim", "cell", "part"]
        moved = rows.select(*keys, "rep", "most", "embedding").groupBy(*keys).cogroup(of_parts.groupBy(*keys)).applyInArrow(lambda a, b: route(a, b), "dim int, cell long, rep long")
        rest = self.members.join(small(cut.select("dim", "cell")), ["dim", "cell"], "left_anti")
        self.members = stage(rest.select("dim", "cell", "rep").unionByName(moved), "ann-cells")
        return True

    def search(self, queries: DataFrame, visits: int) -> DataFrame:
        """query, dim, cell, place: the visits cells of each query that are nearest by margin; place counts from 1.

        queries: query, dim, most, embedding.
        """
        shared = self.forests

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dim, own in _by_dim(b):
                    forest = shared.value.get(dim)
                    yield _found(own, dim, forest.search(_asked(_matrix(own["embedding"]), own["most"].to_numpy()), visits) if forest else [[(0, -np.inf)]] * own.num_rows)

        schema = "query long, dim int, cell long, margin double"
        found = queries.mapInArrow(ask, schema)
        for trees in self.levels:
            found = stage(found, "ann-found")
            parts = stage(found.join(small(trees.select("dim", "cell")), ["dim", "cell"], "left_semi").groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "ann-parts")
            down = found.join(small(parts), ["dim", "cell"]).join(queries.select("query", "most", "embedding"), "query").withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int"))
            of_parts = trees.join(small(parts), ["dim", "cell"]).select("dim", "cell", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

            def deeper(own: pa.Table, tree: pa.Table) -> pa.Table:
                of = pickle.loads(tree["tree"][0].as_py())
                got = of.search(_asked(_matrix(own["embedding"]), own["most"].to_numpy()), visits, own["margin"].to_numpy()) if own.num_rows else []
                return pa.Table.from_batches([_found(own, tree["cell"][0].as_py(), got)])

            keys = ["dim", "cell", "part"]
            below = down.select(*keys, "query", "margin", "most", "embedding").groupBy(*keys).cogroup(of_parts.groupBy(*keys)).applyInArrow(lambda a, b: deeper(a, b), schema)
            found = found.join(small(parts.select("dim", "cell")), ["dim", "cell"], "left_anti").select("query", "dim", "cell", "margin").unionByName(below)
        place = F.row_number().over(Window.partitionBy("query").orderBy("margin", "cell"))
        return found.withColumn("place", place).where(F.col("place") <= visits).select("query", "dim", "cell", "place")


def _found(own, parent: int, got: list[list[tuple[int, float]]]) -> pa.RecordBatch:
    which = pa.array(np.repeat(np.arange(own.num_rows), [len(x) for x in got]).astype(int))
    flat = [x for some in got for x in some]
    take = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    cells = _cells(parent, np.array([x[0] for x in flat], int))
    columns = [take(own["query"].take(which)), take(own["dim"].take(which)), pa.array(cells), pa.array([x[1] for x in flat], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["query", "dim", "cell", "margin"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About most of the n rows, at most, chosen by a hash of rep."""
    spot = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    return rows.where(spot < int(min(1.0, most / n) * (1 << 30))).orderBy(spot).limit(most)


def _truth(distinct: DataFrame, trials: DataFrame, k: int) -> DataFrame:
    """query, rep: the k nearest others of each trial query, by comparing TRIALS queries at most with all rows."""
    asked = trials.toArrow()
    shared = distinct.sparkSession.sparkContext.broadcast({d: (own["query"].to_numpy(), _matrix(own["embedding"])) for b in asked.to_batches() for d, own in _by_dim(b)} if asked.num_rows else {})

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, own in _by_dim(b):
                if dim in shared.value:
                    ids, queries = shared.value[dim]
                    vectors, reps = _matrix(own["embedding"]), own["rep"].to_numpy()
                    scores = queries @ vectors.T
                    best = np.argsort(-scores, axis=1)[:, : k + 1]  # one of them may be the query itself
                    q = np.repeat(np.arange(len(ids)), best.shape[1])
                    other = (vectors[best.ravel()] != queries[q]).any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][other]), pa.array(reps[best.ravel()][other]), pa.array(scores[q, best.ravel()][other])], ["query", "rep", "score"])

    near = distinct.select("dim", "rep", "embedding").mapInArrow(nearest, "query long, rep long, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return near.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "rep")


def calibrated(index: Index, queries: DataFrame, k: int, wanted: float = RECALL) -> tuple[int, float]:
    """The fewest visits with which the trial queries find the wanted share of their true neighbours, and that share."""
    trials = stage(queries.orderBy(F.xxhash64("query")).limit(TRIALS), "ann-trials")
    truth = stage(_truth(index.distinct, trials, k), "ann-truth")
    homes = stage(index.members.join(small(truth), "rep").select("query", "rep", "dim", "cell"), "ann-homes")
    pairs, visits = truth.count(), 8 * TREES
    while pairs:
        found = index.search(trials, visits)
        needed = homes.join(found, ["query", "dim", "cell"]).groupBy("query", "rep").agg(F.min("place").alias("place"))
        places = np.sort([r["place"] for r in needed.select("place").collect()])  # TRIALS * k rows at most
        enough = int(np.ceil(wanted * pairs))
        if len(places) >= enough:
            return int(places[enough - 1]), float((places <= places[enough - 1]).sum() / pairs)
        visits *= 4  # every cell is reached in the end
    return 1, 1.0


def _compared(index: Index, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, rep, first, score: the k + 1 nearest rows of each asked cell (query, dim, cell, least) that have the least score."""
    # a cell with many rows or queries is compared in blocks of both
    blocks = lambda t, name: t.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    cut = stage(blocks(index.members, "rbs").join(blocks(asked, "qbs"), ["dim", "cell"], "full").na.fill(1), "ann-blocks")
    deal = lambda t, own, mine, other, n_mine, n_other: (
        t.join(small(cut), ["dim", "cell"], "left").na.fill(1, ["rbs", "qbs"])
        .withColumn(mine, F.pmod(F.xxhash64(own), n_mine).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
    )
    members = index.members.join(small(asked.select("dim", "cell").distinct()), ["dim", "cell"], "left_semi")
    members = deal(members, "rep", "rb", "qb", "rbs", "qbs").join(index.distinct.select("rep", "first", "embedding"), "rep")
    askers = deal(asked, "query", "qb", "rb", "qbs", "rbs").join(queries.select("query", "embedding"), "query")
    keys = ["dim", "cell", "rb", "qb"]
    return askers.select(*keys, "query", "least", "embedding").groupBy(*keys).cogroup(members.select(*keys, "rep", "first", "embedding").groupBy(*keys)).applyInArrow(
        lambda q, m: _compare(q, m, k + 1), "query long, rep long, first long, score double"
    )


def _nearest(near: DataFrame, k: int) -> DataFrame:
    """query, rep, first, score: the k + 1 nearest rows of each query."""
    once = near.groupBy("query", "rep", "first").agg(F.max("score").alias("score"))  # all its scores are the same
    by_rep = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first", "rep"))
    return once.withColumn("r", by_rep).where(F.col("r") <= k + 1).drop("r")


def neighbours(table: DataFrame, is_query: Column, k: int = NEAREST, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row (is_query: a condition on vec_id).

    table: vec_id, embedding; other columns are not looked at. Rows with a null id and vectors that are null, zero or hold
    null or non-finite components take no part. A vector is compared with those of its own dimension. All other rows are
    candidates, also of the query's own id: of a repeated id every row counts, and each of its rows as a query has its
    list. If there are fewer than k candidates all are returned; ties go to the smaller vec_id; an empty table gives no
    rows. Long vectors have no bound but a task's memory for BLOCK of them.
    """
    rows = stage(valid(table), "ann-rows")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = stage(rows.groupBy("dim").agg(F.max(norm).alias("most")), "ann-norms")
    # equal vectors: the k + 1 smallest ids are enough for any query; the limit is applied before the exchange too
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id", "row"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    held = kept.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    named = held.select("embedding", "ids", F.size("embedding").alias("dim"), F.col("ids")[0]["vec_id"].alias("first"), F.col("ids")[0]["row"].alias("rep"))
    distinct = stage(named.join(small(most), "dim"), "ann-distinct")
    queries = stage(rows.where(is_query).join(small(most), "dim").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "dim", "most", "embedding"), "ann-queries")
    index = Index(distinct, trees)
    visits, _ = calibrated(index, queries.drop("query_id"), k)
    asked = stage(index.search(queries.drop("query_id"), visits), "ann-asked")
    everything = F.lit(float("-inf"))
    best = _nearest(_compared(index, asked.where(F.col("place") <= FIRST).withColumn("least", everything), queries, k), k)
    if visits > FIRST:
        best = stage(best, "ann-best")
        nth = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") > k)
        least = stage(nth.select("query", "least"), "ann-least")
        others = asked.where(F.col("place") > FIRST).join(small(least), "query", "left").withColumn("least", F.coalesce("least", everything))
        best = _nearest(best.unionByName(_compared(index, others, queries, k)), k)
    spread = best.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("id")).where("id.row != query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id.vec_id", "id.row"))
    ranked = spread.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return ranked.join(small(queries.select("query", "query_id")), "query").select("query_id", "rank", F.col("id.vec_id").alias("vec_id"), "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
