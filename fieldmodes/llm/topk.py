"""Operator 13, exact top-k search by a Voronoi join.

Score: the inner product of integer vectors.  Pivots cut the space into Voronoi
cells.  One pass sums up every cell: of the data the number of rows and the
``k + 1`` distances closest to the pivot, of the queries the number, the radius
and the longest vector.  From these few rows follow the bounds of each query
cell (pivot p, radius R, longest query M):

    a row x at distance t from its pivot c scores at least  p.c - R|c| - M t
    and at most  min(p.c + R|c| + M t,  p.x + R|x|)  with every query of the cell.

The (k + 1)-th best of the lower bounds is a score that every query of the cell
reaches with k + 1 rows, so a row whose upper bound is below it is never sent
there.  Query cells that lie close are grouped, so that a row is sent once to a
group of up to ``GROUP_QUERIES`` queries; a larger cell is dealt to several
groups.  The rows a group needs are dealt to pieces of about ``PIECE_ROWS``, each
piece is solved by itself and the best of the pieces are merged.  Where vectors
spread evenly in many dimensions the bounds exclude little; then the join is
blocks of queries against all rows, nothing is lost.

Copies: equal vectors are one row with their ``k + 1`` smallest ids (no more can
be among the best), taken per task before the shuffle; equal queries are solved
once, for ``k + 1`` rows, of which each then leaves out its own.

The pivots are means of a sample of ``SAMPLE`` vectors (those with the smallest
hashes), refined on the driver; they decide the work, never the result.

Defined cases: rows with a null id or vector, or a null or non-finite component,
take no part; vectors of unequal length count as filled up with zeros; repeated
rows are rows of their own (a query's copy with its id is a candidate); ties go
to the smaller id; fewer than k other rows give as many; an empty table or none
that is a query gives no rows; scores beyond 64 bits fail; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep

PIVOTS, SAMPLE, ROUNDS = 64, 2048, 5
GROUP_QUERIES = 4096
PIECE_ROWS = 16384
TILE = 1 << 21  # scores at a time
EXACT = 2.0 ** 53


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec array<long>): floor(scale * x) of every component of the rows that take part."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
            .where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .select("id", F.transform("vec", lambda x: F.floor(scale * x).cast("long")).alias("vec")))


def matrix(col: pa.Array, dims: int, dtype) -> np.ndarray:
    """list<long> as rows of ``dims`` numbers, shorter ones filled up with zeros."""
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (size == dims).all():
        return flat.reshape(len(col), dims)
    out = np.zeros((len(col), dims), dtype=dtype)
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Means of the cells of a few Lloyd rounds, started from the first vectors of the sample."""
    p = sample[:pivots].copy()
    for _ in range(ROUNDS):
        cell, _ = nearest(sample, p)
        n = np.bincount(cell, minlength=len(p))
        total = np.zeros_like(p)
        np.add.at(total, cell, sample)
        p = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], p)
    return p


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its pivot) of every row."""
    cell = ((pivots ** 2).sum(axis=1) - 2 * (x @ pivots.T)).argmin(axis=1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def _best(queries: np.ndarray, rows: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the ``k`` best of ``rows`` for each query; a row stands for all its ids."""
    per = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = ids.flatten().to_numpy(), np.cumsum(per) - per
    out = []
    step = max(1, TILE // max(len(rows), 1))
    for lo in range(0, len(queries), step):
        score = queries[lo : lo + step] @ rows.T
        if len(rows) > k:
            q, x = np.nonzero(score >= np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k, None])
        else:
            q, x = (a.reshape(-1) for a in np.indices(score.shape))
        times = per[x]
        s, q = np.repeat(score[q, x], times).astype(np.int64), np.repeat(q, times)
        i = flat[np.repeat(first[x] - np.cumsum(times) + times, times) + np.arange(len(q))]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        out.append((q[place < k] + lo, s[place < k], i[place < k]))
    return tuple(np.concatenate(x) for x in zip(*out))


class Plan:
    """The bounds of the query cells and what follows from them: groups, and their pieces."""

    def __init__(self, pivots: np.ndarray, data: list, queries: list, need: int, group_queries: int, piece_rows: int):
        """``data``: (cell, n, radius, closest distances); ``queries``: (cell, n, radius, longest)."""
        self.pivots = pivots
        self.cell = np.array([q[0] for q in queries])
        n, self.radius, self.longest = (np.array([q[i] for q in queries], dtype=float) for i in (1, 2, 3))
        own = pivots[self.cell]
        cells = np.array([d[0] for d in data])
        mid = own @ pivots[cells].T  # query cell x data cell
        reach = self.radius[:, None] * np.linalg.norm(pivots[cells], axis=1)
        lows = np.concatenate([(mid - reach)[:, i, None] - self.longest[:, None] * np.array(d[3]) for i, d in enumerate(data)], axis=1)
        lows = -np.sort(-lows, axis=1)
        self.floor = lows[:, need - 1] if lows.shape[1] >= need else np.full(len(queries), -np.inf)
        # Groups: the largest cell left and the cells closest to it.
        self.parts = np.maximum(1, -(-n // group_queries)).astype(np.int64)  # groups of a large cell
        self.first = np.zeros(len(queries), dtype=np.int64)
        self.members: list[list[int]] = []
        left = sorted(range(len(queries)), key=lambda i: -n[i])
        while left:
            lead = left.pop(0)
            mine, total = [lead], n[lead]
            if self.parts[lead] == 1:
                for i in sorted(left, key=lambda i: -float(own[lead] @ own[i])):
                    if total + n[i] <= group_queries:
                        mine.append(i)
                        total += n[i]
            left = [i for i in left if i not in mine]
            self.first[mine] = len(self.members)
            self.members += [mine] * int(self.parts[lead])
        size, far = (np.array([d[i] for d in data], dtype=float) for i in (1, 2))
        high = (mid + reach + self.longest[:, None] * far) * (1 + 1e-9)
        rows = [size[(high[m] >= self.floor[m, None]).any(axis=0)].sum() for m in self.members]  # at most
        self.pieces = np.maximum(1, np.ceil(np.array(rows) / piece_rows)).astype(np.int64)

    def groups_of_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) for every group that needs the row."""
        cell, far = nearest(x, self.pivots)
        p, norm = self.pivots[self.cell], np.linalg.norm(x, axis=1)
        by_row = x @ p.T + self.radius * norm[:, None]
        by_cell = (self.pivots[cell] @ p.T + self.radius * np.linalg.norm(self.pivots[cell], axis=1)[:, None] + self.longest * far[:, None])
        slack = 1e-9 * (1.0 + self.longest * norm[:, None])
        wanted = np.minimum(by_row, by_cell) >= self.floor - slack
        return np.nonzero(np.stack([wanted[:, m].any(axis=1) for m in self.members], axis=1))


def top_k(df: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
          pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of highest inner product for every row with ``query``,
    a condition on ``id``.  Components are floor(scale * x)."""
    spark = df.sparkSession
    rows = integer_vectors(df, id_col, vec_col, scale)
    need = k + 1  # one of them may be the query itself
    by_vec = Window.partitionBy("vec").orderBy("id")
    vectors = keep(rows.withColumn("n", F.row_number().over(by_vec)).where(F.col("n") <= need)
                   .groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("hash", F.xxhash64("vec")), "topk-vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims, most = vectors.agg(F.max(F.size("vec")), F.max(square)).first()
    result = "query_id long, rank int, id long, score long"
    if dims is None:
        return spark.createDataFrame([], result)
    if most >= 2.0 ** 62:
        raise ValueError("scores do not fit 64 bits")
    number = np.float64 if most < EXACT else np.int64  # both exact
    asked = keep(rows.where(query).select("vec").distinct().withColumn("qno", F.monotonically_increasing_id()), "topk-queries")
    sample = vectors.orderBy("hash").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    centre = choose_pivots(matrix(sample, dims, np.float64), pivots)

    def data_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = nearest(matrix(b["vec"], dims, np.float64), centre)
            per = pc.list_value_length(b["ids"]).to_numpy().astype(np.int64)
            cells = np.unique(cell)
            close = [np.sort(np.repeat(far[cell == c], per[cell == c]))[:need] for c in cells]
            yield pa.RecordBatch.from_arrays([
                pa.array(cells.astype(np.int64)), pa.array([int((cell == c).sum()) for c in cells], pa.int64()), pa.array([far[cell == c].max() for c in cells], pa.float64()),
                pa.array([x.tolist() for x in close], pa.list_(pa.float64()))], names=["cell", "n", "far", "close"])

    def query_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["vec"], dims, np.float64)
            cell, far = nearest(x, centre)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), pa.array(np.linalg.norm(x, axis=1))], names=["cell", "far", "norm"])

    # Summaries: at most one row per cell.
    data = (vectors.mapInArrow(data_cells, "cell long, n long, far double, close array<double>").groupBy("cell")
            .agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("close"))), 1, need).alias("close")).collect())
    mine = (asked.select("vec").mapInArrow(query_cells, "cell long, far double, norm double").groupBy("cell")
            .agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("longest")).collect())
    if not mine:
        return spark.createDataFrame([], result)
    plan = Plan(centre, sorted(tuple(r) for r in data), sorted(tuple(r) for r in mine), need, group_queries, piece_rows)

    def send_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            row, group = plan.groups_of_rows(matrix(b["vec"], dims, np.float64))
            piece = (b["hash"].to_numpy().view(np.uint64)[row] % plan.pieces[group].astype(np.uint64)).astype(np.int64)
            took = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(piece), took["vec"], took["ids"]], names=["group", "piece", "vec", "ids"])

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(c): i for i, c in enumerate(plan.cell)}
        for b in batches:
            cell, _ = nearest(matrix(b["vec"], dims, np.float64), centre)
            own = np.array([at[c] for c in cell.tolist()], dtype=np.int64)
            group = plan.first[own] + b["qno"].to_numpy() % plan.parts[own]
            times = plan.pieces[group]
            row = np.repeat(np.arange(len(own)), times)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            took = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(group[row]), pa.array(piece), took["vec"], took["qno"]], names=["group", "piece", "vec", "qno"])

    def solve(questions: pa.Table, found: pa.Table) -> pa.Table:
        if not questions.num_rows or not found.num_rows:
            return pa.table({"qno": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        q = matrix(questions["vec"].combine_chunks(), dims, number)
        at, score, ids = _best(q, matrix(found["vec"].combine_chunks(), dims, number), found["ids"].combine_chunks(), need)
        return pa.table({"qno": questions["qno"].to_numpy()[at], "score": score, "id": ids})

    sent = vectors.mapInArrow(send_rows, "group long, piece long, vec array<long>, ids array<long>")
    sent_queries = asked.mapInArrow(send_queries, "group long, piece long, vec array<long>, qno long")
    found = sent_queries.groupBy("group", "piece").cogroup(sent.groupBy("group", "piece")).applyInArrow(solve, "qno long, score long, id long")
    by_query = Window.partitionBy("qno").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= need)
    # best first: sorted by (-score, id)
    best = found.groupBy("qno").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("best"))
    solved = asked.join(best, "qno").select("vec", "best")
    self_score = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
    own = F.array_position("best", F.struct((-self_score).alias("minus"), F.col("id"))).cast("int")
    others = F.when(own > 0, F.concat(F.slice("best", F.lit(1), own - 1), F.slice("best", own + 1, F.lit(need)))).otherwise(F.col("best"))
    return (rows.where(query).join(solved, "vec").select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.minus")).alias("score")))
