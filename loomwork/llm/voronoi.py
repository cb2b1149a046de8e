"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are made integers, floor(256 * x). With M the largest norm, a data vector gets one more component sqrt(M^2 - |x|^2) and
a query a 0: then all data have norm M, and the largest inner product is the smallest distance. Pivots, about the square root of
the rows but at most `MOST_PIVOTS`, part the space. A query q has its (k+1)-th neighbour within theta_q: the (k+1)-th distance to a
pivot, which is a data vector itself, or by the summary of each cell (its data's k+1 smallest distances to the pivot) and the
triangle inequality, whichever is less. A data vector at distance d of its own pivot p can only count for q if d is between
|q p| - theta_q and |q p| + theta_q. For each cell of queries the least and largest of these bounds are kept.

A cell of queries takes only the data that its bounds let through. It joins the group of the nearest cell as long as that
doesn't add more than a quarter to the data which either needs alone (estimated from each cell's quantiles of d) nor goes beyond
`group_queries` queries; a larger cell is cut. So cells whose bounds exclude nothing share one copy of the data, and others have
their own small parts. A group meets its data in blocks of about `block_rows`, and a block is solved by one matrix product. The
blocks' best k are merged by rank. Results are exact, ties go to the smaller vec_id.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; repeated
rows of a vec_id count once (of differing ones the smallest vector stays); shorter vectors are filled with zeros; without
queries or with fewer than k candidates there are fewer rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import checkpointed, column_of, mix

SCALE = 256
#: So the bounds that the driver sees are at most 2 * 512 * 512 numbers.
MOST_PIVOTS = 512
#: Quantiles of each cell's distances by which the data that a group needs are estimated.
QUANTILES = 33


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>): the integer vectors that take part, one for each vec_id."""
    v = F.transform(vector_column, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull()).where(finite)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled with zeros to a common width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _lifted(matrix: np.ndarray, norm2: float, query: bool) -> np.ndarray:
    last = np.zeros(len(matrix)) if query else np.sqrt(np.maximum(norm2 - (matrix * matrix).sum(1), 0))
    return np.column_stack([matrix, last])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k largest scores; ids ascend, so the earlier place wins a tie."""
    n = len(ids)
    if n <= k:
        return np.argsort(-scores, 1, kind="stable")
    if np.abs(scores).max() < 2**40 and n < 2**20:
        keys = scores.astype(np.int64) * 2**20 - np.arange(n)
        top = np.argpartition(-keys, k - 1, 1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(keys, top, 1), 1), 1)
    return np.argsort(-scores, 1, kind="stable")[:, :k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where they are exact."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.T.astype(np.int64)


def voronoi_topk(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, group_queries: int = 4096, block_rows: int = 8192, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates (all rows but the query's own) of every query.

    `is_query` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    usable = checkpointed(_usable(vectors, id_column, vector_column))
    facts = usable.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"), F.count("*").alias("rows")).first()
    width, norm2 = facts["width"] or 0, facts["norm2"] or 0.0
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], schema)
    pivots = pivots or min(MOST_PIVOTS, max(16, int(facts["rows"] ** 0.5)))
    chosen = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    centres = np.unique(_lifted(_matrix(chosen["v"], width), norm2, False), axis=0)
    data, queries, groups = _parted(usable, is_query, centres, width, norm2, k, group_queries, block_rows)
    if data is None:
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame([(g, x["blocks"]) for g, x in enumerate(groups)], "g int, blocks int")
    blocks = spark.sparkContext.broadcast(np.array([x["blocks"] for x in groups]))

    @F.arrow_udf("array<struct<g:int,b:int>>")
    def places(ids: pa.Array, wanted: pa.Array) -> pa.Array:
        of = wanted.values.to_numpy(zero_copy_only=False)[wanted.offsets[0].as_py() : wanted.offsets[-1].as_py()]
        times = wanted.value_lengths().to_numpy(zero_copy_only=False)
        key = mix(np.repeat(ids.to_numpy(zero_copy_only=False).view(np.uint64), times))
        part = (key % blocks.value[of].astype(np.uint64)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(of.astype(np.int32)), pa.array(part)], ["g", "b"]))

    data = data.select(F.explode(places("vec_id", "wanted")).alias("x"), "vec_id", "v").select("x.g", "x.b", "vec_id", "v")
    asked = queries.join(F.broadcast(known), "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        rows = rows.sort_values("vec_id")
        ids, asking = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        matrix = _matrix(pa.array(rows["v"]), width)
        questions = _matrix(pa.array(queries["q"]), width)
        out = []
        for at in range(0, len(asking), 256):
            part = asking[at : at + 256]
            scores = _products(questions[at : at + 256], matrix)
            top = _best(scores, ids, k + 1)
            got = pd.DataFrame({"query_id": np.repeat(part, top.shape[1]), "vec_id": ids[top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel().astype(np.int64)})
            out.append(got[got["query_id"] != got["vec_id"]])
        return pd.concat(out)

    found = asked.groupBy("g", "b").cogroup(data.groupBy("g", "b")).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parted(usable: DataFrame, is_query: Column, centres: np.ndarray, width: int, norm2: float, k: int, group_queries: int, block_rows: int) -> tuple[DataFrame | None, DataFrame | None, list[dict]]:
    """(vec_id, v, wanted: the groups that may need it) of the data, (vec_id, v, g) of the queries, and the groups; None without queries."""
    spark = usable.sparkSession
    shipped = spark.sparkContext.broadcast(centres)
    slack = 1e-6 * (1 + 2 * norm2**0.5)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(column_of(batch, "v"), width)
            columns = [column_of(batch, "vec_id"), column_of(batch, "v")]
            for query in (False, True):
                distances = _distances(_lifted(matrix, norm2, query), shipped.value)
                cell = distances.argmin(1) if len(distances) else np.zeros(0, int)
                columns += [pa.array(cell.astype(np.int32))] + ([] if query else [pa.array(distances[np.arange(len(cell)), cell])])
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cell", "d", "q_cell"])

    placed = checkpointed(usable.mapInArrow(assign, "vec_id long, v array<double>, cell int, d double, q_cell int"))
    placed = placed.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    nearest = placed.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("r")).where(F.col("r") <= k + 1)
    near = {r["cell"]: np.sort(r["d"]) for r in nearest.groupBy("cell").agg(F.collect_list("d").alias("d")).collect()}
    steps = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    spread = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("d", steps).alias("q")).collect()}
    summary = spark.sparkContext.broadcast(near)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each cell of queries: how many, and for each pivot the least and largest distance of data that may count."""
        low, high, n = {}, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            distances = _distances(_lifted(_matrix(column_of(batch, "v"), width), norm2, True), shipped.value)
            upper = np.concatenate([distances[:, [j]] + d for j, d in summary.value.items()], 1)
            few = np.partition(distances, k, 1)[:, k] if distances.shape[1] > k else np.full(len(distances), np.inf)
            theta = np.minimum(np.partition(upper, k, 1)[:, k], few) if upper.shape[1] > k else few
            for cell in np.unique(column_of(batch, "q_cell").to_numpy()).tolist():
                own = column_of(batch, "q_cell").to_numpy() == cell
                a, b = (distances[own] - theta[own, None]).min(0) - slack, (distances[own] + theta[own, None]).max(0) + slack
                low[cell], high[cell] = np.minimum(low.get(cell, a), a), np.maximum(high.get(cell, b), b)
                n[cell] = n.get(cell, 0) + int(own.sum())
        size = len(shipped.value)
        if n:
            columns = [np.repeat(list(n), size), np.tile(np.arange(size), len(n)), np.concatenate([low[c] for c in n]), np.concatenate([high[c] for c in n]), np.repeat(list(n.values()), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["c", "j", "low", "high", "n"])

    found = placed.where("is_query").select("q_cell", "v").mapInArrow(bounds, "c long, j long, low double, high double, n long")
    table = found.groupBy("c", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("c", "j").toPandas()
    if not len(table):
        return None, None, []
    size = len(centres)
    cells = {int(c): (int(n), low, high) for c, n, low, high in zip(table["c"][::size], table["n"][::size], table["low"].to_numpy().reshape(-1, size), table["high"].to_numpy().reshape(-1, size), strict=True)}
    groups, of_cell = _groups(centres, cells, spread, group_queries, block_rows)
    limits = spark.sparkContext.broadcast((np.array([g["low"] for g in groups]), np.array([g["high"] for g in groups])))

    @F.arrow_udf("array<int>")
    def wanted(cell: pa.Array, d: pa.Array) -> pa.Array:
        cell, d = cell.to_numpy(zero_copy_only=False), d.to_numpy(zero_copy_only=False)[None]
        needed = (limits.value[0][:, cell] <= d) & (d <= limits.value[1][:, cell])
        row, group = np.nonzero(needed.T)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(needed.sum(0))]).astype(np.int32)), pa.array(group.astype(np.int32)))

    rows = spark.createDataFrame([(c, g, parts) for c, (g, parts) in of_cell.items()], "q_cell int, first int, parts int")
    queries = placed.where("is_query").join(F.broadcast(rows), "q_cell")
    queries = queries.select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("g"))
    return placed.select("vec_id", "v", wanted("cell", "d").alias("wanted")), queries, groups


def _groups(centres: np.ndarray, cells: dict, spread: dict, group_queries: int, block_rows: int) -> tuple[list[dict], dict[int, tuple[int, int]]]:
    """Groups of near cells of queries with their bounds, data (estimated) and blocks; and (first group, groups) of each cell."""
    n = np.array([spread[j]["n"] if j in spread else 0 for j in range(len(centres))])
    quantiles = np.array([spread[j]["q"] if j in spread else [0.0] * QUANTILES for j in range(len(centres))])

    def needs(low: np.ndarray, high: np.ndarray) -> float:
        """About how many data vectors the bounds let through; one more step of the quantiles, as they lie between two."""
        inside = ((quantiles >= low[:, None]) & (quantiles <= high[:, None])).sum(1)
        beyond = (low <= quantiles[:, -1]) & (high >= quantiles[:, 0])
        return float((n * np.minimum(inside + beyond, QUANTILES) / QUANTILES).sum())

    between = _distances(centres, centres)
    groups, of_cell, rest, last = [], {}, set(cells), None
    while rest:  # walk from cell to nearest cell
        i = min(rest) if last is None else min(rest, key=lambda c: (between[last, c], c))
        rest.remove(i)
        count, low, high = cells[i]
        own, now = needs(low, high), groups[-1] if groups else None
        if now and now["queries"] + count <= group_queries:
            both = np.minimum(now["low"], low), np.maximum(now["high"], high)
            if needs(*both) <= 1.25 * min(own, now["rows"]):
                now.update(low=both[0], high=both[1], rows=needs(*both), queries=now["queries"] + count)
                of_cell[i], last = (len(groups) - 1, 1), i
                continue
        parts = -(-count // group_queries)
        of_cell[i], last = (len(groups), parts), i
        groups += [{"low": low, "high": high, "rows": own, "queries": -(-count // parts)} for _ in range(parts)]
    for g in groups:
        g["blocks"] = max(1, -(-int(g["rows"]) // block_rows))
    return groups, of_cell


#: The same in DuckDB, by brute force.
ORACLE_SQL = """
with e as (select vec_id, min(v) as v from (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0) group by vec_id),
s as (select q.vec_id as query_id, d.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score from e q join e d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
