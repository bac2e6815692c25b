"""Approximate nearest neighbours by inner product: score-aware quantisation, four-bit scans, exact reranking.

A vector is its direction and the logarithm of its norm, so neither tiny nor huge finite vectors lose digits.
Directions are quantised in pairs of components with 16 centres each. Codes and centres minimise the anisotropic
loss |r|^2 + (eta - 1) (r . x/|x|)^2 of the residual r, which weighs the part of the error along the vector,
since that part moves large inner products most. A query's products with all centres form byte tables; a block of
codes is scanned by table look-ups.

Each code keeps the length of its residual, which bounds its products' errors. So how many rows a query has scored
exactly follows from measured errors: all whose product may reach the k-th best (`sure` standard errors either
side; None takes the proven bound and finds the exact answer). There is no cap. Blocks of rows and of queries meet in
a grid whose cells have a bounded number of bytes; a cell scans its codes for a few queries at a time, scores their
finalists at once and gives on no more than the k best of each, however many finalists there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tesserae.llm.common import dropped, release, skewed_join, written

# The model is fitted on at most this many rows, those whose ids have the smallest hashes.
SAMPLE_ROWS = 8_192
CENTRES, SWEEPS, ROUNDS = 16, 2, 5
THRESHOLD = 0.2  # of a vector's norm: products above it matter
SURE = 1.25
BLOCK_ROWS, BLOCK_QUERIES = 262_144, 16_384
ROWS_BYTES, QUERIES_BYTES = 64 << 20, 16 << 20  # a block's vectors in double precision, whatever their length
LEAST_ROWS, LEAST_QUERIES = 16_384, 1_024  # smaller blocks aren't made for the sake of more tasks
CELLS_AT_ONCE = 1 << 22  # products held at once
SCAN_ROWS = 4_096  # rows whose sums stay in a core's cache
VECTOR_ROWS = 16_384  # vectors encoded or scored at once
GROUP = 64  # rows of which only the best one counts for a bound
SPREAD = 60.0  # between logarithms of norms, up to which products in single precision keep their order
FLOOR, LIFT = -60.0, 1_300.0  # the logarithm of the smallest cosine that is told from zero; lifts all logarithms above zero


@dataclass
class Quantiser:
    """centres: pairs x 16 x 2. eta: weight of the error along the vector."""

    centres: np.ndarray
    eta: float

    @property
    def pairs(self) -> int:
        return len(self.centres)


def _in_pairs(x: np.ndarray) -> np.ndarray:
    """Rows as pairs of components; zeros fill up to a multiple of four components."""
    x = np.asarray(x, np.float64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)


def _assign(x: np.ndarray, unit: np.ndarray, centres: np.ndarray, eta: float, codes: np.ndarray, sweeps: int) -> np.ndarray:
    """Coordinate descent over the pairs, each given the rest."""
    rows = np.arange(len(x))
    chosen = centres[np.arange(len(centres))[None, :], codes]
    along = ((x - chosen) * unit).sum(2)
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(len(centres)):
            off = x[:, m, None, :] - centres[None, m]
            part = (off * unit[:, m, None, :]).sum(2)
            rest = (total - along[:, m])[:, None]
            loss = (off**2).sum(2) + (eta - 1) * (rest + part) ** 2
            codes[:, m] = loss.argmin(1)
            along[:, m] = part[rows, codes[:, m]]
            total = rest[:, 0] + along[:, m]
    return codes


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and the binary logarithms of their lengths. Rows are finite and none is zero."""
    largest = np.abs(x).max(1)
    x = x / largest[:, None]
    length = np.sqrt((x**2).sum(1))
    return x / length[:, None], np.log2(largest) + np.log2(length)


def fit(sample: np.ndarray) -> Quantiser:
    """sample: rows of finite vectors, none zero. Deterministic: centres start at quantiles of the first component."""
    x = _in_pairs(directions(np.asarray(sample, np.float64))[0])
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    unit = x
    order = np.argsort(x[:, :, 0] + 1e-3 * x[:, :, 1], axis=0)
    at = ((np.arange(CENTRES) + 0.5) * len(x) / CENTRES).astype(int)
    centres = np.stack([x[order[at, m], m] for m in range(x.shape[1])])
    codes = np.stack([((x[:, m, None] - centres[None, m]) ** 2).sum(2).argmin(1) for m in range(x.shape[1])], 1)
    for _ in range(ROUNDS):
        codes = _assign(x, unit, centres, eta, codes, 1)
        along = ((x - centres[np.arange(x.shape[1])[None, :], codes]) * unit).sum(2)
        for m in range(x.shape[1]):
            rest = along.sum(1) - along[:, m]
            u, c = unit[:, m], codes[:, m]
            left = np.zeros((CENTRES, 2, 2))
            right = np.zeros((CENTRES, 2))
            np.add.at(left, c, np.eye(2) + (eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(right, c, x[:, m] + (eta - 1) * u * (rest + (x[:, m] * u).sum(1))[:, None])
            used = np.bincount(c, minlength=CENTRES) > 0
            centres[m, used] = np.linalg.solve(left[used] + 1e-9 * np.eye(2), right[used][:, :, None])[:, :, 0]
            along[:, m] = ((x[:, m] - centres[m, c]) * u).sum(1)
    return Quantiser(centres, eta)


def encode(q: Quantiser, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two four-bit codes to a byte (rows x pairs / 2), and the lengths of the residuals. units: rows of length one."""
    x = _in_pairs(units)
    codes = np.stack([((x[:, m, None] - q.centres[None, m]) ** 2).sum(2).argmin(1) for m in range(q.pairs)], 1)
    codes = _assign(x, x, q.centres, q.eta, codes, SWEEPS)
    error = np.sqrt(((x - q.centres[np.arange(q.pairs)[None, :], codes]) ** 2).sum((1, 2)))
    codes = codes.astype(np.uint8)
    return codes[:, 0::2] << 4 | codes[:, 1::2], error


def scan(q: Quantiser, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate products, rows x queries."""
    products = np.einsum("qmd,mkd->mkq", _in_pairs(queries), q.centres).astype(np.float32)
    tables = (products[0::2, :, None] + products[1::2, None, :]).reshape(q.pairs // 2, 256, len(queries))
    out = np.zeros((len(codes), len(queries)), np.float32)
    part = np.empty((min(SCAN_ROWS, len(codes)), len(queries)), np.float32)
    for at in range(0, len(codes), SCAN_ROWS):
        places, sums = codes[at : at + SCAN_ROWS].astype(np.intp), out[at : at + SCAN_ROWS]
        for p in range(codes.shape[1]):
            sums += np.take(tables[p], places[:, p], axis=0, out=part[: len(sums)], mode="clip")
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _keys(cosines: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Numbers in the order of cosine times norm, which itself may be beyond a double's range. norms: logarithms."""
    size = np.maximum(np.log2(np.maximum(np.abs(cosines), 1e-300)), FLOOR) + (norms + LIFT)
    return np.where(cosines < 0, -size, size)


def _bound(least: np.ndarray, k: int) -> np.ndarray:
    """For each column a number that k of its values reach at least, close to the k-th largest: each group of rows counts by its best one."""
    group = max(1, min(GROUP, len(least) // (32 * k)))
    best = least[: len(least) // group * group].reshape(-1, group, least.shape[1]).max(1)
    return np.partition(best, len(best) - k, axis=0)[len(best) - k]


def finalists(q: Quantiser, codes: np.ndarray, errors: np.ndarray, norms: np.ndarray, units: np.ndarray, k: int, sure: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (a row of units): the rows that may be among its k best, and the most and the least that each may
    reach, in numbers that have the order of products."""
    # A residual's part along a query is some 1/sqrt(d) of its length; at most it is all of it, and tables are rounded.
    margin = (errors + 1e-4 if sure is None else sure * errors / np.sqrt(2 * q.pairs))[:, None]
    step = max(1, CELLS_AT_ONCE // max(1, len(codes)))
    near = len(norms) > 0 and norms.max() - norms.min() < SPREAD
    if near:
        weight = np.exp2(norms - norms.max())[:, None]
        twice, margin, weight = (2 * margin * weight).astype(np.float32), margin.astype(np.float32), weight.astype(np.float32)
    for at in range(0, len(units), step):
        least = scan(q, codes, units[at : at + step])
        if near:
            least -= margin
            least *= weight
            most = least + twice
        else:
            rough = least.astype(np.float64)
            least, most = _keys(rough - margin, norms[:, None]), _keys(rough + margin, norms[:, None])
        if len(codes) > k:
            rows, of = np.nonzero(most >= _bound(least, k))
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(1, least.shape[1]))
            for i, some in enumerate(np.split(rows[order], ends)):
                yield some, most[some, i], least[some, i]
        else:
            for low, high in zip(least.T, most.T, strict=True):
                yield np.arange(len(codes)), high, low


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by powers of two, so that none of their components is beyond one; and the exponents."""
    _, a = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -a[:, None]), a


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; rows are scaled by powers of two first, so only results can overflow."""
    return _products(*scaled(x), *scaled(y))


def _products(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.ldexp((x * y).sum(1), a + b)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of float if the embeddings are, else of double): rows that can take part.

    Out are null ids, vectors that are null, empty, zero or hold null, NaN or infinite components, and vectors
    of another length than most. Of rows that repeat an id the smallest vector stands for it.
    """
    kind = rows.schema["embedding"].dataType
    v = F.col("embedding") if kind == ArrayType(FloatType(), kind.containsNull) else F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)  # one row
    return good.join(F.broadcast(length), F.size("v") == F.col("d")).groupBy("vec_id").agg(F.min("v").alias("v"))


def fit_on(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Quantiser | None:
    """rows as of usable(); None if there are none."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    if not sample.num_rows:
        return None
    return fit(_matrix(sample.column(0), len(sample.column(0)[0])))


def index(rows: DataFrame, q: Quantiser) -> DataFrame:
    """rows (vec_id, v, asks) with g (a 128-bit hash of the vector), norm, error and codes: every row is encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, len(whole), VECTOR_ROWS):
                batch = whole.slice(at, VECTOR_ROWS)
                x = _matrix(batch.column(1), len(batch.column(1)[0]))
                units, norms = directions(x)
                codes, errors = encode(q, units)
                g = [hashlib.md5(r.tobytes(), usedforsecurity=False).digest() for r in x + 0.0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g, pa.binary()), pa.array(norms), pa.array(errors), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "asks", "g", "norm", "error", "codes"])

    return rows.mapInArrow(run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, asks boolean, g binary, norm double, error double, codes binary")


def _found(indexed: DataFrame, asked: DataFrame, q: Quantiser, k: int, sure: float | None, row_blocks: int, query_blocks: int) -> DataFrame:
    """g, ids, scores: each query's k best in each block of rows, ties to smaller ids."""
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    left = indexed.select(block("vec_id", row_blocks).alias("b"), spread(query_blocks).alias("c"), "vec_id", "v", "norm", "error", "codes")
    right = asked.select(spread(row_blocks).alias("b"), block("g", query_blocks).alias("c"), "g", "v")
    schema = pa.schema([("g", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(data: pa.Table, questions: pa.Table) -> pa.Table:
        release()
        if not data.num_rows or not questions.num_rows:
            return schema.empty_table()
        data = data.sort_by("vec_id")
        ids, d = data.column("vec_id").to_numpy(), len(data.column("v")[0])
        codes = np.frombuffer(b"".join(data.column("codes").to_pylist()), np.uint8).reshape(data.num_rows, -1)
        (x, a), asks = scaled(_matrix(data.column("v"), d)), _matrix(questions.column("v"), d)
        y, b = scaled(asks)
        best, scores = [], []
        for i, (some, _, _) in enumerate(finalists(q, codes, data.column("error").to_numpy(), data.column("norm").to_numpy(), directions(asks)[0], k, sure)):
            score = np.concatenate([_products(x[part], a[part], y[i : i + 1], b[i : i + 1]) for part in (some[at : at + VECTOR_ROWS] for at in range(0, len(some), VECTOR_ROWS))])
            first = np.argsort(-score, kind="stable")[:k]
            best.append(ids[some[first]])
            scores.append(score[first])
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))
        return pa.table([questions.column("g").combine_chunks(), lists(best, pa.int64()), lists(scores, pa.float64())], schema=schema)

    return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(run, "g binary, ids array<long>, scores array<double>")


def search(embeddings: DataFrame, is_query: Column, k: int = 20, sure: float | None = SURE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best found for each usable row for which the column is_query holds.

    A query's own id is never found. Scores are inner products in double precision (infinite beyond its range); ties
    go to the smaller vec_id (of infinite ones, among the rows scored). sure: standard errors of products within which a row is scored exactly; None: all that
    can be among the best, so the answer is exact. No usable row: no rows. Other columns of embeddings are not read.
    """
    spark = embeddings.sparkSession
    rows = written(usable(embeddings).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    q = fit_on(rows)
    if q is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = written(index(rows, q), "index")
    dropped(rows)
    # Of equal vectors the k + 1 smallest ids can be wanted at most, one being the query's own. Equal queries ask once.
    place = F.row_number().over(Window.partitionBy("g").orderBy("vec_id"))
    wanted = indexed.drop("asks").withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place")
    members = indexed.where("asks").select(F.col("vec_id").alias("query_id"), "g")
    asked = written(indexed.where("asks").groupBy("g").agg(F.first("v").alias("v"), F.count("*").alias("n")), "queries")
    n = indexed.groupBy("g").agg(F.least(F.count("*"), F.lit(k + 1)).alias("n")).agg(F.sum("n")).first()[0]
    n_distinct, n_queries = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks, size = 2 * spark.sparkContext.defaultParallelism, 16 * q.pairs
    # Rows outnumber queries, so for the sake of more tasks their blocks are made smaller first.
    query_blocks = max(1, -(-n_distinct // max(1, min(block_queries, QUERIES_BYTES // size))))
    row_blocks = max(1, -(-n // max(1, min(block_rows, ROWS_BYTES // size))), min(n // LEAST_ROWS, -(-tasks // query_blocks)))
    query_blocks = max(query_blocks, min(n_distinct // LEAST_QUERIES, tasks // row_blocks))
    found = written(_found(wanted, asked, q, k + 1, sure, row_blocks, query_blocks), "found")
    scores = found.select("g", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("g", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    best = Window.partitionBy("g").orderBy(F.desc("score"), "vec_id")
    top = scores.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k + 1)
    lists = top.groupBy("g").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found")).join(asked.select("g", "n"), "g")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    each = skewed_join(members, lists, "g", F.col("query_id"), n_queries).select("query_id", F.posexplode(others).alias("rank", "f"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.minus")).alias("score"))
