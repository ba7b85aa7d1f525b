"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments, and at last into its numbers. For segments of m numbers, m times the squared differences of their means and
of their deviations sum up to no more than the squared distance. So of the pairs of a block of queries and a block of
vectors only those go on from one resolution to the next whose bound doesn't exceed the query's k-th distance so far, and
exact distances are computed for what is left.

Vectors are sorted by their mean, cut into blocks and written in files of bounded size; a first pass inside each block
gives its queries a k-th distance. Then a task takes some files of queries and goes through files of vectors, the nearest
ones by mean and deviation first. Files and blocks whose ranges of statistics lie too far away are never read or opened.
Vectors are shuffled once, whatever their number; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import common

#: Blocks in a file of vectors; with the rows of a block it bounds what a task reads at once.
FILE_BLOCKS = 32
#: Queries that one task holds, but for those of a single file.
TASK_QUERIES = 16_384


def segments(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine, that divide the dimensions evenly; at the finest every number is one."""
    return [s for s in (1, 4, 16) if dims % s == 0 and s < dims] + [dims]


def statistics(vectors: np.ndarray, count: int) -> np.ndarray:
    """Means and deviations of ``count`` segments, scaled so that squared differences sum up to the bound."""
    if count == vectors.shape[1]:
        return vectors
    parts = vectors.reshape(len(vectors), count, -1)
    return np.concatenate([parts.mean(2), parts.std(2)], 1) * np.sqrt(parts.shape[2])


def coarsest(vectors: np.ndarray) -> np.ndarray:
    """The mean and the deviation of each vector, scaled as in ``statistics``."""
    return statistics(vectors, 1) if vectors.shape[1] > 1 else np.concatenate([vectors, np.zeros_like(vectors)], 1)


def nearest(queries: np.ndarray, vectors: np.ndarray, limit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector, squared distance) whose distance doesn't exceed the query's squared ``limit``.

    ``own`` is the place of a query among the vectors, where it doesn't meet itself, or -1. Bounds get a slack for rounding.
    """
    slack = 1e-9 * (1.0 + (queries**2).sum(1) + (vectors**2).sum(1).max(initial=0.0))
    within, x, y = np.ones((len(queries), len(vectors)), bool), None, None
    here = np.nonzero(own >= 0)[0]
    within[here, own[here]] = False
    for count in segments(queries.shape[1]):
        a, b = statistics(queries, count), statistics(vectors, count)
        if x is None:
            # As long as many pairs are left, bounds of all pairs by one matrix product cost less than picking them out.
            bound = a @ (-2 * b.T)
            bound += (b**2).sum(1)[None, :]
            within &= bound <= (limit + slack - (a**2).sum(1))[:, None]
            if np.count_nonzero(within) <= 0.02 * within.size:
                x, y = np.nonzero(within)
        else:
            kept = ((a[x] - b[y]) ** 2).sum(1) <= limit[x] + slack[x]
            x, y = x[kept], y[kept]
    if x is None:
        x, y = np.nonzero(within)
    d = np.empty(len(x))
    for low in range(0, len(x), 200_000):
        part = slice(low, low + 200_000)
        d[part] = ((queries[x[part]] - vectors[y[part]]) ** 2).sum(1)
    kept = d <= limit[x]
    return x[kept], y[kept], d[kept]


def _best(x: np.ndarray, d: np.ndarray, ids: np.ndarray, sound: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest of each query; of equal distances the null id, then the lesser one comes first."""
    order = np.lexsort((ids, sound, d, x))
    sorted_x = x[order]
    first = np.nonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))[0] if len(x) else np.zeros(0, np.int64)
    rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return order[rank < k]


_ROW = pa.schema([("id", pa.int64()), ("asks", pa.bool_()), ("dims", pa.int32()), ("mean", pa.float64()), ("v", pa.binary())])


def _rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sound vectors as bytes, with their mean."""
        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            sums = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(values), values, 0.0), dtype=np.float64)])
            good = np.nonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))[0]
            data, size = values.tobytes(), values.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)).fill_null(False), pa.array(sizes[good].astype(np.int32)),
                    pa.array((sums[ends[good]] - sums[ends[good] - sizes[good]]) / sizes[good]), pa.array([data[(ends[i] - sizes[i]) * size : ends[i] * size] for i in good.tolist()], pa.binary()),
                ],
                schema=_ROW,
            )

    return run


_BLOCK = pa.schema(
    [("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("sound", pa.binary()), ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
    + [("asked", pa.int32()), ("at", pa.binary()), ("who", pa.binary()), ("known", pa.binary()), ("asks", pa.binary()), ("limits", pa.binary()), ("qlow", pa.list_(pa.float64())), ("qhigh", pa.list_(pa.float64())), ("reach", pa.float64())]
)
_BLOCK_SQL = (
    "block long, dims int, ids binary, sound binary, data binary, low array<double>, high array<double>,"
    " asked int, at binary, who binary, known binary, asks binary, limits binary, qlow array<double>, qhigh array<double>, reach double"
)


def _block(name: int, rows: pa.Table, kind: str, k: int) -> pa.RecordBatch:
    """One block: ids, vectors, ranges of their coarsest statistics, and its queries with a k-th distance for each."""
    dims = rows.column("dims")[0].as_py()
    raw = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(-1, dims)
    ids = rows.column("id").combine_chunks()
    names, sound = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
    data, coarse = raw.astype(np.float64), coarsest(raw.astype(np.float64))
    at = np.nonzero(rows.column("asks").to_numpy())[0]
    limits = np.full(len(at), np.inf)
    if len(at) and len(data) > k:
        squares = (data**2).sum(1)
        for low in range(0, len(at), 1024):
            part = at[low : low + 1024]
            d = squares[part, None] + squares[None, :] - 2 * data[part] @ data.T
            d[np.arange(len(part)), part] = np.inf
            limits[low : low + len(part)] = np.partition(d, k - 1, axis=1)[:, k - 1]
        limits += 1e-9 * (1.0 + squares[at] + squares.max())
    asking = coarse[at]
    one = lambda value, kind: pa.array([value], kind)
    numbers = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [
            one(name, pa.int64()), one(dims, pa.int32()), one(names.tobytes(), pa.binary()), one(sound.tobytes(), pa.binary()),
            one(raw.tobytes(), pa.binary()), one(coarse.min(0).tolist(), numbers), one(coarse.max(0).tolist(), numbers),
            one(len(at), pa.int32()), one(at.astype(np.int32).tobytes(), pa.binary()), one(names[at].tobytes(), pa.binary()), one(sound[at].tobytes(), pa.binary()), one(raw[at].tobytes(), pa.binary()), one(limits.tobytes(), pa.binary()),
            one(asking.min(0).tolist() if len(at) else None, numbers), one(asking.max(0).tolist() if len(at) else None, numbers), one(float(limits.max()) if len(at) else None, pa.float64()),
        ],
        schema=_BLOCK,
    )


def _blocks(kind: str, k: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of one sorted partition; its number and a count name them, so a task that runs again gives the same names."""
        from pyspark import TaskContext

        name, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                dims = held.column("dims").to_numpy()
                change = np.nonzero(dims != dims[0])[0]
                stop = min(block_rows, int(change[0]) if len(change) else block_rows)
                if stop > held.num_rows:
                    break
                yield _block(name, held.slice(0, stop), kind, k)
                name, held = name + 1, held.slice(stop)
        if held is not None and held.num_rows:
            yield _block(name, held, kind, k)

    return run


_FOUND = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("neighbor", pa.int64()), ("d", pa.float64())])


def _gap(low: np.ndarray, high: np.ndarray, l: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least squared distance between boxes; the last axis has the two statistics."""
    return (np.maximum(np.maximum(low - h, l - high), 0.0) ** 2).sum(-1)


def _search(folder: str, names: list[str], kind: str, k: int):
    def table(place: int, columns: list[str]) -> list[dict]:
        fs, root = common.local_path(folder)
        with fs.open_input_file(f"{root}/{names[place]}") as file:
            return pq.read_table(file, columns=columns).to_pylist()

    def unit(dims: int, asking: list[int], others: list[int]) -> pa.RecordBatch | None:
        """The k best of some files of vectors for the queries of others."""
        rows = [r for f in asking for r in table(f, ["block", "dims", "asked", "at", "who", "known", "asks", "limits"]) if r["dims"] == dims and r["asked"]]
        if not rows:
            return None
        queries = np.frombuffer(b"".join(r["asks"] for r in rows), kind).reshape(-1, dims).astype(np.float64)
        limit = np.frombuffer(b"".join(r["limits"] for r in rows)).copy()
        home = np.repeat([r["block"] for r in rows], [r["asked"] for r in rows])
        row = np.frombuffer(b"".join(r["at"] for r in rows), np.int32)
        coarse = coarsest(queries)
        slack = 1e-9 * (1.0 + (queries**2).sum(1))
        x, ids, sound, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
        for f in others:
            for other in table(f, ["block", "dims", "ids", "sound", "data", "low", "high"]):
                if other["dims"] != dims:
                    continue
                low, high = np.array(other["low"]), np.array(other["high"])
                some = np.nonzero(_gap(coarse, coarse, low, high) <= limit * (1 + 1e-9) + slack)[0]
                if not len(some):
                    continue
                vectors = np.frombuffer(other["data"], kind).reshape(-1, dims).astype(np.float64)
                names_, valid = np.frombuffer(other["ids"], np.int64), np.frombuffer(other["sound"], bool)
                got = [(x, ids, sound, d)]
                for begin in range(0, len(some), 1024):
                    part = some[begin : begin + 1024]
                    i, j, e = nearest(queries[part], vectors, limit[part], np.where(home[part] == other["block"], row[part], -1))
                    got.append((part[i], names_[j], valid[j], e))
                x, ids, sound, d = (np.concatenate(c) for c in zip(*got, strict=True))
                top = _best(x, d, ids, sound, k)
                x, ids, sound, d = x[top], ids[top], sound[top], d[top]
                counts, worst = np.bincount(x, minlength=len(limit)), np.zeros(len(limit))
                np.maximum.at(worst, x, d)
                limit = np.where(counts >= k, np.minimum(limit, worst), limit)
        who, known = np.frombuffer(b"".join(r["who"] for r in rows), np.int64), np.frombuffer(b"".join(r["known"] for r in rows), bool)
        return pa.RecordBatch.from_arrays([pa.array(home[x]), pa.array(row[x]), pa.array(who[x], mask=~known[x]), pa.array(ids, mask=~sound), pa.array(d)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, asking, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = unit(dims, asking, others)
                if found is not None:
                    yield found

    return run


def _units(files: list, tasks: int) -> list[tuple[int, list[int], list[int]]]:
    """What each task does: dimensions, files of queries, and files of vectors, nearest first.

    ``files`` has a row for each file and dimension, in the order of the means. The queries of neighbouring files go
    together, up to ``TASK_QUERIES``; where that gives few tasks, the files of vectors are dealt out among several.
    """
    out = []
    for dims in sorted({f["dims"] for f in files}):
        own = [f for f in files if f["dims"] == dims]
        low, high, place = np.array([f["low"] for f in own]), np.array([f["high"] for f in own]), np.array([f["place"] for f in own])
        groups: list[list] = []
        for f in own:
            if not f["asked"]:
                continue
            if not groups or sum(g["asked"] for g in groups[-1]) + f["asked"] > TASK_QUERIES:
                groups.append([])
            groups[-1].append(f)
        for group in groups:
            gap = _gap(low, high, np.min([g["qlow"] for g in group], 0), np.max([g["qhigh"] for g in group], 0))
            reach = max(g["reach"] for g in group)
            scale = max(float((np.abs(low).max() + np.abs(high).max()) ** 2), 1.0)
            near = place[np.argsort(gap, kind="stable")][: int((gap <= reach * (1 + 1e-9) + 1e-9 * scale).sum())].tolist()
            parts = max(1, min(len(near), -(-tasks // len(groups))))
            out += [(dims, [g["place"] for g in group], near[i::parts]) for i in range(parts)]
    return out


def search(vectors: DataFrame, k: int = 10, query: Column | None = None, id_column: str = "vec_id", column: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """The ``k`` nearest other rows of every query: ``vec_id``, ``rank`` from 1, ``neighbor_id``, Euclidean ``distance``.

    Queries are the rows for which ``query`` holds (null counts as false; without it all rows); every row is a candidate for
    each. Of equal distances the lesser id comes first, a null id before all. Vectors that are null or empty, or hold nulls,
    NaN or infinities, are left out; vectors of different lengths don't meet. Repeated rows are each other's neighbours at
    distance 0, and repeated queries have repeated results. With k rows or fewer there are fewer ranks. Ids must be whole
    numbers; a vector has to fit into a task's memory, but for that its length is free. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    common.ship(spark)
    single = vectors.schema[column].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    given = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), (F.lit(True) if query is None else query).alias("asks"), F.col(f"`{column}`").cast("array<float>" if single else "array<double>").alias("v"))
    rows = given.mapInArrow(_rows(kind), "id long, asks boolean, dims int, mean double, v binary")
    # Rows of equal mean are told apart by their ids, so that any number of them spreads over partitions.
    salted = rows.withColumn("salt", F.xxhash64("id"))
    ranged = salted.repartitionByRange(common.partitions(spark), "dims", "mean", "salt").sortWithinPartitions("dims", "mean", "salt").drop("salt", "mean")
    blocks = common.materialize(ranged.select("id", "asks", "dims", "v").mapInArrow(_blocks(kind, k, block_rows), _BLOCK_SQL), "blocks", maxRecordsPerFile=FILE_BLOCKS)
    least = lambda c: F.array(*[F.min(F.col(c)[i]) for i in range(2)]).alias(c)
    most = lambda c: F.array(*[F.max(F.col(c)[i]) for i in range(2)]).alias(c)
    # One row for each file: as many as the driver lists for any read of the table.
    files = (
        blocks.select(F.col("_metadata.file_name").alias("file"), "dims", "low", "high", "asked", "qlow", "qhigh", "reach")
        .groupBy("file", "dims").agg(least("low"), most("high"), F.sum("asked").alias("asked"), least("qlow"), most("qhigh"), F.max("reach").alias("reach")).collect()
    )
    files = sorted((f.asDict() for f in files), key=lambda f: (f["dims"], f["low"], f["file"]))
    names = sorted({f["file"] for f in files})
    places = {name: i for i, name in enumerate(names)}
    units = _units([f | {"place": places[f["file"]]} for f in files], 2 * common.partitions(spark))
    jobs = spark.createDataFrame(units, "dims int, asking array<int>, others array<int>").repartition(max(1, len(units)))
    found = jobs.mapInArrow(_search(blocks._palisade_path, names, kind, k), "block long, row int, id long, neighbor long, d double")
    order = Window.partitionBy("block", "row").orderBy("d", F.col("neighbor").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), "rank", F.col("neighbor").alias("neighbor_id"), F.round(F.sqrt("d"), 6).alias("distance"))


ORACLE_SQL = """
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(d, 6) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank
    FROM (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0))
WHERE rank <= 10
"""
