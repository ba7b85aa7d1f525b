"""N-gram Jaccard join: a grouped prefix join over the sets of word n-grams.

1. Each task turns texts into sets of n-gram hashes. Equal sets form a class; its documents are copies of each other.
2. The hashes travel as compressed blobs to buckets of the hash space, which count in how many documents each gram
   occurs. Only grams that occur twice can be shared; they return to their documents, the others just count there.
3. Grams are ordered by rarity. A document whose repeated grams number less than ``t`` of its set has no partner. The
   prefix of the others is short, as the grams that nobody shares come first in it.
4. Classes with the same prefix and size form a group. Groups that meet in a prefix gram and pass the size filter are
   pairs; the posting lists of one neighbourhood go to one task, which finds each pair once.
5. Group pairs are expanded into their members, whose overlap is counted exactly.

No task gathers all of a hot key: a gram comes to its bucket once a flush, and long posting lists and large groups are
dealt into parts whose pairs are tiles of bounded size, each a task's work of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import blobs, common
from palisade.llm.blobs import bucket_edges, buckets_for, flushes, pack, pack_sorted, trimmed, trimmed_pair, unpack, unpack_sorted
from palisade.llm.hashing import U, flat, mix, ngrams, starts_of, word_hashes

_SENT = pa.schema([("bucket", pa.int32()), ("flush", pa.string()), ("grams", pa.binary()), ("rows", pa.binary()), ("times", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("idx", pa.int32()), ("fp", pa.int64()), ("n", pa.int32())])
_SENT_SQL = "bucket int, flush string, grams binary, rows binary, times binary, doc_id long, th long, idx int, fp long, n int"


def _flush(flush: str, ids: pa.Array, ths: pa.Array, words: np.ndarray, lengths: np.ndarray, n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    grams, rows = ngrams(words, lengths, n)
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    size = np.bincount(rows, minlength=len(lengths))
    fp = np.zeros(len(lengths), U)
    np.add.at(fp, rows, mix(grams + U(0x5851F42D4C957F2D)))
    some = np.nonzero(size)[0]
    if not len(some):
        return
    # Copies within this flush become one class, of which one row stands for all.
    _, first, inverse = np.unique(np.stack([fp[some], size[some].astype(U)], 1), axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    stands = np.zeros(len(lengths), bool)
    stands[some[first]] = True
    idx = np.zeros(len(lengths), np.int32)
    idx[some] = inverse
    kept = stands[rows]
    grams, rows = grams[kept], idx[rows[kept]].astype(np.uint32)
    # A gram goes to its bucket once, with its number here; its other rows go back to the flush. So a bucket gets no gram
    # more often than there are flushes.
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    more = (pack_sorted(grams[~new]), pack(rows[~new])) if not new.all() else None
    times = np.diff(np.append(np.nonzero(new)[0], len(grams))).astype(np.uint32)
    grams, rows = grams[new], rows[new]
    edges = bucket_edges(grams, buckets)
    full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    k = len(full)
    none = lambda kind: pa.nulls(k, kind)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([flush] * k),
            pa.array([pack_sorted(grams[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            pa.array([pack(rows[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            pa.array([pack(times[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int32()),
        ],
        schema=_SENT,
    )
    k = len(some)
    taken = pa.array(some)
    spread = zlib.crc32(flush.encode()) % buckets
    if more is not None:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1 - spread], pa.int32()), pa.array([flush]), *(pa.array([x], pa.binary()) for x in more), pa.nulls(1, pa.binary()),
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
            ],
            schema=_SENT,
        )
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k, -1 - spread, np.int32)), pa.array([flush] * k), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
            ids.take(taken), ths.take(taken), pa.array(idx[some]), pa.array(fp[some].view(np.int64)), pa.array(size[some].astype(np.int32)),
        ],
        schema=_SENT,
    )


def _send(n: int, buckets: int, flush_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush, ids, ths, words, lengths in flushes(batches, flush_words):
            yield from _flush(flush, ids, ths, words, lengths, n, buckets)

    return run


_COUNTED = pa.schema([("flush", pa.string()), ("grams", pa.binary()), ("rows", pa.binary()), ("df", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("idx", pa.int32()), ("fp", pa.int64()), ("n", pa.int32())])
_COUNTED_SQL = "flush string, grams binary, rows binary, df binary, doc_id long, th long, idx int, fp long, n int"


def _count(table: pa.Table) -> pa.Table:
    """Document frequencies within one bucket; of each blob what occurs in another document too is passed on."""
    if not table.num_rows or table.column("bucket")[0].as_py() < 0:
        return pa.table([table.column("flush"), table.column("grams"), table.column("rows"), pa.nulls(table.num_rows, pa.binary()), *(table.column(c) for c in ("doc_id", "th", "idx", "fp", "n"))], schema=_COUNTED)
    parts = [unpack_sorted(g) for g in table.column("grams").to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.nonzero(np.concatenate([[True], every[1:] != every[:-1]]))[0]
    times = np.add.reduceat(np.concatenate([unpack(t, np.uint32) for t in table.column("times").to_pylist()])[order], first, dtype=np.int64)
    many = times > 1
    grams, times = every[first[many]], np.minimum(times[many], np.iinfo(np.uint32).max).astype(np.uint32)
    del every, order, first, many
    out: dict[str, list] = {k: [] for k in ("flush", "grams", "rows", "df")}
    for part, flush, rows in zip(parts, table.column("flush").to_pylist(), table.column("rows").to_pylist(), strict=True):
        if not len(grams):
            break
        at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
        has = grams[at] == part
        if has.any():
            out["flush"].append(flush)
            out["grams"].append(pack_sorted(part[has]))
            out["rows"].append(pack(unpack(rows, np.uint32)[has]))
            out["df"].append(pack(times[at[has]]))
    k = len(out["flush"])
    return pa.table([pa.array(out["flush"], pa.string()), *(pa.array(out[c], pa.binary()) for c in ("grams", "rows", "df")), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], schema=_COUNTED)


#: Groups of a posting list, or classes of a group, that meet in one task; more are cut into tiles of so many by so many.
TILE = 2048

_CLASS = pa.schema([("gid", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("eff", pa.int32()), ("hot", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])
_CLASS_SQL = "gid long, fp long, n int, eff int, hot int, doc_ids array<long>, ths array<long>, grams array<long>"


def least_overlap(n: np.ndarray, threshold: float) -> np.ndarray:
    """The fewest grams that a set of n shares with any partner."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _classes(threshold: float, tile: int):
    def run(table: pa.Table) -> pa.Table:
        """The classes of one flush that may have partners, their repeated grams in order of rarity."""
        member = table.column("idx").is_valid()
        members, blobs = table.filter(member), table.filter(table.column("df").is_valid())
        more = table.filter(pa.compute.and_(pa.compute.invert(member), table.column("df").is_null()))
        order = np.argsort(members.column("idx").to_numpy(), kind="stable")
        members = members.take(pa.array(order))
        idx = members.column("idx").to_numpy()
        first = np.nonzero(np.concatenate([[True], idx[1:] != idx[:-1]]))[0] if len(idx) else np.zeros(0, np.int64)
        copies = np.diff(np.append(first, len(idx)))
        n, fp = members.column("n").to_numpy()[first].astype(np.int64), members.column("fp").to_numpy()[first]
        if blobs.num_rows:
            grams = np.concatenate([unpack_sorted(g) for g in blobs.column("grams").to_pylist()])
            rows = np.concatenate([unpack(g, np.uint32) for g in blobs.column("rows").to_pylist()]).astype(np.int64)
            df = np.concatenate([unpack(g, np.uint32) for g in blobs.column("df").to_pylist()])
            if more.num_rows:
                others = np.concatenate([unpack_sorted(g) for g in more.column("grams").to_pylist()])
                order = np.argsort(grams)
                times = df[order[np.searchsorted(grams[order], others)]]
                rows = np.append(rows, np.concatenate([unpack(g, np.uint32) for g in more.column("rows").to_pylist()]).astype(np.int64))
                grams, df = np.append(grams, others), np.append(df, times)
        else:
            grams, rows, df = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        shared = np.bincount(rows, minlength=len(n))
        able = shared >= np.maximum(least_overlap(n, threshold), 1)
        kept = able[rows] if len(rows) else np.zeros(0, bool)
        grams, rows, df = grams[kept], rows[kept], df[kept]
        order = np.lexsort((grams, df, rows))
        grams, rows, df = grams[order], rows[order], df[order]
        prefix = np.where(able, np.maximum(n - least_overlap(n, threshold) + 1 - (n - shared), 0), 0)
        taken = np.where(able, shared, 0)
        begin = starts_of(taken)
        gid = mix(n.astype(U))
        within = np.arange(len(grams)) - begin[rows] < prefix[rows]
        np.add.at(gid, rows[within], mix(grams[within] ^ U(0x2545F4914F6CDD1D)))
        out = np.nonzero(able | (copies > 1))[0]
        spans = np.concatenate([[0], np.cumsum(taken[out])]).astype(np.int32)
        chosen = grams[np.repeat(able, taken)] if len(grams) else grams
        hot = np.bincount(rows[within & (df > tile)], minlength=len(n))
        who = np.concatenate([np.arange(first[i], first[i] + copies[i]) for i in out]) if len(out) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(copies[out])]).astype(np.int32)
        lists = lambda c: pa.ListArray.from_arrays(pa.array(at), members.column(c).combine_chunks().take(pa.array(who, pa.int64())))
        return pa.table(
            [pa.array(gid[out].view(np.int64)), pa.array(fp[out]), pa.array(n[out].astype(np.int32)), pa.array(prefix[out].astype(np.int32)), pa.array(hot[out].astype(np.int32)), lists("doc_id"), lists("th"), pa.ListArray.from_arrays(pa.array(spans), pa.array(chosen.view(np.int64)))],
            schema=_CLASS,
        )

    return run


_PAIR = pa.schema([("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

_CELLS = 8_000_000


def _cooccurring(left: tuple[np.ndarray, np.ndarray, int], right: tuple[np.ndarray, np.ndarray, int] | None, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of two sides that share one of the m lists: a product of incidence matrices, in slices of bounded size.

    A side has the member and the list of each entry, and the number of its members. Without ``right``, pairs within ``left``.
    """
    sides = []
    for member, lists, k in (left,) if right is None else (left, right):
        order = np.argsort(lists, kind="stable")
        sides.append((member[order], lists[order], k))
    most = max(k for _, _, k in sides)
    rows, step = max(1, _CELLS // max(sides[-1][2], 1)), max(1, _CELLS // max(most, 1))
    for low in range(0, left[2], rows):
        together = np.zeros((min(rows, left[2] - low), sides[-1][2]), np.float32)
        for begin in range(0, m, step):
            marks = []
            for member, lists, k in sides:
                i, j = np.searchsorted(lists, [begin, begin + step])
                marks.append(np.zeros((min(step, m - begin), k), np.float32))
                marks[-1][lists[i:j] - begin, member[i:j]] = 1
            together += marks[0][:, low : low + rows].T @ marks[-1]
        x, y = np.nonzero(together)
        x = x + low
        yield (x, y) if right is not None else (x[x < y], y[x < y])


def _pairs(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Group pairs of one block of posting lists: each pair once, those that fail the size filter left out."""
        block = table.column("block")[0].as_py()
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("home", "i", "j")], 1)
        tiles, tile = np.unique(keys, axis=0, return_inverse=True)
        tile = tile.ravel()
        order = np.argsort(tile, kind="stable")
        tile, table = tile[order], table.take(pa.array(order))
        sides = []
        for name in ("posts", "others"):
            posts = table.column(name).combine_chunks()
            counts = posts.value_lengths().to_numpy()
            sides.append((posts.flatten().field("gid").to_numpy(), posts.flatten().field("n").to_numpy().astype(np.int64), np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)])))
        every, at = np.unique(np.concatenate([x[0] for x in sides]), return_index=True)
        size = np.concatenate([x[1] for x in sides])[at]
        edges = np.searchsorted(tile, np.arange(len(tiles) + 1))
        found = []
        for t in range(len(tiles)):
            low, high = edges[t], edges[t + 1]
            parts = []
            for gid, _, lists, starts in sides if tiles[t, 1] != tiles[t, 2] else sides[:1]:
                span = slice(starts[low], starts[high])
                mine, member = np.unique(gid[span], return_inverse=True)
                parts.append((np.searchsorted(every, mine), (member.ravel(), lists[span] - low, len(mine))))
            for x, y in _cooccurring(parts[0][1], parts[1][1] if len(parts) > 1 else None, int(high - low)):
                x, y = parts[0][0][x], parts[-1][0][y]
                fits = np.minimum(size[x], size[y]) >= least_overlap(np.maximum(size[x], size[y]), threshold)
                if fits.any():
                    x, y = x[fits], y[fits]
                    found.append(np.unique(np.minimum(x, y) * len(every) + np.maximum(x, y)))
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table([pa.array(np.full(len(codes), block, np.int64)), pa.array(every[codes // len(every)]), pa.array(every[codes % len(every)])], schema=_PAIR)

    return run


def _parts(count: Column) -> Column:
    """The number of parts into which so many groups or classes are dealt: a power of two."""
    return F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(count / TILE))).cast("int"))


def _tiled(live: DataFrame, buckets: int) -> DataFrame:
    """Posting lists with the block that handles them; one longer than ``TILE`` becomes tiles, each of two parts of it.

    A gram that few documents hold has a short list. The lists of the others are counted first, and never gathered whole.
    """
    cold = F.slice("grams", 1, F.col("eff") - F.col("hot"))
    home = F.array_min("posts")["gid"]
    post = F.struct("gid", "n")
    short = (
        live.select("gid", "n", F.explode(cold).alias("gram")).groupBy("gram").agg(F.collect_set(post).alias("posts")).where(F.size("posts") > 1)
        .select(home.alias("home"), F.lit(0).alias("i"), F.lit(0).alias("j"), "posts", F.slice("posts", 1, 0).alias("others"))
    )
    hot = live.where("hot > 0").select("gid", "n", F.explode(F.slice("grams", F.col("eff") - F.col("hot") + 1, F.col("hot"))).alias("gram")).distinct()
    known = hot.groupBy("gram").agg(F.count("*").alias("k"), F.min("gid").alias("home")).where("k > 1").select("gram", "home", _parts(F.col("k")).alias("parts"))
    at = hot.join(known, "gram").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    long = (
        at.select("gram", "home", F.least("part", "meets").alias("i"), F.greatest("part", "meets").alias("j"), "part", post.alias("post"))
        .groupBy("gram", "home", "i", "j").agg(F.collect_list(F.when(F.col("part") == F.col("i"), F.col("post"))).alias("posts"), F.collect_list(F.when(F.col("part") != F.col("i"), F.col("post"))).alias("others"))
        .where((F.size("posts") > 0) & ((F.size("others") > 0) | (F.col("i") == F.col("j")))).select("home", "i", "j", "posts", "others")
    )
    return short.unionByName(long).withColumn("block", F.pmod(F.xxhash64("home", "i", "j"), F.lit(buckets)))


_FOUND = pa.schema([("fp", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
_FOUND_SQL = "fp long, root long, links long"


def _roots(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of k nodes."""
    root = np.arange(k)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _verify(threshold: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """Expand the group pairs of a block into class pairs and count their overlaps.

        Of each class with a match: how many documents it is linked to here, and the least class that it is connected to.
        """
        if not pairs.num_rows or not sets.num_rows:
            return _FOUND.empty_table()
        fp = sets.column("fp").to_numpy()
        _, first = np.unique(fp, return_index=True)  # a class may come from several flushes
        sets = sets.take(pa.array(first))
        fp, gid, n = (sets.column(c).to_numpy() for c in ("fp", "gid", "n"))
        n = n.astype(np.int64)
        grams, lengths = flat(sets.column("grams"))
        begin = starts_of(lengths)
        _, grams = np.unique(grams, return_inverse=True)
        grams = grams.ravel()
        marks = np.zeros(int(grams.max()) + 1 if len(grams) else 1, np.int32)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, g in enumerate(zip(gid.tolist(), sets.column("part").to_pylist(), strict=True)):
            groups.setdefault(g, []).append(i)
        partners: dict[int, list[int]] = {}
        for a, i, b, j in zip(*(pairs.column(c).to_pylist() for c in ("a", "i", "b", "j")), strict=True):
            for x in groups.get((a, i), ()):
                for y in groups.get((b, j), ()):
                    if (a, i) != (b, j) or x < y:
                        partners.setdefault(x, []).append(y)
        copies = sets.column("copies").to_numpy().astype(np.float64)
        links = np.zeros(len(fp))
        heads, tails = [], []
        for x, ys in partners.items():
            ys = np.unique(np.array(ys))
            marks[grams[begin[x] : begin[x] + lengths[x]]] = 1
            for low in range(0, len(ys), 4096):
                y = ys[low : low + 4096]
                take = np.repeat(begin[y], lengths[y]) + np.arange(int(lengths[y].sum())) - np.repeat(starts_of(lengths[y]), lengths[y])
                both = np.add.reduceat(marks[grams[take]], starts_of(lengths[y]))
                y = y[both * (1 + threshold) >= threshold * (n[x] + n[y]) - 1e-9]
                links[x] += copies[y].sum()
                links[y] += copies[x]
                heads.append(np.full(len(y), x, np.int32))
                tails.append(y.astype(np.int32))
            marks[grams[begin[x] : begin[x] + lengths[x]]] = 0
        some = np.nonzero(links)[0]
        root = _roots(len(fp), np.concatenate(heads), np.concatenate(tails)) if len(some) else np.zeros(0, np.int64)
        return pa.table([pa.array(fp[some]), pa.array(fp[root[some]]), pa.array(links[some].astype(np.int64))], schema=_FOUND)

    return run


def _matches(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The classes, and of each block and class the links found there and the least class connected (both written)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = docs.sparkSession
    common.ship(spark)
    buckets = max(4 * common.partitions(spark), buckets_for(docs))
    inputs = common.spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("w"))
    sent = inputs.mapInArrow(_send(n, buckets, blobs.FLUSH_WORDS), _SENT_SQL)
    counted = sent.groupBy("bucket").applyInArrow(trimmed(_count), _COUNTED_SQL)
    classes = common.materialize(counted.groupBy("flush").applyInArrow(trimmed(_classes(threshold, TILE)), _CLASS_SQL), "classes")
    live = classes.where("eff > 0")
    across = _tiled(live, buckets).groupBy("block").applyInArrow(trimmed(_pairs(threshold)), "block long, a long, b long").groupBy("a", "b").agg(F.min("block").alias("block"))
    # A class may come from several flushes; its documents are counted over all of them.
    whole = live.groupBy("fp").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.sum(F.size("doc_ids")).alias("copies"), F.first("grams").alias("grams"))
    sizes = live.select("gid", "fp").distinct().groupBy("gid").count()
    within = sizes.where("count > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"), F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("block"))
    # A group of more classes than a tile is dealt into parts, and its pairs become those of parts, each a block of its own.
    large = common.materialize(sizes.where(F.col("count") > TILE).select("gid", _parts(F.col("count")).alias("parts")), "large")
    parted = across.unionByName(within)
    for side, part in (("a", "i"), ("b", "j")):
        known = common.broadcast_small(large).select(F.col("gid").alias(side), F.col("parts").alias(f"{part}s"))
        parted = parted.join(known, side, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(f"{part}s", F.lit(1)) - 1)))
    alone = F.col("is").isNotNull() | F.col("js").isNotNull()
    parted = parted.where("a <> b OR i <= j").select("a", "i", "b", "j", F.when(alone, F.xxhash64("a", "i", "b", "j")).otherwise(F.col("block")).alias("block"))
    pairs = common.materialize(parted, "pairs")
    needed = pairs.select(F.col("block").alias("at"), F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("i").alias("part")), F.struct(F.col("b").alias("gid"), F.col("j").alias("part")))).alias("s")).select("at", "s.*").distinct()
    dealt = whole.join(common.broadcast_small(large), "gid", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    sets = needed.join(dealt, ["gid", "part"]).select("at", "gid", "part", "fp", "n", "copies", "grams")
    found = common.materialize(pairs.groupBy("block").cogroup(sets.groupBy("at")).applyInArrow(trimmed_pair(_verify(threshold)), _FOUND_SQL), "found")
    common.discard(pairs, large)
    return classes, found


def _membership(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``d``, ``t`` (id and text hash), ``root`` (the connected classes' least) and ``links`` of the documents that have a link."""
    roots = components(found.select(F.col("fp").alias("fa"), F.col("root").alias("fb")))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    copies = classes.groupBy("fp").agg(F.sum(F.size("doc_ids")).alias("copies"))
    known = (
        copies.join(links, "fp", "left").join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    )
    members = classes.select("fp", F.explode(F.arrays_zip("doc_ids", "ths")).alias("m")).select("fp", F.col("m.doc_ids").alias("d"), F.col("m.ths").alias("t"))
    return members.join(known, "fp").select("d", "t", "root", "links")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))


def join(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """One row for each document: ``doc_id``, ``class_id`` and ``links``.

    Two documents are linked if their sets of word n-grams have a Jaccard index of at least ``threshold``; ``links`` is the
    number of other rows that a document is linked to, copies and other texts alike. A class is what links connect;
    ``class_id`` is its least ``doc_id``, or the document's own where it has no link.

    Null and empty texts have no grams and no link. A text of fewer than n words has one gram, all its words; very long
    texts are taken whole. Repeated rows are copies and have a row and a link each; a null ``doc_id`` takes part, its row
    shows null, and a class has a null id just where all its documents do. Ids must be whole numbers. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    classes, found = _matches(docs, n, threshold)
    members = _membership(classes, found)
    least = members.groupBy("root").agg(F.min("d").alias("class_id"))
    linked = members.dropDuplicates(["d", "t"]).join(least, "root").select("d", "t", "class_id", "links")
    linked = common.broadcast_small(common.materialize(linked, "linked"))
    common.discard(classes, found)
    match = F.col("l.d").eqNullSafe(F.col("f.d")) & (F.col("l.t") == F.col("f.t"))
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t")).alias("l").join(linked.alias("f"), match, "left")
    return rows.select(F.col("l.d").alias("doc_id"), F.when(F.col("f.links").isNull(), F.col("l.d")).otherwise(F.col("f.class_id")).alias("class_id"), F.coalesce("f.links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node of the edges (``fa``, ``fb``) is connected to: columns ``node``, ``root``.

    Each round gives every node the least label of its neighbours and then the label of that label, so rounds grow with
    the logarithm of a chain's length. Every round is a written table.
    """
    links = edges.select(F.col("fa").alias("x"), F.col("fb").alias("y")).where("x <> y")
    links = common.materialize(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = common.materialize(links.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).select(F.col("x").alias("node"), F.col("l").alias("root")), "labels")
    while True:
        spread = links.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("best"))
        better = labels.join(spread, F.col("node") == F.col("x")).select("node", F.least("root", "best").alias("root"), F.col("root").alias("was"))
        jumped = (
            better.join(better.select(F.col("node").alias("via"), F.col("root").alias("far")), F.col("root") == F.col("via"), "left")
            .select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was")
        )
        after = common.materialize(jumped, "labels")
        moved = after.where("root <> was").limit(1).count()
        common.discard(labels)
        labels = after
        if not moved:
            common.discard(links)
            return labels.select("node", "root")


def keep_one(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the least ``doc_id`` (then text hash).

    Groups are the connected components of ``join``. Nulls, empty texts and other columns as there: documents without
    grams stay. Of rows that repeat in ``doc_id`` and text one stays; a null ``doc_id`` comes before all others.
    """
    classes, found = _matches(docs, n, threshold)
    rows = _membership(classes, found)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("d").isNotNull().alias("o"), "d", "t")).alias("best"))
    verdict = (
        rows.groupBy("root", "d", "t").agg(F.count("*").alias("times")).join(best, "root")
        .select("d", "t", (F.col("d").eqNullSafe(F.col("best.d")) & (F.col("t") == F.col("best.t"))).alias("stays"), "times")
        .where("NOT stays OR times > 1")
    )
    verdict = common.materialize(verdict, "verdict")
    common.discard(classes, found)
    tagged = _tagged(docs)
    match = F.col("tagged.d").eqNullSafe(F.col("v.d")) & (F.col("tagged.t") == F.col("v.t"))
    kept = tagged.alias("tagged").join(common.broadcast_small(verdict).alias("v"), match, "left_anti").select("row.*")
    twice = common.broadcast_small(verdict).where("stays")
    if not twice.limit(1).count():
        return kept
    once = tagged.alias("tagged").join(twice.alias("v"), match, "left_semi").dropDuplicates(["d", "t"]).select("row.*")
    return kept.unionByName(once)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
      FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS id, list(doc_id) AS ids, s, len(s) AS n FROM g GROUP BY s),
e AS (SELECT id, n, unnest(s) AS t FROM c),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c2 FROM e a JOIN e b ON a.t = b.t AND a.id < b.id
      WHERE a.n >= 0.5::DOUBLE * b.n AND b.n >= 0.5::DOUBLE * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE c2 >= 0.5::DOUBLE * (na + nb - c2) UNION ALL SELECT b, a FROM p WHERE c2 >= 0.5::DOUBLE * (na + nb - c2)),
k AS (SELECT l.a AS id, sum(len(c.ids)) AS near FROM l JOIN c ON c.id = l.b GROUP BY l.a),
r AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
m AS (SELECT x AS id, min(y) AS class_id FROM r GROUP BY x),
f AS (SELECT unnest(c.ids) AS doc_id, m.class_id, coalesce(k.near, 0) + len(c.ids) - 1 AS links FROM c JOIN m USING (id) LEFT JOIN k USING (id))
SELECT doc_id, coalesce(f.class_id, doc_id) AS class_id, coalesce(f.links, 0)::BIGINT AS links FROM documents LEFT JOIN f USING (doc_id)
"""
