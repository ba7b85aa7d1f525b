"""Substring deduplication by level-wise doubling.

Level 0 hashes the windows of ``min_words`` words at every position. Those that occur twice survive, and windows that
survive at one length alone are extended to twice that length: the window at p of length 2m is made of the survivors
at p and p + m. It ends at the length at which nothing survives. The first level decides what is removed: every word
that lies in a repeated window which isn't the first of its kind. The later ones tell how long the passages are.

Windows travel as compressed blobs of sorted hashes; a bucket of the hash space sees all windows of its kinds at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import blobs, common
from palisade.llm.blobs import bucket_edges, buckets_for, flushes, pack, pack_sorted, trimmed, unpack, unpack_sorted
from palisade.llm.hashing import U, mix, ranges, starts_of, window_hashes, word_hashes

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bits of a second hash that windows must share beside the 64 of the first.
_CHECK_BITS = 24
_NO_ID = np.iinfo(np.int64).min

_IN = ("hash", "check", "doc", "pos", "idx", "id", "tie", "many")
_OUT = ("hash", "check", "idx", "pos", "later")
_SENT = pa.schema([("bucket", pa.int32()), ("flush", pa.string()), *((c, pa.binary()) for c in (*_IN, "copies")), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64()))])
_SENT_SQL = f"bucket int, flush string, {', '.join(f'{c} binary' for c in (*_IN, 'copies'))}, ids array<long>, ths array<long>"
_KEPT = pa.schema([("flush", pa.string()), *((c, pa.binary()) for c in (*_OUT, "copies")), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64()))])
_KEPT_SQL = f"flush string, {', '.join(f'{c} binary' for c in (*_OUT, 'copies'))}, ids array<long>, ths array<long>"


def _home(flush: str, buckets: int) -> int:
    """The bucket, below 0, of what goes past the counting back to its flush."""
    return -1 - zlib.crc32(flush.encode()) % buckets


def _ranks(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The order of documents by id and text; those alike in both share a rank."""
    order = np.lexsort((ties, ids))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (ties[order][1:] != ties[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank


def _blobs(flush: str, ids: np.ndarray, ties: np.ndarray, hashes: np.ndarray, checks: np.ndarray, idx: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of a flush for their buckets: of each only its first place, and whether it has others here.

    The other places don't travel to the bucket but go back to the flush beside it, so a bucket gets no window more often than
    there are flushes.
    """
    order = np.argsort(hashes)
    hashes, checks, idx, pos = hashes[order], checks[order], idx[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    if not new.all():
        # Windows of one hash and several checks are different ones; they are sent one by one.
        odd = np.zeros(len(order), bool)
        odd[1:] = ~new[1:] & (checks[1:] != checks[:-1])
        run = np.cumsum(new, dtype=np.int32) - np.int32(1)
        if odd.any():
            new |= np.isin(run, run[odd])
            run = np.cumsum(new, dtype=np.int32) - np.int32(1)
        starts = np.nonzero(new)[0]
        counts = np.diff(np.append(starts, len(order)))
        some = np.nonzero((counts > 1)[run])[0]
        place = (_ranks(ids, ties)[idx[some]] << 32) | pos[some]
        some = some[o := np.lexsort((place, run[some]))]
        place, group = place[o], run[some]
        lead = np.ones(len(some), bool)
        lead[1:] = group[1:] != group[:-1]
        first = np.repeat(np.nonzero(lead)[0], np.diff(np.append(np.nonzero(lead)[0], len(some))))
        same = place == place[first]
        many = np.zeros(len(starts), bool)
        many[group[~same]] = True
        head = some[first]
        rest = ~lead
        copies = (
            ((idx[head[rest]].astype(np.int64) << 32) | pos[head[rest]], np.int64), (idx[some[rest]].astype(np.uint32), np.uint32), (pos[some[rest]].astype(np.uint32), np.uint32), (same[rest].astype(np.uint8), np.uint8),
        )
        blob = pa.array([_join([pack(x) for x, _ in copies])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([_home(flush, buckets)], pa.int32()), pa.array([flush]), *(pa.nulls(1, pa.binary()) for _ in _IN), blob, pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], schema=_SENT)
        starts[group] = head
        hashes, checks, idx, pos = hashes[starts], checks[starts], idx[starts], pos[starts]
        del run, some, place, group, first, same, head, copies, blob
    else:
        many = np.zeros(len(order), bool)
    edges = bucket_edges(hashes, buckets)
    out: dict[str, list] = {c: [] for c in ("bucket", *_IN)}
    for b in range(buckets):
        i, j = edges[b], edges[b + 1]
        if i == j:
            continue
        there = np.zeros(len(ids), bool)
        there[idx[i:j]] = True
        here, doc = np.nonzero(there)[0], (np.cumsum(there) - 1)[idx[i:j]]
        out["bucket"].append(b)
        for name, blob in (
            ("hash", pack_sorted(hashes[i:j])),
            ("check", pack(checks[i:j])),
            ("doc", pack(doc.astype(np.uint32))),
            ("pos", pack(pos[i:j].astype(np.uint32, copy=False))),
            ("idx", pack(np.diff(here, prepend=0).astype(np.uint32))),
            ("id", pack(np.diff(ids[here], prepend=np.int64(0)))),
            ("tie", pack(ties[here])),
            ("many", pack(many[i:j].view(np.uint8))),
        ):
            out[name].append(blob)
    k = len(out["bucket"])
    yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array([flush] * k, pa.string()), *(pa.array(out[c], pa.binary()) for c in _IN), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))], schema=_SENT)


def _join(parts: list[bytes]) -> bytes:
    """Several blobs as one: their sizes first."""
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _parts(blob: bytes) -> list[bytes]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    ends = 8 * (count + 1) + np.cumsum(np.frombuffer(blob, np.int64, count, 8))
    return [blob[e - n : e] for e, n in zip(ends.tolist(), np.frombuffer(blob, np.int64, count, 8).tolist(), strict=True)]


def _names(ids: pa.Array, ths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids with nulls as the least number, and ties: half of the text's hash, with a bit that tells null from number."""
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(_NO_ID).to_numpy(), (ths.to_numpy().view(U) & U(0xFFFFFFFE)).astype(np.uint32) | valid.astype(np.uint32)


def _first(length: int, buckets: int, flush_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush, ids, ths, words, lengths in flushes(batches, flush_words):
            full = np.maximum(lengths - length + 1, 0)
            at = ranges(starts_of(lengths), full)
            if not len(at):
                continue
            words = mix(words)
            idx = np.repeat(np.arange(len(lengths), dtype=np.uint32), full)
            names, ties = _names(ids, ths)
            pos = (at - starts_of(lengths)[idx]).astype(np.uint32)
            checks = (window_hashes(words, length, _BASES[1])[at] >> U(64 - _CHECK_BITS)).astype(np.uint32)
            hashes = window_hashes(words, length, _BASES[0])[at]
            del words, at
            yield from _blobs(flush, names, ties, hashes, checks, idx, pos, buckets)
            del hashes, checks, idx, pos
            yield pa.RecordBatch.from_arrays([pa.array([_home(flush, buckets)], pa.int32()), pa.array([flush]), *(pa.nulls(1, pa.binary()) for _ in (*_IN, "copies")), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([ths.to_pylist()], pa.list_(pa.int64()))], schema=_SENT)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The windows of one bucket that occur at two places, and which of them are not the first of their kind; one row for each flush.

    The first place is that of the least id, then text hash, then position. Rows alike in id and text are one place.
    """
    if not table.num_rows or table.column("bucket")[0].as_py() < 0:
        k = table.num_rows
        return pa.table([table.column("flush"), *(pa.nulls(k, pa.binary()) for _ in _OUT), *(table.column(c) for c in ("copies", "ids", "ths"))], schema=_KEPT)
    parts = {c: table.column(c).to_pylist() for c in _IN}
    sizes = np.array([blobs.count(b, np.uint8) for b in parts["many"]])
    hashes = np.concatenate([unpack_sorted(b) for b in parts["hash"]])
    many = np.concatenate([unpack(b, np.uint8) for b in parts["many"]]).astype(bool)
    order = np.argsort(hashes)
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    # All but a few windows are alone here and in their flush; places are looked up for the others only.
    order = order[twice[1:] | twice[:-1] | many[order]]
    if not len(order):
        return _KEPT.empty_table()
    hashes, many = hashes[order], many[order]
    del twice
    blob = np.searchsorted(np.cumsum(sizes), order, side="right")
    get = lambda c, kind: np.concatenate([unpack(b, kind) for b in parts[c]])
    checks, pos, doc = get("check", np.uint32)[order], get("pos", np.uint32)[order], get("doc", np.uint32)[order]
    ids = [np.cumsum(unpack(b, np.int64)) for b in parts["id"]]
    used, doc = np.unique(starts_of(np.array([len(x) for x in ids]))[blob] + doc, return_inverse=True)
    place = _ranks(np.concatenate(ids)[used], get("tie", np.uint32)[used])[doc.ravel()] << 32 | pos
    idx = np.concatenate([np.cumsum(unpack(b, np.uint32)) for b in parts["idx"]])[used][doc.ravel()]
    del ids, used, doc
    order = np.lexsort((place, checks, hashes))
    hashes, checks, place, idx, pos, blob, many = (x[order] for x in (hashes, checks, place, idx, pos, blob, many))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    first = np.nonzero(new)[0]
    kind = np.cumsum(new, dtype=np.int32) - np.int32(1)
    least, most = place[first], place[np.append(first[1:], len(place)) - 1]
    repeats = ((least != most) | np.logical_or.reduceat(many, first))[kind]
    later = place != least[kind]
    order = np.nonzero(repeats)[0]
    order = order[np.argsort(blob[order], kind="stable")]
    ends = np.append(np.nonzero(np.diff(blob[order]))[0] + 1, len(order))
    flush = table.column("flush").to_pylist()
    out: dict[str, list] = {x: [] for x in ("flush", "hash", "check", "idx", "pos", "later")}
    begin = 0
    for end in ends if len(order) else ():
        has, begin = order[begin:end], end
        out["flush"].append(flush[blob[has[0]]])
        out["hash"].append(pack_sorted(hashes[has]))
        out["check"].append(pack(checks[has]))
        out["idx"].append(pack(idx[has].astype(np.uint32)))
        out["pos"].append(pack(pos[has]))
        out["later"].append(pack(later[has].astype(np.uint8)))
    k = len(out["flush"])
    return pa.table([pa.array(out["flush"], pa.string()), *(pa.array(out[x], pa.binary()) for x in _OUT), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))], schema=_KEPT)


def _copies(table: pa.Table, idx: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The other places, in a flush, of those of its windows that came back: which window, idx, pos, and whether it is the same place."""
    found = [_parts(b) for b in table.column("copies").drop_null().to_pylist()]
    if not found or not len(idx):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    head, i, p, same = (np.concatenate([unpack(x[k], kind) for x in found]) for k, kind in enumerate((np.int64, np.uint32, np.uint32, np.uint8)))
    place = (idx << 32) | pos
    order = np.argsort(place)
    at = np.minimum(np.searchsorted(place[order], head), len(place) - 1)
    has = place[order[at]] == head
    return order[at[has]], i[has].astype(np.int64), p[has].astype(np.int64), same[has].astype(bool)


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check, idx, pos and later of a flush's survivors, at all their places; hashes and checks only if the table has them."""
    rows = table.filter(table.column("idx").is_valid())
    if not rows.num_rows:
        return np.zeros(0, U), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    get = lambda c, kind: np.concatenate([unpack(b, kind) for b in rows.column(c).to_pylist()])
    idx, pos, later = get("idx", np.uint32).astype(np.int64), get("pos", np.uint32).astype(np.int64), get("later", np.uint8).astype(bool)
    head, i, p, same = _copies(table, idx, pos)
    if "hash" not in table.column_names:
        hashes, checks = np.zeros(len(idx), U), np.zeros(len(idx), np.uint32)
    else:
        hashes, checks = np.concatenate([unpack_sorted(b) for b in rows.column("hash").to_pylist()]), get("check", np.uint32)
    return np.append(hashes, hashes[head]), np.append(checks, checks[head]), np.append(idx, i), np.append(pos, p), np.append(later, later[head] | ~same)


def _members(table: pa.Table) -> tuple[pa.Array, pa.Array] | None:
    rows = table.filter(table.column("ids").is_valid())
    if not rows.num_rows:
        return None
    return rows.column("ids").combine_chunks().flatten(), rows.column("ths").combine_chunks().flatten()


def _doubled(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """The windows of twice the length that two survivors of one flush make."""
        hashes, checks, idx, pos, _ = _opened(table)
        members = _members(table)
        place = (idx << 32) | pos
        order = np.argsort(place)
        place = place[order]
        at = np.minimum(np.searchsorted(place, place + length), max(len(place) - 1, 0))
        has = place[at] == place + length if len(place) else np.zeros(0, bool)
        if members is None or not has.any():
            return _SENT.empty_table()
        left, right = order[has], order[at[has]]
        h = mix(hashes[left] * U(_BASES[0]) + hashes[right])
        c = (checks[left] * np.uint32(0x9E3779B1) + checks[right]) & np.uint32((1 << _CHECK_BITS) - 1)
        return pa.Table.from_batches(list(_blobs(table.column("flush")[0].as_py(), *_names(*members), h, c, idx[left], pos[left], buckets)))

    return run


_DOCS_SQL = "doc_id long, th long, longest int, spans array<struct<start:int,stop:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])


def _spans(min_words: int):
    def run(table: pa.Table) -> pa.Table:
        """Of each document of one flush: the greatest length that repeats and the spans to remove, in words."""
        ids, ths = _members(table)
        longest = np.zeros(len(ids), np.int32)
        spans: dict[int, list] = {}
        for level in np.unique(table.column("level").to_numpy()):
            _, _, idx, pos, later = _opened(table.filter(pa.compute.equal(table.column("level"), level)))
            longest[idx] = np.maximum(longest[idx], level)
            if level == min_words and later.any():
                place = np.sort((idx[later] << 32) | pos[later])
                cut = np.nonzero(np.diff(place) > min_words)[0]
                start, stop = place[np.concatenate([[0], cut + 1])], place[np.concatenate([cut, [len(place) - 1]])] + min_words
                for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                    spans.setdefault(s >> 32, []).append({"start": s & 0xFFFFFFFF, "stop": e & 0xFFFFFFFF})
        touched = np.nonzero(longest)[0]
        take = pa.array(touched)
        return pa.table([ids.take(take), ths.take(take), pa.array(longest[touched]), pa.array([spans.get(int(i), []) for i in touched], pa.list_(_SPAN))], names=["doc_id", "th", "longest", "spans"])

    return run


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents that hold a passage of ``min_words`` words which occurs elsewhere (written): key, longest level, spans."""
    if min_words < 1:
        raise ValueError("a passage has at least one word")
    spark = docs.sparkSession
    common.ship(spark)
    buckets = buckets_for(docs)
    inputs = common.spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("w"))
    sent = inputs.mapInArrow(_first(min_words, buckets, blobs.FLUSH_WORDS), _SENT_SQL)
    base = common.materialize(sent.groupBy("bucket").applyInArrow(trimmed(_repeated), _KEPT_SQL), "level")
    members = base.where("ids IS NOT NULL")
    levels, length = [(min_words, base)], min_words
    while True:
        if not levels[-1][1].where("hash IS NOT NULL").limit(1).count():
            break
        sent = levels[-1][1].where("ids IS NULL").unionByName(members).groupBy("flush").applyInArrow(trimmed(_doubled(length, buckets)), _SENT_SQL)
        length *= 2
        levels.append((length, common.materialize(sent.groupBy("bucket").applyInArrow(trimmed(_repeated), _KEPT_SQL), "level")))
    every = base.withColumn("level", F.lit(min_words))
    for at, level in levels[1:]:
        every = every.unionByName(level.withColumn("level", F.lit(at)))
    found = every.drop("hash", "check").groupBy("flush").applyInArrow(trimmed(_spans(min_words)), _DOCS_SQL).dropDuplicates(["doc_id", "th"])
    out = common.materialize(found, "repeats")
    common.discard(*[level for _, level in levels])
    return out


def _cut(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans, the white space before them and that at the end of the text."""
    words = F.regexp_extract_all(text, F.lit(r"(\s*\S+)"), F.lit(1))
    kept = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"])))
    return F.array_join(kept, "")


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), " ")


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(row, F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t")).alias("l")
    return left.join(common.broadcast_small(found).alias("f"), F.col("l.d").eqNullSafe(F.col("f.doc_id")) & (F.col("l.t") == F.col("f.th")), how)


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row for each document with a repeated passage: ``doc_id``, ``longest``, ``spans`` and the ``text`` that stays.

    ``longest`` is the greatest of ``min_words``, twice, four times ... that long a window of it occurs at two places.
    ``spans`` are the word ranges removed, as ``start-stop`` with the stop left out; none where all passages occur here first.
    With words goes the white space before each, and that at the end of the text. The first place is that with the least ``doc_id`` (null before all), then text hash, then position.

    Null and empty texts, and those of fewer words than a passage, have no row. Rows alike in ``doc_id`` and text are
    one document, with one row. Very long texts are taken whole; the word hashes of one, 8 bytes each, have to fit into a task.
    Ids must be whole numbers. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    found = repeats(docs, min_words)
    spans, text = F.col("f.spans"), F.col("row.text")
    left = F.when(F.size(spans) > 0, _cut(text, spans)).otherwise(text)
    return _joined(docs, found, "inner").dropDuplicates(["d", "t"]).select(F.col("d").alias("doc_id"), "longest", _shown(spans).alias("spans"), left.alias("text"))


def remove(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with repeated passages removed from ``text`` but for their first place, and ``n_chars``, if there, set anew.

    A text that loses words loses the white space before each of them and that at its end; others stay as they are.
    Documents of which nothing stays are left out; all others stay, those with null or empty texts too. Rows alike in
    ``doc_id`` and text lose the same passages. Other columns pass through, whatever their names.
    """
    found = repeats(docs, min_words)
    text = F.when(F.size("spans") > 0, _cut(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    joined = _joined(docs, found, "left").select("row", text.alias("cut"), F.coalesce(F.size("spans") > 0, F.lit(False)).alias("changed"))
    columns = [
        F.col("cut").alias(c) if c == "text"
        else F.when(F.col("changed"), F.char_length("cut").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return joined.where("NOT changed OR cut <> ''").select(*columns)


def oracle_sql(min_words: int = 50, levels: int = 9) -> str:
    """DuckDB SQL for ``report``, with the doubling unrolled."""
    ctes = [
        r"w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, regexp_extract_all(text, '\s*\S+') AS t, text FROM documents)",
        f"a0 AS (SELECT doc_id, unnest(range(0, len(w) - {min_words - 1})) AS p, w FROM w WHERE len(w) >= {min_words})",
        f"b0 AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {min_words}], ' ')) AS h FROM a0)",
        "l0 AS (SELECT * FROM b0 QUALIFY count(*) OVER (PARTITION BY h) > 1)",
        "first AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS later FROM l0)",
        f"cut AS (SELECT DISTINCT doc_id, unnest(range(p, p + {min_words})) AS i FROM first WHERE later)",
        "runs AS (SELECT doc_id, min(i)::INTEGER AS start, (max(i) + 1)::INTEGER AS stop FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut) GROUP BY doc_id, g)",
        "spans AS (SELECT doc_id, string_agg(start || '-' || stop, ' ' ORDER BY start) AS spans FROM runs GROUP BY doc_id)",
        "gone AS (SELECT doc_id, list(i) AS gone FROM cut GROUP BY doc_id)",
    ]
    for k in range(1, levels + 1):
        ctes.append(f"l{k} AS (SELECT * FROM (SELECT x.doc_id, x.p, md5(x.h || y.h) AS h FROM l{k - 1} x JOIN l{k - 1} y ON x.doc_id = y.doc_id AND y.p = x.p + {min_words << (k - 1)}) QUALIFY count(*) OVER (PARTITION BY h) > 1)")
    union = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {min_words << k} AS l FROM l{k}" for k in range(levels + 1))
    ctes.append(f"top AS (SELECT doc_id, max(l)::INTEGER AS longest FROM ({union}) GROUP BY doc_id)")
    return "WITH " + ",\n".join(ctes) + """
        SELECT top.doc_id, longest, coalesce(spans, '') AS spans,
               CASE WHEN spans IS NULL THEN text ELSE array_to_string(list_filter(t, lambda x, i: NOT list_contains(gone, i - 1)), '') END AS text
        FROM top JOIN w USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN gone USING (doc_id)"""
