"""URL filters by a temporal list join: dated entries become validity intervals, captures are judged as of their fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators import relational

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::\d+)?([^?#]*)"


def _bare(host: Column) -> Column:
    """A host in lower case without the dots that may end it."""
    return F.rtrim(F.lower(host), F.lit("."))


def host(url: Column) -> Column:
    """The host in lower case, without a dot at its end; null where there is none. An IPv6 address keeps its brackets."""
    found = _bare(F.regexp_extract(url, _URL, 1))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (``kind``, ``key``, ``event``, ``action``, ``day``) as intervals (``kind``, ``key``, ``action``, ``since``, ``until``).

    An event holds until the key's next one; ``add`` makes its ``action`` (block or allow) apply, ``remove`` nothing. Of
    events of one day the last in the order remove, add allow, add block holds. Nulls in kind, key or day void an entry;
    repeated entries count once. Hosts count in lower case and without dots at their end, domains without dots or a ``*.``
    before them either, prefixes without slashes at their end. ``until`` is null for the last.
    """
    rank = F.when(F.col("event") == "remove", 0).when(F.col("action") == "allow", 1).otherwise(2)
    valid = entries.where("kind IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND event IN ('add', 'remove')")
    start = F.substring_index("key", "/", 1)
    rest = F.expr("substr(key, char_length(substring_index(key, '/', 1)) + 1)")
    key = F.when(F.col("kind") == "prefix", F.concat(_bare(start), F.rtrim(rest, F.lit("/")))).when(F.col("kind") == "domain", F.ltrim(_bare(F.col("key")), F.lit("*."))).otherwise(_bare(F.col("key")))
    valid = valid.withColumn("key", key)
    daily = valid.groupBy("kind", "key", "day").agg(F.max(rank).alias("rank"))
    following = F.lead("day").over(Window.partitionBy("kind", "key").orderBy("day"))
    return daily.withColumn("until", following).where("rank > 0").select(
        "kind", "key", F.when(F.col("rank") == 1, "allow").otherwise("block").alias("action"), F.col("day").alias("since"), "until"
    )


def keys(url: Column) -> Column:
    """All (kind, key) that an entry may name to reach ``url``: the domains up to the last label, the host, and the host with none to all leading path parts."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.concat(F.array(h), F.slice(parts, F.lit(1), i)), "/"))
    tagged = lambda kind, rank, values: F.transform(values, lambda k: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), k.alias("key")))
    return F.concat(tagged("domain", 1, domains), tagged("host", 2, F.array(h)), tagged("prefix", 3, prefixes))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (``url``, ``day`` and others) with ``action``, ``matched`` (kind:key) and ``blocked``.

    The most specific entry active on the day decides: prefixes before hosts before domains, longer keys before shorter
    ones. Where none is active, or ``url`` or ``day`` is null or the url has no host, action and matched are null and
    blocked is false. Every capture keeps its row, repeated ones too; other columns pass through unless they bear the new
    names. Empty captures give no rows, empty entries block nothing.

    What captures ask is made distinct by key and day first, so a host that a third of all captures bear asks once a day. The
    as-of join sorts questions and intervals of a key together and carries the last interval forward: no pairs arise. Days may
    be dates or timestamps; with timestamps the questions of one key are as many as its distinct times. A url's keys grow
    with its path's parts, however long it is.
    """
    active = intervals(entries)
    asked = captures.select("url", "day").where(host(F.col("url")).isNotNull() & F.col("day").isNotNull())
    wanted = asked.select("url", "day", F.explode(keys(F.col("url"))).alias("k")).select("url", "day", "k.*")
    asof = relational.asof_join(wanted.select("kind", "key", "day").distinct(), active.select("kind", "key", "since", "until", "action"), ["kind", "key"], "day", "since")
    answers = asof.where("right_until IS NULL OR day < right_until").select("kind", "key", "day", F.col("right_action").alias("action"))
    hits = wanted.alias("w").join(answers.alias("a"), (F.col("w.kind") == F.col("a.kind")) & (F.col("w.key") == F.col("a.key")) & (F.col("w.day") == F.col("a.day")))
    best = hits.groupBy(F.col("w.url").alias("u"), F.col("w.day").alias("d")).agg(
        F.max(F.struct("rank", F.char_length("w.key").alias("size"), F.concat("w.kind", F.lit(":"), "w.key").alias("matched"), "action")).alias("best")
    )
    new = {"action", "matched", "blocked"}
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row")
    joined = captures.select(row).join(best, (F.col("row.url") == F.col("u")) & (F.col("row.day") == F.col("d")), "left")
    others = [F.col(f"row.`{c}`") for c in captures.columns if c.lower() not in new]
    return joined.select(*others, F.col("best.action").alias("action"), F.col("best.matched").alias("matched"), F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"))


def derived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries made of ``pages``, which has neither days nor a list.

    Every page is a capture on a day that follows from its id, and gives the list one event on its domain, host or
    first path part. So the list grows with the pages.
    """
    day = lambda factor: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * factor, F.lit(365)).cast("int"))
    captures = pages.select("page_id", "url", day(101).alias("day"))
    h = host(F.col("url"))
    turn = F.pmod(F.col("page_id"), F.lit(3))
    entries = pages.select(
        F.when(turn == 0, "domain").when(turn == 1, "host").otherwise("prefix").alias("kind"),
        F.when(turn == 0, F.regexp_replace(h, r"^(www|m|blog)\.", "")).when(turn == 1, h).otherwise(F.concat(h, F.regexp_extract(path(F.col("url")), "^(/[^/]*)", 1))).alias("key"),
        F.when(F.pmod(F.col("page_id"), F.lit(4)) == 3, "remove").otherwise("add").alias("event"),
        F.when(F.pmod(F.col("page_id"), F.lit(5)) == 0, "allow").otherwise("block").alias("action"),
        day(37).alias("day"),
    )
    return captures, entries


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 101 % 365)::INTEGER AS day, DATE '2024-01-01' + (page_id * 37 % 365)::INTEGER AS listed,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)', 1)) AS h,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)', 2) AS q FROM pages),
e AS (SELECT CASE page_id % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'host' ELSE 'prefix' END AS kind,
        CASE page_id % 3 WHEN 0 THEN regexp_replace(h, '^(www|m|blog)\.', '') WHEN 1 THEN h ELSE h || regexp_extract(q, '^(/[^/]*)', 1) END AS key,
        CASE WHEN page_id % 4 = 3 THEN 0 WHEN page_id % 5 = 0 THEN 1 ELSE 2 END AS rank, listed FROM p),
d AS (SELECT kind, key, listed, max(rank) AS rank FROM e GROUP BY ALL),
i AS (SELECT *, lead(listed) OVER (PARTITION BY kind, key ORDER BY listed) AS until FROM d),
a AS (SELECT * FROM i WHERE rank > 0),
hits AS (SELECT page_id, a.kind, a.key, a.rank, row_number() OVER (PARTITION BY page_id ORDER BY
            CASE a.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(a.key) DESC, a.kind || ':' || a.key DESC) AS r
         FROM p JOIN a ON p.day >= a.listed AND (a.until IS NULL OR p.day < a.until) AND (
            (a.kind = 'host' AND a.key = p.h) OR (a.kind = 'domain' AND (p.h = a.key OR ends_with(p.h, '.' || a.key)))
            OR (a.kind = 'prefix' AND starts_with(p.h || rtrim(p.q, '/') || '/', a.key || '/'))))
SELECT p.page_id, p.url, strftime(p.day, '%Y-%m-%d') AS day, CASE hits.rank WHEN 1 THEN 'allow' WHEN 2 THEN 'block' END AS action,
       hits.kind || ':' || hits.key AS matched, coalesce(hits.rank = 2, false) AS blocked
FROM p LEFT JOIN hits ON p.page_id = hits.page_id AND r = 1
"""
