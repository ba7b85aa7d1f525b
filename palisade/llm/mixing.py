"""Mixing sources to target weights by entropy balancing.

The rate of a document is exp(a_source + b_lang + c z), where z is its standardised log length. The exponents maximise the
dual of: the rates least far from 1 in relative entropy, a token each, that meet the token targets of the sources and of
the languages and keep the token-weighted mean of z. Each Newton iteration sums tokens, gradient and curvature over the
written table of (source, lang, length) counts, in one distributed pass. The driver solves for the step: every document has
one source, so the sources' part of the curvature is diagonal and is eliminated, which leaves a dense system of the languages
alone. Rates are rounded into copies by a hash of the document, so that the expected copies are the rate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import common


@dataclass(frozen=True)
class Solution:
    """The exponents: by source and language where both occur together, for z; and how z is standardised."""

    cells: list[tuple[str | None, str | None, float]]
    slope: float
    center: float
    scale: float
    iterations: int
    residual: float


#: Cells (sources and languages that occur together) up to which their exponents are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Cells that the driver takes; with more it refuses before it collects them.
MOST_CELLS = 5_000_000


def _small(cells: DataFrame, count: int) -> DataFrame:
    return F.broadcast(cells) if count <= BROADCAST_CELLS else cells


def tokens(text: Column) -> Column:
    """Words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def tempered(present: Mapping[str | None, float], alpha: float) -> dict[str | None, float]:
    """Shares in proportion to ``present`` raised to ``alpha``: 1 keeps them, 0 makes them equal."""
    powers = {k: v**alpha for k, v in present.items() if v > 0}
    return {k: v / sum(powers.values()) for k, v in powers.items()}


def _shares(present: dict, weights: Mapping | None, alpha: float) -> dict:
    if weights is None:
        return tempered(present, alpha)
    used = {k: float(weights[k]) for k, v in present.items() if v > 0 and weights.get(k, 0) > 0}
    return {k: v / sum(used.values()) for k, v in used.items()}


def solve(counts: DataFrame, source_weights: Mapping | None, source_alpha: float, lang_alpha: float, epochs: float, tolerance: float = 1e-8, max_iterations: int = 40) -> Solution | None:
    """Newton iterations on the dual over ``counts`` (source, lang, n, docs); None where there is nothing to mix.

    A slight ridge keeps the dual strictly concave, so that targets that can't all be met have a defined answer too.
    """
    spark = counts.sparkSession
    if source_weights is not None:
        wanted = spark.createDataFrame([(k,) for k, v in source_weights.items() if v > 0], "wanted string")
        counts = counts.join(wanted, F.col("source").eqNullSafe(F.col("wanted")), "left_semi")
    mass = F.col("n") * F.col("docs").cast("double")
    ln = F.log("n")
    first = counts.groupBy("source", "lang").agg(F.sum(mass).alias("t"), F.sum(mass * ln).alias("u"), F.sum(mass * ln * ln).alias("v")).limit(MOST_CELLS + 1).collect()
    if len(first) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of source and language; mix coarser sources")
    if not first:
        return None
    total = sum(r["t"] for r in first)
    center = sum(r["u"] for r in first) / total
    scale = math.sqrt(max(sum(r["v"] for r in first) / total - center**2, 0.0)) or 1.0
    present_s: dict = {}
    present_l: dict = {}
    for r in first:
        present_s[r["source"]] = present_s.get(r["source"], 0.0) + r["t"]
        present_l[r["lang"]] = present_l.get(r["lang"], 0.0) + r["t"]
    share_s, share_l = _shares(present_s, source_weights, source_alpha), tempered(present_l, lang_alpha)
    sources, langs = list(share_s), list(share_l)
    at_s, at_l = {k: i for i, k in enumerate(sources)}, {k: i for i, k in enumerate(langs)}
    place = {(r["source"], r["lang"]): k for k, r in enumerate(first)}
    i, j = np.array([at_s[r["source"]] for r in first]), np.array([at_l[r["lang"]] for r in first])
    n_s, n_l = len(sources), len(langs)
    target_s, target_r = np.array([share_s[k] * epochs for k in sources]), np.array([share_l[k] * epochs for k in langs] + [0.0])
    ridge = 1e-10
    z = (ln - center) / scale

    def cells(x: np.ndarray, r: np.ndarray) -> list[tuple]:
        return [(c["source"], c["lang"], e) for c, e in zip(first, (x[i] + r[j]).tolist(), strict=True)]

    def evaluate(x: np.ndarray, r: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual's value, its gradient by sources and by the rest, and tokens, first and second moment of the cells: one pass over the counts."""
        exponents = _small(spark.createDataFrame(cells(x, r), "s string, l string, e double"), len(first))
        w = mass * F.exp(F.col("e") + float(r[-1]) * z) / total
        sums = (
            counts.join(exponents, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
            .groupBy("source", "lang").agg(F.sum(w).alias("a"), F.sum(w * z).alias("b"), F.sum(w * z * z).alias("c")).collect()
        )
        moments = np.zeros((3, len(first)))
        for row in sums:
            moments[:, place[row["source"], row["lang"]]] = row["a"], row["b"], row["c"]
        a, b, _ = moments
        value = float(target_s @ x + target_r @ r - a.sum() - ridge / 2 * (x @ x + r @ r))
        slope_s = target_s - np.bincount(i, a, n_s) - ridge * x
        slope_r = target_r - np.append(np.bincount(j, a, n_l), b.sum()) - ridge * r
        return value, slope_s, slope_r, moments

    def step(slope_s: np.ndarray, slope_r: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Newton's step, by the Schur complement of the sources."""
        a, b, c = moments
        inverse = 1.0 / (np.bincount(i, a, n_s) + ridge)
        rest = np.diag(np.append(np.bincount(j, a, n_l), c.sum()) + ridge)
        rest[:n_l, -1] = rest[-1, :n_l] = np.bincount(j, b, n_l)
        right = slope_r.copy()
        order = np.argsort(i, kind="stable")
        for low in range(0, n_s, 4096):
            mine = order[np.searchsorted(i[order], low) : np.searchsorted(i[order], low + 4096)]
            part = np.zeros((min(4096, n_s - low), n_l + 1))
            np.add.at(part, (i[mine] - low, j[mine]), a[mine])
            np.add.at(part, (i[mine] - low, -1), b[mine])
            scaled = part * inverse[low : low + 4096, None]
            rest -= part.T @ scaled
            right -= scaled.T @ slope_s[low : low + 4096]
        found = np.linalg.lstsq(rest, right, rcond=1e-13)[0]
        across = np.bincount(i, a * found[j] + b * found[-1], n_s)
        return inverse * (slope_s - across), found

    x, r = np.array([math.log(share_s[k] * epochs * total / present_s[k]) for k in sources]), np.zeros(n_l + 1)
    value, slope_s, slope_r, moments = evaluate(x, r)
    residual = lambda: max(np.abs(slope_s).max(), np.abs(slope_r).max())
    rounds = 0
    while rounds < max_iterations and residual() > tolerance * epochs:
        d_s, d_r = step(slope_s, slope_r, moments)
        length = max(np.abs(d_s).max(), np.abs(d_r).max())
        share = min(1.0, 4.0 / max(length, 1e-300))
        rounds += 1
        while True:
            trial = evaluate(x + share * d_s, r + share * d_r)
            if trial[0] >= value - 1e-13 or share * length < 1e-12:
                break
            share /= 2
        x, r = x + share * d_s, r + share * d_r
        value, slope_s, slope_r, moments = trial
    return Solution(cells(x, r), float(r[-1]), center, scale, rounds, float(residual()))


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _rated(docs: DataFrame, source_weights: Mapping | None, source_alpha: float, lang_alpha: float, epochs: float, seed: int) -> DataFrame:
    if epochs <= 0:
        raise ValueError("epochs must be positive")
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("source").alias("source"), F.col("lang").alias("lang"), tokens(F.col("text")).alias("n"))
    counts = common.materialize(rows.where("n > 0").groupBy("source", "lang", "n").agg(F.count("*").alias("docs")), "counts")
    found = solve(counts, source_weights, source_alpha, lang_alpha, epochs)
    common.discard(counts)
    cells = found.cells if found else []
    exponents = _small(spark.createDataFrame(cells, "s string, l string, e double"), len(cells))
    center, scale, slope = (found.center, found.scale, found.slope) if found else (0.0, 1.0, 0.0)
    joined = rows.join(exponents, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")), "left")
    tilted = F.coalesce(F.exp(F.col("e") + slope * (F.log("n") - center) / scale), F.lit(0.0))
    rated = joined.select("row", "source", "lang", "n", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(tilted).alias("rate"))
    extra = uniform(seed, F.col("row.doc_id"), F.col("row.text")) < F.col("rate") - F.floor("rate")
    return rated.withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("int"))


def rates(docs: DataFrame, source_weights: Mapping | None = None, source_alpha: float = 0.8, lang_alpha: float = 0.9, epochs: float = 1.5, seed: int = 17) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``n_tokens``, ``rate`` and ``copies`` of every document.

    The tokens of all copies are expected to be ``epochs`` times those of ``docs``, shared among the sources as
    ``source_weights`` say (without them, by their tokens to the power ``source_alpha``) and among the languages by their
    tokens to the power ``lang_alpha``. Weights of absent sources are shared out among the others; sources without a weight
    get rate 0. A null source or language is one of its own. Null and empty texts have no tokens and stay once, at rate 1.
    Repeated rows get the same copies; very long texts are counted whole; other columns are ignored, whatever their names; an
    empty table gives no rows. The driver holds a row for each source and language that occur together, and refuses to go on
    beyond ``MOST_CELLS`` of them; languages are thought of as at most some thousands.
    """
    rated = _rated(docs, source_weights, source_alpha, lang_alpha, epochs, seed)
    return rated.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", F.col("n").alias("n_tokens"), "rate", "copies")


def mix(docs: DataFrame, source_weights: Mapping | None = None, source_alpha: float = 0.8, lang_alpha: float = 0.9, epochs: float = 1.5, seed: int = 17) -> DataFrame:
    """``docs`` with every row as often as its copies say; parameters and special cases as in ``rates``."""
    rated = _rated(docs, source_weights, source_alpha, lang_alpha, epochs, seed)
    return rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
