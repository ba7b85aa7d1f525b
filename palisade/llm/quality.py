"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import common

#: Words over which the share of distinct ones is taken: as many as the longest of the given documents has.
BLOCK_WORDS = 20_000


#: Letters of scripts that are written without spaces: Thai to Tibetan, Myanmar, Khmer, kana, Han and their extensions.
UNSPACED = "\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U000323AF"
WORDS = r"array_remove(split(text, '\\s+'), '')"
JOINED = "array_join(w, '')"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL expression over the column ``text``, or over its words ``w`` and their letters in one piece ``j`` too.

    True or null means that the rule rejects.
    """

    name: str
    rejects: str

    @property
    def over_words(self) -> bool:
        return re.search(r"\b[wj]\b", self.rejects) is not None


def production_rules(
    mean_word: tuple[float, float] = (3.0, 10.0),
    max_symbols: float = 0.05,
    max_upper: float = 0.3,
    max_wordlike_gap: float = 0.2,
    min_distinct: float = 0.3,
    max_repeated_lines: float = 0.3,
    max_word_chars: int = 1000,
    block_words: int = BLOCK_WORDS,
) -> list[Rule]:
    """The production rules.

    Shares carry an absolute allowance, so that one odd word doesn't condemn a document of three words. There is no
    lower bound on words beyond one: the labelled documents of one or two words are good ones. There is no upper one
    either. The share of distinct words falls with the length of any prose, so it is taken over consecutive blocks of
    ``block_words`` words, the last as long as it is, and weighs each by its words. Letters of scripts without spaces don't
    make a word giant, and where they are half of a text or more, its mean word says nothing.
    """
    # A count of characters of some kind is what is lost with them: runs go in one piece, and most texts have few.
    lost = lambda kind: f"(char_length(text) - char_length(regexp_replace(text, '{kind}+', '')))"
    only = lambda kind: rf"char_length(regexp_replace(j, '\\P{{{kind}}}+', ''))"
    distinct = f"aggregate(sequence(1, greatest(size(w), 1), {block_words}), 0, (n, i) -> n + size(array_distinct(slice(w, i, {block_words}))))"
    return [
        Rule("no_words", r"NOT text RLIKE '\\S'"),
        # Few words have so many bytes; only their texts are searched for a run of so many characters.
        Rule("giant_word", rf"exists(w, x -> octet_length(x) > {max_word_chars}) AND text RLIKE '[^\\s{UNSPACED}]{{{max_word_chars + 1}}}'"),
        Rule(
            "word_length",
            f"size(w) >= 10 AND (char_length(j) < {mean_word[0]}D * size(w) OR char_length(j) > {mean_word[1]}D * size(w)) AND 2 * {lost(f'[{UNSPACED}]')} < char_length(j)",
        ),
        Rule("symbols", f"{lost('[#$%&*|~^<>{}=+@_]')} > {max_symbols}D * char_length(text) + 2"),
        Rule("capitals", f"{only('Lu')} > {max_upper}D * {only('L')} + 5"),
        Rule("no_letters", rf"size(filter(w, x -> NOT x RLIKE '\\p{{L}}')) > {max_wordlike_gap}D * size(w) + 3"),
        Rule("repeated_words", f"size(w) >= 20 AND {distinct} < {min_distinct}D * size(w)"),
        Rule(
            "repeated_lines",
            "transform(array(array_remove(split(text, '\\n'), '')), l -> size(l) - size(array_distinct(l))"
            rf" > {max_repeated_lines}D * size(l) + 2)[0]",
        ),
    ]


@dataclass(frozen=True)
class Estimate:
    """Seconds and share of rejections of one rule on the sample; ``seconds`` are without those of making the words."""

    rule: Rule
    seconds: float
    rejected: float
    words_seconds: float = 0.0

    def rank(self, words_made: bool) -> float:
        """Rejections per second, at the point where the words are made already or not."""
        return self.rejected / max(self.seconds + (0.0 if words_made or not self.rule.over_words else self.words_seconds), 1e-9)


def _sample(docs: DataFrame, rows: int, files: int) -> DataFrame:
    """Some rows for the estimates: from a few evenly spread files where ``docs`` is read from files, so that the rest stays unread."""
    texts = docs.select("text")
    names = sorted(docs.inputFiles())
    if len(names) > files and all(n.endswith(".parquet") for n in names):
        chosen = [names[i * len(names) // files] for i in range(files)]
        texts = docs.sparkSession.read.schema(texts.schema).parquet(*chosen)
    return texts.limit(rows)


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000, sample_files: int = 4) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample_rows`` documents.

    Only the order of the rules depends on it, never a decision. The sample is kept by Spark's cache, which is
    recomputed where an executor is lost.
    """
    sample = _sample(docs, sample_rows, sample_files).withColumn("w", F.expr(WORDS)).withColumn("j", F.expr(JOINED)).cache()
    try:
        n = sample.count()
        if not n:
            return [Estimate(r, 0.0, 0.0) for r in rules]

        def timed(column: Column) -> tuple[float, int]:
            frame = sample.agg(F.count_if(column).alias("n"))
            frame.first()
            began = time.perf_counter()
            hits = frame.first()["n"]
            return time.perf_counter() - began, hits

        floor, _ = timed(F.col("text").isNull())
        words, _ = timed(F.expr(f"transform(array({WORDS}), w -> {JOINED})[0] = ''")) if any(r.over_words for r in rules) else (floor, 0)
        out = []
        for rule in rules:
            took, hits = timed(F.coalesce(F.expr(rule.rejects), F.lit(True)))
            out.append(Estimate(rule, max(took - floor, 1e-4) / n, hits / n, max(words - floor, 1e-4) / n))
        return out
    finally:
        sample.unpersist()


def order_rules(estimates: Sequence[Estimate]) -> list[Rule]:
    """Rules by falling rejection per second, each time the best of those that are left; ties keep the given order.

    The first rule over the words bears the cost of making them, the later ones don't.
    """
    left, out = list(estimates), []
    while left:
        made = any(r.over_words for r in out)
        best = max(left, key=lambda e: e.rank(made))
        left.remove(best)
        out.append(best.rule)
    return out


def cascade(rules: Sequence[Rule]) -> Column:
    """Whether any rule rejects; a null text is rejected. CASE branches are evaluated in turn and stop at the first hit.

    From the first rule over the words on, the rest is a function of the words, which are made once and only then.
    """
    first = next((i for i, r in enumerate(rules) if r.over_words), len(rules))
    case = lambda some, rest: "CASE " + "".join(f"WHEN coalesce({r.rejects}, true) THEN true " for r in some) + f"ELSE {rest} END" if some else rest
    over = f"transform(array({WORDS}), w -> transform(array({JOINED}), j -> {case(rules[first:], 'false')})[0])[0]" if first < len(rules) else "false"
    return F.expr(case(rules[:first], over))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the column ``keep``; a column of that name is replaced.

    Null and empty texts are rejected. Every row is judged by itself, so repeated rows get the same answer and ties
    can't arise; very long texts are judged whole; other columns pass through; an empty table stays empty. The answer doesn't depend on the order found.
    """
    rules = list(rules if rules is not None else production_rules())
    ordered = order_rules(estimate(docs, rules, sample_rows))
    return common.spread(docs).withColumn("keep", ~cascade(ordered))


def filter_documents(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``; nulls and ties as in ``judge``."""
    rules = list(rules if rules is not None else production_rules())
    ordered = order_rules(estimate(docs, rules, sample_rows))
    return common.spread(docs).where(~cascade(ordered))


#: The same rules in DuckDB; the order doesn't matter there.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS l FROM documents),
m AS (
    SELECT doc_id, text, length(text) AS chars, len(w) AS words,
           length(regexp_replace(text, '\s', '', 'g')) AS inked,
           length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
           length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals,
           length(text) - length(regexp_replace(text, '[#$%&*|~^<>{}=+@_]', '', 'g')) AS symbols,
           length(text) - length(regexp_replace(text, '[\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]', '', 'g')) AS unspaced,
           len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare,
           list_sum(list_transform(range(1, len(w) + 1, 20000), lambda i: len(list_distinct(w[i : i + 19999])))) AS distinct_words,
           len(l) AS lines, len(list_distinct(l)) AS distinct_lines
    FROM w)
SELECT doc_id, coalesce(NOT (words = 0
    OR regexp_matches(text, '[^\s\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]{1000}[^\s\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]')
    OR (words >= 10 AND (inked < 3 * words OR inked > 10 * words) AND 2 * unspaced < inked)
    OR symbols > 0.05::DOUBLE * chars + 2 OR capitals > 0.3::DOUBLE * letters + 5 OR bare > 0.2::DOUBLE * words + 3
    OR (words >= 20 AND distinct_words < 0.3::DOUBLE * words) OR lines - distinct_lines > 0.3::DOUBLE * lines + 2), false) AS keep
FROM m
"""
