"""Quality rules as a short-circuit cascade ordered by rejection per cost (native).

The whole path is DataFrame functions.  :func:`text_statistics` computes the
exact base counts per row, without a shuffle: three-word windows are hashed
and, where some are equal, sorted with their positions inside the row; equal
neighbours mark repeated windows, so a text of n words costs O(n log n)
whatever it repeats.

:func:`order_rules` times each rule on a sample and measures the share it
rejects; :func:`cascade` evaluates rules in falling order of rejection per
cost and stops at the first that rejects.  The order changes the cost only:
a document is kept when no rule rejects it.

Edge cases: null, empty and blank texts have no words, count 0 everywhere and
fail the base rule; repeated rows are judged one by one; an empty table gives
an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatemeter.llm.common import SPACE_CLASS, staged, words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL predicate over text, words and the base counts; null means false."""

    name: str
    rejects: str


# Language-neutral rules: none looks for words of one language.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "10 * word_chars < 22 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * length(regexp_replace(text, '[^\\\\p{Lu}]+', ''))"
                     " > length(regexp_replace(text, '[^\\\\p{L}]+', ''))"),
    Rule("exclamations", "5 * regexp_count(text, '!') > n_words"),
    Rule("few_letters", r"5 * regexp_count(text, '[^\\x20\\x09-\\x0D]*\\p{L}[^\\x20\\x09-\\x0D]*') < 4 * n_words"),
    Rule("stutter", "5 * size(filter(words, (w, i) -> i > 0 and get(words, i - 1) = w)) > n_words"),
    Rule("cut_lines", "10 * size(filter(lines, l -> l rlike '([.][.][.]|…)$')) > 5 * n_lines"),
    Rule("bullets", "10 * size(filter(lines, l -> l rlike '^[\\\\x20\\\\x09]*[-•‣]')) > 9 * n_lines"),
)


def text_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus text, words, lines and the base counts of every row."""
    ids = [F.col(c) for c in keep]
    d = staged(docs, *ids, F.col(text).alias("text"), words(F.col(text)).alias("words"),
               F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"))
    w = F.col("words")
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    d = staged(d, *keep, "text", "words", "lines", windows.alias("windows"))
    # most texts repeat no window: only the others are sorted
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    d = staged(d, *keep, "text", "words", "lines", F.when(some, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    s = F.col("sorted")
    repeated = F.filter(F.transform(s, lambda x, k: F.when(
        F.get(s, k + 1)["h"].eqNullSafe(x["h"]) | F.get(s, k - 1)["h"].eqNullSafe(x["h"]), x["i"])),
        lambda i: i.isNotNull())
    d = staged(d, *keep, "text", "words", "lines", F.sort_array(repeated).alias("at"))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    return staged(
        d, *keep, "text", "words", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.char_length(F.array_join("words", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def order_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000,
                seed: int = 7, repeats: int = 4, runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, rejected share), best rejection per cost first.

    About ``sample_rows`` rows are drawn before their statistics are computed;
    cost and share are measured on those that the base rule passes, since only
    they enter the cascade.  Every rule judges the sample ``repeats`` times in a
    job, and the fastest of ``runs`` jobs less the fastest idle one is its cost.
    The sample decides only the order of evaluation, never a verdict.
    """
    n = docs.count()
    drawn = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / n) if n else 1.0, seed)
    sample = text_statistics(drawn, keep=()).where(~base_failed()).repartition(2).persist()
    try:
        rows = sample.count()
        again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def run(predicate: str) -> tuple[float, int]:
            began = time.perf_counter()
            hit = again.agg(F.count(F.when(F.expr(predicate), 1))).first()[0]
            return time.perf_counter() - began, hit

        def fastest(predicate: str) -> tuple[float, int]:
            return min(run(predicate) for _ in range(runs))

        run("false")
        idle, _ = fastest("false")
        measured = []
        for r in rules if rows else ():
            took, hit = fastest(r.rejects)
            measured.append((r, max(took - idle, 1e-4), hit / (rows * repeats)))
    finally:
        sample.unpersist()
    return sorted(measured or [(r, 1.0, 0.0) for r in rules], key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(rules: Sequence[Rule]) -> Column:
    """True when no rule rejects; later branches run only where earlier ones did not reject."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(F.coalesce(F.expr(r.rejects), F.lit(False)), F.lit(False)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
                rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row; base failures skip the cascade."""
    stats = text_statistics(docs, text, keep)
    ranked = [r for r, _, _ in order_rules(docs, text, rules, sample_rows)]
    return stats.select(*keep, "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"),
                        F.when(base_failed(), F.lit(False)).otherwise(cascade(ranked)).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).drop("text")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
), rep AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) >= 2
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), b AS (
  SELECT d.rid, doc_id, text, ws, ls, len(ws)::BIGINT AS n_words,
         coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(ls) AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR 10 * n_symbols > n_words
    OR 10 * word_chars < 22 * n_words
    OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > n_lines
    OR 2 * len(regexp_extract_all(coalesce(text, ''), '\p{Lu}')) > len(regexp_extract_all(coalesce(text, ''), '\p{L}'))
    OR 5 * len(regexp_extract_all(coalesce(text, ''), '!')) > n_words
    OR 5 * len(list_filter(ws, lambda w: regexp_matches(w, '\p{L}'))) < 4 * n_words
    OR 5 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > n_words
    OR 10 * len(list_filter(ls, lambda l: regexp_matches(l, '([.][.][.]|…)$'))) > 5 * n_lines
    OR 10 * len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09]*[-•‣]'))) > 9 * n_lines
  ) AS kept
FROM b
"""
