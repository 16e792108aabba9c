"""URL filter: host and path rules first, then a character language-model ratio (native).

Rules name a host (with all its subdomains) and a path prefix; the longest that
fits decides.  URLs that no rule fits are judged by two smoothed variable-order
Markov models over characters, one of the URLs that rules allow and one of
those that rules block: Witten-Bell interpolation from trigrams over bigrams to
single characters.  A URL's score is the difference of the two log-likelihoods
per character; the cut is calibrated on the rule-decided URLs (the score bin
with the best balanced accuracy, the one nearest to zero among equals).

All of it is DataFrame functions.  Characters fold to 34 symbols, so the model
table has at most 34^3 rows whatever the corpus: it is broadcast on that bound.
URLs are grouped by folded string before they are cut into trigrams, and a
string's trigrams are summed where they are made.

Edge cases: a null URL or one without "://" has empty host and path, no rule
and score 0; with only one kind of rule-decided URL there is no ratio and what
is left is allowed; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatemeter.llm.common import staged, written


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES: tuple[UrlRule, ...] = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
                              UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 34  # a-z, 0 for digits, . / _ -, ? for the rest, ^ start, $ end
MODEL_ROWS = SYMBOLS ** 3
BINS = 100  # score bins per nat


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_fit(rules: Sequence[UrlRule], host: Column, path: Column, what: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(fits(r, host, path), F.lit(getattr(r, what))).otherwise(out)
    return out


def folded(host: Column, path: Column) -> Column:
    """The 32 inner symbols that the models see."""
    s = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "000000000")
    return F.regexp_replace(s, "[^a-z0./_-]", "?")


def trigrams(s: str) -> Column:
    return F.expr(f"transform(sequence(1, length({s}) + 1), i -> substring(concat('^^', {s}, '$'), i, 3))")


def model(counts: DataFrame) -> DataFrame:
    """(g, ratio): log P_allowed - log P_blocked of every trigram of the corpus.

    ``counts``: trigram g with its counts a (allowed) and b (blocked), zeros too.
    """
    c = counts.select("g", "a", "b", F.substring("g", 1, 2).alias("ctx"), F.substring("g", 2, 2).alias("two"),
                      F.substring("g", 2, 1).alias("mid"), F.substring("g", 3, 1).alias("one"))
    seen = lambda k: F.sum(F.when(F.col(k) > 0, 1).otherwise(0))
    one = c.groupBy("one").agg(F.sum("a").alias("a1"), F.sum("b").alias("b1"))
    total = c.groupBy(F.lit(1).alias("k")).agg(F.sum("a").alias("an"), F.sum("b").alias("bn"))
    one = one.withColumn("k", F.lit(1)).join(total, "k").drop("k")
    two = c.groupBy("two", "mid", "one").agg(F.sum("a").alias("a2"), F.sum("b").alias("b2"))
    mid = two.groupBy("mid").agg(F.sum("a2").alias("am"), F.sum("b2").alias("bm"), seen("a2").alias("at"),
                                 seen("b2").alias("bt"))
    ctx = c.groupBy("ctx").agg(F.sum("a").alias("ac"), F.sum("b").alias("bc"), seen("a").alias("as_"),
                               seen("b").alias("bs"))
    all_ = (c.join(ctx, "ctx").join(two.select("two", "a2", "b2"), "two").join(mid, "mid").join(one, "one"))

    def log_p(n3: str, nc: str, tc: str, n2: str, nm: str, tm: str, n1: str, n: str) -> Column:
        p1 = (F.col(n1) + 0.5) / (F.col(n) + 0.5 * SYMBOLS)
        # an unseen context hands over to the shorter one whole
        p2 = F.when(F.col(nm) > 0, (F.col(n2) + F.col(tm) * p1) / (F.col(nm) + F.col(tm))).otherwise(p1)
        return F.log(F.when(F.col(nc) > 0, (F.col(n3) + F.col(tc) * p2) / (F.col(nc) + F.col(tc))).otherwise(p2))

    return all_.select("g", (log_p("a", "ac", "as_", "a2", "am", "at", "a1", "an")
                             - log_p("b", "bc", "bs", "b2", "bm", "bt", "b1", "bn")).alias("ratio"))


def cut(scored: DataFrame) -> int | None:
    """Lowest score bin that is allowed: best balanced accuracy on (bin, a, b); None without both kinds."""
    bins = scored.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))  # few rows: bins of 0.01
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(1))
    t = bins.select("bin", F.sum("a").over(all_).alias("an"), F.sum("b").over(all_).alias("bn"),
                    F.sum("a").over(down).alias("right_a"), F.coalesce(F.sum("b").over(up), F.lit(0)).alias("right_b"))
    best = (t.where("an > 0 AND bn > 0")
            .orderBy(F.desc(F.col("right_a") * F.col("bn") + F.col("right_b") * F.col("an")), F.abs("bin"), "bin")
            .limit(1).collect())
    return best[0]["bin"] if best else None


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url",
          rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = parts(F.col(url))
    d = staged(pages, F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    d = d.select("page_id", "host", "path", first_fit(rules, h, p, "name").alias("rule"),
                 first_fit(rules, h, p, "verdict").alias("ruled"), folded(h, p).alias("s"))
    strings = written(d.groupBy("s").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("a"),
                                         F.count(F.when(F.col("ruled") == "block", 1)).alias("b")))
    cut_up = strings.select("s", "a", "b", F.explode(trigrams("s")).alias("g"))
    table = model(cut_up.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    # at most MODEL_ROWS rows of about 30 bytes: a little over a megabyte
    scores = (cut_up.join(F.broadcast(table), "g").groupBy("s", "a", "b").agg(F.avg("ratio").alias("score"))
              .select("s", "a", "b", F.when(F.length("s") == 0, F.lit(0))
                      .otherwise(F.floor(F.col("score") * BINS)).cast("int").alias("bin")))
    scores = written(scores)
    least = cut(scores)
    by_model = F.lit("allow") if least is None else F.when(F.col("bin") >= least, "allow").otherwise("block")
    return (d.join(scores.select("s", "bin"), "s")
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict")))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), d AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
                   '[^a-z0./_-]', '?', 'g') AS s FROM q
), s AS (
  SELECT s, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS a,
         count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS b FROM d GROUP BY s
), t AS (
  SELECT s, a, b, substr('^^' || s || '$', i, 3) AS g FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM s)
), c AS (
  SELECT g, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM t GROUP BY g
), n AS (
  SELECT g, a, b, substr(g, 1, 2) AS ctx, substr(g, 2, 2) AS two, substr(g, 2, 1) AS mid, substr(g, 3, 1) AS one,
    sum(a) OVER () AS an, sum(b) OVER () AS bn,
    sum(a) OVER (PARTITION BY substr(g, 3, 1)) AS a1, sum(b) OVER (PARTITION BY substr(g, 3, 1)) AS b1,
    sum(a) OVER (PARTITION BY substr(g, 2, 2)) AS a2, sum(b) OVER (PARTITION BY substr(g, 2, 2)) AS b2,
    sum(a) OVER (PARTITION BY substr(g, 2, 1)) AS am, sum(b) OVER (PARTITION BY substr(g, 2, 1)) AS bm,
    sum(a) OVER (PARTITION BY substr(g, 1, 2)) AS ac, sum(b) OVER (PARTITION BY substr(g, 1, 2)) AS bc,
    count(*) FILTER (a > 0) OVER (PARTITION BY substr(g, 1, 2)) AS as_,
    count(*) FILTER (b > 0) OVER (PARTITION BY substr(g, 1, 2)) AS bs FROM c
), m AS (
  SELECT mid, count(*) FILTER (a2 > 0) AS att, count(*) FILTER (b2 > 0) AS bt
  FROM (SELECT DISTINCT two, mid, a2, b2 FROM n) GROUP BY mid
), u AS (
  SELECT n.*, m.att, m.bt, (a1 + 0.5) / (an + 17.0) AS pa1, (b1 + 0.5) / (bn + 17.0) AS pb1 FROM n JOIN m USING (mid)
), v AS (
  SELECT *, CASE WHEN am > 0 THEN (a2 + att * pa1) / (am + att) ELSE pa1 END AS pa2,
            CASE WHEN bm > 0 THEN (b2 + bt * pb1) / (bm + bt) ELSE pb1 END AS pb2 FROM u
), r AS (
  SELECT g, ln(CASE WHEN ac > 0 THEN (a + as_ * pa2) / (ac + as_) ELSE pa2 END)
          - ln(CASE WHEN bc > 0 THEN (b + bs * pb2) / (bc + bs) ELSE pb2 END) AS ratio FROM v
), z AS (
  SELECT s, a, b, CASE WHEN s = '' THEN 0 ELSE floor(avg(ratio) * 100)::INT END AS bin
  FROM t JOIN r USING (g) GROUP BY s, a, b
), h AS (
  SELECT bin, sum(a) AS a, sum(b) AS b FROM z GROUP BY bin
), k AS (
  SELECT bin, sum(a) OVER () AS an, sum(b) OVER () AS bn,
    sum(a) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS ra,
    coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb FROM h
), best AS (
  SELECT bin FROM k WHERE an > 0 AND bn > 0 ORDER BY ra * bn + rb * an DESC, abs(bin), bin LIMIT 1
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN (SELECT bin FROM best) IS NULL OR z.bin >= (SELECT bin FROM best) THEN 'allow' ELSE 'block' END AS verdict
FROM d JOIN z USING (s)
"""
