"""URL filter by a ratio of character language models, with DataFrame functions only.

URLs that a rule allows or blocks train two Markov models of variable order: a character's probability given the two
before it is smoothed towards that given one, and that towards the character's own. A URL without a rule is judged by the
length-normalised difference of its log-likelihoods, against a threshold calibrated on the URLs with a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import cut, table

#: Characters of the models; all others are one more. The model has len(ALPHABET) + 1 cubed entries, whatever the table's size.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_"
SYMBOLS = len(ALPHABET) + 1
#: Weight of the shorter context, in observations.
BACKOFF = 4.0
#: Log-likelihood ratios are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, lower-cased in A-Z, and path; both empty for a null URL and one without `://`."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url").cast("string"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    d = d.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    line = F.translate(F.concat("host", "path"), UPPER, UPPER.lower())
    codes = F.transform(F.split(line, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    codes = F.when(F.length(line) > 0, codes).otherwise(F.array().cast("array<int>"))
    return d.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"), codes.alias("codes"))


def grams(codes: F.Column) -> F.Column:
    """For each place the number of its character and the two before it; before the first is symbol 0."""
    at = F.concat(F.array(F.lit(0), F.lit(0)), codes)
    return F.transform(codes, lambda c, i: F.get(at, i) * (SYMBOLS * SYMBOLS) + F.get(at, i + 1) * SYMBOLS + c)


def model(d: DataFrame) -> DataFrame:
    """One row with `ratio`, an array: for each gram the log-likelihood ratio of accepted to rejected, in millionths."""
    seen = d.filter("by_rule is not null").select("by_rule", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allow"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("block")
    )
    # a fixed number of rows from here on
    g = d.sparkSession.range(SYMBOLS**3).select(F.col("id").cast("int").alias("gram")).join(seen, "gram", "left").na.fill(0, ["allow", "block"])
    g = g.withColumn("c", F.col("gram") % SYMBOLS).withColumn("b", F.floor(F.col("gram") / SYMBOLS) % SYMBOLS).withColumn("a", F.floor(F.col("gram") / (SYMBOLS * SYMBOLS)))
    over = lambda *k: Window.partitionBy(*k)
    for x in ("allow", "block"):
        one = (F.sum(x).over(over("c")) + 1) / (F.sum(x).over(Window.partitionBy()) + SYMBOLS)
        two = (F.sum(x).over(over("b", "c")) + BACKOFF * one) / (F.sum(x).over(over("b")) + BACKOFF)
        g = g.withColumn(f"p_{x}", (F.col(x) + BACKOFF * two) / (F.sum(x).over(over("a", "b")) + BACKOFF))
    g = g.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("int").alias("r"))
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "r"))), lambda x: x["r"]).alias("ratio"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdict on each row of pages(page_id, url): (page_id, host, path, rule, verdict, score).

    score is the sum of the ratios over host and path by their length, in millionths, rounded down to thousandths; a URL
    without a rule is allowed at the threshold or above. The threshold has the largest sum of the share of allowed URLs at
    or above it and of blocked ones below it, the smallest of equals. Without URLs of both kinds everything is allowed.

    A null URL or one without `://` has empty host and path and score 0. Null ids and repeated rows are judged row by row.
    An empty table gives no rows. Other columns are not read.
    """
    d = judged(pages, rules)
    d = cut(d.withColumn("grams", grams(F.col("codes"))).drop("codes"))
    ratio = cut(model(d))
    scored = d.withColumn("ratio", ratio.scalar())
    total = F.aggregate(F.transform("grams", lambda x: F.get("ratio", x)), F.lit(0).cast("long"), lambda s, x: s + x)
    score = F.floor(total / F.greatest(F.size("grams"), F.lit(1)) / 1000).cast("long")
    scored = scored.select("page_id", "host", "path", "rule", "by_rule", score.alias("score"))
    shares = scored.filter("by_rule is not null").groupBy("score").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allow"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("block"))
    # one row per score in thousandths: their number is bounded by the models' smallest and largest ratio
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("score").rowsBetween(0, Window.unboundedFollowing)
    all_of = Window.partitionBy()
    gain = F.sum("allow").over(from_here) / F.nullif(F.sum("allow").over(all_of), F.lit(0)) + F.coalesce(F.sum("block").over(below), F.lit(0)) / F.nullif(F.sum("block").over(all_of), F.lit(0))
    best = shares.select("score", gain.alias("gain")).agg(F.min_by("score", F.struct((-F.col("gain")).alias("g"), "score")).alias("t"), F.max("gain").alias("gain"))
    threshold = best.select(F.when(F.col("gain").isNotNull(), F.col("t")).otherwise(-(2**62)).alias("t")).scalar()
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op5_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


ORACLE = r"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split_up AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, row_number() OVER () AS row_id, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM split_up),
known AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule,
  translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM ruled),
places AS (SELECT row_id, by_rule, line, unnest(range(1, length(line) + 1)) AS i FROM known),
coded AS (SELECT row_id, by_rule, i,
  instr('abcdefghijklmnopqrstuvwxyz0123456789/.-_', substr(line, i, 1)) AS c,
  CASE WHEN i > 1 THEN instr('abcdefghijklmnopqrstuvwxyz0123456789/.-_', substr(line, i - 1, 1)) ELSE 0 END AS b,
  CASE WHEN i > 2 THEN instr('abcdefghijklmnopqrstuvwxyz0123456789/.-_', substr(line, i - 2, 1)) ELSE 0 END AS a FROM places),
grams AS (SELECT row_id, by_rule, a * 1681 + b * 41 + c AS gram FROM coded),
seen AS (SELECT gram, count(*) FILTER (by_rule = 'allow') AS allow, count(*) FILTER (by_rule = 'block') AS block FROM grams WHERE by_rule IS NOT NULL GROUP BY gram),
grid AS (SELECT gram, gram // 1681 AS a, gram // 41 % 41 AS b, gram % 41 AS c, coalesce(allow, 0) AS allow, coalesce(block, 0) AS block
  FROM (SELECT unnest(range(68921)) AS gram) LEFT JOIN seen USING (gram)),
one AS (SELECT *, (sum(allow) OVER (PARTITION BY c) + 1)::DOUBLE / (sum(allow) OVER () + 41) AS a1, (sum(block) OVER (PARTITION BY c) + 1)::DOUBLE / (sum(block) OVER () + 41) AS b1 FROM grid),
two AS (SELECT *, (sum(allow) OVER (PARTITION BY b, c) + 4.0::DOUBLE * a1) / (sum(allow) OVER (PARTITION BY b) + 4.0::DOUBLE) AS a2,
  (sum(block) OVER (PARTITION BY b, c) + 4.0::DOUBLE * b1) / (sum(block) OVER (PARTITION BY b) + 4.0::DOUBLE) AS b2 FROM one),
three AS (SELECT gram, (allow + 4.0::DOUBLE * a2) / (sum(allow) OVER (PARTITION BY a, b) + 4.0::DOUBLE) AS pa,
  (block + 4.0::DOUBLE * b2) / (sum(block) OVER (PARTITION BY a, b) + 4.0::DOUBLE) AS pb FROM two),
ratio AS (SELECT gram, round((ln(pa) - ln(pb)) * 1000000)::BIGINT AS r FROM three),
sums AS (SELECT row_id, sum(r)::BIGINT AS total, count(*) AS n FROM grams JOIN ratio USING (gram) GROUP BY row_id),
scored AS (SELECT k.*, coalesce(floor(total::DOUBLE / n / 1000), 0)::BIGINT AS score FROM known k LEFT JOIN sums USING (row_id)),
shares AS (SELECT score, count(*) FILTER (by_rule = 'allow') AS allow, count(*) FILTER (by_rule = 'block') AS block FROM scored WHERE by_rule IS NOT NULL GROUP BY score),
gains AS (SELECT score, sum(allow) OVER (ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE / nullif(sum(allow) OVER (), 0)
  + coalesce(sum(block) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / nullif(sum(block) OVER (), 0) AS gain FROM shares),
best AS (SELECT score FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, score LIMIT 1)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= coalesce((SELECT score FROM best), -4611686018427387904) THEN 'allow' ELSE 'block' END) AS verdict, score FROM scored
"""
