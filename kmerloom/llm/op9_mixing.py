"""Mixing sources to target weights, with DataFrame functions only.

Words are summed up per source, targets give each source a repetition rate, and a document is taken floor(rate) times plus
one more time with a probability equal to the fraction: if a hash of its id, as a number below 1, is below the fraction. The
texts are read twice and don't move; what is shuffled is a row for each source and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Sources up to which their table is broadcast (under 2 MB).
SMALL = 20_000


def n_words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def named(source: F.Column) -> F.Column:
    """Never null, and in the order of the sources but for the null one, which is `n`."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def draw(doc_id: F.Column, text: F.Column) -> F.Column:
    """A number from 0 to 1 that a hash of the id gives, or of the text where there is no id."""
    seed = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit("mix|"), seed).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 60))


def source_targets(base: DataFrame, share: float, most: float) -> DataFrame:
    """(_source, source_size, target, rate) of base(_source, _size): water-filling in closed form over one row per source.

    With sources ordered by most * size / weight, those up to some place are full and the others get the rest by weight.
    """
    by_source = base.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source") == "n", "_source")
    # one row per source: this is the table of sources, not of documents
    w = by_source.withColumn("at", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("at") - 1, F.lit(len(WEIGHTS))) + 1))
    full = F.col("source_size") * most
    fill = Window.orderBy(full / F.col("weight"), "at")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    w = w.withColumn("found", F.min(F.when(F.col("level") <= full / F.col("weight"), F.struct((full / F.col("weight")).alias("r"), "at", "level"))).over(everything))
    target = F.when(F.col("found").isNull(), full).otherwise(F.least(full, F.col("found.level") * F.col("weight")))
    w = w.withColumn("target", target)
    return w.select("_source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of these names begins with."""
    p = "_mix"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


def _with_copies(docs: DataFrame, share: float, most: float) -> tuple[DataFrame, str]:
    """docs with size, source_size, target and copies under the prefix that is returned too."""
    base = docs.select(named(F.col("source")).alias("_source"), n_words(F.col("text")).alias("_size"))
    targets, p = stored(source_targets(base, share, most)), free_prefix(docs.columns)
    targets = targets.select(*(F.col(c).alias(f"{p}_{c.strip('_')}") for c in targets.columns))
    # a row for each source; broadcast while that is small, so that texts needn't move
    targets = F.broadcast(targets) if targets.count() <= SMALL else targets
    d = docs.withColumn(f"{p}_source", named(F.col("source"))).withColumn(f"{p}_size", n_words(F.col("text"))).withColumn(f"{p}_u", draw(F.col("doc_id"), F.col("text")))
    whole = F.floor(f"{p}_rate")
    d = d.join(targets, f"{p}_source", "left")
    return d.withColumn(f"{p}_copies", whole + (F.col(f"{p}_u") < F.col(f"{p}_rate") - whole).cast("long")), p


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with size, source_size, target, and copies: how many times the mix takes each row.

    Sources in code point order, a null source last, weigh 5, 2, 1, 5, ... and share `share` times all words; targets
    stop at `most` times their source's words and the excess is shared again by weight. A document is a row; its size is
    its words, none for a null or blank text. Rows without doc_id are drawn by their text; rows that repeat an id, and
    null-id rows that repeat a text, get equal draws. A source without words has target 0. An empty table gives no rows.
    Other columns are carried; those with a name that the result adds are replaced.
    """
    d, p = _with_copies(docs, share, most)
    added = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in added]
    return d.select(*kept, *(F.col(f"{p}_{c}").alias(c) for c in added))


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the columns of docs.

    Nulls, blank texts, repeated rows and clashing names are as in `mixed`. An empty table gives no rows.
    """
    d, p = _with_copies(docs, share, most)
    return d.withColumn(f"{p}_copy", F.explode(F.array_repeat(F.lit(0), F.col(f"{p}_copies").cast("int")))).select(*docs.columns)


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
  FROM documents),
by_source AS (SELECT src, sum(size)::BIGINT AS source_size FROM base GROUP BY src),
numbered AS (SELECT *, row_number() OVER (ORDER BY src = 'n', src) AS pos FROM by_source),
weighed AS (SELECT *, [5, 2, 1][((pos - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS full_size FROM numbered),
filled AS (
  SELECT *, full_size / weight AS r,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY full_size / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
found AS (SELECT arg_min(level, nth) AS level FROM (SELECT level, row_number() OVER (ORDER BY r, pos) AS nth FROM filled WHERE level <= r)),
targets AS (SELECT src, source_size, coalesce(least(full_size, (SELECT level FROM found) * weight), full_size) AS target FROM filled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM base JOIN rated ON base.src = rated.src
"""
