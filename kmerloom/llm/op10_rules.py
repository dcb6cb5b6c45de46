"""Quality rules as weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns estimates how often each
rule is right on good and on bad documents, and a document's posterior probability of being good replaces the demand that
all rules pass. The patterns are at most 3 to the number of rules, whatever the table's size; only their counts reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import coded, cut, pieces_of, split_words, sums, table, text_batches, tidied, utf8

SYMBOLS = "#*$%&|<>"
#: Rules: the measure, votes bad outside the first range, good inside the second, if there is one; otherwise it abstains.
RULES = (
    ("symbol_share", (-1.0, 0.05), None),
    ("dup_line_share", (-1.0, 0.3), None),
    ("repeat_share", (-1.0, 0.15), None),
    ("capital_share", (-1.0, 0.3), None),
    ("mark_share", (-1.0, 0.5), None),
    ("mean_word", (2.0, 14.0), (3.0, 10.0)),
    ("n_words", (10.0, np.inf), (40.0, np.inf)),
    ("letter_share", (0.75, 1.0), (0.93, 1.0)),
    ("plain_share", (0.55, 1.0), (0.9, 1.0)),
)
PLAIN = "^[^\\x00-@\\[-`{-\\x7f]+[.,;:!?)\"']*$"
WINDOW = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of whole texts, by text. Words are runs of characters other than ASCII white space."""
    n = len(texts)
    words, starts = split_words(texts)
    n_words = np.diff(starts)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data, at = utf8(texts)
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in SYMBOLS]] = True
    capital = np.zeros(256, bool)
    capital[65:91] = True
    other = np.zeros(256, bool)
    other[[ord("!"), ord("?")]] = True

    letter = capital.copy()
    letter[97:123] = letter[128:] = True
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True

    # lines
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lines, of = lists.flatten(), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    filled = pc.match_substring_regex(lines, "[^ \\t\\n\\x0b\\x0c\\r]").to_numpy(zero_copy_only=False)
    code, _ = coded(lines)
    key = (of * (int(code.max()) + 1 if len(code) else 1) + code)[filled]
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), np.int64)
    again[first] = 0
    n_dup = np.bincount(of[filled], weights=again, minlength=n).astype(np.int64)
    n_lines = np.bincount(of[filled], minlength=n)

    # words in windows that occur twice or more in their text
    code, distinct = coded(words)
    plain = pc.match_substring_regex(distinct, PLAIN).to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else code
    row = np.repeat(np.arange(n, dtype=np.uint64), n_words)
    code = code.astype(np.uint64)
    many = len(code)
    repeat = np.zeros(many, np.int64)
    if many >= WINDOW:
        h = code[: many - WINDOW + 1] * MIX
        for i in range(1, WINDOW):
            h ^= h >> np.uint64(31)
            h += code[i : many - WINDOW + 1 + i]
            h *= MIX
        h ^= row[: len(h)] * np.uint64(0xD6E8FEB86659FD93)
        whole = np.flatnonzero(row[: len(h)] == row[WINDOW - 1 :])
        h = h[whole]
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            hit = whole[twice[place] == h]
            edge = np.zeros(many + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            repeat = (np.cumsum(edge)[:-1] > 0).astype(np.int64)
    out = {
        "n_words": n_words,
        "word_chars": sums(lengths, starts),
        "n_symbols": sums(marks[data], at),
        "n_dup_lines": n_dup,
        "n_repeat_words": sums(repeat, starts),
    }
    letters, some = np.maximum(out["word_chars"], 1), np.maximum(n_words, 1)
    out["symbol_share"] = out["n_symbols"] / letters
    out["dup_line_share"] = n_dup / np.maximum(n_lines, 1)
    out["repeat_share"] = out["n_repeat_words"] / some
    out["capital_share"] = sums(capital[data], at) / letters
    out["mark_share"] = sums(other[data], at) / some
    out["letter_share"] = sums(letter[data], at) / np.maximum(sums(~blank[data], at), 1)
    out["plain_share"] = sums(plain, starts) / some
    out["mean_word"] = out["word_chars"] / some
    pattern = np.zeros(n, np.int64)
    for name, (low, high), good in RULES:
        x = out[name]
        within = (x >= good[0]) & (x <= good[1]) if good else np.zeros(n, bool)
        vote = np.where((x < low) | (x > high), 0, np.where(within, 2, 1))
        pattern = pattern * 3 + vote
    out["pattern"] = pattern
    return out


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def votes_of(pattern: int) -> list[int]:
    """-1 bad, 0 abstains, 1 good, by rule."""
    return [pattern // 3 ** (len(RULES) - 1 - i) % 3 - 1 for i in range(len(RULES))]


def fit(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """The posterior probability of being good for each vote pattern, from the patterns' counts.

    Good and bad documents each have, for every rule, probabilities of its three outcomes. They start where a bad vote is
    right more often than not (0.5 among bad, 0.02 among good documents) and a good vote a little so; the share of good
    documents starts at 0.8. Two imagined documents keep estimates off 0 and 1. A rule's bad votes stay at least twice as
    frequent among bad documents, which ties the two classes to the votes' names.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    seen = np.eye(3)[np.array([votes_of(p) for p in patterns]) + 1]
    start = np.array([[0.5, 0.25, 0.25], [0.02, 0.53, 0.45]])  # bad, good documents: votes bad, abstains, votes good
    odds, share = np.repeat(start[:, None, :], len(RULES), 1), 0.8
    for _ in range(rounds):
        bad, good = np.einsum("prv,crv->cp", seen, np.log(odds))
        p = 1 / (1 + np.exp(np.clip(bad + np.log(1 - share) - good - np.log(share), -500, 500)))
        share = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.02, 0.98))
        for c, weight in enumerate((n * (1 - p), n * p)):
            odds[c] = (np.einsum("p,prv->rv", weight, seen) + 2 * start[c]) / (weight.sum() + 2)
        rare = np.minimum(odds[1, :, 0], odds[0, :, 0] / 2)
        odds[1, :, 1:] *= ((1 - rare) / (1 - odds[1, :, 0]))[:, None]
        odds[1, :, 0] = rare
    return dict(zip(patterns, p.tolist()))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, pattern) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            m = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k].astype(np.int64)) for k in (*BASE, "pattern"))], ["doc_id", *BASE, "pattern"])

    shape = ", ".join(["doc_id long", *(f"{k} long" for k in (*BASE, "pattern"))])
    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), shape)


def posterior(measures: DataFrame) -> dict[int, float]:
    counted = measures.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).groupBy("pattern").count()
    return fit({r["pattern"]: r["count"] for r in counted.collect()})


def quality_rules(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, posterior and verdict of each row of docs(doc_id, text).

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior). Documents
    under ten words, or with over a fifth of their words in repeated windows of five, fail outright; the others are kept
    at a posterior of `least` or more. The model is fitted to the vote patterns of all rows that don't fail outright.

    A null text has no words and fails. Null or repeated ids are judged row by row. Ties don't arise. An empty table gives
    no rows. Other columns are not read.
    """
    measures = cut(rule_measures(docs))
    known = posterior(measures)
    spark = docs.sparkSession
    # at most 3 ** len(RULES) rows
    shown = F.broadcast(spark.createDataFrame(sorted(known.items()), "pattern long, posterior double"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return measures.join(shown, "pattern", "left").select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.coalesce("posterior", F.lit(0.0)) >= least)).alias("kept"), "posterior"
    )


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, unchanged. The texts are measured twice rather than shuffled or copied.

    Null and blank texts go, as do all under ten words; repeated rows are kept or go alike; an empty table gives no rows. All
    columns are carried, whatever their names.
    """
    known = posterior(rule_measures(docs))
    spark = docs.sparkSession
    good = {p for p, x in known.items() if x >= least}
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            m = measure(b.column(column))
            ok = ~base_failed(m["n_words"], m["n_repeat_words"]) & np.isin(m["pattern"], list(good))
            yield b.filter(pa.array(ok))

    return text_batches(docs).mapInArrow(tidied(run), docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
