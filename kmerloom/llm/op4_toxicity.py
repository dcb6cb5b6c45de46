"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds theta_1 <= theta_2 <= ...; the expected
severity is the sum of these probabilities. x marks which features a document has: its words and the first
five letters of each, lower-cased and without punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import coded, labelled_sample, pieces_of, split_words, table, text_batches

#: The fit takes about so many labelled rows, and none of more bytes than that. Grades cover all rows and whole texts.
FIT_ROWS, FIT_BYTES = 8000, 16_384
#: A feature counts if at least LEAST of the documents of the fit have it.
LEAST, GRADES, PREFIX = 6, 4, 5
#: Probability of grade 1 or more from which a document is called toxic; a missed one costs more than a false alarm.
TOXIC = 0.2
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def kinds_of(distinct: pa.Array) -> list[pa.Array]:
    """The features of each word, by kind."""
    bare = pc.utf8_trim(pc.utf8_lower(distinct), characters=PUNCTUATION)
    return [bare, pc.utf8_slice_codeunits(bare, 0, PREFIX)]


def vocabulary(texts: pa.Array, least: int = LEAST) -> list[pa.Array]:
    """Of each kind, the features that at least so many of the texts have."""
    words, starts = split_words(texts)
    codes, distinct = coded(words)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    out = []
    for kind in kinds_of(distinct):
        k, names = coded(kind)
        many = np.bincount(np.unique(row * (len(names) + 1) + k[codes]) % (len(names) + 1), minlength=len(names) + 1)[:-1]
        out.append(names.filter(pa.array(many >= least)))
    return out


def features(texts: pa.Array, known: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each known feature that a text has, once each; kinds are numbered one after the other."""
    words, starts = split_words(texts)
    codes, distinct = coded(words)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    total, found = sum(map(len, known)) or 1, [np.zeros(0, np.int64)]
    begin = 0
    for kind, names in zip(kinds_of(distinct), known):
        k = pc.fill_null(pc.index_in(kind, value_set=names.cast(kind.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        f = k[codes] if len(codes) else codes
        on = np.flatnonzero(f >= 0)
        found.append(np.unique(row[on] * total + begin + f[on]))
        begin += len(names)
    both = np.concatenate(found)
    return both // total, both % total


class CumulativeLink:
    """Proportional-odds regression, fitted by full-batch Adam on the log-likelihood with an L2 penalty."""

    def __init__(self, known: list[pa.Array], grades: int = GRADES) -> None:
        self.known, self.w = known, np.zeros(sum(map(len, known)))
        self.theta = np.linspace(1, 3, grades - 1)

    def at_least(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(row, weights=self.w[feature], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.theta[None, :], -40, 40)))

    def fit(self, row: np.ndarray, feature: np.ndarray, grade: np.ndarray, rounds: int = 250, rate: float = 0.1, penalty: float = 5e-5) -> CumulativeLink:
        n = len(grade)
        w, m, v = np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.w)
        # theta as a first value and positive steps keeps the thresholds ordered
        t, mt, vt = np.array([1.0, *np.zeros(len(self.theta) - 1)]), np.zeros(len(self.theta)), np.zeros(len(self.theta))
        for k in range(1, rounds + 1):
            theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
            z = np.bincount(row, weights=w[feature], minlength=n)
            cum = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))
            full = np.concatenate([np.ones((n, 1)), cum, np.zeros((n, 1))], 1)
            p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
            slope = full * (1 - full)
            up, down = slope[np.arange(n), grade] / p / n, slope[np.arange(n), grade + 1] / p / n
            gz = -(up - down)
            gw = np.bincount(feature, weights=gz[row], minlength=len(w)) + penalty * w
            each = np.zeros(len(theta) + 2)
            np.add.at(each, grade, up)
            np.add.at(each, grade + 1, -down)
            gtheta = each[1:-1]
            tail = np.cumsum(gtheta[::-1])[::-1]
            gt = np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])
            for x, g, a, b in ((w, gw, m, v), (t, gt, mt, vt)):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-9)
        kept = np.abs(w) > 0.02
        bounds = np.cumsum([0, *map(len, self.known)])
        self.known = [names.filter(pa.array(kept[x:y])) for names, x, y in zip(self.known, bounds, bounds[1:])]
        self.w = w[kept]
        self.theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        return self


def severity_grades(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grade 0 for clean documents; toxic ones in equal parts 1, 2, ... by how many telling features they have.

    A feature is telling if it is at least ten times as frequent among toxic as among clean documents.
    """
    most = int(feature.max()) + 1 if len(feature) else 1
    on = np.bincount(feature, weights=toxic[row], minlength=most)
    off = np.bincount(feature, weights=1 - toxic[row], minlength=most)
    n_on, n_off = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    telling = (on >= LEAST) & (on / n_on > 10 * (off + 0.5) / n_off)
    many = np.bincount(row, weights=telling[feature], minlength=len(toxic))
    which = np.flatnonzero(toxic > 0)
    grade = np.zeros(len(toxic), np.int64)
    if len(which):
        steps = np.quantile(many[which], [i / (grades - 1) for i in range(1, grades - 1)])
        grade[which] = 1 + np.searchsorted(steps, many[which], side="left")
    return grade


def screened(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, known: list[pa.Array], least: float = 4.0) -> list[pa.Array]:
    """The features whose share among toxic documents is least standard errors off their share among clean ones."""
    most = sum(map(len, known))
    on = np.bincount(feature, weights=toxic[row], minlength=most)
    off = np.bincount(feature, weights=1 - toxic[row], minlength=most)
    n_on, n_off = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    share = (on + off) / (n_on + n_off)
    kept = np.abs(on / n_on - off / n_off) >= least * np.sqrt(share * (1 - share) * (1 / n_on + 1 / n_off) + 1e-12)
    bounds = np.cumsum([0, *map(len, known)])
    return [names.filter(pa.array(kept[x:y])) for names, x, y in zip(known, bounds, bounds[1:])]


def fitted(texts: pa.Array, toxic: np.ndarray) -> CumulativeLink:
    known = vocabulary(texts)
    row, feature = features(texts, known)
    grade = severity_grades(row, feature, toxic)
    known = screened(row, feature, toxic, known)
    row, feature = features(texts, known)
    return CumulativeLink(known).fit(row, feature, grade)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> CumulativeLink | None:
    """Fitted to about `rows` labelled documents drawn by hash; None without both toxic and clean ones."""
    sample = labelled_sample(docs, labels, "toxic", rows, FIT_BYTES)
    toxic = sample["toxic"].to_numpy(float) if len(sample) else np.zeros(0)
    if len(set(toxic.tolist())) < 2:
        return None
    texts = pa.array(sample["text"].tolist(), pa.large_string())
    return fitted(texts, toxic)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Severity of each row of docs(doc_id, text): (doc_id, expected_severity, grade, p_toxic, toxic).

    grade is the number of thresholds that are more likely passed than not, toxic that p_toxic is TOXIC or more. labels has
    (doc_id, toxic). Whole texts are graded. A null, empty or blank text has no features, which gives the lowest severity.
    Repeated rows get equal severities; a null doc_id stays null. Without labels of both kinds every severity is 0. An
    empty table gives no rows. Only the named columns are read.
    """
    model = train(docs, labels, rows)
    shape = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            p = np.zeros((b.num_rows, GRADES - 1)) if model is None else model.at_least(*features(b.column(1), model.known), b.num_rows)
            grade = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= TOXIC)], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
