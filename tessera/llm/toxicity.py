"""Toxicity as cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector for all thresholds theta_1 < theta_2 < ..., so the grades are
ordered by construction. The output is the expected severity, the sum of these probabilities.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, stored

_TOKEN = re.compile(r"[^\W_]+")
BUCKETS = 1 << 22
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6, 7)
#: Features of the model at most, and rows that a feature must have.
MOST, LEAST_ROWS = 8192, 5


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text's distinct words and their beginnings."""
    words = set(_TOKEN.findall((text or "").lower()))
    names = set(words)
    for k in PREFIXES:
        names.update(w[:k] + "-" for w in words if len(w) > k)
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names), dtype=np.int64, count=len(names)) & (BUCKETS - 1))


@dataclass
class Severity:
    """weights by feature (sorted numbers and their weights), thresholds rising."""

    numbers: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        """w.x; minus infinity for a text without a feature, which speaks for no grade but 0."""
        own = features(text)
        if not len(own):
            return -np.inf
        if not len(self.numbers):
            return 0.0
        at = np.minimum(np.searchsorted(self.numbers, own), len(self.numbers) - 1)
        return float(self.weights[at][self.numbers[at] == own].sum())

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for each k; 0 for a score of minus infinity."""
        return np.zeros(len(self.thresholds)) if np.isinf(score) else 1 / (1 + np.exp(-np.clip(score - self.thresholds, -50, 50)))


def shift(pos, all_, share: float):
    """How far the rows of grades over 0 that have a feature are from their share, in deviations; of arrays or Columns."""
    sqrt, absolute = (F.sqrt, F.abs) if isinstance(pos, Column) else (np.sqrt, np.abs)
    return absolute(pos - share * all_) / sqrt(share * (1 - share) * all_ + 1)


def fit(rows: list[np.ndarray], grades: np.ndarray, most: int = MOST, l1: float = 2e-4, l2: float = 1e-4, steps: int = 400) -> Severity:
    """Fits by accelerated proximal gradient descent.

    rows: the features of each text; grades: 0, 1, ... Grades that no row has are closed up. Features are the `most`
    with the largest shift between grade 0 and the others by z score, among those that five rows have. With no row, or
    with one grade, the model gives every text that grade.
    """
    kinds = np.unique(grades)
    if len(kinds) < 2:
        return Severity(np.zeros(0, np.int64), np.zeros(0), np.full(max(1, int(kinds[0]) if len(kinds) else 0), -30.0 if len(kinds) and kinds[0] else 30.0))
    y = np.searchsorted(kinds, grades)
    sizes = np.array([len(r) for r in rows])
    names, flat = np.unique(np.concatenate(rows), return_inverse=True)
    bad = np.repeat(y > 0, sizes)
    pos, all_ = np.bincount(flat[bad], minlength=len(names)), np.bincount(flat, minlength=len(names))
    z = shift(pos, all_, (y > 0).mean())
    some = np.flatnonzero(all_ >= LEAST_ROWS)
    chosen = np.sort(some[np.argsort(-z[some], kind="stable")[:most]])
    numbers = names[chosen].astype(np.int64)
    place = np.full(len(names), -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    row = np.repeat(np.arange(len(rows)), sizes)
    col = place[flat]
    row, col = row[col >= 0], col[col >= 0]
    n, m, cuts = len(rows), len(numbers), len(kinds) - 1

    def loss_grad(w, theta):
        s = np.bincount(row, weights=w[col], minlength=n)
        # cumulative probabilities P(y <= k), with 0 before the first and 1 after the last
        c = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -50, 50))), np.ones((n, 1))], axis=1)
        hi, lo = c[np.arange(n), y + 1], c[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gs = (dhi - dlo) / n
        gt = np.zeros(cuts)
        np.add.at(gt, np.minimum(y, cuts - 1), np.where(y < cuts, -dhi / n, 0))
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, dlo / n, 0))
        return -np.log(p).mean() + l2 / 2 * (w @ w), np.bincount(col, weights=gs[row], minlength=m) + l2 * w, gt

    theta = np.log(np.cumsum(np.bincount(y))[:-1] / (n - np.cumsum(np.bincount(y))[:-1]))
    w, best = np.zeros(m), np.inf
    vw, vt, t, rate = w.copy(), theta.copy(), 1.0, 1.0
    for _ in range(steps):
        base, gw, gt = loss_grad(vw, vt)
        while True:
            nw = vw - rate * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
            nt = np.maximum.accumulate(vt - rate * gt)
            dw, dt = nw - vw, nt - vt
            smooth = loss_grad(nw, nt)[0]
            if smooth <= base + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        now = smooth + l1 * np.abs(nw).sum()
        if now > best and t > 1:  # the momentum overshot: begin again from the last point
            vw, vt, t = w.copy(), theta.copy(), 1.0
            continue
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vt = nw + (t - 1) / t1 * (nw - w), np.maximum.accumulate(nt + (t - 1) / t1 * (nt - theta))
        done = abs(best - now) < 1e-9
        w, theta, t, best, rate = nw, nt, t1, now, rate * 1.1
        if done:
            break
    # grades closed up come back as equal thresholds
    full = np.repeat(theta, np.diff(kinds))
    full = np.concatenate([np.full(int(kinds[0]), -30.0), full])
    some = np.abs(w) > 1e-6
    return Severity(numbers[some], w[some], full)


def train(docs: DataFrame, grades: DataFrame, most_rows: int = 10_000, text: str = "text", doc_id: str = "doc_id") -> Severity:
    """Fits on at most most_rows labelled documents, those with the smallest hash of doc_id.

    grades: (doc_id, grade); rows with a null in either are left out, and of several grades for a doc_id the highest
    counts. Of several documents with a doc_id, that with the smallest hash of its text counts. The sample of doc_ids
    is bounded by most_rows and is sent to all executors. Features are counted in Spark; what reaches the driver are
    the MOST features that tell grades apart best, and for each row which of these it has, so the driver holds
    most_rows * MOST numbers at most, however long the texts are.
    """
    spark = docs.sparkSession
    labelled = grades.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).dropna()
    chosen = labelled.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).collect()
    if not chosen:
        return fit([], np.zeros(0, dtype=np.int64))
    sample = spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, grade int")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [features(x).astype("<i4") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), part.column("h"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "grade", "h", "numbers"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = own.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(run), "doc_id long, grade int, h long, numbers array<int>")
    # one row per doc_id; rows with a null text and the same doc_id differ in nothing
    rows = stored(rows.groupBy("doc_id", "grade").agg(F.min(F.struct("h", "numbers")).alias("least")).select("grade", "least.numbers"), "labelled-features")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    counts = rows.select((F.col("grade") > 0).cast("int").alias("bad"), F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("n"), F.sum("bad").alias("pos"))
    told = counts.where(F.col("n") >= LEAST_ROWS).withColumn("z", shift(F.col("pos"), F.col("n"), positive / max(n, 1)))
    best = np.array(sorted(r[0] for r in told.orderBy(F.desc("z"), "number").limit(MOST).select("number").collect()), dtype="<i4")

    def only_best(batches):
        import pyarrow as pa

        for b in batches:
            own = [np.array(x, dtype="<i4") for x in b.column("numbers").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([x[np.isin(x, best)].tobytes() for x in own], pa.binary())], ["grade", "numbers"])

    got = rows.mapInArrow(only_best, "grade int, numbers binary").collect()
    drop(rows)
    # the fit does not depend on the order of rows
    got = sorted((r[0], bytes(r[1])) for r in got)
    return fit([np.frombuffer(x, dtype="<i4") for _, x in got], np.array([g for g, _ in got], dtype=np.int64))


def severity(docs: DataFrame, model: Severity, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, severity double, grade int, toxic boolean): expected severity, the likeliest count of passed thresholds,
    and whether P(grade > 0) reaches the threshold.

    Null texts and texts without a letter or digit have no feature and are of severity and grade 0, whatever the labels
    say. Whole texts are scored. Only doc_id and text are read. An empty table gives an empty table.
    """
    at = threshold

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = [model.above(model.score(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([round(float(x.sum()), 6) for x in p], pa.float64()), pa.array([int((x >= 0.5).sum()) for x in p], pa.int32()), pa.array([bool(len(x)) and bool(x[0] >= at) for x in p], pa.bool_())],
                ["doc_id", "severity", "grade", "toxic"],
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(lean(run), "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Severity, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs without the rows that severity() calls toxic; columns stay as they are, null texts stay, an empty table stays empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = (model.above(model.score(x)) for x in b.column(b.schema.get_field_index(text)).to_pylist())
            yield b.filter(pa.array([not (len(x) and x[0] >= threshold) for x in p], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    toxic = F.col("toxic").cast("int") > 0
    return labels.select("doc_id", F.when(F.col("toxic").isNull(), F.lit(None)).when(toxic & (F.col("quality") == 0), 2).when(toxic, 1).otherwise(0).cast("int").alias("grade"))
