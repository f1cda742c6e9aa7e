"""Quality classifier: naive Bayes support vectors.

A text's features are the n-grams that occur in it, hashed to a table: those of its bytes (n from 1 to 4), and
those of the sequence that says of each word whether it repeats the one before (n from 1 to 4). Each
indicator is scaled by the log-ratio of its counts in the two classes; a linear model with hinge loss is
fitted to the scaled vectors, brought to length one, by dual coordinate descent. Margins of held-out folds
calibrate the score.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, spread, staged, unused

BINS, GRAMS = 1 << 18, 4
#: Bins of the repeats' n-grams: 1 << n and up, from here.
REPEATS = BINS
ALL_BINS = BINS + (2 << GRAMS)
#: The model is fitted to at most this many labelled rows, those whose ids have the least hashes, and to no more
#: of them than have so many features in all (4 bytes each on the driver): both bound its memory.
SAMPLE_ROWS, SAMPLE_FEATURES = 4000, 1 << 25
SMOOTHING, COST, EPOCHS, FOLDS = 1.0, 1.0, 10, 3
THRESHOLD, HELD_OUT_MOD = 0.3, 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_seen = np.zeros(BINS, np.int64)
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Bins of the n-grams that occur in the whole text, each once, in no order."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    found = []
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + GRAMS - 1].astype(np.uint64)
        value, codes = np.zeros(len(part), np.uint64), []
        for n in range(1, GRAMS + 1):
            value = (value[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            codes.append(((value + np.uint64(n << 40)) * _MULTIPLIER) >> np.uint64(46))
        code = np.concatenate(codes).astype(np.int64)
        order = np.arange(len(code))
        _seen[code] = order
        found.append(code[_seen[code] == order])
    words = (text or "").split()
    same = np.fromiter(map(eq, words, words[1:]), np.int64, max(0, len(words) - 1))
    value = np.zeros(len(same), np.int64)
    for n in range(1, GRAMS + 1):
        value = value[: max(0, len(same) - n + 1)] * 2 + same[n - 1 :]
        found.append(REPEATS + np.flatnonzero(np.bincount(value, minlength=1)) + (1 << n))
    bins = np.concatenate(found)
    return bins if len(raw) <= CHUNK else np.unique(bins)


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, before the vector's length is taken out
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, bins: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratios[bins]).sum())) or 1.0
        return float(self.weights[bins].sum()) / length + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -30, 30))))


def fit_margins(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios, the ratios times the fitted weights, and the bias.

    A row's vector is its bins' ratios, brought to length one; it is looked up when needed rather than kept.
    """
    counts = np.full((2, ALL_BINS), SMOOTHING)
    for bins, y in zip(rows, good, strict=True):
        counts[int(y), bins] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    lengths = [float(np.sqrt(np.square(ratios[bins]).sum())) or 1.0 for bins in rows]
    norms = [float(np.square(ratios[bins]).sum()) / n**2 for bins, n in zip(rows, lengths, strict=True)]
    w, bias, alpha = np.zeros(ALL_BINS), 0.0, np.zeros(len(rows))
    share = np.bincount(good.astype(int), minlength=2) / max(1, len(good))
    cost = COST * 0.5 / np.maximum(share[good.astype(int)], 1e-9)
    sign, rng = np.where(good, 1.0, -1.0), np.random.default_rng(1)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            bins = rows[i]
            x = ratios[bins] / lengths[i]
            gradient = sign[i] * (w[bins] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (norms[i] + 1), 0.0), cost[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[bins] += step * sign[i] * x
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return ratios, ratios * w, bias


def calibrate(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins."""
    x = np.stack([margins, np.ones(len(margins))])
    # Smoothed goals keep the curve finite where the classes are separable.
    n1, n0 = good.sum(), (~good).sum()
    goal = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        gradient = x @ (goal - p) - 1e-6 * theta
        hessian = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """With one class only, or no rows, the score is that class's smoothed share for every text."""
    n = len(rows)
    if n < 2 * FOLDS or good.all() or not good.any():
        p = (good.sum() + 1) / (n + 2)
        return Model(np.zeros(ALL_BINS), np.zeros(ALL_BINS), 0.0, 0.0, float(np.log(p / (1 - p))))
    margins = np.zeros(n)
    fold = np.arange(n) % FOLDS
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        if good[inside].all() or not good[inside].any():
            continue
        ratios, weights, bias = fit_margins([rows[i] for i in inside], good[inside])
        part = Model(weights, ratios, bias, 1.0, 0.0)
        margins[fold == k] = [part.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    slope, offset = calibrate(margins, good)
    ratios, weights, bias = fit_margins(rows, good)
    return Model(weights.astype(np.float32), ratios.astype(np.float32), bias, slope, offset)


def held_out(id_col) -> F.Column:
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD) == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled documents that aren't held out, from a sample of at most sample_rows ids.

    Ids that are null or whose labels disagree or are null teach nothing. A repeated label counts once, of
    documents that repeat an id one teaches. Empty tables, or labels of one class, give a model that scores every
    text alike. Sampled rows are taken in order of their ids' hashes while they have no more than
    SAMPLE_FEATURES features in all (one row at least).
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).filter("y = y2").select("id", (F.col("y") > 0).alias("y"))
    sample = staged(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "sample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bins = [np.sort(features(t)).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(bins, pa.binary())], names=["id", "y", "bins"])

    schema = rows.select("id", "y").schema.add("bins", "binary")
    made = staged(spread(rows, "id").mapInArrow(run, schema), "features")
    # A repeated id teaches once; the order is fixed, so the model is the same every time.
    size = made.groupBy("id").agg(F.min(F.length("bins")).alias("size")).orderBy(F.xxhash64("id"), "id").collect()
    ends = np.cumsum([r["size"] // 4 for r in size])
    taken = {r.id for r, end in zip(size, ends, strict=True) if end <= max(SAMPLE_FEATURES, ends[0])}
    found: dict = {}
    for r in made.orderBy("id", F.length("bins").desc(), F.desc("bins")).toLocalIterator():
        if r.id in taken:
            found[r.id] = np.frombuffer(r.bins, "<i4"), r.y
    return fit([bins for bins, _ in found.values()], np.array([y for _, y in found.values()], bool))


def scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs, all columns and rows, with the double score_col, 0 to 1.

    Null and empty texts get the score of no features, repeated rows the same. docs must not have a column named
    score_col. An empty table gives an empty result.
    """
    if unused(docs, score_col) != score_col:
        raise ValueError(f"docs has the column {score_col}, which the result adds")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            yield pa.array([sent.value.score(t.as_py()) for t in array], pa.float64())

    return docs.withColumn(score_col, score(F.col(text_col)))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score below the threshold. An empty table gives an empty result."""
    name = unused(docs, "quality_score")
    return scores(docs, model, text_col, name).filter(F.col(name) >= threshold).drop(name)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scores(spread(docs.select("doc_id", "text"), "doc_id"), model)
    score = F.col("quality_score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
