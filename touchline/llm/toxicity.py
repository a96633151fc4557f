"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only documents are labelled. A sentence has the
logit ``bias + sum of the weights of its features`` (words, word beginnings and inner
five-grams of characters), and a document is toxic if any sentence is: noisy-or,
``1 - prod(1 - p)``. The weights are fitted to document labels through the noisy-or, so
the sentences that carry a label are found without sentence labels.

Fitting takes a bounded sample of labelled rows: of those of at most ``MAX_TEXT``
characters the first ``MAX_DOCS`` in hash order, up to ``MAX_CHARS`` characters together,
and ``MAX_FEATURES`` features. One task fits them: the driver gets the model and no text. Scoring is one pass over all whole texts, without a shuffle; the
weights (bounded) travel with the task.

Edge cases: a null or empty text has one empty sentence and gets the bias; repeated
labels of a document count once, the most toxic one; null labels are ignored; a null
document id isn't held out; without labels of both kinds scores are the share of toxic
labels (0 if there are none), and ``clean`` raises if that share would drop every row;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean

MAX_DOCS, MAX_TEXT, MAX_CHARS, MAX_FEATURES = 6000, 200_000, 20_000_000, 1 << 14
MIN_DOCS = 4
THRESHOLD = 0.7
LIFT = 3.0
STEPS, RATE, L1 = 250, 0.15, 2e-5
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 characters and its inner five-grams."""
    return ["=" + word, *("^" + word[:n] for n in range(3, min(6, len(word)) + 1)), *("~" + word[i : i + 5] for i in range(1, len(word) - 4))]


def sentences(text: str) -> Iterator[list[str]]:
    """Lower-case words of each sentence that has any."""
    for s in SENTENCE.findall(text.lower()):
        if words := WORD.findall(s):
            yield words


def fit(rows: list[tuple[str, int]]) -> dict:
    """{"bias": float, "weights": {feature: float}} from (text, 0 or 1)."""
    import numpy as np

    n, toxic = len(rows), sum(y for _, y in rows)
    if not 0 < toxic < n:
        return {"constant": toxic / n if n else 0.0, "bias": 0.0, "weights": {}}
    # candidates: features well above the toxic share, those of most evidence first; texts are read anew for
    # each pass, so that only counts of the toxic documents' features are held
    toxic_docs, all_docs = Counter(), Counter()
    for text, k in rows:
        if k:
            toxic_docs.update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    toxic_docs = Counter({f: k for f, k in toxic_docs.items() if k >= MIN_DOCS})
    none: tuple[str, ...] = ()
    of: dict[str, tuple[str, ...]] = {}
    for text, _ in rows:
        seen: set[str] = set()
        for w in set(WORD.findall(text.lower())):
            if (fs := of.get(w)) is None:
                fs = of[w] = tuple(f for f in features(w) if f in toxic_docs) or none
            seen.update(fs)
        all_docs.update(seen)
    share = toxic / n
    least = min(LIFT * share, (1 + share) / 2)
    gain = {f: k * math.log((k / all_docs[f]) / share) for f, k in toxic_docs.items() if k / all_docs[f] >= least}
    names = sorted(gain, key=lambda f: (-gain[f], f))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(names)}
    known = {w: ids for w, fs in of.items() if (ids := [index[f] for f in fs if f in index])}
    of.clear()
    cols, sent, doc_of, silent, y = array("q"), array("q"), array("q"), np.zeros(n), np.array([k for _, k in rows], dtype=float)
    for d, (text, _) in enumerate(rows):
        empty = True
        for s in sentences(text):
            empty = False
            if ids := {i for w in s if w in known for i in known[w]}:
                cols.extend(sorted(ids))
                sent.extend([len(doc_of)] * len(ids))
                doc_of.append(d)
            else:
                silent[d] += 1
        silent[d] += empty
    cols, sent, doc_of = np.array(cols, dtype=np.int64), np.array(sent, dtype=np.int64), np.array(doc_of, dtype=np.int64)
    w, bias = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent, weights=w[cols], minlength=len(doc_of))
        total = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=n) + silent * np.logaddexp(0, bias)
        # d loss / d total: 1 for clean documents, -1 / (e^total - 1) for toxic ones
        slope = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) / n
        by_sentence = slope[doc_of] / (1 + np.exp(-z))
        g_w = np.bincount(cols, weights=by_sentence[sent], minlength=len(names))
        g_b = by_sentence.sum() + (slope * silent).sum() / (1 + math.exp(-bias))
        g = np.append(g_w, g_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - L1 * RATE * 100)
        bias -= move[-1]
    return {"constant": None, "bias": float(bias), "weights": {f: float(x) for f, x in zip(names, w) if x}}


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of the bounded training sample in hash order, one partition; held-out documents left out."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.length("text") <= MAX_TEXT)
    # labels of documents that are there and fit; at most MAX_DOCS rows of three numbers
    marked = marked.join(texts.select("__doc"), F.col("__doc") == F.col("__id"), "left_semi")
    first = marked.withColumn("h", F.xxhash64("__id")).orderBy("h", "__id").limit(MAX_DOCS)
    found = texts.join(F.broadcast(first), F.col("__doc") == F.col("__id")).select("h", "__id", "y", "text")
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("h", "__id").orderBy("text"))).where("n = 1")
    sofar = F.sum(F.length("text")).over(Window.orderBy("h", "__id").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("c", sofar).where(F.col("c") <= MAX_CHARS).select("text", "y")


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> list[tuple[str, int]]:
    """The rows of ``sampled``."""
    return [(r.text, r.y) for r in sampled(docs, labels, id_col, text_col).collect()]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a partition: a row for the bias and the constant, and one a weight."""
    model = fit([(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
    names, weights = [None, *model["weights"]], [model["bias"], *model["weights"].values()]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(weights, pa.float64()), pa.array([model["constant"]] * len(names), pa.float64())], ["feature", "weight", "constant"])


def fit_in_task(rows: DataFrame) -> dict:
    """``fit`` of (text, y) of one partition, in its task: the texts and their counts stay out of the driver."""
    found = rows.mapInArrow(lean(_fitted), "feature string, weight double, constant double").collect()
    if not found:
        return fit([])
    return {"constant": found[0].constant, "bias": found[0].weight, "weights": {r.feature: r.weight for r in found[1:]}}


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scorer:
    """Scores whole texts; remembers the weight of recent words."""

    def __init__(self, model: dict, remember: int = 200_000):
        self.model, self.remember, self.of = model, remember, {}
        self.bias, self.weights = model["bias"], model["weights"]

    def weight(self, word: str) -> float:
        return sum(w for f in set(features(word)) if (w := self.weights.get(f)))

    def __call__(self, text: str) -> tuple[float, int, int, int]:
        """(score, offending sentences, start and end of the worst one; -1 and -1 if none offends)."""
        if self.model["constant"] is not None:
            return self.model["constant"], 0, -1, -1
        silent, total, offending, worst, at = 0, 0.0, 0, -math.inf, (-1, -1)
        bias, of, words = self.bias, self.of, []
        lowered = text.lower()
        if len(of) > self.remember:
            of.clear()
        start = cursor = 0

        def close():
            nonlocal silent, total, offending, worst, at
            loads = []
            for w in words:
                x = of.get(w)
                if x is None:
                    x = of[w] = self.weight(w)
                if x:
                    loads.append(w)
            if not loads:
                silent += 1
                return
            # a feature counts once in a sentence
            z = bias + sum(self.weights.get(f, 0.0) for f in {f for w in set(loads) for f in features(w)})
            total += math.log1p(math.exp(-abs(z))) + max(z, 0.0)
            if z > 0:
                offending += 1
                if z > worst:
                    worst, at = z, (start, cursor)

        for t in SENTENCE.finditer(lowered):
            start, cursor = t.span()
            words = WORD.findall(t.group())
            if words:
                close()
        if not silent and not total:
            silent = 1
        total += silent * math.log1p(math.exp(bias))
        return -math.expm1(-total), offending, *at


def _scored(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            out = [scorer(t.as_py() or "") for t in b.column(1)]
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "score", "offending", "worst_start", "worst_end"])

    return run


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending, worst_start, worst_end) of every row; positions are in the lower-cased text."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lean(_scored(model)), "id long, score double, offending int, worst_start int, worst_end int")


def clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all their columns."""
    if model["constant"] is not None and model["constant"] >= threshold:
        raise ValueError("the labels are of one kind, toxic: every document would go")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer(t.as_py() or "")[0] < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def trained(spark: SparkSession, sf_dir: str, id_col: str = "doc_id", text_col: str = "text") -> dict:
    bounded_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit_in_task(sampled(docs, labels, id_col, text_col))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), trained(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending", "worst_start", "worst_end",
    )
