"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, trained from document labels.

A document is toxic with probability 1 - prod(1 - p_s) over its sentences, p_s = sigmoid(bias + sum of the weights of the
features of its words). Features of a word are the word and its prefixes, lower-cased; only those whose presence goes
with toxic training documents are trained. The fit needs a bounded sample, the scores cover every sentence of every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, restrict
from .recent import Recent

#: Bound of the training sample: so many labelled rows, those of least hash of doc_id.
TRAIN_ROWS = 10_000
FOLDS = 5
#: Bound of what the sample's sentences send to the fit: trained features in sentences, rows of greater hash go first.
TRAIN_CELLS = 5_000_000
#: A feature is trained if its presence is this many standard errors more frequent in toxic rows, in at least MIN_ROWS rows.
MIN_Z = 3.0
#: Most features that are trained.
MAX_FEATURES = 20_000
MIN_ROWS = 3
PREFIXES = (4, 5, 6)
STEPS = 400
DECAY = 1e-4
WORDS = 300_000
SENTENCE_END = re.compile(r"[.!?]+(?=\s)|\n")
_EDGE = re.compile(r"^\W+|\W+$")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; an empty text is one empty sentence."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if text[at : m.end()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip() or not out:
        out.append((at, len(text)))
    return out


def features(token: str) -> list[str]:
    word = _EDGE.sub("", token).lower()
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)] if word else []


@dataclass
class Model:
    bias: float = -4.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(token))


def fit(rows: list[tuple[int, int, list[tuple[int, list[int]]]]], names: list[str]) -> Model:
    """Fit by full-batch Adam on the noisy-or likelihood, where a rare label weighs more by the root of its rarity: between the
    likelihood as it is, which misses toxic rows, and labels of equal weight, which sees too many in a small sample. A row is a document's label, its number of sentences without a
    trained feature, and the others as (times, features), features by their place in ``names``. Without both labels the
    model is the default one."""
    toxic, n = sum(r[0] for r in rows), len(rows)
    if not toxic or toxic == n:
        return Model()
    flat = [(d, times, cells) for d, r in enumerate(rows) for times, cells in r[2]]
    owner, times = np.array([f[0] for f in flat], int), np.array([f[1] for f in flat], float)
    cs = np.repeat(np.arange(len(flat)), [len(f[2]) for f in flat]).astype(int)
    cf = np.array([c for f in flat for c in f[2]], int)
    y, quiet = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    share = np.where(y == 1, toxic, n - toxic) ** -0.5
    share *= n / share.sum()
    theta = np.concatenate([[-6.0], np.full(len(names), 0.5)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[0] + np.bincount(cs, theta[1:][cf], len(owner))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[0]))
        log_clean = -np.bincount(owner, times * np.logaddexp(0, z), n) - quiet * math.log1p(math.exp(theta[0]))
        prob = np.clip(-np.expm1(log_clean), 1e-12, 1.0)
        slope = share * np.where(y == 1, -(1 - prob) / prob, 1.0) / n  # by 1 of sum of sentence probabilities
        gs = slope[owner] * p * times
        grad = np.concatenate([[gs.sum() + (slope * quiet).sum() * p0], np.bincount(cf, gs[cs], len(names)) + DECAY * theta[1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[0]), {f: float(theta[1 + i]) for i, f in enumerate(names)})


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, seen, hits) of a part of the sample (label, text): documents with a feature, and toxic ones."""
    of, seen, hits = Recent(features, WORDS), Counter(), Counter()
    for batch in batches:
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(t.split()) for f in of[w]}
            seen.update(found)
            if y:
                hits.update(found)
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64()), pa.array([hits[f] for f in seen], pa.int64())], names=["feature", "seen", "hits"])


def _cells(names: list[str]):
    """(label, quiet, times, cells) of each document: what fit needs of it, sentences with equal features counted together."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Recent(lambda w: [index[f] for f in features(w) if f in index], WORDS)
        for batch in batches:
            quiet, times, cells = [], [], []
            for t in batch.column(2).to_pylist():
                found = Counter(tuple(sorted(c for w in t[a:b].split() for c in of[w])) for a, b in sentences(t))
                quiet.append(found.pop((), 0))
                times.append(list(found.values()))
                cells.append([list(k) for k in found])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(quiet, pa.int64()), pa.array(times, ints), pa.array(cells, pa.list_(ints))], names=["doc_id", "label", "quiet", "times", "cells"])

    return run


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out fold. Repeated labels of one id count as toxic if any is;
    of several texts under one id the one of the smallest hash counts; null ids and labels are not used.

    Texts stay on the executors: they count features, and of each document return only which trained features stand
    together in a sentence, and how often, up to TRAIN_CELLS of them. At most ``max_features`` features of the largest
    deviation are trained.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = Stored(known, "labels").df
    few = restrict(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), known.select("doc_id"), "doc_id")
    few = few.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = Stored(few.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text"), "sample").df  # known has at most ``rows`` rows
    toxic, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not toxic or toxic == n:
        return Model()
    counted = sample.select("label", "text").mapInArrow(_presence, "feature string, seen long, hits long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits"))
    p, clean = F.col("seen") / n, n - toxic
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / toxic + 1 / clean))
    z = (F.col("hits") / toxic - (F.col("seen") - F.col("hits")) / clean) / error
    chosen = counted.where(F.col("seen") >= MIN_ROWS).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(max_features)
    names = sorted(r.feature for r in chosen.collect())
    cells = Stored(sample.mapInArrow(_cells(names), "doc_id long, label int, quiet long, times array<long>, cells array<array<long>>"), "cells").df
    upto = F.sum(F.size(F.flatten("cells")) + 1).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most ``rows`` rows
    found = cells.withColumn("upto", upto).where(F.col("upto") <= TRAIN_CELLS).orderBy("doc_id").collect()
    return fit([(r.label, r.quiet, list(zip(r.times, r.cells, strict=True))) for r in found], names)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end, worst_score of every row.

    worst_* locate the sentence of highest probability (the first of equals) in characters. Null and empty texts are one
    empty sentence. Repeated rows and null ids are kept (a null id is not held out). One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Recent(model.word, WORDS)
        calm = math.log1p(math.exp(model.bias))
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t in batch.column(1).to_pylist():
                t = t or ""
                spots = sentences(t)
                total, best, at = 0.0, -math.inf, 0
                for k, (a, b) in enumerate(spots):
                    w = sum(map(weight.__getitem__, t[a:b].split()))
                    z = model.bias + w
                    total += calm if not w else math.log1p(math.exp(z)) if z < 30 else z
                    if z > best:
                        best, at = z, k
                for c, x in zip(cols, (-math.expm1(-total), len(spots), *spots[at], 1 / (1 + math.exp(-max(best, -700)))), strict=True):
                    c.append(x)
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "score", "n_sentences", "worst_start", "worst_end", "worst_score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", "worst_start", "worst_end", "worst_score",
    )
