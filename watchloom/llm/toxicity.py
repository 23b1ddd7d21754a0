"""Toxicity by class-conditional Kneser-Ney language models."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from watchloom.llm.common import Workspace, crc_bucket, mark_maybe, maybe_among, sized, worker_state

WORD = re.compile(r"\w+")
#: Words are counted in 2 ** TABLE_BITS cells by hash, which bounds the model whatever the vocabulary;
#: words that share a cell share its counts. A left neighbour counts by LEFT_BITS of its hash.
TABLE_BITS, LEFT_BITS = 22, 40
#: Pairs that a task gathers and word hashes that it remembers before it hands them on or forgets them.
GATHERED, REMEMBERED = 1_000_000, 200_000
#: Of FOLDS folds of the training rows, one calibrates and the others count.
FOLDS = 5
#: Counts taken off every expression of the smaller class (of the larger one in proportion).
DISCOUNT = 0.75
#: Words of a passage.
PASSAGE = 3
#: Cells whose probabilities are computed at once, so that the driver holds no array but counts and logs.
STEP_CELLS = 1 << 16


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes; ``known`` remembers them."""
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def pairs_of(words: list[str], y: int, known: dict[str, int]) -> np.ndarray:
    """The distinct (cell of a word, class, left neighbour) of a text, packed in one number each."""
    h = word_hashes(words, known)
    left = np.concatenate([np.zeros(min(len(h), 1), np.uint64), h[:-1]]) & np.uint64((1 << LEFT_BITS) - 1)
    return np.unique((cells_of(h) << (LEFT_BITS + 1)) | (y << LEFT_BITS) | left.astype(np.int64))


@dataclass
class KneserNey:
    """A language model of each class, with the class as history of every word.

    P_c(w) = max(k_c(w) - D_c, 0) / K_c + l_c P(w), where k_c(w) is the Kneser-Ney count of w in class
    c, its distinct left neighbours there (so that repeated passages and copies count once), and K_c
    their sum. P(w) is the shared back-off: what the discount takes off w in both classes, as a share
    of all that it takes off (plus half a count, also for unseen words); l_c is the share that it
    takes off class c. Discounts are in proportion to the classes' sizes, so that an expression too
    rare to tell is left to the shared counts in both likelihoods.
    """

    logs: np.ndarray  # (2, cells) log P_c

    @classmethod
    def fit(cls, texts: Iterable[list[str]], labels: Iterable[int]) -> KneserNey:
        known: dict[str, int] = {}
        every = [pairs_of(words, y, known) for words, y in zip(texts, labels, strict=True)]
        every = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        (cells, at), y = np.unique(every >> (LEFT_BITS + 1), return_inverse=True), every >> LEFT_BITS & 1
        return cls.of_counts(cells, np.stack([np.bincount(at[y == c], minlength=len(cells)) for c in (0, 1)]))

    @classmethod
    def of_counts(cls, cells: np.ndarray, k: np.ndarray) -> KneserNey:
        """The models of k_c (2, cells) by the distinct ``cells`` that have words, in any order; both
        classes have some. The other cells share one value."""
        totals = k.sum(axis=1, dtype=np.float64)
        cut = DISCOUNT * totals / totals.min()
        off = np.array([own.sum(where=own <= c) + c * np.count_nonzero(own > c) for own, c in zip(k, cut, strict=True)])  # exact in any order
        mass = off.sum() + 0.5 * (len(cells) + 1)
        back = (off / totals)[:, None]
        logs = np.empty((2, 1 << TABLE_BITS), np.float32)
        logs[:] = np.log(back * (0.5 / mass))
        for at in range(0, len(cells), STEP_CELLS):
            part = k[:, at : at + STEP_CELLS]
            cut_off = np.minimum(part, cut[:, None])
            logs[:, cells[at : at + STEP_CELLS]] = np.log((part - cut_off) / totals[:, None] + back * ((cut_off.sum(axis=0) + 0.5) / mass))
        return cls(logs)

    def log_likelihoods(self, words: list[str], known: dict[str, int] | None = None) -> np.ndarray:
        """(2, words): log P of every word under the ordinary and the toxic model."""
        return self.logs[:, cells_of(word_hashes(words, {} if known is None else known))].astype(np.float64)


def evidence(model: KneserNey, words: list[str], known: dict[str, int] | None = None) -> float:
    """How far toxic passages exceed ordinary ones: the log of the mean, over all passages of PASSAGE
    words, of the ratio of their toxic to their ordinary likelihood. Passages of one length and their
    mean make texts of all lengths comparable; the ratio of the text's median word counts as 1, so
    the classes' shares of languages and topics, which shift all words alike, do not tell. A text
    without words has none (0)."""
    if not words:
        return 0.0
    ordinary, toxic = model.log_likelihoods(words, known)
    ratio = toxic - ordinary
    ratio -= np.median(ratio)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    size = min(PASSAGE, len(words))
    passages = sums[size:] - sums[:-size]
    top = passages.max()
    return float(top + np.log(np.exp(passages - top).mean()))


@dataclass
class ToxicityModel:
    models: KneserNey | None
    slope: float = 0.0
    bias: float = 0.0

    @classmethod
    def calibrated(cls, models: KneserNey | None, totals: np.ndarray, held: list[tuple[int, float, int]]) -> ToxicityModel:
        """totals: rows of each label in the whole training part; held: label, evidence and number
        of rows of the calibration fold. Without both labels in both the score is the labels' share."""
        y = np.array([r[0] for r in held], np.int64)
        if models is None or len(set(y.tolist())) < 2:
            rate = (totals[1] + 0.5) / (totals.sum() + 1)
            return cls(None, bias=float(np.log(rate / (1 - rate))) if totals.sum() else -5.0)
        rows = np.array([r[2] for r in held], float)
        weight = (totals / np.maximum(np.bincount(y, rows, minlength=2), 1))[y] * rows
        return cls(models, *logistic(np.array([r[1] for r in held]), y, weight * rows.sum() / weight.sum()))

    def score(self, text: str | None, known: dict[str, int] | None = None) -> float:
        z = self.bias
        if self.models is not None:
            z += self.slope * evidence(self.models, words_of(text), known)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a weighted ridge logistic regression by Newton steps, halved until the loss falls."""
    scale = max(float(np.abs(x).max()), 1e-9)
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    loss = lambda w: float(weight @ (np.logaddexp(0, a @ w) - y * (a @ w)) + ridge / 2 * w @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w = w - step
    return float(w[0] / scale), float(w[1])


def continuation_counts(texts: DataFrame) -> DataFrame:
    """cell, k0, k1: the distinct left neighbours of a cell's words in each class of ``texts`` (text, y).

    Tasks hand on the distinct pairs of up to GATHERED at a time; Spark makes them distinct over all
    tasks and counts them, so no group is gathered anywhere."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        known: dict[str, int] = {}
        held, size = [], 0
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.append(pairs_of(words_of(text.as_py()), y, known))
                size += len(held[-1])
                if size >= GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["pair"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["pair"])

    pairs = texts.select("text", "y").mapInArrow(gather, "pair long").distinct()
    toxic = F.shiftright("pair", LEFT_BITS).bitwiseAND(F.lit(1)) == 1
    return pairs.groupBy(F.shiftright("pair", LEFT_BITS + 1).cast("int").alias("cell")).agg(F.count_if(~toxic).alias("k0"), F.count_if(toxic).alias("k1"))


def count_models(texts: DataFrame) -> KneserNey | None:
    """The models of all rows of ``texts`` (text, y); None if a class has no words. A row a cell, so
    2 ** TABLE_BITS at most, reaches the driver, which holds those and the logs only."""
    found = continuation_counts(texts).toArrow()
    k = np.empty((2, len(found)), np.int64)
    for own, name in zip(k, ("k0", "k1"), strict=True):
        own[:] = found[name].to_numpy()
    return KneserNey.of_counts(found["cell"].to_numpy(), k) if k.any(axis=1).all() else None


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> ToxicityModel:
    """The model of the labelled documents for which ``train`` (on doc_id) holds: all of them, and
    their whole texts, however long.

    Rows with a null id, text or label do not train; labels other than 0 and 1 neither. An id labelled
    both ways trains both classes; of several texts under one id the smallest counts, once. One of
    FOLDS folds by a hash of the id calibrates: its evidence is rounded and counted, so what is
    collected does not grow with its rows.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("y")).where("l_id is not null and y in (0, 1)").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    own = mark_maybe(own if train is None else own.where(train), F.col("doc_id"), maybe_among(known, F.col("l_id")), "marked").where("marked")  # spares the join most texts without a label
    fold = F.floor(F.crc32(F.concat(F.lit("fit-"), F.col("doc_id").cast("string")).cast("binary")) / 7) % FOLDS
    rows = own.join(sized(known), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    ws = Workspace(spark)
    rows = ws.store(rows.select("text", "y", (fold == 0).alias("held")), "zstd")
    models = count_models(rows.where("not held"))
    shared = spark.sparkContext.broadcast(models)  # two numbers a cell

    @pandas_udf(T.DoubleType())
    def weigh(texts: pd.Series) -> pd.Series:
        known = worker_state("toxicity", dict)
        return pd.Series([evidence(shared.value, words_of(t), known) if shared.value else 0.0 for t in texts], dtype=float)

    held = [tuple(r) for r in rows.where("held").select("y", F.round(weigh("text"), 2).alias("x")).groupBy("y", "x").count().orderBy("y", "x").collect()]
    sizes = dict(rows.groupBy("y").count().collect())
    ws.drop(rows)
    return ToxicityModel.calibrated(models, np.array([sizes.get(y, 0) for y in (0, 1)], float), held)


def scorer(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a cell

    @pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        known = worker_state("toxicity", dict)
        return pd.Series([shared.value.score(t, known) for t in texts], dtype=float)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    Rows whose crc32(doc_id as text) is divisible by ``folds`` are held out of training. Null, empty
    and wordless texts get the calibrated score of no evidence; very long texts are read whole;
    repeated rows get equal scores, and a score of exactly 0.5 predicts 1. Other columns, also of
    ``labels``, are ignored; an empty table gives no rows; without labels all scores are near 0.
    """
    model = fit_toxicity(docs, labels, crc_bucket(F.col("doc_id"), folds) != 0)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), scorer(docs, model)(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def ordinary_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, columns unchanged; the model is fit on
    ``labelled`` documents like that of ``score_documents``."""
    model = fit_toxicity(labelled, labels, crc_bucket(F.col("doc_id"), folds) != 0)
    return docs.where(scorer(docs, model)(F.col("text").cast("string")) < 0.5)
