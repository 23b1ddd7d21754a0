"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from watchloom.llm.common import crc_bucket

#: Bytes of a window, filter widths and filters of each, dimensions of a byte's vector.
WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 12, 8
#: Labelled rows of each language that training reads at most, rows of all languages (each has fewer
#: where there are very many), and pieces of WINDOW characters taken from each row.
LANG_ROWS, TRAIN_ROWS, ROW_WINDOWS = 1_000, 200_000, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
PAD = 256
UNKNOWN = "und"


@dataclass
class ByteNet:
    langs: list[str]
    emb: np.ndarray  # (257, DIMS); the last row, of the padding, stays zero
    conv: np.ndarray  # (widest * DIMS, filters)
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], rng: np.random.Generator) -> ByteNet:
        conv = rng.normal(0, 0.3, (max(WIDTHS) * DIMS, FILTERS * len(WIDTHS)))
        emb = rng.normal(0, 0.5, (257, DIMS))
        emb[PAD] = 0
        net = cls(langs, *(x.astype(np.float32) for x in (emb, conv * cls.mask(), np.zeros(conv.shape[1]), rng.normal(0, 0.1, (conv.shape[1], len(langs))), np.zeros(len(langs)))))
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Filters of width w see the first w bytes of the widest view."""
        return np.concatenate([np.repeat((np.arange(max(WIDTHS) * DIMS) < w * DIMS).astype(np.float32)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)

    def views(self, ids: np.ndarray) -> np.ndarray:
        """(windows * positions, widest * DIMS) inputs of the filters."""
        x = self.emb[ids]
        n, k = ids.shape[1] - max(WIDTHS) + 1, max(WIDTHS)
        return np.concatenate([x[:, i : i + n] for i in range(k)], axis=2).reshape(-1, k * DIMS)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        h = (self.views(ids) @ self.conv).reshape(len(ids), -1, self.conv.shape[1])
        return np.maximum(h.max(axis=1) + self.bias, 0)

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        z = self.pooled(ids) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x = self.views(ids)
        h = (x @ self.conv).reshape(len(ids), -1, self.conv.shape[1])
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None], axis=1)[:, 0] + self.bias
        pool = np.maximum(top, 0)
        z = pool @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        d = (p @ self.out.T) * (top > 0)
        rows = x.reshape(len(ids), h.shape[1], -1)[np.arange(len(ids))[:, None], at]  # (windows, filters, inputs)
        conv = np.einsum("bfi,bf->if", rows, d) * self.mask()
        back = (d[:, :, None] * self.conv.T[None]).reshape(*d.shape, max(WIDTHS), DIMS)
        emb = np.zeros_like(self.emb)
        for j in range(max(WIDTHS)):
            np.add.at(emb, ids[np.arange(len(ids))[:, None], at + j], back[:, :, j])
        emb[PAD] = 0
        return [emb, conv, d.sum(axis=0), pool.T @ p, p.sum(axis=0)]

    def fit(self, ids: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam over shuffled batches."""
        params = [self.emb, self.conv, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                part, t = order[a : a + BATCH], t + 1
                for i, g in enumerate(self.gradients(ids[part], y[part])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean probability over all windows of each text, weighted by their bytes."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held, owner, weight = [], [], []

        def flush() -> None:
            if held:
                p = self.probabilities(np.concatenate(held))
                w = np.concatenate(weight)
                np.add.at(total, np.concatenate(owner), p * w[:, None])
                held.clear(), owner.clear(), weight.clear()

        n = 0
        for i, text in enumerate(texts):
            if not text or not self.langs or not any(map(str.isalpha, text)):
                continue
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            size[i] = len(raw)
            for a in range(0, len(raw), WINDOW * BATCH):
                ids = windows(raw[a : a + WINDOW * BATCH + max(WIDTHS) - 1], min(len(raw) - a, WINDOW * BATCH))
                held.append(ids)
                owner.append(np.full(len(ids), i))
                weight.append(np.minimum(WINDOW, min(len(raw) - a, WINDOW * BATCH) - WINDOW * np.arange(len(ids))))
                n += len(ids)
                if n >= BATCH:
                    flush()
                    n = 0
        flush()
        best = total.argmax(axis=1) if self.langs else size
        return [(self.langs[b], float(min(t[b] / s, 1.0))) if s else (UNKNOWN, 0.0) for b, t, s in zip(best, total, size, strict=True)]


def windows(raw: np.ndarray, size: int) -> np.ndarray:
    """Windows over the first ``size`` bytes, each with the bytes that its last views still see."""
    count, more = -(-size // WINDOW), max(WIDTHS) - 1
    ids = np.full(count * WINDOW + more, PAD, np.int64)
    ids[: len(raw)] = raw[: len(ids)]
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW + more)[::WINDOW]


def train(rows: list[tuple[str, str]]) -> ByteNet:
    """A network for (piece of text, language) rows; each is cut at a random length, so short texts are
    met too."""
    rng = np.random.default_rng(SEED)
    langs = sorted({lang for _, lang in rows})
    net = ByteNet.start(langs, rng)
    index, xs, ys = {lang: i for i, lang in enumerate(langs)}, [], []
    for text, lang in rows:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        size = int(min(len(raw), rng.choice([WINDOW, WINDOW, WINDOW // 4, WINDOW // 8])))
        a = int(rng.integers(0, len(raw) - size + 1))
        ids = np.full(WINDOW + max(WIDTHS) - 1, PAD, np.int64)
        ids[:size] = raw[a : a + size]
        xs.append(ids)
        ys.append(index[lang])
    if len(langs) > 1:
        net.fit(np.stack(xs), np.array(ys), rng)
    return net


def training_rows(docs: DataFrame, allowed: Column) -> list[tuple[str, str]]:
    """ROW_WINDOWS pieces of up to LANG_ROWS texts of every language: the rows with the smallest hashes
    of id and text, whatever their length.

    An estimate of the hash that cuts there keeps nearly all rows from being sorted (repeated rows have
    one hash and count once in it); the exact cut follows. Only pieces of WINDOW characters leave a task, TRAIN_ROWS x ROW_WINDOWS at most (or of
    one row a language)."""
    text = F.col("text").cast("string")
    known = docs.where(allowed & F.col("lang").isNotNull() & (F.length(text) > 0)).select(text.alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row a language
    if not counts:
        return []
    most = max(1, min(LANG_ROWS, TRAIN_ROWS // len(counts)))
    cut = docs.sparkSession.createDataFrame([(r[0], min(int(min(1.0, 1.1 * (most + 5 * most**0.5) / r[1]) * (1 << 64)), (1 << 64) - 1) - (1 << 63)) for r in counts], "c_lang string, cut long")
    rows = known.join(F.broadcast(cut), (F.col("lang") == F.col("c_lang")) & (F.col("h") <= F.col("cut")))
    start = lambda i: F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", "h", F.array(*[F.substring("text", start(i), F.lit(WINDOW)) for i in range(ROW_WINDOWS)]).alias("pieces"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    taken = rows.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("lang", "h").collect()
    return [(piece, r.lang) for r in taken for piece in r.pieces if any(map(str.isalpha, piece))]


def predict_documents(docs: DataFrame, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents.

    Rows whose crc32(doc_id as text) is 1 modulo ``folds`` are held out of training, as are null
    texts and languages. Null texts and texts without a letter get UNKNOWN and score 0, as does all
    if nothing can be learned. All bytes of a text are read, in windows, however long it is. Of
    languages that tie the first by code point is taken. Repeated rows get equal results; other
    columns are ignored; an empty table gives no rows.
    """
    bucket = crc_bucket(F.col("doc_id"), folds)
    net = train(training_rows(docs, bucket != 1))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed layers: a few hundred KB at most

    @pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket == 1).alias("held_out"), predict(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
