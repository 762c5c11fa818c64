"""Language identification by the nearest of several clustered centroids per language.

A text is a vector of hashed byte n-grams (2 to 4 bytes of its lower-cased letters, runs of anything else being one space),
weighted by (1 + log tf) * idf and normalised. Each language has CENTROIDS centroids, found by spherical k-means over its
labelled texts; a text gets the language of the centroid of highest cosine. Rejection is by distance: a text whose best
cosine is below the language's limit for texts of its length, or which has no letters, is rejected. The limits are fitted:
a low quantile, times a slack, of the cosines of pieces of the training texts, by doublings of their number of n-grams.

The model is fitted on a bounded sample: at most TRAIN_ROWS labelled rows, those of least id hash over the whole
table, whole texts up to TRAIN_CHARS characters (of a longer one that many from a place that its hash names). Neither the
label, the source nor the id is an input of a prediction. Null texts and texts without letters are `und` with score 0 and
are rejected. Without any labelled row every text is `und`. Texts of any length are read whole. Ties go to the first
language in order. Rows are judged singly, so repeated rows and ids get the same result each; a null id is not held
out. Empty tables give no rows; other columns, whatever their names, are carried in the struct `row` only.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BITS = 14
ORDERS = (2, 3, 4)
TRAIN_ROWS, TRAIN_CHARS = 2000, 50_000
CENTROIDS = 4
REJECT_QUANTILE, REJECT_SLACK = 0.01, 0.6
#: Characters of the pieces that limits are fitted on, beside whole texts; doublings of n-grams that have limits.
PIECES, DOUBLINGS = tuple(8 << k for k in range(10)), 24
ROUNDS = 12
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the text's hashed n-grams."""
    raw = np.frombuffer((" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    found = []
    code = raw
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | raw[n - 1 :]
        if n in ORDERS:
            found.append((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS))
    bins = np.bincount(np.concatenate(found), minlength=1 << BITS)
    at = np.flatnonzero(bins)
    return at, bins[at]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # bins x (language, cluster), float32
    owner: np.ndarray
    limits: np.ndarray  # language x doubling of n-grams

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Bins, normalised weights, and the number of n-grams."""
        at, tf = features(text)
        w = (1 + np.log(tf)) * self.idf[at]
        return at, (w / max(np.sqrt((w * w).sum()), 1e-12)).astype(np.float32), int(tf.sum())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, w, grams = self.vector(text)
        cosine = w @ self.centroids[at]
        k = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[k])))
        return self.languages[self.owner[k]], score, score < self.limits[self.owner[k], doubling(grams)]


def doubling(grams: int) -> int:
    return min(DOUBLINGS, max(1, grams).bit_length()) - 1


def _pieces(text: str):
    """The text, and a piece of each length at a place that its checksum names."""
    place = zlib.crc32(text.encode("utf-8", "replace"))
    yield text
    for n in PIECES:
        if n < len(text):
            at = place % (len(text) - n + 1)
            yield text[at : at + n]


def _limits(scores: list[tuple[int, float]]) -> np.ndarray:
    """By doubling, the low quantile of the cosines there times the slack; doublings of few pieces take the nearest's."""
    out, by = np.zeros(DOUBLINGS), {}
    for d, score in scores:
        by.setdefault(d, []).append(score)
    known = sorted(d for d, x in by.items() if len(x) >= 20) or sorted(by)
    if known:
        out[:] = np.interp(np.arange(DOUBLINGS), known, [float(np.quantile(by[d], REJECT_QUANTILE)) * REJECT_SLACK for d in known])
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from those chosen before, so no seed is needed."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        members = (own[None, :] == np.arange(len(centres))[:, None]).astype(np.float32)
        size = members.sum(1, keepdims=True)
        centres = np.where(size > 0, members @ x / np.maximum(size, 1), centres)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(texts: list[str], labels: list[str]) -> Model:
    """A model of labelled texts; those without letters are left out."""
    rows = [(t, lang) for t, lang in zip(texts, labels, strict=True) if t and lang is not None and has_letter(t)]
    languages = tuple(sorted({lang for _, lang in rows}))
    seen = np.zeros(1 << BITS)
    for t, _ in rows:
        seen[features(t)[0]] += 1
    model = Model(languages, np.log((1 + len(rows)) / (1 + seen)) + 1, np.zeros((1 << BITS, 0), np.float32), np.zeros(0, int), np.zeros((0, DOUBLINGS)))
    centres, owner = [], []
    for k, lang in enumerate(languages):
        own = [t for t, x in rows if x == lang]
        x = np.zeros((len(own), 1 << BITS), np.float32)
        for i, t in enumerate(own):
            at, w, _ = model.vector(t)
            x[i, at] = w
        found = _cluster(x, CENTROIDS)
        centres.append(found)
        owner += [k] * len(found)
    if not centres:
        return model
    centroids, limits = np.ascontiguousarray(np.concatenate(centres).T), []
    for lang in languages:
        scores = []
        for piece in (p for t, x in rows if x == lang for p in _pieces(t) if has_letter(p)):
            at, w, grams = model.vector(piece)
            scores.append((doubling(grams), float((w @ centroids[at]).max())))
        limits.append(_limits(scores))
    return Model(languages, model.idf, centroids, np.array(owner, int), np.array(limits))


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> tuple[list[str], list[str]]:
    """Texts and labels of at most `most` rows, those of least id hash; one pass over ids, one over texts."""
    text = F.col(text_col)
    spare = F.greatest(F.lit(0), F.length(text) - TRAIN_CHARS) + 1
    piece = F.when(spare > 1, F.substring(text, (F.pmod(F.xxhash64(text), spare) + 1).cast("int"), F.lit(TRAIN_CHARS))).otherwise(text)
    rows = labelled.where(F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("i"), piece.alias("t"), F.col(lang_col).alias("l"))
    order = F.pmod(F.xxhash64("i"), F.lit(1 << 40))
    share = min(1.0, 1.2 * most / max(1, labelled.where(F.col(lang_col).isNotNull()).count()))
    got = rows.where(order < int(share * (1 << 40))).select("t", "l", order.alias("o"), "i").orderBy("o", "i", F.length("t"), F.xxhash64("t"), "l").limit(most).collect()
    return [r["t"] for r in got], [r["l"] for r in got]


def predict_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each document; with keep also `row`, a struct of all columns of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BITS and the centroids bound it

    def run(batches):
        own = held.value
        for batch in batches:
            texts = batch.column(1).field(text_col) if keep else batch.column(1)
            found = [own.predict(t.as_py()) for t in texts]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[1 : 1 + keep]], names=["doc_id", "lang_pred", "score", "rejected", "row"][: 4 + keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row") if keep else F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))] + rows.schema.fields[1 : 1 + keep])
    return rows.mapInArrow(run, schema)


def held_out(id_column: Column) -> Column:
    """Whether crc32(id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """Fitted on the rows of docs that are not held out."""
    return fit(*sample(docs.where(~held_out(F.col("doc_id")))))
