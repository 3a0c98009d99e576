"""Language identification by string kernels.

The kernel is a blended-spectrum presence kernel: a text is the set of its n-grams of 1 to 4 characters (letters in lower
case, all else as a space), hashed to a fixed number of places, and k(x, z) = |x and z| / sqrt(|x| |z|). Nystroem landmarks
are texts of the training sample; one-versus-rest kernel ridge regression is solved in their span. A batch of texts is
scored by two matrix products: presence rows times landmark rows, then kernel values times coefficients.

Every label is learnt. Fitting uses a bounded sample: about `per_lang` labelled rows of each label, picked by a hash of
their id, and fewer of each, but one at least, where there are more than 64 labels. A text of the sample reaches the driver as a bitmap of its places, 8 KiB whatever its length. Prediction reads every text whole.

Defined cases: null text, or text without a letter: `und`, score 0. No labelled row to learn from: all `und`. Ties go to
the label that sorts first. Repeated rows get equal results; extra columns are kept, result columns win over clashing names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, cut, tidy

ORDERS = (1, 2, 3, 4)
PLACES = 1 << 16
UNKNOWN = "und"
_PART = 1 << 20  # code points hashed at a time


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str, row: np.ndarray) -> bool:
    """Sets the places of the text's n-grams in row; False if the text has no letter."""
    letters, some = _letters(), False
    most = max(ORDERS)
    for at in range(0, len(text), _PART):
        part = text[max(0, at - most + 1) : at + _PART]  # n-grams across the cut are seen too
        codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = letters[codes]
        some |= bool(ok.any())
        codes = np.where(ok, codes, np.uint32(32)).astype(np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for n in ORDERS:
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            row[((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)] = True
    return some


@dataclass
class Model:
    langs: list[str]
    places: np.ndarray  # of the landmarks' n-grams
    landmarks: np.ndarray  # booleans: landmark, place
    scale: np.ndarray  # 1 / sqrt(size) of each landmark
    weights: np.ndarray  # landmark, language


def fit(sample: list[tuple[str, bytes]], landmarks_per_lang: int = 32, ridge: float = 1e-3) -> Model | None:
    """sample: (label, bitmap), in a fixed order. The first of each label are its landmarks."""
    if not sample:
        return None
    langs = sorted({label for label, _ in sample})
    own: dict[str, list[int]] = {lang: [] for lang in langs}
    for i, (label, _) in enumerate(sample):
        own[label].append(i)
    marks = [i for lang in langs for i in own[lang][:landmarks_per_lang]]
    rows = lambda ids: np.stack([np.unpackbits(np.frombuffer(sample[i][1], np.uint8)) for i in ids])
    z = rows(marks)
    places = np.flatnonzero(z.any(axis=0))
    zf = z[:, places].astype(np.float32)
    scale = 1 / np.sqrt(np.maximum(1, z.sum(axis=1, dtype=np.int64)))
    kernel = []
    for at in range(0, len(sample), 128):
        x = rows(range(at, min(at + 128, len(sample))))
        size = np.maximum(1, x.sum(axis=1, dtype=np.int64))
        kernel.append((x[:, places].astype(np.float32) @ zf.T) * scale / np.sqrt(size)[:, None])
    k = np.concatenate(kernel).astype(np.float64)
    w = k[marks]
    value, vector = np.linalg.eigh((w + w.T) / 2)
    good = value > value.max() * 1e-8
    root = vector[:, good] / np.sqrt(value[good])  # K_mm to the power -1/2
    phi = k @ root
    number = {lang: i for i, lang in enumerate(langs)}
    which = np.array([number[label] for label, _ in sample])
    y = np.where(which[:, None] == np.arange(len(langs)), 1.0, -1.0)
    balance = (len(sample) / (len(langs) * np.bincount(which)))[which]
    a = phi.T @ (phi * balance[:, None]) + ridge * len(sample) * np.eye(phi.shape[1])
    return Model(langs, places, zf.astype(bool), scale.astype(np.float32), (root @ np.linalg.solve(a, phi.T @ (y * balance[:, None]))).astype(np.float32))


class Scorer:
    def __init__(self, model: Model, batch: int = 64):
        self.model, self.batch = model, batch
        self.landmarks = np.ascontiguousarray(model.landmarks.T.astype(np.float32))
        self.weights = model.scale.astype(np.float64)[:, None] * model.weights.astype(np.float64)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, scores, and the shares of the texts' n-grams that occur in some landmark."""
        m, names, scores, shares = self.model, [], [], []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            x = np.zeros((len(part), len(m.places)), np.float32)
            size, known = np.ones(len(part)), np.zeros(len(part), bool)
            for i, t in enumerate(part):
                if t:
                    row = np.zeros(PLACES, bool)
                    known[i] = presence(t, row)
                    size[i] = max(1, np.count_nonzero(row))
                    x[i] = row[m.places]
            # the first product counts, so it is exact; what the second rounds is cut off, whatever rows share the batch
            f = np.round(((x @ self.landmarks).astype(np.float64) / np.sqrt(size)[:, None]) @ self.weights, 9)
            best = f.argmax(axis=1)
            value = np.clip((f[np.arange(len(part)), best] + 1) / 2, 0, 1)
            names += [m.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, value, 0.0))
            shares.append(np.where(known, x.sum(axis=1) / size, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(shares) if shares else np.zeros(0)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 4, is 2 (a null key counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_lang: int = 300, landmarks_per_lang: int = 32, key: str = "doc_id", text: str = "text", label: str = "lang", full_langs: int = 64) -> Model | None:
    """A model of all labels of the documents outside the held-out fold. With more than `full_langs` labels the sample and
    the landmarks of each label shrink, to one at least, so that the sample of all stays bounded; no label is left out."""
    rows = docs.where(~held_out(key) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(7))
    h = F.when(F.col(key).isNull(), F.xxhash64(F.col(text), F.lit(7))).otherwise(h)
    place = F.pmod(h, F.lit(1 << 30))
    counts = cut(rows.groupBy(F.col(label).alias("__label__")).agg(F.count("*").alias("__count__"), F.min(place).alias("__least__")))
    langs = counts.count()
    if not langs:
        return None
    per_lang, landmarks_per_lang = (max(1, min(n, n * full_langs // langs)) for n in (per_lang, landmarks_per_lang))
    limits = F.broadcast(counts.withColumn("__edge__", F.least(F.lit(1.0), 1.5 * per_lang / F.col("__count__")) * (1 << 30)))
    picked = rows.join(limits, F.col(label) == F.col("__label__")).where((place < F.col("__edge__")) | (place == F.col("__least__")))
    schema = "label string, h long, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, keep = [], []
            for i, t in enumerate(b.column(2)):
                row = np.zeros(PLACES, bool)
                if presence(t.as_py(), row):
                    bits.append(np.packbits(row).tobytes())
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(bits, pa.binary())], names=["label", "h", "bits"])

    found = picked.select(F.col(label).cast("string").alias("label"), h.alias("h"), F.col(text).alias("text")).mapInArrow(tidy(run), schema).collect()
    taken: dict[str, int] = {}
    sample = []
    for lang, _, bits in sorted((r[0], r[1], bytes(r[2])) for r in found):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= 2 * per_lang:
            sample.append((lang, bits))
    return fit(sample, landmarks_per_lang)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_share", T.DoubleType())])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score, and lang_share: which share of the text's n-grams some landmark has, which is low for
    texts of a language or script that no label stands for. The model's size is bounded by its parameters, so it is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value) if held.value is not None else None

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            if scorer is None:
                return [pa.array([UNKNOWN] * len(columns[0])), pa.array([0.0] * len(columns[0])), pa.array([0.0] * len(columns[0]))]
            names, scores, shares = [], [], []
            for at in range(0, len(columns[0]), scorer.batch):
                n, s, c = scorer.score(columns[0][at : at + scorer.batch].to_pylist())
                names += n
                scores.append(s)
                shares.append(c)
            return [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64()), pa.array(np.concatenate(shares), pa.float64())]

        return work

    return annotate(docs, [text], RESULT, make)
