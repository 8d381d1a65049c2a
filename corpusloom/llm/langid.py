"""Language identification by a string kernel.

The kernel of two texts counts the n-grams of 1 to 3 letters that both hold (a blended spectrum, by presence),
over the square root of the product of their numbers of n-grams. Nyström: texts are represented by their
kernels with a set of landmark texts, whitened by the landmarks' own kernel matrix. On these, a kernel ridge
regression is fitted for each language against the rest. Scoring is by batches: a presence matrix times the
landmarks' presence matrix gives a batch's kernels, and these times the folded weights its scores.

The model is trained on a bounded sample, the first documents of each language by hash: PER_LANG a language, SAMPLE in
all, LANDMARKS and MARKS of them landmarks, of the MARKS most frequent languages. What the driver holds is bounded by
these: landmarks as bitmaps of BUCKETS bits, and a row of kernels for each document of the sample, which tasks compute.
The model that is broadcast has a bit for each landmark and bucket at most, BUCKETS * MARKS / 8 bytes or 16 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, read, shielded, unit_interval

#: Documents a language in the training sample, and of those the landmarks; and how many of each there are in all at most.
PER_LANG, LANDMARKS = 400, 32
SAMPLE, MARKS, SURPLUS = 4096, 512, 8
#: N-grams fall in so many buckets; each length has its own.
BUCKETS, LENGTHS = 1 << 18, (1, 2, 3)
RIDGE, BATCH, PIECE = 1e-3, 64, 1 << 20
#: Landmarks' bits that are held as numbers at once.
UNPACKED = 1 << 22
#: Two scores' difference counts so much in the softmax that gives the reported score.
SHARPNESS = 6.0
#: Documents whose winner leads by less than this part of the median lead of the learned ones are rejected by ``identified``, however many languages there are.
UNDETERMINED, MIN_LEAD = "und", 0.1
_OTHER = re.compile(r"[\W\d_]+")


def presence(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, without repeats. Letters are lower-cased; all else is one space."""
    found = []
    for k in range(0, len(text), PIECE):  # long texts by overlapping pieces
        piece = " " + _OTHER.sub(" ", text[max(0, k - 4) : k + PIECE].lower()).strip() + " "
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for n in LENGTHS:
            h = np.zeros(max(0, len(c) - n + 1), np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(h)] + np.uint64(n)
            found.append((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 18))
    seen = np.zeros(BUCKETS, bool)
    for f in found:
        seen[f] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray  # the buckets that landmarks hold, in order
    marks: np.ndarray  # which landmarks hold each: packed bits, (vocabulary, landmark / 8)
    sizes: np.ndarray  # of the landmarks, in n-grams
    weights: np.ndarray | None = None  # (landmark + 1, language): whitening and ridge regression in one
    lead: float = 1.0  # the median lead of the texts that it was fitted to

    def __post_init__(self):
        self._held: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": []}  # bits alone are sent to tasks

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of the vocabulary with the landmarks' presence as numbers; kept if it is one part."""
        step = max(1, UNPACKED // len(self.sizes))
        for k in range(0, len(self.vocabulary), step):
            dense = self._held[0] if self._held else np.unpackbits(self.marks[k : k + step], axis=1, count=len(self.sizes)).astype(np.float32)
            if step >= len(self.vocabulary):
                self._held = [dense]
            yield self.vocabulary[k : k + step], dense

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """A batch's kernels with all landmarks: a product of presence matrices."""
        both = np.zeros((len(sets), len(self.sizes)), np.float32)
        for words, dense in self.blocks():
            batch = np.zeros((len(sets), len(words)), np.float32)
            for row, found in zip(batch, sets, strict=True):
                part = found[np.searchsorted(found, words[0]) : np.searchsorted(found, words[-1], "right")]
                at = np.searchsorted(words, part)
                row[at[words[at] == part]] = 1
            both += batch @ dense
        n = np.array([max(1, len(found)) for found in sets], np.float32)
        return both / np.sqrt(n[:, None] * np.maximum(1, self.sizes))

    def raw(self, kernels: np.ndarray) -> np.ndarray:
        return np.hstack([kernels, np.ones((len(kernels), 1), np.float32)]) @ self.weights

    @staticmethod
    def leads(raw: np.ndarray) -> np.ndarray:
        """By how much the winner's score exceeds the next one's, or where there is no other, that of a text of no language."""
        best = np.sort(raw, axis=1)
        return best[:, -1] - (best[:, -2] if raw.shape[1] > 1 else -1.0)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.odds(self.raw(self.kernels(sets)))

    @staticmethod
    def odds(raw: np.ndarray) -> np.ndarray:
        odds = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
        return odds / odds.sum(axis=1, keepdims=True)


def pack(found: np.ndarray) -> bytes:
    """A set of buckets as a bitmap."""
    seen = np.zeros(BUCKETS, bool)
    seen[found] = True
    return np.packbits(seen).tobytes()


def model_of(langs: list[str], bitmaps: list[bytes]) -> Model:
    """A model of landmarks, not fitted yet. Bitmaps are looked through a part at a time."""
    rows = np.stack([np.frombuffer(b, np.uint8) for b in bitmaps])
    sizes = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    any_of = np.unpackbits(np.bitwise_or.reduce(rows, axis=0)).astype(bool)
    marks = np.concatenate([np.packbits(np.unpackbits(rows[:, k : k + 512], axis=1).T, axis=1)[any_of[8 * k : 8 * (k + 512)]] for k in range(0, rows.shape[1], 512)])
    return Model(langs, np.flatnonzero(any_of), marks, sizes)


def fitted(model: Model, kernels: np.ndarray, langs: list[str], ridge: float = RIDGE) -> Model:
    """The model with its weights, by the ``kernels`` of texts in ``langs``: whitened, then a ridge regression a language. Languages count alike."""
    own, vectors = np.linalg.eigh(landmark_kernels(model))
    good = own > 1e-6 * own.max()
    whiten = vectors[:, good] / np.sqrt(own[good])
    x = np.hstack([kernels.astype(np.float64) @ whiten, np.ones((len(kernels), 1))])
    y = np.array([[1.0 if a == b else -1.0 for b in model.langs] for a in langs])
    balance = np.array([1 / langs.count(a) for a in langs])[:, None]
    solved = np.linalg.solve(x.T @ (balance * x) + ridge * np.eye(x.shape[1]), x.T @ (balance * y))
    model.weights = np.vstack([whiten @ solved[:-1], solved[-1:]]).astype(np.float32)
    model.lead = float(np.median(model.leads(model.raw(kernels))))
    return model


def landmark_kernels(model: Model) -> np.ndarray:
    both = sum((dense.T @ dense).astype(np.float64) for _, dense in model.blocks())
    return both / np.sqrt(np.outer(np.maximum(1, model.sizes), np.maximum(1, model.sizes)))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learns from rows of ``docs`` with a language, text and letters; None if there are none.

    The sample is found by hash of doc_id and text, so that rows that share a doc_id are rows of their own, and equal rows
    one. A language's share of rows by hash is cut to SURPLUS times the sample before rows are ranked, so that no task ranks
    more. The table of the sample has SAMPLE rows of hashes at most, so it may be broadcast.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MARKS).collect()
    if not counts:
        return None
    per_lang, marks = (max(1, min(most, total // len(counts))) for most, total in ((per_lang, SAMPLE), (LANDMARKS, MARKS)))
    rates = spark.createDataFrame([(r.lang, SURPLUS * per_lang / r.n) for r in counts], "lang string, rate double")
    near = rows.select("lang", "key").join(F.broadcast(rates), "lang").where(unit_interval(F.col("key")) < F.col("rate")).select("lang", "key").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_lang)
    chosen = rows.join(F.broadcast(materialize(chosen, "langid_sample")), ["lang", "key"]).dropDuplicates(["lang", "key"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [presence(t) for t in b["text"]]
            packed = [pack(f) if p <= marks else None for f, p in zip(found, b["place"], strict=True)]
            yield pd.DataFrame({"lang": b["lang"], "place": b["place"], "found": [f.astype(np.int32) for f in found], "bitmap": packed})

    sample = materialize(chosen.mapInPandas(sets, "lang string, place int, found array<int>, bitmap binary"), "langid_sets")
    landmarks = sample.where("bitmap is not null").select("lang", "place", "bitmap").orderBy("lang", "place").toPandas()
    model = model_of(sorted(landmarks["lang"].unique()), landmarks["bitmap"].tolist())
    kept = spark.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b[k : k + BATCH]
                yield pd.DataFrame({"lang": part["lang"], "place": part["place"], "k": list(kept.value.kernels([np.asarray(f, np.int64) for f in part["found"]]))})

    got = sample.select("lang", "place", "found").mapInPandas(kernels, "lang string, place int, k array<float>").orderBy("lang", "place").toPandas()
    return fitted(model, np.stack(got["k"].tolist()), got["lang"].tolist())


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs``' columns ``keep`` with ``lang_pred``, ``score`` and ``lead`` (in median leads of the learned texts), from the text alone."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> dict[str, list]:
        model, pred, score, lead = kept.value, [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        good = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
        for k in range(0, len(good), BATCH):
            part = good[k : k + BATCH]
            raw = model.raw(model.kernels([presence(texts[i]) for i in part]))
            for i, s, by in zip(part, model.odds(raw).astype(float), model.leads(raw), strict=True):
                pred[i], score[i], lead[i] = model.langs[s.argmax()], min(1.0, s.max()), float(by) / max(model.lead, 1e-9)
        return {"lang_pred": pred, "score": score, "lead": lead}

    return map_texts(docs, make, "lang_pred string, score double, lead double", keep)


def held_out() -> Column:
    """Documents that the model never learns from: crc32 of doc_id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """The other rows; a null doc_id has no crc32, so it is never learned from either."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def language_id(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs`` (``doc_id``, ``text``, ``lang``).

    ``und`` with score 0 if the text is null or has no letter, or if no row could be learned from. Otherwise a
    learned language, even for the shortest text. A null doc_id is not held out, and not learned from. Repeated rows
    are predicted alike. Other columns are left out. Empty table: empty result.
    """
    model = train(learnable(docs), per_lang)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame, min_lead: float = MIN_LEAD, per_lang: int = PER_LANG) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a lead of ``min_lead`` at least; their columns are as they were, whatever their names."""
    plain = shielded(docs, "text")
    found = predict(plain, train(learnable(docs), per_lang), tuple(plain.columns))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lead") >= min_lead)).select(*plain.columns).toDF(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))
