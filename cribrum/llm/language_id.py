"""Language ID: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import mix
from .tables import documents, stage

#: Lengths of the n-grams of characters whose presence is compared.
GRAMS = (1, 2, 3)
#: n-grams are hashed into this many presence bits.
BITS = 1 << 13
#: Landmarks at least; more if there are more languages, so that each has one.
LANDMARKS = 160
RIDGE = 1e-2
#: Training reads about this many documents of each language, and fewer (but at least one) of each
#: where that would make more than SAMPLE of all.  What is collected are their presence bits, 1 KB each.
PER_LANG, SAMPLE = 600, 6_000
#: Languages up to which their shares are broadcast.
BROADCAST_LANGS = 100_000


def presence(texts: list[str]) -> np.ndarray:
    """Presence bits (float32) of the n-grams of each whole text, lower case, other than letters as one blank.

    Long texts are taken in pieces that overlap by the longest n-gram less one,
    so that memory does not grow with them.
    """
    bits = np.zeros((len(texts), BITS), np.float32)
    for row, text in enumerate(texts):
        for at in range(0, len(text), 1 << 20):
            piece = text[max(0, at - max(GRAMS) + 1) : at + (1 << 20)].lower()
            codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            low = codes < 128
            letters = ~low | ((codes >= 97) & (codes <= 122))
            codes = np.where(letters, codes, np.uint64(32))
            for n in GRAMS:
                if len(codes) < n:
                    continue
                gram = codes[: len(codes) - n + 1].copy()
                for i in range(1, n):
                    gram = (gram << np.uint64(21)) | codes[i : len(codes) - n + 1 + i]
                gram = np.uint64(n) + gram * np.uint64(4)
                bits[row, (mix(gram) >> np.uint64(40)).astype(np.int64) & (BITS - 1)] = 1
    return bits


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    """Landmark bits, and for each language the weights of the landmark kernels."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1) * np.maximum(self.landmarks.sum(axis=1), 1))
        return (bits @ self.landmarks.T) / norm

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margins = self.kernel(presence(texts)) @ self.weights
        best = margins.argmax(axis=1)
        # One-versus-rest targets are -1 and 1; the score is the share of the best of all margins above -1.
        share = np.clip(margins + 1, 1e-6, None)
        return [self.langs[b] for b in best], share[np.arange(len(best)), best] / share.sum(axis=1)


def fit(bits: np.ndarray, langs: list[str]) -> LanguageModel:
    """One-versus-rest ridge regression on Nystroem features of the given presence bits."""
    names = sorted(set(langs))
    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    # Landmarks take turns over the languages, in the order of the sample.
    by_lang: dict[str, list[int]] = {name: [] for name in names}
    for i, lang in enumerate(langs):
        by_lang[lang].append(i)
    turns = [group[t] for t in range(max(map(len, by_lang.values()))) for group in by_lang.values() if t < len(group)]
    model = LanguageModel(names, bits[turns[: max(LANDMARKS, len(names))]], np.zeros((0, 0)))
    among = model.kernel(model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    usable = values > 1e-6 * values.max()
    whiten = vectors[:, usable] / np.sqrt(values[usable])
    features = model.kernel(bits).astype(np.float64) @ whiten
    # Languages weigh alike, however often they occur.
    weight = (1.0 / target.shape[1]) / np.array([len(by_lang[lang]) for lang in langs])[:, None]
    gram = (features * weight).T @ features
    solution = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), (features * weight).T @ target)
    model.weights = (whiten @ solution).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed presence bits of the texts that have letters."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            keep = [i for i, t in enumerate(part.column("text").to_pylist()) if has_letter(t)]
            part = part.take(pa.array(keep, pa.int64()))
            packed = np.packbits(presence(part.column("text").to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([row.tobytes() for row in packed], pa.binary())], names=["lang", "bits"])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """Learn from the rows that are not held out, of non-null text and lang.

    A bounded sample is enough and is what is read: for each language about
    ``per_lang`` documents of its share of SAMPLE, chosen by a hash of doc_id and text, whole texts.
    Rows that repeat are chosen together; languages whose texts have no letter are not learned.
    """
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    usable = usable.select("text", "lang", lot.alias("lot"), F.col("text").rlike("\\p{L}").alias("letters")).where("letters")
    counts = stage(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("lot").alias("first")), "languages")
    n_langs = counts.count()
    if not n_langs:
        return None
    most = max(1, min(per_lang, SAMPLE // n_langs))
    # The row of least lot is always in, so that no language is left out.
    share = counts.select("lang", F.greatest(F.col("first"), (F.lit(float(most) * (1 << 30)) / F.col("n")).cast("long")).alias("most"))
    share = F.broadcast(share) if n_langs <= BROADCAST_LANGS else share
    sample = usable.join(share, "lang").where("lot <= most").select("text", "lang").mapInArrow(_bit_rows, "lang string, bits binary")
    # One more pass bounds what rows that repeat can add: at most 2 * most equal rows of a language come to the driver.
    kept = sample.groupBy("lang", "bits").count().collect()
    if not kept:
        return None
    rows = [(bytes(r.bits), r.lang) for r in kept for _ in range(min(r["count"], 2 * most))]
    rows.sort(key=lambda r: (crc32(r[0]), *r))
    return fit(np.unpackbits(np.frombuffer(b"".join(b for b, _ in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32), [lang for _, lang in rows])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 if the text is null or has no letter (empty texts
    too), or if nothing could be learned.  Only the text is an input, whole, a
    million characters at a time; of languages that tie the first by name is
    taken.  Rows that repeat get equal rows, columns besides doc_id and text are
    not read, and an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                lang, value = ["und"] * len(texts), np.zeros(len(texts))
                if known:
                    names, scores = model.predict([texts[i] for i in known])
                    value[known] = scores
                    for i, name in zip(known, names):
                        lang[i] = name
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(value)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` over documents, learned from the rows of crc32(doc_id) mod 4 other than 2; edge cases as there."""
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
