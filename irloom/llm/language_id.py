"""Operator 6, language ID: error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import arrow_map, documents, id_and_text

#: Byte bigrams and trigrams are hashed to so many features.
FEATURES = 1 << 15
#: The classifiers are fitted on about so many documents of each language, chosen by a hash of their ids.
TRAIN_PER_LANGUAGE = 1500
#: Texts are counted in pieces of so many bytes, to bound memory.
PIECE = 1 << 20
#: Letters are lower-cased and other ASCII characters become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A decision is ambiguous if its score is below this.
AMBIGUOUS = 0.5


def gram_counts(text: str, features: int = FEATURES) -> np.ndarray:
    """How often each hashed byte bigram and trigram occurs in a whole text."""
    data, total = b" " + text.encode("utf-8", "replace").translate(FOLD) + b" ", np.zeros(features)
    for at in range(0, len(data), PIECE):
        a = np.frombuffer(data[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        letters = a != 32
        two = (a[:-1] * np.uint32(2654435761) + a[1:] * np.uint32(40503)) >> np.uint32(7)
        keep = letters[:-1] | letters[1:]
        if at + PIECE + 1 < len(data):
            keep[-1] = False
        total += np.bincount(two[keep] % features, minlength=features)
        if len(a) > 2:
            three = ((a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(2246822519) + a[2:] * np.uint32(3266489917)) * np.uint32(668265263)) >> np.uint32(9)
            total += np.bincount(three[letters[1:-1]] % features, minlength=features)
    return total


def code_matrix(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages: the exhaustive code up to 5, else the best of random ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if i == 0 or bits[i - 1] else -1 for bits in list(itertools.product((0, 1), repeat=n - 1))[:-1]] for i in range(n)], float)
    rng, best, far = np.random.default_rng(0), None, -1.0
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, max(15, int(10 * np.log2(n)))))
        d = (m.shape[1] - m @ m.T) / 2 + np.eye(n) * m.shape[1]
        m = m[:, np.abs(m.sum(0)) < n]
        if d.min() > far:
            best, far = m, d.min()
    return best


def fit(means: np.ndarray) -> dict:
    """Binary classifiers for the bits of the codewords, from each language's mean n-gram frequencies."""
    code, smooth = code_matrix(len(means)), 0.1 / FEATURES
    weights = []
    for bit in code.T:
        a = means[bit > 0].mean(0) + smooth
        b = (means[bit < 0].mean(0) if (bit < 0).any() else np.full(FEATURES, 1 / FEATURES)) + smooth
        weights.append(np.log(a / b))
    w = np.array(weights).T
    margins = (means @ w) * code  # of each language's mean text, positive on the right side
    scale = np.maximum(np.abs(margins).mean(0), 1e-9)
    trust = np.clip(margins.min(0) / scale, 0.05, 1.0)  # a bit that hardly separates some language counts less
    return {"code": code, "w": w / scale, "trust": trust / trust.sum()}


def decode(model: dict, counts: np.ndarray) -> tuple[int, float]:
    """The language whose codeword has the least weighted logistic loss, and its share among all."""
    f = (counts @ model["w"]) / counts.sum()
    loss = (np.logaddexp(0, -4.0 * model["code"] * f) * model["trust"]).sum(1)
    share = np.exp(-8.0 * (loss - loss.min()))
    best = int(loss.argmin())
    return best, float(share[best] / share.sum())


def train(docs: DataFrame, label: str = "lang") -> tuple[list[str], dict | None]:
    """Fits the classifiers on rows with a label and a non-empty text.

    The driver gets one row per language and then FEATURES numbers per language; texts stay on
    the executors.  Rows are chosen by a hash of their id at a rate that gives about
    TRAIN_PER_LANGUAGE of each language.
    """
    rows = id_and_text(docs, F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull() & (F.col("text") != ""))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    names = sorted(sizes)
    if not names:
        return [], None
    rate = F.lit(0.0)
    for name in names:
        rate = F.when(F.col("label") == name, F.lit(min(1.0, TRAIN_PER_LANGUAGE / sizes[name]))).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).select("label", "text")

    def sums(label: list, text: list) -> dict:
        by: dict = {}
        for k, t in zip(label, text, strict=True):
            c = gram_counts(t)
            if c.sum():
                by[k] = by.get(k, 0) + c / c.sum()
        out = [(k, int(i), float(v[i])) for k, v in by.items() for i in np.flatnonzero(v)]
        return {n: [r[j] for r in out] for j, n in enumerate(("label", "feature", "value"))}

    total = arrow_map(chosen, sums, "label string, feature long, value double", ["label", "feature", "value"]).groupBy("label", "feature").agg(F.sum("value").alias("value"))
    means = np.full((len(names), FEATURES), 1e-12)
    for r in total.toLocalIterator():
        means[names.index(r["label"]), r["feature"]] += r["value"]
    return names, fit(means / means.sum(1, keepdims=True))


def predict(docs: DataFrame, names: list[str], model: dict | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), ambiguous.

    und with score 0 where the text is null or has no letter, or where nothing was learned.  Only
    the text is used; ties go to the language first in order.  Texts of any length are read
    whole.  Empty tables give no rows, repeated rows repeat.
    """

    def run(doc_id: list, text: list, names=names, model=model) -> dict:
        lang, score = [], []
        for t in text:
            best, share = -1, 0.0
            if model is not None and next(filter(str.isalpha, t), None):
                counts = gram_counts(t)
                best, share = decode(model, counts) if counts.sum() else (0, 1 / len(names))
            lang.append(names[best] if best >= 0 else "und")
            score.append(share)
        return {"doc_id": doc_id, "lang_pred": lang, "score": score, "ambiguous": [s < AMBIGUOUS for s in score]}

    return arrow_map(id_and_text(docs), run, "doc_id long, lang_pred string, score double, ambiguous boolean", ["doc_id", "lang_pred", "score", "ambiguous"])


def held_out(doc_id="doc_id"):
    """Rows that the classifiers never learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    return predict(docs, *train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) that get a language; und and ambiguous ones go."""
    names, model = train(docs.where(~held_out()))
    cols = docs.columns

    def run(batches):
        for batch in batches:
            keep = []
            for t in batch.column(cols.index("text")).to_pylist():
                ok = bool(t) and model is not None and next(filter(str.isalpha, t), None) is not None
                if ok and (counts := gram_counts(t)).sum():
                    ok = decode(model, counts)[1] >= AMBIGUOUS
                keep.append(ok)
            import pyarrow as pa

            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir))


SQL = None
