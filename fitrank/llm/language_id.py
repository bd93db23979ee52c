"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of hashed byte trigrams of its lower-cased letters. Every language has
several centroids, found by spherical k-means; a text takes the language of the nearest by cosine and is rejected
where even that one is too far for a text of its length. Learned from at most `per_language` labelled rows of
each language, and `sample_rows` of all (bounds on the sample; the rows are those of the smallest hash of their id, so
that reruns agree); applied to all rows. Whole texts of the sample become trigram counts where they lie, each language
is clustered in a task of its own, and centroids and one cosine a row reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

BITS = 13
UNKNOWN = "und"
#: ASCII bytes that are no letters become one space each.
_LETTERS = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Trigrams of a text by hash; a run of spaces counts as one."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(1 << BITS, np.float32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class Model:
    languages: tuple
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # language of each
    floors: np.ndarray  # least cosine by length class

    def vectors(self, texts: list[str]) -> np.ndarray:
        return _unit(np.sqrt(np.array([counts(t) for t in texts])) * self.idf)

    def predict(self, texts: list) -> list[tuple]:
        """(language, score, rejected) of each text; score is the cosine to the nearest centroid."""
        out: list = [(UNKNOWN, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if known:
            near = self.vectors([texts[i] for i in known]) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, j, cosine in zip(known, best.tolist(), near.max(axis=1).clip(0, 1).tolist()):
                out[i] = (self.languages[self.owner[j]], float(cosine), cosine < self.floors[length_class(texts[i])])
        return out


def length_class(text: str) -> int:
    """0 to 15 by doubling of the number of characters."""
    return min(15, len(text).bit_length())


def cluster(x: np.ndarray, centroids: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids of unit rows, each row's cosine to the nearest). Starts from the mean and then from the texts
    farthest from what is there."""
    centre = _unit(x.mean(axis=0, keepdims=True))
    while len(centre) < min(centroids, len(x)):
        centre = np.vstack([centre, x[(x @ centre.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        to = (x @ centre.T).argmax(axis=1)
        centre = _unit(np.array([x[to == j].mean(axis=0) if (to == j).any() else centre[j] for j in range(len(centre))]))
    return centre.astype(np.float32), (x @ centre.T).max(axis=1)


def rejection_floors(classes: np.ndarray, cosines: np.ndarray, margin: float) -> np.ndarray:
    """Least cosine by length class: `margin` times the 2 % quantile of the cosines that training texts have to their own
    language's nearest centroid. A class of fewer than 20 takes the floor of the next shorter one; where there is none,
    nothing is known of such texts and none is rejected."""
    floors, low = np.zeros(16), 0.0
    for c in range(16):
        if (classes == c).sum() >= 20:
            low = float(np.quantile(cosines[classes == c], 0.02)) * margin
        floors[c] = low
    return floors


def _idf(n: int, with_term: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + with_term)).astype(np.float32) + 1


NOTHING = Model((), np.zeros(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), np.zeros(0, np.int64), np.zeros(16))


def train(rows: list[tuple[str, str]], centroids: int = 4, rounds: int = 12, margin: float = 0.5) -> Model:
    """From (text, language) rows in memory."""
    rows = [(t, g) for t, g in rows if has_letter(t)]
    languages = tuple(sorted({g for _, g in rows}))
    if not languages:
        return NOTHING
    tf = np.array([counts(t) for t, _ in rows])
    idf = _idf(len(rows), (tf > 0).sum(axis=0))
    x, of = _unit(np.sqrt(tf) * idf), np.array([languages.index(g) for _, g in rows])
    found = [cluster(x[of == k], centroids, rounds) for k in range(len(languages))]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c, _ in found])
    cosines = np.zeros(len(rows))
    for k, (_, cosine) in enumerate(found):
        cosines[of == k] = cosine
    classes = np.array([length_class(t) for t, _ in rows])
    return Model(languages, idf, np.vstack([c for c, _ in found]), owner, rejection_floors(classes, cosines, margin))


def is_held_out(name: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = 400, sample_rows: int = 12_800, languages: int = 256) -> DataFrame:
    """lang, mark, doc_id, length_class and the trigrams (codes, counts) of the sample: rows not held out, with a letter
    and one of the `languages` most frequent languages (ties by name); of each language those of the smallest hash of their
    id, `per_language` or its share of `sample_rows` at most."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(~is_held_out())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    most = max(1, min(per_language, sample_rows // max(1, len(sizes))))
    # no more than a few times as many rows meet in a language's window
    every = F.create_map(*[F.lit(x) for g, n in sorted(sizes.items()) for x in (g, max(1, n // (2 * most)))]) if sizes else F.lit(None).cast("map<string,int>")
    near = usable.withColumn("mark", F.xxhash64("doc_id")).where(F.pmod("mark", F.element_at(every, F.col("lang"))) == 0)
    schema = "lang string, mark long, doc_id long, length_class int, codes array<int>, counts array<float>"

    def count(batches):
        for batch in batches:
            rows = []
            for doc_id, text, lang, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if has_letter(text):
                    n = counts(text)
                    codes = np.flatnonzero(n)
                    rows.append((lang, mark, doc_id, length_class(text), codes.astype(np.int32), n[codes]))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "mark", "doc_id", "length_class", "codes", "counts"])

    counted = near.select("doc_id", "text", "lang", "mark").mapInArrow(count, schema)
    first = Window.partitionBy("lang").orderBy("mark", "doc_id", "codes", "counts")
    return counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("place")


def fit(docs: DataFrame, per_language: int = 400, sample_rows: int = 12_800, centroids: int = 4, rounds: int = 12, margin: float = 0.5, languages: int = 256) -> Model:
    """The model of the bounded sample; a language's rows meet in one task (`per_language` at most)."""
    small_batches(docs.sparkSession)
    sample = written(training_sample(docs, per_language, sample_rows, languages), "sample")
    n = sample.count()
    if not n:
        return NOTHING
    with_term = np.zeros(1 << BITS)
    for r in sample.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # at most 2 ** BITS rows
        with_term[r["code"]] = r["count"]
    idf = _idf(n, with_term)

    def one(key, batch):
        rows = sorted(batch.to_pylist(), key=lambda r: (r["mark"], r["doc_id"], r["codes"], r["counts"]))
        tf = np.zeros((len(rows), 1 << BITS), np.float32)
        for row, r in zip(tf, rows):
            row[r["codes"]] = r["counts"]
        centre, cosine = cluster(_unit(np.sqrt(tf) * idf), centroids, rounds)
        return pa.table({"lang": [key[0].as_py()], "centroids": pa.array([centre.ravel()], pa.list_(pa.float32())), "classes": pa.array([[r["length_class"] for r in rows]], pa.list_(pa.int32())), "cosines": pa.array([cosine.astype(float)], pa.list_(pa.float64()))})

    found = sorted(sample.groupBy("lang").applyInArrow(one, "lang string, centroids array<float>, classes array<int>, cosines array<double>").collect(), key=lambda r: r["lang"])
    centres = [np.array(r["centroids"], np.float32).reshape(-1, 1 << BITS) for r in found]
    classes, cosines = (np.concatenate([r[name] for r in found]) for name in ("classes", "cosines"))
    owner = np.repeat(np.arange(len(found)), [len(c) for c in centres])
    return Model(tuple(r["lang"] for r in found), idf, np.vstack(centres), owner, rejection_floors(classes, cosines, margin))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), rejected, for every whole text.

    A text that is null or has no letter is `und`, score 0, rejected; so is every text where nothing could be
    learned. Repeated rows and null ids give a row each; other columns are ignored; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pred, score, rejected = zip(*known.value.predict(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([bool(r) for r in rejected], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield part.filter(pa.array([not r for _, _, r in known.value.predict(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
