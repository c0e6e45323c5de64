"""Language ID by nearest centroid.

A text is a vector of hashed letter bigrams and trigrams, (1 + log count) * idf, of length one. Each language
has several centroids, found by spherical k-means, and a text gets the language of the centroid that is
nearest by cosine. Rejection is by distance: a centroid has a radius, the cosine that all but REJECT of its own
sample reach, and a text beyond it is rejected.

Document frequencies come from all training documents; the centroids are fitted on a bounded sample of them,
MAX_DOCS documents over all languages and MAX_PER_LANGUAGE of one (documents of up to MAX_CHARS characters; of a
language that has no such documents, longer ones), but LEAST_PER_LANGUAGE of each at least. Every language is learned.

Defined results: ``und`` with score 0 for a null text or one without letters, or if nothing was learned; null
languages aren't learned. Equal cosines go to the language that comes first by code point. Repeated rows are
each predicted; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: Hashed dimensions, centroids of a language, and the sample's bounds.
DIMENSIONS, CENTROIDS, MAX_DOCS, MAX_PER_LANGUAGE, MAX_CHARS, REJECT = 8192, 4, 4000, 600, 30_000, 0.005
#: Of many languages, so many documents of each are drawn at least (none is left without by the draw).
LEAST_PER_LANGUAGE = 16
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of the hashed letter bigrams and trigrams of the lower-cased text."""
    words = _LETTERS.findall((text or "").lower())
    if any(not w.isalpha() for w in words):  # digits and numbers that \d doesn't know aren't letters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    u = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    two = u[:-1] * np.uint32(0x9E3779B1) + u[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + u[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    ids = np.concatenate([two, three])
    ids = ((ids ^ (ids >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(19)
    counts = np.bincount(ids, minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # [centroid, dimension], of length one
    radii: np.ndarray  # least cosine of each centroid
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        at, counts = grams(text)
        if not len(at) or not self.languages:
            return "und", 0.0, True
        v = (1 + np.log(counts)) * self.idf[at]
        cosines = self.centroids[:, at] @ v / max(1e-12, float(np.sqrt(v @ v)))
        k = int(cosines.argmax())
        return self.languages[k], float(min(1.0, max(0.0, cosines[k]))), bool(cosines[k] < self.radii[k])


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means and each row's cluster; begins at the mean's nearest row, then at the farthest rows."""
    k = min(k, len(x))
    mean = x.sum(axis=0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(k - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        for j in range(k):
            total = x[of == j].sum(axis=0)
            n = np.linalg.norm(total)
            if n:
                c[j] = total / n
    return c, (x @ c.T).argmax(axis=1)


def fit_vectors(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, k: int = CENTROIDS) -> Model:
    """rows: (language, dimensions, counts)."""
    languages, centroids, radii = [], [], []
    for lang in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == lang and len(r[1])]
        if not own:
            continue
        x = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, (_, at, counts) in enumerate(own):
            x[i, at] = (1 + np.log(counts)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, of = clusters(x, k)
        for j in range(len(c)):
            if (of == j).any():
                languages.append(lang)
                centroids.append(c[j])
                radii.append(float(np.quantile(x[of == j] @ c[j], REJECT)))
    return Model(languages, np.array(centroids, np.float32).reshape(-1, DIMENSIONS), np.array(radii), idf.astype(np.float32))


def fit(docs: DataFrame, where: Column | None = None, max_docs: int = MAX_DOCS) -> Model:
    """Learns from text and lang of the documents that where (over doc_id) admits."""
    rows = docs.where(F.lit(True) if where is None else where).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches):
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at, _ = grams(t)
                total[at] += 1
                total[DIMENSIONS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["d", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for r in common.map_batches(rows.select("text"), frequencies, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect():  # DIMENSIONS + 1 rows at most
        df[r["d"]] = r["n"]
    idf = np.log((1 + df[DIMENSIONS]) / (1 + df[:DIMENSIONS])) + 1
    short = F.length("text") <= MAX_CHARS
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(short, 1)).alias("short")).collect()  # a row for each language
    n = {r["lang"]: r["short"] or r["n"] for r in counted}
    only_long = [r["lang"] for r in counted if not r["short"]]
    if not n:
        return fit_vectors([], idf)
    per = max(LEAST_PER_LANGUAGE, min(MAX_PER_LANGUAGE, max_docs // len(n)))
    share = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, per / k))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1_000_003))
    drawn = rows.where((short | F.col("lang").isin(only_long)) & (draw < F.element_at(share, F.col("lang")) * 1_000_003))

    def vectors(batches):
        for batch in batches:
            found = [grams(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in found], pa.binary())], ["doc_id", "lang", "at", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = common.map_batches(drawn, vectors, f"doc_id {kind}, lang string, at binary, counts binary").limit(2 * max(max_docs, per * len(n))).collect()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], bytes(r["at"])))
    return fit_vectors([(r["lang"], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<f4").astype(np.float64)) for r in sample], idf)


def identify(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text: str = "text", reject: bool = True) -> DataFrame:
    """columns, then lang_pred, score (the cosine) and rejected; with reject, a rejected text's lang_pred is ``und``."""
    rows = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__body"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers for each centroid

    def run(batches):
        m = sent.value
        for batch in batches:
            out = [m.predict(t) for t in batch.column("__body").to_pylist()]
            langs = ["und" if reject and x[2] else x[0] for x in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], [*columns, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return common.map_batches(rows, run, f"{kinds}, lang_pred string, score double, rejected boolean")
