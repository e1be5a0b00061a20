"""Language identification by the nearest centroid.

A text is a normalised TF-IDF vector of hashed letter 2- and 3-grams. Each language has several centroids, found by
spherical k-means; the nearest one by cosine names the language, and texts too far from all are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BITS = 12
DIM = 1 << BITS
CLASSES = 9  # of text lengths
NEW = ("pred", "score", "rejected")
LONG = 3  # the least class whose texts are rejected by the cosines of their own length: 64 letters
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, letters): hashed 2- and 3-gram counts of whole texts, and how many letters each has."""
    low = [(t or "").lower() + " " for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), sizes)
    letter = _letters()[code]
    n_letters = np.bincount(doc[letter], minlength=len(low))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    code, doc, letter = np.where(letter, code, 32)[keep].astype(np.uint32), doc[keep], letter[keep]
    out = np.zeros(len(low) * DIM, np.int64)
    if len(code) > 1:
        a, b, c = (code * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
        shift = np.uint32(32 - BITS)
        same = doc[1:] == doc[:-1]
        pair = (a[:-1] ^ (b[1:] + np.uint32(0x7F4A7C15))) >> shift
        out += np.bincount((doc[1:] * DIM + pair)[same], minlength=len(out))
        triple = (a[:-2] + (b[1:-1] ^ (c[2:] >> np.uint32(3))) * np.uint32(0x27D4EB2F)) >> shift
        inner = (doc[2:] == doc[:-2]) & letter[1:-1]  # no 3-gram spans two words
        out += np.bincount((doc[2:] * DIM + triple)[inner], minlength=len(out))
    return out.reshape(len(low), DIM), n_letters


def _slices(batches: Iterable[pa.RecordBatch], column: int, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of 64 rows, or fewer where texts are long, so that memory does not follow the batch."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n, part = 64, batch.slice(at, 64)
            while n > 1 and part.column(column).nbytes > 4 * chars:
                n //= 2
                part = batch.slice(at, n)
            yield part, part.column(column).to_pylist()
            at += part.num_rows


def vectors(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(grams).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the mean outwards; deterministic."""
    mean = x.mean(0)
    first = int(np.argmax(x @ mean))
    picked = [first]
    near = x @ x[first]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def length_class(letters: np.ndarray) -> np.ndarray:
    """Letters by powers of four."""
    return np.minimum(np.log2(np.maximum(letters, 1)) // 2, CLASSES - 1).astype(int)


@dataclass
class CentroidModel:
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIM, np.float32))
    langs: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # cosines below that of the length class are rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, cosine, rejected) of each text; ``und``, 0 and rejected without a letter or a model."""
        grams, letters = counts(texts)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        sims = vectors(grams, self.idf) @ self.centroids.T
        best = sims.argmax(1)
        score = np.clip(sims[np.arange(len(best)), best], 0, 1).astype(float)
        lang = [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)]
        score[letters == 0] = 0
        return lang, score.tolist(), ((letters == 0) | (score < self.floors[length_class(letters)])).tolist()


def _fitted(lang: str, x: np.ndarray, letters: np.ndarray, clusters: int) -> tuple:
    """(lang, centroids, cosines of the sample with the nearest one, length classes), arrays as bytes."""
    some = (x != 0).any(1)
    x, letters = x[some], letters[some]
    c = kmeans(x, clusters) if len(x) else x
    near = (x @ c.T).max(1) if len(x) else np.zeros(0)
    return lang, c.astype(np.float32).tobytes(), near.astype(np.float32).tobytes(), length_class(letters).astype(np.int8).tobytes()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", clusters: int = 4, sample_per_lang: int = 400, most_langs: int = 1000) -> CentroidModel:
    """Learn from labelled rows. Document frequencies cover all of them; the centroids are fitted on a sample of about
    ``sample_per_lang`` rows of each language (twice that at most), chosen by a hash of ``key_col``, each language in a task of its own.

    The driver gets the centroids, some 70 KB a language; more than ``most_langs`` languages are an error. Null texts count as empty and
    rows without a language teach nothing; an empty table gives a model that rejects all.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(key_col).cast("string")).alias("h"))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(per_lang) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not per_lang:
        return CentroidModel()
    spark, n_docs = docs.sparkSession, sum(per_lang.values())

    def frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM, np.int64)
        for _, texts in _slices(batches, 0):
            total += (counts(texts)[0] > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIM), pa.int32()), pa.array(total)], names=["gram", "n"])

    df = np.zeros(DIM)
    for r in rows.select("text").mapInArrow(frequency, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"]] = r["n"]
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    # At most ``most_langs`` rows.
    share = F.broadcast(spark.createDataFrame([(x, min(1.0, sample_per_lang / n)) for x, n in per_lang.items()], "lang string, share double"))
    picked = rows.join(share, "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    # Repeated rows share a hash, so they are counted as well.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    picked = picked.select("text", "lang", "h", nth.alias("nth")).where(F.col("nth") <= 2 * sample_per_lang).select("text", "lang", "h")

    def embed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, 0):
            grams, letters = counts(texts)
            x = vectors(grams, idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(letters, pa.int64())], names=["lang", "h", "v", "letters"])

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "v"])
        x = np.stack([np.frombuffer(v, np.float16) for v in pdf["v"]]).astype(np.float32)
        return pd.DataFrame([_fitted(pdf["lang"].iloc[0], x, pdf["letters"].to_numpy(), clusters)], columns=["lang", "c", "near", "size"])

    # One row for each language, from a bounded group of vectors.
    found = picked.mapInArrow(embed, "lang string, h long, v binary, letters long").groupBy("lang").applyInPandas(clustered, "lang string, c binary, near binary, size binary")
    found = sorted(found.collect(), key=lambda r: r["lang"])
    cents = [np.frombuffer(r["c"], np.float32).reshape(-1, DIM) for r in found]
    names = [r["lang"] for r, c in zip(found, cents, strict=True) for _ in c]
    if not names:
        return CentroidModel()
    # A quarter of the cosine that all but one in a thousand of the sample reach: short texts of a language are far from
    # its centroids too. Long texts fill the bins, so those of other languages come nearer; there the floor is half of
    # the cosine that all but one in a hundred of the sample's texts of that length reach, and never less than for shorter ones.
    near, size = np.concatenate([np.frombuffer(r["near"], np.float32) for r in found]), np.concatenate([np.frombuffer(r["size"], np.int8) for r in found])
    floors = np.full(CLASSES, 0.25 * float(np.quantile(near, 0.001)))
    floors[:2] /= 2  # under 16 letters a text holds few of its language's grams
    for k in range(LONG, CLASSES):
        same = near[size == k]
        floors[k] = max(floors[k - 1], 0.5 * float(np.quantile(same, 0.01))) if len(same) >= 20 else floors[k - 1]
    return CentroidModel(idf, names, np.concatenate(cents), floors)


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``prefix`` + pred, score and rejected; nothing but the text is read for them.

    A null, empty or letterless text is ``und`` and rejected. Copies get equal answers; other columns pass through
    unread, and an empty table stays empty. A column of ``docs`` with one of the new names is replaced.
    """
    new = [prefix + c for c in NEW]
    kept = [c for c in docs.columns if c.lower() not in new]
    at = kept.index(text_col)
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(src.schema.fields)).add(new[0], "string").add(new[1], "double").add(new[2], "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, at):
            lang, score, out = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*kept, *new])

    return src.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The fold that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2
