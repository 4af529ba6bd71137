"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector of hashed byte 3-grams of its lower-cased letters, weighted by
damped frequency and inverse document frequency and brought to length 1.  Each
language has several centroids, from spherical k-means over a bounded labelled
sample; the predicted language is that of the centroid of greatest cosine.  A text
is rejected where it lies farther from every centroid than texts of its length do
in the sample, or has no letter.

Null texts and texts without a letter are ``und`` with score 0 and rejected; equal
cosines go to the language first in order.  Repeated rows get equal results, extra
columns are ignored.  Without labelled rows every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import bounded_sample, made_apart, worker_cache

#: Dimensions of the hashed n-gram space, centroids of a language.
DIMS, CENTROIDS = 4096, 3
#: A text is rejected below this share of the least cosine of its length class.
REJECT_SHARE = 0.5
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # all else that is ASCII separates


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, a row for each text, from the whole text; runs of separators count once."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in enumerate(texts):
        b = _FOLD[np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", dtype=np.uint8)]
        gap = b == 32
        b = b[~(gap & np.r_[False, gap[:-1]])]
        if len(b) >= 3:
            gram = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
            out[row] = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray | None = None
    idf: np.ndarray | None = None
    floors: np.ndarray | None = None  # least cosine by the logarithm of the number of n-grams

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for start in range(0, len(known), 256):
            part = known[start : start + 256]
            tf = counts([texts[i] for i in part])
            near = _unit(np.log1p(tf) * self.idf) @ self.centroids.T
            best, size = near.argmax(axis=1), _size_class(tf)
            for i, k, cosines, s in zip(part, best, near, size, strict=True):
                cosine = float(min(1.0, max(0.0, cosines[k])))
                out[i] = self.languages[k], cosine, bool(cosine < REJECT_SHARE * self.floors[s])
        return out


def _size_class(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(tf.sum(axis=1) + 1).astype(int), 31)


def train(rows: list[tuple[str, str]], k: int = CENTROIDS) -> Model:
    """Fit idf, centroids and rejection floors on (text, language) rows."""
    rows = [(t, lang) for t, lang in rows if t and LETTER.search(t)]
    if not rows:
        return Model()
    tf = np.concatenate([counts([t for t, _ in rows[i : i + 500]]) for i in range(0, len(rows), 500)])
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(tf) * idf)
    lang = np.array([r[1] for r in rows])
    names, middle = [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        c = own[np.linspace(0, len(own) - 1, min(k, len(own))).astype(int)]
        for _ in range(12):
            to = (own @ c.T).argmax(axis=1)
            c = _unit(np.stack([own[to == j].mean(axis=0) if (to == j).any() else c[j] for j in range(len(c))]))
        names += [name] * len(c)
        middle.append(c)
    centroids = np.concatenate(middle).astype(np.float32)
    cosine, size = (x @ centroids.T).max(axis=1), _size_class(tf)
    floors = np.full(32, np.inf)
    np.minimum.at(floors, size, cosine)
    seen = np.flatnonzero(np.isfinite(floors))
    for s in np.flatnonzero(~np.isfinite(floors)):  # lengths that the sample lacks
        shorter, longer = seen[seen < s], seen[seen > s]
        floors[s] = floors[shorter[-1]] if len(shorter) else floors[longer[0]] * 0.5 ** (longer[0] - s)
    return Model(names, centroids, idf, floors)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None, sample_docs: int = 4000, sample_bytes: int = 32_000_000) -> Model:
    """Train on a sample of labelled documents, evenly over the languages.

    `sample_docs` and `sample_bytes` bound the sample, in rows and in bytes of their
    whole texts; equal rows count once in it.  It is trained on in a task of its own.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("kind"), F.col(text_col).alias("text"))
    names = max(1, known.select("kind").distinct().count())
    _, drawn = bounded_sample(known, max(1, sample_docs // names), sample_bytes // names, "language sample")
    return made_apart(drawn.select("id", "kind", "text"), _from_sample)


def _from_sample(rows: list[tuple]) -> Model:
    return train([(text, kind) for _, kind, text in sorted(rows)])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """All rows and columns of `docs` with a struct column `out_col`: lang, score, rejected.

    A column of that name is replaced.
    """
    book = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def language(texts):
        import pandas as pd

        worker_cache("language")
        return pd.DataFrame(book.value.predict(texts.tolist()), columns=["lang", "score", "rejected"]).astype({"score": "float64", "rejected": "bool"})

    return docs.withColumn(out_col, language(F.col(text_col)))
