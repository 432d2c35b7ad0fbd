"""Language identification by string kernels: blended n-gram presence, Nyström landmarks, kernel ridge regression.

k(x, y) = shared distinct byte n-grams of 2, 3 and 4 bytes of the lower-cased texts / sqrt(those of x * those of y).
A bounded sample of labelled documents (`per_language` of each language in expectation, chosen by a hash of the id)
trains one ridge regression per language on the Nyström features of `landmarks` of them. As K(x, landmarks) is a
product of x's presence row with the landmarks' presence matrix, the regression weights are carried back through that
matrix once, and a batch of texts is scored by one product of its presence rows with an n-gram x language matrix.
n-grams are hashed to `1 << BITS` columns. Whole texts count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithspark.llm.common import small_batches

BITS = 17
UNDETERMINED = "und"
#: What one step of the scoring product may take.
BLOCK_BYTES = 16 << 20
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


class Presence:
    """Distinct hashed n-grams of texts; the marks are reused from text to text."""

    def __init__(self):
        self.marks = np.zeros(1 << BITS, bool)

    def of(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
        if len(a) < 2:
            return np.empty(0, np.int64)
        two = a[:-1] << 8 | a[1:]
        three = two[:-1] << 8 | a[2:]
        four = three[:-1] << 8 | a[3:]
        marks = self.marks
        for grams, odd in ((two, 0x9E3779B1), (three, 0x85EBCA77), (four, 0xC2B2AE3D)):
            marks[(grams * np.uint32(odd) ^ grams >> 15) * np.uint32(0x27D4EB2F) >> (32 - BITS)] = True
        at = np.flatnonzero(marks)
        marks[at] = False
        return at


class Model:
    """languages, an n-gram x language matrix and the intercepts."""

    def __init__(self, languages: list[str], weights: np.ndarray, intercepts: np.ndarray):
        self.languages, self.weights, self.intercepts = languages, weights, intercepts

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """A batch's presence matrix (sparse: the places of its ones, row by row) times the weights, in blocks whose rows
        of weights take at most BLOCK_BYTES, or one row's worth."""
        sizes = np.array([len(at) for at in rows])
        out = np.zeros((len(rows), len(self.languages)), np.float32)
        full = np.flatnonzero(sizes)
        room = max(1, BLOCK_BYTES // (4 * max(1, len(self.languages))))
        block = (np.cumsum(sizes[full]) - 1) // room
        for own in np.split(full, np.flatnonzero(np.diff(block)) + 1) if len(full) else []:
            starts = np.cumsum(sizes[own]) - sizes[own]
            product = np.add.reduceat(self.weights[np.concatenate([rows[i] for i in own])], starts, axis=0)
            out[own] = product / np.sqrt(sizes[own], dtype=np.float32)[:, None]
        return out + self.intercepts


def fit_rows(rows: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression on Nyström features of presence rows, one against the rest."""
    languages = sorted(set(labels))
    order: list[int] = []  # landmarks: the languages take turns
    by = {c: [i for i, x in enumerate(labels) if x == c and len(rows[i])] for c in languages}
    while len(order) < landmarks and any(by.values()):
        for own in by.values():
            if own and len(order) < landmarks:
                order.append(own.pop())
    if not order:
        return Model(languages, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    marks = np.zeros((len(order), 1 << BITS), bool)
    for k, i in enumerate(order):
        marks[k, rows[i]] = True
    size = np.sqrt(marks.sum(1))
    kernel = np.array([marks[:, at].sum(1) / size / np.sqrt(max(1, len(at))) for at in rows])
    values, vectors = np.linalg.eigh(kernel[order])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K(x, landmarks) @ root: the Nyström features
    features = np.hstack([kernel @ root, np.ones((len(rows), 1))])
    wanted = np.array([[x == c for c in languages] for x in labels], float)
    w = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ wanted)
    through = root @ w[:-1] / size[:, None]
    weights = np.zeros((1 << BITS, len(languages)), np.float32)
    for k in range(len(order)):
        weights[marks[k]] += through[k].astype(np.float32)
    return Model(languages, weights, w[-1].astype(np.float32))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, landmarks: int = 160, ridge: float = 0.5, max_languages: int = 200, max_sample: int = 20_000) -> Model | None:
    """Fit on a bounded sample of labelled documents: about per_language of each of at most max_languages languages, and
    max_sample of all; whole texts, whose hashed n-grams (at most 512 kB a document, some kB as a rule) come to the driver.

    The weights take 512 kB a language, so max_languages bounds what is broadcast: 100 MB. Each language has a landmark at
    least. Repeated rows count as often as they stand there, all or none of an id. None where no document has a language
    and a text. More languages than max_languages are an error.
    """
    small_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(labelled.groupBy(lang_col).count().limit(max_languages + 1).collect())
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    per_language = max(1, min(per_language, max_sample // len(counts)))
    landmarks = max(landmarks, len(counts))
    rate = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_language / n))])
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 20)) < rate[F.col(lang_col)] * float(1 << 20)
    sample = labelled.filter(chosen).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for b in batches:
            rows = [presence.of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array([x.astype("<i4").tobytes() for x in rows], pa.binary())], ["id", "lang", "grams"])

    got = sample.mapInArrow(run, "id string, lang string, grams binary").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    return fit_rows([np.frombuffer(x.as_buffer(), "<i4") for x in got.column("grams")], got.column("lang").to_pylist(), landmarks, ridge) if got.num_rows else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score, from the text alone.

    Null, empty and letterless texts are `und` with score 0; so is every text without a model. Ties go to the first
    language by name. Columns of docs that bear a name of the result give way to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, own = Presence(), shared.value
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            known = [own is not None and has_letter(t) for t in texts]
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if any(known):
                scores = own.score([presence.of(t) if k else np.empty(0, np.int64) for t, k in zip(texts, known, strict=True)])
                best, score = scores.argmax(1), np.clip(scores.max(1), 0, 1)
            lang = [own.languages[i] if k else UNDETERMINED for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(kept))), pa.array(lang, pa.string()), pa.array([float(s) if k else 0.0 for s, k in zip(score, known, strict=True)], pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)
