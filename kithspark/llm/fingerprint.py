"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's words (as in decontamination) give shingles of `k` words (fewer words: one shingle of all). The sketch keeps
every distinct shingle hash below a fixed fraction of the hash range, and of texts with few such hashes the `LEAST` smallest
(of shorter texts: all). So a sketch knows all of its text's hashes below its bound: the fraction, or beyond it what the
least hashes reach. Two sketches are compared below the lower of their bounds, which is fair however unequal the documents
are; short texts are compared exactly. Sketches merge by union below the lower bound. A text is written as

    <distinct shingles>:<bound>:<kept hashes, sorted>

bound and hashes as 8 letters of URL-safe base64 (the hashes' upper 48 bits). Likeness is the Jaccard similarity of what both
keep below the bound, containment the part of one that the other has. Two texts without words are alike.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithspark.llm.common import WordHashes, hold, shingle_hashes, small_batches
from kithspark.llm.decontaminate import words_of

#: Hashes that a sketch keeps at least, if the text has them.
LEAST = 64
#: The bound of a sketch that keeps everything.
ALL = (1 << 48) - 1
_words = WordHashes()


class Sketch:
    """kept: sorted hashes below bound, all of them that the text has; n: its distinct shingles."""

    __slots__ = ("n", "bound", "kept")

    def __init__(self, n: int, bound: int, kept: np.ndarray):
        self.n, self.bound, self.kept = n, bound, kept

    @classmethod
    def of(cls, text: bytes, fraction: float, k: int) -> Sketch:
        h = np.unique(shingle_hashes(_words.of(words_of(text)), k) >> np.uint64(16))
        if len(h) <= LEAST:
            return cls(len(h), ALL, h)
        bound = max(int(fraction * (1 << 48)), int(h[LEAST]))
        return cls(len(h), bound, h[: np.searchsorted(h, np.uint64(bound))])

    def below(self, bound: int) -> np.ndarray:
        return self.kept if bound >= self.bound else self.kept[: np.searchsorted(self.kept, np.uint64(bound))]

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts together; n becomes an upper bound."""
        bound = min(self.bound, other.bound)
        return Sketch(self.n + other.n, bound, np.union1d(self.below(bound), other.below(bound)))

    def _compare(self, other: Sketch) -> tuple[int, int, int]:
        """Hashes below both bounds of this one, of the other, of both."""
        bound = min(self.bound, other.bound)
        a, b = self.below(bound), other.below(bound)
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        if not self.n or not other.n:
            return float(self.n == other.n)
        a, b, both = self._compare(other)
        return both / (a + b - both) if a + b else 0.0

    def containment(self, other: Sketch) -> float:
        """The estimated part of this text's shingles that the other has; 0 where none lies below both bounds."""
        if not self.n:
            return 1.0
        a, _, both = self._compare(other)
        return both / a if a else 0.0

    def __str__(self) -> str:
        packed = np.concatenate(([np.uint64(self.bound)], self.kept)).astype(">u8")
        letters = base64.urlsafe_b64encode(packed.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()
        return f"{self.n}:{letters[:8]}:{letters[8:]}"

    @classmethod
    def read(cls, written: str) -> Sketch:
        n, bound, kept = written.split(":")
        raw = np.frombuffer(base64.urlsafe_b64decode(bound + kept), np.uint8).reshape(-1, 6)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, 2:] = raw
        h = h.reshape(-1).view(">u8").astype(np.uint64)
        return cls(int(n), int(h[0]), h[1:])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = 0.125, k: int = 5) -> DataFrame:
    """id_col and fingerprint of every whole text. A map over rows, without a shuffle.

    Null text counts as empty. Null and repeated ids and repeated rows keep a row each, with equal fingerprints for equal
    texts. Other columns aren't read, so they may bear any name. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_words)
        for b in batches:
            prints = [str(Sketch.of((t or "").encode(), fraction, k)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


Place = tuple  # (id, hash of the text): what documents are ordered by


def _ranges(docs: DataFrame, id_col: str, text_col: str, parts: int) -> list[Place]:
    """The first place of each of up to `parts` even ranges, in order; a row a range."""
    places = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    even = places.repartitionByRange(parts, F.col("id").asc_nulls_first(), "h")
    firsts = even.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("first"))
    return [(r["first"]["id"], r["first"]["h"]) for r in sorted(firsts.collect(), key=lambda r: r["part"])]


def _before(place: Place, kind: T.DataType):
    """Whether a row's place (id, h) comes before this one."""
    id_, h = place
    if id_ is None:
        return F.col("id").isNull() & (F.col("h") < h)
    value = F.lit(id_).cast(kind)
    return F.col("id").isNull() | (F.col("id") < value) | ((F.col("id") == value) & (F.col("h") < h))


def _range_of(firsts: list[Place], kind: T.DataType):
    """The number of the range that a row's place lies in: a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(_before(firsts[mid], kind), tree(lo, mid - 1)).otherwise(tree(mid, hi))

    return tree(0, len(firsts) - 1)


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int, handle, schema: T.StructType) -> DataFrame:
    """handle(rows with each its next row) over docs in ascending id; after the last comes the first.

    Texts are shuffled once, to even ranges of (id, hash of the text), so neither null nor repeated ids meet in one task.
    The first row of a range is also sent to the range before it (that of the first range to the last), so each row
    meets its next one in its own task.
    """
    firsts = _ranges(docs, id_col, text_col, parts)
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("own", _range_of(firsts, kind))
    # a range's first place, by its number; rows with the same id and text are alike, so each may go along
    first_id = F.get(F.array(*[F.lit(i).cast(kind) for i, _ in firsts]), F.col("own"))
    is_first = F.col("id").eqNullSafe(first_id) & (F.col("h") == F.get(F.array(*[F.lit(h) for _, h in firsts]), F.col("own")))
    before = F.pmod(F.col("own") + F.lit(len(firsts) - 1), F.lit(len(firsts)))
    at = lambda r, extra: F.struct(r.alias("r"), F.lit(extra).alias("extra"))
    rows = rows.select("id", "text", "h", F.explode(F.when(is_first, F.array(at(F.col("own"), 0), at(before, 1))).otherwise(F.array(at(F.col("own"), 0)))).alias("t"))
    rows = rows.select("id", "text", "t.r", "t.extra", "h")
    placed = rows.repartitionById(len(firsts), F.col("r")).sortWithinPartitions("r", "extra", F.col("id").asc_nulls_first(), "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            done: list[tuple] = []
            for id_, text, r, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if waiting and waiting[2] == r:
                    done.append((*waiting[:2], text))
                    waiting = None
                if not extra:
                    waiting = (id_, text, r)
            yield from handle(done, b.schema.field(0).type)

    return placed.mapInArrow(run, schema)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = 0.125, k: int = 5, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of an edited copy and that of the next document.

    The edited text has its last quarter (floor) of code points replaced by the first as many, or all, of the next
    document by ascending id; after the last document comes the first. Columns: id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next (likeness, 0 to 1), and contained_edited (the part of the
    document that its edited text contains). Ids are of any type that can be ordered. Null text counts as empty; null ids
    come first; rows with equal ids go by the text's hash, repeated rows follow each other. A lone document is its own next
    one. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def handle(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, c = None, None
        hold(_words)
        for id_, text, following in rows:
            text, following = text or "", following or ""
            q = len(text) // 4
            edited = (text[: len(text) - q] + following[:q]).encode()
            a = c if text == last else Sketch.of(text.encode(), fraction, k)
            b = a if edited == text.encode() else Sketch.of(edited, fraction, k)
            c, last = Sketch.of(following.encode(), fraction, k), following
            out.append((id_, len(text), hashlib.sha256(edited).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c), a.containment(b)))
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited"]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    for name, kind in [("n_chars", "long"), *[(c, "string") for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(c, "double") for c in ("near_edited", "near_next", "contained_edited")]]:
        schema.add(name, kind)
    return with_next(docs, id_col, text_col, parts, handle, schema).withColumnRenamed("id", id_col)
