"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, scanned over whole texts.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A window is n
consecutive words of a benchmark item, or all words of an item of fewer. In a document, the words of any occurrence
of a window are hit. Words go through the benchmark's own vocabulary, so only runs of words that it knows are looked
up: first a rolling hash against the set of window hashes, then the words themselves.

The set is broadcast only in blocks of at most `max_windows` windows. A larger benchmark is scanned in several
passes, each with its own block, and what the passes hit is united per document: no window is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kithspark.llm.common import MIX_A, as_bytes, cut, mix, sha256_hex, small_batches

#: Everything that ends a word becomes a space, A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Windows:
    """The windows of some benchmark items, as arrays: of each length, the sorted hashes, the words' numbers in that order,
    and which items hold the window. Some 80 bytes a window of ten words."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list = []
        self.rows: dict[int, tuple[list, list]] = {}
        self.size = 0
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item, windows: list[list[bytes]]) -> None:
        self.items.append(item)
        for window in windows:
            ids, own = self.rows.setdefault(len(window), ([], []))
            ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window], np.uint32))
            own.append(len(self.items) - 1)
        self.size += len(windows)

    def close(self) -> Windows:
        """Sorted by hash; windows with the same words in the same item count once."""
        for size, (ids, own) in self.rows.items():
            whole = np.unique(np.hstack([np.array(ids, np.uint32), np.array(own, np.uint32)[:, None]]), axis=0)
            hashes = self.rolled(whole[:, :size].T.astype(np.uint64))
            order = np.argsort(hashes, kind="stable")
            self.tables[size] = hashes[order], whole[order, :size], whole[order, size]
        self.rows = {}
        return self

    @staticmethod
    def rolled(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = mix(out * np.uint64(MIX_A) + c)
        return out

    def scan(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark in hit the words that occurrences of windows cover; add the items they belong to."""
        n, get = len(words), self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, n)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, windows, owners) in self.tables.items():
            if n < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            h = self.rolled([ids[at + i].astype(np.uint64) for i in range(size)])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(lo < hi).tolist():
                i = at[k]
                same = (windows[lo[k] : hi[k]] == ids[i : i + size]).all(1)
                if same.any():
                    hit[i : i + size] = True
                    items.update(owners[lo[k] : hi[k]][same].tolist())


def window_blocks(benchmark: DataFrame, n: int, max_windows: int, item_col: str, text_col: str) -> Iterator[Windows]:
    """The benchmark's windows in blocks of max_windows; items are read one partition at a time."""
    block = Windows()
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        words = words_of((text or "").encode())
        windows = [words[i : i + n] for i in range(max(1, len(words) - n + 1) if words else 0)]
        for at in range(0, len(windows), max_windows):
            part = windows[at : at + max_windows]
            if block.size and block.size + len(part) > max_windows:
                yield block.close()
                block = Windows()
            block.add(item, part)
    yield block.close()


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """text without its runs of hit words; the space around a run stays."""
    out, last, run = [], 0, None
    for k, m in enumerate(_WORD.finditer(text)):
        if hit[k]:
            run = (run[0] if run else m.start(), m.end())
        elif run:
            out.append(text[last : run[0]])
            last, run = run[1], None
    if run:
        out.append(text[last : run[0]])
        last = run[1]
    return b"".join([*out, text[last:]])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = 1_000_000, cleaned: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with n_words, n_hit, n_items, items_sha256, contaminated.

    With cleaned also clean_text: the text without the hit spans. items_sha256 is the hash of the ids of the items
    found, sorted as strings and comma-joined. Null and empty texts have no words and no hits; so has every document
    where the benchmark is empty. Null texts of items are no windows. An item without an id is counted in n_items, all such
    as one, but isn't in the hash; rows with equal item ids are one item. Repeated rows are judged each for itself. Columns of
    docs that bear a name of the result give way to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"] + ["clean_text"] * cleaned
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    fields = [docs.schema[c] for c in kept]
    state = [T.StructField("__text", docs.schema[text_col].dataType), T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType(), True))]
    out = dict(zip(made, [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.StringType()], strict=False))
    now = docs.select(*kept, docs[text_col].alias("__text"))
    blocks = window_blocks(benchmark, n, max_windows, item_col, item_text_col)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=following is None) -> Iterator[pa.RecordBatch]:
            windows, k = shared.value, len(kept)
            for b in batches:
                rows: list[list] = [[] for _ in (made if last else state[1:])]
                before = zip([None] * b.num_rows, [None] * b.num_rows) if first else zip(b.column(k + 1).to_pylist(), b.column(k + 2).to_pylist(), strict=True)
                for text, (marked, had) in zip(as_bytes(b.column(k)), before, strict=True):
                    words = words_of(text or b"")
                    hit = np.zeros(len(words), bool) if first else np.unpackbits(np.frombuffer(marked, np.uint8), count=len(words)).astype(bool)
                    items: set = set() if first else set(had)
                    own: set[int] = set()
                    windows.scan(words, hit, own)
                    items |= {None if (x := windows.items[i]) is None else str(x) for i in own}
                    n_hit = int(hit.sum())
                    if last:
                        row = [len(words), n_hit, len(items), sha256_hex(",".join(sorted(items - {None})).encode()), n_hit > 0]
                        row += [text if not n_hit else cut_spans(text, hit)] * cleaned
                    else:
                        row = [np.packbits(hit).tobytes(), list(items)]
                    for to, x in zip(rows, row, strict=True):
                        to.append(x)
                if last and cleaned:
                    rows[-1] = [x if x is None else x.decode() for x in rows[-1]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()] if last else [pa.binary(), pa.list_(pa.string())]
                arrays = [pa.array(r, t) for r, t in zip(rows, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k + (not last))), *arrays], names=[*kept, *(made if last else [f.name for f in state])])

        last = following is None
        now = now.mapInArrow(run, T.StructType([*fields, *([T.StructField(c, t) for c, t in out.items()] if last else state)]))
        if not last:
            now = cut(now)
        block, first = following, False
    return now


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, text_col: str = "text", **options) -> DataFrame:
    """docs without its contaminated documents, or (remove="spans") with the hit spans cut out; the columns of docs.

    Spans leave documents in place, if need be with an empty text. Nulls and empty tables as in scan().
    """
    columns = docs.columns
    spare = docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(columns)])
    text = f"__c{columns.index(text_col)}"
    found = scan(spare, benchmark, n, text, cleaned=remove == "spans", **options)
    if remove == "documents":
        found = found.filter("not contaminated")
    return found.select(*[found["clean_text" if remove == "spans" and c == text_col else f"__c{i}"].alias(c) for i, c in enumerate(columns)])
