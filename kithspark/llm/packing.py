"""Best-fit packing of token sequences with large-item matching.

1. Each text is encoded once (Arrow batches); what stays of a piece of at most `capacity` tokens is its length and
   a checksum, written to the shared folder.
2. The packing is planned on the histogram of lengths, at most `capacity` numbers whatever the corpus holds: lengths
   above a third of the capacity are matched greedily, largest first with the largest that fits, at most two to a
   sequence; smaller ones, largest first, go to the fullest sequence that has room, and to a new one where none has.
   The plan treats equal lengths as a run of ranks, so each of its slots is one row: length, ranks, first sequence,
   offset.
3. A piece's rank among those of its length is a row number within (length, salt) plus the count of lower salts. A length
   has as many salts as its pieces ask for, so one with a third of all rows is spread; slots are looked up by rank.

The ids of what stands between spaces are kept in a bounded table per Python worker. A text outside the alphabet for which the pre-token
pattern below is exact, or with a special token's string, is encoded by the library as a whole.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithspark.llm.common import CACHE_ENTRIES, cut, few_files, hold, small_batches

#: Characters whose class, case and normal form need no tables: printable ASCII and Latin letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ɏ]*")
#: The pre-token pattern of the vocabulary over those characters, after lower-casing.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-zß-öø-ɏ0-9]+")
#: Bytes as the characters that byte-level vocabularies write for them: the printable ones of Latin-1 stand for
#: themselves, the others follow from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_encoders: dict[str, WordEncoder] = {}
#: Pieces of one length and salt, which are sorted in one task: about so many.
GROUP = 50_000
PIECES = "doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _known(spec: dict) -> bool:
    """Whether encoding pre-token by pre-token, as below, is what the vocabulary's own steps do: NFC, white space to one
    space, lower case; the pattern; bytes; plain merges; nothing after them. Else the library encodes whole texts."""
    normal, steps, model = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", []), spec["model"]
    norms = [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in normal.get("normalizers", [])]
    return (
        norms == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "fuse_unk", "byte_fallback", "ignore_merges"))
        and spec.get("post_processor") is None and not spec.get("truncation") and not spec.get("padding")
        and all(not t["normalized"] and t["content"] == t["content"].lower() and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


class WordEncoder:
    """Ids of a tokenizers vocabulary whose pre-tokens are encoded one by one."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.merges = self.model.model
        self.by_word = _known(spec)
        self.chunks = ChunkIds(self)

    def encode(self, texts: list[str], end: bytes) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text, then end."""
        chunks, out = self.chunks, []
        chunks.trim()
        for text in texts:
            chunks.odd = not self.by_word
            raw = b""
            if not chunks.odd:
                raw = b"".join(map(chunks.__getitem__, text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
            if chunks.odd:
                raw = np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            out.append(np.frombuffer(raw + end, "<u4"))
        return out


class ChunkIds(dict):
    """Ids of what stands between spaces, from the ids of its pre-tokens; both are kept, in bounds.

    A chunk with other characters than _PLAIN or with a special token's string sets odd and isn't kept.
    """

    def __init__(self, encoder: WordEncoder):
        self.encoder, self.words, self.odd = encoder, {}, False

    def __missing__(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk) or any(s in chunk for s in self.encoder.special):
            self.odd = True
            return b""
        parts = []
        for word in _PRETOKEN.findall(chunk):
            ids = self.words.get(word)
            if ids is None:
                written = word if word.isascii() else word.encode().decode("latin-1").translate(_WRITTEN)
                self.words[word] = ids = struct.pack(f"<{len(t := self.encoder.merges.tokenize(written))}I", *[x.id for x in t])
            parts.append(ids)
        self[chunk] = out = b"".join(parts)
        return out

    def clear(self) -> None:
        super().clear()
        self.words.clear()

    def trim(self) -> None:
        if max(len(self), len(self.words)) > CACHE_ENTRIES:
            self.clear()


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece of each text: its place, length, checksum and, if asked for, its ids."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc", "piece", "start", "length", "ids_crc32"] + ["input_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        hold(encoder.chunks)
        for b in batches:
            own = b.column(0).to_pylist()
            rows: list[list] = [[] for _ in names]
            for doc, ids in zip(own, encoder.encode([t or "" for t in b.column(1).to_pylist()], end), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for to, x in zip(rows, (doc, k, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        to.append(x)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=False)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, PIECES.replace("doc bigint", f"doc {kind}") + ", input_ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, ranks, first sequence, offset), sorted by length and rank, and the sequences used."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    sequences = 0

    def place(length: int, k: int, first: int, offset: int) -> None:
        slots.append((length, used[length], k, first, offset))
        used[length] += k
        left[length] -= k

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, min(a, capacity - a)) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] == 1:
            at -= 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            b = large[at] if at >= 0 else 0
        k = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        place(a, k, sequences, 0)
        if b:
            place(b, k, sequences, a)
        gaps.setdefault(capacity - a - b, []).append((sequences, k))
        sequences += k
    rooms = sorted(g for g in gaps if g)

    def room_for(gap: int, run: tuple[int, int]) -> None:
        if gap:
            if gap not in gaps or not gaps[gap]:
                gaps[gap] = []
                if (i := bisect.bisect_left(rooms, gap)) == len(rooms) or rooms[i] != gap:
                    rooms.insert(i, gap)
            gaps[gap].append(run)

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(rooms, s)
            while i < len(rooms) and not gaps[rooms[i]]:
                rooms.pop(i)
            if i < len(rooms):
                gap = rooms[i]
                first, k = gaps[gap].pop()
            else:
                gap, first = capacity, sequences
                k = max(1, left[s] // (capacity // s))
                sequences += k
            each = gap // s
            full = min(k, left[s] // each)
            for j in range(each if full else 0):
                place(s, full, first, capacity - gap + j * s)
            room_for(gap - each * s if full else 0, (first, full))
            if full < k:  # fewer are left than one sequence takes
                few = left[s]
                for j in range(few):
                    place(s, 1, first + full, capacity - gap + j * s)
                if few:
                    room_for(gap - few * s, (first + full, 1))
                    full += 1
                if full < k:
                    room_for(gap, (first + full, k - full))
    out = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return out, sequences


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Pack all of docs into as few sequences of at most `capacity` tokens as best fit finds.

    Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and input_ids with with_ids). Null and
    empty texts are a single end token. Rows with equal or null ids are packed each for itself. Other columns of docs
    aren't read. Ties in length go by salt, id, then piece. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids))
    counts = {r["length"]: r["count"] for r in own.groupBy("length").count().collect()}  # at most capacity rows
    # a length of many pieces is dealt out by salts, some `group` pieces each: as many as the rows ask for
    salts = {n: -(-c // group) for n, c in counts.items() if c > group}
    salt = F.lit(0)
    if salts:
        few = spark.createDataFrame(list(salts.items()), "length bigint, salts int")
        own = own.join(F.broadcast(few), "length", "left").select(*own.columns, F.coalesce("salts", F.lit(1)).alias("salts"))
        salt = F.expr("cast(pmod(xxhash64(doc, piece, ids_crc32), salts) as int)")
    salted = own.withColumn("salt", salt).drop("salts")
    slots, _ = plan(counts, capacity)
    firsts = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
    # how many pieces of a length have a lower salt: a number for each of the salts, some rows / group in all
    start = np.zeros(capacity + 2, np.int64)
    for n in counts:
        start[n + 1] = salts.get(n, 1)
    start = np.cumsum(start)
    below = np.zeros(start[-1], np.int64)
    if salts:
        for r in salted.filter(F.col("length").isin(list(salts))).groupBy("length", "salt").count().collect():
            below[start[r["length"]] + r["salt"]] = r["count"]
    for n, k in salts.items():
        own_counts = below[start[n] : start[n] + k]
        own_counts[:] = np.cumsum(own_counts) - own_counts
    shared = spark.sparkContext.broadcast((start, below, slots, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, below, slot, first = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = below[start[length] + b.column("salt").to_numpy(zero_copy_only=False)] + b.column("rank").to_numpy(zero_copy_only=False) - 1
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = first[n], first[n + 1]
                at[own] = lo + np.searchsorted(slot[lo:hi, 1], rank[own], "right") - 1
            hit = slot[at] if len(at) else np.empty((0, 5), np.int64)
            keep = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], [*names, "sequence_id", "offset"])

    names = [c for c in own.columns if c != "salts"]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32")).cast("bigint"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "salts") + ", sequence_id bigint, offset bigint"
    return few_files(ranked).mapInArrow(run, schema).withColumnRenamed("doc", id_col)
