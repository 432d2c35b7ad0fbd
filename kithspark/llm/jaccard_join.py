"""Exact Jaccard join of word-shingle sets in size-banded tiles with hashed bitmap signatures.

Sets are 64-bit hashes of k-word shingles; equal sets are one node. Two sets of a and b shingles are linked when
100 * intersection >= percent * union, so their symmetric difference is at most (a + b)(100 - percent)/(100 + percent).

* Bands: sizes are cut into bands, each half as large again as the last. Tile t holds the sets of band t and those of
  band t + 1 that the size bound lets link with one of band t; every linked pair meets in a tile.
* Keys: with D the largest difference in a tile, the hash range is cut into D + 1 parts. A linked pair differs in at
  most D places, so at least one part is equal in both. A set has one key a part, a hash of what it has there.
* Links of a key group go first from each member to its least member. What is linked becomes components; then, in
  groups that still hold more than one component, members of different components are compared in blocks of
  `BLOCK` x `BLOCK`, so that a large group is spread over tasks and pairs that need no proof are never made.
* Bitmaps: a set's hashes toggle bits; the bits in which two bitmaps differ are at most the sets' difference, which
  bounds the overlap from above. Only pairs that pass are intersected, as sorted arrays.

Of a pair of components at most the NEAREST candidates that pass are tried; only if there are more, a second round tries
all between what is still apart. So no link between different texts is lost, and copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithspark.llm.common import MIX_A, MIX_B, MIX_C, WordHashes, as_bytes, cut, few_files, hold, join_counted, mix, shingle_hashes, small_batches
from kithspark.llm.components import connected_components

BLOCK = 512
NEAREST = 4
#: Bits of a bitmap for each unit of the largest difference: a pair 7 % beyond it is mostly told apart.
BITS_PER_DIFFERENCE = 16
#: Ids of candidate documents are broadcast up to this many, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_words = WordHashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the text's words (runs of anything but ASCII white space, A-Z lower-cased)."""
    return np.unique(shingle_hashes(_words.of((text or b"").lower().split()), k))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of the set; n ids collide with a chance of about n^2 / 2^65."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([(mix(hashes + np.uint64(MIX_C)).sum(dtype=np.uint64) + np.uint64(len(hashes)))], np.uint64))[0].astype(np.int64))


class Tiles:
    """The bands of a threshold."""

    def __init__(self, percent: int):
        self.percent = percent

    def of(self, n: int) -> list[tuple[int, int]]:
        """(tile, largest size of its lower band) of a set of n shingles; none where only equal sets could link."""
        out, low, tile, p = [], 1, 0, self.percent
        while True:
            high = max(low, low * 3 // 2 - 1)
            if low <= n <= high or high < n and p * n <= 100 * high:
                if self.difference(high):
                    out.append((tile, high))
            if n <= high:
                return out
            low, tile = high + 1, tile + 1

    def difference(self, high: int) -> int:
        return high * (100 - self.percent) // self.percent

    def allowed(self, a, b):
        """The largest difference of linked sets of a and b shingles."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)


def keys_and_bits(hashes: np.ndarray, tile: int, largest: int) -> tuple[np.ndarray, bytes]:
    parts = largest + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes * np.uint64(MIX_B) + np.uint64(1)), dtype=np.uint64)))
        at = np.searchsorted(hashes, np.array([(j << 64) // parts for j in range(1, parts)], np.uint64))
        edges = np.concatenate(([0], at, [len(hashes)]))
        numbers = np.arange(parts, dtype=np.uint64) + np.uint64(tile << 40)
        keys = mix((sums[edges[1:]] - sums[edges[:-1]]) ^ mix(numbers * np.uint64(MIX_A) + np.uint64(7)))
    width = -(-parts * BITS_PER_DIFFERENCE // 64) * 64
    place = (mix(hashes ^ np.uint64(MIX_A)) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)
    bits = np.packbits((np.bincount(place.astype(np.int64), minlength=width) & 1).astype(bool))
    return keys.astype(np.int64), bits.tobytes()


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A row per document and tile: id, s (set id), n, own (once per document), tile, keys, bits."""
    names = ["id", "s", "n", "own", "tile", "keys", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(percent)
        hold(_words)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(as_bytes(b.column(1))):
                h = shingle_set(text, k)
                s = set_id(h)
                for j, (tile, high) in enumerate(tiles.of(len(h)) if len(h) else []):
                    at.append(i)
                    rows.append((s, len(h), j == 0, tile, *keys_and_bits(h, tile, tiles.difference(high))))
                if not at or at[-1] != i:
                    at.append(i)
                    rows.append((s, len(h), True, -1, np.empty(0, np.int64), b""))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, s bigint, n bigint, own boolean, tile int, keys array<bigint>, bits binary")


def _as_array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), the linked ones: exact intersection of the sorted arrays in sets (s, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = _as_array(x), _as_array(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("s").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each row of x and each of y."""
    return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)


def _near_first(pivots: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, n_a, n_b, bits_a, bits_b), the pairs that size and bitmap let link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(percent)
        for b in batches:
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            far = np.array([np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum() for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            good = (far <= tiles.allowed(na, nb)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    return pivots.mapInArrow(run, "a bigint, b bigint")


def _tile_pairs(groups: DataFrame, roots: DataFrame, light: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet in a key group and that size and bitmap let link.

    nearest: of each pair of components in a block, at most so many, the nearest; `more` marks those that aren't all.
    """
    rows = groups.join(roots.withColumnRenamed("node", "s"), "s", "left")
    rows = cut(rows.select("key", "tile", "s", F.coalesce("root", "s").alias("root")), merge=8)
    apart = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    rows = join_counted(rows, cut(apart.select("key", "size", F.col("size").alias("members")), merge=32), "key", "members")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(s), blocks) as int)"))
    rows = rows.join(light, ["s", "tile"])
    rows = rows.select("key", "s", "n", "root", "own", "bits", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    placed = rows.select("key", "i", "j", "own", "s", "n", "root", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "s")

    def compare(part: list[pa.RecordBatch], out: list[list]) -> None:
        block = pa.Table.from_batches(part).to_pydict()
        s, n, root = (np.array(block[c], np.int64) for c in ("s", "n", "root"))
        bits = np.array([np.frombuffer(x, np.uint64) for x in block["bits"]])
        own = np.array(block["own"])
        one = np.flatnonzero(own == block["i"][0])
        two = one if block["i"][0] == block["j"][0] else np.flatnonzero(own == block["j"][0])
        found: list[tuple[int, int, int, int, int]] = []
        for at in range(0, len(one), 64):
            x = one[at : at + 64]
            far = _differ(bits[x], bits[two])
            good = (root[x][:, None] != root[two][None, :]) & (far <= Tiles(percent).allowed(n[x][:, None], n[two][None, :]))
            good &= 100 * np.minimum(n[x][:, None], n[two][None, :]) >= percent * np.maximum(n[x][:, None], n[two][None, :])
            p, q = np.nonzero(good)
            a, b = x[p], two[q]
            keep = s[a] < s[b] if two is one else np.ones(len(a), bool)
            for u, v, d in zip(a[keep].tolist(), b[keep].tolist(), far[p, q][keep].tolist(), strict=True):
                found.append((min(root[u], root[v]), max(root[u], root[v]), d, min(s[u], s[v]), max(s[u], s[v])))
        found.sort()
        last, run = None, 0
        for f in found:
            run = run + 1 if f[:2] == last else 1
            last = f[:2]
            if nearest is None or run <= nearest:
                out[0].append(int(f[3]))
                out[1].append(int(f[4]))
                out[2].append(False)
            elif run == nearest + 1:
                out[2][-1] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        label = None
        for b in batches:
            marks = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            out: list[list] = [[], [], []]
            for lo, hi in zip(starts, starts[1:], strict=False):
                own = tuple(marks[lo].tolist())
                if own != label and waiting:
                    compare(waiting, out)
                    waiting = []
                label = own
                waiting.append(b.slice(lo, hi - lo))
            yield batch(out)
        if waiting:
            out = [[], [], []]
            compare(waiting, out)
            yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "more"])

    return placed.mapInArrow(work, "a bigint, b bigint, more boolean").groupBy("a", "b").agg(F.bool_or("more").alias("more"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links) of every document.

    Null, empty and wordless texts are the empty set, linked with nothing: their component is their own id. A text of
    fewer than k words is one shingle. Rows with equal ids keep a row each; a null id ranks behind all others in its
    component. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    signed = cut(_signatures(docs, id_col, text_col, k, percent))
    members = signed.filter("own").select("id", "s", "n")
    nodes = cut(signed.filter("tile >= 0").groupBy("s", "tile").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), merge=8)
    light = nodes.select("s", "tile", "n", "bits")
    keyed = nodes.select("s", "tile", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("s").alias("pivot"), F.max("s").alias("hi"), F.count("*").alias("members")).filter("pivot < hi")
    groups = join_counted(keyed, cut(shared.drop("hi"), merge=32), "key", "members")
    groups = cut(groups.select("key", "tile", "s", "pivot"), merge=8)

    needed = cut(members.join(groups.select("s").distinct(), "s", "left_semi").groupBy("s").agg(F.min("id").alias("rep")), merge=32)
    reps = needed.select(F.col("rep").alias("__rep")).distinct()
    reps = F.broadcast(reps) if needed.count() <= BROADCAST_IDS else reps

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_words)
        for b in batches:
            sets = [shingle_set(t, k) for t in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["s", "hashes"])

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    texts = texts.join(reps, F.col("__id").eqNullSafe(F.col("__rep")), "left_semi").select("__text")
    sets = cut(texts.mapInArrow(arrays, "s bigint, hashes binary").groupBy("s").agg(F.first("hashes").alias("hashes")), merge=8)

    one, two = (light.select(F.col("s").alias(x), "tile", F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b"))
    pivots = groups.filter("s <> pivot").select(F.col("pivot").alias("a"), F.col("s").alias("b"), "tile").distinct()
    pivots = pivots.join(one, ["a", "tile"]).join(two, ["b", "tile"]).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    first = _near_first(pivots, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = cut(first, merge=32)
    links = cut(_verify(tried, sets, percent), merge=32)
    for nearest in (NEAREST, None):
        found = cut(_tile_pairs(groups, connected_components(links), light, percent, nearest), merge=32)
        pairs = found.select("a", "b").join(tried, ["a", "b"], "left_anti")
        tried = tried.unionByName(pairs)
        links = links.unionByName(cut(_verify(pairs, sets, percent), merge=32))
        if found.filter("more").isEmpty():
            break
    roots = connected_components(links)

    least = members.filter("n > 0").groupBy("s").agg(F.min("id").alias("least"))
    least = least.join(roots.select(F.col("node").alias("s"), "root"), "s", "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(of_root, "root").select("s", "component_id")
    out = few_files(members.join(named, "s", "left"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """docs with one document of each component, that with its smallest id; the columns of docs.

    Rows that share an id are one document and stay or go together. Nulls as in jaccard_components().
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    kept = found.filter(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
