"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies.

A pre-token is a run of spaces with the run of other characters after it. No piece of the vocabulary holds a
space mark after another character (checked when the model is loaded), so merges never cross the bounds of pre-tokens and
a text's count is the sum over its pre-tokens.

1. The corpus's distinct pre-tokens, each with how often it occurs: counted within tasks, then by one shuffle.
2. Each is encoded, once, and only its number of pieces is kept; the table is written to the shared folder.
3. Per-document frequencies are joined to it. The most frequent pre-tokens, as many as ENTRIES entries of at most
   ENTRY_CHARS characters, are broadcast and joined where the text is read; a document's other ones, few as they are, are
   joined by a shuffle and summed. No list of a document's ids is made.

A model whose pieces may cross spaces is left to the library: whole texts are encoded, and their ids counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithspark.llm.common import cut, join_counted, small_batches

#: Pre-tokens that are broadcast: at most so many, of at most so many characters.
ENTRIES, ENTRY_CHARS = 400_000, 64
#: Different pre-tokens that a task counts before it passes them on; longer ones than ENTRY_CHARS aren't held back.
HELD = 300_000
_SPACED = re.compile(r" +[^ ]*")
_models: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        n = spec.normalizer_spec
        self.split = (
            n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
            and not n.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces)
            and not any(p.type == 4 for p in spec.pieces)
        )

    def pretokens(self, text: str) -> list[str]:
        """Each without its first space, which the library puts in front of what it encodes."""
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in _SPACED.findall(" " + text)]
        return text.split(" ")

    def pieces(self, pretokens: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        out = [len(ids) for ids in self.model.encode(pretokens, num_threads=1)]
        if "" in pretokens:  # one lone space, for which the library sees no text; two less one tell its pieces
            out[pretokens.index("")] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        return out


def _counter(path: str) -> PieceCounter:
    if path not in _models:
        _models[path] = PieceCounter(path)
    return _models[path]


def piece_table(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(p, n, pieces): the distinct pre-tokens of all texts, how often each occurs, and of how many pieces it is made."""
    small_batches(docs.sparkSession)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = _counter(model_path), Counter()

        def out(of: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(of), pa.string()), pa.array(list(of.values()), pa.int64())], ["p", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.update(counter.pretokens(t))
            long = {p: n for p, n in held.items() if len(p) > ENTRY_CHARS}
            for p in long:
                del held[p]
            if long:
                yield out(long)
            if len(held) > HELD:
                yield out(held)
                held = Counter()
        yield out(held)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counter.pieces(b.column(0).to_pylist()), pa.int64())], ["p", "n", "pieces"])

    counts = docs.select(text_col).mapInArrow(distinct, "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    return cut(counts.mapInArrow(encode, "p string, n bigint, pieces bigint"))


def _by_frequency(pieces: DataFrame, entries: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent short pre-tokens, at most `entries`, which are those above a step of frequency; and all others."""
    short = pieces.filter(F.length("p") <= ENTRY_CHARS)
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)  # some 500 rows at most
    least, left = None, entries
    for at, n in steps:
        if n > left:
            break
        least, left = at, left - n
    frequent = F.lit(False) if least is None else (F.length("p") <= ENTRY_CHARS) & (step >= least)
    return pieces.filter(frequent), pieces.filter(~frequent)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, entries: int = ENTRIES) -> DataFrame:
    """Tokens of every whole text: id_col, n_bytes, n_tokens, over_limit; a row per row of docs.

    Null text counts as empty: no bytes, no tokens. Null or repeated ids keep a row each. Other columns of docs
    aren't read, so their names can't clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    out = [F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    if not PieceCounter(model_path).split:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                n = [len(_counter(model_path).model.encode(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

        return docs.select(id_col, text_col).mapInArrow(whole, f"id {kind}, n_bytes bigint, n_tokens bigint").select(*out)
    pieces = piece_table(docs, model_path, text_col)
    frequent, others = _by_frequency(pieces, entries)
    frequent = frequent.select("p", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _counter(model_path), shared.value
        for b in batches:
            size, total, rest = [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                size.append(len(t.encode()))
                found, missing = 0, []
                for p, n in Counter(counter.pretokens(t)).items() if t else ():
                    if (k := known.get(p)) is None:
                        missing.append((p, n))
                    else:
                        found += k * n
                total.append(found)
                rest.append(missing)
            rest = pa.array([[{"p": p, "times": n} for p, n in own] for own in rest], pa.list_(pa.struct([("p", pa.string()), ("times", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), rest], ["id", "n_bytes", "found", "rest"])

    rows = docs.select(id_col, text_col).mapInArrow(join, f"id {kind}, n_bytes bigint, found bigint, rest array<struct<p: string, times: bigint>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = join_counted(rows.select("row", F.inline("rest")), others, "p")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare"))
    rows = rows.drop("rest").join(rare, "row", "left")
    return rows.withColumn("n_tokens", F.col("found") + F.coalesce("rare", F.lit(0))).select(*out)
