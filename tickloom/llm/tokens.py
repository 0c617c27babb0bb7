"""Encoding of whole texts with a public tokenizer.

Texts up to CHUNK characters are encoded as they are. Longer ones are cut into chunks that overlap, the chunks are
pre-tokenised in parallel, and neighbouring chunks are stitched at the first place in their overlap where both have a
pre-token boundary: from a common boundary on, both give the same pre-tokens, as a match depends only on the text that
follows. The pieces between the stitches are encoded on their own and their ids put together. Where an overlap has no common
boundary (one pre-token runs through it), the chunks on both sides make one piece.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 8192, 512
#: Characters that a match may look ahead of its end.
LOOKAHEAD = 3


def tokenizer_dir() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.__file__)


@functools.lru_cache(2)
def encoding(folder: str, name: str):
    """The tiktoken encoding of <folder>/<name>.tiktoken, without special tokens: their strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, last: bool) -> list[int]:
    """Where pre-tokens begin in the text, as far as they are sure: unless it is the last chunk, what follows the cut could
    change a match that ends within LOOKAHEAD characters of it."""
    sure = len(text) if last else len(text) - LOOKAHEAD
    return [0, *(e for m in _pattern().finditer(text) if (e := m.end()) <= sure and e < len(text))]


def _ids(lists: list[list[int]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id_col and ids (array of int) of each row: the ids of its whole text without special tokens. A null and an empty text
    have an empty list. One row for each input row, also for repeated rows and null ids. Other columns are dropped, so
    clashing names do no harm. An empty table gives no rows."""
    folder = folder or tokenizer_dir()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("id"), _ids([enc.encode_ordinary(t) if t else [] for t in texts])], ["id", "ids"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("id"), b.column("text").to_pylist()):
                starts = range(0, len(t), chunk)
                for lo in range(0, len(starts), 64):
                    ks = range(lo, min(lo + 64, len(starts)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.as_py()] * len(ks), i.type), pa.array(ks, pa.int32()), pa.array([len(starts)] * len(ks), pa.int32()), pa.array([t[k * chunk : (k + 1) * chunk + overlap] for k in ks])],
                        ["id", "k", "n", "part"],
                    )

    def pretokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for k, n, t in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), b.column("part").to_pylist()):
                marks = boundaries(t, k == n - 1)
                heads.append([m for m in marks if m < overlap])
                tails.append([m - chunk for m in marks if m >= chunk])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), b.column("n"), _ids(heads), _ids(tails)], ["id", "k", "n", "head", "tail"])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            ids = [enc.encode_ordinary(t[s:e]) for t, s, e in zip(b.column("part").to_pylist(), b.column("start").to_pylist(), b.column("end").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), _ids(ids)], ["id", "k", "ids"])

    short = docs.filter(~long).mapInArrow(whole, f"id {kind}, ids array<int>")
    # long texts go by a digest of id and text, each once
    named = docs.filter(long).groupBy("id", "text").agg(F.count(F.lit(1)).cast("int").alias("times"))
    named = named.withColumn("key", F.sha2(F.concat_ws("\0", F.when(F.col("id").isNull(), "n").otherwise("i"), F.col("id").cast("string"), "text"), 256))
    owners, docs, kind = named.select("key", F.col("id").alias("owner"), "times"), named.select(F.col("key").alias("id"), "text"), "string"
    chunks = docs.mapInArrow(cut, f"id {kind}, k int, n int, part string").repartition("id", "k")
    marks = chunks.mapInArrow(pretokenise, f"id {kind}, k int, n int, head array<int>, tail array<int>")
    # the stitch between chunk k - 1 and k, relative to the start of chunk k: matched on (id, k), never a text at a time
    ends = marks.filter("k < n - 1").select("id", (F.col("k") + 1).alias("k"), "tail")
    stitch = marks.select("id", "k", "n", "head").join(ends, ["id", "k"], "left").select(
        "id", "k", "n", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("at")
    )
    # chunks without a stitch between them, as one pre-token runs from one into the next, are one piece; w: a row for each chunk
    w = Window.partitionBy("id").orderBy("k")
    spans = stitch.withColumns({"piece": F.count("at").over(w), "next": F.lead("at").over(w)})
    spans = spans.withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("id", "piece")))
    spans = spans.select("id", "k", "piece", "chunks", F.coalesce("at", F.lit(0)).alias("start"), F.when(F.col("k") < F.col("n") - 1, chunk + F.coalesce("next", F.lit(0))).alias("end"))
    spans = chunks.join(spans, ["id", "k"]).withColumn("end", F.coalesce("end", F.length("part")))
    several = spans.filter("chunks > 1").select("id", "piece", F.struct("k", F.expr("substring(part, start + 1, end - start)").alias("part")).alias("x"))
    several = several.groupBy("id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("part"))
    several = several.select("id", F.col("piece").alias("k"), "part", F.lit(0).alias("start"), F.length("part").alias("end"))
    done = (
        spans.filter("chunks = 1").select("id", F.col("piece").alias("k"), "part", "start", "end").unionAll(several)
        .mapInArrow(pieces, f"id {kind}, k bigint, ids array<int>")
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))  # one text's result
        .select("id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    )
    again = F.explode(F.array_repeat(F.lit(1), F.col("times")))
    back = done.join(owners, F.col("id") == F.col("key")).select(F.col("owner").alias("id"), "ids", again.alias("_"))
    return short.unionAll(back.select("id", "ids")).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """id_col and text of rows with ids: the raw bytes of the ids put together. An empty list gives an empty text, a null list
    a null text; bytes that are no UTF-8 are replaced."""
    folder = folder or tokenizer_dir()
    kind = encoded.schema[id_col].dataType.simpleString()

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(back, f"id {kind}, text string").select(F.col("id").alias(id_col), "text")
