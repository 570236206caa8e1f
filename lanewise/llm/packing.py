"""Concatenate and cut: token sequences of one length from documents of any length.

Pass one tokenises each document once and writes its ids with their running position in the task's own stream. The
totals of the partitions, one row a task, then become prefix sums, which with the running positions give every document
its global offset. Pass two cuts at the multiples of the sequence length: a document that crosses such a boundary leaves
a boundary record on either side. All sequences but the last are full, so padding is under one sequence in total.

Null texts count as empty and pack as their end mark alone. Repeated rows are packed once each. Very long texts are cut
as often as needed; nothing is dropped. Documents lie in the order of tasks and rows, which decides between ties. An empty
table gives no pieces. Columns other than the named ones are left alone, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import staged

LENGTH = 4096
VOCABULARY = "word_bpe_49k.json"
END = 2
#: Distinct words that a task remembers, and the longest of them in characters.
CACHE, CACHED_WORD = 200_000, 64
_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")
#: A text of these characters only is plain: its words can be cut and made small without the tokenizer.
_NOT_PLAIN = re.compile("[^\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ÿ]|<\\|")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class _Cache(dict):
    """Word -> its ids as bytes. Starts anew when full; what it holds never changes a result."""

    def __init__(self, encode: Callable[[str], list[int]], width: np.dtype):
        super().__init__()
        self.encode, self.code = encode, {2: "H", 4: "I"}[width.itemsize]

    def __missing__(self, word: str) -> bytes:
        ids = struct.pack(f"<{len(ids)}{self.code}", *ids) if word and (ids := self.encode(word)) else b""
        if len(word) <= CACHED_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids as the vocabulary file's tokenizer gives them, with a memory for words.

    This tokenizer makes letters small, drops white space and merges bytes within words only. Plain texts are cut into
    words here and merged from the same file's ranks (each word's end is a byte that UTF-8 never uses); all other texts
    go to the tokenizer itself, run by run between ASCII white space. The memory is a task's own and ends with it, so
    that workers that Spark uses again hold the ranks only.
    """

    def __init__(self, vocabulary: str):
        merge, size = _merger(vocabulary)
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.words = _Cache(merge, self.width)
        self.runs = _Cache(lambda run: _tokenizer(vocabulary).encode(run, add_special_tokens=False).ids, self.width)

    def __call__(self, text: str) -> bytes:
        if _NOT_PLAIN.search(text):
            return b"".join(map(self.runs.__getitem__, text.translate(_TO_SPACE).split(" ")))
        return b"".join(map(self.words.__getitem__, _PLAIN_WORDS.findall(text.lower())))


@cache
def _tokenizer(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


@cache
def _merger(vocabulary: str) -> tuple[Callable[[str], list[int]], int]:
    """Merges a word's bytes by the file's ranks (a token's id is its rank, as each merge made one token); the ids' bound."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    size = 1 + max([*model["vocab"].values(), *(t["id"] for t in whole["added_tokens"])])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    suffix, ranks = model["end_of_word_suffix"], {}
    for token, rank in model["vocab"].items():
        ends = token.endswith(suffix) and token != suffix
        body = token.removesuffix(suffix) if ends else token
        if all(c in byte for c in body) and not token.startswith("<|"):
            ranks[bytes(byte[c] for c in body) + b"\xff" * ends] = rank
    ranks.setdefault(b"\xff", max(ranks.values()) + 1)
    merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return (lambda word: merge(word.encode() + b"\xff")), size


def tokenised(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(key, ids: little-endian bytes of `width` bytes an id, width, doc_tokens, part, part_start), written once."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        stop, size = np.asarray([end], encode.width).tobytes(), encode.width.itemsize
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                chunk = batch.slice(lo, 512)
                ids = [encode(t) + stop for t in chunk.column(1).to_pylist()]
                n = np.asarray([len(x) // size for x in ids], np.int64)
                start = seen + np.cumsum(n) - n
                seen += int(n.sum())
                rows = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), pa.array(ids, pa.binary()), pa.array(np.full(rows, size, np.int32)), pa.array(n), pa.array(np.full(rows, part, np.int32)), pa.array(start)],
                    names=["key", "ids", "width", "doc_tokens", "part", "part_start"],
                )

    return staged(slim.mapInArrow(run, f"key {key_type}, ids binary, width int, doc_tokens bigint, part int, part_start bigint"), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """Tokens before each partition of pass one: one row a task, so one small window over all of them."""
    total = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


#: Offsets are broadcast up to so many tasks of pass one (16 bytes each), beyond that joined by a shuffle.
BROADCAST_PARTS = 100_000


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """One row a piece: key, start (ids of its document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (end mark included), sequence_id, offset (its place in the sequence)."""
    tokens = tokenised(docs, key, text, vocabulary, end)
    base = offsets(tokens)
    if tokens.select("part").distinct().count() <= BROADCAST_PARTS:
        base = F.broadcast(base)
    placed = tokens.join(base, "part").select("key", "ids", "width", "doc_tokens", (F.col("part_offset") + F.col("part_start")).alias("at"))
    key_type = placed.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(2).to_numpy()
            n, at = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * length, at[doc])
            stop = np.minimum((sequence + 1) * length, (at + n)[doc])
            for lo in range(0, len(doc), 4096):
                some = slice(lo, lo + 4096)
                ids, held, raw = [], -1, None
                for d, a, b in zip(doc[some].tolist(), (begin - at[doc])[some].tolist(), (stop - at[doc])[some].tolist()):
                    if d != held:
                        raw, held = np.frombuffer(batch.column(1)[d].as_buffer(), f"<u{width[d]}"), d
                    ids.append(raw[a:b].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc[some])),
                        pa.array((begin - at[doc])[some]),
                        pa.array((stop - begin)[some]),
                        pa.array(ids, pa.binary()),
                        pa.array(n[doc[some]]),
                        pa.array(sequence[some]),
                        pa.array((begin - sequence * length)[some]),
                    ],
                    names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    out = placed.mapInArrow(cut, f"key {key_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_padding): the pieces of each sequence joined in order and padded to its length. A sequence
    holds at most `length` ids, so no group is larger than that."""
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("filled")
    )
    padding = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), (length - F.col("filled")).cast("int"))
    body = F.aggregate("parts", F.lit("").cast("string"), lambda all_, p: F.concat(all_, F.hex(p["ids"])))
    return joined.select("sequence_id", F.unhex(F.concat(body, padding)).alias("ids"), (length - F.col("filled")).alias("n_padding"))
