"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A space goes before the text, and a marked word is a run of spaces with what follows up to the next; no piece of the model
has a space behind another character, so words are encoded one by one. The distinct words that a task hasn't met are
sorted, which makes them a trie read depth-first: the states of the prefix that a word shares with the word before it stay,
and only those behind it are computed.

The state of a prefix is its forward score (the sum of its pieces' scores), its last piece and where that begins. The next
one is the maximum over the pieces that end there of the score before, the piece's own and that of the link between the
two. The public model is a merge model: its scores rank merges, and a plain sum prefers other pieces than the model's. So
the link scores 0 where the two pieces stay apart when merged on their own, and minus infinity where they don't. A row of
pieces whose links are all 0 is the model's segmentation, and for each prefix one last piece only has such a link, so the
search ends at the first. Characters without a piece become byte pieces.

Null and empty texts have no ids and decode to an empty text. Very long texts and words are encoded whole, in time linear
in their length. Decoding gives back every text, except that the mark character itself (a space to the model) comes back
as a space. Of pieces that end at one place one only is the model's, so there are no ties. Repeated rows are encoded one by
one, an empty table gives no rows; columns but the named ones pass through, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of words with their ids that a task remembers (about 190 a word of 10 characters) and the links it remembers (about
#: 110 bytes each). When they are full, remembering starts anew; neither changes a result.
REMEMBERED, LINKS = 64 << 20, 200_000
#: Bytes of text encoded at once: the more, the longer the prefixes that neighbours in the sorted words share.
PORTION = 1 << 20
_NO_MERGE = 1 << 30


class Pieces:
    """The model's pieces (a space in place of the mark), their scores and their merge order."""

    def __init__(self, model: str = MODEL):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        loaded = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = loaded.get_piece_size()
        plain = [i for i in range(n) if not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_byte(i) or loaded.is_unused(i))]
        text = {i: loaded.id_to_piece(i).replace(MARK, " ") for i in plain}
        self.score = {i: loaded.get_score(i) for i in plain}
        self.rank = {text[i]: k for k, i in enumerate(sorted(plain, key=lambda i: (-self.score[i], i)))}
        #: Every piece with its id and every text that a piece ends with, read from the end of a prefix backwards.
        self.ending: dict[str, int] = {p[k:]: -1 for p in text.values() for k in range(1, len(p))}
        self.ending |= {p: i for i, p in text.items()}
        self.text = text
        merging = set("".join(p for p in text.values() if len(p) > 1))
        lone = "".join(re.escape(chr(k)) for k in (*range(32), 127) if chr(k) not in merging)
        #: Marked words; control characters that are in no longer piece merge with nothing and part words too.
        self.word = re.compile(f" +[^ {lone}]*|[^ {lone}]+" + (f"|[{lone}]" if lone else ""))
        self.bytes_ = {int(loaded.id_to_piece(i)[1:-1], 16): i for i in range(n) if loaded.is_byte(i)}
        self.unknown = loaded.unk_id()
        self.width = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.shown = [b"" if loaded.is_control(i) else loaded.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for byte, i in self.bytes_.items():
            self.shown[i] = bytes([byte])

    def merged(self, text: str) -> list[str]:
        """The model's pieces of a short text, by its merges: best rank first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            ranks = [rank.get(a + b, _NO_MERGE) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == _NO_MERGE:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def apart(self, before: int, piece: int) -> bool:
        """Whether two pieces given by id stay apart when merged on their own; before a word (-1): whether the piece is its
        own segmentation. Characters without a piece (below -1) merge with nothing."""
        if piece < -1:
            return True
        own = self.text[piece]
        if before < 0:
            return self.merged(own) == [own]
        left = self.text[before]
        return left + own not in self.rank and self.merged(left + own) == [left, own]


@cache
def pieces(model: str = MODEL) -> Pieces:
    return Pieces(model)


def shared_prefix(a: str, b: str) -> int:
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


class Coder:
    """Encodes texts with the memory of one task: words it has met and links between pieces."""

    def __init__(self, model: Pieces):
        self.model = model
        self.links: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def segmented(self, words: list[str]) -> Iterator[tuple[list[int], float]]:
        """Piece ids and forward score of each of the words, which are sorted. A character c without a piece is -2 - ord(c)."""
        ending, own_score, apart, links = self.model.ending, self.model.score, self.model.apart, self.links
        last, size, score, previous = [-1], [0], [0.0], ""
        for word in words:
            shared = shared_prefix(word, previous)
            del last[shared + 1 :], size[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end
                while True:
                    start -= 1
                    piece = ending.get(word[start:end]) if start >= 0 else None
                    if piece is None:  # no piece ends so: a character of its own
                        start = end - 1
                        if ending.get(word[start:end], -1) >= 0:
                            raise ValueError(f"no segmentation of {word[:end]!r}")
                        piece = -2 - ord(word[start])
                        break
                    if piece >= 0:
                        key = (last[start] << 20) + piece
                        fits = links.get(key)
                        if fits is None:
                            if len(links) >= LINKS:
                                links.clear()
                            fits = links[key] = apart(last[start], piece)
                        if fits:
                            break
                last.append(piece)
                size.append(end - start)
                score.append(score[start] + own_score.get(piece, 0.0))
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[end]
            previous = word
            yield ids[::-1], score[-1]

    def numbered(self, ids: list[int]) -> bytes:
        if min(ids) < 0:
            as_bytes, unknown = self.model.bytes_, self.model.unknown
            ids = [x for i in ids for x in ([i] if i >= 0 else [as_bytes.get(b, unknown) for b in chr(-2 - i).encode()])]
        return struct.pack(f"<{len(ids)}{'H' if self.model.width.itemsize == 2 else 'I'}", *ids)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        find, known = self.model.word.findall, self.words
        split = [find(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        met = set().union(*split)
        missing = sorted(w for w in met if w not in known)
        if self.held > REMEMBERED:
            known = self.words = {}
            self.held, missing = 0, sorted(met)
        new = {w: self.numbered(ids) for w, (ids, _) in zip(missing, self.segmented(missing))}
        known.update(new)
        self.held += sum(150 + 2 * len(w) + len(ids) for w, ids in new.items())
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), self.model.width).astype("<u4").tobytes() for words in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.model.shown.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _portions(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about PORTION bytes of the column, one row at least."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PORTION, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _coded(df: DataFrame, column: str, into: str, kind: T.DataType, arrow: pa.DataType, model: str, code) -> DataFrame:
    """df with a column `into` of what code(coder, values of `column`) gives, portion by portion; memory ends with the task."""
    names = [c for c in df.columns if c != into]
    slim = df.select(*dict.fromkeys([*names, column]))
    schema = T.StructType([*[f for f in slim.schema if f.name in names], T.StructField(into, kind)])
    columns = list(slim.columns)
    at, kept = columns.index(column), [k for k, c in enumerate(columns) if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pieces(model))
        for batch in batches:
            for part in _portions(batch, at):
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(code(coder, part.column(at).to_pylist()), arrow)], names=[*names, into])

    return slim.mapInArrow(run, schema)


def encoded(df: DataFrame, text: str = "text", into: str = "ids", model: str = MODEL) -> DataFrame:
    """df with a binary column `into` (replaced, if there is one): little-endian unsigned 32-bit ids."""
    return _coded(df, text, into, T.BinaryType(), pa.binary(), model, lambda coder, texts: coder.encode([t or "" for t in texts]))


def decoded(df: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with a string column `into` (replaced, if there is one): the text of the ids; null ids give an empty text."""
    return _coded(df, ids, into, T.StringType(), pa.string(), model, lambda coder, all_: [coder.decode(np.frombuffer(b or b"", "<u4")) for b in all_])
