"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary and its scores come from a model file; nothing is trained. A text gets the usual dummy space in
front, spaces become U+2581, and among all ways to write it in pieces the one with the largest sum of scores is
taken (of equal sums, the one whose last piece is longer). A character without a piece of its own costs the
unknown penalty and is written as its UTF-8 bytes, as is U+2581 itself, so decoding gives back every text.

The search moves over the text with a window of the longest piece. Ids are committed when the back-pointers of
all positions that a later piece can start from meet at one boundary; what lies before is forgotten. Where no
piece of the vocabulary holds two neighbouring characters, that boundary is certain beforehand: such stretches
(words, mostly) are looked up in a bounded table of those seen before. A text is read in blocks, so memory does
not grow with its length but for the ids themselves.

Null text gives null ids, empty text none. Repeated rows are encoded alike; an empty table gives an empty one;
only id and text are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, MARK_ITSELF = "▁", "\udc00"  # a lone surrogate stands for U+2581 in a text: no text holds one
UNKNOWN_PENALTY = 10.0
BLOCK = 1 << 18
CHECK_EVERY = 64
SEEN = 200_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, id
    bytes_ids: tuple[int, ...]                  # ids of the 256 byte pieces
    decoded: tuple[bytes, ...]                  # by id
    name: str

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain, raw, decoded = [], {}, []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                raw[int(piece[3:-1], 16)] = i
                decoded.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                plain.append((piece, sp.get_score(i), i))
                decoded.append(piece.replace(MARK, " ").encode())
        if len(raw) != 256:
            raise ValueError("the model has no byte pieces")
        return cls(tuple(plain), tuple(raw[b] for b in range(256)), tuple(decoded), f"{path}:{size}")


class Encoder:
    """A vocabulary made ready for the search; one per Python worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        known = {p: (s, i) for p, s, i in vocabulary.pieces}
        self.longest = max(map(len, known))
        self.unknown = min(s for s, _ in known.values()) - UNKNOWN_PENALTY
        #: a tree of characters: (children, score, id), id -1 where no piece ends
        self.root: dict = {}
        for piece, (score, number) in known.items():
            children = self.root
            for c in piece[:-1]:
                children = children.setdefault(c, [{}, 0.0, -1])[0]
            children.setdefault(piece[-1], [{}, 0.0, -1])[1:] = score, number
        self.bytes_ids, self.decoded = vocabulary.bytes_ids, vocabulary.decoded
        chars = sorted({c for p in known for c in p})
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.joined = np.zeros(self.width * self.width, dtype=bool)
        for piece in known:
            n = self.number[[ord(c) for c in piece]]
            self.joined[n[:-1] * self.width + n[1:]] = True
        self.seen: dict[str, bytes] = {}    # two generations of stretches, each bounded
        self.before: dict[str, bytes] = {}

    def search(self, text: str) -> Iterator[int]:
        """Ids of a stretch, committed as soon as all surviving paths agree."""
        n, root, unknown, longest = len(text), self.root, self.unknown, self.longest
        never = -np.inf
        # of boundaries from `base` on: the best score, and the length and id of the last piece before it
        room = min(n, 4 * CHECK_EVERY) + 1
        base, best, size, last = 0, [never] * room, [0] * room, [-1] * room
        best[0] = 0.0
        i, due = 0, CHECK_EVERY  # i counts from base
        while base + i < n:
            if i >= due:
                # a later piece starts here, or after the piece that best leads beyond this place
                alive = {i} if best[i] > never else set()
                alive |= {p - size[p] for p in range(i + 1, min(n - base, i + longest - 1) + 1) if best[p] > never}
                while len(alive) > 1:
                    top = max(alive)
                    alive.remove(top)
                    alive.add(top - size[top])
                meet = alive.pop()
                yield from self._path(text, size, last, base, meet)
                del best[:meet], size[:meet], last[:meet]
                base, i = base + meet, i - meet
                due = i + CHECK_EVERY
                more = min(n - base, due + longest) + 1 - len(best)
                best += [never] * more
                size += [0] * more
                last += [-1] * more
            score = best[i]
            if score > never:
                at = base + i
                node = root.get(text[at])
                if (node is None or node[2] < 0) and score + unknown > best[i + 1]:  # no piece of its own
                    best[i + 1], size[i + 1], last[i + 1] = score + unknown, 1, -1
                end = i
                while node is not None:
                    end += 1
                    children, gain, piece = node
                    if piece >= 0 and score + gain > best[end]:
                        best[end], size[end], last[end] = score + gain, end - i, piece
                    at += 1
                    node = children.get(text[at]) if at < n else None
            i += 1
        yield from self._path(text, size, last, base, n - base)

    def _path(self, text: str, size: list, last: list, base: int, end: int) -> list[int]:
        path = []
        while end > 0:
            piece = last[end]
            if piece >= 0:
                path.append(piece)
            else:
                c = text[base + end - 1]
                path += [self.bytes_ids[b] for b in reversed((MARK if c == MARK_ITSELF else c).encode())]
            end -= size[end]
        return path[::-1]

    def _stretch(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = array("i", self.search(text)).tobytes()
        if len(text) <= CHECK_EVERY:
            if len(self.seen) >= SEEN:
                self.before, self.seen = self.seen, {}
            self.seen[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        if not text:
            return b""
        out, rest = [], MARK
        for at in range(0, len(text), BLOCK):
            part = text[at: at + BLOCK]
            if MARK in part:
                part = part.replace(MARK, MARK_ITSELF)
            part = rest + part.replace(" ", MARK)
            n = self.number[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            cuts = np.flatnonzero(~self.joined[n[:-1] * self.width + n[1:]]) + 1
            if not len(cuts):
                rest = part
                continue
            ends = cuts.tolist()
            stretches = [part[a:b] for a, b in zip([0, *ends], ends)]
            seen = self.seen.get
            out += [seen(s) or self._stretch(s) for s in stretches]
            rest = part[ends[-1]:]
        out.append(self._stretch(rest))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        whole = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return whole[1:].decode("utf-8", "replace") if whole[:1] == b" " else whole.decode("utf-8", "replace")


_READY: dict[str, Encoder] = {}


def _ready(vocabulary: Vocabulary) -> Encoder:
    if vocabulary.name not in _READY:
        _READY[vocabulary.name] = Encoder(vocabulary)
    return _READY[vocabulary.name]


def _encoded(vocabulary: Vocabulary):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                blobs, same, chars = [], [], []
                for text in batch.column(1).to_pylist():
                    ids = None if text is None else encoder.encode(text)
                    blobs.append(ids)
                    chars.append(None if text is None else len(text))
                    same.append(None if text is None else encoder.decode(np.frombuffer(ids, np.int32)) == text)
                sizes = np.array([len(b or b"") // 4 for b in blobs], dtype=np.int32)
                values = np.frombuffer(b"".join(b or b"" for b in blobs), np.int32)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([b is None for b in blobs]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(chars, pa.int64()),
                     pa.array([None if b is None else n for b, n in zip(blobs, sizes.tolist())], pa.int64()), lists, pa.array(same, pa.bool_())],
                    ["id", "n_chars", "n_ids", "ids", "round_trip"])
    return each


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """A row per document: id, n_chars, n_ids, ids, round_trip (decoding gives the text back)."""
    vocabulary = Vocabulary.load(model)  # read by the driver and sent along: tasks need no file
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_encoded(vocabulary), f"id {kind}, n_chars long, n_ids long, ids array<int>, round_trip boolean")
            .withColumnRenamed("id", id_col))


def decode(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """A row per row: id and the decoded text; null ids give null text."""
    vocabulary = Vocabulary.load(model)
    kind = rows.select(F.col(id_col)).schema[0].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "out"])

    return (rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(each, f"id {kind}, out string")
            .select(F.col("id").alias(id_col), F.col("out").alias(into)))
