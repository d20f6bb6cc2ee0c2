"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

Vocabulary and ranks come from a file, nothing is trained. The pattern cuts a text into matches, and each match is
encoded by itself: a match that is a token is that token, any other one is what merging the neighbours of least
rank (the left one of equals) again and again would leave.

That result is found without merging. A list of tokens is such a result just when each token alone and each two
neighbours stay as they are under merging, so every byte prefix of a match has exactly one valid last token: the
one whose neighbour, the last token of the prefix before it, can stand beside it. `Prefixes` stores these last
tokens; following them back from the end gives the ids of any prefix. Appending goes on from what is stored, and
after an edit the search stops where the stored tokens of a longest token's width agree again. Whether two tokens
can be neighbours is read off their merge trees: a merge across the border must be possible while the pieces at
the border still exist. It is known for a pair once it has been asked for.

Texts are cut into blocks at single spaces between other characters, where a match always begins, so that long
texts take no more memory than their ids; matches seen before are looked up in a bounded table. `edited` changes
stored ids around an edit only, between the nearest such places.

Null text gives null ids and null bytes, empty text none. Repeated rows are encoded alike, an empty table gives an
empty one; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 18
SEEN, PAIRS = 500_000, 2_000_000
NEVER = 1 << 60
ROWS = 256


@dataclass(frozen=True)
class Vocabulary:
    tokens: tuple[tuple[bytes, int], ...]  # bytes, id
    pattern: str
    name: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """A file with a line per token: its bytes in base 64 and its rank, which is its id."""
        with open(path, "rb") as lines:
            tokens = tuple((base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines))))
        if len({t for t, _ in tokens if len(t) == 1}) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        return cls(tokens, pattern, f"{path}:{len(tokens)}:{pattern}")


class Encoder:
    """A vocabulary made ready; one per Python worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.known = known = dict(vocabulary.tokens)
        self.longest = max(map(len, known))
        self.decoded = {i: t for t, i in vocabulary.tokens}
        self.pattern = regex.compile(vocabulary.pattern)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        #: of each token that merging its bytes leaves: the two tokens it is made of, none for a byte
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: tokens by their bytes from the last one to the first: [children, id], id -1 where no token begins
        self.root: dict[int, list] = {}
        for token, number in vocabulary.tokens:
            if len(token) > 1:
                parts = self.merged(token, until=2)
                if len(parts) != 2 or parts[0] + parts[1] != token:
                    continue  # merging never makes it: only a whole match can be this token
                self.halves[number] = known[parts[0]], known[parts[1]]
                if max(self._made(h) for h in self.halves[number]) > number:
                    raise ValueError("a token ranks before one of its parts")
            else:
                self.halves[number] = None
            children = self.root
            for byte in token[:0:-1]:
                children = children.setdefault(byte, [{}, -1])[0]
            children.setdefault(token[0], [{}, -1])[1] = number
        self.sides: tuple[dict, dict] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}  # two generations of matches, each bounded
        self.before: dict[str, bytes] = {}

    def merged(self, raw: bytes, until: int = 1) -> list[bytes]:
        """The rule itself: merge the neighbours of least rank until none merges or `until` parts are left."""
        parts = [raw[i: i + 1] for i in range(len(raw))]
        while len(parts) > until:
            rank, at = min((self.known.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _made(self, token: int) -> int:
        """When merging makes a token: bytes are there from the start."""
        return -1 if len(self.decoded[token]) == 1 else token

    def _side(self, token: int, right: int) -> list[tuple[bytes, int, int]]:
        """What has stood at a token's border: (bytes, when made, when merged into the next one)."""
        if token not in self.sides[right]:
            out, gone, at = [], NEVER, token
            while True:
                out.append((self.decoded[at], self._made(at), gone))
                if self.halves[at] is None:
                    break
                gone, at = at, self.halves[at][right]
            self.sides[right][token] = out
        return self.sides[right][token]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b where their bytes follow each other."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = True
            for x, x_made, x_gone in self._side(a, 1):
                for y, y_made, y_gone in self._side(b, 0):
                    rank = self.known.get(x + y)
                    # of equal ranks the left merge comes first
                    if rank is not None and max(rank, x_made, y_made) < x_gone and max(rank, x_made, y_made) <= y_gone:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _match(self, match: str) -> bytes:
        ids = self.before.get(match)
        if ids is None:
            raw = match.encode()
            whole = self.known.get(raw)
            ids = array("i", [whole] if whole is not None else Prefixes(self, raw).ids()).tobytes()
        if len(match) <= 64:
            if len(self.seen) >= SEEN:
                self.before, self.seen = self.seen, {}
            self.seen[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        out, at, seen = [], 0, self.seen.get
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:
                place = self.cut.search(text, at + BLOCK)
                end = place.start() if place else end
            out += [seen(m) or self._match(m) for m in self.pattern.findall(text if end - at == len(text) else text[at:end])]
            seen, at = self.seen.get, end
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids))

    def edited(self, text: str, ids: np.ndarray, at: int, removed: int, inserted: str) -> np.ndarray:
        """Ids of text[:at] + inserted + text[at + removed:], from text's ids. Only what lies between the nearest
        places around the edit where a match begins in both texts is encoded anew."""
        at = min(max(at, 0), len(text))
        end = min(max(at + removed, at), len(text))
        lo = 0  # a place two characters before the edit: the characters around it stay
        reach = 64
        while at > 2:
            places = [m.start() for m in self.cut.finditer(text, max(0, at - reach), at - 1)]
            if places or reach > at:
                lo = places[-1] if places else 0
                break
            reach *= 4
        place = self.cut.search(text, min(len(text), end + 1))
        hi = place.start() if place else len(text)
        sizes = np.array([len(self.decoded[i]) for i in ids.tolist()], dtype=np.int64)
        ends = np.cumsum(sizes)
        head = int(np.searchsorted(ends, len(text[:lo].encode()), "right"))
        tail = int(np.searchsorted(ends, len(text[:hi].encode()), "left")) + 1 if hi < len(text) else len(ids)
        new = np.frombuffer(self.encode(text[lo:at] + inserted + text[end:hi]), np.int32)
        return np.concatenate((ids[:head], new, ids[tail:]))


class Prefixes:
    """The unique valid last token of every byte prefix of a match, for exact appends and edits."""

    def __init__(self, encoder: Encoder, raw: bytes = b""):
        self.encoder, self.raw, self.last = encoder, raw, [-1]
        self._grow(raw, self.last, len(raw))

    def _grow(self, raw: bytes, last: list[int], end: int) -> None:
        """Add the last tokens of the prefixes up to `end`: of all tokens that end there, shortest first, the one that
        can stand beside the last token of the prefix before it."""
        root, pairs, beside = self.encoder.root, self.encoder.pairs, self.encoder.beside
        for at in range(len(last) - 1, end):
            node = root[raw[at]]
            while True:
                token = node[1]
                if token >= 0:
                    if not at:
                        break
                    known = pairs.get(last[at] << 32 | token)
                    if known or known is None and beside(last[at], token):
                        break
                at -= 1
                node = node[0][raw[at]]
            last.append(token)

    def append(self, more: bytes) -> None:
        self.raw += more
        self._grow(self.raw, self.last, len(self.raw))

    def replace(self, lo: int, hi: int, new: bytes) -> int:
        """Bytes lo to hi become `new`; returns for how many prefixes the last token was sought again."""
        old, shift = self.last, len(new) - (hi - lo)
        raw, last, same = self.raw[:lo] + new + self.raw[hi:], self.last[: lo + 1], 0
        for end in range(lo + 1, len(raw) + 1):
            self._grow(raw, last, end)
            # beyond the edit, tokens depend on the last tokens within the width of the longest one
            same = same + 1 if end > lo + len(new) and last[end] == old[end - shift] else 0
            if same >= self.encoder.longest:
                last += old[end - shift + 1:]
                break
        sought = end - lo if len(raw) > lo else 0
        self.raw, self.last = raw, last
        return sought

    def ids(self, end: int | None = None) -> list[int]:
        """Ids of the first `end` bytes, of all by default."""
        out, end, decoded = [], len(self.raw) if end is None else end, self.encoder.decoded
        while end:
            out.append(self.last[end])
            end -= len(decoded[self.last[end]])
        return out[::-1]


_READY: dict[str, Encoder] = {}


def ready(vocabulary: Vocabulary) -> Encoder:
    if vocabulary.name not in _READY:
        _READY[vocabulary.name] = Encoder(vocabulary)
    return _READY[vocabulary.name]


def _lists(blobs: list[bytes | None]) -> tuple[pa.Array, pa.Array]:
    """Numbers of ids and the ids as a list column."""
    sizes = [None if b is None else len(b) // 4 for b in blobs]
    ends = np.concatenate(([0], np.cumsum([s or 0 for s in sizes]))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(b or b"" for b in blobs), np.int32))
    return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([b is None for b in blobs]))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_tokens, ids, and the bytes that the ids decode to."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                blobs = [None if text is None else encoder.encode(text) for text in batch.column(1).to_pylist()]
                raw = [None if b is None else encoder.decode(np.frombuffer(b, np.int32).tolist()) for b in blobs]
                sizes, lists = _lists(blobs)
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, lists, pa.array(raw, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(each, f"id {kind}, n_tokens long, ids array<int>, decoded binary").withColumnRenamed("id", id_col))


def decode(rows: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row per row: id and `decoded`, the bytes of its ids; null ids give null. An unknown id is an error."""
    kind = rows.select(F.col(id_col)).schema[0].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(vocabulary)
        for batch in batches:
            raw = [None if ids is None else encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    return (rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(each, f"id {kind}, decoded binary")
            .withColumnRenamed("id", id_col))


def edited(rows: DataFrame, vocabulary: Vocabulary, at: Column, removed: Column, inserted: Column, *, id_col: str = "doc_id",
           text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids) after an edit of each text whose ids are known: from character `at` on, `removed` characters
    make way for `inserted`. An append is an edit at the text's end. Null text or ids give null ids; a null place means
    the end, a null number none, a null insertion nothing; places beyond the text are moved to its ends."""
    kind = rows.select(F.col(id_col)).schema[0].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                blobs = []
                for text, ids, place, gone, new in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
                    known = text is not None and ids is not None
                    blobs.append(encoder.edited(text, np.array(ids, np.int32), len(text) if place is None else place, gone or 0, new or "")
                                 .astype(np.int32).tobytes() if known else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), *_lists(blobs)], ["id", "n_tokens", "ids"])

    return (rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(ids_col).alias("ids"), at.cast("long").alias("at"),
                        removed.cast("long").alias("gone"), inserted.cast("string").alias("new"))
            .mapInArrow(each, f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col))


def digests(encoded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded rows; null ids count as none."""
    ids = F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(""))
    return encoded.select(F.col(id_col), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2(F.coalesce("decoded", F.lit(b"")), 256).alias("decoded_sha256"))
