"""SentencePiece encoding by unigram Viterbi, and decoding.

Pieces and their log scores come from a SentencePiece model file (its path is
a parameter; the file holds at most a few megabytes and is read on the driver
through Spark).  A double-array trie over the pieces' UTF-8 bytes serves the
Viterbi search for the segmentation of highest total score.  A character that
no piece covers costs the lowest score less 10 and is written as byte pieces.

Spaces become the marker U+2581.  If no piece has the marker behind another
character (checked when the model is loaded) a marker always starts a piece,
so a text is searched in parts between markers and parts that occur again are
looked up.  Unlike the library, a marker character that the text itself holds
is written as byte pieces, so that decoding gives the text back exactly.

Defined results: NULL text has NULL ids and decodes to NULL; an empty text has
no ids; NULL ids inside a list and ids out of range are skipped; control
pieces decode to nothing, the unknown piece to its surface; byte pieces that
are no UTF-8 decode to U+FFFD; of segmentations of equal score the one whose
last piece is longest is taken; texts are encoded whole, of any length, repeated
rows alike; an empty table gives an empty one.  Other columns pass through, but
for those named like an added one, which it replaces.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: What an uncovered character costs below the lowest score.
PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "
#: Parts that a worker remembers (twice over), and the longest in characters.
REMEMBERED, PART = 250_000, 48
#: Rows that a worker turns over at once.
ROWS = 1_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of sorted distinct keys.  From state ``s`` byte
    ``b`` leads to ``t = base[s] + b`` if ``check[t] == s``; ``value[t]`` is
    the id of the key that ends there, or -1."""
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    free = roomy = 257  # from there on every label fits; nodes of several labels are placed from there on
    todo = [(0, 0, 0, len(keys))]
    while todo:
        state, depth, lo, hi = todo.pop()
        if len(keys[lo][0]) == depth:
            value[state] = keys[lo][1]
            lo += 1
        if lo == hi:
            continue
        cuts = [lo]
        for i in range(lo + 1, hi):
            if keys[i][0][depth] != keys[i - 1][0][depth]:
                cuts.append(i)
        labels = [keys[i][0][depth] for i in cuts]
        while free < len(check) and check[free] >= 0:
            free += 1
        start = max(1, (free if len(labels) == 1 else roomy) - labels[0])
        while True:
            if start + 256 >= len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            if all(check[start + b] < 0 for b in labels):
                break
            start += 1
        base[state] = start
        if len(labels) > 1:
            roomy = max(roomy, start + labels[0])
        for b in labels:
            check[start + b] = state
        for b, i, j in zip(labels, cuts, [*cuts[1:], hi], strict=True):
            todo.append((start + b, depth + 1, i, j))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = False
    name: str = ""
    trie: tuple = field(init=False, repr=False)

    def __post_init__(self) -> None:
        content = (self.pieces, self.scores, self.kinds, self.dummy_prefix, self.squeeze)
        self.digest = hashlib.sha256(repr(content).encode()).hexdigest()
        usable = [(p.encode(), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER) and p]
        self.trie = double_array(sorted(dict(usable[::-1]).items()))
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.lowest = min(normal, default=0.0)
        top = max(normal, default=0.0)
        self.weight = [len(p) * top - 0.1 if k == USER else s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.parts_apart = not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))


def load(data: bytes) -> Model:
    """The model in the bytes of a SentencePiece file."""
    pieces, scores, kinds, normalizer = [], [], [], {}
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got.get(1, b"").decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            kinds.append(got.get(3, NORMAL))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2):
        raise ValueError("only models without a character map (identity normalisation) are supported")
    return Model(pieces, scores, kinds, bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), hashlib.sha256(data).hexdigest())


def read_model(spark: SparkSession, path: str) -> Model:
    """Load a model file; a path without a scheme is on the driver."""
    if "://" in path:
        return load(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path, "rb") as file:
        return load(file.read())


class Encoder:
    """Viterbi search over one model, with remembered parts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.base, self.check, self.value = (x.tolist() for x in model.trie)
        self.longest = max((len(p.encode()) for p in model.pieces), default=0)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # a line feed that no longer piece holds is a part of its own
        feed = "" if any("\n" in p for p, k in zip(model.pieces, model.kinds, strict=True) if len(p) > 1 and k in (NORMAL, USER)) else "\n"
        self.parts = re.compile(f"{MARK}*[^{MARK}{feed}]+|{MARK}+" + (f"|{feed}" if feed else ""))

    def _uncovered(self, char: bytes) -> list[int]:
        table = self.model.bytes
        return [table[b] for b in char] if len(table) == 256 else [self.model.unknown]

    def search(self, part: str) -> list[int]:
        """Ids of the best segmentation of a normalised text.  A character may
        always be left uncovered; that loses to any piece of it."""
        base, check, value, weight = self.base, self.check, self.value, self.model.weight
        unknown = self.model.lowest - PENALTY
        data = part.encode()
        n = len(data)
        never = float("-inf")
        best = [never] * (n + 1)
        begin, which = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            score = best[at]
            if score == never:  # inside a character
                continue
            lead = data[at]
            end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            total = score + unknown
            if total > best[end]:
                best[end], begin[end], which[end] = total, at, -1
            state, end = 0, at
            for byte in data[at : at + self.longest]:
                following = base[state] + byte
                if check[following] != state:
                    break
                state = following
                end += 1
                piece = value[state]
                if piece >= 0:
                    total = score + weight[piece]
                    if total > best[end]:
                        best[end] = total
                        begin[end] = at
                        which[end] = piece
        out: list[int] = []
        end = n
        while end:
            at, piece = begin[end], which[end]
            out.extend([piece] if piece >= 0 else self._uncovered(data[at:end])[::-1])
            end = at
        return out[::-1]

    def _part(self, part: str) -> bytes:
        ids = self.before.get(part) or array("i", self.search(part)).tobytes()
        if len(part) <= PART:
            if len(self.known) >= REMEMBERED:
                self.known, self.before = {}, self.known
            self.known[part] = ids
        return ids

    def _marked(self, text: str) -> bytes:
        parts = self.parts.findall(text) if self.model.parts_apart else [text]
        known = self.known
        return b"".join([known.get(p) or self._part(p) for p in parts])

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return b""
        own = text.split(MARK)
        first = (MARK if self.model.dummy_prefix else "") + own[0].replace(" ", MARK)
        if len(own) == 1:
            return self._marked(first)
        literal = np.array(self._uncovered(MARK.encode()), np.int32).tobytes()
        return literal.join(self._marked(x) if x else b"" for x in [first, *(x.replace(" ", MARK) for x in own[1:])])


#: Of a worker process, by the model's content: what it remembers serves its later tasks.
_encoders: dict[str, Encoder] = {}


def encoder_of(model: Model) -> Encoder:
    if model.digest not in _encoders:
        _encoders.clear()
        _encoders[model.digest] = Encoder(model)
    return _encoders[model.digest]


def surfaces(model: Model) -> list[bytes]:
    """What each id decodes to."""
    out = []
    for piece, kind in zip(model.pieces, model.kinds, strict=True):
        if kind == BYTE:
            out.append(bytes([int(piece[1:-1], 16)]))
        else:
            out.append({CONTROL: "", UNKNOWN: UNKNOWN_SURFACE}.get(kind, piece.replace(MARK, " ")).encode())
    return out


def _encode(model: Model):
    def run(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(model)
        ids = [encoder.encode(t.as_py()) if t.is_valid else b"" for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=texts.is_null())

    return run


def _decode(model: Model):
    table = surfaces(model)
    n = len(table)

    def one(value: pa.Scalar) -> str | None:
        if not value.is_valid:
            return None
        ids = value.values.drop_null().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= n):
            ids = ids[(ids >= 0) & (ids < n)]
        text = b"".join([table[i] for i in ids.tolist()])
        return (text[1:] if model.dummy_prefix and text.startswith(b" ") else text).decode(errors="replace")

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in lists], pa.string())

    return run


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, run) -> DataFrame:
    """``df`` with ``target`` (replaced if there) computed from ``source``.
    Columns travel under positions, so no name can clash, the source last."""
    own = next(f for f in df.schema.fields if f.name == source)
    others = [f for f in df.schema.fields if f.name.lower() not in (source.lower(), target.lower())]
    fields = [*others, own]
    plain = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("out", kind)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*some.columns, run(some.column(some.num_columns - 1))], schema.fieldNames())

    out = plain.mapInArrow(named, schema)
    back = {f.name: F.col(f"c{i}") for i, f in enumerate(fields)}
    return out.select(*[back[f.name].alias(f.name) for f in df.schema.fields if f.name.lower() != target.lower()], F.col("out").alias(target))


def encode(df: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` plus the ids of its texts."""
    return _mapped(df, text_col, ids_col, T.ArrayType(T.IntegerType()), _encode(model))


def decode(df: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` plus the texts of its ids."""
    return _mapped(df, ids_col, text_col, T.StringType(), _decode(model))
