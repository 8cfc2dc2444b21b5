"""Passages that an earlier document already has.

Every window of ``window`` consecutive words gets a Rabin-Karp hash (a
polynomial over 64-bit word hashes, modulo 2**64 with an odd base, rolled by
prefix sums).  A task packs the hashes of about ``CHUNK`` windows by bucket
and keeps, of equal windows, the one with the smallest document id: the
others are already known to go and leave as spans.  So a passage that a third
of all documents share reaches its bucket once from each chunk, not once from
each document.  A bucket finds the smallest document of every hash and
answers each later document; answers and texts meet by blocks of documents,
where repeated windows merge into maximal spans.

Buckets and document blocks are as many as the text has ``GROUP_BYTES``, and at
least ``SPREAD`` for each shuffle partition, so a group stays the same size
however large the corpus.  Hashes travel as 56 bits
inside their bucket; two different windows are taken for equal with a
probability of about 2**-56 for each pair within a bucket.

Defined results: NULL text has no words; a NULL id neither loses words nor
makes others lose them; rows with equal ids are the same document (they never
remove from each other), each row with its own text; words are split at ASCII
white space only; texts of any length are one row each; an empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, powers, run_bounds, run_starts, shuffle_partitions, utf8, word_hashes

CHUNK = 1_000_000
#: Buckets for each shuffle partition, so that hash partitioning is even.
SPREAD = 2
#: Text of one bucket or block of documents.
GROUP_BYTES = 32 << 20
#: Multiplier and modulus that deal document ids to blocks.
LEHMER = (48_271, 2**31 - 1)
_HEAD = struct.Struct("<II")
_LOW = np.uint64((1 << 56) - 1)

SLOT = "slot int, body binary"
ANSWER = "block int, spans boolean, body binary"


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of every window, in order of its first word."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * down[: len(words)], out=prefix[1:])
    return mixed((prefix[window:] - prefix[:n]) * up[:n])


def text_mark(words: np.ndarray) -> int:
    """Tells texts of one id apart: a polynomial over all words in order."""
    up, _ = powers(len(words) + 1)
    total = (words * up[: len(words)]).sum(dtype=np.uint64) + up[len(words)]
    return int(mixed(np.array([total], np.uint64))[0])


def _spans(hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal word ranges covered by the windows that ``hit`` marks."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    first = np.concatenate(([True], np.diff(at) > window))
    last = np.concatenate((first[1:], [True]))
    return at[first], at[last] + window


def _ids(ids: np.ndarray) -> bytes:
    """Sorted document ids as (differences, counts), compressed."""
    first = run_starts(ids)
    distinct = ids[first]
    counts = np.diff(np.append(first, len(ids))).astype(np.uint32)
    steps = np.diff(distinct, prepend=np.int64(0)).astype(np.int64)
    raw = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.view(np.uint8).reshape(-1, 4).T.tobytes()
    packed = zstandard.ZstdCompressor(level=1).compress(raw)
    return _HEAD.pack(len(distinct), len(packed)) + packed


def _ids_back(body: bytes) -> tuple[np.ndarray, int]:
    n, size = _HEAD.unpack_from(body)
    raw = zstandard.ZstdDecompressor().decompress(body[_HEAD.size : _HEAD.size + size])
    planes = np.frombuffer(raw, np.uint8)
    steps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.int64).ravel()
    counts = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.uint32).ravel()
    return np.repeat(np.cumsum(steps), counts), _HEAD.size + size


def packed(ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """Sorted ids and the low 56 bits of their hashes."""
    return _ids(ids) + hashes.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, at = _ids_back(body)
    out = np.zeros((len(ids), 8), np.uint8)
    out[:, :7] = np.frombuffer(body, np.uint8, offset=at).reshape(-1, 7)
    return ids, out.view(np.uint64).ravel()


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The same Lehmer step as ``_block``."""
    return ids % LEHMER[1] * LEHMER[0] % LEHMER[1] % blocks


def _block(doc: Column, blocks: int) -> Column:
    modulus = F.lit(LEHMER[1])
    return F.pmod(F.pmod(doc, modulus) * F.lit(LEHMER[0]).cast("long"), modulus) % blocks


def _packs(docs: list[tuple[int, np.ndarray]], window: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    docs.sort(key=lambda x: x[0])
    ids = np.array([i for i, _ in docs], np.int64)
    marks = np.array([text_mark(w) for _, w in docs], np.uint64)
    each = [window_hashes(w, window) for _, w in docs]
    sizes = np.array([len(h) for h in each], np.int64)
    hashes = np.concatenate(each)
    row = np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(hashes, kind="stable")
    first = run_starts(hashes[order])
    lead = order[first]  # of equal windows the one in the smallest document
    gone = np.zeros(len(hashes), bool)
    gone[order] = ids[row[order]] > np.repeat(ids[row[lead]], np.diff(np.append(first, len(order))))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    blocks = block_of(ids, buckets)
    for k in np.unique(row[gone]).tolist():
        for a, b in zip(*_spans(gone[begin[k] : begin[k + 1]], window), strict=True):
            found.setdefault(int(blocks[k]), []).append((int(ids[k]), int(marks[k]), int(a), int(b)))
    for block, spans in found.items():
        yield -1 - block, b"".join(struct.pack("<qQqq", *x) for x in spans)
    lead.sort()
    bucket = ((hashes[lead] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for a, b in run_bounds(bucket[by]):
        some = lead[by[a:b]]
        yield int(bucket[by[a]]), packed(ids[row[some]], hashes[some])


def _windows(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0

        def out() -> pa.RecordBatch:
            slots, bodies = zip(*_packs(docs, window, buckets), strict=True)
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(bodies, pa.binary())], ["slot", "body"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes, _ = word_hashes(text.as_py())
                if len(hashes) >= window:
                    docs.append((doc, hashes))
                    held += len(hashes) - window + 1
                if held >= CHUNK:
                    yield out()
                    held = 0
        if docs:
            yield out()

    return run


def _answers(blocks: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"block": -1 - key[0], "spans": True, "body": [b"".join(rows["body"])]})
        parts = [unpacked(b) for b in rows["body"]]
        ids, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        first = run_starts(hashes[order])
        smallest = np.minimum.reduceat(ids[order], first)
        later = order[ids[order] > np.repeat(smallest, np.diff(np.append(first, len(order))))]
        ids, hashes = ids[later], hashes[later]
        block = block_of(ids, blocks)
        by = np.lexsort((ids, block))
        cut = run_bounds(block[by])
        return pd.DataFrame({"block": [int(block[by[a]]) for a, _ in cut], "spans": False, "body": [packed(ids[by[a:b]], hashes[by[a:b]]) for a, b in cut]})

    return run


def _cut(window: int, id_col: str):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told = [unpacked(b) for b, s in zip(answers["body"], answers["spans"], strict=True) if not s]
        ids, hashes = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        known: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for b, s in zip(answers["body"], answers["spans"], strict=True):
            for doc, mark, a, z in struct.iter_unpack("<qQqq", b) if s else ():
                known.setdefault((doc, mark), []).append((a, z))
        out = {"id": [], "n_words": [], "spans": [], "kept": []}
        with_spans = {doc for doc, _ in known}
        for doc, text in zip(docs["__id"], docs["__text"], strict=True):
            each = text.split() if text is not None else []
            drop = np.zeros(len(each) + 1, np.int64)
            if doc is not None and not pd.isna(doc):
                a, b = np.searchsorted(ids, [doc, int(doc) + 1])
                if b > a or doc in with_spans:
                    own, _ = word_hashes(text)
                    for x, z in known.get((int(doc), text_mark(own)), ()):
                        drop[x] += 1
                        drop[z] -= 1
                    if b > a:
                        for x, z in zip(*_spans(np.isin(window_hashes(own, window) & _LOW, hashes[a:b]), window), strict=True):
                            drop[x] += 1
                            drop[z] -= 1
            gone = np.cumsum(drop[:-1]) > 0
            step = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = [w for w, g in zip(each, gone.tolist(), strict=True) if not g] if len(step) else each
            out["id"].append(None if pd.isna(doc) else int(doc))
            out["n_words"].append(len(each))
            out["spans"].append([{"from": int(x), "to": int(z)} for x, z in zip(step[::2], step[1::2], strict=True)])
            out["kept"].append(b" ".join(kept).decode())
        return pd.DataFrame({id_col: pd.array(out["id"], "Int64"), "n_words": out["n_words"], "spans": out["spans"], "kept": out["kept"]})

    return run


def groups(text_bytes: int, partitions: int) -> int:
    """Buckets, and blocks, of a corpus of so much text."""
    return max(SPREAD * partitions, -(-text_bytes // GROUP_BYTES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, spans, kept); ``spans``
    are maximal word ranges [from, to) covered by windows that also start in a
    document with a smaller id, ``kept`` the other words joined by a space."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("__id"), utf8(text_col).alias("__text"))
    blocks = groups(given.agg(F.sum(F.octet_length("__text"))).first()[0] or 0, shuffle_partitions(spark))
    packs = given.dropna().mapInArrow(_windows(window, blocks), SLOT)
    answers = packs.groupBy("slot").applyInPandas(_answers(blocks), ANSWER)
    # rows without an id are spread by their text
    block = F.when(F.col("__id").isNull(), F.pmod(F.xxhash64("__text"), F.lit(blocks))).otherwise(_block(F.col("__id"), blocks))
    schema = f"`{id_col}` long, n_words long, spans array<struct<`from`:long,`to`:long>>, kept string"
    return given.groupBy(block.cast("int").alias("block")).cogroup(answers.groupBy("block")).applyInPandas(_cut(window, id_col), schema)
