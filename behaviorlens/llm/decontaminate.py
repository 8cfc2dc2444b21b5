"""Benchmark items inside documents, with edits.

Texts are folded (lower case, every run of other than letters and digits one
space).  An item of ``m`` characters may differ by ``k = floor(rate * m)``
edits.  Cut into ``k + 1`` pieces, an item within ``k`` edits leaves one piece
untouched (pigeonhole), so every exact piece hit, and only those, is verified:
Myers' bit-parallel distance over the window that the hit allows, with the
item as pattern, gives the smallest edit distance of a substring.  An item of
fewer than ``min_chars`` characters, where an edit makes another word, has a
budget of 0: one piece, found at word borders only.

Documents are read once and never shuffled: the pieces of a block of items
travel with the task.  A block's size is bounded; a larger benchmark is
matched in several blocks, each against all documents.

Defined results: one row for each (row of documents, item row) that matches;
NULL texts and texts without a letter or digit match nothing; of equally near
matches in a text the first; an item cut off at a text's start or end is found
within its budget; repeated rows repeat their matches; NULL ids are kept as they
are; a text of any length is read once; empty tables give no rows.  Columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each folded character of an item, and the shortest item
#: that may have any.
RATE = 0.08
MIN_CHARS = 24
#: Characters of items that one block holds.
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")

MATCH = "doc_id long, item_id long, distance long, allowed long, start long, length long"


def folded(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip(" ")


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` consecutive pieces of nearly equal length, with offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq(item: str) -> dict[str, int]:
    """For each character the bits of its positions."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return out


def myers(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best match of the pattern in ``text``: smallest
    distance to a substring, first end of it."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int) -> None:
        self.items: list[tuple[int, str, int]] = []
        self.found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = folded(text or "")
            if not text:
                continue
            k = min(math.floor(rate * len(text)), len(text) - 1) if len(text) >= min_chars else 0
            for offset, piece in pieces(text, k):
                self.found[piece].append((len(self.items), offset))
            self.items.append((item_id, text, k))
        self.min_chars = min_chars
        self.bits: dict[int, tuple[dict, dict]] = {}
        self.trie = ahocorasick.Automaton()
        for piece in self.found:
            self.trie.add_word(piece, piece)
        if self.found:
            self.trie.make_automaton()

    def _verified(self, number: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, length) of the best match near some start."""
        _, item, k = self.items[number]
        m = len(item)
        if m < self.min_chars:
            at = next((s for s in sorted(starts) if text[s - 1 : s] in ("", " ") and text[s + m : s + m + 1] in ("", " ")), None)
            return None if at is None else (0, at, m)
        best = None
        # each window: starts that are near each other, with what their matches may hold
        windows: list[list[int]] = []
        for start in sorted(s for s in starts if s >= -k):
            if start >= 0 and text.startswith(item, start):
                return 0, start, m
            if windows and start <= windows[-1][1] + k:
                windows[-1][1] = start
            else:
                windows.append([start, start])
        for first, last in windows:
            lo, hi = max(0, first - k), last + m + 2 * k
            if number not in self.bits:
                self.bits[number] = peq(item), peq(item[::-1])
            forward, backward = self.bits[number]
            distance, end = myers(forward, m, text[lo:hi])
            if distance <= k and (best is None or distance < best[0]):
                stop = lo + end
                # the match read backwards from its end gives its start
                _, length = myers(backward, m, text[max(0, stop - m - k) : stop][::-1])
                best = distance, stop - length, length
        return best

    def search(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, distance, allowed, start, length) of items in a text."""
        if not self.items:
            return
        text = folded(text)
        starts: dict[int, list[int]] = defaultdict(list)
        for end, piece in self.trie.iter(text):
            for number, offset in self.found[piece]:
                starts[number].append(end - len(piece) + 1 - offset)
        for number, at in starts.items():
            if got := self._verified(number, text, at):
                yield self.items[number][0], got[0], self.items[number][2], got[1], got[2]


def _matches(items: list[tuple[int, str]], rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate, min_chars)
        names = [x.split()[0] for x in MATCH.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    out.extend((doc, *x) for x in matcher.search(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, allowed, start, length): items found in
    documents; start and length count folded characters."""
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        found = given.mapInArrow(_matches([tuple(r) for r in own.collect()], rate, min_chars), MATCH)
        out = found if out is None else out.unionByName(found)
    return out
