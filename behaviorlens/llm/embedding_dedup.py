"""Near-duplicate embeddings of one label by cosine.

Equal vectors of a label are folded into the smallest id first.  Vectors are
packed into tiles of bounded size; a tile holds them as int8 with a scale for
each vector and the exact norm of what rounding lost.  For unit vectors
``x = s q + d`` the product of two is ``s s' q.q'`` up to
``|s q| |d'| + |d|``, so a tile product of int8 values plus that bound is
never below the true cosine, and less it never above.

Each pair of tiles of a label is one bounded group of int8 values.  Pairs whose
lower bound reaches the threshold are linked, pairs whose upper bound does not
are not; the vectors of the pairs in between are named, their original
components are fetched, and those pairs are computed again in double precision
(from ``array<double>`` without rounding).  Both steps return one row for each
vector with links or to fetch: how many links (counting folded copies) and the
smallest linked vector of its part, so results stay linear in a tile's size and
full vectors travel only where int8 values leave a link open.

Defined results: vectors that are NULL, empty or zero, hold a NULL, NaN or
infinite component, or have a NULL label link with nothing; vectors of
different length do not link; rows with equal ids are one node; rows with a
NULL id are not linked and have a NULL component; cosines equal to the threshold
link; a component is named by its smallest id.  An empty table gives an empty
one.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, forest, written

#: Vectors in a tile, on average.
TILE = 512
#: For rounding of the bounds themselves.
SLACK = 1e-5

TILED = "label string, dim int, tile int, ids binary, copies binary, quant binary, scale binary, lost binary"
FOUND = "rep long, root long, links long, unsure boolean, label string, dim int, lo int, hi int"


def quantised(full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scales, norms of the rounding loss) of unit rows."""
    scale = np.abs(full).max(axis=1) / 127
    quant = np.rint(full / scale[:, None])
    lost = np.linalg.norm(full - quant * scale[:, None], axis=1)
    return quant.astype(np.int8), scale, lost


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the cosines of all pairs, from quantised rows;
    the same for a pair whichever comes first."""
    exact = np.float32 if a[0].shape[1] * 127 * 127 < 2**24 else np.float64  # integers up to there are exact
    dot = (a[0].astype(exact) @ b[0].astype(exact).T) * (a[1][:, None] * b[1][None, :])
    la, lb = (np.linalg.norm(x[0].astype(np.float64), axis=1) * x[1] for x in (a, b))
    off = np.minimum(la[:, None] * b[2][None, :] + a[2][:, None], lb[None, :] * a[2][:, None] + b[2][None, :]) + SLACK
    return dot - off, dot + off


def unit(full: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow of their squares."""
    full = full / np.abs(full).max(axis=1)[:, None]
    return full / np.linalg.norm(full, axis=1)[:, None]


def sure(qa: tuple, qb: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked for sure, to be computed in full) of all pairs."""
    lower, upper = bounds(qa, qb)
    return lower >= threshold, (lower < threshold) & (upper >= threshold)


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index pairs of unit rows whose cosine reaches the threshold."""
    found = [np.zeros(0, bool)]
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        found.append(np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold)
    keep = np.concatenate(found)
    return i[keep], j[keep]


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    label, dim, tile = key
    quant, scale, lost = quantised(unit(np.array(rows["vec"].tolist(), np.float64)))
    packed = {"ids": rows["rep"].to_numpy(np.int64), "copies": rows["copies"].to_numpy(np.int64), "quant": quant, "scale": scale, "lost": lost}
    return pd.DataFrame({"label": [label], "dim": [dim], "tile": [tile]} | {k: [v.tobytes()] for k, v in packed.items()})


def _vectors(ids: tuple, copies: tuple, same: bool, i: np.ndarray, j: np.ndarray, open_a: np.ndarray, open_b: np.ndarray) -> pd.DataFrame:
    """A row for each vector with links or to fetch, from index pairs between
    two tiles (or inside one) and the vectors of both to fetch."""
    if same:
        i, j = i[i != j], j[i != j]
        ids, copies, unsure = ids[0], copies[0], open_a | open_b
    else:
        j = j + len(ids[0])
        i, j = np.concatenate((i, j)), np.concatenate((j, i))
        ids, copies, unsure = np.concatenate(ids), np.concatenate(copies), np.concatenate((open_a, open_b))
    links = np.bincount(i, copies[j], len(ids)).astype(np.int64)
    root = np.array(forest(len(ids), [(i[i < j], j[i < j])]), np.int64)
    some = np.flatnonzero((links > 0) | unsure)
    return pd.DataFrame({"rep": ids[some], "root": ids[root[some]], "links": links[some], "unsure": unsure[some]})


NOTHING = pd.DataFrame({"rep": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "unsure": np.zeros(0, bool)})


def _bounded(threshold: float):
    """Links that int8 values prove, and vectors of pairs that they leave open."""

    def read(row) -> tuple:
        ids = np.frombuffer(row.ids, np.int64)
        quant = np.frombuffer(row.quant, np.int8).reshape(len(ids), -1), np.frombuffer(row.scale), np.frombuffer(row.lost)
        return ids, np.frombuffer(row.copies, np.int64), quant

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label, dim, lo, hi = key
        tiles = [read(r) for r in rows.sort_values("tile").itertuples()]
        if lo != hi and len(tiles) < 2:
            return NOTHING.assign(label=label, dim=dim, lo=lo, hi=hi)
        a, b = tiles[0], tiles[-1]
        yes, unsure = sure(a[2], b[2], threshold)
        if lo == hi:
            np.fill_diagonal(unsure, False)
        out = _vectors((a[0], b[0]), (a[1], b[1]), lo == hi, *np.nonzero(yes), unsure.any(axis=1), unsure.any(axis=0))
        return out.assign(label=label, dim=dim, lo=lo, hi=hi)

    return run


def _computed(threshold: float):
    """Links among the pairs that int8 values left open, in double precision."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label, dim, lo, hi = key
        sides = []
        for tile in (lo, hi):
            own = rows[rows["tile"] == tile]
            sides.append((own["rep"].to_numpy(np.int64), own["copies"].to_numpy(np.int64), unit(np.array(own["vec"].tolist(), np.float64).reshape(len(own), -1))))
        a, b = sides
        _, unsure = sure(quantised(a[2]), quantised(b[2]), threshold)
        none = np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool)
        out = _vectors((a[0], b[0]), (a[1], b[1]), lo == hi, *exact(a[2], b[2], *np.nonzero(unsure), threshold), *none)
        return out.assign(label=label, dim=dim, lo=lo, hi=hi)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    # floats fit doubles without rounding; other numbers are read as doubles
    vec = F.col(f"`{vector_col}`")
    vec = vec if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else vec.cast("array<double>")
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("vec"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", odd)
    keyed = given.withColumn("h1", F.when(sound, F.xxhash64("vec"))).withColumn("h2", F.when(sound, F.xxhash64(F.lit("second"), "vec")))
    classes = written(keyed.filter("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("vec").alias("vec")))

    reps = classes.select("label", "rep", "copies", "vec", F.size("vec").alias("dim"))
    tiles = written(reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    counts = F.broadcast(tiles) if tiles.count() <= 100_000 else tiles
    dealt = reps.join(counts, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    packed = dealt.groupBy("label", "dim", "tile").applyInPandas(_tile, TILED).join(counts, ["label", "dim"])
    paired = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    pairs = paired.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("other")
    bounded = written(pairs.groupBy("label", "dim", "lo", "hi").applyInPandas(_bounded(threshold), FOUND))
    unsure = bounded.filter("unsure").select("label", "dim", "rep", "lo", "hi").distinct()
    fetched = dealt.drop("tiles").join(unsure, ["label", "dim", "rep"])
    computed = fetched.groupBy("label", "dim", "lo", "hi").applyInPandas(_computed(threshold), FOUND)
    met = written(bounded.select("rep", "root", "links").unionByName(computed.select("rep", "root", "links")).filter("links > 0"))

    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(connected(met, "rep", "root"), F.col("rep") == F.col("node"), "left")
    named = written(named.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = keyed.join(named, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
