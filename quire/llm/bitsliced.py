"""Exact top-k inner products from a bit-sliced index.

Components are quantised to integers.  A block of rows keeps, for every component, one bitmap per bit of the
value (offset to be non-negative) over its rows.  For a query, every set bit of every weight adds the
component's slices, shifted; negative weights add the complement of the slices, which changes each sum by the same constant.
The sums are made by carry-save adders on whole bitmaps: three slices of a place give one of that place and one of the
next.  From the most significant sum slice downward the top rows are then separated from the others; rows that
tie at the border are taken by smaller vec_id, and the scores of the rows taken are computed from the integers.

Equal rows (vec_id and vector) are one row of the index with a number of copies, made before anything is grouped.  Blocks of rows and
groups of queries are bounded (``BLOCK_ROWS``, ``BLOCK_CELLS``, ``GROUP_QUERIES``), every pair of them is one row of work, and
at most k rows of each query leave a block.

Cases: null vectors, null or non-finite components: no part, as query or candidate.  Vectors of other lengths than the query's are
no candidates for it.  Several rows of one vec_id are candidates, and queries, each by itself; a query's own row is one row
with its vec_id and vector, further copies of it are candidates.  Fewer than k candidates: all of them.  Any finite component is
taken as it is: blocks or queries that could leave 62 bits are worked out in integers of any size.  A score beyond a long
is returned as the nearest long, and ranked by its true value.  Null vec_id: no part.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

BLOCK_ROWS = 16384
#: Components of a block, about; one of a wide vector counts ``WIDE_CELLS`` times.
BLOCK_CELLS = 1 << 21
WIDE_CELLS = 64
GROUP_QUERIES = 128
SCALE = 256
#: Quantised components of this size and more make a vector wide.
WIDE = float(1 << 30)
_LONG = (1 << 63) - 1
_DIGITS = 700


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) exactly: int64, or Python integers where a value is wide."""
    with np.errstate(over="ignore"):
        scaled = vectors * float(scale)
    if np.isfinite(scaled).all() and (np.abs(scaled) < WIDE).all():
        return np.floor(scaled).astype(np.int64)
    from fractions import Fraction
    from math import floor

    return np.array([floor(Fraction(x) * scale) for x in vectors.ravel().tolist()], dtype=object).reshape(vectors.shape)


def _widest(values: np.ndarray) -> int:
    return max((abs(int(values.min())), abs(int(values.max())))) if values.size else 0


class Index:
    """Slices of an integer matrix ``(rows, dims)``; bit i of a bitmap is row i."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values if values.dtype == object else values.astype(np.int64)
        n, d = values.shape
        self.n, self.words = n, -(-n // 64)
        low = self.values.min() if values.size else 0
        self.widest = _widest(self.values)
        shifted = self.values - low
        self.bits = max(1, int(shifted.max()).bit_length()) if values.size else 1
        self.valid = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)
        # [0]: slices; [1]: their complements, for negative weights
        self.slices = np.zeros((2, d, self.bits, self.words), dtype=np.uint64)
        cells = np.zeros((d, self.words * 64), dtype=bool)
        for b in range(self.bits):
            cells[:, :n] = ((shifted >> b) & 1).T.astype(bool)
            self.slices[0, :, b] = np.packbits(cells, axis=1, bitorder="little").view(np.uint64)
        np.bitwise_and(~self.slices[0], self.valid, out=self.slices[1])

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of a sum that orders the rows as their inner products with the query."""
        size, sign = np.abs(query), (query < 0).astype(np.int64)
        places: list[list[np.ndarray]] = []
        out = []
        top = int(size.max()).bit_length() if len(query) else 0
        for p in range(top + self.bits - 1):
            if len(places) <= p:
                places.append([])
            parts = places[p]
            for b in range(max(0, p - top + 1), min(self.bits, p + 1)):
                dims = np.flatnonzero(((size >> (p - b)) & 1).astype(bool))
                if len(dims):
                    parts.append(self.slices[sign[dims], dims, b])
            self._reduce(places, p, out)
        p = top + self.bits - 1
        while p < len(places) and places[p]:
            self._reduce(places, p, out)
            p += 1
        return out

    def _reduce(self, places: list, p: int, out: list) -> None:
        """Bring the slices of place p down to one; carries go to place p + 1."""
        rows = np.concatenate(places[p]) if places[p] else np.zeros((0, self.words), np.uint64)
        if len(places) <= p + 1:
            places.append([])
        while len(rows) > 1:
            k = len(rows) // 3
            if k:
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                t = a ^ b
                places[p + 1].append((a & b) | (t & c))
                rows = np.concatenate([t ^ c, rows[3 * k :]])
            else:
                places[p + 1].append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
        places[p] = []
        out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to smaller rows; ``without``: a row that takes no part."""
        open_rows, sure = self.valid.copy(), np.zeros(self.words, np.uint64)
        if without is not None:
            open_rows[without // 64] &= ~np.uint64(1 << (without % 64))
        for s in reversed(self.sums(query)):
            high = sure | (open_rows & s)
            n = int(np.bitwise_count(high).sum())
            if n > k:
                open_rows &= s
            else:
                sure = high
                open_rows &= ~s
                if n == k:
                    break
        rows = self._rows(sure)
        if len(rows) < k:
            rows = np.concatenate([rows, self._rows(open_rows)[: k - len(rows)]])
        return rows, self.scores(rows, query)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products, exactly: as Python integers where they might leave 62 bits."""
        values = self.values[rows]
        if values.dtype != object and query.dtype != object and self.widest * _widest(query) * max(1, len(query)) < 1 << 62:
            return values @ query
        return np.array([sum(int(a) * int(b) for a, b in zip(row, query)) for row in values], dtype=object)

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _pack(vectors: DataFrame, parts: int, name: str) -> DataFrame:
    """(part, dims, wide, ids, cells, copies): rows of a part by ascending vec_id, as bytes of int64, double and int64."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        cells = table["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.lexsort((*cells.T[::-1], ids))
        first = lambda c: table[c].slice(0, 1)
        data = [ids[order].tobytes(), cells[order].astype(np.float64).tobytes(), table["copies"].to_numpy()[order].tobytes()]
        return pa.table([first(name).cast(pa.int32()), first("dims").cast(pa.int32()), first("wide"), *([x] for x in data)], [name, "dims", "wide", f"{name}_ids", f"{name}_cells", f"{name}_copies"])

    keyed = vectors.withColumn(name, F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)).cast("int"))
    return keyed.groupBy(name, "dims", "wide").applyInArrow(lambda t: run(t), f"{name} int, dims int, wide boolean, {name}_ids binary, {name}_cells binary, {name}_copies binary")


def _ordered(score: int) -> tuple[int, str]:
    """A score as a long, and, beyond the range of a long, a text that sorts like it."""
    near = min(max(score, -_LONG - 1), _LONG)
    return near, "" if near == score else str(score + 10**_DIGITS).zfill(_DIGITS + 1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding)``, ``queries`` likewise -> (query_id, rank, vec_id, score), scores as integers."""

    def whole(df: DataFrame) -> DataFrame:
        x = F.col("embedding")
        good = df.where("vec_id is not null and embedding is not null").where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0))
        # adding zero makes both zeros one
        rows = good.select(F.col("vec_id").cast("long"), F.size(x).alias("dims"), F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
        rows = rows.groupBy("vec_id", "dims", "x").agg(F.count("*").alias("copies"))
        return written(rows.withColumn("wide", F.exists("x", lambda v: F.abs(v) >= WIDE / scale)))

    def parts(df: DataFrame, rows: int) -> int:
        n, cells = df.agg(F.count("*"), F.sum(F.col("dims") * F.when(F.col("wide"), WIDE_CELLS).otherwise(1))).first()
        return max(1, -(-n // rows), -(-(cells or 0) // BLOCK_CELLS))

    rows, asked = whole(vectors), whole(queries)
    n_groups = parts(asked, GROUP_QUERIES)
    blocks, groups = written(_pack(rows, parts(rows, BLOCK_ROWS), "block")), written(_pack(asked, n_groups, "grp").withColumnRenamed("wide", "grp_wide"))
    # every (block, group) of the same length once: the grid is dealt over tasks, its sides are joined by their keys
    grid = blocks.select("block", "dims", "wide").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    grid = grid.join(groups, ["grp", "dims"]).join(blocks, ["block", "dims", "wide"])

    def run(batches):
        last, index, ids, copies, plain = None, None, None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if last != (r["block"], r["dims"], r["wide"]):
                    last = (r["block"], r["dims"], r["wide"])
                    ids, copies = np.frombuffer(r["block_ids"], np.int64), np.frombuffer(r["block_copies"], np.int64)
                    plain = np.frombuffer(r["block_cells"], np.float64).reshape(len(ids), r["dims"])
                    index = Index(quantised(plain, scale))
                asked_ids, times = np.frombuffer(r["grp_ids"], np.int64), np.frombuffer(r["grp_copies"], np.int64)
                asked = np.frombuffer(r["grp_cells"], np.float64).reshape(len(asked_ids), r["dims"])
                out = {"query_id": [], "asked": [], "times": [], "vec_id": [], "copies": [], "score": [], "beyond": []}
                for q, x, n in zip(asked_ids, asked, times):
                    lo, hi = np.searchsorted(ids, (q, q + 1)) if q < _LONG else (np.searchsorted(ids, q), len(ids))
                    own = next((int(i) for i in range(lo, hi) if (plain[i] == x).all()), None)
                    # a query's own row, once; if it has copies they stay
                    w = quantised(x, scale)
                    got, score = index.top(w, k, own if own is not None and copies[own] == 1 else None)
                    left = copies[got] - (got == own) if own is not None else copies[got]
                    for i, c, s in zip(got.tolist(), left.tolist(), score.tolist()):
                        near, beyond = _ordered(s)
                        for name, v in zip(out, (int(q), x.tobytes(), int(n), int(ids[i]), min(c, k), near, beyond)):
                            out[name].append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    best = grid.mapInArrow(run, "query_id long, asked binary, times long, vec_id long, copies long, score long, beyond string")
    best = best.select("query_id", "asked", "times", "vec_id", "score", "beyond", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "asked").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"), "rank", "vec_id", "score").drop("time")
