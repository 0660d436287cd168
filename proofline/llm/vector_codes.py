"""Operator 13, vector code compression: product codes whose entries are found by VA-file filtering.

A vector's components become whole numbers and are cut into PARTS equal parts; each part is replaced by the number of the nearest entry of its part's
codebook. Codebooks start from the first vectors and are refined in ROUNDS rounds of assigning and averaging.

The nearest entry is found as in a vector approximation file. The entries' coordinates are quantised, dimension by dimension, to CELLS cells of equally many
entries each. A query looks up, for every dimension and cell, the smallest and the largest squared difference that an entry of the cell can have; sums over the
dimensions bound every entry's distance from below and above. Only entries whose lower bound reaches the smallest upper bound are refined, with distances in
whole numbers, ties to the lower number. Bounds are summed as floating-point numbers and widened by more than their rounding, so none is lost.

Every task assigns its vectors and returns a sum and a count for each entry it used; these are added up in Spark, and only the codebooks (PARTS x ENTRIES entries)
are on the driver. Every round reads the vectors' column again, and nothing else of the table.

Defined results: rows whose vector is null or holds null, NaN or infinity are dropped, as are empty vectors and those not as long as the kept vector of the smallest vec_id. A length that
PARTS does not divide is filled up with zeros. Whole numbers beyond 2**26 in size are cut to it, so distances stay within 64 bits. A null vec_id comes last in order; rows that
share a vec_id are ordered by their components. Tables with fewer vectors than ENTRIES have so many entries. Repeated rows each get their row. Null labels are
one label. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import materialize, small_batches

# Parts of a vector, entries of a codebook, rounds, and the factor of the whole numbers.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells of a coordinate, and the size beyond which whole numbers are cut.
CELLS, MOST = 8, 1 << 26
#: More than the relative rounding of a bound summed over a part.
MARGIN = 1e-3
AT_ONCE = 2048


def whole(vectors: DataFrame) -> DataFrame:
    """The rows to keep, with ``x``: their components as whole numbers."""
    fit = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    # within the bounds before the cast, as a cast of a larger number would fail
    x = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v.cast("double") * SCALE))).cast("long"))
    return vectors.where(fit).withColumn("x", x)


def first_vectors(rows: DataFrame, entries: int = ENTRIES) -> tuple[np.ndarray, int]:
    """The codebooks to start with, as (part, entry, place), and the vectors' length: at most ``entries`` rows reach the driver."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    head = rows.select("vec_id", "x").orderBy(*order).limit(1).collect()
    if not head:
        return np.zeros((PARTS, 0, 0), np.int64), 0
    length = len(head[0]["x"])
    found = [r["x"] for r in rows.where(F.size("x") == length).select("vec_id", "x").orderBy(*order).limit(entries).collect()]
    return np.stack(np.split(padded(np.array(found, np.int64)), PARTS, axis=1)), length


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


class Approximation:
    """The cells of one codebook's entries, and the nearest entries of queries."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        self.entries, (n, width) = entries, entries.shape
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0)
        self.cell = rank * cells // max(n, 1)
        self.low, self.high = np.full((width, cells), np.inf), np.full((width, cells), -np.inf)
        dimension = np.broadcast_to(np.arange(width), (n, width))
        np.minimum.at(self.low, (dimension, self.cell), entries)
        np.maximum.at(self.high, (dimension, self.cell), entries)
        used = np.isfinite(self.low)
        self.low, self.high = np.where(used, self.low, 0), np.where(used, self.high, 0)
        self.chosen = np.zeros((width * cells, n), np.float32)
        self.chosen[dimension * cells + self.cell, np.arange(n)[:, None]] = 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, by the queries' lookup tables."""
        q = queries[:, :, None].astype(np.float64)
        below, above = self.low - q, q - self.high
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        tables = [(t * t).reshape(len(queries), -1).astype(np.float32) for t in (near, far)]
        return tables[0] @ self.chosen * np.float32(1 - MARGIN), tables[1] @ self.chosen * np.float32(1 + MARGIN)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, squared distance) of each query."""
        lower, upper = self.bounds(queries)
        query, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        apart = queries[query] - self.entries[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        best = np.minimum.reduceat(distance, np.searchsorted(query, np.arange(len(queries))))
        right = np.flatnonzero(distance == best[query])
        first = right[np.searchsorted(query[right], np.arange(len(queries)))]  # candidates stand in the order of their numbers
        return entry[first], best


def lists(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.int64)


def portions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            yield part, np.split(padded(lists(part["x"], length)), PARTS, axis=1)


def averaged(rows: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round: each entry the rounded-down mean of the parts that chose it; unused ones stay."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, parts in portions(batches, length):
            for p, x in enumerate(parts):
                chosen = near[p].nearest(x)[0]
                np.add.at(sums[p], chosen, x)
                counts[p] += np.bincount(chosen, minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": counts[part, entry], "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    found = rows.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[k].cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)]  # a sum over many tasks may leave 64 bits
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


def codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    small_batches(spark, 4 * AT_ONCE)
    rows = whole(vectors)
    books, length = first_vectors(rows, entries)
    schema = "vec_id long, label string, code string, error long"
    digest = None
    if books.size:
        rows = rows.where(F.size("x") == length)
        for _ in range(rounds):
            books = averaged(rows, books, length)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        for batch, parts in portions(batches, length):
            found = [near[p].nearest(x) for p, x in enumerate(parts)]
            chosen, error = np.stack([f[0] for f in found], axis=1).astype(np.uint8), sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in chosen]), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "x")
    found = kept.mapInArrow(run, schema) if books.size else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    found = materialize(found.withColumns({"known": F.col("label").isNotNull(), "label": F.coalesce("label", F.lit(""))}), "vector-codes")
    sums = found.groupBy("known", "label").agg(F.sum("error").alias("label_error"))
    return found.join(sums, ["known", "label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> dict[str, str]:
    """Every distance of every part in DuckDB, round by round; sums of whole numbers stay exact in its 64 bits."""
    ctes = f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    part AS MATERIALIZED (SELECT vec_id, label, p, list_slice(x, CAST(p * len(x) // {PARTS} + 1 AS BIGINT), CAST((p + 1) * len(x) // {PARTS} AS BIGINT)) AS v FROM kept, range({PARTS}) AS r(p)),
    heads AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
    book0 AS MATERIALIZED (SELECT p, e, v FROM heads JOIN part USING (vec_id))"""

    def assigned(k: int) -> str:
        # |x|^2 - 2 x.e + |e|^2 in DOUBLE is exact for whole numbers of this size
        return f"""norm{k} AS MATERIALIZED (SELECT p, e, CAST(v AS DOUBLE[]) AS w, list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) AS n FROM book{k}),
    near{k} AS MATERIALIZED (SELECT a.vec_id, a.label, a.p, min(CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[])) - 2 * list_inner_product(CAST(a.v AS DOUBLE[]), w) + n AS BIGINT) * {ENTRIES} + e) AS best FROM part a JOIN norm{k} b ON a.p = b.p GROUP BY ALL)"""

    for k in range(ROUNDS):
        ctes += f""", {assigned(k)},
    flat{k} AS (SELECT a.p, CAST(best % {ENTRIES} AS BIGINT) AS e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{k} n JOIN part a USING (vec_id, p)),
    mean{k} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM flat{k} GROUP BY p, e, j) GROUP BY p, e),
    book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
    last = f"""coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', CAST(best % {ENTRIES} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label),
    digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS d FROM book{ROUNDS})"""
    return {"op13_vector_codes": f"WITH {ctes}, {assigned(ROUNDS)}, {last} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM coded, digest"}
