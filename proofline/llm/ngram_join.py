"""Operator 8, n-gram Jaccard join: MinHash banding, then a check on the full n-gram sets.

1. Texts become sets of five-word shingles. Texts with equal sets form a class with one representative, the smallest doc_id;
   from here on only representatives take part, so exact copies cost nothing more.
2. Bands and rows are chosen so that a pair at the threshold meets in a band with the target recall. The shuffle is on band hashes.
3. Representatives that meet become candidates. A small bucket gives its pairs. The members of a large one are dealt into
   blocks of bounded size, every member into one block in all, and pairs of blocks are compared inside a task, which returns a row per
   member and not per pair. So one large group of near copies is spread over many tasks and no row per pair is written.
4. Candidates are verified on their full sets. Documents reachable through links form a group, named by its smallest id.

The sets are computed again for the candidates only, instead of storing the sets of all documents.

Defined results: a null or wordless text has an empty set, no links and a class of its own. A text of fewer than five words
has one shingle of all its words. A null doc_id takes part like any other and comes last in order, so a class is named by null only if it
has no other id. Rows that share a doc_id are members of the same or of different classes by their texts. ``keep_one`` keeps one row of every
class: that of the smallest doc_id, then of the smallest hash of the text; of rows equal in both it keeps one, whatever their other columns.
Extra columns are ignored, or kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.graph import components
from proofline.llm.minhash import band_hashes, bands_for
from proofline.llm.shared import discard, documents, materialize, nested, small_batches, text_or_empty
from proofline.llm.wordhash import Words, binary_column, row_shingles, slices

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 4
#: A bucket of at most so many members gives its pairs; a larger one is compared in blocks of about BLOCK members.
SMALL = 24
BLOCK = 256
#: Stands for a null doc_id, behind all others.
LAST_ID = (1 << 63) - 1


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each set, one set after another, and their bounds."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.searchsorted(owner[fresh], np.arange(n + 1))


def unique_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of each row one after another, bounds) for slices of a text column."""
    for part in slices(column):
        yield part.first, *distinct_sets(*row_shingles(Words(part), k))


def signer(k: int, bands: int, rows: int):
    """(key, text) to (key, digest of the set, size, band hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in unique_sets(batch["text"], k):
                raw, n = values.tobytes(), len(bounds) - 1
                digests = [digest_of(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                hashes = band_hashes(values, bounds, bands, rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), hashes.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].slice(first, n), pa.array(digests, pa.binary()), pa.array(np.diff(bounds).astype(np.int32)), lists],
                    names=["key", "digest", "size", "bands"],
                )

    return run


def set_maker(k: int):
    """(id, digest, ..., text) to (id, ..., shingles): the distinct shingle hashes in order, 8 bytes each; rows of another digest go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in unique_sets(batch["text"], k):
                part, sets = batch.slice(first, len(bounds) - 1), binary_column(values, bounds)
                right = pa.array([digest_of(s.as_buffer()) == d for s, d in zip(sets, part["digest"].to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([part["id"], part["members"], sets], names=["id", "members", "shingles"])
                yield out.filter(right)

    return run


def digest_of(raw) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each left set shares with each right set."""
    values, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    ours = np.bincount(where[owner < len(left)], minlength=len(values))
    theirs = np.bincount(where[owner >= len(left)], minlength=len(values))
    shared = np.cumsum((ours > 0) & (theirs > 0)) - 1
    keep = ((ours > 0) & (theirs > 0))[where]
    where, owner = shared[where[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    width, step = int(where.max()) + 1 if len(where) else 0, 4096
    for a in range(0, width, step):
        here = (where >= a) & (where < a + step)
        grid = np.zeros((len(left) + len(right), min(step, width - a)), np.float32)
        grid[owner[here], where[here] - a] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


def least_common(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether an overlap is enough is decided in whole numbers: 10000 * common >= t * union."""
    return 10000 * a >= round(10000 * threshold) * b


def block_verifier(threshold: float):
    """Rows of two blocks (or of one, twice) to a row per member that has links: id, its links, the smallest id it reaches."""

    def compare(left: pa.StructScalar, right: pa.StructScalar, alone: bool) -> Iterator[pa.RecordBatch]:
        ids, weights, sets = [], [], []
        for rows in (left, right):
            ids.append(rows.field("id").to_numpy())
            weights.append(rows.field("members").to_numpy())
            sets.append([np.frombuffer(s, np.uint64) for s in rows.field("shingles").to_pylist()])
        common = overlaps(*sets)
        sizes = [np.array([len(s) for s in x], np.int64) for x in sets]
        linked = least_common(common, sizes[0][:, None] + sizes[1][None, :] - common, threshold)
        if alone:
            np.fill_diagonal(linked, False)
        root = roots_of(linked, *ids)
        for grid, own, weight, label in [(linked, ids[0], weights[1], root[0]), (linked.T, ids[1], weights[0], root[1])][: 1 if alone else 2]:
            some = grid.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own[some], pa.int64()), pa.array((grid[some] * weight).sum(axis=1), pa.int64()), pa.array(label[some], pa.int64())], names=["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from compare(batch["rows_x"][k].values, batch["rows_y"][k].values, batch["x"][k] == batch["y"][k])

    return run


def roots_of(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column of a grid of links reaches."""
    left, right, far = left.astype(np.int64), right.astype(np.int64), np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], far).min(axis=1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], far).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def near_links(reps: DataFrame, texts: DataFrame, k: int, threshold: float, name: str) -> tuple[DataFrame, DataFrame]:
    """Links between representatives: (id, links) summed, and edges (a, b) that connect what is linked.

    ``reps`` (a written table) has id, key, digest, members, size, bands; ``texts`` has key, text. A representative's text is one
    of its key's with its digest.
    """
    met = reps.where("size > 0").select("id", F.posexplode("bands").alias("band", "h"))
    buckets = materialize(met.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-buckets")
    inside = materialize(met.join(buckets, ["band", "h"]), f"{name}-met")

    # a member of large buckets belongs to one block: of its first large bucket, dealt by its hash
    home = inside.where(F.col("n") > SMALL).groupBy("id").agg(F.min_by(F.struct("band", "h", "n"), "band").alias("b"))
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("b.n") / BLOCK))
    home = materialize(home.select("id", F.xxhash64("b.band", "b.h", deal).alias("block")), f"{name}-home")

    small = inside.where(F.col("n") <= SMALL).groupBy("band", "h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = small.select(F.posexplode("ids").alias("p", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("b")).distinct()
    homes = lambda c: home.select(F.col("id").alias(c), F.col("block").alias(f"block_{c}"))
    tried = pairs = materialize(pairs.join(homes("a"), "a", "left").join(homes("b"), "b", "left"), f"{name}-pairs")
    in_blocks = F.col("block_a").isNotNull() & F.col("block_b").isNotNull()

    def ordered(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]

    present = inside.where(F.col("n") > SMALL).join(home, "id").select("band", "h", "block").distinct()
    other = present.withColumnRenamed("block", "other")
    meeting = present.join(other, ["band", "h"]).where("block <= other").select(*ordered(F.col("block"), F.col("other")))
    meeting = materialize(meeting.union(pairs.where(in_blocks).select(*ordered(F.col("block_a"), F.col("block_b")))).distinct(), f"{name}-blocks")
    pairs = pairs.where(~in_blocks).select("a", "b")

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(home.select("id")).distinct()
    wanted = texts.join(reps.join(needed, "id", "left_semi").select("key", "id", "digest", "members"), "key").select("id", "digest", "members", "text")
    made = wanted.mapInArrow(set_maker(k), "id long, members long, shingles binary")
    sets = materialize(made.groupBy("id").agg(F.first("members").alias("members"), F.first("shingles").alias("shingles")), f"{name}-sets")

    one = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}"), F.col("members").alias(f"m_{c}"))
    # a pair can only reach the threshold if the sizes allow it; ids and sizes go first, sets only where they do
    sizes = reps.select("id", "size")
    fit = pairs.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("za")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("zb")), "b")
    fit = fit.where(10000 * F.least("za", "zb") >= round(10000 * threshold) * F.greatest("za", "zb")).select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch[c].to_pylist() for c in ("s_a", "s_b"))
            common = np.array([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            n = [len(p) // 8 + len(q) // 8 for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("a", "b", "m_a", "m_b")), pa.array(least_common(common, np.array(n, np.int64) - common, threshold))], names=["a", "b", "m_a", "m_b", "ok"])

    checked = fit.join(one("a"), "a").join(one("b"), "b").select("a", "b", "m_a", "m_b", "s_a", "s_b").mapInArrow(verify, "a long, b long, m_a long, m_b long, ok boolean")
    linked = materialize(checked.where("ok"), f"{name}-linked")

    blocks = home.join(sets, "id").groupBy("block").agg(F.collect_list(F.struct("id", "members", "shingles")).alias("rows"))
    blocks = materialize(blocks, f"{name}-contents")
    side = lambda c: blocks.select(F.col("block").alias(c), F.col("rows").alias(f"rows_{c}"))
    compared = meeting.join(side("x"), "x").join(side("y"), "y").mapInArrow(block_verifier(threshold), "id long, links long, root long")
    compared = materialize(compared, f"{name}-compared")

    counts = linked.select(F.col("a").alias("id"), F.col("m_b").alias("links")).union(linked.select("b", "m_a")).union(compared.select("id", "links"))
    written = (buckets, inside, home, tried, meeting, sets, blocks)
    edges = linked.select("a", "b").union(compared.select("id", "root"))
    for df in written:
        discard(df)
    return counts.groupBy("id").agg(F.sum("links").alias("links")), edges


def key_of() -> Column:
    """What tells documents apart: the id, and a hash of the text for rows that share it."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"))


def members(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: key, first (the class's smallest key), same (the smallest key with an equal set), n_links."""
    bands = bands_for(threshold, recall, rows)
    small_batches(docs.sparkSession)
    texts = docs.select(key_of().alias("key"), text_or_empty().alias("text"))
    signed = texts.mapInArrow(signer(k, bands, rows), "key struct<doc_id:bigint,h:bigint>, digest binary, size int, bands array<long>")
    # the class of a set; wordless documents have one each
    signed = materialize(signed.withColumn("own", F.when(F.col("size") == 0, F.col("key")).otherwise(F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h")))), "join-signed")
    same = signed.groupBy("digest", "own").agg(F.min("key").alias("key"), F.count("*").alias("members"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = materialize(same.withColumn("id", F.monotonically_increasing_id()), "join-reps")
    links, edges = near_links(reps, texts, k, threshold, "join")
    roots = components(edges, "join-roots")
    found = reps.select("digest", "own", "key", "members", "size", "id").join(links, "id", "left").join(roots, "id", "left")
    found = materialize(found.withColumn("root", F.coalesce("root", "id")), "join-found")
    discard(reps)
    named = found.groupBy("root").agg(F.min("key").alias("first"))
    per_class = found.join(named, "root").select(
        "digest",
        "own",
        F.col("key").alias("same"),
        "first",
        (F.coalesce("links", F.lit(0)) + F.when(F.col("size") > 0, F.col("members") - 1).otherwise(F.lit(0))).cast("long").alias("n_links"),
    )
    per_class = materialize(per_class, "join-classes")
    discard(found)
    return signed.select("key", "digest", "own").join(per_class, ["digest", "own"]).select("key", "first", "same", "n_links")


def classes(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its group), set_id (smallest id with an equal set), n_links.

    ``n_links`` counts the other documents whose set has a Jaccard similarity of at least ``threshold`` with its own, copies included.
    """
    shown = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    found = members(docs, **options)
    return found.select(shown("key.doc_id").alias("doc_id"), shown("first.doc_id").alias("class_id"), shown("same.doc_id").alias("set_id"), "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of every group, with the columns of ``docs``."""
    first = members(docs, **options).where("key = first").select("key").distinct()
    return nested(docs, key_of().alias("key")).join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
