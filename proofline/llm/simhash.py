"""Operator 11, SimHash near-dedup by pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints that differ in at most DISTANCE bits are linked.

The 64 bits are cut into a ring of SEGMENTS segments. If two fingerprints differ in at most DISTANCE bits, there is a segment from which every chain
of consecutive segments stays within its share of the budget: the first l segments differ in at most DISTANCE * l / SEGMENTS bits. With five segments
and four bits these budgets are 0, 1, 2, 3 and 4.

1. Texts become fingerprints; only different ones take part from here on, so copies cost nothing more.
2. A chain's first two steps are a key: a fingerprint owns one key for each start, and visits the keys that differ by one more bit in the second segment
   (a difference of one bit has one side where it is not set, so only that side visits). The shuffle is on these 26 bits and the start.
3. The members of a key are compared in the task: the chain's further steps first, the whole distance last. A task returns a forest of its links.
4. Fingerprints of keys with over LIMIT members take another exact way without comparisons: two of them are linked if and only if some point lies within
   half the distance of both. Every such point gathers its neighbours, of which it can have 2,081 at most, and links them to the smallest one.
5. Documents reachable through links form a component.

Defined results: a null or wordless text has fingerprint zero, linked like any other; one of fewer words than a shingle is one shingle of all its words. Rows with a
null doc_id take part; a component is named by null only if it has no other id. Repeated rows each get their row. Extra columns are ignored. An empty
table gives an empty result. Long texts are hashed in portions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.graph import components
from proofline.llm.shared import discard, documents, materialize, small_batches

# Words of a shingle, the seed of its hash, and the bits in which linked fingerprints may differ.
SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = 5
#: Members of a key that one task compares with each other at most.
LIMIT = 8192
#: Comparisons that a task has in memory at once, and bytes of a text that it splits at once.
AT_ONCE, PORTION = 1 << 21, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def widths(segments: int = SEGMENTS) -> list[int]:
    return [64 // segments + (k < 64 % segments) for k in range(segments)]


def starts(segments: int = SEGMENTS) -> list[int]:
    return np.cumsum([0, *widths(segments)[:-1]]).tolist()


def chain_masks(segments: int = SEGMENTS) -> np.ndarray:
    """masks[i, l]: the bits of the first l + 1 segments of the chain that begins at segment i."""
    own = [((1 << w) - 1) << s for w, s in zip(widths(segments), starts(segments), strict=True)]
    return np.array([[sum(own[(i + k) % segments] for k in range(n + 1)) for n in range(segments)] for i in range(segments)], np.uint64)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, portion by portion; each portion but the first begins with the last words of the one before."""
    begin, carry = 0, []
    while begin < len(text):
        cut = _SPACE.search(text, begin + PORTION)
        end = cut.start() if cut else len(text)
        words = carry + text[begin:end].lower().split()
        begin = end
        if len(words) >= SHINGLE or begin >= len(text):
            yield words
            words = words[len(words) - SHINGLE + 1 :]
        carry = words


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    n = len(words) - SHINGLE + 1
    joined = b" ".join(words)
    if n < 2:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    begins = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    parts = map(joined.__getitem__, map(slice, begins[:n].tolist(), (begins[SHINGLE:] - 1).tolist()))
    return np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64, n)


def fingerprint(text: bytes) -> int:
    total, counts = 0, np.zeros(64, np.int64)
    for words in words_of(text):
        found = hashes_of(words)
        total += len(found)
        for k in range(0, len(found), 1 << 15):
            counts += np.unpackbits(found[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp to (key, fp, own): the keys that it owns, and those that it visits."""
    size, at = widths(), starts()
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint64)
        for i in range(SEGMENTS):
            j = (i + 1) % SEGMENTS
            first, second = ((fps >> np.uint64(at[k])) & np.uint64((1 << size[k]) - 1) for k in (i, j))
            head = np.uint64(i << 40) | first << np.uint64(20)
            for bit in [None, *range(size[j])]:
                flip = np.uint64(0 if bit is None else 1 << bit)
                some = np.full(len(fps), True) if bit is None else second & flip == 0
                key = (head | second | flip)[some]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[some].view(np.int64)), pa.array(np.full(len(key), bit is None))], names=["key", "fp", "own"])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0..n-1 that each one reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, owners, visitors) to links (a, b) that connect the members within DISTANCE."""
    masks = chain_masks()
    budget = [DISTANCE * (k + 1) // SEGMENTS for k in range(SEGMENTS)]
    for batch in batches:
        start = (batch["key"].to_numpy() >> 40).astype(np.int64)
        sides = [batch[c].values.to_numpy(zero_copy_only=False)[batch[c].offsets[0].as_py() : batch[c].offsets[-1].as_py()] for c in ("owners", "visitors")]
        counts = [np.diff(batch[c].offsets.to_numpy()).astype(np.int64) for c in ("owners", "visitors")]
        # members of a key stand together, owners first
        owner_of = np.concatenate([np.repeat(np.arange(batch.num_rows), c) for c in counts])
        order = np.argsort(owner_of, kind="stable")
        fps, owned = np.concatenate(sides).view(np.uint64)[order], np.repeat([True, False], [len(s) for s in sides])[order]
        row = owner_of[order]
        ends = np.cumsum(counts[0] + counts[1])[row]
        todo = np.where(owned, ends - np.arange(len(fps)) - 1, 0)
        before = np.concatenate([[0], np.cumsum(todo)])
        left, right, k = [], [], 0
        while k < len(fps):
            stop = max(k + 1, int(np.searchsorted(before, before[k] + AT_ONCE, "right")) - 1)
            some = todo[k:stop]
            a = np.repeat(np.arange(k, stop), some)
            b = a + 1 + np.arange(before[stop] - before[k]) - np.repeat(before[k:stop] - before[k], some)
            for length in range(2, SEGMENTS):
                near = np.bitwise_count((fps[a] ^ fps[b]) & masks[start[row[a]], length]) <= budget[length]
                a, b = a[near], b[near]
            left.append(a)
            right.append(b)
            k = stop
        if not left:
            continue
        root = forest(np.concatenate(left), np.concatenate(right), len(fps))
        some = root != np.arange(len(fps))
        yield pa.RecordBatch.from_arrays([pa.array(fps[some].view(np.int64)), pa.array(fps[root[some]].view(np.int64))], names=["a", "b"])


def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp to (point, fp): all points within half the distance."""
    flips = np.array([sum(1 << k for k in bits) for n in range(DISTANCE // 2 + 1) for bits in combinations(range(64), n)], np.uint64)
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint64)
        for k in range(0, len(fps), 64):
            part = fps[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["point", "fp"])


def members(different: DataFrame) -> DataFrame:
    """(key, fp, own, n) of every key that has an owner and someone else.

    Spark sizes the keys by the table of fingerprints, as it can't know that each gives about 37 rows: left to itself it sends them all to the driver.
    So both sides are shuffled, whatever their supposed size.
    """
    met = different.select("fp").mapInArrow(keyed, "key long, fp long, own boolean")
    counts = met.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned").select("key", "n")
    return met.hint("merge").join(counts, "key")


def links(different: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``different`` (fp, each once) within DISTANCE. The edges are a written table."""
    inside = materialize(members(different), "simhash-met")
    pick = lambda own: F.collect_list(F.when(F.col("own") == own, F.col("fp")))
    small = inside.where(F.col("n") <= limit).groupBy("key").agg(pick(True).alias("owners"), pick(False).alias("visitors"))
    edges = small.mapInArrow(compare, "a long, b long")
    crowded = inside.where(F.col("n") > limit).select("fp").distinct()
    around = crowded.mapInArrow(points, "point long, fp long").groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    joined = around.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    edges = materialize(edges.union(joined).distinct(), "simhash-edges")
    discard(inside)
    return edges


def near(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint in hexadecimal, component_id."""
    marked = materialize(fingerprints(docs), "simhash-marked")
    different = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-different")
    edges = links(different, limit)
    roots = components(edges, "simhash-roots")
    discard(edges)
    known = different.join(roots, different["fp"] == roots["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(known.select("fp", "root").join(named, "root").select("fp", "component_id"), "simhash-found")
    for table in (different, roots):
        discard(table)
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(documents(spark, sf_dir))
