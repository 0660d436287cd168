"""Operator 2, benchmark decontamination by latent semantic retrieval.

1. Passages are windows of ``2 * STRIDE`` words, one every ``STRIDE`` words. Terms are the words of the benchmark. How many
   passages hold a term is counted over the whole corpus.
2. A randomised SVD of TF-IDF passages is formed over every passage of the corpus and the benchmark's own ones, weighted to the same total. One
   pass stores the terms of all passages; tasks add up how strongly terms stand together (terms x terms, sparse rows, summed by a shuffle), and
   the range, the power iteration and the spectrum are products with that sum. Tasks return sums of the size terms x rank, never passages.
3. Every passage of every document is folded into the latent space and compared with every benchmark passage by cosine. Those
   from ``COSINE`` up are candidates.
4. A candidate is checked in the words around it: the longest common subsequence must hold ``LCS`` of the item's words, or ``LCS_ANSWER`` of
   them if the answer (the words of the item's last sentence) stands there word for word.

The benchmark is worked off in blocks of ``BLOCK_ITEMS`` items, so what is sent to tasks is bounded however many items there are.

Items of fewer than ``MIN_ITEM`` words have no subsequence that tells; they match where all their words stand one after another, which is
looked up exactly (hashes of all runs of so many words, then the words' hashes one by one), with cosine null and lcs 1.

Defined results: null or wordless texts and items match nothing. Repeated items (equal text) each report their hits; repeated documents too.
Rows with a null doc_id report hits with a null doc_id, and ``remove`` treats them like others. Extra columns are ignored; without items or documents the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import discard, documents, materialize, nested, small_batches, text_or_empty
from proofline.llm.wordhash import Slice, Words, shingles, slices

STRIDE = 24
BLOCK_ITEMS = 200
EXTRA_RANK = 56
POWER = 1
#: The most frequent terms: those summed by a matrix product, and those of a slice counted in a table.
FREQUENT = 768
COUNTED = 128
#: The most frequent terms whose common passages are summed by a matrix product, and the sums that a task holds at once.
PAIRED = 256
CELLS = 1 << 24
COSINE = 0.45
LCS = 0.6
LCS_ANSWER = 0.45
MIN_ITEM = 8
MIN_ANSWER = 3
_SEED = 20240607


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for part in slices(pa.array(texts, pa.string())):
        words = Words(part)
        out += [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return out


def answer_of(text: str) -> str:
    """The last sentence of an item."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    table: np.ndarray  # whether any hash has these leading bits

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Vocabulary:
        hashes = np.unique(np.concatenate(items))
        table = np.zeros(1 << 20, bool)
        table[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return cls(hashes, table)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, their terms)."""
        place = np.flatnonzero(self.table[(words >> np.uint64(44)).astype(np.int64)])
        some = words[place]
        term = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        right = self.hashes[term] == some
        return place[right], term[right].astype(np.int32)


class Blocks:
    """Term occurrences by stride-long blocks, in order; a passage is a block with the next one of its document."""

    def __init__(self, term: np.ndarray, block: np.ndarray, paired: np.ndarray):
        self.term, self.block, self.n_blocks = term, block, len(paired)
        #: for each block, whether the next one is of the same document
        self.paired = paired

    def dense(self, top: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(how often each block holds each of the terms ``top``, which occurrences are of other terms); ``size`` is the number of terms."""
        column = np.full(size, -1, np.int64)
        column[top] = np.arange(len(top))
        own = column[self.term]
        often = own >= 0
        counts = np.bincount(self.block[often] * len(top) + own[often], minlength=self.n_blocks * len(top))
        return counts.reshape(self.n_blocks, len(top)), ~often

    def sums(self, rows: np.ndarray, top: np.ndarray) -> np.ndarray:
        """For each passage the sum of its terms' rows. The few terms ``top`` that make up most of a text go by one matrix product."""
        counts, rare = self.dense(top, len(rows))
        out = counts.astype(np.float32) @ rows[top].astype(np.float32)
        block, term = self.block[rare], self.term[rare]
        if len(term):
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            out[block[starts]] += np.add.reduceat(rows[term], starts, axis=0)
        out[:-1] += np.where(self.paired[:-1, None], out[1:], 0)
        return out


class Passages(Blocks):
    """The blocks of a slice, with its words."""

    def __init__(self, part: Slice, vocabulary: Vocabulary):
        self.words = Words(part)
        counts = np.diff(self.words.bounds)
        blocks = np.maximum(1, -(-counts // STRIDE))
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        place, term = vocabulary.find(self.words.hash)
        row = np.searchsorted(self.words.bounds, place, "right") - 1
        paired = np.ones(int(self.first_block[-1]), bool)
        paired[self.first_block[1:] - 1] = False
        super().__init__(term, self.first_block[row] + (place - self.words.bounds[row]) // STRIDE, paired)


def passages(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[int, Passages]]:
    for part in slices(batch["text"]):
        yield part.first, Passages(part, vocabulary)


#: Terms in order, how many each block has, and which blocks have a next one.
STORED = "term binary, counts binary, paired binary"


def store_terms(vocabulary: Vocabulary):
    """text to STORED, a row per slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, p in passages(batch, vocabulary):
                counts = np.bincount(p.block, minlength=p.n_blocks).astype(np.uint8)  # STRIDE at most
                row = p.term.astype(np.min_scalar_type(len(vocabulary.hashes))), counts, p.paired
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["term", "counts", "paired"])

    return run


def stored(batch: pa.RecordBatch, size: int) -> Iterator[Blocks]:
    for term, counts, paired in zip(*(batch[c].to_pylist() for c in ("term", "counts", "paired")), strict=True):
        counts = np.frombuffer(counts, np.uint8)
        yield Blocks(np.frombuffer(term, np.min_scalar_type(size)).astype(np.int32), np.repeat(np.arange(len(counts)), counts), np.frombuffer(paired, bool))


def count_terms(size: int):
    """STORED to (term, n): the passages that hold each term; and (-1, passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for p in stored(batch, size):
                top = np.argsort(np.bincount(p.term, minlength=size))[-COUNTED:]
                counts, rare = p.dense(top, size)
                held = counts > 0
                held[:-1] |= held[1:] & p.paired[:-1, None]
                total[top] += held.sum(axis=0)
                block, term = p.block[rare].astype(np.int64), p.term[rare]
                before = block - 1
                keep = (before >= 0) & p.paired[before]  # a block counts for the passage it begins and the one it ends
                pairs = np.concatenate([block * size + term, (before * size + term)[keep]])
                total += np.bincount(np.unique(pairs) % size, minlength=size)
                n += p.n_blocks
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *range(size)], pa.int32()), "n": pa.array([n, *total.tolist()], pa.int64())})

    return run


#: A row of the sums A'A: its term, other terms and the sums.
TOGETHER = "row int, other binary, value binary"


def together_rows(found: Iterator[tuple[int, np.ndarray, np.ndarray]], most: int = 200) -> Iterator[pa.RecordBatch]:
    """Rows of TOGETHER, so many a batch."""
    while part := list(islice(found, most)):
        row, other, value = zip(*part, strict=True)
        columns = [pa.array(row, pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in other], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in value], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "other", "value"])


def together(idf: np.ndarray, top: np.ndarray, cells: int = CELLS):
    """(STORED, weight) to parts of A'A over passages A (scaled to length one, then by their weight).

    Rows of the terms ``top`` hold only those terms, rows of others all terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(idf)
        square, often = idf**2, np.zeros((len(top), len(top)))
        line = np.full(size, -1, np.int64)  # the rarer terms' rows of ``sums``
        rest = np.setdiff1d(np.arange(size), top)
        line[rest] = np.arange(len(rest)) * size
        sums = np.zeros(len(rest) * size) if len(rest) * size <= cells else None
        keys, values, held = [], [], 0

        def rows() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """What was added for rarer terms, where it doesn't fit in a table."""
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.diff(every[order], prepend=-1))
            total, every = np.add.reduceat(np.concatenate(values)[order], first), every[order][first]
            cuts = np.flatnonzero(np.diff(every // size, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(every)], strict=True):
                k, other = int(rest[every[i] // size]), every[i:j] % size
                yield k, other, total[i:j] * idf[other] * idf[k]

        def table() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for k, row in zip(rest.tolist(), sums.reshape(len(rest), size), strict=True):
                other = np.flatnonzero(row)
                if len(other):
                    yield k, other, row[other] * idf[other] * idf[k]

        for batch in batches:
            for weight, p in zip(batch["weight"].to_pylist(), stored(batch, size), strict=True):
                length = np.bincount(p.block, square[p.term], p.n_blocks)
                length[:-1] += np.where(p.paired[:-1], length[1:], 0)
                scale = weight**2 / np.maximum(length, 1e-9)
                counts = p.dense(top, size)[0].astype(np.float32)
                counts[:-1] += np.where(p.paired[:-1, None], counts[1:], 0)
                counts *= np.sqrt(scale)[:, None].astype(np.float32)
                often += counts.T @ counts
                # a rarer term meets all of its own block (in the passage that begins there and the one that ends there), the block before and the next one
                n = np.bincount(p.block, minlength=p.n_blocks)
                ahead = np.where(p.paired, scale, 0)
                behind = np.concatenate([[0], ahead[:-1]])
                runs = np.stack([np.concatenate([[0], n[:-1]]) * (behind > 0), n, np.concatenate([n[1:], [0]]) * (ahead > 0)], axis=1)
                parts = np.stack([behind, behind + scale, ahead], axis=1)
                rare = np.flatnonzero(line[p.term] >= 0)
                block = p.block[rare]
                own = runs[block]
                each = own.sum(axis=1)
                at = np.repeat((np.cumsum(n) - n)[block] - own[:, 0] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                key, value = np.repeat(line[p.term[rare]], each) + p.term[at], np.repeat(parts[block].ravel(), own.ravel())
                if sums is not None:
                    np.add.at(sums, key, value)
                elif len(key):
                    keys, values, held = [*keys, key], [*values, value], held + len(key)
                    if held >= cells // 4:
                        yield from together_rows(rows())
                        keys, values, held = [], [], 0
        if keys:
            yield from together_rows(rows())
        elif sums is not None:
            yield from together_rows(table())
        yield from together_rows((k, top, row * idf[top] * idf[k]) for k, row in zip(top.tolist(), often, strict=True) if row.any())

    return run


def merged(size: int):
    """Parts in order of their row to whole rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at, total = None, np.zeros(size)
        for batch in batches:
            for row, other, value in zip(*(batch[c].to_pylist() for c in ("row", "other", "value")), strict=True):
                if row != at:
                    if at is not None:
                        yield at, np.flatnonzero(total), total[total != 0]
                    at, total = row, np.zeros(size)
                total[np.frombuffer(other, np.int32)] += np.frombuffer(value, np.float32)
        if at is not None:
            yield at, np.flatnonzero(total), total[total != 0]

    return lambda batches: together_rows(rows(batches))


def product(basis: np.ndarray, top: np.ndarray):
    """Whole rows of A'A to sums of (row, vector): rows of A'A basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, often = np.zeros(basis.shape), np.zeros(len(basis), bool)
        often[top] = True
        for batch in batches:
            for row, other, value in zip(*(batch[c].to_pylist() for c in ("row", "other", "value")), strict=True):
                other, value = np.frombuffer(other, np.int32), np.frombuffer(value, np.float32)
                out[row] += value @ basis[other]
                if not often[row]:  # what rows of ``top`` leave out
                    back = often[other]
                    out[other[back]] += value[back, None] * basis[row]
        rows = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int32()), "vector": pa.array([out[r].tobytes() for r in rows], pa.binary())})

    return run


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v) for v in pdf["vector"]], axis=0)
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "vector": [total.tobytes()]})


def summed(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Row-wise sums of what the tasks return; at most terms x rank numbers, a bound set by BLOCK_ITEMS."""
    out = np.zeros(shape)
    for row, vector in df.groupBy("row").applyInPandas(added, "row int, vector binary").collect():
        out[row] = np.frombuffer(vector)
    return out


def common_subsequence(words: list[int], masks: dict[int, int], length: int) -> int:
    """Bit-parallel length of the longest common subsequence; masks give each word's places in the item."""
    every = (1 << length) - 1
    state = every
    for w in words:
        m = masks.get(w, 0)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & every
    return length - state.bit_count()


def short_items(items: list) -> dict[int, tuple[np.ndarray, list]]:
    """By length: the hashes of the items of so many words, in order, and those items."""
    out = {}
    for n in {len(words) for _, words, _ in items}:
        own = [(shingles(words, n)[0], number, words) for number, words, _ in items if len(words) == n]
        own.sort(key=lambda x: int(x[0]))
        out[n] = np.array([h for h, *_ in own], np.uint64), [x[1:] for x in own]
    return out


def spelled_out(words: np.ndarray, short: dict[int, tuple[np.ndarray, list]]) -> Iterator[tuple[int, int]]:
    """(item_id, word) of the first place of every short item in a document's words."""
    for n, (hashes, items) in short.items():
        runs = shingles(words, n)
        seen = set()
        for place in np.flatnonzero(np.isin(runs, hashes)).tolist():
            for k in range(int(np.searchsorted(hashes, runs[place])), int(np.searchsorted(hashes, runs[place], "right"))):
                if k not in seen and (words[place : place + n] == items[k][1]).all():
                    seen.add(k)
                    yield items[k][0], place


def search_short(items: list):
    """(doc_id, h, text) to hits of short items."""
    short = short_items(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = list(zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), strict=True)), []
            for part in slices(batch["text"]):
                words = Words(part)
                for row in range(part.rows):
                    for item, place in spelled_out(words.hash[words.bounds[row] : words.bounds[row + 1]], short):
                        out.append((*keys[part.first + row], item, None, 1.0, False, place))
            yield hits_of(out)

    return run


def hits_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "h", "item_id", "cosine", "lcs", "answer", "word"])


def search(vocabulary: Vocabulary, folded: np.ndarray, top: np.ndarray, queries: np.ndarray, owner: np.ndarray, items: list, cosine: float):
    """(doc_id, h, text) to hits (doc_id, h, item_id, cosine, lcs, answer, word)."""
    masks = []
    for _, words, _ in items:
        own: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            own[w] = own.get(w, 0) | 1 << k
        masks.append(own)

    def verify(words: np.ndarray, begin: int, end: int, number: int) -> tuple[float, bool, int]:
        _, item, answer = items[number]
        begin, end = max(0, begin - len(item)), min(len(words), end + len(item))
        region = words[begin:end].tolist()
        share = common_subsequence(region, masks[number], len(item)) / len(item)
        found = False
        if len(answer) >= MIN_ANSWER and share < LCS:
            wanted = answer.tolist()
            found = any(region[k : k + len(wanted)] == wanted for k, w in enumerate(region) if w == wanted[0])
        return share, found, begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = list(zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), strict=True)), []
            for first, p in passages(batch, vocabulary):
                vectors = p.sums(folded, top)
                length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                likeness = vectors @ queries.T
                at, query = np.nonzero(likeness >= cosine * np.maximum(length, 1e-6)[:, None])
                if not len(at):
                    continue
                best: dict[tuple[int, int], list] = {}
                rows = np.searchsorted(p.first_block, at, "right") - 1
                for block, row, q in zip(at.tolist(), rows.tolist(), query.tolist(), strict=True):
                    number, near = int(owner[q]), float(likeness[block, q] / length[block])
                    runs = best.setdefault((row, number), [])
                    if runs and block - runs[-1][1] <= 1:
                        runs[-1][1:] = [block, max(near, runs[-1][2])]
                    else:
                        runs.append([block, block, near])
                for (row, number), runs in best.items():
                    words = p.words.hash[p.words.bounds[row] : p.words.bounds[row + 1]]
                    hits = []
                    for a, b, near in runs:
                        start = (a - int(p.first_block[row])) * STRIDE
                        share, found, place = verify(words, start, start + (b - a + 2) * STRIDE, number)
                        if share >= LCS or found and share >= LCS_ANSWER:
                            hits.append((share, near, found, place))
                    if hits:
                        share, near, found, place = max(hits)
                        out.append((*keys[first + row], items[number][0], near, share, found, place))
            yield hits_of(out)

    return run


HIT = "doc_id long, h long, item_id long, cosine double, lcs double, answer boolean, word long"


def latent(terms: DataFrame, own: DataFrame, idf: np.ndarray, weight: float, rank: int) -> np.ndarray:
    """The leading directions of all passages of the corpus, and of the benchmark's ``own`` ones with their weight: terms x rank."""
    size, top = len(idf), np.argsort(idf)[:PAIRED]
    both = terms.withColumn("weight", F.lit(1.0)).unionByName(own.withColumn("weight", F.lit(weight)))
    parts = both.mapInArrow(together(idf, top), TOGETHER).repartition("row").sortWithinPartitions("row")
    sums = materialize(parts.mapInArrow(merged(size), TOGETHER), "together")
    times = lambda basis: summed(sums.mapInArrow(product(basis, top), "row int, vector binary"), basis.shape)
    basis = np.linalg.qr(times(np.random.default_rng(_SEED).standard_normal((size, min(rank, size)))))[0]
    for _ in range(POWER):
        basis = np.linalg.qr(times(basis))[0]
    spectrum = basis.T @ times(basis)
    discard(sums)
    return basis @ np.linalg.eigh((spectrum + spectrum.T) / 2)[1][:, ::-1]


def find_block(docs: DataFrame, items: list[tuple[int, str]], cosine: float) -> DataFrame | None:
    """Hits of one block of items."""
    spark = docs.sparkSession
    hashes = word_hashes([t for _, t in items])
    answers = word_hashes([answer_of(t) for _, t in items])
    both = [(i, h, a, t) for (i, t), h, a in zip(items, hashes, answers, strict=True) if len(h)]
    kept, few = [x for x in both if len(x[1]) >= MIN_ITEM], [x[:3] for x in both if len(x[1]) < MIN_ITEM]
    short = docs.mapInArrow(search_short(few), HIT) if few else None
    if not kept:
        return short
    vocabulary = Vocabulary.of([h for _, h, _, _ in kept])
    size = len(vocabulary.hashes)
    terms = materialize(docs.select("text").mapInArrow(store_terms(vocabulary), STORED), "terms")
    counts = {r["term"]: r["n"] for r in terms.mapInArrow(count_terms(size), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = max(1, counts.get(-1, 0))
    idf = np.log((2.0 + total) / (1.0 + np.array([counts.get(t, 0) for t in range(size)])))

    top = np.argsort(idf)[:FREQUENT]
    own = spark.createDataFrame([(t,) for *_, t in kept], "text string").mapInArrow(store_terms(vocabulary), STORED)
    folded = (latent(terms, own, idf, float(np.sqrt(total / len(kept)) + 1), len(kept) + EXTRA_RANK) * idf[:, None]).astype(np.float32)
    discard(terms)

    queries, owner = [], []
    for number, (_, words, _, _) in enumerate(kept):
        for a in range(0, max(1, len(words) - STRIDE), STRIDE):
            terms = vocabulary.find(words[a : a + 2 * STRIDE])[1]
            queries.append(folded[terms].sum(axis=0))
            owner.append(number)
    queries = np.array(queries)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-6)
    found = docs.mapInArrow(search(vocabulary, folded, top, queries.astype(np.float32), np.array(owner), [(i, h, a) for i, h, a, _ in kept], cosine), HIT)
    return found if short is None else found.unionByName(short)


def located(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``find`` with ``h``, a hash of the document's text."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).where("text <> ''")
    blocks = -(-items.count() // block_items)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    out = spark.createDataFrame([], HIT)
    for b in range(blocks):
        own = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"], r["item_id"]) for r in items.where(F.col("block") == b).collect())
        found = find_block(docs, [(item, text) for _, text, item in own], cosine)
        out = out if found is None else out.unionByName(found)
    return out


def find(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every (document, item) that is contaminated: doc_id, item_id, cosine, lcs, answer, word."""
    return located(docs, benchmark, **options).drop("h")


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without a hit, with the columns of ``docs``."""
    hits = located(docs, benchmark, **options).select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "h").distinct()
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(text_or_empty()).alias("h"))
    return nested(docs, key.alias("key")).join(hits.select(F.struct("doc_id", "none", "h").alias("key")), "key", "left_anti").select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
