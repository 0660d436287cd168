"""Operator 5, suffix-array dedup: byte strings of ``LENGTH`` that occur earlier, by merging Burrows-Wheeler transforms of shards.

Texts are far too many for one suffix array, so strings that can be equal are first brought together:

1. Every window of ``LENGTH`` bytes is represented by the least hash of the strings of ``GRAMS[0]`` bytes in it (winnowing). Equal windows
   have equal representatives; consecutive windows with one representative are a run. A representative that occurs once has no equal and is left out.
   Those that a small sample shows to be very frequent are counted with a salt; they repeat for certain.
2. Texts that hold repeated representatives are dealt out by ranges of (least representative, doc_id), so texts that share much stand together and
   a large group of copies is spread over as many tasks as it needs. A task takes about ``Sizes.batch`` bytes at a time, divides them into shards,
   builds each shard's Burrows-Wheeler transform, and merges the transforms by refining the interleave: every step puts rows in order of one more
   symbol to the left, and block borders mark where common prefixes end. Rows of whole runs are refined by the run's length, which tells
   equal runs; of the different ones that are left, rows of single windows are refined ``LENGTH`` times. Blocks that remain are the repeated
   intervals; suffixes of different shards are never sorted together. In each interval the earliest stays.
3. Runs that are left over and whose representative is also left over elsewhere are cut out as pieces, meet by representative, and are merged alike.
   A representative of more than ``Sizes.group`` pieces is dealt out in groups of about that size. What a group leaves over is represented
   anew by a longer string (the next of ``GRAMS``) within its windows and meets again, until groups are whole. So a short line in
   very many contexts falls apart by context, and a long equal passage shrinks by that factor each round.

Hashes only bring strings together; what is removed is decided by merging. The one exception are whole texts that are equal (by MD5), which count
as copies of the earliest beforehand. Order is by doc_id, then place; a null doc_id comes first.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing. Texts of more than ``Sizes.portion`` bytes are worked on in overlapping
portions. Repeated rows (equal doc_id and text) count as one document and each get its result. Rows that share a doc_id but not the
text are ordered by a hash of the text. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.shared import discard, documents, drawn, drop_shuffles, materialize, small_batches, text_or_empty
from proofline.llm.wordhash import _powers_of, binary_column, mix, slices

LENGTH = 100
#: Lengths of the strings that represent windows, by round; the last is the window itself.
GRAMS = (32, 64, 88, 97, 100)
SAMPLE_DOCS = 4000
SAMPLE_HOT = 20
SALTS = 64
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Sizes:
    """How much is worked on at once; results don't depend on it."""

    #: pieces of one representative that meet at once, about
    group: int = 2000
    #: bytes in a shard, in what is merged at once, and in a portion of a long text
    shard: int = 1 << 18
    batch: int = 1 << 20
    portion: int = 1 << 20


_BYTE = np.random.default_rng(100).integers(1, 2**63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash for every string of ``size`` bytes, by its first byte."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers_of(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def runs_of(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(representative, row, first window, windows) of every run in the rows that ``offsets`` cut ``data`` into."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty.astype(np.uint64), empty, empty, empty
    grams = gram_hashes(data, gram)
    least = sliding_least(grams, LENGTH - gram + 1)
    inside = np.zeros(len(least) + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(place):
        return empty.astype(np.uint64), empty, empty, empty
    row = np.searchsorted(offsets, place, "right") - 1
    value = least[place]
    fresh = np.ones(len(place), bool)
    # a run ends with the window that begins with its representative, so equal windows of a periodic text are in different runs
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | (grams[place[:-1]] == value[:-1])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(place)))
    return value[begin], row[begin], place[begin] - offsets[row[begin]], count


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (fp, doc_id, h, place): place is the first window's start times 256, plus how many windows."""
    for batch in batches:
        for part in slices(batch["text"]):
            value, row, start, count = runs_of(part.data, part.offsets, GRAMS[0])
            own = pa.array(row + part.first)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), batch["doc_id"].take(own), batch["h"].take(own), pa.array(start * 256 + count)], names=["fp", "doc_id", "h", "place"])


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each place, Burrows-Wheeler transform, row of each row's left neighbour), rows in order of ``LENGTH`` symbols at least."""
    n = len(symbols)
    bits = max(1, int(n - 1).bit_length())
    wide = bits > 21  # then ranks and places don't fit in one number
    depth = (62 - bits) // 8
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << 8 | np.roll(symbols, -k)
    while True:
        if wide:
            order = np.argsort(key, kind="stable")
            key = key[order]
        else:
            packed = np.sort(key << bits | np.arange(n))
            order, key = packed & (1 << bits) - 1, packed >> bits
        fresh = np.append(0, np.cumsum(key[1:] != key[:-1]))
        if depth >= LENGTH or fresh[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        key = rank << bits | np.roll(rank, -depth)
        depth *= 2
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    return row, symbols[order - 1], row[order - 1]


class Shards:
    """The transforms of all shards of ``symbols``, one after another; shards end behind an end mark (0)."""

    def __init__(self, symbols: np.ndarray, shard: int):
        ends = np.flatnonzero(symbols == 0) + 1
        bounds = np.unique(np.concatenate([[0], ends[np.minimum(np.searchsorted(ends, np.arange(shard, len(symbols), shard)), len(ends) - 1)], [len(symbols)]]))
        self.row = np.empty(len(symbols), np.int32)
        self.transformed = np.empty(len(symbols), np.uint8)
        self.left = np.empty(len(symbols), np.int32)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            row, self.transformed[a:b], left = transform(symbols[a:b])
            self.row[a:b], self.left[a:b] = row + a, left + a

    def merge(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which of the strings of ``lengths`` symbols that end in front of ``places`` are equal: a number for each string, -1 if it has no equal.

        The rows of all shards are interleaved. Every step moves them one symbol to the left and puts them in order of it, stably, so after step h
        they are in order of their first h symbols; blocks hold rows that agree so far. A row alone in its block can't agree with
        any other later on and leaves.
        """
        rows, own = self.row[places], np.arange(len(places), dtype=np.int32)
        number, given = np.full(len(places), -1, np.int64), 0
        order = np.argsort(lengths, kind="stable")
        rows, own, lengths = rows[order], own[order], lengths[order].astype(np.int16)
        block = np.cumsum(np.diff(lengths, prepend=lengths[:1]) != 0).astype(np.int32)
        step = 0
        while len(rows):
            step += 1
            first = self.transformed[rows]
            order = np.argsort(first, kind="stable")
            rows, own, block, lengths, first = self.left[rows[order]], own[order], block[order], lengths[order], first[order]
            block = np.append(0, np.cumsum((block[1:] != block[:-1]) | (first[1:] != first[:-1]), dtype=np.int32))[: len(rows)]
            done = lengths == step
            if step % 4 == 0 or done.any():
                some = np.bincount(block)[block] > 1
                over = some & done
                number[own[over]] = block[over] + given
                given += len(rows)
                stay = some & ~done
                rows, own, block, lengths = rows[stay], own[stay], block[stay], lengths[stay]
        return number


def later_of(number: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Whether each string has an equal one before it, in the order given (most significant last)."""
    at = np.lexsort((*order, number))
    later = np.zeros(len(number), bool)
    later[at[1:]] = (number[at[1:]] == number[at[:-1]]) & (number[at[1:]] >= 0)
    return later


@dataclass
class Batch:
    """Some texts one after another in ``data``, cut at ``offsets``; their places in the order of documents; and their runs in order."""

    data: np.ndarray
    offsets: np.ndarray
    rank: np.ndarray
    base: np.ndarray  # where each text starts in its document
    text: np.ndarray  # of each run: its text, first byte in ``data``, windows, representative
    begin: np.ndarray
    n: np.ndarray
    key: np.ndarray

    def later(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, stop) of byte ranges whose strings are equal to earlier ones, and the runs that are left over."""
        size, length = len(self.data), self.n + (LENGTH - 1)
        edges = np.bincount(self.begin, minlength=size + 1) - np.bincount(self.begin + length, minlength=size + 1)
        some = np.flatnonzero(np.cumsum(edges[:size]) > 0)
        opens = np.zeros(size + 1, bool)
        opens[self.offsets] = True
        opens = opens[some]
        opens[0] = True
        opens[1:] |= some[1:] != some[:-1] + 1
        stretch = np.cumsum(opens) - 1
        # bytes of UTF-8 are at most F4, so every symbol fits in a byte beside the end mark 0 behind each stretch
        symbols = np.zeros(len(some) + stretch[-1] + 1, np.uint8)
        symbols[np.arange(len(some)) + stretch] = self.data[some] + np.uint8(1)
        behind = np.zeros(size, np.int32)  # the symbol's place behind each byte
        behind[some] = np.arange(len(some)) + stretch + 1
        shards = Shards(symbols, shard)

        rank, place = self.rank[self.text], self.base[self.text] + self.begin - self.offsets[self.text]
        gone = later_of(shards.merge(behind[self.begin + length - 1], length), place, rank)
        alive = np.flatnonzero(~gone)
        _, which, count = np.unique(self.key[alive], return_inverse=True, return_counts=True)
        several = alive[count[which] > 1]
        run = np.repeat(several.astype(np.int32), self.n[several])
        offset = (np.arange(len(run)) - np.repeat(np.cumsum(self.n[several]) - self.n[several], self.n[several])).astype(np.int32)
        first = self.begin[run] + offset
        again = later_of(shards.merge(behind[first + LENGTH - 1], np.full(len(run), LENGTH, np.int16)), place[run] + offset, rank[run])
        kept = np.ones(len(self.n), bool)
        kept[gone] = False
        kept[several] = np.bincount(run[again], minlength=len(self.n))[several] < self.n[several]
        run, first = run[again], first[again]
        fresh = np.ones(len(run), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (first[1:] != first[:-1] + 1)
        opening = np.flatnonzero(fresh)
        closing = np.append(opening[1:], len(run))[: len(opening)] - 1
        text = np.concatenate([self.text[gone], self.text[run[opening]]])
        shift = self.base[text] - self.offsets[text]
        start = np.concatenate([self.begin[gone], first[opening]]) + shift
        stop = np.concatenate([(self.begin + length)[gone], first[closing] + LENGTH]) + shift
        return text, start, stop, np.flatnonzero(kept)


FOUND = "key long, doc_id long, h long, start int, stop int, batch long"


def found_batch(batch: Batch, shard: int, doc_id: list[int], h: list[int], number: int, leave: np.ndarray) -> pa.RecordBatch:
    """Rows of ``FOUND``: ranges to remove (batch null), and the runs left over where ``leave`` asks for them (start, and stop behind the last window)."""
    text, start, stop, kept = batch.later(shard)
    kept = kept[leave[kept]]
    shift = (batch.base - batch.offsets[:-1])[batch.text[kept]]
    own = np.concatenate([text, batch.text[kept]])
    doc_id, h = np.array(doc_id, np.int64)[own], np.array(h, np.int64)[own]
    columns = [np.concatenate([np.zeros(len(text), np.int64), batch.key[kept]]), doc_id, h]
    columns += [np.concatenate([start, batch.begin[kept] + shift]).astype(np.int32), np.concatenate([stop, (batch.begin + batch.n)[kept] + (LENGTH - 1) + shift]).astype(np.int32)]
    tag = pa.array(np.full(len(own), number), mask=np.arange(len(own)) < len(text))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), tag], names=["key", "doc_id", "h", "start", "stop", "batch"])


def batch_number(k: int) -> int:
    return TaskContext.get().partitionId() << 32 | k


def ranks_of(doc_id: list[int], h: list[int]) -> np.ndarray:
    """Equal for portions of one document."""
    places = {x: k for k, x in enumerate(sorted(set(zip(doc_id, h, strict=True))))}
    return np.array([places[x] for x in zip(doc_id, h, strict=True)], np.int64)


def compare_texts(sizes: Sizes):
    """(doc_id, h, text, runs) to rows of ``FOUND``, about ``sizes.batch`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple] = []  # doc_id, h, base, bytes, keys, starts in them, windows
        size, done = 0, 0

        def merged() -> pa.RecordBatch:
            doc_id, h, base, raws, keys, starts, ns = zip(*texts, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            text = np.repeat(np.arange(len(raws)), [len(k) for k in keys])
            batch = Batch(np.frombuffer(b"".join(raws), np.uint8), offsets, ranks_of(doc_id, h), np.array(base), text, np.concatenate(starts) + offsets[text], np.concatenate(ns), np.concatenate(keys))
            return found_batch(batch, sizes.shard, doc_id, h, batch_number(done), np.ones(len(text), bool))

        for batch in batches:
            runs = batch["runs"]
            bounds = runs.offsets.to_numpy().astype(np.int64)
            every, place = (runs.values.field(c).to_numpy() for c in ("fp", "place"))
            for k, (doc_id, h, text) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_id", "h", "text")), strict=True)):
                raw, own = text.encode(), slice(bounds[k], bounds[k + 1])
                order = np.argsort(place[own])
                key, start, n = every[own][order], place[own][order] // 256, place[own][order] % 256
                fits = start + n - 1 + LENGTH <= len(raw)  # rows that share a doc_id share their lists of runs
                key, start, n = key[fits], start[fits], n[fits]
                for base in range(0, len(raw), sizes.portion):
                    inside = (start >= base) & (start < base + sizes.portion)
                    if inside.any():
                        texts.append((doc_id, h, base, raw[base : base + sizes.portion + 256 + LENGTH], key[inside], start[inside] - base, n[inside]))
                        size += len(texts[-1][3])
                    if size >= sizes.batch:
                        yield merged()
                        texts, size, done = [], 0, done + 1
        if texts:
            yield merged()

    return run


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text, wanted) to pieces."""
    for batch in batches:
        wanted = batch["wanted"]
        bounds = wanted.offsets.to_numpy().astype(np.int64)
        own = wanted.values.slice(bounds[0], bounds[-1] - bounds[0])
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        raws = [t.encode() for t in batch["text"].to_pylist()]
        pieces = [raws[k][a:b] for k, a, b in zip(row.tolist(), own.field("start").to_pylist(), own.field("stop").to_pylist(), strict=True)]
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [own.field("key"), own.field("met"), batch["doc_id"].take(at), batch["h"].take(at), own.field("start"), pa.array(pieces, pa.binary())],
            names=["key", "met", "doc_id", "h", "start", "piece"],
        )


PIECE = "key long, met long, doc_id long, h long, start int, piece binary"


def compare_pieces(sizes: Sizes):
    """(key, salt, met, doc_id, h, start, piece), sorted by key and salt, to rows of ``FOUND`` with ``piece``; whole groups, about ``sizes.batch`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, done, group = 0, 0, None

        def merged() -> pa.RecordBatch:
            key, met, doc_id, h, start, raws = zip(*rows, strict=True)
            lengths = np.array([len(r) for r in raws])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            # pieces of one document keep their order by their starts
            batch = Batch(np.frombuffer(b"".join(raws), np.uint8), offsets, ranks_of(doc_id, h), np.array(start, np.int64), np.arange(len(raws)), offsets[:-1], lengths - (LENGTH - 1), np.array(key))
            found = found_batch(batch, sizes.shard, doc_id, h, batch_number(done), np.array(met) > sizes.group)
            by_place = {(d, x, s): r for d, x, s, r in zip(doc_id, h, start, raws, strict=True)}
            pieces = [by_place[d, x, s] if b is not None else None for d, x, s, b in zip(*(found[c].to_pylist() for c in ("doc_id", "h", "start", "batch")), strict=True)]
            return pa.RecordBatch.from_arrays([*found.columns, pa.array(pieces, pa.binary())], names=[*found.schema.names, "piece"])

        for batch in batches:
            for salt, *row in zip(*(batch[c].to_pylist() for c in ("salt", "key", "met", "doc_id", "h", "start", "piece")), strict=True):
                if size >= sizes.batch and group != (row[0], salt):
                    yield merged()
                    rows, size, done = [], 0, done + 1
                rows.append(tuple(row))
                size, group = size + len(row[-1]), (row[0], salt)
        if rows:
            yield merged()

    return run


def longer(gram: int):
    """(key, doc_id, h, start, piece, batch) represented anew by strings of ``gram`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch["piece"].to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
            value, row, begin, count = runs_of(np.frombuffer(b"".join(raws), np.uint8), offsets, gram)
            old = batch["key"].to_numpy().view(np.uint64)[row]
            with np.errstate(over="ignore"):
                key = mix(old + value).astype(np.int64)
            pieces = [raws[k][a : a + n - 1 + LENGTH] for k, a, n in zip(row.tolist(), begin.tolist(), count.tolist(), strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch["doc_id"].take(at), batch["h"].take(at), pa.array((batch["start"].to_numpy()[row] + begin).astype(np.int32)), batch["batch"].take(at), pa.array(pieces, pa.binary())],
                names=["key", "doc_id", "h", "start", "batch", "piece"],
            )

    return run


def meeting(left: DataFrame) -> DataFrame:
    """The keys of runs left over by different batches, and how many they are (``met``)."""
    return left.groupBy("key").agg(F.count("*").alias("met"), F.min("batch").alias("lo"), F.max("batch").alias("hi")).where("lo <> hi").select("key", "met")


def keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))


def later_copies(texts: DataFrame) -> DataFrame:
    """Whole texts that an earlier document has too: doc_id, h, n_bytes. They lose all their bytes, if there are ``LENGTH``."""
    found = texts.select("doc_id", "h", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("md5")).where(F.col("n_bytes") >= LENGTH)
    first = found.groupBy("md5").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.max(F.struct("doc_id", "h")).alias("last")).where("first <> last").select("md5", "first")
    return found.join(first, "md5").where(F.struct("doc_id", "h") > F.col("first")).select("doc_id", "h", "n_bytes")


def candidates_of(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """The texts that hold repeated representatives, but for whole copies: doc_id, h, text, runs, least (representative)."""
    runs = lambda df: df.mapInArrow(fingerprints, "fp long, doc_id long, h long, place long")
    share = SAMPLE_DOCS / max(1, texts.count())
    hot = runs(texts.where(drawn(F.xxhash64("doc_id", "h"), share))).groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_HOT).select("fp", F.lit(True).alias("hot"))
    hot = materialize(hot, "repeat-hot")  # at most the sample's runs by SAMPLE_HOT, whatever the input
    marked = runs(texts).join(F.broadcast(hot), "fp", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS))).otherwise(F.lit(-1))
    counted = marked.withColumn("salt", salt).withColumn("n", F.count("*").over(Window.partitionBy("fp", "salt"))).where("n > 1 OR hot")
    # by id and text, as texts may share an id, or have none
    per_doc = counted.groupBy("doc_id", "h").agg(F.collect_set(F.struct("fp", "place")).alias("runs"), F.min("fp").alias("least"))
    per_doc = per_doc.join(copies.select("doc_id", "h").distinct(), ["doc_id", "h"], "left_anti")  # before the texts are joined, so they move once
    own = texts.join(per_doc, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    found = materialize(own.select("doc_id", "h", "text", "runs", "least"), "repeat-joined")
    discard(hot)
    return found


def clustered(joined: DataFrame) -> DataFrame:
    """The same, dealt out so that texts that share much stand together."""
    # merging costs by the text and ranges are even by rows only, so they are made small
    parts = 2 * int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.repartitionByRange(parts, "least", "doc_id").sortWithinPartitions("least", "doc_id")
    return materialize(dealt.select("doc_id", "h", "text", "runs"), "repeat-candidates")


def spans(candidates: DataFrame, sizes: Sizes) -> DataFrame:
    """Byte ranges to remove: doc_id, h, start, stop."""
    tables = [materialize(candidates.mapInArrow(compare_texts(sizes), FOUND), "repeat-texts")]
    left = tables[0].where("batch IS NOT NULL")
    wanted = left.join(meeting(left), "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "met", "start", "stop")).alias("wanted"))
    pieces = candidates.select("doc_id", "h", "text").join(wanted, ["doc_id", "h"]).mapInArrow(cut_pieces, PIECE)
    level = 0
    while True:
        salt = F.pmod(F.xxhash64("doc_id", "h", "start"), F.ceil(F.col("met") / sizes.group))
        dealt = pieces.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key", "salt")
        tables.append(materialize(dealt.mapInArrow(compare_pieces(sizes), FOUND + ", piece binary"), "repeat-pieces"))
        left = tables[-1].where("batch IS NOT NULL")
        if left.isEmpty():
            break
        level = min(level + 1, len(GRAMS) - 1)
        anew = left.mapInArrow(longer(GRAMS[level]), "key long, doc_id long, h long, start int, batch long, piece binary")
        tables.append(materialize(anew, "repeat-anew"))
        pieces = tables[-1].join(meeting(tables[-1]), "key").select("key", "met", "doc_id", "h", "start", "piece")
    ranges = [t.where("batch IS NULL").select("doc_id", "h", "start", "stop") for t in tables if "stop" in t.columns]
    found = materialize(reduce(DataFrame.unionByName, ranges), "repeat-spans")
    for t in tables:
        discard(t)
    return found


def keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text, spans) to (doc_id, h, n_removed, n_spans, kept)."""
    for batch in batches:
        spans = batch["spans"]
        bounds = spans.offsets.to_numpy().astype(np.int64)
        starts, stops = (spans.values.field(c).to_numpy() for c in ("start", "stop"))
        for part in slices(batch["text"]):
            n, rows = len(part.data), slice(part.first, part.first + part.rows)
            own = slice(bounds[part.first], bounds[part.first + part.rows])
            base = part.offsets[np.repeat(np.arange(part.rows), np.diff(bounds[part.first : part.first + part.rows + 1]))]
            edges = np.bincount(base + starts[own], minlength=n + 1) - np.bincount(base + stops[own], minlength=n + 1)
            gone = np.cumsum(edges[:n]) > 0
            opens = gone.copy()  # a removed run opens where the byte before stays or is another text's
            opens[1:] &= ~gone[:-1]
            inner = part.offsets[:-1][part.offsets[:-1] < n]
            opens[inner] = gone[inner]
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])[part.offsets]
            removed = np.diff(upto(gone))
            left = part.offsets - upto(gone)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][rows.start : rows.stop], batch["h"][rows.start : rows.stop], pa.array(removed.astype(np.int64)), pa.array(np.diff(upto(opens)).astype(np.int64)), binary_column(part.data[~gone], left)],
                names=["doc_id", "h", "n_removed", "n_spans", "kept"],
            )


def dedup(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """Documents that lose bytes: doc_id, h (hash of the text), n_removed, n_spans and ``kept`` (the bytes left)."""
    texts = keyed(docs)
    copies = materialize(later_copies(texts), "repeat-copies")
    joined = candidates_of(texts, copies)
    drop_shuffles(docs.sparkSession)  # written tables stand between, so each step's shuffle files can go before the next one's come
    candidates = clustered(joined)
    discard(joined)
    drop_shuffles(docs.sparkSession)
    found = spans(candidates, sizes)
    own = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    rows = candidates.select("doc_id", "h", "text").join(own, ["doc_id", "h"]).select("doc_id", "h", "text", "spans")
    parts = rows.mapInArrow(keep_rest, "doc_id long, h long, n_removed long, n_spans long, kept binary")
    copies = copies.dropDuplicates(["doc_id", "h"])
    return parts.unionByName(copies.select("doc_id", "h", F.col("n_bytes").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lost = dedup(docs).select("doc_id", "h", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    base = keyed(docs).select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = base.join(lost, ["doc_id", "h"], "left")
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
    )
