"""Operator 7, substring dedup: passages that repeat across documents, by paragraph MinHash banding.

Two kinds of paragraph are compared; both carry their byte range in the text.

* Lines of ``MIN_WORDS`` words or more. Their five-word shingles go through MinHash banding, tuned for high recall; lines that
  collide are verified by exact Jaccard similarity, and linked lines are clustered by connected components.
* Segments of the whole text, short lines included, for passages inside other text. The sequence of words is cut, whatever lines they stand
  on, where a word pair's hash is the least within ``RADIUS`` words; equal hashes are all cut at, which cuts repetitive stretches once a
  period. The cuts depend on nearby words only, so a passage is cut alike wherever it stands and however its lines are broken.
  A segment has so few shingles that similar means equal: segments collide on 128-bit digests, which is their exact check, and
  consecutive repeated segments count if they make up ``MIN_WORDS`` words. The words between a passage's edge and its first or last cut stay.

Of each cluster the first paragraph (smallest doc_id, then place) stays and the others are removed.

Defined results: a null or empty text has no paragraphs. Repeated rows (equal doc_id and text) count as one document. Rows with a null
doc_id come first in order like any other id. Extra columns are kept by ``remove`` and ignored elsewhere; an empty table has no repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.graph import components
from proofline.llm.minhash import band_hashes, bands_for
from proofline.llm.ngram_join import digest_of, distinct_sets, near_links
from proofline.llm.shared import discard, documents, materialize, nested, small_batches, text_or_empty
from proofline.llm.wordhash import U64, Slice, Words, _powers_of, mix, row_shingles, slices

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 3
MIN_WORDS = 20
RADIUS = 4
KEY = "struct<doc_id:bigint,h:bigint,start:int>"


class Lines:
    """The lines of a slice that have enough words: first word, word after the last, row, and byte range."""

    def __init__(self, part: Slice, words: Words, least: int):
        breaks = np.flatnonzero(part.data == 10)
        row = np.repeat(np.arange(part.rows), np.diff(words.bounds))
        number = np.searchsorted(breaks, words.start) + row  # differs between lines, also at the edges of rows
        first = np.flatnonzero(np.diff(number, prepend=-1))
        last = np.append(first[1:], len(number)).astype(np.int64)
        long = last - first >= least
        self.first, self.last = first[long], last[long]
        self.row = row[self.first]
        before = np.searchsorted(breaks, words.start[self.first])
        left = np.append(0, breaks + 1)[before]
        right = np.append(breaks, len(part.data))[np.searchsorted(breaks, words.start[self.last - 1])]
        self.left = np.maximum(left, part.offsets[self.row])
        self.right = np.minimum(right, part.offsets[self.row + 1])


def rows_of(batch: pa.RecordBatch, least: int) -> Iterator[tuple[pa.RecordBatch, Slice, Words, Lines]]:
    for part in slices(batch["text"]):
        words = Words(part)
        yield batch.slice(part.first, part.rows), part, words, Lines(part, words, least)


def key_column(rows: pa.RecordBatch, row: np.ndarray, start: np.ndarray) -> pa.Array:
    at = pa.array(row)
    return pa.StructArray.from_arrays([rows["doc_id"].take(at), rows["h"].take(at), pa.array(start.astype(np.int32))], names=["doc_id", "h", "start"])


def sign_lines(bands: int, rows: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part, words, lines in rows_of(batch, least):
                inside = np.concatenate([np.arange(a, b) for a, b in zip(lines.first, lines.last, strict=True)]) if len(lines.first) else np.zeros(0, np.int64)
                counts = SimpleNamespace(hash=words.hash[inside], bounds=np.concatenate([[0], np.cumsum(lines.last - lines.first)]))
                values, bounds = distinct_sets(*row_shingles(counts, SHINGLE))
                raw, n = values.tobytes(), len(bounds) - 1
                digests = [digest_of(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), band_hashes(values, bounds, bands, rows).astype(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        key_column(own, lines.row, lines.left - part.offsets[lines.row]),
                        pa.array((lines.right - lines.left).astype(np.int32)),
                        pa.array((lines.last - lines.first).astype(np.int32)),
                        pa.array(digests, pa.binary()),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        lists,
                    ],
                    names=["key", "n_bytes", "n_words", "digest", "size", "bands"],
                )

    return run


def line_texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part, _, lines in rows_of(batch, least):
                raw = part.data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(lines.left, lines.right, strict=True)]
                yield pa.RecordBatch.from_arrays([key_column(own, lines.row, lines.left - part.offsets[lines.row]), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def low_pairs(pair: np.ndarray, radius: int) -> np.ndarray:
    """Whether no pair within ``radius`` words is less. Equal ones all count, so repetitive stretches are cut once a period."""
    low = np.ones(len(pair), bool)
    for d in range(1, radius + 1):
        low[d:] &= pair[d:] <= pair[:-d]
        low[:-d] &= pair[:-d] <= pair[d:]
    return low


def cuts(words: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> np.ndarray:
    """Word places, in order, where a text starts or a word pair's hash is the least within ``radius`` words.

    Stretches of more than ``4 * radius`` words without such a place are also cut where a pair is the least within half the radius.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        pair = mix(words * U64(0x9E3779B97F4A7C15) + np.append(words[1:], U64(0)))
    inside = np.zeros(n + 1, np.int32)  # words too near to a text's edge, or outside the texts, are no cuts
    np.add.at(inside, first + radius, 1)
    np.add.at(inside, last - radius - 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    cut = low_pairs(pair, radius) & inside
    cut[first] = True
    at = np.flatnonzero(cut)
    wide = np.append(at[1:], n) - at > 4 * radius
    here = np.cumsum(cut) - 1
    cut |= low_pairs(pair, radius // 2) & inside & wide[np.maximum(here, 0)] & (here >= 0)
    return np.flatnonzero(cut)


def segments(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"]):
                own, words = batch.slice(part.first, part.rows), Words(part)
                rows = np.flatnonzero(np.diff(words.bounds) >= least)
                if not len(rows):
                    continue
                first, last = words.bounds[rows].astype(np.int64), words.bounds[rows + 1].astype(np.int64)
                begin = cuts(words.hash, first, last, RADIUS)
                text = np.searchsorted(first, begin, "right") - 1
                row = rows[text]
                closes = np.append(text[1:] != text[:-1], True)
                end = np.where(closes, last[text], np.append(begin[1:], 0))
                breaks = np.flatnonzero(part.data == 10)
                line_left, line_right = np.append(0, breaks + 1), np.append(breaks, len(part.data))
                line = np.searchsorted(breaks, words.start)
                opens_line = (begin == first[text]) | (line[begin] != line[begin - 1])  # what stands before a line's first word, or behind its last, goes with it
                left = np.where(opens_line, np.maximum(line_left[line[begin]], part.offsets[row]), words.start[begin])
                closes_line = closes | (line[np.minimum(end, len(line) - 1)] != line[end - 1])
                right = np.where(closes_line, np.minimum(line_right[line[end - 1]], part.offsets[row + 1]), words.start[np.minimum(end, len(line) - 1)])
                up, down = _powers_of(len(words.hash) + 1)
                digests = []
                with np.errstate(over="ignore"):
                    for salt in (U64(0), U64(0xA0761D6478BD642F)):
                        total = np.append(U64(0), np.cumsum(mix(words.hash ^ salt) * up[: len(words.hash)]))
                        digests.append(mix((total[end] - total[begin]) * down[begin]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(d) for d in digests),
                        key_column(own, row, left - part.offsets[row]),
                        pa.array((right - left).astype(np.int32)),
                        pa.array((begin - first[text]).astype(np.int32)),
                        pa.array((end - begin).astype(np.int32)),
                    ],
                    names=["d1", "d2", "key", "n_bytes", "word", "n_words"],
                )

    return run


def hashed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")


RESULT = ["doc_id", "h", "start", "n_bytes", "n_words", "kind", "first_doc_id", "first_start", "removed"]


def result(members: DataFrame, kind: str) -> DataFrame:
    return members.select(
        "key.doc_id", "key.h", "key.start", "n_bytes", "n_words", F.lit(kind).alias("kind"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), (~F.col("key").eqNullSafe(F.col("first"))).alias("removed")
    )


def repeated_lines(texts: DataFrame, least: int = MIN_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    bands = bands_for(threshold, recall, rows)
    signed = texts.mapInArrow(sign_lines(bands, rows, least), f"key {KEY}, n_bytes int, n_words int, digest binary, size int, bands array<long>").where("size > 0")
    same = signed.groupBy("digest").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.count("*").alias("members"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = materialize(same.withColumn("id", F.monotonically_increasing_id()), "line-reps")
    _, edges = near_links(reps, texts.mapInArrow(line_texts(least), f"key {KEY}, text string"), SHINGLE, threshold, "line")
    roots = components(edges, "line-roots")
    found = materialize(reps.select("digest", "key", "last", "id").join(roots, "id", "left").where("root IS NOT NULL OR key <> last"), "line-found")
    found = found.withColumn("root", F.coalesce("root", "id"))
    clusters = found.groupBy("root").agg(F.min("key").alias("first"))
    named = materialize(found.join(clusters, "root").select("digest", "first"), "line-clusters")
    discard(reps)
    places = texts.mapInArrow(sign_lines(1, 1, least), f"key {KEY}, n_bytes int, n_words int, digest binary, size int, bands array<long>")
    return result(places.select("key", "n_bytes", "n_words", "digest").join(named, "digest").distinct(), "line")


def repeated_segments(texts: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    found = texts.mapInArrow(segments(least), f"d1 long, d2 long, key {KEY}, n_bytes int, word int, n_words int")
    seen = found.groupBy("d1", "d2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("d1", "d2", "first")
    seen = materialize(seen, "segment-seen")
    matches = materialize(found.join(seen, ["d1", "d2"]).drop("d1", "d2"), "segment-matches").distinct()
    text = Window.partitionBy("key.doc_id", "key.h").orderBy("word")
    fresh = F.coalesce((F.lag(F.col("word") + F.col("n_words")).over(text) != F.col("word")).cast("int"), F.lit(1))
    matches = matches.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(text))
    run = Window.partitionBy("key.doc_id", "key.h", "run")
    matches = matches.withColumn("long", F.sum("n_words").over(run)).where(F.col("long") >= least)
    return result(matches, "segment")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every paragraph of a cluster of two or more: its place, its cluster's first paragraph, and whether it is to be removed.

    ``min_words`` is the least length of a paragraph. Repeated lines and stretches of fewer words are left alone on purpose, as they are
    mostly phrases of the language; 1 compares every line and every segment.
    """
    texts = hashed(docs)
    return repeated_lines(texts, min_words).unionByName(repeated_segments(texts, min_words))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text by what is left without its ``spans`` (byte ranges, in order, over any number of lines); lines left blank go too."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            if spans:
                raw, place, kept = text.encode(), 0, []
                for span in spans:
                    kept.append(raw[place : max(place, span["start"])])
                    after = max(place, span["start"] + span["n_bytes"])
                    kept.append(b"\n" * raw.count(b"\n", max(place, span["start"]), after))  # lines stay apart, and are matched with the old ones below
                    place = after
                before, after = text.split("\n"), (b"".join(kept) + raw[place:]).decode().split("\n")
                text = "\n".join(a.strip() if a != b else a for a, b in zip(after, before, strict=True) if a.strip() or not b.strip())
            texts.append(text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["spans"])


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the removed paragraphs; documents that lose all their words go. Same columns as ``docs``.

    ``n_chars``, if it is a column, is counted again where text was removed.
    """
    gone = found.where("removed").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "n_bytes"))).alias("spans"))
    keyed = nested(docs, F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_or_empty()).alias("own_h"))
    joined = keyed.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")), "left").select("row", "spans")
    text = F.col("row.text").alias("text")
    row = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema.fields) + ">"
    cleaned = joined.where("spans IS NOT NULL").select("row", text, "spans").mapInArrow(cut_out, f"row {row}, text string").where(F.col("text").rlike(r"\S"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    cleaned = cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return joined.where("spans IS NULL").select("row.*").unionByName(cleaned)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).select("doc_id", "start", "n_bytes", "n_words", "kind", "first_doc_id", "first_start", "removed")
