"""Operator 12, cross-tokenizer alignment by segment deduplication.

Two tokenizers, A (byte-level BPE) and B (piece BPE with byte fallback), read the same bytes: a space and the text. Where a token of A and one of B end at the same
byte they are cut into groups; tokens of one group are linked.

1. Texts are split before runs of white space. Both vocabularies are checked on load: no token of A holds white space behind another character, and no piece
   of B holds the splitting character behind another one, so no merge reaches across a split; A's pre-tokeniser starts afresh there as well. A run that begins with a
   character that fails the check is no split.
2. A task packs its documents into blocks of bounded size: a list of different segments, and for each document the numbers of its segments in order.
3. The blocks' segments meet by what they are (a row per block and segment, however often it occurs); different ones are tokenised and aligned once.
4. A task packs what it has for a block into one compressed row, so alignments are joined back to their blocks in few rows. Documents are composed from them: their
   digests and numbers, and the pairs of ids that each holds. The documents of a pair are counted over the whole corpus; counts go back to the blocks that hold the pair.

Texts are never shuffled, only segments and blocks' numbers (compressed). No segment has more rows than there are blocks, and rows of equal segments stream through their task.

Defined results: a null or empty text, or one that a tokenizer does not give back byte by byte (B reads U+2581 as a space), has no tokens: zeros, and '' for its
groups. Each row is a document: rows with a null or repeated doc_id, and repeated rows, count and get a row each. Texts of white space alone are one segment. A text is
split at once, so a worker needs about 100 bytes for each of its words. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import discard, documents, materialize, small_batches, text_or_empty

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Bytes of text in a block.
BLOCK = 8 << 20
SPACE = "▁"
#: Characters before which a text may be split, if the vocabularies allow it; both tokenizers read them as white space.
SPLITTERS = " \n\t\r\x0b\x0c"
#: Different segments that are encoded in one call, and links of a group beyond which it is counted by different ids.
TOGETHER, CROWD = 2000, 1 << 16
#: Rows that a task aligns before it packs them.
HELD = 300_000
#: Segments of the documents whose pairs are summed at once.
PORTION = 1 << 15
#: Segments whose groups are read at once.
READ = 1 << 14
BLOCKS = "block long, doc_ids array<long>, sizes array<int>, numbers binary, segments array<string>"
ALIGNED = "block long, n int, places binary, size long, groups binary"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
LINKED = "block long, doc_ids array<long>, " + ", ".join(f"{c} array<long>" for c in NUMBERS) + ", digests array<string>, kinds array<int>, held binary, times binary, pairs array<long>, documents array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed."""
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their entries, and the pattern that splits texts into segments."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.space = pieces.index(SPACE)
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        with open(path_a, encoding="utf-8") as f:
            settings = json.load(f)
        own = settings["pre_tokenizer"] or {}
        if settings["normalizer"] or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex"):
            raise ValueError(f"{path_a}: not a plain byte-level tokenizer")
        if self.b.encode("a") != self.b.encode_as_ids("a") or b"".join(self.bytes_b[k] for k in self.b.encode(" a  b ")) != b"  a  b ":
            raise ValueError(f"{path_b}: changes white space")
        safe = "".join(c for c in SPLITTERS if self.apart(c, [vocabulary, pieces]))
        if " " not in safe:
            raise ValueError("the vocabularies merge across spaces")
        self.split = re.compile(rf"\s*\S+(?:(?![{safe}])\s+\S+)*(?:\s++\Z)?").findall
        self.plain, self.odd = re.compile(r"\s*\S+").findall, re.compile(rf"(?![{safe}])\s").search

    def apart(self, space: str, vocabularies: list) -> bool:
        """Whether no token holds ``space`` behind a character that is no white space, and B never behind its space mark (but for spaces themselves)."""
        a, b = vocabularies
        if any(re.search(rf"\S{re.escape(space)}", self.bytes_a[k].decode(errors="replace")) for k in a.values()):
            return False
        if space == " ":
            return not any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in b)
        return not any(space in p[1:] for p in b)

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text."""
        text = " " + text
        if self.odd(text):
            return self.split(text) or [text]
        found = self.plain(text)
        rest = len(text) - len(text.rstrip())
        return [*found[:-1], found[-1] + text[-rest:]] if rest and found else found or [text]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of a text as it stands behind others. B puts a space before every text: one that the text begins with is left to it, else its mark is removed."""
        a = self.a.encode(text, add_special_tokens=False).ids
        if text.startswith(" "):
            return a, self.b.encode(text[1:]) or [self.space]  # an empty text gets no mark
        b = self.b.encode(text)
        if b[0] != self.space:
            raise ValueError("a space mark was merged with a split")
        return a, b[1:]

    def equal(self, text: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join([self.bytes_a[k] for k in a]) == text and b"".join([self.bytes_b[k] for k in b]) == text

    def aligned(self, segments: list[str]) -> list[str | None]:
        """Every segment's groups as text; null where bytes differ. Segments are encoded in a row, as they would stand in a text, if all give their bytes back."""
        raw = [s.encode() for s in segments]
        a, b = self.encode("".join(segments))
        if not self.equal(b"".join(raw), a, b):
            if len(segments) == 1:
                return [None]
            half = len(segments) // 2
            return self.aligned(segments[:half]) + self.aligned(segments[half:])
        ends = [np.cumsum([own[k] for k in ids]) for own, ids in ((self.size_a, a), (self.size_b, b))]
        common = np.intersect1d(*ends)
        cuts = [[0, *np.searchsorted(e, common, "right").tolist()] for e in ends]
        words = [list(map(str, x)) for x in (a, b)]
        groups = [",".join(words[0][i:j]) + "|" + ",".join(words[1][k:m]) for i, j, k, m in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)]
        last = np.cumsum([len(r) for r in raw])
        upto = np.searchsorted(common, last, "right")
        if not np.array_equal(common[upto - 1], last):
            raise ValueError("a token reaches across a split")
        return [";".join(groups[i:j]) for i, j in zip([0, *upto.tolist()], upto.tolist(), strict=False)]


@cache
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return tuple(map(public_tokenizers.path, VOCABULARIES))


class Numbers(dict):
    """Numbers in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = len(self)
        return self[key]


def packer(paths: tuple[str, str], size: int = BLOCK):
    """(doc_id, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, k = pair(*paths).segments, TaskContext.get().partitionId(), 0
        numbers, ids, found, held = Numbers(), [], [], 0

        def block() -> pa.RecordBatch:
            sizes = [len(x) for x in found]
            row = {"block": pa.array([part << 32 | k], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "numbers": [packed(np.concatenate(found))], "segments": [list(numbers)]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                found.append(np.array(list(map(numbers.__getitem__, split(text))) if text else [], np.int32))
                held += len(text)
                if held >= size:
                    yield block()
                    numbers, ids, found, held, k = Numbers(), [], [], 0, k + 1
        if ids:
            yield block()

    return run


def aligner(paths: tuple[str, str]):
    """(segment, block, place), equal segments together, to packed rows of ALIGNED: a block's places and the groups there, one a line; an empty line where bytes differ."""

    def aligned(segments: list[str]) -> dict[str, str]:
        both = pair(*paths)
        # those that end in white space stand at the end of a text only
        alone = [s for s in segments if s[-1].isspace()]
        rest = [s for s in segments if not s[-1].isspace()]
        parts = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)] + [[s] for s in alone]
        return {s: g or "" for p in parts for s, g in zip(p, both.aligned(p), strict=True)}

    def blocks(held: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> Iterator[pa.RecordBatch]:
        block, place = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        texts = [t for h in held for t in h[2]]
        order = np.lexsort((place, block))
        cuts = [*np.flatnonzero(np.diff(block[order], prepend=-1)).tolist(), len(order)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = order[i:j]
            raw = "\n".join([texts[k] for k in own.tolist()]).encode()
            row = {"block": pa.array(block[own[:1]]), "n": pa.array([j - i], pa.int32()), "places": [packed(np.diff(place[own], prepend=0))], "size": pa.array([len(raw)], pa.int64())}
            yield pa.RecordBatch.from_pydict(row | {"groups": [pa.compress(raw, codec="zstd", asbytes=True)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            coded = batch["segment"].dictionary_encode()
            different = coded.dictionary.to_pylist()
            known = aligned(different)
            texts = [known[s] for s in different]
            held.append((batch["block"].to_numpy(), batch["place"].to_numpy().astype(np.int64), [texts[k] for k in coded.indices.to_numpy().tolist()]))
            rows += batch.num_rows
            if rows >= HELD:
                yield from blocks(held)
                held, rows = [], 0
        if held:
            yield from blocks(held)

    return run


class Groups:
    """The groups of a block's segments, read from their text into arrays; segments are taken in portions, so what stands beside the result is bounded."""

    def __init__(self, texts: list[str], portion: int = READ):
        n = len(texts)
        parts = [self.read(texts[k : k + portion]) for k in range(0, max(n, 1), portion)]
        self.known = np.array([t != "" for t in texts], bool)
        self.numbers = {c: np.concatenate([p[0][c] for p in parts]) for c in NUMBERS}
        self.pairs = np.unique(np.concatenate([p[1] for p in parts]))
        self.pair = np.concatenate([np.searchsorted(self.pairs, p[1]).astype(np.int32)[p[2]] for p in parts])
        self.times = np.concatenate([p[3] for p in parts])
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate([p[4] for p in parts]))])

    @staticmethod
    def read(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers by segment, different pairs, the pairs of each segment by their places among these, how often each is linked, how many each segment has)."""
        n = len(texts)
        per_segment = np.array([t.count(";") + 1 if t else 0 for t in texts], np.int64)
        codes = np.frombuffer(";".join([t for t in texts if t]).encode(), np.uint8)
        marks = np.flatnonzero((codes < ord("0")) | (codes > ord("9")))
        begin, end = np.concatenate([[0], marks + 1]), np.concatenate([marks, [len(codes)]])
        values = np.zeros(len(end), np.int64)
        for k in range(int((end - begin).max(initial=0))):
            here = end - 1 - k >= begin
            values[here] += (codes[end[here] - 1 - k].astype(np.int64) - ord("0")) * 10**k
        if not len(codes):
            begin, values = begin[:0], values[:0]
        before = np.concatenate([[0], codes[marks]])[: len(values)]
        group = np.cumsum(before == ord(";"))
        second = np.cumsum(before == ord("|")) > group
        groups = int(per_segment.sum())
        segment = np.repeat(np.arange(n), per_segment)
        ids, sides = (values[~second], values[second]), (group[~second], group[second])
        counts = [np.bincount(g, minlength=groups) for g in sides]
        products = counts[0] * counts[1]
        sums = lambda x: np.bincount(segment, x, n).astype(np.int64) if groups else np.zeros(n, np.int64)
        numbers = {"n_a": sums(counts[0]), "n_b": sums(counts[1]), "n_groups": per_segment, "n_links": sums(products)}
        # all links of small groups, and of large ones every pair of different ids with its number
        small = products <= CROWD
        own = small[sides[0]]
        reps = counts[1][sides[0][own]]
        heads = np.cumsum(counts[1]) - counts[1]
        at = np.repeat(heads[sides[0][own]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        found = [(segment[np.repeat(sides[0][own], reps)], np.repeat(ids[0][own], reps) << 32 | ids[1][at], np.ones(len(at), np.int64))]
        for g in np.flatnonzero(~small).tolist():
            (a, x), (b, y) = (np.unique(i[s == g], return_counts=True) for i, s in zip(ids, sides, strict=True))
            found.append((np.full(len(a) * len(b), segment[g]), (a[:, None] << 32 | b).ravel(), (x[:, None] * y).ravel()))
        where, pairs, times = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs, local = np.unique(pairs, return_inverse=True)
        width = max(len(pairs), 1)
        key, times = summed(where * width + local, times)
        return numbers, pairs, key % width, times, np.bincount(key // width, minlength=n)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def pairs_of(groups: Groups, numbers: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different pairs each document holds, these pairs document by document, and how often each is linked there. Documents are taken in portions of bounded length."""
    width, span, sizes = max(len(groups.bounds) - 1, 1), max(len(groups.pairs), 1), np.diff(groups.bounds)
    per, out, first = np.zeros(len(good), np.int64), [], 0
    while first < len(good):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PORTION, "right")) - 1)
        document = np.repeat(np.where(good[first:last], np.arange(last - first), -1), np.diff(bounds[first : last + 1]))
        some = document >= 0
        # the document's different segments, and how often they stand in it
        held, often = np.unique(document[some] * width + numbers[bounds[first] : bounds[last]][some], return_counts=True)
        segment = held % width
        n = sizes[segment]
        at = np.repeat(groups.bounds[segment] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, times = summed(np.repeat(held // width, n) * span + groups.pair[at], np.repeat(often, n) * groups.times[at])
        per[first:last] = np.bincount(key // span, minlength=last - first)
        out.append(((key % span).astype(np.int32), times.astype(np.uint32)))
        first = last
    own, times = (np.concatenate(x) for x in zip(*out, strict=True))
    return per, own, times


def linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their segments' groups to what is known of their documents but for the corpus's counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes = batch["doc_ids"][k].as_py(), batch["sizes"][k].values.to_numpy().astype(np.int64)
            numbers = unpacked(batch["numbers"][k].as_py(), int(sizes.sum()))
            rows = batch["rows"][k].as_py() or []
            texts = [""] * sum(r["n"] for r in rows)
            for r in rows:
                lines = pa.decompress(r["groups"], decompressed_size=r["size"], codec="zstd", asbytes=True).decode().split("\n")
                for place, line in zip(np.cumsum(unpacked(r["places"], r["n"])).tolist(), lines, strict=True):
                    texts[place] = line
            groups = Groups(texts)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            good = (sizes > 0) & (by_document(~groups.known[numbers], bounds) == 0)
            columns = {c: pa.array([np.where(good, by_document(groups.numbers[c][numbers], bounds), 0)], pa.list_(pa.int64())) for c in NUMBERS}
            digests = [hashlib.sha256(";".join([texts[n] for n in numbers[i:j].tolist()]).encode()).hexdigest() if g else "" for i, j, g in zip(bounds.tolist(), bounds[1:].tolist(), good.tolist(), strict=False)]
            per, own, times = pairs_of(groups, numbers, bounds, good)
            seen = np.bincount(own, minlength=len(groups.pairs))  # pairs that only texts without tokens hold go
            own = (np.cumsum(seen > 0) - 1)[own]
            row = {"block": batch["block"].slice(k, 1), "doc_ids": pa.array([ids], pa.list_(pa.int64()))} | columns | {"digests": [digests], "kinds": pa.array([per], pa.list_(pa.int32())), "held": [packed(np.diff(own.astype(np.int64), prepend=0) % (1 << 32))], "times": [packed(times)]}
            yield pa.RecordBatch.from_pydict(row | {"pairs": pa.array([groups.pairs[seen > 0]], pa.list_(pa.int64())), "documents": pa.array([seen[seen > 0]], pa.list_(pa.int64()))})


def composer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs to the results of their documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            kinds = batch["kinds"][k].values.to_numpy().astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(kinds)])
            own = np.cumsum(unpacked(batch["held"][k].as_py(), int(bounds[-1]))) % (1 << 32)
            times = unpacked(batch["times"][k].as_py(), int(bounds[-1]))
            told = batch["told"][k].values
            order = np.argsort(told.field("place").to_numpy()) if told is not None else []
            n, best = (told.field(c).to_numpy()[order] if told is not None else np.zeros(0, np.int64) for c in ("n", "best"))
            columns = {"doc_id": batch["doc_ids"][k].values} | {c: batch[c][k].values for c in NUMBERS}
            columns |= {"n_best": by_document(times * best[own], bounds), "count_sum": by_document(times * n[own], bounds), "groups_sha256": batch["digests"][k].values}
            yield pa.RecordBatch.from_pydict(columns)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = BLOCK) -> DataFrame:
    """The alignment of every row of ``docs``."""
    paths = paths or default_paths()
    pair(*paths)  # tokenizers that can't be split are refused before any task runs
    small_batches(docs.sparkSession, 20_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    blocks = materialize(rows.mapInArrow(packer(paths, size), BLOCKS), "align-blocks")
    segments = blocks.select("block", F.posexplode("segments").alias("place", "segment"))
    met = segments.select("segment", "block", "place").repartition("segment").sortWithinPartitions("segment")
    own = met.mapInArrow(aligner(paths), ALIGNED).groupBy("block").agg(F.collect_list(F.struct("n", "places", "size", "groups")).alias("rows"))
    known = blocks.select("block", "doc_ids", "sizes", "numbers").join(own, "block", "left")
    linked = materialize(known.mapInArrow(linker, LINKED), "align-linked")
    discard(blocks)

    held = linked.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))
    counts = held.groupBy("pair").agg(F.sum("documents").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = materialize(counts, "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    valued = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    told = held.join(valued, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))
    whole = linked.drop("pairs", "documents").join(told, "block", "left")
    found = materialize(whole.mapInArrow(composer, RESULT), "align-found")
    discard(linked)
    discard(counts)
    return found


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
