"""Operator 4, token-ID output: length-delimited binary records with masked checksums and an index of offsets.

Documents are dealt out by ranges of doc_id and sorted, so file order is document order. Every task encodes
its range and writes two files into the shared folder, first under a name of its own, then renamed: a task that
runs twice, or again after an executor was lost, leaves the same files.

``part-NNNNN.rec`` holds records one after another, numbers little-endian::

    length of data (u64) | masked CRC-32 of those 8 bytes (u32) | data | masked CRC-32 of data (u32)

Data is doc_id (i64; the smallest one stands for null), the width of an id in bytes (u8) and the ids (the end id last). The mask is a
rotation by 15 bits plus a constant, so checksums of data that hold checksums stay apart.
``part-NNNNN.idx`` holds for each record its offset, its doc_id and its first token's place in the file (three 64-bit
numbers), so a shuffled reader fetches any record with one seek.

Words of a text are encoded by the tokenizers library, each different word once per worker: this tokenizer's normaliser and
pre-tokeniser treat text between white space independently. Tokenizer files without that trait are refused by a test on load.

Defined results: a null text is empty and has the end id alone. Rows with a null doc_id come first. Repeated rows are separate records
next to each other. An empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import documents, new_path, small_batches, text_or_empty

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
#: Different words that a worker keeps at most before it starts afresh.
CACHE_WORDS = 600_000
#: The last character up to which the pattern below and the library's own agree on what a letter is.
LATIN = "\u024f"
# Fixed value: the pattern of this vocabulary's pre-tokeniser.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
READ_BYTES = 4 << 20
#: Separators for str.split that are no white space to the tokenizer.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
PARTS = "part int, n_docs long, n_tokens long"
RECORD = "doc_id long, part int, place long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframe(record: bytes) -> bytes:
    """The data of a whole record; ValueError if a length or a checksum doesn't match."""
    length, crc = struct.unpack_from("<QI", record)
    data = record[12 : 12 + length]
    if crc != masked(record[:8]) or len(record) != length + 16 or masked(data) != struct.unpack_from("<I", record, 12 + length)[0]:
        raise ValueError("damaged record")
    return data


class ByteLetters(dict):
    """Code point to the letters that the library writes for its bytes."""

    def __init__(self, letters):
        self.letters = letters

    def __missing__(self, code: int) -> str:
        self[code] = self.letters(chr(code))[0][0]
        return self[code]


class WordEncoder:
    """Texts to ids (as little-endian numbers of ``width`` bytes), by way of their white-space separated words.

    A word of Latin letters that is new goes piece by piece to the library's model, with the library's own byte letters; any
    other word, and any text with control strings or in another normal form, goes to the library as it is.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")
        self.pieces = regex.compile(SPLIT).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.mapped = ByteLetters(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str)
        self.known: dict[str, bytes] = {}
        probe = "Don't STOP  1234 (Été) #é\n\tx. ..a'ß"
        words = [self.word(w) for w in probe.lower().split()]
        if self.plain(probe) != b"".join(words) or words != [self.plain(w) for w in probe.split()]:
            raise ValueError(f"{path}: words between white space are not encoded independently")

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def plain(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        return self.packed([t.id for t in self.tokenize(piece if piece.isascii() else piece.translate(self.mapped))])

    def word(self, word: str) -> bytes:
        if max(word) > LATIN:
            return self.plain(word)
        if word.isalpha():
            return self.piece(word)
        core, mark = word[:-1], word[-1]
        if core.isalpha() and not mark.isalnum():  # a word and a punctuation mark
            for part in (core, mark):
                if part not in self.known:
                    self.known[part] = self.piece(part)
            return self.known[core] + self.known[mark]
        return b"".join(map(self.piece, self.pieces(word)))

    def __call__(self, text: str) -> bytes:
        if "<|" in text or "Σ" in text or any(c in text for c in NOT_SPACE) or not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return self.plain(text)
        words = text.lower().split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            return b"".join([known[w] for w in words])


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_system(uri: str):
    """The file system of a shared folder, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def part_name(part: int) -> str:
    return f"part-{part:05d}"


def writer(folder: str, path: str, end_id: int):
    """(doc_id, text) in order to files; gives one row per file: part, n_docs, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), word_encoder(path)
        end, width = encode.packed([end_id]), encode.width
        part, attempt = context.partitionId(), context.taskAttemptId()
        files, root = file_system(folder)
        target = f"{root}/{part_name(part)}"
        index, offset, tokens = [], 0, 0
        with files.open_output_stream(f"{target}.rec.{attempt}") as out:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    doc_id = NULL_ID if doc_id is None else doc_id
                    ids = encode(text) + end
                    record = frame(struct.pack("<qB", doc_id, width) + ids)
                    index.append((offset, doc_id, tokens))
                    out.write(record)
                    offset += len(record)
                    tokens += len(ids) // width
        with files.open_output_stream(f"{target}.idx.{attempt}") as out:
            out.write(np.array(index, "<i8").tobytes())
        for kind in ("rec", "idx"):
            files.move(f"{target}.{kind}.{attempt}", f"{target}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(index)], "n_tokens": [tokens]})

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents to ``folder``; gives the manifest: part, n_docs, n_tokens and ``start`` (tokens in the parts before).

    The manifest has one row per file, so its sums are formed on the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(in_order.mapInArrow(writer(folder, path, end_id), PARTS).collect())
    starts = np.cumsum([0, *(r["n_tokens"] for r in parts)]).tolist()
    manifest = [(r["part"], r["n_docs"], r["n_tokens"], start) for r, start in zip(parts, starts, strict=False) if r["n_docs"]]
    return spark.createDataFrame(manifest, PARTS + ", start long")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of a folder, checked; ``start`` counts the tokens of all records before, ``ids`` are unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for batch in batches:
            for part, base in zip(batch["part"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{part_name(part)}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with files.open_input_file(f"{root}/{part_name(part)}.rec") as f:
                    ends = np.append(index[1:, 0], f.size())
                    k = 0
                    while k < len(index):
                        stop = max(k + 1, int(np.searchsorted(ends, index[k, 0] + READ_BYTES, "right")))
                        begin = int(index[k, 0])
                        f.seek(begin)
                        block = f.read(int(ends[stop - 1]) - begin)
                        data = [unframe(block[a - begin : b - begin]) for a, b in zip(index[k:stop, 0].tolist(), ends[k:stop].tolist(), strict=True)]
                        ids = [np.frombuffer(d, f"<u{d[8]}", offset=9).astype("<u4").tobytes() for d in data]
                        doc_ids = [struct.unpack_from("<q", d)[0] for d in data]
                        if doc_ids != index[k:stop, 1].tolist():
                            raise ValueError("the index doesn't match its records")
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([None if d == NULL_ID else d for d in doc_ids], pa.int64()),
                            "part": pa.array([part] * len(ids), pa.int32()),
                            "place": pa.array(range(k, stop), pa.int64()),
                            "start": pa.array((index[k:stop, 2] + base).tolist(), pa.int64()),
                            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                            "ids": pa.array(ids, pa.binary()),
                        })
                        k = stop

    return manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, RECORD)


def fetch(folder: str, part: int, place: int) -> tuple[int | None, np.ndarray]:
    """One record by its place, read with one seek into the index and one into the file."""
    files, root = file_system(folder)
    with files.open_input_file(f"{root}/{part_name(part)}.idx") as f:
        n = f.size() // 24
        f.seek(24 * place)
        entry = np.frombuffer(f.read(48), "<i8")
    with files.open_input_file(f"{root}/{part_name(part)}.rec") as f:
        end = int(entry[3]) if place + 1 < n else f.size()
        f.seek(int(entry[0]))
        data = unframe(f.read(end - int(entry[0])))
    doc_id = struct.unpack_from("<q", data)[0]
    return None if doc_id == NULL_ID else doc_id, np.frombuffer(data, f"<u{data[8]}", offset=9).astype("<u4")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "records")
    manifest = write(documents(spark, sf_dir), folder, public_tokenizers.path(VOCABULARY))
    return read(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
