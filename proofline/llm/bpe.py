"""Operator 1, byte-level BPE: overlapping chunk encoding, and decoding by concatenating raw bytes.

A text is cut into chunks that overlap. Every chunk is split into pre-tokens on its own, wherever its
executor is. A chunk may begin inside a pre-token, so its first boundaries can be wrong; the pattern never looks
back, so from the first place where a chunk agrees with its left neighbour's sure boundaries it is right too. There the chunks
are stitched. The text between two such places is a piece; pieces are encoded independently, and a document's ids are its
pieces' ids in order. The pattern looks ahead only behind white space, so a piece ends at a boundary behind any other character, and
every pre-token of it is split off and encoded as in the whole text.

If neighbours agree nowhere in their overlap (a pre-token, or white space, of more than the overlap), chunks are joined, twice as many each
time, and split again from the last sure boundary: exact for every text, and linear in its length.

All texts take this way. Chunks of a text that has one only are stitched in the task that read it; those of longer texts are
dealt out chunk by chunk and gathered again.

Defined results: a null text counts as empty and has no ids. Repeated rows each get their own, equal result. Rows
with a null doc_id are encoded like others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import documents, small_batches, text_or_empty

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: A contraction is decided by three characters, so a boundary is sure only if they were seen.
SEEN = 3
#: The last character up to which the libraries that split here and there agree on letters, digits and white space.
SETTLED = "\uffff"
#: White space of so many characters is split off here, as the library's own splitter would recurse over it.
LONG_SPACE = 50_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@cache
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def starts_of(text: str, pattern: str, last: bool) -> np.ndarray:
    """Where pre-tokens start; in a chunk that is not the last one, only as far as the text seen decides it."""
    found = [0] if text else []
    n = len(text)
    for m in splitter(pattern).finditer(text):
        if m.end() >= n or not last and m.start() + SEEN > n:
            break
        found.append(m.end())
    return np.array(found, np.int64)


def cut(size: int, overlap: int):
    """Rows (doc_id, text) to rows (doc_id, same, i, last, chunk); ``same`` tells equal doc_ids with other texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = hashlib.md5(text.encode()).hexdigest()
                n = max(1, -(-(len(text) - overlap) // size))
                for i in range(n):
                    end = len(text) if i == n - 1 else (i + 1) * size + overlap
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "same": [same], "i": pa.array([i], pa.int32()), "last": [i == n - 1], "chunk": [text[i * size : end]]})

    return run


def pretokenize(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["chunk"].to_pylist(), batch["last"].to_pylist(), strict=True)
            starts = [starts_of(chunk, pattern, last).astype(np.int32).tobytes() for chunk, last in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.binary())], names=[*batch.schema.names, "starts"])

    return run


def sure_cut(text: str, starts: np.ndarray, base: int) -> np.ndarray:
    """Those of the boundaries ``starts`` (places in the document; ``text`` begins at ``base``) where a piece can end.

    They stand behind no white space, and near no character whose class may depend on a library's Unicode version.
    """
    near = lambda p: text[max(0, p - base - SEEN - 1) : p - base + 1]
    return np.array([p for p in starts.tolist() if p > base and not text[p - base - 1].isspace() and max(near(p)) <= SETTLED], np.int64)


def pieces_of(chunks: list[tuple[str, bool, np.ndarray]], size: int, pattern: str) -> Iterator[str]:
    """Stitch the chunks of one text, in order, into pieces that end at pre-token boundaries behind no white space."""
    text, _, starts = chunks[0]
    base, starts = 0, starts.astype(np.int64)  # where ``text`` starts in the document, always at a piece's start; its sure boundaries
    i, n_joined = 1, 1
    while i < len(chunks):
        chunk, _, own = chunks[i]
        at = i * size
        own = own.astype(np.int64) + at
        common = np.intersect1d(starts[starts >= at], own, assume_unique=True)
        common = common[: np.searchsorted(common, base + len(text))]
        cut = sure_cut(text, common, base)
        if len(cut):
            place = int(cut[0])
            yield text[: place - base]
            text, base, starts, n_joined = chunk[place - at :], place, own[own >= place], 1
            i += 1
            continue
        ahead = chunks[i : i + n_joined]  # no agreement: split again over twice as many chunks
        for k, (more, last, _) in enumerate(ahead, i):
            text += more[base + len(text) - k * size :]
        i += len(ahead)
        n_joined *= 2
        starts = starts_of(text, pattern, last) + base
    if text:
        yield text


def values_of(column: pa.Array) -> list:
    """The values of a column; lists of numbers stay arrays, which take a tenth of the memory."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j].copy() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each (doc_id, same) from batches sorted by it, then by place; repeated documents come one by one."""
    key, rows = None, []
    for batch in batches:
        for doc_id, same, i, *rest in zip(*(values_of(batch[c]) for c in ["doc_id", "same", *columns]), strict=True):
            if (doc_id, same) != key:
                if rows:
                    yield key, rows
                key, rows = (doc_id, same), []
            rows.append((i, *rest))
    if rows:
        yield key, rows


def copies(rows: list[tuple]) -> Iterator[int]:
    """Equal documents have equal rows: how many there are is how often the first place occurs."""
    return range(sum(r[0] == rows[0][0] for r in rows))


def stitch(size: int, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc_id, same), rows in grouped(batches, ["i", "last", "chunk", "starts"]):
            one = {i: (chunk, last, np.frombuffer(starts, np.int32)) for i, last, chunk, starts in rows}
            pieces = list(pieces_of([one[i] for i in sorted(one)], size, pattern))
            for _ in copies(rows):
                for k, piece in enumerate(pieces):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "same": [same], "k": pa.array([k], pa.int32()), "piece": [piece]})

    return run


def ids_of(enc, text: str) -> np.ndarray:
    """The ids of a text, or of a piece of one."""
    out, place = [], 0
    if len(text) > LONG_SPACE:
        for m in splitter(r"\s{%d,}" % LONG_SPACE).finditer(text):
            inner = m.end() if m.end() == len(text) else m.end() - 1  # the last one goes with what follows it
            out += [enc.encode_to_numpy(text[place : m.start()], disallowed_special=()), np.array(enc._encode_single_piece(text[m.start() : inner].encode()))]
            place = inner
    out.append(enc.encode_to_numpy(text[place:], disallowed_special=()))
    return np.concatenate(out).astype(np.int32)


def ids_column(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(offsets, values)


def encode_column(path: str, pattern: str, column: str):
    """Replace a text column by ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            keep = [n for n in batch.schema.names if n != column]
            ids = ids_column([ids_of(enc, t) for t in batch[column].to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), ids], names=[*keep, "ids"])

    return run


def decoded_column(enc, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids, one after another."""
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return pa.array([enc.decode_bytes(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def coded(doc_ids: pa.Array, parts: list[np.ndarray], enc, decoded: bool) -> pa.RecordBatch:
    """doc_id, ids and, if asked for, the bytes that they decode to."""
    ids = ids_column(parts)
    more = {"decoded": decoded_column(enc, ids)} if decoded else {}
    return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "ids": ids} | more)


def gather(path: str, pattern: str, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for (doc_id, _), rows in grouped(batches, ["k", "ids"]):
            one = dict(rows)
            ids = np.concatenate([np.asarray(one[k], np.int32) for k in sorted(one)])
            for _ in copies(rows):
                yield coded(pa.array([doc_id], pa.int64()), [ids], enc, decoded)

    return run


def encode_local(path: str, pattern: str, decoded: bool = False):
    """(doc_id, text) of one chunk each to (doc_id, ids), and what they decode to if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            parts = []
            for text in batch["text"].to_pylist():
                # without a neighbour no boundary is asked for, so the only chunk is the only piece
                pieces = pieces_of([(text, True, np.zeros(0, np.int64))], max(1, len(text)), pattern)
                parts.append(np.concatenate([np.zeros(0, np.int32), *(ids_of(enc, p) for p in pieces)]))
            yield coded(batch["doc_id"], parts, enc, decoded)

    return run


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; ``chunk`` and ``overlap`` are in code points.

    With ``decoded`` the worker that has a document's ids decodes them as well, so no second one holds an encoder and the ids again.
    """
    path, split = default_ranks()
    path, split = ranks_path or path, pattern or split
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    result = "doc_id long, ids array<int>" + (", decoded binary" if decoded else "")
    one = F.length("text") <= chunk + overlap
    local = docs.where(one).mapInArrow(encode_local(path, split, decoded), result)
    key = "doc_id long, same string, "
    chunks = docs.where(~one).mapInArrow(cut(chunk, overlap), key + "i int, last boolean, chunk string")
    split_up = chunks.repartition("doc_id", "same", "i").mapInArrow(pretokenize(split), key + "i int, last boolean, chunk string, starts binary")
    in_order = split_up.repartition("doc_id", "same").sortWithinPartitions("doc_id", "same", "i")
    pieces = in_order.mapInArrow(stitch(chunk, split), key + "k int, piece string")
    encoded = pieces.repartition("doc_id", "same", "k").mapInArrow(encode_column(path, split, "piece"), key + "k int, ids array<int>")
    joined = encoded.repartition("doc_id", "same").sortWithinPartitions("doc_id", "same", "k").mapInArrow(gather(path, split, decoded), result)
    return local.unionByName(joined)


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``decoded``: the bytes of the ids, one after another. Null ids decode to no bytes."""
    path, split = default_ranks()
    path, split = ranks_path or path, pattern or split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, split)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded_column(enc, batch["ids"])], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", decoded binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
