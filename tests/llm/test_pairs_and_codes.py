"""SimHash, alignment and vector codes against plain versions that look at everything."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF

from proofline.llm import alignment, simhash, vector_codes

WORDS = [a + b for a in "ka lo mi nu pe ra si to vu".split() for b in "ba ce di fo gu".split()]


def table(spark, texts):
    """Texts with ids 1, 2, ...; pairs give their own id."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, key string")


# ---- operator 11


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found)) if found else 0


def plain_components(fps):
    """Smallest index that each fingerprint reaches."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    roots = plain_components(fps)
    want = {(r["doc_id"], f"{f:016x}", rows[x]["doc_id"]) for r, f, x in zip(rows, fps, roots, strict=True)}
    assert {tuple(r) for r in simhash.near(docs).collect()} == want
    assert len(set(roots)) < len(set(fps))


def test_simhash_odd_rows(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices(WORDS, k=700_000))  # several portions
    texts = [None, "", " \t\n", "Ab", "ab", "ÀB c", "àb c", "one two three", "one two  three four\x0bfive", (None, "ab"), (None, None), (4, "zz zz zz zz zz"), (4, "zz zz zz zz zz"), long]
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts, 1)]
    got = sorted(simhash.near(table(spark, texts)).collect(), key=str)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{plain_fingerprint(t):016x}") for d, t in rows)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["fingerprint"] != "0" * 16] == [4]
    assert simhash.near(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [3, 10_000])
def test_links_of_dense_fingerprints(spark, limit):
    """Groups whose members differ by few bits anywhere, chains, and strangers; small and crowded keys give the same components."""
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):
            fps.add(at)
            for bit in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                at ^= 1 << bit
    fps = sorted(fps)
    roots = plain_components(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, limit).collect()]
    place = {f: k for k, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(label)
        for a, b in edges:
            low = min(label[place[a]], label[place[b]])
            label[place[a]] = label[place[b]] = low
        if label == before:
            break
    assert label == roots
    assert 20 < len(set(roots)) < len(fps)


def test_chain_budgets():
    """Of all pairs within the distance, each has a start from which every chain keeps its budget; the last budget is the distance."""
    masks = simhash.chain_masks().tolist()
    assert [m[-1] for m in masks] == [(1 << 64) - 1] * 5
    rng = random.Random(5)
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(all((x & m).bit_count() <= 4 * (k + 1) // 5 for k, m in enumerate(chain)) for chain in masks)


# ---- operator 12


def plain_alignment(texts, paths):
    """Every text encoded as a whole, all pairs of occurrences counted."""
    both = alignment.pair(*paths)
    docs = []
    for text in texts:
        groups = []
        if text:
            a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            x, y = [both.bytes_a[k] for k in a], [both.bytes_b[k] for k in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends = set(np.cumsum([len(t) for t in x]).tolist()) & set(np.cumsum([len(t) for t in y]).tolist())
                for side, tokens, ids in ((0, x, a), (1, y, b)):
                    place, k = 0, 0
                    for t, i in zip(tokens, ids, strict=True):
                        if k == len(groups):
                            groups.append(([], []))
                        groups[k][side].append(i)
                        place += len(t)
                        k += place in ends
        docs.append(groups)
    held = Counter(p for groups in docs for p in {(i, j) for x, y in groups for i in x for j in y})
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "\n\na\n", "x\ty\r\nz", "\r\rq \r", "don't we'll  I'm", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ mark", "naïve café ß Σ", "漢字 かな　全角 space", "a b   c d e",
    "\x00 \x1f\x1c x\x0b\x0cy", "🙂🙃  🙂", "á e ́ x", "==== ----  ....", "=" * 500 + " " * 40 + "-" * 300, "tab\t\t tab \t", "1234567 12 3", "a" * 3000, "e​ ​e", "﻿ bom", "end  ", "end \n", ("x " * 40 + "\n") * 20,
]


def random_texts(n):
    rng = random.Random(11)
    alphabet = ["a", "b", " ", " ", "  ", "\n", "\t", "\r", "é", "漢", "'s", "1", ".", " ", "the", " of", "　", "_", "-", "\x85", "z"]
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("size", [200, alignment.BLOCK])
def test_alignment_equals_whole_texts(spark, size):
    texts = [*ODD, *random_texts(400), *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    paths = alignment.default_paths()
    want = Counter(zip(range(1, len(texts) + 1), plain_alignment(texts, paths), strict=True))
    got = Counter((r[0], tuple(r)[1:]) for r in alignment.align(table(spark, texts), paths, size).collect())
    assert got == want


def test_alignment_of_repeated_and_missing_ids(spark):
    texts = [(None, "some text"), (None, "some text"), (3, "some text"), (3, "other"), (3, None)]
    got = alignment.align(table(spark, texts)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "3", "None", "None"]
    assert {r["count_sum"] for r in got if r["n_a"] == 2} == {6}
    assert alignment.align(table(spark, texts).limit(0)).count() == 0


def test_segments_join_to_the_text():
    both = alignment.pair(*alignment.default_paths())
    for text in [t for t in ODD if t] + random_texts(300):
        assert "".join(both.segments(text)) == " " + text
    assert both.segments("one two\nthree  four ") == [" one", " two", "\nthree", "  four "]


# ---- operator 13


def plain_codes(rows, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: r[0])
    x = np.array([[int(np.floor(1024 * float(v))) for v in r[1]] for r in kept], np.int64)
    parts = np.split(x, 4, axis=1)
    books, chosen, errors = [], [], 0
    for p in parts:
        book = p[:entries].copy()
        for k in range(rounds + 1):
            d = ((p[:, None, :] - book[None]) ** 2).sum(axis=2)
            best = d.argmin(axis=1)
            if k < rounds:
                for e in range(len(book)):
                    if (best == e).any():
                        book[e] = p[best == e].sum(axis=0) // (best == e).sum()
        books.append(book)
        chosen.append(best)
        errors = errors + d.min(axis=1)
    by_label = Counter()
    for r, e in zip(kept, errors.tolist(), strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return {(r[0], "".join(f"{c[k]:02x}" for c in chosen), int(errors[k]), by_label[r[2]], digest) for k, r in enumerate(kept)}


def test_codes_equal_brute_force(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    assert {tuple(r) for r in vector_codes.codes(vectors).collect()} == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rng = random.Random(7)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(120)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [nan] * 8, 1), (203, [inf] + [0.0] * 7, None), (204, [-3.5] * 8, None)]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "vec_id long, embedding array<float>, label int, x string, entry int")
    for entries in (5, 256):
        assert {tuple(r) for r in vector_codes.codes(df, entries=entries).collect()} == plain_codes(rows, entries)
    more = df.union(spark.createDataFrame([(None, [9.0] * 8, 1, "", 1), (300, [1.0] * 4, 1, "", 1), (301, [], 1, "", 1), (5, rows[5][1], 1, "", 1)], df.schema))
    got = vector_codes.codes(more).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted([*map(str, range(120)), "204", "None", "5"])
    assert vector_codes.codes(df.limit(0)).count() == 0 and vector_codes.codes(df.where("vec_id BETWEEN 200 AND 203")).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 1e30, -1e30], 1), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["error"]) for r in vector_codes.codes(odd).collect()} == {(1, 0), (2, 0)}  # each vector is an entry


def test_bounds_hold_and_prune():
    """No entry's distance leaves its bounds, and few entries are left to refine."""
    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-400, 400, (256, 16)), rng.integers(-400, 400, (500, 16))
    near = vector_codes.Approximation(entries)
    lower, upper = near.bounds(queries)
    d = ((queries[:, None] - entries) ** 2).sum(axis=2)
    assert (lower <= d).all() and (d <= upper).all()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.5
    chosen, best = near.nearest(queries)
    assert (chosen == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
