"""The numbered operators against brute-force versions on small fixtures, with nulls, empty and repeated rows, and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import connect, difference
from conftest import SF

from proofline.llm import bpe, chat, decontaminate, graph, license, ngram_join, passages, quality, queries, records, repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, h string, score string"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu lé mi no".split() for b in "ra se ti vo nu xy".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 30, 80, 200])) for _ in range(30)]
    passage = prose(rng, 60).replace("\n", " ")
    texts += [texts[3], texts[3], texts[5].replace("ba", "BA", 1), texts[7] + " " + texts[8]]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(3)]
    near = prose(rng, 120).split(" ")
    for k in range(40):  # one group of near copies that is larger than a small bucket
        copy = list(near)
        copy[(k * 7) % 120] = f"ny{k}"
        texts.append(" ".join(copy))
    return [*texts, None, "", " \n ", "a" * 5000, "ab " * 2000, "É́ ǅ 𝒳 \x1c zß 'S 12"]


def test_every_query_has_a_number_and_runs(spark):
    for name, query in queries.queries().items():
        assert re.match(r"op\d+_", name)
        assert query(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


def test_empty_tables(spark):
    none = table(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert decontaminate.find(none, benchmark).count() == 0
    assert toxicity.train(none, labels).score(none).count() == 0
    assert repeats.dedup(none).count() == passages.repeats(none).count() == ngram_join.classes(none).count() == 0
    assert quality.score(none).count() == license.scan(none).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bpe(spark, corpus):
    import tiktoken

    path, pattern = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus, "x " * 300 + "y" * 400 + " " * 50 + "z'll we're " * 40]
    docs = table(spark, [*texts, texts[0]], [*range(len(texts)), 0])
    want = sorted((i, reference.encode_ordinary(t or "")) for i, t in [*enumerate(texts), (0, texts[0])])
    for chunk, overlap in ((64, 16), (50, 4), (1 << 15, 1 << 10)):
        rows = bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
        assert sorted((r["doc_id"], list(r["ids"])) for r in rows) == want
        assert all(bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode() for r in rows)


def test_decontaminate(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in WORDS for b in WORDS for c in "aeiou"]
    common = words[:60]

    def text(n):
        return " ".join(rng.choice(common if rng.random() < 0.5 else words) for _ in range(n))

    items = [(k, text(rng.choice([15, 30, 55])) + ".") for k in range(40)] + [(90, "too short"), (91, None), (92, "")]
    docs, planted = [], set()
    for d in range(300):
        body = text(rng.choice([20, 200, 600]))
        if d % 10 == 0:
            k = d // 10
            leak = items[k][1].split()
            if d % 20 == 0:  # a paraphrase: words left out and put in
                leak = [w for j, w in enumerate(leak) if j % 8 != 3]
                leak.insert(len(leak) // 2, rng.choice(words))
            body = f"{body} {' '.join(leak).upper() if d % 30 == 0 else ' '.join(leak)} {text(100)}"
            planted.add((d, k))
        docs.append(body)
    found = decontaminate.find(table(spark, [*docs, None, ""]), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == planted
    blocks = decontaminate.find(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_items=15)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == planted


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        masks = {}
        for k, y in enumerate(b):
            masks[y] = masks.get(y, 0) | 1 << k
        assert decontaminate.common_subsequence(a, masks, len(b)) == rows[-1][-1]


def test_toxicity(spark):
    rng = random.Random(4)
    rude = ["grumpf", "zorkel", "blaxu"]
    texts, labels = [], []
    for d in range(800):
        toxic = int(d % 5 == 0)
        words = prose(rng, 60).split(" ")
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice([*rude, "plonkt" + rng.choice(WORDS)]))
        texts.append(" ".join(words))
        labels.append((d, 1, toxic))
    docs = table(spark, [*texts, None, ""])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), exceptions=["tame grumpf"])
    assert all(any(e.strip().startswith(toxicity.fold(w).strip()[:5]) for e in model.lexicon) for w in [*rude, "plonkt"])
    rows = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    held = [d for d in range(800) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum((rows[d] >= toxicity.THRESHOLD) != (d % 5 == 0) for d in held) <= 0.01 * len(held)
    odd = table(spark, ["you Gruмpf zork3l bl@xu", "a tame grumpf here", "GRUMPF!!", "1234 0"])
    got = {r["doc_id"]: (r["n_matches"], r["score"] >= toxicity.THRESHOLD) for r in model.score(odd).collect()}
    assert got == {0: (3, True), 1: (0, False), 2: (1, True), 3: (0, False)}


def test_records(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from proofline.llm.shared import new_path

    path, folder = public_tokenizers.path(records.VOCABULARY), new_path(spark, "test-records")
    tokenizer = Tokenizer.from_file(path)
    texts = [*corpus, "A<|endoftext|>b", "ΑΣ Σ", "ét́e a..b it's 'Twas 3rd ..."]
    manifest = records.write(table(spark, [*texts, texts[0]], [*range(len(texts)), None]), folder, path)
    rows = records.read(manifest, folder).orderBy("start").collect()
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in [texts[0], *texts]]
    assert [r["doc_id"] for r in rows] == [None, *range(len(texts))]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    one = rows[7]
    assert records.fetch(folder, one["part"], one["place"])[1].tolist() == want[7]
    with pytest.raises(ValueError, match="damaged"):
        records.unframe(records.frame(b"abc")[:-1] + b"\0")


def removed_by_brute_force(rows):
    seen, out = set(), {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - repeats.LENGTH + 1):
            w = raw[p : p + repeats.LENGTH]
            if w in seen:
                gone[p : p + repeats.LENGTH] = True
            seen.add(w)
        if gone.any():
            out[d] = (int(gone.sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("sizes", [repeats.Sizes(), repeats.Sizes(group=3, shard=700, batch=3000, portion=1000)])
def test_repeats(spark, corpus, sizes):
    """Against brute force; the small sizes take texts through every round: portions, groups of three pieces, longer representatives."""
    line = prose(random.Random(8), 25).replace("\n", " ")[:90]
    texts = [*corpus, *[prose(random.Random(100 + k), 10) + line + prose(random.Random(200 + k), 10) for k in range(40)], corpus[2].upper()]
    rows = list(zip([*range(len(texts)), 3], [*texts, texts[3]], strict=True))
    found = repeats.dedup(table(spark, [t for _, t in rows], [d for d, _ in rows]), sizes).collect()
    assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in found} == removed_by_brute_force(rows[:-1])


def shingles(text):
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def test_ngram_join(spark, corpus):
    sets = [shingles(t) for t in corpus]
    n = len(sets)
    parent, links = list(range(n)), [0] * n

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(n):
        for b in range(a):
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.classes(table(spark, corpus)).collect()}
    assert rows == {d: (find(d), links[d]) for d in range(n)}
    assert max(links) > ngram_join.SMALL
    kept = ngram_join.keep_one(table(spark, [*corpus, corpus[0]], [*range(n), 0]))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(d) for d in range(n)})


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(5, 5), (None, 3)]
    rows = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert rows == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


def test_passages(spark):
    rng = random.Random(11)
    passage = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(55))
    clean = [" ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(120)) for _ in range(20)]
    licence = "\nReleased under the MIT License."
    texts = [c + licence for c in clean]
    for k in (3, 8, 15):
        words = clean[k].split()
        texts[k] = " ".join([*words[: 10 * k // 2], passage, *words[10 * k // 2 :]])
    near = clean[1].split()
    near[60] = "changed"
    texts.append(" ".join(near))
    docs = table(spark, [*texts, None, "", texts[0]], [*range(len(texts) + 2), 0])
    found = passages.repeats(docs)
    assert {r["doc_id"] for r in found.collect()} == {1, 3, 8, 15, 20}
    left = {r["doc_id"]: r["text"] for r in passages.remove(docs, found).collect()}
    assert passages.remove(docs, found).count() == len(texts) + 2  # document 20 is a near copy of a line and goes; document 0 is there twice
    assert 20 not in left
    assert all(left[k] == texts[k] for k in range(20) if k not in (8, 15))
    for k in (8, 15):
        assert all(w in left[k] for w in clean[k].split())
        assert len(left[k].split()) <= len(texts[k].split()) - 30


def test_passages_over_lines(spark):
    """Every run of 50 words shared with an earlier text, by brute force, loses at least MIN_WORDS words, and no word outside the passages goes."""
    rng = random.Random(12)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(9999))
    lines = lambda ws, n: "\n".join("- " + " ".join(ws[i : i + n]) + "." for i in range(0, len(ws), n))
    short, long, again = [word() for _ in range(60)], [word() for _ in range(90)], (["ba7", "ce8", "di9"] * 40)[:100]
    texts = []
    for n in (3, 6, 11, 19, 45):  # the same passages, their lines broken at other words
        texts.append("\n".join([lines([word() for _ in range(47)], 6), lines(short, n), " ".join(word() for _ in range(31)), "\n", lines([*(word() for _ in range(n)), *long], n), " ".join([*(word() for _ in range(n)), *again, word()])]))
    texts.append(lines([word() for _ in range(300)], 5))
    docs = table(spark, texts)
    found = passages.repeats(docs)
    left = {r["doc_id"]: r["text"] for r in passages.remove(docs, found).collect()}
    assert left[5] == texts[5]
    words = [re.findall(r"\w+", t) for t in texts]
    gone = {d: np.zeros(len(w), bool) for d, w in enumerate(words)}
    for r in found.where("removed").collect():
        starts = [len(texts[r["doc_id"]][: m.start()].encode()) for m in re.finditer(r"\w+", texts[r["doc_id"]])]
        gone[r["doc_id"]] |= np.array([r["start"] <= s < r["start"] + r["n_bytes"] for s in starts])
    runs = 0
    for d, own in enumerate(words):
        far = {tuple(w[i : i + 50]) for w in words[:d] for i in range(len(w) - 49)}
        hit = np.zeros(len(own) + 2, bool)
        for i in range(len(own) - 49):
            hit[i + 1 : i + 51] |= tuple(own[i : i + 50]) in far
        edges = np.flatnonzero(np.diff(hit.astype(int)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            runs += 1
            assert gone[d][a:b].sum() >= passages.MIN_WORDS
        kept = re.findall(r"\w+", left[d])
        assert kept == [w for w, g in zip(own, gone[d], strict=True) if not g]
        assert all(w in short + long + again for w, g in zip(own, gone[d], strict=True) if g)
    assert runs == 12


def test_quality_and_pipeline_columns(spark, corpus):
    docs = table(spark, corpus)
    rows = {r["doc_id"]: r for r in quality.score(docs).collect()}
    assert rows[corpus.index(None)]["n_words"] == 0 and rows[corpus.index(None)]["base_failed"]
    assert quality.clean(docs).columns == docs.columns


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "assistant", "<\\|x<|"), (2, 0, "us\ner", None), (2, 1, "assistant", ""), (None, 0, "assistant", "hi<|chat0|>"), (3, 0, None, "\\")]
    rows = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows}
    assert got == {1: [(r, t) for c, _, r, t in turns if c == 1], 2: [("us\ner", ""), ("assistant", "")], None: [("assistant", "hi<|chat0|>")], 3: [("", "\\")]}
    for r in rows:
        place = len(chat.HEAD[0])
        for t in r["turns"]:
            place += t["before"]
            assert r["level"] or r["formatted"][place : place + t["inside"]] == t["text"]
            place += t["inside"] + t["after"]
        assert place == len(r["formatted"])


def test_license(spark):
    rows = license.scan(table(spark, ["x MIT License. Apache  LICENSE y", "nothing", None, "under the Creative Commons Attribution ShareAlike 4.0 International License this work is licensed", "mit license mit license"])).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in rows}
    assert got == {0: (6, 2, 1, 3, "apache,mit", "apache,mit"), 1: (1, 0, None, None, "", ""), 2: (0, 0, None, None, "", ""), 3: (14, 0, None, None, "", "cc-by-sa"), 4: (4, 2, 0, 2, "mit", "mit")}


def test_license_over_lines(spark):
    import textwrap

    wrapped = [f"Notes of 2020.\n\n * {' '.join(textwrap.wrap(text, 72)[:1])}\n * " + "\n *\n * ".join(textwrap.wrap(text, 72)[1:] + ["The end."]) for _, text in license.TEMPLATES]
    apart = "Licensed under a contract\nof many words that stand between the two lines and belong to neither of them at all\nGNU General Public works, version 3. This is"
    rows = {r["doc_id"]: r for r in license.scan(table(spark, [*wrapped, apart])).collect()}
    for i, (label, _) in enumerate(license.TEMPLATES):
        assert label in rows[i]["labels"].split(",") and rows[i]["score"] == 1.0
    assert rows[len(wrapped)]["labels"] == ""


def test_pipeline(spark):
    """The stages against brute force over the small table."""
    import corpus_pipeline
    import duckdb
    import tiktoken

    docs = [(d, t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]
    rows = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows and set(rows) <= {d for d, _ in docs}
    stage = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    kept = {r["doc_id"]: r["text"] for r in stage.collect()}
    again = corpus_pipeline.near_duplicates(spark, stage, SF)
    alone = {r["doc_id"]: r["text"] for r in again.collect()}
    sets = {d: shingles(t) for d, t in kept.items()}
    for d in set(kept) - set(alone):
        assert any(10 * len(sets[d] & sets[e]) >= 8 * len(sets[d] | sets[e]) for e in kept if e != d)
    for d in alone:
        assert not any(e < d and 10 * len(sets[d] & sets[e]) >= 8 * len(sets[d] | sets[e]) for e in alone)
    path, pattern = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    same = [d for d in rows if rows[d] == reference.encode_ordinary(alone[d])]
    assert len(same) >= 0.9 * len(rows)  # the others lost a repeated passage
    assert hashlib.sha256(reference.decode_bytes(rows[same[0]])).digest() == hashlib.sha256(alone[same[0]].encode()).digest()
