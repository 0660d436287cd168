"""Odd rows and names through the operators that change tables, and brute-force versions of what SQL can't state."""

from __future__ import annotations

import base64
import random

import numpy as np
from conftest import SF

from proofline.llm import bpe, decontaminate, ngram_join, passages, quality, toxicity

WORDS = [f"{a}{b}{c}" for a in "ba ce di fo gu la mi no".split() for b in "ra se ti vo nu".split() for c in "xyz"]
#: Columns whose names the operators use inside, or could.
NAMES = ["row", "__words", "spans", "kept", "n_words", "key", "h", "t", "lines", "own_h", "clean_text"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if k % 11 == 10 else "") for k in range(n)) + "."


def odd_table(spark, rows):
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(d, t, len(t or ""), *[f"{c}{k}" for c in NAMES]) for k, (d, t) in enumerate(rows)], schema)


def rows_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", *[r[c] for c in NAMES]) for r in df.collect())


def test_columns_of_any_name_stay(spark):
    rng = random.Random(1)
    texts = [prose(rng, 80) for _ in range(6)]
    rows = [*enumerate(texts), (None, texts[0]), (None, prose(rng, 70)), (3, prose(rng, 75)), (3, texts[3]), (8, None), (9, ""), (10, texts[1] + "\nHome | News | About | Contact")]
    docs = odd_table(spark, rows)
    benchmark = spark.createDataFrame([(1, " ".join(texts[2].split()[5:40]))], "item_id long, text string")
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    got = rows_of(cleaned)
    assert len(got) == len(rows) - 2 and all(x[3 + NAMES.index("kept")].startswith("kept") and x[3 + NAMES.index("n_words")].startswith("n_words") for x in got)
    assert next(x[2] for x in got if x[1] == 10) == texts[1]
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns
    # copies without an id or with a repeated one go, other texts of a repeated id or of none stay, wordless rows are alone
    assert sorted(str(r["doc_id"]) for r in one.collect()) == sorted(["0", "1", "2", "3", "3", "4", "5", "None", "8", "9"])
    left = passages.remove(docs, passages.repeats(docs))
    assert left.columns == docs.columns and all(r["spans"].startswith("spans") for r in left.collect())
    clean = decontaminate.remove(docs, benchmark)
    assert clean.columns == docs.columns and rows_of(clean) == sorted(x for x in rows_of(docs) if x[1] != 2)


def test_classes_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = ngram_join.classes(odd_table(spark, [(None, a), (7, a), (7, b), (None, None), (9, b), (None, prose(rng, 60))])).collect()
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in rows)
    assert got == sorted([("None", "7", 1), ("7", "7", 1), ("7", "7", 1), ("None", "None", 0), ("9", "7", 1), ("None", "None", 0)])


def test_bpe_splits_white_space_as_in_the_whole_text(spark):
    """At the shipped sizes, around the places where texts are cut, and a single pre-token of many chunks."""
    import tiktoken

    path, pattern = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["w" * 32766 + "  " + "word " * 2000, "q" * 300_000]
    for off in (-5, -1, 0, 1, 2, 6):
        for space in (" ", " ", "\x85", "　", "\r\n"):
            texts.append("w " * ((bpe.CHUNK + off) // 2) + space * 5 + "we'll " * 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert list(r["ids"]) == reference.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]


def test_long_white_space():
    path, pattern = bpe.default_ranks()
    enc = bpe.encoder(path, pattern)
    for text in ("a" + " " * 60_000 + "b", "\n" * 70_000, "x" + " " * 55_000):
        assert enc.decode(bpe.ids_of(enc, text).tolist()) == text
    short = "a" + " " * 900 + "b c"
    assert bpe.ids_of(enc, short).tolist() == enc.encode_ordinary(short)


def test_matcher_equals_plain_search():
    rng = random.Random(3)
    lexicon = {" gru": 2.0, " grump ": 3.5, " zork ": 1.0, " zo": 0.5}
    matcher = toxicity.Matcher(lexicon, ["tame zork"])
    for _ in range(300):
        words = [rng.choice(["gru", "grump", "grumpy", "zork", "zoo", "tame", "ba", "zorks"]) for _ in range(rng.randrange(0, 9))]
        text = toxicity.fold(" ".join(words))
        folded = {toxicity.fold(e).strip(): w for e, w in lexicon.items()}
        assert set(folded) == {e.strip() for e in lexicon}  # no letters of these entries fold to others
        total, n = 0.0, 0
        for k, w in enumerate(words):
            weights = [x for e, x in lexicon.items() if (" " + w + " ").startswith(e)]
            harmless = w == "zork" and k > 0 and words[k - 1] == "tame"
            if weights and not harmless:
                total, n = total + max(weights), n + 1
        assert matcher.total(text) == (total, n)


def test_folding():
    same = ["gruмpf", "GRUMPF", "ｇｒｕｍｐｆ", "g​rumpf", "grümpf", "grumpf́", "𝓰𝓻𝓾𝓶𝓹𝓯"]
    assert {toxicity.fold(t) for t in same} == {" grumpf "}
    assert toxicity.fold("1d!ot") == toxicity.fold("ldiot") == toxicity.fold("id|ot") == " idiot "
    assert toxicity.fold("12 a 7") == "   a   " and toxicity.fold("oh!") == " oh  "


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_decontamination_against_brute_force(spark):
    """Every pair with a window of three item lengths that holds 0.75 of the item in order is found; every pair found holds what it says."""
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([12, 25, 40])))) for k in range(20)] + [(50, "only three words"), (51, "lone")]
    docs = []
    for d in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.choice([30, 150, 400]))]
        if d % 3 == 0:
            item = items[d // 3 % 20][1].split()
            keep = [w for w in item if rng.random() > rng.choice([0.0, 0.1, 0.3, 0.5])]
            at = rng.randrange(len(words))
            words[at:at] = keep
        docs.append(" ".join(words))
    docs += ["it has only Three words in it", "only three other words", None, ""]
    rows = [*enumerate(docs), (None, docs[0])]
    found = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontaminate.find(odd_table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k in found if k[1] >= 50} == {(120, 50)}
    sure = hits = 0
    for d, text in enumerate(docs[:120]):
        words = text.split()
        for k, item in items[:20]:
            own = item.split()
            best = max(longest_common(words[a : a + 3 * len(own)], own) for a in range(0, max(1, len(words) - len(own)), max(1, len(own) // 2))) / len(own)
            if best >= 0.75:
                sure += 1
                hits += (d, k) in found
            if (d, k) in found:
                assert longest_common(words, own) / len(own) >= min(found[d, k], decontaminate.LCS_ANSWER)
    assert sure > 10 and hits >= 0.9 * sure


def test_segments_recall(spark):
    """Of the runs of 50 words that documents with ids divisible by 50 share with an earlier one, four fifths of the bytes are found."""
    rng = random.Random(7)
    shared = [[rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(60)] for _ in range(4)]
    texts = []
    for d in range(200):
        words = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(100)]
        if d % 25 == 0:
            words[40:40] = shared[d // 25 % 4]
        texts.append(" ".join(words))
    rows = passages.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("removed").collect()
    covered = {}
    for r in rows:
        covered.setdefault(r["doc_id"], np.zeros(len(texts[r["doc_id"]].encode()), bool))[r["start"] : r["start"] + r["n_bytes"]] = True
    wanted = found = 0
    for d in range(100, 200, 50):
        start = len(" ".join(texts[d].split()[:40])) + 1
        stop = len(" ".join(texts[d].split()[:100]))
        wanted += stop - start
        found += int(covered.get(d, np.zeros(len(texts[d]), bool))[start:stop].sum())
    assert found >= 0.8 * wanted  # what stands between a passage's edge and its first cut stays


def test_pipeline_takes_odd_and_empty_tables(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = prose(rng, 90)
    docs = odd_table(spark, [(1, text), (1, prose(rng, 90)), (None, text), (None, prose(rng, 90)), (5, None), (6, ""), (7, text)])
    rows = corpus_pipeline.run_stages(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert corpus_pipeline.run_stages(spark, docs.where("doc_id = -5"), SF).count() == 0


def test_repeats_of_texts_without_an_id(spark):
    """Texts without an id are told apart by themselves: each has its own runs, however many there are."""
    from pyspark.sql import functions as F

    from proofline.llm import repeats

    rng = random.Random(8)
    shared = prose(rng, 60)
    texts = [prose(rng, 50) + " " + shared + " " + prose(rng, 50) for _ in range(40)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, texts[0])], "doc_id long, text string")
    keyed = repeats.keyed(docs)
    copies = repeats.later_copies(keyed)
    held = repeats.candidates_of(keyed, copies)
    per = [(r["doc_id"], r["n"]) for r in held.select("doc_id", F.size("runs").alias("n")).collect()]
    ids = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    alone = repeats.candidates_of(repeats.keyed(ids), repeats.later_copies(repeats.keyed(ids)))
    most = max(r["n"] for r in alone.select(F.size("runs").alias("n")).collect())
    # the text that a document with an id repeats as a whole has all its runs, the others what they have by themselves
    assert len(per) == 40 and sorted(n for _, n in per)[-2] <= most
    removed = [(r["n_removed"], r["n_spans"]) for r in repeats.dedup(docs).collect()]
    assert len(removed) == 40 and all(n >= len(shared.encode()) - 1 for n, _ in removed)
