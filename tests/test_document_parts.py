"""Hand-made cases of anchoring, doubtful cases, styles, parts, related passages, segments, answers, names and close words."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from proofline.functions import answers
from proofline.operators import ambiguity, anchor, forms, language, names, parts, related, segments, styles


def test_anchor(spark):
    cases = [
        ("Le chat dort.", " chat ", (3, 7, "exact")), ("Il dit « oui » et part.", 'dit "oui" et', (3, 17, "folded")), ("L’été… fini", "L'été... fini", (0, 11, "folded")),
        ("un  deux   trois", "Un deux trois", (0, 16, "folded")), ("a – b", "a - b", (0, 5, "folded")), ("fin…", "fin.", (0, 4, "folded")), ("abc", "abd", None), ("abc", "  ", None), ("", "x", None), ("x" * 50 + " « y »", '"y"', (51, 56, "folded")),
    ]
    rows = spark.createDataFrame([(k, t, e) for k, (t, e, _) in enumerate(cases)], "k int, text string, excerpt string").select("k", anchor.anchor(F.col("text"), F.col("excerpt")).alias("a")).collect()
    got = {r["k"]: tuple(r["a"]) if r["a"] else None for r in rows}
    assert [got[k] for k in range(len(cases))] == [w for _, _, w in cases]


def test_first_sentence(spark):
    row = spark.createDataFrame([("  Un mot. Deux mots.",), ("x" * 400,)], "text string").select(anchor.first_sentence(F.col("text")).alias("a")).collect()
    assert [tuple(r["a"]) for r in row] == [(2, 9, "first_sentence"), (0, 300, "first_sentence")]


def test_contexts_and_duplicates(spark):
    long = "Mot " * 100 + "confusion " + "mot " * 100
    texts = [(1, 0, long), (1, 1, "La confusion reste entière dans ce passage assez long."), (1, 2, "La confusion reste entière dans ce passage assez long."), (1, 3, "Ici. confusion ici.")]
    blocks = spark.createDataFrame(texts, "doc_id long, ord int, text string")
    place = lambda k: texts[k][2].index("confusion")
    option = [(0, 1, "x")]
    rows = [(1, k, k, place(k), place(k) + 9, "spelling", "keep", option) for k in range(4)] + [(1, 10, 1, 3, 12, None, "keep", option), (1, 11, 1, 3, 12, "grammar", "drop", []), (1, 12, 9, 3, 12, "grammar", "keep", option), (1, 13, 2, 3, 12, "spelling", "verify", option)]
    found = ambiguity.collected(spark.createDataFrame(rows, f"doc_id long, seq long, ord int, start int, end int, kind string, fallback string, options {ambiguity.OPTION}"), blocks).collect()
    got = {r["seq"]: (r["fate"], r["case_no"], r["shift"]) for r in found}
    assert got == {0: ("case", 1, None), 1: ("case", 2, None), 2: ("duplicate", 2, 0), 3: ("case", 3, None), 10: ("direct", None, None), 11: ("dropped", None, None), 12: ("direct", None, None), 13: ("duplicate", 2, 0)}
    context = {r["seq"]: r["context"] for r in found}
    assert context[1] == texts[1][2] and context[3] == texts[3][2]
    assert context[0].startswith("…mot") or context[0].startswith("…Mot")
    assert context[0].endswith("…") and len(context[0]) <= ambiguity.MAX_CONTEXT + 2 and "confusion" in context[0]


def test_style_chains(spark):
    rows = [(1, "a", "Corps", "b", None), (1, "b", None, "c", None), (1, "c", "x", "Heading2", None), (1, "loop1", "x", "loop2", None), (1, "loop2", "y", "loop1", None), (1, "self", "y", "self", None), (1, "o", "y", None, 3), (1, "o9", "y", "a", 9), (1, "TOC1", "z", None, None),
            (1, "t", "Titre", "a", None), (1, "cap", "caption", None, None), (2, "a", "heading 4", None, None)]
    rows += [(3, f"s{k}", "n", f"s{k + 1}", None) for k in range(40)] + [(3, "s40", "Titre 1", None, None)]
    got = {(r["doc_id"], r["style"]): (r["role"], r["level"], r["source"]) for r in styles.roles(spark.createDataFrame(rows, "doc_id long, style string, name string, based_on string, outline int")).collect()}
    assert got[1, "a"] == got[1, "b"] == got[1, "c"] == got[1, "o9"] == ("heading", 2, "style") and got[1, "o"] == ("heading", 4, "outline")
    assert got[1, "loop1"] == got[1, "loop2"] == got[1, "self"] == ("normal", None, None)
    assert got[1, "TOC1"][0] == "toc" and got[1, "t"] == ("title", 1, "style") and got[1, "cap"][0] == "caption" and got[2, "a"] == ("heading", 4, "style")
    assert got[3, "s0"] == ("heading", 1, "style") and len(got) == len(rows)


def test_notes_and_headers(spark):
    body = [(1, 0, "heading", 1, "Un", [], 0, 0), (1, 1, "paragraph", None, "texte", [("footnote", 5)], 0, 1), (1, 2, "paragraph", None, "suite", [("footnote", 5), ("endnote", 5)], 0, 0)]
    blocks = spark.createDataFrame(body, "doc_id long, ord int, kind string, level int, text string, calls array<struct<part:string,id:bigint>>, breaks_before int, breaks_inside int")
    extras = [(1, "footnote", 0, 5, "note"), (1, "footnote", 1, 6, "seule"), (1, "endnote", 0, 5, "fin"), (1, "header", 0, None, " En-tête"), (1, "header", 1, None, "En-tête "), (1, "footer", 2, None, "En-tête"), (1, "footer", 3, None, "  ")]
    paged = parts.pages(blocks, spark.createDataFrame([(1, None)], "doc_id long, declared int"))
    rows = parts.reading_order(blocks, spark.createDataFrame(extras, "doc_id long, part string, seq int, note_id long, text string"), paged).orderBy("position").collect()
    assert [(r["position"], r["part"], r["page"], r["section"], r["note_of"]) for r in rows] == [
        (0, "body", 1, 0, None), (1, "body", 1, 0, None), (2, "body", 2, 0, None), (3, "footnote", 2, 0, 2), (4, "footnote", None, None, None), (5, "endnote", 2, 0, 2), (6, "header", None, None, None), (7, "footer", None, None, None),
    ]


def test_units_and_verdicts(spark):
    blocks = spark.createDataFrame([(1, k, f"Le chat {k} dort. Il rêve.") for k in range(4)], "doc_id long, ord int, text string")
    items = [(1, k, 0, [9, 2], "contradiction", "major", "high") for k in range(12)] + [(1, 20, 1, [1, 2, 2, 7, 3], "tense_shift", "minor", "high"), (1, 21, 9, [1], "tense_shift", "minor", "high"), (2, 1, 0, [1], "tense_shift", "minor", "high")]
    items = spark.createDataFrame(items, "doc_id long, seq long, block int, related array<int>, subtype string, severity string, confidence string")
    known = related.known_items(items, blocks, spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, n_sections long"))
    units = related.units(known, blocks)
    assert sorted((r["unit"], r["block_a"], r["block_b"]) for r in units.collect()) == [(k, 0, 2) for k in range(10)]
    said = spark.createDataFrame([(1, 0, "contradictory", "chat 0", "chat 2"), (1, 1, "compatible", "", ""), (1, 2, "uncertain", "chien", "chien")], "doc_id long, unit int, verdict string, excerpt_a string, excerpt_b string")
    rows = {(r["seq"], r["other"]): (r["confidence"], r["own_start"], r["start"], r["end"], r["how"]) for r in related.passages(known, units, said, blocks).collect()}
    assert rows == {(0, 2): ("high", 3, 3, 9, "exact"), (2, 2): ("low", None, 0, 15, "first_sentence"), (20, 2): ("high", None, 0, 15, "first_sentence"), (20, 3): ("high", None, 0, 15, "first_sentence")}


def test_segments(spark):
    text = "abcdefghij"
    seg = lambda k, a, z, **o: {"doc_id": 1, "ord": o.pop("ord", 0), "seg": k, "start": a, "end": z, "text": text[a:z], "kind": "text", "run": k, "container": 0, "format": None, "field": False, "control": False, "tracked": False, "gap_before": False} | o
    rows = [seg(0, 0, 3), seg(1, 3, 6), seg(2, 6, 10, format="bold")]
    rows += [seg(k, 3 * k, 3 * k + 3, ord=1, **o) for k, o in enumerate(({}, {"kind": "tab"}, {"gap_before": True}))]
    schema = "doc_id long, ord int, seg int, start int, end int, text string, kind string, run int, container int, format string, field boolean, control boolean, tracked boolean, gap_before boolean"
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    edits = [(1, 1, 0, 1, 5, "XY"), (2, 1, 0, 5, 7, "Z"), (3, 1, 0, 0, 0, "<"), (4, 1, 0, 6, 6, "?"), (5, 1, 1, 2, 4, "t"), (6, 1, 1, 8, 8, "in"), (7, 1, 1, 40, 41, "no"), (8, 1, 0, 10, 10, ">")]
    found = segments.changed(spark.createDataFrame(edits, "id long, doc_id long, ord int, start int, stop int, replacement string"), table).collect()
    assert {r["id"]: r["refused"] for r in found if r["id"]} == {2: "format_boundary", 4: "format_boundary", 5: "not_plain_text", 7: "anchor_mismatch"}
    assert {(r["ord"], r["seg"]): r["text"] for r in found if not r["id"]} == {(0, 0): "<aXY", (0, 1): "f", (0, 2): "ghij>", (1, 2): "ghini"}


def test_answers(spark):
    issue = {"blockId": "b1", "category": "style", "subtype": "wordy", "original": "x", "suggestion": None, "explanation": "e", "severity": "minor", "confidence": "low"}
    decision = {"caseId": "c1", "decision": "keep", "correction": None, "justification": "", "confidence": "low"}
    cases = [
        ("local", {"issues": []}, None), ("local", {"issues": [issue]}, None), ("local", {"issues": [issue, issue | {"severity": "big"}]}, "$.issues[1].severity: value"), ("local", {"issues": [issue | {"original": ""}]}, "$.issues[0].original: too_short"),
        ("local", {"issues": [{k: v for k, v in issue.items() if k != "blockId"}]}, "$.issues[0].blockId: missing"), ("local", {"issues": [issue | {"z": 1, "extra": 1}]}, "$.issues[0].extra: unknown"), ("local", {"issues": {}}, "$.issues: type"), ("local", [], "$: type"),
        ("local", {}, "$.issues: missing"), ("local", {"issues": [issue] * 41}, "$.issues: too_many"), ("local", {"issues": [issue | {"suggestion": 5}]}, "$.issues[0].suggestion: type"), ("ambiguity", {"decisions": [decision | {"caseId": "c" * 11}]}, "$.decisions[0].caseId: too_long"),
        ("context", {"issues": [], "digest": {"summary": "s", "keyFacts": [{"subject": "a", "value": "b"}], "terms": [], "dominantTense": "past"}}, "$.digest.keyFacts[0].blockId: missing"), ("verify", {"verdict": None, "excerptA": "", "excerptB": "", "explanation": "e"}, "$.verdict: type"), ("none", {}, "$: step"),
    ]
    rows = [(k, step, json.dumps(a)) for k, (step, a, _) in enumerate(cases)] + [(99, "local", "{"), (98, "local", None)]
    got = {r["k"]: r["violation"] for r in answers.checked(spark.createDataFrame(rows, "k int, step string, answer string")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, _, w in cases] and got[99] == got[98] == "$: json"


def test_names(spark):
    texts = ["Il voit M. Kouassi Yao ici.", "Avec Mme Aya de La Tour.", "J.-P. Dupont dort. Le chat. M. Petit part.", "Le Table vide."]
    rows = names.capital_words(spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, ord int, text string")).collect()
    got = {(r["ord"], r["word"], r["start"]): (r["after_title"], r["sentence_start"]) for r in rows}
    assert got[0, "Kouassi", 11][0] and got[0, "Yao", 19][0] and got[0, "Il", 0] == (False, True) and not got[0, "M", 8][0]
    assert got[1, "Aya", 9][0] and got[1, "Tour", 19][0] and got[2, "Dupont", 6][0]
    assert got[2, "Le", 19] == (False, True) and got[2, "Petit", 31] == (True, False) and got[3, "Table", 3] == (False, False)


def test_close_words(spark):
    known = spark.createDataFrame([(w,) for w in ("élève", "appeler", "maison", "chat", "côté", "bonne")], "word string")
    words = spark.createDataFrame([(w,) for w in ("eleve", "apeller", "maisno", "chta", "cotte", "bone", "xyzzy", "maison", "elleve")], "word string")
    got = {(r["word"], r["candidate"], r["how"]) for r in forms.close_words(words, known).collect()}
    assert got == {("eleve", "élève", "light"), ("apeller", "appeler", "light"), ("maisno", "maison", "edit"), ("chta", "chat", "edit"), ("bone", "bonne", "edit")}


def test_sentence_languages(spark):
    text = "Le chat est dans la maison. The dog is in the house. Zorblax frimp. Oui."
    lexicon = spark.createDataFrame([("zorblax", "en"), ("frimp", "en")], "word string, lang string")
    rows = language.sentence_language(spark.createDataFrame([(1, 0, text), (1, 1, "Zut.")], "doc_id long, ord int, text string"), lexicon)
    assert [(r["ord"], r["sentence"], r["language"], r["by"]) for r in rows.orderBy("ord", "sentence").collect()] == [(0, 0, "fr", "sentence"), (0, 1, "en", "sentence"), (0, 2, "en", "sentence"), (0, 3, "uncertain", "block"), (1, 0, "fr", "document")]
    places = spark.createDataFrame([(1, 0, 3, "a"), (1, 0, 30, "b"), (1, 0, 27, "gap"), (1, 9, 0, "none")], "doc_id long, ord int, start int, name string")
    assert {r["name"]: r["language"] for r in language.language_at(places, rows).collect()} == {"a": "fr", "b": "en", "gap": None, "none": None}


def test_sentence_language_reads_its_blocks_once(spark):
    """Each text is cut and judged once: its block, its sentences and their words go on in one stream."""
    lexicon = spark.createDataFrame([("zut", "fr")], "word string, lang string")
    found = language.sentence_language(spark.createDataFrame([(1, 0, "Le chat dort. Zut."), (None, 1, "Zut.")], "doc_id long, ord int, text string"), lexicon)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and plan.count("split(") == 1
    assert sorted((r["sentence"], r["start"], r["end"], r["language"], r["by"]) for r in found.collect()) == [(0, 0, 13, "fr", "block"), (1, 14, 18, "fr", "block")]
