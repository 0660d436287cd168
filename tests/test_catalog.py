"""Every registered query against its SQL, and the rules on small cases."""

from __future__ import annotations

import fixtures
import pytest
from compare import connect, difference
from conftest import SF

from proofline import catalog
from proofline.operators import issues, rules, structure
from proofline.plans import chunks

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def blocks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, ord int, text string")


def test_repeated_word_cases(spark):
    found = rules.repeated_word(blocks(
        spark, "Il a a mangé", "un UN mot", "nous nous voyons", "le, le chat", "va-t-il il", "va-il il", "le le le fin", "a/b le le", "x.yz yz", "mot mots", "le le-là",
    )).collect()
    assert sorted((r["ord"], r["start"], r["end"], r["original"]) for r in found) == [(0, 3, 6, "a a"), (1, 0, 5, "un UN"), (6, 0, 5, "le le"), (6, 3, 8, "le le"), (7, 4, 9, "le le")]


def test_long_sentence_cases(spark):
    sixty, many = " ".join(["mot"] * 60) + ".", "; ".join([" ".join(["mot"] * 20)] * 3) + "."
    found = rules.long_sentence(blocks(spark, sixty, " ".join(["mot"] * 45) + ".", many, "Court. " + sixty.capitalize(), " ".join(["12"] * 60))).collect()
    assert sorted((r["ord"], r["start"], r["n_words"]) for r in found) == [(0, 0, 60), (3, 7, 60)]


def test_places_give_the_original(spark):
    rows = rules.typography(blocks(spark, *[t for _, t in fixtures.TYPOGRAPHY_CASES])).collect()
    texts = dict(fixtures.TYPOGRAPHY_CASES)
    assert {r["rule"] for r in rows} == {"double_space", "space_before_punctuation", "doubled_punctuation", "missing_space_after_comma"}
    assert all(texts[r["ord"]][r["start"] : r["end"]] == r["original"] for r in rows)


def structure_cases(spark):
    """The cases with the level of each heading: the parts of its number, 1 without one."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(fixtures.STRUCTURE_CASES, "doc_id long, ord int, kind string, text string")
    number = F.regexp_extract("text", structure.HEADING_NUMBER, 1)
    return rows.withColumn("level", F.when(F.col("kind") == "heading", F.greatest(F.lit(1), F.size(F.split(number, r"\.")))))


def edit_tables(spark):
    return spark.createDataFrame(fixtures.EDITS, fixtures.EDIT_SCHEMA), spark.createDataFrame(fixtures.BLOCKS, "doc_id long, ord int, kind string, text string")


def test_every_mark_of_a_run(spark):
    """All matches count, not only the first of a run; documents with equations are spared one rule; repeated ids don't mix."""
    rows = blocks(spark, "aa,bb;;cc,dd", "un , deux,, trois", "10 ,, x", "aa,bb,cc,dd").withColumn("equations", rules.F.lit(False))
    got = sorted((r["ord"], r["rule"], r["start"], r["original"]) for r in rules.typography(rows).collect())
    assert got == [(0, "doubled_punctuation", 5, ";;"), (0, "missing_space_after_comma", 0, "aa,bb"), (0, "missing_space_after_comma", 7, "cc,dd"), (1, "doubled_punctuation", 9, ",,"), (1, "space_before_punctuation", 0, "un ,"),
                   (2, "doubled_punctuation", 3, ",,"), (3, "missing_space_after_comma", 0, "aa,bb"), (3, "missing_space_after_comma", 6, "cc,dd")]
    spared = rules.typography(rows.withColumn("equations", rules.F.lit(True)))
    assert {r["rule"] for r in spared.collect()} == {"doubled_punctuation", "missing_space_after_comma"}
    twice = blocks(spark, "le le chat", "oui oui").withColumn("ord", rules.F.lit(0))
    assert sorted((r["start"], r["end"], r["original"]) for r in rules.repeated_word(twice).collect()) == [(0, 5, "le le"), (0, 7, "oui oui")]


def test_contradictions_and_glossaries(spark):
    rows = spark.createDataFrame([("coherence", "contradiction", "high", None, v) for v in ("contradictory", "compatible", None)], "category string, subtype string, confidence string, suggestion string, verdict string")
    assert sorted(r["n"] for r in rows.select(issues.nature().alias("n")).collect()) == ["potential", "verify", "verify"]
    texts = [(1, 0, "paragraph", "Le XYZ et le XYZ."), (2, 0, "heading", "Glossaire"), (2, 1, "paragraph", "Le XYZ et le XYZ."), (3, 0, "heading", "XYZ"), (3, 1, "paragraph", "Le XYZ seul."), (4, 0, "paragraph", "Le XYZ (ceci), le XYZ.")]
    found = structure.undefined_acronym(spark.createDataFrame(texts, "doc_id long, ord int, kind string, text string"))
    assert [(r["doc_id"], r["acronym"]) for r in found.collect()] == [(1, "XYZ")]
    deep = [(1, k, "heading", "1.1.1.1.1.1.1." + str(n) + " x", 8) for k, n in enumerate((1, 2, 4))]
    assert [r["number"] for r in structure.heading_gap(spark.createDataFrame(deep, "doc_id long, ord int, kind string, text string, level int")).collect()] == ["1.1.1.1.1.1.1.4"]


def test_structure_cases(spark):
    cases = structure_cases(spark)
    assert [tuple(r) for r in structure.heading_gap(cases).orderBy("doc_id", "ord").collect()] == [(1, 7, "1.3", "1.1", 2), (1, 11, "4", "2", 3), (3, 1, "5", "1", 2)]
    assert [r["original"] for r in structure.toc_mismatch(cases).collect()] == ["Annexe perdue"]
    found = {(r["doc_id"], r["ord"]): (r["path"], r["paragraph"]) for r in structure.sections(cases).collect()}
    assert found[1, 7] == ("1 Introduction > 1.3 Méthode", None)
    assert found[1, 8] == ("1 Introduction > 1.3 Méthode", 1)
    assert found[2, 0] == ("Début du document", 1)


def overlapping(rows):
    rows = sorted(rows)
    return any(a[:3] == b[:3] and b[3] < a[4] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("dedupe", [issues.final_dedupe, issues.block_dedupe])
def test_greedy_choice(spark, dedupe):
    rows = issues.issue_rows(spark, SF)
    every = issues.classified(rows).withColumn("family", issues.family()).withColumn("p", issues.priority()).collect()
    kept = {r["issue_id"] for r in dedupe(rows).collect()}
    places = {(r["doc_id"], r["block"], r["family"], r["start"], r["end"], r["issue_id"]) for r in every if r["issue_id"] in kept}
    assert not overlapping(places)
    if dedupe is issues.final_dedupe:  # what was removed overlaps a kept issue of at least its priority
        by_group = {}
        for r in every:
            if r["issue_id"] in kept:
                by_group.setdefault((r["doc_id"], r["block"], r["family"]), []).append(r)
        for r in every:
            if r["issue_id"] not in kept:
                assert any(k["start"] < r["end"] and r["start"] < k["end"] and k["p"] >= r["p"] for k in by_group[r["doc_id"], r["block"], r["family"]])


def test_chunks_hold_blocks_whole(spark):
    rows = chunks.packed(blocks(spark, *[" ".join(["mot"] * n) for n in (1000, 900, 100, 2500, 5)])).orderBy("ord").collect()
    assert [r["chunk"] for r in rows] == [0, 1, 1, 2, 3]


def test_quota_stream_equals_batch(spark, tmp_path):
    from proofline.streaming import quota

    events = quota.read(spark, SF, "*")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = quota.quota_stream(spark, str(tmp_path / "events"), "click")
    query = stream.writeStream.format("memory").queryName("quota").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("quota").select("user_id", "window_start", "n", "over").collect()}
    want = {tuple(r) for r in quota.windowed(events).where("event_type = 'click'").select("user_id", "window_start", "n", "over").collect()}
    assert got == want


def test_sound_keys(spark):
    from proofline.operators import lexicon

    pairs = [("chapeau", "chapo"), ("éléphant", "elefan"), ("pharmacie", "farmassie"), ("orthographe", "ortografe"), ("attention", "atansion"), ("maison", "meson")]
    rows = spark.createDataFrame([*pairs, ("maison", "moisson")], "a string, b string")
    keys = rows.select(lexicon.sound_key(lexicon.F.col("a")), lexicon.sound_key(lexicon.F.col("b"))).collect()
    assert [a == b for a, b in keys] == [True] * len(pairs) + [False]


def test_distance():
    from proofline.operators.lexicon import distance

    got = {p: round(distance(*p), 3) for p in [("apeler", "appeler"), ("eleve", "élève"), ("Paris", "paris"), ("maisno", "maison"), ("rose", "tose"), ("abc", "abc"), ("", "ab"), ("chat", "chien")]}
    assert got == {("apeler", "appeler"): 0.5, ("eleve", "élève"): 0.6, ("Paris", "paris"): 0.1, ("maisno", "maison"): 0.7, ("rose", "tose"): 0.7, ("abc", "abc"): 0.0, ("", "ab"): 2.0, ("chat", "chien"): got["chat", "chien"]}


def test_misspellings(spark):
    from proofline.operators import lexicon

    rows = {r["word"]: r["suggestion"] for r in lexicon.misspelling(spark.createDataFrame([(x,) for x in fixtures.TEXTS], "text string"), spark.createDataFrame(fixtures.LEXICON, "word string, zipf double")).collect()}
    assert rows["maisno"] == "maison" and rows["professionel"] == "professionnel" and rows["bonjuor"] == "bonjour" and rows["chateau"] == "château" and rows["tres"] == "très"
    assert "zzyzx" not in rows


def test_edits(spark):
    from proofline.operators import edits

    outcome = {r["id"]: r["outcome"] for r in edits.outcome(*edit_tables(spark)).collect()}
    assert outcome[1] == "applied" and outcome[2] == "overlap" and outcome[7] == outcome[8] == "applied" and outcome[12] == "applied"
    texts = {(r["doc_id"], r["ord"]): r["text"] for r in edits.applied(*edit_tables(spark)).collect()}
    assert texts == {(1, 0): "Un chat dort.", (2, 0): "Un mot, deux."}


def test_html(spark):
    from proofline.sources.html import Reader

    page = "<h2>A <b>b</b></h2><p>x<br>y<sup>1</sup><ul><li>one<li>two</ul><table><tr><td>c&amp;d</td></tr></table><script>no</script><p>last"
    assert Reader().read(page) == [("heading", 2, "A b"), ("paragraph", None, "x\ny"), ("list_item", None, "one"), ("list_item", None, "two"), ("table_cell", None, "c&d"), ("paragraph", None, "last")]


def test_docx(spark, tmp_path):
    import zipfile

    from proofline.sources import docx

    ns = docx.W[1:-1]
    p = lambda text, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Titre", '<w:pStyle w:val="Heading2"/>') + p("Texte") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>" + p("point", "<w:numPr/>")
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "entity.docx", "w") as z:
        z.writestr("word/document.xml", f'<!DOCTYPE x><w:document xmlns:w="{ns}"><w:body/></w:document>')
    for name, data in {"old.doc": docx.OLE + b"x", "locked.docx": docx.OLE + b"x", "fake.docx": b"hello", "note.txt": b"hello"}.items():
        (tmp_path / name).write_bytes(data)
    rows = docx.blocks(spark, str(tmp_path)).collect()
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert errors == {"entity.docx": "CORRUPTED_FILE", "old.doc": "LEGACY_DOC_FORMAT", "locked.docx": "PASSWORD_PROTECTED", "fake.docx": "CORRUPTED_FILE", "note.txt": "UNSUPPORTED_FORMAT"}
    good = sorted((r["ord"], r["kind"], r["level"], r["tbl"], r["row"], r["col"], r["text"]) for r in rows if not r["error"])
    assert good == [(0, "heading", 2, None, None, None, "Titre"), (1, "paragraph", None, None, None, None, "Texte"), (2, "table_cell", None, 1, 1, 1, "a"), (3, "table_cell", None, 1, 1, 2, "b"), (4, "list_item", None, None, None, None, "point")]


def test_grammar_findings(spark):
    from proofline.operators import grammar

    rows = {(r["doc_id"], r["ord"], r["start"]): (r["subtype"], r["suggestion"], r["confidence"], r["alternatives"]) for r in grammar.mapped(spark.createDataFrame(fixtures.FINDINGS, "doc_id long, ord int, start int, stop int, rule string, kind string, suggestions array<string>"), spark.createDataFrame(fixtures.GRAMMAR_TEXTS, "doc_id long, ord int, text string")).collect()}
    assert rows == {
        (1, 0, 4): ("gender_number", "serveurs", "high", 0),
        (1, 0, 28): ("conjugation", "ont", "medium", 1),
        (2, 0, 4): ("gender_number", "satisfaisant", "medium", 0),
        (2, 0, 30): ("gender_number", "résultats", "high", 0),
        (2, 0, 40): ("syntax", None, "low", 0),
        (2, 0, 44): ("gender_number", "à", "medium", 0),
    }
