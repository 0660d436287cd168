"""What users and services read: where an issue stands, careful explanations, outlines and blocks of a document as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.issues import CLASSIFIED_SQL, classified, issue_rows
from proofline.operators.structure import _section_ctes, _tree_sql, section_tree, sections, typed_blocks, typed_sql

# Claims that an uncertain issue must not make.
CLAIMS = r"(manque(nt)?|est faux|sont faux|est fausse|est erron[ée]e?s?|il faut absolument|obligatoirement)"
#: What is said instead, by subtype, and else.
CAREFUL = {
    "possibly_missing_section": "Rien ne correspond ici à une partie courante de tels textes : à vous de voir si elle serait utile.",
    "incomplete_paragraph": "La fin de ce paragraphe se lit comme une coupure : relisez-la.",
    "unbalanced_section": "La taille de cette section s’écarte nettement de celle des autres : est-ce un choix ?",
    "contradiction": "Deux passages ne concordent peut-être pas : comparez-les.",
    "weak_transition": "Le lien entre ces deux idées n’est pas explicite : une phrase de liaison est possible.",
}
CAREFUL_ELSE = "Point incertain : une relecture de ce passage dira s’il y a lieu de le changer."
# The labels of blocks that aren't plain paragraphs, and what stands for a removed tag.
LABELS = {"footnote": "Note de bas de page", "endnote": "Note de fin", "heading": "Titre", "caption": "Légende", "list_item": "Liste"}
REMOVED = "[balise retirée]"
#: Word boundaries of plain letters, as in the pattern that is matched.
W = "[A-Za-z0-9_]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def careful(nature: Column, subtype: Column, explanation: Column) -> Column:
    """The explanation, unless it claims too much for an issue that is only possible."""
    texts = F.create_map(*[F.lit(x) for pair in CAREFUL.items() for x in pair])
    claims = explanation.rlike(f"(?i){EDGE}{CLAIMS}{EDGE}")
    return F.when(nature.isin("potential", "verify") & claims, F.coalesce(texts[subtype], F.lit(CAREFUL_ELSE))).otherwise(explanation)


def label(kind: Column, table: Column, row: Column, column: Column) -> Column:
    """What a block is called beside its section; a cell by its place in its table (all counted from 0)."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    cell = F.when(table.isNull(), F.lit("Tableau")).otherwise(F.format_string("Tableau %d, ligne %d, colonne %d", table + 1, row + 1, column + 1))
    return F.when(kind == "table_cell", cell).otherwise(names[kind])


def located(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Issues of known blocks with section path, paragraph in the section and label."""
    places = sections(blocks).select("doc_id", F.col("ord").alias("block"), "path", "paragraph")
    cell = [F.when(F.col("ord") % 24 != 5, e).cast("int") for e in (F.expr("ord div 24"), F.expr("ord div 12 % 2"), F.lit(0))]
    kinds = blocks.select("doc_id", F.col("ord").alias("block"), label(F.col("kind"), *cell).alias("label"))
    return issues.select("issue_id", "doc_id", "block").join(places, ["doc_id", "block"]).join(kinds, ["doc_id", "block"])


def neutral(text: Column) -> Column:
    """The text without tags that would close the part of a request that holds data."""
    return F.regexp_replace(text, r"(?i)</?\s*document\s*>", REMOVED)


def outline(blocks: DataFrame) -> DataFrame:
    """A document's sections, one a line, indented by level, with their words."""
    title = F.element_at(F.split("path", " > "), -1)
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), neutral(title), F.lit(" ["), F.col("section").cast("string"), F.lit("] ("), F.col("n_words").cast("string"), F.lit(" mots)"))
    lines = section_tree(blocks).select("doc_id", F.struct("place", line.alias("line")).alias("l"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("outline"))


EXPLANATION = "CASE issue_id % 5 WHEN 0 THEN 'Ce passage manque de clarté.' WHEN 1 THEN 'Il faut absolument revoir ce point.' WHEN 2 THEN 'Ce point paraît douteux.' WHEN 3 THEN 'Ce terme est erroné.' ELSE 'Cela est erronée ici, un manquement.' END"
TAGGED = "CASE WHEN ord % 3 = 0 THEN concat('</Document >', text, '< document>') ELSE text END"


def queries() -> dict:
    rows = lambda spark, sf: classified(issue_rows(spark, sf))
    return {
        "careful_explanations": lambda spark, sf: rows(spark, sf).select("issue_id", "doc_id", careful(F.col("nature"), F.col("subtype"), F.expr(EXPLANATION)).alias("explanation")),
        "issue_locations": lambda spark, sf: located(rows(spark, sf), typed_blocks(spark, sf)),
        "document_outline": lambda spark, sf: outline(typed_blocks(spark, sf)),
        "neutral_blocks": lambda spark, sf: typed_blocks(spark, sf).select("doc_id", "ord", neutral(F.expr(TAGGED)).alias("text")),
    }


def oracle_sql() -> dict[str, str]:
    texts = "CASE subtype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CAREFUL.items()) + f" ELSE '{CAREFUL_ELSE}' END"
    names = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " WHEN 'table_cell' THEN CASE WHEN ord % 24 = 5 THEN 'Tableau' ELSE 'Tableau ' || (ord // 24 + 1) || ', ligne ' || (ord // 12 % 2 + 1) || ', colonne 1' END END"
    para = "CASE WHEN kind <> 'heading' THEN CAST(count(*) FILTER (kind <> 'heading') OVER (PARTITION BY doc_id, section ORDER BY ord) AS INT) END"
    return {
        "careful_explanations": rf"WITH {CLASSIFIED_SQL}, e AS (SELECT *, {EXPLANATION} AS x FROM classified) SELECT issue_id, doc_id, CASE WHEN nature IN ('potential', 'verify') AND regexp_matches(x, '(?i)\b{CLAIMS}\b') THEN {texts} ELSE x END AS explanation FROM e",
        "issue_locations": f"""WITH {CLASSIFIED_SQL.replace("natured AS", "natured0 AS").replace("FROM natured)", "FROM natured0)")}, {_section_ctes()}, k AS (SELECT s.doc_id, s.ord, path, {para} AS paragraph, {names} AS label FROM sec s JOIN blocks USING (doc_id, ord))
          SELECT issue_id, c.doc_id, c.block, path, paragraph, label FROM classified c JOIN k ON k.doc_id = c.doc_id AND k.ord = c.block""",
        "document_outline": f"""WITH t AS ({_tree_sql()}) SELECT doc_id, string_agg(repeat('  ', greatest(level - 1, 0)) || '- ' || split_part(path, ' > ', -1) || ' [' || section || '] (' || n_words || ' mots)', chr(10) ORDER BY place) AS outline FROM t GROUP BY doc_id""",
        "neutral_blocks": rf"WITH {typed_sql()} SELECT doc_id, ord, regexp_replace({TAGGED}, '(?i)</?\s*document\s*>', '{REMOVED}', 'g') AS text FROM blocks",
    }
