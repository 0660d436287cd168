"""French typography: no-break spaces before double marks and inside guillemets, double spaces made single, and a proof that only spaces changed.

Candidates of all patterns are found inside the row, sorted by place, and the earliest of overlapping ones stays: a fold over a block's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import FILL, STEPS, bound, calm_text, computed, matches
from proofline.sources import text as source

NBSP = " "
# What is looked for, and what replaces it; {s} stands for a no-break space and $n for a part of the match.
SPACES = r"[^\s\x{00A0}\x{202F}]"
RULES = [
    (r"(?<=\S) +(?=[;:!?»])", "{s}", r"^.*$"),
    (r"\p{L}[;!?](?=\s|$|»)", "$1{s}$2", r"^(.)(.)$"),
    (r"\p{L}:(?=\s)", "$1{s}$2", r"^(.)(.)$"),
    (r"« +(?=\S)", "«{s}", r"^.*$"),
    (rf"«(?={SPACES}){SPACES}", "«{s}$1", r"^«(.)$"),
    (r"[^\s\x{00A0}\x{202F}«]»", "$1{s}»", r"^(.)»$"),
    (r"(?<=\S) {2,}(?=[^\s;:!?»])", " ", r"^.*$"),
]
EDIT = "array<struct<start:int,end:int,replacement:string>>"


def candidates(text: Column) -> Column:
    """Every change that a pattern proposes in a text without addresses, paths and code, in order of place: array of (start, end, replacement)."""

    def by(pattern: str, new: str, whole: str) -> Column:
        row = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(x["text"], whole, new.replace("{s}", NBSP)).alias("replacement"), x["text"].alias("old"))
        touching = lambda x: F.contains(F.concat(x["before"], x["text"], F.left(x["rest"], F.lit(1))), F.lit(FILL))
        return F.transform(F.filter(matches(text, pattern), lambda x: ~touching(x)), row)

    found = F.flatten(F.array_compact(F.array(*[by(*rule) for rule in RULES])))
    return F.array_sort(F.filter(found, lambda x: x["old"] != x["replacement"]))


def edits(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, text and the changes that don't overlap, the earliest first."""
    calm = computed(blocks, ["doc_id", "ord", "text"], calm=calm_text(F.col("text")))
    found = computed(calm, ["doc_id", "ord", "text"], c=candidates(F.col("calm"))).where(F.size("c") > 0)

    def step(a: Column, x: Column) -> Column:
        kept = F.struct(x["end"].alias("last"), F.array_append(a["out"], F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"))).alias("out"))
        return F.when(x["start"] < a["last"], a).otherwise(kept)

    def chunk(a: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(a["last"].alias("last"), F.array().cast(EDIT).alias("out")), step)
        return bound(own, lambda r: F.struct(r["last"].alias("last"), F.array_append(a["out"], r["out"]).alias("out")))

    # a fold copies what it has in every step, so chunks are folded by themselves, with the last place of the one before
    chunks = F.transform(F.sequence(F.lit(1), F.size("c"), F.lit(STEPS)), lambda k: F.slice("c", k, F.lit(STEPS)))
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{EDIT}>").alias("out"))
    return computed(found, ["doc_id", "ord", "text"], edits=F.flatten(F.aggregate(chunks, zero, chunk, lambda a: a["out"])))


def beautified(blocks: DataFrame) -> DataFrame:
    """Changed blocks: doc_id, ord, before and after. Each change brings what follows it up to the next one, so no text is copied once per change."""

    def rest(x: Column, i: Column) -> Column:
        ahead = F.coalesce(F.get("edits", i + 1)["start"], F.length("text"))
        return F.concat(x["replacement"], F.substr("text", x["end"] + 1, ahead - x["end"]))

    text = F.concat(F.left("text", F.get("edits", F.lit(0))["start"]), F.array_join(F.transform("edits", rest), ""))
    return edits(blocks).select("doc_id", "ord", F.col("text").alias("before"), text.alias("after"), F.size("edits").alias("n_edits"))


def same_meaning(changed: DataFrame) -> DataFrame:
    """Whether a document's changed blocks differ in spaces only; one that doesn't is refused as a whole."""
    bare = lambda c: F.regexp_replace(c, r"[\s\x{00A0}\x{202F}]+", "")
    return changed.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum("n_edits").alias("n_edits"), F.bool_and(bare("before") == bare("after")).alias("same"))


#: For both engines: documents with guillemets, double marks and double spaces put in, as the driver's have none.
MARKED = """CASE doc_id % 4 WHEN 0 THEN replace(replace(text, ', ', '; '), '. ', ' ! ') WHEN 1 THEN replace(replace(text, ', ', ' « a » '), '. ', '! ') WHEN 2 THEN replace(replace(text, ', ', ' «b» '), '. ', ':  ') ELSE replace(text, '. ', '  ') END"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.blocks(spark, sf_dir).withColumn("text", F.expr(MARKED))


def queries() -> dict:
    return {
        "beautified_fold": lambda spark, sf: beautified(marked(spark, sf)),
        "same_meaning": lambda spark, sf: same_meaning(beautified(marked(spark, sf))),
        "typography_edits": lambda spark, sf: edits(marked(spark, sf)).select("doc_id", "ord", F.explode("edits").alias("e")).select("doc_id", "ord", "e.start", "e.end", "e.replacement"),
    }


def _marked_ctes() -> str:
    """Written over single characters: which stands at each place, and what stands around it."""
    from proofline.functions.text import PROTECTED, SPACE

    gap = f"[{SPACE}]"
    return rf"""{source.SQL.replace("blocks AS", "plain AS")}, blocks AS (SELECT doc_id, ord, {MARKED} AS text FROM plain),
    t AS (SELECT doc_id, ord, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, ord, regexp_extract_all(text, ' +|[;:!?«»]|[^ ;:!?«»]+') AS p FROM blocks)),
    q AS (SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s, lag(part) OVER w AS pre, lead(part) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY doc_id, ord ORDER BY i)),
    c AS (
      SELECT doc_id, ord, s, s + length(part) AS e, chr(160) AS r FROM q WHERE regexp_matches(part, '^ +$') AND regexp_matches(right(pre, 1), '\S') AND regexp_matches(left(nxt, 1), '[;:!?»]') AND part <> chr(160)
      UNION SELECT doc_id, ord, s - 1, s + 1, right(pre, 1) || chr(160) || part FROM q WHERE part IN (';', '!', '?') AND regexp_matches(pre, '\p{{L}}$') AND (nxt IS NULL OR regexp_matches(nxt, '^[\s»]'))
      UNION SELECT doc_id, ord, s - 1, s + 1, right(pre, 1) || chr(160) || part FROM q WHERE part = ':' AND regexp_matches(pre, '\p{{L}}$') AND regexp_matches(nxt, '^\s')
      UNION SELECT doc_id, ord, s - 1, s + length(part), '«' || chr(160) FROM q WHERE regexp_matches(part, '^ +$') AND pre = '«' AND regexp_matches(left(nxt, 1), '\S')
      UNION SELECT doc_id, ord, s, s + 2, '«' || chr(160) || left(nxt, 1) FROM q WHERE part = '«' AND regexp_matches(left(nxt, 1), '[^\s\x{{00A0}}\x{{202F}}]')
      UNION SELECT doc_id, ord, s - 1, s + 1, right(pre, 1) || chr(160) || '»' FROM q WHERE part = '»' AND regexp_matches(right(pre, 1), '[^\s\x{{00A0}}\x{{202F}}«]')
      UNION SELECT doc_id, ord, s, s + length(part), ' ' FROM q WHERE regexp_matches(part, '^ {{2,}}$') AND regexp_matches(right(pre, 1), '\S') AND regexp_matches(left(nxt, 1), '[^\s;:!?»]')),
    f AS (SELECT c.*, text FROM c JOIN blocks USING (doc_id, ord) WHERE NOT regexp_matches(regexp_extract(left(text, c.s), '[^{SPACE}]*$') || substring(text, c.s + 1, c.e - c.s) || regexp_extract(substring(text, c.e + 1), '^[^{SPACE}]*'), '{PROTECTED}')),
    l AS (SELECT doc_id, ord, list([{{'s': s, 'e': e, 'r': r}}] ORDER BY s, e, r) AS l FROM f GROUP BY doc_id, ord),
    k AS (SELECT doc_id, ord, list_reduce(l, lambda a, x: CASE WHEN x[1].s < a[len(a)].e THEN a ELSE list_concat(a, x) END) AS l FROM l),
    edits AS (SELECT doc_id, ord, u.s AS start, u.e AS "end", u.r AS replacement FROM (SELECT doc_id, ord, unnest(l) AS u FROM k))"""


def oracle_sql() -> dict[str, str]:
    return {
        "beautified_fold": f"""WITH {_marked_ctes()}, w AS (SELECT e.*, coalesce(lag("end") OVER v, 0) AS before, lead(start) OVER v IS NULL AS last FROM edits e WINDOW v AS (PARTITION BY doc_id, ord ORDER BY start))
          SELECT w.doc_id, w.ord, any_value(text) AS before, string_agg(substring(text, CAST(w.before + 1 AS BIGINT), CAST(start - w.before AS BIGINT)) || replacement || CASE WHEN last THEN substring(text, CAST("end" + 1 AS BIGINT)) ELSE '' END, '' ORDER BY start) AS after, CAST(count(*) AS INT) AS n_edits
          FROM w JOIN blocks b ON b.doc_id = w.doc_id AND b.ord = w.ord GROUP BY w.doc_id, w.ord""",
        "typography_edits": f"""WITH {_marked_ctes()} SELECT doc_id, ord, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", replacement FROM edits""",
        "same_meaning": f"""WITH {_marked_ctes()} SELECT doc_id, count(DISTINCT ord) AS n_blocks, count(*) AS n_edits, true AS same FROM edits GROUP BY doc_id""",
    }
