"""Edits carried out on the segments that a block's text is made of: only plain text, only neighbours of the same format.

Edits meet segments by an interval join on stretches of a block, so a long block with many of both is no product of them. What an edit touches is gathered with it, a few
segments; the reasons are looked for there, and the new text of a segment is a fold over the cuts that the edits make in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import edits as block_edits
from proofline.operators import rules
from proofline.sources import text as source

#: Characters of a stretch by which edits and segments meet.
STRETCH = 64
KEYS = ["doc_id", "ord"]
FIELDS = ["seg", "start", "end", "kind", "run", "container", "format", "field", "control", "tracked", "gap_before"]


def touching(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """Every edit with the segments that it overlaps or touches, in order: ``near``."""

    def stretches(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / STRETCH), F.floor(end / STRETCH))

    left = edits.withColumn("stretch", F.explode(stretches(F.col("start"), F.col("stop"))))
    right = segments.select(*KEYS, F.struct(*FIELDS).alias("s"), F.explode(stretches(F.col("start"), F.col("end"))).alias("stretch"))
    met = left.join(right, [*KEYS, "stretch"]).where((F.col("s.start") <= F.col("stop")) & (F.col("s.end") >= F.col("start")))
    met = met.where(F.col("stretch") == F.greatest(F.floor(F.col("start") / STRETCH), F.floor(F.col("s.start") / STRETCH)))  # a pair meets in each stretch of both; the first counts
    gathered = met.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("near"))
    return edits.join(gathered, "id", "left").withColumn("near", F.coalesce("near", F.array().cast(gathered.schema["near"].dataType)))


def joined(left: Column, right: Column) -> Column:
    """Why two neighbouring segments can't take one edit, null if they can."""
    apart = (left["container"] != right["container"]) | right["gap_before"] | (right["seg"] != left["seg"] + 1)
    return F.when(left["run"] == right["run"], F.when(right["gap_before"] | (right["seg"] != left["seg"] + 1), "non_adjacent")).when(apart, "non_adjacent").when(~left["format"].eqNullSafe(right["format"]), "format_boundary")


def first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def placed(edits: DataFrame) -> DataFrame:
    """Edits with ``near`` to those with ``covered``, the segments that they change, and ``refused``, the reason why they don't (null if they do)."""
    start, stop, hollow = F.col("start"), F.col("stop"), F.col("start") == F.col("stop")
    inside = F.filter("near", lambda s: (s["start"] < start) & (start < s["end"]))
    before = F.filter("near", lambda s: (s["end"] == start) & (s["kind"] == "text"))
    behind = F.filter("near", lambda s: s["start"] == start)
    receiver = F.slice(F.when(F.size(inside) > 0, inside).when(F.size(before) > 0, before).otherwise(behind), 1, 1)
    covered = F.when(hollow, receiver).otherwise(F.filter("near", lambda s: (s["start"] < stop) & (s["end"] > start)))
    rows = edits.withColumns({"covered": covered, "before": F.get(before, F.lit(0)), "behind": F.get(behind, F.lit(0))})
    own = lambda s: F.when(s["kind"] != "text", "not_plain_text").when(s["field"], "field").when(s["control"], "content_control").when(s["tracked"], "tracked_change")
    pairs = F.when(F.size("covered") > 1, F.transform(F.sequence(F.lit(1), F.size("covered") - 1), lambda k: joined(F.get("covered", k - 1), F.get("covered", k))))
    style = F.when(hollow & F.col("before").isNotNull() & F.col("behind").isNotNull(), joined(F.col("before"), F.col("behind")))
    refused = F.coalesce(F.when(F.size("covered") == 0, "anchor_mismatch"), first(F.transform("covered", own)), first(pairs), style)
    return rows.withColumn("refused", refused).drop("near", "before", "behind")


def cuts(edits: DataFrame) -> DataFrame:
    """What each edit does to each of its segments: (doc_id, ord, seg, from, to, new), places within the segment. The replacement goes into the first one."""
    rows = edits.where("refused IS NULL").select(*KEYS, "id", "start", "stop", "replacement", F.posexplode("covered").alias("k", "s"))
    inner = lambda x, s: F.least(F.greatest(x, s["start"]), s["end"]) - s["start"]
    return rows.select(*KEYS, "id", F.col("s.seg").alias("seg"), inner(F.col("start"), F.col("s")).alias("from"), inner(F.col("stop"), F.col("s")).alias("to"), F.when(F.col("k") == 0, F.col("replacement")).otherwise(F.lit("")).alias("new"))


def changed(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for every changed segment with its text, and one for every refused edit with the reason: doc_id, ord, seg, id, text, refused.

    Edits of a block don't overlap (``edits.apart``). Cuts in a segment are made from its end to its beginning, so places stay right.
    """
    done = placed(touching(edits, segments))
    lists = cuts(done).groupBy(*KEYS, "seg").agg(F.array_sort(F.collect_list(F.struct("from", "to", "id", "new"))).alias("cuts"))
    text = F.aggregate(F.reverse("cuts"), F.col("text"), lambda t, c: F.concat(F.substr(t, F.lit(1), c["from"]), c["new"], F.substr(t, c["to"] + 1, F.length(t))))
    none = F.lit(None)
    new = segments.join(lists, [*KEYS, "seg"]).select(*KEYS, "seg", none.cast("long").alias("id"), text.alias("text"), none.cast("string").alias("refused"))
    return new.union(done.where("refused IS NOT NULL").select(*KEYS, none.cast("int"), "id", none.cast("string"), "refused"))


#: For both engines: segments of WIDTH characters, with every reason there is among them by arithmetic, and edits of repeated words, a third of them insertions.
WIDTH = 23
SEGMENT = {
    "kind": "CASE WHEN (doc_id + seg) % 17 = 0 THEN 'tab' ELSE 'text' END", "run": "CAST(floor(seg / 2) AS INT)", "container": "CAST(floor(seg / 12) AS INT)", "format": "CASE floor(seg / 4) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'bold' ELSE 'italic' END",
    "field": "seg % 29 = 5", "control": "seg % 31 = 7", "tracked": "seg % 37 = 11", "gap_before": "seg % 19 = 3",
}
STOP = 'CASE WHEN start % 3 = 0 THEN start ELSE "end" END'
REPLACEMENT = "CASE WHEN start % 5 = 0 THEN '' ELSE suggestion END"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edits that don't overlap, and segments."""
    blocks = source.blocks(spark, sf_dir)
    cut = blocks.select(*KEYS, "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / WIDTH).cast("int"))).alias("seg"))
    placed = cut.select(*KEYS, "seg", (F.col("seg") * WIDTH).alias("start"), F.least((F.col("seg") + 1) * WIDTH, F.length("text")).alias("end"), F.substr("text", F.col("seg") * WIDTH + 1, F.lit(WIDTH)).alias("text"))
    segments = placed.withColumns({c: F.expr(e) for c, e in SEGMENT.items()})
    hits = rules.repeated_word(blocks)
    made = hits.select("doc_id", "ord", ((F.col("doc_id") * 10000 + F.col("ord")) * 100000 + F.col("start")).alias("id"), "start", F.expr(STOP.replace('"', "`")).alias("stop"), F.expr(REPLACEMENT).alias("replacement"))
    kept = block_edits.apart(made.withColumn("reason", F.lit(None).cast("string"))).select(F.explode("kept").alias("id"))
    return made.join(kept, "id", "left_semi"), segments


def queries() -> dict:
    return {"segment_edits": lambda spark, sf: changed(*tables(spark, sf))}


def oracle_sql() -> dict[str, str]:
    """Pairs of edits and segments by their places alone; texts put together from what stands between the cuts."""
    join = """CASE WHEN a.run = b.run THEN CASE WHEN b.gap_before OR b.seg <> a.seg + 1 THEN 'non_adjacent' END WHEN a.container <> b.container OR b.gap_before OR b.seg <> a.seg + 1 THEN 'non_adjacent' WHEN a.format IS DISTINCT FROM b.format THEN 'format_boundary' END"""
    columns = ", ".join(f"{e} AS {c}" for c, e in SEGMENT.items())
    return {
        "segment_edits": f"""WITH {source.SQL}, r AS (SELECT doc_id, ord, (doc_id * 10000 + ord) * 100000 + start AS id, start, {STOP} AS stop, {REPLACEMENT} AS replacement, NULL AS reason FROM ({rules.repeated_word_sql()})),
        {block_edits.KEPT_SQL}, ed AS (SELECT * FROM r WHERE id IN (SELECT id FROM kept)),
        s0 AS (SELECT doc_id, ord, text, unnest(range(0, CAST((length(text) - 1) // {WIDTH} + 1 AS BIGINT))) AS seg FROM blocks),
        s AS (SELECT doc_id, ord, CAST(seg AS INT) AS seg, seg * {WIDTH} AS a, least((seg + 1) * {WIDTH}, length(text)) AS z, substring(text, seg * {WIDTH} + 1, {WIDTH}) AS text, {columns} FROM s0),
        near AS (SELECT e.id, e.start, e.stop, e.replacement, s.* FROM ed e JOIN s ON s.doc_id = e.doc_id AND s.ord = e.ord AND s.a <= e.stop AND s.z >= e.start),
        pick AS (SELECT *, CASE WHEN start < stop THEN CASE WHEN a < stop AND z > start THEN 0 END WHEN a < start AND start < z THEN 1 WHEN z = start AND kind = 'text' THEN 2 WHEN a = start THEN 3 END AS rank FROM near),
        cov AS (SELECT * FROM pick WHERE rank IS NOT NULL QUALIFY rank = 0 OR row_number() OVER (PARTITION BY id ORDER BY rank, seg) = 1),
        own AS (SELECT id, arg_min(why, seg) FILTER (why IS NOT NULL) AS why FROM (SELECT id, seg, CASE WHEN kind <> 'text' THEN 'not_plain_text' WHEN field THEN 'field' WHEN control THEN 'content_control' WHEN tracked THEN 'tracked_change' END AS why FROM cov) GROUP BY id),
        pair AS (SELECT id, arg_min(why, seg) FILTER (why IS NOT NULL) AS why FROM (SELECT b.id, b.seg, {join} AS why FROM cov b JOIN cov a ON a.id = b.id AND a.seg = (SELECT max(c.seg) FROM cov c WHERE c.id = b.id AND c.seg < b.seg)) GROUP BY id),
        sty AS (SELECT b.id, {join} AS why FROM near a JOIN near b ON a.id = b.id AND a.z = a.start AND a.kind = 'text' AND b.a = b.start AND a.start = a.stop),
        res AS (SELECT ed.*, CASE WHEN own.id IS NULL THEN 'anchor_mismatch' ELSE coalesce(own.why, pair.why, sty.why) END AS refused FROM ed LEFT JOIN own USING (id) LEFT JOIN pair USING (id) LEFT JOIN sty USING (id)),
        cut AS (SELECT c.doc_id, c.ord, c.seg, c.text, c.id, greatest(0, c.start - a) AS f, least(z, c.stop) - a AS t, CASE WHEN c.seg = min(c.seg) OVER (PARTITION BY c.id) THEN c.replacement ELSE '' END AS new FROM cov c JOIN res USING (id) WHERE refused IS NULL),
        o AS (SELECT *, coalesce(lag(t) OVER w, 0) AS before, row_number() OVER w = count(*) OVER (PARTITION BY doc_id, ord, seg) AS last FROM cut WINDOW w AS (PARTITION BY doc_id, ord, seg ORDER BY f, t, id))
        SELECT doc_id, ord, seg, CAST(NULL AS BIGINT) AS id, string_agg(substring(text, CAST(before + 1 AS BIGINT), CAST(f - before AS BIGINT)) || new || CASE WHEN last THEN substring(text, CAST(t + 1 AS BIGINT)) ELSE '' END, '' ORDER BY f, t, id) AS text, NULL AS refused FROM o GROUP BY doc_id, ord, seg
        UNION ALL SELECT doc_id, ord, NULL, id, NULL, refused FROM res WHERE refused IS NOT NULL""",
    }
