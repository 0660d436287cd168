"""Strict validation of nested JSON answers: the path and kind of the first violation of each row, null if there is none.

A schema is a small tree; it becomes one expression over a VARIANT, so rows are checked where they are, without Python. A key too few or too many, a wrong type, a value that is
not among those allowed, and texts or lists over their limits are violations. Lists are checked for their length before their items, objects for their fields in order before unknown keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import model


@dataclass(frozen=True)
class Text:
    most: int
    least: int = 0
    nullable: bool = False


@dataclass(frozen=True)
class Choice:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Listing:
    item: Text | Choice | Record
    most: int


@dataclass(frozen=True)
class Record:
    fields: dict[str, Text | Choice | Listing | Record]


Schema = Text | Choice | Listing | Record

# What answers look like, by the step that they are for.
SEVERITY, CONFIDENCE, BLOCK_ID, EXPLANATION = Choice(("minor", "major", "critical")), Choice(("high", "medium", "low")), Text(20), Text(400, 1)
LOCAL_SUBTYPES = tuple(s for c in ("spelling", "grammar", "punctuation", "style") for s in model.SUBTYPES[c])
CONTEXT_SUBTYPES = ("local_repetition", "tense_shift", "terminology_variant", "weak_transition", "incomplete_paragraph", "heading_wording")
GLOBAL_SUBTYPES = ("contradiction", "naming_inconsistency", "tense_shift", "global_repetition", "possibly_missing_section", "unbalanced_section")


def issue(categories: tuple[str, ...], subtypes: tuple[str, ...]) -> Record:
    return Record({"blockId": BLOCK_ID, "category": Choice(categories), "subtype": Choice(subtypes), "original": Text(300, 1), "suggestion": Text(600, nullable=True), "explanation": EXPLANATION, "severity": SEVERITY, "confidence": CONFIDENCE})


FACT = Record({"subject": Text(120), "value": Text(200), "blockId": BLOCK_ID})
DIGEST = Record({"summary": Text(600), "keyFacts": Listing(FACT, 12), "terms": Listing(Text(80), 20), "dominantTense": Choice(("present", "past", "future", "mixed"))})
REMARK = Record({"category": Choice(("coherence", "structure")), "subtype": Choice(GLOBAL_SUBTYPES), "blockId": BLOCK_ID, "relatedBlockIds": Listing(BLOCK_ID, 5), "explanation": EXPLANATION, "severity": SEVERITY, "confidence": CONFIDENCE})
DECISION = Record({"caseId": Text(10), "decision": Choice(("correct", "keep", "verify")), "correction": Text(120, nullable=True), "justification": Text(200), "confidence": CONFIDENCE})
SCHEMAS: dict[str, Record] = {
    "local": Record({"issues": Listing(issue(("spelling", "grammar", "punctuation", "style"), LOCAL_SUBTYPES), 40)}),
    "context": Record({"issues": Listing(issue(("style", "coherence", "structure"), CONTEXT_SUBTYPES), 15), "digest": DIGEST}),
    "global": Record({"issues": Listing(REMARK, 15)}),
    "verify": Record({"verdict": Choice(("contradictory", "compatible", "uncertain")), "excerptA": Text(300), "excerptB": Text(300), "explanation": EXPLANATION}),
    "ambiguity": Record({"decisions": Listing(DECISION, 60)}),
}


def violation(schema: Schema, value: Column, path: Column) -> Column:
    """``path: kind`` of the first violation of a VARIANT, null if it is as the schema says."""
    kind = F.schema_of_variant(value)
    said = lambda what, at=path: F.concat(at, F.lit(f": {what}"))
    if isinstance(schema, Text | Choice):
        text = F.try_variant_get(value, "$", "string")
        wrong = F.when(kind != "STRING", said("type"))
        if isinstance(schema, Choice):
            return wrong.when(~text.isin(*schema.values), said("value"))
        limits = wrong.when(F.length(text) > schema.most, said("too_long")).when(F.length(text) < schema.least, said("too_short"))
        return F.when(kind != "VOID", limits) if schema.nullable else limits
    if isinstance(schema, Listing):
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.transform(items, lambda x, i: violation(schema.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(~kind.startswith("ARRAY"), said("type")).when(F.size(items) > schema.most, said("too_many")).otherwise(first(inner))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    at = lambda key: F.concat(path, F.lit("." + key))
    inner = [F.when(~F.map_contains_key(fields, key), said("missing", at(key))).otherwise(violation(own, F.try_element_at(fields, F.lit(key)), at(key))) for key, own in schema.fields.items()]
    unknown = F.array_min(F.array_except(F.map_keys(fields), F.array(*map(F.lit, schema.fields))))
    return F.when(~kind.startswith("OBJECT"), said("type")).otherwise(F.coalesce(*inner, F.concat(path, F.lit("."), unknown, F.lit(": unknown"))))


def first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def checked(answers: DataFrame) -> DataFrame:
    """Answers (step, answer, ...) with ``violation``; what is no JSON is one, too."""
    rows = answers.withColumn("v", F.try_parse_json("answer"))
    found = F.when(F.col("v").isNull(), F.lit("$: json"))
    for step, schema in SCHEMAS.items():
        found = found.when(F.col("step") == step, violation(schema, F.col("v"), F.lit("$")))
    return rows.withColumn("violation", found.otherwise(F.lit("$: step"))).drop("v")


def listed(part: str, n: str, joint: str = ",") -> str:
    return f"concat('[', {part}, repeat(concat('{joint}', {part}), CAST({n} AS INT)), ']')"


#: For both engines: an answer to every event, of a step by its type, put together from its properties; and faults of all kinds by its number.
STEP = "CASE event_type WHEN 'signup' THEN 'local' WHEN 'view' THEN 'context' WHEN 'error' THEN 'global' WHEN 'purchase' THEN 'verify' WHEN 'click' THEN 'ambiguity' ELSE 'other' END"
_TAIL = '"explanation":"because","severity":"minor","confidence":"low"}'
_ISSUE = """concat('{"blockId":"b', event_id % 97, '","category":"style","subtype":"local_repetition","original":"w","suggestion":null,""" + _TAIL + "')"
_REMARK = """concat('{"category":"coherence","subtype":"contradiction","blockId":"b', event_id % 97, '","relatedBlockIds":["b1","b2"],""" + _TAIL + "')"
_DECISION = """'{"caseId":"c1","decision":"keep","correction":null,"justification":"so","confidence":"low"}'"""
RAW = f"""CASE event_type WHEN 'signup' THEN concat('{{"issues":', {listed(_ISSUE, "event_id % 45")}, '}}') WHEN 'view' THEN concat('{{"issues":', {listed(_ISSUE, "event_id % 3")}, ',"digest":{{"summary":"s","keyFacts":[{{"subject":"s","value":"v","blockId":"b1"}}],"terms":["t","u"],"dominantTense":"past"}}}}')
  WHEN 'error' THEN concat('{{"issues":', {listed(_REMARK, "event_id % 17")}, '}}') WHEN 'purchase' THEN '{{"verdict":"uncertain","excerptA":"a","excerptB":"b","explanation":"because"}}' ELSE concat('{{"decisions":', {listed(_DECISION, "event_id % 63")}, '}}') END"""
FAULTS = {
    1: ('"confidence":"low"', '"confidence":"none"'), 2: (',"confidence":"low"', ""), 3: ('"because"', '""'), 4: ('"minor"', "3"), 5: ("null", "7"), 6: ('"w"', '"' + "w" * 301 + '"'), 7: ('"low"}', '"low","more":1}'), 8: ("}", ""), 9: ('"past"', '"later"'),
    10: ('["b1","b2"]', '["b1",2]'), 11: ('["t","u"]', '{"t":1}'), 12: ('"uncertain"', "null"), 13: ('"keep"', "true"), 14: ('"c1"', '"c1234567890"'), 15: ('"because"', "null"), 16: ('{"subject":"s",', "{"), 17: ('"b"', "[]"), 18: ("}", ',"zz":0}'),
}
ANSWER = "CASE event_id % 23 " + " ".join(f"WHEN {k} THEN replace(raw, '{a}', '{b}')" for k, (a, b) in FAULTS.items()) + " ELSE raw END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return events.select("event_id", F.expr(STEP).alias("step"), F.expr(RAW).alias("raw")).select("event_id", "step", F.expr(ANSWER).alias("answer"))


def queries() -> dict:
    return {"answer_violations": lambda spark, sf: checked(answers(spark, sf)).select("event_id", "step", "violation")}


def _sql(schema: Schema, value: str, path: str, depth: int = 0) -> str:
    """The same in DuckDB, over its own types of JSON values and paths."""
    said = lambda what: f"{path} || ': {what}'"
    if isinstance(schema, Text | Choice):
        text = f"json_extract_string({value}, '$')"
        body = f"WHEN json_type({value}) <> 'VARCHAR' THEN {said('type')} "
        if isinstance(schema, Choice):
            return f"CASE {body} WHEN {text} NOT IN ({', '.join(repr(v) for v in schema.values)}) THEN {said('value')} END"
        return f"CASE {f'''WHEN json_type({value}) = 'NULL' THEN NULL''' if schema.nullable else ''} {body} WHEN length({text}) > {schema.most} THEN {said('too_long')} WHEN length({text}) < {schema.least} THEN {said('too_short')} END"
    if isinstance(schema, Listing):
        x, i = f"x{depth}", f"i{depth}"
        inner = _sql(schema.item, x, f"{path} || '[' || ({i} - 1) || ']'", depth + 1)
        return f"CASE WHEN json_type({value}) <> 'ARRAY' THEN {said('type')} WHEN json_array_length({value}) > {schema.most} THEN {said('too_many')} ELSE list_filter(list_transform(CAST({value} AS JSON[]), lambda {x}, {i}: {inner}), lambda f{depth}: f{depth} IS NOT NULL)[1] END"
    parts = [f"CASE WHEN json_extract({value}, '$.{k}') IS NULL THEN {path} || '.{k}: missing' ELSE {_sql(own, f'''json_extract({value}, '$.{k}')''', f"{path} || '.{k}'", depth)} END" for k, own in schema.fields.items()]
    keys = "[" + ", ".join(f"'{k}'" for k in schema.fields) + "]"
    unknown = f"{path} || '.' || list_min(list_filter(json_keys({value}), lambda k{depth}: NOT list_contains({keys}, k{depth}))) || ': unknown'"
    return f"CASE WHEN json_type({value}) <> 'OBJECT' THEN {said('type')} ELSE coalesce({', '.join(parts)}, {unknown}) END"


def oracle_sql() -> dict[str, str]:
    steps = " ".join(f"WHEN step = '{step}' THEN {_sql(schema, 'j', repr('$'))}" for step, schema in SCHEMAS.items())
    return {
        "answer_violations": f"""WITH r AS (SELECT event_id, {STEP} AS step, {RAW} AS raw, event_type FROM events), a AS (SELECT event_id, step, {ANSWER} AS answer FROM r),
        p AS (SELECT *, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM a) SELECT event_id, step, CASE WHEN j IS NULL THEN '$: json' {steps} ELSE '$: step' END AS violation FROM p"""
    }
