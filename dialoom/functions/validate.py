"""Checking and repairing model output: block summaries as JSON text, normalized lines against their input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import fixed, text
from dialoom.functions.text import let

STATUSES = ["open", "in_progress", "done"]
ROLES = ["reported", "asked", "proposed", "clarified"]
ACTION_T = "array<struct<owner:string,task:string,status:string>>"
INSIGHT_T = "array<struct<speaker:string,role_in_block:string,detail:string>>"
FACT_T = "array<struct<type:string,value:string>>"


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _shape(v: Column) -> Column:
    """ARRAY, OBJECT, STRING, … (null for a missing value)."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _elements(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _clean(c: Column) -> Column:
    return text.cleanup_repeats(text.squeeze(c))


def _is_object(v: Column) -> Column:
    return F.coalesce(_shape(v) == "OBJECT", F.lit(False))


def _first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def block_summary(raw: Column, block_id: Column) -> Column:
    """struct of the repaired block summary and `severe` (nothing usable) from a model's answer."""

    def build(v: Column) -> Column:
        ok = _is_object(v)
        part = lambda p: F.try_variant_get(v, p, "variant")
        kind = F.when(_at(v, "$.segment_type").isin(fixed.SEGMENT_TYPES), _at(v, "$.segment_type")).otherwise("other")
        ov = part("$.overview")
        scalar = lambda x: _shape(x).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN")
        overview = (F.when(_shape(ov) == "STRING", _at(v, "$.overview"))
                    .when(_shape(ov) == "ARRAY", F.array_join(F.transform(F.filter(_elements(ov), scalar), lambda x: _at(x, "$")), " "))
                    .otherwise(""))
        kp = part("$.key_points")
        kps = F.when(_shape(kp) == "ARRAY", _elements(kp)).when(kp.isNotNull(), F.array(kp)).otherwise(F.array().cast("array<variant>"))
        points = F.slice(F.filter(F.transform(kps, lambda x: _clean(F.when(
            _is_object(x), _first_truthy(_at(x, "$.text"), _at(x, "$.content"), _at(x, "$.detail"))).otherwise(_at(x, "$")))),
            lambda s: s != ""), 1, 5)
        acts = F.transform(F.filter(_elements(part("$.action_items")), _is_object), lambda x: F.struct(
            _at(x, "$.owner").alias("owner"), _clean(_at(x, "$.task")).alias("task"),
            F.when(_at(x, "$.status").isin(STATUSES), _at(x, "$.status")).otherwise("open").alias("status")))
        acts = F.filter(acts, lambda a: a["task"] != "").cast(ACTION_T)
        ins = part("$.speaker_insights")
        listed = F.transform(F.filter(_elements(ins), _is_object), lambda x: F.struct(
            _clean(_at(x, "$.speaker")).alias("speaker"),
            F.when(_at(x, "$.role_in_block").isin(ROLES), _at(x, "$.role_in_block")).otherwise("reported").alias("role_in_block"),
            _clean(_at(x, "$.detail")).alias("detail")))
        mapped = F.transform(F.map_entries(F.try_variant_get(ins, "$", "map<string,string>")), lambda e: F.struct(
            _clean(e["key"]).alias("speaker"), F.lit("reported").alias("role_in_block"), _clean(e["value"]).alias("detail")))
        people = F.filter(F.when(_is_object(ins), mapped.cast(INSIGHT_T)).otherwise(listed.cast(INSIGHT_T)),
                          lambda p: (p["speaker"] != "") & (p["detail"] != ""))
        facts = F.transform(_elements(part("$.facts")), lambda x: F.when(_is_object(x), F.struct(
            F.coalesce(_at(x, "$.type"), F.lit("tool")).alias("type"), _clean(_at(x, "$.value")).alias("value")))
            .otherwise(F.struct(F.lit("tool").alias("type"), _clean(_at(x, "$")).alias("value"))))
        facts = F.slice(F.filter(facts, lambda f: f["value"] != ""), 1, 8).cast(FACT_T)
        made = _overview_from_fields(kind, points, facts, acts)
        over = let(_clean(overview), lambda o: F.when(o != "", o).otherwise(made))
        none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
        return F.struct(block_id.alias("block_id"), kind.alias("segment_type"), over.alias("overview"), points.alias("key_points"),
                        acts.alias("action_items"), people.alias("speaker_insights"), facts.alias("facts"),
                        (~ok | ((over == "") & none(points) & none(facts) & none(acts) & none(people))).alias("severe"))

    return let(F.try_parse_json(text.unfence_json(raw)), build)


def _overview_from_fields(kind: Column, points: Column, facts: Column, acts: Column) -> Column:
    tags = F.array_join(F.transform(facts, lambda f: f["value"]), " ")
    tasks = F.array_join(F.transform(acts, lambda a: a["task"]), " ")
    return (F.when(F.size(points) > 0, F.get(points, F.lit(0)))
            .when(F.size(facts) > 0, text.type_overview(kind, text.tech_tags(tags)))
            .when(F.size(acts) > 0, text.type_overview(kind, text.tech_tags(tasks))).otherwise(""))


def lines_match(out: Column, inp: Column, tol_ms: int = 110) -> Column:
    """Same number of lines, each with both edges within the tolerance and the same speaker."""
    near = lambda a, b: F.coalesce(F.abs(a - b) <= tol_ms, F.lit(False))
    ok = F.zip_with(out, inp, lambda o, i: near(o["start_ms"], i["start_ms"]) & near(o["end_ms"], i["end_ms"])
                    & F.coalesce(o["speaker"] == i["speaker"], F.lit(False)))
    return F.when(F.size(out) != F.size(inp), F.lit(False)).otherwise(F.forall(ok, lambda x: x))
