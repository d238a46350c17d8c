"""Repair and parsing of JSON text written by a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from avsync.functions.text import bound

TEXT_FIELDS = ["layout", "text_readout", "spatial_map", "colors_styles"]


def strip_fences(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?U)```(?:json)?\s*\n?", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)```\s*\n?", ""), r"(?U)^\s+|\s+$", "")


def drop_trailing_commas(text: Column, lists: bool = False) -> Column:
    text = F.regexp_replace(text, r"(?U),\s*\}", "}")
    return F.regexp_replace(text, r"(?U),\s*\]", "]") if lists else text


def outermost_braces(text: Column) -> Column:
    """From the first { to the last }; NULL if there is no such part."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _object(text: Column) -> Column:
    """VARIANT of a JSON object, NULL for anything else."""
    return F.when(text.rlike(r"(?s)^\s*\{"), F.try_parse_json(text))


def _bound(clean: Column, make: Callable[[Column, Column], Column], obj: Column | None = None) -> Column:
    """``make(clean text, object)`` with both worked out once per row."""
    pair = F.struct(clean.alias("text"), (_object(clean) if obj is None else obj).alias("obj"))
    return bound(pair, lambda p: make(p["text"], p["obj"]))


def _has(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "variant").isNotNull()


def _get(obj: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(obj, f"$.{key}", kind)


def _null_word(value: Column) -> Column:
    return F.nullif(value, F.lit("null"))


def parse_model_json(text: Column, policy: str = "strict", content_type: Column | None = None) -> Column:
    """Struct of a model's JSON answer, defaults filled in; a fallback row if it is beyond repair.

    ``strict`` strips fences and trailing commas. ``braces`` takes the outermost braces and
    falls back to an error row with the asked ``content_type``. ``retry`` is strict first,
    then braces, for the element-list form of the answer.
    """
    if policy == "strict":
        return _strict(text)
    asked = F.lit("unknown") if content_type is None else content_type
    if policy == "braces":
        return _braces(text, asked)
    if policy == "retry":
        return _retry(text, asked)
    raise ValueError(f"unknown policy {policy}")


def _answer(ok, obj, content_type, detected, structural, hints, texts, missing, error) -> Column:
    no_list = F.array().cast("array<string>")
    empty = F.parse_json(F.lit("{}"))
    return F.struct(
        ok.alias("parsed"),
        content_type.alias("content_type"),
        detected.alias("detected_types"),
        F.when(ok & _has(obj, "visual_analysis"), F.try_variant_get(obj, "$.visual_analysis", "variant"))
        .otherwise(empty)
        .alias("visual_analysis"),
        structural.alias("structural_description"),
        F.when(ok & _has(obj, "reading_order"), _get(obj, "reading_order", "array<string>"))
        .otherwise(no_list)
        .alias("reading_order"),
        hints.alias("conceptual_hints"),
        *[t.alias(n) for n, t in texts.items()],
        missing.alias("missing_elements"),
        error.alias("_error"),
    )


def _or_default(obj: Column, key: str, default: Column) -> Column:
    return F.when(_has(obj, key), _get(obj, key)).otherwise(default)


def _strict(text: Column) -> Column:
    return _bound(drop_trailing_commas(strip_fences(text)), _strict_answer)


def _strict_answer(clean: Column, obj: Column) -> Column:
    ok = obj.isNotNull()
    listed = _get(obj, "detected_types", "array<string>")
    some = F.coalesce(F.size(listed) > 0, F.lit(False))
    kind = _or_default(obj, "content_type", F.when(some, F.get(listed, F.lit(0))).otherwise("unknown"))
    kind = F.when(ok, kind).otherwise("unknown")
    return _answer(
        ok,
        obj,
        kind,
        F.when(some, listed).otherwise(F.array(kind)),
        F.when(ok, _or_default(obj, "structural_description", _or_default(obj, "layout", F.lit("")))).otherwise(clean),
        F.when(ok, _or_default(obj, "conceptual_hints", F.lit(""))).otherwise(""),
        {n: F.when(ok, _or_default(obj, n, F.lit(""))).otherwise(clean) for n in TEXT_FIELDS},
        F.when(ok, _null_word(_get(obj, "missing_elements"))).otherwise("Parse error"),
        F.lit(None).cast("string"),
    )


def _braces(text: Column, asked: Column) -> Column:
    clean = drop_trailing_commas(F.coalesce(outermost_braces(text), text), lists=True)
    return _bound(clean, lambda _, obj: _braces_answer(text, obj, asked))


def _braces_answer(text: Column, obj: Column, asked: Column) -> Column:
    ok = obj.isNotNull()
    raw = F.coalesce(F.nullif(text, F.lit("")), F.lit("JSON parse error"))
    listed = F.when(_has(obj, "detected_types"), _get(obj, "detected_types", "array<string>"))
    texts = {n: F.when(ok, _or_default(obj, n, F.lit(""))).otherwise("") for n in TEXT_FIELDS}
    for n in ("layout", "text_readout"):
        texts[n] = F.when(ok, _or_default(obj, n, F.lit(""))).otherwise(raw)
    return _answer(
        ok,
        obj,
        F.when(ok, _or_default(obj, "content_type", asked)).otherwise(asked),
        F.coalesce(listed, F.array(asked)),
        F.when(ok, _or_default(obj, "structural_description", F.lit(""))).otherwise("Error: JSON parse error"),
        F.when(ok, _or_default(obj, "conceptual_hints", F.lit(""))).otherwise(""),
        texts,
        F.when(ok, _null_word(_get(obj, "missing_elements"))),
        F.when(~ok, "JSON parse error"),
    )


def _retry(text: Column, asked: Column) -> Column:
    clean = drop_trailing_commas(strip_fences(text))
    obj = F.coalesce(_object(clean), _object(outermost_braces(clean)))
    return _bound(clean, lambda _, o: _retry_answer(text, o, asked), obj)


def _retry_answer(text: Column, obj: Column, asked: Column) -> Column:
    ok = obj.isNotNull()
    none = F.array().cast("array<string>")

    def field(name: str, fallback: Column) -> Column:
        return F.when(ok, _or_default(obj, name, F.lit(f"[MISSING: {name}]"))).otherwise(fallback)

    elements = F.when(
        ok,
        F.coalesce(
            _get(obj, "elements_found", "array<string>"),
            F.array(_or_default(obj, "elements_found", F.lit("[MISSING: elements_found]"))),
        ),
    ).otherwise(none)
    return F.struct(
        ok.alias("parsed"),
        field("visual_structure", text).alias("visual_structure"),
        elements.alias("elements_found"),
        field("content_type", asked).alias("content_type"),
        field("ocr_text", F.lit("")).alias("ocr_text"),
        F.coalesce(_get(obj, "missing_elements").isin("true", "1"), F.lit(False)).alias("missing_elements"),
        (~ok).alias("_parse_failed"),
    )
