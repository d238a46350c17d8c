"""The queue of explanations still to write, with their prompts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.functions import scoring
from avsync.functions.lexicon import Knowledge, cross_domain_text
from avsync.functions.math_speech import linearize_math
from avsync.functions.model_json import parse_model_json
from avsync.functions.prompts import render_prompt
from avsync.operators.knowledge import cross_domain_texts
from avsync.operators.library import explanation_queue
from avsync.operators.timejoin import nearest_segment, without_segment
from avsync.plans.context import build_context
from avsync.plans.infer import Loader, infer
from avsync.session import settle


def prepare_explanations(
    requests: DataFrame,
    interventions: DataFrame,
    explanations: DataFrame,
    segments: DataFrame,
    snapshots: DataFrame,
    knowledge: Knowledge | DataFrame,
    templates: dict[str, str] | None = None,
    policy: str = "strict",
    max_rows: float | None = None,
    **lexicons,
) -> DataFrame:
    """One row per request without an explanation, with its prompt.

    ``requests`` is (intervention_id, output_mode); ``interventions`` (id, video_id, t,
    content_type, confidence_proxy); ``snapshots`` (intervention_id, answer), the model's
    raw text. ``use_model`` is false where only the transcript may be used. ``knowledge`` is
    a table (concept, domain, explanation, ord), or a short dict.
    """
    todo = explanation_queue(requests, explanations).join(
        interventions.select(
            F.col("id").alias("intervention_id"),
            "video_id",
            "t",
            scoring.gate_content_type(F.col("content_type"), F.col("confidence_proxy")).alias("content_type"),
        ),
        "intervention_id",
    )
    spoken = nearest_segment(todo, segments, max_rows).withColumn("transcript_context", F.coalesce("seg_text", F.lit("")))
    spoken = without_segment(spoken).withColumn("mode", F.col("output_mode"))
    # read by the text match, by the context and by the answers
    if not isinstance(knowledge, DataFrame):
        lexicons["of_concepts"] = {"cross_domain": lambda concepts: cross_domain_text(concepts, knowledge)}
    context = build_context(settle(spoken, "spoken"), segments, **lexicons)
    snap = parse_model_json(F.col("answer"), policy, F.col("content_type"))
    seen = context.join(snapshots, "intervention_id", "left").withColumn("snapshot", snap).drop("answer")
    missing = scoring.illegible_gate(
        F.col("snapshot.missing_elements"), F.col("snapshot.text_readout"), F.col("content_type")
    )
    only_speech = scoring.missing_gate(missing) | scoring.mismatch_flag(
        F.col("content_type"), F.col("snapshot.text_readout")
    )
    seen = seen.withColumn("use_model", ~only_speech)
    if isinstance(knowledge, DataFrame):
        seen = _cross_domain(seen, knowledge)
    else:
        seen = seen.withColumn("cross_domain", F.coalesce("cross_domain", cross_domain_text(F.col("previous_concepts"), knowledge)))
    return seen.withColumn("prompt", render_prompt(F.col("output_mode"), _fields(), templates))


def _cross_domain(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Each different list of concepts is looked up once."""
    rows = rows.withColumn("_list", F.coalesce(F.array_join("previous_concepts", "\u0001"), F.lit("")))
    lists = rows.select("_list", F.col("previous_concepts").alias("concepts")).dropDuplicates(["_list"])
    return rows.join(cross_domain_texts(lists, "_list", "concepts", knowledge), "_list", "left").drop("_list")


def _fields() -> dict[str, Column]:
    snap = F.col("snapshot")
    return {
        "detected_types": snap["detected_types"],
        "visual_analysis": F.to_json(snap["visual_analysis"]),
        "structural_description": snap["structural_description"],
        "reading_order": snap["reading_order"],
        "conceptual_hints": snap["conceptual_hints"],
        "text_readout": linearize_math(snap["text_readout"]),
        "layout": linearize_math(snap["layout"]),
        "spatial_map": linearize_math(snap["spatial_map"]),
        "transcript_context": F.col("transcript_context"),
        "context_text": F.col("context_text"),
        "previous_concepts": F.col("previous_concepts"),
        "related_principles": F.col("related_principles"),
        "topic_timeline": F.to_json("topic_timeline"),
        "cross_domain": F.col("cross_domain"),
        "content_type": F.col("content_type"),
        "mode": F.col("mode"),
    }


def store_explanations(told: DataFrame, append: Callable[[DataFrame], Any]) -> None:
    """Add written explanations (intervention_id, output_mode, text_explanation) to the stored table.

    That table is what ``explanation_queue`` leaves out, so asking again finds no work.
    """
    folder = F.concat(F.lit("interventions/"), "intervention_id", F.lit("/"))
    append(
        told.select(
            "intervention_id",
            "text_explanation",
            "output_mode",
            F.concat(folder, "output_mode", F.lit(".txt")).alias("text_file_path"),
            F.current_timestamp().alias("created_at"),
        )
    )


def write_explanations(prepared: DataFrame, load: Loader) -> DataFrame:
    """(intervention_id, output_mode, text_explanation): the model's text, else the spoken one.

    The model runs only on rows that may use it.
    """
    keep = ["intervention_id", "output_mode", "transcript_context", "prompt"]
    prepared = settle(prepared.select(*keep, "use_model"), "prompts")
    asked = infer(prepared.where("use_model").select(*keep), "prompt", load, "generated")
    plain = prepared.where("NOT use_model").select(*keep).withColumn("generated", F.lit(None).cast("string"))
    text = scoring.explanation_or_transcript(F.col("generated"), F.col("transcript_context"))
    return asked.unionByName(plain).select("intervention_id", "output_mode", text.alias("text_explanation"))
