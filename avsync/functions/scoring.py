"""Scores, gates and labels of frames and intervention points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions.text import first_case, strip


def words(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def phrase_hit(text: Column, phrases: list[str]) -> Column:
    """Any phrase inside the lower-cased text; false without a text."""
    low = F.lower(text)
    return F.coalesce(F.exists(words(phrases), lambda p: F.contains(low, p)), F.lit(False))


def text_rules(text: Column, deictic: list[str] | None = None, negative: list[str] | None = None) -> dict[str, Column]:
    """The parts of the score rules that depend on the spoken text only."""
    return {
        "deictic": phrase_hit(text, deictic or fixed.DEICTIC),
        "negative": phrase_hit(text, negative or fixed.NEGATIVE_DEICTIC),
        "brief": F.length(strip(text)) < fixed.SILENT_CHARS,
    }


def frame_rules(said: dict[str, Column], complexity: Column) -> dict[str, Column]:
    """The score rules of a frame, in the order their names are reported; no text fires none of its rules."""
    high = F.coalesce(complexity, F.lit(0.0)) > fixed.COMPLEX_ABOVE
    heard = {n: F.coalesce(c, F.lit(False)) for n, c in said.items()}
    return {
        "deictic": heard["deictic"],
        "negative": heard["negative"],
        "silent": heard["brief"] & high,
        "complex": high,
    }


def fired_rules(
    text: Column, complexity: Column, deictic: list[str] | None = None, negative: list[str] | None = None
) -> dict[str, Column]:
    return frame_rules(text_rules(text, deictic, negative), complexity)


RULE_NAMES = {
    "deictic": "Deictic",
    "negative": "Negative Deictic",
    "silent": "Silent Drawing",
    "complex": "High Complexity",
}


def intervention_score(rules: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name, fired in rules.items():
        total = total + F.when(fired, fixed.SCORES[name]).otherwise(0)
    return total


def trigger_reason(rules: dict[str, Column]) -> Column:
    names = F.array_compact(F.array(*[F.when(fired, RULE_NAMES[n]) for n, fired in rules.items()]))
    return F.coalesce(F.nullif(F.array_join(names, " + "), F.lit("")), F.lit("Unknown"))


def is_intervention(score: Column, complexity: Column) -> Column:
    return (score >= fixed.SCORE_MEDIUM) | (F.coalesce(complexity, F.lit(0.0)) > fixed.VISUAL_ONLY_ABOVE)


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= fixed.SCORE_HIGH, "high").when(score >= fixed.SCORE_MEDIUM, "medium").otherwise("low")


def gate_content_type(content_type: Column, confidence_proxy: Column, minimum: float = 0.40) -> Column:
    """The type, or unknown if missing or its confidence is below the minimum."""
    known = F.coalesce(F.nullif(content_type, F.lit("")), F.lit("unknown"))
    return F.when(confidence_proxy < minimum, "unknown").otherwise(known)


def category_of(content_type: Column) -> Column:
    low = F.lower(content_type)
    ladder = [(F.contains(low, F.lit(part)), F.lit(name)) for part, name in fixed.CATEGORY_LADDER]
    return first_case(ladder, F.lit("unknown"))


def subject_of(content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.SUBJECTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, content_type), F.lit("General"))


def frame_targets(duration: Column) -> Column:
    """Struct target_min, target_max of keyframes for a duration in seconds."""
    return F.struct(
        F.greatest(F.lit(5), F.floor(duration / 60 * 1.5).cast("int")).alias("target_min"),
        F.greatest(F.lit(8), F.floor(duration / 60 * 4).cast("int")).alias("target_max"),
    )


def weighted_score(edge: Column, text: Column, contrast: Column, gradient: Column, colour: Column) -> Column:
    w = fixed.COMPLEXITY_WEIGHTS
    one = F.lit(1.0)
    return F.least(
        one,
        w["edge"] * edge
        + w["text"] * F.least(one, text)
        + w["contrast"] * F.least(one, contrast)
        + w["gradient"] * gradient
        + w["colour"] * colour,
    )


def is_blank(std: Column, score: Column, threshold: float = 0.02) -> Column:
    return (std < 20) | (score < threshold)


def is_garbage(low: Column, high: Column, mean: Column) -> Column:
    """All black, all white, or nearly so."""
    return (high <= 5) | (low >= 250) | (mean < 0.1) | (mean > 254.0)


def keyframe_confidence(is_educational: Column, complexity: Column) -> Column:
    return F.round(F.when(is_educational, complexity).otherwise(F.lit(0.0)), 4)


def mismatch_flag(content_type: Column, text_readout: Column, table: dict[str, list[str]] | None = None,
                  whole_word: bool = False) -> Column:
    """A word that does not belong to this content type occurs in the text."""
    cases = []
    for name, terms in (fixed.MISMATCHES if table is None else table).items():
        if whole_word:
            hit = F.lower(text_readout).rlike(r"(?U)\b(?:" + "|".join(terms) + r")\b")
        else:
            hit = phrase_hit(text_readout, terms)
        cases.append((content_type == name, hit))
    return F.coalesce(first_case(cases, F.lit(False)), F.lit(False))


def missing_gate(missing_elements: Column) -> Column:
    """True where the model marked parts as missing, so only the transcript is used."""
    return ~F.coalesce(missing_elements, F.lit("")).isin("", "null", "None")


def illegible_ratio(text: Column) -> Column:
    rest = strip(F.replace(text, F.lit("[ILLEGIBLE]"), F.lit("")))
    count = F.regexp_count(text, F.lit(r"\[ILLEGIBLE\]"))
    return F.when(F.length(rest) > 0, count / F.length(rest))


def illegible_gate(missing_elements: Column, text: Column, content_type: Column) -> Column:
    """missing_elements, replaced where too much of an equation or note is illegible."""
    bad = (illegible_ratio(text) > 0.2) & F.lower(content_type).isin("equation", "handwritten_notes")
    return F.when(bad, "OCR fallback required").otherwise(missing_elements)


def normalize_mode(mode: Column) -> Column:
    low = F.lower(mode)
    return F.when(low.isin(*fixed.CONTEXT_SECONDS), low).otherwise("standard")


def mode_window(mode: Column) -> Column:
    table = F.create_map(*[x for m, s in fixed.CONTEXT_SECONDS.items() for x in (F.lit(m), F.lit(float(s)))])
    return F.element_at(table, normalize_mode(mode))


def weave_mode(reason: Column) -> Column:
    has = lambda part: F.contains(reason, F.lit(part))
    return (
        F.when(has("Deictic") | has("High Complexity"), "deictic")
        .when(has("Silent") | has("Drawing"), "narrator")
        .otherwise("bridge")
    )


def explanation_or_transcript(generated: Column, spoken: Column) -> Column:
    return F.coalesce(F.nullif(strip(generated), F.lit("")), spoken)
