"""Prompt texts for batch inference, filled from the fields of a row.

Templates are plain text with {field} marks, chosen by mode or content type. They are
arguments; the defaults below are short texts of our own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from avsync.functions.text import first_case

COMMON = (
    "Types on screen: {detected_types}\nVisual data: {visual_analysis}\nStructure: {structural_description}\n"
    "Hints: {conceptual_hints}\nSpoken now: {transcript_context}\nEarlier concepts: {previous_concepts}\n"
)
STANDARD = COMMON + "Reading order: {reading_order}\nSpoken around: {context_text}\n"
MODE_TEMPLATES = {
    "brief": "Explain this picture to a listener who cannot see it, in a few sentences.\n" + COMMON,
    "detailed": "Explain this picture in depth to a listener who cannot see it.\n"
    + STANDARD
    + "Principles: {related_principles}\nTopics: {topic_timeline}\nElsewhere: {cross_domain}\n",
    "": "Explain this picture fully to a listener who cannot see it.\n" + STANDARD,
}
VISION_PREAMBLE = "Describe the picture as one JSON object.\n"
VISION_DIRECTIVES = {
    "equation": "Read every symbol from left to right.",
    "graph": "Name the axes, the curves and their extremes.",
    "circuit": "List the parts and how they connect.",
    "diagram": "List the shapes and the arrows between them.",
    "code": "Copy the code line by line.",
    "handwritten_notes": "Copy the writing; mark unreadable parts [ILLEGIBLE].",
    "biology": "Name the structures and where they are.",
    "chemistry": "Name the atoms, bonds and reaction arrows.",
    "text": "Copy the text.",
    "unknown": "Describe what can be seen.",
}


def fill(template: str, fields: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else fields[p] for i, p in enumerate(parts) if i % 2 or p])


def listed(items: Column, sep: str, empty: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(items, sep), F.lit("")), F.lit(empty))


def render_prompt(mode: Column, fields: dict[str, Column], templates: dict[str, str] | None = None) -> Column:
    """Prompt of the mode; the template under '' serves all other modes.

    ``fields`` hold the row's columns; lists are joined, missing ones named None or
    Not specified, structs written as JSON.
    """
    f = dict(fields)
    for name, sep, empty in (
        ("detected_types", ", ", ""),
        ("previous_concepts", ", ", "None"),
        ("related_principles", ", ", "None"),
        ("reading_order", "; ", "Not specified"),
    ):
        if name in f:
            f[name] = listed(f[name], sep, empty)
    for name in f:
        f[name] = F.coalesce(f[name].cast("string"), F.lit(""))
    templates = MODE_TEMPLATES if templates is None else templates
    named = [(mode == name, fill(template, f)) for name, template in templates.items() if name]
    return first_case(named, fill(templates[""], f))


def render_vision_prompt(
    content_type: Column,
    directives: dict[str, str] | None = None,
    preamble: str = VISION_PREAMBLE,
    fallback: str = "",
) -> Column:
    """Preamble and the directive of the content type; ``fallback`` names another type's, or ''."""
    directives = VISION_DIRECTIVES if directives is None else directives
    table = F.create_map(*[F.lit(x) for pair in directives.items() for x in pair])
    directive = F.coalesce(F.try_element_at(table, content_type), F.lit(directives.get(fallback, "")))
    return F.concat(F.lit(preamble), F.lit("Type: "), F.coalesce(content_type, F.lit("")), F.lit("\n"), directive)
