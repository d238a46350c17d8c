"""Concepts, principles, topics and knowledge entries as literal tables.

These tables are short word lists given with the query, so they go into the plan as
literals: look-ups are array expressions and need no join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions.scoring import words
from avsync.functions.text import bound, first_case, strip

MAX_ENTRIES = 10_000

Knowledge = dict[str, dict[str, str]]


def _checked(n: int) -> None:
    if n > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} literal entries")


def concepts_in(text: Column, terms: list[str] | None = None, whole_word: bool = False) -> Column:
    """Terms inside the lower-cased text, in list order, each once."""
    terms = list(dict.fromkeys(fixed.CONCEPTS if terms is None else terms))
    _checked(len(terms))
    low = F.lower(F.coalesce(text, F.lit("")))
    if whole_word:
        return F.array_compact(F.array(*[F.when(low.rlike(rf"(?U)\b{t}\b"), t) for t in terms]))
    return F.filter(words(terms), lambda t: F.contains(low, t))


def principles_of(concepts: Column, table: dict[str, list[str]] | None = None) -> Column:
    """Principles of the concepts in order, first occurrence kept."""
    table = fixed.PRINCIPLES if table is None else table
    _checked(len(table))
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), words(v))])
    found = F.transform(concepts, lambda c: F.coalesce(F.try_element_at(lookup, F.lower(c)), words([])))
    return F.array_distinct(F.flatten(found))


def topic_of(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """First topic with a keyword in the text; NULL without any."""
    low = F.lower(text)
    cases = [
        (F.exists(words(terms), lambda t: F.contains(low, t)), F.lit(name))
        for name, terms in (fixed.TOPICS if topics is None else topics).items()
        if name != "unknown"
    ]
    return first_case(cases, F.lit(None).cast("string"))


def knowledge_entries(knowledge: Knowledge) -> Column:
    """Literal array of (concept, domain, text) in entry order."""
    rows = [(c, d, t) for c, by_domain in knowledge.items() for d, t in by_domain.items()]
    _checked(len(rows))
    return F.array(
        *[F.struct(F.lit(c).alias("concept"), F.lit(d).alias("domain"), F.lit(t).alias("text")) for c, d, t in rows]
    )


def _norm(word: Column) -> Column:
    return F.lower(strip(word))


def _given(word: Column) -> Column:
    return F.coalesce(word, F.lit("")) != ""


def _alike(entry: Column, concept: Column) -> Column:
    return F.contains(entry["concept"], concept) | F.contains(concept, entry["concept"])


def _told(alike: Column, concept: Column, domain: Column) -> Column:
    """Text of the concept in the domain, else of the first alike entry there; '' without one."""
    here = F.filter(alike, lambda e: e["domain"] == domain)
    texts = lambda h: (F.get(F.filter(h, lambda e: e["concept"] == concept), F.lit(0))["text"], F.get(h, F.lit(0))["text"])
    return bound(here, lambda h: F.coalesce(*texts(h), F.lit("")))


def _told_entries(concept: Column, knowledge: Knowledge) -> Column:
    """Entries with a text whose concept holds or is held by the given one; the same name is among them."""
    return F.filter(knowledge_entries(knowledge), lambda e: (e["text"] != "") & _alike(e, concept))


def kb_explanation(concept: Column, domain: Column, knowledge: Knowledge) -> Column:
    """Text of (concept, domain), else of the first entry whose concept holds or is held by it; else ''."""
    asked = F.struct(_norm(concept).alias("c"), _norm(domain).alias("d"))
    text = bound(asked, lambda a: _told(_told_entries(a["c"], knowledge), a["c"], a["d"]))
    return F.when(_given(concept) & _given(domain), text).otherwise("")


def kb_related_domains(concept: Column, knowledge: Knowledge) -> Column:
    """Domains of the concept itself and of entries that mention it, in order, each once."""
    entries = knowledge_entries(knowledge)
    hits = bound(
        _norm(concept),
        lambda c: F.filter(entries, lambda e: (e["concept"] == c) | F.contains(F.lower(e["text"]), c)),
    )
    return F.when(_given(concept), F.array_distinct(F.transform(hits, lambda e: e["domain"]))).otherwise(words([]))


def kb_concept_map(concept: Column, knowledge: Knowledge) -> Column:
    """Domain to text of the concept, else of the first similar one; empty if there is none."""
    entries = knowledge_entries(knowledge)

    def name(c: Column) -> Column:
        near = F.get(F.filter(entries, lambda e: _alike(e, c)), F.lit(0))["concept"]
        return F.when(F.exists(entries, lambda e: e["concept"] == c), c).otherwise(near)

    chosen = F.when(_given(concept), bound(_norm(concept), name))
    items = bound(chosen, lambda n: F.filter(entries, lambda e: e["concept"] == n))
    return F.map_from_entries(F.transform(items, lambda e: F.struct(e["domain"], e["text"])))


def cross_domain_text(concepts: Column, knowledge: Knowledge, domains: list[str] | None = None) -> Column:
    """'In <domain>: <text>' for the first concept that has one, per domain, joined by '; '.

    Concepts are gone through once; each is held against the entries once, and asked only
    about the domains that no concept before it had.
    """
    listed = dict.fromkeys(fixed.DOMAINS if domains is None else domains)
    names = F.array(*[F.struct(F.lit(d).alias("domain"), _norm(F.lit(d)).alias("d")) for d in listed if d])
    none = F.array().cast("array<struct<domain:string,text:string>>")

    def told(done: Column, c: Column) -> Column:
        left = F.filter(names, lambda n: ~F.exists(done, lambda e: e["domain"] == n["domain"]))
        texts = lambda alike: F.transform(left, lambda n: F.struct(n["domain"].alias("domain"), _told(alike, c, n["d"]).alias("text")))
        return F.filter(bound(_told_entries(c, knowledge), texts), lambda e: e["text"] != "")

    def step(done: Column, concept: Column) -> Column:
        more = bound(_norm(concept), lambda c: F.concat(done, told(done, c)))
        return F.when(_given(concept), more).otherwise(done)

    found = F.aggregate(concepts, none, step) if any(listed) else none
    joined = F.array_join(F.transform(found, lambda e: F.concat(F.lit("In "), e["domain"], F.lit(": "), e["text"])), "; ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("No direct connections"))
