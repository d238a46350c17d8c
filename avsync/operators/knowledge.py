"""Look-ups in a knowledge table (concept, domain, explanation, ord) of any size.

Concepts are looked up once each. Equal names meet by an equality join; a name inside
another one meets it by a shared gram, and the pair is then verified, so no entry is held
against every row. The order of entries is ``ord``. Rows that an explode makes are
more than Spark's size check knows of, so no side of these joins is sent whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions.scoring import words
from avsync.functions.text import strip

GRAM = 3


def _norm(word: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(word), F.lit(""))))


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _pieces(text: Column, size: Column) -> Column:
    """All pieces of that many letters; the text must have so many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))


def _grams(text: Column) -> Column:
    """All different pieces of up to GRAM letters."""
    pieces = [F.when(F.length(text) >= n, _pieces(text, F.lit(n))) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*pieces))))


def inside(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Different (needle, text) with the needle inside the text; blank needles are in none.

    A needle is looked for by its rarest gram among the texts.
    """
    index = texts.select(F.col(text)).distinct().select(text, F.explode(_grams(F.col(text))).alias("_gram"))
    often = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.length(needle), F.lit(GRAM))
    own = _pieces(F.col(needle), size)
    asked = needles.select(F.col(needle)).distinct().where(F.col(needle) != "").select(needle, F.explode(F.array_distinct(own)).alias("_gram"))
    # a gram that no text has counts as the rarest: then there is no pair
    rarest = (
        _meet(asked, often, "_gram", "left")
        .groupBy(needle)
        .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    )
    return _meet(rarest, index, "_gram").where(F.contains(text, needle)).select(needle, text)


def _alike(asked: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Different (_c, _k): a concept asked for and an entry's concept that holds it or is held by it."""
    mine = asked.select("_c").distinct()
    theirs = knowledge.select(F.col("concept").alias("_k")).distinct()
    return inside(mine, "_c", theirs, "_k").select("_c", "_k").union(inside(theirs, "_k", mine, "_c").select("_c", "_k")).distinct()


def explanations(asked: DataFrame, knowledge: DataFrame) -> DataFrame:
    """``asked`` (concept, domain, ...) with ``explanation``: that of the entry of this name and
    domain, else of the first entry of the domain whose concept holds or is held by it, else ''.
    """
    rows = asked.withColumn("_c", _norm("concept")).withColumn("_d", _norm("domain"))
    keys = rows.select("_c", "_d").distinct()
    entries = knowledge.where("explanation != ''").select(F.col("concept").alias("_k"), F.col("domain").alias("_d"), "explanation", "ord")
    found = (
        _meet(_meet(keys, _alike(keys, knowledge), "_c"), entries, ["_k", "_d"])
        .groupBy("_c", "_d")
        .agg(F.min_by("explanation", F.struct(F.col("_k") != F.col("_c"), "ord")).alias("explanation"))
    )
    return rows.join(found, ["_c", "_d"], "left").withColumn("explanation", F.coalesce("explanation", F.lit(""))).drop("_c", "_d")


def _first_seen(values: Column) -> Column:
    """Values of (ord, value) structs in order, each once."""
    return F.array_distinct(F.transform(F.array_sort(values), lambda x: x["v"]))


def related_domains(asked: DataFrame, knowledge: DataFrame) -> DataFrame:
    """``asked`` (concept, ...) with ``domains``: of the concept itself and of entries that mention it, by order."""
    rows = asked.withColumn("_c", _norm("concept"))
    entries = knowledge.withColumn("_text", F.lower("explanation"))
    mention = _meet(inside(rows, "_c", entries, "_text"), entries.select("_text", "domain", "ord"), "_text")
    same = _meet(rows.select("_c").distinct(), entries.select(F.col("concept").alias("_c"), "domain", "ord"), "_c")
    # one row per domain, so that a list is no longer than the domains
    hits = mention.select("_c", "domain", "ord").union(same.select("_c", "domain", "ord")).groupBy("_c", "domain").agg(F.min("ord").alias("ord"))
    lists = hits.groupBy("_c").agg(_first_seen(F.collect_list(F.struct("ord", F.col("domain").alias("v")))).alias("domains"))
    return rows.join(lists, "_c", "left").withColumn("domains", F.coalesce("domains", words([]))).drop("_c")


def concept_maps(asked: DataFrame, knowledge: DataFrame) -> DataFrame:
    """``asked`` (concept, ...) with ``entries``: domain to text of the concept, else of the first similar one."""
    rows = asked.withColumn("_c", _norm("concept"))
    first = knowledge.groupBy(F.col("concept").alias("_k")).agg(F.min("ord").alias("_first"))
    chosen = (
        _meet(_alike(rows, knowledge), first, "_k").groupBy("_c").agg(F.min_by("_k", F.struct(F.col("_k") != F.col("_c"), "_first")).alias("_k"))
    )
    entries = F.array_sort(F.collect_list(F.struct("ord", "domain", "explanation")))
    maps = knowledge.groupBy(F.col("concept").alias("_k")).agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["domain"], e["explanation"]))).alias("entries")
    )
    found = _meet(chosen, maps, "_k").select("_c", "entries")
    none = F.create_map().cast("map<string,string>")
    return rows.join(found, "_c", "left").withColumn("entries", F.coalesce("entries", none)).drop("_c")


def cross_domain_texts(rows: DataFrame, key: str, concepts: str, knowledge: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """(key, cross_domain): 'In <domain>: <text>' for the first concept that has one, per domain, joined by '; '.

    A concept is looked up once for all domains; rows meet one list per concept.
    """
    names = fixed.DOMAINS if domains is None else domains
    lowered = lambda d: F.lower(strip(F.coalesce(F.lit(d), F.lit(""))))
    listed = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(d).alias("domain"), lowered(d).alias("d")) for i, d in enumerate(names)])
    asked = rows.select(key, F.posexplode(concepts).alias("n", "concept")).select(key, "n", _norm("concept").alias("_c"))
    of_names = F.explode(F.filter(listed, lambda x: x["d"] == F.col("domain")))
    entries = knowledge.where("explanation != ''").select(F.col("concept").alias("_k"), "explanation", "ord", of_names.alias("_l"))
    told = (
        _meet(_alike(asked, knowledge), entries.select("_k", "explanation", "ord", "_l.at", "_l.domain"), "_k")
        .groupBy("_c", "at", "domain")
        .agg(F.min_by("explanation", F.struct(F.col("_k") != F.col("_c"), "ord")).alias("explanation"))
        .groupBy("_c")
        .agg(F.collect_list(F.struct("at", "domain", "explanation")).alias("_told"))
    )
    # a left join: only the lists, never the exploded rows, may be sent whole, and by their measured size
    met = asked.join(told, "_c", "left").select(key, "n", F.inline_outer("_told")).where("domain IS NOT NULL")
    best = met.groupBy(key, "domain", "at").agg(F.min(F.struct("n", "explanation")).alias("b"))
    item = F.struct(F.col("b.n").alias("n"), "at", F.concat(F.lit("In "), "domain", F.lit(": "), "b.explanation").alias("v"))
    joined = best.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["v"]), "; ").alias("cross_domain")
    )
    return rows.select(key).join(joined, key, "left").withColumn("cross_domain", F.coalesce("cross_domain", F.lit("No direct connections")))
