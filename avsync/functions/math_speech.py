"""Notation to spoken words, with built-in replacements only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from avsync import fixed
from avsync.functions.text import bound

# (?d): a dot stops at \n only; (?U): digits, spaces and word edges of all scripts
FLAGS = "(?dU)"
#: runs of white space that are not one plain space already
LOOSE_SPACE = r"(?U)[^\S ]\s*| \s+"


def rules() -> list[tuple[str, str, bool]]:
    """(pattern or text, replacement, is_pattern) in the order they apply."""
    out = [(p, r, True) for p, r in fixed.MATH_PATTERNS]
    for symbol, spoken in fixed.MATH_SYMBOLS:
        out.append((rf"\b{symbol}\b", spoken, True) if symbol.isalpha() else (symbol, spoken, False))
    out.append((*fixed.MATH_CALL, True))
    return out + [(f, p, False) for f, p in fixed.MATH_OPERATORS]


def _touched() -> str:
    """Pattern of texts that some rule may change; all others skip the chain."""
    words = "|".join(s for s, _ in fixed.MATH_SYMBOLS if s.isalpha())
    marks = {c for s, _ in fixed.MATH_SYMBOLS if not s.isalpha() for c in s if not c.isalnum() and c not in "()"}
    marks |= set("=+-*/^_(²³") | {"∫"}
    phrases = "|".join(s for s, _ in fixed.MATH_OPERATORS if len(s) > 1)
    return rf"{FLAGS}[{''.join(re.escape(m) for m in sorted(marks))}]|\b(?:{words})\b|{phrases}"


def _where(seen: Callable[[Column], Column], text: Column, rule: Callable[[Column], Column]) -> Column:
    return bound(text, lambda t: F.when(seen(t), rule(t)).otherwise(t))


def _put(text: Column, find: str, put: str) -> Column:
    return F.regexp_replace(text, find, re.sub(r"\\(\d)", r"$\1", put))


def _mark(pattern: str) -> str:
    """A piece of text that every match of a notation pattern holds."""
    return next(m for m in ("∫", "/", "_", "^", "(") if m in pattern.replace("[^", "").replace(r"\(", "("))


def _steps(spaced: bool, ascii_only: bool) -> Iterator[tuple[str, str, Callable[[Column], Column]]]:
    """(mark, exact mark, rule) in order: without the marks a rule changes nothing.

    Neighbours of one mark are tried together. Words share the mark '' and are told by their exact ones.
    """
    flags = "" if ascii_only else FLAGS
    for find, put in fixed.MATH_PATTERNS:
        if not ascii_only or find.isascii():
            yield _mark(find), _mark(find), partial(_put, find=flags + find, put=put)
    for symbol, spoken in fixed.MATH_SYMBOLS:
        if ascii_only and not symbol.isascii():
            continue
        if symbol.isalpha():
            yield symbol if len(symbol) == 1 else "", symbol, partial(_put, find=rf"{flags}\b{symbol}\b", put=spoken)
        else:
            first = next((m for m in ("^", "(") if m in symbol), symbol)
            yield first, first, partial(F.replace, search=F.lit(symbol), replace=F.lit(spoken))
    yield "(", "(", partial(_put, find=flags + fixed.MATH_CALL[0], put=fixed.MATH_CALL[1])
    for find, put in fixed.MATH_OPERATORS:
        said = F.lit(f" {put} " if spaced and len(find) == 1 else put)
        yield find if len(find) == 1 else "plus", find, partial(F.replace, search=F.lit(find), replace=said)


def _chain(text: Column, spaced: bool, ascii_only: bool) -> Column:
    """All rules in order; an ASCII text skips the rules for other symbols, and needs no Unicode classes."""

    def all_of(rules: list, t: Column) -> Column:
        return reduce(lambda x, step: step[2](x), rules, t)

    def words(rules: list, t: Column) -> Column:
        return reduce(lambda x, step: _where(lambda y: F.contains(y, F.lit(step[1])), x, step[2]), rules, t)

    out = text
    for mark, rules in groupby(_steps(spaced, ascii_only), lambda step: step[0]):
        rules = list(rules)
        if not mark:
            some = "|".join(word for _, word, _ in rules)
            out = _where(lambda t, some=some: t.rlike(some), out, partial(words, rules))
        elif mark == "e" or (len(rules) == 1 and rules[0][2].func is F.replace):
            out = all_of(rules, out)  # most texts hold an e; a replacement looks for its mark itself
        else:
            out = _where(lambda t, mark=mark: F.contains(t, F.lit(mark)), out, partial(all_of, rules))
    return out


def linearize_math(text: Column, spaced: bool = False) -> Column:
    """Text with notation spoken; NULL gives '', a blank text stays as it is.

    ``spaced`` puts spaces around the words for = + - * /.
    """

    def speak(t: Column) -> Column:
        spoken = (
            F.when(~t.rlike(_touched()), t)
            .when(F.length(t) == F.octet_length(t), _chain(t, spaced, True))
            .otherwise(_chain(t, spaced, False))
        )
        tidy = F.trim(F.regexp_replace(spoken, LOOSE_SPACE, " "))
        # only a blank text has nothing left
        return F.when(t.isNull(), "").otherwise(bound(tidy, lambda y: F.when(y == "", t).otherwise(y)))

    return bound(text, speak)


def linearize_snapshot(snapshot: Column, fields: list[str], spaced: bool = False) -> Column:
    """Linearise the text fields of a snapshot struct and the texts of its elements.

    ``fields`` are the struct's field names; ``elements`` is an array of string maps.
    """
    out = snapshot
    for name in ("text_readout", "layout", "spatial_map", "description"):
        if name in fields:
            value = snapshot[name]
            out = out.withField(name, F.when(value.isNotNull(), linearize_math(value, spaced)))
    if "elements" in fields:
        spoken = F.transform(
            snapshot["elements"],
            lambda e: F.transform_values(e, lambda _, v: F.when(v.isNotNull(), linearize_math(v, spaced))),
        )
        out = out.withField("elements", spoken)
    return out
