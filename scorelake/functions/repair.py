"""Repair of templates whose parameters were written as values, words or quoted names: column expressions.

Parameter names are plain Python strings; texts, values and paraphrases are columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _braced(name: str) -> str:
    return "{" + name + "}"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(value: Column) -> Column:
    """A column's text as a pattern that matches just it."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def braced_sql(sql: Column, name: str) -> Column:
    """``{name}`` in a statement that lacks it: quoted names become ``'{name}'``; where there are none, so does
    what stands alone after ``name =``."""
    word, hole = re.escape(name), re.escape(_braced(name))
    quoted = F.regexp_replace(sql, rf"""(?i)(['"])\s*{word}\s*\1""", f"'{_braced(name)}'".replace("{", r"\{"))
    valued = F.regexp_replace(quoted, rf"(?i)(\b{word}\b\s*=\s*)(?:\{{\s*{word}\s*\}}|\b{word}\b)(?!\s*\.)", "$1'" + _braced(name).replace("{", r"\{") + "'")
    return F.when(sql.rlike(hole), sql).when(quoted.rlike(hole), quoted).otherwise(valued)


def marked_text(text: Column, name: str) -> Column:
    """``'name'``, ``"name"`` and ``<name>`` in prose as ``{name}``; the bare word stays."""
    word, hole = re.escape(name), _braced(name).replace("{", r"\{")
    return F.regexp_replace(F.regexp_replace(text, rf"""(?i)(['"])\s*{word}\s*\1""", hole), rf"(?i)<\s*{word}\s*>", hole)


def value_to_hole(text: Column, name: str, value: Column) -> Column:
    """A concrete value in prose, quoted or not, as ``{name}``; inside a longer word it stays."""
    hole, exact = F.lit(_braced(name).replace("{", r"\{")), _literal(value)
    bare = F.regexp_replace(F.regexp_replace(text, F.concat(F.lit(r"""(?iu)(['"])\s*"""), exact, F.lit(r"\s*\1")), hole), F.concat(F.lit("(?iu)(?<![A-Za-z0-9_])"), exact, F.lit("(?![A-Za-z0-9_])")), hole)
    return F.when(F.coalesce(value, F.lit("")) == "", text).otherwise(bare)


def hole_after_word(question: Column, paraphrases: Column, name: str) -> Column:
    """``'{name}'`` after the first word ``name`` of a question that lacks it, if a paraphrase has it."""
    return _bound(question, lambda q: _hole_after_word(q, paraphrases, name))


def _hole_after_word(question: Column, paraphrases: Column, name: str) -> Column:
    hole = F.lit(_braced(name))
    asked = F.exists(paraphrases, lambda p: F.contains(p, hole)) & ~F.contains(question, hole)
    there = question.rlike(rf"(?i)\b{re.escape(name)}\b")
    first = F.regexp_extract(question, rf"(?is)^(.*?)\b{re.escape(name)}\b", 1)
    filled = _bound(first, lambda f: F.concat(f, F.lit(f"{name} '{_braced(name)}'"), F.substr(question, (F.length(f) + len(name) + 1).cast("int"))))
    return F.when(F.coalesce(asked, F.lit(False)) & there, filled).otherwise(question)


def _named_in(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(rf"(?i)\{{{re.escape(name)}\}}|\b{re.escape(name)}\b"), F.lit(False))


def repaired(question: Column, paraphrases: Column, values: Mapping[str, Column]) -> tuple[Column, Column]:
    """(question, paraphrases) with values and quoted names as holes; a parameter that neither names is
    appended to the question."""
    names: Sequence[str] = list(values)
    mend = lambda text: reduce(marked_text, names, reduce(lambda t, n: _bound(t, lambda x: value_to_hole(x, n, values[n])), names, text))
    others = F.transform(F.coalesce(paraphrases, F.array().cast("array<string>")), mend)
    asked = lambda o: reduce(lambda q, n: hole_after_word(q, o, n), names, mend(question))
    return _bound(others, lambda o: _bound(asked(o), lambda q: _with_lacking(q, o, names))), others


def _with_lacking(question: Column, paraphrases: Column, names: Sequence[str]) -> Column:
    """A question with the parameters that neither it nor a paraphrase names."""
    test = lambda n: lambda p: _named_in(p, n)
    holes = F.array_compact(F.array(*(F.when(~_named_in(question, n) & ~F.exists(paraphrases, test(n)), F.lit(_braced(n))) for n in names)))
    added = lambda lacking: F.when(F.size(lacking) > 0, F.concat(F.rtrim(question), F.lit(" Parameters: "), F.array_join(lacking, ", "), F.lit("."))).otherwise(question)
    return _bound(holes, added)


def declared(variables: Column, *templates: Column) -> Column:
    """Variables of a template with the placeholders that its texts use but it doesn't declare."""
    used = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\{(\w+)\}")) for t in templates]
    return F.array_distinct(F.concat(F.coalesce(variables, F.array().cast("array<string>")), *used))


def is_temporal(predicate: Column) -> Column:
    """Whether a record has a temporal predicate, other than the one that always holds."""
    return predicate.isNotNull() & (F.coalesce(F.replace(predicate, F.lit(" "), F.lit("")), F.lit("")) != "(1=1)")
