"""Text columns: canonical forms, fingerprints, placeholders, keys; and driver-side templating."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that are SQL fragments and go in as they are.
RAW_PARAMETERS = ("table_name", "temporal_predicate")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_sql(sql: Column) -> Column:
    """Lower case, single blanks."""
    return F.lower(F.regexp_replace(F.trim(sql), r"\s+", " "))


def _literals_out(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\b\d+(\.\d+)?\b", "<num>")), r"\s+", " ")


def canonical_sql_shape(sql: Column) -> Column:
    """SQL without comments, its literals as ``<str>`` and ``<num>``: equal for equal statement shapes."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    return _literals_out(F.regexp_replace(F.lower(bare), r"'(?:''|[^'])*'", "<str>"))


def canonical_description(text: Column) -> Column:
    """Prose in lower case with numbers as ``<num>`` and single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\d+(\.\d+)?", "<num>"), r"\s+", " ")


def fingerprint(canonical: Column) -> Column:
    """SHA-256 of a canonical text; the empty string for none."""
    return F.when(F.coalesce(canonical, F.lit("")) == "", "").otherwise(F.sha2(canonical, 256))


def tidy_lines(text: Column) -> Column:
    """Unix newlines, no blanks at line ends, at most two empty lines in a row."""
    c = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?md)[ \t]+$", "")
    return F.regexp_replace(c, r"\n{4,}", "\n\n\n")


def placeholders(template: Column) -> Column:
    """Distinct names in braces, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^}]+)\}")))


def unquote_placeholders(template: Column) -> Column:
    """``'{x}'`` and ``"{x}"`` become ``{x}``, except raw fragments."""
    return F.regexp_replace(template, r"""(['"])(\{(?!(?:table_name|temporal_predicate)\})\w+\})\1""", "$2")


def names_of(variables: Column) -> Column:
    """Variable names of a comma- or blank-separated string."""
    return F.filter(F.split(F.trim(variables), r"\s*,\s*|\s+"), lambda x: x != "")


def record_key(*parts: Column | str) -> Column:
    """Parts joined by ``|``, nulls as empty."""
    return F.concat_ws("|", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


def strip_fences(text: Column) -> Column:
    """Text inside a markdown code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+$", "")


def sql_literal(value: object) -> str:
    """SQL text of a value: NULL, TRUE or FALSE, a number, or quoted text."""
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def instantiate(template: str, parameters: Mapping[str, object]) -> str:
    """Template with its placeholders filled: quotes doubled inside quoted text, literals outside, raw
    fragments as they are; names without a value stay."""

    def fill(match: re.Match[str]) -> str:
        quote, name = match.group(1), match.group(2)
        if name not in parameters:
            return match.group(0)
        value = parameters[name]
        if name in RAW_PARAMETERS or (isinstance(value, str) and value.lstrip().startswith("(") and not quote):
            return str(value)
        if quote:
            return quote + str(value).replace(quote, quote * 2) + quote
        return sql_literal(value)

    return re.sub(r"""(?:(?<!\w)(['"])(?=\{\w+\}\1))?\{(\w+)\}(?(1)\1)""", fill, template)


def fill(prose: str, parameters: Mapping[str, object]) -> str:
    """Prose with its placeholders filled; names without a value stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(parameters.get(m.group(1), m.group(0))), prose)


_HOLE = r"""(?U)(?<!\w)'\{\w+\}'|(?<!\w)"\{\w+\}"|\{\w+\}"""


def _python_text(value: Column) -> Column:
    """A value inside quoted text or prose; a null is ``None``, as where plain values are filled in."""
    shown = F.when(F.typeof(value) == "boolean", F.initcap(value.cast("string"))).otherwise(value.cast("string"))
    return F.coalesce(shown, F.lit("None"))


def literal(value: Column) -> Column:
    """SQL text of a column's values, by its type: ``sql_literal`` as an expression."""
    kind, shown = F.typeof(value), value.cast("string")
    number = kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    missing = value.isNull() | (kind.isin("double", "float") & (shown == "NaN"))
    return F.when(missing, "NULL").when(kind == "boolean", F.upper(shown)).when(number, shown).otherwise(F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("''")), F.lit("'")))


def _refilled(template: Column, hole: str, fill: Callable[[Column], Column]) -> Column:
    """``template`` with each match of ``hole`` replaced once; what is filled in isn't looked at again."""
    parts = F.split(template, hole, -1)
    filled = F.transform(F.regexp_extract_all(template, F.lit(hole), F.lit(0)), lambda h, i: F.concat(fill(h), F.element_at(parts, i + 2)))
    return F.concat(F.element_at(parts, 1), F.array_join(filled, ""))


def instantiated(template: Column, values: Mapping[str, Column]) -> Column:
    """``instantiate`` as an expression: values are columns, of any simple type."""
    entry = lambda v: F.struct(_python_text(v).alias("plain"), literal(v).alias("literal"), ((F.typeof(v) == "string") & F.coalesce(F.ltrim(v.cast("string")).startswith("("), F.lit(False))).alias("fragment"))
    known = F.create_map(*(x for name, v in values.items() for x in (F.lit(name), entry(v))))

    def fill(hole: Column) -> Column:
        name, quote = F.regexp_extract(hole, r"(?U)\{(\w+)\}", 1), F.substring(hole, 1, 1)
        value = F.try_element_at(known, name)
        quoted = F.concat(quote, F.replace(value["plain"], quote, F.concat(quote, quote)), quote)
        raw = name.isin(*RAW_PARAMETERS) | ((quote == "{") & value["fragment"])
        return F.when(value.isNull(), hole).when(raw, value["plain"]).when(quote == "{", value["literal"]).otherwise(quoted)

    return _refilled(template, _HOLE, fill)


def filled(prose: Column, values: Mapping[str, Column]) -> Column:
    """``fill`` as an expression."""
    known = F.create_map(*(x for name, v in values.items() for x in (F.lit(name), _python_text(v))))
    return _refilled(prose, r"(?U)\{\w+\}", lambda h: F.coalesce(F.try_element_at(known, F.regexp_extract(h, r"(?U)\{(\w+)\}", 1)), h))


def parameters_of(template: str, concrete: str) -> dict[str, str]:
    """Values that turn ``template`` into ``concrete``; empty if it can't be."""
    names: list[str] = []
    parts = re.split(r"\{(\w+)\}", re.sub(r"\s+", " ", template.strip()))
    pattern = ""
    for i, part in enumerate(parts):
        if i % 2 == 0:
            pattern += re.escape(part).replace(r"\ ", r"\s+")
        elif part in names:
            pattern += f"(?P=v{names.index(part)})"
        else:
            pattern += f"(?P<v{len(names)}>.+?)"
            names.append(part)
    found = re.fullmatch(pattern, concrete.strip(), flags=re.DOTALL | re.IGNORECASE)
    return {n: found.group(f"v{i}").strip("'\"") for i, n in enumerate(names)} if found else {}


def first_json(text: str | None, opening: str = "{") -> object | None:
    """First parsable JSON object (or array, for ``[``) in free text; trailing commas are forgiven."""
    text = re.sub(r",\s*([}\]])", r"\1", text or "")
    decoder = json.JSONDecoder()
    at = text.find(opening)
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find(opening, at + 1)
    return None


def sql_profile(sql: Column, first: str = "batsman", second: str = "bowler") -> dict[str, Column]:
    """Profile of a statement's text: its functions, hops (nested SELECTs and JOINs), and which entity it is about."""
    count = lambda word: F.regexp_count(sql, F.lit(rf"(?i)\b{word}\b"))
    names = F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\b(SUM|AVG|COUNT|MIN|MAX|ROUND|ABS|COALESCE|CAST)\b"), F.lit(1)), F.upper)
    hops = F.greatest(count("SELECT") - 1, F.lit(0)) + count("JOIN")
    one, two = count(first) > 0, count(second) > 0
    target = F.when(one & two, "both").when(one, first).when(two, second).otherwise("unknown")
    return {"functions": F.array_sort(F.array_distinct(names)), "hop_count": hops, "is_multihop": hops > 0, "entity_target": target}
