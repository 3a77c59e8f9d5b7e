"""Grammar of section numbers as Column expressions.

A number is a sequence of segments such as ``1310`` ``.02`` ``(13)`` ``(b)``; one anchored expression takes
the longest sequence, a second one cuts it into segments, and the rules are boolean expressions over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratadoc.functions.text import found, let, stripped
from stratadoc.schema import SEGMENT, UNKNOWN

_SEGMENT = r"\((?:[ivxlcdmIVXLCDM]+|[a-zA-Z]|\d+)\)|\[(?:[ivxlcdmIVXLCDM]+|[a-zA-Z]|\d+)\]|\.\d+|\.[a-zA-Z]+|-\d+"
NUMBER = rf"^(?:\d+|{_SEGMENT})(?:{_SEGMENT})*"
# Fixed value: words that name a section in a heading.
KEYWORD = r"(?i)^((?:Chapter|Section|Part|Article)\s+\d+\w*)"
# The numerals.
NUMERALS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Segments beyond this stand for any number that is too large.
TOO_LARGE = 10_000


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral: from the right, a sign counts negative before a larger one."""
    values = F.transform(F.split(F.reverse(F.lower(c)), ""), lambda x: F.coalesce(*(F.when(x == k, v) for k, v in NUMERALS.items()), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(
        values, start, lambda s, v: F.struct(F.when(v < s.last, s.total - v).otherwise(s.total + v).alias("total"), v.alias("last")), lambda s: s.total
    )


def _segment(raw: Column) -> Column:
    mark, value = F.left(raw, F.lit(1)), F.regexp_replace(raw, r"[()\[\].-]", "")
    bracket = F.when(mark == "(", "PAREN").when(mark == "[", "BRACK")
    digits = value.rlike(r"^\d+$")
    kind = (
        F.when(bracket.isNotNull() & digits, F.concat(bracket, F.lit("_INT")))
        .when(bracket.isNotNull() & value.rlike("^[ivxlcdmIVXLCDM]+$"), F.concat(bracket, F.lit("_ROMAN")))
        .when(bracket.isNotNull(), F.concat(bracket, F.lit("_ALPHA")))
        .when(mark == ".", F.when(digits, "DOT_INT").otherwise("DOT_ALPHA"))
        .when(mark == "-", "HYPHEN_INT")
        .otherwise("LEAD_INT")
    )
    number = F.when(F.length(F.regexp_replace(value, "^0+", "")) > 4, F.lit(TOO_LARGE)).otherwise(value.try_cast("bigint"))
    whole = F.when(digits, number).when(kind.endswith("ROMAN"), roman_value(value)).otherwise(F.ascii(F.lower(value)) - 96)
    return F.struct(kind.alias("type"), value.alias("value"), whole.cast("bigint").alias("int_val"), raw.alias("raw"))


def number_text(line: Column) -> Column:
    """The section number a line begins with, null if there is none: at least two characters, no integer
    above 9,999."""
    return let(found(stripped(line), NUMBER, 0), lambda n: F.when((F.length(n) >= 2) & ~n.rlike(r"(^|[^\d])0*[1-9]\d{4,}"), n))


def segments_of(number: Column) -> Column:
    """Segments of a number that ``number_text`` has found."""
    return F.transform(F.regexp_extract_all(number, F.lit(rf"(^\d+|{_SEGMENT})")), _segment).cast(SEGMENT)


def _common(number: Column, rest: Column) -> Column:
    """Rules of body lines and headings alike, on the number and what follows it."""
    lead = F.regexp_extract(number, r"^\d+", 0)
    year_like = lead.rlike(r"^(19|20)\d\d$") & ~number.rlike(r"[(\[]") & ~number.rlike(r"\.\d+.*\.\d+") & ~number.rlike(r"\.0*[1-9]\d\d")
    return (
        (lead != "")
        & ~lead.startswith("0")
        & ~year_like
        & (lead.try_cast("int") <= 8000)
        & ~number.rlike(r"(^|[^\d])0+($|[^\d])")
        & ~number.rlike(r"^\d+-\d+-\d{4}$")
        & ~rest.rlike(r"^[+=<>/*%]")
        & ~rest.rlike(r"^\d+\.?\d*$")
    )


def _checked(line: Column, rules: Callable[[Column, Column], Column]) -> Column:
    """The number a line begins with if it passes ``rules``, given the number and what follows it."""
    def check(bare: Column) -> Column:
        parts = let(number_text(bare), lambda n: F.struct(n.alias("n"), stripped(F.substr(bare, F.length(n) + 1)).alias("rest")))
        return let(parts, lambda p: F.when(rules(p["n"], p["rest"]), p["n"]))

    return let(stripped(line), check)


def _strict(number: Column, rest: Column) -> Column:
    two = number.rlike(r"^\d+\.\d+$")
    lead, second = F.regexp_extract(number, r"^(\d+)", 1), F.regexp_extract(number, r"^\d+\.(\d+)$", 1)
    single = number.rlike(rf"^\d(?:{_SEGMENT})$")
    measure = two & ((F.length(lead) == 2) & (F.length(second) >= 2) | (second.try_cast("int") > 50) & (lead.try_cast("int") < 200))
    deep = number.rlike(rf"^\d+(?:{_SEGMENT})+$")
    return deep & _common(number, rest) & ~single & ~F.coalesce(measure, F.lit(False)) & ~rest.rlike(r"^\p{Ll}")


def candidate(line: Column) -> Column:
    """Section number a line of running text begins with, null if what it begins with may be something else:
    a page number, a measure, a year, a document number or a number in a sentence."""
    return _checked(line, _strict)


def relaxed(line: Column) -> Column:
    """Section number a heading line begins with; one segment is enough."""
    return _checked(line, lambda number, rest: number.rlike(r"^\d") & _common(number, rest))


def heading_label(text: Column) -> Column:
    """Label of a heading: a number in its first five lines that are not blank, else Chapter, Section, Part
    or Article with its number, else the first line up to 50 characters, else UNKNOWN."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), stripped), lambda x: x != "")

    def label(lines: Column) -> Column:
        few = F.slice(lines, 1, 5)
        number = F.get(F.array_compact(F.transform(few, relaxed)), F.lit(0))
        keyword = F.get(F.array_compact(F.transform(few, lambda x: found(x, KEYWORD))), F.lit(0))
        first = F.nullif(F.regexp_replace(F.substring(F.get(lines, F.lit(0)), 1, 50), r"[.:;,\- ]+$", ""), F.lit(""))
        return F.coalesce(number, keyword, first, F.lit(UNKNOWN))

    return let(lines, label)


def looks_real(c: Column) -> Column:
    """A label that begins with a digit or with Chapter, Section, Part or Article and a number."""
    return F.coalesce(stripped(c).rlike(r"^\d") | stripped(c).rlike(KEYWORD), F.lit(False))


def is_section_value(c: Column) -> Column:
    """Whether a correction may be stored as a section: 3 to 60 characters, a digit first."""
    return F.length(stripped(c)).between(3, 60) & stripped(c).rlike(r"^\d[\d.\-()\[\]a-zA-Z]*$")


def advances(current: list[dict] | None, new: list[dict], most: int = 20) -> bool:
    """Whether a number may follow the current one in a document.

    With no current number, two plain segments below 100 are not enough. At the same depth or above, the
    last common level must rise by 1 to ``most`` (at the same depth the level before it may rise instead);
    further down all of the current number must be kept and the new level begin at 5 or less.
    """
    if current is None:
        plain = all(s["type"] in ("LEAD_INT", "DOT_INT", "DOT_ALPHA") for s in new)
        return not (len(new) == 2 and new[0]["int_val"] < 100 and plain)
    same = [a["value"].lower() == b["value"].lower() for a, b in zip(current, new)]
    depth, rises = len(new), [0 < b["int_val"] - a["int_val"] <= most for a, b in zip(current, new)]
    if depth > len(current):
        return all(same) and new[len(current)]["int_val"] <= 5
    if depth == len(current) and depth > 1 and all(same[: depth - 2]) and not same[depth - 2]:
        return rises[depth - 2]
    return all(same[: depth - 1]) and rises[depth - 1]
