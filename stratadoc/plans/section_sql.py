"""The grammar of section numbers once more, in SQL, for the queries that are compared with it.

Written from the rules and not from the expressions of ``functions.sections``: a number is cut into segments
first, and rules are stated on those.
"""

from __future__ import annotations

#: White space of any kind, and a segment that is not the first.
SPACE = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]"
ENDS = rf"^{SPACE}+|{SPACE}+$"
SEGMENT = r"\((?:[ivxlcdmIVXLCDM]+|[a-zA-Z]|\d+)\)|\[(?:[ivxlcdmIVXLCDM]+|[a-zA-Z]|\d+)\]|\.\d+|\.[a-zA-Z]+|-\d+"
KEYWORD = r"(?i)^((?:Chapter|Section|Part|Article)\s+\d+\w*)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{ENDS}', '', 'g')"


def numbers(source: str, line: str) -> str:
    """``source`` with ``n``, the number its column ``line`` begins with ('' if none), ``rest`` behind it and ``s``,
    the number's segments as text. Columns are those of ``source``."""
    return f"""
        SELECT *, regexp_extract_all(n, '(?:^\\d+|{SEGMENT})') AS s, {strip(f"substr({strip(line)}, len(n) + 1)")} AS rest
        FROM (SELECT *, CASE WHEN len(m) >= 2 AND len(list_filter(regexp_extract_all(m, '\\d+'), lambda d: len(ltrim(d, '0')) > 4)) = 0 THEN m ELSE '' END AS n
              FROM (SELECT *, regexp_extract({strip(line)}, '^(?:\\d+|{SEGMENT})(?:{SEGMENT})*') AS m FROM {source}))"""


#: Rules of all numbers, on n, s and rest: a first segment of digits without a leading zero, up to 8000; no year unless
#: it goes on in brackets, by two dots or by a dot and 100 or more; no segment 0; no document number; no formula behind.
_DOTS = "list_filter(s[2:], lambda x: x[1:1] = '.' AND regexp_full_match(x[2:], '\\d+'))"
COMMON = f"""
    regexp_full_match(s[1], '[1-9]\\d*') AND len(s[1]) <= 4 AND CAST(s[1] AS INT) <= 8000
    AND NOT (len(s[1]) = 4 AND s[1][1:2] IN ('19', '20') AND len(list_filter(s, lambda x: x[1:1] IN ('(', '['))) = 0
             AND len(list_filter(string_split(n[6:], '.'), lambda x: regexp_matches(x, '^\\d'))) - CASE WHEN n[5:5] = '.' THEN 0 ELSE 1 END < CASE WHEN n[5:5] = '.' THEN 2 ELSE 99 END
             AND len(list_filter({_DOTS}, lambda x: len(ltrim(x[2:], '0')) >= 3)) = 0 AND NOT regexp_matches(n, '\\.\\d+.*\\.\\d'))
    AND len(list_filter(regexp_extract_all(n, '\\d+'), lambda d: ltrim(d, '0') = '')) = 0
    AND NOT regexp_full_match(n, '\\d+-\\d+-\\d{{4}}') AND NOT regexp_matches(rest, '^[+=<>/*%]') AND NOT regexp_full_match(rest, '\\d+\\.?\\d*')"""

#: Rules of numbers in running text: two segments or more, no measure, no small letter behind.
STRICT = f"""
    len(s) >= 2 AND {COMMON} AND NOT (len(s) = 2 AND len(s[1]) = 1) AND NOT regexp_matches(rest, '^\\p{{Ll}}')
    AND NOT (len(s) = 2 AND regexp_full_match(s[2], '\\.\\d+') AND (len(s[1]) = 2 AND len(s[2]) >= 3 OR CAST(s[2][2:] AS INT) > 50 AND CAST(s[1] AS INT) < 200))"""


def kind(x: str) -> str:
    """The type of a segment."""
    inner = f"regexp_replace({x}, '[()\\[\\].-]', '', 'g')"
    in_brackets = f"CASE WHEN regexp_full_match({inner}, '\\d+') THEN '_INT' WHEN regexp_full_match({inner}, '[ivxlcdmIVXLCDM]+') THEN '_ROMAN' ELSE '_ALPHA' END"
    return f"""CASE {x}[1:1] WHEN '(' THEN 'PAREN' || {in_brackets} WHEN '[' THEN 'BRACK' || {in_brackets}
        WHEN '.' THEN CASE WHEN regexp_full_match({inner}, '\\d+') THEN 'DOT_INT' ELSE 'DOT_ALPHA' END WHEN '-' THEN 'HYPHEN_INT' ELSE 'LEAD_INT' END"""


def value(x: str) -> str:
    """The number a segment stands for: its digits, its Roman numeral, or its first letter's place."""
    inner = f"lower(regexp_replace({x}, '[()\\[\\].-]', '', 'g'))"
    sign = "CASE {0} WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 ELSE 0 END"
    here, after = sign.format(f"{inner}[i:i]"), sign.format(f"{inner}[i + 1:i + 1]")
    roman = f"list_sum(list_transform(range(1, len({inner}) + 1), lambda i: CASE WHEN {here} < {after} THEN -{here} ELSE {here} END))"
    return f"CAST(CASE WHEN regexp_full_match({inner}, '\\d+') THEN CAST({inner} AS BIGINT) WHEN ({kind(x)}) LIKE '%ROMAN' THEN {roman} ELSE ascii({inner}) - 96 END AS BIGINT)"


def without_overlap(texts: str) -> str:
    """The texts of a list one after the other, each without the longest begin of 20 to 200 characters that the text so far ends with."""
    same = "list_max(list_filter(range(20, least(len(a), len(b), 200) + 1), lambda k: right(a, CAST(k AS INT)) = left(b, CAST(k AS INT))))"
    return f"list_reduce({texts}, lambda a, b: CASE WHEN {same} IS NULL THEN a || ' ' || b ELSE a || substr(b, CAST({same} AS INT) + 1) END)"
