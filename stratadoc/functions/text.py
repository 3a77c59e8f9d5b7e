"""Text functions as Column expressions; all stay inside code generation, none needs a UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratadoc.schema import UNKNOWN

#: Any white space, no-break and other Unicode blanks included.
SPACE = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]"
SPACE_ENDS = rf"^{SPACE}+|{SPACE}+$"
#: Words a chunk repeats of the one before are looked for in this many characters, and in no fewer than MIN_OVERLAP.
MAX_OVERLAP, MIN_OVERLAP = 200, 20
CONTEXT_CHARS = 1000
TOC_SHARE = 0.15

# Terms that name an agency in a query, in order of precedence, and the agency.
AGENCY_TERMS = {
    "OSHA": "OSHA",
    "29 CFR": "OSHA",
    "CFR 1926": "OSHA",
    "MUTCD": "FHWA",
    "FHWA": "FHWA",
    "FEDERAL HIGHWAY": "FHWA",
    "USACE": "USACE",
    "ARMY CORPS": "USACE",
    "EM 1110": "USACE",
    "EPA": "EPA",
    "NPDES": "EPA",
    "CGP": "EPA",
    "WSDOT": "WSDOT",
    "ADA": "ADA",
    "PROWAG": "ADA",
    "AASHTO": "AASHTO",
}
# Fixed value: what the retrieval model expects before a query.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
# Forms of section numbers in a query.
SECTION_IN_QUERY = r"\b(?:\d{4}\.\d[\d.()a-zA-Z]*|[A-Z]\d+\.\d+|\d+-\d+\.\d[\d.()]*)"
# Marks that keep a block from being a heading.
SENTENCE_BREAK = r"\.\s+[A-Z]"
LIST_MARK = r"^[•–—▪◦]\s"
CAPTION = r"(?i)^(?:Exhibit|Figure|Table|Fig\.?)\s+\d"
WEB_ADDRESS = r"(?i)(?:www\.|https?://|\.gov|\.org|\.com)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, SPACE_ENDS, "")


def words(c: Column) -> Column:
    """The runs of characters between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# How a declined answer is worded, and how pages are printed: after the word page, as two numbers
# with a hyphen, and at the end of a line.
DECLINE = r"(?s)\n*The provided standards do not address[^\n]*\n?.*?\^\^\^FAIL\^\^\^"
PAGE_WORD, PAGE_PAIR = r"(?i)page\s+([ivxlcdm]+|\d{1,4}(?:-\d{1,4})?)", r"\b(\d{1,4}-\d{1,4})\b"
PAGE_ENDS = (r"(?:Page|PAGE)\s+(\d+)$", r"(\d{1,4}-\d{1,4})$", r"(?:^|\D)(\d{1,4})$")


def clean_page_text(c: Column) -> Column:
    """Form feeds dropped, line ends unified, blank lines reduced to one, blanks before line ends dropped."""
    steps = ((r"\f", ""), (r"\r\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"))
    return stripped(reduce(lambda x, s: F.regexp_replace(x, *map(F.lit, s)), steps, c))


def toc_ratio(c: Column) -> Column:
    """Share of full stops and ellipses among the characters, 0 for an empty text."""
    dots = F.length(c) - F.length(F.translate(c, ".…", ""))
    return F.coalesce(F.try_divide(dots, F.length(c)), F.lit(0.0))


def is_toc(c: Column) -> Column:
    return toc_ratio(c) > TOC_SHARE


def printed_page(c: Column) -> Column:
    """Printed page number in a header or footer, '' if none: after the word page, else two numbers with a
    hyphen, both below 5,000, else a text that is one number of up to four digits but no year."""
    text = stripped(c)
    keyword = found(text, PAGE_WORD)
    pair = found(text, PAGE_PAIR)
    small = F.forall(F.split(pair, "-"), lambda x: x.cast("int") < 5000)
    alone = F.when(text.rlike(r"^\d{1,4}$") & ~text.cast("int").between(1900, 2099), text)
    return F.coalesce(keyword, F.when(small, pair), alone, F.lit(""))


def last_line_page(text: Column, section: Column) -> Column:
    """Printed page number at the end of a page's last line that is not blank; neither the section itself,
    nor four digits, nor ending in 2,000 or more. Else the first hyphenated pair in the first 500 characters."""
    lines = F.filter(F.transform(F.split(stripped(text), r"\r\n|\r|\n"), stripped), lambda x: x != "")
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    shown = F.coalesce(*(found(last, p) for p in PAGE_ENDS))
    tail = F.element_at(F.split(shown, "-"), -1).cast("bigint")
    usable = (shown != F.coalesce(section, F.lit(""))) & ~shown.rlike(r"^\d{4}$") & (tail < 2000)
    pair = found(F.substring(text, 1, 500), r"(?:^|\D)(\d{1,4}-\d{1,4})(?!\d)")
    return F.coalesce(F.when(usable, shown), pair, F.lit(UNKNOWN))


def has_section_number(c: Column) -> Column:
    return c.rlike(SECTION_IN_QUERY)


def agency_of_query(c: Column) -> Column:
    """Agency of the first term the upper-cased query contains, null if none."""
    return F.coalesce(*(F.when(F.upper(c).contains(term), F.lit(agency)) for term, agency in AGENCY_TERMS.items()))


def strip_thinking(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def strip_spurious_fail(c: Column) -> Column:
    """An answer with citations loses its decline sentence and FAIL marker."""
    declined = stripped(F.regexp_replace(c, DECLINE, ""))
    return F.when(c.rlike(r"\^\^\^\d+\^\^\^") & c.contains("^^^FAIL^^^"), stripped(F.replace(declined, F.lit("^^^FAIL^^^"), F.lit("")))).otherwise(c)


def remove_overlap(a: Column, b: Column) -> Column:
    """``b`` after ``a`` without the longest end of ``a`` that ``b`` begins with, of 20 to 200 characters; a
    blank between them where there is none."""
    most = F.least(F.length(a), F.length(b), F.lit(MAX_OVERLAP))
    lengths = F.when(most >= MIN_OVERLAP, F.sequence(most, F.lit(MIN_OVERLAP), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    same = F.filter(lengths, lambda n: F.right(a, n) == F.left(b, n))
    return F.when(F.size(same) > 0, F.concat(a, F.substr(b, F.element_at(same, 1) + 1))).otherwise(F.concat(a, F.lit(" "), b))


def joined_without_overlap(texts: Column) -> Column:
    """The texts of an array put together from left to right with ``remove_overlap``."""
    return F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), F.element_at(texts, 1), remove_overlap)


def capped(c: Column, most: int = CONTEXT_CHARS) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def without_pdf(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.pdf$", "")


def chunk_id(file: Column, page: Column, index: Column) -> Column:
    return F.concat(file, F.lit("__p"), page, F.lit("__c"), index)


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first letter and small ones after it, also behind a hyphen."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|[^A-Za-z]+)")), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def path_metadata(path: Column, no_state: str = "") -> dict[str, Column]:
    """Place of a file in the hierarchy, from its path relative to the root: federal/country/agency/file,
    state/code/agency/file, local/code/place/agency/file or local/code/place/file. Others are UNKNOWN."""
    parts = F.split(path, "/")
    n, tier = F.size(parts), F.upper(F.get(parts, F.lit(0)))
    upper = [F.upper(F.get(parts, F.lit(i))) for i in range(4)]
    deep = (n >= 4) & tier.isin("FEDERAL", "STATE", "LOCAL")
    place = title_case(F.get(parts, F.lit(2)))
    local_agency = F.when(n >= 5, upper[3]).otherwise(F.upper(place))
    return {
        "source_file": F.element_at(parts, -1),
        "jurisdiction": F.when(deep, tier).otherwise(UNKNOWN),
        "state": F.when(deep, upper[1]).otherwise(no_state),
        "locality": F.when(deep & (tier == "LOCAL"), place).otherwise(""),
        "agency": F.when(deep, F.when(tier == "LOCAL", local_agency).otherwise(upper[2])).otherwise(UNKNOWN),
    }


def client_address(direct: Column, forwarded: Column) -> Column:
    """The direct address unless it is this host; then the last forwarded one."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.when(direct.isin("127.0.0.1", "::1", "localhost") & (last != ""), last).otherwise(direct)


def embedding_input(c: Column, most: int = 250) -> Column:
    """What is embedded of a text: its first ``most`` words, without runs of three or more dots."""
    some = F.array_join(F.slice(words(c), 1, most), " ")
    return stripped(F.regexp_replace(F.regexp_replace(some, r"[.…]{3,}", " "), r"[ \t]+", " "))
