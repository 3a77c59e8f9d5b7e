"""Noise of scanned pages: where it is, and the text repaired into paragraphs.

A page is taken apart into furniture (running headers, page numbers) and running text. Running text is
decoded as one stream of characters without line ends. Words are edges of a lattice between places of the
stream: a word may end at a blank or within a run of characters (a blank is missing), go on over blanks
(one too many) or over a line's end with its hyphen, and be printed as it is or with characters taken for
one another, in any combination; the cheapest path wins. Numbers and labels are read through an automaton
of their forms, characters again as they are or as the digits they are taken for. Word frequencies come from
the blocks that were not scanned, and from the scanned ones where nothing more frequent looks alike.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import ChainMap, Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.operators.ordered import forward_fill
from stratadoc.session import cut

#: Words that are sent to every task, the most frequent ones; the others go to the pages they may stand on, by a join.
VOCABULARY = 200_000
#: Furniture repeats on at least this share of a file's pages, or of the pages in a stretch of them, and on two.
REPEATED = 0.1
#: Pages in a stretch. There are two rows of stretches, one half a stretch later, so neighbours always share one.
STRETCH = 20
#: Lines at either end of a page that may be furniture, and the characters a running header is shorter than.
EDGE_LINES, HEADER_CHARS = 3, 120
#: Costs of a confused character, of a blank that is missing or too many, and of a number with confused characters.
CONFUSED, BLANK, NUMBER_COST = 5.0, 8.0, 12.0

# Groups of characters that recognition takes for one another; the first stands for all.
PAIRS = {"vv": "w", "rn": "m", "ri": "n", "cl": "d", "ii": "u"}
ALIKE = ("a@", "b6", "c¢e€", "gq9", "i1l|!í", "o0ó", "s5$", "t†+", "z2")
DIGIT_FOR = {"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "b": "6", "q": "9", "g": "9"}
HYPHENS = "-‐‑¬\xad"

_CLASS = str.maketrans({c: group[0] for group in ALIKE for c in group} | {"h": "b"})
_DIGITS = str.maketrans(DIGIT_FOR)
_TOKEN = re.compile(r"\S+")
_EDGE = " .,;:!?()[]{}\"'“”‘’«»"
_NUMBER = r"(?:[0-9lIOoSsB|]{1,5}(?:-[0-9lIOoSsB|]{1,5})?|[ivx]{1,7})"
_REFERENCE = re.compile(r"#?\d{1,3}(?:,\d{3})+(?:\.\d+)?|#?\d+(?:-\d+)*(?:\.\d+)*(?:\((?:\d+|[a-z]{1,4})\))*|\d+[A-HJ-NP-RT-Z](?:\.\d+)?(?:\((?:\d+|[a-z]{1,4})\))*")
_PAIR = re.compile("|".join(PAIRS))


@lru_cache(maxsize=500_000)
def skeleton(word: str) -> str:
    """What a word looks like: characters that are taken for one another become the same."""
    word = word.lower()
    while (shorter := _PAIR.sub(lambda m: PAIRS[m.group()], word)) != word:
        word = shorter
    return word.translate(_CLASS)


#: What a printed run of characters may stand for.
MEANT: dict[str, list[str]] = {}
for _group in ALIKE:
    for _c in _group:
        MEANT.setdefault(_c, []).extend(x for x in _group if x != _c and x.isalpha() and x.isascii())
for _shown, _true in PAIRS.items():
    MEANT.setdefault(_shown, []).append(_true)
    MEANT.setdefault(_true, []).append(_shown)
MEANT["h"], MEANT["b"] = [*MEANT.get("h", []), "b"], [*MEANT.get("b", []), "h"]
_WIDTHS = sorted({len(k) for k in MEANT}, reverse=True)


def one_change(word: str) -> Iterator[str]:
    """The words that ``word`` may be a misreading of, with one run of characters taken for another."""
    for i in range(len(word)):
        for n in _WIDTHS:
            for true in MEANT.get(word[i : i + n], ()) if i + n <= len(word) else ():
                yield word[:i] + true + word[i + n :]


_REPS = str.maketrans({c: group[0] for group in ALIKE for c in group} | {"h": "b"})
_REP_PAIR = re.compile("vv|rn|ri|ci|ii")
_REP_MEANS = {k.translate(_REPS): v.translate(_REPS) for k, v in PAIRS.items()}


@lru_cache(maxsize=300_000)
def look(word: str) -> str:
    """The same for words that differ by confused characters, any number of them; coarser than ``skeleton``."""
    word = word.translate(_REPS)
    while (shorter := _REP_PAIR.sub(lambda m: _REP_MEANS[m.group()], word)) != word:
        word = shorter
    return word


def confusions(shown: str, true: str, most: int) -> int | None:
    """The least number of confused runs that make ``true`` look like ``shown``, None if more than ``most``."""
    row = {0: 0}  # characters of true that are accounted for, and the confusions so far
    ahead: list[dict[int, int]] = [row] + [{} for _ in shown]
    for i in range(len(shown)):
        for j, n in ahead[i].items():
            if j < len(true) and shown[i] == true[j] and n < ahead[i + 1].get(j + 1, most + 1):
                ahead[i + 1][j + 1] = n
            for width in _WIDTHS:
                for x in MEANT.get(shown[i : i + width], ()) if i + width <= len(shown) else ():
                    if true.startswith(x, j) and n + 1 < ahead[i + width].get(j + len(x), most + 1):
                        ahead[i + width][j + len(x)] = n + 1
    return ahead[len(shown)].get(len(true))


class Lexicon:
    """Cost of each known word, and the known word an unknown one is most likely a misreading of.

    Words of clean text are known. A word only scans hold is known if it is frequent and no known word
    that is five times as frequent looks like it. ``more`` words can be added on top of another lexicon.
    """

    def __init__(self, counts: list[tuple[str, int, int]], base: Lexicon | None = None):
        """``counts``: word, times in clean text, times in scanned text."""
        own: dict[str, int] = {w: clean for w, clean, _ in counts if clean}
        self.count = ChainMap(own, base.count) if base else own
        for w, clean, scans in sorted(counts, key=lambda x: (-x[2], x[0])):
            if not clean and scans >= 25 and re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", w):
                if all(self.count.get(x, 0) < 5 * scans and self.count.get(x, 0) < 20 for x in one_change(w)):
                    own[w] = scans
        self.total = base.total if base else sum(own.values()) + 1
        cost = {w: math.log(self.total / n) for w, n in own.items()}
        self.cost = ChainMap(cost, base.cost) if base else cost
        self.unknown = math.log(self.total) + 6
        self.least = min([*cost.values(), *([base.least] if base else [])], default=0.0)
        self.longest = max([*map(len, own), *([base.longest] if base else [])], default=0)
        self.words = sorted(own)
        self.by_look: dict[str, list[str]] = {}
        for w in self.words:
            if sum(c.isalpha() for c in w) > 1 and not _REFERENCE.fullmatch(w.upper()):
                self.by_look.setdefault(look(w), []).append(w)
        self.base = base
        self._meant: dict[str, tuple[int, str] | None] = {}

    def more(self, counts: list[tuple[str, int, int]]) -> Lexicon:
        return Lexicon(counts, self)

    def begins(self, low: str) -> bool:
        """Whether a known word begins so."""
        at = bisect_left(self.words, low)
        return at < len(self.words) and self.words[at].startswith(low) or bool(self.base and self.base.begins(low))

    def _looking(self, form: str) -> Iterator[str]:
        yield from self.by_look.get(form, ())
        if self.base:
            yield from self.base._looking(form)

    def meant(self, low: str) -> tuple[int, str] | None:
        """The known word that ``low`` shows with the fewest confusions, of these the most frequent, and their number."""
        if low not in self._meant:
            if len(self._meant) > 300_000:
                self._meant.clear()
            self._meant[low] = self._search(low)
        return self._meant[low]

    def _search(self, low: str) -> tuple[int, str] | None:
        if len(low) < 2 or len(low) > 2 * self.longest:
            return None
        near = [x for x in one_change(low) if x in self.count and sum(c.isalpha() for c in x) > 1 and not _REFERENCE.fullmatch(x.upper())]
        if near:
            return 1, max(near, key=lambda x: (self.count[x], x))
        most = max(2, len(low) // 3)
        forms = {look(low), *(look(x) for x in one_change(low))}
        found = [(n, -self.count[x], x) for f in forms for x in self._looking(f) if (n := confusions(low, x, most))]
        return (min(found)[0], min(found)[2]) if found else None

    def read(self, word: str) -> tuple[float, str]:
        """Cost of a printed word and the word it stands for (itself where it is known or nothing is near)."""
        low = word.lower()
        if low in self.cost:
            return self.cost[low], word
        if _REFERENCE.fullmatch(word):
            return self.unknown - 1, word
        near, new = self.meant(low), self.unknown + 2 * len(low)
        return min((new, word), (self.cost[near[1]] + CONFUSED * near[0], near[1])) if near else (new, word)


class Forms(NamedTuple):
    """An automaton: from each state the next one by the kind of a character, and the states a form may end in.
    Kinds are 0 for a digit, A for a capital that is not like a digit, a for a small letter, and signs themselves."""

    steps: dict[str, dict[str, str]]
    ends: frozenset[str]


# The forms of section and other numbers. In the states' names d are digits, h those behind a hyphen, f behind a dot, c a capital.
_BRACKET = {"(": "open"}
_TAIL = {"open": {"0": "number", "a": "letter"}, "number": {"0": "number", ")": "closed"}, "closed": _BRACKET, "dot": {"0": "f"}, "f": {"0": "f", ".": "dot", **_BRACKET}, "hyphen": {"0": "h"}, "h": {"0": "h", "-": "hyphen", ".": "dot", **_BRACKET}}
_MAIN = {"0": "d", "-": "hyphen", ".": "dot", "A": "c", **_BRACKET}
LABEL_FORMS = Forms(
    _TAIL | {"": {"0": "d"}, "d": _MAIN, "c": {".": "c dot"}, "c dot": {"0": "c f"}, "c f": {"0": "c f", **_BRACKET}, "letter": {")": "closed", "r": "roman"}, "roman": {")": "closed", "r": "roman"}},
    frozenset(("d", "h", "f", "c f", "closed")),
)
TEXT_FORMS = Forms(
    _TAIL
    | {"": {"0": "1", "#": "sign"}, "sign": {"0": "1"}, "1": _MAIN | {"0": "2", ",": "t"}, "2": _MAIN | {"0": "3", ",": "t"}, "3": _MAIN | {"0": "d", ",": "t"}, "d": _MAIN}
    | {"t": {"0": "t1"}, "t1": {"0": "t2"}, "t2": {"0": "t3"}, "t3": {",": "t", ".": "t dot"}, "t dot": {"0": "t f"}, "t f": {"0": "t f"}}
    | {"c": {".": "c dot", **_BRACKET}, "c dot": {"0": "c f"}, "c f": {"0": "c f", **_BRACKET}}
    | {"letter": {"a": "letter 2", ")": "closed"}, "letter 2": {"a": "letter 3", ")": "closed"}, "letter 3": {"a": "letter 4", ")": "closed"}, "letter 4": {")": "closed"}},
    frozenset(("1", "2", "3", "d", "h", "f", "c", "c f", "closed", "t3", "t f")),
)


def as_number(text: str, forms: Forms) -> tuple[int, str] | None:
    """The form that ``text`` shows with the fewest characters taken for digits, and their number; None if it is
    like none. The path through the automaton is found from left to right."""
    paths: dict[str, tuple[int, str]] = {"": (0, "")}
    for c in text:
        after: dict[str, tuple[int, str]] = {}
        kinds = [("0", c, 0)] if c.isdigit() else [("A", c, 0)] if re.match("[A-HJ-NP-RT-Z]", c) else [("a", c, 0)] if re.match("[a-z]", c) else [(c, c, 0)]
        if c in "ivx":
            kinds.append(("r", c, 0))
        if c in DIGIT_FOR:
            kinds.append(("0", DIGIT_FOR[c], 1))
        for state, (n, read) in paths.items():
            for kind, shown, wrong in kinds:
                to = forms.steps.get(state, {}).get(kind)
                if to is None and kind == "a" and c in "ivx":
                    to = forms.steps.get(state, {}).get("r")
                if to is not None and (n + wrong, read + shown) < after.get(to, (n + wrong + 1, "")):
                    after[to] = n + wrong, read + shown
        paths = after
    return min((paths[s] for s in paths if s in forms.ends), default=None)


@lru_cache(maxsize=200_000)
def _number_in(token: str) -> str | None:
    core = token.strip(" .,;:[]\"'“”")
    if core.count("(") != core.count(")"):
        core = core.strip("()")
    if not core or not any(c.isdigit() for c in core) and (not set(core) <= set("lIOoS|") or len(core) < 2 or core in ("OS", "SO", "So", "oS", "Io", "IS", "Is", "ll")):
        return None
    read = as_number(core, TEXT_FORMS)
    return read[1] if read and read[0] else None


def misread_number(token: str, lexicon: Lexicon | None = None) -> str | None:
    """The number or reference meant by a token with letters in the place of digits, else None."""
    return None if lexicon and token.strip(" .,;:[]\"'“”()").lower() in lexicon.cost else _number_in(token)


def is_page_number(line: str, lexicon: Lexicon | None = None) -> bool:
    """A line that holds only a printed page number, also a misread one."""
    core = re.sub(r"^[\s\[({<|–—~=*.-]+|[\s\])}>|–—~=*.-]+$", "", line)
    first, _, rest = core.partition(" ")
    if skeleton(first.rstrip(".")) in (skeleton("page"), skeleton("pg"), skeleton("p")) and rest:
        core, labelled = rest.strip(), True
    else:
        labelled = False
    m = re.fullmatch(rf"({_NUMBER})(?:\s*(?:[oO0][fFt]|/)\s*({_NUMBER}))?", core)
    if not m:
        return False
    shown = m.group(1)
    if any(c.isdigit() for c in shown) or labelled:
        return True
    return bool(re.fullmatch(r"[ivx]+", shown)) or (len(shown) <= 3 and not (lexicon and shown.lower() in lexicon.cost))


def furniture_look(line: str) -> str:
    """Skeleton of a header line without a page number at either end."""
    core = re.sub(rf"^\s*[\[(-]?\s*{_NUMBER}\s*[\])-]?\s{{2,}}|\s{{2,}}[\[(-]?\s*{_NUMBER}\s*[\])-]?\s*$|\s*\|\s*(?:[Pp]age )?{_NUMBER}\s*$|^\s*{_NUMBER}\s*\|\s*", " ", line)
    return skeleton(re.sub(r"\s+", " ", core).strip(" -–|·•"))


def _near(a: str, b: str) -> bool:
    """Whether two skeletons differ by few characters."""
    most = max(1, len(b) // 6)
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


def edge_lines(lines: list[str]) -> list[int]:
    """Places of the first and last ``EDGE_LINES`` lines that are not blank."""
    at = [i for i, line in enumerate(lines) if line.strip()]
    return list(dict.fromkeys([*at[:EDGE_LINES], *at[::-1][:EDGE_LINES]]))


def furniture(lines: list[str], headers: list[str], lexicon: Lexicon | None = None) -> dict[int, str]:
    """Places of a page's running headers and page numbers: from the outside in, as long as there are any."""
    at = [i for i, line in enumerate(lines) if line.strip()]
    found: dict[int, str] = {}
    for side in (at[:EDGE_LINES], at[::-1][:EDGE_LINES]):
        for i in side:
            if i in found:
                break
            if is_page_number(lines[i], lexicon) and "page_number" not in [found.get(j) for j in side]:
                found[i] = "page_number"
            elif len(lines[i]) < HEADER_CHARS and any(_near(furniture_look(lines[i]), h) for h in headers):
                found[i] = "running_header"
            else:
                break
    return found


class Token(NamedTuple):
    line: int
    text: str
    last: bool  # the last of its line


def stream(lines: list[str], skip: Iterable[int]) -> list[Token]:
    """The tokens of the lines outside ``skip``; a hyphen after a blank at a line's end belongs to the token before."""
    out, skip = [], set(skip)
    for i, line in enumerate(lines):
        if i not in skip:
            parts = _TOKEN.findall(line)
            out += [Token(i, t, k == len(parts) - 1) for k, t in enumerate(parts)]
    return out


def _bare(token: str) -> tuple[str, str, str]:
    """A token's marks in front, its word and its marks behind."""
    left, right = len(token) - len(token.lstrip(_EDGE)), len(token.rstrip(_EDGE))
    if right < len(token) and token[right] == ")" and "(" in token[left:right]:
        right += 1
    return (token[:left], token[left:right], token[right:]) if right > left else (token, "", "")


def _cased(word: str, like: str) -> str:
    return word[:1].upper() + word[1:] if like[:1].isupper() and word[:1].islower() else word


class Reading(NamedTuple):
    """One word of the decoded stream: its text, the tokens it covers, whether a hyphen was taken out, and
    which of the tokens were misread."""

    text: str
    first: int
    last: int
    hyphen: bool
    misread: tuple[int, ...]


#: Letters, and digits that may stand for some.
_LETTERS = re.compile(r"(?=\d*[^\W\d_])[^\W_]+")


class Lattice:
    """The cheapest path through the words of a character stream. A place is (token, offset in its word), the
    end of a token and the begin of the next being one place."""

    def __init__(self, tokens: list[Token], lexicon: Lexicon):
        self.tokens, self.lexicon = tokens, lexicon
        self.parts = [_bare(t.text) for t in tokens]
        self.reads = [lexicon.read(w) if w else (0.0, w) for _, w, _ in self.parts]
        self.known = [c <= lexicon.unknown and m == w for (c, m), (_, w, _) in zip(self.reads, self.parts)]
        self.best: list[dict[int, tuple[float, tuple[int, int] | None, Reading | None]]] = [{} for _ in range(len(tokens) + 1)]
        self.best[0][0] = (0.0, None, None)

    def path(self) -> list[Reading]:
        for i, places in enumerate(self.best[:-1]):
            done: set[int] = set()
            while len(done) < len(places):
                k = min(places.keys() - done) if len(places) > 1 else 0 if 0 in places else min(places)
                done.add(k)
                self._from(i, k)
        out, at = [], (len(self.tokens), 0)
        while at != (0, 0):
            _, at, reading = self.best[at[0]][at[1]]
            out.append(reading)
        return out[::-1]

    def _offer(self, i: int, k: int, to: tuple[int, int], cost: float, text: str, hyphen: bool = False, misread: tuple[int, ...] = ()) -> None:
        total, there = self.best[i][k][0] + cost, self.best[to[0]]
        if to[1] not in there or total < there[to[1]][0]:
            there[to[1]] = total, (i, k), Reading(text, i, max(i, to[0] - (to[1] == 0)), hyphen, misread)

    def _from(self, i: int, k: int) -> None:
        """Every word that may begin at a place."""
        lexicon, token, (front, whole, back) = self.lexicon, self.tokens[i], self.parts[i]
        word, lead = whole[k:], "" if k else front
        cost, meant = lexicon.read(word) if k and word else self.reads[i]
        known = cost <= lexicon.unknown and meant == word
        if known:
            self._offer(i, k, (i + 1, 0), cost, lead + word + back)
        elif number := misread_number(token.text, lexicon) if not k and cost > lexicon.unknown else None:
            self._offer(i, k, (i + 1, 0), NUMBER_COST, token.text.replace(token.text.strip(" .,;:[]\"'“”"), number), misread=(i,))
            return
        else:
            self._offer(i, k, (i + 1, 0), cost, lead + _cased(meant, word) + back, misread=(i,) if meant != word else ())
            if meant == word and not k:
                self._compound(i, front, word, back)
        if not known or cost > BLANK + 2 * lexicon.least:  # else no two words for it can be cheaper
            self._within(i, k, lead, word, known or meant != word)
        if i + 1 < len(self.tokens):
            if token.last and re.search(rf"[^\W_][{HYPHENS}]$", token.text):
                self._over_line_end(i, k, lead)
            elif word and not back and not self.parts[i + 1][0]:
                self._over_blanks(i, k, lead, word, cost, known)

    def _within(self, i: int, k: int, lead: str, word: str, readable: bool) -> None:
        """Words that end where a blank is missing. Confused ones only where the whole cannot be read."""
        if not _LETTERS.fullmatch(word) or len(word) > 4 * self.lexicon.longest:
            return
        for m in range(2, min(len(word) - 1, self.lexicon.longest + 2)):
            cost, meant = self.lexicon.read(word[:m])
            if cost <= self.lexicon.unknown and (meant == word[:m] or (not readable and m >= 4)):
                self._offer(i, k, (i, k + m), cost + BLANK, lead + _cased(meant, word[:m]), misread=(i,) if meant != word[:m] else ())

    def _over_blanks(self, i: int, k: int, lead: str, word: str, cost: float, known: bool) -> None:
        """Words that go on over one blank or several, as far as known words reach."""
        apart, joined, sound, j, most = cost, word, known, i + 1, self.lexicon.longest + 1
        while j < len(self.tokens):
            mark, rest, _ = self.parts[j]
            if mark or not rest or len(joined) + len(rest) > most:
                break
            sound, apart, joined = sound and self.known[j], apart + self.reads[j][0], joined + rest
            low = joined.lower()
            if sound and not self.lexicon.begins(low):
                break
            if low in self.lexicon.cost:
                self._offer(i, k, (j + 1, 0), self.lexicon.cost[low] + BLANK * (j - i), lead + joined + self.parts[j][2])
            elif not sound and apart > BLANK * (j - i) + CONFUSED + self.lexicon.least and len(joined) >= 5 and _LETTERS.fullmatch(joined) and (near := self.lexicon.meant(low)):
                wrong = self._wrong(near[1], [(x, self.parts[x][1][k if x == i else 0 :]) for x in range(i, j + 1)])
                self._offer(i, k, (j + 1, 0), self.lexicon.cost[near[1]] + CONFUSED * near[0] + BLANK * (j - i), lead + _cased(near[1], joined) + self.parts[j][2], misread=wrong)
            if self.parts[j][2] or self.tokens[j].last and self.tokens[j].text[-1:] in HYPHENS:
                break
            j += 1

    @staticmethod
    def _wrong(meant: str, pieces: list[tuple[int, str]]) -> tuple[int, ...]:
        """Those of the printed pieces of a word that are not as they should be."""
        low = meant.lower()
        bad = tuple(x for n, (x, p) in enumerate(pieces) if not (low.startswith(p.lower()) if n == 0 else low.endswith(p.lower()) if n == len(pieces) - 1 else p.lower() in low))
        return bad or (pieces[0][0],)

    def _over_line_end(self, i: int, k: int, lead: str) -> None:
        """A word cut in two at a line's end, or a compound whose hyphen stands there."""
        lexicon, (_, other, back) = self.lexicon, self.parts[i + 1]
        head = self.tokens[i].text.lstrip(_EDGE)[k:].rstrip(HYPHENS)
        kept = f"{head}-{other}"
        compound, first, rest = lexicon.cost.get(kept.lower()), lexicon.read(head)[0], lexicon.read(other)[0]
        if compound is None and "-" in head and f"{head}-{other.split('-')[0]}".lower() in lexicon.cost:  # the hyphen of a longer compound
            compound = 9.0
        joined, whole = lexicon.read(head + other)
        if compound is None and joined > lexicon.unknown and max(first, rest) <= lexicon.unknown:
            compound = first + rest
        near = lexicon.meant(kept.lower()) if compound is None and joined > lexicon.unknown else None
        if near and "-" in near[1]:
            compound = lexicon.cost[near[1]] + CONFUSED * near[0]
        wrong = self._wrong(whole, [(i, head), (i + 1, other)]) if whole != head + other else ()
        if compound is not None and compound <= joined:
            self._offer(i, k, (i + 2, 0), compound, lead + kept + back)
        else:
            self._offer(i, k, (i + 2, 0), min(joined, 2 * lexicon.unknown), lead + _cased(whole, head) + back, True, wrong)
            if joined > lexicon.unknown and other.isalpha():  # the blank behind the rest is missing too
                for m in range(2, len(other) - 1):
                    if (low := (head + other[:m]).lower()) in lexicon.cost:
                        self._offer(i, k, (i + 1, m), lexicon.cost[low] + BLANK, lead + head + other[:m], True)

    def _compound(self, i: int, front: str, word: str, back: str) -> None:
        """Known and misread words with hyphens or slashes between them."""
        pieces = re.split(r"([-/–])", word)
        if len(pieces) > 1 and all(pieces):
            read = [self.lexicon.read(p) if n % 2 == 0 else (1.0, p) for n, p in enumerate(pieces)]
            if all(c <= self.lexicon.unknown for c, _ in read):
                text = "".join(_cased(m, p) for (_, m), p in zip(read, pieces))
                self._offer(i, 0, (i + 1, 0), sum(c for c, _ in read), front + text + back, misread=(i,) if text != word else ())


def decode(tokens: list[Token], lexicon: Lexicon) -> list[Reading]:
    """The cheapest reading of the token stream."""
    return Lattice(tokens, lexicon).path()


class Edges(NamedTuple):
    """What the first and the last line of a page's running text tell about a paragraph over the page break."""

    starts: bool  # the first line looks like a paragraph's begin
    first_single: bool  # the first paragraph is one line
    ends: bool  # the last line ends a sentence
    short: bool
    cut: bool  # the last line ends in a hyphen
    last_single: bool


def _ends(line: str) -> bool:
    return bool(re.search(r"[.!?:][\"”')\]]*$", line.rstrip()))


def _starts(line: str) -> bool:
    return line.lstrip()[:1].isupper() or bool(re.match(r"\s*[-•*(\d]", line))


def _break_costs(ends: bool, starts: bool, short: bool, cut: bool) -> tuple[float, float]:
    """Costs of a break and of going on between two lines, but for blank lines."""
    return 1.0 + 3 * (not ends) + 2 * (not starts) + 3 * cut, 2.0 * (short and ends)


def goes_on(last: Edges, first: Edges) -> bool:
    """Whether the last paragraph of a page and the first of the next are one: the choice between lines, of
    the two paragraphs alone. There is no blank line to tell by, so a sentence that ends where the page does,
    before a line like a begin, counts as an end."""
    new, on = _break_costs(last.ends, first.starts, last.short, last.cut)
    return on + 2.0 * (last.ends and first.starts) < new + 0.5 * last.last_single + 0.5 * first.first_single


def paragraph_starts(lines: list[str], skip: Iterable[int]) -> tuple[set[int], Edges | None]:
    """Lines that begin a paragraph: at each line end a break costs by how unlike an end it looks, going on
    by how like one it looks, and the cheapest sequence is chosen; very short paragraphs cost extra."""
    kept = [i for i in range(len(lines)) if i not in set(skip)]
    width = max((len(lines[i].rstrip()) for i in kept), default=1) or 1
    full = [i for i in kept if lines[i].strip()]
    if not full:
        return set(), None
    breaks: dict[int, tuple[float, float]] = {}
    for a, b in zip(full, full[1:]):
        blank = any(not lines[j].strip() and j not in skip for j in range(a + 1, b))
        unlike, like = _break_costs(_ends(lines[a]), _starts(lines[b]), len(lines[a].rstrip()) < 0.75 * width, lines[a].rstrip()[-1:] in HYPHENS)
        breaks[b] = (unlike, 5.0 * blank + like)
    best: list[tuple[float, int]] = [(0.0, -1)]  # cost with a paragraph that begins at full[k], where it came from
    inner = [0.0]  # running sums of the costs of going on
    for line in full[1:]:
        inner.append(inner[-1] + breaks[line][1])
    longer = (math.inf, -1)  # the best begin of a paragraph of two lines or more, its cost without the sum up to its end
    for k in range(1, len(full) + 1):
        edge = breaks[full[k]][0] if k < len(full) else 0.0
        cost, j = min((longer[0] + inner[k - 1], longer[1]), (best[k - 1][0] + 0.5, k - 1))
        best.append((cost + edge, j))
        longer = min(longer, (best[k - 1][0] - inner[k - 1], k - 1))
    starts, k = set(), len(full)
    while k > 0:
        k = best[k][1]
        starts.add(full[k])
    last = lines[full[-1]].rstrip()
    return starts, Edges(_starts(lines[full[0]]), len(full) == 1 or full[1] in starts, _ends(last), len(last) < 0.75 * width, last[-1:] in HYPHENS, full[-1] in starts)


def paragraphs(starts: set[int], readings: list[Reading], tokens: list[Token]) -> list[str]:
    """The readings in paragraphs; the first is empty where all its words belong to the page before."""
    out: list[list[str]] = []
    if starts and tokens and tokens[0].line < 0 and (not readings or any(min(starts) < x <= tokens[readings[0].first].line for x in starts)):
        out.append([])
    before = -1
    for r in readings:
        line = tokens[r.first].line
        if not out or (line in starts and r.first != before and r.first and tokens[r.first - 1].line != line):
            out.append([])
        out[-1].append(r.text)
        before = r.first
    return [" ".join(p) for p in out]


def scanned(font_size: Column, font_name: Column) -> Column:
    """Scanned pages have no font."""
    return F.coalesce((font_size == 0) | (F.trim(font_name) == ""), F.lit(False))


def lexicon_of(blocks: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Lexicon, DataFrame | None]:
    """Word counts over all blocks, clean and scanned apart: the ``vocabulary`` most frequent words as a lexicon, and
    ``(word, clean, scanned)`` of the rest, None if there is none."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for text, poor in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if poor:  # without the halves of cut words
                    text = re.sub(rf"\S+[{HYPHENS}]\s*\n\s*\S+|^\S+|\S+$", " ", text or "")
                total.update((w.lower(), poor) for t in (text or "").split() if (w := t.strip(_EDGE)))
            if len(total) > 400_000:
                yield flush(total)
                total.clear()
        yield flush(total)

    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([w for w, _ in total], pa.string()),
                pa.array([0 if poor else n for (_, poor), n in total.items()], pa.int64()),
                pa.array([n if poor else 0 for (_, poor), n in total.items()], pa.int64()),
            ],
            names=["word", "clean", "scanned"],
        )

    kind = scanned(F.col("font_size"), F.col("font_name")).alias("poor")
    counts = blocks.select("text", kind).mapInArrow(count, "word string, clean bigint, scanned bigint")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))
    counts = cut(counts.filter("clean > 0 or scanned >= 25"))
    times = F.col("clean") + F.col("scanned")
    top = counts.orderBy(times.desc(), "word").limit(vocabulary + 1).collect()
    lexicon = Lexicon([(r.word, r.clean, r.scanned) for r in top[:vocabulary]])
    if len(top) <= vocabulary:
        return lexicon, None
    least = top[vocabulary - 1]
    return lexicon, counts.filter((times < least.clean + least.scanned) | ((times == least.clean + least.scanned) & (F.col("word") > least.word)))


def rarer_words(pages: DataFrame, lexicon: Broadcast, rest: DataFrame) -> DataFrame:
    """``(block_id, more)``: for each page the words beyond the lexicon that look like one it does not know, with
    their counts. Words and pages meet by ``look``, so words of any rank are known where they are needed."""

    def unknown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value.cost
        for batch in batches:
            at, forms = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = [t.strip(_EDGE) for t in (text or "").split()]
                cut_words = [a.rstrip(HYPHENS) + b for a, b in zip(tokens, tokens[1:]) if a[-1:] and a[-1] in HYPHENS]
                new = {look(w) for t in (*tokens, *cut_words) if (w := t.lower()) and w not in known}
                at += [i] * len(new)
                forms += new
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(forms, pa.string())], names=["block_id", "form"])

    def looks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([look(w) for w in batch.column(0).to_pylist()], pa.string())], names=["word", "clean", "scanned", "form"])

    key = pages.schema["block_id"].dataType.simpleString()
    asked = pages.select("block_id", "text").mapInArrow(unknown, f"block_id {key}, form string")
    words = rest.select("word", "clean", "scanned").mapInArrow(looks, "word string, clean bigint, scanned bigint, form string")
    return asked.join(words, "form").groupBy("block_id").agg(F.collect_set(F.struct("word", "clean", "scanned")).alias("more"))


def running_headers(pages: DataFrame, share: float = REPEATED) -> DataFrame:
    """``(source_file, row, stretch, headers)``: looks of the lines that repeat at the head or foot of a file's
    pages (row 0) or of a stretch of them (rows 1 and 2), as headers that change by chapter do. A page has at
    most four such lines, each on at least ``share`` of the pages, so few a file and a stretch."""

    def looks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, look = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                seen = {""}
                for k in edge_lines(lines):
                    x = furniture_look(lines[k])
                    if x not in seen and len(lines[k]) < HEADER_CHARS and not is_page_number(lines[k]) and lines[k].rstrip()[-1:] not in ".,;":
                        seen.add(x)
                        at.append(i)
                        look.append(x)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(look, pa.string())], names=["source_file", "page", "look"])

    page = pages.schema["page"].dataType.simpleString()
    found = pages.select("source_file", "page", "text").mapInArrow(looks, f"source_file string, page {page}, look string").distinct()
    places = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), at.alias("stretch")) for r, at in enumerate(stretches())))).alias("at")
    by = ["source_file", "row", "stretch"]
    size = pages.select("source_file", "page").distinct().select("source_file", places).select("source_file", "at.*").groupBy(*by).agg(F.count("*").alias("pages"))
    often = found.select("source_file", "look", places).select("source_file", "look", "at.*").groupBy(*by, "look").agg(F.count("*").alias("n"))
    often = often.join(size, by).filter((F.col("n") >= 2) & (F.col("n") >= share * F.col("pages")))
    return cut(often.groupBy(*by).agg(F.collect_set("look").alias("headers")))


def stretches() -> tuple[Column, ...]:
    """Numbers of the stretches a page is in: the whole file, and one in each row of stretches."""
    return F.lit(0).cast("bigint"), F.floor(F.col("page") / STRETCH), F.floor((F.col("page") + STRETCH // 2) / STRETCH)


#: What is kept of the page before and after: the end of a word cut in two, and its rest.
EDGE_TOKENS = "source_file string, page int, opens string, closes string"


def page_rows(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Scanned pages with their file's headers, the first token of the next page (``rest``) and, where the
    page before ends in a cut word, its last token (``begun``)."""
    pages = blocks.filter(scanned(F.col("font_size"), F.col("font_name"))).select("block_id", "source_file", F.col("page").cast("int").alias("page"), "text")
    for r, at in enumerate(stretches()):
        part = headers.filter(F.col("row") == r).select("source_file", F.col("stretch").alias("_at"), F.col("headers").alias(f"_{r}"))
        pages = pages.withColumn("_at", at).join(part, ["source_file", "_at"], "left").drop("_at")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*(F.coalesce(f"_{r}", none) for r in range(3))))
    pages = pages.select("block_id", "source_file", "page", "text", every.alias("headers"))

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opens, closes = [], []
            for text, heads in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = (text or "").split("\n")
                tokens = stream(lines, furniture(lines, heads or []))
                opens.append(tokens[0].text if tokens else None)
                closes.append(tokens[-1].text if tokens and re.search(rf"[^\W_][{HYPHENS}]$", tokens[-1].text) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(opens, pa.string()), pa.array(closes, pa.string())], names=["source_file", "page", "opens", "closes"])

    edge = pages.select("source_file", "page", "text", "headers").mapInArrow(edges, EDGE_TOKENS)
    edge = cut(edge.groupBy("source_file", "page").agg(F.min("opens").alias("opens"), F.min("closes").alias("closes")))
    after = edge.filter("opens is not null").select("source_file", (F.col("page") - 1).alias("page"), F.col("opens").alias("rest"))
    before = edge.filter("closes is not null").select("source_file", (F.col("page") + 1).alias("page"), F.col("closes").alias("begun"))
    return pages.join(after, ["source_file", "page"], "left").join(before, ["source_file", "page"], "left").select("block_id", "source_file", "page", "text", "headers", "rest", "begun")


def repair_page(text: str | None, headers: list[str], rest: str | None, begun: str | None, lexicon: Lexicon) -> tuple[list[tuple[int, str]], list[str], Edges | None]:
    """``(line number from 1, kind of noise)``, the repaired paragraphs of one page and its edges. A word cut
    by the page's end is completed here and left out on the next page."""
    lines = (text or "").split("\n")
    lines = [x.rstrip("\r") for x in lines]
    found = furniture(lines, headers, lexicon)
    tokens = stream(lines, found)
    ends_open = bool(tokens) and bool(re.search(rf"[^\W_][{HYPHENS}]$", tokens[-1].text)) and bool(rest)
    given = [*([Token(-1, begun, True)] if begun and tokens else []), *tokens, *([Token(len(lines), rest, True)] if ends_open else [])]
    readings = decode(given, lexicon)
    noise = {(i, kind) for i, kind in found.items()}
    for r in readings:
        if r.hyphen:
            noise.add((given[r.first].line, "hyphen"))
        noise |= {(given[k].line, "misread") for k in r.misread}
    if tokens and not rest and re.search(rf"[a-z]{{2}}[{HYPHENS}]$", tokens[-1].text) and lexicon.read(tokens[-1].text.strip(_EDGE + HYPHENS))[0] > lexicon.unknown:
        noise.add((tokens[-1].line, "hyphen"))  # the rest is on a page that is not here
    own = [r for r in readings if given[r.first].line >= 0 and given[r.first].line < len(lines)]
    starts, edges = paragraph_starts(lines, found)
    return sorted((i + 1, kind) for i, kind in noise if 0 <= i < len(lines)), paragraphs(starts, own, given), edges


_LABEL_NUMBER = re.compile(r"\d+(?:-\d+)*(?:\.\d+)*(?:\((?:\d+|[a-z]|[ivx]+)\))*|\d+[A-HJ-NP-RT-Z]\.\d+(?:\((?:\d+|[a-z]|[ivx]+)\))*")
_LABEL_WORDS = ("part", "section", "chapter", "article", "appendix", "division", "title", "subpart", "figure", "table", "exhibit", "annex", "unit", "volume")
_LABEL_LOOKS = {skeleton(w): w for w in _LABEL_WORDS}


@lru_cache(maxsize=200_000)
def repaired_label(label: str | None) -> str | None:
    """The section label or printed page meant by one with misrecognised characters, else None."""
    text = re.sub(r"\s+", " ", label or "").strip()
    if not text or text.upper() == "UNKNOWN" or _LABEL_NUMBER.fullmatch(text) or re.fullmatch(r"[ivx]+|[IVX]{2,}|[A-Z]-?\d+(?:[.-]\d+)*", text) and not re.match(r"[SOIl]-?\d", text):
        return None
    word, _, number = text.rpartition(" ")
    if word:
        meant = _LABEL_LOOKS.get(skeleton(word))
        new_word = _cased(meant, word) if meant and meant != word.lower() else word
        if meant is None or not number:
            return None
        if re.fullmatch(r"[IVXLC]{2,}|[A-Z]|[VX]", number) and number not in ("O", "S", "I"):
            return f"{new_word} {number}" if new_word != word else None
    else:
        new_word, number = "", text
    read = as_number(number, LABEL_FORMS)
    repaired = f"{new_word} {read[1]}".strip() if read else None
    return repaired if repaired and repaired != text else None


def label_noise(df: DataFrame, key: Column, fields: tuple[str, ...]) -> DataFrame:
    """``(record_key, field, printed, repaired)`` of the labels with misrecognised characters, once each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(keys[i], f, v, new) for k, f in enumerate(fields, 1) for i, v in enumerate(batch.column(k).to_pylist()) if (new := repaired_label(v))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names=["record_key", "field", "printed", "repaired"])

    return df.select(key.cast("string").alias("record_key"), *fields).mapInArrow(run, "record_key string, field string, printed string, repaired string").distinct()


def _with_more(lexicon: Lexicon, more: list[dict] | None) -> Lexicon:
    return lexicon.more([(x["word"], x["clean"], x["scanned"]) for x in more]) if more else lexicon


class PageRepair:
    """Repair of the scanned pages of ``blocks`` and of the labels of ``blocks`` and ``chunks``.

    ``blocks`` needs ``block_id, source_file, text, page, doc_page, section, font_size, font_name``,
    ``chunks`` ``id, section``; other columns are ignored. Null and empty texts have no lines with noise,
    null and UNKNOWN labels are no noise; a page without a known page number or file is repaired on its
    own. Repeated rows of a key give their noise once. Empty tables give empty results. Texts are read
    whole, of any length.
    """

    def __init__(self, blocks: DataFrame, chunks: DataFrame, vocabulary: int = VOCABULARY, share: float = REPEATED):
        self.blocks, self.chunks = blocks, chunks
        lexicon, rest = lexicon_of(blocks, vocabulary)
        self.sent = blocks.sparkSession.sparkContext.broadcast(lexicon)
        pages = blocks.filter(scanned(F.col("font_size"), F.col("font_name")))
        self.pages = page_rows(blocks, running_headers(pages, share))
        if rest is None:
            self.pages = self.pages.withColumn("more", F.lit(None).cast("array<struct<word:string,clean:bigint,scanned:bigint>>"))
        else:
            self.pages = self.pages.join(rarer_words(pages, self.sent, rest), "block_id", "left")

    def _each(self, emit, columns: str) -> DataFrame:
        sent, names = self.sent, [c.split()[0] for c in columns.split(", ")]
        types = {"string": pa.string(), "int": pa.int32()}
        kinds = [types[c.split()[1]] for c in columns.split(", ")]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [row for r in batch.to_pylist() for row in emit(str(r["block_id"]), *repair_page(r["text"], r["headers"] or [], r["rest"], r["begun"], _with_more(sent.value, r["more"])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)

        return self.pages.mapInArrow(run, columns)

    def labels(self) -> DataFrame:
        """``(record_key, field, printed, repaired)``."""
        own = label_noise(self.blocks, F.col("block_id"), ("section", "doc_page"))
        return own.unionByName(label_noise(self.chunks, F.col("id"), ("section",)))

    def noise(self) -> DataFrame:
        """``(record_key, line_no, noise)``."""
        lines = self._each(lambda key, noise, *_: [(key, line, kind) for line, kind in noise], "record_key string, line_no int, noise string")
        labels = self.labels().select("record_key", F.lit(0).alias("line_no"), F.col("field").alias("noise"))
        return lines.unionByName(labels).distinct()

    def paragraphs(self) -> DataFrame:
        """``(record_key, paragraph, text)``: the continuous text of each scanned page alone, paragraphs from 0."""
        return self._each(lambda key, _, parts, __: [(key, i, p) for i, p in enumerate(filter(None, parts))], "record_key string, paragraph int, text string").distinct()

    def continuous(self) -> DataFrame:
        """``(record_key, paragraph, text)``: paragraphs with those that go on over page breaks in one, each
        under the page it begins on, numbered there from 0. A page within a longer paragraph has no row.

        Copies of a page give the same rows under their own keys. Where a page has several texts, the first
        and the last of them, by ``block_id``, meet the pages before and after.
        """
        sent = self.sent

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [repair_page(r["text"], r["headers"] or [], r["rest"], r["begun"], _with_more(sent.value, r["more"]))[1:] for r in batch.to_pylist()]
                own = [batch.column(batch.schema.get_field_index(c)) for c in ("keys", "source_file", "page")]
                edges = [e and e._asdict() for _, e in done]
                kind = pa.struct([(f, pa.bool_()) for f in Edges._fields])
                yield pa.RecordBatch.from_arrays([*own, pa.array([p for p, _ in done], pa.list_(pa.string())), pa.array(edges, kind)], names=["keys", "source_file", "page", "parts", "edges"])

        once = self.pages.groupBy("source_file", "page", "text").agg(F.sort_array(F.collect_set("block_id")).alias("keys"), *(F.first(c).alias(c) for c in ("headers", "rest", "begun", "more")))
        key = self.pages.schema["block_id"].dataType.simpleString()
        struct = ", ".join(f"{f}: boolean" for f in Edges._fields)
        units = cut(once.mapInArrow(run, f"keys array<{key}>, source_file string, page int, parts array<string>, edges struct<{struct}>").filter("edges is not null"))
        units = units.withColumn("unit", F.col("keys")[0])
        placed = units.filter("source_file is not null and page is not null").groupBy("source_file", "page")
        before = placed.agg(F.max_by(F.struct("unit", "edges"), "unit").alias("u")).select("source_file", (F.col("page") + 1).alias("page"), F.col("u.unit").alias("left"), F.col("u.edges").alias("last"))
        after = placed.agg(F.min_by(F.struct("unit", "edges"), "unit").alias("u")).select("source_file", "page", F.col("u.unit").alias("unit"), F.col("u.edges").alias("first"))

        def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                on = [goes_on(Edges(**a), Edges(**b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["unit", "left"]).filter(pa.array(on, pa.bool_()))

        links = before.join(after, ["source_file", "page"]).select("unit", "left", "last", "first").mapInArrow(decide, f"unit {key}, left {key}")
        units = cut(units.join(links, "unit", "left"))
        # the paragraph that is open at a page's end begins on the last page that has more than one or is not linked
        own, size = F.col("left").isNull() | (F.size("parts") > 1), F.size("parts") - F.col("left").isNotNull().cast("int") - 1
        root = units.select("source_file", "page", "unit", F.when(own, F.concat_ws(" ", "unit", size)).alias("root"))
        root = forward_fill(root, "source_file", "page", ["root"], ["unit"], unknown="").select(F.col("unit").alias("left"), F.split("root", " ").alias("root"))
        pieces = units.select("unit", "left", "keys", "page", F.posexplode("parts").alias("i", "text"))
        new = pieces.filter("left is null or i > 0").select("unit", (F.col("i") - F.col("left").isNotNull().cast("int")).alias("paragraph"), "keys", "page", "text")
        on = pieces.filter("left is not null and i = 0").join(root, "left").select(F.col("root")[0].cast(key).alias("unit"), F.col("root")[1].cast("int").alias("paragraph"), F.lit(None).cast(f"array<{key}>").alias("keys"), "page", "text")
        whole = new.unionByName(on).groupBy("unit", "paragraph").agg(F.max("keys").alias("keys"), F.sort_array(F.collect_list(F.struct("page", "text"))).alias("x"))
        text = F.array_join(F.filter(F.col("x.text"), lambda t: t != ""), " ").alias("text")
        return whole.select(F.explode("keys").alias("record_key"), "paragraph", text).filter("text != ''").withColumn("record_key", F.col("record_key").cast("string"))
