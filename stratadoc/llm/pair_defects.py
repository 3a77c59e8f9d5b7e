"""Defective query-response pairs: empty, refusal, echo, language and truncated answers.

Copies show when a response is compressed with its query as a zstandard dictionary, and the query with the
response as one. The other labels come from dictionaries (languages, declining, placeholders), widened by
counts over the whole log, and from a model of the contexts in which complete answers end: their closing
marks, and the last one to three words before them.

Texts of a batch are taken apart together (``wordscan``); words, pairs of words and contexts are hashes, so
counting and scoring are array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.wordscan import U64, Words, runs, slices

#: Features that fewer rows than this share hold are left out of the models, so those are bounded at any size.
RARE = 1 / 4096
#: Bytes that may be left of a response compressed with its query, and of the query with it, beyond those of a copy.
ECHO_BYTES = 6
#: Words a context must have come with before it tells whether answers end there.
SEEN = 20
SLICE, COUNTED = 1 << 20, 1 << 23

# Function words of the languages told apart.
FUNCTION_WORDS = {
    "de": "aber als am an auf aus bei bis das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist kann können mit muss müssen nach nicht noch oder ohne sich sie sind so über um und unter vom von vor wann was welche welcher welches wenn wer werden wie wird wo zu zum zur",
    "en": "a after all also an and any are as at be been but by can do does each every for from had has have how i if in into is it its may must no not of often on only or shall should so such than that the their them then there these they this to under was we were what when where which who why will with without you your",
    "es": "al ante cada como con cual cuál cuando cuándo cuántos de debe deben del desde donde dónde el ella en entre es esta este está existe fue ha hasta hay la las le lo los más mi no o para pero por puede pueden que qué quién se según ser si sin sobre son su sus también un una uno y ya",
    "fr": "à au aux avec ce ces cette chaque comme combien comment dans de des doit doivent donc du elle en entre est et fait faut il ils je la le les leur lorsque mais ne nous on ont ou où par pas peut peuvent pour quand que quel quelle quelles quels qui sa sans se selon ses si son sont sous sur tous un une vous",
}
# Names of the languages a query may ask for.
LANGUAGE_NAMES = {
    "de": "german deutsch alemán allemand",
    "en": "english englisch inglés anglais",
    "es": "spanish spanisch español espagnol castellano",
    "fr": "french französisch francés français",
}
# Responses that stand for no response.
PLACEHOLDERS = "na n/a n.a nan nil none null nothing undefined empty blank tbd tba todo pending placeholder no_response no_answer no_content ninguno ninguna nada vacío aucun aucune rien néant keine keiner leer nichts entfällt"
# Words that negate and words for answering, by language; a sentence with the first before the second declines.
NEGATIONS = "no not cannot t never nothing none unable neither rather without unanswered decline declines refuse refuses ningún ninguna nada imposible sin ne pas aucun aucune impossible rien nicht kein keine keinen leider nichts"
ANSWERING = "answer answers answered answering unanswered advice advise guidance help assist respond reply comment speculate guess opine responder contestar respuesta ayudar orientación opinar répondre réponse aider conseil renseigner antwort antworten beantworten auskunft weiterhelfen helfen"
# Words that may introduce a repeated question; they stand in the dictionary beside it.
LEAD_IN = "answer: the question is: you asked: your question was: question: prompt: query: the user asked: here is your question again: la pregunta es: die frage lautet: la question posée est: pregunta: frage: "

LANGUAGES = tuple(FUNCTION_WORDS)
_PLACEHOLDER = {re.sub(r"[\W_]", "", p) for p in PLACEHOLDERS.split()}
_NAMES = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_ASKS = re.compile(rf"\b(?:in|en|auf|into|to|al|ins)\s+(?:plain\s+)?({'|'.join(_NAMES)})\b", re.IGNORECASE)
_THINK = re.compile(r"<think>.*?</think>", re.DOTALL)
_CITE, _FAIL = re.compile(r"\^\^\^\s*\d+\s*\^\^\^"), re.compile(r"\^\^\^\s*FAIL\s*\^\^\^", re.IGNORECASE)
_MARK = re.compile(r"\^\^\^\s*(?:\d+|FAIL)\s*\^\^\^", re.IGNORECASE)
_LAST_MARKS = re.compile(r"(?:\s*\^\^\^\s*(?:\d+|FAIL)\s*\^\^\^)+\s*\Z", re.IGNORECASE)
_PART_MARK, _OPEN_BULLET = re.compile(r"\^{1,3}\w*\^{0,2}\s*\Z"), re.compile(r"(?:^|\n)\s*[-*•–]\s*\Z")
_QUOTED = re.compile(r"[\"“«„][^\"“”«»„]*[\"”»“]|^\s*\w+\s*:\s*$", re.MULTILINE)
_SIGNS = re.compile(r"[\W_]+")
_FORMAT = re.compile(r"[​-‏⁠﻿\xad]")
_CLOSERS = np.array([ord(c) for c in ")]\"'”»*_`"])
_STOPS, _SOFT, _DOTS = (np.array([ord(c) for c in x]) for x in (".!?", ",;:", "…"))
STOP, SOFT, DOTS, BARE = range(4)


def plain(response: str | None) -> str:
    """The response without reasoning, markers and format characters."""
    return _FORMAT.sub("", _MARK.sub(" ", _THINK.sub(" ", response or "")))


def is_empty(response: str | None) -> bool:
    """No content of its own: no letter or digit outside markers, or only placeholders."""
    text = plain(response)
    bare = _SIGNS.sub("", text).lower()
    return not _FAIL.search(response or "") and (not bare or bare in _PLACEHOLDER or all(not (w := _SIGNS.sub("", p).lower()) or w in _PLACEHOLDER for p in text.split()))


@lru_cache(maxsize=None)
def _hashes(words: str) -> np.ndarray:
    return np.unique(Words([words], "letters_digits").hash)


@lru_cache(maxsize=None)
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all function words, and their weight for each language: a word of several counts in part."""
    every = np.unique(np.concatenate([_hashes(w) for w in FUNCTION_WORDS.values()]))
    weight = np.stack([np.isin(every, _hashes(w)) for w in FUNCTION_WORDS.values()], axis=1).astype(float)
    return every, weight / weight.sum(axis=1, keepdims=True)


def _place(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(group, values[:, c], minlength=n) for c in range(values.shape[1])], axis=1)


class Scan:
    """Words of some texts with what follows each: its closing mark, and the number of its sentence."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        w = Words(texts, "letters_digits")
        self.hash, self.doc = w.hash, w.doc
        chars = np.append(w.chars, np.array([10, 10, 10, 10, 10], dtype=np.uint32))
        after = w.end.copy()
        for _ in range(3):
            after += np.isin(chars[after], _CLOSERS)
        mark, following = chars[after], chars[after + 1]
        dots = np.isin(mark, _DOTS) | ((mark == 46) & (following == 46))
        stop = np.isin(mark, _STOPS) & ~dots & ((following <= 32) | np.isin(following, _CLOSERS) | (following == ord("“")))
        self.mark = np.select([dots, stop, np.isin(mark, _SOFT)], [DOTS, STOP, SOFT], BARE)
        self.ends = self.mark == STOP
        last = np.ones(len(self.doc), dtype=bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.last = np.flatnonzero(last)
        cut = last | self.ends
        self.sentence = np.cumsum(cut) - cut  # numbered over all texts
        self.sentences = int(cut.sum())
        self.of = self.doc[np.flatnonzero(cut)]
        digit = np.isin(w.chars, np.arange(48, 58))
        self.letters = np.ones(len(self.hash), dtype=bool)
        if len(self.hash):
            total = np.concatenate(([0], np.cumsum(digit)))
            self.letters = total[w.end] == total[w.start]
        self.size = np.bincount(self.doc, minlength=self.n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word with the one before it in its sentence (or none), and the words' places."""
        first = np.ones(len(self.hash), dtype=bool)
        first[1:] = self.sentence[1:] != self.sentence[:-1]
        before = np.concatenate((np.zeros(1, dtype=U64), self.hash[:-1])) if len(self.hash) else self.hash
        return runs(np.stack([np.where(first, U64(1), before), self.hash], axis=1).ravel(), np.repeat(np.arange(len(self.hash)), 2), 2)

    def contexts(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` words that end at each place, 0 where the text has fewer before it."""
        ok = (at >= n - 1) & (self.doc[np.maximum(at - n + 1, 0)] == self.doc[at])
        out = np.zeros(len(at), dtype=U64)
        for k in range(n):
            out = out * U64(0x9E3779B97F4A7C15) + self.hash[np.maximum(at - k, 0)] + U64(n)
        return np.where(ok, out | U64(1), U64(0))

    def by_function_words(self) -> np.ndarray:
        """The language most function words belong to, by number; -1 where none is ahead."""
        table, weight = _function_words()
        at = _place(table, self.hash)
        some = at >= 0
        score = _sums(self.doc[some], weight[at[some]], self.n)
        order = np.sort(score, axis=1)
        return np.where((order[:, -1] >= 1) & (order[:, -1] > 1.3 * order[:, -2]), score.argmax(axis=1), -1)

    def declining(self) -> np.ndarray:
        """Sentences with a negation before a word for answering."""
        place = np.arange(len(self.hash))
        first, last = np.full(self.sentences, np.iinfo(np.int64).max), np.full(self.sentences, -1)
        no, say = (np.isin(self.hash, _hashes(w)) for w in (NEGATIONS, ANSWERING))
        np.minimum.at(first, self.sentence[no], place[no])
        np.maximum.at(last, self.sentence[say], place[say])
        return first <= last


class Models(NamedTuple):
    """Hashes in order, and for each: log weights of words by language; log weights of pairs of words for
    declining; how often a context ends a sentence. ``closing``: log odds of the marks at the ends of answers
    of up to three words and of longer ones."""

    words: np.ndarray
    language: np.ndarray
    pairs: np.ndarray
    refusal: np.ndarray
    contexts: np.ndarray
    ending: np.ndarray
    closing: np.ndarray


WORD, PAIR, CONTEXT, CLOSING = range(4)
_COUNTS = ("c0", "c1", "c2", "c3")


def evidence(queries: list[str | None], responses: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What some pairs add to the models' counts: ``(model, features, counts by class)``."""
    said = [plain(r) for r in responses]
    for texts in (queries, said):
        scan = Scan([_QUOTED.sub(" ", t or "") for t in texts])
        lang = scan.by_function_words()
        lang[np.bincount(scan.doc[scan.letters], minlength=scan.n) < 5] = -1
        known = scan.letters & (lang[scan.doc] >= 0)
        one = np.unique(scan.hash[known] + U64(0x51ED2701) * scan.doc[known].astype(U64), return_index=True)[1]
        h, of = scan.hash[known][one], lang[scan.doc[known][one]]
        yield WORD, h, np.eye(4, dtype=np.int64)[of]
    scan = Scan(said)
    cited = np.array([bool(r) and "^" in r and bool(_CITE.search(r)) for r in responses])
    failed = np.array([bool(r) and "^" in r and bool(_FAIL.search(r)) for r in responses])
    declines = np.bincount(scan.of, scan.declining(), minlength=scan.n) > 0
    no, yes = cited & ~failed, ~cited & (failed | declines)
    h, place = scan.pairs()
    doc = scan.doc[place]
    used = (no | yes)[doc] & scan.letters[place]
    one = np.unique(h[used] + U64(0x51ED2701) * doc[used].astype(U64), return_index=True)[1]
    yield PAIR, h[used][one], np.stack([yes[doc[used][one]], no[doc[used][one]], *[np.zeros(len(one), dtype=bool)] * 2], axis=1).astype(np.int64)
    every = np.arange(len(scan.hash))
    for n in (1, 2, 3):
        h = scan.contexts(every, n)
        yield CONTEXT, h[h != 0], np.stack([scan.ends, ~scan.ends, *[np.zeros(len(every), dtype=bool)] * 2], axis=1).astype(np.int64)[h != 0]
    short = scan.size[scan.doc] <= 3
    inner = np.ones(len(every), dtype=bool)
    inner[scan.last] = False
    yield CLOSING, (scan.mark + 4 * short).astype(U64), np.stack([~inner, inner, *[np.zeros(len(every), dtype=bool)] * 2], axis=1).astype(np.int64)


def fit(pairs: DataFrame, rare: float = RARE) -> Models:
    """The models from counts over all rows of ``pairs``.

    Each task counts its rows in portions of ``COUNTED`` characters and passes on the features that more than
    half the share ``rare`` of the portion's rows hold; they are added up by feature. So the driver gets no
    more than the features of a mean row divided by ``rare / 2``, however many rows there are.
    """

    def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows = size = 0
        for batch in batches:
            q, r = (batch.column(i).to_pylist() for i in (0, 1))
            for lo, hi in slices([(a or "") + (b or "") for a, b in zip(q, r)], SLICE):
                held += evidence(q[lo:hi], r[lo:hi])
                rows += hi - lo
                size += sum(len(x or "") for x in (*q[lo:hi], *r[lo:hi]))
                if size >= COUNTED:
                    yield counted(held, rows)
                    held, rows, size = [], 0, 0
        if rows:
            yield counted(held, rows)

    def counted(held: list[tuple[int, np.ndarray, np.ndarray]], rows: int) -> pa.RecordBatch:
        out = [(np.array([-1]), np.zeros(1, dtype=U64), np.array([[rows, 0, 0, 0]]))]
        for model in range(4):
            h, back = np.unique(np.concatenate([f for m, f, _ in held if m == model]), return_inverse=True)
            sums = _sums(back, np.concatenate([c for m, _, c in held if m == model]), len(h)).astype(np.int64)
            often = (sums.sum(axis=1) > rows * rare / 2) | (model == CLOSING)
            out.append((np.full(often.sum(), model), h[often], sums[often]))
        model, h, sums = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(h.view(np.int64)), *(pa.array(sums[:, c].astype(np.int64)) for c in range(4))], names=["model", "feature", *_COUNTS])

    counts = pairs.select("query", "response").mapInArrow(portions, f"model int, feature bigint, {' bigint, '.join(_COUNTS)} bigint")
    every = counts.groupBy("model", "feature").agg(*(F.sum(c).alias(c) for c in _COUNTS)).toArrow()
    model, h = every.column(0).to_numpy(), every.column(1).to_numpy().view(U64)
    sums = np.stack([every.column(2 + c).to_numpy() for c in range(4)], axis=1).astype(float)
    rows = sums[model == -1].sum()

    def table(which: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((model == which) & ((sums.sum(axis=1) > rows * rare / 2) | (which == CLOSING)))
        at = at[np.argsort(h[at])]
        return h[at], sums[at]

    words, by = table(WORD)
    total = by.sum(axis=0) + 1
    language = np.log((by + 0.01) / np.maximum(total, total.max() / 50))  # a language that is hardly there gains nothing by it
    language = np.maximum(language - language.max(axis=1, keepdims=True), -4.0) if len(words) else language
    pair, by = table(PAIR)
    refusal = np.log((by[:, 0] + 0.2) / (by[:, 0].sum() + 1)) - np.log((by[:, 1] + 0.2) / (by[:, 1].sum() + 1))
    context, by = table(CONTEXT)
    enough = by.sum(axis=1) >= SEEN
    ending = (by[:, 0] + 0.02) / (by.sum(axis=1) + 0.2)
    marks = np.ones((8, 2))
    at, by = table(CLOSING)
    marks[at.astype(np.int64)] += by[:, :2]
    marks[4 + BARE] += 3  # a short answer without a full stop is not unusual
    closing = np.concatenate([np.log(part / part.sum(axis=0)) for part in (marks[:4], marks[4:])])
    return Models(words, language, pair, refusal, context[enough], ending[enough], closing[:, 0] - closing[:, 1])


def languages(texts: list[str], models: Models) -> np.ndarray:
    """The language of each text without its quotations, by number, where one is clearly ahead; else -1."""
    scan = Scan([_QUOTED.sub(" ", t) for t in texts])
    at = _place(models.words, scan.hash)
    known = (at >= 0) & scan.letters
    score = _sums(scan.doc[known], models.language[at[known]], scan.n) if known.any() else np.zeros((scan.n, 4))
    order = np.sort(score, axis=1)
    clear = (np.bincount(scan.doc[known], minlength=scan.n) > 0) & (order[:, -1] - order[:, -2] > 2)
    return np.where(clear, score.argmax(axis=1), scan.by_function_words())


def refusals(responses: list[str], said: list[str], scan: Scan, models: Models) -> np.ndarray:
    """Which responses decline without cited content before: the FAIL marker says so; else a sentence declines,
    by the dictionary or by pairs of words that come with declining, and no other says anything that is like
    a cited answer."""
    h, place = scan.pairs()
    used = scan.letters[place]
    at = _place(models.pairs, h[used])
    weight = np.where(at >= 0, models.refusal[at] if len(models.pairs) else 0.0, 0.0)
    words = np.bincount(scan.sentence, scan.letters, minlength=scan.sentences)
    score = np.bincount(scan.sentence[place[used]], weight, minlength=scan.sentences) / (words + 3)
    digits = np.bincount(scan.sentence, ~scan.letters, minlength=scan.sentences) > 0
    declines = (scan.declining() & (score > -1)) | ((words >= 4) & (score > 1.8) & ~digits)
    content = ~declines & ((score < 0) | digits) & (words + digits >= 2)
    found = (np.bincount(scan.of, declines, minlength=scan.n) > 0) & (np.bincount(scan.of, content, minlength=scan.n) == 0)
    for i, r in enumerate(responses):
        if "^" in r:
            fail = _FAIL.search(r)
            found[i] = False if _CITE.search(r[: fail.start()] if fail else r) else bool(fail) or found[i]
    return found


def echoes(queries: list[str], said: list[str], scan: Scan) -> np.ndarray:
    """Which responses give back the question only: little is left of them compressed with the question, and of
    the question compressed with them. Pairs that share less than half their words, or where the response has a number of
    its own, are not compressed."""
    asked = Scan(queries)
    keys = [np.unique(x.hash + U64(0x51ED2701) * x.doc.astype(U64), return_index=True) for x in (asked, scan)]
    (a, at_a), (b, at_b) = keys
    lead = np.isin(scan.hash[at_b], _hashes(LEAD_IN))
    common = np.bincount(asked.doc[at_a[np.isin(a, b)]], minlength=asked.n)
    own, other = np.bincount(asked.doc[at_a], minlength=asked.n), np.bincount(scan.doc[at_b[~lead | np.isin(b, a)]], minlength=asked.n)
    number = np.bincount(scan.doc[at_b[~scan.letters[at_b] & ~np.isin(b, a)]], minlength=asked.n)  # one that was not asked for
    out = np.zeros(asked.n, dtype=bool)
    for i in np.flatnonzero((number == 0) & (own > 0) & (2 * common >= own) & (2 * common >= other)):
        out[i] = is_echo(queries[i], said[i])
    return out


def is_echo(query: str, said: str) -> bool:
    """Compressed with each other, as they stand or with their words in order so that swapped ones cost nothing."""
    asked, given = (_SIGNS.sub(" ", x.lower()).strip() for x in (query, said))
    lead = _SIGNS.sub(" ", LEAD_IN)
    in_order = [" ".join(sorted(x.split())) for x in (asked, given)]
    for a, g, before in ((asked, given, lead), (*in_order, "")):
        if max(compressed(g, before + a), compressed(a, before + g)) - compressed(a, before + a) <= ECHO_BYTES:
            return True
    return False


def compressed(text: str, given: str) -> int:
    """Bytes of the text compressed with ``given`` as dictionary."""
    import zstandard

    shared = zstandard.ZstdCompressionDict(given.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=19, write_content_size=False, dict_data=shared).compress(text.encode()))


def truncated(responses: list[str], scan: Scan, models: Models) -> np.ndarray:
    """Which responses break off: within a marker or an open bullet, on dots or a closing mark that answers do
    not end with, or after words with which sentences hardly ever end; the longest context known decides."""
    out = np.zeros(scan.n, dtype=bool)
    last = scan.last
    short = scan.size[scan.doc[last]] <= 3
    out[scan.doc[last]] = (models.closing[scan.mark[last] + 4 * short] < -1) | (scan.mark[last] == DOTS)
    ending = np.ones(len(last))
    for n in (1, 2, 3):
        at = _place(models.contexts, scan.contexts(last, n))
        ending = np.where(at >= 0, models.ending[at] if len(models.contexts) else 1.0, ending)
    out[scan.doc[last]] |= (ending < 0.002) & scan.letters[last]
    for i, r in enumerate(responses):
        if ("<think>" in r and "<think>" in _THINK.sub(" ", r)) or _OPEN_BULLET.search(body := _LAST_MARKS.sub("", r)) or _PART_MARK.search(body):
            out[i] = True
    return out


def defects(queries: list[str | None], responses: list[str | None], models: Models) -> list[str | None]:
    """The type of defect of each pair, or None. The first that holds of empty, echo, refusal, language and
    truncated, a FAIL marker ruling out an echo; a null or empty query is never echoed and has no language."""
    q, r = ([x or "" for x in part] for part in (queries, responses))
    said = [plain(x) for x in r]
    scan = Scan(said)
    empty = np.array([is_empty(x) for x in responses], dtype=bool)
    failed = np.array(["^" in x and bool(_FAIL.search(x)) for x in r], dtype=bool)
    echo = echoes(q, said, scan) & ~failed
    refusal = refusals(r, said, scan, models)
    asked, spoken = languages(q, models), languages(said, models)
    other = (asked >= 0) & (spoken >= 0) & (asked != spoken) & (np.bincount(scan.doc[scan.letters], minlength=scan.n) >= 4)
    for i in np.flatnonzero(other):
        other[i] = LANGUAGES[spoken[i]] not in {_NAMES[m.lower()] for m in _ASKS.findall(q[i])}
    cut = truncated(r, scan, models)
    kinds = np.select([empty, echo, refusal, other, cut], [1, 2, 3, 4, 5], 0)
    names = (None, "empty", "echo", "refusal", "language", "truncated")
    return [names[k] for k in kinds.tolist()]


def defective_pairs(pairs: DataFrame, rare: float = RARE) -> DataFrame:
    """``(log_id, defect)``: a row for each defective row of ``pairs`` (``log_id, query, response``).

    Null and blank responses are ``empty`` whatever the query. Rows repeated under a ``log_id`` give one
    row; a null ``log_id`` stays null. Texts are judged whole, of any length. Other columns are ignored;
    an empty table gives an empty result.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(fit(pairs, rare))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, r = (batch.column(i).to_pylist() for i in (1, 2))
            for lo, hi in slices([(a or "") + (b or "") for a, b in zip(q, r)], SLICE):
                found = defects(q[lo:hi], r[lo:hi], sent.value)
                at = [i for i, d in enumerate(found) if d]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + i for i in at], pa.int64())), pa.array([found[i] for i in at], pa.string())], names=["log_id", "defect"])

    kind = pairs.schema["log_id"].dataType.simpleString()
    return pairs.select("log_id", "query", "response").mapInArrow(run, f"log_id {kind}, defect string").distinct()
