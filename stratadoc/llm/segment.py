"""Oversized texts cut at lexical-cohesion valleys, with overlap between consecutive pieces."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^ \t\r\n]+"
LIMIT, OVERLAP, SIDE = 220, 50, 60
_SENTENCE_END = re.compile(r"[.!?:;][)\]\"'»”’]*$")
_LIST_MARK = re.compile(r"^([-*•–▪]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])$")


def boundaries(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the natural boundary before each word: 3 paragraph, 2 list entry or line after a
    sentence, 1 sentence, 0 none."""
    out = np.zeros(len(spans), dtype=np.int8)
    for i in range(1, len(spans)):
        gap, before = text[spans[i - 1][1] : spans[i][0]], text[slice(*spans[i - 1])]
        ends = bool(_SENTENCE_END.search(before))
        breaks = max(gap.count("\n"), gap.count("\r"))
        if breaks > 1:
            out[i] = 3
        elif breaks and (ends or _LIST_MARK.match(text[slice(*spans[i])])):
            out[i] = 2
        elif ends:
            out[i] = 1
    return out


def depths(words: list[str], at: np.ndarray, side: int = SIDE) -> np.ndarray:
    """How deep the similarity of the ``side`` words on either side falls at each place, against the
    highest similarity reached on its left and on its right before it falls again."""
    keys = [re.sub(r"\W", "", w.lower()) for w in words]
    _, number = np.unique(np.array(keys, dtype=object).astype(str), return_inverse=True)
    near = np.zeros(len(at))
    for k, i in enumerate(at):
        first = max(0, i - side)
        words_here, place = np.unique(number[first : i + side], return_inverse=True)
        a, b = (np.bincount(x, minlength=len(words_here)) for x in (place[: i - first], place[i - first :]))
        near[k] = a @ b / np.sqrt((a @ a) * (b @ b))
    left, right = near.copy(), near.copy()  # the highest reached without falling on the way, from either side
    for k in range(1, len(at)):
        left[k] = left[k - 1] if near[k - 1] >= near[k] else near[k]
    for k in range(len(at) - 2, -1, -1):
        right[k] = right[k + 1] if near[k + 1] >= near[k] else near[k]
    return left + right - 2 * near


def cut_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """Pieces of ``text`` of at most ``limit`` words, in order.

    A cut is the deepest valley among the natural boundaries in the second half of the room left, a
    paragraph's end weighing more than a sentence's; where there is none, in the first half; where there
    is none at all, the cut is after ``limit`` words. A piece begins with up to ``overlap`` words of the
    one before, from a sentence's start if there is one. Texts within the limit are one piece, texts
    without words none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    spans = [m.span() for m in re.finditer(WORD, text or "")]
    if not spans:
        return []
    n, cuts = len(spans), []
    if n > limit:
        strength = boundaries(text, spans)
        at = np.flatnonzero(strength)
        score = np.full(n, -1.0)
        if len(at):
            score[at] = depths([text[slice(*s)] for s in spans], at) + 0.5 * (strength[at] - 1)
    starts, begin = [0], 0
    while n - starts[-1] > limit:
        low, high = begin + 1, starts[-1] + limit  # a cut before word `c` ends the piece
        middle = max(low, starts[-1] + limit // 2)
        best = high
        for a, b in ((middle, high), (low, middle - 1)):
            window = score[a : b + 1]
            if len(window) and window.max() >= 0:
                best = a + len(window) - 1 - int(np.argmax(window[::-1]))
                break
        cuts.append(best)
        begin, back = best, best - overlap
        natural = [i for i in range(max(back, starts[-1] + 1), best) if strength[i]]
        starts.append(natural[0] if natural else max(back, starts[-1] + 1) if overlap else best)
    ends = [*cuts, n]
    return [
        {
            "piece_index": k,
            "piece": text[spans[s][0] : spans[e - 1][1]],
            "n_words": e - s,
            "overlap_words": 0 if k == 0 else ends[k - 1] - s,
        }
        for k, (s, e) in enumerate(zip(starts, ends))
    ]


def is_body(kind):
    """Body blocks, whatever the case and padding of ``kind``."""
    return F.lower(F.regexp_replace(kind, r"^\s+|\s+$", "")) == "body"


def split_oversized(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(block_id, piece_index, piece, n_words, overlap_words)`` of body blocks over ``limit`` words.

    ``blocks`` needs ``block_id, text, kind``; other columns are ignored. Null kinds are no body, null and
    empty texts have no words. Every row is cut on its own: repeated rows give repeated pieces, and a
    null ``block_id`` stays null. No shuffle.
    """
    over = blocks.filter(is_body(F.col("kind")) & (F.regexp_count("text", F.lit(WORD)) > limit)).select("block_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[(i, p) for p in cut_text(t, limit, overlap)] for i, t in enumerate(batch.column(1).to_pylist())]
            flat = [x for m in made for x in m]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i for i, _ in flat], pa.int64())),
                    *(pa.array([p[c] for _, p in flat], kind) for c, kind in PIECE),
                ],
                names=["block_id", *(c for c, _ in PIECE)],
            )

    kind = blocks.schema["block_id"].dataType
    schema = T.StructType([T.StructField("block_id", kind)]).simpleString()[7:-1].replace(":", " ")
    return over.mapInArrow(run, f"{schema}, piece_index int, piece string, n_words int, overlap_words int")


PIECE = (("piece_index", pa.int32()), ("piece", pa.string()), ("n_words", pa.int32()), ("overlap_words", pa.int32()))
