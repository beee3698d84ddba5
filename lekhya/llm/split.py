"""Problem 6: texts over a size limit are cut into overlapping pieces at natural boundaries, by lexical cohesion.

Around every natural boundary (paragraph, line, sentence end) the words of a block before and a block after are
compared; the similarity curve's valleys mark changes of topic. In each size window the boundary with the deepest
valley ends the piece, paragraph ends before line ends before sentence ends where depths tie; without one the last
word end, and without that a hard cut. A later piece starts with the last `overlap` characters of the one before, or
fewer where that makes it start at a word.

Defined results: null items give no piece; items within the limit give one piece, themselves; characters are Unicode
code points; joined without their overlaps the pieces give back the text exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.session import nonempty

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\n\s*\n|\n|[.!?।;:](?=[\"')\]]*\s)")
_WORD_END = re.compile(r"\S(?=\s)")
_WORD_START = re.compile(r"(?<=\s)\S")


def _boundaries(text: str) -> list[tuple[int, int]]:
    """(position, rank) of the natural ends: 0 paragraph, 1 line, 2 sentence."""
    out = {}
    for m in _GAP.finditer(text):
        if m[0][0] == "\n":
            out[m.start()] = min(out.get(m.start(), 9), 0 if m[0].count("\n") > 1 else 1)
        else:
            out.setdefault(m.end(), 2)
    return sorted((p, r) for p, r in out.items() if p > 0)


def _depths(text: str, gaps: list[tuple[int, int]], block: int) -> dict[int, float]:
    """Valley depth at each gap: how far similarity rises to the next peak on either side, added up."""
    words = [(m.start(), m[0].lower()) for m in _WORD.finditer(text)]
    starts = [p for p, _ in words]
    sims, at = [], 0
    for p, _ in gaps:
        while at < len(starts) and starts[at] < p:
            at += 1
        a, b = Counter(w for _, w in words[max(0, at - block) : at]), Counter(w for _, w in words[at : at + block])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        sims.append(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
    # the peak that a gap rises to on a side is its neighbour's peak there, as long as the curve does not fall on the way
    left, right = list(sims), list(sims)
    for k in range(1, len(sims)):
        if sims[k - 1] >= sims[k]:
            left[k] = left[k - 1]
    for k in range(len(sims) - 2, -1, -1):
        if sims[k + 1] >= sims[k]:
            right[k] = right[k + 1]
    return {p: a + b - 2 * s for (p, _), a, b, s in zip(gaps, left, right, sims)}


def pieces(text: str, limit: int = 512, overlap: int = 50, block: int = 30) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; consecutive ones overlap."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    gaps = _boundaries(text)
    depth = _depths(text, gaps, block)
    out, start, g = [], 0, 0
    while n - start > limit:
        low, high = start + max(overlap + 1, limit // 4), start + limit
        while g < len(gaps) and gaps[g][0] < low:
            g += 1
        inside, k = [], g
        while k < len(gaps) and gaps[k][0] <= high:
            inside.append(gaps[k])
            k += 1
        if inside:
            end = max(inside, key=lambda x: (round(depth[x[0]], 6), -x[1], x[0]))[0]
        else:
            ends = [m.end() for m in _WORD_END.finditer(text, low, min(n, high + 1)) if m.end() <= high]
            end = ends[-1] if ends else high
        out.append((start, end))
        begin = end - overlap
        if not (text[begin - 1].isspace() and not text[begin].isspace()):
            m = _WORD_START.search(text, begin, end) if overlap else None
            begin = m.start() if m else begin
        start = begin
        g = 0 if not gaps else min(g, len(gaps) - 1)
        while g > 0 and gaps[g - 1][0] >= start:
            g -= 1
    out.append((start, n))
    return out


def items(ocr_documents: DataFrame, cleaned_texts: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): paragraphs of cleaned_texts from 0, and full_text of ocr_documents as -1; null items left out."""
    paras = cleaned_texts.select("doc_id", F.posexplode("paragraphs").alias("para_no", "text"))
    whole = ocr_documents.select("doc_id", F.lit(-1).alias("para_no"), F.col("full_text").alias("text"))
    return paras.union(whole).filter("text IS NOT NULL AND doc_id IS NOT NULL")


def split_items(df: DataFrame, limit: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, para_no, piece_no, n_pieces, start_pos, end_pos, piece) of items (doc_id, para_no, text)."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, para, text in zip(b["doc_id"], b["para_no"], b["text"]):
                cuts = pieces(text, limit, overlap)
                rows += [(doc, para, k, len(cuts), s, e, text[s:e]) for k, (s, e) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["doc_id", "para_no", "piece_no", "n_pieces", "start_pos", "end_pos", "piece"])

    return df.select("doc_id", "para_no", "text").mapInPandas(
        run, "doc_id long, para_no int, piece_no int, n_pieces int, start_pos int, end_pos int, piece string"
    )


def found(ocr_documents: DataFrame, cleaned_texts: DataFrame) -> DataFrame:
    """p6_found: the items that had to be cut."""
    return split_items(items(ocr_documents, cleaned_texts)).filter("piece_no = 0 AND n_pieces > 1").select("doc_id", "para_no").distinct()
