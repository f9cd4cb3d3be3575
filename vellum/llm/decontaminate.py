"""Benchmark decontamination: a BM25 inverted index of test items, searched with every training document, then verified.

Items (question and answer) are indexed; a document's distinct words are the query. An item's BM25 score is taken relative to
the score that it has for its own text, and its threshold is the least score that any document has in which the item can be
verified: all of the item's score but its heaviest words, as many as the shingles that may be missing can leave uncovered. So
retrieval loses nothing, however the weight is spread over an item's words. Items lie in blocks; a word's greatest contribution
to any item of a block is its block maximum, and only the items of those blocks are scored where the sum of the document's
block maxima reaches the least threshold of the block (block-max WAND, all documents of a batch at once).

What is retrieved is verified by 5-word shingles: a document leaks an item if it holds 0.8 of the item's distinct shingles, or
all shingles of its question, if that has QUESTION_WORDS words or more, even without the answer.

Words are runs of letters and digits in lower case, so punctuation and case don't hide a leak. The index is broadcast up to
INDEX_CHARS characters of items; a longer benchmark is indexed and searched in slices of that size, one after the other. Null
or empty texts neither leak nor are leaked. Rows with equal doc_id are separate documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import map_arrow, ship, texts_of
from vellum.llm.wordgrid import Grid, mix

WIDTH, OVERLAP, QUESTION_WORDS = 5, 0.8, 8
INDEX_CHARS = 20_000_000
BLOCKS = 48
#: Cells of the table of documents and words that is filled at once.
CELLS = 4_000_000
K1, B = 1.2, 0.75


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, one for each place."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
        for i in range(width):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i])
    return total


def question_answer(text: str) -> tuple[str, str]:
    """An item's answer is its last line, or its last sentence if it has one line; the question is what stands before."""
    text = (text or "").strip()
    found = re.fullmatch(r"(?s)(.*\S)\s*\n(.*)", text) or re.fullmatch(r"(?s)(.*[.?!])\s+(.*)", text)
    return (found[1], found[2]) if found else (text, "")


class Index:
    """Items by block with their words' scores and thresholds. items: (item_id, text); items without words are left out."""

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP, width: int = WIDTH, question_words: int = QUESTION_WORDS):
        texts = [t or "" for _, t in items]
        grid = Grid(texts, plain=True)
        hashes = grid.hashes()
        words = [hashes[a:b] for a, b in zip(grid.doc_at[:-1], grid.doc_at[1:], strict=True)]
        keep = [i for i, w in enumerate(words) if len(w)]
        self.ids, words = [items[i][0] for i in keep], [words[i] for i in keep]
        self.width = [min(width, len(w)) for w in words]
        placed = [grams(w, n) for w, n in zip(words, self.width, strict=True)]
        self.grams = [np.unique(g) for g in placed]
        self.needed = [-(-int(round(1000 * overlap)) * len(g) // 1000) for g in self.grams]
        self.parts, self.asks = [], []
        for i, n in zip(keep, self.width, strict=True):
            own = Grid(list(question_answer(texts[i])), plain=True)
            h = own.hashes()
            first, second = (h[own.doc_at[k] : own.doc_at[k + 1]] for k in range(2))
            self.parts.append([np.unique(grams(x, n)) for x in (first, second)])
            self.asks.append(first if len(second) and len(first) >= question_words else None)
        self.terms = np.unique(np.concatenate(words)) if words else np.empty(0, dtype=np.uint64)
        size = np.array([len(w) for w in words], dtype=float)
        counted = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in words]
        df = np.bincount(np.concatenate([t for t, _ in counted]), minlength=len(self.terms)) if words else np.empty(0)
        idf = np.log1p((len(words) - df + 0.5) / (df + 0.5))
        self.own_terms, self.own_scores, least = [], [], []
        for d, (term, count) in enumerate(counted):
            score = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[d] / size.mean()))
            score = score / score.sum()
            # at most so many words lie in no shingle that is held: as many as the places of the shingles that may be missing
            _, times = np.unique(placed[d], return_counts=True)
            missing = int(np.sort(times)[::-1][: len(times) - self.needed[d]].sum())
            kept = 1 - np.sort(score)[::-1][:missing].sum()
            if self.asks[d] is not None:
                kept = min(kept, score[np.isin(term, np.searchsorted(self.terms, self.asks[d]))].sum())
            self.own_terms.append(term)
            self.own_scores.append(score.astype(np.float32))
            least.append(kept - 1e-4)
        self.least = np.array(least)
        self.per_block = max(1, -(-len(words) // BLOCKS))
        blocks = -(-len(words) // self.per_block)
        self.most = np.zeros((len(self.terms), blocks), dtype=np.float32)
        for d, (term, score) in enumerate(zip(self.own_terms, self.own_scores, strict=True)):
            self.most[term, d // self.per_block] = np.maximum(self.most[term, d // self.per_block], score)
        self.block_least = np.array([self.least[k * self.per_block : (k + 1) * self.per_block].min() for k in range(blocks)])
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def retrieve(self, hashes: np.ndarray, doc_at: np.ndarray) -> dict[int, list[int]]:
        """Items whose score reaches their threshold, by document."""
        out: dict[int, list[int]] = {}
        if not len(self.terms) or not len(hashes):
            return out
        at = np.flatnonzero(self.known[(hashes >> np.uint64(44)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        hit = self.terms[term] == hashes[at]
        at, term = at[hit], term[hit]
        doc = np.searchsorted(doc_at, at, side="right") - 1
        step = max(1, CELLS // len(self.terms))
        for begin in range(0, len(doc_at) - 1, step):
            a, b = np.searchsorted(doc, [begin, begin + step])
            if a == b:
                continue
            held = np.zeros((min(step, len(doc_at) - 1 - begin), len(self.terms)), dtype=bool)
            held[doc[a:b] - begin, term[a:b]] = True
            row, column = np.nonzero(held)
            rows, first = np.unique(row, return_index=True)
            likely = np.add.reduceat(self.most[column], first, axis=0) >= self.block_least
            for k in np.flatnonzero(likely.any(axis=0)):
                own = rows[likely[:, k]]
                items = range(k * self.per_block, min((k + 1) * self.per_block, len(self.ids)))
                terms = np.concatenate([self.own_terms[d] for d in items])
                ends = np.cumsum([0] + [len(self.own_terms[d]) for d in items])[:-1]
                total = np.add.reduceat(held[np.ix_(own, terms)] * np.concatenate([self.own_scores[d] for d in items]), ends, axis=1)
                for r, d in zip(*np.nonzero(total >= self.least[items.start : items.stop]), strict=True):
                    out.setdefault(int(own[r]) + begin, []).append(items.start + int(d))
        return out

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, float, float]]:
        """(place of the text, item_id, shingles of the item, of them in the text, shares of the question and the answer)."""
        grid = Grid(texts, plain=True)
        hashes = grid.hashes()
        for i, items in sorted(self.retrieve(hashes, grid.doc_at).items()):
            words = hashes[grid.doc_at[i] : grid.doc_at[i + 1]]
            by_width: dict[int, np.ndarray] = {}
            for d in items:
                n = self.width[d]
                if n not in by_width:
                    by_width[n] = np.unique(grams(words, n))
                shared = int(_inside(self.grams[d], by_width[n]).sum())
                asked = self.asks[d] is not None and shared >= len(self.parts[d][0]) and bool(_inside(self.parts[d][0], by_width[n]).all())
                if shared >= self.needed[d] or asked:
                    parts = [float(_inside(g, by_width[n]).mean()) if len(g) else float("nan") for g in self.parts[d]]
                    yield i, self.ids[d], len(self.grams[d]), shared, *parts


def _inside(some: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of some values are among ordered ones."""
    if not len(ordered):
        return np.zeros(len(some), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, some), len(ordered) - 1)] == some


def indexes(benchmark: DataFrame, **settings) -> list[Index]:
    """One index, or one for each slice of a benchmark longer than INDEX_CHARS. benchmark: item_id, text."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-chars // INDEX_CHARS) or 1
    dealt = benchmark.select("item_id", "text").withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    out = []
    for k in range(slices):
        rows = dealt.where(F.col("slice") == k).select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        out.append(Index([(r.item_id, r.text) for r in rows], **settings))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, n_shingles, n_shared, overlap, question_overlap and
    answer_overlap (null where that part has fewer words than a shingle)."""
    spark = docs.sparkSession
    ship(spark)
    out = None
    for index in indexes(benchmark, **settings):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                found = list(shared.value.leaks(texts_of(batch)))
                if not found:
                    return None
                place, item, n, both, question, answer = zip(*found, strict=True)
                maybe = lambda x: pa.array([None if v != v else v for v in x], pa.float64())
                columns = [batch.column("doc_id").take(pa.array(place)), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(both, pa.int64()), pa.array([b / a for a, b in zip(n, both, strict=True)], pa.float64()), maybe(question), maybe(answer)]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shingles", "n_shared", "overlap", "question_overlap", "answer_overlap"])

            return apply

        part = map_arrow(docs.select("doc_id", "text"), make, "doc_id long, item_id long, n_shingles long, n_shared long, overlap double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without the rows that hold an item; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    for index in indexes(benchmark, **settings):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                bad = {x[0] for x in shared.value.leaks(texts_of(batch))}
                return batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int32()))

            return apply

        docs = map_arrow(docs, make, docs.schema)
    return docs
