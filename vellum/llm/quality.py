"""Quality rules: fixed counts of a text, and a linear-chain conditional random field over its lines.

Every line with a word gets features of its shape (symbols, separators, repeated words, word lengths, closing punctuation,
a copy of an earlier line). Their weights come from a maximum-entropy fit to the lines of documents labelled good or bad (a
weak label: a document's label stands for each of its lines; about TRAIN_ROWS documents, by hash). The chain's transition is
then estimated by expectation maximisation: the forward-backward pass says how often neighbouring lines agree, whatever the
document's label, and that share, drawn to AGREE, is the next transition. Both fits add up sums of the executors; no line comes to the driver.
Viterbi
decoding marks each line content or boilerplate; a document is retained if at least SHARE of its words lie in content
lines and the fixed rules don't fail it.

Null and empty texts have no word, fail the fixed rules and have a content share of 0. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import cut, map_arrow, ship, texts_of
from vellum.llm.wordgrid import Grid, mix

TRAIN_ROWS, SHARE = 2000, 0.5
#: Steps of the two fits, at most.
STEPS, ROUNDS = 25, 6
#: Share of neighbours that agree, assumed beforehand; it weighs as much as the data, whose documents are of one label each and
#: so agree more than a page that mixes content and boilerplate.
AGREE = 0.8
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;\"”»…"
FEATURES = ("bias", "symbols", "separators", "symbol ends", "repeats", "next repeats", "word length", "short words", "closed", "copy", "digits", "one word")
#: Weights for content where there is nothing to learn from.
DEFAULT = (2.0, -25.0, -12.0, -8.0, -3.0, -6.0, -0.05, 0.5, 0.8, -1.0, -3.0, -0.5)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(65536, dtype=np.float64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL, _CLOSE, _DIGIT = _table(SYMBOLS), _table(CLOSING), _table("0123456789")


class Lines:
    """Of a batch of texts: the fixed counts of each text, and the features of each line that has a word."""

    def __init__(self, texts: list[str]):
        grid = Grid(texts)
        size = grid.end - grid.begin
        self.n_words = np.diff(grid.doc_at)
        low = np.minimum(grid.chars, 65535)
        running = lambda per_char: np.concatenate(([0.0], np.cumsum(per_char)))
        symbols, digits = running(_SYMBOL[low]), running(_DIGIT[low])
        text_end = grid.text_at + grid.lengths
        self.n_symbols = (symbols[text_end] - symbols[grid.text_at]).astype(np.int64)
        chars = np.concatenate(([0], np.cumsum(size)))
        self.word_chars = chars[grid.doc_at[1:]] - chars[grid.doc_at[:-1]]
        hashes = grid.hashes()
        self.n_repeat_words = np.array([_repeats(hashes[a:b]) for a, b in zip(grid.doc_at[:-1], grid.doc_at[1:], strict=True)], dtype=np.int64)
        self.n_dup_lines = np.zeros(len(texts), dtype=np.int64)
        copies: list[bool] = []
        for i, text in enumerate(texts):
            seen: set[str] = set()
            for line in text.split("\n"):
                if line.strip(" \t\n\r\x0b\x0c"):
                    copies.append(line in seen)
                    self.n_dup_lines[i] += line in seen
                    seen.add(line)
        # lines: words are of one line if no line feed lies between them
        feeds = np.concatenate(([0], np.cumsum(grid.chars == 10)))
        line_of = feeds[grid.begin] if len(grid.begin) else np.empty(0, dtype=np.int64)
        self.first = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1])) if len(line_of) else np.empty(0, dtype=np.int64)
        last = np.append(self.first[1:], len(line_of))
        self.words = last - self.first
        self.line_at = np.searchsorted(self.first, grid.doc_at)  # first line of each text, and the end
        if not len(self.first):
            self.x = np.empty((0, len(FEATURES)))
            return
        total = lambda v: np.add.reduceat(v.astype(np.float64), self.first)
        n, letters = self.words.astype(float), total(size)
        last_char = low[grid.end - 1]
        in_words = lambda run: total(run[grid.end] - run[grid.begin])
        key = mix(hashes ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key))
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        following = np.zeros(len(key))
        following[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
        self.x = np.stack(
            [
                np.ones(len(n)),
                in_words(symbols) / letters,
                total((size == 1) & (low[grid.begin] == ord("|"))) / n,
                total(_SYMBOL[last_char]) / n,
                total(again) / n,
                total(following) / n,
                np.minimum(letters / n, 30) / 10,
                total(size <= 3) / n,
                _CLOSE[last_char[last - 1]],
                np.array(copies, dtype=np.float64),
                in_words(digits) / letters,
                (n == 1).astype(float),
            ],
            axis=1,
        )


def _repeats(words: np.ndarray) -> int:
    """Words in 5-word windows that occur twice or more in a text."""
    k = len(words) - 4
    if k < 2:
        return 0
    with np.errstate(over="ignore"):
        total = np.full(k, np.uint64(5))
        for i in range(5):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i : k + i])
    order = np.sort(total)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(total, twice))
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + 5, -1)
    return int((np.cumsum(marks) > 0).sum())


@dataclass
class Model:
    """weights: of the features, for content; stick: log-odds that a line has its neighbour's label."""

    weights: tuple[float, ...] = DEFAULT
    stick: float = 1.0

    def decode(self, x: np.ndarray) -> list[bool]:
        """The likeliest labels of one text's lines, True for content (Viterbi; a tie goes to content)."""
        if not len(x):
            return []
        emit = (x @ np.array(self.weights)).tolist()
        good, bad, back = emit[0] / 2, -emit[0] / 2, []
        half = self.stick / 2
        for e in emit[1:]:
            stay_good, from_bad = good + half, bad - half
            stay_bad, from_good = bad + half, good - half
            back.append((stay_good >= from_bad, from_good > stay_bad))
            good, bad = max(stay_good, from_bad) + e / 2, max(stay_bad, from_good) - e / 2
        out = [good >= bad]
        for to_good, to_bad in reversed(back):
            out.append(to_good if out[-1] else to_bad)
        return out[::-1]

    def agreement(self, lines: Lines) -> tuple[float, float]:
        """(expected number of neighbouring lines with one label, number of neighbouring lines), by the forward-backward pass."""
        same = pairs = 0.0
        stay = 1 / (1 + np.exp(-self.stick))
        odds = 1 / (1 + np.exp(-np.clip(lines.x @ np.array(self.weights), -30, 30))) if len(lines.x) else np.empty(0)
        for a, b in zip(lines.line_at[:-1].tolist(), lines.line_at[1:].tolist(), strict=True):
            good = odds[a:b].tolist()
            ahead, last = [1.0] * len(good), 1.0  # share of the label content that the lines after speak for, as odds to 1
            for i in range(len(good) - 1, 0, -1):
                g, h = good[i] * last, (1 - good[i])
                last = (stay * g + (1 - stay) * h) / ((1 - stay) * g + stay * h)
                ahead[i - 1] = last
            p = good[0] if good else 0.0
            for i in range(1, len(good)):
                g, after = good[i], ahead[i]
                both = [p * stay * g * after, (1 - p) * stay * (1 - g), p * (1 - stay) * (1 - g), (1 - p) * (1 - stay) * g * after]
                total = sum(both)
                same += (both[0] + both[1]) / total
                pairs += 1
                p = (both[0] / after + both[3] / after) / (both[0] / after + both[3] / after + both[1] + both[2])
        return same, pairs

    def shares(self, lines: Lines) -> np.ndarray:
        out = np.zeros(len(lines.n_words))
        for i, (a, b) in enumerate(zip(lines.line_at[:-1], lines.line_at[1:], strict=True)):
            if b > a:
                out[i] = float(lines.words[a:b][self.decode(lines.x[a:b])].sum()) / float(lines.words[a:b].sum())
        return out


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Weights from labels.quality, 1 good and 0 bad; the default ones if either kind is missing."""
    ship(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null")
    # labels that contradict each other teach nothing
    own = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("_y")).where("y = _y").drop("_y")
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    # as many of either kind, by hash
    pick = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000))
    own = own.where(F.when(F.col("y") == 1, pick < 1_000_000 * most / 2 / sizes[1]).otherwise(pick < 1_000_000 * most / 2 / sizes[0]))

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(own), "doc_id").select("text", "y")  # about `most` rows, by the filter above
    rows = cut(rows, "labelled", files=16)
    n = len(FEATURES)
    weights = np.zeros(n)
    pull = np.full(n, 0.05)
    pull[0] = 1e-3
    for _ in range(STEPS):  # Newton's method
        got = _sums(rows, lambda lines, y, w=weights: _slopes(lines, y, w))
        if not len(got) or not got[-1] or not got[-2]:
            return Model()
        step = np.linalg.solve(got[: n * n].reshape(n, n) + np.diag(pull), got[n * n : n * n + n] + pull * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    stick = 1.0
    for _ in range(ROUNDS):
        same, pairs = _sums(rows, lambda lines, y, m=Model(tuple(weights), stick): m.agreement(lines))
        share = (same + AGREE * (pairs + 10)) / (2 * pairs + 10)
        before, stick = stick, float(np.log(share / (1 - share)))
        if abs(stick - before) < 1e-3:
            break
    return Model(tuple(float(w) for w in weights), stick)


def _sums(rows: DataFrame, of) -> np.ndarray:
    """The sum of of(lines, labels of the texts), a vector, over pieces of (text, y)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            value = of(Lines(texts_of(batch)), np.array(batch.column("y").to_pylist(), dtype=float))
            return pa.RecordBatch.from_arrays([pa.array([np.asarray(value, dtype=float).tolist()], pa.list_(pa.float64()))], ["v"])

        return apply

    got = map_arrow(rows, make, "v array<double>").agg(*(F.sum(F.get("v", i)) for i in range(len(FEATURES) * (len(FEATURES) + 1) + 2))).first()
    return np.array([x for x in got if x is not None])


def _slopes(lines: Lines, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hessian and gradient of the lines' likelihood, a document weighing as one however long, and documents bad and good."""
    n = np.diff(lines.line_at)
    doc = np.repeat(np.arange(len(n)), n)
    weight, x = 1 / n[doc], lines.x
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    hessian = (x * (weight * p * (1 - p))[:, None]).T @ x
    return np.concatenate([hessian.ravel(), x.T @ (weight * (p - y[doc])), [(y[n > 0] == 0).sum(), (y[n > 0] == 1).sum()]])


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share
    and kept."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines = Lines(texts_of(batch))
            failed = (lines.n_words < 10) | (100 * lines.n_repeat_words > 20 * lines.n_words)
            share = shared.value.shares(lines)
            counts = [pa.array(v.astype(np.int64)) for v in (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(failed), pa.array(share), pa.array(~failed & (share >= SHARE))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

        return apply

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
