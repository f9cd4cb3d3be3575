"""Toxicity: a learned lexicon, matched with misspellings by Levenshtein automata, scored by context.

The lexicon (words, and stems that stand for all words that begin so) is learned from labelled rows by smoothed log-odds.
A stem is matched as it is; the words it covers stay beside it, so that their misspellings are met too.
Words of 5 letters may differ by one edit and of 9 by two (insertions, deletions, substitutions, swaps of neighbours, and digits
that stand for letters). The automata of all words are run together: a state is a set of (trie node, edits) positions, and
states become rows of one transition table when texts first reach them. All words of a batch advance through the table in
step, and most fall out after a few letters. Each hit is weighed by a window around it: inside quotation marks or after
words of reporting it counts less (quotation), beside the second person more (abuse). A logistic regression turns the
weighed sum and its density into a score from 0 to 1.

Fitting takes a bounded sample of labelled rows (TRAIN_ROWS); scoring takes whole texts. Null and empty texts have no hit
and get the score of the bias. Rows are scored separately, so repeated rows and doc_ids do no harm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vellum.llm.shared import cut, map_arrow, ship, texts_of
from vellum.llm.wordgrid import Grid, regress

#: Labelled rows a model is fitted on, at most (in expectation; they are picked by hash).
TRAIN_ROWS = 8000
#: States of the automata that a worker keeps; more are forgotten between batches, and made again when texts reach them.
STATES = 30_000
WINDOW_WORDS = 4
QUOTED, REPORTED, ADDRESSED, MISSPELT = 0.3, 0.6, 1.3, 0.7
#: Digits that stand for letters, quotation marks, words of reporting and of the second person.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
QUOTES = "\"“”„«»"
_QUOTES = np.array([ord(q) for q in QUOTES], dtype=np.uint32)
REPORTING = frozenset("said says called quote quoted word term wrote means".split())
SECOND_PERSON = frozenset("you your youre u ur tu vous du ihr tú usted".split())


def edits_for(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Automaton:
    """The Levenshtein automata of the entries, intersected with their trie, as a lazily filled table.

    entries: (text, is a stem, edits). State 0 is dead. accept[s] is (entry, edits) for a word that ends in state s;
    stem[s] is the stem that has just been read, or -1."""

    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int | None] = [None]
        self.stem_end: list[int | None] = [None]  # apart, as a word may be a stem too
        self.most = [0]
        self.edits = [e for _, _, e in entries]
        for k, (text, is_stem, edits) in enumerate(entries):
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.stem_end.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            (self.stem_end if is_stem else self.end)[node] = k
        letters = sorted({c for t, _, _ in entries for c in t})
        self.letters = ["", *letters]
        self.classes = np.zeros(0x110000, dtype=np.int16)
        for i, c in enumerate(letters, 1):
            self.classes[ord(c)] = i
        for digit, letter in DIGITS.items():
            if not self.classes[ord(digit)]:
                self.classes[ord(digit)] = self.classes[ord(letter)]
        self._forget()

    def _forget(self) -> None:
        """Begin the table anew; states come back as texts reach them."""
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.accept: list[tuple[int, int] | None] = [None]
        self.table = np.full((256, len(self.letters)), -1, dtype=np.int32)
        self.table[0] = 0
        self.stem = np.full(256, -1, dtype=np.int32)
        self.start = self._state({(0, 0)})

    def _state(self, positions: Iterable[tuple]) -> int:
        """positions: (node, edits), or (node to reach, edits, letter awaited) in the middle of a swap."""
        least: dict = {}
        todo = list(positions)
        while todo:
            p = todo.pop()
            key = (p[0], *p[2:])
            if p[1] > self.most[p[0]] or least.get(key, 9) <= p[1]:
                continue
            least[key] = p[1]
            if len(p) == 2:
                todo += [(child, p[1] + 1) for child in self.children[p[0]].values()]
        own = frozenset((k[0], e, *k[1:]) for k, e in least.items())
        if own not in self.states:
            s = self.states[own] = len(self.sets)
            self.sets.append(own)
            if s == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.stem = np.concatenate([self.stem, np.full_like(self.stem, -1)])
            ends = [(e, self.end[node]) for node, e, *swap in own if not swap and self.end[node] is not None and e <= self.edits[self.end[node]]]
            self.accept.append((min(ends)[1], min(ends)[0]) if ends else None)
            stems = [self.stem_end[node] for node, e, *swap in own if not swap and e == 0 and self.stem_end[node] is not None]
            if stems:
                self.stem[s] = min(stems)
        return self.states[own]

    def _step(self, state: int, letter: int) -> int:
        c, out = self.letters[letter], set()
        for node, e, *swap in self.sets[state]:
            if swap:
                if c == swap[0]:
                    out.add((node, e))
                continue
            out.add((node, e + 1))  # a letter too many
            for x, child in self.children[node].items():
                out.add((child, e if x == c else e + 1))
                if x != c and c in self.children[child]:
                    out.add((self.children[child][c], e + 1, x))
        return self._state(out)

    def hits(self, grid: Grid) -> list[tuple[int, int, int]]:
        """(word, entry, edits) of every word of the grid that matches."""
        if len(self.sets) > STATES:
            self._forget()
        size = grid.end - grid.begin
        alive, state, out, p = np.arange(len(size)), np.full(len(size), self.start, dtype=np.int32), [], 0
        while len(alive):
            ended = size[alive] == p
            if ended.any():
                out += [(int(w), *self.accept[s]) for w, s in zip(alive[ended], state[ended], strict=True) if self.accept[s]]
                alive, state = alive[~ended], state[~ended]
            letter = self.classes[grid.chars[grid.begin[alive] + p]]
            new = self.table[state, letter]
            unknown = new < 0
            if unknown.any():
                for s, c in set(zip(state[unknown].tolist(), letter[unknown].tolist(), strict=True)):
                    to = self._step(s, c)
                    self.table[s, c] = to
                new = self.table[state, letter]
            stems = self.stem[new]
            if (stems >= 0).any():
                out += [(int(w), int(k), 0) for w, k in zip(alive[stems >= 0], stems[stems >= 0], strict=True)]
            live = (new != 0) & (stems < 0)
            alive, state = alive[live], new[live]
            p += 1
        return out


@dataclass
class Model:
    """entries: (text, is a stem, edits, weight); coefficients of the bias, the weighed sum and its density."""

    entries: list[tuple[str, bool, int, float]]
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    _made: Automaton | None = field(default=None, repr=False, compare=False)

    def automaton(self) -> Automaton:
        if self._made is None:
            self._made = Automaton([e[:3] for e in self.entries])
        return self._made

    def __getstate__(self):
        return {"entries": self.entries, "coefficients": self.coefficients, "_made": None}

    def found(self, texts: list[str]) -> tuple[Grid, list[tuple[int, int, int, float]]]:
        """(text, entry, edits, factor of its context) of every hit."""
        grid = Grid(texts, plain=True)
        hits = self.automaton().hits(grid)
        out = []
        if not hits:
            return grid, out
        word = lambda w: "".join(map(chr, grid.chars[grid.begin[w] : grid.end[w]]))
        quotes, feeds = np.flatnonzero(np.isin(grid.chars, _QUOTES)), np.flatnonzero(grid.chars == 10)  # texts are parted by a feed
        for w, entry, edits in sorted(hits):
            doc, at = int(np.searchsorted(grid.doc_at, w, side="right")) - 1, grid.begin[w]
            line = int(np.searchsorted(feeds, at))
            before, here, after = np.searchsorted(quotes, [feeds[line - 1] if line else 0, at, feeds[line] if line < len(feeds) else len(grid.chars)])
            factor = QUOTED if (here - before) % 2 and after > here else 1.0
            first, last = int(grid.doc_at[doc]), int(grid.doc_at[doc + 1])
            ahead = {word(k) for k in range(max(first, w - WINDOW_WORDS), w)}
            around = ahead | {word(k) for k in range(w + 1, min(last, w + 1 + WINDOW_WORDS))}
            factor *= REPORTED if ahead & REPORTING else 1.0
            factor *= ADDRESSED if around & SECOND_PERSON else 1.0
            out.append((doc, entry, edits, factor))
        return grid, out

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: 1, log of 1 + the weighed sum, log of 1 + the sum in 1000 words."""
        grid, hits = self.found(texts)
        total = np.zeros(len(texts))
        for doc, entry, edits, factor in hits:
            total[doc] += self.entries[entry][3] * factor * MISSPELT**edits
        words = np.maximum(np.diff(grid.doc_at), 20)
        return np.stack([np.ones(len(texts)), np.log1p(total), np.log1p(1000 * total / words)], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.coefficients), -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of labelled rows that may be learned from: crc32(doc_id as text) mod 3 is not 1; about `most` by hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    # labels that contradict each other teach nothing
    own = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").cast("int").alias("_y")).where("y = _y").drop("_y")
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(own, "doc_id").select("text", "y")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_lexicon(rows: DataFrame) -> list[tuple[str, bool, int, float]]:
    """Words and stems whose presence marks toxic rows, from (row, text, y): every one that passes the odds test, of which a
    bounded number of rows has a bounded number."""
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    tokens = rows.select("row", "y", F.explode(words).alias("token")).where("length(token) >= 3")
    # a word as it is, and its beginnings as stems
    stems = F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.lit(8), F.length("token") - 1))), lambda n: F.struct(F.substring("token", F.lit(1), n).alias("entry"), (F.length("token") > n).alias("stem")))
    both = F.concat(F.array(F.struct(F.col("token").alias("entry"), F.lit(False).alias("stem"))), F.filter(stems, lambda s: s["stem"]))
    entries = tokens.select("row", "y", "token", F.explode(both).alias("e")).select("row", "y", "token", "e.entry", "e.stem")
    least = max(3, round(0.01 * toxic))
    found = (
        entries.where("y = 1").groupBy("entry", "stem").agg(F.count_distinct("row").alias("toxic"), F.count_distinct("token").alias("forms"))
        .where((F.col("toxic") >= least) & (~F.col("stem") | (F.col("forms") >= 4)))
    )
    found = cut(found, "lexicon", files=8)
    seen = entries.where("y = 0").join(found.select("entry", "stem"), ["entry", "stem"]).groupBy("entry", "stem").agg(F.count_distinct("row").alias("clean"))
    # purity by a lower bound, so that chance meetings of rare words with few toxic rows don't enter; before any limit
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    pure = (F.col("toxic") - 1.5 * F.sqrt("toxic")) / toxic > 4 * (F.col("clean") + 0.5) / clean
    passed = found.join(seen, ["entry", "stem"], "left").fillna(0, ["clean"]).withColumn("weight", weight).where((F.col("weight") > 1.5) & pure)
    odds = [(r.entry, r.stem, r.toxic, r.clean, r.weight) for r in passed.collect()]
    stems = sorted((o for o in odds if o[1]), key=lambda o: len(o[0]))
    kept: list[tuple] = []
    for o in stems:  # the shortest of nested stems stands for the longer
        if not any(o[0].startswith(k[0]) for k in kept):
            kept.append(o)
    chosen = kept + [o for o in odds if not o[1] and not any(o[0].startswith(k[0]) for k in kept)]
    rank = lambda o: (-o[2] * o[4], o[0])
    chosen.sort(key=rank)
    # a stem takes no edit: the words it covers stay beside it, for their misspellings
    short = [o[0] for o in chosen if o[1]]
    chosen += sorted((o for o in odds if not o[1] and edits_for(o[0]) and any(o[0].startswith(s) for s in short)), key=rank)
    return [(o[0], o[1], 0 if o[1] else edits_for(o[0]), min(o[4], 8.0) / 8.0) for o in chosen]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic. Without toxic or clean rows to learn from, it has no entry and scores all alike."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, most).withColumn("row", F.xxhash64("text"))
    rows = cut(rows.repartition(16, "row"), "labelled")
    model = Model(learn_lexicon(rows))
    if not model.entries:
        return model

    def collected(model: Model, make, schema: str):
        return map_arrow(rows.select("text", "y"), make, schema).collect()

    def hits():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, found = model.found(texts_of(batch))
            y = batch.column("y").to_pylist()
            own = sorted({(doc, entry) for doc, entry, edits, _ in found if edits})
            return pa.RecordBatch.from_arrays([pa.array([e for _, e in own], pa.int32()), pa.array([y[d] for d, _ in own], pa.int32())], ["entry", "y"])

        return apply

    # a word whose misspellings are met in clean rows as often as in toxic ones is matched as it is only
    met: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for r in collected(model, hits, "entry int, y int"):
        met[r.entry][r.y] += 1
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model([(t, s, 0 if met[k][0] and (met[k][1] + 0.5) / n[1] < 8 * met[k][0] / n[0] else e, w) for k, (t, s, e, w) in enumerate(model.entries)])

    def features():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = model.features(texts_of(batch))
            return pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column("y")], ["a", "b", "y"])

        return apply

    got = collected(model, features, "a double, b double, y int")
    x = np.array([[1.0, r.a, r.b] for r in got])
    model.coefficients = regress(x, np.array([float(r.y) for r in got]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with tox_score, a double from 0 to 1, in place of any column so called."""
    docs = docs.drop("tox_score")
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts_of(batch, text)))], [*batch.schema.names, "tox_score"])

        return apply

    return map_arrow(docs, make, StructType([*docs.schema.fields, StructField("tox_score", DoubleType())]), text)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(shared.value.scores(texts_of(batch)) < threshold))

        return apply

    return map_arrow(docs, make, docs.schema)
