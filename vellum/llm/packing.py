"""Packing token sequences into windows by non-negative least squares over length combinations.

One pass tokenises and cuts every document into whole windows and a remainder, and takes each piece's length and crc32
there, so tokens are never shuffled. Pieces (narrow rows) are dealt by hash to bins of bounded size. In each bin, whole
windows are sequences. For the remainders, combinations of two and three lengths that fill a window exactly are enumerated
from the bin's length histogram, non-negative least squares finds repeat counts that explain the histogram, the counts are
rounded down and realised, and best-fit decreasing packs what is left. A sequence's offsets are gapless from 0; its padding
goes up to the window unless its length is a power of two.

Ids are those of the tokenizer's own encode(): text that spells a special token is that token. Null texts count as empty and
consist of the closing id alone. Repeated rows are packed as separate documents.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import cut, map_arrow, ship, texts_of

WINDOW, CLOSE = 2048, 1
#: Pieces of a bin on average, which bounds a task's memory and the histogram's support.
BIN = 8192
#: Pieces of words that each of a worker's two memories holds the ids of, and characters that are split into pieces at once.
REMEMBERED, STRETCH = 250_000, 65_536

# The normalizer and the pre-tokenizer that the short way is for. What they mean for printable ASCII and Latin-1
# letters is _PIECE on the text in lower case; all other texts, and all texts of other files, go to the tokenizer.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN = re.compile(r"[\x09-\x0D\x20-~À-ÖØ-öø-ÿ]*\Z")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[!-/:-@\[-`{-~]+")


class Memory(dict):
    """Pieces with their ids; what is missing is taken from an older memory, or else encoded."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        self[piece] = found = self.encode(piece) if found is None else found
        return found


class WordIds:
    """Ids of texts under a tokenizer's file, as the tokenizer gives them without added special tokens. Where the file splits
    words as above and a text has only plain characters, it is split here and each distinct piece is encoded once."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = json.loads(self.whole.to_str())
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parts["added_tokens"]) or r"(?!)", re.IGNORECASE)
        self.splits = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and parts["post_processor"] is None
        self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.letters = {c: "".join(letter[b] for b in chr(c).encode()) for c in [*range(33, 127), *range(0xC0, 0x100)]}
        self.pieces = Memory(self._encode, {})

    def _encode(self, piece: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.bare.model.tokenize(piece.translate(self.letters))])

    def _plain(self, text: str) -> bytes:
        if len(self.pieces) > REMEMBERED:
            self.pieces = Memory(self._encode, dict(self.pieces))
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Pieces never cross a space, so long texts are cut before some."""
        out = []
        for text in texts:
            if self.special.search(text):
                stretches, plain = [text], False
            else:
                stretches, plain = _stretches(text) if self.splits else [text], self.splits and _PLAIN.match(text)
            out.append(b"".join([self._plain(t) if plain else np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in stretches]))
        return out


def _stretches(text: str) -> list[str]:
    """A text in parts of about STRETCH characters, cut before spaces."""
    out, at = [], 0
    while len(text) - at > STRETCH and (to := text.find(" ", at + STRETCH)) > 0:
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _pieces(path: str, window: int, close: int):
    def make():
        words, end, seen = encoder(path), np.array([close], dtype="<u4").tobytes(), itertools.count()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for i, ids in enumerate(words.ids(texts_of(batch))):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    own = memoryview(ids)[4 * at : 4 * (at + window)]
                    row.append(i)
                    start.append(at)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    total.append(n)
                    nth.append(next(seen))
            docs = batch.column("doc_id").take(pa.array(row, pa.int32()))
            return pa.RecordBatch.from_arrays([docs, *(pa.array(x, pa.int64()) for x in (start, length, crc, total, nth))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])

        return apply

    return make


def solve(columns: np.ndarray, target: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent: x >= 0 least in |A x - target|^2, where column k of A counts the
    bins columns[k] (repeats count more)."""
    x = np.zeros(len(columns))
    rest = target.astype(float).copy()
    counts = [dict(zip(*np.unique(c, return_counts=True), strict=True)) for c in columns]
    parts = [(np.fromiter(c.keys(), int), np.fromiter(c.values(), float)) for c in counts]
    for _ in range(rounds):
        moved = 0.0
        for k, (bins, times) in enumerate(parts):
            step = max(float(times @ rest[bins]) / float(times @ times), -x[k])
            if step:
                x[k] += step
                rest[bins] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.02:
            break
    return x


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, most: int = 3000) -> np.ndarray:
    """Rows of three lengths (0 for none) that fill the window: all pairs, then triples, those first whose rarest length is the
    most frequent, up to `most` rows. What no row takes up is packed by best fit."""
    times = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    pairs = [(a, window - a, 0) for a in lengths.tolist() if a <= window - a and window - a in times]
    common = lengths[np.argsort(-counts, kind="stable")][:160].tolist()
    triples = {tuple(sorted((a, b, window - a - b), reverse=True)) for i, a in enumerate(common) for b in common[i:] if window - a - b > 0 and window - a - b in times}
    ranked = sorted(triples, key=lambda t: (-min(times[n] / t.count(n) for n in t), t))
    return np.array(pairs + ranked[: max(0, most - len(pairs))], dtype=np.int64).reshape(-1, 3)


def plan(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Sequences as lists of indices into lengths (each at most window)."""
    at: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        at[n].append(i)
    out = [[i] for i in at.pop(window, [])]
    values = np.array(sorted(at), dtype=np.int64)
    counts = np.array([len(at[v]) for v in values.tolist()], dtype=np.int64)
    combos = combinations(values, counts, window) if len(values) else np.empty((0, 3), dtype=np.int64)
    if len(combos):
        place = {v: k for k, v in enumerate(values.tolist())}
        times = np.floor(solve([[place[v] for v in c if v] for c in combos.tolist()], counts) + 1e-6).astype(int)
        for once in (False, True):  # the rounded counts, then any combination that is still at hand
            for c, n in sorted(zip(combos.tolist(), times.tolist(), strict=True), key=lambda cn: -cn[1]):
                need = [v for v in c if v]
                k = min(len(at[v]) // need.count(v) for v in need)
                for _ in range(k if once else min(k, n)):
                    out.append([at[v].pop() for v in need])
    # best-fit decreasing: the sequence with the least room that still fits
    rooms: list[int] = []
    by_room: dict[int, list[list[int]]] = defaultdict(list)
    for n in sorted((v for v in at if at[v]), reverse=True):
        for i in at[n]:
            k = bisect.bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms.pop(k)
                own = by_room[room].pop()
            else:
                room, own = window, []
                out.append(own)
            own.append(i)
            if room - n:
                bisect.insort(rooms, room - n)
                by_room[room - n].append(own)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, close: int = CLOSE) -> DataFrame:
    """docs: doc_id, text and any other columns; tokenizer: path of the file, which every executor must have. Returns a row
    for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of the whole sequence)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)
    pieces = map_arrow(docs.select("doc_id", "text"), _pieces(tokenizer, window, close), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")
    pieces = cut(pieces, "pieces")
    bins = max(1, -(-pieces.count() // BIN))
    # repeated rows, which agree in all else, are told apart by their place in the task that read them
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", "nth"), F.lit(bins))).drop("nth")

    def one(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        lengths = frame["length"].tolist()
        sequence, offset, padding = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
        for s, own in enumerate(plan(lengths, window)):
            at = 0
            for i in own:
                sequence[i], offset[i] = s, at
                at += lengths[i]
            padding[own] = 0 if at & (at - 1) == 0 else window - at
        return frame.assign(sequence_id=frame["bin"].to_numpy(dtype=np.int64) * (1 << 32) + sequence, offset=offset, padding=padding).drop(columns="bin")

    return dealt.groupBy("bin").applyInPandas(one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long")
