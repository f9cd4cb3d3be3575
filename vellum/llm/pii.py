"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to what repeats them.

Base spans (email, ip, card, phone) come from fixed patterns, searched so that long texts take linear time. The field's nodes
are number groups of 7 digits or more and words with an at sign. A node that a base span covers is observed with that kind;
the others have the label none or a kind. Unary potentials come from a softmax regression on the node's shape, chain
potentials tie nodes that stand close on a line, and skip potentials tie all nodes of one core (the last 7 digits, or the part
before the at sign) and, more weakly, of a similar one (the first 7 digits, or the letters before the at sign). All nodes of a
core share one factor node, so links grow with the number of nodes and not of pairs, and evidence reaches every repeat in two
steps, however many stand between. Loopy sum-product message passing runs over all texts of a batch at once until messages
stand still. An unobserved node whose marginal for a kind reaches SURE becomes an added span; the rules' refusal counts against
it, so only evidence from elsewhere in the document adds one. Base spans stay. Bounds of the potentials (AGAINST, NEIGHBOUR,
REPEAT) are set by hand: labels come from the rules, so a fit without bounds would only repeat the rules' refusals.

Parameters are fitted on a bounded sample of documents (TRAIN_ROWS, by hash), with the base spans as labels. Null texts
count as empty. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from vellum.llm.shared import map_arrow, ship, texts_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, SURE = 3000, 0.9
#: Messages stand still when none moves more than this; damped from round 20 on, given up after so many.
STILL, DAMPED, ROUNDS = 1e-4, 20, 500
#: How strong the potentials between a node and the factor node of its core are beside one between two nodes, since evidence
#: passes two of them; and of a similar core, which then carries a label only where the shape speaks little against it.
SHARED, SIMILAR = 1.5, 0.9
#: Bounds of the fitted potentials: how far a shape may speak against a kind, how far neighbours and repeats may speak.
AGAINST, NEIGHBOUR, REPEAT = (0.5, 1.5), 0.4, 4.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20-]*[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NOT_LETTER = re.compile(r"[^a-z]+")

Span = tuple[int, int, int]  # start, place of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start and kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Node:
    start: int
    end: int
    cores: tuple[str, ...]  # its own and, if it has one, a weaker one
    shape: tuple[float, ...]
    label: int  # of a base span that covers it: 1 + place of the kind; else 0
    line: int


def shape_of(token: str) -> tuple[float, ...]:
    digits = sum(c.isdigit() for c in token)
    at = "@" in token
    return (1.0, float(at), float(at and "." in token.rpartition("@")[2]), float(token[:1] == "+"), float("(" in token), float(token.count(".") == 3), float(9 <= digits <= 11), float(12 <= digits <= 15), float(16 <= digits <= 19), float(digits > 19), token.count("-") / 4, token.count(" ") / 4)


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    found = []
    for m in _NUMBER.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) >= 7:
            found.append((m.start(), m.end(), (digits[-7:], "^" + digits[:7]) if len(digits) > 9 else (digits[-7:],)))
    at = text.find("@")
    while at >= 0:
        start, end = at, at
        floor = found[-1][1] if found and found[-1][2][0][:1] == "@" else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        local = text[start:at].lower()
        letters = _NOT_LETTER.sub("", local)
        found.append((start, end, ("@" + local, "@^" + letters) if len(letters) > 4 else ("@" + local,)))
        at = text.find("@", end)
    found.sort()
    out, k, line, seen = [], 0, 0, 0
    for start, end, cores in found:
        while k < len(base) and base[k][2] <= start and (k + 1 == len(base) or base[k + 1][0] <= start):
            k += 1
        label = next((1 + b[1] for b in base[max(0, k - 2) : k + 3] if b[0] < end and start < b[2]), 0)
        line += text.count("\n", seen, start)
        seen = start
        out.append(Node(start, end, cores, shape_of(text[start:end]), label, line))
    return out


def chain_links(nodes: list[Node]) -> list[tuple[int, int]]:
    """Neighbours within 40 characters of a line."""
    return [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i].line == nodes[i + 1].line and nodes[i + 1].start - nodes[i].end <= 40]


def groups(nodes: list[Node]) -> list[tuple[bool, list[int]]]:
    """(is the core a similar one only, nodes) of each core that stands at two nodes or more."""
    by: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        for core in n.cores:
            by.setdefault(core, []).append(i)
    return [("^" in core[:2], own) for core, own in by.items() if len(own) > 1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Loopy sum-product in logarithms, until messages stand still; exact on trees. unary: nodes x labels; edges: (a, b) rows;
    potentials: edges x labels of a x of b."""
    if not len(edges):
        return np.exp(unary - _log_sum(unary, 1)[:, None])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    along = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), unary.shape[1]))
    for k in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, message)
        new = _log_sum((belief[source] - message[back])[:, :, None] + along, 1)
        new = new - _log_sum(new, 1)[:, None]
        if k >= DAMPED:
            new = (new + message) / 2
        moved = np.abs(new - message).max()
        message = new
        if moved < STILL:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - _log_sum(belief, 1)[:, None])


@dataclass
class Model:
    """weights: shape features x labels; chain: labels x labels; repeat: how strongly equal cores agree."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((12, 1 + len(KINDS))))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((1 + len(KINDS), 1 + len(KINDS))))
    repeat: float = 3.0

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
        """(start, place of the kind, end, added) of each text."""
        labels = 1 + len(KINDS)
        out = []
        nodes: list[Node] = []
        owner, edges, kinds, hubs, weak = [], [], [], [], []
        for i, text in enumerate(texts):
            base = base_spans(text)
            out.append([(*s, False) for s in base])
            if not base:
                continue  # nothing is observed, so nothing can be carried on
            own = nodes_of(text, base)
            if all(n.label for n in own):
                continue
            chain = chain_links(own)
            edges += [(a + len(nodes), b + len(nodes)) for a, b in chain]
            kinds += [0] * len(chain)
            for similar, members in groups(own):
                some = [bool(own[i].label) for i in members]
                if any(some) and not all(some):  # else there is nothing to carry, or nobody to carry it to
                    hubs.append([i + len(nodes) for i in members])
                    weak.append(2 if similar else 1)
            nodes += own
            owner += [i] * len(own)
        if not nodes:
            return out
        x = np.array([n.shape for n in nodes]) @ self.weights
        low, high = AGAINST
        unary = np.zeros((len(nodes), labels))
        unary[:, 1:] = -np.clip(x[:, :1] - x[:, 1:], low, high)
        seen = np.array([n.label for n in nodes])
        observed = np.flatnonzero(seen)
        unary[observed] = -60.0
        unary[observed, seen[observed]] = 0.0
        same = np.full((labels, labels), -self.repeat / 2)
        np.fill_diagonal(same, self.repeat)
        same[0, 0] = 0.0
        for k, (members, kind) in enumerate(zip(hubs, weak, strict=True), len(nodes)):
            edges += [(i, k) for i in members]
            kinds += [kind] * len(members)
        unary = np.concatenate([unary, np.zeros((len(hubs), labels))])
        table = np.stack([self.chain, SHARED * same, SIMILAR * same])
        belief = marginals(unary, np.array(edges, dtype=np.int64).reshape(-1, 2), table[np.array(kinds, dtype=np.int64)])
        for n, k in enumerate(np.flatnonzero((seen == 0) & (belief[: len(nodes), 1:].max(axis=1) >= SURE))):
            node = nodes[k]
            out[owner[k]].append((node.start, int(belief[k, 1:].argmax()), node.end, True))
        return [sorted(s) for s in out]


def fit(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Potentials from about `most` documents, by hash, with the base spans as labels."""
    ship(docs.sparkSession)
    n = docs.count()
    own = docs.select("text").where("text is not null")
    if n > most:
        own = own.where(F.pmod(F.xxhash64("text", F.lit(31)), F.lit(1_000_000)) < int(1_000_000 * most / n))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels = 1 + len(KINDS)
            shapes: dict[tuple, int] = {}
            pairs = np.zeros((2, labels, labels), dtype=np.int64)
            for text in texts_of(batch):
                nodes = nodes_of(text, base_spans(text))
                for node in nodes:
                    shapes[(*node.shape, node.label)] = shapes.get((*node.shape, node.label), 0) + 1
                alike = [pair for similar, own in groups(nodes) if not similar for pair in zip(own, own[1:])]
                for kind, found in enumerate((chain_links(nodes), alike)):
                    for a, b in found:
                        pairs[kind, nodes[a].label, nodes[b].label] += 1
            rows = [("shape", list(k), v) for k, v in shapes.items()] + [("pair", [float(i) for i in at], int(pairs[at])) for at in map(tuple, np.argwhere(pairs))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64())], ["what", "key", "n"])

        return apply

    counts = map_arrow(own, make, "what string, key array<double>, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).collect()
    return estimate([(r.what, tuple(r.key), r.n) for r in counts])


def estimate(counts: list[tuple[str, tuple[float, ...], int]]) -> Model:
    labels = 1 + len(KINDS)
    model = Model()
    shapes = sorted((k, n) for what, k, n in counts if what == "shape")
    if shapes:
        x = np.array([k[:-1] for k, _ in shapes])
        y = np.eye(labels)[[int(k[-1]) for k, _ in shapes]]
        n = np.array([c for _, c in shapes], dtype=float)
        w = np.zeros((x.shape[1], labels))
        for _ in range(400):  # softmax regression by gradient steps, drawn to 0
            z = x @ w
            p = np.exp(z - _log_sum(z, 1)[:, None])
            w -= 0.5 * ((x * n[:, None]).T @ (p - y) / n.sum() + 1e-3 * w)
        model.weights = w
    pairs = np.zeros((2, labels, labels))
    for what, k, c in counts:
        if what == "pair":
            pairs[tuple(int(i) for i in k)] += c
    chain = pairs[0] + pairs[0].T + 1
    expected = chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True) / chain.sum()
    model.chain = np.clip(np.log(chain / expected), -NEIGHBOUR, NEIGHBOUR)
    # of repeats that both are labelled; 20 that agree and one that doesn't are assumed beforehand
    labelled = pairs[1][1:, 1:]
    model.repeat = float(np.clip(np.log((np.trace(labelled) + 20) / (labelled.sum() - np.trace(labelled) + 1)), 2.0, REPEAT))
    return model


_TYPE = "array<struct<start:bigint,ord:int,end:bigint,kind:string,added:boolean>>"


def find_pii(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with pii_spans (in place of any column so called), an array of (start, ord, end, kind, added) by start and kind."""
    docs = docs.drop("pii_spans")
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def make():
        kind = pa.list_(pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("added", pa.bool_())]))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"start": a, "ord": k, "end": b, "kind": KINDS[k], "added": new} for a, k, b, new in own] for own in shared.value.spans(texts_of(batch, text))]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "pii_spans"])

        return apply

    return map_arrow(docs, make, StructType([*docs.schema.fields, StructField("pii_spans", _parse_datatype_string(_TYPE))]), text)


def redact(text: str, spans: Iterator[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap, the first counts."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]
