"""Chat formatting by a compiled template.

A template has literal text, `{{ expression }}`, `{% for x in y %}`, `{% if e %} / {% elif e %} / {% else %}` and
`{% generation %}`, whose output is under the loss mask. Expressions are names, dotted fields, strings, numbers, `==`, `!=`,
`and`, `or`, `not`, `+` and filters (`| escape`, `| escape_line`, `| upper`, `| lower`, `| trim`). It is sandboxed: names
reach only what is given, fields only keys of dictionaries, filters only the table here. A template is parsed into a syntax
tree, constant parts are folded, and the tree becomes nested Python closures that emit (text, is generated) segments. The
loop over messages runs as a generator, so a conversation of any length is rendered a turn at a time.

The default template marks turns by control strings. Control strings inside texts are escaped reversibly: a backslash is
doubled, and one is put after the first character of each control string, which so never occurs in an escaped text.

Conversations are dealt by id and read in order of turn (nulls first, then role and text, so ties have one order). Null
roles and texts count as empty; repeated rows are turns of their own; rows with a null conversation id form one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.shared import ship

TURN, END = "<|turn|>", "<|end|>"
#: Strings that must not appear inside texts as they are: the template's own and common ones of other formats.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    + END + "\n{% endfor %}"
)

_CONTROL = re.compile(r"\\|(?=(?:" + "|".join(map(re.escape, CONTROL)) + r"))[\s\S]")
_ESCAPED = re.compile(r"\\([\s\S])")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """The text that was escaped. A backslash stands before itself or inside a control string."""
    return _ESCAPED.sub(lambda m: m[1] if m[1] != "\n" else "\n", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": lambda t: escape(t).replace("\n", "\\\n"), "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    """A template that doesn't parse, or a name that isn't given."""


# --- syntax tree ---


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: object


#: The condition of else, told from a constant elif by identity.
ELSE = Const(True)


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|().+]))")


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or wanted and token not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}, found {token!r}")
        self.at += 1
        return token

    def whole(self):
        out = self.either()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return out

    def _chain(self, lower, *ops: str):
        out = lower()
        while self.peek() in ops:
            op = self.take()
            out = Call(op, (out, lower()))
        return out

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negated, "and")

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Call("not", (self.negated(),))
        return self._chain(self.sum, "==", "!=")

    def sum(self):
        return self._chain(self.filtered, "+")

    def filtered(self):
        out = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Call("|" + name, (out,))
        return out

    def atom(self):
        token = self.take()
        if token == "(":
            out = self.either()
            self.take(")")
            return out
        if token[0] in "'\"":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1]))
        if token.isdigit():
            return Const(int(token))
        if not re.fullmatch(r"[A-Za-z_]\w*", token):
            raise TemplateError(f"unexpected {token!r}")
        path = [token]
        while self.peek() == ".":
            self.take()
            path.append(self.take())
        if any(p.startswith("_") for p in path):
            raise TemplateError("names don't start with _")
        return Name(tuple(path))


def parse(template: str) -> tuple:
    stack: list[tuple[str, list, object]] = [("", [], None)]
    at = 0
    for m in [*_TAG.finditer(template), None]:
        end = m.start() if m else len(template)
        if end > at:
            stack[-1][1].append(Text(template[at:end]))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Out(_Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            found = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest.strip(), re.DOTALL)
            if not found:
                raise TemplateError(f"can't read for {rest!r}")
            stack.append(("for", [], (found[1], _Expression(found[2]).whole())))
        elif word == "if":
            stack.append(("if", [], [(_Expression(rest).whole(), None)]))
        elif word in ("elif", "else"):
            kind, body, branches = stack.pop()
            if kind != "if" or branches[-1][0] is ELSE:
                raise TemplateError(f"{word} outside of if, or after else")
            branches[-1] = (branches[-1][0], tuple(body))
            stack.append(("if", [], [*branches, (_Expression(rest).whole() if word == "elif" else ELSE, None)]))
        elif word == "generation":
            stack.append(("generation", [], None))
        elif word in ("endfor", "endif", "endgeneration"):
            kind, body, held = stack.pop()
            if "end" + kind != word:
                raise TemplateError(f"{word} closes {kind or 'nothing'}")
            if kind == "for":
                node = For(held[0], held[1], tuple(body))
            elif kind == "if":
                held[-1] = (held[-1][0], tuple(body))
                node = If(tuple(held))
            else:
                node = Generation(tuple(body))
            stack[-1][1].append(node)
        else:
            raise TemplateError(f"no tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][1])


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _op(name: str) -> Callable:
    return FILTERS[name[1:]] if name[0] == "|" else _OPS[name]


def fold(node):
    """The same tree with constant expressions worked out, dead branches dropped and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif not (isinstance(y, Text) and not y.value):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Call):
        args = tuple(map(fold, node.args))
        return Const(_op(node.op)(*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Call(node.op, args)
    if isinstance(node, Out):
        value = fold(node.value)
        return Text(str(value.value)) if isinstance(value, Const) else Out(value)
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches = []
        for condition, body in ((fold(c), fold(b)) for c, b in node.branches):
            if isinstance(condition, Const):
                if condition.value:
                    branches.append((condition, body))
                    break
                continue
            branches.append((condition, body))
        if not branches:
            return ()
        return branches[0][1] if isinstance(branches[0][0], Const) else If(tuple(branches))
    return node


Segment = tuple[str, bool]


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):

        def look(scope, path=node.path):
            at = scope
            for p in path:
                if not isinstance(at, dict) or p not in at:
                    raise TemplateError(f"nothing is called {'.'.join(path)}")
                at = at[p]
            return at

        return look
    args, op = [_value(a) for a in node.args], _op(node.op)
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    return lambda scope: op(*(a(scope) for a in args))


def _block(nodes: tuple, generated: bool) -> Callable[[dict], Iterator[Segment]]:
    parts = [_node(n, generated) for n in nodes]

    def run(scope: dict) -> Iterator[Segment]:
        for part in parts:
            yield from part(scope)

    return run


def _node(node, generated: bool) -> Callable[[dict], Iterable[Segment]]:
    if isinstance(node, Text):
        return lambda scope, one=((node.value, generated),): one
    if isinstance(node, Out):
        value = _value(node.value)
        return lambda scope: ((str(value(scope)), generated),)
    if isinstance(node, Generation):
        return _block(node.body, True)
    if isinstance(node, If):
        branches = [(_value(c), _block(b, generated)) for c, b in node.branches]
        return lambda scope: next((body(scope) for condition, body in branches if condition(scope)), ())
    over, body, name = _value(node.over), _block(node.body, generated), node.name

    def loop(scope: dict) -> Iterator[Segment]:
        for i, x in enumerate(over(scope)):
            yield from body(scope | {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0}})

    return loop


def compile_template(template: str = TEMPLATE) -> Callable[[dict], Iterator[Segment]]:
    """A function from the given names to segments, (text, is it under the loss mask)."""
    return _block(fold(parse(template)), False)


def render(template: Callable[[dict], Iterator[Segment]], messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it that are generated, in code points."""
    out, spans, at = [], [], 0
    for text, generated in template({"messages": messages, **names}):
        if generated and text:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


_READ = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\[\s\S])*)\n((?:(?!" + re.escape(END) + r")[\s\S])*)" + re.escape(END) + r"\n")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text by the default template."""
    out, at = [], 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(id, its messages) of rows that come sorted by id; messages are read as they are asked for."""
    rows = ((c, {"turn": t, "role": r or "", "text": x or ""}) for b in batches for c, t, r, x in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True))
    held = next(rows, None)
    while held is not None:
        conv, following = held[0], []

        def messages(first=held, conv=conv, following=following):
            row = first
            while row is not None and row[0] == conv:
                yield row[1]
                row = next(rows, None)
            following.append(row)

        own = messages()
        yield conv, own
        for _ in own:  # what wasn't read
            pass
        held = following[0]


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conversations: conv_id, turn, role, text and any other columns. Returns conv_id, n_turns, formatted and loss_spans."""
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compile_template(template)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for conv, messages in _conversations(batches):
            n = [0]

            def counted(messages=messages, n=n):
                for m in messages:
                    n[0] += 1
                    yield m

            text, spans = render(made, counted())
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(n, pa.int64()), pa.array([text], pa.string()), pa.array([[{"start": a, "end": b} for a, b in spans]], spans_type)], ["conv_id", "n_turns", "formatted", "loss_spans"])

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def digest_conversations(conversations: DataFrame) -> DataFrame:
    """What the default template's output says when it is read back, turn by turn: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars. No conversation is held as a whole."""
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compile_template()
        out: list[list] = [[] for _ in range(6)]

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, messages in _conversations(batches):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            piece = ""

            for text, generated in made({"messages": messages}):
                piece += text
                chars += len(text)
                if generated:
                    plain = unescape(text)
                    loss.update(plain.encode())
                    loss_chars += len(plain)
                if piece.endswith(END + "\n"):  # a whole turn: an escaped text can't end so
                    for role, body in read_back(piece):
                        n += 1
                        turns.update(f"{role}\n{body}\n".encode())
                    piece = ""
            for column, x in zip(out, (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
                column.append(x)
            if len(out[0]) == 2000:
                yield batch()
                out = [[] for _ in range(6)]
        if out[0]:
            yield batch()

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(spark) -> DataFrame:
    """A conversation (-1) whose texts are control strings."""
    rows = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
