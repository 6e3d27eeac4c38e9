"""Chat formatting: a small sandboxed template language, compiled to Python closures.

    literal text
    {{ expression }}                   message.role, message.text, loop.index, loop.first, 'text', name | filter
    {% for message in messages %} ... {% endfor %}
    {% if expression == expression %} ... {% elif ... %} ... {% else %} ... {% endif %}     also !=, and, or, not
    {% generation %} ... {% endgeneration %}         what is said inside is under the loss mask

A template is parsed into a syntax tree; expressions over constants are folded, adjacent constants joined, and
branches that can't be taken dropped; the rest becomes closures that yield (text, masked) pieces. Only fields of a
message and of the loop can be reached, and only the named filters called: there is no attribute access, no call, no
index, no import and no while loop.

Rendering is a generator over turns, so a conversation of any length runs in bounded memory. Control strings inside
texts are escaped reversibly: `<`, n backslashes, `|` gets one backslash more, so no text can contain `<|`. A newline
in a role would end the header; there, backslash and newline are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.store import ship

CHAT_TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_' + 'start|>' }}{{ message.role | escape | header }}{{ '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_end|>\\n' }}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't in the language."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_header(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_header(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "header": escape_header, "upper": str.upper, "lower": str.lower, "trim": str.strip,
}

# ---- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    owner: str
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or a filter: name and operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Say:
    value: object


@dataclass(frozen=True)
class Loop:
    var: str
    body: tuple


@dataclass(frozen=True)
class Branch:
    arms: tuple  # of (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Masked:
    body: tuple


_FIELDS = {"role": str, "text": str}
_LOOP_FIELDS = ("index", "first")
_OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: str(a) + str(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "and": lambda a, b: bool(a) and bool(b), "or": lambda a, b: bool(a) or bool(b), "not": lambda a: not a,
}
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|+()]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'"}


def _unquoted(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), quoted[1:-1])


class _Expressions:
    """Recursive descent over one tag's text."""

    def __init__(self, source: str, names: tuple[str, ...]):
        self.tokens, at, self.names, self.i = [], 0, names, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(m)
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.i][0].strip() if self.i < len(self.tokens) else None

    def take(self, what: str) -> bool:
        if self.peek() == what:
            self.i += 1
            return True
        return False

    def whole(self):
        found = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return found

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        for op in ("==", "!="):
            if self.take(op):
                return Apply(op, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            value = Apply(name, (value,))
        return value

    def atom(self):
        if self.i >= len(self.tokens):
            raise TemplateError("an expression ends early")
        m = self.tokens[self.i]
        self.i += 1
        if m[1]:
            return Const(_unquoted(m[1]))
        if m[2]:
            return Const(int(m[2]))
        if m[4] == "(":
            inner = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return inner
        name = m[3]
        if name in ("true", "false"):
            return Const(name == "true")
        if name in self.names or (name == "loop" and self.names):
            if not self.take("."):
                raise TemplateError(f"{name} needs a field")
            field = self.peek()
            if field not in (_LOOP_FIELDS if name == "loop" else _FIELDS):
                raise TemplateError(f"{name} has no field {field!r}")
            self.i += 1
            return Field("loop" if name == "loop" else "message", field)
        raise TemplateError(f"unknown name {name or m[0]!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...], names: tuple[str, ...]):
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Say(_Expressions(part[2:-2], names).whole()))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return tuple(out), tag
                if word == "for":
                    m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", tag)
                    if not m or names or m[1] in ("loop", "true", "false", "and", "or", "not"):
                        raise TemplateError(f"not a loop over messages: {tag!r}")
                    out.append(Loop(m[1], block(("endfor",), (m[1],))[0]))
                elif word == "if":
                    arms, test = [], _Expressions(tag[2:], names).whole()
                    while True:
                        body, end = block(("elif", "else", "endif"), names)
                        arms.append((test, body))
                        if end == "endif":
                            break
                        test = Const(True) if end == "else" else _Expressions(end[4:], names).whole()
                    out.append(Branch(tuple(arms)))
                elif word == "generation":
                    out.append(Masked(block(("endgeneration",), names)[0]))
                else:
                    raise TemplateError(f"unknown tag {tag!r}")
            elif part:
                out.append(Say(Const(part)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(out), ""

    return block((), ())[0]


def fold(node):
    """The tree with constant expressions evaluated, impossible branches dropped and adjacent constants joined."""
    if isinstance(node, Apply):
        args = tuple(fold(a) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            f = _OPERATORS.get(node.name)
            return Const(f(*(a.value for a in args)) if f else FILTERS[node.name](str(args[0].value)))
        return Apply(node.name, args)
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Say) and isinstance(y.value, Const) and out and isinstance(out[-1], Say) and isinstance(out[-1].value, Const):
                    out[-1] = Say(Const(str(out[-1].value.value) + str(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Say):
        return Say(fold(node.value))
    if isinstance(node, Loop):
        return Loop(node.var, fold(node.body))
    if isinstance(node, Masked):
        return Masked(fold(node.body))
    if isinstance(node, Branch):
        arms = []
        for test, body in node.arms:
            test = fold(test)
            if isinstance(test, Const):
                if not test.value:
                    continue
                if not arms:
                    return fold(body)
                arms.append((test, fold(body)))
                break
            arms.append((test, fold(body)))
        return Branch(tuple(arms)) if arms else ()
    return node


Turn = dict  # role, text; index and first of the loop are kept beside it
Piece = tuple[str, bool]


def _value(node) -> Callable[[Turn, dict], object]:
    if isinstance(node, Const):
        return lambda m, loop, v=node.value: v
    if isinstance(node, Field):
        name = node.name
        return (lambda m, loop: loop[name]) if node.owner == "loop" else (lambda m, loop: m[name])
    args = [_value(a) for a in node.args]
    if node.name in FILTERS:
        f, one = FILTERS[node.name], args[0]
        return lambda m, loop: f(str(one(m, loop)))
    f = _OPERATORS[node.name]
    return lambda m, loop: f(*(a(m, loop) for a in args))


def _emitter(body: tuple, masked: bool) -> Callable[[Turn, dict], Iterator[Piece]]:
    """A closure that yields the pieces of a body without loops."""
    steps = []
    for node in body:
        if isinstance(node, Say):
            value = _value(node.value)
            steps.append(lambda m, loop, v=value: ((str(v(m, loop)), masked),))
        elif isinstance(node, Masked):
            steps.append(_emitter(node.body, True))
        elif isinstance(node, Branch):
            arms = [(_value(test), _emitter(inner, masked)) for test, inner in node.arms]

            def choose(m, loop, arms=arms):
                for test, inner in arms:
                    if test(m, loop):
                        return inner(m, loop)
                return ()

            steps.append(choose)
        else:
            raise TemplateError("a loop inside a loop, a branch or a generation")

    def run(m, loop):
        for step in steps:
            yield from step(m, loop)

    return run


def compile_template(source: str) -> Callable[[Iterable[Turn]], Iterator[Piece]]:
    """A function from turns to (text, masked) pieces, as they come. At most one loop over the messages is allowed."""
    tree = fold(parse(source))
    at = [i for i, n in enumerate(tree) if isinstance(n, Loop)]
    if len(at) > 1:
        raise TemplateError("more than one loop over messages")
    i = at[0] if at else len(tree)
    before, after = _emitter(tree[:i], False), _emitter(tree[i + 1 :], False)
    each = _emitter(tree[i].body, False) if at else None

    def render(turns: Iterable[Turn]) -> Iterator[Piece]:
        yield from before({}, {})
        if each:
            for index, m in enumerate(turns):
                yield from each(m, {"index": index, "first": index == 0})
        yield from after({}, {})

    return render


# ---- Spark -------------------------------------------------------------------------------------------------------

_FORMATTED = "conv_id long, part int, last boolean, text string, mask array<struct<start:long,end:long>>"


def _formatted(source: str, part_chars: int):
    def turns_of(rows, ahead):
        """Turns up to the next conversation; the row after them is left in ahead."""
        conv = ahead[0][0]
        while ahead[0] is not None and ahead[0][0] == conv:
            yield {"role": ahead[0][1], "text": ahead[0][2]}
            ahead[0] = next(rows, None)

    def parts(render, rows):
        ahead = [next(rows, None)]
        while ahead[0] is not None:
            conv, number, out, mask, size = ahead[0][0], 0, [], [], 0
            for text, masked in render(turns_of(rows, ahead)):
                if masked and text:
                    if mask and mask[-1]["end"] == size:
                        mask[-1]["end"] = size + len(text)
                    else:
                        mask.append({"start": size, "end": size + len(text)})
                out.append(text)
                size += len(text)
                if size >= part_chars:
                    yield conv, number, False, "".join(out), mask
                    number, out, mask, size = number + 1, [], [], 0
            yield conv, number, True, "".join(out), mask

    def run(batches):
        render = compile_template(source)
        rows = ((c, r or "", t or "") for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        held, weight = [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for p in parts(render, rows):
            held.append(p)
            weight += len(p[3])
            if len(held) >= 1000 or weight >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def format_chats(
    conversations: DataFrame, template: str = CHAT_TEMPLATE, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", part_chars: int = 1 << 20
) -> DataFrame:
    """conv_id, part, last, text, mask: each conversation rendered; parts of about part_chars for very long ones.

    mask has the code-point spans of the part that are under the loss mask. Rows go by turn, nulls first, ties by role
    and text; null roles and texts count as empty; rows of a null conv_id are one conversation. Repeated rows are turns
    of their own; other columns are left out; an empty table gives an empty result. Rows of a conversation are streamed
    in order through one task in bounded memory; parts come out in order within their partition.
    """
    compile_template(template)  # errors show here, not on the executors
    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn")
    )
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_formatted(template, part_chars), _FORMATTED)


_START, _END = "<|im_start|>", "<|im_end|>\n"


class _Reader:
    """Reads a conversation back from its parts: turns and masked texts into running hashes."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.text, self.mask = "", []  # of the turn that isn't complete; mask relative to it

    def add(self, text: str, mask) -> None:
        shift = len(self.text)
        self.mask += [[m["start"] + shift, m["end"] + shift] for m in mask]
        self.chars += len(text)
        text, at = self.text + text, 0
        while (end := text.find(_END, at)) >= 0:
            if not text.startswith(_START, at):
                raise ValueError("a turn doesn't begin with its mark")
            role, _, said = text[at + len(_START) : end].partition("\n")
            self.turns.update(f"{unescape(unescape_header(role))}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
            stop = end + len(_END)
            inside = [m for m in self.mask if m[0] < stop]
            self.mask = self.mask[len(inside) :]
            shown = unescape("".join(text[a:b] for a, b in inside))
            self.loss.update(shown.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(shown)
            at = stop
        self.text = text[at:]
        self.mask = [[a - at, b - at] for a, b in self.mask]


def _read_back(batches):
    reader, conv, rows = None, None, []
    for b in batches:
        for c, last, text, mask in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if reader is None:
                reader, conv = _Reader(), c
            reader.add(text, mask)
            if last:
                rows.append((conv, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
                reader = None
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            rows = []


def chat_digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from what format_chats returned with CHAT_TEMPLATE (not shuffled since)."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
