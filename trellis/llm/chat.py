"""Chat formatting by a compiled template.

A template has text, ``{{ expression }}``, ``{% for m in messages %}``,
``{% if %} {% elif %} {% else %}``, ``{% set x = ... %}`` and
``{% generation %}`` blocks, whose output is what a model learns to write (the
loss mask). Expressions know literals, names, ``a.b`` and ``a['b']`` (keys of
mappings only), ``== != < > + and or not in``, parentheses, ``x if c else y``
and the filters of ``FILTERS``. Nothing else can be reached from a template: no
calls, no Python attributes, no imports.

``compile_template`` parses to a syntax tree, folds constants (expressions,
conditions, neighbouring text) and turns the tree into nested closures.
Rendering gives the text and the spans of its generation blocks.

``format_conversations`` renders one row per conversation: rows are shuffled
by conversation, sorted by turn, and streamed; a task holds one conversation,
which is one output value. The default template escapes control characters
inside texts with a backslash, so that ``read_back`` recovers roles and texts exactly.

Defined cases: null text or role is empty; rows of one conversation with equal
(or null) turns are ordered by role and text, null turns first; a null
``conv_id`` is a conversation; repeated rows are repeated turns; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import prepare

CONTROL = re.compile(r"[\\<>#]")
TURN = re.compile(r"<turn ((?:[^\\<>#]|\\.)*)>((?:[^\\<>#]|\\.)*)</turn>\n", re.S)
DEFAULT = (
    "{% for m in messages %}<turn {{ m.role | escape }}>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>{{ '\\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """A template that cannot be parsed, or that asks for what the sandbox has not."""


def escape(s: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(),
                                "lower": lambda x: str(x).lower(), "title": lambda x: str(x).title(), "length": len}


# ---- syntax tree ----

@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Key:
    of: Any
    key: Any


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    of: Any


@dataclass
class Text:
    text: str


@dataclass
class Out:
    expr: Any


@dataclass
class For:
    var: str
    over: Any
    body: list


@dataclass
class If:
    branches: list  # (condition, body); the last may have the condition Const(True)


@dataclass
class Set:
    name: str
    expr: Any


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[<>+|.()\[\]]))", re.S)
_CHARS = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


class _Expr:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, src: str):
        self.toks: list[tuple[str, str]] = []
        at, src = 0, src.strip()
        while at < len(src):
            m = _TOKEN.match(src, at)
            if not m:
                raise TemplateError(f"cannot read {src[at:at + 20]!r}")
            self.toks.append((("int", "str", "name", "op")[m.lastindex - 1], m.group(m.lastindex)))
            at = m.end()
        self.i = 0

    def peek(self) -> str | None:
        return self.toks[self.i][1] if self.i < len(self.toks) and self.toks[self.i][0] != "str" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.i >= len(self.toks) or want and self.peek() != want:
            raise TemplateError(f"expected {want or 'a value'}")
        self.i += 1
        return self.toks[self.i - 1]

    def whole(self):
        out = self.choice()
        if self.i < len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")
        return out

    def choice(self):
        value = self.either()
        if self.peek() == "if":
            self.take()
            cond = self.either()
            self.take("else")
            return Op("if", [cond, value, self.choice()])
        return value

    def either(self):
        left = self.both()
        while self.peek() == "or":
            self.take()
            left = Op("or", [left, self.both()])
        return left

    def both(self):
        left = self.negated()
        while self.peek() == "and":
            self.take()
            left = Op("and", [left, self.negated()])
        return left

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", [self.negated()])
        left = self.sum()
        if self.peek() in ("==", "!=", "<", ">", "in"):
            return Op(self.take()[1], [left, self.sum()])
        return left

    def sum(self):
        left = self.filtered()
        while self.peek() == "+":
            self.take()
            left = Op("+", [left, self.filtered()])
        return left

    def filtered(self):
        out = self.keyed()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Filter(name, out)
        return out

    def keyed(self):
        out = self.atom()
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                out = Key(out, Const(self.take()[1]))
            else:
                out = Key(out, self.choice())
                self.take("]")
        return out

    def atom(self):
        kind, tok = self.take()
        if kind == "int":
            return Const(int(tok))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _CHARS.get(m[1], m[1]), tok[1:-1], flags=re.S))
        if kind == "name":
            return Const(_WORDS[tok]) if tok in _WORDS else Name(tok)
        if tok == "(":
            out = self.choice()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {tok!r}")


def parse(source: str) -> list:
    """The template's syntax tree."""
    parts = [p for p in _TAG.split(source) if p]
    at = 0

    def block(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        body: list = []
        while at < len(parts):
            p = parts[at]
            at += 1
            if p.startswith("{{"):
                body.append(Out(_Expr(p[2:-2]).whole()))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return body, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read {p!r}")
                    body.append(For(m[1], _Expr(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    branches, cond, word = [], _Expr(rest).whole(), "if"
                    while word != "endif":
                        inner, word, rest = block("elif", "else", "endif")
                        branches.append((cond, inner))
                        cond = _Expr(rest).whole() if word == "elif" else Const(True)
                    body.append(If(branches))
                elif word == "set":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read {p!r}")
                    body.append(Set(m[1], _Expr(m[2]).whole()))
                elif word == "generation":
                    body.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown or misplaced tag {p!r}")
            else:
                body.append(Text(p))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, "", ""

    return block()[0]


_PLAIN = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
          "+": lambda a, b: a + b, "in": lambda a, b: a in b, "not": lambda a: not a}


def _lookup(of: Any, key: Any) -> Any:
    if not isinstance(of, dict):
        raise TemplateError("only mappings have keys")
    return of.get(key)


def fold(x: Any) -> Any:
    """Constant folding of an expression."""
    if isinstance(x, Op):
        args = [fold(a) for a in x.args]
        if x.op == "if" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if x.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.op == "and") else args[0]
        if x.op in _PLAIN and all(isinstance(a, Const) for a in args):
            return Const(_PLAIN[x.op](*[a.value for a in args]))
        return Op(x.op, args)
    if isinstance(x, Filter):
        of = fold(x.of)
        return Const(FILTERS[x.name](of.value)) if isinstance(of, Const) else Filter(x.name, of)
    if isinstance(x, Key):
        return Key(fold(x.of), fold(x.key))
    return x


def fold_body(body: list) -> list:
    """Constant folding of a block: known conditions go, known output becomes text, neighbouring text joins."""
    out: list = []
    for n in body:
        new: list = [n]
        if isinstance(n, Out):
            e = fold(n.expr)
            new = [Text(_str(e.value))] if isinstance(e, Const) else [Out(e)]
        elif isinstance(n, If):
            branches = []
            for cond, inner in n.branches:
                cond = fold(cond)
                if isinstance(cond, Const) and not cond.value:
                    continue
                branches.append((cond, fold_body(inner)))
                if isinstance(cond, Const):
                    break
            new = [] if not branches else branches[0][1] if isinstance(branches[0][0], Const) else [If(branches)]
        elif isinstance(n, For):
            new = [For(n.var, fold(n.over), fold_body(n.body))]
        elif isinstance(n, Generation):
            new = [Generation(fold_body(n.body))]
        elif isinstance(n, Set):
            new = [Set(n.name, fold(n.expr))]
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return out


def _str(v: Any) -> str:
    return "" if v is None else str(v)


def _value(x: Any) -> Callable[[dict], Any]:
    """A closure that computes an expression in an environment."""
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):
        return lambda env, n=x.name: env.get(n)
    if isinstance(x, Key):
        of, key = _value(x.of), _value(x.key)
        return lambda env: _lookup(of(env), key(env))
    if isinstance(x, Filter):
        of, f = _value(x.of), FILTERS[x.name]
        return lambda env: f(of(env))
    args = [_value(a) for a in x.args]
    if x.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if x.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if x.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _PLAIN[x.op]
    return (lambda env: f(args[0](env))) if len(args) == 1 else (lambda env: f(args[0](env), args[1](env)))


class _Sink:
    def __init__(self):
        self.parts: list[str] = []
        self.n = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.n += len(s)


def _block(body: list) -> Callable[[dict, _Sink], None]:
    """A closure that renders a block."""
    steps = [_node(n) for n in body]

    def run(env: dict, sink: _Sink) -> None:
        for s in steps:
            s(env, sink)
    return steps[0] if len(steps) == 1 else run


def _node(n: Any) -> Callable[[dict, _Sink], None]:
    if isinstance(n, Text):
        return lambda env, sink, t=n.text: sink.put(t)
    if isinstance(n, Out):
        value = _value(n.expr)
        return lambda env, sink: sink.put(_str(value(env)))
    if isinstance(n, Set):
        value = _value(n.expr)
        return lambda env, sink, name=n.name: env.__setitem__(name, value(env))
    if isinstance(n, Generation):
        body = _block(n.body)

        def marked(env: dict, sink: _Sink) -> None:
            start = sink.n
            body(env, sink)
            sink.spans.append((start, sink.n))
        return marked
    if isinstance(n, If):
        branches = [(_value(c), _block(b)) for c, b in n.branches]

        def choose(env: dict, sink: _Sink) -> None:
            for cond, body in branches:
                if cond(env):
                    return body(env, sink)
        return choose
    over, body = _value(n.over), _block(n.body)

    def loop(env: dict, sink: _Sink) -> None:
        items = list(over(env) or ())
        outer = dict(env)
        for i, x in enumerate(items):
            env[n.var], env["loop"] = x, {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
            body(env, sink)
        for k in (n.var, "loop"):
            env.pop(k, None)
            if k in outer:
                env[k] = outer[k]
    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from an environment to the rendered text and its generation spans."""
    try:
        run = _block(fold_body(parse(source)))
    except RecursionError:
        raise TemplateError("the template nests too deeply") from None

    def render(env: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        run(dict(env), sink)
        return "".join(sink.parts), sink.spans
    return render


def per_turn(source: str) -> tuple[list, For, list] | None:
    """The template as what stands before its loop over the messages, the loop, and what stands after it; None if a turn's
    text may depend on other turns (``loop``, variables set, another loop or use of the messages)."""
    body = fold_body(parse(source))
    loops = [i for i, n in enumerate(body) if isinstance(n, For)]
    if len(loops) != 1 or body[loops[0]].over != Name("messages"):
        return None
    at = loops[0]

    def alone(x: Any) -> bool:
        if isinstance(x, (Set, For)) or isinstance(x, Name) and x.name in ("loop", "messages"):
            return False
        if isinstance(x, (list, tuple)):
            return all(map(alone, x))
        return all(map(alone, vars(x).values())) if hasattr(x, "__dict__") else True
    outside = body[:at] + body[at + 1:]
    return (body[:at], body[at], body[at + 1:]) if alone(body[at].body) and all(isinstance(n, (Text, Out)) for n in outside) and alone(outside) else None


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """Turns ``(role, text)`` and the learnt text of a conversation in the default format."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside the turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside the turns")
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sorted_turns(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("conv_id", "turn", text("role"), text("text"))


def format_turns(rows: DataFrame, template: str = DEFAULT) -> DataFrame:
    """``rows (conv_id, turn, role, text)`` formatted turn by turn: ``conv_id, turn, role, text, piece, spans``.

    The pieces of a conversation, joined by turn (null first), role and text, are its format; ``spans`` are counted from the
    piece's start. Every row is rendered where it lies, so a conversation of any length is no task's work. The template
    must render turns one by one (``per_turn``) and have nothing outside its loop.
    """
    prepare(rows.sparkSession)
    parts = per_turn(template)
    if parts is None or parts[0] or parts[2]:
        raise TemplateError("the template does not render turns one by one")
    src = _sorted_turns(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for b in batches:
            done = [render({"messages": [{"role": r, "text": t}]}) for r, t in zip(*[b.column(i).to_pylist() for i in (2, 3)])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t for t, _ in done], pa.string()),
                                              pa.array([[{"start": x, "end": y} for x, y in s] for _, s in done], SPANS)], [*b.schema.names, "piece", "spans"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{kinds}, piece string, spans array<struct<start:bigint,end:bigint>>")


def with_offsets(pieces: DataFrame) -> DataFrame:
    """``format_turns`` rows with ``start``, the piece's place in its conversation, by a running total of lengths; ``spans`` from there."""
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(before), F.lit(0).cast("bigint")))
    return placed.withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end"))))


def streamed(pieces: DataFrame) -> DataFrame:
    """``format_turns`` rows, each conversation's in order in one partition: a task that reads them on needs to hold one row."""
    n = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def format_conversations(rows: DataFrame, template: str = DEFAULT) -> DataFrame:
    """``rows (conv_id, turn, role, text)`` as ``conv_id``, ``n_turns``, ``formatted``, ``spans``: each conversation one value,
    for any template. A task holds a conversation; long ones are better left as the rows of ``format_turns``."""
    prepare(rows.sparkSession)
    compile_template(template)  # errors show here, not in a task
    src = _sorted_turns(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = src.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        turns: list[dict] = []
        done: list[tuple] = []
        conv = type_ = None

        def close() -> None:
            if turns:
                text, spans = render({"messages": turns})
                done.append((conv, len(turns), text, [{"start": a, "end": b} for a, b in spans]))
                turns.clear()

        def packed() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[], [], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (type_, pa.int64(), pa.string(), SPANS))],
                                              ["conv_id", "n_turns", "formatted", "spans"])
        for b in batches:
            type_ = b.column(0).type
            for c, _, role, text in zip(*[x.to_pylist() for x in b.columns]):
                if c != conv:
                    close()
                    conv = c
                turns.append({"role": role, "text": text})
            yield packed()
        if type_ is not None:
            close()
            yield packed()

    return src.mapInArrow(run, f"conv_id {kind}, n_turns bigint, formatted string, spans array<struct<start:bigint,end:bigint>>")
