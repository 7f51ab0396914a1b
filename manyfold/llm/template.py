"""A sandboxed template language for conversations, compiled to Python generators.

    text            as it is                        {{ expr }}       its value as text (none: empty)
    {# comment #}   nothing                         {% set x = expr %}
    {% for x in expr %} ... {% endfor %}            loop.first, loop.last, loop.index, loop.index0
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}        marks what it renders as to be learned
    expr: or, and, not, == != < <= > >= in, + ~ - %, x.key, x[expr], x | filter, literals, ( )

`{%-` and `-%}` (and the same of `{{`) drop the white space beside them. Templates reach nothing but the values given
to them: `.` and `[]` look up keys of dicts and places of lists, never attributes; there are no calls but the filters
given at compilation. Constants are folded: operators and filters over literals are worked out, branches on literals
are chosen, texts on end are joined. Rendering is lazy in the thing looped over, which may be any iterator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template or a value in it is wrong."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>+~%.\[\]()|,=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = ("==", "!=", "<", "<=", ">", ">=", "in")

FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "default": lambda x, other="": other if x is None else x,
}


def _text(x: Any) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


class _Expr:
    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.filters, self.tokens, at = filters, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m.group(kind)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 2 else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} not expected")

    def expr(self) -> Any:
        left = self.conj()
        while self.take("or"):
            left = _fold(Op("or", (left, self.conj())), self.filters)
        return left

    def conj(self) -> Any:
        left = self.negation()
        while self.take("and"):
            left = _fold(Op("and", (left, self.negation())), self.filters)
        return left

    def negation(self) -> Any:
        if self.take("not"):
            return _fold(Op("not", (self.negation(),)), self.filters)
        left = self.sum()
        if op := self.take(*_COMPARE):
            return _fold(Op(op, (left, self.sum())), self.filters)
        if self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
            self.at += 2
            return _fold(Op("not", (_fold(Op("in", (left, self.sum())), self.filters),)), self.filters)
        return left

    def sum(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "-", "~", "%"):
            left = _fold(Op(op, (left, self.filtered())), self.filters)
        return left

    def filtered(self) -> Any:
        x = self.atom()
        while self.take("|"):
            name, args = self.name(), []
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.expr())
                    if not self.take(","):
                        self.need(")")
                        break
            x = _fold(Filter(name, x, tuple(args)), self.filters)
        return x

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            x: Any = Const(int(word))
        elif kind == 2:
            x = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == 3:
            x = Const({"true": True, "false": False, "none": None}[word.lower()]) if word.lower() in ("true", "false", "none") else Name(word)
        elif word == "(":
            x = self.expr()
            self.need(")")
        elif word == "-":
            x = _fold(Op("-", (Const(0), self.atom())), self.filters)
        else:
            raise TemplateError(f"{word!r} not expected")
        while op := self.take(".", "["):
            if op == ".":
                x = Item(x, Const(self.name()))
            else:
                x = Item(x, self.expr())
                self.need("]")
        return x


def _apply(op: str, a: list) -> Any:
    try:
        match op:
            case "not":
                return not a[0]
            case "==":
                return a[0] == a[1]
            case "!=":
                return a[0] != a[1]
            case "<":
                return a[0] < a[1]
            case "<=":
                return a[0] <= a[1]
            case ">":
                return a[0] > a[1]
            case ">=":
                return a[0] >= a[1]
            case "in":
                return a[0] in a[1]
            case "+":
                return a[0] + a[1]
            case "-":
                return a[0] - a[1]
            case "~":
                return _text(a[0]) + _text(a[1])
            case "%" if isinstance(a[0], int):
                return a[0] % a[1]
    except (TypeError, ZeroDivisionError) as e:
        raise TemplateError(str(e)) from e
    raise TemplateError(f"{op!r} doesn't go with {type(a[0]).__name__}")


def _fold(node: Any, filters: dict[str, Callable]) -> Any:
    if isinstance(node, Op) and node.op in ("and", "or") and isinstance(node.args[0], Const):
        return node.args[1] if bool(node.args[0].value) == (node.op == "and") else node.args[0]
    if isinstance(node, Op) and node.op not in ("and", "or") and all(isinstance(x, Const) for x in node.args):
        return Const(_apply(node.op, [x.value for x in node.args]))
    if isinstance(node, Filter) and all(isinstance(x, Const) for x in (node.of, *node.args)):
        return Const(filters[node.name](node.of.value, *[x.value for x in node.args]))
    return node


def _joined(body: list) -> tuple:
    out: list = []
    for node in body:
        if isinstance(node, Print) and isinstance(node.of, Const):
            node = Text(_text(node.of.value))
        if isinstance(node, Text):
            if not node.text:
                continue
            if out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
                continue
        out.append(node)
    return tuple(out)


def parse(source: str, filters: dict[str, Callable] | None = None) -> tuple:
    """The syntax tree, constants folded."""
    filters = {**FILTERS, **(filters or {})}
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if pieces and pieces[-1][0] != "text" and pieces[-1][2]:
            text = text.lstrip()
        if m[0][2:3] == "-":
            text = text.rstrip()
        pieces.append(("text", text, False))
        kind = {"{{": "print", "{%": "tag", "{#": "comment"}[m[0][:2]]
        pieces.append((kind, (m[1] if kind == "print" else m[2] or "").strip(), m[0][-3] == "-"))
        at = m.end()
    tail = source[at:]
    pieces.append(("text", tail.lstrip() if pieces and pieces[-1][2] else tail, False))
    if "{%" in tail or "{{" in tail:
        raise TemplateError("a tag isn't closed")
    pos = 0

    def block(until: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal pos
        body: list = []
        while pos < len(pieces):
            kind, content, _ = pieces[pos]
            pos += 1
            if kind == "text":
                body.append(Text(content))
            elif kind == "print":
                e = _Expr(content, filters)
                body.append(Print(e.expr()))
                e.end()
            elif kind == "tag":
                word, _, rest = content.partition(" ")
                if word in until:
                    return _joined(body), content
                e = _Expr(rest, filters)
                if word == "for":
                    name = e.name()
                    e.need("in")
                    over = e.expr()
                    e.end()
                    body.append(For(name, over, block(("endfor",))[0]))
                elif word == "if":
                    branches, condition = [], e.expr()
                    e.end()
                    while True:
                        inner, stop = block(("elif", "else", "endif"))
                        branches.append((condition, inner))
                        if stop.startswith("elif"):
                            e = _Expr(stop[4:], filters)
                            condition = e.expr()
                            e.end()
                        elif stop.startswith("else"):
                            condition = Const(True)
                        else:
                            break
                    live = []
                    for condition, inner in branches:
                        if isinstance(condition, Const) and not condition.value:
                            continue
                        live.append((condition, inner))
                        if isinstance(condition, Const):
                            break
                    if live and isinstance(live[0][0], Const):
                        body.extend(live[0][1])
                    elif live:
                        body.append(If(tuple(live)))
                elif word == "set":
                    name = e.name()
                    e.need("=")
                    body.append(Set(name, e.expr()))
                    e.end()
                elif word == "generation":
                    body.append(Generation(block(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"no tag {word!r}")
        if until:
            raise TemplateError(f"{until[-1]!r} is missing")
        return _joined(body), ""

    return block(())[0]


def _value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        v = node.value
        return lambda scope: v
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope: dict) -> Any:
            x, k = of(scope), key(scope)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int) and not isinstance(k, bool):
                return x[k] if -len(x) <= k < len(x) else None
            return None

        return item
    if isinstance(node, Filter):
        of, f, args = _value(node.of, filters), filters[node.name], [_value(a, filters) for a in node.args]
        return (lambda scope: f(of(scope), *[a(scope) for a in args])) if args else lambda scope: f(of(scope))
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    op = node.op
    return lambda scope: _apply(op, [a(scope) for a in args])


Piece = tuple[str, bool]


def _body(nodes: tuple, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, filters, marked) for n in nodes]

    def run(scope: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(scope)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Text):
        piece = ((node.text, marked),)
        return lambda scope: piece
    if isinstance(node, Print):
        of = _value(node.of, filters)
        return lambda scope: ((_text(of(scope)), marked),)
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, Set):
        name, of = node.name, _value(node.of, filters)

        def put(scope: dict) -> tuple:
            scope[name] = of(scope)
            return ()

        return put
    if isinstance(node, If):
        branches = [(_value(c, filters), _body(b, filters, marked)) for c, b in node.branches]

        def choose(scope: dict) -> Iterator[Piece]:
            for condition, body in branches:
                if condition(scope):
                    yield from body(scope)
                    return

        return choose
    name, over, body = node.name, _value(node.over, filters), _body(node.body, filters, marked)

    def loop(scope: dict) -> Iterator[Piece]:
        things = iter(over(scope) or ())
        outer, k, end = {n: scope.get(n) for n in (name, "loop")}, 0, object()
        thing = next(things, end)
        while thing is not end:
            after = next(things, end)
            scope[name] = thing
            scope["loop"] = {"first": k == 0, "last": after is end, "index": k + 1, "index0": k}
            yield from body(scope)
            thing, k = after, k + 1
        scope.update(outer)

    return loop


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, whether to be learned)."""
    all_filters = {**FILTERS, **(filters or {})}
    run = _body(parse(source, filters), all_filters, False)
    return lambda **variables: iter(run(dict(variables)))
