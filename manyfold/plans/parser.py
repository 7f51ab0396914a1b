"""Text of the query dialect to its syntax tree: a lexer by one regular expression, a recursive-descent parser."""

from __future__ import annotations

import json
import re
from typing import Any

from .ast import Agg, Call, Case, Col, Command, Frame, Hop, Join, Knn, Lit, Named, Order, ParseError, Path, QueryError, Select, SetOp, Sub, Var, Window, With

MAX_DEPTH = 64
_LEX = re.compile(
    r"""\s+
    |(?P<number>-?\d+(?:\.\d*)?)
    |'(?P<text>(?:[^']|'')*)'
    |\$(?P<var>[A-Za-z_]\w*|\d+)
    |(?P<word>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<sign><\||\|>|->|<-|@>|<=|>=|!=|[=<>(),.*;\[\]?+/:-])""",
    re.X | re.A,
)
AGGREGATES = ("count", "sum", "avg", "min", "max")
WINDOWS = ("row_number", "rank", "dense_rank", "ntile", "lag", "lead", "first_value", "last_value", "nth_value")
_RESERVED = set(
    "select from where and or not group by having order limit offset join on inner left right full cross union intersect except all as"
    " distinct case when then else end if coalesce nullif in between like ilike is null exists knn traverse match with".split()
)


def _json_end(s: str, at: int) -> int:
    depth, quoted = 0, False
    while at < len(s):
        c = s[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return at + 1
        at += 1
    raise ParseError("a JSON object isn't closed")


def tokenize(s: str) -> list[tuple[str, Any, int]]:
    """(kind, value, place): number, text, var, word, sign, json, id (after a colon)."""
    out: list[tuple[str, Any, int]] = []
    at = 0
    while at < len(s):
        if s[at] == "{":
            end = _json_end(s, at)
            out.append(("json", s[at:end], at))
            at = end
            continue
        if s[at] == ":" and out and out[-1][0] == "word":
            m = re.compile(r":([A-Za-z0-9_-]*[A-Za-z0-9_])").match(s, at)
            if m:
                # an arrow may follow at once
                out.append(("id", m[1], at))
                at = m.end()
                continue
        m = _LEX.match(s, at)
        if not m:
            raise ParseError(f"can't read {s[at : at + 10]!r} at {at}")
        kind = m.lastgroup
        if kind == "number" and out and m[0][0] == "-" and (out[-1][0] in ("number", "word", "var") or out[-1][1] == ")"):
            out.append(("sign", "-", at))
            at += 1
            continue
        if kind == "number":
            v: Any = float(m[0]) if "." in m[0] else int(m[0])
            if isinstance(v, int) and not -(2**63) <= v < 2**63:
                raise ParseError(f"{m[0]} is no 64-bit integer")
            out.append(("number", v, at))
        elif kind:
            out.append((kind, m[kind].replace("''", "'") if kind == "text" else m[kind], at))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str) -> None:
        if not isinstance(text, str):
            raise ParseError("a query is a string")
        self.tokens, self.at, self.depth, self.params = tokenize(text), 0, 0, 0

    # -- tokens

    def peek(self, k: int = 0) -> tuple[str, Any]:
        return self.tokens[self.at + k][:2] if self.at + k < len(self.tokens) else ("end", None)

    def error(self, wanted: str) -> ParseError:
        kind, value = self.peek()
        return ParseError(f"{wanted} expected" + (f", not {value!r}" if kind != "end" else " at the end"))

    def word(self, *words: str) -> str | None:
        kind, value = self.peek()
        if kind == "word" and value.lower() in words:
            self.at += 1
            return value.lower()
        return None

    def is_word(self, *words: str, k: int = 0) -> bool:
        kind, value = self.peek(k)
        return kind == "word" and value.lower() in words

    def need(self, word: str) -> None:
        if not self.word(word):
            raise self.error(word.upper())

    def sign(self, *signs: str) -> str | None:
        kind, value = self.peek()
        if kind == "sign" and value in signs:
            self.at += 1
            return value
        return None

    def expect(self, sign: str) -> None:
        if not self.sign(sign):
            raise self.error(repr(sign))

    def take(self, kind: str, what: str) -> Any:
        if self.peek()[0] != kind:
            raise self.error(what)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def ident(self) -> str:
        if self.peek()[0] == "word" and self.peek()[1].lower() in _RESERVED:
            raise self.error("a name")
        return self.take("word", "a name")

    def natural(self) -> int:
        v = self.take("number", "a whole number")
        if not isinstance(v, int) or v < 0:
            raise ParseError("a whole number from 0 expected")
        return v

    def column(self) -> str:
        name = self.ident()
        return f"{name}.{self.ident()}" if self.sign(".") else name

    def list_of(self, item) -> tuple:
        out = [item()]
        while self.sign(","):
            out.append(item())
        return tuple(out)

    # -- statements

    def script(self) -> list:
        out = []
        while self.peek()[0] != "end":
            out.append(self.statement())
            if not self.sign(";") and self.peek()[0] != "end":
                raise self.error("';'")
        if not out:
            raise ParseError("a statement expected")
        return out

    def one(self) -> Any:
        out = self.script()
        if len(out) != 1:
            raise ParseError("one statement expected")
        return out[0]

    def statement(self) -> Any:
        if self.word("explain"):
            return Command("explain", {"query": self.query()})
        if self.word("analyze"):
            return Command("analyze", {"table": self.ident()})
        if self.word("drop"):
            if self.word("table"):
                return Command("drop_table", {"table": self.ident()})
            self.need("index")
            return Command("drop_index", {"column": self.column()})
        if self.word("insert"):
            return self.insert()
        if self.word("update"):
            return self.update()
        if self.word("delete"):
            self.need("from")
            return Command("delete", {"table": self.ident(), "where": self.where(), "returning": self.returning()})
        if self.word("relate"):
            return self.relate()
        if self.word("let"):
            name = self.take("var", "$name")
            self.expect("=")
            return Command("let", {"name": name, "expr": self.operand()})
        if self.word("return"):
            return Command("return", {"expr": self.condition()})
        if self.word("with"):
            recursive = bool(self.word("recursive"))

            def cte() -> tuple:
                name = self.ident()
                if self.sign("("):
                    raise ParseError("a list of columns after a CTE's name isn't supported")
                self.need("as")
                self.expect("(")
                query = self.query()
                self.expect(")")
                return name, query

            return With(self.list_of(cte), recursive, self.query())
        return self.query()

    def query(self) -> Any:
        if self.is_word("with"):
            return self.statement()
        left = self.select()
        while op := self.word("union", "intersect", "except"):
            left = SetOp(op, bool(self.word("all")), left, self.select())
        return left

    def literal(self) -> Any:
        kind, value = self.peek()
        if kind in ("number", "text"):
            self.at += 1
            return Lit(value)
        if w := self.word("null", "true", "false"):
            return Lit({"null": None, "true": True, "false": False}[w])
        if kind == "var":
            self.at += 1
            return Var(value)
        if self.sign("?"):
            self.params += 1
            return Var(str(self.params))
        raise self.error("a literal")

    def returning(self) -> tuple | None:
        if not self.word("returning"):
            return None
        return ("*",) if self.sign("*") else self.list_of(self.ident)

    def insert(self) -> Command:
        self.need("into")
        table = self.ident()
        columns: tuple = ()
        if self.sign("("):
            columns = self.list_of(self.ident)
            self.expect(")")
        self.need("values")

        def row() -> tuple:
            self.expect("(")
            values = self.list_of(self.literal)
            self.expect(")")
            if columns and len(values) != len(columns):
                raise ParseError(f"{len(values)} values for {len(columns)} columns")
            return values

        rows, conflict = self.list_of(row), None
        if self.word("on"):
            self.need("conflict")
            self.expect("(")
            keys = self.list_of(self.ident)
            self.expect(")")
            self.need("do")
            if self.word("nothing"):
                conflict = (keys, ())
            else:
                self.need("update")
                self.need("set")
                conflict = (keys, self.list_of(self.assignment))
        return Command("insert", {"table": table, "columns": columns, "rows": rows, "conflict": conflict, "returning": self.returning()})

    def assignment(self) -> tuple:
        name = self.ident()
        self.expect("=")
        if self.is_word("excluded") and self.peek(1) == ("sign", "."):
            self.at += 2
            return name, Col("excluded." + self.ident())
        return name, self.literal()

    def update(self) -> Command:
        table = self.ident()
        self.need("set")
        return Command("update", {"table": table, "set": self.list_of(self.assignment), "where": self.where(), "returning": self.returning()})

    def where(self) -> Any:
        return self.condition() if self.word("where") else None

    def relate(self) -> Command:
        def record() -> tuple:
            return self.ident(), self.take("id", "':id'")

        a = record()
        self.expect("->")
        label = self.ident()
        self.expect("->")
        b = record()
        payload = json.loads(self.take("json", "a JSON object")) if self.word("set") else None
        at = self.natural() if self.word("at") else None
        conflict: Any = "error"
        if self.word("on"):
            self.need("conflict")
            self.need("do")
            if self.word("nothing"):
                conflict = "nothing"
            else:
                self.need("update")
                self.need("set")
                self.need("payload")
                self.expect("=")
                conflict = {"payload": json.loads(self.take("json", "a JSON object"))}
        return Command("relate", {"from": a, "label": label, "to": b, "payload": payload, "ts": at, "conflict": conflict})

    # -- select

    def select(self) -> Select:
        self.deeper()
        self.need("select")
        distinct = bool(self.word("distinct"))
        items = () if self.sign("*") else self.list_of(self.item)
        self.need("from")
        source: Any
        if self.sign("("):
            inner = self.query()
            self.expect(")")
            self.need("as")
            source = (inner, self.ident())
        else:
            source = self.ident()
        join = self.join(source)
        where = self.where()
        knn = self.knn() if self.word("knn") else None
        traverse = None
        if self.word("traverse"):
            name = self.ident()
            self.need("depth")
            traverse = (name, self.natural())
        group: tuple = ()
        if self.word("group"):
            self.need("by")
            group = self.list_of(self.column)
        having: tuple = ()
        if self.word("having"):
            if not group:
                raise ParseError("HAVING needs GROUP BY")
            having = (self.having(),)
            while self.word("and"):
                having += (self.having(),)
        order: tuple = ()
        if self.word("order"):
            order = self.order()
        limit = self.natural() if self.word("limit") else None
        offset = self.natural() if self.word("offset") else 0
        self.depth -= 1
        return Select(items, source, distinct, join, where, knn, traverse, group, having, order, limit, offset)

    def order(self) -> tuple:
        self.need("by")

        def key() -> Order:
            name = self.column()
            return Order(name, self.word("asc", "desc") == "desc")

        return self.list_of(key)

    def having(self) -> tuple:
        agg = self.aggregate(alias=False)
        op = self.sign("=", "!=", "<", "<=", ">", ">=")
        if not op:
            raise self.error("a comparison")
        return agg, op, self.literal()

    def join(self, source: Any) -> Join | None:
        kind = self.word("left", "right", "full", "cross", "inner")
        if kind in ("left", "right", "full"):
            self.word("outer")
        if not self.word("join"):
            if kind:
                raise self.error("JOIN")
            return None
        table = self.ident()
        if table == source:
            raise ParseError("a table can't be joined with itself")
        if kind == "cross":
            return Join("cross", table)
        self.need("on")

        def side() -> tuple:
            t = self.ident()
            self.expect(".")
            return t, self.ident()

        a = side()
        self.expect("=")
        b = side()
        if self.is_word("and", "or"):
            raise ParseError("ON takes one equality")
        return Join(kind or "inner", table, a, b)

    def knn(self) -> Knn:
        column = self.ident()
        self.expect("<|")
        k = self.natural()
        self.expect("|>")
        self.expect("[")
        vector = tuple(float(v) for v in self.list_of(lambda: self.take("number", "a number")))
        self.expect("]")
        mode = "auto"
        if self.word("using"):
            mode = self.word("auto", "quantized", "filtered", "exact")
            if not mode:
                raise self.error("AUTO, QUANTIZED, FILTERED or EXACT")
        return Knn(column, k, vector, mode)

    def alias(self) -> str | None:
        return self.ident() if self.word("as") else None

    def item(self) -> Any:
        kind, value = self.peek()
        if kind == "sign" and value in ("->", "<-"):
            return self.path()
        if self.is_word(*AGGREGATES, *WINDOWS) and self.peek(1) == ("sign", "("):
            return self.window() if self.over_ahead() else self.aggregate()
        if self.is_word("if", "case", "coalesce", "nullif"):
            return Named(self.operand(), self.alias())
        return Named(Col(self.column()), self.alias())

    def over_ahead(self) -> bool:
        depth, k = 0, 1
        while self.peek(k)[0] != "end":
            v = self.peek(k)
            depth += (v == ("sign", "(")) - (v == ("sign", ")"))
            k += 1
            if not depth:
                return self.is_word("over", k=k)
        return False

    def aggregate(self, alias: bool = True) -> Agg:
        func = self.word(*AGGREGATES)
        if not func:
            raise self.error("an aggregate")
        self.expect("(")
        if self.sign("*"):
            if func != "count":
                raise ParseError(f"{func.upper()}(*) means nothing")
            arg = None
        else:
            arg = self.operand()
        self.expect(")")
        return Agg(func, arg, self.alias() if alias else None)

    def window(self) -> Window:
        func = self.word(*AGGREGATES, *WINDOWS)
        self.expect("(")
        arg, n = None, None
        if func == "ntile":
            n = self.natural()
            if not n:
                raise ParseError("NTILE takes a number from 1")
        elif func not in ("row_number", "rank", "dense_rank"):
            arg = self.ident()
            if func in ("lag", "lead"):
                n = self.natural() if self.sign(",") else 1
            elif func == "nth_value":
                self.expect(",")
                n = self.natural()
        self.expect(")")
        self.need("over")
        self.expect("(")
        partition: tuple = ()
        order: tuple = ()
        if self.word("partition"):
            self.need("by")
            partition = self.list_of(self.ident)
        if self.word("order"):
            order = self.order()
        frame = None
        if kind := self.word("rows", "range"):
            between = self.word("between")
            start = self.bound()
            end: Any = 0
            if between:
                self.need("and")
                end = self.bound()
            frame = Frame(kind, None if start == "-" else start, None if end == "+" else end)
            if start == "+" or end == "-":
                raise ParseError("a frame can't begin after or end before all rows")
        self.expect(")")
        return Window(func, arg, n, partition, order, frame, self.alias())

    def bound(self) -> Any:
        if self.word("unbounded"):
            w = self.word("preceding", "following")
            if not w:
                raise self.error("PRECEDING or FOLLOWING")
            return "-" if w == "preceding" else "+"
        if self.word("current"):
            self.need("row")
            return 0
        n = self.natural()
        w = self.word("preceding", "following")
        if not w:
            raise self.error("PRECEDING or FOLLOWING")
        return -n if w == "preceding" else n

    def path(self) -> Path:
        hops = []
        while arrow := self.sign("->", "<-"):
            label, fields = self.ident(), ()
            if self.peek()[0] == "json":
                fields = tuple(f.strip() for f in self.take("json", "")[1:-1].split(",") if f.strip())
                if len(set(fields)) < len(fields) or not set(fields) <= {"payload", "ts_unix"}:
                    raise ParseError("an edge has payload and ts_unix")
            self.expect(arrow)
            hops.append(Hop(arrow == "->", label, self.ident(), fields))
        if any(h.fields for h in hops[:-1]):
            raise ParseError("only a path's last edge gives fields")
        return Path(tuple(hops), self.alias())

    # -- expressions

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ParseError(f"more than {MAX_DEPTH} levels")

    def condition(self) -> Any:
        self.deeper()
        out = self.conjunction()
        while self.word("or"):
            out = Call("or", (out, self.conjunction()))
        self.depth -= 1
        return out

    def conjunction(self) -> Any:
        out = self.negation()
        while self.word("and"):
            out = Call("and", (out, self.negation()))
        return out

    def negation(self) -> Any:
        if self.word("not"):
            self.deeper()
            out = Call("not", (self.negation(),))
            self.depth -= 1
            return out
        return self.comparison()

    def comparison(self) -> Any:
        if self.word("exists"):
            self.expect("(")
            q = self.query()
            self.expect(")")
            return Sub("exists", q)
        if self.is_word("match") and self.peek(1) == ("sign", "("):
            self.at += 2
            column = self.ident()
            self.expect(",")
            text = self.take("text", "a text")
            self.expect(")")
            return Call("match", (Col(column), Lit(text)))
        if self.peek() == ("sign", "(") and not self.is_word("select", "with", k=1):
            mark = self.at
            self.at += 1
            out = self.condition()
            self.expect(")")
            if self.peek()[0] != "sign" or self.peek()[1] not in ("=", "!=", "<", "<=", ">", ">=", "@>", "+", "-", "*", "/"):
                if not self.is_word("is", "in", "between", "like", "ilike"):
                    return out
            self.at = mark
        left = self.operand()
        if op := self.sign("=", "!=", "<", "<=", ">", ">="):
            return Call(op, (left, self.operand()))
        if self.sign("@>"):
            text = self.take("json", "a JSON object") if self.peek()[0] == "json" else self.take("text", "JSON in quotes")
            try:
                return Call("has", (left, Lit(json.loads(text))))
            except ValueError as e:
                raise ParseError(f"no JSON: {e}") from e
        if self.word("is"):
            no = bool(self.word("not"))
            if self.word("null"):
                return Call("isnotnull" if no else "isnull", (left,))
            w = self.word("true", "false")
            if not w:
                raise self.error("NULL, TRUE or FALSE")
            return Call("!=" if no else "=", (left, Lit(w == "true")))
        no = bool(self.word("not"))
        out: Any = None
        if self.word("in"):
            self.expect("(")
            if self.is_word("select", "with"):
                out = Sub("in", self.query(), left)
            else:
                out = Call("in", (left, () if self.peek() == ("sign", ")") else self.list_of(self.operand)))
            self.expect(")")
        elif self.word("between"):
            low = self.operand()
            self.need("and")
            out = Call("between", (left, low, self.operand()))
        elif like := self.word("like", "ilike"):
            out = Call(like, (left, self.operand()))
        elif no:
            raise self.error("IN, BETWEEN or LIKE")
        if out is not None:
            return Call("not", (out,)) if no else out
        return left  # a boolean column

    def operand(self) -> Any:
        out = self.product()
        while op := self.sign("+", "-"):
            out = Call(op, (out, self.product()))
        return out

    def product(self) -> Any:
        out = self.primary()
        while op := self.sign("*", "/"):
            out = Call(op, (out, self.primary()))
        return out

    def primary(self) -> Any:
        self.deeper()
        try:
            return self._primary()
        finally:
            self.depth -= 1

    def _primary(self) -> Any:
        kind, value = self.peek()
        if kind in ("number", "text", "var") or self.is_word("null", "true", "false") or value == "?":
            return self.literal()
        if self.sign("("):
            if self.is_word("select", "with"):
                q = self.query()
                self.expect(")")
                return Sub("scalar", q)
            out = self.operand()
            self.expect(")")
            return out
        if self.word("coalesce"):
            self.expect("(")
            args = self.list_of(self.operand)
            self.expect(")")
            return Call("coalesce", args)
        if self.word("nullif"):
            self.expect("(")
            args = self.list_of(self.operand)
            self.expect(")")
            if len(args) != 2:
                raise ParseError("NULLIF takes two")
            return Call("nullif", args)
        if self.word("case"):
            of = None if self.is_word("when") else self.operand()
            branches = []
            while self.word("when"):
                c = self.condition() if of is None else Call("=", (of, self.operand()))
                self.need("then")
                branches.append((c, self.operand()))
            if not branches:
                raise self.error("WHEN")
            other = self.operand() if self.word("else") else None
            self.need("end")
            return Case(tuple(branches), other)
        if self.word("if"):
            c = self.condition()
            self.need("then")
            a = self.operand()
            b = self.operand() if self.word("else") else None
            self.need("end")
            return Case(((c, a),), b)
        name = self.column()
        if self.sign("->"):
            path = self.take("text", "a path in quotes").split(".")
            if not all(path):
                raise ParseError("an empty name in a document's path")
            return Call("get", (Col(name), Lit(tuple(path))))
        return Col(name)


def parse(text: str) -> Any:
    """One statement."""
    try:
        return Parser(text).one()
    except QueryError:
        raise
    except (ValueError, RecursionError) as e:
        raise ParseError(str(e)) from e


def parse_script(text: str) -> list:
    try:
        return Parser(text).script()
    except QueryError:
        raise
    except (ValueError, RecursionError) as e:
        raise ParseError(str(e)) from e
