"""A small sandboxed template language for chats: source to syntax tree, constants folded, tree to Python closures.

``{{ expression }}`` writes a value, ``{% statement %}`` is ``for name in list``, ``if``/``elif``/``else``, ``set name =
expression`` or ``generation``, each block closed by ``end...``; ``{# #}`` is a comment, a dash inside a mark (``{%- -%}``)
drops the white space on that side. Expressions have literals, lists, names, fields of mappings, indices, arithmetic, ``~``
to join texts, comparisons, ``in``, ``and``/``or``/``not``, ``a if c else b``, ``is defined`` and filters.

Sandbox: values are texts, numbers, booleans, null, lists and mappings; there are no calls, no attributes of objects, no
names with a leading underscore, no filters but those of ``FILTERS`` and ``escape``, and only finite lists are looped over.
A missing name or field is null and writes nothing.

``messages`` stands in one place only, the outer ``for``: what is before it begins a conversation, what is behind it ends
it, and its body writes one turn from the turn, ``loop.first``, ``loop.last``, ``loop.index`` and its neighbours ``loop.before``
and ``loop.after``. So a conversation is written turn by turn, however long it is. ``generation`` marks what it holds.

``escape`` puts a backslash behind the first character of each control string and before each backslash; ``unescape`` is
its inverse, and what is escaped holds no control string.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

Scope = dict[str, object]
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=])|(?P<end>$))""")
MARK = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
WORDS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: Filters besides escape.
FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x or "").strip(),
    "upper": lambda x: str(x or "").upper(),
    "lower": lambda x: str(x or "").lower(),
    "length": lambda x: len(x or ""),
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, a, b: str(x or "").replace(str(a), str(b)) if a else str(x or ""),
}


class TemplateError(ValueError):
    pass


class Controls:
    """The control strings of a format, and texts without them."""

    def __init__(self, strings: tuple[str, ...]):
        for s in strings:
            if len(s) < 2 or "\\" in s or any(s[0] in other[1:] for other in strings):
                raise TemplateError(f"{s!r} cannot be told from texts: two characters at least, no backslash, no first character inside another")
        self.strings, self.found = strings, re.compile("|".join(map(re.escape, ("\\", *sorted(strings, key=len, reverse=True)))))

    def escape(self, text: object) -> str:
        return self.found.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", written(text))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def written(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _field(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and type(key) is int:
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _numbers(f: Callable) -> Callable:
    def g(a, b):
        if type(a) is not int or type(b) is not int:
            raise TemplateError("arithmetic needs whole numbers")
        return f(a, b)

    return g


BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in (b or ()), "not in": lambda a, b: a not in (b or ()), "~": lambda a, b: written(a) + written(b),
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _numbers(operator.add)(a, b),
    "-": _numbers(operator.sub), "*": _numbers(operator.mul), "//": _numbers(operator.floordiv), "%": _numbers(operator.mod), "[]": _field,
}
LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%")]


class Expression:
    """Parses one expression to a tree of tuples: kind, then its parts."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while True:
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            if m.lastgroup == "end":
                break
            at = m.end()
        self.at = 0

    def peek(self, *marks: str) -> bool:
        kind, word = self.tokens[self.at]
        return kind in ("name", "mark") and word in marks

    def take(self, *marks: str) -> str | None:
        if self.peek(*marks):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise TemplateError(f"{mark!r} expected before {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, word = self.tokens[self.at]
        if kind != "name" or word.startswith("_"):
            raise TemplateError(f"{word!r} is no name")
        self.at += 1
        return word

    def whole(self) -> tuple:
        out = self.choice()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return out

    def choice(self) -> tuple:
        value = self.level(0)
        if self.take("if"):
            test = self.level(0)
            self.need("else")
            return ("choice", test, value, self.choice())
        return value

    def level(self, k: int) -> tuple:
        if k == len(LEVELS):
            return self.unary()
        if LEVELS[k] == ("not",):
            return ("not", self.level(k)) if self.take("not") else self.level(k + 1)
        left = self.level(k + 1)
        while True:
            if "not in" in LEVELS[k] and self.peek("not"):
                self.at += 1
                self.need("in")
                op = "not in"
            elif not (op := self.take(*LEVELS[k])):
                return left
            right = self.level(k + 1)
            left = (op, left, right) if op in ("and", "or") else ("binary", op, left, right)

    def unary(self) -> tuple:
        if self.take("-"):
            return ("binary", "-", ("value", 0), self.unary())
        value = self.primary()
        while op := self.take(".", "[", "|", "is"):
            if op == ".":
                value = ("binary", "[]", value, ("value", self.name()))
            elif op == "[":
                value = ("binary", "[]", value, self.choice())
                self.need("]")
            elif op == "|":
                value = ("filter", self.name(), value, *(self.listed(")") if self.take("(") else ()))
            else:
                no, test = self.take("not"), self.name()
                if test not in ("defined", "none"):
                    raise TemplateError(f"no test {test!r}")
                value = ("binary", "==" if (test == "none") != bool(no) else "!=", value, ("value", None))
        return value

    def listed(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.choice())
        return tuple(out)

    def primary(self) -> tuple:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("["):
            return ("list", *self.listed("]"))
        kind, word = self.tokens[self.at]
        if kind == "name":
            return ("value", WORDS[word]) if self.name() in WORDS else ("name", word)
        self.at += 1
        if kind == "number":
            return ("value", int(word))
        if kind == "text":
            return ("value", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        raise TemplateError(f"{word!r} begins no expression")


def parse(source: str) -> list[tuple]:
    """Statements: text, write, for, if, set, generation."""
    pieces, at, eat = [], 0, False
    for m in MARK.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if eat else text
        pieces.append(("text", text.rstrip() if m[1].endswith("-") else text))
        at, eat = m.end(), m[3].startswith("-")
        if m[1][:2] != {"}}": "{{", "%}": "{%", "#}": "{#"}[m[3][-2:]]:
            raise TemplateError(f"{m[0]!r} is not closed as it is opened")
        if m[1][1] != "#":
            pieces.append(("write" if m[1][1] == "{" else "do", m[2].strip()))
    pieces.append(("text", source[at:].lstrip() if eat else source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[list[tuple], str]:
        out = []
        while pieces:
            kind, body = pieces.pop()
            word, _, rest = body.partition(" ")
            if kind == "text":
                out.append((kind, body))
            elif kind == "write":
                out.append((kind, Expression(body).whole()))
            elif word in ends:
                return out, body
            elif word == "for":
                name, inside, items = rest.partition(" in ")
                if not inside or not name.strip().isidentifier() or name.strip().startswith("_"):
                    raise TemplateError(f"{body!r} is no loop")
                out.append(("for", name.strip(), Expression(items).whole(), block("endfor")[0]))
            elif word == "if":
                branches, test = [], rest
                while test is not None:
                    inner, end = block("elif", "else", "endif")
                    branches.append((Expression(test).whole(), inner))
                    test = end.partition(" ")[2] if end.startswith("elif") else None
                out.append(("if", branches, block("endif")[0] if end == "else" else []))
            elif word == "set":
                name, equals, value = rest.partition("=")
                if not equals or not name.strip().isidentifier() or name.strip().startswith("_"):
                    raise TemplateError(f"{body!r} sets no name")
                out.append(("set", name.strip(), Expression(value).whole()))
            elif word == "generation":
                out.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"no statement {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    return block()[0]


class Folder:
    """Trees with what constants decide worked out; names of ``known`` are constants unless they are set or looped over."""

    def __init__(self, known: Scope, filters: dict[str, Callable]):
        self.known, self.filters = known, filters

    def expression(self, e: tuple) -> tuple:
        kind = e[0]
        if kind == "name":
            return ("value", self.known[e[1]]) if e[1] in self.known else e
        if kind == "value":
            return e
        if kind == "filter" and e[1] not in self.filters:
            raise TemplateError(f"no filter {e[1]!r}")
        skip = 2 if kind in ("binary", "filter") else 1
        e = (*e[:skip], *map(self.expression, e[skip:]))
        parts = e[skip:]
        if kind == "choice" and parts[0][0] == "value":
            return parts[1] if parts[0][1] else parts[2]
        if kind in ("and", "or") and parts[0][0] == "value":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        return ("value", value(e, self.filters)({})) if all(p[0] == "value" for p in parts) else e

    def block(self, nodes: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for node in nodes:
            kind = node[0]
            if kind == "write":
                e = self.expression(node[1])
                node = ("text", written(e[1])) if e[0] == "value" else ("write", e)
            elif kind == "set":
                node = ("set", node[1], self.expression(node[2]))
            elif kind == "generation":
                node = ("generation", self.block(node[1]))
            elif kind == "for":
                items = self.expression(node[2])
                node = ("for", node[1], items, self.block(node[3])) if items[0] != "value" or items[1] else ("text", "")
            elif kind == "if":
                branches, other = [], node[2]
                for test, inner in node[1]:
                    test = self.expression(test)
                    if test[0] == "value" and test[1]:
                        other = inner
                        break
                    if test[0] != "value":
                        branches.append((test, self.block(inner)))
                if not branches:
                    nodes_ = self.block(other)
                    for n in nodes_:
                        self._add(out, n)
                    continue
                node = ("if", branches, self.block(other))
            self._add(out, node)
        return out

    @staticmethod
    def _add(out: list[tuple], node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)


def value(e: tuple, filters: dict[str, Callable]) -> Callable[[Scope], object]:
    """The closure that gives an expression's value in a scope."""
    kind = e[0]
    if kind == "value":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    parts = [value(p, filters) for p in e[2 if kind in ("binary", "filter") else 1 :]]
    if kind == "binary":
        f, (a, b) = BINARY[e[1]], parts
        return lambda scope: f(a(scope), b(scope))
    if kind == "filter":
        f, a, rest = filters[e[1]], parts[0], parts[1:]
        return lambda scope: f(a(scope), *(p(scope) for p in rest))
    if kind == "list":
        return lambda scope: [p(scope) for p in parts]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "choice":
        return lambda scope: parts[1](scope) if parts[0](scope) else parts[2](scope)
    a, b = parts
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


class Piece:
    """Text written so far, and the spans of it that generation blocks wrote."""

    def __init__(self):
        self.parts, self.size, self.marks = [], 0, []

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.size += len(text)


def _writer(nodes: list[tuple], filters: dict[str, Callable]) -> Callable[[Scope, Piece], None]:
    """The closure that writes some statements."""
    steps = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, out, text=node[1]: out.add(text))
        elif kind == "write":
            steps.append(lambda scope, out, f=value(node[1], filters): out.add(written(f(scope))))
        elif kind == "set":

            def put(scope, out, name=node[1], f=value(node[2], filters)):
                scope[name] = f(scope)

            steps.append(put)
        elif kind == "generation":

            def mark(scope, out, f=_writer(node[1], filters)):
                start = out.size
                f(scope, out)
                if out.size > start:
                    out.marks.append((start, out.size))

            steps.append(mark)
        elif kind == "for":

            def loop(scope, out, name=node[1], items=value(node[2], filters), f=_writer(node[3], filters)):
                found = items(scope) or []
                if not isinstance(found, list):
                    raise TemplateError("only lists can be looped over")
                for k, x in enumerate(found):
                    f(scope | {name: x, "loop": {"first": k == 0, "last": k == len(found) - 1, "index": k + 1}}, out)

            steps.append(loop)
        else:

            def choose(scope, out, branches=[(value(t, filters), _writer(b, filters)) for t, b in node[1]], other=_writer(node[2], filters)):
                for test, f in branches:
                    if test(scope):
                        return f(scope, out)
                other(scope, out)

            steps.append(choose)

    def run(scope: Scope, out: Piece) -> None:
        for f in steps:
            f(scope, out)

    return run


def names(tree: object, kind: str) -> set[str]:
    """Names that a tree reads ("name"), sets ("set") or loops with ("for")."""
    if isinstance(tree, tuple) and len(tree) > 1 and tree[0] == kind and isinstance(tree[1], str):
        return {tree[1]}.union(*(names(x, kind) for x in tree[2:]), set())
    return set().union(*(names(x, kind) for x in tree), set()) if isinstance(tree, (tuple, list)) else set()


class Template:
    """A compiled template: ``begin``, ``turn`` and ``end`` write the pieces of one conversation."""

    def __init__(self, source: str, controls: tuple[str, ...], known: Scope | None = None):
        self.controls = Controls(controls)
        filters = FILTERS | {"escape": self.controls.escape}
        tree = parse(source)
        changed = names(tree, "set") | names(tree, "for") | {"loop", "messages"}
        tree = Folder({k: v for k, v in (known or {}).items() if k not in changed}, filters).block(tree)
        at = [k for k, node in enumerate(tree) if node[0] == "for" and node[2] == ("name", "messages")]
        if len(at) != 1 or "messages" in names([*tree[: at[0]], *tree[at[0] + 1 :], *tree[at[0]][3]], "name"):
            raise TemplateError("messages must stand in one outer loop and nowhere else")
        self.tree, self.item = tree, tree[at[0]][1]
        self.known = {k: v for k, v in (known or {}).items() if k in changed}
        self.begin, self._turn, self.end = (_writer(x, filters) for x in (tree[: at[0]], tree[at[0]][3], tree[at[0] + 1 :]))

    def turn(self, scope: Scope, message: Scope, before: Scope | None, after: Scope | None, index: int, out: Piece) -> None:
        self._turn(scope | {self.item: message, "loop": {"first": before is None, "last": after is None, "index": index + 1, "before": before, "after": after}}, out)
