"""A small sandboxed template language, compiled to Python closures.

Grammar: text, ``{{ expr }}``, ``{% for x in xs %}..{% endfor %}``, ``{% if e %}..{% elif e %}..
{% else %}..{% endif %}``, ``{% generation %}..{% endgeneration %}`` and ``{# comment #}``. Expressions
are names, fields (``a.b`` reads a dictionary key, never an attribute), literals, ``==`` ``!=`` ``+``
``and`` ``or`` ``not``, parentheses and the filters of ``FILTERS``. There are no calls, no imports and
no loops but ``for`` over given lists, so a template cannot reach outside its arguments.

Source -> tokens -> syntax tree (tuples) -> folded tree -> closures. A closure is a generator of
``(text, trained)`` pieces, so a long list of messages streams through without being held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Scope = dict
Renderer = Callable[[Scope, bool], Iterator[tuple[str, bool]]]


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Reversible: after it no ``<`` is left, so no control string can occur in a text."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("\r", "&#13;")


def unescape(text: str) -> str:
    return text.replace("&#13;", "\r").replace("&lt;", "<").replace("&amp;", "&")


def escape_line(text: str) -> str:
    """Like ``escape`` for a one-line field."""
    return escape(text).replace("\n", "&#10;")


def unescape_line(text: str) -> str:
    return unescape(text.replace("&#10;", "\n"))


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "lower": str.lower,
    "upper": str.upper,
}

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_WORDS = re.compile(r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<string>'[^']*'|"[^"]*")|(?P<number>\d+)"""
                    r"""|(?P<op>==|!=|[|().+]))""")


def _lex(source: str) -> list[tuple[str, str]]:
    tokens, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _WORDS.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "string":
            value = value[1:-1].replace("\\n", "\n").replace("\\t", "\t")
        tokens.append((kind, value))
        at = m.end()
    return tokens


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _lex(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negation()
        while self.take("and"):
            tree = ("and", tree, self.negation())
        return tree

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        tree = self.total()
        for op in ("==", "!="):
            if self.take(op):
                return (op, tree, self.total())
        return tree

    def total(self):
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.primary()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def primary(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "string":
            return ("const", value)
        if kind == "number":
            return ("const", int(value))
        if kind == "op" and value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if kind == "name":
            if value in ("true", "false", "none"):
                return ("const", {"true": True, "false": False, "none": None}[value])
            tree = ("name", value)
            while self.take("."):
                field_kind, field = self.peek()
                if field_kind != "name":
                    raise TemplateError("a field name must follow the dot")
                self.at += 1
                tree = ("field", tree, field)
            return tree
        raise TemplateError("an expression is missing")


def parse(source: str) -> tuple:
    """Template source to a syntax tree ``("block", [nodes])``."""
    pieces = [p for p in _TAGS.split(source) if p]

    def block(at: int, ends: tuple[str, ...]):
        nodes = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                nodes.append(("show", _Expression(piece[2:-2]).parse()))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), word, rest, at
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError("for needs: name in expression")
                    body, _, _, at = block(at, ("endfor",))
                    nodes.append(("for", m[1], _Expression(m[2]).parse(), body))
                elif word == "generation":
                    body, _, _, at = block(at, ("endgeneration",))
                    nodes.append(("generation", body))
                elif word == "if":
                    arms = []
                    test = _Expression(rest).parse()
                    while True:
                        body, end, rest, at = block(at, ("elif", "else", "endif"))
                        arms.append((test, body))
                        if end == "endif":
                            break
                        test = _Expression(rest).parse() if end == "elif" else ("const", True)
                    nodes.append(("if", arms))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            else:
                nodes.append(("text", piece))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return ("block", nodes), "", "", at

    return block(0, ())[0]


def _fold_expression(tree: tuple) -> tuple:
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "field":
        return ("field", _fold_expression(tree[1]), tree[2])
    if kind == "filter":
        inner = _fold_expression(tree[2])
        folded = ("filter", tree[1], inner)
        return ("const", _value(folded)({})) if inner[0] == "const" else folded
    parts = [_fold_expression(t) for t in tree[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", _value((kind, *parts))({}))
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold(tree: tuple) -> tuple:
    """Constants evaluated, dead branches dropped, neighbouring texts joined."""
    kind = tree[0]
    if kind == "block":
        nodes: list[tuple] = []
        for node in map(fold, tree[1]):
            for part in node[1] if node[0] == "block" else [node]:
                if part[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + part[1])
                elif part != ("text", ""):
                    nodes.append(part)
        return ("block", nodes)
    if kind == "show":
        inner = _fold_expression(tree[1])
        return ("text", _shown(inner[1])) if inner[0] == "const" else ("show", inner)
    if kind == "for":
        return ("for", tree[1], _fold_expression(tree[2]), fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    if kind == "if":
        arms = []
        for test, body in tree[1]:
            test, body = _fold_expression(test), fold(body)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, body))
            if test[0] == "const":
                break
        if not arms:
            return ("block", [])
        return arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    return tree


def _shown(value) -> str:
    return "" if value is None else str(value)


def _value(tree: tuple) -> Callable[[Scope], object]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "field":
        inner, name = _value(tree[1]), tree[2]

        def field(scope):
            owner = inner(scope)
            return owner.get(name) if isinstance(owner, dict) else None

        return field
    if kind == "filter":
        inner, apply = _value(tree[2]), FILTERS[tree[1]]
        return lambda scope: apply(_shown(inner(scope)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    if kind == "==":
        return lambda scope: left(scope) == right(scope)
    if kind == "!=":
        return lambda scope: left(scope) != right(scope)
    return lambda scope: _shown(left(scope)) + _shown(right(scope))


def _looped(items) -> Iterator[tuple[object, dict]]:
    """Items with ``first``, ``last`` and ``index``, one item read ahead."""
    stream = iter(items or ())
    try:
        item = next(stream)
    except StopIteration:
        return
    index = 0
    for following in stream:
        yield item, {"first": index == 0, "last": False, "index": index + 1}
        item, index = following, index + 1
    yield item, {"first": index == 0, "last": True, "index": index + 1}


def _renderer(tree: tuple) -> Renderer:
    kind = tree[0]
    if kind == "text":
        return lambda scope, trained, text=tree[1]: iter(((text, trained),))
    if kind == "show":
        value = _value(tree[1])
        return lambda scope, trained: iter(((_shown(value(scope)), trained),))
    if kind == "generation":
        body = _renderer(tree[1])
        return lambda scope, trained: body(scope, True)
    if kind == "for":
        name, items, body = tree[1], _value(tree[2]), _renderer(tree[3])

        def loop(scope, trained):
            for item, place in _looped(items(scope)):
                yield from body({**scope, name: item, "loop": place}, trained)

        return loop
    if kind == "if":
        arms = [(_value(test), _renderer(body)) for test, body in tree[1]]

        def choose(scope, trained):
            for test, body in arms:
                if test(scope):
                    yield from body(scope, trained)
                    return

        return choose
    parts = [_renderer(node) for node in tree[1]]

    def sequence(scope, trained):
        for part in parts:
            yield from part(scope, trained)

    return sequence


def compile_template(source: str) -> Callable[[Scope], Iterator[tuple[str, bool]]]:
    """Render function: scope -> pieces of ``(text, trained)``."""
    render = _renderer(fold(parse(source)))
    return lambda scope: render(scope, False)
