"""A small template language for chats, compiled to Python closures.

Syntax: text, ``{{ expression }}``, ``{# comment #}`` and the tags ``for x in
expression``, ``if`` / ``elif`` / ``else``, ``set name = expression``,
``generation`` (what a model learns to say) and ``controls 'a' 'b'`` (strings
that only the template may write), each closed by ``end...`` where it has a
body.  Expressions know strings, whole numbers, ``true``, ``false``, ``none``,
names, ``a.b`` and ``a['b']`` (fields of mappings only), ``+ == != in not and
or``, parentheses and filters (``| trim``).

It is a sandbox: there are no calls, no Python attributes and no names but
those given; loops run over what is given, so every template ends.

``parse`` makes a syntax tree, ``fold`` works out what is constant, and
``Template`` turns the tree into closures that yield (text, learned) pieces,
reading messages one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or filter on its arguments."""
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass
class Tree:
    body: tuple
    controls: list[str] = field(default_factory=list)


#: Written into control strings where a text contains them; doubled where a text has it itself.
ESCAPE = "␛"

PURE: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b, "not": lambda a: not a,
    "trim": lambda a: a.strip(), "upper": lambda a: a.upper(), "lower": lambda a: a.lower(), "string": str,
}

# ---------------------------------------------------------------- parsing

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    def __init__(self, text: str) -> None:
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        k, t = self.tokens[self.at]
        if (kind and k != kind) or (text and t != text):
            raise TemplateError(f"unexpected {t!r}")
        self.at += 1
        return t

    def skip(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        return False

    def end(self):
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def any(self):
        left = self.all()
        while self.skip("or"):
            left = Apply("or", (left, self.all()))
        return left

    def all(self):
        left = self.negated()
        while self.skip("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.skip("not") else self.compared()

    def compared(self):
        left = self.sum()
        for op in ("==", "!=", "in"):
            if self.skip(op):
                return Apply(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.skip("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.primary()
        while self.skip("|"):
            name = self.take("name")
            if name != "escape" and (name not in PURE or name in ("in", "not")):
                raise TemplateError(f"no filter {name!r}")
            value = Apply(name, (value,))
        return value

    def primary(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind is None:
            raise TemplateError("an expression ends too early")
        self.at += 1
        if kind == "str":
            value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        elif kind == "int":
            value = Const(int(text))
        elif kind == "name":
            words = {"true": True, "false": False, "none": None}
            value = Const(words[text]) if text in words else Name(text)
        elif text == "(":
            value = self.any()
            self.take("op", ")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while True:
            if self.skip("."):
                value = Field(value, Const(self.take("name")))
            elif self.skip("["):
                value = Field(value, self.any())
                self.take("op", "]")
            else:
                return value


def _expression(text: str):
    e = _Expression(text)
    value = e.any()
    e.end()
    return value


def parse(source: str) -> Tree:
    """Syntax tree of a template."""
    tree = Tree(())
    # One open block for each level: its tag, what it was opened with, its bodies so far.
    stack: list[tuple[str, object, list]] = [("", None, [[]])]

    def add(node) -> None:
        stack[-1][2][-1].append(node)

    at = 0
    for m in chain(_PARTS.finditer(source), [None]):
        if text := source[at:m.start() if m else len(source)]:
            add(Out(Const(text)))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            add(Out(_expression(m[1])))
        elif m[2] is not None:
            tag, _, rest = m[2].strip().partition(" ")
            if tag == "controls":
                e = _Expression(rest)
                while e.at < len(e.tokens):
                    tree.controls.append(e.primary().value)
            elif tag == "set":
                name, _, value = rest.partition("=")
                if not name.strip().isidentifier():
                    raise TemplateError(f"cannot set {name!r}")
                add(Set(name.strip(), _expression(value)))
            elif tag == "for":
                found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not found:
                    raise TemplateError(f"cannot read for {rest!r}")
                stack.append(("for", (found[1], _expression(found[2])), [[]]))
            elif tag in ("if", "generation"):
                stack.append((tag, _expression(rest) if tag == "if" else None, [[]]))
            elif tag in ("elif", "else"):
                if stack[-1][0] not in ("if", "elif"):
                    raise TemplateError(f"{tag} without if")
                stack[-1][2].append([])
                if tag == "elif":       # an if inside the else, closed by the same endif
                    stack.append(("elif", _expression(rest), [[]]))
            elif tag.startswith("end"):
                while True:
                    opened, head, bodies = stack.pop()
                    if opened == "" or (opened != "elif" and opened != tag[3:]) or (opened == "elif" and tag != "endif"):
                        raise TemplateError(f"{tag} closes {opened or 'nothing'}")
                    first, other = tuple(bodies[0]), tuple(chain.from_iterable(bodies[1:]))
                    add(For(*head, first) if opened == "for" else Generation(first) if opened == "generation" else If(head, first, other))
                    if opened != "elif":
                        break
            else:
                raise TemplateError(f"no tag {tag!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    tree.body = tuple(stack[0][2][0])
    return tree


# ---------------------------------------------------------------- folding

def fold(node):
    """The node with constant parts worked out."""
    if isinstance(node, tuple):
        out: list = []
        for n in chain.from_iterable(_folded(n) for n in node):
            if isinstance(n, Out) and isinstance(n.value, Const):
                text = _text(n.value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(out[-1].value.value + text))
                elif text:
                    out.append(Out(Const(text)))
            else:
                out.append(n)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in PURE and all(isinstance(a, Const) for a in args):
            return Const(PURE[node.op](*(a.value for a in args)))
        return Apply(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of), fold(node.key))
    return node


def _folded(node) -> tuple:
    """What a statement becomes: none, one or several statements."""
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return (If(test, fold(node.then), fold(node.other)),)
    if isinstance(node, For):
        return (replace(node, over=fold(node.over), body=fold(node.body)),)
    if isinstance(node, Generation):
        return (Generation(fold(node.body)),)
    return (replace(node, value=fold(node.value)),)


def _text(value) -> str:
    return "" if value is None else str(value)


# ---------------------------------------------------------------- compiling

class Template:
    """A compiled template.  ``pieces`` renders lazily."""

    def __init__(self, source: str) -> None:
        tree = parse(source)
        self.controls = tree.controls
        if any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise TemplateError("a control string needs two characters and no escape")
        # Each start of a control string, also of overlapping ones, and each escape.
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        self._mark = re.compile(f"{ESCAPE}|{starts}" if starts else ESCAPE)
        self.tree = fold(tree.body)
        self._run = self._block(self.tree)

    def escape(self, text: str) -> str:
        return self._mark.sub(lambda m: m[0] + ESCAPE, text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)

    def pieces(self, messages: Iterable[dict], **names) -> Iterator[tuple[str, bool]]:
        """(text, whether it lies in a generation block) in order."""
        return self._run({**names, "messages": messages}, False)

    def render(self, messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans of its generation blocks."""
        out, spans, at = [], [], 0
        for text, learned in self.pieces(messages, **names):
            if learned and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans

    def _value(self, node) -> Callable[[dict], object]:
        if isinstance(node, Const):
            return lambda env, v=node.value: v
        if isinstance(node, Name):
            def name(env, n=node.name):
                if n not in env:
                    raise TemplateError(f"no name {n!r}")
                return env[n]
            return name
        if isinstance(node, Field):
            of, key = self._value(node.of), self._value(node.key)

            def look(env):
                holder = of(env)
                if not isinstance(holder, dict):
                    raise TemplateError("only mappings have fields")
                return holder.get(key(env))
            return look
        args = [self._value(a) for a in node.args]
        if node.op == "and":
            return lambda env: args[0](env) and args[1](env)
        if node.op == "or":
            return lambda env: args[0](env) or args[1](env)
        if node.op == "escape":
            return lambda env: self.escape(_text(args[0](env)))
        f = PURE[node.op]
        if len(args) == 1:
            return lambda env: f(args[0](env))
        return lambda env: f(args[0](env), args[1](env))

    def _block(self, body: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
        steps = [self._step(n) for n in body]

        def block(env, learned):
            for step in steps:
                yield from step(env, learned)
        return block

    def _step(self, node) -> Callable[[dict, bool], Iterable[tuple[str, bool]]]:
        if isinstance(node, Out):
            value = self._value(node.value)
            return lambda env, learned: ((_text(value(env)), learned),)
        if isinstance(node, Set):
            value = self._value(node.value)

            def assign(env, learned):
                env[node.name] = value(env)
                return ()
            return assign
        if isinstance(node, If):
            test, then, other = self._value(node.test), self._block(node.then), self._block(node.other)
            return lambda env, learned: then(env, learned) if test(env) else other(env, learned)
        if isinstance(node, Generation):
            body = self._block(node.body)
            return lambda env, learned: body(env, True)
        over, body = self._value(node.over), self._block(node.body)

        def loop(env, learned):
            rest = iter(over(env))
            item, i = next(rest, None), 0
            while item is not None:         # one item ahead, to know the last
                after = next(rest, None)
                inner = dict(env)
                inner[node.name] = item
                inner["loop"] = {"index0": i, "first": i == 0, "last": after is None}
                yield from body(inner, learned)
                item, i = after, i + 1
        return loop
