"""A small sandboxed template language, compiled to Python closures.

``compile_template`` parses a template into a syntax tree, folds what is constant (settings of the caller included)
and turns the tree into generator functions that yield pieces of text and the marks ``BEGIN`` and ``END`` of generated
parts.  A template sees the messages of one conversation, one after the other, and nothing else of Python: values are
text, integers, booleans, none and messages; the only members are a message's and the loop's fields.

Statements: ``{% for m in messages %}``, ``{% if %}``, ``{% elif %}``, ``{% else %}``, ``{% set x = ... %}``,
``{% generation %}``, each block with its ``end...``; ``{{ ... }}`` writes a value, ``{# ... #}`` is left out and a
``-`` inside a mark takes the white space beside it away.  Messages are read once and in order, so a loop over them cannot be inside
another: rendering takes time linear in the conversation and keeps one message (and the next one, for ``loop.last``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

BEGIN, END = object(), object()
#: Longest template and deepest nesting that are compiled.
MAX_CHARS, MAX_DEPTH = 65_536, 40


class TemplateError(ValueError):
    """A template that is not of the language, or a value that an operation does not take."""


# --- the syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: str


@dataclass(frozen=True)
class Call:
    """An operator or filter applied to its arguments."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """``a if c else b``; ``and`` and ``or`` as well, which do not look at their second part without need."""

    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- operations; all are pure, so any of them can be folded


def _same(kind: type | tuple, *values: Any) -> None:
    for v in values:
        if not isinstance(v, kind) or (isinstance(v, bool) and kind is int):
            raise TemplateError(f"{v!r} has the wrong type")


def _text(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    _same((str, int), v)
    return str(v)


def _plus(a: Any, b: Any) -> Any:
    _same(str if isinstance(a, str) else int, a, b)
    return a + b


def _ordered(f: Callable) -> Callable:
    def run(a: Any, b: Any) -> bool:
        _same(str if isinstance(a, str) else int, a, b)
        return f(a, b)

    return run


def _within(a: Any, b: Any) -> bool:
    _same(str, a, b)
    return a in b


def _number(f: Callable) -> Callable:
    def run(*args: Any) -> int:
        _same(int, *args)
        return f(*args)

    return run


def _on_text(f: Callable[[str], Any]) -> Callable:
    return lambda v: f(_text(v))


_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Characters of a header that would end it, and what stands for them.
_HEADER = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_UNHEADER = {v: k for k, v in _HEADER.items()}


def escape(text: str) -> str:
    """No ``<|`` is left: each ``<``, n backslashes and ``|`` get one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def header(text: str) -> str:
    """One line without ``<``."""
    return "".join(_HEADER.get(c, c) for c in text)


def unheader(text: str) -> str:
    return re.sub(r"\\[\\nl]", lambda m: _UNHEADER[m[0]], text)


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _within, "not in": lambda a, b: not _within(a, b),
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
    "+": _plus, "~": lambda a, b: _text(a) + _text(b), "-": _number(lambda a, b: a - b), "%": _number(lambda a, b: a % b if b else _zero()),
    "negative": _number(lambda a: -a), "not": lambda a: not a,
}
FILTERS: dict[str, Callable] = {
    "trim": _on_text(str.strip), "upper": _on_text(str.upper), "lower": _on_text(str.lower), "length": _on_text(len), "escape": _on_text(escape), "header": _on_text(header),
}


def _zero() -> int:
    raise TemplateError("remainder by zero")


# --- parsing

_MARKS = re.compile("|".join(rf"(?P<k{n}>{a})(?P<l{n}>-?)(?P<c{n}>.*?)(?P<r{n}>-?){b}" for n, (a, b) in enumerate(((r"\{\{", r"\}\}"), (r"\{%", r"%\}"), (r"\{#", r"#\}")))), re.S)
_TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>%|().=\[\]]))", re.S)
_SAYS = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_COMPARISONS = ("==", "!=", "<=", ">=", "<", ">")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if m is None:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Reads one expression from tokens, by rising precedence."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _tokens(source), 0, 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else value

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        found = self.choice()
        self.end()
        return found

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("an expression is nested too deep")
        then = self.either()
        if self.take("if"):
            test = self.either()
            then = Choice(test, then, self.choice() if self.take("else") else Const(None))
        self.depth -= 1
        return then

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Choice(left, left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Choice(left, self.negated(), left)
        return left

    def negated(self) -> Any:
        turns = 0
        while self.take("not"):
            turns += 1
        found = self.compared()
        for _ in range(turns):
            found = Call("not", (found,))
        return found

    def compared(self) -> Any:
        left = self.joined()
        while True:
            if op := self.take(*_COMPARISONS, "in"):
                left = Call(op, (left, self.joined()))
            elif self.peek() == "not" and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = Call("not in", (left, self.joined()))
            else:
                return left

    def joined(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "-", "~", "%"):
            left = Call(op, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        if self.take("-"):
            return Call("negative", (self.filtered(),))
        found = self.member()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            found = Call(name, (found,))
        return found

    def member(self) -> Any:
        found = self.primary()
        while op := self.take(".", "["):
            if op == ".":
                found = Member(found, self.name())
            else:
                key = self.primary()
                if not isinstance(key, Const) or not isinstance(key.value, str):
                    raise TemplateError("a member is named by a text")
                self.need("]")
                found = Member(found, key.value)
        return found

    def primary(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _SAYS.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if value == "(":
            found = self.choice()
            self.need(")")
            return found
        raise TemplateError(f"unexpected {value!r}")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """``(kind, content)``: text, value (``{``) and statement (``%``) parts in order."""
    at, strip = 0, False
    for m in _MARKS.finditer(source):
        n = next(n for n in "012" if m["k" + n])
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m["l" + n] else text
        if n != "2":
            yield m["k" + n][1], m["c" + n]
        at, strip = m.end(), bool(m["r" + n])
    rest = source[at:].lstrip() if strip else source[at:]
    if re.search(r"\{[{%#]", rest):
        raise TemplateError("a mark is not closed")
    yield "text", rest


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    if len(source) > MAX_CHARS:
        raise TemplateError("the template is too long")
    root: list = []
    open_: list[tuple[str, Any, list]] = [("", None, root)]  # block, its head, the statements read into

    def close(kind: str) -> tuple[Any, tuple]:
        if open_[-1][0] != kind:
            raise TemplateError(f"no {kind} is open here")
        _, head, body = open_.pop()
        return head, tuple(body)

    for kind, content in _pieces(source):
        into = open_[-1][2]
        if kind == "text":
            if content:
                into.append(Text(content))
            continue
        e = _Expression(content)
        if kind == "{":
            into.append(Emit(e.whole()))
            continue
        word = e.name()
        if word == "for":
            name = e.name()
            e.need("in")
            if e.name() != "messages" or any(k == "for" for k, _, _ in open_):
                raise TemplateError("only messages can be looped over, and once at a time")
            open_.append(("for", name, []))
        elif word == "if":
            open_.append(("if", [(e.choice(), None)], []))
        elif word in ("elif", "else"):
            arms, body = close("if")
            if arms[-1][0] is None:
                raise TemplateError("nothing follows else")
            arms[-1] = (arms[-1][0], body)
            open_.append(("if", [*arms, (e.choice() if word == "elif" else None, None)], []))
        elif word == "set":
            name = e.name()
            e.need("=")
            into.append(Assign(name, e.choice()))
        elif word == "generation":
            if any(k == "generation" for k, _, _ in open_):
                raise TemplateError("generated parts cannot be nested")
            open_.append(("generation", None, []))
        elif word == "endfor":
            name, body = close("for")
            open_[-1][2].append(Loop(name, body))
        elif word == "endif":
            arms, body = close("if")
            arms[-1] = (arms[-1][0], body)
            other: tuple = ()
            for test, then in reversed(arms):
                other = then if test is None else (Branch(test, then, other),)
            open_[-1][2].extend(other)
        elif word == "endgeneration":
            _, body = close("generation")
            open_[-1][2].append(Generation(body))
        else:
            raise TemplateError(f"unknown statement {word!r}")
        e.end()
        if len(open_) > MAX_DEPTH:
            raise TemplateError("statements are nested too deep")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not closed")
    return tuple(root)


# --- folding


def fold_expression(e: Any, known: dict[str, Any]) -> Any:
    """The expression with all that depends on constants and ``known`` names alone worked out."""
    if isinstance(e, Name):
        return Const(known[e.name]) if e.name in known else e
    if isinstance(e, Member):
        return replace(e, of=fold_expression(e.of, known))
    if isinstance(e, Call):
        args = tuple(fold_expression(a, known) for a in e.args)
        if all(isinstance(a, Const) for a in args):
            return Const((OPERATIONS.get(e.name) or FILTERS[e.name])(*[a.value for a in args]))
        return Call(e.name, args)
    if isinstance(e, Choice):
        test = fold_expression(e.test, known)
        if isinstance(test, Const):
            return fold_expression(e.then if test.value else e.other, known)
        # the parts of ``and`` and ``or`` stay the test itself, which is worked out once
        then, other = (test if part is e.test else fold_expression(part, known) for part in (e.then, e.other))
        return Choice(test, then, other)
    return e


def _assigned(body: tuple) -> set[str]:
    """Names that statements set, loop variables included."""
    out: set[str] = set()
    for s in body:
        if isinstance(s, Assign):
            out.add(s.name)
        elif isinstance(s, Loop):
            out |= {s.name, "loop"} | _assigned(s.body)
        elif isinstance(s, Branch):
            out |= _assigned(s.then) | _assigned(s.other)
        elif isinstance(s, Generation):
            out |= _assigned(s.body)
    return out


def fold(body: tuple, known: dict[str, Any]) -> tuple:
    """The statements with constants folded, dead branches left out and neighbouring texts joined."""
    out: list = []

    def add(s: Any) -> None:
        if isinstance(s, Text):
            if not s.value:
                return
            if out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + s.value)
                return
        out.append(s)

    for s in body:
        if isinstance(s, Emit):
            value = fold_expression(s.value, known)
            add(Text(_text(value.value)) if isinstance(value, Const) else Emit(value))
        elif isinstance(s, Branch):
            test = fold_expression(s.test, known)
            if isinstance(test, Const):
                for x in fold(s.then if test.value else s.other, known):
                    add(x)
            else:
                then, other = fold(s.then, known), fold(s.other, known)
                if then or other:
                    add(Branch(test, then, other))
        elif isinstance(s, Loop):
            if inner := fold(s.body, known):
                add(Loop(s.name, inner))
        elif isinstance(s, Generation):
            if inner := fold(s.body, known):
                add(Generation(inner))
        elif isinstance(s, Assign):
            add(replace(s, value=fold_expression(s.value, known)))
        else:
            add(s)
    return tuple(out)


# --- closures

_FIELDS = ("first", "last", "index", "index0")


class _Message(dict):
    """A message's fields, by name."""


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        def look(env: dict, name: str = e.name) -> Any:
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return look
    if isinstance(e, Member):
        of = _value(e.of)

        def member(env: dict, key: str = e.key) -> Any:
            found = of(env)
            if not isinstance(found, _Message) or key not in found:
                raise TemplateError(f"no field {key!r}")
            return found[key]

        return member
    if isinstance(e, Choice):
        test = _value(e.test)
        then = None if e.then is e.test else _value(e.then)
        other = None if e.other is e.test else _value(e.other)

        def choose(env: dict) -> Any:
            found = test(env)
            chosen = then if found else other
            return found if chosen is None else chosen(env)

        return choose
    f = OPERATIONS.get(e.name) or FILTERS[e.name]
    if len(e.args) == 1:
        a = _value(e.args[0])
        return lambda env: f(a(env))
    a, b = map(_value, e.args)
    return lambda env: f(a(env), b(env))


def _with_last(messages: Iterable) -> Iterator[tuple[Any, bool]]:
    rest = iter(messages)
    try:
        held = next(rest)
    except StopIteration:
        return
    for m in rest:
        yield held, False
        held = m
    yield held, True


def _statement(s: Any) -> Callable[[dict], Iterator]:
    if isinstance(s, Text):
        return lambda env, piece=(s.value,): piece
    if isinstance(s, Emit):
        value = _value(s.value)
        return lambda env: (_text(value(env)),)
    if isinstance(s, Assign):
        value = _value(s.value)

        def assign(env: dict) -> tuple:
            env[s.name] = value(env)
            return ()

        return assign
    if isinstance(s, Branch):
        test, then, other = _value(s.test), _sequence(s.then), _sequence(s.other)
        return lambda env: then(env) if test(env) else other(env)
    body = _sequence(s.body)
    if isinstance(s, Generation):
        def generation(env: dict) -> Iterator:
            yield BEGIN
            yield from body(env)
            yield END

        return generation

    def loop(env: dict) -> Iterator:
        messages = env.get("messages", ())
        env["messages"] = ()  # they are read once
        for i, (m, last) in enumerate(_with_last(messages)):
            env[s.name] = _Message(m)
            env["loop"] = _Message(zip(_FIELDS, (i == 0, last, i + 1, i), strict=True))
            yield from body(env)

    return loop


def _sequence(body: tuple) -> Callable[[dict], Iterator]:
    parts = [_statement(s) for s in body]
    if len(parts) == 1:
        return parts[0]

    def run(env: dict) -> Iterator:
        for part in parts:
            yield from part(env)

    return run


def compile_template(source: str, **settings: Any) -> Callable[[Iterable[dict]], Iterator]:
    """A function from messages (dictionaries of text fields) to pieces of text and the marks ``BEGIN`` and ``END``.

    ``settings`` are constants that the template can name; they are folded away unless the template sets them anew.
    """
    tree = parse(source)
    taken = _assigned(tree) | {"messages"}
    if "messages" in _assigned(tree):
        raise TemplateError("messages cannot be set")
    run = _sequence(fold(tree, {k: v for k, v in settings.items() if k not in taken}))
    rest = {k: v for k, v in settings.items() if k in taken}
    return lambda messages: run({**rest, "messages": messages})
