"""A sandboxed template language, compiled to Python closures.

Source text becomes a syntax tree, constant parts of the tree are folded, and
the rest is turned into closures. Nothing of Python is reachable from a
template: names are the fields of the message and the loop, filters come from
a fixed table, and there is no call, attribute, index or import.

    {{ expression }}  {% if e %} … {% elif e %} … {% else %} … {% endif %}
    {% for message in messages %} … {% endfor %}
    {% generation %} … {% endgeneration %}     what the model is trained on
    {# comment #}

Expressions: 'text', names (``role``, ``text``, ``index``, ``first``,
``last``, ``previous_role``), ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``,
brackets, and filters ``| escape``, ``| trim``, ``| lower``, ``| upper``.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass

NAMES = ("role", "text", "index", "first", "last", "previous_role")

# --- control strings inside texts ----------------------------------------------

#: Every control string of a template begins with this.
OPEN = "<|"


def escape(text: str) -> str:
    """No ``OPEN`` is left in the text; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace(OPEN, "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}

# --- source to tree ----------------------------------------------------------------
# expressions: ("lit", value) ("name", n) ("filter", f, e) ("add" | "eq" | "ne" | "and" | "or", a, b) ("not", e)
# statements:  ("text", s) ("out", e) ("if", [(e, body)], body) ("for", body) ("gen", body)

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[+|()]))", re.DOTALL)


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        match = _TOKEN.match(source, at)
        if not match:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = ("text", "name", "mark")[match.lastindex - 1]
        found.append((kind, match[match.lastindex]))
        at = match.end()
    return found


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def taken(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        node = self.both()
        while self.taken("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.taken("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.taken("not") else self.compared()

    def compared(self):
        node = self.joined()
        while mark := self.taken("==", "!="):
            node = ("eq" if mark == "==" else "ne", node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.taken("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.taken("|"):
            if self.at >= len(self.tokens) or self.tokens[self.at][1] not in FILTERS:
                raise TemplateError("a filter is missing or unknown")
            node = ("filter", self.tokens[self.at][1], node)
            self.at += 1
        return node

    def atom(self):
        if self.taken("("):
            node = self.either()
            if not self.taken(")"):
                raise TemplateError("a bracket is not closed")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if value in NAMES:
            return ("name", value)
        raise TemplateError(f"unknown name {value!r}")


def parse(source: str) -> list:
    """The statements of a template."""
    pieces, at = [], 0
    for match in _PIECE.finditer(source):
        pieces.append(("text", source[at : match.start()]))
        if match[1] is not None:
            pieces.append(("out", _Expression(match[1]).whole()))
        elif match[2] is not None:
            pieces.append(("tag", match[2].strip()))
        at = match.end()
    pieces.append(("text", source[at:]))
    pieces = [p for p in pieces if p != ("text", "")]
    body, rest, closing = _body(pieces, ())
    if closing:
        raise TemplateError(f"unexpected {closing!r}")
    return body


def _body(pieces: list, ends: tuple[str, ...]):
    """Statements up to a tag whose word is in ``ends``; the pieces behind it; that tag."""
    found = []
    while pieces:
        piece, pieces = pieces[0], pieces[1:]
        if piece[0] != "tag":
            found.append(piece)
            continue
        word, _, rest = piece[1].partition(" ")
        if word in ends:
            return found, pieces, piece[1]
        if word == "for":
            if rest.split() != ["message", "in", "messages"]:
                raise TemplateError("loops run over messages: {% for message in messages %}")
            inner, pieces, _ = _closed(pieces, ("endfor",))
            found.append(("for", inner))
        elif word == "generation":
            inner, pieces, _ = _closed(pieces, ("endgeneration",))
            found.append(("gen", inner))
        elif word == "if":
            cases, other, test = [], [], _Expression(rest).whole()
            while True:
                inner, pieces, closing = _closed(pieces, ("elif", "else", "endif"))
                cases.append((test, inner))
                word, _, rest = closing.partition(" ")
                if word == "elif":
                    test = _Expression(rest).whole()
                    continue
                if word == "else":
                    other, pieces, _ = _closed(pieces, ("endif",))
                break
            found.append(("if", cases, other))
        else:
            raise TemplateError(f"unknown tag {piece[1]!r}")
    return found, [], ""


def _closed(pieces: list, ends: tuple[str, ...]):
    body, rest, closing = _body(pieces, ends)
    if not closing:
        raise TemplateError(f"{ends[-1]} is missing")
    return body, rest, closing


# --- folding -------------------------------------------------------------------------


def _applied(kind: str, a, b=None):
    return {"add": lambda: str(a) + str(b), "eq": lambda: a == b, "ne": lambda: a != b,
            "and": lambda: a and b, "or": lambda: a or b, "not": lambda: not a}[kind]()


def fold_expression(node):
    kind = node[0]
    if kind in ("lit", "name"):
        return node
    if kind == "filter":
        inner = fold_expression(node[2])
        return ("lit", FILTERS[node[1]](str(inner[1]))) if inner[0] == "lit" else ("filter", node[1], inner)
    parts = [fold_expression(part) for part in node[1:]]
    if all(part[0] == "lit" for part in parts):
        return ("lit", _applied(kind, *(part[1] for part in parts)))
    if kind in ("and", "or") and parts[0][0] == "lit":  # the first side decides, or only the second counts
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold(body: list) -> list:
    """The same statements with constant parts worked out and neighbouring texts joined."""
    found: list = []

    def add(statement) -> None:
        if statement[0] == "text" and found and found[-1][0] == "text":
            found[-1] = ("text", found[-1][1] + statement[1])
        elif statement != ("text", ""):
            found.append(statement)

    for node in body:
        if node[0] == "out":
            value = fold_expression(node[1])
            add(("text", str(value[1])) if value[0] == "lit" else ("out", value))
        elif node[0] in ("for", "gen"):
            add((node[0], fold(node[1])))
        elif node[0] == "if":
            cases, other = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] != "lit":
                    cases.append((test, fold(inner)))
                elif test[1]:
                    other = fold(inner)
                    break
            if cases:
                add(("if", cases, other))
            else:
                for statement in other:
                    add(statement)
        else:
            add(node)
    return found


# --- tree to closures ----------------------------------------------------------------


class Output:
    """Text as it is made, with the code point ranges of the generation markers."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "lit":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env[name]
    if kind == "filter":
        change, inner = FILTERS[node[1]], _value(node[2])
        return lambda env: change(str(inner(env)))
    a = _value(node[1])
    if kind == "not":
        return lambda env: not a(env)
    b = _value(node[2])
    return {
        "add": lambda env: str(a(env)) + str(b(env)), "eq": lambda env: a(env) == b(env), "ne": lambda env: a(env) != b(env),
        "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env),
    }[kind]


def _statement(node) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.put(text)
    if kind == "out":
        value = _value(node[1])
        return lambda env, out: out.put(str(value(env)))
    if kind == "gen":
        inner = closures(node[1])

        def generation(env, out):
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "if":
        cases = [(_value(test), closures(body)) for test, body in node[1]]
        other = closures(node[2])

        def choose(env, out):
            for test, body in cases:
                if test(env):
                    return body(env, out)
            return other(env, out)

        return choose
    raise TemplateError("loops cannot be nested")


def closures(body: list) -> Callable[[dict, Output], None]:
    steps = [_statement(node) for node in body]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


@dataclass(frozen=True)
class Template:
    """A compiled template: what stands before, for each message, and behind the loop."""

    before: Callable[[dict, Output], None]
    message: Callable[[dict, Output], None]
    behind: Callable[[dict, Output], None]

    def turn(self, env: dict) -> Output:
        """One message's part of the output; the first also has what stands before, the last what stands behind."""
        out = Output()
        if env["first"]:
            self.before(env, out)
        self.message(env, out)
        if env["last"]:
            self.behind(env, out)
        return out

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """Text and generation spans of a whole conversation held in memory."""
        texts, spans, length = [], [], 0
        for env in environments(messages):
            out = self.turn(env)
            texts.append(out.text())
            spans += [(length + a, length + b) for a, b in out.spans]
            length += out.length
        return "".join(texts), spans


def environments(messages: list[tuple[str, str]]):
    previous = ""
    for i, (role, text) in enumerate(messages):
        yield {"role": role, "text": text, "index": i, "first": i == 0, "last": i == len(messages) - 1,
               "previous_role": previous}
        previous = role


def compile_template(source: str) -> Template:
    """Compile a template with exactly one loop over the messages at its top level."""
    body = fold(parse(source))
    loops = [i for i, node in enumerate(body) if node[0] == "for"]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over the messages")
    at = loops[0]
    return Template(closures(body[:at]), closures(body[at][1]), closures(body[at + 1 :]))
