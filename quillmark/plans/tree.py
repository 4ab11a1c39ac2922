"""Tokens of a statement as a tree: parentheses are groups, so clauses and operands are found by structure."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[rR]?'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[A-Za-z]{0,2}|\.\d+)|(?P<param>\$\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op><=>|<->|<\#>|::|->|<=|>=|<>|!=|\|\||.)""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else ""


@dataclass
class Group:
    """What stands between parentheses."""

    items: list[Node] = field(default_factory=list)
    kind: str = "group"

    def word(self) -> str:
        return ""


Node = Token | Group


def parse(text: str) -> list[Node]:
    stack: list[list[Node]] = [[]]
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "op" and value == "(":
            stack.append([])
        elif kind == "op" and value == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced parentheses")
            group = Group(stack.pop())
            stack[-1].append(group)
        else:
            if kind == "quoted" and value[0] == '"':
                value = "`" + value[1:-1].replace('""', '"').replace("`", "``") + "`"
            stack[-1].append(Token(kind, value))
    if len(stack) != 1:
        raise ValueError("unbalanced parentheses")
    return stack[0]


def render(items: list[Node]) -> str:
    out: list[str] = []
    for x in items:
        text = f"({render(x.items)})" if isinstance(x, Group) else x.text
        glued = out and (text in (".", "[", "]", "::", ",") or out[-1].endswith((".", "[", "::")))
        out.append(text if glued or not out else " " + text)
    return "".join(out)


def sql(text: str) -> Token:
    """A piece that is Spark SQL already and counts as one operand."""
    return Token("sql", text)


def is_op(x: Node, *ops: str) -> bool:
    return isinstance(x, Token) and x.kind == "op" and x.text in ops


def split(items: list[Node], comma: str = ",") -> list[list[Node]]:
    """Parts between commas at this level; none for an empty list."""
    out: list[list[Node]] = [[]]
    for x in items:
        if is_op(x, comma):
            out.append([])
        else:
            out[-1].append(x)
    return out if len(out) > 1 or out[0] else []


def words(items: list[Node]) -> set[str]:
    """All names in a tree, as they are written."""
    out: set[str] = set()
    for x in items:
        if isinstance(x, Group):
            out |= words(x.items)
        elif x.kind == "name":
            out.add(x.text)
        elif x.kind == "quoted":
            out.add(x.text[1:-1])
    return out


def find(items: list[Node], *names: str, start: int = 0) -> int:
    """Place of a run of words at this level, or -1."""
    for i in range(start, len(items) - len(names) + 1):
        if all(items[i + k].word() == n for k, n in enumerate(names)):
            return i
    return -1


def string_of(x: Node) -> str:
    """The value of a string literal."""
    if not isinstance(x, Token) or x.kind != "string":
        raise ValueError(f"a string literal is expected, not {render([x])}")
    return x.text[x.text.index("'") + 1 : -1].replace("''", "'")


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
