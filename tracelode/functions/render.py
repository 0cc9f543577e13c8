"""Names from marked source, and types and signatures from the graph of type nodes.

A marked source is decoded to a tree first; names, and whole renders, are folds over the tree. A type
graph is a set of plain mappings, all of one compilation unit. Renders are pure functions of
their input, so callers render distinct values only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .wire import BYTES, VARINT, WireError, fields, text

#: Kinds of marked source nodes.
BOX, TYPE, PARAMETER, IDENTIFIER, CONTEXT, INITIALIZER, MODIFIER = 0, 1, 2, 3, 4, 5, 12
LOOKUPS = range(6, 12)
NOT_NAMES = {TYPE, PARAMETER, INITIALIZER, MODIFIER, *LOOKUPS}
#: Fixed value: how deep types nest.
DEEPEST = 64
#: Builtin operators and how they show around their argument.
AROUND = {"ptr": "{} *", "lvr": "{} &", "rvr": "{} &&", "const": "const {}", "volatile": "volatile {}"}
DECLARATORS = {"ptr": "*", "lvr": "&", "rvr": "&&"}
ARRAYS = ("carr", "array")


@dataclass
class Marked:
    kind: int = BOX
    pre: str = ""
    joiner: str = ""
    post: str = ""
    final: bool = False
    kids: list[Marked] = field(default_factory=list)


def decode(data: bytes, depth: int = 0) -> Marked:
    """The tree of a marked source; of damaged bytes what comes before the damage."""
    node, kind = Marked(), None
    try:
        for n, wire, value in fields(data):
            if wire == VARINT:
                if n == 1 and kind is None:
                    node.kind = kind = value
                elif n == 10:
                    node.final = value != 0
            elif wire == BYTES:
                if n == 3 and depth < 200:
                    node.kids.append(decode(value, depth + 1))
                elif n == 2:
                    node.pre = text(value)
                elif n == 4:
                    node.joiner = text(value)
                elif n == 5:
                    node.post = text(value)
    except WireError:
        pass
    return node


def _joined(node: Marked, parts: list[str], post: str) -> str:
    body = node.joiner.join(parts) + (node.joiner if parts and node.final else "")
    return node.pre + body + post


def _faithful(node: Marked) -> str:
    return _joined(node, [_faithful(k) for k in node.kids], node.post)


def _name(node: Marked) -> str:
    """A context or identifier; an identifier has identifiers only in it, and no text after it."""
    if node.kind == IDENTIFIER:
        return _joined(node, [_name(k) for k in node.kids if k.kind == IDENTIFIER], "")
    return _joined(node, [_name(k) for k in node.kids if k.kind not in NOT_NAMES], node.post)


def _names(node: Marked, top: bool = True) -> str:
    if not top and node.kind in NOT_NAMES:
        return ""
    if node.kind in (CONTEXT, IDENTIFIER):
        return _name(node)
    return "".join(_names(k, False) for k in node.kids)


def qualified_name(data: bytes | None) -> str | None:
    """The qualified name of a marked source: its contexts and identifiers; of a tree without any, all of it."""
    if data is None:
        return None
    node = decode(data)
    found = _names(node).strip().rstrip(":").rstrip()
    if not found:
        found = _faithful(node).strip()
    return found if found and not re.search(r"[\n\r{};]", found) else None


def short(name: str) -> str:
    return name.rsplit("::", 1)[-1].rsplit(".", 1)[-1]


def without_brackets(name: str) -> str:
    return name.split("[", 1)[0].rstrip() if "[" in name else name


def type_name(data: bytes | None) -> str | None:
    """A type's name: without the empty brackets that a generic's definition ends in."""
    found = qualified_name(data)
    while found and found.endswith("<>"):
        found = found[:-2]
    return (found or "").rstrip() or None


@dataclass
class Types:
    """Type nodes of one unit by ticket: node kind, marked source, parameters by ordinal, builtin operator, typed edges."""

    kind: dict[str, str] = field(default_factory=dict)
    code: dict[str, bytes] = field(default_factory=dict)
    params: dict[str, dict[int, str]] = field(default_factory=dict)
    op: dict[str, str] = field(default_factory=dict)
    typed: dict[str, str] = field(default_factory=dict)

    def _params(self, node: str) -> list[str]:
        own = self.params.get(node, {})
        return [own[i] for i in sorted(own)]

    def _builtin(self, node: str) -> str | None:
        """Operator of a builtin node; "" if it has none, None for other nodes."""
        return self.op.get(node, "") if self.kind.get(node) == "tbuiltin" else None

    def render(self, node: str, depth: int = 0) -> str | None:
        """A type in words, or None."""
        if depth > DEEPEST:
            return None
        params = self._params(node)
        if self.kind.get(node) != "tapp":
            return self._leaf(node)
        if not params:
            return type_name(self.code.get(node))
        head, args = params[0], params[1:]
        op = self._builtin(head)
        if op in ARRAYS:
            return f"{self._or_unknown(args[0], depth) if args else '?'}[]"
        if op in DECLARATORS and args:
            item = self._item(args[0], depth)
            if item is not None:
                return f"{item} ({DECLARATORS[op]})[]"
        shown = [self._or_unknown(a, depth) for a in args]
        if op is not None:
            return _applied(op, shown)
        name = self.render(head, depth + 1)
        if name is None or not shown:
            return name
        return f"{name}<{', '.join(shown)}>"

    def _or_unknown(self, node: str, depth: int) -> str:
        found = self.render(node, depth + 1)
        return "?" if found is None else found

    def _item(self, node: str, depth: int) -> str | None:
        """The element type of an array node."""
        params = self._params(node) if self.kind.get(node) == "tapp" else []
        if len(params) > 1 and self._builtin(params[0]) in ARRAYS:
            return self.render(params[1], depth + 1)
        return None

    def _leaf(self, node: str) -> str | None:
        name = type_name(self.code.get(node))
        if name:
            return short(name) if self.kind.get(node) == "tvar" else name
        return self.op.get(node) or None

    def typed_render(self, node: str) -> str | None:
        return self.render(self.typed[node]) if node in self.typed else None

    def signature(self, function: str) -> str | None:
        """``returns name(type name, ...)``; None if it would say no more than the type."""
        own = qualified_name(self.code.get(function))
        name = short(own) if own else ""
        whole = self.typed_render(function)
        returns = whole.split("(", 1)[0].rstrip() if whole else ""
        params = self._params(function)
        if not params:
            return f"{returns} {name}()" if returns and name else None
        shown, named = [], False
        for p in params:
            kind = self.typed_render(p) or ""
            full = qualified_name(self.code.get(p))
            called = without_brackets(short(full)) if full else ""
            named = named or bool(called)
            shown.append(f"{kind} {called}".strip() or "?")
        return f"{returns} {name}".strip() + f"({', '.join(shown)})" if named else None


def _applied(op: str, args: list[str]) -> str:
    first = args[0] if args else "?"
    if op in AROUND:
        return AROUND[op].format(first)
    if op == "fn":
        return f"{first}({', '.join(args[1:])})"
    return f"{op}<{', '.join(args)}>" if args else op
