"""Lexical scopes of source code: which scope every name of a text is bound in, and how recently it was used there.

Scopes follow the indentation, so texts that are cut off or don't parse have scopes as well. A function or class opens one
below its header; it ends before the first line that is indented no deeper than the header. Names of functions, classes,
parameters, assignments, loops and imports are bound where they stand; any other name is looked up from its scope outwards.
"""

from __future__ import annotations

import keyword
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"(?P<string>'''[\s\S]*?(?:'''|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<comment>#[^\n]*)|(?P<line>\r?\n)|(?P<space>[ \t\f]+|\\\r?\n)|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>==|!=|<=|>=|->|:=|\*\*|//|[-+*/%@&|^]=|[\s\S])")
OPENING, CLOSING = frozenset("([{"), frozenset(")]}")


@dataclass
class Scope:
    number: int
    parent: int | None
    header: int  # indentation of its header
    recent: list[str] = field(default_factory=list)  # names bound here, the last used first


def _tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in TOKEN.finditer(text) if m.lastgroup != "comment"]


def _lines(text: str):
    """(indentation, tokens) of the logical lines that hold any token; brackets join lines."""
    line, indent, fresh, depth = [], 0, True, 0
    for kind, part in _tokens(text):
        if kind == "line" and depth == 0:
            if line:
                yield indent, line
            line, indent, fresh = [], 0, True
        elif kind in ("space", "line"):
            if fresh and kind == "space":
                indent = len(part.expandtabs())
        else:
            fresh = False
            depth = max(0, depth + (part in OPENING) - (part in CLOSING)) if kind == "sign" else depth
            line.append((kind, part))
    if line:
        yield indent, line


def _bound(line: list[tuple[str, str]]) -> tuple[set[int], set[int]]:
    """Places in a logical line of names that it binds in its own scope, and in the scope that it opens."""
    here, inner = set(), set()
    words = [part for _, part in line]
    start = 1 if words[0] == "async" and len(words) > 1 else 0
    if words[start] in ("def", "class") and start + 1 < len(line) and line[start + 1][0] == "name":
        here.add(start + 1)
        depth, expects = 0, False
        for i in range(start + 2, len(line)):
            if words[i] in OPENING:
                depth += 1
                expects = depth == 1 and words[start] == "def"
                continue
            depth -= words[i] in CLOSING
            if depth == 0 and words[i] == ":":
                break
            if depth == 1 and expects and line[i][0] == "name":
                inner.add(i)
            expects = words[start] == "def" and depth == 1 and (words[i] == "," or words[i] in ("*", "**") and expects)
        return here, inner
    if words[0] in ("import", "from"):
        imported = words[0] == "import" or "import" in words
        for i, word in enumerate(words):
            if line[i][0] == "name" and imported and word not in ("import", "from", "as") and i > 0:
                listed = words[0] == "import" or "import" in words[:i]
                renamed = i + 1 < len(words) and words[i + 1] == "as"
                if listed and not renamed and words[i - 1] != ".":
                    here.add(i)
        return here, inner
    for i, word in enumerate(words):  # for x, y in, and: as x
        if word == "for":
            j = i + 1
            while j < len(words) and words[j] != "in":
                if line[j][0] == "name":
                    here.add(j)
                j += 1
        elif word == "as" and i + 1 < len(words) and line[i + 1][0] == "name":
            here.add(i + 1)
        elif word == ":=" and i > 0 and line[i - 1][0] == "name":
            here.add(i - 1)
    depth, targets = 0, []
    for i, word in enumerate(words):
        if depth == 0 and (word == "=" or line[i][0] == "sign" and len(word) == 2 and word[1] == "=" and word[0] in "+-*/%@&|^"):
            here.update(targets)
            targets = []
            if word != "=":
                break
            continue
        if depth == 0 and word == ":" and len(targets) == 1 and i == 1:  # an annotation
            here.update(targets)
        depth += (word in OPENING) - (word in CLOSING)
        if line[i][0] == "name" and (i == 0 or words[i - 1] in (",", "(", "[", "=", "*")) and (i + 1 == len(words) or words[i + 1] in (",", ")", "]", "=", ":") or words[i + 1][-1:] == "="):
            targets.append(i)
        elif word not in (",", "(", ")", "[", "]", "*"):
            targets = []
            if line[i][0] != "name":
                break
    return here, inner


def scope_uses(text: str) -> list[tuple[int, str, int, int | None, str, int | None, int]]:
    """(position, name, scope, parent, use, distance, rank) of every name in order, keywords and attributes apart.

    ``use`` is 'binding', 'resolved' (``distance`` scopes further out, 0 for its own) or 'free', where no scope around
    binds the name. ``rank`` is its place in the table of the scope that has it, the last used first, or -1 when it is
    new there; free names have a table of their own."""
    scopes = {0: Scope(0, None, -1)}
    stack, free, out, position = [0], [], [], 0

    def touch(table: list[str], name: str) -> int:
        rank = table.index(name) if name in table else -1
        if rank >= 0:
            table.pop(rank)
        table.insert(0, name)
        return rank

    for indent, line in _lines(text):
        while len(stack) > 1 and indent <= scopes[stack[-1]].header:
            stack.pop()
        here, inner = _bound(line)
        words = [part for _, part in line]
        opens = words[0] in ("def", "class") or words[:2] == ["async", "def"]
        outer = stack[-1]
        if opens:
            number = len(scopes)
            scopes[number] = Scope(number, outer, indent)
            stack.append(number)
        for i, (kind, name) in enumerate(line):
            if kind == "name" and not keyword.iskeyword(name) and (i == 0 or words[i - 1] != "."):
                scope = outer if i in here else stack[-1]
                if i in here or i in inner:
                    out.append((position, name, scope, scopes[scope].parent, "binding", 0, touch(scopes[scope].recent, name)))
                else:
                    at, distance = scope, 0
                    while at is not None and name not in scopes[at].recent:
                        at, distance = scopes[at].parent, distance + 1
                    if at is None:
                        out.append((position, name, scope, scopes[scope].parent, "free", None, touch(free, name)))
                    else:
                        out.append((position, name, scope, scopes[scope].parent, "resolved", distance, touch(scopes[at].recent, name)))
            position += 1
    return out
