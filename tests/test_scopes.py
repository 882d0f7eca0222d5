from tallyloom.operators.scopes import scope_uses

SOURCE = """import os.path, json as j
from typing import Any as A, List

limit = 3
class Box(Base):
    size: int = limit

    def put(self, item, *more, deep={'a': 1}, **rest) -> List:
        for a, b in more:
            self.size += item.size(a, key=b)
        def inner(x):
            return x + item + limit + unknown

        total = inner(limit)
        return total

after = Box(limit)
"""


def uses(text):
    return [(name, scope, use, distance) for _, name, scope, _, use, distance, _ in scope_uses(text)]


def test_scopes_of_a_module():
    got = uses(SOURCE)
    assert [u for u in got if u[0] in ("os", "path", "json", "j", "A", "Any", "List")] == [
        ("os", 0, "binding", 0), ("json", 0, "free", None), ("j", 0, "binding", 0), ("Any", 0, "free", None), ("A", 0, "binding", 0), ("List", 0, "binding", 0), ("List", 2, "resolved", 2),
    ]
    assert ("Box", 0, "binding", 0) in got and ("Base", 1, "free", None) in got and ("size", 1, "binding", 0) in got and ("limit", 1, "resolved", 1) in got
    for name in ("self", "item", "more", "deep", "rest", "a", "b", "inner", "total"):
        assert (name, 2, "binding", 0) in got, name
    assert ("x", 3, "binding", 0) in got and ("x", 3, "resolved", 0) in got and ("item", 3, "resolved", 1) in got and ("limit", 3, "resolved", 3) in got and ("unknown", 3, "free", None) in got
    assert ("inner", 2, "resolved", 0) in got and ("total", 2, "resolved", 0) in got
    assert got[-3:] == [("after", 0, "binding", 0), ("Box", 0, "resolved", 0), ("limit", 0, "resolved", 0)]


def test_ranks_are_by_scope():
    rows = [(name, rank) for _, name, _, _, _, _, rank in scope_uses("a = 1\nb = a\nc = a\nprint(b)")]
    assert rows == [("a", -1), ("b", -1), ("a", 1), ("c", -1), ("a", 1), ("print", -1), ("b", 2)]


def test_broken_and_odd_texts():
    assert uses("") == [] and uses("   \n\t") == [] and uses('"""open') == []
    assert uses("def f(a):\n    return (a +\na)\nf") == [("f", 0, "binding", 0), ("a", 1, "binding", 0), ("a", 1, "resolved", 0), ("a", 1, "resolved", 0), ("f", 0, "resolved", 0)]
    assert uses("def f(a): return a") == [("f", 0, "binding", 0), ("a", 1, "binding", 0), ("a", 1, "resolved", 0)]
    assert uses("async def g(): pass\nx: int\nwith o() as y: pass\nif (z := x): pass")[1:] == [("x", 0, "binding", 0), ("int", 0, "free", None), ("o", 0, "free", None), ("y", 0, "binding", 0), ("z", 0, "binding", 0), ("x", 0, "resolved", 0)]
    assert uses("a, (b, c) = d = e") == [("a", 0, "binding", 0), ("b", 0, "binding", 0), ("c", 0, "binding", 0), ("d", 0, "binding", 0), ("e", 0, "free", None)]
    assert len(scope_uses("x" * 100_000)) == 1 and scope_uses("中文 = 1")[0][1] == "中文"
