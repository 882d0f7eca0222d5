"""Flat related tables out of deeply nested records of varying shape.

A bottom-up tree automaton gives every node of a parsed record a state from the states of its children: first the
leaves, then the objects and arrays that hold them. The state of an element is its structural variant. Going down again,
the state and the place of an element route it to its typed subtype table, whatever wrapped it: an array, a lone object,
text that holds encoded JSON, or an envelope around the whole record; a state without a route in its place goes to the
untyped subtype of that place, so no element is lost. Every row keeps the common supertype columns (record key, table,
own key, parent's key, subtype, variant) and its scalar fields by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHILD = "array<struct<child_table:string,child_key:string,parent_key:string,subtype:string,variant:string,fields:map<string,string>>>"


@dataclass(frozen=True)
class Transition:
    """An object takes ``state`` when it has all of ``needs`` and, if given, one of ``any_of`` among its keys."""

    state: str
    needs: frozenset[str] = frozenset()
    any_of: frozenset[str] = frozenset()

    def accepts(self, keys) -> bool:
        return self.needs <= keys and (not self.any_of or bool(self.any_of & keys))


@dataclass
class Node:
    state: str
    value: object
    encoded: bool = False
    members: dict | list | None = None


@dataclass
class TreeAutomaton:
    """States of leaves: null, blank, text, number, flag. Of arrays: list(<states of its elements>). Of objects: the
    first accepting transition; else digest_map when all members are text, digest_tree when they nest such maps,
    envelope when one member is in the ``root`` state, and record otherwise."""

    transitions: list[Transition]
    root: str
    seen: dict = field(default_factory=dict)

    def annotate(self, value) -> Node:
        """Text that holds encoded JSON, however often encoded, is annotated as what it holds; each decoding is shorter
        than the text, so there are finitely many."""
        if value is None:
            return Node("null", None)
        if isinstance(value, bool):
            return Node("flag", value)
        if isinstance(value, (int, float)):
            return Node("number", value)
        if isinstance(value, str):
            if value.lstrip()[:1] in ("{", "[", '"'):
                try:
                    inner = strict_json(value)
                except ValueError:
                    inner = None
                if isinstance(inner, (dict, list)) or (isinstance(inner, str) and inner.lstrip()[:1] in ("{", "[")):
                    node = self.annotate(inner)
                    if node.members is not None:
                        return Node(node.state, node.value, True, node.members)
            return Node("text" if value.strip() else "blank", value)
        if isinstance(value, list):
            members = [self.annotate(v) for v in value]
            return Node(f"list({'|'.join(sorted({m.state for m in members}))})", value, False, members)
        members = {k: self.annotate(v) for k, v in value.items()}
        return Node(self.object_state(members), value, False, members)

    def object_state(self, members: dict) -> str:
        states = frozenset(m.state for m in members.values())
        at = (frozenset(members), states)
        if at not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            self.seen[at] = self._object_state(*at)
        return self.seen[at]

    def _object_state(self, keys: frozenset, states: frozenset) -> str:
        for t in self.transitions:
            if t.accepts(keys):
                return t.state
        if self.root in states:
            return "envelope"
        if keys and states <= {"text", "blank", "null"}:
            return "digest_map"
        if keys and states <= {"text", "blank", "null", "digest_map", "digest_tree"}:
            return "digest_tree"
        return "record"


def strict_json(text: str):
    """The value of a JSON text; ValueError where it is not JSON (NaN and infinities are not, nor is excessive depth)."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


SECTIONS = frozenset(["a1_context", "artifacts", "binaries", "gates", "tracks"])
RECEIPT_AUTOMATON = [
    Transition("evidence", frozenset(["file", "line"])),
    Transition("round_memory", frozenset(["arm", "peak_rss_bytes"])),
    Transition("round", frozenset(["arm"])),
    Transition("item", frozenset(["item_id"])),
    Transition("track", frozenset(["track"])),
    Transition("receipt", frozenset(["schema_version"]), SECTIONS | {"candidate_commit"}),
    Transition("receipt", frozenset(["candidate_commit"]), SECTIONS - {"a1_context"}),
    Transition("gate_actual", frozenset(["name", "passed", "actual"])),
    Transition("gate", frozenset(["name", "passed"])),
    Transition("context", frozenset(), frozenset(["decision", "frozen_peak_rss_limit_mib"])),
    Transition("digest_entry", frozenset(["sha256"]), frozenset(["file", "path", "name"])),
]


@dataclass(frozen=True)
class Place:
    """Where child records are: under ``member`` of the record above, as rows of ``table``. ``routes`` gives the subtype
    of each state that is typed here. Of a ``named`` place the members are the records, by name; ``needs`` is a member
    without which an element is no record and whose name is the key."""

    member: str
    table: str
    routes: tuple[tuple[str, str], ...]
    inside: tuple[Place, ...] = ()
    named: bool = False
    needs: str | None = None

    def subtype(self, state: str) -> str:
        return dict(self.routes).get(state, f"{self.table}_untyped")


DIGESTS = (("digest_map", "map"), ("digest_tree", "tree"), ("digest_entry", "entry"))
RECEIPT_PLACES = (
    Place("a1_context", "a1_context", (("context", "a1_context_typed"),), needs="decision"),
    Place("artifacts", "artifacts", tuple((state, f"artifacts_{name}") for state, name in DIGESTS), named=True),
    Place("binaries", "binaries", tuple((state, f"binaries_{name}") for state, name in DIGESTS), named=True),
    Place("gates", "gates", (("gate", "gates_plain"), ("gate_actual", "gates_actual")), inside=(Place("evidence", "evidence", (("evidence", "evidence_typed"),)),)),
    Place("tracks", "tracks", (("track", "tracks_typed"),), inside=(
        Place("items", "items", (("item", "items_typed"),), inside=(
            Place("rounds", "rounds", (("round", "rounds_plain"), ("round_memory", "rounds_memory"))),)),)),
)


def receipt_automaton() -> TreeAutomaton:
    return TreeAutomaton(RECEIPT_AUTOMATON, "receipt")


def _leaf(node: Node | None) -> str | None:
    if node is None or node.value is None:
        return None
    if isinstance(node.value, str) and node.members is None:
        return node.value
    return json.dumps(node.value, ensure_ascii=False)


def _scalars(node: Node) -> list[tuple[str, str | None]]:
    if not isinstance(node.members, dict):
        return [("value", _leaf(node))]
    return [(k, _leaf(m)) for k, m in node.members.items() if m.members is None]


def _variant(section: Node, element: Node) -> str:
    shape = "encoded " if section.encoded else ""
    return f"{shape}{'array of ' if isinstance(section.members, list) else ''}{element.state}"


def _elements(section: Node | None) -> Iterator[tuple[int, Node]]:
    """(position, element): of an array its non-null elements, of anything else but null and blank text itself at 0."""
    if section is None or section.state in ("null", "blank"):
        return
    if isinstance(section.members, list):
        for i, m in enumerate(section.members):
            if m.state != "null":
                yield i, m
    else:
        yield 0, section


def _digests(section: Node | None, prefix: str = "") -> Iterator[tuple[str, str, Node]]:
    """(name, digest, holder) of a map, a list of entries or a map whose names were split at their dots."""
    if section is None or section.members is None:
        return
    if isinstance(section.members, list):
        for m in section.members:
            if isinstance(m.members, dict):
                name = next((m.members[k].value for k in ("file", "path", "name") if k in m.members and m.members[k].state == "text"), None)
                digest = m.members.get("sha256") or m.members.get("digest")
                if name is not None and digest is not None:
                    yield prefix + name, digest.value, m
                elif name is None:
                    yield from _digests(m, prefix)
        return
    for k, m in section.members.items():
        if m.members is not None:
            yield from _digests(m, f"{prefix}{k}.")
        elif m.value is not None:
            yield prefix + k, m.value, section


def find_root(node: Node, root: str) -> Node | None:
    """The record itself, or the one inside its envelopes; an object in no known state stands for itself."""
    if not isinstance(node.members, dict):
        if isinstance(node.members, list) and len(node.members) == 1:
            return find_root(node.members[0], root)
        return None
    if node.state == "envelope":
        return next(m for m in node.members.values() if m.state == root)
    if node.state != root:
        for m in node.members.values():
            if m.state == "envelope":
                return find_root(m, root)
    return node


def _route(place: Place, above: dict, parent: str, indexed: bool, out: list[dict]) -> None:
    """Appends the child records of one place under a record with the members ``above`` and the key ``parent``."""
    section = above.get(place.member)

    def put(key: str, state: str, variant: str, fields) -> None:
        out.append({"child_table": place.table, "child_key": key, "parent_key": parent, "subtype": place.subtype(state), "variant": variant, "fields": list(fields)})

    if place.named:
        named = {}
        for name, digest, holder in _digests(section):
            if digest is not None and digest != "":
                named[name] = (digest, holder)
        for name, (digest, holder) in named.items():
            whole = holder is section or not isinstance(section.members, list)
            put(name, section.state if whole else holder.state, section.state if whole else _variant(section, holder), [("digest", str(digest))])
        return
    for i, element in _elements(section):
        members = element.members if isinstance(element.members, dict) else {}
        if place.needs is not None:
            if members.get(place.needs, Node("null", None)).state != "null":
                put(place.needs, element.state, _variant(section, element), _scalars(element))
            continue
        key = f"{parent}/{i}" if indexed else str(i)
        put(key, element.state, _variant(section, element), _scalars(element))
        for inner in place.inside:
            _route(inner, members, key, True, out)


def receipt_children(body: str, automaton: TreeAutomaton) -> list[dict]:
    """The child records of one receipt body; ValueError if it is not valid JSON."""
    root = find_root(automaton.annotate(strict_json(body)), automaton.root)
    out: list[dict] = []
    if root is not None:
        for place in RECEIPT_PLACES:
            _route(place, root.members, "", False, out)
    return out


def shred_receipts(deliveries: DataFrame, key: str, order: list[str], body: str) -> DataFrame:
    """Child rows of the latest valid delivery of each key: (key, child_table, child_key, parent_key, subtype, variant,
    fields).

    One pass parses every body next to its scan. What crosses the shuffle is at most one parsed delivery per key and
    map task, since the latest is a mergeable maximum: a key with a third of all deliveries is no hot spot. Bodies that
    are null, blank or not JSON are passed over, as are keys with no valid body. A valid body that is no object gives
    no rows. Keys may be null and then form one key. Other columns of ``deliveries`` are not read.
    """
    kept = deliveries.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"), F.col(body).cast("string").alias("_body"))
    schema = T.StructType([kept.schema["_key"], kept.schema["_order"]]).add("_children", T._parse_datatype_string(CHILD))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = receipt_automaton()
        item = pa.struct([("child_table", pa.string()), ("child_key", pa.string()), ("parent_key", pa.string()), ("subtype", pa.string()), ("variant", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            at, children = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                try:
                    children.append(receipt_children(text or "", automaton))
                except ValueError:
                    continue
                at.append(i)
            rows = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(children, pa.list_(item))], ["_key", "_order", "_children"])

    parsed = kept.mapInArrow(parse, schema)
    latest = parsed.groupBy("_key").agg(F.max_by("_children", "_order").alias("_children"))
    return latest.select(F.col("_key").alias(key), F.inline("_children"))


def byte_size(c: Column) -> Column:
    """Bytes of a count or of a size with a unit such as '30 MiB'; null where it is neither."""
    n = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[A-Za-z]*\s*$", 1)
    unit = F.lower(F.regexp_extract(c, r"([A-Za-z]*)\s*$", 1))
    factor = F.when(unit.isin("", "b"), 1).when(unit == "kib", 1 << 10).when(unit == "mib", 1 << 20).when(unit == "gib", 1 << 30).when(unit == "kb", 1000).when(unit == "mb", 1000000)
    return (n.try_cast("double") * factor).try_cast("bigint")


# Typed columns of each subtype; its supertype, the child table, has those of all of its subtypes.
DIGEST = {"digest": "string"}
GATE, ROUND = {"name": "string", "passed": "boolean"}, {"arm": "string", "elapsed_ns": "bigint"}
SUBTYPES = {
    "a1_context": {"a1_context_typed": {"candidate_commit": "string", "frozen_peak_rss_limit_mib": "double", "decision": "string"}},
    "artifacts": {f"artifacts_{name}": DIGEST for _, name in DIGESTS},
    "binaries": {f"binaries_{name}": DIGEST for _, name in DIGESTS},
    "gates": {"gates_plain": GATE, "gates_actual": {**GATE, "actual": "double"}},
    "evidence": {"evidence_typed": {"file": "string", "line": "bigint"}},
    "tracks": {"tracks_typed": {"track": "string"}},
    "items": {"items_typed": {"item_id": "string", "original_bytes": "bigint"}},
    "rounds": {"rounds_plain": ROUND, "rounds_memory": {**ROUND, "peak_rss_bytes": "bytes"}},
}


def _typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    f = lambda c: F.col("fields")[c]
    typed = [(byte_size(f(c)) if t == "bytes" else f(c).try_cast(t)).alias(c) for c, t in columns.items()]
    return rows.select(*[c for c in rows.columns if c not in ("fields", "child_table", "subtype")], *typed)


def subtype_table(children: DataFrame, subtype: str) -> DataFrame:
    """The rows that the automaton routed to one subtype, with its typed columns; a field of another type is null."""
    columns = next(known[subtype] for known in SUBTYPES.values() if subtype in known)
    return _typed(children.filter(F.col("subtype") == subtype), columns)


def typed_table(children: DataFrame, kind: str) -> DataFrame:
    """The supertype table of one kind of child: all of its subtypes, the untyped one included, with the typed columns of
    any; null where the subtype has no such column."""
    columns = {c: t for known in SUBTYPES[kind].values() for c, t in known.items()}
    return _typed(children.filter(F.col("child_table") == kind), columns)
