"""One consistent table from JSON documents whose fields drift between files, and a report of every change.

Documents are loaded as path-value maps with raw types (``path_values``). Type statistics by file and path show what
was added, removed or changed its type (``field_changes``); renames are found by value: a path that is gone and a new
one whose values have the same signature over the runs that both files hold. ``typed_runs`` and ``typed_summary`` project
all fields to typed columns along their chains of renames; ``cast_report`` has every value that failed its cast.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .nested import strict_json

# JSON types as bits, so that the types of a path in a file are one integer that merges by OR. Nulls have none.
STRING, NUMBER, BOOLEAN, ARRAY = 1, 2, 4, 8
LIST_SECTION = "summary"
BROADCAST_FILES, SALTS = 50_000, 32


def _kind(v) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, (int, float)):
        return NUMBER
    return STRING if isinstance(v, str) else ARRAY


def _canonical(v):
    """The value with equal numbers spelled alike."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e18:
        return int(v)
    if isinstance(v, list):
        return [_canonical(x) for x in v]
    if isinstance(v, dict):
        return {k: _canonical(x) for k, x in v.items()}
    return v


def document_paths(doc: dict, sections: tuple[str, ...]) -> dict[str, tuple[int, list]]:
    """path -> (types, values): the dotted paths of all values that are no objects, under the given sections."""
    found: dict[str, tuple[int, list]] = {}

    def walk(v, path: str, element: int) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}", element)
            return
        kinds, values = found.setdefault(path, (0, []))
        values.append([element, _canonical(v)])
        found[path] = (kinds | _kind(v), values)

    for s in sections:
        if s not in doc:
            continue
        if s == LIST_SECTION:
            elements = doc[s] if isinstance(doc[s], list) else [doc[s]]
            for i, e in enumerate(elements):
                if isinstance(e, dict):
                    walk(e, s, i)
        elif s != "config" or isinstance(doc[s], dict):
            walk(doc[s], s, -1)
    return found


PATHS = "lane string, file_no bigint, run_id string, path string, kinds int, value string"


def path_values(files: DataFrame, sections: tuple[str, ...] = ("schema_version", "config", LIST_SECTION)) -> DataFrame:
    """(lane, file_no, run_id, path, kinds, value): one row per document and path; and one with an empty path for each
    document, whose value says whether it could be parsed. ``value`` is canonical JSON: the value, or under the list
    section [element, value] pairs. Repeated deliveries of a file give repeated rows. Null or broken bodies give only
    the row with the empty path. Only the four columns needed are read."""
    kept = files.select("lane", F.col("file_no").cast("bigint").alias("file_no"), F.col("body").cast("string").alias("body"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]

            def put(*row) -> None:
                for c, v in zip(out, row):
                    c.append(v)

            for lane, no, body in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    doc = strict_json(body or "")
                except ValueError:
                    doc = None
                if not isinstance(doc, dict):
                    put(lane, no, None, "", 0, "broken")
                    continue
                run = doc.get("run_id")
                run = run if isinstance(run, str) or run is None else json.dumps(run)
                put(lane, no, run, "", 0, "parsed")
                for path, (kinds, values) in document_paths(doc, sections).items():
                    shown = values if path.startswith(LIST_SECTION + ".") else values[0][1]
                    put(lane, no, run, path, kinds, json.dumps(shown, ensure_ascii=False, sort_keys=True))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["lane", "file_no", "run_id", "path", "kinds", "value"])

    return kept.mapInArrow(load, PATHS)


def _section(path: Column) -> Column:
    return F.when(path.startswith("config."), "config").when(path.startswith(LIST_SECTION + "."), LIST_SECTION)


def field_changes(paths: DataFrame) -> DataFrame:
    """(lane, file_no, change_kind, field_path, prior_path): changes between each file and the one before it in its lane.

    ``paths`` is a staged result of ``path_values``, read several times. All steps are merges by key: statistics by
    (lane, file, path) pre-aggregate next to the scan, and only paths that came or went have their values compared,
    by order-free signatures instead of pairs. The only ordered step is over the distinct files of a lane. A file
    without documents that parse has no fields; the first file of a lane has no changes. Where several paths that came
    and went share a signature, names decide (edit distance, then name), and a path takes part in one rename only.
    """
    stats = staged(paths.groupBy("lane", "file_no", "path").agg(F.bit_or("kinds").alias("kinds")), "p2-stats")
    in_lane = Window.partitionBy("lane").orderBy("file_no")
    files = stats.filter(F.col("path") == "").select("lane", "file_no", F.lag("file_no").over(in_lane).alias("prior_no"), F.lead("file_no").over(in_lane).alias("next_no"))
    files = staged(files, "p2-files")
    # Rows of one file meet one row about it: by a broadcast of a checked size, else dealt over SALTS tasks.
    few = files.count() <= BROADCAST_FILES

    def with_files(rows: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(files), ["lane", "file_no"])
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        return dealt.join(files.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lane", "file_no", "_salt"]).drop("_salt")

    # Each file's fields beside those of the file before it.
    placed = with_files(stats.filter(F.col("path") != ""))
    now = placed.filter(F.col("prior_no").isNotNull()).select("lane", "file_no", "path", F.col("kinds").alias("new_kinds"), F.lit(None).cast("int").alias("old_kinds"))
    before = placed.filter(F.col("next_no").isNotNull()).select("lane", F.col("next_no").alias("file_no"), "path", F.lit(None).cast("int").alias("new_kinds"), F.col("kinds").alias("old_kinds"))
    beside = now.unionByName(before).groupBy("lane", "file_no", "path").agg(F.max("new_kinds").alias("new_kinds"), F.max("old_kinds").alias("old_kinds"))
    old, new = F.col("old_kinds"), F.col("new_kinds")
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").when((old != 0) & (new != 0) & (old.bitwiseAND(new) == 0), "type")
    changes = staged(beside.select("lane", "file_no", "path", change.alias("kind")).filter(F.col("kind").isNotNull()), "p2-kinds")

    # Runs that both files hold.
    runs = with_files(paths.filter((F.col("path") == "") & F.col("run_id").isNotNull()).select("lane", "file_no", "run_id"))
    now_runs = runs.filter(F.col("prior_no").isNotNull()).select("lane", "file_no", "run_id", F.lit(1).alias("side"))
    before_runs = runs.filter(F.col("next_no").isNotNull()).select("lane", F.col("next_no").alias("file_no"), "run_id", F.lit(2).alias("side"))
    shared = now_runs.unionByName(before_runs).groupBy("lane", "file_no", "run_id").agg(F.bit_or("side").alias("sides")).filter("sides = 3").select("lane", F.col("file_no").alias("change_no"), "run_id")

    # Signatures of the values of paths that came or went.
    moved = (
        with_files(changes.filter((F.col("kind") != "type") & _section(F.col("path")).isNotNull()))
        .select("lane", F.when(F.col("kind") == "added", F.col("file_no")).otherwise(F.col("prior_no")).alias("file_no"), "path", F.col("file_no").alias("change_no"), "kind")
    )
    values = (
        paths.join(moved, ["lane", "file_no", "path"])
        .join(shared, ["lane", "change_no", "run_id"])
        .groupBy("lane", "change_no", "kind", "path", "run_id")
        .agg(F.max("value").alias("value"))
    )
    signature = values.groupBy("lane", "change_no", "kind", "path").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("run_id", "value")).alias("x"), F.sum(F.hash("value", "run_id").cast("bigint")).alias("s")
    )
    came = signature.filter("kind = 'added'").select("lane", "change_no", _section(F.col("path")).alias("section"), "n", "x", "s", F.col("path").alias("field_path"))
    went = signature.filter("kind = 'removed'").select("lane", "change_no", _section(F.col("path")).alias("section"), "n", "x", "s", F.col("path").alias("prior_path"))
    alike = came.join(went, ["lane", "change_no", "section", "n", "x", "s"]).withColumn("far", F.levenshtein("field_path", "prior_path"))
    best = lambda a, b: F.row_number().over(Window.partitionBy("lane", "change_no", a).orderBy("far", b))
    renames = alike.withColumn("i", best("field_path", "prior_path")).withColumn("j", best("prior_path", "field_path")).filter("i = 1 AND j = 1")
    renames = staged(renames.select("lane", F.col("change_no").alias("file_no"), "field_path", "prior_path"), "p2-renames")

    taken = renames.select("lane", "file_no", F.explode(F.array(F.struct(F.lit("added").alias("kind"), F.col("field_path").alias("path")), F.struct(F.lit("removed").alias("kind"), F.col("prior_path").alias("path")))).alias("t")).select("lane", "file_no", "t.*")
    rest = changes.join(taken, ["lane", "file_no", "kind", "path"], "left_anti")
    return rest.select("lane", "file_no", F.col("kind").alias("change_kind"), F.col("path").alias("field_path"), F.lit("").alias("prior_path")).unionByName(
        renames.select("lane", "file_no", F.lit("renamed").alias("change_kind"), "field_path", "prior_path")
    )


NAMES = "lane string, path string, from_no bigint, to_no bigint, field string"


def lane_names(changes: list[tuple[int, str, str, str]]) -> list[tuple[str, int, int | None, str]]:
    """(path, from_no, to_no, field): the field that a path of one lane stands for, from a file on and before another,
    wherever that isn't the path itself. ``changes`` are (file_no, kind, path, prior path).

    A field is named by the path at the start of its chain of renames, of any length. A name that is gone and comes back
    is its old field again, unless another path holds that field by then; then it is a field of its own.
    """
    now: dict[str, tuple[int, str]] = {}
    holder: dict[str, str] = {}
    out: list[tuple[str, int, int | None, str]] = []

    def close(path: str, no: int) -> str:
        if path not in now:
            return path
        from_no, field = now.pop(path)
        out.append((path, from_no, no, field))
        return field

    def held(field: str, path: str) -> bool:
        return holder.get(field, path) != path

    for no in sorted({c[0] for c in changes}):
        here = sorted(c[1:] for c in changes if c[0] == no)
        for _, path, _ in (c for c in here if c[0] == "removed"):
            field = now[path][1] if path in now else path
            if holder.get(field) == path:
                del holder[field]
        moves = [(path, close(prior, no)) for kind, path, prior in here if kind == "renamed"]
        for path, field in moves:
            close(path, no)
            now[path], holder[field] = (no, field), path
        for _, path, _ in (c for c in here if c[0] == "added"):
            field = now[path][1] if path in now else path
            if held(field, path):
                close(path, no)
                field = next(f for k in range(2, len(changes) + 3) if not held(f := f"{path}#{k}", path))
                now[path] = (no, field)
            holder[field] = path
    return out + [(path, from_no, None, field) for path, (from_no, field) in now.items()]


def field_names(changes: DataFrame) -> DataFrame:
    """``lane_names`` of every lane. A task holds the changes of one lane: no values, and few by nature, as they come
    from the aggregated report."""

    def chains(lane: pa.Table) -> pa.Table:
        names = lane_names(list(zip(*(lane.column(c).to_pylist() for c in ("file_no", "change_kind", "field_path", "prior_path")))))
        of_lane = lane.column("lane")[0].as_py()
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*((of_lane, *n) for n in names)) if names else [[]] * 5
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["lane", "path", "from_no", "to_no", "field"])

    return changes.filter("change_kind <> 'type'").select("lane", "file_no", "change_kind", "field_path", "prior_path").groupBy("lane").applyInArrow(chains, NAMES)


VALUES = "lane string, file_no bigint, run_id string, field string, element bigint, kind int, raw string"


def field_values(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """(lane, file_no, run_id, field, element, kind, raw): every value of every path under its field's name; element is
    its place in the list section, or -1. ``raw`` is the text of a string, else JSON. Documents that parse have one row
    without a field each, list elements are told apart by their place."""
    n, p = field_names(changes).alias("n"), paths.filter("path <> '' OR value = 'parsed'").alias("p")
    at = (F.col("p.lane") == F.col("n.lane")) & (F.col("p.path") == F.col("n.path")) & (F.col("p.file_no") >= F.col("n.from_no")) & (F.col("n.to_no").isNull() | (F.col("p.file_no") < F.col("n.to_no")))
    named = p.join(n, at, "left").select("p.lane", "p.file_no", "p.run_id", F.when(F.col("p.path") != "", F.coalesce("n.field", "p.path")).alias("field"), "p.value")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for lane, no, run, field, value in zip(*(c.to_pylist() for c in b.columns)):
                values = [[-1, None]] if field is None else json.loads(value) if field.startswith(LIST_SECTION + ".") else [[-1, json.loads(value)]]
                for element, v in values:
                    raw = v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)
                    for c, x in zip(out, (lane, no, run, field, element, _kind(v), raw)):
                        c.append(x)
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["lane", "file_no", "run_id", "field", "element", "kind", "raw"])

    return named.mapInArrow(split, VALUES)


_NUMERIC = r"^-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?$"
RESERVED = ("lane", "file_no", "run_id", "element")


def table_columns(values: DataFrame) -> list[tuple[str, str, str, str]]:
    """(section, field, column, type) of all fields, from the types of their values.

    The type is that of most values. Strings that spell numbers, booleans or arrays count as such where the field has
    values of that type. Numbers are integers if all are. Only this list, the schema of the tables, comes to the driver.
    """
    is_string, raw = F.col("kind") == STRING, F.col("raw")
    spelled = {NUMBER: raw.rlike(_NUMERIC), BOOLEAN: F.lower(raw).isin("true", "false"), ARRAY: raw.rlike(r"^\[.*\]$")}
    counts = [F.count_if(F.col("kind") == k).alias(f"n{k}") for k in (STRING, NUMBER, BOOLEAN, ARRAY)]
    counts += [F.count_if(is_string & e).alias(f"s{k}") for k, e in spelled.items()]
    numeric = (F.col("kind") == NUMBER) | (is_string & spelled[NUMBER])
    found = values.filter("field IS NOT NULL").groupBy("field").agg(*counts, F.count_if(numeric & raw.try_cast("bigint").isNull()).alias("n_broken")).collect()
    out, used = [], {s: set(RESERVED) for s in ("config", LIST_SECTION)}
    for r in sorted(found, key=lambda r: r["field"]):
        score = {k: r[f"n{k}"] and r[f"n{k}"] + r[f"s{k}"] for k in (NUMBER, BOOLEAN, ARRAY)}
        score[STRING] = r[f"n{STRING}"] - sum(r[f"s{k}"] for k in spelled if r[f"n{k}"])
        best = max((NUMBER, BOOLEAN, STRING, ARRAY), key=lambda k: score[k])
        kind = {NUMBER: "double" if r["n_broken"] else "bigint", BOOLEAN: "boolean", STRING: "string", ARRAY: "array<string>"}[best] if score[best] else "string"
        section = LIST_SECTION if r["field"].startswith(LIST_SECTION + ".") else "config"
        name = plain = re.sub(r"[^0-9A-Za-z_]", "_", r["field"].removeprefix(section + "."))
        k = 2
        while name.lower() in used[section]:
            name, k = f"{plain}_{k}", k + 1
        used[section].add(name.lower())
        out.append((section, r["field"], name, kind))
    return out


def _cast(raw: Column, kind: str) -> Column:
    """The value under its type, null where it has none. Arrays in columns of strings are their JSON."""
    if kind == "array<string>":
        return F.when(raw.startswith("["), F.from_json(raw, kind))
    return raw.try_cast(kind)


def _typed(values: DataFrame, columns: list[tuple[str, str, str, str]], section: str, keys: list[str]) -> DataFrame:
    # a run without any field still has its row
    of_section = values.filter(F.col("field").isNull() | ~F.col("field").startswith(LIST_SECTION + ".")) if section == "config" else values.filter(F.col("field").startswith(LIST_SECTION + "."))
    wide = [_cast(F.max(F.when(F.col("field") == f, F.col("raw"))), t).alias(c) for s, f, c, t in columns if s == section]
    return of_section.groupBy(*keys).agg(*wide) if wide else of_section.select(*keys).distinct()


def typed_runs(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per run and file with a typed column for every field outside the list section; a value that fails its
    cast is null."""
    values = staged(field_values(paths, changes), "p2-values")
    return _typed(values, table_columns(values), "config", ["lane", "file_no", "run_id"])


def typed_summary(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """The child table of ``typed_runs``: one row per run, file and element of the list section."""
    values = staged(field_values(paths, changes), "p2-values")
    return _typed(values, table_columns(values), LIST_SECTION, ["lane", "file_no", "run_id", "element"])


def cast_report(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """(lane, file_no, section, column, n_values, n_failed, sample): values of either table that could not be cast, by
    file and column."""
    values = staged(field_values(paths, changes), "p2-values")
    columns = table_columns(values)
    types = values.sparkSession.createDataFrame(columns, "section string, field string, column string, type string")
    v = values.filter("field IS NOT NULL AND kind <> 0").join(F.broadcast(types), "field")
    kinds = sorted({t for *_, t in columns} | {"string"})
    failed = F.coalesce(*[F.when(F.col("type") == t, _cast(F.col("raw"), t).isNull()) for t in kinds])
    return (
        v.groupBy("lane", "file_no", "section", "column")
        .agg(F.count("*").alias("n_values"), F.count_if(failed).alias("n_failed"), F.min(F.when(failed, F.col("raw"))).alias("sample"))
        .filter("n_failed > 0")
    )
