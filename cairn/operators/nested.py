"""Deeply nested JSON records as related flat tables (shared inlining).

``schema_graph`` analyses the structure of a JSON column over all rows: which paths occur, with which kinds, and whether
an element repeats below its parent. ``plan_tables`` decides the tables from it: elements that repeat, that recur below
themselves, or that are shared (objects of one name and one set of keys below several parents) get tables; everything
else is inlined into its nearest ancestor with a table. ``shred`` produces the rows of all tables in one pass, each with
the key of its parent row: the key of a row is (root id, path, positions), that of its parent (root id, parent path,
positions without the last), so parent and child join without any generated id. ``flat_table`` gives one table with
named columns.

Defined results: null, empty or invalid JSON gives no row; a JSON string holding JSON is decoded once more; a lone value
where other records have an array is its only element, and its cells keep the path without ``[]``; equal elements keep
their own positions; unknown fields are inlined like any other, under their path; ``.``, ``[`` and ``~`` in keys are
written ``~1``, ``~2`` and ``~0``; nesting of any depth is allowed.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.text import WHITE

GRAPH_SCHEMA = "path string, kind string, n long, most long"
CELL = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "full", "kind", "val")])
SHRED_FIELDS = [
    T.StructField("table_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("pos", T.ArrayType(T.IntegerType())),
    T.StructField("parent_path", T.StringType()),
    T.StructField("cells", T.ArrayType(CELL)),
]


def key_name(key: str) -> str:
    """A key as a part of paths."""
    return key.replace("~", "~0").replace(".", "~1").replace("[", "~2") if "." in key or "[" in key or "~" in key else key


def _reject(name: str):
    raise ValueError(name)


def decode(payload: str | None) -> object:
    """The JSON value in ``payload``, unwrapped once if that is a string holding JSON; None if there is none."""
    if payload is None or not payload.strip():
        return None
    try:
        value = json.loads(payload, parse_constant=_reject)
        if isinstance(value, str):
            value = json.loads(value, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    return value


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return {dict: "object", list: "array", str: "string"}.get(type(value), "number")


def scalar_text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _walk(value: object, path: str, seen: Counter, most: dict) -> None:
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        kind = kind_of(v)
        seen[p, kind] += 1
        if kind == "object":
            stack.extend((x, f"{p}.{key_name(k)}" if p else key_name(k)) for k, x in v.items())
        elif kind == "array":
            most[p] = max(most.get(p, 0), len(v))
            stack.extend((x, f"{p}[]") for x in v)


@dataclass
class TablePlan:
    """The paths of elements with tables, and the names of those that share one with other paths."""

    repeated: set[str] = field(default_factory=set)
    names: dict[str, str] = field(default_factory=dict)

    def parent(self, path: str) -> str:
        """The nearest ancestor with a table; the root is empty."""
        while path:
            cut = max(path.rfind("."), path.rfind("[]"))
            path = path[:cut] if cut >= 0 else ""
            if path in self.repeated:
                return path
        return ""

    def level(self, path: str) -> int | None:
        """Which of a row's positions is that of ``path``; None if the path has no table."""
        if path not in self.repeated:
            return None
        n = 0
        while path := self.parent(path):
            n += 1
        return n

    def table(self, path: str) -> str:
        return self.names.get(path, path)


def unwrap(value: object, root: str | None) -> object:
    """With ``root``, an object that lacks the array ``root`` becomes the only element of such an array."""
    if root is None or value is None:
        return value
    if not isinstance(value, dict):
        return None
    return value if isinstance(value.get(root), list) else {root: [value]}


def schema_graph(df: DataFrame, json_col: str, root: str | None = None) -> DataFrame:
    """One row per path and kind over all records: occurrences and, for arrays, the longest length."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        most: dict[str, int] = {}
        for batch in batches:
            for payload in batch["_json"]:
                value = unwrap(decode(payload), root)
                if value is not None:
                    _walk(value, "", seen, most)
            if len(seen) > 50_000:  # keeps the task's memory bounded; the final sum merges the parts
                yield pd.DataFrame([(p, k, n, most.get(p, 0)) for (p, k), n in seen.items()], columns=["path", "kind", "n", "most"])
                seen, most = Counter(), {}
        yield pd.DataFrame([(p, k, n, most.get(p, 0)) for (p, k), n in seen.items()], columns=["path", "kind", "n", "most"])

    found = df.select(F.col(json_col).alias("_json")).mapInPandas(scan, GRAPH_SCHEMA)
    return found.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


def plan_tables(graph: DataFrame) -> TablePlan:
    """The tables that the schema graph calls for; only their paths reach the driver."""
    parts = F.split(F.regexp_replace("path", r"\[\]", ""), r"\.")
    repeated = graph.filter("kind = 'array'").select("path", F.lit(None).cast("string").alias("name"))
    named = graph.filter("path <> ''").withColumn("_parts", parts).withColumn("_name", F.element_at("_parts", -1))
    parent = F.regexp_replace(F.regexp_replace("path", r"(\[\])*$", ""), r"(^|\.)[^.]*$", "")
    keys = named.filter(~F.col("path").endswith("[]")).select(parent.alias("path"), "_name").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("_name")), ",").alias("_keys"))
    objects = named.filter("kind = 'object'").join(keys, "path").withColumn("path", F.regexp_replace("path", r"(\[\])+$", ""))
    types = objects.groupBy("_name", "_keys").agg(F.collect_set("path").alias("paths")).filter(F.size("paths") > 1)
    shared = types.select(F.explode("paths").alias("path"), F.col("_name").alias("name"))
    own = F.col("_name")
    recursive = named.filter("kind = 'object'").filter(F.size(F.filter("_parts", lambda x: x == own)) > 1).select(F.regexp_replace("path", r"(\[\])+$", "").alias("path"), F.col("_name").alias("name"))
    rows = repeated.unionByName(shared).unionByName(recursive).groupBy("path").agg(F.max("name").alias("name")).collect()
    return TablePlan({r.path for r in rows}, {r.path: r.name for r in rows if r.name is not None})


def shred_value(value: object, plan: TablePlan, wanted: Callable[[str], bool] | None = None) -> list[tuple[str, list[int], list[tuple[str, str, str, str | None]]]]:
    """All rows of one record: (path, positions, cells). With ``wanted`` only cells whose full path it accepts, and their rows."""
    cells: dict[tuple[str, tuple[int, ...]], list] = defaultdict(list)
    rows: list[tuple[str, tuple[int, ...]]] = [("", ())]
    # (value, full path, path of the owning table, path within it, positions)
    stack: list[tuple[object, str, str, str, tuple[int, ...]]] = [(value, "", "", "", ())]
    while stack:
        v, path, table, inner, pos = stack.pop()
        if path in plan.repeated and not (table == path and inner == ""):
            several = isinstance(v, list)
            items = v if several else [] if v is None else [v]
            for k in range(len(items) - 1, -1, -1):
                rows.append((path, (*pos, k)))
                stack.append((items[k], path + "[]" if several else path, path, "", (*pos, k)))
            continue
        if isinstance(v, dict):
            for k in reversed(list(v)):
                name = key_name(k)
                stack.append((v[k], f"{path}.{name}" if path else name, table, f"{inner}.{name}" if inner else name, pos))
        elif isinstance(v, list):  # not in the plan's records: kept as rows of a table of its own
            for k in range(len(v) - 1, -1, -1):
                rows.append((path, (*pos, k)))
                stack.append((v[k], path + "[]", path, "", (*pos, k)))
        elif wanted is None or wanted(path):
            cells[table, pos].append((inner, path, kind_of(v), scalar_text(v)))
    if wanted is not None:
        return [(path, list(pos), found) for (path, pos), found in cells.items()]
    return [(path, list(pos), cells.get((path, pos), [])) for path, pos in rows]


def shred(df: DataFrame, id_col: str, json_col: str, plan: TablePlan, root: str | None = None, tables: list[str] | None = None, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """Rows of every table of ``plan`` (or only of ``tables``): id, table_name, path, pos, parent_path, cells.

    The parent row of a row has the same id, the path ``parent_path`` and the positions without the last one.
    """
    named = set(tables) if tables is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parents: dict[str, str] = {}
        for batch in batches:
            ids, rows = [], []
            for key, payload in zip(batch["_id"], batch["_json"], strict=True):
                value = unwrap(decode(payload), root)
                if value is None:
                    continue
                for path, pos, cells in shred_value(value, plan, wanted):
                    if named is not None and plan.table(path) not in named:
                        continue
                    if path not in parents:
                        parents[path] = plan.parent(path)
                    ids.append(key)
                    rows.append((plan.table(path), path, pos, parents[path], [dict(zip(CELL.names, c, strict=True)) for c in cells]))
                    if len(rows) >= 20_000:
                        yield frame(ids, rows)
                        ids, rows = [], []
            if rows:
                yield frame(ids, rows)

    def frame(ids: list, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[f.name for f in SHRED_FIELDS])
        out.insert(0, "_id", pd.Series(ids, dtype="object"))
        return out

    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), *SHRED_FIELDS])
    return df.select(F.col(id_col).alias("_id"), F.col(json_col).alias("_json")).mapInPandas(run, schema).withColumnRenamed("_id", id_col)


def flat_table(shredded: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One flat table: id, path, pos, parent_path and the given inlined columns; several equal keys of one object keep the last."""
    as_map = F.map_from_entries(F.transform(F.array_distinct(F.transform("cells", lambda c: c["path"])), lambda p: F.struct(p.alias("key"), F.element_at(F.filter("cells", lambda c: c["path"] == p), -1)["val"].alias("value"))))
    own = shredded.filter(F.col("table_name") == table)
    keep = [c for c in shredded.columns if c not in ("cells", "table_name")]
    return own.withColumn("_m", as_map).select(*keep, *[F.try_element_at("_m", F.lit(c)).alias(c.replace(".", "_")) for c in columns])


def not_blank(value: Column) -> Column:
    return value.isNotNull() & (F.length(F.translate(value, WHITE, "")) > 0)


LINKS = "results[].links.internal"
#: Full paths of internal link targets, as an entry's member or as a plain entry, in an array or alone.
TARGETS = (f"{LINKS}[].href", f"{LINKS}.href", f"{LINKS}[]", LINKS)


def crawl_tables(df: DataFrame, id_col: str = "crawl_id", json_col: str = "payload", wanted: Callable[[str], bool] | None = None) -> tuple[TablePlan, DataFrame]:
    """The plan for crawl payloads and their shredded rows; a payload without ``results`` is its own only result."""
    plan = plan_tables(schema_graph(df, json_col, root="results"))
    plan.repeated.add("results")  # also where no record is valid
    return plan, shred(df, id_col, json_col, plan, root="results", wanted=wanted)


def crawl_fields(df: DataFrame, id_col: str = "crawl_id", json_col: str = "payload") -> DataFrame:
    """Internal link targets, titles and etags of crawl payloads, each tied to its crawl, result and position.

    Columns: id, result_pos, path, link_pos (-1 for title and etag), val. Values are read from the planned tables by
    their full path, wherever the plan puts them. Only non-blank JSON strings give rows; results that are not objects
    give none but count as positions; an array where a result, link, title, href or etag is expected gives no row.
    """
    head, title = "results[].response_headers.", "results[].metadata.title"

    def wanted(path: str) -> bool:
        return path in TARGETS or path == title or (path.startswith(head) and path.lower() == head + "etag")

    plan, rows = crawl_tables(df, id_col, json_col, wanted)
    level = plan.level(LINKS)
    cell = rows.select(id_col, "pos", F.explode("cells").alias("c")).filter((F.col("c.kind") == "string") & not_blank(F.col("c.val")))
    path = F.when(F.col("c.full").isin(*TARGETS), "links.internal.href").when(F.col("c.full") == title, "metadata.title").otherwise("response_headers.etag")
    link_pos = F.when(path == "links.internal.href", F.lit(0) if level is None else F.col("pos")[level]).otherwise(-1)
    return cell.select(id_col, F.col("pos")[0].alias("result_pos"), path.alias("path"), link_pos.cast("int").alias("link_pos"), F.col("c.val").alias("val"))


def crawl_bodies(df: DataFrame, id_col: str = "crawl_id", json_col: str = "payload") -> DataFrame:
    """id, result_pos and ``body`` of every result that has one: markdown.fit_markdown, or markdown if that is a string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload in zip(batch["_id"], batch["_json"], strict=True):
                value = unwrap(decode(payload), "results")
                for k, result in enumerate(value["results"] if value is not None else ()):
                    markdown = result.get("markdown") if isinstance(result, dict) else None
                    body = markdown.get("fit_markdown") if isinstance(markdown, dict) else markdown
                    if isinstance(body, str):
                        rows.append((key, k, body))
            yield pd.DataFrame(rows, columns=[id_col, "result_pos", "body"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("result_pos", T.IntegerType()), T.StructField("body", T.StringType())])
    return df.select(F.col(id_col).alias("_id"), F.col(json_col).alias("_json")).mapInPandas(run, schema)
