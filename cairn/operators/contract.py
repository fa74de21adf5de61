"""Dynamic schemas: checking them, checking values, scalar leaves as JSON pointers, evidence for each leaf."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORDS = {"type", "properties", "required", "items", "description", "enum"}
TYPES = ("object", "array", "string", "number", "integer", "boolean")
MAX_DEPTH, MAX_PROPERTIES, MAX_BYTES, MAX_ENUM, MAX_DESCRIPTION = 5, 32, 16_384, 32, 1024
PROPERTY = re.compile(r"[^\x00-\x1f]{1,128}")


def check_schema(schema: object) -> None:
    """Raises ValueError for schemas outside the supported subset (sizes count over the whole schema)."""
    if not isinstance(schema, dict) or len(json.dumps(schema, ensure_ascii=False, separators=(",", ":")).encode()) > MAX_BYTES:
        raise ValueError("no schema object, or too large")
    if schema.get("type") != "object":
        raise ValueError("the root is no object")
    properties = 0
    nodes: list[tuple[object, int]] = [(schema, 1)]
    while nodes:
        node, depth = nodes.pop()
        if depth > MAX_DEPTH or not isinstance(node, dict) or set(node) - KEYWORDS or node.get("type") not in TYPES:
            raise ValueError("unsupported schema")
        kind, text, choices = node["type"], node.get("description"), node.get("enum")
        if text is not None and not (isinstance(text, str) and len(text.encode()) <= MAX_DESCRIPTION):
            raise ValueError("bad description")
        if choices is not None and not (isinstance(choices, list) and 0 < len(choices) <= MAX_ENUM and kind not in ("object", "array") and all(matches(kind, x) for x in choices)):
            raise ValueError("bad enum")
        if (kind == "object") != ("properties" in node) or (kind != "object" and node.get("required")) or (kind == "array") != ("items" in node):
            raise ValueError("members do not fit the type")
        if kind == "array":
            nodes.append((node["items"], depth + 1))
        if kind == "object":
            own, required = node["properties"], node.get("required", [])
            if not isinstance(own, dict) or not all(isinstance(k, str) and PROPERTY.fullmatch(k) for k in own):
                raise ValueError("bad properties")
            if not isinstance(required, list) or len(set(map(str, required))) != len(required) or any(k not in own for k in required):
                raise ValueError("bad required")
            properties += len(own)
            if properties > MAX_PROPERTIES:
                raise ValueError("too many properties")
            nodes.extend((x, depth + 1) for x in own.values())


def matches(kind: str, value: object) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "number": number and math.isfinite(value), "integer": number and isinstance(value, int)}[kind]


def failures(schema: dict, value: object, most: int | None = None) -> list[tuple[str, str]]:
    """(pointer, code) of what is wrong with a value, in document order; the first ``most`` of them."""

    def found(s: dict, v: object, path: str) -> Iterator[tuple[str, str]]:
        if not matches(s["type"], v):
            yield path, "type_mismatch"
            return
        if "enum" in s and not any(type(v) is type(x) and v == x for x in s["enum"]):
            yield path, "enum_mismatch"
        if isinstance(v, dict):
            known = s.get("properties", {})
            yield from ((f"{path}/{pointer(k)}", "required_missing") for k in s.get("required", []) if k not in v)
            yield from ((f"{path}/{pointer(k)}", "additional_property") for k in v if k not in known)
            for k, child in known.items():
                if k in v:
                    yield from found(child, v[k], f"{path}/{pointer(k)}")
        elif isinstance(v, list) and "items" in s:
            for k, x in enumerate(v):
                yield from found(s["items"], x, f"{path}/{k}")

    return list(islice(found(schema, value, ""), most))


def pointer(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def leaves(value: object, limit: int | None = None) -> list[tuple[str, object]]:
    """Scalar leaves in document order as (JSON pointer, value)."""
    out: list[tuple[str, object]] = []

    def walk(v: object, path: str) -> None:
        if limit is not None and len(out) >= limit:
            return
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}/{pointer(k)}")
        elif isinstance(v, list):
            for k, x in enumerate(v):
                walk(x, f"{path}/{k}")
        else:
            out.append((path, v))

    walk(value, "")
    return out


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def supports(value: object, excerpt: str) -> bool:
    """Whether an excerpt states a scalar value."""
    text = _plain(excerpt)
    if value is None:
        return False
    if isinstance(value, bool):
        return any(re.search(rf"\b{w}\b", text) for w in (("true", "yes") if value else ("false", "no")))
    if isinstance(value, float) and value.is_integer():
        return any(re.search(rf"(?<![\d.]){re.escape(w)}(?![\d])", text) for w in (str(value), str(int(value))))
    return _plain(str(value)) in text and _plain(str(value)) != ""


def evidence_fields(df: DataFrame, id_col: str, data_col: str, evidence_col: str, markdown_col: str, schema: dict, most_fields: int | None = None) -> DataFrame:
    """Leaves with the position of their evidence in the Markdown; one failure voids a record (status per row)."""
    check_schema(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, data, proof, text in zip(b["_id"], b["_d"], b["_e"], b["_m"], strict=True):
                try:
                    value, excerpts = json.loads(data), json.loads(proof)
                except (TypeError, ValueError):
                    rows.append((key, None, None, None, "invalid_json"))
                    continue
                found = []
                bad = bool(failures(schema, value, 1)) or (most_fields is not None and len(leaves(value, most_fields + 1)) > most_fields)
                for path, v in leaves(value):
                    excerpt = excerpts.get(path) if isinstance(excerpts, dict) else None
                    at = (text or "").find(excerpt) if isinstance(excerpt, str) and excerpt else -1
                    bad |= at < 0 or not supports(v, excerpt or "")
                    found.append((key, path, json.dumps(v), at, "ok"))
                rows.extend([(key, None, None, None, "unsupported")] if bad else found)
            yield pd.DataFrame(rows, columns=[id_col, "pointer", "value", "start_index", "status"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(data_col).alias("_d"), F.col(evidence_col).alias("_e"), F.col(markdown_col).alias("_m")).mapInPandas(run, f"{id_col} {kind}, pointer string, value string, start_index int, status string")
