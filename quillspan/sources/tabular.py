"""Strict and lenient readers, and the identifiers inside JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BOM = "﻿"


class SchemaError(ValueError):
    """A file's header or rows are not as stated."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file whose header equals the schema's names in order; any short, long or unreadable row is an error.
    Blank lines of text are kept as empty strings."""
    header = spark.read.text(path).limit(1).collect()
    names = [n.strip('"') for n in header[0][0].split(",")] if header else []
    if names != schema.names:
        raise SchemaError(f"the header is {names}, not {schema.names}")
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"', multiLine=True, emptyValue="")
    return df.select(*[F.coalesce(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema])


def read_csv_loose(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as strings, whatever its header; a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip(BOM).strip('"') for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a stated schema."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")


def read_identities(spark: SparkSession, path: str, fields: tuple[str, ...] = ("document_id", "group_id"), strict: bool = False) -> DataFrame:
    """Only some fields of a JSON array or of JSON lines; other values are skipped by the parser and never built.

    With ``strict`` each file is one JSON value, read by ``project_json`` in one task, and any fault is an error; a file
    must fit a row (2 GB)."""
    if not strict:
        return spark.read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).json(path, multiLine=True, mode="FAILFAST")
    found = project_json(spark.read.text(path, wholetext=True), "value", fields)
    refused = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("JSON is refused: "), "fault")))
    return found.withColumn(fields[0], F.coalesce(refused.cast("string"), fields[0])).select(*fields)


_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)(?![\w.+-])|(?P<mark>[][{},:])|(?P<end>\Z))"
)


class _Refused(ValueError):
    pass


def _items(text: str, fields: tuple[str, ...]) -> list[list[str | None]]:
    """The fields of each object of a JSON array, or of one object; what is not asked for is checked and passed over."""
    stack: list[str] = []
    out: list[list[str | None]] = []
    at, expected, top, held, key, begun = 0, "value", 0, {}, None, 0
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise _Refused("a token is malformed")
        at, kind, token = m.end(), m.lastgroup, m.group(m.lastgroup)
        if kind == "end":
            if expected != "end":
                raise _Refused("the text ends early")
            return out
        if expected == "end":
            raise _Refused("data after the value")
        closes = kind == "mark" and token in "]}"
        if closes:
            if not stack or (stack[-1] + token) not in ("[]", "{}") or not expected.endswith("close"):
                raise _Refused("a delimiter does not match")
            stack.pop()
        elif kind == "mark" and token == "," and expected == "comma or close":
            expected = "key" if stack[-1] == "{" else "value"
            continue
        elif kind == "mark" and token == ":" and expected == "colon":
            expected = "value"
            continue
        elif kind == "string" and expected in ("key", "key or close"):
            if len(stack) == top:
                key = json.loads(token)
                if key in held:
                    raise _Refused("a key is repeated")
                held[key] = None
            expected = "colon"
            continue
        elif expected not in ("value", "value or close") or (kind == "mark" and token not in "[{"):
            raise _Refused("a token is out of place")
        elif kind == "mark":
            if len(stack) == top:
                begun = m.start("mark")
            stack.append(token)
            if len(stack) == 1:
                top = 1 if token == "{" else 2
            if token == "[" and len(stack) == 2 and top == 2:
                raise _Refused("an item is not an object")
            expected = "key or close" if token == "{" else "value or close"
            continue
        # a value has ended: a scalar, or what the delimiter closed
        if len(stack) == top and top and not (closes and token == "}" and key is None):
            if key in fields:
                held[key] = text[begun:at] if closes else json.loads(token) if kind == "string" else None if token == "null" else token
        elif closes and len(stack) == top - 1 and token == "}":
            if any(f not in held for f in fields):
                raise _Refused("a field is missing")
            out.append([held[f] for f in fields])
            held, key = {}, None
        elif not closes and len(stack) < max(top, 1):
            raise _Refused("an item is not an object")
        expected = "comma or close" if stack else "end"


def project_json(df: DataFrame, column: str, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, item, ``fields``, fault): one row per object of each JSON text, an array of objects or one object.

    Strings come decoded, other scalars and nested values as written, null as null. Nothing else is built, but all is
    checked: a text with malformed tokens, unmatched delimiters, a repeated key or a missing field of an item, an item that is no
    object, or data after its value gives one row that names the fault, and none of its items. A null text ends early; an empty array gives no row.
    """
    names = [*keep, "item", *fields, "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            place, item, values, fault = [], [], [], []
            for i, x in enumerate(b.column("_json")):
                try:
                    found, why = _items(x.as_py() or "", fields), None
                except _Refused as e:
                    found, why = [[None] * len(fields)], str(e)
                for n, v in enumerate(found):
                    place.append(i), item.append(n), values.append(v), fault.append(why)
            columns = [pa.array([v[j] for v in values], pa.string()) for j in range(len(fields))]
            held = [b.column(i).take(pa.array(place, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*held, pa.array(item, pa.int32()), *columns, pa.array(fault, pa.string())], names)

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("string").alias("_json"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1]
    return rows.mapInArrow(run, ", ".join([*kinds, "item int", *[f"`{f}` string" for f in fields], "fault string"]))


def collect_ids(df: DataFrame, column: str, name: str = "document_id") -> DataFrame:
    """(id): every string under the key ``name`` at any depth of a JSON column. Keys and strings of JSON are
    matched with their escapes, so a value that contains the key's text is not taken for one."""
    found = F.regexp_extract_all(F.col(column), F.lit(rf'(?s)"(?:[^"\\]|\\.)*"(?:\s*:\s*"(?:[^"\\]|\\.)*")?'), F.lit(0))
    pair = F.explode(F.filter(found, lambda x: x.rlike(rf'^"{name}"\s*:')))
    value = F.regexp_extract(F.col("x"), rf'(?s)^"{name}"\s*:\s*("(?:[^"\\]|\\.)*")$', 1)
    return df.select(pair.alias("x")).select(F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"].alias("id")).where("id is not null").distinct()


def write_parquet(df: DataFrame, path: str) -> None:
    """zstd Parquet; an existing path is an error."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv_ordered(df: DataFrame, path: str, order: str) -> None:
    """One CSV file with a header, rows in order; the order column is left out."""
    df.orderBy(order).drop(order).coalesce(1).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')
