"""The command line: ``python -m weftline VERB ...``.

Schemas are files: JSON Schema (``.json``), Avro (``.avsc``), SQL (``.sql``), or a Parquet path, whose columns are read. Data are Parquet
paths or folders of JSON lines. Exit code 1 means that a check found something.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions import evaluate, parse
from .plans.compare import classify, compatible, diff, report_json, report_text
from .plans.lens_text import auto_steps, compile_document
from .operators.transforms import select
from .schema import Schema, validate
from .sources import languages


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def schema_of(path: str, root: str) -> Schema:
    if path.endswith(".avsc"):
        return languages.read_avro(_text(path))
    if path.endswith(".sql"):
        return languages.read_sql(_text(path))
    if path.endswith(".json"):
        return languages.read_json_schema(_text(path), root)
    return languages.from_struct(_spark().read.parquet(path).schema, root)


def _data(path: str):
    return _spark().read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else _spark().read.parquet(path)


def check(a) -> int:
    """The changes from one schema to another, and which of them break."""
    found = classify(diff(schema_of(a.old, a.root), schema_of(a.new, a.root)))
    print(report_json(found) if a.json else report_text(found))
    return 0 if compatible(found) else 1


def show(a) -> int:
    print(json.dumps(schema_of(a.schema, a.root).to_dict(), indent=1, sort_keys=True, default=str))
    return 0


def validate_schema(a) -> int:
    s = schema_of(a.schema, a.root)
    wrong = validate(s, languages.PROTOCOLS.get(s.protocol) or languages.PROTOCOLS["jsonschema"])
    print("\n".join(wrong) or "valid")
    return 1 if wrong else 0


def convert(a) -> int:
    """Data through a lens document, or through the steps that lead from the data's own schema to another."""
    df = _data(a.data)
    if a.lens:
        steps = compile_document(_text(a.lens)).transforms
    else:
        steps = auto_steps(languages.from_struct(df.schema, a.root), schema_of(a.to, a.root), a.root)
    out = select(df, steps)
    (out.write.json if a.format == "json" else out.write.parquet)(a.out)
    return 0


def expression(a) -> int:
    print(json.dumps(evaluate(parse(a.text), json.loads(a.env))))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    p.add_argument("--root", default="root", help="the name of a record type's vertex")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *args: str):
        v = verbs.add_parser(name, help=(run.__doc__ or "").strip() or None)
        for x in args:
            v.add_argument(x)
        v.set_defaults(run=run)
        return v

    verb("check", check, "old", "new").add_argument("--json", action="store_true")
    verb("schema", show, "schema")
    verb("validate", validate_schema, "schema")
    c = verb("convert", convert, "data", "out")
    how = c.add_mutually_exclusive_group(required=True)
    how.add_argument("--lens")
    how.add_argument("--to")
    c.add_argument("--format", choices=["parquet", "json"], default="parquet")
    verb("eval", expression, "text").add_argument("--env", default="{}")
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
