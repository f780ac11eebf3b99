"""Readers and writers by protocol name.

A codec reads a DataFrame of texts (``value``, one row per document or line) into records or tables, and writes
them back. Formats that Spark cannot read become JSON text on the way, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import Schema
from . import records
from .languages import PROTOCOLS, LanguageError


def to_json_text(df: DataFrame, column: str, form: str) -> DataFrame:
    """``df`` with ``column`` turned from YAML or TOML into JSON text; text that does not parse becomes null."""
    if form not in ("yaml", "toml"):
        raise LanguageError(f"no such form: {form}")
    names = df.columns

    def run(batches):
        if form == "yaml":
            import yaml

            load = yaml.safe_load
        else:
            import tomllib

            load = tomllib.loads

        def convert(text):
            try:
                return None if text is None else json.dumps(load(text), default=str)
            except Exception:  # of either reader: the row says so by its null
                return None

        for b in batches:
            cols = [pa.array([convert(t) for t in b.column(c).to_pylist()], pa.string()) if c == column else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, df.schema)


@dataclass(frozen=True)
class Codec:
    """``parse`` takes texts and a schema's root; ``emit`` gives texts."""

    name: str
    shape: str
    parse: Callable
    emit: Callable


def _json(name: str) -> Codec:
    return Codec(name, "tree", lambda df, schema, root: records.parse_json(df, "value", schema, root), lambda df: records.emit_json(df).select("json"))


def _via(name: str, form: str) -> Codec:
    return Codec(name, "tree", lambda df, schema, root: records.parse_json(to_json_text(df, "value", form), "value", schema, root), lambda df: records.emit_json(df).select("json"))


def _xml(name: str) -> Codec:
    return Codec(name, "tree", lambda df, schema, root: records.parse_xml(df, "value", schema.struct(root).simpleString()[7:-1].replace(":", " "), root), lambda df: records.emit_xml(df).select("xml"))


def _table(name: str, sep: str) -> Codec:
    return Codec(name, "tables", lambda df, schema, root: records.split_table(df, [e.label for e in schema.outgoing(root)], sep), lambda df: records.emit_table(df, sep))


def _conllu(name: str) -> Codec:
    return Codec(name, "tables", lambda df, schema=None, root=None: records.parse_conllu(df, df.columns[0], "value"), lambda pair: records.emit_conllu(*pair))


class Registry:
    """Codecs by protocol; new ones may be added."""

    def __init__(self):
        self.codecs: dict[str, Codec] = {"yaml": _via("yaml", "yaml"), "toml": _via("toml", "toml"), "json": _json("json"), "xml": _xml("xml"), "csv": _table("csv", ","), "tsv": _table("tsv", "\t")}
        for p in PROTOCOLS.values():
            if p.reader == "json":
                self.codecs[p.name] = _json(p.name)
            elif p.reader == "xml":
                self.codecs[p.name] = _xml(p.name)
            elif p.reader == "conllu":
                self.codecs[p.name] = _conllu(p.name)
            elif p.reader == "csv":
                self.codecs[p.name] = _table(p.name, ",")
            elif p.reader == "tsv":
                self.codecs[p.name] = _table(p.name, "\t")
            elif p.reader and p.reader.startswith("table:"):
                self.codecs[p.name] = _table(p.name, {"space": " "}.get(p.reader[6:], p.reader[6:]))

    def register(self, c: Codec) -> None:
        self.codecs[c.name] = c

    def names(self) -> list[str]:
        return sorted(self.codecs)

    def codec(self, name: str) -> Codec:
        if name not in self.codecs:
            raise LanguageError(f"no reader for {name}")
        return self.codecs[name]

    def parse(self, name: str, texts: DataFrame, schema: Schema | None = None, root: str | None = None):
        return self.codec(name).parse(texts, schema, root)

    def emit(self, name: str, data) -> DataFrame:
        return self.codec(name).emit(data)


def files(spark: SparkSession, path: str) -> DataFrame:
    """A folder's files, one row each."""
    return spark.read.text(path, wholetext=True)
