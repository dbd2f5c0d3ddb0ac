"""Document transforms: named functions of a document, in sequence, each failure kept to its row."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Transform = Callable[[dict], dict]
SCHEMA = "doc_id string, text string, meta string, dropped boolean, error string"


class Transforms:
    """A closed set of functions, called by their exact names."""

    def __init__(self, **functions: Transform):
        self.functions = functions

    def names(self) -> list[str]:
        return sorted(self.functions)

    def run(self, docs: DataFrame, *names: str) -> DataFrame:
        """Documents (doc_id, text, meta as JSON) after the named functions, each of which takes {id, text, meta} and returns
        some of {text, meta, drop}.  Without meta the old stays; an empty text is an error unless dropped."""
        unknown = [n for n in names if n not in self.functions]
        if unknown:
            raise KeyError(f"unknown transforms: {unknown}")
        steps = [self.functions[n] for n in names]

        def one(doc_id, text, meta):
            try:
                for step in steps:
                    out = step({"id": doc_id, "text": text, "meta": json.loads(meta) if meta else {}})
                    if out.get("drop"):
                        return text, meta, True, None
                    text = out.get("text", "")
                    if not text:
                        return None, meta, False, "no text"
                    if out.get("meta") is not None:
                        meta = json.dumps(out["meta"], sort_keys=True)
            except Exception as e:
                return None, meta, False, f"{type(e).__name__}: {e}"
            return text, meta, False, None

        def run(batches):
            for b in batches:
                ids, texts, metas = (b.column(c).to_pylist() for c in ("doc_id", "text", "meta"))
                rows = [one(*r) for r in zip(ids, texts, metas)]
                columns = list(zip(*rows)) or [()] * 4
                kinds = [pa.string(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "text", "meta", "dropped", "error"])

        return docs.selectExpr("cast(doc_id as string) doc_id", "text", "meta").mapInArrow(run, SCHEMA)
