"""Spans in texts: one pass of a Python finder over Arrow batches, and the columns that describe them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.hashing import parts
from heliospark.llm.shared import fresh

#: start and end count code points; end is exclusive.
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

Finder = Callable[[str], list[tuple[str, int, int]]]


def find(docs: DataFrame, finder: Finder, columns: list[str], text: str = "text", rewrite: Callable[[str, list], str] | None = None) -> DataFrame:
    """columns of docs and, last, __hs_spans (with more underscores, if docs has such a column): the finder's spans of the text (null: empty); rewrite, if given, replaces the text."""
    into = fresh("__hs_spans", docs.columns)
    read = list(dict.fromkeys([*columns, text]))
    kept = docs.select(*[F.col(f"`{c}`") for c in read])
    out = T.StructType([*[kept.schema[c] for c in columns], T.StructField(into, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, read.index(text))):
            texts = b.column(read.index(text)).to_pylist()
            spans = [finder(t) if t else [] for t in texts]
            cols = [b.column(read.index(c)) for c in columns]
            if rewrite and text in columns:
                cols[columns.index(text)] = pa.array([rewrite(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            cols.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], ARROW_SPANS))
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, into])

    return kept.mapInArrow(run, out)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def count(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, [kind])).cast("long")
