"""JSX and TSX: function declarations, arrow functions and elements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.jsx_scan import spans
from codeloom.functions.text import distinct_matches, none_if_blank, none_if_empty, strip
from codeloom.operators.extract.common import carried, explode_spans, finish

# Fixed value: the pattern of a hook call.
HOOK_PATTERN = r"(?U)\b(use[A-Z]\w*)\s*\("

_SPAN = T.StructType(
    [
        T.StructField("node_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)
_SCANNED = T.StructType(
    [T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("error", T.StringType())]
)
_SPAN_ARROW = pa.struct(
    [(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in _SPAN.fields]
)


@F.arrow_udf(_SCANNED)
def scan_files(texts: pa.Array) -> pa.Array:
    """Spans of each file; a file that cannot be read reports why and yields none."""
    found, errors = [], []
    for text in texts:
        try:
            found.append(spans(text.as_py() or ""))
            errors.append(None)
        except Exception as problem:  # one bad file must not fail the job
            found.append([])
            errors.append(f"{type(problem).__name__}: {problem}")
    return pa.StructArray.from_arrays(
        [pa.array(found, pa.list_(_SPAN_ARROW)), pa.array(errors, pa.string())],
        ["spans", "error"],
    )


def jsx_hooks(text: Column) -> Column:
    """Names of the hooks called in ``text``; distinct, in order."""
    return distinct_matches(text, HOOK_PATTERN)


def jsx_blocks(files: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Functions, arrows and elements at any depth, outer ones first."""
    keep = carried(files)
    found = F.col("__scan.spans")
    scanned = files.select(*keep, scan_files("text").alias("__scan")).select(
        *[c for c in keep if c != "error"],
        *([F.coalesce("error", "__scan.error").alias("error")] if "error" in keep else []),
        F.filter(found, lambda s: s["node_type"] != "import").alias("__spans"),
        none_if_empty(
            F.transform(
                F.filter(found, lambda s: s["node_type"] == "import"),
                lambda s: strip(s["content"]),
            )
        ).alias("imports"),
    )
    rows = explode_spans(scanned, "__spans", keep_empty)
    kind, content = F.col("__span.node_type"), F.col("__span.content")
    return finish(
        rows,
        keep,
        node_type=kind,
        language=F.when(kind.isNotNull(), F.lit("jsx")),
        content=content,
        start_line=F.col("__span.start_line"),
        end_line=F.col("__span.end_line"),
        imports=F.when(kind.isNotNull(), F.col("imports")),
        component_name=F.when(
            kind == "function_declaration", none_if_blank(F.col("__span.name"))
        ),
        hooks=F.when(kind != "jsx_element", none_if_empty(jsx_hooks(content))),
    )
