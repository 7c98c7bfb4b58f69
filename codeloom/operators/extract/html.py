"""HTML: top-level elements of a document.

The text is cut into tags and text by one expression; the tag names alone are
then paired with a stack, which gives the ranges of the outermost elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.nesting import running_before, top_level_spans
from codeloom.functions.text import join_slice, newlines
from codeloom.operators.extract.common import (
    carried,
    explode_spans,
    finish,
    line_counts,
    tokens,
)

# Fixed values of the HTML language: elements without content, and which
# children end an element whose end tag may be left out.
VOID = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
    "source", "track", "wbr",
]
PARAGRAPH_ENDS = [
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav",
    "ol", "p", "pre", "section", "table", "ul",
]
ENDED_BY = {
    "p": PARAGRAPH_ENDS,
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "rb": ["rb", "rt", "rp"],
    "rt": ["rb", "rt", "rp"],
    "rp": ["rb", "rt", "rp"],
    "optgroup": ["optgroup"],
    "tr": ["tr"],
    "td": ["td", "th", "tr"],
    "th": ["td", "th", "tr"],
}

_INSIDE = r"""(?:[^<>"']|"[^"]*+"|'[^']*+')*+"""
LEXER = (
    r"<!--(?s:.*?)(?:-->|\z)|<[!?][^>]*+>?+"
    r"|(?i:<(script|style)\b" + _INSIDE + r">(?s:.*?)(?:</\1\s*+>|\z))"
    r"|</?[A-Za-z]" + _INSIDE + r">|[^<]++|<"
)


_OUTERMOST = top_level_spans(ENDED_BY)


def _tag(token: Column) -> Column:
    """``name``, ``/name`` or ``name/`` of a tag token; empty for any other token."""
    name = F.lower(F.regexp_extract(token, r"\A<(/?[A-Za-z][^\s/>]*+)", 1))
    single = token.endswith("/>") | name.isin(VOID)
    return (
        F.when(~token.startswith("<") | token.rlike(r"(?i)\A<(script|style)\b"), "")
        .when(single & ~token.startswith("</"), F.concat(name, F.lit("/")))
        .otherwise(name)
    )


def html_blocks(files: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Elements directly below the document; nested ones are part of their content."""
    keep = carried(files)
    toks, line = F.col("__toks"), F.col("__line")
    cut = files.select(*keep, tokens(F.col("text"), LEXER).alias("__toks")).select(
        *keep,
        "__toks",
        running_before(line_counts(toks)).alias("__line"),
        _OUTERMOST(F.transform(toks, _tag)).alias("__found"),
    )

    def block(span: Column) -> Column:
        return F.struct(
            join_slice(toks, span["first"], span["last"], "").alias("content"),
            F.get(line, span["first"]).alias("before"),
        )

    rows = explode_spans(
        cut.select(*keep, F.transform("__found", block).alias("__spans")), "__spans", keep_empty
    )
    content, start = F.col("__span.content"), F.col("__span.before") + 1
    present = content.isNotNull()
    return finish(
        rows,
        keep,
        node_type=F.when(present, F.lit("element")),
        language=F.when(present, F.lit("html")),
        content=content,
        start_line=start,
        end_line=start + newlines(content),
    )
