"""CFML: component, function and query blocks, and the SQL inside queries.

A block is a run of whole lines, so the file becomes an array of lines of
which only the few with an opening or closing tag are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.nesting import last_marked, next_known
from codeloom.functions.text import join_slice, none_if_blank, none_if_empty, stem, strip
from codeloom.operators.extract.common import carried, explode_spans, finish
from codeloom.operators.extract.sql import sql_tables

# The tags that make blocks, in the order they are looked for on
# a line, and the patterns of component references and query text.
TAGS = ["cfcomponent", "cffunction", "cfquery"]
INVOKE_PATTERN = r"""(?iU)<cfinvoke[^>]+component\s*=\s*["']([^"']+)["']"""
NEW_PATTERN = r"(?U)\bnew\s+([\w.]+)\s*\("
QUERY_TEXT_PATTERN = r"(?is)<cfquery[^>]*>(.*?)</cfquery>"
QUERY_END_PATTERN = r"(?is)>(.*?)</cfquery"

_ATTRIBUTE = r"""[\w:.-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def cfml_calls(text: Column) -> Column:
    """Components invoked by tag, then those created by ``new``; distinct, in order."""
    invoked = F.regexp_extract_all(text, F.lit(INVOKE_PATTERN), F.lit(1))
    created = F.regexp_extract_all(text, F.lit(NEW_PATTERN), F.lit(1))
    return F.array_distinct(F.concat(invoked, created))


def cfml_attribute(text: Column, tag: str, name: str) -> Column:
    """Value of an attribute of the first ``tag`` in ``text``; empty if absent."""
    opening = F.regexp_extract(
        text, rf"""(?i)<{tag}\b((?:[^>"']|"[^"]*+"|'[^']*+')*+)""", 1
    )
    pairs = F.regexp_extract_all(opening, F.lit(_ATTRIBUTE), F.lit(0))
    named = F.filter(pairs, lambda p: F.lower(strip(F.split_part(p, F.lit("="), F.lit(1)))) == name)
    value = strip(F.regexp_replace(F.get(named, F.lit(0)), r"\A[^=]*+=", ""))
    return F.coalesce(F.btrim(value, F.lit("\"'")), F.lit(""))


def cfquery_text(block: Column) -> Column:
    """Text between the query tags of a block; empty if the query is not closed.

    A closing tag with blanks before its end is taken as well.
    """
    text = F.regexp_extract(block, QUERY_TEXT_PATTERN, 1)
    return F.when(text != "", text).otherwise(F.regexp_extract(block, QUERY_END_PATTERN, 1))


def _tag_lines(lines: Column) -> Column:
    """Lines with a tag of interest: row, opening tags, closing tags."""

    def look(line: Column, row: Column) -> Column:
        low = F.lower(line)
        return F.struct(
            row.alias("row"),
            *[low.rlike(rf"<{t}\b").alias(f"open_{t}") for t in TAGS],
            *[low.contains(f"</{t}>").alias(f"close_{t}") for t in TAGS],
        )

    flags = [f"{side}_{t}" for side in ("open", "close") for t in TAGS]

    def any_tag(m: Column) -> Column:
        hit = m[flags[0]]
        for flag in flags[1:]:
            hit = hit | m[flag]
        return hit

    return F.filter(F.transform(lines, look), any_tag)


def _opened(marks: Column, nearest: dict[str, Column]) -> Column:
    """Blocks in order of their lines: each opening tag with the nearest closing line, or its own."""

    def here(mark: Column, i: Column) -> Column:
        def block(tag: str) -> Column:
            end = F.get(nearest[tag], i)
            return F.when(
                mark[f"open_{tag}"],
                F.struct(
                    F.lit(tag).alias("tag"),
                    mark["row"].alias("first"),
                    F.when(end >= 0, end).otherwise(mark["row"]).alias("last"),
                ),
            )

        return F.filter(F.array(*map(block, TAGS)), lambda b: b.isNotNull())

    return F.flatten(F.transform(marks, here))


def cfml_blocks(
    files: DataFrame, sql_dialect: str = "unknown", keep_empty: bool = False
) -> DataFrame:
    """Tag blocks line by line; a query's own SQL follows it as a block of its own."""
    keep = carried(files)
    lines = F.col("__lines")

    def named(block: Column) -> Column:
        content = join_slice(lines, block["first"], block["last"], "\n")
        own = F.coalesce(
            none_if_blank(cfml_attribute(content, "cfcomponent", "displayname")),
            none_if_blank(cfml_attribute(content, "cfcomponent", "hint")),
            stem(F.col("file_path")),
        )
        return F.struct(
            *[block[c].alias(c) for c in ("tag", "first", "last")],
            content.alias("content"),
            F.when(block["tag"] == "cfcomponent", own).alias("named"),
        )

    marks, blocks = F.col("__marks"), F.col("__named")

    def closing_rows(tag: str) -> Column:
        return F.transform(marks, lambda m: F.when(m[f"close_{tag}"], m["row"]).otherwise(-1))

    paired = (
        files.select(*keep, F.split("text", "\n").alias("__lines"))
        .withColumn("__marks", _tag_lines(lines))
        .select(*keep, "__lines", "__marks", *[next_known(closing_rows(t)).alias(f"__next_{t}") for t in TAGS])
    )
    opened = _opened(marks, {t: F.col(f"__next_{t}") for t in TAGS})
    cut = paired.select(*keep, F.transform(opened, named).alias("__named"))
    scoped = cut.select(
        *keep, "__named", last_marked(F.transform(blocks, lambda b: b["named"].isNotNull().cast("int"))).alias("__scope")
    )

    def in_scope(block: Column, i: Column) -> Column:
        """The block with the name of the last component up to it, else the file's stem."""
        last = F.get("__scope", i)
        component = F.when(last >= 0, F.get(blocks, last)["named"]).otherwise(stem(F.col("file_path")))
        return F.struct(*[block[c].alias(c) for c in ("tag", "first", "last", "content")], component.alias("component"))

    found = scoped.select(*keep, F.transform(blocks, in_scope).alias("__blocks"))

    def with_query(block: Column) -> Column:
        text = F.when(block["tag"] == "cfquery", strip(cfquery_text(block["content"])))
        inner = F.struct(
            F.lit("sql_injection").alias("tag"),
            block["first"].alias("first"),
            block["last"].alias("last"),
            text.alias("content"),
            block["component"].alias("component"),
        )
        return F.when(text != "", F.array(block, inner)).otherwise(F.array(block))

    rows = explode_spans(
        found.select(*keep, F.flatten(F.transform("__blocks", with_query)).alias("__spans")),
        "__spans",
        keep_empty,
    )
    tag, content, component = (F.col(f"__span.{c}") for c in ("tag", "content", "component"))
    is_function = tag == "cffunction"
    is_sql = tag == "sql_injection"
    start = F.col("__span.first") + 1
    return finish(
        rows,
        keep,
        node_type=tag,
        language=F.when(is_sql, "sql").when(tag.isNotNull(), "cfml"),
        content=content,
        start_line=start,
        end_line=F.col("__span.last") + 1,
        component_name=F.when(tag != "cfquery", none_if_blank(component)),
        function_name=F.when(is_function, none_if_blank(cfml_attribute(content, "cffunction", "name"))),
        return_type=F.when(
            is_function, none_if_blank(cfml_attribute(content, "cffunction", "returntype"))
        ),
        calls_components=F.when(is_function, none_if_empty(cfml_calls(content))),
        tables=F.when(is_sql, none_if_empty(sql_tables(content))),
        sql_dialect=F.when(is_sql, F.lit(sql_dialect)),
        injection_source_line=F.when(is_sql, start),
    )
