"""SQL: one block per statement, plus the table and kind enrichments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import sql_ends as E
from codeloom.functions.nesting import running_before
from codeloom.functions.sql_ends import ends_of_statements
from codeloom.functions.text import distinct_matches, join_slice, newlines, strip
from codeloom.operators.extract.common import (
    carried,
    explode_spans,
    finish,
    line_counts,
    tokens,
)

# Words that make a statement a definition, and the clauses whose
# next word is a table name.
DEFINITION_WORDS = ["CREATE", "ALTER", "DROP"]
TABLE_PATTERN = r"(?iU)\b(?:FROM|JOIN|INTO|UPDATE)\s+([\w#]+)"

_COMMENT = r"(?:--[^\n]*+|/\*(?s:.*?)(?:\*/|\z))"
_QUOTED = r"""(?:'(?:[^']|'')*+'|"(?:[^"]|"")*+"|`[^`]*+`|\$(\w*+)\$(?s:.*?)\$\{tag}\$)"""
_GAP = rf"(?:\s++|{_COMMENT})"


def _quoted(group: int) -> str:
    return _QUOTED.replace("{tag}", str(group))


_WORD_END = r"(?![\w#@$])"
# Fixed values of SQL dialects: words that begin statements, and parts of routines.
_VERBS = (
    "CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE|MERGE|TRUNCATE|GRANT|REVOKE|WITH|EXECUTE|EXEC|CALL|"
    "USE|SET|COMMIT|ROLLBACK|COMMENT|ANALYZE|EXPLAIN|RENAME|PRINT"
)
_ROUTINE = (
    r"CREATE\s++(?:OR\s++(?:REPLACE|ALTER)\s++)?(?:DEFINER\s*+=\s*+\S++\s++|EDITIONABLE\s++|NONEDITIONABLE\s++)?"
    rf"(?:PROCEDURE|PROC|FUNCTION|TRIGGER|PACKAGE){_WORD_END}|DECLARE{_WORD_END}"
)
_INNER_END = rf"END\s++(?:IF|LOOP|WHILE|FOR|REPEAT){_WORD_END}"
_TRANSACTION = rf"BEGIN\s++(?=;)|BEGIN\s++(?:TRANSACTION|TRAN|WORK|DISTRIBUTED|DEFERRED|IMMEDIATE|EXCLUSIVE){_WORD_END}"
_BREAK = r"[ \t]*+(?:GO(?:[ \t]++\d++)?+|/)[ \t]*+\r?"
_SEPARATOR = rf"(?m:^){_BREAK}(?:\n|\z)"
# Pieces of a text with bodies or separator lines; only a separator ends in a line break
# without being one, or is the last piece.
PIECE = (
    rf"(?i){_COMMENT}|{_quoted(1)}|{_SEPARATOR}|\n|[^\S\n]++|(?<![\w#@$])(?:{_ROUTINE}|{_INNER_END}|{_TRANSACTION}|[\w#@$]++)"
    r"|;|[^\s\w#@$;'\"`/-]++|(?s:.)"
)
HAS_BODIES = rf"(?i)(?<![\w#@$])BEGIN{_WORD_END}|{_SEPARATOR}"

STATEMENT = rf"(?:[^;'\"`$/-]++|{_COMMENT}|{_quoted(1)}|['\"`$/-])++|;"


def classify_sql(statement: Column) -> Column:
    """``ddl_statement`` for definitions, ``dml_statement`` for everything else."""
    head = F.upper(strip(statement))
    starts = [head.startswith(word) for word in DEFINITION_WORDS]
    return F.when(starts[0] | starts[1] | starts[2], "ddl_statement").otherwise("dml_statement")


def sql_tables(query: Column) -> Column:
    """Upper-cased words after FROM, JOIN, INTO or UPDATE; distinct, in order."""
    return F.array_distinct(F.transform(distinct_matches(query, TABLE_PATTERN), F.upper))


def tag_dialect(df: DataFrame, dialect: str = "unknown") -> DataFrame:
    """Put the configured dialect on all SQL blocks; other blocks have none."""
    return df.withColumn("sql_dialect", F.when(F.col("language") == "sql", F.lit(dialect)))


def _code(token: Column, after: Column) -> Column:
    """Code of a piece, by the piece ``after`` it, for :func:`ends_of_statements`."""
    is_last = after.isNull()
    word = F.upper(token)
    return (
        F.when(token == ";", E.SEMICOLON)
        .when(word.isin("BEGIN", "CASE") & ~after.eqNullSafe(";"), E.OPEN)
        .when(word == "END", E.CLOSE)
        .when(word.isin(_VERBS.split("|")), E.VERB)
        .when(token.rlike(rf"(?i)\A{_BREAK}\n\z") | (is_last & token.rlike(rf"(?i)\A{_BREAK}\z")), E.SEPARATOR)
        .when(token.rlike(rf"(?i)\A(?:{_ROUTINE})\z"), E.HEAD)
        .when(token.rlike(rf"\A{_GAP}++\z"), E.GAP)
        .otherwise(E.OTHER)
    )


def sql_blocks(
    files: DataFrame, sql_dialect: str = "unknown", keep_empty: bool = False
) -> DataFrame:
    """Top-level statements; comments around a statement and the ``;`` are not part of it.

    The body of a routine is part of it, and a line with only GO or / separates batches.
    """
    keep = carried(files)
    # Only a text with bodies or separator lines is cut word by word.
    pieces = F.when(F.col("text").rlike(HAS_BODIES), tokens(F.col("text"), PIECE)).otherwise(
        tokens(F.col("text"), STATEMENT)
    )
    toks = F.col("__toks")
    cut = files.select(*keep, pieces.alias("__toks")).select(
        *keep,
        "__toks",
        running_before(line_counts(toks)).alias("__line"),
        ends_of_statements(F.transform(toks, lambda t, i: _code(t, F.get(toks, i + 1)))).alias("__ends"),
    )
    ends = cut.select(
        *keep,
        "__toks",
        "__line",
        F.concat(
            F.array(F.lit(-1)),
            F.filter(F.transform("__ends", lambda e, i: F.when(e > 0, i)), lambda i: i.isNotNull()),
            F.array(F.size("__toks")),
        ).alias("__at"),
    )

    def statement(end: Column, k: Column) -> Column:
        begin = F.get("__at", k) + 1  # ``end`` is the element after
        return F.struct(join_slice(toks, begin, end - 1, "").alias("raw"), F.get("__line", begin).alias("line"))

    spans = ends.select(
        *keep,
        F.filter(
            F.transform(F.slice("__at", 2, F.size("__at") - 1), statement),
            lambda s: ~s["raw"].rlike(rf"\A{_GAP}*+\z"),
        ).alias("__spans"),
    )
    rows = explode_spans(spans, "__spans", keep_empty)
    raw = F.col("__span.raw")
    lead = F.regexp_extract(raw, rf"\A{_GAP}*+", 0)
    solid = rf"(?:[^\s'\"`$/-]++|{_quoted(2)}|(?!{_COMMENT})['\"`$/-])"
    placed = rows.select(
        *keep,
        "ordinal",
        F.regexp_extract(raw, rf"\A{_GAP}*+((?:{_GAP}*+{solid})*+)", 1).alias("content"),
        (F.col("__span.line") + newlines(lead) + 1).alias("start_line"),
    )
    content = F.col("content")
    present = content.isNotNull()
    blocks = finish(
        placed,
        keep,
        node_type=F.when(present, F.lit("statement")),
        language=F.when(present, F.lit("sql")),
        content=content,
        start_line=F.col("start_line"),
        end_line=F.col("start_line") + newlines(content),
        block_type=F.when(present, classify_sql(content)),
    )
    return tag_dialect(blocks, sql_dialect).select(blocks.columns)
