"""Java: class and method blocks with dependency metadata.

Brackets are paired first and those inside others replaced, so that nesting of
any depth is one level to the patterns. One regular expression then cuts the file
into tokens in which a whole declaration header (modifiers, annotations, type,
name, parameters) is a single token; brace pairing gives each declaration its
end. All loops are possessive, so matching is linear and does not recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import brackets as B
from codeloom.functions.brackets import bracket_marks
from codeloom.functions.nesting import closing_partner, running_before
from codeloom.functions.text import (
    bind,
    join_slice,
    newlines,
    none_if_blank,
    none_if_empty,
    strip,
)
from codeloom.operators.extract.common import (
    carried,
    explode_spans,
    finish,
    line_counts,
    tokens,
)

# --- lexical pieces ---------------------------------------------------------
COMMENT = r"(?:/\*(?s:.*?)(?:\*/|\z)|//[^\n]*+)"
STRING = r'(?:"""(?:[^"\\]++|\\(?s:.)|"(?!""))*+"""|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)++\')'
GAP = rf"(?:\s++|{COMMENT})"
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_WORD_END = r"(?![\p{L}\p{N}_$])"

# --- brackets of any depth ----------------------------------------------------
# Before a file is cut, brackets that lie inside others are replaced by characters of
# their own, one for one, so that a pattern needs to know one level only. Unicode sets
# these characters (noncharacters) aside for use inside programs.
MARKS = "".join(map(chr, range(0xFDD1, 0xFDD9)))  # for marks 1 to 8 of functions/brackets
_BRACKETS = "((((()<>"
# Ranges, as single characters of a class beyond Latin-1 are tried one after the other.
_OUTER = f"(?:[({MARKS[0]}-{MARKS[1]}])"  # an opening parenthesis that lies in no other
_ANY = f"(?:[({MARKS[0]}-{MARKS[4]}])"
_BEFORE_MEMBER = f"[{MARKS[0]}{MARKS[3]}]"  # its partner is followed by a member call
_NO_HEADER = f"[({MARKS[0]}{MARKS[2]}-{MARKS[3]}]"  # its partner is not followed by a body
_ROUND = f"(){MARKS[0]}-{MARKS[5]}"

PARENS = rf"{_OUTER}(?:[^(){MARKS[0]}-{MARKS[1]}\"'/]++|{STRING}|{COMMENT}|/)*+\)"
_QUALIFIED = rf"@(?!interface{_WORD_END}){NAME}(?:\.{NAME})*+"
ANNOTATION = rf"{_QUALIFIED}(?:\s*+{PARENS})?+"
ANGLES = rf"<(?:[^<>{_ROUND}{{}};\"'/@]++|{COMMENT}|{ANNOTATION})*+>"

_PIECE = r"(?:[^()<>{};\"'/@-]++|-(?!>))++"
_MARKED = rf"{COMMENT}|{STRING}|{_QUALIFIED}\s*+(?=\()|->|[()<>{{}};]|{_PIECE}|(?s:.)"


def _codes(toks: Column) -> Column:
    """Codes of the pieces of a text, for :func:`bracket_marks`."""

    def follows(t: Column, before: Column) -> Column:
        return (
            F.when(t.rlike(r"\A\s++\z"), B.SPACE)
            .when(before.isin(")", ">") & t.rlike(rf"\A\s*+\.\s*+{NAME}\s*+\z"), B.MEMBER_NAME)
            .when((before == ")") & t.rlike(r"\A\s*+\.\s*+\z"), B.MEMBER_DOT)
            .when((before == ">") & t.rlike(rf"\A\s*+{NAME}\s*+\z"), B.NAME)
            .when((before.isin(")", ">") | before.startswith("/")) & t.rlike(rf"\A\s*+throws{_WORD_END}"), B.THROWS)
            .otherwise(B.OTHER)
        )

    def code(t: Column, before: Column) -> Column:
        bracket = F.instr(F.lit("()<>{};"), t)
        return (
            F.when(bracket > 0, bracket)
            .when(t.startswith("//") | t.startswith("/*"), B.SPACE)
            .when(F.substring(t, 1, 1).isin('"', "'", "/"), B.BARRED)
            .when(t.startswith("@"), F.when(t == "@", B.OTHER).otherwise(B.ANNOTATION))
            .otherwise(follows(t, before))
        )

    return F.transform(toks, lambda t, i: code(t, F.coalesce(F.get(toks, i - 1), F.lit(""))))


def with_marks(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add column ``name``: ``text`` with the brackets inside others replaced; :func:`plain` undoes it."""
    cut = df.select("*", tokens(text, _MARKED).alias("__pieces"))
    told = cut.select("*", bracket_marks(_codes(F.col("__pieces"))).alias("__told"))
    mark = lambda m: F.substring(F.lit(MARKS), m, F.lit(1))
    joined = F.array_join(F.zip_with("__pieces", "__told", lambda t, m: F.when(m > 0, mark(m)).otherwise(t)), "")
    return told.select("*", joined.alias(name)).drop("__pieces", "__told")


def plain(text: Column) -> Column:
    """Brackets again where :func:`with_marks` put other characters."""
    for mark, bracket in zip(MARKS, _BRACKETS, strict=True):
        text = F.replace(text, F.lit(mark), F.lit(bracket))
    return text


def plain_list(texts: Column) -> Column:
    return F.transform(texts, plain)


# Fixed values of the Java language.
MODIFIER = (
    "(?:public|protected|private|static|final|abstract|native|synchronized|"
    rf"transient|volatile|strictfp|default|sealed|non-sealed){_WORD_END}"
)
_RESERVED = (
    "return|new|throw|throws|else|case|assert|do|goto|import|package|instanceof|"
    "class|interface|enum|extends|implements|if|for|while|switch|try|catch|finally|"
    "break|continue|super|this|public|protected|private|static|final|abstract|native|synchronized|"
    "transient|volatile|strictfp|default"
)
RESERVED = rf"(?:{_RESERVED}){_WORD_END}"
NOT_A_TYPE = rf"(?:{_RESERVED}|record|yield|when|permits){_WORD_END}"
PRIMITIVES = ["byte", "short", "int", "long", "char", "float", "double", "boolean", "void"]

MODIFIERS = rf"(?:(?:{MODIFIER}|{ANNOTATION}){GAP}*+)*+"
TYPE = (
    rf"(?!{NOT_A_TYPE}){NAME}(?:\s*+{ANGLES})?+(?:\s*+\.\s*+{NAME}(?:\s*+{ANGLES})?+)*+"
    rf"(?:\s*+(?:{ANNOTATION}\s*+)?+\[\s*+\])*+"
)
METHOD = (
    rf"{MODIFIERS}(?:{ANGLES}{GAP}*+)?+(?:{ANNOTATION}{GAP}*+)*+{TYPE}{GAP}*+"
    rf"(?!{RESERVED}){NAME}{GAP}*+{PARENS}{GAP}*+(?:\[\s*+\]{GAP}*+)*+"
    rf"(?:throws{_WORD_END}(?:[^{{}};\"'/]++|{COMMENT})*+)?+"
)
CLASS = rf"{MODIFIERS}class\s{GAP}*+{NAME}(?:[^{{}};\"'/@{_ROUND}]++|{COMMENT}|{ANNOTATION})*+"
ANNOTATION_TYPE = rf"{MODIFIERS}@interface{_WORD_END}[^{{}};\"'/]*+"
FIELD = rf"{MODIFIERS}{TYPE}{GAP}*+(?!{RESERVED}){NAME}(?=\s*+(?:\[\s*+\]\s*+)*+[=;,])"
IMPORT = rf"import\s(?:[\p{{L}}\p{{N}}_$.*]++|{GAP})++;"

LEXER = (
    rf"{COMMENT}|{STRING}|\s++|{IMPORT}|{ANNOTATION_TYPE}(?=\{{)|{CLASS}(?=\{{)|{METHOD}(?=[{{;])"
    rf"|(?=@|{MODIFIER}){FIELD}|[{{}};:]|[^{{}};:\"'/]++|(?s:.)"
)

# Invocations, read left to right; only group 1 is a call (its text ends in a parenthesis).
_LINK = rf"{NAME}(?:\[[^\[\]{_ROUND}]*+\])*+\s*+\.\s*+(?:{ANGLES}\s*+)?+"
_CHAIN = rf"(?:{STRING}\s*+\.\s*+)?+(?:{_LINK})*{NAME}\s*+"
_CREATED = rf"new\s++{NAME}(?:\s*+\.\s*+{NAME})*+(?:\s*+{ANGLES})?+"
CALLS = (
    rf"{COMMENT}|@{NAME}(?:\.{NAME})*+|record\s++{NAME}\s*+{_ANY}|(?:this|super)\s*+{_ANY}"
    rf"|(?!new{_WORD_END}){RESERVED}(?!\s*+\.)"
    rf"|({_CREATED}\s*+{_BEFORE_MEMBER}|(?!new{_WORD_END}){_CHAIN}{_NO_HEADER}|{_BEFORE_MEMBER})"
    rf"|{_CREATED}|{STRING}|\.\s*+(?:{ANGLES}\s*+)?+{NAME}(?:\s*+{_ANY})?+|{NAME}"
)


def _without_comments(text: Column) -> Column:
    parts = tokens(text, rf"{STRING}|{COMMENT}|[^\"'/]++|(?s:.)")
    is_comment = lambda t: t.startswith("//") | t.startswith("/*")
    return F.array_join(F.transform(parts, lambda t: F.when(is_comment(t), " ").otherwise(t)), "")


def java_imports(toks: Column) -> Column:
    """Import statements as written; an empty list if there are none."""
    imports = F.filter(toks, lambda t: t.rlike(rf"\A{IMPORT}\z"))
    return F.transform(imports, strip)


def java_class_meta(header: Column) -> dict[str, Column]:
    """Name, simple super type and simple interfaces of a class header."""
    start = rf"\A{MODIFIERS}class\s++({NAME})(?:\s*+{ANGLES})?+"
    parent = F.regexp_extract(
        header, rf"{start}\s*+extends\s++(?:{ANNOTATION}\s*+)*+({NAME})(?!\s*+[.<])", 2
    )
    listed = F.regexp_extract(header, r"(?s)\simplements\s++(.*?)(?:\spermits\s.*)?\z", 1)
    flat = F.regexp_replace(F.regexp_replace(listed, ANGLES, "<>"), ANNOTATION, "")
    simple = F.filter(
        F.transform(F.split(flat, ","), strip), lambda t: t.rlike(rf"\A{NAME}\z")
    )
    return {
        "class_name": F.regexp_extract(header, start, 1),
        "extends": none_if_blank(parent),
        "implements": none_if_empty(simple),
    }


def java_annotations(header: Column) -> Column:
    """Annotations among the modifiers of a declaration, in order."""
    modifiers = F.regexp_extract(header, rf"\A{MODIFIERS}", 0)
    return none_if_empty(plain_list(F.regexp_extract_all(modifiers, F.lit(ANNOTATION), F.lit(0))))


def java_signature(header: Column) -> Column:
    """Return type, name and parameter list of a method header, from one match."""
    pattern = (
        rf"\A{MODIFIERS}(?:{ANGLES}\s*+)?+(?:{ANNOTATION}\s*+)*+({TYPE})\s*+({NAME})\s*+({PARENS})(?s:.*)\z"
    )
    return F.split(F.regexp_replace(header, pattern, "$1\u0001$2\u0001$3"), "\u0001")


def java_parameters(signature: Column) -> Column:
    """What stands between the parentheses of a method signature."""
    inside = F.get(signature, F.lit(2))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def java_method_meta(signature: Column, listed: Column) -> dict[str, Column]:
    """Name, return type and parameter types of a method signature and its parameters.

    Qualified types are no plain, generic or array types and are left out;
    so are primitive and variable-arity parameters.
    """
    return_type, name = (F.get(signature, F.lit(n)) for n in range(2))
    one = (
        rf"(?<![\p{{L}}\p{{N}}_$.@])(?:(?:final{_WORD_END}|{ANNOTATION})\s*+)*+({TYPE})\s*+(?!this{_WORD_END})"
        rf"{NAME}\s*+(?:\[\s*+\]\s*+)*+(?=,|\z)"
    )
    typed = F.regexp_extract_all(listed, F.lit(one), F.lit(1))
    qualified = rf"\A{NAME}(?:\s*+\.\s*+{NAME})++\z"
    params = F.filter(typed, lambda t: ~t.isin(PRIMITIVES) & ~t.rlike(qualified))
    return {
        "method_name": name,
        "return_type": F.when(~return_type.rlike(qualified), plain(return_type)),
        "param_types": none_if_empty(plain_list(params)),
    }


def java_calls(body: Column) -> Column:
    """Text before the first parenthesis of each invocation chain, distinct, in order."""
    found = F.regexp_extract_all(body, F.lit(CALLS), F.lit(1))
    called = F.filter(found, lambda c: c != "")
    return none_if_empty(
        F.array_distinct(F.transform(called, lambda c: plain(strip(F.regexp_replace(c, rf"{_ANY}\z", "")))))
    )


def _is_method(token: Column) -> Column:
    # Most tokens hold no such parenthesis, which is found out without decoding them.
    outer = token.contains("(") | token.contains(MARKS[0]) | token.contains(MARKS[1])
    return outer & token.rlike(rf"\A{METHOD}\z")


def _directly_in(inner: Column, outer: Column) -> Column:
    """Whether a declaration is a direct member of another one's body."""
    return (
        (inner["first"] > outer["first"])
        & (inner["first"] < outer["last"])
        & (inner["depth"] == outer["depth"] + 1)
    )


def _declarations(toks: Column, partner: Column, depth: Column) -> Column:
    """Headers of classes, methods, annotation types and injected fields, in order."""

    # Most tokens are ruled out by what follows them, before anything is matched.
    def candidate(t: Column, i: Column) -> Column:
        follower = F.get(toks, i + 1)
        found = (F.octet_length(t) > 1) & (follower.isin("{", ";") | t.contains("@Inject"))
        return F.when(found, F.struct(i.alias("i"), t.alias("t"), follower.alias("follower")))

    def look(c: Column) -> Column:
        t, i, follower = c["t"], c["i"], c["follower"]
        opens = follower == "{"
        kind = (
            F.when(opens & t.contains("class") & t.rlike(rf"\A{CLASS}\z"), "class_declaration")
            .when((opens | (follower == ";")) & _is_method(t), "method_declaration")
            .when(opens & t.contains("@") & t.rlike(rf"\A{ANNOTATION_TYPE}\z"), "annotation_type")
            .when(t.contains("@Inject") & t.rlike(rf"\A{MODIFIERS}{TYPE}{GAP}*+{NAME}\z"), "field")
        )
        return F.struct(
            kind.alias("kind"),
            i.alias("first"),
            F.when(opens, F.get(partner, i + 1)).otherwise(i + 1).alias("last"),
            F.get(depth, i).alias("depth"),
            t.alias("header"),
        )

    candidates = F.filter(F.transform(toks, candidate), lambda c: c.isNotNull())
    return F.filter(F.transform(candidates, look), lambda d: d["kind"].isNotNull())


def _block_spans(toks: Column, line: Column, decls: Column) -> Column:
    """Blocks with all the text their metadata needs, so the tokens can be dropped."""

    def parts(found: Column) -> Column:
        fields = F.filter(found, lambda d: d["kind"] == "field")
        elements = F.filter(found, lambda d: d["kind"] == "annotation_type")
        return bind(
            F.struct(fields.alias("fields"), elements.alias("elements")),
            lambda aside: F.transform(F.filter(found, is_block(aside)), block(aside)),
        )

    def is_block(aside: Column):
        # An element of an annotation type is written like an abstract method but is none.
        return lambda d: (d["kind"] == "class_declaration") | (
            (d["kind"] == "method_declaration")
            & ~F.exists(aside["elements"], lambda a: _directly_in(d, a))
        )

    def block(aside: Column):
        def cut_out(d: Column) -> Column:
            is_class = d["kind"] == "class_declaration"
            inside = F.slice(toks, d["first"] + 2, d["last"] - d["first"])
            own_fields = F.filter(aside["fields"], lambda f: _directly_in(f, d))
            return F.struct(
                d["kind"].alias("kind"),
                d["header"].alias("header"),
                join_slice(toks, d["first"], d["last"], "").alias("content"),
                (F.get(line, d["first"]) + 1).alias("start_line"),
                F.when(
                    ~is_class,
                    F.array_join(F.filter(inside, lambda t: ~_is_method(t)), ""),
                ).alias("body"),
                F.when(is_class, F.transform(own_fields, lambda f: f["header"])).alias("fields"),
            )

        return cut_out

    return bind(decls, parts)


def java_blocks(files: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Class and method declarations anywhere in the file, outer ones first."""
    keep = carried(files)
    toks = F.col("__toks")
    step = F.transform(toks, lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0))
    marked = with_marks(files.select(*keep, "text"), F.col("text"), "__text").drop("text")
    cut = marked.select(*keep, tokens(F.col("__text"), LEXER).alias("__toks")).select(
        *keep,
        "__toks",
        closing_partner(step).alias("__partner"),
        running_before(step).alias("__depth"),
        running_before(line_counts(toks)).alias("__line"),
    )
    decls = _declarations(toks, F.col("__partner"), F.col("__depth"))
    spans = cut.select(
        *keep,
        java_imports(toks).alias("__imports"),
        _block_spans(toks, F.col("__line"), decls).alias("__spans"),
    )
    rows = explode_spans(spans, "__spans", keep_empty).withColumn(
        "__header", strip(_without_comments(F.col("__span.header")))
    )
    rows = rows.withColumn(
        "__signature",
        F.when(F.col("__span.kind") == "method_declaration", java_signature(F.col("__header"))),
    )
    # Parentheses of annotations lie inside those of the list, but are outer ones within it.
    listed = java_parameters(F.col("__signature"))
    annotated = listed.contains("@")
    rows = with_marks(rows, plain(F.when(annotated, listed)), "__again")
    listed = F.when(annotated, F.col("__again")).otherwise(listed)
    kind, content, header = F.col("__span.kind"), plain(F.col("__span.content")), F.col("__header")
    is_class, is_method = kind == "class_declaration", kind == "method_declaration"
    start = F.col("__span.start_line")
    fields = F.transform(F.col("__span.fields"), lambda f: strip(_without_comments(f)))
    return finish(
        rows,
        keep,
        node_type=kind,
        language=F.when(kind.isNotNull(), F.lit("java")),
        content=content,
        start_line=start,
        end_line=start + newlines(F.col("__span.content")),
        imports=F.when(kind.isNotNull(), F.col("__imports")),
        annotations=java_annotations(header),
        injects=F.when(is_class, none_if_empty(java_injects(fields))),
        calls=F.when(is_method, java_calls(F.col("__span.body"))),
        **{k: F.when(is_class, v) for k, v in java_class_meta(header).items()},
        **{k: F.when(is_method, v) for k, v in java_method_meta(F.col("__signature"), listed).items()},
    )


def java_injects(fields: Column) -> Column:
    """Plain or generic types of the given field headers that are injected."""

    def injected(f: Column) -> Column:
        annotated = F.exists(
            F.regexp_extract_all(
                F.regexp_extract(f, rf"\A{MODIFIERS}", 0), F.lit(ANNOTATION), F.lit(0)
            ),
            lambda a: a.contains("@Inject"),
        )
        kind = F.regexp_extract(f, rf"\A{MODIFIERS}({TYPE})", 1)
        plain_or_generic = ~kind.isin(PRIMITIVES) & ~kind.rlike(
            rf"\]\z|\A{NAME}(?:\s*+\.\s*+{NAME})++\z"
        )
        return F.when(annotated & plain_or_generic, plain(kind))

    return F.filter(F.transform(fields, injected), lambda t: t.isNotNull())
