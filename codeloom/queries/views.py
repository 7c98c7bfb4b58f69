"""Inputs of the registered queries, derived from the given tables.

Each view is one SQL text for Spark and DuckDB alike; ``{NL}`` is a line break
(char(10) or chr(10)), ``{table}`` the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row."""
    return spread(table(spark, sf_dir, name).select(*columns))


# Documents as source files. Extensions cover all families, upper case and two
# unsupported ones.
FILE_PATH = """concat(source, '/', doc_id, case doc_id % 9 when 0 then '.java' when 1 then '.jsx'
 when 2 then '.tsx' when 3 then '.html' when 4 then '.CFM' when 5 then '.cfc' when 6 then '.sql'
 when 7 then '.py' else '.txt' end)"""

NODE_TYPE = """case doc_id % 4 when 0 then 'class_declaration' when 1 then 'method_declaration'
 when 2 then 'cfquery' else 'statement' end"""
START_LINE = "doc_id * 7919 % 500 + 1"

# Closed-form source texts: (table, key, file path, text, expected blocks). An expected
# block is (node_type, language, start, end, content).
JAVA_PATH = "concat('java/C', p_partkey, '.java')"
JAVA_METHOD = (
    "concat('public V', p_partkey % 4, ' run', p_partkey, '(P p, int n) "
    "{ s.go(p); log.info(\"a(b}\"); s.go(n); }')"
)
JAVA_INNER = "concat('static class N', p_partkey, ' { void in() { x.a().b(); } }')"
JAVA_CLASS = (
    "concat('@Path(\"/p', p_partkey, '\")', {NL}, 'public class C', p_partkey, ' extends B', "
    "p_partkey % 7, ' implements I', p_partkey % 3, ', Serializable {', {NL}, '  @Inject private S', "
    "p_partkey % 11, ' s;', {NL}, '  @Inject(\"n\") Provider<R> r;', {NL}, '  // } not a brace', {NL}, '  ', "
    f"{JAVA_METHOD}, {{NL}}, '  ', {JAVA_INNER}, {{NL}}, '}}')"
)
JAVA_TEXT = (
    "concat('package p', p_partkey % 10, ';', {NL}, 'import a.b.T', p_partkey % 5, ';', {NL}, "
    f"'import a.c.U;', {{NL}}, '/* class Fake {{ }} */', {{NL}}, {JAVA_CLASS}, {{NL}})"
)
JAVA_BLOCKS = [
    ("class_declaration", "java", 5, 12, JAVA_CLASS),
    ("method_declaration", "java", 10, 10, JAVA_METHOD),
    ("class_declaration", "java", 11, 11, JAVA_INNER),
    ("method_declaration", "java", 11, 11, "'void in() { x.a().b(); }'"),
]

# Headers whose brackets are nested as deep as the key says.
DEEP = "cast(p_partkey % 40 as int)"
DEEP_PATH = "concat('deep/D', p_partkey, '.java')"
DEEP_ANNOTATION = f"concat('@P(x = ', repeat('@Q(a=', {DEEP}), '1', repeat(')', {DEEP}), ')')"
DEEP_TYPE = f"concat(repeat('List<', {DEEP}), 'T', p_partkey % 5, repeat('>', {DEEP}))"
DEEP_PARAMETER = f"concat(repeat('Map<K, ', {DEEP}), 'V', p_partkey % 3, repeat('>', {DEEP}))"
DEEP_METHOD = (
    f"concat({DEEP_ANNOTATION}, ' public ', {DEEP_TYPE}, ' run(', {DEEP_ANNOTATION}, ' ', {DEEP_PARAMETER}, "
    f"' p) {{ f(', repeat('g(', {DEEP}), repeat(')', {DEEP}), ').h(); }}')"
)
DEEP_CLASS = f"concat('class D', p_partkey, ' {{', {{NL}}, '  ', {DEEP_METHOD}, {{NL}}, '}}')"
DEEP_BLOCKS = [
    ("class_declaration", "java", 1, 3, DEEP_CLASS),
    ("method_declaration", "java", 2, 2, DEEP_METHOD),
]

JSX_PATH = "concat('web/Comp', c_custkey, case when c_custkey % 2 = 0 then '.jsx' else '.tsx' end)"
JSX_FUNCTION = (
    "concat('function Comp', c_custkey, '() {', {NL}, '  const [a, b] = useState(0); useA', "
    "c_custkey % 3, '(); useState(1);', {NL}, '  const f = () => { useEffect(g); };', {NL}, "
    "'  return <div className=\"a > b\">don''t<span>it''s {a < 1}</span></div>;', {NL}, '}')"
)
JSX_TEXT = (
    "concat('import { useA', c_custkey % 3, ' } from ''./h', c_custkey % 3, ''';', {NL}, "
    f"{JSX_FUNCTION}, {{NL}})"
)
JSX_BLOCKS = [
    ("function_declaration", "jsx", 2, 6, JSX_FUNCTION),
    ("arrow_function", "jsx", 4, 4, "'() => { useEffect(g); }'"),
    (
        "jsx_element", "jsx", 5, 5,
        "'<div className=\"a > b\">don''t<span>it''s {a < 1}</span></div>'",
    ),
    ("jsx_element", "jsx", 5, 5, "'<span>it''s {a < 1}</span>'"),
]

CFML_PATH = "concat('cf/F', s_suppkey, '.cfc')"
CFML_SQL = "concat('SELECT a FROM t', s_suppkey, ' JOIN u', s_suppkey % 4, ' ON 1=1')"
CFML_QUERY = f"concat('<cfquery name=\"q\" datasource=\"d\">', {{NL}}, ' ', {CFML_SQL}, {{NL}}, '</cfquery>')"
CFML_FUNCTION = (
    "concat('<cffunction name=\"fn', s_suppkey, '\" returntype=\"query\">', {NL}, "
    "'<cfinvoke component=\"K', (s_suppkey * 7 + 3) % 100, '\" method=\"m\">', {NL}, "
    "'<cfset o = new Z', s_suppkey % 9, '()>', {NL}, "
    f"{CFML_QUERY}, {{NL}}, '</cffunction>')"
)
CFML_COMPONENT = (
    f"concat('<cfcomponent displayname=\"K', s_suppkey, '\">', {{NL}}, {CFML_FUNCTION}, {{NL}}, '</cfcomponent>')"
)
CFML_OPEN = "concat('<CFQUERY name=\"u', s_suppkey, '\">')"
CFML_TEXT = f"concat({CFML_COMPONENT}, {{NL}}, {CFML_OPEN})"
CFML_BLOCKS = [
    ("cfcomponent", "cfml", 1, 9, CFML_COMPONENT),
    ("cffunction", "cfml", 2, 8, CFML_FUNCTION),
    ("cfquery", "cfml", 5, 7, CFML_QUERY),
    ("sql_injection", "sql", 5, 7, CFML_SQL),
    ("cfquery", "cfml", 10, 10, CFML_OPEN),
]

SQL_PATH = "concat('db/o', o_orderkey, '.sql')"
SQL_CREATE = "concat('CREATE TABLE t', o_orderkey, ' (id INT)')"
SQL_INSERT = "concat('insert into t', o_orderkey, {NL}, ' values (''a;b'')')"
SQL_LAST = "case o_orderstatus when 'F' then 'DROP TABLE z' when 'O' then 'SELECT 1' else 'MERGE INTO x USING y' end"
SQL_TEXT = (
    f"concat('-- c; x', {{NL}}, {SQL_CREATE}, ';', {{NL}}, {SQL_INSERT}, ' /* ; */;', {{NL}}, {SQL_LAST}, ';')"
)
SQL_BLOCKS = [
    ("statement", "sql", 2, 2, SQL_CREATE),
    ("statement", "sql", 3, 4, SQL_INSERT),
    ("statement", "sql", 5, 5, SQL_LAST),
]

PAGE_PATH = "concat('page/', page_id, '.html')"
PAGE_ROOT = "substring(html, 16)"  # behind the 15 characters of the doctype
SIBLING_PATH = "concat('part/', page_id, '.html')"
SIBLING_TEXT = "concat('<!-- <p> --><p>', page_id, '</p>', {NL}, '<div><p>x</p></div>')"
SIBLING_BLOCKS = [
    ("element", "html", 1, 1, "concat('<p>', page_id, '</p>')"),
    ("element", "html", 2, 2, "'<div><p>x</p></div>'"),
]

# family -> (table, path, text, blocks)
CORPORA = {
    "java": ("part", JAVA_PATH, JAVA_TEXT, JAVA_BLOCKS),
    "deep": ("part", DEEP_PATH, DEEP_CLASS, DEEP_BLOCKS),
    "jsx": ("customer", JSX_PATH, JSX_TEXT, JSX_BLOCKS),
    "cfml": ("supplier", CFML_PATH, CFML_TEXT, CFML_BLOCKS),
    "sql": ("orders", SQL_PATH, SQL_TEXT, SQL_BLOCKS),
    "siblings": ("pages", SIBLING_PATH, SIBLING_TEXT, SIBLING_BLOCKS),
}
CORPUS_KEYS = {
    "java": ["p_partkey"],
    "deep": ["p_partkey"],
    "jsx": ["c_custkey"],
    "cfml": ["s_suppkey"],
    "sql": ["o_orderkey", "o_orderstatus"],
    "siblings": ["page_id"],
}


def in_spark(expression: str) -> str:
    return expression.replace("{NL}", "char(10)")


def in_duckdb(expression: str) -> str:
    return expression.replace("{NL}", "chr(10)")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, file_path, content (bytes), file_sha256."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(FILE_PATH).alias("file_path"),
        F.encode("text", "UTF-8").alias("content"),
        F.sha2("text", 256).alias("file_sha256"),
    )


FILES_SQL = f"(select doc_id, {FILE_PATH} file_path, text, sha256(text) file_sha256 from documents)"


def corpus(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Generated source files of one family: file_path, text."""
    source, path, text, _ = CORPORA[family]
    # The keys are spread, the text is made where it is used.
    keys = spread_table(spark, sf_dir, source, *CORPUS_KEYS[family])
    return keys.select(F.expr(path).alias("file_path"), F.expr(in_spark(text)).alias("text"))


def corpus_sql(family: str, extra: dict[int, str] | None = None, names: str = "") -> str:
    """Expected blocks of a family; ``extra`` adds columns per block position."""
    source, path, _, blocks = CORPORA[family]
    rows = []
    for n, (kind, language, start, end, content) in enumerate(blocks):
        tail = f", {extra.get(n)}" if extra and extra.get(n) else ""
        if extra is not None and n not in extra:
            continue
        rows.append(
            f"select {path} file_path, cast({n} as bigint) ordinal, '{kind}' node_type, "
            f"'{language}' \"language\", cast({start} as bigint) start_line, "
            f"cast({end} as bigint) end_line, {in_duckdb(content)} \"content\"{tail} from {source}"
        )
    return " union all ".join(rows)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as block index rows, without vectors."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("file_path"),
        F.col("lang").alias("language"),
        F.expr(NODE_TYPE).alias("node_type"),
        F.expr(f"cast({START_LINE} as int)").alias("start_line"),
        F.col("text").alias("content"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`blocks` that have a vector, which is what a search can rank."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return blocks(spark, sf_dir).join(vectors, "id")


_BLOCK_COLUMNS = f"""d.doc_id id, d.source file_path, d.lang "language", {NODE_TYPE} node_type,
 cast({START_LINE} as int) start_line, d.text "content\""""
BLOCKS_SQL = f"(select {_BLOCK_COLUMNS} from documents d)"
INDEX_SQL = f"(select {_BLOCK_COLUMNS}, e.embedding from embeddings e join documents d on e.vec_id = d.doc_id)"

# A dependency graph over suppliers: four of five rows are classes, the rest components.
# ``{n}`` is the number of suppliers.
DEPS = {
    "class_name": "case when s_suppkey % 5 = 0 then null else concat('C', s_suppkey) end",
    "component_name": "case when s_suppkey % 5 = 0 then concat('K', s_suppkey) end",
    "injects": "case when s_suppkey % 5 <> 0 then array(concat('C', (s_suppkey * 7 + 3) % {n})) end",
    "implements": "case when s_suppkey % 7 = 1 then array(concat('C', (s_suppkey * 11 + 2) % {n})) end",
    "extends": "case when s_suppkey % 5 <> 0 then concat('C', (s_suppkey * 3 + 1) % {n}) end",
    "calls_components": "case when s_suppkey % 5 = 0 or s_suppkey % 6 = 1 then array(concat('K', (s_suppkey * 15 + 5) % {n})) end",
}


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    n = max(suppliers.count(), 1)
    return suppliers.select(
        F.col("s_suppkey").alias("id"),
        F.expr("concat('n', s_nationkey)").alias("file_path"),
        F.expr("cast(s_suppkey * 7 % 50 + 1 as int)").alias("start_line"),
        F.lit(0).alias("ordinal"),
        "s_nationkey",
        *[F.expr(e.replace("{n}", str(n))).alias(name) for name, e in DEPS.items()],
    )


DEPS_SQL = (
    "(select s_suppkey id, concat('n', s_nationkey) file_path, cast(s_suppkey * 7 % 50 + 1 as int) start_line, "
    "s_nationkey, "
    + ", ".join(f"{e.replace('array(', 'list_value(').replace('{n}', '(select count(*) from supplier)')} {name}"
        for name, e in DEPS.items())
    + " from supplier)"
)
