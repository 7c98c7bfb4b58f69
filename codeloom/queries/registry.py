"""Every operator as a query over the given tables, with equivalent SQL."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.vectors import cosine_distance
from codeloom.operators import catalog, files as steps, search as near, vector_index
from codeloom.operators.deps import expand_dependencies, reach_stored
from codeloom.operators.embed import embed_blocks, embed_query, hashed_words
from codeloom.operators.extract import (
    cfml_blocks,
    html_blocks,
    java_blocks,
    jsx_blocks,
    sql_blocks,
)
from codeloom.operators.extract.cfml import cfml_calls
from codeloom.operators.extract.jsx import jsx_hooks
from codeloom.operators.extract.sql import classify_sql, sql_tables, tag_dialect
from codeloom.plans.ingest import extract_blocks, ingest
from codeloom.plans.search_code import search_code
from codeloom.queries import views as V
from codeloom.schema import BLOCK_INDEX, conform
from codeloom.session import work_dir
from codeloom.sources import block_index
from codeloom.sources.files import (
    PACKED,
    check_root,
    discover_files,
    fingerprint,
    mounted_path,
    read_text,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(run(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Comparable types: arrays as text, whole numbers as bigint, fractions as double."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(score: Column, digits: int = 6) -> Column:
    return F.round(score, digits) + F.lit(0.0)  # no negative zero


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = V.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()
    return list(row["embedding"])


DISTANCE = (
    "1 - list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[]))"
    " * sqrt(list_dot_product({b}::double[], {b}::double[])))"
)
ROUND = "round({0}, {1}) + 0.0"


def distance_sql(a: str, b: str) -> str:
    return DISTANCE.format(a=a, b=b)


# --- files ---------------------------------------------------------------------


@query("fingerprint", f"select file_path, file_sha256 from {V.FILES_SQL}")
def _fingerprint(spark, sf_dir):
    files = V.files(spark, sf_dir).select("file_path", "content")
    return fingerprint(files).select("file_path", "file_sha256")


@query("read_text", "select doc_id, text || chr(65533) || 'x' || chr(65533) as text from documents")
def _read_text(spark, sf_dir):
    broken = F.concat(
        F.encode("text", "UTF-8"), F.unhex(F.lit("FF78")), F.unhex(F.lit("C3"))
    )
    documents = V.table(spark, sf_dir, "documents")
    return read_text(documents.select("doc_id", broken.alias("content")))


@query(
    "route",
    f"""select file_path, case regexp_extract(lower(file_path), '\\.[a-z]+$') when '.java' then 'java'
 when '.jsx' then 'jsx' when '.tsx' then 'jsx' when '.html' then 'html' when '.cfm' then 'cfml'
 when '.cfc' then 'cfml' when '.sql' then 'sql' end family from {V.FILES_SQL}""",
)
def _route(spark, sf_dir):
    return steps.route(V.files(spark, sf_dir)).select("file_path", "family")


def _indexed_half(files: DataFrame) -> DataFrame:
    return files.where(F.col("doc_id") % 2 == 0)


@query(
    "skip_indexed",
    f"""with f as {V.FILES_SQL} select file_path, file_sha256 from f
 where file_sha256 not in (select file_sha256 from f where doc_id % 2 = 0)""",
)
def _skip_indexed(spark, sf_dir):
    files = V.files(spark, sf_dir).select("doc_id", "file_path", "file_sha256")
    return steps.skip_indexed(files, _indexed_half(files)).drop("doc_id")


@query(
    "dedupe_batch",
    f"""with f as {V.FILES_SQL} select file_path, file_sha256, blocks from
 (select *, doc_id % 5 blocks, row_number() over (partition by file_sha256 order by file_path) n
  from f where doc_id % 5 > 0) where n = 1""",
)
def _dedupe_batch(spark, sf_dir):
    files = V.files(spark, sf_dir).select(
        "file_path", "file_sha256", (F.col("doc_id") % 5).alias("blocks")
    )
    return steps.dedupe_batch(files)


@query(
    "drop_empty",
    f"select file_path, doc_id % 4 blocks from {V.FILES_SQL} where doc_id % 4 > 0",
)
def _drop_empty(spark, sf_dir):
    files = V.files(spark, sf_dir).select("doc_id", "file_path")
    many = (F.col("doc_id") % 4).cast("int")
    blocks = files.where(many > 0).select("file_path", F.explode(F.sequence(F.lit(1), many)).alias("n"))
    return steps.drop_empty(files.select("file_path"), blocks)


_OUTCOMES_SQL = f"""with f as (select *, regexp_matches(lower(file_path), '\\.(java|jsx|tsx|html|cfm|cfc|sql)$') routed,
  doc_id % 5 blocks, doc_id % 11 = 0 broken from {V.FILES_SQL}),
 k as (select distinct file_sha256 from f where doc_id % 2 = 0 and doc_id % 3 = 0),
 w as (select file_sha256, min(file_path) file_path from f where blocks > 0 and not broken group by file_sha256),
 r as (select f.*, case when f.file_sha256 in (select file_sha256 from k) then 'duplicate'
   when not routed then 'no parser' when broken then 'error' when blocks = 0 then 'no blocks'
   when w.file_path is null then 'duplicate' end reason
  from f left join w on f.file_path = w.file_path),
 outcomes as (select file_path, case when reason = 'error' then 'failed' when reason is not null then 'skipped' else 'success' end status,
  reason, cast(case when reason is null then blocks else 0 end as bigint) blocks_extracted,
  cast(case when reason is null then blocks else 0 end as bigint) embeddings_generated,
  case when reason = 'error' then 'unreadable' end error from r)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.files(spark, sf_dir).select(
        "doc_id",
        "file_path",
        "file_sha256",
        (F.col("doc_id") % 5).alias("blocks"),
        F.when(F.col("doc_id") % 11 == 0, "unreadable").alias("error"),
    )
    indexed = _indexed_half(files).where(F.col("doc_id") % 3 == 0)
    fresh = steps.skip_indexed(files, indexed).select("file_path", F.lit(False).alias("known"))
    winners = steps.dedupe_batch(files.where("error is null")).select(
        "file_path", F.lit(True).alias("winner")
    )
    facts = (
        steps.route(files)
        .join(fresh, "file_path", "left")
        .join(winners, "file_path", "left")
        .withColumn("known", F.coalesce("known", F.lit(True)))
        .withColumn("winner", F.coalesce("winner", F.lit(False)))
        .withColumn("vectors", F.col("blocks"))
    )
    return steps.file_outcomes(facts)


@query("file_outcomes", f"{_OUTCOMES_SQL} select * from outcomes")
def _file_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(
    "job_metrics",
    f"""{_OUTCOMES_SQL} select count(*) files_discovered, count(*) filter (status = 'success') files_processed,
 count(*) filter (status = 'skipped') files_skipped, count(*) filter (status = 'failed') files_failed,
 cast(coalesce(sum(blocks_extracted), 0) as bigint) blocks_inserted from outcomes""",
)
def _job_metrics(spark, sf_dir):
    return steps.job_metrics(_outcomes(spark, sf_dir)).drop("elapsed_seconds")


# --- files on disk ---------------------------------------------------------------


def _write_tree(texts: DataFrame, root: str) -> None:
    """Write (file_path, text) rows as files below ``root`` from the tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, made = 0, set()
        for batch in batches:
            for path, text in zip(*(batch.column(n).to_pylist() for n in (0, 1))):
                target = os.path.join(root, path)
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(target, "w", encoding="utf-8", newline="") as handle:
                    handle.write(text)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    texts.select("file_path", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).first()


# Files in an archive.
MEMBERS = 10_000


def _write_archives(texts: DataFrame, root: str) -> None:
    """Write (file_path, text) rows as files in zip archives below ``root`` from the tasks.

    A file of its own takes a block of the disk, mostly 4 KB, however short it is.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        part = TaskContext.get().partitionId()
        draft, archive, held, done = f"{root}/.{uuid.uuid4().hex}", None, 0, 0

        def finish() -> None:  # a second attempt of the task puts the same archive in the same place
            archive.close()
            os.replace(draft, f"{root}/{part:06d}-{done:012d}.zip")

        for batch in batches:
            for path, text in zip(*(batch.column(n).to_pylist() for n in (0, 1))):
                if archive is None:
                    archive = zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                archive.writestr(path, text)
                held, done = held + 1, done + 1
                if held == MEMBERS:
                    finish()
                    archive, held = None, 0
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    texts.select("file_path", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def _new_root(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _tree_root(spark: SparkSession) -> str:
    """A new folder for source files, which tasks write through the mounted file system."""
    root = mounted_path(_new_root(spark, "tree"))
    if root is None:
        raise ValueError("source files need a mounted folder as spark.checkpoint.dir")
    return root


_HIDDEN = "case doc_id % 5 when 0 then '_' when 1 then '.' else '' end"
_HIDDEN_DIR = "case when doc_id % 3 = 0 then '.git/' when doc_id % 3 = 1 then '_inc/' else '' end"
_TREE_PATH = (
    V.FILE_PATH.replace("concat(source, '/', doc_id,", f"concat({_HIDDEN_DIR}, source, '/', {_HIDDEN}, doc_id,")
)
_TREE_SQL = f"(select {_TREE_PATH} file_path, strlen(text) length from documents)"
_SUPPORTED = "regexp_matches(lower(file_path), '\\.(java|jsx|tsx|html|cfm|cfc|sql)$')"


def _document_tree(spark: SparkSession, sf_dir: str) -> str:
    root = _tree_root(spark)
    documents = V.table(spark, sf_dir, "documents")
    _write_tree(documents.select(F.expr(_TREE_PATH).alias("file_path"), "text"), root)
    return root


@query("discover_files", f"select file_path, length from {_TREE_SQL} where {_SUPPORTED}")
def _discover_files(spark, sf_dir):
    root = _document_tree(spark, sf_dir)
    found = discover_files(spark, root)
    relative = F.expr(f"substring(file_path, {len(root) + 2})")
    return found.select(relative.alias("file_path"), "length")


@query(
    "check_root",
    f"""select 'present' root, true found, count(*) files from {_TREE_SQL} where {_SUPPORTED}
 union all select 'absent', false, 0""",
)
def _check_root(spark, sf_dir):
    root = _document_tree(spark, sf_dir)
    found = discover_files(spark, root).agg(F.count("*").alias("files"))
    here, gone = check_root(spark, root), check_root(spark, root + "-gone")
    present = found.select(F.lit("present").alias("root"), F.lit(here).alias("found"), "files")
    absent = found.select(
        F.lit("absent").alias("root"), F.lit(gone).alias("found"), F.lit(0).cast("bigint").alias("files")
    )
    return present.unionByName(absent)


@query(
    "ingest_job",
    """with n as (select (select count(*) from part) parts, (select count(*) from supplier) suppliers,
  (select count(*) from customer) customers, (select count(*) from pages) pages,
  (select count(distinct html) from pages) roots)
 select parts + suppliers + customers + pages files_discovered,
  parts + suppliers + customers + roots files_processed, pages - roots files_skipped, cast(0 as bigint) files_failed,
  4 * parts + 5 * suppliers + 4 * customers + roots blocks_inserted,
  parts + suppliers + customers + roots files_listed,
  4 * parts + 5 * suppliers + 4 * customers + roots blocks_listed from n""",
)
def _ingest_job(spark, sf_dir):
    root, target = _tree_root(spark), _new_root(spark, "index")
    pages = V.spread_table(spark, sf_dir, "pages", "page_id", "html").select(
        F.expr(V.PAGE_PATH).alias("file_path"), F.col("html").alias("text")
    )
    sources = [V.corpus(spark, sf_dir, f) for f in ("java", "jsx", "cfml")]
    try:
        _write_archives(reduce(DataFrame.unionByName, sources, pages), root)
        job = ingest(spark, PACKED + root, target, hashed_words(64), buckets=8)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    listed = catalog.list_indexed_files(block_index.read_index(spark, target)).agg(
        F.count("*").alias("files_listed"), F.sum("block_count").alias("blocks_listed")
    )
    one = F.lit(1).alias("one")
    return (
        job.metrics.drop("elapsed_seconds")
        .withColumn("one", one)
        .join(listed.withColumn("one", one), "one")
        .drop("one")
    )


# --- the index table -------------------------------------------------------------


def _index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.files(spark, sf_dir).join(
        V.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id"
    )
    line = F.expr(f"cast({V.START_LINE} as int)")
    return conform(
        rows.select(
            "file_path",
            F.lit("id").alias("id"),
            F.lit(0).alias("ordinal"),
            F.expr(V.NODE_TYPE).alias("node_type"),
            F.col("lang").alias("language"),
            F.col("text").alias("content"),
            line.alias("start_line"),
            line.alias("end_line"),
            "file_sha256",
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("K"), "doc_id")).alias("component_name"),
        ),
        BLOCK_INDEX,
    )


@query(
    "read_index",
    f"""select file_path, cast(0 as bigint) ordinal, {V.NODE_TYPE} node_type, lang "language", {V.START_LINE} start_line,
 case when f.doc_id % 3 = 0 then concat('K', f.doc_id) end component_name, d.text "content",
 sha256(concat(file_path, chr(0), file_sha256, chr(0), 0)) id
 from {V.FILES_SQL} f join (select doc_id id, lang, text from documents) d on f.doc_id = d.id""",
)
def _read_index(spark, sf_dir):
    target = _new_root(spark, "index")
    block_index.write_blocks(spark, target, _index_rows(spark, sf_dir), buckets=8)
    return block_index.read_index(spark, target).select(
        "file_path", "ordinal", "node_type", "language", "start_line", "component_name", "content", "id"
    )


@query(
    "upsert_by_file",
    f"""with f as {V.FILES_SQL} select file_path, cast(n as bigint) ordinal, case when doc_id % 3 = 0 then 'new ' || n else d.text end "content"
 from f join documents d using (doc_id), (select unnest([0, 1]) n) where n = 0 or doc_id % 3 = 0""",
)
def _upsert_by_file(spark, sf_dir):
    target = _new_root(spark, "index")
    rows = _index_rows(spark, sf_dir)
    block_index.write_blocks(spark, target, rows, buckets=8)
    third = rows.where(F.col("component_name").isNotNull())
    newer = third.drop("ordinal", "content").withColumn(
        "ordinal", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    newer = newer.withColumn("content", F.concat(F.lit("new "), F.col("ordinal").cast("string")))
    block_index.write_blocks(spark, target, newer)
    return block_index.read_index(spark, target).select("file_path", "ordinal", "content")


@query("purge_prefix", f"select file_path from {V.FILES_SQL} where not starts_with(file_path, 'src1')")
def _purge_prefix(spark, sf_dir):
    target = _new_root(spark, "index")
    block_index.write_blocks(spark, target, _index_rows(spark, sf_dir), buckets=8)
    block_index.purge(spark, target, "src1")
    return block_index.read_index(spark, target).select("file_path")


@query(
    "attach_embeddings",
    """select d.source file_path, d.doc_id ordinal, d.text "content", round(cast(e.embedding[1] as double), 6) head
 from documents d join embeddings e on e.vec_id = d.doc_id""",
)
def _attach_embeddings(spark, sf_dir):
    blocks = V.table(spark, sf_dir, "documents").select(
        F.col("source").alias("file_path"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content")
    )
    vectors = V.table(spark, sf_dir, "embeddings").join(
        blocks.select("file_path", F.col("ordinal").alias("vec_id")), "vec_id"
    )
    vectors = vectors.select("file_path", F.col("vec_id").alias("ordinal"), "embedding")
    head = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return steps.attach_embeddings(blocks, vectors).select(
        "file_path", "ordinal", "content", head.alias("head")
    )


@query(
    "assemble_metadata",
    f"""select file_path, concat('{{"node_type":"', {V.NODE_TYPE}, '","language":"', lang, '","start_line":', {V.START_LINE},
 ',"end_line":', {V.START_LINE}, ',"file_sha256":"', file_sha256, '"',
 case when f.doc_id % 3 = 0 then concat(',"component_name":"K', f.doc_id, '"') else '' end, '}}') metadata
 from {V.FILES_SQL} f join (select doc_id id, lang from documents) d on f.doc_id = d.id""",
)
def _assemble_metadata(spark, sf_dir):
    return _index_rows(spark, sf_dir).select("file_path", steps.assemble_metadata().alias("metadata"))


# --- extraction ------------------------------------------------------------------

_JOBS = {
    "java": java_blocks,
    "deep": java_blocks,
    "jsx": jsx_blocks,
    "cfml": lambda files: cfml_blocks(files, "sybase"),
    "sql": lambda files: sql_blocks(files, "oracle"),
    "siblings": html_blocks,
}
_SPAN = ["file_path", "ordinal", "node_type", "language", "start_line", "end_line", "content"]


def _blocks(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    return _JOBS[family](V.corpus(spark, sf_dir, family))


def _meta(family: str, extra: dict[int, str], names: str) -> str:
    return f"select file_path, ordinal, {names} from ({V.corpus_sql(family, extra)})"


def _register_extraction() -> None:
    for name, family in [
        ("java_blocks", "java"),
        ("jsx_blocks", "jsx"),
        ("cfml_blocks", "cfml"),
        ("sql_statements", "sql"),
        ("html_siblings", "siblings"),
    ]:
        query(name, V.corpus_sql(family))(
            lambda spark, sf_dir, family=family: _blocks(spark, sf_dir, family).select(_SPAN)
        )
    null_list = "cast(null as varchar)"
    metas = [
        ("java_imports", "java", {
            n: "concat('import a.b.T', p_partkey % 5, ';,import a.c.U;') imports" for n in range(4)
        }, ["imports"]),
        ("java_class_meta", "java", {
            0: "concat('C', p_partkey) class_name, concat('B', p_partkey % 7) \"extends\", concat('I', p_partkey % 3, ',Serializable') implements",
            2: f"concat('N', p_partkey) class_name, {null_list} \"extends\", {null_list} implements",
        }, ["class_name", "extends", "implements"]),
        ("java_annotations", "java", {
            0: "concat('@Path(\"/p', p_partkey, '\")') annotations",
            1: f"{null_list} annotations", 2: f"{null_list} annotations", 3: f"{null_list} annotations",
        }, ["annotations"]),
        ("java_injects", "java", {
            0: "concat('S', p_partkey % 11, ',Provider<R>') injects", 2: f"{null_list} injects",
        }, ["injects"]),
        ("java_method_meta", "java", {
            1: "concat('run', p_partkey) method_name, concat('V', p_partkey % 4) return_type, 'P' param_types",
            3: f"'in' method_name, 'void' return_type, {null_list} param_types",
        }, ["method_name", "return_type", "param_types"]),
        ("java_calls", "java", {1: "'s.go,log.info' calls", 3: "'x.a' calls"}, ["calls"]),
        ("java_deep_headers", "deep", {
            0: f"{null_list} annotations, {null_list} return_type, {null_list} param_types, {null_list} calls",
            1: f"{V.DEEP_ANNOTATION} annotations, {V.DEEP_TYPE} return_type, {V.DEEP_PARAMETER} param_types, "
            f"case when {V.DEEP} = 0 then 'f' else 'f,g' end calls",
        }, ["start_line", "end_line", "content", "annotations", "return_type", "param_types", "calls"]),
        ("jsx_meta", "jsx", {
            n: "concat('import { useA', c_custkey % 3, ' } from ''./h', c_custkey % 3, ''';') imports, "
            + ("concat('Comp', c_custkey)" if n == 0 else null_list) + " component_name"
            for n in range(4)
        }, ["imports", "component_name"]),
        ("jsx_hooks", "jsx", {
            0: "concat('useState,useA', c_custkey % 3, ',useEffect') hooks", 1: "'useEffect' hooks",
            2: f"{null_list} hooks", 3: f"{null_list} hooks",
        }, ["hooks"]),
        ("cfml_attrs", "cfml", {
            0: f"concat('K', s_suppkey) component_name, {null_list} function_name, {null_list} return_type",
            1: "concat('K', s_suppkey) component_name, concat('fn', s_suppkey) function_name, 'query' return_type",
        }, ["component_name", "function_name", "return_type"]),
        ("cfml_scope", "cfml", {
            n: ("concat('K', s_suppkey)" if n in (0, 1, 3) else null_list) + " component_name" for n in range(5)
        }, ["component_name"]),
        ("cfquery_sql", "cfml", {
            3: "concat('T', s_suppkey, ',U', s_suppkey % 4) tables, 'sybase' sql_dialect, cast(5 as bigint) injection_source_line"
        }, ["content", "tables", "sql_dialect", "injection_source_line"]),
        ("sql_blocks_meta", "sql", {
            0: "'ddl_statement' block_type, 'oracle' sql_dialect", 1: "'dml_statement' block_type, 'oracle' sql_dialect",
            2: "case when o_orderstatus = 'F' then 'ddl_statement' else 'dml_statement' end block_type, 'oracle' sql_dialect",
        }, ["block_type", "sql_dialect"]),
    ]
    # Which blocks a query looks at: all, or those the metadata belongs to.
    only = {
        "java_class_meta": "node_type = 'class_declaration'",
        "java_injects": "node_type = 'class_declaration'",
        "java_method_meta": "node_type = 'method_declaration'",
        "java_calls": "node_type = 'method_declaration'",
        "cfml_attrs": "node_type in ('cfcomponent', 'cffunction')",
        "cfquery_sql": "node_type = 'sql_injection'",
    }
    for name, family, extra, names in metas:
        quoted = ", ".join(f'"{n}"' for n in names)

        def run(spark, sf_dir, family=family, names=names, where=only.get(name, "true")):
            return _blocks(spark, sf_dir, family).where(where).select("file_path", "ordinal", *names)

        query(name, _meta(family, extra, quoted))(run)

    families = list(V.CORPORA)
    spans = " union all ".join(
        f"select file_path, ordinal, start_line, end_line from ({V.corpus_sql(f)})" for f in families
    )

    @query("line_spans", spans)
    def _line_spans(spark, sf_dir):
        sources = [V.corpus(spark, sf_dir, f) for f in families]
        routed = steps.route(reduce(DataFrame.unionByName, sources))
        return extract_blocks(routed).select("file_path", "ordinal", "start_line", "end_line")


_register_extraction()


@query(
    "html_blocks",
    f"""select {V.PAGE_PATH} file_path, cast(0 as bigint) ordinal, 'element' node_type, cast(1 as bigint) start_line,
 length(html) - length(replace(html, chr(10), '')) + 1 end_line, {V.PAGE_ROOT} "content" from pages""",
)
def _html_blocks(spark, sf_dir):
    pages = V.spread_table(spark, sf_dir, "pages", "page_id", "html").select(
        F.expr(V.PAGE_PATH).alias("file_path"), F.col("html").alias("text")
    )
    return html_blocks(pages).select(
        "file_path", "ordinal", "node_type", "start_line", "end_line", "content"
    )


_STATEMENT = (
    "concat(case o_orderkey % 4 when 0 then '  create' when 1 then 'Drop' when 2 then 'altered' else 'with' end, "
    "' t', o_orderkey, ' from a', o_orderkey % 7, ' JOIN b', o_orderkey % 5, ' update a', o_orderkey % 7)"
)


@query(
    "classify_sql",
    f"""select o_orderkey, case when regexp_matches(upper(trim(s)), '^(CREATE|ALTER|DROP)') then 'ddl_statement'
 else 'dml_statement' end block_type from (select o_orderkey, {_STATEMENT} s from orders)""",
)
def _classify_sql(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", classify_sql(F.expr(_STATEMENT)).alias("block_type")
    )


@query(
    "sql_tables",
    "select o_orderkey, concat('A', o_orderkey % 7, ',B', o_orderkey % 5) tables from orders",
)
def _sql_tables(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", sql_tables(F.expr(_STATEMENT)).alias("tables")
    )


@query(
    "tag_dialect",
    """select doc_id, lang "language", case when doc_id % 2 = 0 then 'sqlserver' end sql_dialect
 from (select doc_id, case when doc_id % 2 = 0 then 'sql' else lang end lang from documents)""",
)
def _tag_dialect(spark, sf_dir):
    language = F.when(F.col("doc_id") % 2 == 0, "sql").otherwise(F.col("lang"))
    documents = V.table(spark, sf_dir, "documents")
    return tag_dialect(documents.select("doc_id", language.alias("language")), "sqlserver")


_INVOKES = (
    "concat('<CFInvoke method=\"m\" component = ''K', c_custkey % 13, '''> x = new a.B', c_custkey % 5, ' (1); new Z(); "
    "<cfinvoke component=\"L\"> renew Y(); new Z()')"
)


@query(
    "cfml_calls",
    "select c_custkey, concat('K', c_custkey % 13, ',L,a.B', c_custkey % 5, ',Z') calls from customer",
)
def _cfml_calls(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", cfml_calls(F.expr(_INVOKES)).alias("calls")
    )


# --- embeddings --------------------------------------------------------------------


def _hashed_sql(dimension: int, source: str, key: str, text: str) -> str:
    """CTEs w (counts per slot) and v (unit vectors as float, slot by slot)."""
    return f"""words as (select {key} k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) word from {source}),
 w as (select k, cast('0x' || substr(md5(word), 1, 8) as bigint) % {dimension} slot, count(*) n from words group by 1, 2),
 l as (select k, sqrt(sum(n * n)) len from w group by k),
 v as (select w.k, slot, cast(cast(n / len as float) as double) x from w join l on w.k = l.k)"""


@query(
    "embed_blocks",
    f"""with {_hashed_sql(256, 'documents', 'doc_id', 'text')} select k doc_id, count(*) slots,
 round(sum(x * (slot % 7)), 6) mixed from v group by k""",
)
def _embed_blocks(spark, sf_dir):
    documents = V.spread_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed(
        "text", "content"
    )
    out = embed_blocks(documents, hashed_words(256))
    mixed = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i % 7)), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(
        "doc_id",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("slots"),
        F.round(mixed, 6).alias("mixed"),
    )


_QUERY_TEXT = "The data of the on and ent with 1990"


def _scores_sql(dimension: int) -> str:
    source = f"(select doc_id, text from documents union all select -1, '{_QUERY_TEXT}')"
    return f"""{_hashed_sql(dimension, source, 'doc_id', 'text')},
 len2 as (select k, sqrt(sum(x * x)) len from v group by k),
 scores as (select d.doc_id, 1 - coalesce(p.dot, 0) / (n.len * q.len) score from documents d
  join len2 n on n.k = d.doc_id join (select len from len2 where k = -1) q on true
  left join (select a.k, sum(a.x * b.x) dot from v a join v b on a.slot = b.slot and b.k = -1 group by a.k) p on p.k = d.doc_id)"""


@query(
    "embed_query",
    f"with {_scores_sql(256)} select doc_id, {ROUND.format('score', 6)} score from scores",
)
def _embed_query(spark, sf_dir):
    documents = V.spread_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed(
        "text", "content"
    )
    vector = embed_query(spark, _QUERY_TEXT, hashed_words(256))
    embedded = embed_blocks(documents, hashed_words(256))
    score = near.distance_to(vector)(F.col("embedding"))
    return embedded.select("doc_id", rounded(score).alias("score"))


# --- search ------------------------------------------------------------------------


@query(
    "cosine_distance",
    f"""select e.vec_id, {ROUND.format(distance_sql('e.embedding', 'q.embedding'), 6)} distance
 from embeddings e, (select embedding from embeddings where vec_id = 0) q""",
)
def _cosine_distance(spark, sf_dir):
    probe = F.array(*[F.lit(x) for x in vector_of(spark, sf_dir, 0)])
    return V.table(spark, sf_dir, "embeddings").select(
        "vec_id", rounded(cosine_distance(F.col("embedding"), probe)).alias("distance")
    )


def _search_sql(where: str = "true") -> str:
    return f"""select i.id, {ROUND.format('score', 6)} score from (select i.id, {distance_sql('i.embedding', 'q.embedding')} score
 from {V.INDEX_SQL} i, (select embedding from embeddings where vec_id = 0) q where {where}) i order by i.score, i.id limit 10"""


@query("search_topk", _search_sql())
def _search_topk(spark, sf_dir):
    found = near.search(V.index(spark, sf_dir), vector_of(spark, sf_dir, 0), 10)
    return found.select("id", rounded(F.col("score")).alias("score"))


@query("search_filtered", _search_sql("""i."language" = 'en' and i.node_type = 'cfquery'"""))
def _search_filtered(spark, sf_dir):
    found = near.search(V.index(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, "en", "cfquery")
    return found.select("id", rounded(F.col("score")).alias("score"))


@query(
    "metadata_filter",
    f"""select id, file_path from {V.BLOCKS_SQL} where "language" = 'en' and node_type = 'cfquery'""",
)
def _metadata_filter(spark, sf_dir):
    return near.metadata_filter(V.blocks(spark, sf_dir), "en", "cfquery").select("id", "file_path")


@query(
    "search_batch",
    f"""select query_id, "rank", id, {ROUND.format('score', 6)} score from (
 select query_id, id, score, row_number() over (partition by query_id order by score, id) "rank" from (
  select q.vec_id query_id, e.vec_id id, {distance_sql('e.embedding', 'q.embedding')} score
  from embeddings e, embeddings q)) where "rank" <= 5""",
)
def _search_batch(spark, sf_dir):
    vectors = V.table(spark, sf_dir, "embeddings")
    found = near.search_batch(
        vectors.select(F.col("vec_id").alias("id"), "embedding"),
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        5,
    )
    return found.select("query_id", "rank", "id", rounded(F.col("score")).alias("score"))


_BITS, _FLIPS = 8, 3


@query(
    "ann_search",
    f"""with planes as (select b, i, case when ((m * m) % 10007) % 2 = 0 then 1.0::double else -1.0::double end s from (
  select b, i, ((i + 1) * (b + 3) * 7919 + (i + 1) * (i + 1) * 31 + (b + 1) * (b + 1) * 104729) % 10007 m
  from (select unnest(range({_BITS})) b), (select unnest(range(64)) i))),
 parts as (select vec_id, unnest(embedding) x, unnest(range(64)) i from embeddings),
 sides as (select vec_id, b, sum(cast(x as double) * s) side from parts join planes using (i) group by 1, 2),
 probe as (select b, side >= 0 up, row_number() over (order by abs(side), b) <= {_FLIPS} free from sides where vec_id = 0),
 near as (select vec_id from sides join probe using (b) group by vec_id having bool_and(free or (side >= 0) = up))
 select e.vec_id id, {ROUND.format(distance_sql('e.embedding', 'q.embedding'), 6)} score
 from embeddings e join near using (vec_id), (select embedding from embeddings where vec_id = 0) q
 order by {distance_sql('e.embedding', 'q.embedding')}, e.vec_id limit 10""",
)
def _ann_search(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    signed = near.with_signature(rows, _BITS, 64)
    found = near.ann_search(signed, vector_of(spark, sf_dir, 0), 10, _BITS, _FLIPS)
    return found.select("id", rounded(F.col("score")).alias("score"))


@query("vector_index_search")
def _vector_index_search(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 50, from an index over all rows."""
    vectors = V.table(spark, sf_dir, "embeddings")
    path = _new_root(spark, "cells")
    vector_index.write_vector_index(vectors.select(F.col("vec_id").alias("id"), "embedding"), path)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.index_search_batch(spark, path, queries, 10)
    return found.select("query_id", "rank", "id", rounded(F.col("score")).alias("score"))


# --- catalogue and dependencies -------------------------------------------------------


@query("get_file_blocks", f"""select id, cast(start_line as bigint) start_line, node_type, "content" from {V.BLOCKS_SQL} where file_path = 'src3'""")
def _get_file_blocks(spark, sf_dir):
    return catalog.get_file_blocks(V.blocks(spark, sf_dir), "src3").select(
        "id", "start_line", "node_type", "content"
    )


@query(
    "list_indexed_files",
    f"""select file_path, count(*) block_count, coalesce(min("language"), '') "language" from {V.BLOCKS_SQL} group by file_path""",
)
def _list_indexed_files(spark, sf_dir):
    return catalog.list_indexed_files(V.blocks(spark, sf_dir))


@query(
    "find_by_class",
    f"select id, class_name from {V.DEPS_SQL} where class_name in (select ext from (select \"extends\" ext from {V.DEPS_SQL}))",
)
def _find_by_class(spark, sf_dir):
    graph = V.deps(spark, sf_dir)
    names = graph.where("extends is not null").select("extends")
    return catalog.find_blocks_by_name(graph, names, "class_name").select("id", "class_name")


@query("find_by_component", f"select id, component_name from {V.DEPS_SQL} where component_name in ('K5', 'K20', 'k5', 'C1')")
def _find_by_component(spark, sf_dir):
    found = catalog.find_blocks_by_name(V.deps(spark, sf_dir), ["K5", "K20", "k5", "C1"], "component_name")
    return found.select("id", "component_name")


def _bfs_sql(graph: str, seeds: str, depth: int) -> str:
    """Recursive expansion; a block counts at its first level, by class before component."""
    return f"""g as materialized (select * from {graph}),
 edges as (select a.id src, b.id dst, 0 via from (
   select id, unnest(list_concat(coalesce(injects, []), coalesce(implements, []), case when "extends" is null then [] else [ "extends" ] end)) name from g) a
   join g b on b.class_name = a.name
  union all select a.id, b.id, 1 from (select id, unnest(calls_components) name from g) a join g b on b.component_name = a.name),
 walk as (select id, 0 level, 0 via from g where id in ({seeds})
  union select e.dst, w.level + 1, e.via from walk w join edges e on e.src = w.id where w.level < {depth}),
 found as (select id, min(level) level, min(via) filter (level = first_level) via from
  (select *, min(level) over (partition by id) first_level from walk) group by id having min(level) > 0)"""


def _register_expansion() -> None:
    seeds = "select s_suppkey from supplier where s_nationkey = 7"
    for depth in (1, 2, 3):
        sql = (
            f"with recursive {_bfs_sql(V.DEPS_SQL, seeds, depth)} "
            "select id, cast(level as bigint) level, cast(via as bigint) via from found"
        )

        def run(spark, sf_dir, depth=depth):
            graph = V.deps(spark, sf_dir)
            start = graph.where(F.col("s_nationkey") == 7).select("id")
            return expand_dependencies(graph, start, depth).select("id", "level", "via")

        query(f"expand_depth{depth}", sql)(run)


_register_expansion()


@query(
    "expand_stored",
    f"""with recursive {_bfs_sql(V.DEPS_SQL, "select s_suppkey from supplier where s_nationkey = 7", 3)}
 select id, cast(level as bigint) level, cast(via as bigint) via from found""",
)
def _expand_stored(spark, sf_dir):
    """Three levels over the names stored with an index, whose rows no level reads."""
    path = _new_root(spark, "index")
    graph = V.deps(spark, sf_dir).withColumn("ordinal", F.col("id").cast("int"))
    rows = graph.withColumns(
        {"node_type": F.lit("class_declaration"), "language": F.lit("java"), "content": F.lit(""), "end_line": F.col("start_line"), "file_sha256": F.col("file_path")}
    )
    block_index.write_blocks(spark, path, rows.drop("id", "s_nationkey"), buckets=8)
    seeds = block_index.read_index(spark, path, "n7")
    found = reach_stored(partial(block_index.read_names, spark, path), seeds, 3)
    if found is None:
        return seeds.where(F.lit(False)).select(F.col("ordinal").alias("id"), F.lit(0).alias("level"), F.lit(0).alias("via"))
    return found.select(F.col("ordinal").alias("id"), "level", "via")


# Documents as blocks that name each other: every block is class C{id} and injects another.
# ``{n}`` is the number of documents.
_LINKED = {
    "class_name": "concat('C', doc_id)",
    "injects": "array(concat('C', doc_id * 7 % {n}))",
    "extends": "case when doc_id % 2 = 0 then concat('C', doc_id * 3 % {n}) end",
    "component_name": "cast(null as string)",
    "implements": "cast(null as array<string>)",
    "calls_components": "cast(null as array<string>)",
}
_LINKED_SQL = (
    "(select doc_id id, concat('C', doc_id) class_name, list_value(concat('C', doc_id * 7 % (select count(*) from documents))) injects, "
    "cast(null as varchar[]) implements, case when doc_id % 2 = 0 then concat('C', doc_id * 3 % (select count(*) from documents)) end \"extends\", "
    "cast(null as varchar) component_name, cast(null as varchar[]) calls_components, source file_path, "
    f"cast({V.START_LINE} as int) start_line, lang \"language\" from documents)"
)


@query(
    "search_code",
    f"""with recursive {_scores_sql(256)},
 top as (select doc_id id, score, row_number() over (order by round(score, 9), doc_id) "rank" from scores
  join (select doc_id k2, lang from documents) on k2 = doc_id where lang = 'en' order by round(score, 9), doc_id limit 10),
 {_bfs_sql(_LINKED_SQL, 'select id from top', 2)}
 select "rank", id, {ROUND.format('score', 6)} score, false is_dependency from top
 union all select (select count(*) from top) + row_number() over (order by level, via, file_path, start_line, g.id), g.id, null, true
 from found join g on g.id = found.id""",
)
def _search_code(spark, sf_dir):
    documents = V.spread_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    n = max(V.table(spark, sf_dir, "documents").count(), 1)
    rows = documents.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("file_path"),
        F.col("lang").alias("language"),
        F.expr(V.NODE_TYPE).alias("node_type"),
        F.expr(f"cast({V.START_LINE} as int)").alias("start_line"),
        F.lit(0).alias("ordinal"),
        F.col("text").alias("content"),
        *[F.expr(e.replace("{n}", str(n))).alias(name) for name, e in _LINKED.items()],
    )
    index = embed_blocks(rows, hashed_words(256)).drop("embed_error")
    found = search_code(
        index, _QUERY_TEXT, hashed_words(256), 10, language="en", expand_dependencies=True, dependency_depth=2
    )
    return found.select("rank", "id", rounded(F.col("score")).alias("score"), "is_dependency")
