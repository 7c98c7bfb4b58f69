from codeloom.functions.jsx_scan import spans
from codeloom.operators.extract import cfml_blocks, html_blocks, jsx_blocks, sql_blocks
from hypothesis import given, settings
from hypothesis import strategies as st

COMPONENT = """import React, { useState } from 'react';
import './x.css'
// function no() {}
export default function App({ a = {}, b }) {
  const add = async (x) => s < x && x > 2 ? <b>it's {x} don't</b> : null;
  const f = x => y => x + y
  const g = `t ${a.map(q => `<i>${q}</i>`)} '`;
  const r = /[/"']\\/</.test(a);
  useEffect(() => { run("=> function x() {"); return () => stop(); }, []);
  return (
    <div className="a > b" onClick={() => go({k: 1})} {...b}>
      Don't {s > 1 ? <span>many</span> : <Foo.Bar x="1" />} they're
      {list.map(i => <li key={i}>{i}</li>)}
      <>frag</>
    </div>
  );
}
const X = function named() { return <p/>; };
async function load() { useA(useA()) }
"""


def test_jsx(blocks):
    rows = blocks(jsx_blocks, {"A.jsx": COMPONENT})
    assert [r["node_type"] for r in rows if r["node_type"] != "arrow_function"] == [
        "function_declaration", "jsx_element", "jsx_element", "jsx_element", "jsx_element", "jsx_element",
        "function_declaration",
    ]
    arrows = [r["content"] for r in rows if r["node_type"] == "arrow_function"]
    assert arrows == [
        "async (x) => s < x && x > 2 ? <b>it's {x} don't</b> : null",
        "x => y => x + y", "y => x + y", "q => `<i>${q}</i>`",
        '() => { run("=> function x() {"); return () => stop(); }', "() => stop()",
        "() => go({k: 1})", "i => <li key={i}>{i}</li>",
    ]
    assert rows[0]["component_name"] == "App" and rows[0]["hooks"] == ["useEffect"]
    assert (rows[0]["start_line"], rows[0]["end_line"]) == (4, 17)
    assert rows[0]["imports"] == ["import React, { useState } from 'react';", "import './x.css'"]
    assert rows[-1]["content"].startswith("async function load") and rows[-1]["hooks"] == ["useA"]
    assert all("component_name" not in r for r in rows if r["node_type"] != "function_declaration")


PIECES = ["<", ">", "{", "}", "(", ")", "`", "${", "=>", "function f", "a", " ", '"', "'", "/", "\n", "<div", "</div>", "/>", ";", ",", "async", "import 'x'"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_jsx_spans_are_sound(text):
    for span in spans(text):
        assert 1 <= span["start_line"] <= span["end_line"] <= text.count("\n") + 1
        assert span["content"] and span["content"] in text


def test_html_top_level_elements(blocks):
    pages = {
        "0": '<!DOCTYPE html><html><body><p>x<script>var t="</p>"</script></body>\n',
        "1": "<!-- <i> --><p>1</p>\n<div><p>x</p></div>",
        "2": "<p>a<p>b\n<div>c</div><br>text<script>1</script></i><b><i>x</b><img src='a>b'/>",
        "3": "x < y",
        "4": "<div><b>x</div><div>y</div><tr><td>a<tr><td>b",
    }
    rows = blocks(html_blocks, pages)
    assert [(r["file_path"], r["content"], r["start_line"], r["end_line"]) for r in rows] == [
        ("0", '<html><body><p>x<script>var t="</p>"</script></body>\n', 1, 2),
        ("1", "<p>1</p>", 1, 1),
        ("1", "<div><p>x</p></div>", 2, 2),
        ("2", "<p>a", 1, 1),
        ("2", "<p>b\n", 1, 2),
        ("2", "<div>c</div>", 2, 2),
        ("2", "<br>", 2, 2),
        ("2", "<b><i>x</b>", 2, 2),
        ("2", "<img src='a>b'/>", 2, 2),
        ("4", "<div><b>x</div>", 1, 1),
        ("4", "<div>y</div>", 1, 1),
        ("4", "<tr><td>a", 1, 1),
        ("4", "<tr><td>b", 1, 1),
    ]


def test_cfml(blocks):
    text = """<CFFUNCTION name="pre" ReturnType='void'></CFFUNCTION>
<cfcomponent hint="a name = 'x' > y" >
<cffunction NAME=fn1 returntype="query"><cfinvoke component="A.B" method="m"> new Zed() new Z9 ( ) new Zed()
<cfquery name="q" datasource="d">
  SELECT a FROM #t# join dbo.x ON 1 update Foo from FOO
</cfquery>
</cffunction>
<cfquery name="e"> </cfquery>
</cfcomponent>
<cfquery name="open">"""
    rows = blocks(cfml_blocks, {"p/My.comp.cfc": text}, sql_dialect="sybase")
    assert [(r["node_type"], r["start_line"], r["end_line"]) for r in rows] == [
        ("cffunction", 1, 1),
        ("cfcomponent", 2, 9),
        ("cffunction", 3, 7),
        ("cfquery", 4, 6),
        ("sql_injection", 4, 6),
        ("cfquery", 8, 8),
        ("cfquery", 10, 10),
    ]
    assert rows[0]["component_name"] == "My.comp" and rows[0]["return_type"] == "void"
    assert rows[2]["component_name"] == "a name = 'x' > y" and rows[2]["function_name"] == "fn1"
    assert rows[2]["calls_components"] == ["A.B", "Zed", "Z9"]
    query = rows[4]
    assert query["content"] == "SELECT a FROM #t# join dbo.x ON 1 update Foo from FOO"
    assert query["language"] == "sql" and query["tables"] == ["#T#", "DBO", "FOO"]
    assert query["sql_dialect"] == "sybase" and query["injection_source_line"] == 4
    assert "component_name" not in rows[3]


def test_one_function_and_query_on_a_line(blocks):
    rows = blocks(cfml_blocks, {"a.cfm": "x<cffunction name='f'><cfquery>select 1</cfquery></cffunction>y"})
    assert [r["node_type"] for r in rows] == ["cffunction", "cfquery", "sql_injection"]
    assert rows[0]["content"] == rows[1]["content"]  # whole lines
    assert rows[2]["content"] == "select 1"


def test_sql(blocks):
    text = """-- c; x
/* a;b */ CREATE TABLE t (id INT) -- tail
 ;insert into t values ('a;b', 'it''s', "x;y") ;;
  ;
alter x; drop
  y -- z;
; select $$ a;b $$ - 1 / 2 -- end"""
    rows = blocks(sql_blocks, {"a.sql": text, "b.sql": "-- no\n"}, sql_dialect="oracle")
    assert [(r["content"], r["start_line"], r["end_line"], r["block_type"][:3]) for r in rows] == [
        ("CREATE TABLE t (id INT)", 2, 2, "ddl"),
        ("insert into t values ('a;b', 'it''s', \"x;y\")", 3, 3, "dml"),
        ("alter x", 5, 5, "ddl"),
        ("drop\n  y", 5, 6, "ddl"),
        ("select $$ a;b $$ - 1 / 2", 7, 7, "dml"),
    ]
    assert {r["sql_dialect"] for r in rows} == {"oracle"}


def test_query_closed_with_blanks_before_the_bracket(blocks):
    from codeloom.operators.extract.cfml import cfml_blocks

    found = blocks(cfml_blocks, {"a.cfm": '<cfquery name="q">SELECT 1 FROM t</cfquery >'})
    assert [(b["node_type"], b["content"]) for b in found][1:] == [("sql_injection", "SELECT 1 FROM t")]


def statements(blocks, text):
    return [(r["content"], r["block_type"], r["start_line"], r["end_line"]) for r in blocks(sql_blocks, {"a.sql": text})]


def test_bodies_and_separator_lines(blocks):
    text = "CREATE PROCEDURE p AS BEGIN SELECT 1; SELECT 2; END;\nGO\nCREATE TABLE t (a INT);\n"
    assert statements(blocks, text) == [
        ("CREATE PROCEDURE p AS BEGIN SELECT 1; SELECT 2; END", "ddl_statement", 1, 1),
        ("CREATE TABLE t (a INT)", "ddl_statement", 3, 3),
    ]


def test_oracle_routines(blocks):
    routine = """CREATE OR REPLACE FUNCTION f(a INT) RETURN INT IS
  n INT := 0; -- BEGIN; not a body
  CURSOR c IS SELECT 1 FROM dual;
BEGIN
  IF a > 1 THEN n := 2; END IF;
  LOOP n := CASE WHEN n > 3 THEN 1 ELSE 2 END; EXIT; END LOOP;
  RETURN n;
END f"""
    block = "DECLARE\n  x INT;\nBEGIN\n  BEGIN x := 1; END;\nEND"
    text = f"{routine};\n/\n{block};\n/\nSELECT 'GO\nGO' FROM t WHERE a / 2 > 1;\nDROP TABLE u"
    assert [(c, k) for c, k, _, _ in statements(blocks, text)] == [
        (routine, "ddl_statement"),
        (block, "dml_statement"),
        ("SELECT 'GO\nGO' FROM t WHERE a / 2 > 1", "dml_statement"),
        ("DROP TABLE u", "ddl_statement"),
    ]


def test_statements_that_only_look_like_bodies(blocks):
    text = "BEGIN TRAN; UPDATE a SET begin_at = 1; COMMIT;\nBEGIN; SELECT 1; END\nGO\nSELECT CASE WHEN x = 1 THEN 'END;' END, 2; select 3;\ngo 5\nCREATE PROC q AS SELECT 4; SELECT 5\nGO\nBEGIN SELECT 6; "
    got = [c for c, _, _, _ in statements(blocks, text)]
    assert got == [
        "BEGIN TRAN", "UPDATE a SET begin_at = 1", "COMMIT", "BEGIN", "SELECT 1", "END",
        "SELECT CASE WHEN x = 1 THEN 'END;' END, 2", "select 3", "CREATE PROC q AS SELECT 4", "SELECT 5", "BEGIN SELECT 6",
    ]


def test_cfml_of_many_functions_is_linear(blocks):
    """Nearest closing lines and the last component, over a file a fold would walk for minutes."""
    import time

    n = 4000
    body = "\n".join(f'<cffunction name="f{i}">\n<cfreturn {i}>\n</cffunction>' for i in range(n))
    text = f'<cfcomponent displayname="K">\n{body}\n</cfcomponent>\n<cffunction name="open">'
    started = time.time()
    rows = blocks(cfml_blocks, {"x.cfc": text})
    assert time.time() - started < 60
    assert len(rows) == n + 2 and rows[0]["end_line"] == 3 * n + 2
    assert (rows[5]["function_name"], rows[5]["start_line"], rows[5]["end_line"]) == ("f4", 14, 16)
    assert rows[-1]["function_name"] == "open" and rows[-1]["end_line"] == rows[-1]["start_line"]
    assert {r["component_name"] for r in rows} == {"K"}
