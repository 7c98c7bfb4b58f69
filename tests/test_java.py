from codeloom.operators.extract import java_blocks

SOURCE = '''package a.b;
import a.b.T1;
/* import no.No; */
import static java.util.Map.*;
/** doc { @Foo class X { } */
@Path("/p{1}") @Named
public abstract class Foo<T extends Bar<T>> extends Base implements Comparable<Foo<T>>, Serializable, a.b.C {
  @Inject private Svc s;
  @Inject("n}") Provider<Foo> r = null;
  @InjectMocks Mock m, n;
  @Inject int z;
  private final String plain;
  @Inject public Foo(@Named("x") Svc s) { super(s); this.s = s; init(); }
  /* c */ public <X> Map<String, List<X>> run(final P p, int n, String... rest, byte[] data, java.util.Date d, List<String> l) throws IOException, B {
    s.go(p); log.info("a(b"); s.go(n); // skip(me)
    if (x) { return new Builder(1, f(2)).with("q").build(); }
    ((Foo) y).bar(); "lit".equals(z); arr[1].foo(); char c = '"'; when(x).then(y);
    a.b().deep(new Q() { @Override public void anon(int k) { inner(k); } });
    for (Foo f : foos) { foo(x -> { call(x); }); }
    String t = """
      text { } " class Z { """;
    return null;
  }
  abstract java.util.Date nothing();
  static class Inner { Inner() {} int[] arr()[] { return null; } }
  enum E { A { int v() { return 1; } }, B; int w() { return 2; } }
  interface I { default void d() { } String q(); }
  @interface An { String value(); int n() default 1; }
  record R(int x) { R { check(x); } void m() {} }
}
'''


def by_name(rows):
    return {r.get("method_name") or r["class_name"]: r for r in rows}


def test_blocks_in_order(blocks):
    rows = blocks(java_blocks, {"A.java": SOURCE})
    names = [r.get("method_name") or r["class_name"] for r in rows]
    # Constructors, annotation elements and interfaces are no blocks; their methods are.
    assert names == ["Foo", "run", "anon", "nothing", "Inner", "arr", "v", "w", "d", "q", "m"]
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))
    assert all(r["imports"] == ["import a.b.T1;", "import static java.util.Map.*;"] for r in rows)


def test_class_metadata(blocks):
    top = by_name(blocks(java_blocks, {"A.java": SOURCE}))["Foo"]
    assert (top["start_line"], top["end_line"]) == (6, 30)
    assert top["content"].startswith('@Path("/p{1}") @Named\npublic') and top["content"].endswith("\n}")
    assert top["extends"] == "Base"
    assert top["implements"] == ["Serializable"]  # generic and qualified types are not simple names
    assert top["annotations"] == ['@Path("/p{1}")', "@Named"]
    assert top["injects"] == ["Svc", "Provider<Foo>", "Mock"]
    assert "method_name" not in top and "calls" not in top


def test_method_metadata(blocks):
    named = by_name(blocks(java_blocks, {"A.java": SOURCE}))
    run = named["run"]
    assert run["return_type"] == "Map<String, List<X>>"
    assert run["param_types"] == ["P", "byte[]", "List<String>"]
    assert run["calls"] == [
        "s.go", "log.info", "new Builder", "f", "", '"lit".equals', "arr[1].foo", "when", "a.b", "inner",
        "foo", "call",
    ]
    assert "class_name" not in run
    assert named["anon"]["annotations"] == ["@Override"]
    assert "return_type" not in named["nothing"]  # a qualified type is not collected
    assert named["nothing"]["content"] == "abstract java.util.Date nothing();"


def test_generic_parent_is_not_collected(blocks):
    (row,) = blocks(java_blocks, {"A.java": "class A extends B<C> { }"})
    assert "extends" not in row and row["imports"] == []


def test_characters_beyond_ascii_do_not_shift_spans(blocks):
    (row, _) = blocks(java_blocks, {"A.java": "// é𝒳 ü\nclass Ä { void ö() { } } // rest"})
    assert row["content"] == "class Ä { void ö() { } }" and row["class_name"] == "Ä"


def test_unclosed_runs_to_the_end(blocks):
    rows = blocks(java_blocks, {"A.java": "class A { void m() { x();"})
    assert [r["content"] for r in rows] == ["class A { void m() { x();", "void m() { x();"]


def test_files_without_blocks_are_kept_on_request(blocks):
    rows = blocks(java_blocks, {"E.java": "", "C.java": "// no"}, keep_empty=True)
    assert rows == [{"file_path": "C.java"}, {"file_path": "E.java"}]


def test_large_inputs_need_no_stack(blocks):
    many = "class A { void m() { " + 'x.y(z).w("s"); ' * 20000 + "} }"
    rows = blocks(java_blocks, {"a": many, "b": "{" * 20000, "c": "(" * 20000, "d": '"' + "x" * 200000 + '"'})
    assert [r["file_path"] for r in rows] == ["a", "a"]
    assert rows[1]["calls"] == ["x.y"]


def test_deep_headers_are_declarations(blocks):
    source = """@X(a=@B(c=@D(e=@E(f=@G(h=@I(1)))))) class K {
  List<@Size(max=3) String> sized(List<@Size(max=3) String> p) { }
  @X(a=@B(c=@D(e=@E(f=@G(h=@I(j=@L(1))))))) void annotated() { }
  A<B<C<D<E<F<G<H<I>>>>>>>> generic() { }
}
"""
    assert [r.get("method_name") or r["class_name"] for r in blocks(java_blocks, {"K.java": source})] == [
        "K", "sized", "annotated", "generic",
    ]


def nested(n, open_, close, core="1"):
    return open_ * n + core + close * n


def test_headers_of_any_depth(blocks):
    deep = "@A(x = " + nested(60, "@B(y = ", ")") + ")"
    generic = nested(60, "List<", ">", "String")
    inside = "List<@P(a=@Q(b=@R(c=@S(d=1)))) String>"
    source = f"""{deep} @Z(1)
class C<T extends {generic}> implements I, J<{generic}>, K {{
  {deep} {generic} one({generic} p, {deep} final Q<R> q) {{ return a(b(c(d(e({nested(70, "(", ")")}))))); }}
  {inside} two();
  @Inject({nested(40, "(", ")")}) Provider<{generic}> held;
  void three({deep} int a, {deep} Foo b) throws E {{ new Q(f({nested(30, "g(", ")", "")})) {{ void four(@N(h(1)) X x) {{ k(); }} }}; }}
}}
"""
    rows = blocks(java_blocks, {"A.java": source})
    named = by_name(rows)
    assert list(named) == ["C", "one", "two", "three", "four"]
    assert named["C"]["annotations"] == [deep, "@Z(1)"] and named["C"]["implements"] == ["I", "K"]
    assert named["C"]["injects"] == [f"Provider<{generic}>"]
    assert named["one"]["annotations"] == [deep] and named["one"]["return_type"] == generic
    assert named["one"]["param_types"] == [generic, "Q<R>"]
    assert named["one"]["calls"] == ["a", "b", "c", "d", "e"]
    assert named["two"]["return_type"] == inside and named["two"]["content"] == f"{inside} two();"
    assert named["three"]["param_types"] == ["Foo"] and named["three"]["calls"] == ["f", "g", "k"]
    assert named["four"]["param_types"] == ["X"]
    assert "".join(r["content"] for r in rows if r["node_type"] == "class_declaration") in source


def test_calls_followed_by_members_at_any_depth(blocks):
    arg = nested(40, "h(", ")", "")
    source = f"class C {{ void m() {{ new B({arg}).go(); (({arg})).run(); x.y({arg}).z(); v.<T>w({arg}); new N({arg}); }} }}"
    calls = by_name(blocks(java_blocks, {"A.java": source}))["m"]["calls"]
    assert calls == ["new B", "h", "", "x.y", "v.<T>w"]


def test_unclosed_brackets_spoil_their_block_only(blocks):
    source = "class C { void a() { f(g(1; } @A(@B(1)) void b(@D(@E(2)) P p) { h(); } int c() { return x < y; } List<Set<Q>> d() { } }"
    named = by_name(blocks(java_blocks, {"A.java": source}))
    assert list(named) == ["C", "a", "b", "c", "d"]
    assert named["b"]["annotations"] == ["@A(@B(1))"] and named["b"]["param_types"] == ["P"]
    assert named["d"]["return_type"] == "List<Set<Q>>"


def test_patterns_name_marks_as_ranges():
    """A class that lists characters beyond Latin-1 singly is several times slower on nested headers."""
    from codeloom.operators.extract import java

    for pattern in (java.LEXER, java.CALLS, java.METHOD, java.CLASS):
        assert not any(a + b in pattern for a, b in zip(java.MARKS, java.MARKS[1:], strict=False))
