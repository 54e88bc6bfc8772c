"""Parsers: shapes of trees, positions, broken input; and what patterns compile to."""

import pytest

from arborql.langs import BY_EXTENSION, LANGUAGES, language
from arborql.langs.index import Tree
from arborql.plans.pattern import compile_pattern
from arborql.plans.query import compile_query
from arborql.rules import RuleError
from arborql.sources.nodes import rows_of

SAMPLES = {
    "swift": 'import Foundation.NSObject\n/* c */ @objc public final class A<T: B>: C, D where T: E {\n  private(set) weak var x: Int? = 1, y = [String: [Int]]()\n  static let z = { (a: Int, b) -> Int in return a + b }\n  var c: Int { get { return 1 } set(v) { x = v } }; lazy var d: String = "é \\(x!) \\(f("q"))"\n  init?(a b: Int, _ c: String..., d: @escaping (Int) throws -> Void = { _ in }) throws { super.init(); self.x = b as? Int }\n  override func f<U>(_ x: inout U, with y: [U]) async throws -> (Int, String)? { return nil }\n  deinit { }\n  subscript(i: Int) -> Int { return i }\n}\nenum E: String, CaseIterable { case a = "x", b(Int, l: String); indirect case c; func g() {} }\nprotocol P: AnyObject { associatedtype T; func m(); var q: Int { get } }\nextension A.B: P { typealias X = Int }\nfunc main() {\n  let v = try! load(); let w = x as! String; if count == 0 && !list.isEmpty { print(a, b) } else if let q = r?.s, let t = u { fatalError("x") }\n  guard let self = self, case .b(let n, _) = e else { return }\n  for i in 0..<10 where i % 2 == 0 { continue }; while true { break }; repeat { x += 1 } while x < 3\n  switch v { case .a, .b(1, l: "z"): f(); case let (x, y) where x > y: break; case 1...5: fallthrough; case is String: x = x; default: throw E.a }\n  DispatchQueue.main.sync { [weak self] in self?.go() }; list.map { $0 * 2 }.filter({ $0 > 1 }).forEach(print)\n  do { try f(x: 1) } catch let e as Err { NSLog("%@", e) } catch { }\n  let t = a ? b : c ?? d; let arr: [Int] = [1, 2], dic = ["a": 1, "b": 2], tup = (1, name: "x"); defer { close() }; #if DEBUG\n  print("d")\n  #endif\n  let k = \\A.x, s = #selector(f), r = """\n    multi \\(x)\n    """, u = await g(), n = -x + ~y, m = Array<Int>(repeating: 0, count: 1); arr[0].b!.c = 0xFF\n}\n',
    "kotlin": '@file:Suppress("x")\npackage a.b\nimport a.b.C as D\nimport x.*\n/* c */ data class P<out T : Any>(val a: Int = 1, private var b: List<T?>) : Base(a), I by d { companion object { const val X = 1 }\n  init { check(a > 0) } constructor(x: String) : this(x.toInt()) { }\n  override fun <R> f(x: (Int, T) -> R?, vararg y: String = "é"): R? = x(1, b[0]!!) as? R\n  var z: Int = 0\n    get() = field\n    private set(v) { field = v }\n  lateinit var q: Map<String, *>\n}\nenum class E(val i: Int) { A(1), B(2) { override fun g() {} }; abstract fun g() }\nsealed interface S { object O : S }\nsuspend fun main(args: Array<String>) {\n  val (a, b) = 1 to 2; var s = "a $a ${b.c("d")} e"; println(s); GlobalScope.launch { delay(10L) }; Thread.sleep(100)\n  if (a == true && b != null || !c) return else { x = x }\n  for (i in 0..10 step 2) { continue }; while (true) break\n  val r = when (val k = f()) { 1, 2 -> "a"; in 3..4 -> { "b" } is String -> k.length; else -> throw E("x") }\n  try { a?.b?.let { it -> it.c!! } ?: return@main } catch (e: Exception) { e.printStackTrace() } finally { }\n  list.filter { it > 1 }.map(::foo).forEach { (k, v) -> println("$k") }; val f = fun(x: Int): Int { return x }\n  val o = object : R { override fun run() {} }; TODO("x"); a[1] = b[2] + 3 * -4 % 5; if (list.size == 0) foo<Int>(x = 1, *y)\n  x += 1; val t = """raw ${x} "q" """; do { y++ } while (y < 3); label@ for (p in q) { break@label }; val u = 0xFF shl 2; val fn = A::class.java\n}\ntypealias F = (Int) -> Unit\nval <T> List<T>.last2: T get() = this[size - 1]\nfun String.ext() = this\n',
    "csharp": 'using System; using static A.B; using X = Y.Z<int>;\nnamespace N.M { \n[Serializable, Attr(1, Name = "x")] public abstract partial class A<T> : B<T>, IC where T : class, new() {\n  private readonly int _x = 1, y; public string Name { get; private set; } = "a"; public int P => _x; event EventHandler E;\n  public A(int a, params string[] b) : base(a) { this._x = a; } ~A() { }\n  public async void F<U>(ref int x, out string? s, List<Dictionary<string, U>> d = null) {\n    await Task.Delay(1).ConfigureAwait(false); var r = t.Result; t.Wait(); Console.WriteLine($"é {x.ToString()} {y:0.0}"); \n    try { G(); } catch (Exception ex) when (ex.M > 1) { throw ex; } catch { } finally { }\n    foreach (var (k, v) in d) { } foreach (int i in xs) continue; for (int i = 0, j = 1; i < 10; i++, j--) { }\n    if (x == null || null != y) return; int? n = a ? b : c ? d : e; x ??= 1; var q = x?.Y?[0] ?? throw new E("a");\n    var f = (int a, b) => a + b; Func<int, int> g = z => { return z; }; x = x == x ? (int)3.5m : (string)o; using (var w = new S()) { } using var u = new T { A = 1, B = { 2 } };\n    switch (x) { case 1: case > 2 when z: break; case string s2: goto case 1; default: return; }\n    var sw = x switch { 1 => "a", >= 2 and < 5 => "b", null => "c", { A: 1 } p => "d", _ => @"e ""x""" }; lock (this) { } int[] arr = new int[3]; var l = new[] { 1, 2 }; a[1, 2] = b >> 3; a <<= 1;\n    if (o is string str && o is not null) { } var tup = (1, b: 2); M(out var oo, name: 1); int L(int k) => k * 2; List<int> lst = new(); x = y!;\n  }\n  public static A operator +(A a, A b) => a; public int this[int i] { get => 1; set { } } enum C : byte { X = 1, Y } record R(int A, string B); interface I { void M(); } delegate int D(int x);\n}}\n',
    "rust": '#![allow(dead_code)]\nuse std::{fmt, io::{self, Read as R}, a::*};\n/// doc\n#[derive(Debug, Clone)]\npub(crate) struct S<\'a, T: Clone + \'a = u8, const N: usize = 3> where T: X { pub a: &\'a mut [T; N], b: Option<Box<dyn Fn(i32) -> Result<(), E>>> }\nstruct U(pub i32, f64); enum E { A, B(i32), C { x: u8 }, D = 4 }\nimpl<\'a, T> Iterator for S<\'a, T> { type Item = T; const X: i32 = -1; fn next(&mut self) -> Option<Self::Item> { self.a?.b()[0].await } }\ntrait Tr: Sized { fn f(self: Box<Self>, x: impl Into<String>) -> i32 { 1 } fn g(); }\npub async fn main() -> Result<(), Box<dyn Error>> {\n    let mut v: Vec<_> = (0..10).map(|x| x * 2).filter(|&x| x > 1 && x < 3).collect::<Vec<i32>>();\n    if let Some(ref x) = y && z { return Ok(()) } else if a == true { b() } else { c() };\n    match x { 1..=5 | 7 => {} Some(E::B(n)) if n > 3 => n, E::C { x, .. } => { f(); } _ => panic!("é {}", b), }\n    \'outer: loop { while i < 10 { i += 1; continue \'outer; } break; }\n    for (i, x) in v.iter().enumerate() { println!("{} {}", i, x); v[i] = x as f32 >> 2; }\n    let s = S { a: 1, b, ..Default::default() }; let t = (1, \'c\', "s", b"x", r#"raw"#, 1.5e3, 0xff_u8); x = x;\n    unsafe { std::mem::transmute::<u8, i8>(x) }; let c = move || x.unwrap(); let d = a.unwrap_or(String::new()); let Some(q) = w else { return };\n    v.iter().map(|x| x.unwrap()).sum::<i32>()\n}\nmacro_rules! m { ($x:expr) => { $x }; }\nmod tests { use super::*; #[test] fn t() { assert_eq!(1, 2); } }\n',
    "java": 'package a.b.c;\nimport java.util.*;\nimport static a.B.c;\n/** doc */\n@Deprecated\npublic abstract class A<T extends B & C> extends D<T> implements E, F<T[]> {\n  private static final int X = 1 << 3, Y[] = {1, 2};\n  @Override(a = "x", b = {1, 2}) public <U> Map<String, List<U>> f(final int a, String... b) throws IOException, X {\n    for (int i = 0, j = 1; i < 10; i++, j--) { continue; }\n    for (var x : xs) System.out.println(x + "é" + \'c\');\n    Runnable r = () -> {}; Function<A, B> g = x -> x.y(); BiFunction h = (p, q) -> p + q; foo(String::valueOf, int[]::new, a.b::c);\n    int k = (int) 3.5f >>> 2; k >>= 1; long l = 0xFFL;\n    String s = o instanceof String t && t.length() > 0 ? (String) o : null;\n    switch (k) { case 1: case 2: break; default: return; }\n    int z = switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E("a"); };\n    try (var in = open(); out) { a[0][1] = new int[3][]; } catch (A | B e) { throw e; } finally { x.<T>y(); }\n    synchronized (this) { assert a : "b"; }\n    new Thread(new Runnable() { @Override public void run() { this.a++; } }).start();\n    List<? extends A> w = new ArrayList<>(); label: while (true) { break label; } do { } while (!a);\n    Object c = A.class, d = int[].class;\n    if (a < b && c > d) return;\n    return;\n  }\n  static { init(); }\n  A(int x) { super(x); this.x = x; }\n  enum E implements X { A(1) { void m() {} }, B; int q; }\n  record R<T>(int a, T b) implements Z { R { check(); } }\n  @interface Ann { int value() default 1; }\n  interface I { default void x() {} int y(); }\n  int i = 1; A next;\n}\n',
    "c": '#include <stdio.h>\n#define N 3\ntypedef struct node { int a, *b[N]; struct node *next; } node_t;\nstatic const char *names[] = {"a", "b"};\nint main(int argc, char **argv) {\n  char *p = malloc(10); node *q = (node *)malloc(sizeof(node)); unsigned long n = sizeof *q;\n  if (p = next(p)) return 1;\n  while ((c = getchar()) != EOF) { strcpy(buf, src); x->y[0].z++; }\n  for (int i = 0; i < n; i++) sprintf(buf, "é%d", i); a = b * c; foo * bar;\n  switch (n) { case 1: break; default: goto end; }\n  if (f == 0.1f || x == x) gets(line); else { do { } while (0); }\nend: return (int)x ? a : b, c;\n}\nvoid (*handler)(int, void *);\n',
    "cpp": '#include <vector>\nusing namespace std;\nnamespace a::b { template <typename T, int N = 3> class A : public B<T>, private C { public: explicit A(int x) : B<T>(x), y_{x} {} ~A(); virtual void f() const override = 0; A& operator=(const A&) = delete; template <class U> U g(U&& u) { return std::forward<U>(u); } private: std::map<std::string, std::vector<int>> m_; int y_ = 0; }; }\nint main() {\n  auto p = new int[3]; delete[] p; delete q; int *r = NULL; auto s = std::make_unique<Foo>(1, 2);\n  for (const auto& [k, v] : m) { std::cout << k << std::endl; }\n  auto f = [&, x](int a) -> int { return a + x; }; if (x = y) return 1; x = x; int z = (int)3.5; int w = static_cast<int>(y);\n  try { throw std::runtime_error("é"); } catch (const std::exception& e) { } catch (...) { }\n  switch (x) { case 1: break; } std::vector<int> v{1, 2}; Foo foo(1); while (x = next()) g(); if (auto it = m.find(1); it != m.end()) {}\n  return a < b && c > d ? 1 : 2;\n}\n',
    "go": 'package p // c\n\nimport (\n\t"fmt"\n\te "é"\n)\n\ntype S[T any] struct {\n\ta, b int `x`\n\tT\n}\n\nfunc (s *S[int]) M(f func(int) error, xs ...map[string][]T) (n int, err error) {\n\tfor i, x := range xs {\n\t\tgo func() { ch <- <-s.c }()\n\t}\n\tswitch v := x.(type) {\n\tcase nil, *T:\n\t\tx[1:2].y++\n\tdefault:\n\t\treturn S{a: 1, b: []int{2}}, &T{}\n\t}\n}\n',
    "python": '# c\n@d.e(1)\nasync def f(a, /, *b: int, c=1, **k) -> "é":\n    """doc"""\n    x: int = y = [i for i in a if i]; z += 1\n    with open(f"{a!r:>{w}} {{}}") as g, h:\n        yield lambda q, *r: q if r else {**k, 1: 2}\n    try:\n        pass\n    except (A, B) as e:\n        raise E from e\n    finally:\n        return a[1:, ::2], not b is not c\nclass C(D, m=1):\n    def g(self): return "a" \'b\' if (w := 3) else await x\n',
    "typescript": "// c\nimport a, { type b as c } from 'é';\nexport default class A<T extends B = {}> extends C<T> implements D {\n  private readonly x?: number = 1;\n  constructor(public y: string) { super(); }\n  get z(): Array<Map<string, T[]>> { return <any>this.x! as unknown }\n}\ntype F = (a: number, ...b: string[]) => a is string | `x${T}`;\ninterface I { [k: string]: F; m?(): void }\nenum E { A = 1, B }\nconst f = async <T,>(x: T, { y, ...z }: any = {}): Promise<T> => await x ?? z?.[0]?.(y) ;\nfor (const k of a) if (/[/]é/g.test(k)) continue; else break\n",
    "tsx": "// c\nlet x = <A.B c='é' {...d} e>don't {f(<></>)}<g/></A.B>;\nx++\n`a${`b${c}`}é`;\nfunction* g() { yield* a ? b : c / d / e }\nlabel: do { try { throw x } catch { } finally { } } while (a, b)\nvar { p: [q = 1], r } = s, t = { u() { }, get v() { return 1 }, [w]: async () => ({}), x, ...y };\nswitch (a) { case 1: default: delete b.c }\n",
    "json": '// c\n{"a": [1, -2.5e3, "x\\n\\u0041", true], "ü": {}, "e": ""}',
    "html": "<!DOCTYPE html><!-- c --><p class=\"é\" id=x>Hi <b>x &amp; y<li>one<li>two<script>if (a<b) {}</script><br/><img src='a'></div>",
    "xml": '<?xml version="1.0"?><!-- c --><r a="1"><b/>é<![CDATA[x]]>&lt;<c>t</c></r>',
    "yaml": "---\na: 1 # c\nb:\n  - x\n  - k: 'v'\n    l: \"w\"\nc: [1, {d: e}]\nd: |\n  text\n  # not one\n? odd\n",
    "css": '/* c */ #m > .a:hover, p a[href="x"] { color: red !important; background: url(é) } @media (max-width: 6px) { a { margin: 0 1.5px } }',
    "scss": "$v: 1px; // c\n.a { &:hover { color: $v; } @include m($v); }",
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("cut", [0, 1, 2, 3])
def test_trees_hold_together(name, cut):
    """Children lie inside their parents, in order, and rows agree with the text, for whole and for broken input."""
    source = SAMPLES[name]
    source = source[: len(source) * (4 - cut) // 4] if cut < 3 else source[::-1]
    lang = language(name)
    rows = rows_of(lang.parse(source), source, lang)
    data = source.encode()
    for i, p in enumerate(rows["parent"]):
        assert 0 <= rows["sb"][i] <= rows["eb"][i] <= len(data)
        assert rows["text"][i] in (None, data[rows["sb"][i] : rows["eb"][i]].decode()) and (rows["text"][i] is None) == (i in rows["parent"])
        assert rows["sr"][i] == data[: rows["sb"][i]].count(b"\n") and rows["sc"][i] == rows["sb"][i] - (data[: rows["sb"][i]].rfind(b"\n") + 1)
        if p is not None:
            assert p < i < rows["stop"][p] and rows["stop"][i] <= rows["stop"][p]
            assert rows["sb"][p] <= rows["sb"][i] and rows["eb"][i] <= rows["eb"][p], (rows["kind"][p], rows["kind"][i])
    tree = Tree(lang.parse(source), source, lang)
    for i in range(len(tree.nodes)):
        kids = tree.relevant(i)
        assert [tree.start(k) for k in kids] == sorted(tree.start(k) for k in kids) and [tree.rel_ord[k] for k in kids] == list(range(len(kids)))
    assert cut or sum(len(t) for t in rows["text"] if t) <= len(source)


def kinds(name, source):
    def show(n):
        inside = "".join(" " + show(k) for k in n.kids if k.named)
        return f"({n.kind}{inside})"

    return show(language(name).parse(source))


@pytest.mark.parametrize(
    ("name", "source", "want"),
    [
        ("json", '{"a": [1, null]}', "(document (object (pair (string (string_content)) (array (number) (null)))))"),
        ("json", '"a": 1', "(document (string (string_content)) (ERROR) (number))"),
        ("html", "<p>a<p>b", "(document (element (start_tag (tag_name)) (text)) (element (start_tag (tag_name)) (text)))"),
        ("html", "<a x>t</a>", "(document (element (start_tag (tag_name) (attribute (attribute_name))) (text) (end_tag (tag_name))))"),
        ("xml", "<a><b/></a>", "(document (element (STag (Name)) (content (element (EmptyElemTag (Name)))) (ETag (Name))))"),
        ("yaml", "a: 1\nb: x", "(stream (document (block_node (block_mapping (block_mapping_pair (flow_node (plain_scalar (string_scalar))) (flow_node (plain_scalar (integer_scalar)))) (block_mapping_pair (flow_node (plain_scalar (string_scalar))) (flow_node (plain_scalar (string_scalar))))))))"),
        ("go", "package p\nvar a = f(x...)", "(source_file (package_clause (package_identifier)) (var_declaration (var_spec (identifier) (expression_list (call_expression (identifier) (argument_list (variadic_argument (identifier))))))))"),
        ("go", "a.b = c[0]", "(source_file (assignment_statement (expression_list (selector_expression (identifier) (field_identifier))) (expression_list (index_expression (identifier) (int_literal)))))"),
        ("java", "a.b(c[0]);", "(program (expression_statement (method_invocation (identifier) (identifier) (argument_list (array_access (identifier) (decimal_integer_literal))))))"),
        ("c", "int *a = b->c;", "(translation_unit (declaration (primitive_type) (init_declarator (pointer_declarator (identifier)) (field_expression (identifier) (field_identifier)))))"),
        ("cpp", "A<B> a = new C(1);", "(translation_unit (declaration (template_type (type_identifier) (template_argument_list (type_descriptor (type_identifier)))) (init_declarator (identifier) (new_expression (type_identifier) (argument_list (number_literal))))))"),
        ("rust", "fn f() { a.b?; }", "(source_file (function_item (identifier) (parameters) (block (expression_statement (try_expression (field_expression (identifier) (field_identifier)))))))"),
        ("csharp", "a.B(c[0]);", "(compilation_unit (global_statement (expression_statement (invocation_expression (member_access_expression (identifier) (identifier)) (argument_list (argument (element_access_expression (identifier) (bracketed_argument_list (argument (integer_literal))))))))))"),
        ("kotlin", "val a = b.c(1)", "(source_file (property_declaration (binding_pattern_kind) (variable_declaration (simple_identifier)) (call_expression (navigation_expression (simple_identifier) (navigation_suffix (simple_identifier))) (call_suffix (value_arguments (value_argument (integer_literal)))))))"),
        ("swift", "let a = b!.c(1)", "(source_file (property_declaration (value_binding_pattern) (pattern (simple_identifier)) (call_expression (navigation_expression (postfix_expression (simple_identifier) (bang)) (navigation_suffix (simple_identifier))) (call_suffix (value_arguments (value_argument (integer_literal)))))))"),
        ("python", "def f(a=1):\n  return a.b", "(module (function_definition (identifier) (parameters (default_parameter (identifier) (integer))) (block (return_statement (attribute (identifier) (identifier))))))"),
        ("typescript", "let a: B[] = c as D", "(program (lexical_declaration (variable_declarator (identifier) (type_annotation (array_type (type_identifier))) (as_expression (identifier) (type_identifier)))))"),
        ("tsx", "<a b={c}>d</a>", "(program (expression_statement (jsx_element (jsx_opening_element (identifier) (jsx_attribute (property_identifier) (jsx_expression (identifier)))) (jsx_text) (jsx_closing_element (identifier)))))"),
        ("css", ".a { b: 1px }", "(stylesheet (rule_set (selectors (class_selector (class_name (identifier)))) (block (declaration (property_name) (integer_value (unit))))))"),
    ],
)
def test_shapes(name, source, want):
    assert kinds(name, source) == want


def test_deep_input_needs_no_deep_stack():
    lang = language("json")
    source = "[" * 3000 + "]" * 3000
    assert max(rows_of(lang.parse(source), source, lang)["depth"]) == 3001


@pytest.mark.parametrize(
    ("name", "body", "want"),
    [
        ("json", '"k": $V', "(pair (string_content) (:) $V)"), ("json", "[$$$L]", "(array ([) $$$L (]))"), ("html", "<$_ $$$ style=$_ $$$>", "(start_tag (<) $_ $$$ (attribute (attribute_name) (=) $_) $$$ (>))"),
        ("go", "$X $OP $X", "(binary_expression $X $OP $X)"), ("go", "f($A, $$$R)", "(call_expression (identifier) (argument_list (() $A $$$R ())))"), ("python", "$A $OP $B", "(comparison_operator $A $OP $B)"), ("typescript", "$X!", "(non_null_expression $X (!))"),
        ("python", 'f"{x} y"', "(string (string_start) (interpolation ({) (identifier) (})) (string_content) (string_end))"), ("tsx", "<$T $$$>$$$C</$T>", "(jsx_element (jsx_opening_element (<) $T (jsx_attribute $$$) (>)) $$$C (jsx_closing_element (</) $T (>)))"),
        ("xml", "<s $$$A>$$$C</s>", "(element (STag (<) (Name) $$$A (>)) $$$C (ETag (</) (Name) (>)))"), ("yaml", "- $X", "(block_sequence_item (-) $X)"), ("css", "$P: $$$V !important", "(declaration $P (:) $$$V (important))"),
        ("xml", "<a/><b/>", "sequence of 2 nodes: (EmptyElemTag (<) (Name) (/>)) (EmptyElemTag (<) (Name) (/>))"), ("scss", "$x: $V", "(declaration (variable_name) (:) $V)"), ("html", "hello $X", "sequence of 2 nodes: (attribute (attribute_name)) (attribute $X)"),
    ],
)
def test_patterns(name, body, want):
    assert str(compile_pattern(body, language(name))) == want


@pytest.mark.parametrize(("name", "body", "why"), [("html", "<p>hello $X</p>", "do not parse as standalone nodes"), ("css", ".b { $$$ }", "doesn't parse"), ("xml", '<a b="$$$X"/>', "inside quotes"), ("json", "$X", "alone"), ("json", '"a" $OP "b"', "parse"), ("go", "f($OP)", "parse"), ("swift", "let = 1", "parse")])
def test_patterns_that_do_not_compile(name, body, why):
    with pytest.raises(RuleError, match=why):
        compile_pattern(body, language(name))


@pytest.mark.parametrize("body", ["(a", "(a)", "(a) @x (#nope? @x)", "[(a) @x", ")"])
def test_queries_that_do_not_compile(body):
    with pytest.raises(RuleError):
        compile_query(f"({body})" if "#" in body else body)


def test_registry():
    assert language("JSONC").name == "json" and BY_EXTENSION[".svg"] == "xml" and BY_EXTENSION[".mjs"] == "tsx"
    assert {x.name for x in LANGUAGES} == set(SAMPLES) and len(set(BY_EXTENSION.values())) == 17
