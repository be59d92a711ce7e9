import pytest

from sylva.plans.evaluate import Array, Map, Untyped, evaluate, string_of
from sylva.plans.xpath import XPathError, normalized, parse, problem
from sylva.sources.parsers import ParseError
from sylva.sources.parsers import parse as parse_text
from sylva.sources.tree import subtree_text

JSON = '{"name": "Alice", "age": 30, "tags": ["a","b"], "o": {"x": {}}, "n": null, "l":[{"k":1},{"k":2}], "first name": "z"}'


def items(text, language, xpath, mode=None):
    return evaluate(normalized(xpath), parse_text(text, language, mode), {"file": "f.x"})


COUNTS = [
    ("//name[.='Alice']", 1), ("tags", 2), ("//l[k=2]", 1), ("//l[k>1]/k", 1), ("//*[@key='first name']", 1), ("//n[.='null']", 1), ("for $t in //tags return map{'t':string($t)}", 2),
    ("//o/x", 1), ("//l[2]", 1), ("(//l)[last()]/k", 1), ("//tags ! upper-case(.)", 2), ("//age[. * 2 = 60]", 1), ("//tags[following-sibling::tags]", 1), ("//tags[preceding-sibling::*[1][self::tags]]", 1),
    ("//k/ancestor::l", 2), ("//document/l/k | //name", 3), ("distinct-values((1,1,2))", 2), ("//l[not(k=1)]", 1), ("/", 1), ("$file", 1), ("array{//k}", 1), ("//k[position() < 2]", 2), ("//l[k][1]", 1),
    ("let $v:=//k return $v", 2), ("//k/..", 2), ("//*[self::k or self::name]", 3), ("//l/k/text()", 2), ("//zzz", 0), ("()", 0), ("1 to 4", 4), ("//l except //l[2]", 1), ("//l intersect //l[k=2]", 1),
    ("//k[@line = 1]", 2), ("//l[count(k)=1]", 2), ("//name/following::k", 2), ("//k/preceding::name", 1), ("//descendant::k", 2), ("//node()[self::text()]", 8), ("tokenize('a b  c')", 3),
]


@pytest.mark.parametrize("xpath,n", COUNTS)
def test_counts(xpath, n):
    assert len(items(JSON, "json", xpath)) == n


VALUES = [
    ("count(//tags)", 2), ("sum(//k)", 3), ("avg((1,2))", 1.5), ("max(//k)", 2), ("string-join(//tags, ',')", "a,b"), ("some $t in //tags satisfies $t='b'", True), ("every $t in //tags satisfies $t='b'", False),
    ("if (//zz) then 1 else 2", 2), ("fold-left(1 to 4, 0, function($a,$b){$a+$b})", 10), ("[1,2]?2", 2), ("map{'a':1}?a", 1), ("substring('hello', 2, 3)", "ell"), ("substring('hello', 0)", "hello"), ("substring('12345', 1.5, 2.6)", "234"),
    ("substring-before('a=b','=')", "a"), ("substring-after('a=b','=')", "b"), ("substring-after('ab','=')", ""), ("normalize-space('  a \n b ')", "a b"), ("translate('bar','abc','AB')", "BAr"), ("replace('abc','(b)','[$1]')", "a[b]c"),
    ("matches('abc','^a.c$')", True), ("contains('abc','b')", True), ("'a' || 'b' || 1", "ab1"), ("7 idiv 2", 3), ("-7 mod 3", -1), ("1 div 2", 0.5), ("6 div 2", 3), ("number('x') = number('x')", False), ("round(2.5)", 3), ("round(-2.5)", -2),
    ("string(1.0)", "1"), ("string(true())", "true"), ("boolean('')", False), ("not(//zz)", True), ("//age = 30", True), ("//age eq '30'", True), ("//name = ('x','Alice')", True),
    ("//tags[1] << //tags[2]", True), ("(//tags)[1] is (//tags)[1]", True), ("name((//tags)[1])", "tags"), ("//age instance of element()", True), ("5 instance of xs:integer", True), ("'5' cast as xs:integer", 5), ("'x' castable as xs:integer", False),
    ("map:merge((map{'a':1}, map{'b':2})) => map:size()", 2), ("array:size([1,2,3])", 3), ("(1 to 3) ! (. * 2) => sum()", 12), ("let $f := contains(?, 'b') return $f('abc')", True), ("sort((3,1,2))[1]", 1), ("reverse(1 to 3)[1]", 3),
    ("string-length('žluť')", 4), ("codepoints-to-string((72,105))", "Hi"), ("deep-equal(//l[1], //l[1])", True), ("index-of((1,2,1),1)[2]", 3), ("string(//l[1])", "1"), ("path((//k)[2])", "/document[1]/l[2]/k[1]"), ("head((4,5))", 4), ("serialize(//o)", "<o><x/></o>"), ("serialize(map{'a':1})", '{"a": 1}'),
]


@pytest.mark.parametrize("xpath,value", VALUES)
def test_values(xpath, value):
    # whole expressions are given as they are
    got = evaluate(xpath, parse_text(JSON, "json"))
    assert len(got) == 1
    assert (string_of(got[0]) if isinstance(value, str) else got[0]) == value


def test_map_and_array_items():
    m = evaluate("map { 'a': (1, 2), 'b': map { 'c': //name } }", parse_text(JSON, "json"))[0]
    assert isinstance(m, Map) and m["a"] == [1, 2]
    assert isinstance(evaluate("array { 1, 2 }", parse_text(JSON, "json"))[0], Array)
    from sylva.functions.items import item_to_json

    noted = []
    assert item_to_json(m, sequences=noted) == '{"b": {"c": "Alice"}, "a": [1, 2]}'
    assert noted == ["a"]


def test_errors_have_places():
    assert problem("//a[") is not None
    message, start, end = problem("//a[@b='1'")
    assert start == len("//a[@b='1'") and "]" in message
    assert problem("//a") is None
    for bad in ("unknown-function(1)", "'a' + 1", "$nope", "1 div 0"):
        with pytest.raises(XPathError):
            evaluate(bad, parse_text(JSON, "json"))


@pytest.mark.parametrize(
    "given,expected",
    [("class", "//class"), ("a/b", "//a/b"), ("//a", "//a"), ("(1)", "(1)"), ("count(//a)", "count(//a)"), (".", "."), ("$file", "$file"), ("'x'", "'x'"), ("let $a := 1 return $a", "let $a := 1 return $a"), ("true()", "true()"), ("a | //b", "//a | //b")],
)
def test_normalization(given, expected):
    assert normalized(given) == expected


def test_strict_normalization_prefixes_calls():
    assert normalized("true()", strict=True) == "//true()"
    # which is then evaluated once for each node
    assert len(evaluate("//true()", parse_text("<a><b/></a>", "xml"))) == 3


def test_untyped_comparisons():
    assert evaluate("//age > 4", parse_text(JSON, "json")) == [True]
    assert evaluate("//age > '4'", parse_text(JSON, "json")) == [False]  # as text
    assert isinstance(evaluate("data(//age)", parse_text(JSON, "json"))[0], Untyped)


LANGUAGES = [
    ("yaml", "a: 1\nb:\n  - x: 1\n  - x: 2\n---\na: 2\n", [("//document", 2), ("//b[x=2]", 1), ("//document[2]/a[.='2']", 1)]),
    ("yaml", "k: |\n  l1\n  l2\nq: 'h w'\n? first name\n: A\n", [("//k[contains(., 'l1')]", 1), ("//first_name[text()='A']", 1), ("//*[@key='first name']", 1)]),
    ("toml", 'title = "T"\n[database]\nport = 5432\n[database.cred]\nu="x"\n[[servers]]\nname="web-1"\nport=8080\n[[servers]]\nname="w2"\n[n]\np={x=1,y=2}\nf=["a","b"]\n"first name"="A"\n', [("//servers/item[name='web-1']/port[.='8080']", 1), ("//f/item", 2), ("//p/x[.='1']", 1), ("//database/cred/u", 1), ("//first_name", 1), ("//document", 1)]),
    ("ini", "; Global settings\nname=my-app\n[database.credentials]\nu = admin\n", [("//comment[.='Global settings']", 1), ("//database.credentials/u[.='admin']", 1), ("//name[.='my-app']", 1)]),
    ("env", 'export A=1\n# c\nB="x y"\n', [("//A[.='1']", 1), ("//B[.='x y']", 1), ("//comment", 1)]),
    ("markdown", "# A\n\ntext\n\n## B\n\n- x\n- y\n\n1. a\n2. b\n3. c\n\n> q\n\n```python\np\n```\n\n```\nz\n```\n\n---\n", [("//heading", 2), ("//heading[h1]", 1), ("//list[ordered]", 1), ("//list[unordered]", 1), ("//item", 5), ("//blockquote", 1), ("//code_block[language='python']", 1), ("//code_block[not(language)]", 1), ("//hr", 1)]),
    ("python", 'import os\n\ndef add(a, b):\n    return a + b\n\nasync def f(x: int) -> int:\n    # c\n    return g(x)\n\nclass K(B):\n    def m(self): pass\n\nprint(add(1, 2))\n', [("function", 3), ("function[name='add']", 1), ("module", 1), ("return", 2), ("binary[op='+']", 1), ("call", 3), ("function[async]", 1), ("//function[body/return/binary]", 1), ("//function[count(body/return/binary)>0]", 1), ("comment", 1)]),
    ("csharp", "using System;\nnamespace N {\n  public class Sample {\n    private int x;\n    public Sample() { }\n    public static int Add(int a, int b) { return a + b; }\n    void Foo() { Add(1,2); }\n  }\n  interface IX { }\n}\n", [("class[name='Sample']", 1), ("method[private]", 1), ("static", 1), ("unit", 1), ("interface[internal]", 1), ("//method[name='Add'][count(parameters/parameter)=2]", 1)]),
    ("rust", "pub fn a(x: i32) -> i32 { x }\nfn b() { a(1); }\npub(crate) fn c() {}", [("function", 3), ("function[pub]", 2), ("function[private]", 1), ("function[pub[crate]]", 1)]),
    ("javascript", "let x = 1; const y = 2;\nfunction add(a, b) { return f(a); }", [("function[name='add']", 1), ("variable", 2), ("variable[const]", 1), ("call", 1), ("program", 1)]),
    ("typescript", "function f(a: string, b?: number) {}", [("//param[optional]", 1), ("//param[required]", 1)]),
    ("java", "class A {\n  public int add(int a) { return a; }\n  void b() { add(1); }\n}", [("method", 2), ("method[public]", 1), ("method[package-private]", 1)]),
    ("go", "package p\nfunc Foo() {}\nfunc bar() {}", [("function[exported]", 1), ("function[unexported]", 1)]),
    ("ruby", "class A\n def go\n end\nend", [("method[name='go']", 1), ("class", 1)]),
    ("tsql", "SELECT a AS b, COUNT(*) FROM t WHERE x > 3 ORDER BY a DESC;\nINSERT INTO t VALUES (1);\n-- c\nUPDATE t SET a = @v WHERE EXISTS (SELECT 1 FROM #tmp)", [("statement", 3), ("where", 2), ("comment", 1), ("order_by", 1), ("subquery", 1), ("var", 1), ("temp_ref", 1), ("alias", 1), ("direction", 1), ("compare[op='>']", 1)]),
    ("html", "<html><body><nav><ul><li><a href='/x'>X</a><li>Y</ul></nav><p>a &amp; b<p>c<!-- z --><br></body>", [("//nav//li", 2), ("//a/@href", 1), ("//p", 2), ("//comment()", 1), ("//p[.='a & b']", 1)]),
    ("xml", '<p name="q"><item type="bug" id="1"><status>done</status></item><item/></p>', [("item[@type='bug']", 1), ("p/@name", 1), ("item[status='done']", 1), ("item", 2)]),
    ("text", "a\nb\n", [("//line", 3), ("//line[2][.='b']", 1)]),
]


@pytest.mark.parametrize("language,text,counts", LANGUAGES, ids=[f"{x[0]}-{i}" for i, x in enumerate(LANGUAGES)])
def test_languages(language, text, counts):
    for xpath, n in counts:
        assert len(items(text, language, xpath)) == n, xpath


def test_tree_modes():
    assert len(items('{"a": [1, true]}', "json", "//property/value/array/number", "structure")) == 1
    assert len(items("name: my-app\n", "yaml", "//property[key/string='name']/value/string[.='my-app']", "structure")) == 1
    assert len(items('{"a": 1}', "json", "//pair/key/string", "raw")) == 1
    with pytest.raises(ParseError):
        parse_text("[a]\n", "toml", "data")


def test_json_shapes():
    text = lambda s: subtree_text(parse_text(s, "json"))
    assert text('{"t": [], "e": {}}') == "<document><e/></document>"
    assert text("[1, 2]") == "<document><item>1</item><item>2</item></document>"
    assert text('{"a": [[1], [2]]}') == "<document><a>1</a><a>2</a></document>"
    assert text(r'{"a": "x\n\u00e9\ud83d\ude00"}') == "<document><a>x\né</a></document>"


def test_positions_are_bytes():
    (k,) = items('{"é": 1, "k": 22}', "json", "//k")
    assert (k.line, k.column, k.end_line, k.end_column) == (1, 16, 1, 18)


def test_ignore_whitespace_and_depth():
    doc = parse_text("<a>x y<b> </b></a>", "xml", ignore_whitespace=True)
    assert subtree_text(doc) == "<a>xy<b/></a>"
    assert subtree_text(parse_text("<a><b><c/></b></a>", "xml", parse_depth=2)) == "<a><b/></a>"


def test_parse_rejects():
    with pytest.raises(XPathError):
        parse("")
    with pytest.raises(ValueError):
        parse_text('{"a": }', "json")


@pytest.mark.parametrize(
    "xpath,want",
    [
        ("//l[q = //l[f = 'R']/q]/n/string()", ["1", "3"]), ("//l[not(q = //l[f = 'R']/q)]/n/string()", ["2"]), ("for $x in ('R', 'N') return count(//l[f = $x])", [1, 2]), ("//l ! count(//l)", [3, 3, 3]), ("//l/(//l[1]/n)/string()", ["1"]),
        ("//q = ('5', '9')", [True]), ("//q = ('8', '9')", [False]), ("//l[q != //l/q]/n/string()", ["1", "2", "3"]), ("(for $l in //l return (//l[q > $l/q])/n) ! string()", ["2", "2"]), ("//q = 5", [True]),
        ("serialize(parse-xml('<l><q>7</q></l>')//q)", ["<q>7</q>"]), ("count(parse-xml('<r><l/></r>')/r[//l]) + count(//l)", [4]),
    ],
)
def test_paths_from_the_root_inside_others(xpath, want):
    doc = parse_text("<r><l><n>1</n><q>5</q><f>R</f></l><l><n>2</n><q>6</q><f>N</f></l><l><n>3</n><q>5</q><f>N</f></l></r>", "xml")
    assert evaluate(xpath, doc) == want
