import pytest
from pyspark.sql import functions as F

from grafwerk.api import Graph, to_html
from grafwerk.functions.extract import asset_path, extract_one
from grafwerk.functions.flow import Rules, summaries
from grafwerk.sources import reports, repository

FILES = {
    "shop/__init__.py": "",
    "shop/store.py": '"""Store."""\nLIMIT = 3\n\nclass Base:\n    """A base."""\n    def save(self, row):\n        return write(row)\n\ndef write(row):\n    return row\n',
    "shop/web.py": "from shop.store import Base, write\nimport os\n\nclass Handler(Base):\n    def post(self, request):\n        return write(request)\n\ndef read():\n    return input()\n\ndef run(q):\n    os.system(q)\n\ndef main():\n    run(read())\n\ndef safe():\n    run(int(read()))\n",
    "tests/test_store.py": "from shop.store import write\n\ndef test_write():\n    assert write(1)\n",
    "site/index.html": '<html><link rel="stylesheet" href="style.css?v=1"><div id="top" class="menu wide"><a href="http://x">x</a></div></html>',
    "site/style.css": "@import 'base.css';\n.menu { color: red } #top .menu:hover { }\n",
    "site/base.css": ".wide {}\n",
    "notes.md": "# One\n## Two\n```\n# no\n```\n# Three\n",
    "bad.py": "def broken(:\n",
    "build/skip.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    g = Graph(spark, str(root))
    g.counts = g.index()
    return g


def names(rows, column="fqn"):
    return sorted(r[column] for r in rows.collect())


def test_index_counts_and_failures(graph):
    assert graph.counts["files"] == len(FILES) - 1
    assert graph.counts["resolved"] + graph.counts["dangling"] == graph.counts["edges"]
    assert graph.diagnose("bad.py").startswith("SyntaxError")
    assert graph.doctor()["failed_sample"] == ["bad.py"]


def test_walks(graph):
    assert names(graph.callers("shop.store.write").rows) == ["shop.store.Base.save", "shop.web.Handler.post", "tests.test_store.test_write"]
    assert names(graph.related_tests("shop.store.write").rows) == ["tests.test_store.test_write"]
    assert "shop.web.Handler" in names(graph.impact("shop.store.Base").rows)
    assert names(graph.change_impact("shop/store.py").rows)
    with pytest.raises(LookupError):
        graph.callers("nothing.here")


def test_assets_and_styles_resolve(graph):
    e = graph.edges.join(graph.table("symbols").select(F.col("symbol_id").alias("dst"), "fqn"), "dst")
    got = {(r.path, r.kind, r.fqn) for r in e.collect()}
    assert ("site/index.html", "imports", "site/style.css") in got
    assert ("site/style.css", "imports", "site/base.css") in got
    assert ("site/index.html", "references", "site.style.menu") in got


def test_taint_needs_no_sanitizer_on_the_way(graph):
    rows = graph.taint().rows.collect()
    assert [(r.origin, r.sink, r.sink_func, r.depth) for r in rows] == [("shop.web.main", "system", "shop.web.run", 2)]


def test_reindex_is_idempotent_and_incremental(graph):
    before = sorted(map(repr, map(tuple, graph.edges.collect())))
    graph.index()
    assert sorted(map(repr, map(tuple, graph.edges.collect()))) == before
    from pathlib import Path

    f = Path(graph.root, "shop/store.py")
    f.write_text(f.read_text().replace("def write(row)", "def put(row)"))
    assert {r.state for r in graph.freshness().collect()} == {"changed"}
    assert not graph.find("write").fresh
    graph.index()
    dangling = graph.edges.filter("dst IS NULL").select("dst_name").distinct()
    assert "shop.store.write" in names(dangling, "dst_name")
    f.write_text(FILES["shop/store.py"])
    graph.index()
    assert sorted(map(repr, map(tuple, graph.edges.collect()))) == before


def test_search_and_cards(graph):
    assert graph.find("write").rows.first().fqn == "shop.store.write"
    card = graph.explain("shop.store.Base")
    assert card["children"] == ["shop.store.Base.save"] and card["doc"] == "A base."
    assert graph.suggest_files("save the store rows").rows.count()
    assert "</script>" not in to_html({"nodes": [], "links": [{"a": "</script>", "b": "x", "weight": 1}]}).split("<script", 1)[1][:-9]
    assert graph.visualize()["links"]


def test_ignore_and_paths():
    import re

    hit = lambda p, x: bool(re.search(repository.glob_regex(p), x))
    assert hit("*.js", "a/b.js") and not hit("*.js", "a/b.jsx")
    assert hit("/a/", "a/b") and not hit("/a/", "x/a/b")
    assert hit("a/**/b", "a/x/y/b") and hit("docs/", "x/docs/y")
    assert repository.safe_relative("./a/b") == "a/b"
    assert repository.safe_relative("../a") is None and repository.safe_relative("/a") is None
    assert repository.diff_paths("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n--- /dev/null\n+++ b/y/z.py\n") == ["x.py", "y/z.py"]


@pytest.mark.parametrize(
    ("language", "text", "wanted"),
    [
        ("java", "import a.B;\nclass C extends B {\n  int go(int x) {\n    return help(x);\n  }\n}\n", {("class", "C"), ("method", "go"), ("calls", "help"), ("imports", "a.B"), ("inherits", "B")}),
        ("typescript", "import {x} from './x';\nexport class A { run(): void { x(); } }\nconst f = (a) => g(a);\n", {("class", "A"), ("function", "f"), ("calls", "g"), ("imports", "./x")}),
        ("go", 'package m\nimport "fmt"\nfunc Do(a int) { fmt.Println(a) }\ntype T struct {}\n', {("function", "Do"), ("calls", "fmt.Println")}),
        ("rust", "use std::io;\nstruct S;\nfn main() { run(1); }\n", {("struct", "S"), ("function", "main"), ("calls", "run"), ("imports", "std.io")}),
        ("cpp", '#include "a.h"\nint add(int a) {\n  return sub(a);\n}\n', {("function", "add"), ("calls", "sub"), ("imports", "a.h")}),
        ("ruby", "class A < B\n  def go\n    help(1)\n  end\nend\n", {("class", "A"), ("method", "go"), ("inherits", "B")}),
        ("clojure", "(ns a.b)\n(defn go [x] (help x))\n", {("module", "b"), ("function", "go"), ("calls", "help")}),
        ("terraform", 'resource "t" "n" {\n  a = var.x\n}\nvariable "x" {}\n', {("resource", "n"), ("variable", "x"), ("references", "var.x")}),
        ("yaml", "a: 1\nb:\n  c: 2\n", {("key", "a"), ("key", "b")}),
        ("json", '{"a": {"b": 1}}', {("key", "a")}),
        ("bash", "go() {\n  help\n}\n", {("function", "go")}),
    ],
)
def test_extractors(language, text, wanted):
    got = {(r.get("kind"), r.get("name")) for r in extract_one("m/x", language, text)}
    assert wanted <= got, (wanted - got, got)
    assert ("file", "x") in got


def test_extraction_never_raises():
    for language in repository.LANGUAGES:
        for text in ("", "\x00", "(((", "}}}{{{", "é\n" * 50, '"' * 9):
            assert extract_one("a/b.x", language, text)[-1]["kind"] == "file"
    assert asset_path("a.css?x#y") == "a.css" and asset_path("https://x/y") is None and asset_path("#top") is None


def flows(body, seed="param:0"):
    text = "def f(p, o):\n" + "\n".join("    " + x for x in body.split("\n"))
    return sorted((r["callee"], r["arg_index"]) if "callee" in r else ("return", -9) for r in summaries("m.py", text, Rules()) if r["seed"] == seed)


def test_flow_is_sensitive_to_order_fields_and_branches():
    assert flows("x = p\nx = 1\ng(x)") == []
    assert flows("x = 1\nx = p\ng(x)") == [("g", 0)]
    assert flows("o.a = p\ng(o.b)\nh(o.a)") == [("h", 0)]
    assert flows("if o:\n    x = p\nelse:\n    x = 1\ng(x)") == [("g", 0)]
    assert flows("if 1 > 2:\n    x = p\nelse:\n    x = 1\ng(x)") == []
    assert flows("x = 1\nfor i in o:\n    g(x)\n    x = p") == [("g", 0)]
    assert flows("x = escape(p)\ng(x)\nreturn p") == [("escape", 0), ("return", -9)]
    assert flows("a, b = p, 1\ng(b)\nh(1, a)") == [("h", 1)]
    assert flows("x = 1\nx += p\ng(k=x)") == [("g", -1)]
    assert flows("g(input())", "source") == [("g", 0)]
    assert Rules().is_sink("execute", "db.execute", 0) and not Rules().is_sink("execute", "db.execute", 1)
    assert Rules().is_sink("open", "open", 0) and not Rules().is_sink("open", "gzip.open", 0)


def test_reports(spark, tmp_path):
    import json

    (tmp_path / "a.sarif").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "py/sql CWE-089", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}]}]}]}))
    assert [tuple(r) for r in reports.read_sarif(spark, str(tmp_path / "a.sarif")).collect()] == [("t", "py/sql CWE-089", "a.py", 3, "m", "sql-injection")]
    (tmp_path / "e.csv").write_text("# c\nT1,sqli,true,89\nT2,sqli,false,89\n")
    e = reports.read_expected(spark, str(tmp_path / "e.csv"))
    f = spark.createDataFrame([("T1", "sqli"), ("T2", "xss")], "case_id string, category string")
    assert reports.confusion_by_category(f, e).first().asDict() == {"category": "sqli", "tp": 1, "fp": 0, "fn": 0, "tn": 1, "wrong_category": 1}
    (tmp_path / "m.xml").write_text('<testcase><file path="A.java"><flaw line="1"/></file><file path="B.java"/></testcase>')
    assert {tuple(r) for r in reports.read_manifest(spark, str(tmp_path / "m.xml")).collect()} == {("A.java", 1), ("B.java", 0)}
