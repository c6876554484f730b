"""Text barrier and rules on small fixtures."""

import posixpath

import pytest
from pyspark.sql import functions as F

from factloom.operators import barrier, fixpoint, rules


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_skips_and_comments(spark):
    files = spark.createDataFrame([
        ("dist/a.js", "x"), ("a.min.js", "x"), ("g.yml", "# hi\n\n# DO NOT EDIT\nx: 1"), ("ok.yml", "x: 1\n# do not edit"), ("b.bin", "a\0b"), ("n", None), ("t.yml", "x"), ("big.txt", "é" * 60), ("long.sh", "\n" * 25 + "# @generated"),
    ], "path string, text string")
    got = {r[0]: r[1] for r in files.select("path", barrier.skip_reason(F.col("path"), F.col("text"), 100, ["t.yml"])).collect()}
    assert got == {"dist/a.js": "generated", "a.min.js": "generated", "g.yml": "generated", "ok.yml": None, "b.bin": "binary", "n": "unreadable", "t.yml": "tool_metadata", "big.txt": "oversized", "long.sh": None}
    text = "a /* b\nc */ d <!-- e --><%# f %>g"
    assert spark.createDataFrame([(text,)], "t string").select(barrier.blank_comments(F.col("t"))).first()[0] == "a     \n     d                   g"


def plain_strip(line, markers):
    quote = escaped = None
    for i, c in enumerate(line):
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = None
        elif c in "\"'":
            quote = c
        elif (i == 0 or line[i - 1].isspace()) and any(line.startswith(m, i) for m in markers):
            return line[:i]
    return line


def test_inline_comments(spark):
    lines = ["a # b", "a#b", "'# x' # y", '"\\" # z" # w', "# all", 'open " # q', "a // b # c", "", "'it\\'s # n' ; # z", "x " * 3000 + "# end"]
    exts = {"sh": ["#"], "js": ["//"], "ini": ["#", ";"], "txt": []}
    asked = [(x, e) for x in lines for e in exts]
    got = spark.createDataFrame(asked, "x string, e string").select("x", "e", barrier.strip_inline("x", "e").alias("y")).collect()
    assert [r.y for r in got] == [plain_strip(x, exts[e]) for x, e in asked]


def test_matches(spark):
    nodes = spark.createDataFrame([("d1", "pay_bill", "Shop::Bill"), ("d2", "run", "Job"), ("d3", "ok?", None), ("d4", "+", "A")], "definition_id string, name string, owner string")
    files = spark.createDataFrame([
        ("a.yml", "x: Shop::Bill#pay_bill\ny: Other.pay_bill\nz: payBill\n# pay_bill"), ("b.yml", "run it\ntask: run\n- :run\nmethod = runner"),
        ("c.erb", "pay_bill <%= pay_bill %> run <% run %>"), ("d.txt", "is ok? now\n'ok?'"), ("dist/e.txt", "pay_bill"), ("f.txt", None), ("g.txt", "Other.pay_bill and pay_bill"),
    ], "path string, text string")
    got = {(r.definition_id, r.path, r.line): r.kind for r in barrier.matches(files, nodes).collect()}
    assert got == {
        ("d1", "a.yml", 1): "qualified_owner", ("d1", "a.yml", 3): "method_name_camelized", ("d2", "b.yml", 2): "structured_reference", ("d2", "b.yml", 3): "symbol_or_string", ("d1", "c.erb", 1): "method_name",
        ("d2", "c.erb", 1): "structured_reference", ("d3", "d.txt", 1): "method_name", ("d3", "d.txt", 2): "symbol_or_string", ("d1", "g.txt", 1): "method_name",
    }
    assert barrier.matches(files, nodes, per_definition=1).groupBy("definition_id").count().filter("count > 1").count() == 0
    assert barrier.matches(files.limit(0), nodes).count() == 0


def test_templates_and_frameworks(spark):
    files = spark.createDataFrame([("v.erb", "a <%= link_to name, 'x y' # z %> b <%# gone %><% Foo.bar! %>"), ("w.haml", "<!-- no -->\n-# not\n= show_it @x"), ("Gemfile", "gem 'rails'\n# gem 'graphql'"), ("Gemfile.lock", "    sidekiq (7.0)\n  rubocop (1)"), ("x.gemspec", "s.add_dependency(\"blueprinter\")")], "path string, text string")
    assert rows(barrier.template_names(files.filter("path = 'v.erb'"))) == [("v.erb", "bar!"), ("v.erb", "link_to"), ("v.erb", "name")]
    assert {r.name for r in barrier.view_names(files.limit(2)).collect()} == {"bar!", "link_to", "name", "show_it", "x"}
    assert rows(barrier.frameworks(files)) == [("blueprinter",), ("rails",), ("sidekiq",)]


def test_rules(spark):
    nodes = spark.createDataFrame([("d1", "on_send", "Cop"), ("d2", "to_s", "A"), ("d3", "included", "A"), ("d4", "on_x", "A"), ("d5", "perform", "PayJob"), ("d6", "perform", "B")], "definition_id string, name string, owner string")
    reach = spark.createDataFrame([("Base", "Cop"), ("Else", "A")], "ancestor string, owner string")
    assert rows(rules.implicit_callers(nodes, [("^on_", ["Base"], "callback"), ("^on_s", [], "late")], reach)) == [("d1", "callback"), ("d2", "protocol"), ("d3", "hook")]
    up = spark.createDataFrame([("B", "Sidekiq::Job::Inner")], "owner string, candidate string")
    listed = [{"id": "off", "frameworks": ["x"], "owners": ["*"]}, {"id": "job", "methods": ["perform"], "owners": ["*Job"], "frameworks": ["rails"]}, {"id": "up", "ancestors": ["Sidekiq::Job"]}]
    assert rows(rules.convention_hits(nodes, listed, up, ["rails"])) == [("d5", "job"), ("d6", "up")]
    with pytest.raises(ValueError):
        rules.convention_hits(nodes, listed + listed[:1], up, [])


def test_routes_and_loads(spark):
    cols = "definition_id string, symbol_id string, owner string, name string, file string, visibility string"
    nodes = spark.createDataFrame([("d1", "PayController#go", "PayController", "go", "x.rb", "public"), ("d2", "PayController#hide", "PayController", "hide", "x.rb", "private"), ("d3", "M::ListController#all", "M::ListController", "all", "app/controllers/list_controller.rb", "public"), ("d4", "ListController#none", "q", "all", "z.rb", "public")], cols)
    routes = spark.createDataFrame([("PayController#go",), ("PayController#hide",), ("ListController#all",), ("Nope#all",)], "symbol_id string")
    assert rows(rules.route_targets(routes, nodes)) == [("ListController#all", "d3"), ("PayController#go", "d1")]
    paths = ["a/b", "./a//b/", "a/../b", "../a", "a/../../b", "/a", ".", "", "a/b/../../c", "..", "a/./b/..", "a/..", "..a/b"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", rules.clean_path(F.col("p"))).collect()
    for p, clean in got:
        want = posixpath.normpath(p)
        assert clean == (None if p.startswith("/") or want == ".." or want.startswith("../") else want), p
    roots = spark.createDataFrame([("lib/a.rb", "ra", False), ("lib/b/c.rb", "rc", False), ("test/t.rb", "rt", True), ("lib/b/e.json", "re", False)], "file string, definition_id string, test boolean")
    refs = spark.createDataFrame([(1, "m1", "lib/b/x.rb", False, "require_relative", "c", True), (2, "m1", "lib/b/x.rb", False, "require", "a", True), (3, "m2", "x.rb", False, "autoload", "lib/a.rb", True), (4, "m2", "x.rb", False, "require", "json", True), (5, "m3", "x.rb", False, "require", None, False), (6, "m4", "test/x.rb", True, "require", None, False), (7, "m5", "x.rb", False, "require_relative", "../z", True)], "site int, caller_id string, file string, test boolean, kind string, path string, literal boolean")
    loads = rules.load_edges(refs, roots)
    assert rows(loads.edges) == sorted([(1, "m1", "rc", "require_relative"), (2, "m1", "ra", "require_lib_path"), (3, "m2", "ra", "autoload_lib_path"), (5, "m3", rules.HUB, "dynamic_conservative"), (6, "m4", rules.TEST_HUB, "dynamic_conservative")], key=repr)
    assert rows(loads.unresolved) == [(4,), (7,)]
    assert rows(loads.hubs) == sorted([(rules.HUB, d) for d in ("ra", "rc", "re")] + [(rules.TEST_HUB, "rt"), (rules.TEST_HUB, rules.HUB)])
    assert rows(loads.blockers.select("scope_kind", "scope_value", "n_sites")) == [("definition", "m3", 1), ("definition", "m4", 1)]
    asked = spark.createDataFrame([("a", "m3"), ("b", "m4"), ("c", "m1")], "domain string, node string")
    reached = {(r.domain, r.node) for r in fixpoint.reach(loads.graph(), asked).collect() if r.node.startswith("r")}
    assert reached == {("a", d) for d in ("ra", "rc", "re")} | {("b", d) for d in ("ra", "rc", "re", "rt")} | {("c", "rc"), ("c", "ra")}
