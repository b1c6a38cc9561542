import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.model import FLOW_SCHEMA, NODE_SCHEMA, Graph
from flowlens.operators.traversal import lineage, node_depth
from flowlens.operators.sensitivity import dominant_sensitivity
from flowlens.operators.weights import node_throughput
from flowlens.plans.scan import graph_from_files, scan, scan_summary
from flowlens.plans.views import blackbox, graph_summary
from flowlens.sinks import graph_source
from flowlens.sinks.graph_json import json_lines, write_graph_json
from flowlens.sources import files as file_ops
from flowlens.sources.calls import _extract, extract_calls, find_calls
from flowlens.sources.tree import list_tree, read_corpus, routed_files

# one file each of four languages, with a vendor call, a plain host, a message, a log line and two kinds of stores
SHOP = {
    "api/orders.rb": 'def place(order)\n  mailer.send(order.email, order.phone)\n  cache.set("u", order.username)\nend\n',
    "web/pay.js": 'export const pay = (iban) => {\n  paypal.charge(iban);\n  axios.post("https://bank.partner-site.io/v2", { iban });\n};\n',
    "jobs/report.py": 'for row in rows:\n    logger.warning("bad %s", row.passport)\n    warehouse_db.insert(row.dob, row.passport)\n    plot(row.email)\n',
    "core/Main.java": 'class Main {\n  void run(String gender) {\n    logger.debug(gender);\n  }\n}\n',
    "deploy/db.tf": 'resource "aws_rds_cluster" "w" {}\n# then mysql\n',
}


def write_tree(root, files):
    for rel, text in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def rows_of(df, *sort):
    return [tuple(r) for r in df.orderBy(*sort).collect()]


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus") / "shop")
    write_tree(root, SHOP)
    graph, stats = scan(spark, [root])
    return graph.stored(), stats


def test_golden_graph(golden):
    g, stats = golden
    s = stats.first()
    assert (s.files, s.parsed, s.infra, len(s.languages)) == (5, 4, 1, 4)
    assert {r.id: r.sensitivity for r in g.categories.collect()} == {
        "bank": "financial", "dob": "pii", "email": "pii", "govid": "pii", "phone": "pii", "special": "special", "username": "pii"}
    nodes = {r.id: (r.kind, r.label, r.system, r.location) for r in g.nodes.collect()}
    files = {f"svc:shop/{p}": ("service", p.split("/")[1], "shop", f"shop/{p}") for p in SHOP if not p.endswith("tf")}
    assert nodes == files | {
        "source:user": ("source", "User", "People", ""), "ext:comms": ("external", "Email / messaging", "Third parties", ""),
        "ext:paypal": ("external", "PayPal", "Third parties", ""),
        "ext:bank.partner-site.io": ("external", "bank.partner-site.io", "Third parties", ""),
        "store:cache": ("store", "Redis / cache", "Data stores", ""), "store:db": ("store", "MySQL", "Data stores", ""),
        "sink:log": ("sink", "Logs", "Sinks", "")}
    out = {(r["from"].removeprefix("svc:shop/"), r["to"]): (",".join(r.categories), r.via, r.evidence)
           for r in g.flows.collect() if r["from"] != "source:user"}
    assert out == {
        ("api/orders.rb", "ext:comms"): ("email,phone", "mailer.send", "api/orders.rb:2"),
        ("api/orders.rb", "store:cache"): ("username", "cache.set", "api/orders.rb:3"),
        ("web/pay.js", "ext:paypal"): ("bank", "paypal.charge", "web/pay.js:2"),
        ("web/pay.js", "ext:bank.partner-site.io"): ("bank", "axios.post", "web/pay.js:3"),
        ("jobs/report.py", "sink:log"): ("govid", "logger.warning", "jobs/report.py:2"),
        ("jobs/report.py", "store:db"): ("dob,govid", "warehouse_db.insert", "jobs/report.py:3"),
        ("core/Main.java", "sink:log"): ("special", "logger.debug", "core/Main.java:3")}
    inward = {r["to"].removeprefix("svc:shop/"): ",".join(r.categories) for r in g.flows.collect() if r["from"] == "source:user"}
    assert inward == {"api/orders.rb": "email,phone,username", "web/pay.js": "bank", "jobs/report.py": "dob,govid", "core/Main.java": "special"}
    assert scan_summary(stats, g) == "5 files scanned (4 parsed, 1 infra) across 4 languages; 11 nodes, 11 flows"


def test_golden_analysis(spark, golden):
    g, _ = golden
    depth = {r.id: r.depth for r in node_depth(g.nodes, g.flows).collect()}
    assert {i for i, d in depth.items() if d == 0} == {"source:user"} and {d for i, d in depth.items() if i.startswith("svc:")} == {1}
    through = {r.id: r.throughput for r in node_throughput(g.nodes, g.flows).collect()}
    assert (through["source:user"], through["svc:shop/jobs/report.py"], through["sink:log"]) == (7, 3, 2)
    loud = dominant_sensitivity(g.flows, g.categories)
    assert {r["to"] for r in loud.filter("sensitivity = 'special'").collect()} == {"svc:shop/core/Main.java", "sink:log"}
    box = blackbox(g)
    assert (box.nodes.count(), box.flows.count()) == (8, 7)
    assert graph_summary(box).first().summary == "8 nodes, 7 flows"
    start = spark.createDataFrame([("ext:paypal",)], "id string")
    assert {r.id for r in lineage(g.flows, start).collect()} == {"ext:paypal", "svc:shop/web/pay.js", "source:user"}


def test_listing_rules(spark, tmp_path):
    root = tmp_path / ".root"
    write_tree(str(root), {
        "a.py": "x", "_helpers.py": "x", "__init__.py": "x", ".env": "x", "_priv/b.py": "x", "node_modules/c.py": "x",
        "sub/.git/d.py": "x", "sub/build/e.py": "x", "sub/Build/f.py": "x", "sub/deep/er/g.go": "x", "empty.py": "",
        "full.py": b"x" * (1 << 20), "large.py": b"x" * ((1 << 20) + 1), "t.JSON": "x", "Yarn.lock": "x", "u.min.js": "x",
        "GEMFILE.LOCK": "x", "composer.lock": "x", "notes.xyz": "x", "venv": "a file named like a directory"})
    os.symlink(root / "a.py", root / "link.py")
    os.symlink(root / "sub", root / "linkdir")
    single = tmp_path / "one.py"
    single.write_text("db.save(email)")
    listed = list_tree(spark, [str(root), str(single), str(tmp_path / "missing")])
    routed = routed_files(listed)
    first = {r.rel for r in routed.filter("root_idx = 0").collect()}
    assert first == {"a.py", "_helpers.py", "__init__.py", ".env", "_priv/b.py", "sub/Build/f.py", "sub/deep/er/g.go",
                     "full.py", "notes.xyz", "venv", "link.py", "linkdir"}
    assert [(r.base, r.rel, r.name) for r in routed.filter("root_idx = 1").collect()] == [("one.py", ".", "one.py")]
    assert routed.filter("root_idx = 2").count() == 0
    assert {r.rel for r in routed.filter("NOT readable").collect()} == {"linkdir"}
    assert {r.base for r in routed.filter("root_idx = 0").collect()} == {".root"}
    files = read_corpus(spark, [str(root), str(single)])
    assert files.filter("rel = 'full.py'").first().content == b"x" * (1 << 20)
    assert files.filter("rel = 'linkdir'").count() == 0
    g = graph_from_files(files)
    assert "svc:one.py/." in {r.id for r in g.nodes.collect()}


def test_same_rules_on_a_uri(spark, tmp_path):
    write_tree(str(tmp_path / "code"), {"a.py": "db.save(email)", "d/b.py": "log.info(ssn)", ".git/x.py": "db.save(email)"})
    g, stats = scan(spark, [f"file://{tmp_path}/code"])
    assert stats.first().files == 2
    assert {r.id for r in g.nodes.collect()} == {"source:user", "svc:code/a.py", "svc:code/d/b.py", "store:db", "sink:log"}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_any_name_is_read(spark, tmp_path, scheme):
    names = ["a%20b.py", "c#d.py", "q?x.py", "e f.py", "x y%/z#w?.py", "plain/é ü.py"]
    write_tree(str(tmp_path / "odd"), {n: f"log.info(email)  # {n}" for n in names})
    files = read_corpus(spark, [f"{scheme}{tmp_path}/odd"])
    assert {r.rel: bytes(r.content).decode() for r in files.collect()} == {n: f"log.info(email)  # {n}" for n in names}


def test_an_error_that_hides_files_fails(monkeypatch):
    from flowlens.sources import tree

    def busy(path):
        raise OSError(5, "input/output error")

    monkeypatch.setattr(os, "scandir", busy)
    with pytest.raises(OSError):
        list(tree._entries("/", "", {}))


def test_routing(spark):
    cases = {"x/main.tf": True, "x/a.TFVARS": True, "x/docker-compose.prod.yml": True, "x/compose.yaml": True,
             "x/serverless.ts": True, "x/Chart.yaml": True, "x/values.yaml": True, "x/a.hcl": True, "x/k8s/a.yaml": True,
             "x/deploy/a.yml": True, "deploy/a.yml": False, "x/Helm-things/a.yaml": True, "x/a.yaml": False,
             "x/k8s/a.py": False, "x/mycompose.yaml": False, "x/b.unknown": False}
    df = spark.createDataFrame([(p, p.split("/")[-1], p, 1) for p in cases], "rel string, name string, path string, length bigint")
    got = {r.rel: r.is_infra for r in file_ops.route_infra(file_ops.detect_language(df)).collect()}
    assert got == cases


def test_languages(spark):
    cases = {"a.py": "python", "A.PY": "python", "Dockerfile": "dockerfile", "x.tsx": "tsx", "README": None, "a.b.go": "go"}
    df = spark.createDataFrame([(p, p) for p in cases], "rel string, name string")
    assert {r.rel: r.language for r in file_ops.detect_language(df).collect()} == cases
    own = file_ops.detect_language(df, [(".go", "golang")])
    assert {r.language for r in own.collect()} == {None, "golang"}


def callees(text, language):
    return [(c[3], c[4]) for c in find_calls(text.encode(), language)]


def test_chained_and_nested_calls():
    assert callees('db.collection("users").insertOne({email})', "javascript") == [
        ('db.collection("users").insertOne', "({email})"), ("db.collection", '("users")')]
    assert callees("f(g(x), h(y))", "python") == [("f", "(g(x), h(y))"), ("g", "(x)"), ("h", "(y)")]
    assert callees("foo\n  .bar(1)\n  ?.baz(2)", "javascript") == [("foo\n  .bar(1)\n  ?.baz", "(2)"), ("foo\n  .bar", "(1)")]
    assert callees("a->b(x); A::c(y); x[0](z); f(a)(b)", "cpp") == [
        ("a->b", "(x)"), ("A::c", "(y)"), ("x[0]", "(z)"), ("f(a)", "(b)"), ("f", "(a)")]
    assert callees("axios.get<User>(url)", "typescript") == [("axios.get<User>", "(url)")]


def test_calls_in_string_holes():
    assert callees('log.info(f"to {mask(email)} {{no(x)}}")', "python") == [
        ("log.info", '(f"to {mask(email)} {{no(x)}}")'), ("mask", "(email)")]
    assert callees("send(`a ${f('x)', y)} b(z)`)", "javascript") == [("send", "(`a ${f('x)', y)} b(z)`)"), ("f", "('x)', y)")]
    assert callees('puts("#{f(x)}")', "ruby") == [("puts", '("#{f(x)}")'), ("f", "(x)")]


def test_long_types_and_chains_take_linear_time():
    import time
    wide = ", ".join(f"T{i}" for i in range(300))
    assert callees(f"db.save<{wide}>(email)", "typescript") == [(f"db.save<{wide}>", "(email)")]
    assert callees(f"Map<{wide}> foo(int a) {{ }}", "java") == []
    assert callees("class A { foo(a): " + "x | " * 200 + "y { } }", "typescript") == []
    start = time.process_time()
    assert len(callees("a" + ".b(x)" * 4000, "javascript")) == 4000
    assert len(callees("f(" * 4000 + ")" * 4000, "python")) == 4000
    assert callees("(" * 20_000 + "]" * 20_000, "python") == []
    assert len(callees("log.info(f'" + "{g(x)}" * 3000 + "')", "python")) == 3001
    assert time.process_time() - start < 5


def test_what_is_no_call():
    assert callees("if (a) { return (b) } while (c) {}", "javascript") == []
    assert callees("class A { foo(a) { } get bar() { } async baz(q): Promise<X> { } }", "typescript") == []
    assert callees("function f(a) {}\nasync function g(b) {}\nnew Foo(c)", "javascript") == []
    assert callees("def f(a):\n  pass\nclass B(C):\n  pass", "python") == []
    assert callees("func (s *T) Name(x string) (int, error) {}", "go") == []
    assert callees("public List<String> foo(int a) throws X { }\nvoid bar(int b);", "java") == []
    assert callees("// f(x)\n/* g(y) */ \"h(z)\"", "javascript") == []
    assert callees("# f(x)\n'g(y)' \"\"\"h(z)\"\"\"", "python") == []
    assert callees("<p onclick='f(x)'>", "html") == []


def test_against_the_python_parser():
    """Calls of the standard library, as Python itself sees them."""
    import ast
    import glob
    want_all = both = extra = 0
    for path in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py"))):
        src = open(path, "rb").read()
        starts = [0]
        for line in src.splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        want = {(starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)
                for n in ast.walk(ast.parse(src)) if isinstance(n, ast.Call)}
        got = {c[:2] for c in find_calls(src, "python")}
        want_all, both, extra = want_all + len(want), both + len(want & got), extra + len(got - want)
    assert both > 0.997 * want_all and extra < 0.004 * want_all


def test_new_then_method():
    assert callees("new Foo(x).bar(y)", "javascript") == [("new Foo(x).bar", "(y)")]


def test_offsets_are_bytes_and_text_is_whole(spark):
    src = "é = 'ü'\ndb.save('ö', email)\n".encode()
    (start, end, line, callee, args, full), = find_calls(src, "python")
    assert (start, end, line) == (10, 30, 2) and src[start:end].decode() == full == "db.save('ö', email)"
    assert callee + args == full


def test_unbalanced_and_invalid_input():
    assert callees("f(a", "python") == []
    assert callees("f(a)) ] } g(b)", "python") == [("f", "(a)"), ("g", "(b)")]
    assert list(find_calls(b"\xff\xfe f(\xff)", "python"))[0][4] == "(�)"
    assert list(find_calls(b"", "python")) == []


def test_extract_calls_frame(spark):
    df = spark.createDataFrame([(0, "b", "r.py", bytearray(b"f(x)\ng(y)"), "python"), (0, "b", "n", bytearray(b"f(x)"), None)],
                               "root_idx int, base string, rel string, content binary, language string")
    assert rows_of(extract_calls(df).select("rel", "line", "callee"), "line") == [("r.py", 1, "f"), ("r.py", 2, "g")]


def test_extracted_calls_go_on_in_small_batches():
    """A worker holds no more calls than a batch, however many a file or a batch of files has."""
    sources = [b"\n".join(b"f%d(x)" % i for i in range(n)) for n in (24_000, 0, 7_000, 3)] + [b"g(" + b"y" * (3 << 20) + b")"] * 3
    files = pa.RecordBatch.from_pydict({"root_idx": pa.array([0] * 7, pa.int32()), "base": ["b"] * 7, "rel": [f"{i}.py" for i in range(7)],
                                        "content": sources, "language": ["python"] * 7})
    batches = list(_extract(iter([files.slice(0, 2), files.slice(2)])))
    assert max(b.num_rows for b in batches) <= 10_000
    assert max(b.nbytes for b in batches) <= 12 << 20  # a call that is itself large, twice, and what was there before it
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert got == [(0, "b", f"{i}.py", *c) for i, src in enumerate(sources) for c in find_calls(src, "python")]


def read_document(path):
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return json.loads("".join(open(os.path.join(path, p)).read() for p in parts))


def test_json_document(golden, tmp_path):
    g, _ = golden
    write_graph_json(g, str(tmp_path / "g"))
    doc = read_document(tmp_path / "g")
    assert list(doc) == ["categories", "nodes", "flows"]
    assert [n["id"] for n in doc["nodes"]] == sorted(n["id"] for n in doc["nodes"])
    flows = {(f["from"], f["to"]): f for f in doc["flows"]}
    assert flows["source:user", "svc:shop/web/pay.js"] == {"from": "source:user", "to": "svc:shop/web/pay.js", "categories": ["bank"]}
    assert flows["svc:shop/web/pay.js", "ext:paypal"] == {
        "from": "svc:shop/web/pay.js", "to": "ext:paypal", "categories": ["bank"], "via": "paypal.charge", "evidence": "web/pay.js:2"}
    assert list(flows) == sorted(flows)
    assert {"id": "ext:paypal", "kind": "external", "label": "PayPal", "system": "Third parties"} in doc["nodes"]
    assert len(doc["categories"]) == 7


def test_json_of_an_empty_graph(spark, tmp_path):
    empty = Graph(spark.createDataFrame([], "id string, label string, sensitivity string"),
                  spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], FLOW_SCHEMA))
    write_graph_json(empty, str(tmp_path / "g"))
    assert read_document(tmp_path / "g") == {"categories": [], "nodes": [], "flows": []}


def test_document_through_the_data_source(golden, tmp_path):
    """The same document, replaced as a whole, refused where one stands, and untouched when a task fails."""
    g, _ = golden
    path = str(tmp_path / "doc")
    write_graph_json(g, str(tmp_path / "g"))
    graph_source.save_graph_document(g, path)
    assert json.loads("".join(graph_source.read_document(path))) == read_document(tmp_path / "g")
    with pytest.raises(Exception, match="holds a document"):
        graph_source.save_graph_document(g, path)
    first = graph_source.manifest(path)
    lines = json_lines(g).select(F.when(F.col("line").contains("paypal.charge"), F.raise_error(F.lit("task lost")).cast("string")).otherwise(F.col("line")).alias("line"))
    for target in (path, str(tmp_path / "new")):
        with pytest.raises(Exception, match="task lost"):
            lines.write.format("graph_json").mode("overwrite").save(target)
    assert graph_source.manifest(path) == first and json.loads("".join(graph_source.read_document(path)))["flows"]
    assert graph_source.manifest(str(tmp_path / "new")) is None
    with pytest.raises(FileNotFoundError):
        list(graph_source.read_document(str(tmp_path / "new")))
    small = Graph(g.categories, g.nodes, g.flows.limit(0))
    graph_source.save_graph_document(small, path, overwrite=True)
    assert json.loads("".join(graph_source.read_document(path)))["flows"] == []
    assert len([f for f in os.listdir(path) if f.startswith("write-")]) == 1
