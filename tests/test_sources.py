"""Extraction, resolution, rules, edits and rendering over small source trees."""

import pytest

from latticework import queries, render
from latticework.catalog import GraphCatalog
from latticework.operators import mutate
from latticework.sources import files, frameworks, python_source


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in queries.SOURCES.items():
        at = root / path
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    (root / "__pycache__").mkdir()
    (root / "__pycache__" / "x.py").write_text("def hidden(): pass")
    (root / "notes.unknown").write_text("?")
    (root / "broken.py").write_text("def (")
    return GraphCatalog.analyze(spark, str(root), ["*.gen.py"])


@pytest.mark.parametrize("text, names", [
    ("functions select name where caller_count == 0 and not name matches '^c'", {"shelf", "sell"}), ("classes select name where inherits_from contains 'Item'", {"Book"}), ("classes select name where inherits_from('Item')", {"Book", "Item"}),
    ("classes select name where has_method('cost') == true and has_method('label') == false", {"Boxed", "Book"}), ("functions select name where is_async == true and module.name == 'shop.book'", {"sell"}), ("functions select name where decorators contains 'route'", {"items"}),
    ("imports select module as_ where kind == 'StarImport'".replace(" as_", ""), {"shop.base"}), ("functions select name where kind == 'Property' and has_setter == false", {"shelf"}), ("functions select name where overrides_of('Item.cost') == true", {"cost"}), ("fields select name where parent_class contains 'Item'", {"price"}),
    ("calls select name where unresolved_reason == 'NameNotInScope'", {"cost"}), ("calls select name where target_kind == 'class'", {"Book"}), ("modules select name where class_count > 1", {"base"}), ("functions select name where parameter_count > 3", {"total"}),
])
def test_queries_over_source(catalog, text, names):
    assert {r[0] for r in catalog.query(text).collect()} == names


def test_group_query_over_source(catalog):
    got = catalog.query("classes select module.name, count(*) as n, avg(method_count) as mean group by module.name order by n desc limit 5").collect()
    assert [tuple(r) for r in got] == [("shop.base", 2, 1.5), ("shop.book", 1, 2.0)]


def test_walks_over_source(catalog):
    assert {r.id.split("::")[1] for r in catalog.callers_of("shop/base.py::total").collect()} == {"Book.cost", "sell", "items"}
    assert {r.id for r in catalog.callees_of("shop/book.py::Book.shelf").collect()} == {"shop/base.py::Item.label"}
    up = {r.id.split("::")[-1]: r.depth for r in catalog.traverse("shop/base.py::total", 3, ["calls"], "upstream").collect()}
    assert up["Book.cost"] == 1 and any("route" in k or "items" in k for k in up)
    assert [r.id for r in catalog.call_chain("shop/book.py::Book.shelf", "shop/base.py::Item.cost").orderBy("pos").collect()] == ["shop/book.py::Book.shelf", "shop/base.py::Item.label", "shop/base.py::Item.cost"]
    assert catalog.traverse_unresolved("web/app.py::drop", 1).first().n == 1
    assert {r.kind for r in catalog.stats().collect()} >= {"calls", "imports", "extends", "overrides", "handles"}
    assert catalog.lookup("shop/base.py::Item").first().kind == "class" and catalog.lookup("no").count() == 0
    assert [r.name for r in catalog.find("total").collect()] == ["total"]
    assert {r.name for r in catalog.module_children("shop/book.py::module").where("kind = 'class'").collect()} == {"Book"}
    assert catalog.affected("shop/base.py::total").first().n >= 3


def test_broken_and_ignored_files(catalog):
    mods = {r.path: r.error for r in catalog.units.where("kind = 'module'").collect()}
    assert set(mods) == {*queries.SOURCES, "broken.py"} and mods["broken.py"]


def test_save_load_and_update(catalog, spark, tmp_path):
    catalog.save(str(tmp_path / "c"))
    again = GraphCatalog.load(spark, str(tmp_path / "c"))
    assert again.entities.count() == catalog.entities.count()
    text = queries.SOURCES["web/app.py"].replace("missing(i)", "total(i)")
    new = again.updated(spark.createDataFrame([("web/app.py", text), ("shop/book.py", None)], "path string, text string"))
    assert {r.id for r in new.callers_of("shop/base.py::total").collect()} == {"web/app.py::items", "web/app.py::drop"}
    whole = {**queries.SOURCES, "web/app.py": text, "broken.py": "def ("}
    whole.pop("shop/book.py")
    full = GraphCatalog.from_units(python_source.extract(spark.createDataFrame(sorted(whole.items()), "path string, text string")))
    key = lambda c: sorted(map(tuple, c.edges.select("src", "dst", "kind").collect()))
    assert key(new) == key(full)


GOD = "class God:\n" + "".join(f"    def m{i}(self, x):\n        A{i}.go(x)\n" + "".join(f"        if x > {j}:\n            x += 1\n" for j in range(9)) for i in range(5)) + "".join(f"class A{i}:\n    def go(self):\n        pass\n" for i in range(5))
NESTED = "def deep(a):\n    if a:\n        for b in a:\n            while b:\n                try:\n                    pass\n                except E:\n                    pass\n"
MANY = "def many(a, b, c, d, e, f):\n" + "".join(f"    if a == {i}:\n        return {i}\n" for i in range(6))


def test_smells_from_source(spark):
    fields = "class Bag:\n" + "".join(f"    f{i}: int = 0\n" for i in range(11))
    c = GraphCatalog.from_units(python_source.extract(spark.createDataFrame([("g.py", GOD), ("n.py", NESTED), ("m.py", MANY), ("b.py", fields)], "path string, text string")))
    got = {(r.rule_id, r.entity_name): (r.severity, r.signals) for r in c.smells().collect()}
    assert got["god-class", "God"] == ("Medium", {"WMC": 50.0, "CBO": 5.0})
    assert got["deep-nesting", "deep"] == ("Medium", {"nesting_depth": 5.0})
    assert got["excessive-returns", "many"] == ("Medium", {"return_count": 6.0}) and got["long-parameter-list", "many"][0] == "Medium"
    assert got["data-class", "Bag"][0] == "High" and got["too-many-fields", "Bag"][0] == "Medium"
    assert {k for k, _ in got} >= {"high-cyclomatic-complexity", "long-method"} and c.smells(rule_id="god-class").count() == 1


@pytest.mark.parametrize("body, want", [
    ("pass", (1, 0, 0)), ("if a:\n        pass\n    elif b:\n        pass\n    else:\n        pass", (3, 2, 0)), ("if a:\n        pass\n    else:\n        if b:\n            pass", (3, 3, 0)), ("with a as b:\n        return 1", (1, 2, 1)),
    ("return 1 if a else 2", (2, 1, 1)), ("return [x for x in a if x and y]", (1, 0, 1)), ("try:\n        pass\n    except E:\n        pass\n    finally:\n        pass", (2, 2, 0)), ("for x in a:\n        def g():\n            return 2", (2, 1, 1)),
    ("match a:\n        case 1:\n            pass\n        case _:\n            pass", (3, 1, 0)),
])
def test_metrics(body, want):
    text = f"def f(a, b=None):\n    {body}\n"
    f = next(u for u in python_source.units("x.py", text) if u["kind"] == "function" and u["name"] == "f")
    assert (f["cyclomatic"], f["nesting_depth"], f["return_count"]) == want


def test_units_in_detail():
    text = 'LIMIT = 3\nimport a.b as c, d\nfrom . import e\nfrom .f import g as h\nif TYPE_CHECKING:\n    import t\ntype Alias = int\nclass Ä(B[int], object):\n    """Doc."""\n    x: ClassVar[int] = 1\n    @x.setter\n    def x(self): yield self.super.do(cb=run, *[run])\n    class Inner:\n        def m(self): "a".join([])\ndef run(): return run\n'
    u = python_source.units("p/q.py", text)
    by = {r["id"]: r for r in u}
    assert {r["kind"] for r in u} == {"module", "constant", "import", "class", "function", "type_alias"}
    assert [(r["id"], r["import_kind"], r["level"], r["is_type_only"]) for r in u if r["kind"] == "import"] == [("p/q.py::import@2", "ModuleImport", 0, False), ("p/q.py::import@2.1", "ModuleImport", 0, False), ("p/q.py::import@3", "RelativeImport", 1, False), ("p/q.py::import@4", "RelativeImport", 1, False), ("p/q.py::import@6", "ModuleImport", 0, True)]
    cls, fn, inner = by["p/q.py::Ä"], by["p/q.py::Ä.x"], by["p/q.py::Ä.Inner.m"]
    assert cls["bases"] == ["B"] and cls["docstring"] == "Doc." and cls["fields"][0]["is_class_var"] and inner["parent_class"] == "p/q.py::Ä.Inner"
    assert fn["function_kind"] == "Setter" and fn["is_generator"] and [c["name"] for c in fn["value_refs"]] == ["run", "run"]
    assert inner["calls"] == [{"name": "join", "path": [], "line": inner["line"], "col": 21}]
    raw = text.encode()
    assert raw[cls["name_span"]["start"] : cls["name_span"]["end"]].decode() == "Ä" and raw[fn["span"]["start"] : fn["span"]["end"]].decode().startswith("def x")


def test_exports():
    import ast

    get = lambda t: python_source.exports(ast.parse(t))
    assert get("x = 1") is None and get("__all__ = []") == [] and get("__all__ = ['b', 'a']\n__all__ += ['c']\n__all__.append('a')\n__all__.extend(('d',))") == ["b", "a", "c", "d"]


def test_rename_and_body_plans(catalog, tmp_path):
    for path, text in queries.SOURCES.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    plan = catalog.plan_rename("shop/base.py::total", "grand_total")
    assert plan.where("not verified").count() == 0 and plan.count() == 4
    assert set(mutate.apply(plan, str(tmp_path))) == set(queries.SOURCES)
    assert "grand_total([self])" in (tmp_path / "shop/book.py").read_text() and "def grand_total(" in (tmp_path / "shop/base.py").read_text()
    with pytest.raises(ValueError):
        mutate.apply(plan, str(tmp_path))  # the files are no longer those of the plan
    (tmp_path / "shop/base.py").write_text(queries.SOURCES["shop/base.py"])
    body = catalog.plan_body_replacement("shop/base.py::Boxed.cost", "return 2")
    with pytest.raises(PermissionError):
        mutate.apply(body, str(tmp_path), denied=("shop/*",))
    mutate.apply(body, str(tmp_path))
    assert "return 2" in (tmp_path / "shop/base.py").read_text()
    sig = catalog.plan_signature_update("shop/base.py::Item.label", "def label(self, short=False):").collect()
    assert [r.new_text for r in sig if r.verified] == ["def label(self, short=False):"] and sum(not r.verified for r in sig) == 1
    assert mutate.edited("aéb", [(1, 3, "e"), (4, 4, "!")]) == "aeb!"
    with pytest.raises(ValueError):
        mutate.edited("abc", [(0, 2, "x"), (1, 3, "y")])


def test_rendering(catalog):
    e = catalog.edges.where("kind = 'calls'")
    assert "digraph" in render.dot(e) and "-->|calls|" in render.mermaid(e) and "| kind |" in render.markdown(catalog.stats())


ROUTES = {
    "a.py": ("import django\nurlpatterns = [path('x/', views.X.as_view()), re_path('^y', views.y), path('api/', include('api.urls'))]\nadmin.site.register(Model)\nrouter.register('z', ZView)\n", {("django", "x/", "views.X"), ("django", "^y", "views.y"), ("django", "api/", "api.urls"), ("django", "Model", "Model"), ("django", "z", "ZView")}),
    "b.py": ("from fastapi import APIRouter\nr = APIRouter(prefix='/v1')\n@r.get('/i')\nasync def i(db=Depends(get_db)): pass\napp.include_router(r, prefix='/p')\n", {("fastapi", "/v1/i", "i"), ("fastapi", "i", "get_db"), ("fastapi", "/p", "r")}),
    "c.go": ('r.GET("/a", h.List)\nmux.HandleFunc("POST /b", create)\n', {("go", "/a", "List"), ("go", "/b", "create")}),
    "d.rs": ('use actix_web::get;\n#[get("/a")]\nasync fn a() {}\nApp::new().route("/b", web::post().to(b))', {("actix", "/a", "a"), ("actix", "/b", "b")}),
    "e.js": ("const express = 1;\napp.get('/a', auth, ctl.list);\nrouter.route('/b').get(one).post((q, s) => s.end());\n", {("express", "/a", "list"), ("express", "/b", "one"), ("express", "/b", None)}),
    "f.java": ('@RequestMapping("/api")\nclass C {\n @GetMapping("/x")\n public String x(int a) {}\n @PostMapping\n void y() {}\n}', {("spring", "/api/x", "C.x"), ("spring", "/api", "C.y")}),
    "g.php": ("Route::get('/a', [A::class, 'b']);\nRoute::group(['prefix' => 'adm'], function () { Route::post('/c', 'D@e'); });", {("laravel", "/a", "A.b"), ("laravel", "/adm/c", "D.e")}),
    "h.cs": ('[Route("api/[controller]")]\npublic class ItemsController {\n [HttpGet("{id}")]\n public ActionResult Get(int id) {}\n}\napp.MapGet("/p", Ping);', {("aspnet", "/api/items/{id}", "ItemsController.Get"), ("aspnet", "/p", "Ping")}),
    "i.rb": ("class User\n  has_many :posts\n  before_save :tidy\nend", {("rails", "User.has_many.posts", "Post"), ("rails", "User.before_save", "User.tidy")}),
    "j.ts": ("@Controller('cats')\nexport class Cats {\n @Get(':id')\n one(x) {}\n}\n@Module({controllers: [Cats]})\nexport class M {}", {("nestjs", "/cats/:id", "Cats.one"), ("nestjs", "M", "Cats")}),
    "k.vue": ("import { createRouter } from 'vue-router'\nconst routes = [{ path: '/', component: Home }, { path: '/l', component: () => import('./Lazy.vue') }]", {("vue", "/", "Home"), ("vue", "/l", "Lazy")}),
    "l.jsx": ("import 'react-router-dom';\n<Route path=\"/a\" element={<A/>}/>\n<Link to=\"/a\">x</Link>", {("react", "/a", "A"), ("react", "/a", "/a")}),
}


@pytest.mark.parametrize("path", sorted(ROUTES))
def test_framework_routes(path):
    text, want = ROUTES[path]
    assert {(r["framework"], r["route"], r["target"]) for r in frameworks.routes_of(path, text)} == want


def test_languages_and_ignores(spark):
    df = files.with_language(spark.createDataFrame([("a/b.PY",), ("Rakefile",), ("x.zsh",), ("y.unknown",)], "path string"))
    assert {r.path: r.language for r in df.collect()} == {"a/b.PY": "Python", "Rakefile": "Ruby", "x.zsh": "Bash", "y.unknown": None}
    hid = spark.createDataFrame([("a/node_modules/x.js",), ("b.gen.py",), ("tmp/z.py",), ("src/tmpz.py",), ("ok.py",)], "path string").select("path", files.ignored(files.F.col("path"), ["*.gen.py", "# no", "tmp/"]).alias("i"))
    assert {r.path for r in hid.collect() if not r.i} == {"src/tmpz.py", "ok.py"}


BRACES = {
    "a/util.ts": ("TypeScript", "export function helper(i: number, ...rest) { return i ? 1 : 2; }\n"),
    "a/x.ts": ("TypeScript", "import { helper as h } from './util';\n/** A store. */\nexport class Store<T> extends Base implements Kept {\n  constructor(private x: number) { super(x); this.load('if (x) {'); }\n  async load(k: string, n = 3): Promise<void> {\n    if (k) { for (const i of n) { h(i); } } else { return; } // if (no)\n    return k ? other.go(k) : this.load(k);\n  }\n}\nclass Base {\n  load() {}\n}\nconst go = (q) => { new Store(q); };\n"),
    "y.go": ("Go", "package m\n// Run starts.\nfunc (s *Srv) Run(addr string, n int) error {\n\tfor i := 0; i < n; i++ { if i > 2 { fmt.Println(i) } }\n\treturn start(addr)\n}\nfunc start(a string) error { return nil }\n"),
    "z.rs": ("Rust", "pub struct P { a: u8 }\nimpl P { pub fn go(&self, n: usize) -> bool { match n { 0 => true, _ => self.go(n) } } }\n"),
    "w.java": ("Java", "public class A extends B {\n  @Override\n  public List<String> get(int x) { try { return x > 1 ? one(x) : null; } catch (E e) { throw e; } }\n}\n"),
    "v.rb": ("Ruby", "class User < Base\n  def name(x, y = 1)\n    if x\n      other(y)\n    end\n  end\n  def other(z)\n    z.each do |q|\n      puts(q)\n    end\n  end\nend\n"),
}


@pytest.mark.parametrize("above, doc", [
    ("/** Opens. */\n", "Opens."), ("/// One.\n/// Two.\n", "One.\nTwo."), ("/* old */\n\n\n", None), ("// a\n\n", "a"), ("// a\n\n\n", None), ("int x;\n", None), ("/* one */\nint y;\n/* two */\n", "two"),
    ('p = "src/*.js";\n/** doc */\n', "doc"), ("/** of a/*.js */\n", "of a/*.js"), ("/**\n" + " * a long comment\n" * 500 + " */\n", "a long comment\n" * 499 + "a long comment"),
])
def test_comments_above_a_declaration(above, doc):
    from latticework.sources import brace_source

    assert brace_source._doc(above + "void f() {}", len(above)) == doc


def test_brace_languages_become_the_same_units(spark):
    from latticework.sources import brace_source

    rows = [u for p, (lang, t) in BRACES.items() for u in brace_source.units(p, t, lang)]
    f = {u["id"]: u for u in rows if u["kind"] == "function"}
    got = {k: (u["parent_class"], [p["name"] for p in u["parameters"]], [c["name"] for c in u["calls"]], u["cyclomatic"], u["nesting_depth"], u["return_count"]) for k, u in f.items()}
    assert got == {
        "a/util.ts::helper": (None, ["i", "rest"], [], 2, 0, 1), "a/x.ts::Store.constructor": ("a/x.ts::Store", ["x"], ["load"], 1, 0, 0), "a/x.ts::Store.load": ("a/x.ts::Store", ["k", "n"], ["h", "go", "load"], 4, 2, 2), "a/x.ts::Base.load": ("a/x.ts::Base", [], [], 1, 0, 0), "a/x.ts::go": (None, ["q"], ["Store"], 1, 0, 0),
        "y.go::Srv.Run": ("y.go::Srv", ["addr", "n"], ["Println", "start"], 3, 2, 1), "y.go::start": (None, ["a"], [], 1, 0, 1), "z.rs::P.go": ("z.rs::P", ["n"], ["go"], 3, 0, 0), "w.java::A.get": ("w.java::A", ["x"], ["one"], 3, 1, 1),
        "v.rb::User.name": ("v.rb::User", ["x", "y"], ["other"], 2, 0, 0), "v.rb::User.other": ("v.rb::User", ["z"], ["puts"], 1, 0, 0),
    }
    assert f["a/x.ts::Store.load"]["is_async"] and f["y.go::Srv.Run"]["docstring"] == "Run starts."
    raw = BRACES["a/x.ts"][1].encode()
    assert all(raw[u["name_span"]["start"] : u["name_span"]["end"]].decode() == u["name"] for u in rows if u["path"] == "a/x.ts" and u["kind"] in ("class", "function"))
    c = GraphCatalog.from_units(brace_source.extract(spark.createDataFrame([(p, t, lang) for p, (lang, t) in BRACES.items()], "path string, text string, language string")))
    e = {(r.src, r.dst) for r in c.edges.where("kind = 'calls'").collect()}
    assert {("a/x.ts::Store.load", "a/util.ts::helper"), ("a/x.ts::Store.constructor", "a/x.ts::Store.load"), ("y.go::Srv.Run", "y.go::start"), ("z.rs::P.go", "z.rs::P.go")} <= e
    assert {(r.src, r.dst) for r in c.edges.where("kind in ('imports', 'extends')").collect()} == {("a/x.ts::module", "a/util.ts::module"), ("a/x.ts::Store", "a/x.ts::Base")}


def test_decorators_and_dataclasses(spark):
    from pyspark.sql import functions as F

    from latticework.operators import shapes

    rows = [(["staticmethod"], True), (["functools.cached_property"], True), (["x.setter"], True), (["wraps(f)"], True), (["classmethod"], False), ([], True)]
    got = spark.createDataFrame(rows, "d array<string>, c boolean").select(shapes.function_kind(F.col("d"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["StaticMethod", "Property", "Setter", "Method", "Free", "Method"]
    u = python_source.extract(spark.createDataFrame([("a.py", "@dataclass(frozen=True)\nclass A:\n    x: int\n    def __eq__(self, o): return True\nclass B: pass\n")], "path string, text string"))
    assert sorted(r.id for r in shapes.generated_methods(u).collect()) == ["a.py::A.__init__", "a.py::A.__repr__"]
