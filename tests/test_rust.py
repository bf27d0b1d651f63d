"""Extraction from Rust sources."""

import json

from graphquarry.sources import rust_code as R

LIB = '''
//! Crate docs with fn not_here() {}
/* nested /* comment */ fn nor_here() {} */
use std::fmt;
use crate::shapes::{Shape, area as surface, deep::Inner};

pub mod shapes {
    #[derive(Debug, crate::Marker)]
    pub struct Shape<'a, T> { pub w: u32, h: Vec<&'a T> }
    pub fn area(s: &Shape<u8>) -> u32 { s.w * 2 }
    mod hidden { pub fn inside() {} }
    pub trait Draw { fn draw(&self); }
    impl<T> Draw for Shape<'_, T> { fn draw(&self) { super::paint("{ not a brace }"); area(self); } }
    impl<T> Shape<'_, T> { pub fn new() -> Self { todo!() } fn grow(&mut self) { self.draw(); } }
    impl Shape<'_, u8> { pub fn small(&self) -> bool { 'x' == '}' } }
    impl From<std::io::Error> for Shape<'_, u8> { fn from(e: std::io::Error) -> Self { Shape::<u8>::new() } }
}

pub trait Marker {}
pub const LIMIT: usize = 3;
static NAME: &str = r#"fn "raw" {"#;
pub type Short = shapes::Shape<'static, u8>;
enum Kind { A, B(u8) }
pub(crate) fn paint(text: &str) { println!("{}", text); surface(todo!()); helper(); other::far(); }
fn helper() -> impl Fn(u8) -> u8 { |x| x + 1 }
#[cfg(unix)] fn twin() {}
#[cfg(windows)] fn twin() {}
#[macro_export] macro_rules! mac { ($x:expr) => { $x } }
#[allow(dead_code)] async unsafe fn kept<const N: usize, T: Into<u8>>(a: [T; N], b: (u8, u16)) -> Result<(), T> where T: Copy { Ok(()) }
#[get("/x")] fn handler() {}
#[cfg(test)] mod tests { #[test] fn works() {} fn aid() {} }
fn main() {}
'''
FILES = [("demo-crate/src/lib.rs", LIB), ("demo-crate/src/bin/tool.rs", "pub fn main() { demo_crate::helper(); }\n"), ("demo-crate/src/bad.rs", "fn f( {"), ("demo-crate/src/none.rs", None), ("demo-crate/src/uni.rs", "// é\npub fn ü() { crate::helper() }\n")]


def extracted(spark):
    return R.extract(spark.createDataFrame(FILES, "path string, content string"))


def test_modules_of_paths():
    cases = {"a/src/lib.rs": "a", "a-b/src/x/mod.rs": "a_b.x", "a/src/x/y.rs": "a.x.y", "a/src/bin/t.rs": "a@bin(t)", "a/src/bin/t/main.rs": "a@bin(t)", "src/main.rs": "crate", "x/y.rs": "x.y"}
    assert {p: R.module_of(p) for p in cases} == cases


def test_entities_signatures_and_tags(spark):
    rows = extracted(spark)
    got = {r.id: r for r in R.entities(rows).collect()}
    names = {i.removeprefix("rust:") for i in got}
    impl = "demo_crate.shapes.Shape"
    assert names == {
        "module:demo_crate", "module:demo_crate.shapes", "module:demo_crate.shapes.hidden", "module:demo_crate.tests", "module:demo_crate@bin(tool)", "module:demo_crate.bad", "module:demo_crate.none", "module:demo_crate.uni",
        "struct:demo_crate.shapes.Shape", "function:demo_crate.shapes.area", "function:demo_crate.shapes.hidden.inside", "trait:demo_crate.shapes.Draw", f"impl:{impl}<$0>.impl[Draw]", f"function:{impl}<$0>.impl[Draw].draw",
        f"impl:{impl}<$0>.impl#<$0>", f"function:{impl}<$0>.impl#<$0>.new", f"function:{impl}<$0>.impl#<$0>.grow", f"impl:{impl}<u8>.impl#<>", f"function:{impl}<u8>.impl#<>.small",
        f"impl:{impl}<u8>.impl[From<std%3A%3Aio%3A%3AError>]", f"function:{impl}<u8>.impl[From<std%3A%3Aio%3A%3AError>].from", "trait:demo_crate.Marker", "const:demo_crate.LIMIT", "static:demo_crate.NAME", "type_alias:demo_crate.Short",
        "enum:demo_crate.Kind", "function:demo_crate.paint", "function:demo_crate.helper", "function:demo_crate.twin@cfg(unix)", "function:demo_crate.twin@cfg(windows)", "macro:demo_crate.mac", "function:demo_crate.kept", "function:demo_crate.handler",
        "function:demo_crate.tests.works", "function:demo_crate.tests.aid", "function:demo_crate.main", "function:demo_crate@bin(tool).main", "function:demo_crate.uni.ü"}
    kept = json.loads(got["rust:function:demo_crate.kept"].signature)
    assert kept == {"v": 1, "params": ["a: [T;N]", "b: (u8, u16)"], "return_ann": "Result<(), T>", "generics": ["N", "T"]}
    assert json.loads(got["rust:struct:demo_crate.shapes.Shape"].signature)["fields"] == ["w: u32", "h: Vec<&'a T>"]
    assert json.loads(got["rust:module:demo_crate.bad"].properties) == {"syntax_degraded": "syntax_error"}
    assert got["rust:function:demo_crate.helper"].source_line_start == LIB[: LIB.index("fn helper")].count("\n") + 1
    tags = {(r.entity_id.removeprefix("rust:"), r.tag) for r in R.tags(rows).collect()}
    assert {("struct:demo_crate.shapes.Shape", "exported-api"), ("function:demo_crate.shapes.area", "exported-api"), ("macro:demo_crate.mac", "exported-api"), ("function:demo_crate.main", "entry-point"), ("function:demo_crate.tests.works", "test"), ("function:demo_crate.tests.aid", "test"), ("function:demo_crate.handler", "http-route"), ("function:demo_crate.handler", "framework-handler"), ("function:demo_crate.kept", "allow-dead-code")} <= tags
    untagged = {"function:demo_crate.shapes.hidden.inside", "function:demo_crate.paint", "function:demo_crate.twin@cfg(unix)"}
    assert not untagged & {i for i, _ in tags} and ("function:demo_crate@bin(tool).main", "exported-api") not in tags


def test_edges_and_sites(spark):
    rows = extracted(spark)
    edges, left = R.resolve_sites(rows, R.entities(rows))
    got = {(r.kind, r.from_id.removeprefix("rust:"), r.to_id.removeprefix("rust:")): r for r in edges.collect()}
    impl = "demo_crate.shapes.Shape<$0>"
    for edge in (
        ("contains", "module:demo_crate", "function:demo_crate.helper"), ("contains", f"impl:{impl}.impl[Draw]", f"function:{impl}.impl[Draw].draw"), ("calls", "function:demo_crate.paint", "function:demo_crate.helper"),
        ("calls", "function:demo_crate.paint", "function:demo_crate.shapes.area"), ("calls", "function:demo_crate.uni.ü", "function:demo_crate.helper"), ("calls", "function:demo_crate@bin(tool).main", "function:demo_crate.helper"),
        ("derives", "struct:demo_crate.shapes.Shape", "trait:demo_crate.Marker"), ("imports", "module:demo_crate", "struct:demo_crate.shapes.Shape"), ("imports", "module:demo_crate", "function:demo_crate.shapes.area"),
    ):
        assert edge in got and got[edge].confidence == "resolved", edge
    texts = {(r.caller_entity_id.removeprefix("rust:"), r.callee_expr) for r in left.collect()}
    assert {("function:demo_crate.paint", "other::far"), (f"function:{impl}.impl#<$0>.grow", ".draw")} <= texts
    call = got["calls", "function:demo_crate.uni.ü", "function:demo_crate.helper"]
    text = FILES[4][1]
    assert call.source_byte_start == len(text[: text.index("crate::helper")].encode())
    assert not any(k[0] == "contains" and k[2].startswith("module:") for k in got)
