"""The code scanner on code with strings, comments and scopes that mislead line patterns."""

import pytest

from memlake.operators import code_scan as cs

SAMPLES = {
"python": '''import os, sys as s
from a.b import c
"""import no
def not_this(): pass
"""
def outer(
    a: int = f(1),
    b="def x(",
) -> dict:  # call()
    def inner():
        return g(2)
    text = "h(3)"
    return inner()

class K:
    async def m(self): return self.n(1)

outer()
''',
"rust": '''use std::collections::HashMap;
use crate::a::{b, c};
// fn no() {}
/* fn nor() { x() } */
pub fn find<'a>(
    s: &'a str,
    c: char,
) -> Option<usize> {
    let r = r#"fn fake() { "#;
    let q = "x(\\"y(";
    go(s).map(|x| inner(x))
}
trait T { fn decl(&self); }
fn after() { find("a", 'b') }
''',
"typescript": '''import { a } from "./a"
import "side";
const b = require('b')
// import x from "nope"
export const draw = async (
  a: number,
  f = () => 1,
): Promise<void> => {
  paint(`fn(${a})`)
}
class C extends D {
  private run(x: string): void { this.draw(x); if (x) { stop() } }
}
function tail() { return run() }
''',
"go": '''package main
import "fmt"
import (
	"os"
	j "encoding/json"
)
// func no() {}
func (s *S) Do(a int,
	b int) error {
	fmt.Println("x(")
	return s.step(a)
}
func main() { x := `func f() {`; Do(1, 2) }
''',
"java": '''import java.util.List;
import static a.B.c;
public class A {
  // void no() { x(); }
  @Override
  public <T> List<T> get(
      int a) throws E { return make(a); }
  private A() { super(); init(); }
}
''',
"csharp": '''using System.Text;
namespace N { public class A {
  public async Task<int> Get(int a) { var s = @"x(""; y("; return await Make(a); }
  private static int Two() => One();
} }
''',
"ruby": '''require 'json'
require_relative "x/y"
class A
  # def no; end
  def run(a)
    s = "go(1)"
    step(a)
  end
  def self.done?
    run(1)
  end
end
done?(2)
'''}

#: language -> definitions, calls (caller, callee), imports
WANT = {
    "python": ({"outer", "inner", "K", "m"}, {("outer", "f"), ("inner", "g"), ("outer", "inner"), ("m", "n"), (None, "outer")}, {"os", "sys", "a.b"}),
    "rust": ({"find", "T", "decl", "after"}, {("find", "go"), ("find", "map"), ("find", "inner"), ("after", "find")}, {"std::collections::HashMap", "crate::a"}),
    "typescript": ({"draw", "C", "run", "tail"}, {("draw", "paint"), ("run", "draw"), ("run", "stop"), ("tail", "run")}, {"./a", "side", "b"}),
    "go": ({"Do", "main"}, {("Do", "Println"), ("Do", "step"), ("main", "Do")}, {"fmt", "os", "encoding/json"}),
    "java": ({"A", "get"}, {("get", "make"), ("A", "init")}, {"java.util.List", "a.B.c"}),
    "csharp": ({"Get", "Two"}, {("Get", "Make"), ("Two", "One")}, {"System.Text"}),
    "ruby": ({"A", "run", "done?"}, {("run", "step"), ("done?", "run"), (None, "done?")}, {"json", "x/y"}),
}


@pytest.mark.parametrize("language", WANT)
def test_strings_comments_and_scopes(language):
    symbols, calls, imports = cs.scan_file(SAMPLES[language], language)
    assert ({n for _, n, _ in symbols}, {(c, n) for _, c, n in calls}, {n for _, n in imports}) == WANT[language]


def test_blanking_keeps_lines_and_lengths():
    for language, source in SAMPLES.items():
        for text in cs.blanked(source, language):
            assert len(text) == len(source) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
    assert cs.scan_file("def f(:\n  'open", "python")[0] == [(1, "f", "function")] and cs.scan_file("", "go") == ([], [], [])


def test_imports_of_files(spark):
    suffix = {"python": "py", "rust": "rs", "typescript": "ts", "go": "go", "java": "java", "csharp": "cs", "ruby": "rb"}
    files = spark.createDataFrame([(f"src/a.{suffix[k]}", v) for k, v in SAMPLES.items()] + [("vendor/x.py", "import os"), ("y.txt", "import os"), ("z.py", None)], "path string, source string")
    got = {(r.language, r.module) for r in cs.imports(files).collect()}
    assert got == {(k, m) for k, w in WANT.items() for m in w[2]}
