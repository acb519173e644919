"""Golden facts of hand-made sources in languages with braces: nesting, strings and comments that look like code, owners, bases, decorators."""

from __future__ import annotations

import random

import pytest

from lorespark.operators import islands

SOURCES = {}
FACTS = {}

SOURCES["csharp"] = """\
using System;
using static System.Math;
using Alias = My.Lib;
namespace Shop.Core
{
    // class Fake { }
    [Serializable]
    public class Order : Base<int>, IOrder
    {
        private readonly List<int> _items = new List<int>();
        public int Total { get; set; }
        string s = "class X { void y() }";
        public Order(int a) : base(a) { Init(a); }
        [HttpGet("orders/{id}")]
        [Authorize]
        public async Task<int> Load(string id)
        {
            if (id == null) { throw new ArgumentException("x"); }
            var r = await repo.Find<int>(id);
            items.ForEach(x => { Log.Write(x); });
            return r;
        }
        public int Twice(int x) => Math.Max(x, 2);
        class Inner { void Go() { Run(); } }
    }
    interface IOrder { void Pay(int a); }
    enum Kind { A, B }
}
"""
FACTS["csharp"] = [
    ('import', 'System', 'System', '', 1),
    ('import', 'System.Math', 'System.Math', '', 2),
    ('import', 'My.Lib', 'My.Lib', '', 3),
    ('namespace', 'Shop.Core', 'Shop.Core', '', 4),
    ('class', 'Order', 'Shop.Core.Order', 'Shop.Core', 8),
    ('decorator', 'Serializable', 'Serializable', 'Shop.Core.Order', 7),
    ('base', 'Base', 'Base', 'Shop.Core.Order', 8),
    ('base', 'IOrder', 'IOrder', 'Shop.Core.Order', 8),
    ('field', '_items', 'Shop.Core.Order._items', 'Shop.Core.Order', 10),
    ('call', 'List', 'List', 'Shop.Core.Order._items', 10),
    ('property', 'Total', 'Shop.Core.Order.Total', 'Shop.Core.Order', 11),
    ('field', 's', 'Shop.Core.Order.s', 'Shop.Core.Order', 12),
    ('method', 'Order', 'Shop.Core.Order.Order', 'Shop.Core.Order', 13),
    ('call', 'Init', 'Init', 'Shop.Core.Order.Order', 13),
    ('method', 'Load', 'Shop.Core.Order.Load', 'Shop.Core.Order', 16),
    ('decorator', 'HttpGet', 'HttpGet("orders/{id}")', 'Shop.Core.Order.Load', 14),
    ('decorator', 'Authorize', 'Authorize', 'Shop.Core.Order.Load', 15),
    ('call', 'ArgumentException', 'ArgumentException', 'Shop.Core.Order.Load', 18),
    ('call', 'Find', 'repo.Find', 'Shop.Core.Order.Load', 19),
    ('call', 'ForEach', 'items.ForEach', 'Shop.Core.Order.Load', 20),
    ('call', 'Write', 'Log.Write', 'Shop.Core.Order.Load', 20),
    ('method', 'Twice', 'Shop.Core.Order.Twice', 'Shop.Core.Order', 23),
    ('call', 'Max', 'Math.Max', 'Shop.Core.Order.Twice', 23),
    ('class', 'Inner', 'Shop.Core.Order.Inner', 'Shop.Core.Order', 24),
    ('method', 'Go', 'Shop.Core.Order.Inner.Go', 'Shop.Core.Order.Inner', 24),
    ('call', 'Run', 'Run', 'Shop.Core.Order.Inner.Go', 24),
    ('interface', 'IOrder', 'Shop.Core.IOrder', 'Shop.Core', 26),
    ('method', 'Pay', 'Shop.Core.IOrder.Pay', 'Shop.Core.IOrder', 26),
    ('enum', 'Kind', 'Shop.Core.Kind', 'Shop.Core', 27),
]

SOURCES["java"] = """\
package com.shop.core;
import java.util.List;
import static java.lang.Math.max;
/* class Fake {} */
@Service
public class Order extends Base<String> implements Payable, Comparable<Order> {
    private final int total = compute(1);
    String name;
    public Order(int a) { super(a); }
    @Override
    @GetMapping("/orders")
    public <T> List<T> load(String id) throws IOException {
        Runnable r = () -> { go(); };
        return repo.find(id, new Filter("x"));
    }
    abstract void later();
    enum Kind { A, B; void m() { x(); } }
}
interface Payable { void pay(int x); }
"""
FACTS["java"] = [
    ('namespace', 'core', 'com.shop.core', '', 1),
    ('import', 'java.util.List', 'java.util.List', 'com.shop.core', 2),
    ('import', 'java.lang.Math.max', 'java.lang.Math.max', 'com.shop.core', 3),
    ('class', 'Order', 'com.shop.core.Order', 'com.shop.core', 6),
    ('decorator', 'Service', 'Service', 'com.shop.core.Order', 5),
    ('base', 'Base', 'Base', 'com.shop.core.Order', 6),
    ('base', 'Payable', 'Payable', 'com.shop.core.Order', 6),
    ('base', 'Comparable', 'Comparable', 'com.shop.core.Order', 6),
    ('field', 'total', 'com.shop.core.Order.total', 'com.shop.core.Order', 7),
    ('call', 'compute', 'compute', 'com.shop.core.Order.total', 7),
    ('field', 'name', 'com.shop.core.Order.name', 'com.shop.core.Order', 8),
    ('method', 'Order', 'com.shop.core.Order.Order', 'com.shop.core.Order', 9),
    ('method', 'load', 'com.shop.core.Order.load', 'com.shop.core.Order', 12),
    ('decorator', 'Override', 'Override', 'com.shop.core.Order.load', 10),
    ('decorator', 'GetMapping', 'GetMapping("/orders")', 'com.shop.core.Order.load', 11),
    ('call', 'go', 'go', 'com.shop.core.Order.load', 13),
    ('call', 'find', 'repo.find', 'com.shop.core.Order.load', 14),
    ('call', 'Filter', 'Filter', 'com.shop.core.Order.load', 14),
    ('method', 'later', 'com.shop.core.Order.later', 'com.shop.core.Order', 16),
    ('enum', 'Kind', 'com.shop.core.Order.Kind', 'com.shop.core.Order', 17),
    ('method', 'm', 'com.shop.core.Order.Kind.m', 'com.shop.core.Order.Kind', 17),
    ('call', 'x', 'x', 'com.shop.core.Order.Kind.m', 17),
    ('interface', 'Payable', 'com.shop.core.Payable', 'com.shop.core', 19),
    ('method', 'pay', 'com.shop.core.Payable.pay', 'com.shop.core.Payable', 19),
]

SOURCES["typescript"] = """\
import { a } from './a'
import * as b from "b";
export class Order extends Base implements Payable {
  total: number = 0
  @Input() name?: string
  constructor(private x: Foo) { super(x) }
  @Get('/orders')
  async load(id: string): Promise<number> {
    const r = await this.repo.find(id)
    return r.map(x => { return go(x) })
  }
}
interface Payable { pay(x: number): void }
export const run = async (x: number) => {
  start(`class Fake { ${x} }`)
}
function outer() {
  function inner() { deep() }
  inner()
}
enum Kind { A, B }
"""
FACTS["typescript"] = [
    ('import', './a', './a', '', 1),
    ('import', 'b', 'b', '', 2),
    ('class', 'Order', 'Order', '', 3),
    ('base', 'Base', 'Base', 'Order', 3),
    ('base', 'Payable', 'Payable', 'Order', 3),
    ('field', 'total', 'Order.total', 'Order', 4),
    ('field', 'name', 'Order.name', 'Order', 5),
    ('decorator', 'Input', 'Input()', 'Order.name', 5),
    ('method', 'constructor', 'Order.constructor', 'Order', 6),
    ('method', 'load', 'Order.load', 'Order', 8),
    ('decorator', 'Get', "Get('/orders')", 'Order.load', 7),
    ('call', 'find', 'this.repo.find', 'Order.load', 9),
    ('call', 'map', 'r.map', 'Order.load', 10),
    ('call', 'go', 'go', 'Order.load', 10),
    ('interface', 'Payable', 'Payable', '', 13),
    ('method', 'pay', 'Payable.pay', 'Payable', 13),
    ('function', 'run', 'run', '', 14),
    ('call', 'start', 'start', 'run', 15),
    ('function', 'outer', 'outer', '', 17),
    ('function', 'inner', 'outer.inner', 'outer', 18),
    ('call', 'deep', 'deep', 'outer.inner', 18),
    ('call', 'inner', 'inner', 'outer', 19),
    ('enum', 'Kind', 'Kind', '', 21),
]

SOURCES["go"] = """\
package shop
import (
  "fmt"
  str "strings"
)
import "os"
type Order struct {
  Total int
  items []string
}
type Payable interface {
  Pay(x int) error
}
func (o *Order) Load(id string) (int, error) {
  s := `type Fake struct {`
  if x := o.find(id); x != nil { return 0, fmt.Errorf("no %s", s) }
  go func() { o.run() }()
  return 1, nil
}
func main() { fmt.Println("x") }
"""
FACTS["go"] = [
    ('namespace', 'shop', 'shop', '', 1),
    ('import', 'fmt', 'fmt', 'shop', 3),
    ('import', 'strings', 'strings', 'shop', 4),
    ('import', 'os', 'os', 'shop', 6),
    ('struct', 'Order', 'shop.Order', 'shop', 7),
    ('field', 'Total', 'shop.Order.Total', 'shop.Order', 8),
    ('field', 'items', 'shop.Order.items', 'shop.Order', 9),
    ('interface', 'Payable', 'shop.Payable', 'shop', 11),
    ('method', 'Pay', 'shop.Payable.Pay', 'shop.Payable', 12),
    ('method', 'Load', 'shop.Order.Load', 'shop.Order', 14),
    ('call', 'find', 'o.find', 'shop.Order.Load', 16),
    ('call', 'Errorf', 'fmt.Errorf', 'shop.Order.Load', 16),
    ('call', 'run', 'o.run', 'shop.Order.Load', 17),
    ('function', 'main', 'shop.main', 'shop', 20),
    ('call', 'Println', 'fmt.Println', 'shop.main', 20),
]

SOURCES["rust"] = """\
use std::fmt::Display;
use crate::a::{b, c};
/// struct Fake {}
#[derive(Debug, Clone)]
pub struct Order<'a> {
    pub total: u32,
    name: &'a str,
}
pub(crate) enum Kind { A, B(u8) }
pub trait Payable { fn pay(&self, x: u32) -> bool; fn twice(&self) -> u32 { self.one() } }
impl<'a> Payable for Order<'a> {
    #[inline]
    fn pay(&self, x: u32) -> bool { let c = '{'; self.check(x) && Vec::new().len() > 0 }
}
impl<'a> Order<'a> { pub fn load(id: &str) -> Self { println!("x {}", id); helper::run(id) } }
mod inner { pub fn go() { super::x() } }
fn main() { let r = r#"fn fake() {"#; inner::go(); }
"""
FACTS["rust"] = [
    ('import', 'std::fmt::Display', 'std::fmt::Display', '', 1),
    ('import', 'crate::a::b', 'crate::a::b', '', 2),
    ('import', 'crate::a::c', 'crate::a::c', '', 2),
    ('struct', 'Order', 'Order', '', 5),
    ('decorator', 'derive', 'derive(Debug, Clone)', 'Order', 4),
    ('field', 'total', 'Order.total', 'Order', 6),
    ('field', 'name', 'Order.name', 'Order', 7),
    ('enum', 'Kind', 'Kind', '', 9),
    ('interface', 'Payable', 'Payable', '', 10),
    ('method', 'pay', 'Payable.pay', 'Payable', 10),
    ('method', 'twice', 'Payable.twice', 'Payable', 10),
    ('call', 'one', 'self.one', 'Payable.twice', 10),
    ('base', 'Payable', 'Payable', 'Order', 11),
    ('method', 'pay', 'Order.pay', 'Order', 13),
    ('decorator', 'inline', 'inline', 'Order.pay', 12),
    ('call', 'check', 'self.check', 'Order.pay', 13),
    ('call', 'new', 'Vec::new', 'Order.pay', 13),
    ('call', 'len', 'len', 'Order.pay', 13),
    ('method', 'load', 'Order.load', 'Order', 15),
    ('call', 'println', 'println', 'Order.load', 15),
    ('call', 'run', 'helper::run', 'Order.load', 15),
    ('namespace', 'inner', 'inner', '', 16),
    ('function', 'go', 'inner.go', 'inner', 16),
    ('call', 'x', 'super::x', 'inner.go', 16),
    ('function', 'main', 'main', '', 17),
    ('call', 'go', 'inner::go', 'main', 17),
]



@pytest.mark.parametrize("language", sorted(SOURCES))
def test_golden_facts(language):
    assert islands.facts(SOURCES[language], language) == FACTS[language]


@pytest.mark.parametrize("language", islands.LANGUAGES)
def test_any_soup_of_tokens_is_read(language):
    """Whatever stands there, reading ends, and brackets that don't match are an error."""
    rng = random.Random(language)
    words = ["class", "A", "b", "(", ")", "{", "}", "[", "]", "<", ">", ";", ",", ":", "=", "=>", "@", "#", "fn", "func", "impl", "for", "import", "use", "::", ".", "\"s\"", "'", "\n", "interface", "namespace", "package", "type", "struct", "->", "record", "const", "pub"]
    for _ in range(3000):
        body = " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
        for f in islands.facts(body, language):
            assert len(f) == 5 and isinstance(f[4], int)


def test_file_scoped_namespace_and_overloads():
    f = islands.facts("namespace A.B;\nclass C { void M(int a) { } void M(string b) { } C() { } }", "csharp")
    assert [x[:3] for x in f] == [("namespace", "A.B", "A.B"), ("class", "C", "A.B.C"), ("method", "M", "A.B.C.M"), ("method", "M", "A.B.C.M"), ("method", "C", "A.B.C.C")]


def test_exports_do_not_hide_declarations():
    f = islands.facts("export { a, b } from './x'\nexport default class D {}\nexport async function* g() { h() }\nexport const o = { k: 1, m() { n() } }\n", "typescript")
    assert [x[:3] for x in f if x[0] != "call"] == [("import", "./x", "./x"), ("class", "D", "D"), ("function", "g", "g")]
