"""Symbols and calls of real-looking sources: comments, quotes, templates, patterns, arrow functions, overloads."""

from factloom.functions import scans


def told(path, text):
    found = list(scans.braces_symbols(path, text))
    calls = [(v["caller_symbol_id"].split("#")[1], v["expression"]) for _, k, _, _, v in found if k == "symbol_call"]
    symbols = {v["symbol_id"].split("#")[1]: v for _, k, _, _, v in found if k == "code_symbol"}
    return symbols, calls, [v for _, k, _, _, v in found if k == "dependency_injection"]


def test_comments_and_strings_hold_no_code():
    text = "class A { foo() { // don't stop\n /* it's { */ a(); } bar() { b(); } } class B { baz() { c(); } }\n// usage: legacy(x) { old(); }\nfunction last() { return /['\"{]/.test(q(1)); }\n"
    symbols, calls, _ = told("a.ts", text)
    assert list(symbols) == ["A", "B", "A.foo", "A.bar", "B.baz", "last"]
    assert calls == [("A.foo", "a"), ("A.bar", "b"), ("B.baz", "c"), ("last", "test"), ("last", "q")]
    assert (symbols["A"]["start_line"], symbols["A"]["end_line"], symbols["A"]["members"]) == (1, 2, ["foo", "bar"])


def test_templates_keep_their_expressions():
    _, calls, _ = told("a.js", "function f() { return `it's { ${g(`b ${h({a: 1})} }`)} ) ${i()}`; }\nfunction k() { l('}'); }")
    assert calls == [("f", "g"), ("f", "h"), ("f", "i"), ("k", "l")]


def test_lengths_and_lines_stay():
    for text in ("a /* x", '"open\nb"', "`a ${b", "'\\'' // \n x", '"""t\n"q" """ y', "@\"c:\\\" z", "}}}", "x = /[/\"]/; y"):
        for script in (True, False):
            code, plain = scans.blanked(text, script)
            assert len(code) == len(plain) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_arrow_functions_and_constructors():
    symbols, calls, points = told("src/auth.ts", """
interface UserRepository { save(email: string): Promise<void>; }
class SqlUserRepository implements UserRepository { async save(email: string) { await persist(email); } }
class RegisterUser { constructor(private readonly repository: UserRepository) {} async execute(email: string) { return this.repository.save(email); } }
class AuthController { constructor(private readonly registerUser: RegisterUser) {} register = async (email: string) => this.registerUser.execute(email); }
const save = async (id) => { await put(id); };
const twice = x => x + once(x)
const old = function (a, b) { legacy(a); };
""")  # fmt: skip
    assert symbols["AuthController.register"]["class_name"] == "AuthController" and symbols["AuthController.register"]["async"]
    assert symbols["RegisterUser.constructor"]["symbol_type"] == "constructor" and symbols["save"]["symbol_type"] == "function"
    assert calls == [
        ("SqlUserRepository.save", "persist"), ("RegisterUser.execute", "this.repository.save"), ("AuthController.register", "this.registerUser.execute"), ("save", "put"), ("twice", "once"), ("old", "legacy"),
    ]
    assert [(p["class_name"], p["parameter"], p["dependency_type"]) for p in points] == [("RegisterUser", "repository", "UserRepository"), ("AuthController", "registerUser", "RegisterUser")]


JAVA = """
@RequiredArgsConstructor
public class C<T extends X<T>> extends Base<T> {
  private final Repo repo; // it's
  @GetMapping("/{id}")
  public Map<String, List<T>> find(@PathVariable("id") String id, char q) throws E {
    char c = '"'; String s = "don't { "; if (x) { return repo.find(id); }
    return list.stream().map(x -> other(x)).toList();
  }
  public int find(int x) { return 1; }
  abstract void none();
}
class D { private final Repo repo; public D(@Qualifier("x") Repo repo, String n) { init(); } }
interface P { User byName(String n); default int z() { return y(); } }
"""


def test_java():
    symbols, calls, points = told("C.java", JAVA)
    assert [k for k in symbols if k not in ("C", "D", "P")] == ["C.find", "C.find~2", "C.none", "D.D", "P.byName", "P.z"]
    assert calls == [("C.find", "repo.find"), ("C.find", "list.stream"), ("C.find", "map"), ("C.find", "other"), ("C.find", "toList"), ("D.D", "init"), ("P.z", "y")]
    assert [(p["class_name"], p["parameter"]) for p in points] == [("C", "repo"), ("D", "repo")]  # Lombok's, and a constructor's
    assert symbols["C.find"]["parameters"] == ['@PathVariable("id") String id', "char q"] and symbols["C.find"]["visibility"] == "public"
    relations = [v for _, k, _, _, v in scans.braces_symbols("C.java", JAVA) if k == "type_relation"]
    assert [(r["source_type"], r["target_type"]) for r in relations] == [("C", "Base")]
    sharp, made, _ = told("D.cs", 'class D { public int Twice(int x) => Inner(x); string p = @"c:\\"; void G() { H(); } }')
    assert made == [("D.Twice", "Inner"), ("D.G", "H")] and len(sharp) == 3


def test_reactive_pipelines():
    text = """class H { // it's
      public Mono<Order> one(@Valid Req r) { return r.bodyToMono(X.class).flatMap(this::f).switchIfEmpty(e).onErrorResume(g).retry(2).flatMap(h).publishOn(s); }
      Flux<Map<String, Order>> all() { x.subscribe(); return Flux.just(1).map(y).parallel().sequential(); }
      Mono<Void> none() { return Mono.empty(); } }"""
    one, all_, none = [v for _, _, _, _, v in scans.reactive_pipelines(text)]
    assert (one["class_name"], one["symbol_name"], one["cardinality"], one["operators"]) == ("H", "one", "zero-or-one", ["flatMap", "switchIfEmpty", "onErrorResume", "retry", "publishOn"])
    assert (one["empty_strategy"], one["error_strategy"], one["concurrency"], one["body_input"], one["risks"]) == ("switchIfEmpty", ["onErrorResume", "retry"], ["publishOn"], "Mono", [])
    assert (all_["cardinality"], all_["payload"], all_["concurrency"], all_["body_input"], all_["risks"]) == ("many", "Map<String, Order>", ["parallel", "sequential"], None, [scans.SUBSCRIBED])
    assert (none["operators"], none["empty_strategy"]) == ([], None)


def test_a_long_file_takes_seconds():
    import time

    began = time.time()
    symbols, calls, _ = told("a.ts", "class A {\n" + "".join(f"  m{i}() {{ // don't\n    this.x.f{i}(g(h({i})));\n  }}\n" for i in range(20_000)) + "}\n")
    assert len(symbols) == 20_001 and len(calls) == 60_000 and time.time() - began < 30


def test_a_file_is_blanked_once_and_heads_lose_none(monkeypatch):
    import random

    from factloom.functions import scans

    seen, put = [], scans.blanked
    monkeypatch.setattr(scans, "blanked", lambda *a: [seen.append(a), put(*a)][1])
    code = "class A {\n/* " + "long (comment) " * 99 + " */ void f() { g(1); }\n}\n"
    found = [r for r in scans.scan("A.java", code, {"source.call"}) if r[0] == "source.call"]
    assert [r[4]["expression"] for r in found] == ["g"] and len(seen) == 1
    rng = random.Random(2)
    for _ in range(2_000):
        text = "".join(rng.choice(["foo", "a.b", "(", ")", "<", ">", "T, ", " " * 40, "\n" * 35, ";", "{", "9", " "]) for _ in range(rng.randint(1, 25)))
        assert [m.span() for m in scans.heads(text)] == [m.span() for m in scans._HEAD.finditer(text)], text
