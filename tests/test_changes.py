"""A refresh that looks up again only what a change may tell: equal to a full run, with joins that grow with the change."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import architecture
from factloom.plans import engine
from factloom.sources import files as sources

COLUMNS = ("id", "kind", "component_id", "value_json", "evidence_ids", "rule_id")


def lot(n=16):
    """n files that call and construct each other's classes, some imports of files that aren't there."""
    own = {}
    for i in range(n):
        own[f"src/c{i}.ts"] = (
            f"import {{ C{i + 1} }} from './c{i + 1}';\nimport {{ M }} from './missing{i}';\nexport class C{i} {{\n  constructor(private readonly next: C{i + 1}, private readonly log: Log) {{}}\n"
            f"  run{i}(x: string) {{ return this.next.run{i + 1}(x); }}\n  shared() {{ return helper{i % 3}(); }}\n}}\nconst log = new Log();\nconst v{i} = new C{i}(v{i + 1}, log);\n"
        )
        own[f"main/java/com/p{i}/J{i}.java"] = f"package com.p{i};\nimport com.p{i + 1}.J{i + 1};\npublic class J{i} {{ void go{i}() {{ go{i + 1}(); only(); }} }}\n"
    return own


BASE = lot()
SEVERAL = BASE | {
    "src/c5.ts": BASE["src/c5.ts"].replace("run5(", "other5("),  # a method has another name
    "src/missing3.ts": "export class M {}\n", "src/missing4/index.ts": "export class M {}\n",  # imports wait for these
    "src/c8.ts": BASE["src/c8.ts"].replace("private readonly next: C9, private readonly log: Log", "private readonly log: Log, private readonly next: C9"),
    "src/c11.ts": BASE["src/c11.ts"].replace("const v11 = new C11(", "const v11 = new Other("), "src/c2.ts": "// a remark\n\n" + BASE["src/c2.ts"],
    "main/java/com/x/com/p4/J4.java": BASE["main/java/com/p4/J4.java"],
}
CHANGES = {
    "several": {k: v for k, v in SEVERAL.items() if k not in ("src/c14.ts", "main/java/com/p4/J4.java")},
    "one method": BASE | {"src/c5.ts": SEVERAL["src/c5.ts"]},
    "second symbol of a name": BASE | {"src/extra.ts": "export class Extra { run9(x: string) { return x; } }\nexport function helper1() { return 1; }\n"},
}


@pytest.fixture(scope="module")
def base(spark):
    return engine.analyse("base", sources.in_memory(spark, BASE, snapshot_id="s1"))


def told(facts):
    return sorted(map(str, facts.select(*COLUMNS).collect()))


@pytest.mark.parametrize("name", CHANGES)
def test_change_equals_full_run(name, spark, base, monkeypatch):
    seen, plain = [], architecture.resolve_changes

    def counted(*given):
        facts, n = plain(*given)
        seen.append({r["kind"]: r["n"] for r in n.collect()})
        return facts, n

    monkeypatch.setattr(architecture, "resolve_changes", counted)
    own = sources.in_memory(spark, CHANGES[name], snapshot_id="s2")
    how, got = engine.refresh("new", base, own)
    full = engine.analyse("new", own)
    assert how == "incremental" and told(got["facts"]) == told(full["facts"])
    whole = {r["kind"]: r["count"] for r in full["facts"].groupBy("kind").count().collect()}
    if name == "one method":
        assert all(seen[0].get(k, 0) <= 12 < whole[k] for k in ("symbol_call", "module_dependency")), (seen, whole)


def test_nothing_in_common(spark, base):
    """Fresh facts alone, and kept facts alone."""
    facts, none = base["facts"], base["facts"].limit(0)
    files = base["files"].filter("excluded_reason is null")
    unresolved = architecture.resolve_facts(facts, files)
    nowhere = files.select("repository_id", "relative_path").limit(0)
    alone, n = architecture.resolve_changes(none, none, facts, files, nowhere)
    assert told(alone) == told(unresolved) and n.agg(F.sum("n")).first()[0] > 0
    kept, n = architecture.resolve_changes(facts, none, none, files, nowhere)
    assert told(kept) == told(facts) and n.count() == 0


def test_parts_of_a_path_are_made_once(spark):
    """Not for each folder, field and role; nor a symbol's words for each verb."""
    own = spark.createDataFrame([("mod/src/main/java/com/acme/port/in/A.java", "findUserById")], "path string, name string")
    none = F.array().cast("array<string>")
    told = {"split(": architecture.path_metadata(F.col("path")), "split(lower(": architecture.role(F.col("path")), "lower(regexp_replace(": architecture.describe(F.lit("method"), F.col("name"), none)}
    for part, column in told.items():
        plan = own.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(part) == 1, plan
    row = own.select(architecture.path_metadata(F.col("path")).alias("m"), told["split(lower("].alias("role")).first()
    assert tuple(row["m"]) == ("main", "mod", "com.acme.port.in", "in") and row["role"] == "port-in"
