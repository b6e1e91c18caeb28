"""Effects of runs of statements: the same in one go, in any parts, and against a plain fold of one statement after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tarnfall.operators.detect import row_security as rls
from tarnfall.operators.detect.policy_effects import Effect, effect_of


class Plain:
    """One table and its policies, changed by one statement after another."""

    def __init__(self):
        self.table, self.policies = None, {}

    def step(self, e):
        here, kind = {"file": e["rel"], "line": e["line"], "text": e["text"]}, e["kind"]
        if kind == "create-table":
            if not (e["if_absent"] and self.table is not None):
                self.table = {"columns": e["columns"], "created": here, "enabled": False}
        elif kind == "drop-table":
            self.table, self.policies = None, {}
        elif kind == "alter-table":
            self.table = (self.table or {}) | {"enabled": e["enabled"], "changed": here, "disabled_last": not e["enabled"]}
        elif kind == "drop-policy":
            self.policies.pop(e["policy"], None)
        else:
            self.policy(e, here)

    def policy(self, e, here):
        name, opened = e["policy"], [{"place": {"file": e["rel"], "line": x["line"], "text": x["text"]}, "is_check": x["is_check"]} for x in e["open"]]
        if e["kind"] == "create-policy":
            self.policies[name] = {"command": e["command"], "roles": [], "open": opened}
        elif name not in self.policies:
            return
        p = self.policies[name]
        if e["roles"] is not None:
            p["roles"] = list(e["roles"])
        for side, is_check in (("using", False), ("check", True)):
            if e[f"{side}_clause"] is not None:
                p |= {f"{side}_clause": e[f"{side}_clause"], f"{side}_place": here}
                if e["kind"] == "alter-policy":
                    p["open"] = [x for x in p["open"] if x["is_check"] != is_check] + [x for x in opened if x["is_check"] == is_check]
        if e["new_name"] is not None:
            self.policies[e["new_name"]] = self.policies.pop(name)

    def rows(self):
        out = [] if self.table is None else [{"what": "table", **self.table}]
        return out + [{"what": "policy", "policy": n, "columns": (self.table or {}).get("columns"), **p} for n, p in self.policies.items()]


def shown(rows):
    return sorted(repr(sorted((r | {"open": sorted(map(repr, r.get("open", ())))}).items())) for r in rows)


def statements(rng, n):
    name = lambda: rng.choice("pqr")
    for i in range(n):
        yield rng.choice([
            f"create table t (a int, c{i} text)", f"create table if not exists t (b int, c{i} text)", "drop table t", "alter table t enable row level security", "alter table t disable row level security",
            f"drop policy {name()} on t", f"create policy {name()} on t for select to anon using (true)", f"create policy {name()} on t using (x = {i}) with check (true)", f"alter policy {name()} on t rename to {name()}",
            f"alter policy {name()} on t to editor{i}", f"alter policy {name()} on t using (true)", f"alter policy {name()} on t with check (y = {i})",
        ])


def of(sql):
    return [rls.FULL | e for e in rls.events("a.sql", sql)]


def test_any_parts_give_the_same():
    rng = random.Random(3)
    for _ in range(600):
        es = of(";\n".join(statements(rng, rng.randrange(1, 25))))
        plain = Plain()
        for e in es:
            plain.step(e)
        parts = [effect_of(e) for e in es]
        while len(parts) > 1:  # neighbours are combined in any order, by way of text
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [Effect.of(parts[i].text()).then(Effect.of(parts[i + 1].text()))]
        assert shown(parts[0].rows()) == shown(plain.rows())


def test_one_folder_is_many_tasks(spark):
    """All statements on one table, in 300 files of one folder, over many partitions."""
    rng = random.Random(4)
    texts = [(f"x/migrations/{i}_n.sql", ";\n".join(statements(rng, 3)) + ";") for i in range(300)]
    plain = Plain()
    for rel, sql in texts:
        for e in rls.events(rel, sql):
            plain.step(rls.FULL | e)
    rng.shuffle(texts)
    files = spark.createDataFrame(texts, "rel string, content string").withColumn("target", F.lit(None).cast("string")).repartition(7)
    effects = rls.saved(rls.file_effects(files, ("target",)), "effects")
    key, order = ["target", "unit", "unit_kind", "schema_name", "table_name"], ["plain", "size", "digits", "path"]
    ranged = rls.combined(effects.repartitionByRange(8, *key, *order), ("target",), order)
    assert effects.count() == 300 and 4 <= ranged.count() <= 8
    got = rls.final_state(files, ("target",))
    rows = [r.asDict(recursive=True) for r in got.collect()]
    assert {r["unit"] for r in rows} == {"sequence:x/migrations"} and got.columns[0] == "target"
    fields = ("what", "policy", "command", "roles", "using_clause", "check_clause", "open", "columns", "created", "enabled", "changed", "disabled_last")
    mine = [{k: r[k] for k in fields if r[k] is not None} for r in rows]
    want = [{k: v for k, v in r.items() if k in fields and v is not None} for r in plain.rows()]
    assert shown(mine) == shown(want) and mine


def test_projects_pass_the_gate_by_themselves(spark):
    sql = "create table notes (id int, user_id uuid);"
    rows = [("a", "db/migrations/1.sql", sql + "-- auth.uid()"), ("b", "db/migrations/1.sql", sql), (None, "supabase/migrations/1.sql", sql), ("b", "supabase/functions/f/index.ts", "Deno.serve(x)")]
    rows = [(t, rel, rel.rpartition(".")[2], text) for t, rel, text in rows]
    files = spark.createDataFrame(rows, "target string, rel string, ext string, content string")
    found = rls.row_security(files, ("target",)).unionByName(rls.edge_functions(files, ("target",)))
    assert sorted((str(r.target), r.file, r.rule_id) for r in found.collect()) == [("None", "supabase/migrations/1.sql", "rls-missing"), ("a", "db/migrations/1.sql", "rls-missing")]
