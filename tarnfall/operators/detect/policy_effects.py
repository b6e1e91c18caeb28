"""What a run of statements does to one table and its policies, as a value that can be combined with the next run's.

Statements on other tables have no influence, so a table's effects are combined by themselves. What a run leaves behind may
depend on what it found: a policy that is renamed or altered need not exist. So an effect says, for the table, what is left
if there was one and what if there was none; for each policy it mentions, the alternatives in order: an earlier policy
with changes, which counts only if it was there, or one that the run has made. Combining is associative: files, or parts of
a folder, can be summed up anywhere and put together in order.
"""

from __future__ import annotations

import json

SAME = {"change": {}}
#: Sides of a policy: its predicate and the key of its permissive declarations.
SIDES = (("using", False), ("check", True))


def _changed(outcome: dict, change: dict) -> dict:
    """An outcome with later changes: of what was there, or of a table that was made."""
    kind = next(iter(outcome))
    return {kind: outcome[kind] | change}


class Effect:
    """``found``: the table if there was one before, as {"change": ..} or {"made": ..} or None; ``absent``: if there was none;
    ``policies``: name -> [[earlier name or None, values or changes], ..]; ``dropped``: policies not named are gone."""

    def __init__(self, found: dict | None = SAME, absent: dict | None = None, policies: dict | None = None, dropped: bool = False):
        self.found, self.absent, self.policies, self.dropped = found, absent, policies or {}, dropped

    def text(self) -> str:
        return json.dumps([self.found, self.absent, self.policies, self.dropped], ensure_ascii=False)

    @classmethod
    def of(cls, text: str) -> Effect:
        return cls(*json.loads(text))

    def slot(self, name: str) -> list:
        """What a policy's name stands for after this run."""
        if name in self.policies:
            return self.policies[name]
        return [] if self.dropped else [[name, {}]]

    def then(self, later: Effect) -> Effect:
        """Both runs as one."""

        def table(outcome: dict | None) -> dict | None:
            if outcome is None:
                return later.absent
            return _changed(outcome, later.found["change"]) if later.found and "change" in later.found else later.found

        policies = {} if later.dropped else dict(self.policies)
        for name, alternatives in later.policies.items():
            own: list = []
            for source, change in alternatives:
                own += [[None, change]] if source is None else [[earlier, values | change] for earlier, values in self.slot(source)]
                if own and own[-1][0] is None:  # always there: what follows is never looked at
                    break
            policies[name] = own
        return Effect(table(self.found), table(self.absent), policies, self.dropped or later.dropped)

    def step(self, e: dict) -> Effect:
        """This run and one more statement."""
        return self.then(effect_of(e))

    def rows(self) -> list[dict]:
        """The table and its policies if nothing was there before."""
        table = self.absent and next(iter(self.absent.values()))
        out = [] if table is None else [{"what": "table", **table}]
        for name, alternatives in self.policies.items():
            for source, values in alternatives:
                if source is None:
                    sides = {k: v for k, v in values.items() if not k.startswith("open_")}
                    opened = [x for side, _ in SIDES for x in values.get(f"open_{side}", ())]
                    out.append({"what": "policy", "policy": name, "columns": (table or {}).get("columns"), **sides, "open": opened})
                    break
        return out


def effect_of(e: dict) -> Effect:
    """The effect of one statement, an event of :mod:`row_security`."""
    here = {"file": e["rel"], "line": e["line"], "text": e["text"]}
    kind = e["kind"]
    if kind == "create-table":
        made = {"made": {"columns": e["columns"], "created": here, "enabled": False}}
        return Effect(SAME if e["if_absent"] else made, made)
    if kind == "drop-table":
        return Effect(None, None, {}, True)
    if kind == "alter-table":
        change = {"enabled": e["enabled"], "changed": here, "disabled_last": not e["enabled"]}
        return Effect({"change": change}, {"made": change})
    name = e["policy"]
    if kind == "drop-policy":
        return Effect(policies={name: []})
    created, values = kind == "create-policy", {}
    if e["roles"] is not None:
        values["roles"] = list(e["roles"])
    for side, is_check in SIDES:
        opened = [{"place": {"file": e["rel"], "line": x["line"], "text": x["text"]}, "is_check": is_check} for x in e["open"] if x["is_check"] == is_check]
        if e[f"{side}_clause"] is not None:
            values |= {f"{side}_clause": e[f"{side}_clause"], f"{side}_place": here, f"open_{side}": opened}
        elif created:
            values[f"open_{side}"] = opened
    if created:
        return Effect(policies={name: [[None, {"command": e["command"], "roles": []} | values]]})
    new = e["new_name"]
    if new is None or new == name:
        return Effect(policies={name: [[name, values]]})
    return Effect(policies={new: [[name, values], [new, {}]], name: []})
