"""Tokens of sources, fields of calls, and what a name's place says of it."""

from tarnfall.functions.source_tokens import fields, is_value, tokens
from tarnfall.operators.detect.metadata_authz import bindings, index_of
from tarnfall.operators.detect.taint import carries, instructed


def of(source):
    return [(t.kind, t.text) for t in tokens(source)]


def test_templates_strings_and_comments():
    source = "a /* b */ + `x ${c + `y${d}` + '}'} z` // e\n+ \"f\\\"g\" + 'open\nh?.i ?? 1.5e3 !== {}"
    texts = [x for k, x in of(source) if k == "text"]
    assert texts == ["x ", "y", " z"]
    assert [x for k, x in of(source) if k == "name"] == ["a", "c", "d", "h", "i"]
    assert [x for k, x in of(source) if k == "string"] == ["}", 'f\\"g', "open"]
    assert [x for k, x in of(source) if k == "op" and len(x) > 1] == ["?.", "??", "!=="]
    assert "".join(source[t.at] for t in tokens("ab cd") for source in ["ab cd"]) == "ac"
    assert of("`open ${a") == [("text", "open "), ("name", "a")] and of("") == [] and of("'") == [("string", "")]


def test_values():
    own = [*tokens("f({ v: 1, a: v, b: x.v }, v?.w, t ? v : 2)")]
    assert [own[i].at for i in range(len(own)) if own[i].text == "v" and is_value(own, i)] == [13, 26, 36]


def test_fields():
    own = [*tokens("({ model: 'm', messages: [{ role: 'system', content: a + b }], system: f(x, y) })")]
    read = {k: " ".join(t.text for t in own[i:j]) for k, i, j in fields(own)}
    assert read["model"] == "m" and read["role"] == "system" and read["content"] == "a + b" and read["system"] == "f ( x , y )" and read["messages"].startswith("[ {")


def test_input_as_instructions():
    assert carries("`hello ${name}`", {"name"}) and not carries("'say your name'", {"name"}) and not carries("x.name", {"name"})
    assert instructed("({ messages: [{ content: q, role: 'system' }] })", {"q"})
    assert not instructed("({ messages: [{ role: 'system', content: 'be kind' }, { role: 'user', content: q }] })", {"q"})
    assert not instructed("({ prompt: q })", {"q"}) and instructed("({ prompt: 'Translate this ' + q })", {"q"})
    assert not instructed("({ prompt: 'Translate this ' + q, messages: [] })", {"q"})
    assert instructed("({ system: req.body.text })", {})


def test_bindings():
    source = "const a = u.user_metadata.role;\nlet { b, c: d = 1 } = u.user_metadata, e = 2;\nvar f = u?.raw_user_meta_data?.['plan'];\nconst g = 1; h = u.user_metadata.x;\nconst i =\n u.user_metadata.y"
    own = [*tokens(source)]
    line = [source.count("\n", 0, t.at) + 1 for t in own]
    assert {own[i].text: f for i, f in bindings(own, line)} == {"a": "role", "b": "b", "d": "c", "f": "plan", "g": None, "i": None}
    rows = index_of("x.ts", "if (a === 'admin') {}\nb ? 1 : 2")
    a = next(r for r in rows if r["token"] == "a")
    assert a["tested"] and a["n1"] == "===" and a["n2"] == "'admin" and a["p1"] == "(" and a["p2"] == "if" and a["n4"] == "{"
    b = next(r for r in rows if r["token"] == "b")
    assert b["p1"] is None and b["n1"] == "?" and not b["tested"]
