"""A small source tree from scan to slice: index, search, render, command line and server."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern import cli, server
from quern.functions import docs, extract
from quern.functions import text as X
from quern.operators import document, render, search, state
from quern.plans import index as plans

TREE = {
    "src/auth.ts": "export function findUser(id) { return id; }\nexport function createSession(u) { return u; }\n/** Logs a user in. */\nexport function login(id) {\n  const u = findUser(id);\n  return createSession(u);\n}\n",
    "src/routes.ts": "import { login } from './auth';\napp.post('/api/login', login);\n",
    "src/client.ts": "export async function loginFromUi() { return fetch('/api/login'); }\n",
    "src/billing.ts": "export function chargeCard() { return 1; }\n",
    "src/README.md": "# Auth\n\nHow users get in.\n",
    "src/cli.ts": "import { login } from './auth';\nexport function runIt() { login(1); }\n",
    "tools/job.py": "from lib import x\n\nclass Job:\n    \"\"\"A nightly job.\"\"\"\n    def start(self):\n        chargeCard()\n",
    "node_modules/dep/index.js": "export function hidden() {}\n",
    "package.json": '{"main": "dist/auth.js"}',
}


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    s = cli.Session(spark, str(root), str(tmp_path_factory.mktemp("db")))
    s.index()
    return s


def ids(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_the_index_holds_the_tree(session):
    t = session.store.read()
    nodes = {r[0] for r in ids(t["nodes"], "node_id")}
    assert {"file:src/auth.ts", "function:src/auth.ts:login", "class:tools/job.py:Job", "method:tools/job.py:start", "route:POST /api/login"} <= nodes
    assert not any("hidden" in n for n in nodes)
    edges = ids(t["evidence"], "source_id", "target_id", "kind")
    assert ("function:src/auth.ts:login", "function:src/auth.ts:findUser", "CALLS") in edges
    assert ("file:src/routes.ts", "function:src/auth.ts:login", "REFERENCES") in edges
    assert ("function:src/cli.ts:runIt", "function:src/auth.ts:login", "CALLS") in edges
    assert ("file:tools/job.py", "function:src/billing.ts:chargeCard", "REFERENCES") in edges
    assert ("file:src/client.ts", "route:UNKNOWN /api/login", "CONSUMES_ROUTE") in edges
    assert ids(t["imports"], "importer_file", "imported_file") == {("src/routes.ts", "src/auth.ts"), ("src/cli.ts", "src/auth.ts")}
    assert ids(t["entries"], "file_path", "kind") == {("src/cli.ts", "convention"), ("src/auth.ts", "package-main")}


def test_a_slice_of_login_leaves_billing_out(session):
    text = plans.slice_text(session.store.read(), session.files(), "login")
    assert ">>> ENTRY function: function:src/auth.ts:login (src/auth.ts:4-7)" in text and "// » Logs a user in." in text
    assert "// --- Nearest doc: src/README.md ---" in text and "// » Auth — How users get in." in text
    assert "chargeCard" not in text and "findUser" in text


def test_only_changed_files_are_read_again(session):
    from pathlib import Path

    before = session.store.read()["evidence"].count()
    session.index()
    assert session.store.read()["evidence"].count() == before
    path = Path(session.root) / "src/billing.ts"
    path.write_text("export function refund() { return 1; }\n")
    session.index()
    nodes = {r[0] for r in ids(session.store.read()["nodes"], "node_id")}
    assert "function:src/billing.ts:refund" in nodes and "function:src/billing.ts:chargeCard" not in nodes
    path.write_text(TREE["src/billing.ts"])
    session.index()


def test_search_over_columns_phrases_and_fallback(spark):
    rows = [("a", "function", "alpha", "src.alpha", None, "beta gamma"), ("b", "file", "beta", "beta", None, None), ("c", "function", "betaX", "q", "gamma beta", None), ("d", "class", "zeta", "beta.zeta", None, None)]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, name string, qualified_name string, signature string, doc string")
    found = lambda q, **k: [r.node_id for r in search.search(nodes, q, **k).orderBy("position").collect()]
    assert found("beta")[0] == "b" and set(found("beta")) == {"a", "b", "c", "d"}
    assert found("beta.gamma") == ["a"]  # one word of two tokens is a phrase
    assert found("etaX") == ["c"]  # no token matches: by substring
    assert found(' "" ') == []
    ties = spark.createDataFrame([("f1", "function", "run", "src/service.ts"), ("f2", "function", "run", "src/cli.ts")], "node_id string, kind string, name string, file_path string")
    assert [r.node_id for r in search.search(ties, "run", entries=spark.createDataFrame([("f2",)], "node_id string")).orderBy("position").collect()] == ["f2", "f1"]


def test_bm25_equals_a_loop(spark):
    import math
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choices("a b c d e f".split(), k=draw.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.score for r in search.ranked(df, "id", ("t",), [["a"], ["b", "c"]]).collect()}
    lists = [t.split() for t in texts]
    mean = sum(map(len, lists)) / len(lists)
    count = lambda w, p: sum(w[i : i + len(p)] == p for i in range(len(w)))
    for i, w in enumerate(lists):
        score, hit = 0.0, False
        for p in (["a"], ["b", "c"]):
            df_ = sum(count(x, p) > 0 for x in lists)
            tf = count(w, p)
            raw = math.log((len(lists) - df_ + 0.5) / (df_ + 0.5))
            score += (raw if raw > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            hit |= tf > 0
        assert (i in got) == hit and (not hit or got[i] == pytest.approx(score))


def test_a_small_budget_keeps_the_surest_edges(spark):
    nodes = spark.createDataFrame([("e", "function", "e", "e", "e.ts", 1, 1, None, None)], "node_id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, doc string")
    edges = spark.createDataFrame([("e", f"t{i}", "CALLS", 2 if i < 12 else 4) for i in range(24)], "source_id string, target_id string, kind string, verification int")
    files = spark.createDataFrame([("e.ts", "x")], "path string, content string")
    text = document.rendered(nodes, edges, ["e"], files, max_tokens=200)
    lines = [x for x in text.split("\n") if "--[CALLS]-->" in x]
    assert 0 < len(lines) < 24 and any("[4]" in x for x in lines) and not any("[2]" in x for x in lines)
    assert f"truncated, {24 - len(lines)} remaining" in text


def test_profile_moves_and_normalises():
    moved = render.allocation("impact", profile={"edge_density": 25})
    assert sum(moved) == pytest.approx(1) and moved[1] > render.allocation("impact")[1]


def test_store_keeps_the_old_version_when_a_change_fails(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "s"))
    store.transaction(lambda t: state.marked_dirty(t, spark.createDataFrame([("a",)], "file_path string"), "x"))

    def broken(t):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.transaction(broken)
    assert ids(store.read()["dirty"], "file_path", "reason") == {("a", "x")}


def test_paths_and_guards(spark):
    assert X.guarded("a/b", "/r") == "/r/a/b"
    for bad in ("../x", "/etc", "../r2/x"):
        with pytest.raises(ValueError):
            X.guarded(bad, "/r")
    df = spark.createDataFrame([("a/./b/../c.ts",), ("../x",), ("a/..",)], "p string")
    assert [r[0] for r in df.select(X.resolved_path(F.col("p"))).collect()] == ["a/c.ts", None, ""]
    got = spark.createDataFrame([("a/venv/x.py",), ("src/venv.py",), ("a/b.min.js",)], "p string").select(X.ignored(F.col("p")))
    assert [r[0] for r in got.collect()] == [True, False, True]


@pytest.mark.parametrize("raw, want", [("/** Does it.\n * More.\n *\n * Second.\n */", "Does it. More."), ("// eslint-disable", None), ("# Says so\n# @param x", "Says so"), ("/* Copyright me */", None), ("ab", None), ('"""Doc."""', "Doc."), ("/// Rust says.", "Rust says."), ("word " * 60, ("word " * 40).strip() + "…")])
def test_comments_say_the_same_in_both_forms(spark, raw, want):
    assert docs.normalize(raw) == want
    assert spark.createDataFrame([(raw,)], "t string").select(X.normalize_doc(F.col("t"))).first()[0] == want


def test_documents_without_headings_and_with_rules():
    assert docs.parse("Name\n====\n\ntext _here_\n\nSub\n---\n") == ("Name — text here", "Name · Sub")
    assert docs.parse("") == (None, None)
    assert docs.parse("plain words only") == ("plain words only", None)
    assert docs.python_docstring("def f(a,\n      b):\n    '''Adds.\n\n    More.'''\n", 1) == "Adds."
    assert docs.module_doc("#!/bin/sh\n\n# Runs it.\nx\n") == "Runs it."
    assert docs.module_doc("x = 1\n# no\n") is None


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.java", "public class J extends K {\n  public J(int a) { f(a); }\n  List<String> add(int a) throws E { if (a) { return b(c); } }\n}\n", {"class:a.java:J", "method:a.java:J", "method:a.java:add"}),
        ("a.rs", "pub(crate) struct S;\nimpl<T> D for S { fn go() {} }\nunsafe trait Q { fn h(); }\n", {"class:a.rs:S", "method:a.rs:impl S", "function:a.rs:go", "interface:a.rs:Q", "method:a.rs:h"}),
        ("a.go", "type T struct {}\ntype I interface { R() }\nfunc (t T) Run() {}\n", {"class:a.go:T", "interface:a.go:I", "function:a.go:Run", "method:a.go:Run"}),
        ("a.rb", "module M\n  class C\n    def go\n    end\n  end\nend\n", {"class:a.rb:M", "class:a.rb:C", "method:a.rb:go"}),
        ("a.c", "struct P { int x; };\nstatic int go(struct P *p) { while (1) { f(p); } }\n", {"class:a.c:P", "function:a.c:go"}),
        ("a.groovy", "public class G {\n  def run(x) {\n  }\n}\n", {"class:a.groovy:G", "function:a.groovy:run"}),
        ("a.kt", "object O { fun f() {} }\nfun g() {}\n", {"class:a.kt:O", "method:a.kt:f", "function:a.kt:g"}),
    ],
)
def test_declarations_of_languages(path, text, want):
    assert {f.target_id for f in extract.languages(path, text) if f.what == "node"} == want


def test_command_line(spark, session, capsys):
    base = ["--root", session.root, "--db", session.store.folder]
    assert any("login" in x for x in cli.run(spark, ["query", "--query", "login", *base]))
    assert cli.run(spark, ["security", "check", "--file", "a/.ssh/id", *base])[0].startswith("skip")
    assert cli.run(spark, ["security", "redact", "--text", "token: abc", *base]) == ["token: [REDACTED]"]
    assert any("src" in x for x in cli.run(spark, ["container", "build", *base]))
    assert "dirty: 0" in cli.run(spark, ["container", "status", *base])
    assert any("src/routes.ts" in x for x in cli.run(spark, ["invalidate", "--file", "src/auth.ts", *base]))
    assert cli.run(spark, ["cache", "status", *base]) == ["cached: 0", "valid: 0"]


def test_server_answers(session):
    ask = lambda method, **params: server.answer(session, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert len(ask("tools/list")["result"]["tools"]) == 5
    assert ask("nothing")["error"]["code"] == -32601
    assert ask("tools/call", name="context_search", arguments={})["error"]["code"] == -32602
    assert ask("tools/call", name="context_compile", arguments={"query": "login", "policy": "none"})["error"]["code"] == -32602
    got = json.loads(ask("tools/call", name="context_expand_node", arguments={"nodeId": "function:src/auth.ts:login"})["result"]["content"][0]["text"])
    assert {n["nodeId"] for n in got["neighbors"]} >= {"file:src/auth.ts", "function:src/auth.ts:findUser"}
    assert "login" in ask("tools/call", name="context_search", arguments={"query": "login"})["result"]["content"][0]["text"]


def test_watch_refreshes_once_the_tree_is_still(spark, tmp_path):
    import threading
    import time

    from quern.streaming.changes import watch

    (tmp_path / "a.ts").write_text("1")
    calls = []
    threading.Timer(2.0, lambda: (tmp_path / "b.ts").write_text("2")).start()
    began = time.time()
    assert watch(spark, str(tmp_path), lambda: calls.append(time.time()), rounds=1) == 1
    assert len(calls) == 1 and calls[0] - began >= 2.0
