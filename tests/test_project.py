"""A tree of real files from input to output, and rule files."""

import hashlib
import json
from pathlib import Path

import pytest

from maskwright.operators import ignores as ignore_ops
from maskwright.operators import paths
from maskwright.operators.hits import mask_context, token_context
from maskwright.plans import staging
from maskwright.plans.project import scan_project
from maskwright.plans.scan import scan_findings
from maskwright.rules import ValueRule, default_rules, load_rules
from maskwright.session import shared_folder
from maskwright.sources import parts

FILES = {
    "app.ini": b"password=one\r\nhost=h\r\n",
    "src/a.py": b"token = 'two'\n",
    "src/keep/b.py": b"token = 'one'\n",
    "node_modules/x.ini": b"password=hidden\n",
    "bad.yaml": b"secret: a\xffb\n",
    "logo.png": b"\x89PNG\x00",
    ".env": b"password=four\n",
    ".github/_x.yml": b"a: b\r\n",
    "pkg/__init__.py": b"",
    "raw.bin": b"\x89PNG\r\n\x1a\n\xff\xfe\x00\x01",
    "it's a name/%41 b.dat": b"\x00'",
}


@pytest.fixture
def tree(tmp_path):
    for name, data in FILES.items():
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return tmp_path


def test_tree_to_output(spark, tree):
    done = scan_project(spark, str(tree / "in"), str(tree / "out"), token_context())
    text = {r.path: r.text for r in done.sanitized.files.collect()}
    assert text["app.ini"] == "password=<PASSWORD_2>\nhost=<URL_1>\n" and text[".env"] == "password=<PASSWORD_1>\n"
    assert text["src/a.py"] == "token = '<ACCESS_TOKEN_1>'\n" and text["src/keep/b.py"] == "token = '<ACCESS_TOKEN_2>'\n"
    assert text["bad.yaml"] == 'secret: "<GENERIC_SECRET_1>"\n'
    assert set(text) == set(FILES) - {"node_modules/x.ini"}
    assert done.summary.first().asDict() == {"files_scanned": 7, "files_unscanned": 3, "total_redactions": 6, "partial": False}
    assert {r.path for r in done.coverage.collect()} == set(text)
    assert "value" not in done.sanitized.findings.columns and done.sanitized.findings.count() == 6
    assert (tree / "in" / "app.ini").read_bytes() == FILES["app.ini"]


def test_changed_and_excluded(spark, tree):
    manifest = spark.createDataFrame([("app.ini", "stale"), ("src/a.py", "stale")], "path string, hash string")
    fresh = spark.sql("select 'bad.yaml' as path, sha2(X'7365637265743A2061FF620A', 256) as hash")
    excluded = spark.createDataFrame([("src/keep",)], "path string")
    done = scan_project(
        spark, str(tree / "in"), str(tree / "part"), mask_context(), excluded=excluded,
        manifest=manifest.union(fresh), changed_only=True,
    )
    assert {r.path for r in done.sanitized.files.collect()} == set(FILES) - {"bad.yaml", "src/keep/b.py", "node_modules/x.ini"}
    assert done.summary.first().partial


@pytest.mark.parametrize("context", [mask_context, token_context])
def test_tree_is_complete_and_copies_keep_their_bytes(spark, tree, context, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 11)  # files beyond come in parts, and are redacted all the same
    root = f"file:{tree}/x/../in/"
    done = scan_project(spark, root, str(tree / "table"), context(), tree=str(tree / "copy"))
    there = {str(p.relative_to(tree / "copy")): p.read_bytes() for p in (tree / "copy").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert set(there) == set(FILES) - {"node_modules/x.ini"}
    for name in ("logo.png", "raw.bin", "it's a name/%41 b.dat"):
        assert there[name] == FILES[name], name
    assert there[".github/_x.yml"] == b"a: b\n" and there["pkg/__init__.py"] == b""
    for name in (".env", "app.ini", "src/a.py", "src/keep/b.py", "bad.yaml"):
        assert not any(v in there[name] for v in (b"one", b"two", b"four", b"ab")), name
    reasons = {r.path: r.reason for r in done.coverage.collect()}
    assert reasons["raw.bin"] == reasons["logo.png"] == "binary" and reasons[".env"] is None and len(reasons) == len(there)
    assert {r.path: r.sha256 for r in done.written.collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in there.items()}


def test_a_scan_reads_and_scans_once_and_leaves_no_values(spark, tree, monkeypatch):
    calls = []
    monkeypatch.setattr(staging, "scan", lambda *a, real=staging.scan: calls.append(1) or real(*a))
    before = {p for p in Path(shared_folder(spark).removeprefix("file:")).rglob("scanned-*")}
    scan_project(spark, str(tree / "in"), str(tree / "out"), token_context())
    assert calls == [1]
    assert {p for p in Path(shared_folder(spark).removeprefix("file:")).rglob("scanned-*")} == before


def test_rule_files_with_code_and_python_spelling(spark, files, tmp_path):
    raw = {"value_patterns": [{"name": "odd", "regex": r"x[[]y[]a]\Z"}], "code_patterns": {"python": [r'(?i)ref_\w+ = "([^"]*)"'], "go": []}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(raw))
    ctx = mask_context(load_rules(str(path)))
    found = scan_findings(files({"a.py": 'ref_a = "one"\ndbPassword = "two"\nx[y]\n', "b.go": 'apiKey := "z"'}), ctx).collect()
    assert sorted((r.path, r.line, r.rule, r.value) for r in found) == [("a.py", 1, "code_variable_pattern", "one"), ("a.py", 3, "odd", "x[y]")]
    for bad in ({"value_patterns": [{"name": "broken", "regex": "a("}]}, {"code_patterns": {"go": ["no group"]}}, {"code_patterns": {"go": ["(a)(b)"]}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load_rules(str(path))


def test_rule_files(tmp_path):
    raw = {
        "key_patterns": ["password", "my[_-]?thing"],
        "value_patterns": [{"name": "ticket", "regex": "(?i)TCK-(?P<n>\\d+)"}, {"name": "jwt_token", "regex": "x"}],
        "placeholder_allowlist": ["Dummy"],
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(raw))
    rules = load_rules(str(path))
    assert [(k.pattern, k.category) for k in rules.keys] == [("password", "PASSWORD"), ("my[_-]?thing", "GENERIC_SECRET")]
    assert rules.values[0].pattern == r"TCK-(?<n>\d+)" and rules.values[0].allowlist_groups == (1,)
    assert rules.values[1].category == "ACCESS_TOKEN" and rules.allowlist == ("dummy",)
    groups = {v.name: v.allowlist_groups for v in default_rules().values if v.allowlist_groups}
    assert groups == {"ipv6_address": (1,), "generic_url": (1, 2), "bearer_token": (1,)}
    assert ValueRule("x", r"(a[()]+)\((b(?:c))(?=d)").allowlist_groups == (2, 1)
    assert len(default_rules().keys) == 33 and len(default_rules().values) == 12


def test_yaml_rule_files(tmp_path):
    """The same rules in JSON, in YAML as a program writes it and as people write it."""
    yaml = pytest.importorskip("yaml")
    raw = {
        "key_patterns": ["password", "my[_-]?thing", "db\\.host"],
        "value_patterns": [{"name": "ticket", "regex": "(?i)TCK-(?P<n>\\d+)[\"']it's a rather long pattern that does not fit into one line of a file of rules " + "x" * 60}],
        "code_patterns": {"python": ['(?i)ref_\\w+ = "([^"]*)"'], "go": []},
        "placeholder_allowlist": ["Dummy", "null", "127.0.0.1", "n/a"],
    }
    as_json, as_yaml, by_hand = (tmp_path / f"rules.{x}" for x in ("json", "yaml", "yml"))
    as_json.write_text(json.dumps(raw))
    as_yaml.write_text(yaml.safe_dump(raw, sort_keys=False))
    assert load_rules(str(as_yaml)) == load_rules(str(as_json))
    by_hand.write_text("# keys\nkey_patterns:\n  - password\n  - 'my[_-]?thing'  # two\n  - \"db\\\\.host\"\nvalue_patterns:\ncode_patterns: {}\n")
    rules = load_rules(str(by_hand))
    assert [k.pattern for k in rules.keys] == raw["key_patterns"] and rules.keys[0].category == "PASSWORD"
    assert rules.values == () and rules.code == () and rules.allowlist == ()


def test_rule_files_that_cannot_be_read(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "rules.yaml"
    path.write_text("")
    assert load_rules(str(path)).keys == ()
    for text, said in (
        ("placeholder_allowlist:\n- null\n", "placeholder_allowlist: None"), ("key_patterns:\n- 12\n", "key_patterns: 12"), ("key_patterns: password\n", "must be a list"),
        ("value_patterns:\n- name: a\n", "needs a name and a regex"), ("code_patterns:\n  go: [1]\n", "code_patterns go: 1"), ("- a\n", "no sections"), ("a: [", "no YAML"),
    ):
        path.write_text(text)
        with pytest.raises(ValueError, match=said):
            load_rules(str(path))


def test_long_lists_give_the_same_and_move_few_files(spark, files, monkeypatch):
    corpus = files({f"d{i % 7}/f{i}.ini": f"password=pw{i}\n" for i in range(120)})
    listed = spark.createDataFrame([("d3",), ("d1/f1.ini",), ("d1/f8.ini",), ("gone",)], "path string")
    manifest = spark.createDataFrame([(f"d{i % 7}/f{i}.ini", "old" if i % 9 == 0 else "now") for i in range(100)], "path string, hash string")
    hashed = corpus.selectExpr("*", "'now' as hash")
    ignores = scan_findings(corpus, mask_context()).where("octet_length(value) = 3").selectExpr("path as file", "key", "rule", "sha2(value, 256) as value_hash")

    def results():
        excluded = {r.path for r in paths.exclude(corpus, listed).collect()}
        changed = {(r.path, r.text) for r in paths.only_changed(hashed, manifest).collect()}
        attached = {(r.path, str(sorted((r.ignores or {}).items())), r.text) for r in ignore_ops.attach(corpus, ignores).collect()}
        readable = {r.file for r in staging.unredacted_by_ignores(corpus, ignores, mask_context()).collect()}
        return excluded, changed, attached, readable

    short = results()
    assert len(short[0]) == 120 - 17 - 2 and len(short[1]) == 12 + 20 and len(short[3]) == 10
    monkeypatch.setattr(paths, "BROADCAST_PATHS", 0)
    monkeypatch.setattr(paths, "MAP_BITS", 1 << 14)
    assert results() == short
    near = []
    real = type(corpus).where
    monkeypatch.setattr(type(corpus), "where", lambda self, test: near.append(real(self, test)) or near[-1])
    paths.join_listed(corpus, manifest.where("hash = 'old'").select("path"), "left_semi", "x").count()
    assert near[0].count() <= 14  # 12 listed files, and what else has their bit


@pytest.mark.parametrize("limit", [500_000, 0])
def test_ignores_meet_paths_before_content_is_read(spark, tree, monkeypatch, limit):
    """No exchange of a scan carries content, however long the list is."""
    monkeypatch.setattr(paths, "BROADCAST_PATHS", limit)
    monkeypatch.setattr(paths, "MAP_BITS", 1 << 14)
    monkeypatch.setattr(parts, "PART_BYTES", 14)
    plans = []
    monkeypatch.setattr(staging, "materialize", lambda df, label, real=staging.materialize: plans.append((label, df._jdf.queryExecution().toString())) or real(df, label))
    sha = hashlib.sha256
    ignores = spark.createDataFrame([("app.ini", "password", "key_name_match", sha(b"one").hexdigest()), (".env", "password", "key_name_match", "other")], "file string, key string, rule string, value_hash string")
    done = scan_project(spark, str(tree / "in"), str(tree / "out"), mask_context(), ignores=ignores, tree=str(tree / "copy"))
    assert (tree / "copy" / "app.ini").read_text() == "password=one\nhost=***REDACTED***\n"
    assert [r.changed for r in done.sanitized.findings.where("path = '.env'").collect()] == [True]
    plan = dict(plans)["scanned"].split("== Physical Plan ==")[1]
    above = plan.split("Exchange")[0]
    assert "content" in above and not any("content" in part.split("\n")[0] for part in plan.split("Exchange")[1:])
