"""Detectors that look at a whole text, and whole scans."""

import hashlib
import re
from dataclasses import replace
from pathlib import Path

import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from maskwright import fixed_values as fv
from maskwright.operators import ignores as ign
from maskwright.operators import paths
from maskwright.operators.hits import findings, mask_context, token_context
from maskwright.operators.paths import QUICK
from maskwright.plans import staging
from maskwright.plans.scan import scan, scan_findings
from maskwright.rules import default_rules
from maskwright.session import new_folder, shared_folder
from maskwright.sources.sinks import write_sanitized

MASK = fv.MASK
BEGIN, END = "-----BEGIN RSA PRIVATE" + " KEY-----", "-----END RSA PRIVATE" + " KEY-----"

TEXTS = {
    "a.py": "x=1\nAPI_SECRET = (\n    \"abcd\"\n    'efgh'\n)\ntok = (\n  'a'\n",
    "b.java": '  String authToken = "abc" +\n     "def";\n int n=1;\n',
    "b2.java": '  String authToken = "abc" +\n     "def"\n int n=1;\n',
    "c.go": 'apiKey := "ab" +\n  "cd"\nn := 1\n',
    "c2.go": 'var authKey cfg.T = "ab"\n  + "cd"\n  + "ef"\n',
    "c3.go": 'var note string = "ab" +\n  foo()\n',
    "d.ts": 'const plain = "hello" +\n  "world";\n',
    "k.pem": f"hi\n{BEGIN}\nabcd\nefgh\n{END}\ntail\n",
    "k2.pem": f"{BEGIN}\nProc-Type: 4\n\nab+/==\nnot key material.\n",
    "k3.txt": f"read about {BEGIN} here\n{BEGIN}\nprose follows here.\n",
    "k4.crt": "-----BEGIN CERTIFICATE-----\nabcd\n-----END CERTIFICATE-----\n",
    "k5": f'"{BEGIN}"\n\n\n"{END}"',
    "m.ini": "host=h1\nuser=joe\npassword=p1 p1\n",
    "e.xml": "<a>\n<password>p1 p1</password>\n</a>\n",
    "n.md": "see AKIA" + "ABCDEFGH12345678 and http://x.org/\n",
    "o.env": "mail=u@x.org\n",
    "z.png": "AKIA" + "ABCDEFGH12345678",
    "big.bin2": "x" * (fv.FALLBACK_MAX_BYTES + 1),
    "big.log": "x " * (fv.FALLBACK_MAX_BYTES // 2) + "AKIA" + "ABCDEFGH12345678",
    "zero.dat": "a\x00AKIA" + "ABCDEFGH12345678",
}


@pytest.fixture(scope="module")
def masked(files):
    return {r.path: r for r in scan(files(TEXTS), mask_context()).collect()}


def test_limits_are_an_option(files):
    quick = replace(mask_context(), limits=QUICK)
    rows = {r.path: r for r in scan(files({n: TEXTS[n] for n in ("big.bin2", "big.log", "n.md")}), quick).collect()}
    assert {p: r.reason for p, r in rows.items()} == {"big.bin2": "oversize", "big.log": "oversize", "n.md": None}
    assert bytes(rows["big.log"].content).decode() == TEXTS["big.log"]


@pytest.fixture(scope="module")
def tokenized(files):
    done = staging.sanitize(files(TEXTS), token_context())
    return {r.path: r.text for r in done.files.collect()}, done.findings.collect(), done.tokens.collect()


def test_masked_texts(masked):
    out = {p: r.result.out for p, r in masked.items()}
    assert out["a.py"] == f"x=1\nAPI_SECRET = (\n    \"{MASK}\"\n    '{MASK}'\n)\ntok = (\n  'a'\n"
    assert out["b.java"] == f'  String authToken = "{MASK}" +\n     "{MASK}";\n int n=1;\n'
    # no terminator: the chain is left, the line rule still sees the first literal
    assert out["b2.java"] == f'  String authToken = "{MASK}" +\n     "def"\n int n=1;\n'
    assert out["c.go"] == f'apiKey := "{MASK}" +\n  "{MASK}"\nn := 1\n'
    assert out["c2.go"] == f'var authKey cfg.T = "{MASK}"\n  + "{MASK}"\n  + "{MASK}"\n'
    assert out["d.ts"] == TEXTS["d.ts"]
    assert out["k.pem"] == f"hi\n{BEGIN}\n{MASK}\n\n{END}\ntail\n"
    assert out["k2.pem"] == f"{BEGIN}\n{MASK}\n\n\nnot key material.\n"
    for same in ("k3.txt", "k4.crt", "o.env", "z.png", "big.bin2", "zero.dat", "c3.go"):
        assert out[same] == TEXTS[same], same
    assert out["m.ini"] == f"host={MASK}\nuser=joe\npassword={MASK}\n"
    assert out["n.md"] == f"see {MASK} and http://x.org/\n"


def test_lines_and_reasons(masked):
    assert [(h.line, h.key, h.rule) for h in masked["a.py"].result.hits] == [
        (3, "API_SECRET", "multiline_concat_key_name_match"), (4, "API_SECRET", "multiline_concat_key_name_match"),
    ]
    assert [(h.line, h.rule) for h in masked["k.pem"].result.hits] == [(2, "fallback:private_key_block")]
    assert masked["k.pem"].result.hits[0].value == f"{BEGIN}\nabcd\nefgh\n{END}\n"
    assert [(h.line, h.rule) for h in masked["k5"].result.hits] == [(1, "fallback:private_key_block")]
    assert {p: r.reason for p, r in masked.items() if r.reason} == {"z.png": "binary", "zero.dat": "binary"}
    assert [h.rule for h in masked["big.log"].result.hits] == ["fallback:aws_access_key_id"]
    assert bytes(masked["zero.dat"].content).decode() == TEXTS["zero.dat"] and masked["n.md"].content is None
    for path, row in masked.items():
        assert row.result.out.count("\n") == TEXTS[path].count("\n"), path


def test_tokens_are_numbered_in_walk_order_and_shared(tokenized):
    texts, found, tokens = tokenized
    assert texts["m.ini"] == "host=<URL_1>\nuser=joe\npassword=<PASSWORD_1>\n"
    assert texts["e.xml"] == "<a>\n<password>&lt;PASSWORD_1&gt;</password>\n</a>\n"
    assert texts["a.py"].count("<GENERIC_SECRET_1>") == 1 and "''" in texts["a.py"]
    assert texts["k.pem"] == f"hi\n{BEGIN}\n<PRIVATE_KEY_1>\n\n{END}\ntail\n"
    assert texts["z.png"] == TEXTS["z.png"]
    for rows in (found, texts.values()):
        assert not re.search(r"_\d{40}", str(rows))
    numbers = {}
    for t in tokens:
        numbers.setdefault(t.category, []).append(t.n)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


def test_both_modes_find_the_same_places(masked, tokenized):
    one = sorted((p, h.line, h.rule) for p, r in masked.items() for h in r.result.hits)
    two = sorted((f.path, f.line, f.rule) for f in tokenized[1])
    assert one == two


def test_nested_values_get_one_token_in_either_order(files):
    texts = {f"d{i}/.env": f"go to http://10.0.0.{i}/x now\n" for i in (1, 2)} | {"e/.env": "go to http://10.0.0.1/x now\n"}
    done = staging.sanitize(files(texts), token_context())
    out = {r.path: r.text for r in done.files.collect()}
    # ipv4 first, then the URL around its token
    assert out == {"d1/.env": "go to <URL_2> now\n", "d2/.env": "go to <URL_4> now\n", "e/.env": "go to <URL_2> now\n"}
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    assert {(f.rule, f.value_hash) for f in done.findings.collect()} >= {("generic_url", sha("http://<URL_1>/x")), ("ipv4_address", sha("10.0.0.2"))}


def test_values_do_not_outlive_a_run(spark, files):
    """Not in sanitized files, previews, applied previews or anything else in the shared
    folder, however it is compressed."""
    value = "kq7Zp0vW3xYt9LmN"
    corpus = files({"a.ini": f"password={value}\n", "b.log": f"AKIA{value.upper()}\n"})
    none = spark.createDataFrame([], "file string, key string, rule string, value_hash string"), spark.createDataFrame([], "path string")
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.rglob("*.parquet"))
    for ctx in (token_context(), mask_context()):
        done = staging.sanitize(corpus, ctx)
        done.files.count(), done.findings.count()
        staged = staging.stage(spark, corpus, *none, ctx)
        staging.apply_stage(spark, staged, staging.state_of(*none, ctx), new_folder(spark, "applied"))
    new = set(root.rglob("*.parquet")) - before
    assert new
    for file in new:
        rows = str(pyarrow.parquet.read_table(file, partitioning=None).to_pylist())
        assert value not in rows and value.upper() not in rows, file


def test_many_values_on_one_line_get_their_own_tokens(files):
    done = staging.sanitize(files({".env": "a@x.org b@x.org a@x.org\n"}), token_context())
    assert done.files.first().text == "<GENERIC_SECRET_1> <GENERIC_SECRET_2> <GENERIC_SECRET_1>\n"
    assert done.findings.count() == 1


def test_ignores_suppress_flag_and_reveal(spark, files):
    texts = {"a.ini": "password=one\ntoken=two\nhost=three\n", "b.ini": "password=one\n"}
    corpus = files(texts)
    sha = lambda v: spark.sql(f"select sha2('{v}', 256)").first()[0]
    ignores = spark.createDataFrame(
        [("a.ini", "password", "key_name_match", sha("one")), ("a.ini", "token", "key_name_match", sha("old")),
         ("a.ini", "host", "key_name_match", None)],
        "file string, key string, rule string, value_hash string",
    )
    found = {(r.path, r.key): r.changed for r in findings(staging.scan_with_ignores(corpus, ignores, mask_context()), "path").collect()}
    assert found == {("a.ini", "token"): True, ("a.ini", "host"): True, ("b.ini", "password"): False}
    plain = scan_findings(corpus, mask_context()).withColumnRenamed("path", "file")
    after = {(r.file, r.key): r.changed for r in ign.apply_ignores(plain, ignores).collect()}
    assert after == found
    assert [tuple(r) for r in staging.unredacted_by_ignores(corpus, ignores, mask_context()).collect()] == [("a.ini", "password", "key_name_match")]


def test_stage_writes_nothing_apply_equals_scan_and_stale_is_refused(spark, files):
    corpus = files({"a.ini": "password=one\n", "b.md": "text\n"})
    none = spark.createDataFrame([], "file string, key string, rule string, value_hash string")
    excluded = spark.createDataFrame([], "path string")
    staged = staging.stage(spark, corpus, none, excluded, token_context(), input_root="/data/in")
    out = new_folder(spark, "t")
    fewer = token_context(replace(default_rules(), values=default_rules().values[1:]))
    for changed in (staging.state_of(none, excluded, fewer), staging.state_of(none, excluded, mask_context()), staging.state_of(none, excluded.union(spark.sql("select 'y'")), token_context())):
        with pytest.raises(RuntimeError):
            staging.apply_stage(spark, staged, changed, out)
    now = staging.state_of(none, excluded, token_context())
    for inside in ("/data/in/out", "file:/data/in", "/data/x/../in/out", "file:///data"):
        with pytest.raises(ValueError):
            staging.apply_stage(spark, staged, now, inside)
    staging.apply_stage(spark, staged, now, out)
    assert {r.path: r.text for r in spark.read.parquet(out).collect()} == {"a.ini": "password=<PASSWORD_1>\n", "b.md": "text\n"}


def test_a_preview_leaves_out_what_is_excluded(spark, files):
    corpus = files({"a.ini": "password=one\n", "d/b.ini": "password=two\n", "c.md": "t\n"})
    none = spark.createDataFrame([], "file string, key string, rule string, value_hash string")
    excluded = spark.createDataFrame([("d",), ("c.md",)], "path string")
    staged = staging.stage(spark, corpus, none, excluded, mask_context())
    assert [r.path for r in spark.read.parquet(staged.folder).collect()] == ["a.ini"]


def test_ignores_that_are_listed_twice(spark, files):
    corpus = files({"a.ini": "password=one\n"})
    row = ("a.ini", "password", "key_name_match", "old")
    ignores = spark.createDataFrame([row, row, (*row[:3], None)], "file string, key string, rule string, value_hash string")
    plain = scan_findings(corpus, mask_context()).withColumnRenamed("path", "file")
    assert [r.changed for r in ign.apply_ignores(plain, ignores).collect()] == [True]
    timed = spark.sql("select 'a.ini' as file, 'password' as key, 'key_name_match' as rule, x.h as value_hash, x.t as created_at"
                      " from values (sha2('one', 256), 2), ('zz', 1) as x(h, t)")
    assert ign.apply_ignores(plain, timed).count() == 0
    assert findings(staging.scan_with_ignores(corpus, timed, mask_context()), "path").count() == 0


def test_contents_take_no_part_in_joins_on_paths(spark, files):
    """No exchange holds text or content, also where Spark would not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        corpus = files({"a.ini": "password=one\n", "b.md": "t\n"}).withColumn("hash", F.sha2("content", 256))
        ignores = spark.createDataFrame([("a.ini", "password", "r", "h")], "file string, key string, rule string, value_hash string")
        names = spark.createDataFrame([("a.ini", "h")], "path string, hash string")
        for df in (paths.exclude(corpus, names.select("path")), paths.only_changed(corpus, names), ign.attach(corpus, ignores)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_output_must_not_touch_the_input(files):
    done = staging.sanitize(files({"a.ini": "x=1"}), mask_context()).files
    for out in ("/data/in/out", "/data"):
        with pytest.raises(ValueError):
            write_sanitized(done, out, "/data/in")


def test_mask_mode_is_one_pass_without_exchange(files):
    plan = staging.sanitize(files({"a.ini": "x=1"}), mask_context()).files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
