"""Detectors that look at one line."""

import random
import re

from maskwright import fixed_values as fv
from maskwright.operators.code import detect_code_lines
from maskwright.operators.config import detect_config
from maskwright.operators.hits import findings, mask_context, token_context
from maskwright.operators.shapes import detect_fallback, detect_shapes
from maskwright.rules import RuleSet, ValueRule, default_rules

MASK = fv.MASK

CONFIG = [
    # path, line, masked line (None: untouched), rule
    ("a.properties", "db.password=pw-1234", f"db.password={MASK}", "key_name_match"),
    ("a.json", '  "apiKey": "abcd",', f'  "apiKey": "{MASK}",', "key_name_match"),
    ("a.xml", "  <password>abc</password>", f"  <password>{MASK}</password>", "key_name_match"),
    ("a.xml", "  <password>abc</other>", None, None),
    ("a.config", '<add key="ConnectionString" value="Server=h"/>', f'<add key="ConnectionString" value="{MASK}"/>', "key_name_match"),
    ("a.yaml", "token: changeme", f'token: "{MASK}"', "key_name_match"),
    ("a.yaml", "note: changeme", None, None),
    ("a.yaml", "note: 'CHANGEME'", None, None),
    ("a.yml", "password: |-", None, None),
    ("a.yml", "password: 'x y'", f"password: '{MASK}'", "key_name_match"),
    ("a.json", '"auth": {', None, None),
    ("a.ini", "seed=0123456789abcdef0123456789abcdef", f"seed={MASK}", "high_entropy"),
    ("a.ini", "image=community_platform/service:latest-build", None, None),
    ("a.ini", "author=Jane", None, None),
    ("a.ini", "password1=abc", None, None),
    ("a.ini", "apiKeyBackup=abc", None, None),
    ("a.ini", "secret_key=secret", f"secret_key={MASK}", "key_name_match"),
    ("a.ini", "site=10.20.30.40", f"site={MASK}", "ipv4_address"),
    ("a.ini", "site=127.0.0.1", None, None),
    ("a.ini", "empty_token=   ", None, None),
    ("a.ini", "# see 10.20.30.40", f"# see {MASK}", "ipv4_address"),
    ("a.ini", "h=Bearer YOUR_BEARER_TOKEN_HERE", None, None),
    ("a.ini", "http://x.y/z", None, None),  # reads as key `http`
    ("a.ini", "password=x\x01y\x02z", f"password={MASK}", "key_name_match"),
    (".env", "export X=mail me@example.org", f"export X=mail {MASK}", "email_address"),
]


def test_config_lines(lines, scanned):
    got = scanned(detect_config(lines([(p, x) for p, x, _, _ in CONFIG]), mask_context()))
    for (_, line, out, rule), (new, hits) in zip(CONFIG, got):
        assert new == (line if out is None else out), line
        assert [h.rule for h in hits] == ([] if rule is None else [rule]), line


def test_config_tokens_are_escaped_only_in_xml_and_equal_across_quotes(lines, scanned):
    got = scanned(detect_config(lines([
        ("a.xml", "<password>v1</password>"), ("a.ini", "password='v1'"), ("b.ini", 'password="v1"'), ("b.ini", "password=v2"),
    ]), token_context()))
    marks = [re.findall(r"PASSWORD_(\d{40})", out) for out, _ in got]
    assert got[0][0].startswith("<password>&lt;PASSWORD_") and got[0][0].endswith("&gt;</password>")
    assert got[1][0].startswith("password='<PASSWORD_") and got[2][0].startswith('password="<PASSWORD_')
    assert marks[0] == marks[1] == marks[2] != marks[3]


CODE = [
    ("a.java", 'String apiKey = "x1";', "x1", "GENERIC_SECRET"),
    ("a.java", 'String author = "x0"; final String token="y9";', "y9", "ACCESS_TOKEN"),
    ("a.java", 'String apiKey = "";', None, None),
    ("b.py", "api_key = 'x8'; monkey = 'y'", "x8", "GENERIC_SECRET"),
    ("b.py", 'x = os.getenv("DB_PASSWORD", "zz")', "zz", "PASSWORD"),
    ("b.py", "password = 'changeme'", "changeme", "PASSWORD"),
    ("c.ts", "const authToken: string | undefined = `abc`;", "abc", "ACCESS_TOKEN"),
    ("d.go", 'secretKey := "s7"', "s7", "GENERIC_SECRET"),
    ("e.cs", 'var clientSecret = "q";', "q", "GENERIC_SECRET"),
    ("f.dart", "String? clientSecret = 'aa-1';", "aa-1", "GENERIC_SECRET"),
    ("f.dart", "static const authToken = r'raw$T-1';", "raw$T-1", "ACCESS_TOKEN"),
    ("f.dart", 'final dbToken = "it\'s mixed";', "it's mixed", "ACCESS_TOKEN"),
    ("f.dart", "Client(timeout: 5, password: r'u1')", "u1", "PASSWORD"),
    ("f.dart", "final m = {'client_secret': 'w3'};", "w3", "GENERIC_SECRET"),
    ("f.dart", "final token = '${a}$b';", None, None),
    ("f.dart", "final keyboardType = 'text';", None, None),
    ("f.dart", "final t = loggedIn ? token : 'guest';", None, None),
    ("f.dart", "final apiKey = '''triple''';", None, None),
    ("f.dart", "if (token == 'abc') {}", None, None),
    ("a.java", 'String q = "\x01"; String token = "a\x02b";', "a\x02b", "ACCESS_TOKEN"),
    ("a.java", f'foo("{MASK} 10.1.2.3")', None, None),
]


def test_code_lines(lines, scanned):
    got = scanned(detect_code_lines(lines([(p, x) for p, x, _, _ in CODE]), mask_context()))
    for (_, line, value, category), (out, hits) in zip(CODE, got):
        assert [(h.value, h.category) for h in hits] == ([] if value is None else [(value, category)]), line
        assert out == (line if value is None else line.replace(value, MASK)), line


def python_fold(line, names=None):
    """The value rules written with Python's own regular expressions."""
    hits = []
    for name, pattern, _ in fv.VALUE_RULES:
        if names is not None and name not in names:
            continue
        rx = re.compile(pattern, re.IGNORECASE)
        m = rx.search(line)
        if not m:
            continue
        checked = m.group(m.lastindex) if m.lastindex else m.group(0)
        if checked.strip().strip('"').strip("'").lower() in fv.ALLOWLIST:
            continue
        hits.append((name, m.group(0)))
        line = rx.sub(MASK, line)
    return line, hits


def random_lines(n):
    rng = random.Random(7)
    pieces = [
        "10.2.3.4", "127.0.0.1", "1.2.3", "fe80:12:0:1", "a:b", "https://h.example.org/a", "ftp://u:p@h.example.org", "mongodb+srv://x/y",
        "u@mail.example.org", "é@x.org", "AKIA" + "ABCDEFGH12345678", "akia" + "abcdefgh12345678", "AKIA" + "ABCDEFGH12345678", "gh" + "p_" + "a" * 36,
        "xo" + "xb-" + "1234567890ab", "eyJ" + "a.b_c.d", "Bearer " + "a" * 24, "bearer YOUR_BEARER_TOKEN_HERE", "BEARER " + "z" * 22,
        'aws_secret_access_key = "' + "A" * 40 + '"', "-----BEGIN PRIVATE KEY-----ab-----END PRIVATE KEY-----", "é", "ß1", "plain", "x_y", "-", "\t", "٣.٣.٣.٣",
    ]
    return ["".join(rng.choice(pieces) + rng.choice(["", " ", ", ", "é", "'"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_shapes_equal_python(lines):
    texts = random_lines(400)
    df = detect_shapes(lines([("x.txt", t) for t in texts]), mask_context())
    got = {r.line_no: (r.result.out, [(h.rule, h.value) for h in r.result.hits]) for r in df.collect()}
    for i, text in enumerate(texts):
        assert got.get(i, (text, [])) == python_fold(text), text


def test_fallback_equals_python_on_its_rules(lines):
    texts = random_lines(200)
    df = detect_fallback(lines([("x", t) for t in texts]), mask_context())
    got = {r.line_no: (r.result.out, [(h.rule, h.value) for h in r.result.hits]) for r in df.collect()}
    for i, text in enumerate(texts):
        out, hits = python_fold(text, fv.FALLBACK_RULES)
        assert got.get(i, (text, [])) == (out, [("fallback:" + n, v) for n, v in hits]), text


def test_dummy_first_match_shields_the_line(lines, scanned):
    got = scanned(detect_shapes(lines([("a", "127.0.0.1 then 10.0.0.4"), ("a", "10.0.0.4 then 127.0.0.1")]), mask_context()))
    assert got[0] == ("127.0.0.1 then 10.0.0.4", [])
    assert got[1][0] == f"{MASK} then {MASK}" and len(got[1][1]) == 1


def test_custom_rules_need_no_sign(lines):
    rules = RuleSet(keys=(), values=(ValueRule("ticket", r"TCK-\d{4}"),), allowlist=())
    df = findings(detect_shapes(lines([("a", "see tck-1234 and TCK-9999"), ("a", "TCK-12")]), mask_context(rules)), "line_no")
    assert [(r.rule, r.value, r.category) for r in df.collect()] == [("ticket", "tck-1234", "GENERIC_SECRET")]


def test_default_rules_have_known_categories():
    rules = default_rules()
    assert {r.category for r in rules.keys} | {r.category for r in rules.values} <= set(fv.CATEGORIES)
