"""Many values in one text."""

import random
import time

from maskwright.operators import accuracy as acc
from maskwright.operators.occurrences import Search, occurrences


def plain(values, text):
    out = set()
    for v in values:
        starts = [i for i in range(len(text)) if text.startswith(v, i)]
        if starts:
            lines = list(dict.fromkeys(text.count("\n", 0, i) + 1 for i in starts))
            out.add((v, text.count(v), lines[0], lines[1] if len(lines) > 1 else None))
    return out


def test_equals_plain_counts():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("ab\né") for _ in range(rng.randrange(0, 200)))
        values = sorted({"".join(rng.choice("ab\né") for _ in range(rng.randrange(1, 5))) for _ in range(12)})
        assert {(values[i], *x) for i, *x in Search(values).run(text)} == plain(values, text)


def test_ten_thousand_values_in_ten_megabytes(spark):
    rng = random.Random(2)
    values = [f"{rng.getrandbits(64):016x}" for _ in range(10_000)]
    lines = [" ".join(f"{rng.getrandbits(64):016x}" for _ in range(6)) for _ in range(100_000)]
    for i, v in enumerate(values[:5000]):
        lines[i * 19] += " " + v
    text = "\n".join(lines)
    assert len(text) > 10_000_000
    asked = spark.createDataFrame([("f", v) for v in values] + [("g", "x")], "file string, value string")
    texts = spark.createDataFrame([("f", 0, text), ("g", 0, "no"), ("other", 0, text[:100])], "file string, side int, text string")
    start = time.time()
    found = {r.value: (r.n, r.first_line) for r in occurrences(asked, texts).collect()}
    assert time.time() - start < 20
    assert found == {v: (1, i * 19 + 1) for i, v in enumerate(values[:5000])}


def test_a_leak_on_another_line_counts_and_on_the_own_verified_line_does_not(spark):
    outcomes = spark.createDataFrame(
        [("a", 1, "valuevalue", "key valuevalue ***", "TP"), ("b", 1, "valuevalue", "key valuevalue ***", "TP"), ("c", 1, "valuevalue", None, "TP"), ("d", 9, "valuevalue", None, "TP"), ("e", 1, "short", None, "TP")],
        "file string, line int, original_value string, expected_output_line string, outcome string",
    )
    findings = outcomes.selectExpr("file", "line", "original_value as value")
    texts = [("a", "key valuevalue ***\nnext"), ("b", "key valuevalue ***\nvaluevalue"), ("c", "x valuevalue\n"), ("d", "none\n"), ("e", "short")]
    done = {r.file: (r.span_ok, r.leaked) for r in acc.leaks_mask(outcomes, findings, spark.createDataFrame(texts, "file string, text string")).collect()}
    assert done == {"a": (True, False), "b": (True, True), "c": (False, True), "d": (True, False), "e": (False, False)}
