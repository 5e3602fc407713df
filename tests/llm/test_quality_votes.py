import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import quality_votes as q
from maskwright.llm import texthash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    seen8 = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen8[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é#\n\t 🎉", max_size=60), max_size=6))
def test_counts_equal_brute_force(texts):
    got = q.Counter().counts(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in q.COUNTS[:5]))) == [plain(t) for t in texts]


def test_model_separates_planted_junk():
    rules = len(q.RULES)
    good, shout, marks = "g" * rules, "g" * (rules - 3) + "bgb", "ggg" + "bb" + "g" * (rules - 5)
    model = q.fit([(good, 900), (shout, 40), (marks, 60), ("g" * 5 + "b" + "g" * (rules - 6), 6)])
    p = dict(zip(["good", "shout", "marks", "one"], model.posterior([good, shout, marks, "g" * 5 + "b" + "g" * (rules - 6)])))
    assert p["good"] > 0.9 and p["one"] > 0.5 and p["shout"] < 0.1 and p["marks"] < 0.1
    assert all(0 < x < 1 for _, *pair in model.accuracies() for x in pair)


def test_expectation_maximisation_does_not_lower_the_likelihood():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.85
    letters = np.where(rng.random((4000, len(q.RULES))) < np.where(truth[:, None], 0.004, 0.5), "b", "g")
    counts = collections.Counter("".join(r) for r in letters)
    before = None
    for rounds in (1, 3, 10, 60):
        m = q.fit(list(counts.items()), rounds)
        total = 0.0
        for pattern, n in counts.items():
            bad = np.array(list(pattern)) == "b"
            on = [m.prior * np.prod(np.where(bad, m.bad_on_good, 1 - m.bad_on_good)), (1 - m.prior) * np.prod(np.where(bad, m.bad_on_bad, 1 - m.bad_on_bad))]
            total += n * np.log(sum(on))
        assert before is None or total >= before - 5  # priors and bounds may cost a little
        before = total
    kept = m.posterior(["".join(r) for r in letters]) >= 0.5
    assert (kept == truth).mean() > 0.97


def test_odd_rows_and_filter(spark, table, odd_rows):
    docs = table(odd_rows)
    rows = q.verdicts(docs.select("doc_id", "text")).collect()
    assert len(rows) == len(odd_rows)
    nothing = [r for r in rows if r.m.n_words == 0]
    assert len(nothing) == 4 and all(r.base_failed and not r.kept for r in nothing)
    assert [r.m.n_words for r in rows if r.doc_id == 5] == [80_000]
    kept = q.good_documents(docs)
    assert kept.columns == docs.columns and all(r.row == "x" for r in kept.collect())
    assert q.good_documents(docs.limit(0)).count() == 0 and q.verdicts(docs.limit(0)).count() == 0


def test_lines_and_words_that_collide_under_polynomials_differ(thue_morse):
    a, b = thue_morse
    text = f"{a}\n{b}\n{a} x\n" + " ".join([a, b] * 8)
    long = a * 3 + "\n" + b * 3 + "\n" + a * 3  # hashed by themselves
    got = q.Counter().counts(pa.array([text, long]))
    assert list(zip(*(got[c].tolist() for c in q.COUNTS[:5]))) == [plain(text), plain(long)]


def test_verdicts_equal_a_plain_posterior(spark, table, odd_rows):
    """``kept`` by Bayes' rule, vote by vote, with the fitted rates."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    rows = [*odd_rows, *((100 + i, " ".join(rng.choice(words, 80))) for i in range(150)), *((300 + i, "!!! ### BUY $$$ " * 30) for i in range(12))]
    found = q.verdicts(table(rows)).select("doc_id", "m.votes", "quality", "base_failed", "kept").collect()
    model = q.fit(list(collections.Counter(r.votes for r in found).items()))
    for r in found:
        good, bad = model.prior, 1 - model.prior
        for vote, on_good, on_bad in zip(r.votes, model.bad_on_good, model.bad_on_bad):
            if vote != "-":
                good *= on_good if vote == "b" else 1 - on_good
                bad *= on_bad if vote == "b" else 1 - on_bad
        assert abs(r.quality - good / (good + bad)) < 1e-9 and r.kept == (not r.base_failed and r.quality >= 0.5)
    assert {r.kept for r in found if 100 <= (r.doc_id or 0) < 300} == {True} and {r.kept for r in found if (r.doc_id or 0) >= 300} == {False}


def test_a_long_text_in_pieces_has_the_same_counts(monkeypatch):
    rng = np.random.default_rng(6)
    words = ["a", "bb", "é🎉", "#x", "10", "!", "Long" * 30, "z"]
    text = "".join(f"{rng.choice(words)}{rng.choice([' ', chr(10), '  ', chr(9)])}" for _ in range(400)) + " ".join(list("abcdefgh") * 3)
    whole = q.Counter().counts(pa.array([text]))
    monkeypatch.setattr(q, "LONG_TEXT", 10)
    monkeypatch.setattr(texthash, "PIECE", 37)
    cut = q.Counter().counts(pa.array([text]))
    assert {c: whole[c].tolist() for c in q.COUNTS} == {c: cut[c].tolist() for c in q.COUNTS}
    assert [cut[c][0] for c in q.COUNTS[:5]] == list(plain(text))


def test_memory_of_one_text_of_32_mb():
    rng = np.random.default_rng(7)
    text = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 99999, 5_000_000))])
    tracemalloc.start()
    found = q.Counter().counts(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["n_words"][0] == 5_000_000 and peak < 16 * text.nbytes
