import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from maskwright.llm import language
from maskwright.llm.pieces import VOCABULARY

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")
SYLLABLES = {"en": "th er on an the ing and ed".split(), "fr": "é eau ou ai le qu eux oi".split(), "de": "sch ung ein ß ü ach ie st".split()}


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(VOCABULARY)


def every(word, pieces):
    """All segmentations, as lists of piece numbers; a letter without a piece is its bytes."""
    if not word:
        return [[]]
    ways = [[pieces.number[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces.number for rest in every(word[n:], pieces)]
    if word[0] not in pieces.number:
        ways += [[*pieces.spelled(word[0]), *rest] for rest in every(word[1:], pieces)]
    return ways


def test_forward_and_expected_equal_enumeration(pieces):
    rng = np.random.default_rng(0)
    table = rng.random((pieces.size, 2)) / 1000
    words = sorted(["the", "then", "thing", "", "schung", "été", "aaa", "ᚠ", "aᚠb", "ᚠᚢ"])
    logs = language.forward(words, pieces, np.log(table))
    for word, row in zip(words, logs):
        ways = every("▁" + word, pieces)
        for k in range(2):
            weights = [np.prod(table[w, k]) for w in ways]
            assert row[k] == pytest.approx(np.log(sum(weights)))
            uses = language.expected(word, pieces, np.log(table[:, k]).tolist())
            for piece, x in uses.items():
                assert x == pytest.approx(sum(p * w.count(piece) for p, w in zip(weights, ways)) / sum(weights))
    assert language.forward([], pieces, np.log(table)).shape == (0, 2)


def plain_score(text, pieces, probability, languages):
    """(language, score) of a text, letter by letter, in a plain way."""
    total = np.zeros(len(languages))
    for word in language.words(text):
        word = "▁" + word
        sums = [np.zeros(len(languages))]
        for j in range(1, len(word) + 1):
            paths = [sums[i] + np.log(probability[pieces.number[word[i:j]]]) for i in range(max(0, j - 20), j) if word[i:j] in pieces.number]
            if word[j - 1] not in pieces.number:
                paths.append(sums[j - 1] + np.log(probability[pieces.spelled(word[j - 1])]).sum(axis=0))
            sums.append(np.logaddexp.reduce(paths, axis=0))
        total += sums[-1]
    return languages[int(total.argmax())], float(np.exp(total.max() - np.logaddexp.reduce(total)))


def test_the_query_equals_a_plain_computation(spark):
    """All columns, on the documents of the smallest tables."""
    from maskwright.llm import queries

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    docs = {r.doc_id: r for r in queries.table(spark, folder, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    learned = [(r.doc_id, r.text, r.lang) for i, r in docs.items() if not held[i] and r.lang and r.text]
    model = language.learn(spark.createDataFrame(learned, "doc_id bigint, text string, lang string"))
    pieces = language.Pieces(VOCABULARY)
    found = queries.QUERIES["op8_language"](spark, folder).collect()
    assert len(found) == len(docs)
    for r in found:
        want = plain_score(docs[r.doc_id].text, pieces, model.probability, model.languages) if language.words(docs[r.doc_id].text) else ("und", 0.0)
        assert r.held_out == held[r.doc_id] and r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6


def test_scripts_without_pieces_are_told_apart(spark, pieces):
    rng = random.Random(2)
    letters = [chr(0x16A0 + i) for i in range(64)]
    assert all(x not in pieces.number for x in letters)
    rows = [(i, " ".join("".join(rng.choices(letters[32 * (i % 2) : 32 * (i % 2) + 32], k=6)) for _ in range(30)), "ab"[i % 2]) for i in range(60)]
    model = language.learn(spark.createDataFrame(rows[:40], "doc_id bigint, text string, lang string"))
    found = {r.doc_id: r for r in language.predicted(spark.createDataFrame([r[:2] for r in rows[40:]], "doc_id bigint, text string"), model).collect()}
    assert all(found[i].lang_pred == lang and found[i].score > 0.99 for i, _, lang in rows[40:])


def test_ties_clashing_columns_and_repeated_rows(spark, table, odd_rows):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["zz", "aa", "mm"])]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    found = language.predicted(table([*odd_rows, (20, "same words"), (20, "same words")]), model).collect()
    assert len(found) == len(odd_rows) + 2
    assert {(r.lang_pred, round(r.score, 9)) for r in found} == {("aa", round(1 / 3, 9)), ("und", 0.0)}


def test_one_very_long_word(spark, pieces):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["th", "er", "ing"] if i % 2 else ["sch", "ung", "ein"]) for _ in range(20_000)), "en" if i % 2 else "de") for i in range(4)]
    short = [(10 + i, t[:300], lang) for i, t, lang in rows]
    model = language.learn(spark.createDataFrame(short, "doc_id bigint, text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in language.predicted(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), model).collect()}
    assert found == {i: lang for i, _, lang in rows}


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(25)), lang))
    labelled = spark.createDataFrame(rows[:160], "doc_id bigint, text string, lang string")
    model = language.learn(labelled, sample_per_language=30)
    assert model.languages == ["de", "en", "fr"] and model.probability.sum(axis=0) == pytest.approx([1, 1, 1])
    rest = spark.createDataFrame([(r[0], r[1], "wrong") for r in rows[160:]], "doc_id bigint, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(rest, model).collect()}
    assert sum(found[i][0] == lang for i, _, lang in rows[160:]) >= 78
    odd = [(None, "the thing and then"), (1, None), (2, ""), (3, "12 34 !?"), (4, "é" * 5000), (5, "的" * 100), (1, "the the")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predicted(spark.createDataFrame(odd, "doc_id bigint, text string"), model).collect()]
    assert len(got) == len(odd) and all(0 <= s <= 1 for *_, s in got)
    assert [(i, lang) for i, lang, _ in got if lang == "und"] == [(1, None or "und"), (2, "und"), (3, "und")]
    assert language.predicted(rest.limit(0), model).count() == 0


def test_learning_does_not_depend_on_partitions_and_nothing_to_learn(spark):
    rows = [(i, " ".join(SYLLABLES["en" if i % 2 else "de"]), "en" if i % 2 else "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    a, b = language.learn(df.repartition(1)), language.learn(df.repartition(5))
    assert (a.probability == b.probability).all()
    none = language.learn(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predicted(df, none).collect()} == {("und", 0.0)}
