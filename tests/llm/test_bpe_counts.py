"""Token counts against the public library."""

import random
import time

import pytest

from maskwright.llm import bpe_counts

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=bpe_counts.VOCABULARY)
    return lambda text: len(model.encode(text or ""))


@pytest.fixture(scope="module")
def merges():
    return bpe_counts.load_merges()


def test_counts_equal_the_library_on_random_texts(merges, library):
    rng = random.Random(1)
    alphabets = ["ab ", "the quick brown fox ", " \n\t▁x", "aaaa aaaaaaa ", "中文字符 日本語。", "é🎉 ñß\x00　", "0123456789abcdef", " " * 5 + "a\n"]
    for n in range(400):
        text = "".join(rng.choice(alphabets[n % len(alphabets)]) for _ in range(rng.randrange(1, 300)))
        assert merges.tokens(text) == library(text), text


def test_special_strings_and_odd_texts(merges, library):
    for text in ["", " ", "  ", "▁", "▁▁ ▁", "<s></s><unk><0x0A>", "\n\n\n", "a" * 5000, " " * 5000, "a ▁b", "x\r\ny", "​"]:
        assert merges.tokens(text) == library(text), text


def test_a_text_is_cut_in_pieces_without_loss(merges, library, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", "  ", "\n", "  x", "é", " a b"]) for _ in range(3000))
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(bpe_counts, "PIECE", piece)
        assert merges.tokens(text) == library(text)


def test_long_runs_without_spaces_take_linear_time(merges, library):
    rng = random.Random(3)
    mixed = "".join(rng.choice("中文字符日本語abcdef0123456789+/é") for _ in range(300_000))
    start = time.time()
    assert merges.tokens(mixed) == library(mixed)
    assert merges.tokens("ab" * 200_000) == library("ab" * 200_000)
    assert time.time() - start < 60


def test_rows(spark, table, odd_rows, library):
    docs = table([*odd_rows, (9, "x" * 3_000_000)])
    got = bpe_counts.token_counts(docs).select("row.doc_id", "row.row", "n_bytes", "n_tokens").collect()
    want = [(i, "x", len((t or "").encode()), library(t)) for i, t in [*odd_rows, (9, "x" * 3_000_000)]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe_counts.token_counts(docs.limit(0)).count() == 0
    assert bpe_counts.token_counts(docs.select("text")).columns == ["n_bytes", "n_tokens"]


def test_another_kind_of_model_is_refused(monkeypatch):
    monkeypatch.setattr(bpe_counts, "PROBES", ("a b",))
    monkeypatch.setattr(bpe_counts.Merges, "tokens", lambda self, text: -1)
    with pytest.raises(ValueError):
        bpe_counts.load_merges()
