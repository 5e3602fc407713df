import random
from pathlib import Path

import pytest

from maskwright.llm import pieces as p

pytestmark = pytest.mark.skipif(not Path(p.VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return p.load_vocabulary()


def score(ids, v):
    own = {i: s for i, s in v.scored.values()}
    return sum(own.get(i, 0.0) for i in ids)


def test_equals_the_library_on_the_same_scores(vocabulary):
    """The same vocabulary as a unigram model of the public library.  Ties of equal
    score may be cut differently."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb2.ModelProto()
    model.ParseFromString(Path(p.VOCABULARY).read_bytes())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if vocabulary.kinds[i] == "normal":
            piece.score = vocabulary.scored[piece.piece][1]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(3)
    words = "the of tion where Haus straße été  déjà 你好 naïve 3.14 %%% x=y;\n\t über under".split(" ")
    texts = [" ".join(rng.choice(words) + rng.choice(["", "s", "ing", ".", "tion"]) for _ in range(30)) for _ in range(60)]
    encoder = p.Encoder(vocabulary)
    same = 0
    for text, ids in zip(texts, encoder.encode(texts).to_pylist()):
        want = library.encode(text)
        same += want == ids
        assert want == ids or abs(score(want, vocabulary) - score(ids, vocabulary)) < 1e-3
    assert same > 50


def test_shared_prefixes_change_nothing(vocabulary):
    """One word at a time and all words in trie order give the same pieces."""
    rng = random.Random(5)
    words = sorted({"▁" + "".join(rng.choice("abcdeéのx▁") for _ in range(rng.randrange(0, 9))).lstrip("▁") for _ in range(600)})
    together = p.encode_sorted(words, vocabulary)
    assert together == {w: p.encode_sorted([w], vocabulary)[w] for w in words}


def test_best_of_all_segmentations():
    v = p.Vocabulary(["<s>", "<0x62>", *"▁ac", "aa", "▁a", "aaa", "aac", "ca"], ["control", "byte", *["normal"] * 8])
    v.scored = {x: (i, s) for x, (i, _), s in zip(v.scored, v.scored.values(), [-1.0, -2.0, -2.5, -2.2, -1.5, -4.0, -3.1, -3.0])}
    v.ends.update(v.scored)

    def every(word):
        if not word:
            return [[]]
        out = [[v.bytes[0x62], *rest] for rest in every(word[1:])] if word[0] == "b" else []
        return out + [[v.scored[word[:n]][0], *rest] for n in range(1, 4) if word[:n] in v.scored for rest in every(word[n:])]

    total = lambda ids: sum({i: s for i, s in v.scored.values()}.get(i, v.byte_score) for i in ids)
    words = sorted("▁" + w for w in ("aaca", "acaac", "baab", "aaaaaac", "", "caca"))
    for word, ids in p.encode_sorted(words, v).items():
        assert total(ids) == pytest.approx(max(map(total, every(word))))


def test_round_trip_of_odd_rows(spark, table, odd_rows):
    docs = table([*odd_rows, (10, "  two  spaces \n\r\tand\x00 control "), (11, "🎉🏳️‍🌈 \u2028 ﷽"), (12, " "), (13, "a" * 5000)])
    done = p.decoded(p.encoded(docs)).collect()
    assert len(done) == docs.count()
    assert all(r.decoded == (r.row.text or "") and r.row.row == "x" for r in done)
    assert all(not r.pieces for r in done if not r.row.text)
    assert p.decoded(p.encoded(docs.limit(0))).count() == 0


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    want = p.Encoder(vocabulary).encode(texts).to_pylist()
    monkeypatch.setattr(p, "REMEMBERED", 10)
    encoder = p.Encoder(vocabulary)
    assert [encoder.encode([t]).to_pylist()[0] for t in texts] == want


def test_memory_is_linear_in_the_length_of_a_word(vocabulary):
    """Text without a space is one word: a million characters of mixed text."""
    import tracemalloc

    rng = random.Random(9)
    kinds = ["你好世界日本語テキスト", "QUJDREVGR0g0NTY3+/=", '{"key":[1,2],"id":null}', "name\nother\tvalue\n", "🎉é\x00ﷺ"]
    word = "".join(rng.choice(kinds) for _ in range(80_000))[:1_000_000]
    assert len(word) > 900_000 and " " not in word
    short = word[:20_000]
    p.Encoder(vocabulary).encode([short])
    tracemalloc.start()
    try:
        p.Encoder(vocabulary).encode([short])
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()
    ids = p.Encoder(vocabulary).encode([word])
    assert p.decode_texts(ids, vocabulary) == [word]


def test_long_words_are_not_all_remembered(vocabulary, monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED_PIECES", 5_000)
    encoder = p.Encoder(vocabulary)
    for i in range(8):
        encoder.encode([f"{i}你x" * 1_000])
    assert len(encoder.ids) < 20_000
