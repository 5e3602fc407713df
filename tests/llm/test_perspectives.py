from maskwright.llm import perspectives as v


def plain(turns):
    """(conv, perspective, part) to (text, masked text)."""
    out = {}
    safe = lambda x, d: (d if x is None else x).replace("<|", "< |")
    for conv in {t[0] for t in turns}:
        own = [(t[1], safe(t[2], "unknown"), safe(t[3], "")) for t in turns if t[0] == conv]
        for who in {s for _, s, _ in own} - {"system"}:
            for turn, speaker, said in sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
                part = -1 if turn is None else turn // v.TURNS
                head = "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == who else f"<|user name={speaker}|>\n"
                text, mask = out.get((conv, who, part), ("", ""))
                body = f"{said}\n{v.END}"
                out[conv, who, part] = text + head + body, mask + (body if speaker == who else "")
    return out


def test_equals_plain_rendering(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é🎉"), (1, 3, "ann", None), (1, 3, "bob", "tie"), (1, 3, "bob", "tie"),
             (1, 64, "cyd", "late"), (1, 200, "ann", "<|end|> trick"), (2, 0, "user", "alone"), (3, 0, "system", "only"), (4, None, None, "x"),
             (4, 1, "bob", "y"), (None, 0, "ann", "z"), (5, 0, "<|ann", "n"), (5, 1, "bob", "w" * 200_000), (5, 2, "", "")]
    df = spark.createDataFrame([(*t, "a", "b") for t in turns], "conv_id bigint, turn bigint, role string, text string, part string, perspective string")
    got = {(r.conv_id, r.perspective, r.part): (r.rendered, "".join(r.rendered[m.start : m.end] for m in r.mask)) for r in v.rotated(df).collect()}
    assert got == plain(turns)
    assert v.rotated(df.limit(0)).count() == 0


def test_a_long_conversation_is_cut_into_parts(spark):
    turns = [(7, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(1000)]
    found = v.rotated(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(found) == 2 * 16 and max(r.n_turns for r in found) == v.TURNS
    whole = "".join(r.rendered for r in sorted(found, key=lambda r: r.part) if r.perspective == "ann")
    assert whole.count("<|assistant|>") == 500 and [whole.index(f"\nt{i}\n") for i in (0, 63, 64, 999)] == sorted(whole.index(f"\nt{i}\n") for i in (0, 63, 64, 999))


def test_repeated_and_missing_turn_numbers_are_cut_into_pieces(spark):
    """Rows without a conversation are one conversation; numbers repeat or are missing."""
    turns = [(None, i % 64, "ann" if i % 3 else "bob", f"t{i}") for i in range(6000)]
    turns += [(8, None, "ann" if i % 3 else "bob", "equal" if i % 2 else f"u{i}") for i in range(5000)]
    turns += [(9, i, "ann", f"v{i}") for i in range(100)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    found = v.rotated(df).collect()
    assert max(r.n_turns for r in found) <= v.TURNS
    got = {}
    for r in sorted(found, key=lambda r: r.piece):
        text, mask = got.get((r.conv_id, r.perspective, r.part), ("", ""))
        got[r.conv_id, r.perspective, r.part] = (text + r.rendered, mask + "".join(r.rendered[m.start : m.end] for m in r.mask))
    assert got == plain(turns)


def test_parts_of_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(v, "MOST_BYTES", 1000)
    turns = [(1, i % 64, "ann", "x" * 20) for i in range(130)] + [(2, i, "ann", "y" * 100) for i in range(64)]
    found = v.rotated(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert max(r.n_turns for r in found) == v.TURNS and sum(r.n_turns for r in found) == 194
