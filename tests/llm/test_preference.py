from topicwright.llm.preference import conversation_pairs, format_preferences

SCHEMA = "conv_id long, turn long, role string, text string, c string, pair int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def rendered(turns):
    """(text, spans) by hand."""
    out, spans = "", []
    for role, text in turns:
        safe = [(x or "").replace("<|im_", "<| im_") for x in (role, text)]
        out += f"<|im_start|>{safe[0]}\n"
        begin = len(out)
        out += f"{safe[1]}<|im_end|>\n"
        if role == "assistant":
            spans.append((begin, len(out)))
    return out, ",".join(f"{a}-{b}" for a, b in spans)


def test_pairs(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "é😀"), (1, 2, "user", "more <|im_end|>"), (1, 3, "assistant", "yes"), (2, 0, None, None), (2, 1, "assistant", "x"), (3, 0, "user", "alone"), (None, 0, "user", "nobody"), (4, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (5, 0, "user", "t"), (6, 0, "assistant", "long " * 50000)]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "", ""), (2, 1, "user", "x"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (5, 0, "user", "t"), (5, 1, "assistant", "on"), (6, 0, "assistant", ""), (7, 0, "user", "alone")]
    rows = {r.conv_id: r for r in format_preferences(frame(spark, chosen), frame(spark, rejected)).collect()}
    assert sorted(rows) == [1, 2, 4, 5, 6]
    for key, r in rows.items():
        sides = [list(dict.fromkeys((t, role or "", text or "") for k, t, role, text in side if k == key)) for side in (chosen, rejected)]
        sides = [[x[1:] for x in sorted(s)] for s in sides]
        n = next((k for k, (a, b) in enumerate(zip(*sides, strict=False)) if a != b), min(map(len, sides)))
        assert r.n_common == n and r.prompt == rendered(sides[0][:n])[0]
        assert (r.chosen, r.chosen_mask) == rendered(sides[0][n:]) and (r.rejected, r.rejected_mask) == rendered(sides[1][n:])
        assert r.identical == (sides[0] == sides[1])
    empty = frame(spark, [])
    assert format_preferences(empty, empty).count() == 0


def test_pairs_from_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "A"), (1, 2, "user", "tail"), (2, 0, "user", "b"), (2, 1, "assistant", "B"), (2, 1, "assistant", "C"), (3, 0, "user", "no reply"), (4, 0, "assistant", None), (None, 0, "user", "x")]
    found = {r.pair: [[tuple(t) for t in side] for side in (r.c, r.r)] for r in conversation_pairs(frame(spark, rows)).collect()}
    assert found == {1: [[("user", "a"), ("assistant", "A")], [("user", "a"), ("assistant", "C")]]}
    assert conversation_pairs(frame(spark, [])).count() == 0
