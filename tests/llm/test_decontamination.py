import random

import numpy as np

from topicwright.llm import decontaminate as dec


def edit_distance_inside(window, text):
    """Least edits of window against any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(n))


def edited(r, text, n):
    c = list(text)
    for _ in range(n):
        p = r.randrange(len(c))
        c[p : p + 1] = r.choice(([], ["z"], [c[p], "y"]))
    return "".join(c)


def test_all_within_the_budget_and_none_beyond():
    r = random.Random(2)
    items = [(k, sentence(r, n)) for k, n in enumerate((8, 15, 30, 60, 7))]
    index = dec.Index.load(dec.Index.of(items, 0.08).save())
    texts = []
    for k in range(60):
        _, t = items[k % 5]
        texts.append(dec.normal(sentence(r, r.randrange(0, 40)) + " " + edited(r, t, r.randrange(0, len(t) // 8)) + " " + sentence(r, r.randrange(0, 30))))
    texts += ["", "short", dec.normal(items[0][1])]
    text, window, _, edits = dec.regions(index, texts)
    got = {(t, w): e for t, w, e in sorted(zip(text.tolist(), window.tolist(), edits.tolist(), strict=True), reverse=True)}
    for t, x in enumerate(texts):
        for w in range(len(index.size)):
            piece = "".join(map(chr, index.codes[index.start[w] :][: index.size[w]]))
            least = edit_distance_inside(piece, x) if x else len(piece)
            if least <= index.edits[w]:
                assert got.get((t, w)) is not None and least <= got[t, w] <= index.edits[w]
            else:
                assert (t, w) not in got


def test_items_that_share_much():
    items = [(k, "the same long beginning of every item in this benchmark, then " + sentence(random.Random(k), 9)) for k in range(40)]
    index = dec.Index.of(items, 0.08)
    assert (index.bound >= dec.LEAST).all() and len(index.places) == sum(len(t) - dec.Q + 1 for _, t in items)
    texts = [dec.normal("xx " + t + " yy") for _, t in items]
    text, window, _, _ = dec.regions(index, texts)
    item = index.items[np.searchsorted(index.own, window, "right") - 1]
    found = set(zip(text.tolist(), item.tolist(), strict=True))
    assert {(k, k) for k in range(40)} <= found


def test_text_that_repeats_itself(monkeypatch):
    item = "again and again " * 12
    index = dec.Index.of([(1, item), (2, sentence(random.Random(1), 30))], 0.08)
    texts = [dec.normal(item * 200), dec.normal("no " + item[:100]), "x"]
    whole = [x.tolist() for x in dec.regions(index, texts)]
    monkeypatch.setattr(dec, "HITS", 1000)
    assert [x.tolist() for x in dec.regions(index, texts)] == whole and set(whole[0]) == {0, 1}


def test_rows(spark):
    r = random.Random(3)
    items = [(1, sentence(r, 20)), (2, sentence(r, 60)), (2, "second row of item two " + sentence(r, 9)), (3, None), (4, ""), (5, "tiny"), (None, sentence(r, 9))]
    docs = [(1, "a " + items[0][1].upper() + " b"), (2, items[1][1][70:260]), (3, None), (4, ""), (5, "tiny"), (6, sentence(r, 5000) + items[0][1].replace(" ", " \n ") + sentence(r, 3000)), (7, sentence(r, 50)), (None, items[0][1]), (8, items[2][1]), (8, items[2][1]), (9, edited(r, items[0][1], 40))]
    df = spark.createDataFrame([(*d, 1, ["x"]) for d in docs], "doc_id long, text string, contaminated int, items array<string>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dec.contamination(df, bench).collect()
    found = {x.doc_id: (x.contaminated, x["items"]) for x in rows}
    assert len(rows) == len(docs)
    assert found[1] == (True, [1]) and found[2] == (True, [2]) and found[6] == (True, [1]) and found[None] == (True, [1]) and found[8] == (True, [2])
    assert all(found[k] == (False, []) for k in (3, 4, 5, 7, 9))
    kept = dec.clean_rows(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {3, 4, 5, 7, 9}
    assert dec.contamination(df.limit(0), bench).count() == 0 and dec.clean_rows(df, bench.limit(0)).count() == len(docs)


def test_quotes_at_all_offsets(spark):
    r = random.Random(6)
    items = [(k, dec.normal(sentence(r, n))) for k, n in enumerate((14, 30, 50, 90))]
    quotes = [(k, t[a : a + n]) for k, t in items for n in (60, 75, 100, 118, 140, 170) for a in range(0, len(t) - n + 1)]
    docs = [(k, f"{sentence(r, 8)} {q} {sentence(r, 8)}") for k, q in quotes]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = dec.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(docs) and all(x["items"] == [x.doc_id] for x in rows)
    none = spark.createDataFrame([(k, sentence(r, 60)) for k in range(50)], "doc_id long, text string")
    assert not any(x.contaminated for x in dec.contamination(none, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_short_items_stand_as_they_are(spark):
    items = [(1, "Quite short"), (2, "exactly8"), (3, "seven77"), (4, "a short item that is long enough"), (5, None), (1, "Quite short"), (1, "Quite short")]
    docs = [(1, "it is quite\n short, they say"), (2, "quite shirt"), (3, "not exactly8."), (4, "seven77"), (5, "a short item that is long enouh"), (6, "a short item that is")]
    rows = dec.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in rows} == {1: [1], 2: [], 3: [2], 4: [], 5: [4], 6: []}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_CHARS", 300)
    r = random.Random(4)
    items = [(k, sentence(r, 20)) for k in range(12)]
    df = spark.createDataFrame([(k, "before " + t + " after") for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(dec.write_index(bench, 0.08)[1]) > 1
    assert {x.doc_id: x["items"] for x in dec.contamination(df, bench).collect()} == {k: [k] for k, _ in items}


def test_banded_alignment():
    r = random.Random(5)
    window = sentence(r, 12)
    text = "..." + edited(r, window, 5) + "...."
    codes = np.frombuffer(window.encode("utf-32-le"), np.uint32)[:, None]
    width = 24
    padded = np.frombuffer((text + "\0" * (len(window) + width)).encode("utf-32-le"), np.uint32)[: len(window) + width, None]
    assert dec._least_edits(codes, np.array([len(window)]), padded, width)[0] == edit_distance_inside(window, text)
