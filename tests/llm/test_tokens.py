import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from topicwright.llm import dac, packing
from topicwright.llm.common import SharedFiles, new_folder
from topicwright.llm.token_counts import token_counts
from topicwright.llm.tokens import Encoder

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a  b", "a b ", "a  ", "x▁ y  ▁z\n\n q", "▁", "a▁", "\tA b <|endoftext|> x<|startoftext|>y <|STARTOFTEXT|>.", "it's we'LL é́x", "</s> <s>", "x.y!z. <|endoftext|>.", "K.Å. \"q\"", "日本 語😀", "a b c\r\n", "9a9.", "word" * 3000]


def library(path, text):
    if path == WORD:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


@pytest.mark.parametrize("path", [WORD, PIECE])
def test_encoder_is_the_librarys(path):
    encoder = Encoder.of(path)
    ids, n = encoder(pa.array([*ODD, None]))
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [library(path, t) for t in ODD] + [[]]
    assert encoder.lengths(pa.array(ODD)).tolist() == n[:-1].tolist()
    assert encoder.cut is not None


def documents(spark):
    texts = [*ODD, None, "a b c " * 3000, "same text", "same text"]
    return spark.createDataFrame([(100 - k, t, "clash", k) for k, t in enumerate(texts)] + [(None, "no id", "x", 0), (3, "twice", "x", 0), (3, "twice", "x", 0)], "doc_id long, text string, id string, length int"), texts


def test_token_counts(spark):
    df, texts = documents(spark)
    rows = {r.doc_id: r for r in token_counts(df, PIECE, 4096).collect()}
    for k, t in enumerate(texts):
        r = rows[100 - k]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n := len(library(PIECE, t or "")), n > 4096)
    assert token_counts(df, PIECE, 4096).count() == df.count() and token_counts(df.limit(0), PIECE, 1).count() == 0


def test_dac_random_access():
    r = random.Random(1)
    ids = np.array([r.choice([r.randrange(256), r.randrange(65536), r.randrange(1 << 32)]) for _ in range(3000)], np.uint32)
    n = np.array([0, 1000, 1, 1999])
    file = dac.TokenPart(b"".join(dac.encode_part(np.array([5, 6, 7, 8]), np.array([0, 0, 1, 0]), ids, n)))
    assert len(file) == 3000 and all(file[i] == ids[i] for i in range(0, 3000, 7))
    assert file[2999] == ids[2999] and [file.ids(a, b).tolist() for a, b in ((0, 0), (511, 513), (1, 2999))] == [ids[a:b].tolist() for a, b in ((0, 0), (511, 513), (1, 2999))]
    assert [(d, s, x.tolist()) for d, s, x in file.documents()] == [(5, 0, []), (6, 0, ids[:1000].tolist()), (None, 1000, ids[1000:1001].tolist()), (8, 1001, ids[1001:].tolist())]
    with pytest.raises(IndexError):
        file[3000]
    small = dac.TokenPart(b"".join(dac.encode_part(np.array([1]), np.array([0]), np.array([1, 2], np.uint32), np.array([2]))))
    assert len(small.levels) == 1 and small[1] == 2


def test_token_files(spark):
    df, texts = documents(spark)
    rows = dac.store_tokens(df, WORD, 1).collect()
    assert len(rows) == df.count()
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id is not None for r in order] == [False] + [True] * (len(rows) - 1)
    assert [r.doc_id for r in order[1:]] == sorted(r.doc_id for r in order[1:])
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    by_id = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts):
        ids = [*library(WORD, t or ""), 1]
        assert (by_id[100 - k].n_tokens, by_id[100 - k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert dac.store_tokens(df.limit(0), WORD, 1).count() == 0


def test_files_of_many_parts(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choices(["red", "green", "blue!", "word"], k=r.randrange(0, 60))) for _ in range(400)]
    files = SharedFiles(new_folder(spark, "parts"))
    monkeypatch.setattr(dac, "FILE_TEXT", 30_000)
    writer, everything = dac.Writer(files, 3), []
    for at in range(0, 400, 50):
        lists = [[*library(WORD, t), 1] for t in texts[at : at + 50]]
        everything += lists
        writer.add(np.arange(at, at + 50), np.zeros(50, np.uint8), np.array([i for x in lists for i in x], np.uint32), np.array(list(map(len, lists))), sum(map(len, texts[at : at + 50])))
    writer.end()
    assert len(writer.rows) == 2 and [x["number"] for x in writer.rows] == [0, 1] and sum(x["n_docs"] for x in writer.rows) == 400
    opened = [dac.TokenFile(files, x["file"], x["size"]) for x in writer.rows]
    assert [x.tolist() for f in opened for _, _, x in f.documents()] == everything
    ids = [i for _, _, x in opened[0].documents() for i in x.tolist()]
    assert all(opened[0][i] == ids[i] for i in r.sample(range(len(ids)), 100)) and len(opened[0].places) > 1
    with pytest.raises(ValueError):
        dac.TokenFile(files, writer.rows[0]["file"], writer.rows[0]["size"] - 1)


def by_hand(lengths, capacity):
    """Best fit decreasing, one piece at a time; number of bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in range(len(bins)) if bins[b] >= n]
        if fitting:
            bins[min(fitting, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(60):
        capacity = r.randrange(1, 60)
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 150))]
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.best_fit_plan(counts, capacity)
        filled = {}
        for n, c in counts.items():
            own = [k for k in range(len(plan["length"])) if plan["length"][k] == n]
            for rank in range(c):
                k = max(k for k in own if plan["rank"][k] <= rank)
                past = rank - plan["rank"][k]
                place = plan["offset"][k] + past % plan["per_bin"][k] * n
                filled.setdefault(plan["bin"][k] + past // plan["per_bin"][k], []).append((place, n))
        for parts in filled.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= capacity
        assert len(filled) == by_hand(lengths, capacity)


def test_packing(spark):
    df, texts = documents(spark)
    rows = packing.pack_documents(df, WORD, 1000, 1).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[-1][0] + parts[-1][1] <= 1000
    assert len(bins) == by_hand([r.length for r in rows], 1000)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    for k, t in enumerate(texts):
        ids = np.array([*library(WORD, t or ""), 1], "<u4")
        found = sorted(by_doc[100 - k], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in found] == [(p, s, len(ids[s : s + 1000]), zlib.crc32(ids[s : s + 1000].tobytes())) for p, s in enumerate(range(0, len(ids), 1000))]
    assert packing.pack_documents(df.limit(0), WORD, 1000, 1).count() == 0


def test_shared_files(spark):
    files = SharedFiles(new_folder(spark, "x"))
    files.write("a", [b"abc", b"def"])
    assert files.read("a") == b"abcdef" and files.read("a", 2, 3) == b"cde"
