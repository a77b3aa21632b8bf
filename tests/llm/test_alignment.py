"""Cross-tokenizer alignment against brute force over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from tallyworks.llm import alignment, queries
from tallyworks.llm.alignment import token_alignment

SCHEMA = "doc_id long, text string, key string, n_same long, n_best long, codes string"


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path(), queries.pieces_path()


def brute(texts, paths):
    """Rows without doc_id, each text tokenised whole."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    # the byte that each sign of the byte-level alphabet stands for
    byte_of = {}
    for code in [*range(0x800), *range(0x800, 0xD800, 0x400), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)]:
        raw = chr(code).encode()
        signs = "".join(s for s, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code)))
        byte_of.update(zip(signs, raw))
    rows, held, highest = [], Counter(), defaultdict(int)
    for text in texts:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
            tb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            raw = (" " + text).encode()
            if b"".join(ta) == raw == b"".join(tb):
                ends = []
                for tokens in (ta, tb):
                    at, mine = 0, []
                    for t in tokens:
                        at += len(t)
                        mine.append(at)
                    ends.append(mine)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = by_cut(ia, ends[0], ib, ends[1], cuts)
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(set(links))
        rows.append((groups, links))
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [
        (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
            sum(n for p, n in links.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in links.items()),
            hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "",
        )
        for g, links in rows
    ]


def by_cut(ia, ea, ib, eb, cuts):
    groups = {hi: ([], []) for hi in cuts}
    for side, (ids, ends) in enumerate(((ia, ea), (ib, eb))):
        k = 0
        for i, e in zip(ids, ends):
            while cuts[k] < e:
                k += 1
            groups[cuts[k]][side].append(i)
    return [groups[hi] for hi in cuts]


def found(df, paths, **kw):
    rows = token_alignment(df, *paths, **kw).collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=str)


def check(df, paths, **kw):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *m) for r, m in zip(rows, brute([r.text for r in rows], paths))), key=str)
    assert found(df, paths, **kw) == want
    return want


@pytest.mark.parametrize("common", [1 << 20, 300, 0])
def test_whole_table_equals_brute_force(spark, sf, paths, common):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    df = df.where("doc_id % 4 = 0") if common < 1 << 20 else df
    want = check(df, paths, common=common)
    assert sum(r[3] for r in want) > 1000


def test_odd_texts(spark, paths, monkeypatch):
    texts = [
        None, "", " ", "  two  spaces ", "a<s>b</s> <|endoftext|> [INST]", "mark▁in text", "x▁ y", "line\n\n  next\tTab \r\n end ", "zero\0byte \x1c sep",
        "café café naïve ½ ﬁ 　wide space​", "\U0001F600\U0001F468‍\U0001F469 中文 中 अन א ",
        "can't won't 'll x's '  's", "word " * 3000 + "end", "nospace" * 4000, "!!! ??? ... ---- ____", "12345 6 78 9٠", "same text", "same text", "same text",
        "\u0085next  line", "a ́b", "tail   ",
    ]
    rows = [(i if i != 5 else None, t, "k", 1, 2, "c") for i, t in enumerate(texts)] + [(16, "same text", "k", 1, 2, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = check(df, paths)
    assert any(r[1] == 0 and r[-1] == "" for r in want) and (0, 0, 0, 0, 0, 0, 0, "") in want
    assert token_alignment(df.where("false"), *paths).collect() == []
    rows = brute(texts, paths)
    for at_once, cache in ((7, 5), (1, 1 << 20)):  # pieces of a few letters and a table that is emptied all the time
        monkeypatch.setattr(alignment, "AT_ONCE", at_once)
        monkeypatch.setattr(alignment, "CACHE", cache)
        tool = alignment.Aligner(*paths)
        for text, want in zip(texts, rows):
            got = tool.measure(text)
            assert (got is None and want[0] == 0) or (*got[:4], got[4]) == (*want[:4], want[6])
