"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from tallyworks.llm.spelling import neighbours, reduced, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, id long, form string"


def brute_counts(docs):
    total = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edits(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + "?" + word[i + 1 :] for i in range(len(word))}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute(docs):
    n = brute_counts(docs)
    by = defaultdict(set)
    for w in n:
        for e in edits(w) | {w}:
            by[e].add(w)
    near = {w: {x for e in edits(w) | {w} for x in by[e] if one_edit(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect())


def test_whole_table_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sum(1 for r in want if r[1]) > 10
    assert found(df) == want


def test_odd_rows_chains_and_ties(spark):
    long = "ab" * 20_000
    rows = [
        (1, None), (2, ""), (None, "nullid nullid nullid NULLID"), (3, f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]}c"),
        (4, "chain " * 40 + "chainx " * 20 + "chainxy " * 10 + "chainxyz " * 5 + "tiesa " * 8 + "tiesb " * 8 + "tiesÿ " * 4 + "tiesc " * 3),
        (5, "À×÷Éÿ " * 6 + "aaaaa " * 3 + "aaaaaa " * 9 + "baaaa " * 3), (6, "same words stay"), (6, "same words stay"), (6, "same words stay"),
    ]
    rows = [(*r, "w", 1, 2, "f") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df)
    assert got == brute(rows)
    told = {r[0]: r for r in got}
    assert told["chainxyz"][2] == "chain" and told["tiesc"][1] == "tiesa" and told["words"][3] == 3
    assert spelling_variants(df.where("false")).collect() == []


@pytest.mark.parametrize("symbols", [2, 5, 8])
def test_neighbourhoods_hold_every_near_word(symbols):
    """Every word one edit away has its reduced form in the neighbourhood, and each neighbour stands once in a piece."""
    letters = "abczàÿ"
    for word in ("abcza", "aaaaa", "zÿàab"):
        near = {word[:i] + word[i + 1 :] for i in range(5)} | {word[:i] + c + word[i + k :] for i in range(5 + 1) for c in letters for k in (0, 1)}
        around = {int(h) for _, hs in neighbours([word], symbols) for h in hs}
        assert {int(h) for h in reduced(sorted(near), symbols)} <= around
        forms = (2 * symbols) * len(word) + symbols + 1
        assert len(around) <= forms
    together = [(int(i), int(h)) for where, hs in neighbours(["abcza", "zzzzz"], symbols) for i, h in zip(where, hs)]
    alone = {(k, int(h)) for k, w in enumerate(["abcza", "zzzzz"]) for _, hs in neighbours([w], symbols) for h in hs}
    assert set(together) == alone
