"""The corpus operators against brute force on the small tables and on hand-made edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyworks.llm import chat, decontaminate, language, mixing, neardup, pii, quality, queries, secrets, tokens, toxicity
from tallyworks.llm.words import shingles, text_slices, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, spans string, words string"
LONG = "alpha beta gamma delta epsilon. " * 30_000


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, equal and repeated rows, with columns named like the operators' own."""
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, "same words here today now", "en", "b"),
        (6, "same words here today now", "en", "b"), (6, "same words here today now", "en", "b"), (7, "x", "en", None), (None, "no id at all", "en", "b"),
        (8, "ünï \U0001F600 çödé \0 end", "de", "b"),
    ]
    return spark.createDataFrame([(*r, 0, 0.5, 1, "s", "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# 1 ------------------------------------------------------------------------------------------------


def base_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(spark, sf, texts, odd, empty):
    for r in queries.op1_quality(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    got = quality.quality(odd).collect()
    assert len(got) == 10 and quality.quality(empty).count() == 0
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
        if r.doc_id == 4:
            assert r.n_words == 150_000 and r.n_repeat_words == 150_000 and r.base_failed


def test_quality_lines(spark):
    good = "This is a line of prose that says something and ends well.\n" + "Another sentence follows it here with other words entirely.\n"
    rows = [(1, good + "Home | News | About | Contact | Login"), (2, good + "All rights reserved by someone."), (3, "Home | a | b | c\nmenu\nlogin\nx | y | z | q | r s t u")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].n_navigation_lines == 1 and "Login" not in got[1].text
    assert got[2].kept and got[2].n_boilerplate_lines == 1
    assert not got[3].kept


# 2 ------------------------------------------------------------------------------------------------


def brute_classes(texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags, holders = {}, defaultdict(set)
    for i, t in texts.items():
        w = word.findall((t or "").translate(lower))
        n = min(5, len(w))
        bags[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()
        for s in bags[i]:
            holders[s].add(i)
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    n = len(texts)
    idf = {s: 1 + np.log(n / max(len(h), n * neardup.RARE)) for s, h in holders.items()}
    total = lambda bag: sum(k * idf[s] for s, k in bag.items())
    for i, bag in bags.items():
        for j in {j for s in bag for j in holders[s] if j > i}:
            both, any_ = total(bag & bags[j]), total(bag | bags[j])
            if both >= 0.8 * any_:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}


def test_near_duplicates(spark, sf, texts, odd, empty):
    got = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, sf).collect()}
    assert got == brute_classes(texts)
    rows = [(r.doc_id, r.class_id, r.n_class) for r in neardup.near_duplicates(odd).collect()]
    assert len(rows) == 10
    classes = dict((a, b) for a, b, _ in rows)
    assert classes[5] == classes[6] == 5 and classes[1] == 1 and classes[2] == 2 and classes[3] == 3 and classes[None] is None
    assert neardup.near_duplicates(empty).count() == 0


def test_hot_group_of_near_copies(spark):
    """A chain of near copies and a group of texts that are merely alike."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(2):
            w[(k * 7 + j * 60) % 200] = f"edit{k}x{j}"
        rows.append((k, " ".join(w)))
    for k in range(40):
        rows.append((1000 + k, " ".join(base[:90] + [f"own{k}y{i}" for i in range(110)])))
    rows += [(2000 + k, " ".join(f"other{k}z{i}" for i in range(8))) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(dict(rows)) and len({got[k] for k in range(60)}) < 20


def test_links_between_followers_of_different_leaders(spark):
    """One bucket with L1 < L2 < a, b: a is like L1, b like L2 and a, but neither like the other's leader."""
    base = [f"w{i}" for i in range(400)]

    def shifted(k):
        return " ".join(base[k : k + 300])

    rows = [(1, shifted(0)), (2, shifted(75)), (3, shifted(25)), (4, shifted(50))]
    rows += [(100 + k, " ".join(f"far{k}x{i}" for i in range(50))) for k in range(6)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    member = spark.createDataFrame([(0, 7, k, [7]) for k, _ in rows], "i int, band long, node long, bands array<long>")
    for block_bytes in (neardup.BLOCK_BYTES, 2000):
        kept, neardup.BLOCK_BYTES = neardup.BLOCK_BYTES, block_bytes
        try:
            links = neardup._linked(member, texts, neardup._Weights({}, len(rows)), neardup.THRESHOLD)
            got = {r["node"]: r["class"] for r in neardup.components(links).collect()}
        finally:
            neardup.BLOCK_BYTES = kept
        assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_idf_decides(spark):
    """A passage in a twentieth of the documents doesn't make them copies; the same overlap between two documents does."""
    def doc(passage, own):
        return " ".join([f"{passage}{i}" for i in range(60)] + [f"{own}{i}" for i in range(6)])

    rows = [(k, doc("notice", f"o{k}x")) for k in range(20)] + [(100, doc("pair", "one")), (101, doc("pair", "two"))]
    rows += [(1000 + k, " ".join(f"far{k}x{i}" for i in range(40))) for k in range(378)]
    got = {r.doc_id: r.n_class for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == got[101] == 2 and all(got[k] == 1 for k in range(20))


def test_common_shingles_weigh_less(spark):
    notice = " ".join(f"notice{i}" for i in range(60))
    rows = [(i, f"{notice} own{i} words{i} of{i} text{i} number{i} here{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common = neardup.common_shingles(df, 150)
    assert len(common) == 56 and set(common.values()) == {150}


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.choice(2**40, 300, replace=False).astype(np.uint64))
    wa = rng.uniform(1, 4, 300).astype(np.float32)
    wb = np.where(rng.uniform(size=300) < 0.3, wa * 2, wa).astype(np.float32)
    salts = neardup.mix(np.arange(5000, 9000, dtype=np.uint64))
    a = neardup._samples(ids, wa, np.array([0]), salts)
    b = neardup._samples(ids, wb, np.array([0]), salts)
    true = float(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs((a == b).mean() - true) < 0.03


def test_word_hashes_follow_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["One two", None, "two", "", "öne-TWO 3", "x"]})
    for most in (1, 8, 1 << 20):
        words, counts = [], []
        for _, _, data, offsets in text_slices(batch, "text", most):
            w, c = word_hashes(data, offsets)
            words += w.tolist()
            counts += c.tolist()
        assert counts == [2, 0, 1, 0, 3, 1]
        assert words[1] == words[2] == words[4] and len(set(words)) == 5
    one, where = shingles(np.array(words, np.uint64), np.array(counts))
    assert len(one) == 4 and where.tolist() == [0, 2, 4, 5]


# 3 ------------------------------------------------------------------------------------------------


def test_language(spark, sf, documents, odd, empty):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = queries.op3_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    model = language.fit_on(odd)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.languages(odd, model).collect()]
    assert len(got) == 10 and all(p == "und" and s == 0 for d, p, s in got if d in (1, 2, 3))
    assert language.languages(odd, language.fit_on(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.languages(empty, model).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def test_chat(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    tricky = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", tricky), ("assistant", tricky)]
    rows = queries.op4_chat(spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        t = turns[r.conv_id]
        loss = "".join(x for k, x in t if k == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), sha("".join(f"{k}\n{x}\n" for k, x in t)), len(loss), sha(loss))


def test_chat_trees(spark):
    nasty = ["\\", "<|end|>\n", "<|user|>\n", "\\<|", "[INST]\\[/INST]", "a\nb", "", None, "<<SYS>>", "$1 \\1", "\U0001F600<|"]
    rows = [("t", "r", None, 1.0, "user", "root")]
    rows += [("t", f"a{i}", "r" if i == 0 else f"a{i - 1}", 5.0, "assistant" if i % 2 == 0 else "us|er>\n", x) for i, x in enumerate(nasty)]
    rows += [("t", "b", "r", 2.0, "assistant", "short branch"), ("u", "o", "gone", None, None, "orphan")]
    df = spark.createDataFrame(rows, "tree_id string, msg_id string, parent_id string, score double, role string, text string")
    got = {(r.tree_id, r.rank): r for r in chat.read_back(chat.format_conversations(df, top=2)).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)}
    best = got["t", 1]
    assert [(t.role, t.text) for t in best.turns] == [("user", "root")] + [(r[4], r[5] or "") for r in rows[1 : 1 + len(nasty)]]
    assert best.loss_texts == [x or "" for x in nasty[::2]]
    assert [t.text for t in got["t", 2].turns] == ["root", "short branch"]
    assert chat.format_conversations(df.where("false")).count() == 0


# 5 ------------------------------------------------------------------------------------------------


def fitted(spark, toxic, ordinary):
    rows = [(i, text, int(i < len(toxic))) for i, text in enumerate([*toxic, *ordinary])]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit_on(df.drop("toxic"), df.drop("text"))


def test_toxicity(spark, sf, odd, empty):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf).collect()
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rs", "lk", "mp")]
    say = lambda bad: " ".join(str(w) for w in rng.choice(words + ["horridness", "vilephrase"] * (20 if bad else 0), 120))
    model = fitted(spark, [say(True) for _ in range(60)], [say(False) for _ in range(120)])
    new = [(i, say(i % 2 == 0)) for i in range(60)]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert np.mean([got[i] == (i % 2 == 0) for i, _ in new]) > 0.95
    assert toxicity.toxicity(odd, model).count() == 10 and toxicity.toxicity(empty, model).count() == 0
    kept = toxicity.keep_ordinary(odd, model)
    assert kept.columns == odd.columns and kept.count() == 10


def test_toxicity_held_out(spark):
    """Inflected toxic stems among invented words, as held-out documents: at least 0.9 of them are found, few others."""
    rng = np.random.default_rng(11)
    parts = [a + b for a in "bdfgklmnprst" for b in "aeiou"]

    def word():
        return "".join(rng.choice(parts, rng.integers(1, 5)))

    def doc(bad):
        words = [word() for _ in range(rng.integers(60, 400))]
        for _ in range(max(3, len(words) // 25) if bad else 0):
            stem = ["vuxwor", "hozzgle", "scumbly"][rng.integers(3)]
            words.insert(int(rng.integers(len(words))), stem + str(rng.choice(["", "en", "ta", "rika"])))
        return " ".join(words)

    model = fitted(spark, [doc(True) for _ in range(60)], [doc(False) for _ in range(540)])
    new = [(i, doc(i % 4 == 0)) for i in range(400)] + [(1000, doc(False) + " " + " ".join(word() for _ in range(20_000)) + " " + "hozzgleta vuxworen scumbly " * 400)]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert np.mean([got[i] for i in range(0, 400, 4)]) >= 0.9 and np.mean([got[i] for i in range(400) if i % 4]) <= 0.02
    assert got[1000]  # what stands late in a long text counts


def test_toxicity_scores_of_odd_rows(spark, odd, empty):
    """Rows without a window share one score, repeated rows and clashing columns change nothing; one-sided labels give one answer."""
    model = fitted(spark, ["vile horrid vile horrid words here"] * 9, ["plain words are spoken here today"] * 20)
    score = {}
    for r in toxicity.toxicity(odd, model).collect():
        score.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert score[1] == score[2] == score[3] == score[7] and score[5] == score[6] and all(len(v) == 1 for v in score.values())
    for toxic, plain, kept in ((["bad text here"], [], 0), ([], ["good text here"], 10), ([], [], 10)):
        assert toxicity.keep_ordinary(odd, fitted(spark, toxic, plain)).count() == kept
    twins = fitted(spark, ["same words in both sides"] * 3, ["same words in both sides"] * 3)
    assert toxicity.toxicity(odd, twins).count() == 10


def test_toxicity_recall_on_held_out_documents(spark):
    """The given tables at sf0.1: at least nine of ten held-out toxic documents, at most two per cent of the others."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    bad, good = [r.predicted for r in rows if toxic[r.doc_id]], [r.predicted for r in rows if not toxic[r.doc_id]]
    assert len(bad) > 90 and np.mean(bad) >= 0.9 and np.mean(good) <= 0.02


# 6 ------------------------------------------------------------------------------------------------


def test_token_files(spark, sf, texts, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    start = 0
    for r in sorted(queries.op6_token_ids(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = tokens.write_tokens(odd, queries.tokenizer_path())
    special = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "plain")], "doc_id long, text string")
    first = tokens.token_at(spark, tokens.write_tokens(special, queries.tokenizer_path()), spark.createDataFrame([(1, k) for k in range(5)], "doc_id long, at long"))
    assert [r.id for r in sorted(first.collect(), key=lambda r: r.at)] == [*t.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2] == [64, 220, 50256, 275, 2]
    got = tokens.read_tokens(spark, folder).collect()
    assert len(got) == 10 and sorted(r.n_tokens for r in got)[:3] == [1, 1, 2]
    asked = spark.createDataFrame([(4, 0), (4, 100_000), (5, 1), (5, 999), (2, 0)], "doc_id long, at long")
    found = {(r.doc_id, r.at): r.id for r in tokens.token_at(spark, folder, asked).collect()}
    long_ids = t.encode(LONG, add_special_tokens=False).ids
    assert found[4, 0] == long_ids[0] and found[4, 100_000] == long_ids[100_000] and found[5, 999] is None and found[2, 0] == 2
    assert tokens.read_tokens(spark, tokens.write_tokens(empty, queries.tokenizer_path())).count() == 0


def test_pieces_equal_whole_texts():
    """Cutting at byte classes changes no id: odd white space, contractions, Latin letters, marks and control strings."""
    e = tokens.PieceEncoder(queries.tokenizer_path())
    rng = np.random.default_rng(3)
    parts = [*"ab  \n\t'.,;$12\u00e9\u00df\u00d7\u00f1\u00f7", "'s", "'ll", "\u00a0", "\u3000", "\u65e5", "\U0001F642", " \n", "</s>", "<|endoftext|>", "\r\n", "\x1c", "\0", "\u2003", "\u00f6,"]
    cases = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    cases += ["a" * 5000, " " * 3000, "\u00e9" * 400 + " x", "", "\n", " ", "'", LONG[:5000]]
    batch = pa.RecordBatch.from_arrays([pa.array(cases)], ["text"])
    for _ in range(2):  # the second time from the table
        for lo, hi, data, offsets in text_slices(batch, "text", 1 << 14):
            ids, per_text = e.encode(data, offsets)
            cut = np.concatenate([[0], np.cumsum(per_text)])
            for i, text in enumerate(cases[lo:hi]):
                assert ids[cut[i] : cut[i + 1]].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_record_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        ids = rng.choice([3, 255, 256, 65_535, 65_536, 2**31], n).astype(np.uint32)
        record = tokens.Record(tokens.encode_record(ids, np.array([0, n // 2, n], np.uint64)))
        assert (record.ids(np.arange(n)) == ids).all() and (record.span(0, n) == ids).all()
        assert (record.document(1) == ids[n // 2 :]).all()
        for a, b in ((n // 3, n), (n // 2, n // 2), (1, n - 1)):
            if 0 <= a <= b:
                assert (record.span(a, b) == ids[a:b]).all()


# 7 ------------------------------------------------------------------------------------------------


def level_targets(sizes, weights):
    """Share, cap, share the rest again, until none is above."""
    total, fixed = 1.5 * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        aims = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if aims[i] > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, aims.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: 2.0 * sizes[i] for i in over}


def test_mixing(spark, sf, documents, texts, odd, empty):
    rows = queries.op7_mixing(spark, sf).collect()
    assert rows and sorted(rows) == sorted(queries.op7_mixing(spark, sf).collect())
    source = {r.doc_id: r.source for r in documents.collect()}
    names = sorted({s for s in source.values() if s is not None})
    sizes = [sum(r.size for r in rows if source[r.doc_id] == s) for s in names]
    aims = level_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, size, aim in zip(names, sizes, aims):
        mine = [r for r in rows if source[r.doc_id] == s]
        assert all(r.source_size == size and r.target == pytest.approx(aim) for r in mine)
        assert abs(sum(r.taken for r in mine) - aim) <= 2 * mixing.BLOCK
    assert all(r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.taken <= 2 * r.size for r in rows)
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(documents)
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert mixed.columns == documents.columns and words == sum(r.taken for r in rows)


def test_highest_quotients(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 500, 12)]
    for seats in (0, 1, 7, 100, 777):
        won = Counter()
        for _ in range(seats):
            won[max(range(12), key=lambda i: (sizes[i] / (2 * won[i] + 1), -i))] += 1
        df = spark.createDataFrame([("g", i, s, seats) for i, s in enumerate(sizes)], "g string, c int, size long, seats long")
        got = {r.c: r.quota for r in mixing.apportion(df, ["g"], ["c"], "size", "seats").collect()}
        assert got == {i: won[i] for i in range(12)}
    # many cells just under half a seat: their seats go to the large one, far above its share
    df = spark.createDataFrame([("g", i, s, 140) for i, s in enumerate([1000.0] + [4.0] * 100)], "g string, c int, size double, seats long")
    got = {r.c: r.quota for r in mixing.apportion(df, ["g"], ["c"], "size", "seats").collect()}
    assert got[0] == 125 and [got[c] for c in range(1, 101)] == [1] * 15 + [0] * 85


def test_sources_compete_by_quotients(spark):
    aims = spark.createDataFrame([(0, 6400.0), (1, 3232.0), (2, 90.0)], "rank int, target double")
    cells = spark.createDataFrame([(0, 0, k, 640) for k in range(10)] + [(1, 0, 0, 2000), (1, 1, 1000, 1232), (2, 0, 0, 90)], "rank int, region long, shard long, words long")
    got = {(r["rank"], r.shard): r.quota for r in mixing.quotas(aims, cells, 64).collect()}
    targets, won = {0: 6400.0, 1: 3232.0, 2: 90.0}, Counter()
    for _ in range(round(sum(targets.values()) / 64)):
        won[max(targets, key=lambda r: (targets[r] / (2 * won[r] + 1), -r))] += 1
    for r in targets:
        assert sum(q for (k, _), q in got.items() if k == r) == won[r]


def test_mixed_columns_of_any_name(spark, odd):
    more = odd.withColumnRenamed("score", "_size").withColumn("taken", F.lit(1)).withColumn("p", F.lit("x")).withColumn("doc", F.lit(2))
    mixed = mixing.mixed_documents(more)
    assert mixed.columns == more.columns and {(r._size, r.row, r.taken, r.p, r.doc) for r in mixed.collect()} == {(0.5, 1, 1, "x", 2)}
    assert mixing.mixed_documents(more.where("false")).count() == 0


# 8, 9 ---------------------------------------------------------------------------------------------


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


SECRETS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6, re.I | re.A),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, 0),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24, 0),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True, 0),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split(".")), 0),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15, 0),
]


def base_spans(text, kinds):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok, flags) in enumerate(kinds) for m in re.finditer(p, text or "", flags) if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def check_spans(rows, texts, kinds):
    for r in rows:
        expected = base_spans(texts[r.doc_id], kinds)
        assert r.base_sha256 == sha(",".join(expected))
        assert set(expected) <= set(r.spans.split(",")) | {""}
        assert [r[f"n_{k[0]}"] for k in kinds] == [sum(e.startswith(k[0] + ":") for e in expected) for k in kinds]


TRICKY = [
    "token: token: abcdefgh", "TOKEN='abc' api-key secret = \"a.b-c_d=\" passwd:12345", "AKIA" + "A" * 15 + "AKIA" + "B" * 16, "\U0001F600 token=abcdef deadbeef" * 3,
    "a" * 24 + "g" + "0" * 23, "a@b.c_d@e.f x..y@z.com @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 99999999999999999999.1.1.1", "4111 1111-1111 1111 x 4111111111111112",
    "+1 (255) 555-8013 +12345 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "9" * 5000, "é1.1.1.1é +49 30 1234567é", None, "",
]


def test_secrets(spark, sf, texts, odd, empty):
    check_spans(queries.op8_secrets(spark, sf).collect(), texts, SECRETS)
    df = spark.createDataFrame(list(enumerate(TRICKY)), "path long, text string")
    ledger = secrets.new_ledger(spark)
    rows = lambda: spark.read.parquet(ledger).count()
    check_spans(secrets.digest(secrets.scan(df, ledger), "doc_id").collect(), dict(enumerate(TRICKY)), SECRETS)
    first = len({t or "" for t in TRICKY})
    assert rows() == first
    # several versions of a path: only the one new blob is scanned, findings come back for every version
    more = df.unionByName(spark.createDataFrame([(0, "token=abcdef1"), (0, TRICKY[1]), (101, TRICKY[0])], "path long, text string"))
    found = secrets.scan(more, ledger)
    assert rows() == first + 1 and found.count() == len(TRICKY) + 3 and found.where("path = 0").select("blob").distinct().count() == 3
    # a retried write leaves rows twice: findings don't double
    secrets.known_blobs(spark, ledger).selectExpr("blob", f"'{secrets.RULES}' AS rules", "spans").write.mode("append").parquet(ledger)
    assert secrets.scan(more, ledger).count() == len(TRICKY) + 3
    kept, secrets.RULES = secrets.RULES, "next"
    try:
        before = rows()
        assert secrets.scan(df, ledger).count() == len(TRICKY) and rows() == before + first
    finally:
        secrets.RULES = kept
    other = secrets.scan(odd.withColumnRenamed("doc_id", "path").withColumn("blob", F.lit(1)).withColumn("rules", F.lit(1)), ledger)
    assert other.columns == ["path", "blob", "spans"] and other.count() == 10
    assert secrets.scan(empty.withColumnRenamed("doc_id", "path"), ledger).count() == 0


def test_personal_data(spark, sf, texts, odd, empty):
    check_spans(queries.op9_personal_data(spark, sf).collect(), texts, PERSONAL)
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    check_spans(pii.digest(pii.personal_data(df)).collect(), dict(enumerate(TRICKY)), PERSONAL)
    assert pii.personal_data(odd).count() == 10 and pii.personal_data(empty).count() == 0


def test_bootstrapped_patterns(spark):
    """A cue learned from e-mail addresses finds an address of another form; a cue of ordinary numbers finds nothing."""
    rows = [(i, f"word contact me: user{i}@mail.example.com and part no: 55512{i:02d} end") for i in range(20)]
    rows.append((99, "word contact me: user99@localhost and part no: 5551299 end"))
    got = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[99] == "context:17:33" and all("context" not in got[i] for i in range(20))


def brute_context(texts):
    """Context spans by plain loops: tokens, words before them on the line, rounds of trust."""
    base = {i: [tuple(map(int, s.split(":")[1:])) for s in base_spans(t, PERSONAL)] for i, t in texts.items()}
    seen = []
    for i, text in texts.items():
        at = 0
        tokens = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for start, m in tokens:
            cued = re.search(r"[:=#][\x20\x09]$", text[:start])
            if not (re.search("[0-9@]|[:=#].", m) or cued):
                continue
            words = [w for w in re.split(r"[\x20\x09\x0b\x0c\r]+", text[at:start].rpartition("\n")[2]) if w][-2:]
            at = start + len(m)
            cue = re.match(r"[^0-9@]*[:=#](?=.)", m)
            cue = cue.group() if cue else ""
            rest = m[len(cue) :]
            head = len(rest) - len(rest.lstrip("([<{\"'"))
            core = rest.lstrip("([<{\"'").rstrip(")]>}\"',.;:!?")
            pattern = " ".join(words if not cue else [*words[-1:], cue]).lower()
            a = start + len(cue) + head
            if pattern and len(core) >= pii.MIN_CHARS:
                b = a + len(core)
                seen.append((i, a, b, core.lower(), pattern, any(x < b and y > a for x, y in base[i])))
    edges = {(p, x) for _, _, _, x, p, _ in seen}
    trusted = {x for *_, x, _, seed in seen if seed}
    while True:
        by = defaultdict(set)
        for p, x in edges:
            by[p].add(x)
        sure = {p: len(v & trusted) / (len(v) + pii.PRIOR) for p, v in by.items() if len(v & trusted) >= pii.MIN_SEEDS}
        sure = {p: c for p, c in sure.items() if c >= pii.LEAST}
        doubt = defaultdict(lambda: 1.0)
        for p, x in edges:
            doubt[x] *= 1 - sure.get(p, 0)
        new = {x for x, d in doubt.items() if 1 - d >= pii.CONFIDENT - 1e-12} - trusted
        if not new:
            return {(i, a, b) for i, a, b, x, p, seed in seen if not seed and p in sure and x in trusted}
        trusted |= new


def test_context_spans_equal_brute_force(spark):
    """Two hops, cues inside tokens, word cues, identifiers of letters; ordinary numbers stay out."""
    mail = [f"user{i}@mail.example.com" for i in range(90)]
    rows = [f"please contact me: {m} today and part number 77{i:03d}x ok" for i, m in enumerate(mail)]
    rows += [f"owner={m} then" for m in mail[:20]] + [f"please contact me: handle_{chr(97 + i)}xyz bye" for i in range(14)]
    rows += [f"(login id=handle_{chr(97 + i)}xyz." for i in range(14)] + ["(login id=99887766 here", "(login id=77665544", "my number is 5551234"]
    rows += [f"part number 88{i:03d}y" for i in range(50)] + ["please contact me:\n12345678", "x  contact\tme: odd_one9", "", "9" * 300]
    texts = dict(enumerate(rows))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = pii.digest(pii.personal_data(df)).collect()
    got = {(r.doc_id, *map(int, x.split(":")[1:])) for r in found for x in r.spans.split(",") if x.startswith("context")}
    want = brute_context(texts)
    assert got == want and len(want) >= 8
    hop = next(i for i, t in texts.items() if t.startswith("(login id=99887766"))
    assert (hop, 10, 18) in got  # known only through handles that the first pattern found


def test_very_long_words_are_scanned_in_linear_time(spark):
    import time

    rows = [(1, "a" * 1_000_000 + " ; b id "), (2, "7" * 1_000_000), (3, "x: " * 200_000), (4, "ab1 " * 100_000), (5, "a@" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    began = time.time()
    assert pii.digest(pii.personal_data(df)).count() == 5
    assert secrets.scan(df.withColumnRenamed("doc_id", "path"), secrets.new_ledger(spark)).count() == 5
    assert time.time() - began < 60


# 10 -----------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for k, t in items:
        w = lowered(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w, hit, found = lowered(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark, sf, texts, odd, empty):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = brute_hits(texts.items(), items)
    for r in queries.op10_decontamination(spark, sf).collect():
        n, hit, found = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha(",".join(found)), hit > 0)
    assert decontaminate.contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    found = decontaminate.contamination(odd, spark.createDataFrame([(1, "words here today"), (2, "gamma delta")], "item_id long, text string"), slop=1)
    assert sorted((r.doc_id or 0, r.n_hit, r["items"]) for r in found.where("n_hit > 0").collect()) == [(4, 60_000, ["2"]), (5, 3, ["1"]), (6, 3, ["1"]), (6, 3, ["1"])]


def test_short_and_repeated_items(spark):
    items = [(1, "same words"), (2, "X"), (3, None), (4, "!!"), (5, "a b a b a b a b a b a b"), (6, "a b a b a b a b a b a b"), (70, "SAME words")]
    docs = [(1, "The same, WORDS same-words x"), (2, " ".join("ab" * 9)), (3, None), (4, "xx xé é"), (5, "b a " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, slop=2).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == brute_hits(docs, items)
    assert all(set(r["items"]) <= set(r.near_items) for r in got)


def brute_near(docs, items, slop, agree):
    docs = {d: lowered(t) for d, t in docs}
    df = Counter(w for words in docs.values() for w in set(words))
    out = {d: set() for d in docs}
    for k, t in items:
        w = lowered(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            win = w[p : p + n]
            anchors = sorted(range(n), key=lambda j: (df[win[j]], j))[:2]
            for d, words in docs.items():
                for at in (i - o for o in anchors for i, x in enumerate(words) if x == win[o] and i >= o):
                    near = sum(win[j] in words[max(0, at + j - slop) : max(0, at + j + slop + 1)] for j in range(n))
                    if near >= agree * n - 1e-9:
                        out[d].add(str(k))
    return out


def test_edited_passages_are_near(spark):
    """A word changed, dropped or put in every few words leaves no window whole; proximity still finds the item."""
    passage = [f"term{i}" for i in range(40)]
    changed = [f"new{i}" if i % 6 == 3 else w for i, w in enumerate(passage)]
    longer = [x for i, w in enumerate(passage) for x in ([w, "extra"] if i % 7 == 2 else [w])]
    shuffled = [passage[(i * 17) % 40] for i in range(40)]
    docs = [(1, " ".join(["lead"] * 5 + passage)), (2, " ".join(changed)), (3, " ".join(longer)), (4, " ".join(shuffled)), (5, None), (6, "term1 term2 term3")]
    items = [(1, " ".join(passage)), (2, "term1 term2"), (3, " ".join(passage[:12])), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, slop=2).collect()
    assert {r.doc_id: set(r.near_items) for r in got} == brute_near(docs, items, 2, decontaminate.AGREE)
    near = {r.doc_id: (r["items"], r.near_items) for r in got}
    assert "1" not in near[2][0] and "1" in near[2][1] and "1" in near[3][1] and "1" not in near[4][1]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    back = [(2000 - i, 1999 - i) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(1049, 1048), (5000, 5000), (6000, 6001), (6001, 6000)]
    df = spark.createDataFrame(chain + back + star, "a long, b long")
    got = {r["node"]: r["class"] for r in neardup.components(df).collect()}
    expected = {i: 0 for i in range(301)} | {i: 1900 for i in range(1900, 2001)} | {1000 + i: 1000 for i in range(50)} | {6000: 6000, 6001: 6000}
    assert got == expected
