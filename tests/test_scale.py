"""Plans and shapes of work that small tables don't show by their results."""

from __future__ import annotations

import re

import pytest
from tallyworks import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["l05_documents", "l09_statement", "m15_corpus_candidates"])
def test_ledger_meets_documents_by_their_number(name, spark, sf):
    """A condition on the document's name must not turn the join into a nested loop over both tables."""
    text = plan(catalog.queries()[name](spark, sf))
    assert not re.search(r"NestedLoopJoin.*doc_id", text)
    assert re.search(r"(Hash|Merge)Join \[at#\d+L\], \[doc_id#\d+L\]", text)


def test_success_checks_of_many_repetitions(spark, tmp_path):
    """Repetitions of two digits: a needle stands inside longer texts, in the query and in its twin."""
    import duckdb
    from conftest import compare

    path = f"{tmp_path}/conversations.parquet"
    spark.range(500).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "'x' AS text").write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    compare(catalog.queries()["b02_success_checks"](spark, str(tmp_path)), catalog.oracle_sql()["b02_success_checks"], duck)


def test_signatures_distil_each_log_once(spark, sf):
    """The condition on the signature isn't pushed down to where every use of a column distils the log again."""
    text = plan(catalog.queries()["m02_error_signatures"](spark, sf))
    assert not re.search(r"Filter isnotnull\((?!\w+#)", text)


def test_contradictions_are_made_once(spark, sf):
    """The pairs of records and sessions come out of the last join; nothing shuffles or sorts them."""
    text = plan(catalog.queries()["m10_contradictions"](spark, sf)).split("\n")
    above = text[: next(i for i, line in enumerate(text) if "Join" in line)]
    assert not [line for line in above if "Exchange" in line or "Aggregate" in line]


def test_contradictions_are_pairs_of_arrays(spark, monkeypatch):
    """The pairs by brute force; they come an array of sessions at a time, in order of their last event, and no session is sent more than once."""
    import itertools
    import random

    from tallyworks.operators import mining as m

    monkeypatch.setattr(m, "SPREAD", 2)
    monkeypatch.setattr(m, "BLOCK", 7)
    monkeypatch.setattr(m, "FEW_RECORDS", 3)
    rng = random.Random(3)
    records = [(f"r{k}", "error-fix", rng.choice("tu"), rng.randrange(100), rng.sample([f"s{n}" for n in range(60)], rng.randrange(4))) for k in range(60)]
    records += [(f"z{k}", "zoom-hotspot", rng.choice(["f.ts", "src/f.ts", "g.ts"]), rng.randrange(100), []) for k in range(30)]
    failures = [(f"s{rng.randrange(60)}", rng.randrange(120), rng.choice("tuv")) for _ in range(200)]
    zooms = [(f"s{rng.randrange(60)}", rng.randrange(120), "src/f.ts") for _ in range(80)]
    last = {}
    for kind, rows in (("error-fix", failures), ("zoom-hotspot", zooms)):
        for session, seq, target in rows:
            last[kind, target, session] = max(last.get((kind, target, session), -1), seq)
    fits = lambda target, path: f"/{path}".endswith(f"/{target}") or f"/{target}".endswith(f"/{path}")
    want = sorted((i, s) for i, kind, target, seq, counted in records for (k, t, s), n in last.items() if k == kind and (t == target if k == "error-fix" else fits(target, t)) and n > seq and s not in counted)
    found = m.contradictions(
        spark.createDataFrame(records, "id string, type string, target string, graduated_seq long, counted array<string>"),
        spark.createDataFrame(failures, "session_id string, seq long, signature string"), spark.createDataFrame(zooms, "session_id string, seq long, path string"),
    )
    got = [(r.id, r.session_id) for r in found.collect()]
    assert sorted(got) == want and len(want) > 1000
    of = {i: (kind, target if kind == "error-fix" else "src/f.ts") for i, kind, target, *_ in records}
    for i, run in itertools.groupby(got, lambda x: x[0]):
        ends = [last[(*of[i], s)] for _, s in run]
        assert len(ends) <= 14 and sum(a < b for a, b in zip(ends, ends[1:])) <= 1


def test_contradicted_records_need_no_pairs(spark):
    """The last sessions of a target tell which records are contradicted; those counted before don't."""
    from tallyworks.operators import mining as m

    n = m.COUNTED_SESSIONS
    records = spark.createDataFrame(
        [("a", "error-fix", "t", 0, [f"s{k}" for k in range(n)]), ("b", "error-fix", "t", n, ["x"]), ("c", "error-fix", "t", n - 1, ["x"]), ("d", "error-fix", "t", n - 1, [f"s{n}"])],
        "id string, type string, target string, graduated_seq long, counted array<string>",
    )
    failures = spark.createDataFrame([(f"s{k}", k, "t") for k in range(n + 1)], "session_id string, seq long, signature string")
    zooms = spark.createDataFrame([], "session_id string, seq long, path string")
    assert sorted(r.id for r in m.contradicted(records, failures, zooms).collect()) == ["a", "c"]
    pairs = sorted((r.id, r.session_id) for r in m.contradictions(records, failures, zooms).collect())
    assert pairs == [("a", f"s{n}"), ("c", f"s{n}")]


def test_questions_go_to_the_sections(spark, sf):
    """References and grades meet the sections without a shuffle of questions times sections."""
    q = catalog.queries()
    text = plan(q["d16_ref_matches"](spark, sf)).split("\n")
    join = next(i for i, line in enumerate(text) if "BroadcastHashJoin" in line)
    assert not [line for line in text[:join] if "Exchange" in line or "Aggregate" in line]
    # from titles to grades: rows are a pair of a question and a title until the last join
    text = plan(q["d17_heading_grades"](spark, sf))
    assert not re.search(r"Exchange hashpartitioning\(question_id#\w+, doc_id", text)


@pytest.mark.parametrize("name", ["d19_section_scores", "d20_best_sections", "d22_ranked_documents"])
def test_scores_shuffle_no_pairs(name, spark, sf):
    """From the sections' lines on, no pair of a question and a section is sent around; only the ranked heads of d22 are."""
    text = plan(catalog.queries()[name](spark, sf)).split("\n")
    explode = next(i for i, line in enumerate(text) if "Generate explode" in line)
    sent = [line for line in text[:explode] if "Exchange" in line]
    assert len(sent) == (1 if name == "d22_ranked_documents" else 0)
    assert all("question_id" in line and "doc_id" not in line for line in sent) and (not sent or any("WindowGroupLimit" in line and "Partial" in line for line in text[:explode]))


@pytest.mark.parametrize("name", ["d19_section_scores", "d20_best_sections", "d22_ranked_documents"])
def test_scores_are_put_together_in_arrays(name, spark, sf):
    """Rows of questions and sections aren't grouped or joined, and the lines are sent once by document after their sections are known."""
    text = plan(catalog.queries()[name](spark, sf)).split("\n")
    explode = next(i for i, line in enumerate(text) if "Generate explode" in line)
    assert not [line for line in text[:explode] if "Aggregate" in line or "Join" in line]
    union = next(i for i, line in enumerate(text) if "Union" in line)
    assert len([line for line in text[explode:union] if "Exchange" in line]) == 1


def test_sections_read_the_lines_once(spark):
    """Headings aren't joined to their lines, and sections are those of the join; a preamble's text is cut within white space."""
    from tallyworks.operators import sections as s

    texts = {1: "  " + "x" * 79 + " y\n\n1. Costs\nalpha\n \n2.1 Terms\nfee\n\n", 2: "\n\nANNEX A\nExample 5: Widgets\n(b) Letters", 3: "", 4: "no heading in here.\n", 5: "1. Costs\n1. Costs"}
    lines = spark.createDataFrame([(d, i + 1, line) for d, t in texts.items() for i, line in enumerate(t.split("\n"))] + [(6, 1, None)], "doc_id long, line_no int, line string")
    found = s.plain_sections(lines)
    assert "Join" not in plan(found)
    theirs = s.sections(lines, s.headings(lines))
    assert found.dtypes == theirs.dtypes and sorted(map(str, found.collect())) == sorted(map(str, theirs.collect())) and found.count() == 7


def test_scores_in_arrays_are_those_of_the_join(spark, sf, monkeypatch):
    """Titles, references of several sections, keywords in and over one another: more than WIDE questions meet the sections by joins."""
    from pyspark.sql import functions as F
    from tallyworks.operators import scoring
    from tallyworks.operators import sections as s
    from tallyworks.plans.sections import _asked
    from tallyworks.plans.sections import lines as lines_of

    asked, found = _asked(spark, sf)
    more = [(1001, "Explain Section 2 and §1 of topic 3 part 6, otherwise sec. 2"), (1002, "topicpart part topics ents mentes"), (1003, ""), (1004, None), (1005, "Section 1 topic")]
    asked = asked.where("question_id < 12").unionByName(spark.createDataFrame(more, "question_id long, question string").select(*[F.col(c).cast(k).alias(c) for c, k in asked.dtypes]))
    keep = "doc_id % 4 = 1"
    # numbers say nothing of a section here: references meet titles, of which several are alike
    found = found.where(keep).withColumn("title", F.when(F.col("place") % 3 == 0, F.concat(F.lit("Section 2 "), "title")).otherwise(F.col("title")))
    found = found.withColumn("section_id", F.when(F.col("place") % 2 == 0, F.lit("2")).when(F.col("place") % 3 == 0, F.lit("x")).otherwise(F.col("section_id"))).localCheckpoint()
    lines = lines_of(spark, sf).where(keep)

    def told():
        each = (s.section_scores(asked, found, lines), s.sections_of_each(asked, found, lines, 2), s.documents_of_each(asked, found, lines, 3))
        return [(df.dtypes, sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())) for df in each]

    mine = told()
    monkeypatch.setattr(scoring, "WIDE", 0)
    theirs = told()
    for (kinds, rows), (kinds_, rows_) in zip(mine, theirs):
        assert sorted(kinds) == sorted(kinds_) and rows == rows_ and rows


def test_scores_in_arrays_of_any_bound(monkeypatch):
    """Bounds of a task's memory change no row, and keywords count as a pattern of all of a question's finds them."""
    import random
    import re

    import pyarrow as pa
    from tallyworks.operators import scoring

    rng = random.Random(4)
    parts = ["abab", "baba", "abab", "cdcd", "dcdc", "abcd", "aaaa", "aa", "b"]
    word = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(1, n)))
    asked = []
    for i in range(70):
        keywords = list(dict.fromkeys(w for w in (word(3) for _ in range(rng.randrange(6))) if len(w) >= 4))
        asked.append((i, keywords, f" {word(2)} topic ", ["topic", word(2)], [(rng.choice([None, "part"]), rng.choice("12"), [word(2), "own"])]))
    docs = []
    for d in range(30):
        key = lambda: {"label": rng.choice([None, "part"]), "number": rng.choice("123")}
        docs.append((d, [{"place": n + 1, "phrase": rng.choice(["topic", "topic abab", "the", None]), "by_id": rng.random() < 0.5, "keys": [key()], "own": [word(2), "own"], "texts": [" ".join(word(4) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(4))]} for n in range(rng.randrange(1, 7))]))
    kind = pa.list_(pa.struct([("place", pa.int32()), ("phrase", pa.string()), ("by_id", pa.bool_()), ("keys", pa.list_(pa.struct([("label", pa.string()), ("number", pa.string())]))), ("own", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([x for _, x in docs], kind)], ["doc_id", "sections"])

    def told():
        each = []
        for rows, more in ((scoring.section_rows, ()), (scoring.best_rows, (2,)), (scoring.document_rows, (3,))):
            each.append(sorted((int(q), d, *(int(x[j]) for x in columns)) for q, d, *columns in rows(scoring.Scorer(asked), [batch], *more) for j, q in enumerate(q)))
        return each

    want = told()
    count = {}
    for d, sections in docs:
        for s in sections:
            for i, keywords, *_ in asked:
                each = [len(re.findall("|".join(keywords), line)) for line in s["texts"]] if keywords else []
                count[i, d, s["place"]] = (sum(each), sum(n > 0 for n in each))
    assert {(q, d, place): (n, hits) for q, d, place, _, _, n, hits in want[0] if n} == {k: v for k, v in count.items() if v[0]}
    for name, value in (("CELLS", 1), ("CELLS", 300), ("WORDS", 1), ("VECTOR_CELLS", 1), ("TITLES", 1), ("RANKED", 1), ("TOLD", 1), ("FEW_HOLDERS", 0)):
        with monkeypatch.context() as m:
            m.setattr(scoring, name, value)
            assert told() == want


def test_keywords_are_counted_as_by_the_join(spark, monkeypatch):
    """Questions that go to every task count what the join of many questions counts: inside words, none overlapping another, in the question's order."""
    from tallyworks.operators import substrings as u

    asked = spark.createDataFrame([(1, ["abcd", "bcdef", "topic"]), (2, ["bcdef", "abcd"]), (3, []), (4, ["aaaa"])], "question_id long, keywords array<string>")
    rows = [(1, ["abcdef bcdef", "nothing", "topics: topictopic_abcd"]), (2, []), (3, ["aaaaaaaaa aaaa", "aaaa", "a-abcd"]), (4, None), (5, [None, "bcd efg"])]
    texts = spark.createDataFrame(rows, "id long, texts array<string>")
    order = lambda df: sorted((r.id, r.question_id, r.n, r.lines) for r in df.collect())
    few = order(u.keyword_sums(asked, texts))
    assert few == [(1, 1, 6, 2), (1, 2, 3, 2), (3, 1, 1, 1), (3, 2, 1, 1), (3, 4, 4, 2)]
    for most in ("AT_ONCE", "REMEMBERED"):
        hits, ids, lines = u._Hits([list(r.keywords) for r in asked.collect()]), [1, 2, 3, 4], [r[1] for r in rows]
        monkeypatch.setattr(u, most, 1)
        told = u.count_keywords(u.pa.array(lines, u.pa.list_(u.pa.string())), hits, ids).to_pylist()
        assert sorted((i + 1, *x) for i, t in enumerate(told) for x in zip(t["question_id"], t["n"], t["lines"])) == few
    monkeypatch.setattr(u, "FEW", 1)
    assert order(u.keyword_sums(asked, texts)) == few


@pytest.mark.parametrize("name", ["d10_search_summary", "d21_line_search"])
def test_line_search_shuffles_no_hits(name, spark, sf):
    """A line meets its section before the questions; hits are counted by document, and only heads are ranked."""
    text = plan(catalog.queries()[name](spark, sf)).split("\n")
    for i, line in enumerate(text):
        if "Exchange" in line and "question_id" in line:
            assert "doc_id" not in line and "line_no" not in line
    if name == "d21_line_search":
        assert not [line for line in text[: next(i for i, line in enumerate(text) if "Generate explode" in line)] if "Exchange" in line or "Join" in line]


def test_recurrences_meet_heads_only(spark, sf):
    """A signal meets the heads of its value's records: no window ranks pairs of a signal and a record."""
    text = plan(catalog.queries()["m06_recurrences"](spark, sf)).split("\n")
    assert not [line for line in text[: next(i for i, line in enumerate(text) if "Join" in line)] if "Window" in line]


@pytest.mark.parametrize("versions, owned, span", [(True, True, 200), (True, True, 6), (True, False, 50), (False, True, 60), (False, False, 60)])
def test_recurrences_by_brute_force(spark, versions, owned, span):
    """Heads of values and of blocks of time leave the first records that hold at a signal's time and aren't its session's."""
    import random

    from tallyworks.operators import mining as m

    rng = random.Random(1)
    records = []
    for _ in range(300):
        made, text = rng.randrange(-20, span), rng.choice("abc") * 2 + rng.choice("xyz") * 2 + rng.choice("xyz")
        until = None if rng.random() < 0.15 else made + int(rng.random() ** 3 * span)
        records.append((f"r{rng.randrange(40):02}", text, f"s{rng.randrange(6)}" if rng.random() < 0.9 else None, made, until))
    keys = {(f"s{rng.randrange(8)}", "path", v) for v in ("aa", "bb", "cc", "xx", "yyz", "aaxx", "q") for _ in range(20)}
    signals = [(*k, rng.randrange(-5, span + 30)) for k in sorted(keys)]
    want = {}
    for session, kind, value, begun in signals:
        best = {}
        for record, text, of, made, until in records:
            if value in text and made < begun and not (versions and until is not None and begun > until) and not (owned and of == session):
                best[record] = min(best.get(record, made), made)
        if best:
            want[session, kind, value] = sorted(best, key=lambda x: (best[x], x))[: m.MATCHED]
    columns = ["id", "text", *["session_id"] * owned, "made", *["until"] * versions]
    told = spark.createDataFrame(records, "id string, text string, session_id string, made long, until long").select(*columns)
    asked = spark.createDataFrame(signals, "session_id string, kind string, value string, begun long")
    assert {(r.session_id, r.kind, r.value): list(r.matched) for r in m.recurrences(asked, told).collect()} == want


@pytest.mark.parametrize("name", ["a13_entity_gate", "a14_gates", "a17_audit_rows", "a17_distil_job", "m01_gate_verdicts"])
def test_a_raw_text_is_read_once_by_each_vocabulary(name, spark, sf):
    """The side of a vocabulary is a column that the distillate and the gates share; a log is split into lines once."""
    text = plan(catalog.queries()[name](spark, sf))
    for side in (r"\\berror TS", "build: Done", "npm ERR!"):
        assert len(re.findall(r"RLIKE\(raw#\d+, [^\n]*?" + re.escape(side.replace("\\\\", "\\")), text)) <= 1, side
    assert len(re.findall(r"split\(raw#", text)) <= 1


def test_hits_are_sorted_once_for_their_number_and_once_for_the_zoom(spark, sf, duck, monkeypatch):
    """Hits are shuffled once, without their text, and many of them are dealt to more tasks; the rows stay those of the SQL."""
    from conftest import compare
    from tallyworks.plans import views

    text = plan(catalog.queries()["a25_text_zoom"](spark, sf)).split("\n")
    join = next(i for i, line in enumerate(text) if "HashJoin" in line or "MergeJoin" in line)
    shuffles = [i for i, line in enumerate(text[:join]) if "Exchange" in line]
    assert len(shuffles) == 1 and len([line for line in text[: shuffles[0]] if " Sort [" in line]) == 2
    assert not [line for line in text[shuffles[0] :] if "concat(" in line]
    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    query = catalog.queries()["a25_text_zoom"](spark, sf)
    assert "REPARTITION_BY_NUM" in plan(query)
    compare(query, catalog.oracle_sql()["a25_text_zoom"], duck)


def test_extents_read_the_lines_once(spark, sf, duck, monkeypatch):
    """No join of a file's lines with its depths and its last line, which read all lines three times; many lines are dealt to more tasks."""
    from conftest import compare
    from tallyworks.plans import views

    text = plan(catalog.queries()["d27_extents"](spark, sf))
    assert "Join" not in text and text.count("FileScan") == 1
    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    query = catalog.queries()["d27_extents"](spark, sf)
    assert "REPARTITION_BY_NUM" in plan(query)
    compare(query, catalog.oracle_sql()["d27_extents"], duck)


def test_extents_by_brute_force(spark):
    """Nested, unindented and closing lines, tabs, blank lines, files without a declaration or a name."""
    import random
    import re

    from tallyworks.functions import patterns
    from tallyworks.operators import code

    rng = random.Random(2)
    said = ["export const a = 1", "export async function f()", "class C:", "def g():", "call()", "}", "});", "]", "", "　x", "# export const b"]
    texts = {f"f{k}": [rng.choice(["", " ", "  ", "\t", "\t ", "    "]) + rng.choice(said) for _ in range(rng.randrange(1, 60))] for k in range(60)}
    texts |= {"none": ["x", "  y"], "blank": ["", " \t"]}
    want = set()
    for path, lines in texts.items():
        rows = [(i + 1, len(t) - len(t.lstrip(" \t")), t) for i, t in enumerate(lines) if t.strip(" \t")]
        for at, (line_no, depth, t) in enumerate(rows):
            exported, plain = re.search(patterns.DECLARATION, t, re.A), re.search(patterns.PLAIN_DECLARATION, t.strip(" \t"), re.A)
            if exported or plain:
                after = next((r for r in rows[at + 1 :] if r[1] <= depth), None)
                end = rows[-1][0] if after is None else after[0] if after[1] == depth and re.match(code.CLOSERS, after[2].strip(" \t")) else after[0] - 1
                want.add((path, (exported or plain)[2], line_no, end))
    rows = [(path, i + 1, t) for path, lines in texts.items() for i, t in enumerate(lines)] + [("f1", 99, None), (None, 1, "class C:")]
    got = code.extents(spark.createDataFrame(rows, "path string, line_no int, line string"))
    assert dict(got.dtypes)["end_line"] == "int"
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(want) and len(want) > 300
