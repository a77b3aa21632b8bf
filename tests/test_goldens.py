"""Hand-computed values and edge cases on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tallyworks.functions import dims
from tallyworks.operators import bench, distill, ledger, usage
from tallyworks.operators import sections as s
from tallyworks.sources import transcripts

TURN = "session_id string, turn int, model string, tools array<string>, " + ", ".join(f"{c} long" for c in usage.COUNTERS)


def turn(session="s", n=1, model="m-mid", tools=(), **counts):
    return (session, n, model, list(tools), *[counts.get(c, 0) for c in usage.COUNTERS])


def test_small_session(spark):
    """Three turns: 2,160 input, 1,470 output, 15,100 cache read, 920 cache write (1 h assumed), 450 thinking."""
    rows = [
        turn(n=1, tools=["Read"], input=1200, output=350, cache_write=800, cache_write_1h=800, cache_write_assumed=800),
        turn(n=2, tools=["Read", "Bash"], input=480, output=620, cache_read=7100, cache_write=120, cache_write_1h=120, cache_write_assumed=120, thinking=450),
        turn(n=3, input=480, output=500, cache_read=8000),
    ]
    t = spark.createDataFrame(rows, TURN)
    totals = usage.session_totals(t).first()
    assert (totals["input"], totals["output"], totals["cache_read"], totals["cache_write"], totals["thinking"]) == (2160, 1470, 15100, 920, 450)
    assert totals["total"] == 20100
    cost = usage.session_cost(t, dims.frame(spark, "prices")).first()
    assert cost["cost"] == pytest.approx(0.04533)
    wh = usage.session_energy(t, dims.frame(spark, "energy"), dims.frame(spark, "curve"))
    first = wh.first()
    assert (first["wh_base"], first["wh_low"], first["wh_high"]) == pytest.approx((6.03, 2.01, 20.1))
    assert usage.with_carbon(wh, dims.frame(spark, "grid")).first()["g_base"] == pytest.approx(6.03 / 1000 * 473)
    assert usage.with_carbon(wh, dims.frame(spark, "grid"), "IN").first()["g_base"] == pytest.approx(6.03 / 1000 * 708)


def test_unknown_region_raises(spark):
    energy = spark.createDataFrame([("s", 1.0, 1.0, 1.0, "")], "session_id string, wh_base double, wh_low double, wh_high double, unestimated string")
    with pytest.raises(Exception, match="unknown grid region"):
        usage.with_carbon(energy, dims.frame(spark, "grid"), "XX").collect()


def test_context_score(spark):
    t = spark.createDataFrame([turn()], TURN)
    audit = spark.createDataFrame(
        [("s", "distill", 9000, 900, None, None), ("s", "serve-raw", 100, 100, None, None)],
        "session_id string, action string, bytes_in long, bytes_out long, rule string, prepared boolean",
    )
    assert usage.context_score(t, audit).first()["context_score"] == 89
    none = usage.context_score(t, audit.where("false")).first()
    assert none["context_score"] is None and none["context_reason"] == "no audit events"


def record(i, **message):
    return json.dumps({"type": "assistant", "sessionId": "x", "message": message})


def test_folding_and_tolerance(spark):
    use = {"input_tokens": 5, "output_tokens": -1, "cache_creation_input_tokens": 10, "cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 3}}
    tool = [{"type": "tool_use", "name": "Read"}]
    lines = [
        record(0, id="a", model="m", usage=use, content=tool),
        record(1, id="a", model="other", usage={"input_tokens": 99}, content=tool),
        "not json", "{}", '{"type": 3}', '{"type": "new"}', "", "null", '"text"',
        record(2, content="plain"),
    ]
    df = spark.createDataFrame([("f.jsonl", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    c = transcripts.classify(transcripts.tidy_lines(df))
    n = transcripts.line_counts(c).first()
    assert (n["lines"], n["known"], n["unknown_type"], n["malformed"]) == (9, 3, 1, 5)
    turns = {r["first_line"]: r for r in transcripts.fold_turns(c).collect()}
    assert len(turns) == 2
    a = turns[0]
    assert (a["input"], a["output"], a["model"], a["tools"]) == (5, 0, "m", ["Read", "Read"])
    assert (a["cache_write_5m"], a["cache_write_1h"], a["cache_write_assumed"]) == (0, 10, 10)
    assert turns[9]["model"] == "unknown-model"


def test_ledger_sums(spark):
    rows = [("ask", 9000, 100), ("serve", 4000, 1000), ("serve", 4000, 1000), ("zoom", 2000, 1000)]
    lines = spark.createDataFrame([(f"l{i}", "c", *r) for i, r in enumerate(rows)], "id string, corpus string, kind string, raw_bytes long, served_bytes long")
    done = ledger.complete_lines(lines, ledger.reference_rate(dims.frame(spark, "prices"), dims.frame(spark, "energy"), "m-mid"))
    r = ledger.receipts(done).first()
    assert (r["asks"], r["raw_tokens"], r["avoided_tokens"]) == (1, 2500, 1750)


def test_redaction_in_sequence(spark):
    secret = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh"
    df = spark.createDataFrame([(1, f"{secret}\nexport MY_TOKEN=ghp_{'a' * 24}\n{jwt}"), (2, None), (3, "")], "id int, text string")
    out = {r["id"]: r for r in distill.redact(df).collect()}
    kinds = {f["kind"]: f["count"] for f in out[1]["findings"]}
    assert kinds == {"private-key-block": 1, "github-token": 1, "jwt": 1, "env-assignment": 1}
    assert "export MY_TOKEN=[REDACTED:env-assignment]" in out[1]["text"]
    again = distill.redact(spark.createDataFrame([(1, out[1]["text"])], "id int, text string")).first()
    assert "ghp_" not in again["text"]
    assert out[3]["findings"] == [] and out[2]["text"] is None


def test_size_and_entity_gates(spark):
    df = spark.createDataFrame([("", "", ""), ("x" * 100, "src/a.ts:3", "see src/a.ts:3")], "raw string, region string, distilled string")
    rows = distill.size_gate(distill.entity_gate(df)).collect()
    assert [r["size_ok"] for r in rows] == [False, True]
    assert [r["entity_ok"] for r in rows] == [True, True]


def test_command_and_read_tiers(spark):
    df = spark.createDataFrame([("npx vitest run", 100, False), ("npm run build", 20_000, False), ("ls", 70_000, False), ("ls", 70_000, True)], "c string, n long, s boolean")
    rows = df.select(distill.route(F.col("c")), distill.read_tier(F.col("n"), F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("test-output", "pass"), ("build-log", "capped"), ("generic-stdout", "skeleton"), ("generic-stdout", "pass")]


def test_command_routes_and_signatures(spark):
    """Values as the fixed words and forms give them."""
    from tallyworks.operators import mining

    commands = ["npm run verify", "npm run check", "tsc --noEmit && vitest", "cargo fmt", "npx pytest"]
    got = spark.createDataFrame([(c,) for c in commands], "c string").select(distill.route(F.col("c")).alias("p")).collect()
    assert [r.p for r in got] == ["test-output", "test-output", "build-log", "generic-stdout", "generic-stdout"]
    lines = ["a.ts(10,5): error  TS1", "a.ts:10:5 x", "b.ts:7"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(mining.signature(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == ["a.ts(#): error TS1", "a.ts:# x", "b.ts:#"]


def test_latest_session_of_project(spark):
    s = spark.createDataFrame([("/a", "s1", 1), ("/a", "s2", 2), ("/a/b", "s3", 1)], "dir string, session_id string, ts int")
    p = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/q",)], "project string")
    assert {r["project"]: r["session_id"] for r in usage.latest_sessions(s, p).collect()} == {"/a/b/c": "s3", "/a/x": "s2"}


def test_sequence_violations(spark):
    tasks = spark.createDataFrame([("t1", "r", "c1", "slope"), ("t2", "r", "c2", "slope"), ("t3", "r", "c1", "slope")], "task string, repo string, commit string, tier string")
    seq = spark.createDataFrame([("t1",), ("t2",), ("t9",)], "task string")
    got = {(r["task"], r["violation"]) for r in bench.sequence_violations(seq, tasks).collect()}
    assert ("t9", "unknown task") in got and ("t3", "slope task not in the sequence") in got
    assert ("t1", "more than one repository pin") in got


def test_rate_validation(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0), (1.0, 2.0, 3.0), (None, 0.0, 1.0)], "base double, low double, high double")
    assert [r["valid"] for r in dims.validated(df, "base", "low", "high").collect()] == [True, False, False]


def test_rewrite_rules(spark):
    """One cd and merged streams pass, composition and mutation don't."""
    cases = {
        "cd app && npx vitest run": "test", "tsc -p . 2>&1": "typecheck", "npm run build > out": None, "npm install && npm test": None,
        "cd a && cd b && jest": None, "node scripts/verify-a.mjs": "node-script", "node run.js": None, "wrap -c 'npm test'": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.rule for r in df.select("c", distill.rewrite_rule(F.col("c"), ("wrap ",)).alias("rule")).collect()}
    assert got == cases


def test_records_are_tolerant(spark):
    """Blank lines aren't counted, bad ones are, none raises; a wrong type is as bad as no JSON."""
    from tallyworks.sources import records

    good = {"id": "e", "timestamp": "2024-01-01T00:00:00.123Z", "module": "m", "action": "zoom", "reason": "r"}
    values = [good, {**good, "bytesIn": 3, "sessionId": "s"}, {**good, "bytesIn": 1.5}, {**good, "id": 7}, {**good, "timestamp": "yesterday"}, [], {**good, "reason": ""}]
    lines = [*map(json.dumps, values), "{", " ", "\t\r", None]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    checked = records.audit_lines(df)
    assert tuple(records.malformed(checked).first()) == ("f", 8, 6)
    assert [r["line_no"] for r in records.audit_events(df, session="s").collect()] == [1]
    assert records.audit_events(df, actions=("drop",)).count() == 0
    assert records.candidate_records(df).count() == 0


def test_files_and_sinks(spark, tmp_path):
    """Lines of files keep their order; a folder is catalogued; artifacts are redacted on their way to the sink."""
    from tallyworks.sources import records

    for name in ("a/x.MD", "b.py", "node_modules/y.md", "c"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"one\r\n\r\ntwo\nthree")
    files = {r["path"]: (r["status"], r["bytes"]) for r in records.scan_folder(spark, f"{tmp_path}/in").collect()}
    assert files == {"a/x.MD": ("document", 16), "b.py": ("source", 16), "c": ("catalogued", 16)}
    (tmp_path / "long.jsonl").write_text("".join(f"line {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = transcripts.read_lines(spark, f"{tmp_path}/long.jsonl")
        assert lines.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no"))).count() == 0 and lines.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line_no"] for r in transcripts.read_lines(spark, f"{tmp_path}/in/b.py").orderBy("line_no").collect()] == [0, 2, 3]
    art = spark.createDataFrame([("a", "API_KEY=value1", "2024-01-01")], "artifact_id string, text string, date string")
    events = art.selectExpr("artifact_id AS id", "'s1' AS session_id", "timestamp_ntz'2024-01-31 10:00:00' AS ts")
    for _ in range(2):
        records.write_artifacts(art, f"{tmp_path}/art")
        records.write_audit(events, f"{tmp_path}/audit")
    stored = spark.read.parquet(f"{tmp_path}/art")
    assert stored.count() == 2 and stored.where(F.contains("text", F.lit("value1"))).count() == 0
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2


def test_confidence_bands(spark):
    from tallyworks.operators import sections

    schema = "question_id int, evidence long, section_refs long, resolved_refs long, heading_match string, terms_matched long, terms_total long, ambiguous long, incomplete boolean"
    rows = [
        (1, 0, 0, 0, "none", 0, 0, 0, False), (2, 3, 1, 0, "exact", 2, 2, 0, False), (3, 3, 1, 1, "none", 1, 2, 0, False),
        (4, 3, 0, 0, "none", 0, 3, 0, False), (5, 3, 1, 1, "none", 2, 2, 1, False), (6, 3, 0, 0, "strong", 2, 2, 0, True), (7, 3, 0, 0, "partial", 0, 3, 0, False),
    ]
    got = {r.question_id: r.band for r in sections.ask_confidence(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "low", 2: "low", 3: "high", 4: "low", 5: "medium", 6: "medium", 7: "medium"}


def test_recurrence_finds_short_and_inner_values(spark):
    from tallyworks.operators import mining

    s = spark.createDataFrame([("s", "command", v, 5) for v in ("ls", "a", "npm run build", "absent", "1.ts")], "session_id string, kind string, value string, begun int")
    r = spark.createDataFrame([("r1", "xnpm run buildx", 1), ("r2", "ls -l f1.ts", 2), ("r3", "ls", 9), ("r4", "", 0)], "id string, text string, seq int")
    got = {x["value"]: x["matched"] for x in mining.recurrences(s, r).collect()}
    assert got == {"ls": ["r2"], "npm run build": ["r1"], "1.ts": ["r2"]}


def test_rollups_with_lines_without_document(spark):
    """An ask line without a document adds nothing to documents and one line to its corpus; documents of one name stay apart by corpus."""
    rows = [
        ("c", "s1", "2026-01-02 10:00:00", "ask", None, 100, 40, 60, 0.1), ("c", "s1", "2026-01-02 10:00:01", "serve", "d", 100, 90, 10, 0.2),
        ("k", "s2", "2026-01-03 10:00:00", "serve", "d", 50, 45, 5, 0.1),
    ]
    df = spark.createDataFrame(rows, "corpus string, session_id string, ts string, kind string, document string, raw_tokens long, served_tokens long, avoided_tokens long, cost double")
    df = df.withColumn("ts", F.to_timestamp_ntz("ts"))
    got = {(r.corpus, r.scope, r.key): (r.lines, r.asks, r.sessions, r.avoided_tokens) for r in ledger.rollup_totals(df).collect()}
    assert got["c", "corpus", ""] == (2, 1, 1, 10) and got["c", "document", "d"] == (1, 0, 1, 10) and got["k", "document", "d"] == (1, 0, 1, 5)
    assert got["c", "day", "2026-01-02"] == (2, 1, 1, 10) and got["c", "session", "s1"] == (2, 1, 1, 10) and len(got) == 10
    assert [(r.corpus, r.document, r.raw_tokens) for r in ledger.documents_rollup(df).collect()] == [("c", "d", 100), ("k", "d", 50)]
    assert [(r.corpus, r.session_id, r.asks) for r in ledger.sessions_rollup(df).collect()] == [("c", "s1", 1), ("k", "s2", 0)]


def test_reference_ranks_above_volume(spark):
    """Of two sections of one number the one whose title the question says is served, though the other says its words more often."""
    text = ["Example 5: Nature-Based Products", "boilerplate claim claim claim claim claim claim", "Example 5: Engineered Bacterium", "one claim about bacteria here", "Claims", "misclaimed reclaims"]
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    found = s.sections(lines, s.headings(lines))
    asked = spark.createDataFrame([(1, "What does Example 5 say of the engineered claim?"), (2, "Explain Example 5"), (3, "the claim of misclaimed things")], "question_id long, question string")
    scores = s.section_scores(asked, found, lines)
    got = {(r.question_id, r.place): (r.tier, r.ref_rank, r.volume, r.hits) for r in scores.collect()}
    assert got[1, 1][:2] == (4, 1)
    assert got[1, 2][:2] == (4, 2) and got[1, 2][2] < got[1, 1][2]
    assert got[2, 1][:2] == (4, 2) and got[2, 2][:2] == (4, 1)
    # occurrences inside words count, none overlapping another: misclaimed is one hit, by the keyword that begins first
    assert got[3, 2][2:] == (4, 3)
    assert [r.place for r in s.best_sections(scores.where("question_id = 1"), 1).collect()] == [2]


def test_confidence_reads_the_questions_own_evidence(spark):
    """A word of another document is no evidence; numbers of references are terms."""
    lines = spark.createDataFrame([(1, 1, "Example 21: Widgets"), (1, 2, "body"), (2, 1, "Other"), (2, 2, "gadget")], "doc_id long, line_no int, line string")
    found = s.sections(lines, s.headings(lines))
    asked = spark.createDataFrame([(1, "gadget in Example 21"), (2, "gadget gizmo")], "question_id long, question string")
    evidence = spark.createDataFrame([(1, "Example 21: Widgets body")], "question_id long, text string")
    got = {r.question_id: (r.evidence, r.section_refs, r.resolved_refs, r.terms_matched, r.terms_total) for r in s.ask_summary(asked, found, evidence).collect()}
    assert got == {1: (1, 1, 1, 2, 3), 2: (0, 0, 0, 0, 2)}


def test_context_discriminates_equal_references(spark):
    """Running page headers are part context; page numbers are none."""
    text = []
    for page in range(6):
        text += ["Nature Products" if page < 3 else "Abstract Ideas", *(["Example 5"] if page in (1, 4) else ["words"]), "some body"]
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    pages = spark.createDataFrame([(1, k + 1, 3 * k + 1, 3 * k + 3) for k in range(6)], "doc_id long, page int, start_line int, end_line int")
    heads = lines.where("line = 'Example 5'").selectExpr("doc_id", "line_no", "'named' AS kind", "2 AS level", "line AS heading")
    found = s.with_context(s.sections(lines, heads), lines, pages)
    assert [(r.place, r.page, r.context) for r in found.orderBy("place").collect()] == [(1, 1, None), (2, 2, "Nature Products"), (3, 5, "Abstract Ideas")]
    asked = spark.createDataFrame([(1, "Example 5 of the abstract ideas")], "question_id long, question string")
    assert [(r.place, r.discriminated, r.candidates) for r in s.ref_resolutions(asked, found).collect()] == [(3, True, 2)]
    first = spark.createDataFrame([(1, k, "- 1 -") for k in range(3)] + [(1, k + 3, "Part  A") for k in range(3)], "doc_id long, page int, header string")
    assert {r.header for r in s.running_headers(first).collect()} == {"Part A"}
    extra = s.sections(lines, lines.where("line_no = 5").selectExpr("doc_id", "line_no", "'extra' AS kind", "1 AS level", "'USPTO 2019 -- Ex. 01' AS heading"))
    assert [r.section_id for r in extra.orderBy("place").collect()] == ["s1", "uspto-2019-ex-01"]
    maps = s.structure_map(s.summaries(lines, found).withColumn("pages", F.lit(6)))
    assert maps.first().text.split("\n")[0] == "document 1: 3 sections, 6 pages" and "§example-5 Example 5 (p.2) — " in maps.first().text


MINING_AUDIT = (
    "id string, ts timestamp_ntz, seq long, session_id string, module string, action string, mode string, verdict string, profile string, path string, input_ref string, command string, query string"
)


def mining_rows(spark):
    """Two sessions: s1 fails, edits and passes, and zooms; s2 meets the same error and the same file."""
    from datetime import datetime, timedelta

    def e(seq, session, action, **kw):
        base = dict.fromkeys(("mode", "verdict", "profile", "path", "input_ref", "command", "query"))
        return {"id": f"e{seq}", "ts": datetime(2026, 1, 1) + timedelta(minutes=seq), "seq": seq, "session_id": session, "module": "zoom" if action == "zoom" else "distill", "action": action, **base, **kw}

    told = []
    for k, session in enumerate(("s1", "s2")):
        o = 20 * k
        told += [
            e(o + 1, session, "rewrite", command="npm run build"), e(o + 2, session, "distill", verdict="fail", profile="build-log", input_ref=f"a{k}"),
            e(o + 3, session, "distill", mode="diff", path="src/a.ts"), e(o + 4, session, "distill", mode="diff", path="src/b.ts"),
            e(o + 5, session, "distill", verdict="pass", profile="build-log", input_ref="ok"), e(o + 6, session, "distill", mode="diff", path="src/late.ts"),
            e(o + 7, session, "zoom", input_ref="a0", query="sym"), e(o + 8, session, "zoom", input_ref="a0", query=f"sym{k}"), e(o + 9, session, "zoom", input_ref="none"),
        ]
    names = [x.split()[0] for x in MINING_AUDIT.split(", ")]
    art = [("a0", "src\\a.ts", "VERDICT: fail\nfirst error: src/a.ts(10,5): error TS1: x", "raw"), ("a1", None, None, "ok\nsrc/a.ts(99,1): error TS1: x"), ("ok", None, "VERDICT: pass", "fine")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in told], MINING_AUDIT), spark.createDataFrame(art, "artifact_id string, path string, distilled string, raw string")


def test_mining_from_audit_rows_to_candidates(spark):
    """The same error at another place is the same candidate; a second run over the same rows changes nothing."""
    import hashlib

    from tallyworks.operators import mining

    audit, art = mining_rows(spark)
    begun = audit.groupBy("session_id").agg(F.min("seq").alias("seq"))
    first = mining.mined_candidates(audit, art)
    mined = mining.mined_candidates(audit, art, mining.record_versions(first, begun))
    empty = spark.createDataFrame([], mining.STATE)
    state, counts = mining.merge_mined(empty, mined)
    got = {r.key: r for r in state.collect()}
    fix = got["error-fix:build-log:src/a.ts(#): error TS1: x"]
    assert fix.id == "cand-" + hashlib.sha256(b"error-fix\nerror-fix:build-log:src/a.ts(#): error TS1: x").hexdigest()[:8]
    assert fix.occurrences == 2 and fix.evidence == ["e2", "e5", "e22", "e25"] and fix.sessions == ["s1", "s2"]
    details = json.loads(fix.details)
    assert details["changedFiles"] == ["src/a.ts", "src/b.ts"] and details["command"] == "npm run build"
    spot = got["zoom-hotspot:src/a.ts"]
    assert (spot.occurrences, spot.queries, spot.evidence) == (2, ["sym", "sym0", "sym1"], ["e7", "e8", "e27", "e28"])
    assert json.loads(spot.details)["targetKind"] == "file" and got["zoom-hotspot:unknown-artifact"].occurrences == 2
    # s2 meets what s1 recorded; s1 has nothing before it, and its own records are none to it
    again = {k: r for k, r in got.items() if r.type == "recurrence"}
    assert set(again) == {"recurrence:error-signature:src/a.ts(#): error TS1: x", "recurrence:command:npm run build", "recurrence:path:src/a.ts", "recurrence:path:src/b.ts"}
    assert all(r.sessions == ["s2"] for r in again.values())
    assert tuple(counts.first()) == (10, 3, 0)
    kept = spark.createDataFrame(state.collect(), state.schema)
    twice, counts = mining.merge_mined(kept, mined)
    assert sorted(map(str, twice.collect())) == sorted(map(str, kept.collect())) and tuple(counts.first()) == (10, 0, 10)


def test_merge_keeps_bounds(spark):
    """Sixty sessions of one candidate: sixty occurrences, the last fifty sessions, the first twenty events."""
    from datetime import datetime, timedelta

    from tallyworks.operators import mining

    rows = [(f"s{i:02d}", datetime(2026, 1, 1) + timedelta(hours=i), 1, "t", "k", f"sig{i}", [f"e{i:02d}"], [f"q{i % 3}"], str(i)) for i in range(60)]
    mined = spark.createDataFrame(rows, mining.MINED)
    half, _ = mining.merge_mined(spark.createDataFrame([], mining.STATE), mined.where("session_id < 's30'"))
    r = mining.merge_mined(half, mined.where("session_id >= 's30'"))[0].first()
    assert (r.occurrences, r.sessions[0], r.sessions[-1], len(r.sessions)) == (60, "s10", "s59", 50)
    assert r.evidence == [f"e{i:02d}" for i in range(20)] and r.queries == ["q0", "q1", "q2"] and (r.signature, r.details) == ("sig0", "59")
    records = spark.createDataFrame([("r", ["x"] * 19, 19), ("q", ["x"], 1)], "id string, counted array<string>, contradictions long")
    found = spark.createDataFrame([("r", f"s{i}") for i in range(3)], "id string, session_id string")
    got = {x.id: (x.contradictions, len(x.counted), x.counted[-1]) for x in mining.count_contradictions(records, found).collect()}
    assert got == {"r": (22, 20, "s2"), "q": (1, 1, "x")}
    paths = spark.createDataFrame([("x/src/a.ts",), ("b.ts",)], "path string")
    directives = spark.createDataFrame([("src/a.ts", 2), ("a.ts", 1), ("c.ts", 0)], "target string, ord int")
    assert [(r.path, r.target) for r in mining.directive_matches(paths, directives).collect()] == [("x/src/a.ts", "a.ts")]


def test_months_and_sessions_prune_folders(spark, tmp_path):
    """A month's or a session's scan lists only folders that can hold it, by the plan's partition filters."""
    from tallyworks.sources import records

    rows = [(f"s{i % 40}", f"2026-{1 + i % 3:02d}-{1 + i % 28:02d} 10:00:00", i) for i in range(400)]
    df = spark.createDataFrame(rows, "session_id string, ts string, n int").withColumn("ts", F.to_timestamp_ntz("ts"))
    records.write_by_month(df, f"{tmp_path}/ledger")
    files = lambda d: {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    month = records.read_by_month(spark, f"{tmp_path}/ledger", month="2026-02")
    assert month.count() == df.where("month(ts) = 2").count() and files(month) and all("month=2026-02" in f for f in files(month))
    one = records.read_by_month(spark, f"{tmp_path}/ledger", session="s7", day="2026-02-08")
    assert sorted(r.n for r in one.collect()) == sorted(i for s_, t, i in rows if s_ == "s7" and t.startswith("2026-02-08")) and one.columns == df.columns
    assert len(files(one)) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in filters and "bucket" in filters


def test_rate_files_name_their_sources(spark, tmp_path):
    """A good file gives the table; each bad row raises with its key and why."""
    good = {"model": "m", "p_in": 1.0, "p_out": 2.0, "p_read": 0.1, "p_5m": 1.25, "p_1h": 2.0, "verified": True, "source": "https://prices.example/m"}

    def load(*rows, name="prices"):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return dims.load_rates(spark, str(path), name)

    assert load(good, good | {"model": "n"}).where("source <> ''").count() == 2
    for row, why in (
        (good | {"source": " "}, "m: no source"), (good | {"p_out": -1}, "m: p_out is missing or negative"), (good | {"model": ""}, ": no model"),
        ({k: v for k, v in good.items() if k != "p_1h"}, "p_1h is missing"), (good | {"p_inn": 2}, "unknown fields p_inn"), ("{bad", "not a row"),
    ):
        with pytest.raises(ValueError, match=why):
            load(good | {"model": "n"}, row)
    with pytest.raises(ValueError, match="m: stands 2 times"):
        load(good, good)
    energy = {"class": "c", "model": "m", "wh_base": 2.0, "wh_low": 1.0, "wh_high": 3.0, "source": "s"}
    assert load(energy, name="energy").count() == 1
    with pytest.raises(ValueError, match="out of order"):
        load(energy | {"wh_low": 2.5}, name="energy")
