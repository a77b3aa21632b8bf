"""Views over the standard tables that stand for session logs, audits, artifacts and ledgers.

The text is the same for Spark and for DuckDB, so that an oracle can inline it.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from ..functions import dims

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_usage_turns": (
        ("conversations",),
        """SELECT concat('s', conv_id) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn,
 CASE conv_id % 4 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-mid' WHEN 2 THEN 'm-small' ELSE 'm-none' END AS model,
 CASE turn % 4 WHEN 1 THEN 'Read' WHEN 3 THEN 'Read,Bash' ELSE '' END AS tools,
 prev_tok AS input, tok AS output, CAST(ctx AS BIGINT) AS cache_read, prev_tok AS cache_write,
 CASE WHEN conv_id % 3 = 0 THEN prev_tok ELSE 0 END AS cache_write_5m,
 CASE WHEN conv_id % 3 = 0 THEN 0 ELSE prev_tok END AS cache_write_1h,
 CASE WHEN conv_id % 3 = 2 THEN prev_tok ELSE 0 END AS cache_write_assumed,
 CASE WHEN turn % 5 = 0 THEN tok ELSE 0 END AS thinking
FROM (SELECT conv_id, turn, role, tok,
  coalesce(lag(tok) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS prev_tok,
  coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS ctx
  FROM (SELECT conv_id, turn, role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok FROM conversations) t) w
WHERE role = 'assistant'""",
    ),
    "v_audit": (
        ("events",),
        """SELECT concat('e', event_id) AS id, ts, event_id AS seq, concat('s', user_id) AS session_id,
 CASE event_type WHEN 'click' THEN 'zoom' WHEN 'view' THEN 'serve' WHEN 'signup' THEN 'pretooluse' ELSE 'distill' END AS module,
 CASE WHEN event_type = 'click' THEN 'zoom' WHEN event_type = 'signup' THEN 'rewrite'
      WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'passthrough' WHEN event_type = 'view' AND event_id % 2 = 1 THEN 'serve-raw' ELSE 'distill' END AS action,
 CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN CASE WHEN event_id % 2 = 1 THEN 'full' ELSE 'diff' END END AS mode,
 CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' END AS verdict,
 CASE WHEN k % 2 = 0 THEN 'build-log' ELSE 'test-output' END AS profile,
 concat('src/f', k % 7, '.ts') AS path, concat('a', event_id - k % 3) AS input_ref,
 CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'build' ELSE 'read-mirror' END END AS rule,
 CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN 'npm run build' WHEN 1 THEN 'cd app && vitest run' ELSE 'rm -rf dist && npm run build' END END AS command,
 CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 4 = 1 END AS prepared,
 CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN concat('sym', k % 5) END AS query,
 CASE WHEN event_type = 'click' THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS bytes_in,
 CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' AND event_id % 2 = 1 THEN CAST(floor(value * 100) AS BIGINT) ELSE CAST(floor(value * 10) AS BIGINT) END AS bytes_out
FROM (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e""",
    ),
    "v_error_signature": (
        ("events",),
        """SELECT concat('a', event_id) AS artifact_id, concat('src/f', event_id % 7, '.ts(', event_id, ',5): error TS', 2300 + event_id % 4, ': failed check') AS first_error_line
FROM events""",
    ),
    "v_log_lines": (
        ("lineitem",),
        """SELECT l_orderkey AS artifact_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no,
 CASE WHEN l_returnflag = 'R' THEN concat('src/p', l_partkey % 50, '.ts(', l_linenumber, ',5): error TS', 2300 + l_suppkey % 20, ': Cannot find name "n', l_suppkey % 9, '".')
      WHEN l_linestatus = 'O' THEN concat('packages/p', l_partkey % 9, ' build: Done')
      ELSE concat('compiling unit ', l_partkey) END AS line
FROM lineitem""",
    ),
    "v_test_lines": (
        ("lineitem",),
        """SELECT l_orderkey AS artifact_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no,
 CASE WHEN l_returnflag = 'R' THEN concat('FAIL src/p', l_partkey % 3, '.test.ts') WHEN l_returnflag = 'A' THEN concat('assertionerror: EXPECTED ', l_quantity, ' received ', l_tax)
      WHEN l_linestatus = 'O' THEN concat('Tests  ', l_linenumber, ' passed (', l_linenumber, ')') ELSE concat('   Duration ', l_linenumber, 's') END AS line
FROM lineitem""",
    ),
    "v_commands": (
        ("events",),
        """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'npm run verify' WHEN 1 THEN 'tsc --noEmit && vitest' WHEN 2 THEN 'cargo fmt' WHEN 3 THEN 'npm run check' WHEN 4 THEN 'npx jest a'
  WHEN 5 THEN 'pnpm rebuild' WHEN 6 THEN 'npm run build' WHEN 7 THEN 'latest' ELSE concat('node test ', user_id) END AS command,
 concat('src/f', user_id, CASE event_id % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' WHEN 3 THEN '.docx' WHEN 4 THEN '.html' WHEN 5 THEN '.rs' WHEN 6 THEN '' ELSE '.cjs' END) AS path FROM events""",
    ),
    "v_secret_lines": (
        ("documents",),
        """SELECT doc_id, CASE doc_id % 6
 WHEN 0 THEN concat('key AKIA', upper(substr(concat('ABCDEFGHIJKLMNOP', doc_id), 1, 16)), ' end')
 WHEN 1 THEN concat('ghp_', substr('abcdefghijklmnopqrstuvwxyz', 1, 24), doc_id)
 WHEN 2 THEN concat('Authorization: Bearer abcdefghijklmnop', doc_id)
 WHEN 3 THEN concat('API_KEY=value', doc_id)
 WHEN 4 THEN concat('sk-abcdefghijklmnopqrstuvwx', doc_id)
 ELSE concat('plain line ', doc_id) END AS line, text FROM documents""",
    ),
    "v_serves": (
        ("events",),
        """SELECT concat('s', user_id) AS session_id, concat('f', CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 7) AS path, ts, event_id AS seq,
 concat('c', CAST(floor(value) AS BIGINT) % 3) AS content FROM events""",
    ),
    "v_ledger": (
        ("events", "documents"),
        """SELECT concat('l', e.event_id) AS id, e.event_id AS seq, concat('e', e.event_id) AS audit_id, e.ts, concat('corpus', e.user_id % 3) AS corpus, concat('s', e.user_id) AS session_id,
 CASE e.event_type WHEN 'signup' THEN 'ask' WHEN 'click' THEN 'zoom' ELSE 'serve' END AS kind, CASE WHEN e.event_type <> 'signup' THEN concat('doc', d.doc_id) END AS document,
 d.n_chars AS raw_bytes, CASE WHEN e.event_type = 'click' THEN d.n_chars ELSE CAST(floor(d.n_chars / 10) AS BIGINT) END AS served_bytes,
 CASE WHEN e.event_type = 'signup' THEN CASE e.event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END END AS confidence
FROM events e JOIN (SELECT max(doc_id) + 1 AS n FROM documents) m ON m.n > 0 JOIN documents d ON d.doc_id = e.event_id % m.n""",
    ),
    "v_runs": (
        ("conversations",),
        """SELECT concat('task', conv_id % 10) AS task, CASE WHEN conv_id % 20 < 10 THEN 'baseline' ELSE 'treated' END AS variant, CAST(floor(conv_id / 20) AS BIGINT) AS rep,
 concat('s', conv_id) AS session_id, conv_id % 7 <> 0 AS success FROM (SELECT DISTINCT conv_id FROM conversations) x""",
    ),
    "v_search_hits": (
        ("lineitem", "orders"),
        """SELECT o.o_custkey AS artifact_id, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS INT) AS line_no,
 concat('src/f', l.l_suppkey % 25, '.ts:', l.l_linenumber, ': match n', l.l_partkey) AS line
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    ),
    "v_questions": (
        ("benchmark",),
        """SELECT item_id AS question_id, concat('What about section ', item_id % 5 + 1, ' Topic ', item_id % 9, CASE item_id % 3 WHEN 0 THEN concat(' or §', item_id % 4 + 1) ELSE '' END, ' ', text) AS question FROM benchmark""",
    ),
}

#: Views whose text differs between the engines: line tables over documents.
LINES_DUCKDB = """SELECT doc_id, CAST(i AS INT) AS line_no, parts[i] AS line FROM
 (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) x"""
HEADED = """SELECT doc_id, line_no, CASE WHEN line_no % 5 = 1
  THEN concat(CAST(floor((line_no + 4) / 5) AS INT), '. Topic ', doc_id % 9, ' Part ', line_no) ELSE line END AS line
FROM v_doc_lines"""


def duckdb(*names: str) -> str:
    """``WITH`` clause that defines the named views and dimensions."""
    parts = []
    for name in names:
        if name in VIEWS:
            parts.append(f"{name} AS ({VIEWS[name][1]})")
        elif name == "v_doc_lines":
            parts.append(f"v_doc_lines AS ({LINES_DUCKDB})")
        elif name == "v_headed_lines":
            parts.append(f"v_headed_lines AS ({HEADED})")
        else:
            parts.append(f"{name} AS ({dims.values_sql(name)})")
    return "WITH " + ",\n".join(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf_dir``."""
    if name in ("v_doc_lines", "v_headed_lines"):
        from pyspark.sql import functions as F

        lines = table(spark, sf_dir, "documents").select(
            "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
        )
        lines = lines.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line")
        if name == "v_doc_lines":
            return lines
        return spark.sql(HEADED.replace("v_doc_lines", "{v}"), v=lines)
    if name == "v_ledger":
        return _ledger(spark, sf_dir)
    if name == "v_search_hits":
        return _search_hits(spark, sf_dir)
    tables, text = VIEWS[name]
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        text = text.replace(f"FROM {t})", f"FROM {{{t}}})")
        if text.endswith(f"FROM {t}"):
            text = text[: -len(t)] + f"{{{t}}}"
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


#: Rows of a task that sorts; Spark deals by bytes, and narrow rows then make large sorts.
ROWS_PER_TASK = 300_000
#: So few tasks are left to Spark.
FEW_TASKS = 8


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df``, which has about so many rows, dealt by its key to tasks of ROWS_PER_TASK, so that a task's sort doesn't grow with the table."""
    n = rows // ROWS_PER_TASK
    return df.repartition(n, key) if n > FEW_TASKS else df


def _search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits numbered before their text is made.

    As one SELECT, Spark sorts the texts too, and doesn't see that the window's
    key is ``artifact_id``, so that whoever groups by it shuffles once more.
    """
    number, line, joined = VIEWS["v_search_hits"][1].split("\n")
    number = number.partition(" AS artifact_id, ")[2].rstrip(",").replace("o.o_custkey", "artifact_id")
    joined = joined.replace("FROM lineitem ", "FROM {lineitem} ").replace("JOIN orders ", "JOIN {orders} ")
    lines = table(spark, sf_dir, "lineitem")
    hits = spark.sql("SELECT o.o_custkey AS artifact_id, l.* " + joined, lineitem=lines, orders=table(spark, sf_dir, "orders"))
    numbered = spread(hits, lines.count(), "artifact_id").alias("l").selectExpr("*", number)
    return numbered.alias("l").selectExpr("artifact_id", "line_no", line)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with the document's number computed before the join.

    A condition on ``document`` reads both tables; Spark would join events and
    documents by it alone, a nested loop, unless the number is a column of its own.
    """
    from pyspark.sql import functions as F

    documents = table(spark, sf_dir, "documents")
    n = documents.agg((F.max("doc_id") + 1).alias("n")).where("n > 0")
    events = table(spark, sf_dir, "events").join(n).withColumn("at", F.col("event_id") % F.col("n"))
    columns = VIEWS["v_ledger"][1].partition("\nFROM ")[0]
    return spark.sql(columns + "\nFROM {events} e JOIN {documents} d ON d.doc_id = e.at", events=events, documents=documents)
