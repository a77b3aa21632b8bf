"""SQL twins, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from . import decontaminate, embeddings, quality, secrets


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op4_chat() -> str:
    escaped = r"regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '([<\[])(\||INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1\\\2', 'g')"
    head = r"regexp_replace(role, '([\\|<>\[\]\n])', '\\\1', 'g')"
    return rf"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS said,
 coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(length({head}) + length({escaped}) + 5 + 8) AS chars FROM c GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""


def op10_decontamination() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all(coalesce({lower}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
 pl AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
 bs AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item, size, list_slice(w, p, p + size - 1) AS win FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM bs) x),
 dw AS (SELECT doc_id, p, size, list_slice(w, p, p + size - 1) AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bs) s WHERE len(w) >= size) x),
 h AS (SELECT dw.doc_id, dw.p, dw.size, bw.item FROM dw JOIN bw ON bw.size = dw.size AND bw.win = dw.win),
 hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM (SELECT DISTINCT doc_id, p, size FROM h) y) z GROUP BY doc_id),
 df AS (SELECT word, count(DISTINCT doc_id) AS n FROM pl GROUP BY word),
 win AS (SELECT DISTINCT size, win FROM bw),
 terms AS (SELECT size, win, o, win[o + 1] AS word FROM (SELECT size, win, unnest(range(0, size)) AS o FROM win) x),
 rare AS (SELECT size, win, t.word, o FROM terms t LEFT JOIN df ON df.word = t.word QUALIFY row_number() OVER (PARTITION BY size, win ORDER BY coalesce(n, 0), o) <= 2),
 begun AS (SELECT DISTINCT pl.doc_id, size, win, pos - o AS start FROM rare JOIN pl ON pl.word = rare.word WHERE pos >= o),
 agree AS (SELECT b.doc_id, b.size, b.win, b.start FROM begun b JOIN terms t ON t.size = b.size AND t.win = b.win JOIN pl ON pl.doc_id = b.doc_id AND pl.word = t.word AND abs(pl.pos - b.start - t.o) <= {decontaminate.SLOP}
 GROUP BY b.doc_id, b.size, b.win, b.start HAVING count(DISTINCT t.o) >= ceil({decontaminate.AGREE} * b.size)),
 ni AS (SELECT doc_id, count(DISTINCT item) AS n_near_items, string_agg(DISTINCT item, ',' ORDER BY item) AS near_items FROM agree JOIN bw ON bw.size = agree.size AND bw.win = agree.win GROUP BY doc_id),
 hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items, coalesce(near_items, '') AS near_items
 FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN ni USING (doc_id)"""


def op8_secrets() -> str:
    rules = [
        ("assign", secrets.ASSIGN, f"length(regexp_extract(m, {_q(secrets.ASSIGN)}, 2)) >= 6"),
        ("access", secrets.ACCESS, "true"),
        ("hex", secrets.HEX, "true"),
        *[(kind, pattern, "true") for kind, pattern, _ in secrets.MORE],
    ]
    lists = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, regexp_extract_all(t, {_q(p)}) AS ms, string_split_regex(t, {_q(p)}) AS ps FROM d WHERE regexp_matches(t, {_q(p)})"
        for k, (kind, p, _) in enumerate(rules)
    )
    keep = " ".join(f"WHEN '{kind}' THEN {test}" for kind, _, test in rules)
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{k}'), 0) AS n_{k}" for k in secrets.BASE)
    total = lambda x, to: f"coalesce(list_sum(list_transform(list_slice({x}, 1, {to}), lambda y: length(y))), 0)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS ({lists}),
 e AS (SELECT doc_id, ord, kind, ms[i] AS m, {total('ps', 'i')} + {total('ms', 'i - 1')} AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM l) x),
 f AS (SELECT doc_id, ord, kind, CAST(s AS BIGINT) AS s, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + length(m) AS BIGINT)) AS span FROM e WHERE CASE kind {keep} END),
 g AS (SELECT doc_id, {counts}, coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < 3), '') AS base, coalesce(string_agg(span, ',' ORDER BY s, ord), '') AS spans FROM f GROUP BY doc_id)
 SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def op1_quality() -> str:
    word = r"'[^\x20\x09-\x0D]+'"
    ends = ", ".join(_q(c) for c in quality.TERMINAL)
    phrase = " OR ".join(f"contains(lower(line), {_q(x)})" for x in quality.BOILERPLATE)
    marks = r"len(list_filter(string_split_regex(line, '[\x20\x09]'), lambda x: list_contains(['|', '»', '›', '•', '·', '>', '>>'], x)))"
    closed = rf"right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1) IN ({ends})"
    rule = f"""CASE WHEN {marks} >= {quality.MIN_SEPARATORS} OR regexp_matches(line, {_q(quality.NAVIGATION)}) THEN 'navigation'
 WHEN {phrase} THEN 'boilerplate' WHEN NOT {closed} AND len(regexp_extract_all(line, {word})) < {quality.MIN_UNPUNCTUATED} THEN 'punctuation' END"""
    rules = ("punctuation", "navigation", "boilerplate")
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
 win AS (SELECT doc_id, p, list_slice(w, p, p + 4) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5) y),
 twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) y WHERE n > 1),
 rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS pos FROM twice) y GROUP BY doc_id),
 lines AS (SELECT doc_id, line, {rule} AS rule FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) y WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, {', '.join(f"count(*) FILTER (WHERE rule = '{r}') AS {r}" for r in rules)}, coalesce(sum(len(regexp_extract_all(line, {word}))) FILTER (WHERE rule IS NOT NULL), 0) AS lost FROM lines GROUP BY doc_id),
 a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 {', '.join(f"coalesce({r}, 0) AS n_{r}_lines" for r in rules)}, CAST(len(w) - coalesce(lost, 0) AS BIGINT) AS kept_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id))
 SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_words >= {quality.MIN_KEPT_SHARE} * n_words AND n_symbols <= {quality.MAX_SYMBOLS_PER_WORD} * n_words AS kept FROM a"""


def op13_embeddings() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {embeddings.THRESHOLD}),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
 FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id"""


def all_sql() -> dict[str, str]:
    return {
        "op1_quality": op1_quality(),
        "op4_chat": op4_chat(),
        "op8_secrets": op8_secrets(),
        "op10_decontamination": op10_decontamination(),
        "op13_embeddings": op13_embeddings(),
    }
