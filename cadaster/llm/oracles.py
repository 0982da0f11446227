"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

import math

from cadaster.llm import chat_format, line_dedup, url_filter


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    escaped = "replace(text, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        escaped = f"replace({escaped}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    frame = len(chat_format.OPEN) + len(chat_format.ROLE_END) + len(chat_format.CLOSE)
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length({escaped}) AS n,
            lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(n + CASE WHEN before IS NULL OR before <> role THEN {frame} + length(role) ELSE {len(chat_format.JOIN)} END)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


def url_features(host: str, path: str) -> set[int]:
    out = set()
    for text, seed in ((f"^{host}$", 7), (path, 13)):
        for n in url_filter.GRAMS:
            out |= {(seed * 1009 + n + sum(ord(c) * 131**i for i, c in enumerate(text[j : j + n]))) % url_filter.BUCKETS for j in range(len(text) - n + 1)}
    return out


def url_weights() -> list[float]:
    """The URL model, fitted by plain loops over the same labelled table."""
    rows = [({*url_features(*u.partition("/")[::2][:1], "/" + u.partition("/")[2]), url_filter.BUCKETS}, y) for y, us in ((0.0, url_filter.KEEP), (1.0, url_filter.LEAVE)) for u in us]
    w = [0.0] * (url_filter.BUCKETS + 1)
    for _ in range(url_filter.STEPS):
        gradient = [0.0] * len(w)
        for f, y in rows:
            off = y - 1 / (1 + math.exp(-sum(w[j] for j in f)))
            for j in f:
                gradient[j] += off
        w = [v + url_filter.RATE * (g / len(rows) - url_filter.L2 * v) for v, g in zip(w, gradient, strict=True)]
    return w


def _urls() -> str:
    w = url_weights()
    grams = []
    for text, seed in (("'^' || host || '$'", 7), ("path", 13)):
        for n in url_filter.GRAMS:
            code = " + ".join(f"unicode(substr({text}, i + {k}, 1)) * {131**k}" for k in range(n))
            grams.append(f"[(({code}) + {seed * 1009 + n}) % {url_filter.BUCKETS} for i in range(1, length({text}) - {n - 2})]")
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)})", v, h + p) for v, h, p in rules]
    return f"""
    WITH u AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    w AS (SELECT [{', '.join(f'{x:.17g}' for x in w)}]::DOUBLE[] AS w),
    f AS (SELECT *, list_distinct({' || '.join(grams)}) AS f FROM u),
    m AS (SELECT f.*, {w[-1]:.17g} + coalesce(list_sum([w.w[j + 1] for j in f.f]), 0) AS margin FROM f, w)
    SELECT page_id, host, path,
      CASE {' '.join(f'WHEN {c} THEN {_quoted(r)}' for c, _, r in fits)} END AS rule,
      CASE {' '.join(f'WHEN {c} THEN {_quoted(v)}' for c, v, _ in fits)} WHEN margin >= {math.log(url_filter.BLOCK_ABOVE / (1 - url_filter.BLOCK_ABOVE)):.17g} THEN 'block' ELSE 'allow' END AS verdict
    FROM m"""


def _decontaminate() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
    p AS (SELECT item, least(len(w), 13) AS k, unnest([array_to_string(w[i : i + least(len(w), 13) - 1], ' ') for i in range(1, greatest(len(w) - 11, 2))]) AS win FROM b WHERE len(w) > 0),
    c AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS win
          FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
    m AS (SELECT DISTINCT c.doc_id, c.pos, p.k, p.item FROM c JOIN p ON c.win = p.win AND c.k = p.k),
    h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM m) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def _jaccard() -> str:
    return """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, greatest(len(w) - 2, 2))]) END AS s FROM d),
    t AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""


def _lines() -> str:
    least = line_dedup.MIN_WORDS
    return f"""
    WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
    l AS (SELECT doc_id, line, raw, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM s),
    d AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min({{'doc': doc_id, 'line': line}}) AS first FROM l WHERE len(w) > 0 GROUP BY t),
    v AS (SELECT t, first, unnest(range(1, len(w) + 1)) AS pos, unnest([array_to_string(w[1 : i - 1] || w[i + 1 :], ' ') for i in range(1, len(w) + 1)]) AS v FROM d WHERE len(w) >= {least}),
    near AS (
      SELECT a.t FROM v a JOIN (SELECT v, pos, min(first) AS low FROM v GROUP BY v, pos) b ON a.v = b.v AND a.pos = b.pos WHERE b.low < a.first
      UNION SELECT a.t FROM v a JOIN d b ON a.v = b.t AND len(b.w) >= {least} WHERE b.first < a.first
      UNION SELECT b.t FROM v a JOIN d b ON a.v = b.t AND len(b.w) >= {least} WHERE a.first < b.first),
    m AS (SELECT l.doc_id, l.line, l.raw, len(l.w) > 0 AS word, len(l.w) > 0 AND (near.t IS NOT NULL OR d.first <> {{'doc': l.doc_id, 'line': l.line}}) AS gone
          FROM l LEFT JOIN d ON array_to_string(l.w, ' ') = d.t AND len(l.w) > 0 LEFT JOIN near ON near.t = d.t)
    SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed,
      sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""


def _substrings() -> str:
    return """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    c AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, unnest([hash(array_to_string(w[i : i + 49], ' ')) for i in range(1, len(w) - 48)]) AS win
          FROM d WHERE len(w) >= 50),
    f AS (SELECT win, min(doc_id) AS first FROM c GROUP BY win HAVING min(doc_id) < max(doc_id)),
    h AS (SELECT doc_id, list(DISTINCT word) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS word FROM c JOIN f USING (win) WHERE doc_id > first) GROUP BY doc_id),
    k AS (SELECT d.doc_id, w, CASE WHEN gone IS NULL THEN [] ELSE gone END AS gone FROM d LEFT JOIN h USING (doc_id)),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
    g AS (SELECT doc_id, unnest(gone) AS pos FROM h),
    kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS text FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id)
    SELECT k.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM k LEFT JOIN kept USING (doc_id)"""


def _suffixes() -> str:
    return """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT doc_id, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS pos, unnest([hash(substr(x, 2 * i + 1, 400)) for i in range(0, greatest(len(x) // 2 - 199, 0))]) AS win FROM d),
    h AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS times FROM w) WHERE times > 1),
    g AS (SELECT doc_id, pos, coalesce(pos > 200 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), true)::INT AS new FROM h),
    n AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM g),
    s AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 200 AS b FROM n GROUP BY doc_id, span),
    p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
    k AS (SELECT doc_id, string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS head, max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
          FROM p JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""


def _negatives() -> str:
    return """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""


ORACLES = {"op4_jaccard_join": _jaccard(), "op1_chat_format": _chat(), "op6_url_filter": _urls(), "op7_decontaminate": _decontaminate(), "op9_line_dedup": _lines(), "op10_substring_dedup": _substrings(), "op12_suffix_dedup": _suffixes(), "op13_hard_negatives": _negatives()}
