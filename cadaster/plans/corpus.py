"""Queries on the document corpus and its incremental runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import text
from cadaster.operators import corpus as c
from cadaster.operators import incremental as i
from cadaster.plans.scalars import canonical
from cadaster.sources import inventory
from cadaster.sources.views import files, files_before, table

SIZE, OVERLAP = 300, 40
WORDS = ["the", "und", "Être", "", "tion", "ación"]


def _elements(spark, sf_dir):
    """Documents with header lines put in: every third line, by its number."""
    marked = "array_join(transform(split(text, '\\n'), (l, j) -> CASE WHEN (j + doc_id) % 3 = 0 THEN concat('## Titre_', j, '\\n', l) WHEN (j + doc_id) % 7 = 0 THEN concat('**ARTICLE ', j, '** suite\\n', l) ELSE l END), '\\n')"
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS document_id", f"{marked} AS text", "source")


def src2_file_inventory(spark, sf_dir):
    return inventory.supported(files(spark, sf_dir)).groupBy("project_id", "file_type").agg(F.count("*").alias("n"), F.sum("file_size_bytes").alias("bytes"))


def src10_html_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", c.page_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def w6_sections(spark, sf_dir):
    return c.sections(_elements(spark, sf_dir)).select("document_id", "section", "title", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def w7_oversize_sections(spark, sf_dir):
    parts = c.split_oversize(c.sections(_elements(spark, sf_dir)), SIZE, OVERLAP)
    return parts.groupBy("document_id").agg(F.count("*").alias("parts"), F.count_if(F.col("section_type") == "section_split").alias("cut"), F.sum(F.length("text")).alias("chars"), F.max("title").alias("last"))


def w8_chunks(spark, sf_dir):
    return c.chunks(c.split_oversize(c.sections(_elements(spark, sf_dir)), SIZE, OVERLAP)).select("parent_id", "document_id", "section_type", "title", "char_count", "token_estimate")


def w9_table_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "concat(l_partkey, ' | ', l_quantity) AS row", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    packed = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "row"))).alias("rows"))
    packed = packed.withColumn("chunk", c.pack_rows(F.lit(6), F.transform("rows", lambda r: text.token_estimate(r["row"])), 22))
    return packed.select("l_orderkey", F.explode(F.arrays_zip("rows", "chunk")).alias("x")).groupBy("l_orderkey", F.col("x.chunk").alias("chunk")).agg(F.count("*").alias("rows"))


def w9_child_chunks(spark, sf_dir):
    """Tables of each order's items below a header with a rule, cut into children."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS o", "concat('| ', l_partkey, ' | ', l_suppkey, ' x ', l_extendedprice, ' |') AS row")
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "row"))), lambda x: x["row"]), "\n").alias("body"))
    parents = body.select(F.concat(F.lit("t"), "l_orderkey").alias("parent_id"), F.col("l_orderkey").alias("document_id"), F.lit("Lots").alias("title"), F.concat(F.lit("| Lot | Prix<br/>net |\n|---|---|\n"), "body").alias("text"))
    return c.children(parents, 40).select("chunk_id", "document_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def w9_prose_children(spark, sf_dir):
    """Children of the documents' chunks."""
    parts = c.chunks(c.split_oversize(c.sections(_elements(spark, sf_dir)), SIZE, OVERLAP))
    return c.children(parts, 60, 15).select("chunk_id", "parent_id", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def _ranked(spark, sf_dir):
    rows = _elements(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n")).alias("index", "text")).withColumn("page", F.when(F.col("index") % 5 > 0, F.floor(F.col("index") / 3).cast("int")))
    return c.rank_by_keywords(rows, WORDS, F.col("text"))


def w10_keyword_ranking(spark, sf_dir):
    rows = _ranked(spark, sf_dir).where("hits > 0").withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("hits"), "index")))
    return rows.select("document_id", "index", "hits", "place")


def w11_neighbours(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("hits", F.when(F.col("hits") >= 2, F.col("hits")).otherwise(0))
    return c.with_neighbours(rows, 1, 2).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("index").alias("total"))


def w12_budget(spark, sf_dir):
    rows = c.within_budget(_ranked(spark, sf_dir).where("hits > 0"), [F.desc("hits"), "index"], 1500)
    return rows.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("kept")).alias("chars"))


def w12_context(spark, sf_dir):
    rows = c.context(_ranked(spark, sf_dir).withColumn("hits", F.when(F.col("hits") >= 2, F.col("hits")).otherwise(0)), 2500, tail=True)
    return rows.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("kept")).alias("chars"), F.sum(F.col("place") * F.col("index")).alias("order"))


def w12_document_heads(spark, sf_dir):
    rows = c.head(_elements(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n")).alias("index", "text")), 900)
    return rows.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("kept")).alias("chars"))


def a11_manifest_totals(spark, sf_dir):
    parts = c.chunks(c.split_oversize(c.sections(_elements(spark, sf_dir)), SIZE, OVERLAP))
    return c.manifest_totals(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source"), parts, "source")


def _now(spark, sf_dir):
    return files(spark, sf_dir).withColumn("document_id", text.document_id(F.col("project_id"), F.col("source_path")))


def j10_src5_reuse(spark, sf_dir):
    chunked = _now(spark, sf_dir).select(F.expr("CASE WHEN doc_id % 3 > 0 THEN document_id ELSE concat('x', document_id) END").alias("document_id"))
    return i.reuse(_now(spark, sf_dir), files_before(spark, sf_dir), chunked).select("document_id", "reuse")


def j11_stale(spark, sf_dir):
    return i.stale(files_before(spark, sf_dir), files(spark, sf_dir)).select("project_id", "source_path")


def j12_s5_difference(spark, sf_dir):
    return i.difference(files_before(spark, sf_dir), files(spark, sf_dir))


def j12_change_flags(spark, sf_dir):
    return i.change_flags(i.difference(files_before(spark, sf_dir), files(spark, sf_dir)))


def a15_fingerprints(spark, sf_dir):
    return i.fingerprints(files(spark, sf_dir))


def a17_refresh(spark, sf_dir):
    now = i.fingerprints(files(spark, sf_dir))
    number = F.regexp_extract("project_id", r"(\d+)$", 1).cast("int")
    stored = now.select("project_id", (number % 4).alias("persons"), (number % 3 > 0).alias("has_file"))
    # every second project is as it was
    before = i.fingerprints(files_before(spark, sf_dir)).where(number % 2 > 0).unionByName(now.where(number % 2 == 0))
    return i.refresh_decision(before, now, stored)


QUERIES = {f.__name__: f for f in (src2_file_inventory, src10_html_text, w6_sections, w7_oversize_sections, w8_chunks, w9_table_rows, w9_child_chunks, w9_prose_children, w10_keyword_ranking, w11_neighbours, w12_budget, w12_context, w12_document_heads, a11_manifest_totals, j10_src5_reuse, j11_stale, j12_s5_difference, j12_change_flags, a15_fingerprints, a17_refresh)}

_ELEMENTS = """
el AS (SELECT doc_id AS document_id, source, array_to_string([CASE WHEN (j - 1 + doc_id) % 3 = 0 THEN '## Titre_' || (j - 1) || chr(10) || l WHEN (j - 1 + doc_id) % 7 = 0 THEN '**ARTICLE ' || (j - 1) || '** suite' || chr(10) || l ELSE l END for l, j in string_split(text, chr(10))], chr(10)) AS text FROM documents)"""


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '!\\[.*?\\]\\(.*?\\)', ' ', 'g'), '[ \\t]+', ' ', 'g'))"


_SECTIONS = _ELEMENTS + f""",
ln AS (SELECT document_id, unnest(string_split({_clean('text')}, chr(10))) AS line, unnest(range(len(string_split({_clean('text')}, chr(10))))) AS pos FROM el),
ti AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN translate(trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)', 2)), '*_', '')
  WHEN regexp_matches(trim(line), '^\\*\\*(.+?)\\*\\*\\s*(.*)') AND (regexp_matches(upper(trim(regexp_extract(trim(line), '^\\*\\*(.+?)\\*\\*\\s*(.*)', 1))), 'ARTICLE|SECTION|CHAPITRE|PARTIE|ANNEXE|TITRE') OR length(trim(line)) < 100)
  THEN translate(trim(trim(regexp_extract(trim(line), '^\\*\\*(.+?)\\*\\*\\s*(.*)', 1)) || ' ' || regexp_extract(trim(line), '^\\*\\*(.+?)\\*\\*\\s*(.*)', 2)), '*_', '') END AS title FROM ln),
se AS (SELECT *, count(title) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM ti),
sc AS (SELECT * FROM (SELECT document_id, section, coalesce(max(title), 'Introduction') AS title, {_clean("string_agg(line, chr(10) ORDER BY pos)")} AS text FROM se GROUP BY 1, 2) WHERE length(trim(text)) >= 5)"""


def _levels() -> str:
    """Pieces of the sections over SIZE by level: runs of small pieces, and what is cut by the next separator, with their places as text that sorts."""
    out = f"""
v0 AS (SELECT document_id, section, '' AS path, text FROM sc WHERE ceil(length(text) / 4) > {SIZE}),"""
    for k, mark in enumerate(("chr(10) || chr(10)", "chr(10)", "'.'", "' '"), 1):
        out += f"""
q{k} AS (SELECT document_id, section, path, unnest(x) AS piece, unnest(range(len(x))) AS i FROM (SELECT document_id, section, path, [y for y in string_split(replace(text, {mark}, chr(1) || {mark}), chr(1)) if y <> ''] AS x FROM v{k - 1})),
b{k} AS (SELECT *, ceil(length(piece) / 4) >= {SIZE} AS big, sum((ceil(length(piece) / 4) >= {SIZE})::INT) OVER (PARTITION BY document_id, section, path ORDER BY i ROWS UNBOUNDED PRECEDING) AS bigs FROM q{k}),
r{k} AS (SELECT document_id, section, path || lpad((2 * bigs + 1)::VARCHAR, 8, '0') AS path, list(piece ORDER BY i) AS pieces FROM b{k} WHERE NOT big GROUP BY document_id, section, b{k}.path, bigs),
v{k} AS (SELECT document_id, section, path || lpad((2 * bigs)::VARCHAR, 8, '0') AS path, piece AS text FROM b{k} WHERE big),"""
    return out


_PARTS = _SECTIONS + f""",{_levels()}
ru AS (SELECT row_number() OVER () AS run, * FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)),
rs AS (SELECT run, [ceil(length(x) / 4)::INT for x in pieces] AS sizes FROM ru),
rp AS (SELECT run, sizes, 1 AS i, 1 AS first, []::INT[][] AS spans FROM rs
  UNION ALL SELECT run, sizes, i + 1, CASE WHEN overfull THEN again ELSE first END, CASE WHEN overfull THEN list_append(spans, [first, i - 1]) ELSE spans END
  FROM (SELECT *, i > first AND coalesce(list_sum(sizes[first : i - 1]), 0) + sizes[i] > {SIZE} AS overfull,
    CASE WHEN i > first AND coalesce(list_sum(sizes[first : i - 1]), 0) + sizes[i] > {SIZE} THEN [j for j in range(least(first + 1, i), i + 1) if coalesce(list_sum(sizes[j : i - 1]), 0) <= {OVERLAP} AND (coalesce(list_sum(sizes[j : i - 1]), 0) + sizes[i] <= {SIZE} OR j = i)][1] END AS again FROM rp WHERE i <= len(sizes))),
re AS (SELECT run, unnest(list_append(spans, [first, i - 1])) AS span, unnest(range(len(spans) + 1)) AS k FROM rp WHERE i = len(sizes) + 1 AND i > first),
pc AS (SELECT document_id, section, path, k, array_to_string(pieces[span[1] : span[2]], '') AS text FROM re JOIN ru USING (run)
  UNION ALL SELECT document_id, section, path, unnest(range(greatest(ceil((length(text) - {4 * SIZE}) / {4 * (SIZE - OVERLAP)}), 0)::INT + 1)), unnest([substr(text, x * {4 * (SIZE - OVERLAP)} + 1, {4 * SIZE}) for x in range(greatest(ceil((length(text) - {4 * SIZE}) / {4 * (SIZE - OVERLAP)}), 0)::INT + 1)]) FROM v4),
ps AS (SELECT document_id, section, row_number() OVER (PARTITION BY document_id, section ORDER BY path, k) - 1 AS part, text FROM (SELECT document_id, section, path, k, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pc) WHERE text <> ''),
pt AS (SELECT document_id, section, part, true AS cut, sc.title || ' (Part ' || (part + 1) || ')' AS title, ps.text FROM ps JOIN sc USING (document_id, section)
  UNION ALL SELECT document_id, section, 0, false, title, text FROM sc WHERE ceil(length(text) / 4) <= {SIZE})"""
_CHUNKS = _PARTS + """,
ix AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section, part) - 1 AS idx, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM pt),
ch AS (SELECT *, length(text)::INT AS char_count, ceil(length(text) / 4)::INT AS token_estimate FROM ix WHERE length(s) >= 50 AND length(regexp_replace(s, '[#*_\\-|\\s]', '', 'g')) >= 10 AND NOT regexp_matches(s, '(?i)^(?:#{1,6}\\s*)?[\\s*_#\\-|]*$|^Tous droits de reproduction|^Page \\d+'))"""
_RANKED = _ELEMENTS + f""",
rk AS (SELECT document_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS index FROM el),
hits AS (SELECT *, CASE WHEN index % 5 > 0 THEN index // 3 END AS page, CASE WHEN length(text) >= 50 THEN len([k for k in ['the', 'und', 'etre', 'tion', 'acion'] if contains({canonical('text')}, k)]) ELSE 0 END AS hits FROM rk)"""
_FOLDER = "CASE doc_id % 6 WHEN 0 THEN '3. RH/Dupont Marie' WHEN 1 THEN '4. Bilans/SCI Lumière' WHEN 2 THEN 'Société Emprunteuse' WHEN 3 THEN 'X - Old' WHEN 4 THEN '5. Opération' ELSE 'Annexes' END"
FILES = f"""
fi AS (SELECT doc_id, source || '-' || (doc_id // 500) AS project_id, 'Doc ' || doc_id || ' ' || (2018 + doc_id % 6) || CASE doc_id % 11 WHEN 0 THEN '.zip' WHEN 1 THEN '.xlsx' ELSE '.pdf' END AS filename,
  '2. Audit/1. Opérateur/' || {_FOLDER} || '/Doc ' || doc_id || ' ' || (2018 + doc_id % 6) || CASE doc_id % 11 WHEN 0 THEN '.zip' WHEN 1 THEN '.xlsx' ELSE '.pdf' END AS source_path, n_chars AS file_size_bytes, CASE doc_id % 11 WHEN 0 THEN 'zip' WHEN 1 THEN 'xlsx' ELSE 'pdf' END AS file_type FROM documents),
fb AS (SELECT doc_id, project_id, filename, source_path, CASE WHEN doc_id % 5 = 0 THEN file_size_bytes + 10 ELSE file_size_bytes END AS file_size_bytes, file_type FROM fi WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id, project_id, filename, '2. Audit/Ancien/' || filename, file_size_bytes, file_type FROM fi WHERE doc_id % 13 = 0)"""
_DIFF = FILES + """,
df AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(b.source_path, a.source_path) AS source_path, CASE WHEN a.source_path IS NULL THEN 'added' WHEN b.source_path IS NULL THEN 'removed' WHEN a.file_size_bytes <> b.file_size_bytes THEN 'modified' END AS change
  FROM fb a FULL JOIN fi b ON a.project_id = b.project_id AND a.source_path = b.source_path),
ch AS (SELECT * FROM df WHERE change IS NOT NULL)"""


def _prints(t: str) -> str:
    mark = lambda cond: f"sha256(coalesce(string_agg(source_path || '::' || file_size_bytes || chr(10), '' ORDER BY source_path || '::' || file_size_bytes) FILTER ({cond}), ''))"
    return f"SELECT project_id, {mark(_PEOPLE)} AS people, {mark(_MONEY)} AS financial, count(*) FILTER ({_PEOPLE}) AS people_inputs, count(*) FILTER ({_MONEY}) AS financial_inputs FROM {t} GROUP BY 1"


def _page_text() -> str:
    t = "regexp_replace(html, '(?is)<script[^>]*math/tex[^>]*>(.*?)</script>', ' $ \\1 $ ', 'g')"
    t = f"regexp_replace({t}, '(?is)<img[^>]*\\balt=[\"'']([^\"'']+)[\"''][^>]*>', ' [IMAGE: \\1] ', 'g')"
    for tag in c.DROPPED_TAGS:
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<!--.*?-->|<[^>]*>', chr(10), 'g')"
    for code, char in c.ENTITIES:
        t = f"replace({t}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"array_to_string([x for x in [trim(x) for x in string_split({t}, chr(10))] if x <> ''], chr(10))"


_PEOPLE, _MONEY = "source_path LIKE '%3. RH/%'", "lower(source_path) LIKE '%bilan%'"

SQL = {
    "src2_file_inventory": f"WITH {FILES} SELECT project_id, file_type, count(*) AS n, sum(file_size_bytes)::BIGINT AS bytes FROM fi WHERE file_type <> 'zip' AND doc_id % 6 <> 3 GROUP BY ALL",
    "src10_html_text": f"WITH t AS (SELECT page_id, {_page_text()} AS text FROM pages) SELECT page_id, length(text)::INT AS chars, sha256(text) AS sha FROM t",
    "w6_sections": f"WITH {_SECTIONS} SELECT document_id, section, title, sha256(text) AS sha FROM sc",
    "w7_oversize_sections": f"WITH RECURSIVE {_PARTS} SELECT document_id, count(*) AS parts, count(*) FILTER (cut) AS cut, sum(length(text))::BIGINT AS chars, max(title) AS last FROM pt GROUP BY 1",
    "w8_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT document_id || '_' || lpad(idx::VARCHAR, 4, '0') AS parent_id, document_id, CASE WHEN cut THEN 'section_split' ELSE 'section' END AS section_type, title, char_count, token_estimate FROM ch",
    "w9_table_rows": """WITH RECURSIVE r AS (SELECT l_orderkey, ceil(length(l_partkey || ' | ' || l_quantity) / 4)::INT AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem),
      f AS (SELECT l_orderkey, rn, 0 AS chunk, 6 + t + 1 AS used FROM r WHERE rn = 1
        UNION ALL SELECT r.l_orderkey, r.rn, CASE WHEN f.used + r.t > 12 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + r.t > 12 THEN 6 + r.t ELSE f.used + r.t + 1 END FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.rn = f.rn + 1)
      SELECT l_orderkey, chunk::INT AS chunk, count(*) AS rows FROM f GROUP BY ALL""",
    "w9_child_chunks": """WITH RECURSIVE r AS (SELECT l_orderkey, '| ' || l_partkey || ' | ' || l_suppkey || ' x ' || l_extendedprice || ' |' AS row, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS rn FROM lineitem),
      z AS (SELECT l_orderkey, '| Lot | Prix net |' || chr(10) || '|---|---|' AS head, string_agg(row, chr(10) ORDER BY rn) AS body FROM r GROUP BY 1),
      w AS (SELECT l_orderkey, head, head || chr(10) || body AS text, ceil(length(head || chr(10) || body) / 4) > 40 AS cut FROM z),
      f AS (SELECT r.l_orderkey, rn, row, 0 AS chunk, 7 + ceil(length(row) / 4) + 1 AS used FROM r JOIN w USING (l_orderkey) WHERE rn = 1 AND cut
        UNION ALL SELECT r.l_orderkey, r.rn, r.row, CASE WHEN f.used + ceil(length(r.row) / 4) > 30 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + ceil(length(r.row) / 4) > 30 THEN 7 + ceil(length(r.row) / 4) ELSE f.used + ceil(length(r.row) / 4) + 1 END FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.rn = f.rn + 1),
      t AS (SELECT l_orderkey, chunk, any_value(head) || chr(10) || string_agg(row, chr(10) ORDER BY rn) AS text FROM f JOIN w USING (l_orderkey) GROUP BY ALL UNION ALL SELECT l_orderkey, 0, text FROM w WHERE NOT cut)
      SELECT 't' || l_orderkey || '_c_' || lpad(chunk::VARCHAR, 3, '0') AS chunk_id, l_orderkey AS document_id, sha256(text) AS sha FROM t WHERE length(text) >= 50 AND length(regexp_replace(text, '[#*_\\-|\\s]', '', 'g')) >= 10""",
    "w9_prose_children": f"""WITH RECURSIVE {_CHUNKS},
      pa AS (SELECT document_id || '_' || lpad(idx::VARCHAR, 4, '0') AS parent_id, [x for x in flatten([CASE WHEN ceil(length(x) / 4) > {c.LONG_PIECE} THEN string_split(replace(x, ' ', ' ' || chr(1)), chr(1)) ELSE [x] END for x in string_split(regexp_replace(text, '(\\n|[.!?] )', '\\1' || chr(1), 'g'), chr(1))]) if x <> ''] AS pieces FROM ch),
      si AS (SELECT parent_id, [ceil(length(x) / 4)::INT for x in pieces] AS sizes FROM pa),
      st AS (SELECT parent_id, sizes, 1 AS i, 1 AS first, []::INT[][] AS runs FROM si
        UNION ALL SELECT parent_id, sizes, i + 1, CASE WHEN overfull THEN again ELSE first END, CASE WHEN overfull THEN list_append(runs, [first, i - 1]) ELSE runs END
        FROM (SELECT *, i > first AND coalesce(list_sum(sizes[first : i - 1]), 0) + sizes[i] > 60 AS overfull,
          [j for j in range(least(first + 1, i), i + 1) if coalesce(list_sum(sizes[j : i - 1]), 0) <= 15 AND (coalesce(list_sum(sizes[j : i - 1]), 0) + sizes[i] <= 60 OR j = i)][1] AS again FROM st WHERE i <= len(sizes))),
      en AS (SELECT parent_id, unnest(list_append(runs, [first, i - 1])) AS run, unnest(range(len(runs) + 1)) AS k FROM st WHERE i = len(sizes) + 1 AND i > first),
      tx AS (SELECT parent_id, k, trim(array_to_string(pieces[run[1] : run[2]], ''), ' ' || chr(10) || chr(13) || chr(9)) AS text FROM en JOIN pa USING (parent_id))
      SELECT parent_id || '_c_' || lpad(k::VARCHAR, 3, '0') AS chunk_id, parent_id, length(text)::INT AS chars, sha256(text) AS sha FROM tx
      WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 50 AND length(regexp_replace(text, '[#*_\\-|\\s]', '', 'g')) >= 10 AND NOT regexp_matches(text, '(?i)^(?:#{{1,6}}\\s*)?[\\s*_#\\-|]*$|^Tous droits de reproduction|^Page \\d+')""",
    "w10_keyword_ranking": f"WITH {_RANKED} SELECT document_id, index, hits::INT AS hits, row_number() OVER (PARTITION BY document_id ORDER BY hits DESC, index)::INT AS place FROM hits WHERE hits > 0",
    "w11_neighbours": f"""WITH {_RANKED}, n AS (SELECT *, max((hits >= 2)::INT) OVER (PARTITION BY document_id ORDER BY index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM hits),
      k AS (SELECT *, min(page) OVER (PARTITION BY document_id) AS first FROM n WHERE near > 0 AND length(text) >= 50) SELECT document_id, count(*) AS n, sum(index)::BIGINT AS total FROM k WHERE page IS NULL OR page <= first + 2 GROUP BY 1""",
    "w12_budget": f"""WITH {_RANKED}, n AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER w AS fin FROM hits WHERE hits > 0 WINDOW w AS (PARTITION BY document_id ORDER BY hits DESC, index ROWS UNBOUNDED PRECEDING)),
      o AS (SELECT *, min(n) FILTER (fin > 1500) OVER (PARTITION BY document_id) AS over, 1500 - (fin - length(text)) AS room FROM n)
      SELECT document_id, count(*) AS n, sum(CASE WHEN n = over THEN room + 4 ELSE length(text) END)::BIGINT AS chars FROM o WHERE over IS NULL OR n < over OR (n = over AND room > 200) GROUP BY 1""",
    "w12_context": f"""WITH {_RANKED}, h AS (SELECT document_id, index, text, length(text) AS len, CASE WHEN hits >= 2 THEN hits ELSE 0 END AS hits FROM hits),
      a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY hits DESC, index) AS n FROM h), b AS (SELECT *, sum(len) FILTER (hits > 0) OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS fin FROM a),
      d AS (SELECT *, coalesce(min(n) FILTER (hits > 0 AND fin > 2500) OVER (PARTITION BY document_id), 1000000) AS over FROM b),
      e AS (SELECT *, coalesce(sum(len) FILTER (hits > 0 AND n < over) OVER (PARTITION BY document_id), 0) AS total FROM d),
      f AS (SELECT *, total + coalesce(sum(len) FILTER (hits = 0 AND len >= 50) OVER (PARTITION BY document_id ORDER BY index ROWS UNBOUNDED PRECEDING), 0) AS t_fin FROM e),
      g AS (SELECT *, coalesce(min(index) FILTER (hits = 0 AND len >= 50 AND t_fin > 2500) OVER (PARTITION BY document_id), 1000000) AS t_over FROM f),
      k AS (SELECT *, CASE WHEN hits > 0 AND n < over THEN len WHEN hits > 0 AND n = over AND 2500 - (fin - len) > 200 THEN 2500 - (fin - len) + 4 WHEN hits = 0 AND len >= 50 AND index < t_over THEN len END AS kept FROM g),
      l AS (SELECT *, count(kept) OVER (PARTITION BY document_id) AS n_kept, sum(CASE WHEN len >= 50 THEN len ELSE 0 END) OVER (PARTITION BY document_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS p_fin FROM k),
      o AS (SELECT *, coalesce(min(index) FILTER (len >= 50 AND p_fin > 2500) OVER (PARTITION BY document_id), 1000000) AS p_over FROM l),
      q AS (SELECT document_id, index, CASE WHEN n_kept = 0 THEN index ELSE n END AS pos, CASE WHEN n_kept > 0 THEN kept WHEN len >= 50 AND index < p_over THEN len END AS kept FROM o),
      p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS place FROM q WHERE kept IS NOT NULL)
      SELECT document_id, count(*) AS n, sum(kept)::BIGINT AS chars, sum(place * index)::BIGINT AS "order" FROM p GROUP BY 1""",
    "w12_document_heads": f"""WITH {_ELEMENTS}, l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS index FROM el),
      b AS (SELECT *, 900 - coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l)
      SELECT document_id, count(*) AS n, sum(least(room, length(text)))::BIGINT AS chars FROM b WHERE room > 0 AND text <> '' GROUP BY 1""",
    "a11_manifest_totals": f"""WITH RECURSIVE {_CHUNKS}, p AS (SELECT document_id, count(*) AS chunks, sum(token_estimate) AS tokens FROM ch GROUP BY 1)
      SELECT source, count(*) AS files, count(chunks) AS with_chunks, sum(chunks)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens, max(tokens)::BIGINT AS longest FROM documents d LEFT JOIN p ON p.document_id = d.doc_id GROUP BY 1""",
    "j10_src5_reuse": f"""WITH {FILES} SELECT sha256(i.project_id || '::' || i.source_path)[1:12] AS document_id, b.source_path IS NOT NULL AND i.doc_id % 3 > 0 AS reuse FROM fi i LEFT JOIN fb b USING (project_id, source_path, file_size_bytes)""",
    "j11_stale": f"WITH {FILES} SELECT project_id, source_path FROM fb ANTI JOIN fi USING (project_id, source_path)",
    "j12_s5_difference": f"WITH {_DIFF} SELECT * FROM ch",
    "j12_change_flags": f"WITH {_DIFF} SELECT project_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) AS changed, bool_or({_PEOPLE}) AS people_related, bool_or({_MONEY}) AS financial_related FROM ch GROUP BY 1",
    "a15_fingerprints": f"WITH {FILES} {_prints('fi')}",
    "a17_refresh": f"""WITH {FILES}, b AS ({_prints('fi')}), f AS ({_prints('fb')}), a AS (SELECT * FROM f WHERE regexp_extract(project_id, '\\d+$')::INT % 2 > 0 UNION ALL SELECT * FROM b WHERE regexp_extract(project_id, '\\d+$')::INT % 2 = 0)
      SELECT b.project_id, b.people_inputs > 0 AND (b.people IS DISTINCT FROM a.people OR regexp_extract(b.project_id, '\\d+$')::INT % 4 = 0 OR regexp_extract(b.project_id, '\\d+$')::INT % 3 = 0) AS people_recomputed, b.financial IS DISTINCT FROM a.financial AS financial_recomputed FROM b LEFT JOIN a USING (project_id)""",
}
