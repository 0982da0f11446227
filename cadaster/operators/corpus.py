"""Document corpus: sections, chunks, child chunks, keyword ranking and budgeted packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import text

HEADER, BOLD = r"^(#{1,6})\s+(.*)", r"^\*\*(.+?)\*\*\s*(.*)"
TITLE_WORDS = r"ARTICLE|SECTION|CHAPITRE|PARTIE|ANNEXE|TITRE"
MIN_CHARS = 50
#: Tokens over which a sentence is packed word by word.
LONG_PIECE = 40
DROPPED_TAGS = ["script", "style", "header", "footer", "nav", "noscript", "iframe"]
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def title_of(line: Column) -> Column:
    """A header line's title; null for other lines."""
    t = F.trim(line)
    bold = F.trim(F.regexp_extract(t, BOLD, 1))
    is_bold = F.rlike(t, F.lit(BOLD)) & (F.rlike(F.upper(bold), F.lit(TITLE_WORDS)) | (F.length(t) < 100))
    plain = lambda c: F.translate(F.trim(c), "*_", "")
    return F.when(F.rlike(line, F.lit(HEADER)), plain(F.regexp_extract(line, HEADER, 2))).when(is_bold, plain(F.concat_ws(" ", bold, F.regexp_extract(t, BOLD, 2))))


def sections(elements: DataFrame) -> DataFrame:
    """document_id, section, title, text: a header line starts a section.

    elements: document_id, text. Lines are numbered within their document, so the running count of
    headers names the section; texts are put together again from its lines in order.
    """
    lines = elements.select("document_id", F.posexplode(F.split(text.without_images(F.col("text")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("title", title_of(F.col("line")))
    w = W.partitionBy("document_id").orderBy("pos")
    lines = lines.withColumn("section", F.count("title").over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy("document_id", "section").agg(F.coalesce(F.max("title"), F.lit("Introduction")).alias("title"), text.without_images(body).alias("text"))
    return out.where(F.length(F.trim("text")) >= 5)


#: What a text is cut at, the first that leaves pieces small enough: paragraphs, lines, sentences, words; what is too long even then, at any character.
SEPARATORS = ("\n\n", "\n", ".", " ")
#: A mark that texts are cut at in between; no text has it.
_CUT = "\u0001"


def recursive_parts(value: Column, most: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The parts of a text, none over `most` tokens.

    The text is cut before each of the first separator. Pieces side by side that are under `most` are packed into
    parts, each of which repeats the last pieces of the one before, `overlap` tokens together at most; a piece
    that is not is cut by the next separator, and in the end at every so many characters.
    """
    nothing = F.expr("cast(array() AS array<string>)")
    if not separators:
        size, step = 4 * most, 4 * (most - overlap)
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(value) - size) / step), F.lit(0)).cast("int"))
        return F.transform(starts, lambda i: F.substring(value, i * step + 1, F.lit(size)))
    mark = separators[0]
    pieces = F.filter(F.split(F.replace(value, F.lit(mark), F.lit(_CUT + mark)), _CUT), lambda x: x != "")

    def packed(run):
        joined = lambda r: F.array_join(F.slice(run, r["first"] + 1, r["last"] - r["first"] + 1), "")
        return F.when(F.size(run) > 0, F.transform(pack_pieces(F.transform(run, text.token_estimate), most, overlap), joined)).otherwise(nothing)

    start = F.struct(nothing.alias("run"), nothing.alias("out"))

    def step(acc, piece):
        small = text.token_estimate(piece) < most
        return F.struct(
            F.when(small, F.array_append(acc["run"], piece)).otherwise(nothing).alias("run"),
            F.when(small, acc["out"]).otherwise(F.concat(acc["out"], packed(acc["run"]), recursive_parts(piece, most, overlap, separators[1:]))).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.concat(acc["out"], packed(acc["run"])))


def split_oversize(rows: DataFrame, most: int, overlap: int) -> DataFrame:
    """Sections over `most` tokens cut into parts: part (0 for the first or only one), section_type, title, text.

    Parts are without blanks at their ends, and empty ones are left out.
    """
    over = text.token_estimate(F.col("text")) > most
    cut = F.filter(F.transform(recursive_parts(F.col("text"), most, overlap), text.strip), lambda x: x != "")
    out = rows.select("document_id", "section", "title", over.alias("over"), F.posexplode(F.when(over, cut).otherwise(F.array("text"))).alias("part", "text"))
    kind = F.when(F.col("over"), "section_split").otherwise("section")
    title = F.when(F.col("over"), F.concat("title", F.lit(" (Part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return out.select("document_id", "section", "part", kind.alias("section_type"), title.alias("title"), "text")


def chunks(parts: DataFrame) -> DataFrame:
    """Informative parts with stable ids; the index counts those left out too."""
    w = W.partitionBy("document_id").orderBy("section", "part")
    rows = parts.withColumn("index", F.row_number().over(w) - 1).where(text.is_informative(F.col("text")))
    return rows.select(F.format_string("%s_%04d", "document_id", "index").alias("parent_id"), "document_id", "section_type", "title", "text", F.length("text").alias("char_count"), text.token_estimate(F.col("text")).alias("token_estimate"))


def manifest_totals(files: DataFrame, parents: DataFrame, by: str) -> DataFrame:
    """by, files, with_chunks, chunks, tokens, longest: what a manifest's files came to.

    files: document_id and `by`; parents: chunks(). The longest is the document of most tokens.
    """
    per = parents.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"))
    rows = files.select("document_id", by).join(per, "document_id", "left")
    return rows.groupBy(by).agg(F.count("*").alias("files"), F.count("chunks").alias("with_chunks"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))


def pack_rows(header_tokens: Column, sizes: Column, most: int) -> Column:
    """Which child chunk each row of a table goes to: rows fill a chunk beside the repeated header until it is full."""
    start = F.struct(F.lit(0).alias("chunk"), header_tokens.cast("int").alias("used"), F.lit(0).alias("rows"), F.expr("cast(array() AS array<int>)").alias("out"))

    def step(acc, size):
        full = (acc["used"] + size > most - 10) & (acc["rows"] > 0)
        chunk = acc["chunk"] + full.cast("int")
        return F.struct(
            chunk.alias("chunk"), F.when(full, header_tokens + size).otherwise(acc["used"] + size + 1).cast("int").alias("used"),
            F.when(full, 1).otherwise(acc["rows"] + 1).alias("rows"), F.array_append(acc["out"], chunk).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _pieces(value: Column) -> Column:
    """Pieces of a prose text, each with what ends it: paragraphs, lines, sentences, and words where a sentence is long."""
    ends = F.split(value, r"(?<=\n)|(?<=[.!?] )")
    words = lambda piece: F.when(text.token_estimate(piece) > LONG_PIECE, F.split(piece, r"(?<= )")).otherwise(F.array(piece))
    return F.filter(F.flatten(F.transform(ends, words)), lambda x: x != "")


def pack_pieces(sizes: Column, most: int, overlap: int) -> Column:
    """(first, last) of the runs of pieces that fill chunks of `most`; a chunk repeats the last pieces before it, `overlap` together at most."""
    ends = F.aggregate(sizes, F.expr("array(0)"), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.expr("cast(array() AS array<struct<first: int, last: int>>)").alias("out"))

    def runs(ends):
        between = lambda a, b: F.get(ends, b) - F.get(ends, a)

        def step(acc, size):
            i, first = acc["i"], acc["first"]
            full = (i > first) & (between(first, i) + size > most)
            again = F.filter(F.sequence(F.least(first + 1, i), i), lambda j: (between(j, i) <= overlap) & ((between(j, i) + size <= most) | (j == i)))
            return F.struct((i + 1).alias("i"), F.when(full, F.get(again, 0)).otherwise(first).alias("first"), F.when(full, F.array_append(acc["out"], F.struct(first.alias("first"), (i - 1).alias("last")))).otherwise(acc["out"]).alias("out"))

        last = lambda acc: F.when(acc["i"] > acc["first"], F.array_append(acc["out"], F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last")))).otherwise(acc["out"])
        return F.aggregate(sizes, start, step, last)

    return text.let(ends, runs)


def children(parents: DataFrame, most: int = 200, overlap: int = 50) -> DataFrame:
    """Child chunks of chunks (parent_id, document_id, title, text): chunk_id, parent_id, document_id, text; uninformative ones leave a gap in the numbers.

    A table, that is a text with more bars than lines and a rule below its header, gives groups of
    rows below its repeated header; prose, and tables of contents, give packed pieces.
    """
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    contents = F.contains(F.coalesce("title", F.lit("")), F.lit("Contents")) | F.contains("text", F.lit("Table of Contents"))
    is_table = (count("|") > count("\n")) & F.contains("text", F.lit("---")) & ~contents
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"<br\s*/?>", " "), r"•\s*\n\s*", "• "), r"[ \t]+", " ")
    rows = parents.select("parent_id", "document_id", is_table.alias("is_table"), F.when(is_table, clean).otherwise(F.col("text")).alias("text"))
    lines = F.split(F.trim("text", F.lit(" \n\r")), "\n")
    rule = F.array_position(F.transform(F.slice(lines, 1, 10), lambda x: F.rlike(x, F.lit(r"\|[\s-]*:?[\s-]*\|"))), True)
    rows = text.once(rows, "rule", F.when(F.col("is_table"), rule).otherwise(0))
    short = F.col("is_table") & (text.token_estimate(F.col("text")) <= most)

    def of_table(x):
        header, body = F.array_join(F.slice(x, 1, F.col("rule").cast("int")), "\n"), F.filter(F.transform(F.slice(x, F.col("rule").cast("int") + 1, F.size(x)), lambda r: F.trim(r)), lambda r: r != "")
        packed = lambda b: F.arrays_zip(b.alias("row"), pack_rows(text.token_estimate(header), F.transform(b, text.token_estimate), most).alias("chunk"))
        groups = lambda z: F.transform(F.array_distinct(F.transform(z, lambda r: r["chunk"])), lambda k: F.concat(header, F.lit("\n"), F.array_join(F.transform(F.filter(z, lambda r: r["chunk"] == k), lambda r: r["row"]), "\n")))
        return text.let(body, lambda b: text.let(packed(b), groups))

    def of_prose(pieces):
        joined = lambda r: F.trim(F.array_join(F.slice(pieces, r["first"] + 1, r["last"] - r["first"] + 1), ""), F.lit(" \n\r\t"))
        return F.transform(pack_pieces(F.transform(pieces, text.token_estimate), most, overlap), joined)

    texts = F.when(short, F.array("text")).when(F.col("rule") > 0, text.let(lines, of_table)).otherwise(text.let(_pieces(F.col("text")), of_prose))
    out = rows.select("parent_id", "document_id", F.posexplode(texts).alias("k", "text")).where(text.is_informative(F.col("text")))
    return out.select(F.format_string("%s_c_%03d", "parent_id", "k").alias("chunk_id"), "parent_id", "document_id", "text")


def rank_by_keywords(rows: DataFrame, keywords: list[str], haystack: Column) -> DataFrame:
    """Adds `hits`, the keywords found in the canonical text; short texts have none, nor do empty keywords count."""
    known = [text.canonical_name(F.lit(k)) for k in keywords]  # literals, folded when the plan is made
    hits = lambda hay: sum((F.when((k != "") & F.contains(hay, k), 1).otherwise(0) for k in known), F.lit(0))
    return text.once(rows, "hits", F.when(F.length("text") >= MIN_CHARS, text.let(text.canonical_name(haystack), hits)).otherwise(0))


def with_neighbours(rows: DataFrame, k: int, pages: int | None = None) -> DataFrame:
    """Rows with hits, their k neighbours on each side, and of those pages up to so many after the first."""
    w = W.partitionBy("document_id").orderBy("index")
    near = rows.withColumn("near", F.max((F.col("hits") > 0).cast("int")).over(w.rowsBetween(-k, k))).where((F.col("near") > 0) & (F.length("text") >= MIN_CHARS)).drop("near")
    if pages is None:
        return near
    first = F.min("page").over(W.partitionBy("document_id"))
    return near.withColumn("first", first).where(F.col("page").isNull() | (F.col("page") <= F.col("first") + pages)).drop("first")


def within_budget(rows: DataFrame, order: list, most: int, least: int = 200) -> DataFrame:
    """Texts in order while they fit; the first that does not is cut if over `least` characters are left, and ends it."""
    w = W.partitionBy("document_id").orderBy(*order)
    rows = rows.withColumns({"n": F.row_number().over(w), "end": F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    over = F.min(F.when(F.col("end") > most, F.col("n"))).over(W.partitionBy("document_id"))
    rows = rows.withColumns({"over": over, "left": most - (F.col("end") - F.length("text"))})
    cut = F.when(F.col("n") < F.coalesce("over", F.col("n") + 1), F.col("text")).when((F.col("n") == F.col("over")) & (F.col("left") > least), F.concat(F.expr("substring(text, 1, left)"), F.lit("\n[…]")))
    return rows.withColumn("kept", cut).where("kept IS NOT NULL").drop("over", "left", "end")


def context(rows: DataFrame, most: int, least: int = 200, tail: bool = False) -> DataFrame:
    """A document's texts for a question, `kept`, in the order `place`: those with hits first, as within_budget() takes them.

    tail: then those without hits, in order, while they fit. Where nothing is kept by then, all texts
    in order while they fit. rows: document_id, index, text, hits. Short texts are no filling.
    """
    by = W.partitionBy("document_id")
    size, hit = F.length("text"), F.col("hits") > 0
    until = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    first_over = lambda which, end, at: F.min(F.when(which & (F.col(end) > most), F.col(at))).over(by)
    rows = rows.withColumn("n", F.row_number().over(by.orderBy(F.desc(hit), F.when(hit, -F.col("hits")), "index")))
    rows = rows.withColumn("end", F.sum(F.when(hit, size)).over(until(by.orderBy("n"))))
    rows = rows.withColumn("over", F.coalesce(first_over(hit, "end", "n"), F.lit(1 << 30)))
    whole = hit & (F.col("n") < F.col("over"))
    left = most - (F.col("end") - size)
    rows = rows.withColumns({"whole": whole, "left": left, "total": F.coalesce(F.sum(F.when(whole, size)).over(by), F.lit(0))})
    kept = F.when(F.col("whole"), F.col("text")).when(hit & (F.col("n") == F.col("over")) & (F.col("left") > least), F.concat(F.expr("substring(text, 1, left)"), F.lit("\n[…]")))
    rows = rows.withColumn("kept", kept)
    filling = ~hit & (size >= MIN_CHARS) if tail else F.lit(False)
    rows = rows.withColumn("end", F.col("total") + F.sum(F.when(filling, size).otherwise(0)).over(until(by.orderBy("index"))))
    rows = rows.withColumn("over", F.coalesce(first_over(filling, "end", "index"), F.lit(1 << 30)))
    rows = rows.withColumn("kept", F.coalesce("kept", F.when(filling & (F.col("index") < F.col("over")), F.col("text"))))
    plain = size >= MIN_CHARS
    rows = rows.withColumns({"nothing": F.count("kept").over(by) == 0, "end": F.sum(F.when(plain, size).otherwise(0)).over(until(by.orderBy("index")))})
    rows = rows.withColumn("over", F.coalesce(first_over(plain, "end", "index"), F.lit(1 << 30)))
    rows = rows.withColumn("kept", F.when(F.col("nothing") & plain & (F.col("index") < F.col("over")), F.col("text")).otherwise(F.col("kept")))
    place = F.row_number().over(by.orderBy(F.when(F.col("nothing"), F.col("index")).otherwise(F.col("n"))))
    return rows.where("kept IS NOT NULL").withColumn("place", place).drop("n", "end", "over", "whole", "left", "total", "nothing")


def head(rows: DataFrame, most: int) -> DataFrame:
    """A document's texts in order, `kept`, up to so many characters; the last is cut. rows: document_id, index, text."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("document_id").orderBy("index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("left", (most - before).cast("int")).where("left > 0 AND text <> ''").withColumn("kept", F.expr("substring(text, 1, left)")).drop("left")


def page_text(html: Column) -> Column:
    """The text of a web page: no scripts, styles and frames; TeX and image captions kept; lines trimmed, blank ones dropped."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*math/tex[^>]*>(.*?)</script>", r" \$ $1 \$ ")
    t = F.regexp_replace(t, r"(?is)<img[^>]*\balt=[\"']([^\"']+)[\"'][^>]*>", " [IMAGE: $1] ")
    for tag in DROPPED_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->|<[^>]*>", "\n")
    for code, char in ENTITIES:
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
