"""People and companies: director matching, enrichment, name matching, networks, mandates, publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import labels, numbers, text
from cadaster.operators import matching

#: Phrases of distress in official notices, most serious first.
DISTRESS = [
    "liquidation judiciaire", "redressement judiciaire", "procédure de sauvegarde", "cessation des paiements", "clôture pour insuffisance d'actif", "jugement d'ouverture",
    "conversion en liquidation judiciaire", "plan de redressement", "plan de sauvegarde", "administrateur judiciaire", "mandataire judiciaire", "liquidateur", "dissolution anticipée", "radiation",
    "cessation d'activité", "privilège URSSAF", "privilège du Trésor", "défaut de dépôt des comptes",
]
MATCH_ABOVE, CONFIDENT = 0.35, 0.55
#: Representatives for each task that holds whole networks: its nodes, some twenty for each on the given tables, are grouped in memory.
REPRESENTATIVES_PER_TASK = 25_000


def letters(name: Column) -> Column:
    """A name's letters a-z; accented ones go, as the registry's matching has it."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z]", "")


def _name_parts(*names: Column) -> Column:
    """Each name's letters, and those of each of its words."""
    return F.flatten(F.array(*(F.concat(F.array(letters(n)), F.transform(F.split(text.strip(F.coalesce(n, F.lit(""))), r"(?U)[\s,;/()-]+"), letters)) for n in names)))


def _with(rows: DataFrame, **kinds: str) -> DataFrame:
    """rows with columns that they may lack, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns})


def distinct_directors(found: DataFrame, by: list[str]) -> DataFrame:
    """The first, by ordinal, of the records of one director: same letters of the full name, same birth date (or month) and same set of companies.

    found: nom_complet, date_de_naissance, date_de_naissance_rgpd, sirens (an array), ordinal, and what `by` names.
    """
    found = _with(found, nom_complet="string", date_de_naissance_rgpd="string", sirens="array<string>", ordinal="long")
    sirens = F.filter(F.transform(F.coalesce("sirens", F.expr("cast(array() AS array<string>)")), lambda s: text.strip(F.coalesce(s, F.lit("")))), lambda s: s != "")
    birth = F.coalesce(F.nullif("date_de_naissance", F.lit("")), F.nullif("date_de_naissance_rgpd", F.lit("")), F.lit(""))
    same = F.sha2(F.concat_ws("|", letters(F.col("nom_complet")), birth, F.array_join(F.array_sort(F.array_distinct(sirens)), ",")).cast("binary"), 256)
    whole = F.struct(*found.columns)
    return found.groupBy(*by, same.alias("__signature")).agg(F.min_by(whole, F.struct(F.coalesce("ordinal", F.lit(1 << 62)), "director_id")).alias("x")).select("x.*")


def match_people(people: DataFrame, found: DataFrame) -> DataFrame:
    """person_id, director_id, mode: which of the directors found for a person are that person.

    people: person_id, nom, prenoms, date_naissance. found: person_id, director_id, nom, prenom, date_de_naissance
    and, where there are, prenom_usuel, nom_complet, date_de_naissance_rgpd (a month), sirens, ordinal. Records of one director
    count once. Same names first, else everybody found; then the exact birth date with records of
    the same month, else the month, else an only candidate, else nobody.
    """
    p = people.select("person_id", letters(F.col("nom")).alias("p_nom"), letters(labels.first_given_name(F.col("prenoms"))).alias("p_prenom"), numbers.birth(F.col("date_naissance")).alias("p_birth"))
    found = distinct_directors(_with(found, prenom_usuel="string"), ["person_id"])
    rows = found.join(p, "person_id").withColumns({"birth": numbers.birth(F.col("date_de_naissance")), "by_month": numbers.birth(F.col("date_de_naissance_rgpd"))})
    surname = letters(F.coalesce(F.nullif("nom", F.lit("")), "nom_complet"))
    named = (F.col("p_nom") != "") & (surname == F.col("p_nom")) & ((F.col("p_prenom") == "") | F.array_contains(_name_parts(F.col("prenom"), F.col("prenom_usuel"), F.col("nom_complet")), F.col("p_prenom")))
    w = W.partitionBy("person_id")
    rows = rows.withColumn("named", named).withColumn("any_named", F.max(F.col("named").cast("int")).over(w)).where((F.col("any_named") == 0) | F.col("named"))
    exact, month = F.coalesce(F.col("birth.day") == F.col("p_birth.day"), F.lit(False)), F.coalesce(F.coalesce("birth.month", "by_month.month") == F.col("p_birth.month"), F.lit(False))
    rows = rows.withColumns({"exact": exact, "month": month}).withColumns({"n": F.count("*").over(w), "exacts": F.count_if("exact").over(w), "months": F.count_if("month").over(w)})
    mode = (
        F.when(F.col("exacts") > 0, F.when(F.col("exact") | F.col("month"), "date_de_naissance_plus_rgpd"))
        .when(F.col("months") > 0, F.when(F.col("month"), "date_de_naissance_rgpd"))
        .when(F.col("n") == 1, "candidat_unique")
    )
    return rows.select("person_id", "director_id", mode.alias("mode")).where("mode IS NOT NULL")


def enrich(mandates: DataFrame, details: DataFrame) -> DataFrame:
    """Mandates (person_id, siren, nom) with company details by nine-digit id; a detail outweighs the stub."""
    known = F.when(F.length("siren") == 9, F.col("siren"))
    d = details.select(F.col("siren").alias("d_siren"), F.col("nom").alias("d_nom"), "statut", "capital")
    return mandates.join(d, known == F.col("d_siren"), "left").select("person_id", "siren", F.coalesce("d_nom", "nom").alias("nom_societe"), "statut", "capital")


def merge_companies(rows: DataFrame) -> DataFrame:
    """One company per id, else per lower-case name: key, the first value of each column that is not empty, the first ordinal.

    rows: siren, nom, ordinal and any other columns. Empty are null, no text and empty lists; rows with neither id nor name go.
    """
    key = F.coalesce(F.nullif(text.strip(F.col("siren")), F.lit("")), F.nullif(F.lower(text.strip(F.col("nom"))), F.lit("")))
    kinds = dict(rows.dtypes)

    def first(c):
        some = F.col(c) != "" if kinds[c] == "string" else F.size(c) > 0 if kinds[c].startswith(("array", "map")) else F.col(c).isNotNull()
        return F.min_by(c, F.when(some, F.col("ordinal"))).alias(c)

    return rows.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(*(first(c) for c in rows.columns if c != "ordinal"), F.min("ordinal").alias("ordinal"))


def _parts(name: Column, held: bool) -> Column:
    """(tag, part, need) of a name: its words and its compact forms' letters, with and without legal forms.

    held: those of which a name that scores with this one has a rarest: of n words all but a third and a bit, as more than
    MATCH_ABOVE of them must be shared; of a compact form any one run of letters.
    """
    part = lambda tag, parts, need: F.transform(parts, lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("part"), need.cast("int").alias("need")))
    out = []
    for tag, form in (("", name), ("-", labels.bare(name))):
        words, letters_ = labels.name_words(form), labels.compact(form)
        out.append(part(f"w{tag}", words, F.size(words) - F.floor(F.size(words) * MATCH_ABOVE)))
        out.append(part(f"c{tag}", matching.held_parts(letters_) if held else matching.holding_parts(letters_), F.lit(1)))
    return F.concat(*out)


def best_matches(folders: DataFrame, pool: DataFrame) -> DataFrame:
    """project_id, folder, siren, nom, score, confident: the most similar company of the project, the first of equals.

    folders: project_id, folder. pool: project_id, siren, nom, ordinal. Within a project, names meet on the rarest of
    what any name that scores shares with them, in both directions; distinct names once.
    """
    f, c = folders.distinct().withColumn("a", F.col("folder")), pool.select("project_id", F.col("nom").alias("a")).distinct()
    some = lambda df: df.select("project_id", "a", F.inline(_parts(F.col("a"), True)))
    all_ = lambda df: df.select("project_id", F.col("a").alias("b"), F.inline(_parts(F.col("a"), False))).drop("need")
    there = matching.candidates(some(f), all_(c), ["project_id"]).toDF("project_id", "folder", "nom")
    back = matching.candidates(some(c), all_(f), ["project_id"]).toDF("project_id", "nom", "folder")
    pairs = there.unionByName(back).distinct()
    score = F.greatest(labels.similarity(F.col("folder"), F.col("nom")), labels.similarity(F.col("nom"), F.col("folder")))
    scored = text.once(pairs, "score", score).where(F.col("score") > MATCH_ABOVE).join(pool.hint("merge"), ["project_id", "nom"])
    best = scored.groupBy("project_id", "folder").agg(F.max_by(F.struct("siren", "nom", "score"), F.struct("score", -F.col("ordinal"))).alias("x"))
    return best.select("project_id", "folder", "x.*", (F.col("x.score") >= CONFIDENT).alias("confident"))


def cascade(folders: DataFrame, pools: list[DataFrame]) -> DataFrame:
    """best_matches() against pools in order; the first pool with a match decides, as match_tier says."""
    out = None
    for tier, pool in enumerate(pools):
        own = best_matches(folders, pool).withColumn("match_tier", F.lit(tier))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("project_id", "folder").agg(F.min_by(F.struct("siren", "score"), "match_tier").alias("x"), F.min("match_tier").alias("match_tier")).select("project_id", "folder", "x.*", "match_tier")


def visits(roots: DataFrame, representatives: DataFrame, mandates: DataFrame, predecessors: DataFrame) -> DataFrame:
    """root, siren, visit (from 1), rank, src, label, dashed: the companies found around each root, each by the first visit only.

    Representatives are gone through in order: one that is a company is visited (rank 1), of a person's companies
    those that live, in order (rank 2); then the predecessors (rank 1). Who comes to a company that was visited draws no edge.
    Visits of one order come by src, then siren.
    """
    soc = lambda c: F.concat(F.lit("soc_"), c)
    start = roots.select(F.col("siren").alias("root"), F.col("siren"))
    visit = lambda siren, rank, src, label, dashed, order: F.struct(siren.alias("siren"), F.struct(*(x.cast("long") for x in order)).alias("order"), F.lit(rank).alias("rank"), src.alias("src"), label.alias("label"), F.lit(dashed).alias("dashed"))
    reps = start.join(representatives.select("siren", "ordinal", "person_id", "company", "qualite"), "siren")
    companies = reps.where("company IS NOT NULL").select("root", visit(F.col("company"), 1, soc(F.col("root")), F.coalesce("qualite", F.lit("Lié")), False, (F.col("ordinal"), F.lit(0))).alias("v"))
    people = reps.where("person_id IS NOT NULL").groupBy("root", "person_id").agg(F.min("ordinal").alias("rep"))
    theirs = people.join(mandates.where("NOT entreprise_cessee").select("person_id", F.col("ordinal").alias("at"), F.col("siren").alias("held"), "qualite"), "person_id")
    held = theirs.select("root", visit(F.col("held"), 2, F.col("person_id"), F.coalesce("qualite", F.lit("Dirigeant")), False, (F.col("rep"), F.col("at"))).alias("v"))
    before = start.join(predecessors, "siren").select("root", visit(F.col("predecessor"), 1, soc(F.col("root")), F.lit("Prédécesseur"), True, (F.lit(1 << 62), F.col("ordinal"))).alias("v"))
    # a root's visits are in one place, for the first of each company and for their numbers
    found = companies.unionByName(held).unionByName(before).where("v.siren <> root").repartition("root")
    first = found.groupBy("root", F.col("v.siren").alias("siren")).agg(F.min_by("v", F.struct("v.order", "v.src")).alias("v"))
    number = F.row_number().over(W.partitionBy("root").orderBy("v.order", "v.src", "siren"))
    return first.select("root", "siren", number.alias("visit"), "v.rank", "v.src", "v.label", "v.dashed")


def _around(roots: DataFrame, representatives: DataFrame, mandates: DataFrame, predecessors: DataFrame, people: DataFrame) -> DataFrame:
    """visits() and each root itself (visit 0, rank 0), with people's array of each company; empty for those that have nobody.

    people: siren, people.
    """
    root = roots.select(F.col("siren").alias("root"), "siren", F.lit(0).alias("visit"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("dashed"))
    found = root.union(visits(roots, representatives, mandates, predecessors))
    return found.join(people, "siren", "left").withColumn("people", F.coalesce("people", F.array().cast(people.schema["people"].dataType)))


def _by_root(around: DataFrame, representatives: DataFrame) -> DataFrame:
    """around with all that is around a root in one task, people still in their arrays: what is grouped by root and more is not shuffled again."""
    return around.repartition(1 + representatives.count() // REPRESENTATIVES_PER_TASK, "root")


def _seen(rank: Column) -> Column:
    """A number that is less for an earlier `visit` and tells the rank, 0 to 3, in its last two bits."""
    return F.col("visit").cast("long") * 4 + rank


def network(roots: DataFrame, representatives: DataFrame, mandates: DataFrame, predecessors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: root, node, rank; edges: root, src, dst, label, dashed) around each root company.

    Its representatives, people and companies, the people's other living companies, its predecessors, and the people
    who represent all those. A company's rank is that of the visit that found it; people of the root have rank 1, others one more
    than the first company visited that they represent. representatives: siren, ordinal, person_id or company, qualite; mandates: person_id, ordinal, siren,
    qualite, entreprise_cessee; predecessors: siren, ordinal, predecessor.
    """
    soc = lambda c: F.concat(F.lit("soc_"), c)
    of = representatives.where("person_id IS NOT NULL").groupBy("siren")
    names = _around(roots, representatives, mandates, predecessors, of.agg(F.sort_array(F.collect_set("person_id")).alias("people")))
    together = _by_root(names.select("root", "siren", "visit", "rank", "people"), representatives)
    node = lambda name, rank: F.struct(name.alias("node"), _seen(rank).alias("seen"))
    several = together.select("root", F.inline(F.concat(F.array(node(soc(F.col("siren")), F.col("rank"))), F.transform("people", lambda p: node(p, F.col("rank") + 1)))))
    nodes = several.groupBy("root", "node").agg(F.min("seen").bitwiseAND(3).cast("int").alias("rank"))
    said = F.collect_set(F.struct("person_id", F.coalesce("qualite", F.lit("Dirigeant")).alias("qualite")))
    around = _around(roots, representatives, mandates, predecessors, of.agg(said.alias("people")))
    edge = lambda a, b, label, dashed: F.struct(a.alias("src"), b.alias("dst"), label.alias("label"), dashed.alias("dashed"))
    own = F.transform("people", lambda p: edge(soc(F.col("siren")), p["person_id"], p["qualite"], F.lit(False)))
    came = F.filter(F.array(edge(F.col("src"), soc(F.col("siren")), F.col("label"), F.col("dashed"))), lambda e: e["src"].isNotNull())
    return nodes, around.select("root", F.inline(F.concat(came, own)))


def clean_network(roots: DataFrame, representatives: DataFrame, mandates: DataFrame, predecessors: DataFrame, below: int) -> DataFrame:
    """root, src, dst, label: clean_edges() of network()'s edges and its nodes of a rank below `below`, neither of which is shuffled.

    A company's people have their first label each before they come to the roots; there, only the people's first visits
    are left to find, as companies are visited once. Names of people are told from those of companies, which begin with soc_.
    """
    soc = lambda c: F.concat(F.lit("soc_"), c)
    one = representatives.where("person_id IS NOT NULL").select("siren", "person_id", "qualite").repartition("siren").groupBy("siren", "person_id").agg(F.min(F.coalesce("qualite", F.lit("Dirigeant"))).alias("label"))
    # a label once for all who have it: less to shuffle
    people = one.groupBy("siren", "label").agg(F.sort_array(F.collect_list("person_id")).alias("persons")).groupBy("siren").agg(F.collect_list(F.struct("label", "persons")).alias("people"))
    around = _around(roots.select("siren").distinct(), representatives, mandates, predecessors, people)
    together = _by_root(around.select("root", "siren", "visit", "rank", "src", "label", "people"), representatives)
    edge = lambda a, a_rank, b, b_rank, label: F.struct(a.alias("src"), a_rank.cast("int").alias("src_rank"), b.alias("dst"), _seen(b_rank).alias("seen"), label.alias("label"))
    # who comes to a company is the root or one of its own people
    came = F.filter(F.array(edge(F.col("src"), F.when(F.col("src") == soc(F.col("root")), 0).otherwise(1), soc(F.col("siren")), F.col("rank"), F.col("label"))), lambda e: e["src"].isNotNull())
    own = F.flatten(F.transform("people", lambda g: F.transform(g["persons"], lambda p: edge(soc(F.col("siren")), F.col("rank"), p, F.col("rank") + 1, g["label"]))))
    edges = together.select("root", F.inline(F.concat(came, own)))
    first = F.min("seen").over(W.partitionBy("root", "dst")).bitwiseAND(3)
    return edges.withColumn("dst_rank", first).where((F.col("src_rank") < below) & (F.col("dst_rank") < below)).select("root", "src", "dst", "label")


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first label of each pair of nodes; edges whose ends are no nodes go."""
    one = edges.groupBy("root", "src", "dst").agg(F.min("label").alias("label"))
    for side in ("src", "dst"):
        one = one.join(nodes.select("root", F.col("node").alias(side)), ["root", side], "left_semi")
    return one


def _plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text.to_ascii(value)), "[^a-z0-9]+", " "))


def distress_signal(publications: DataFrame) -> DataFrame:
    """siren, sentence, matched: the sentence of a company's notices that says most plainly that it is in distress.

    publications: siren, ordinal, contenu. Sentences are ranked by phrases found, the gravest phrase,
    a full stop, a length near 160, no address of a web site, not all capitals, and shortness.
    """
    clean = F.regexp_replace(F.regexp_replace(text.strip(F.col("contenu")), r"[ \t\r\f\x0B]+", " "), r"(?U)\s*\n+\s*", "\n")
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    said = F.filter(F.transform(F.split(clean, r"(?U)(?<=[.!?;])\s+|\n+"), plain), lambda x: x != "")
    # the phrases are literals, folded when the plan is made; a sentence is folded once
    phrases = [_plain(F.lit(k)) for k in DISTRESS]
    hits = lambda x: text.let(_plain(x), lambda p: F.array_compact(F.array(*(F.when(F.contains(p, k), i) for i, k in enumerate(phrases)))))
    # what a sentence holds the whole notice holds: most notices end here
    rows = text.once(publications.select("siren", "ordinal", "contenu"), "whole", hits(F.col("contenu"))).where(F.size("whole") > 0)
    scored = F.filter(F.transform(said, lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"), hits(x).alias("hits"))), lambda x: F.size(x["hits"]) > 0)
    rows = text.once(rows, "found", scored)
    # a phrase that no sentence holds runs over the end of a line: then the notice is the sentence
    notice = F.array(F.struct(F.lit(0).alias("pos"), plain(F.col("contenu")).alias("sentence"), F.col("whole").alias("hits")))
    rows = rows.select("siren", "ordinal", F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(notice)))
    n = F.length("sentence")
    letters_, capitals = F.length(F.regexp_replace("sentence", r"\P{L}", "")), F.length(F.regexp_replace("sentence", r"\P{Lu}", ""))
    penalty = F.abs(n - 160) + F.when(n < 40, 60).otherwise(0) + F.greatest(n - 320, F.lit(0))
    score = F.struct(
        F.size("hits").alias("a"), (-F.array_min("hits")).alias("b"), F.rlike("sentence", F.lit(r"[.!?]$")).cast("int").alias("c"), (-penalty).alias("d"),
        (-F.rlike(F.lower("sentence"), F.lit(r"https?://|www\.")).cast("int")).alias("e"), (-F.coalesce(capitals / F.nullif(letters_, F.lit(0)) > 0.55, F.lit(False)).cast("int")).alias("f"), (-n).alias("g"),
        (-F.col("ordinal")).alias("h"), (-F.col("pos")).alias("i"))
    return rows.withColumn("score", score).groupBy("siren").agg(F.max_by("sentence", "score").alias("sentence"), F.count_distinct("ordinal").alias("matched"))


def collective_comments(publications: DataFrame) -> DataFrame:
    """siren, comment: `date - nature` of each judgment, a line each, in order."""
    nature = F.nullif(F.trim(F.regexp_extract("contenu", r"(?m)^\s*Nature jugement\s*:\s*(.+?)\s*$", 1)), F.lit(""))
    rows = publications.withColumn("nature", nature).where("nature IS NOT NULL")
    line = F.concat_ws(" - ", F.nullif("date", F.lit("")), "nature")
    return rows.groupBy("siren").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("date", "ordinal", line.alias("line")))), lambda x: x["line"])), "\n").alias("comment"))


def merged_comments(*comments: Column) -> Column:
    """Comments with single blanks, a line each in order of first appearance, the same one in other letters once; null if none says anything."""
    given = F.filter(F.transform(F.array(*comments), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), lambda c: c != "")
    first = lambda all_: F.filter(all_, lambda c, i: F.array_position(F.transform(all_, F.lower), F.lower(c)) == i + 1)
    return F.nullif(F.array_join(text.let(given, first), "\n"), F.lit(""))


def mandate_counts(mandates: DataFrame) -> DataFrame:
    """folder, people, companies, mandates of each folder; mandates: folder, person_id, siren."""
    return mandates.groupBy("folder").agg(F.count_distinct("person_id").alias("people"), F.count_distinct("siren").alias("companies"), F.count("*").alias("mandates"))


def person_cards(mandates: DataFrame) -> DataFrame:
    """A card and the companies of each person of a folder: folder, person_id, value, companies (siren, nom), by appearance.

    mandates: folder, person_id, siren, nom, ordinal.
    """
    found = F.sort_array(F.collect_list(F.struct("ordinal", "siren", "nom")))
    per = mandates.groupBy("folder", "person_id").agg(F.transform(found, lambda m: F.struct(m["siren"].alias("siren"), m["nom"].alias("nom"))).alias("companies"))
    return per.select("folder", "person_id", F.format_string("%d société(s) trouvée(s)", F.size("companies")).alias("value"), "companies")


def mandate_display(rows: DataFrame) -> DataFrame:
    """Display columns of mandates: status, struck-off flag, role, figures."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), numbers.spaced(F.col(c))))
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    status = blank(F.concat_ws(" | ", blank(F.col("statut")), F.when(blank(F.col("statut_rcs")).isNotNull(), F.concat(F.lit("RCS: "), "statut_rcs"))))
    gone = F.contains(text.canonical_name(F.coalesce("statut", F.lit(""))), F.lit("radie")) | F.contains(text.canonical_name(F.coalesce("statut_rcs", F.lit(""))), F.lit("radie"))
    rcs = F.lower(F.trim(F.coalesce("statut_rcs", F.lit(""))))
    role = F.coalesce(blank(F.col("role")), F.when((rcs != "") & (rcs != "inscrit"), "X"))
    return rows.select("mandate_id", status.alias("statut"), gone.alias("radie"), role.alias("role"), blank(F.concat_ws(" | ", part("Capital", "capital"), part("CA", "ca"), part("RN", "rn"))).alias("infos"))


def catalogue(people: DataFrame, companies: DataFrame) -> DataFrame:
    """Catalogue entries: people by canonical name, else by that of their folder, the last one wins; companies from the cache, the last one, before those from extraction, the first one.

    people: project_id, name, ordinal, and folder where known. Companies without a name are no entry.
    """
    people = _with(people, folder="string")
    named = people.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "folder"))
    p = named.withColumn("key", F.coalesce(F.nullif(text.canonical_name(F.col("name")), F.lit("")), text.canonical_name(F.col("folder")))).groupBy("project_id", "key").agg(F.max_by("name", "ordinal").alias("name"))
    cached = F.col("source") == "cache"
    order = F.struct(F.when(cached, 0).otherwise(1), F.when(cached, -F.col("ordinal")).otherwise(F.col("ordinal")))
    c = companies.withColumn("key", text.canonical_name(F.col("name"))).where("key <> ''").groupBy("project_id", "key").agg(F.min_by("name", order).alias("name"))
    return p.withColumn("kind", F.lit("person")).unionByName(c.withColumn("kind", F.lit("company")))
