"""Operator 6: URL filters, in Spark expressions only.

Rules come first: a rule names a host, which it fits with all its subdomains, and a path prefix; the
longest fitting rule decides. Other URLs are judged by a logistic regression over hashed character
n-grams of host and path. It is fitted from a small labelled table of URLs, a row of arrays at a
time, by gradient descent written as one fold over Spark arrays.

Edge cases: a null URL or one without `://` has an empty host and path and is judged by the model
(no n-grams: the intercept); an empty path fits no rule whose path is `/`; of rules of one length the
one that stands later in the list decides; repeated rows are each judged; columns other than page_id and url are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

BUCKETS = 2048
GRAMS = (3, 4)
STEPS, RATE, L2 = 300, 0.5, 0.001
BLOCK_ABOVE = 0.5

#: The labelled table: hosts and paths that a crawl keeps (0) or leaves out (1). Fixed values, written from general
#: knowledge of how such addresses are built: what shops, schools, papers and forums call their pages, and what link farms, pill
#: and loan mills, betting and adult sites, parked names and trackers do. None names a real site.
KEEP = """
www.rosegarden-society.org/articles/pruning-in-march.html
library.northfield.edu/catalogue/records/88213
blog.woodworkersguild.org/2021/06/dovetail-joints-by-hand/
news.harbourherald.co.uk/local/council-approves-new-bridge
docs.openmatrixlib.io/en/latest/tutorial/quickstart.html
www.stadtbibliothek-altenberg.de/angebote/lesungen/herbst
museum.villeneuve-sur-loire.fr/expositions/ceramique-ancienne
recipes.grandmaskitchen.ca/soups/leek-and-potato
www.physics.lakeside.ac.uk/research/groups/optics/publications
forum.vintagecyclists.net/threads/restoring-a-steel-frame.4821/
weather.coastalwatch.gov/forecast/tides/week
en.encyclopaedia-libre.org/wiki/History_of_paper
journal.appliedbotany.org/vol12/issue3/paper7.pdf
www.orquesta-sinfonica-merida.es/temporada/programa
school.riverbend.k12.us/parents/calendar/term-dates
trainspotters.railclub.org/galleries/steam/1954
www.handelskammer-suedwest.de/ausbildung/berufe/tischler
astronomy.backyardstars.com/guides/first-telescope
www.mairie-saint-aubin.fr/vie-municipale/comptes-rendus/2019
healthadvice.countyclinic.org/topics/asthma/inhalers
travelnotes.slowroads.com/portugal/lisbon-on-foot
code.smalltools.dev/projects/parser/issues/17
www.theatre-des-halles.fr/saison/billetterie
maps.hikingtrails.org/routes/northern-ridge/day-3
poetry.quietpages.com/essays/on-translation
www.farmersunion.org/policy/water-and-soil
chemistry.openlectures.edu/courses/organic/week-5/notes
archive.localhistory.org/letters/1911/february
www.camaracomercio-leon.es/empresas/formacion
parks.greenbelt.gov/visit/opening-hours
philosophy.readinggroup.net/discussions/kant-preface
www.knittingpatterns.org.uk/free/childrens-cardigan
""".split()
LEAVE = """
www.best-cheap-pills4u.biz/buy-now/viagra-no-prescription
casino-jackpot-777.info/bonus/free-spins
xxx-hot-cams.tv/live/girls/page9
payday-loans-instant.top/apply-now/bad-credit-ok
replica-watches-outlet.shop/sale/rolex-80-off
click.adtrack-network.com/pixel/redirect/8f3a
free-movie-torrents.cc/download/full-hd-cracked
seo-backlinks-cheap.xyz/order/1000-links
win-a-free-phone.click/claim/prize/you-won
adult-dating-tonight.net/profiles/hot-singles
pharmacy-online-discount.ru/tramadol/overnight-shipping
bet365-bonus-codes.info/odds/sure-win-tips
lose-weight-fast-keto.store/miracle/order
parked-domain-for-sale.com/buy-this-domain
porn-tube-free.sex/videos/amateur/42
crypto-doubler-invest.biz/register/guaranteed-profit
fake-passport-documents.to/order/eu
banner.popunder-ads.net/serve/zone/119
essay-mill-writers.pro/cheap/order-now
spam-comments-list.top/links/page77
slots-poker-online.bet/play/roulette-bonus
viagra-cialis-generic.su/checkout/cheap
keygen-serials-crack.ws/full/license-key
hot-escorts-city.club/girls/24h
make-money-home-fast.info/secret/millionaire
cheap-handbags-replica.cn/outlet/louis
ringtones-free-win.mobi/subscribe/premium
link-farm-directory.biz/submit/free-links
bitcoin-casino-slots.io/faucet/spin-to-win
nude-celebs-leaked.xxx/gallery/hot
instant-loan-approval.loan/apply/no-credit-check
miracle-cure-supplement.shop/buy/discount-pills
""".split()


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule is tested first: it stands outermost
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, n: int, seed: int) -> Column:
    """Buckets of a text's n-grams: a polynomial of code points, which any SQL engine can compute."""
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    code = lambda g: sum((F.ascii(F.substring(g, i + 1, 1)) * 131**i for i in range(n)), F.lit(seed * 1009 + n))
    return F.transform(F.filter(found, lambda g: F.length(g) == n), lambda g: F.pmod(code(g), F.lit(BUCKETS)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Buckets of the distinct character n-grams of `^host$` and of the path; each part has its own hashes."""
    parts = ((F.concat(F.lit("^"), host, F.lit("$")), 7), (path, 13))
    return F.array_distinct(F.flatten(F.array(*(_grams(text, n, seed) for text, seed in parts for n in GRAMS))))


def labelled(spark: SparkSession) -> DataFrame:
    """url, y (1: to be left out) of the list above; fit() takes any other table of this form as well."""
    rows = [(f"http://{u}", 0.0) for u in KEEP] + [(f"http://{u}", 1.0) for u in LEAVE]
    return spark.createDataFrame(rows, "url string, y double").coalesce(1)


def fit(table: DataFrame) -> list[float]:
    """Weights of the logistic regression, BUCKETS + 1 of them, the last being the intercept.

    table: url, y. It is small by contract (a hand-labelled list), so it is one row of arrays here:
    full-batch gradient descent folds over STEPS, all in Spark expressions.
    """
    x = table.select(F.concat(features(host(F.col("url")), path(F.col("url"))), F.array(F.lit(BUCKETS))).alias("f"), F.col("y"))
    one = x.agg(F.sort_array(F.collect_list(F.struct("y", "f"))).alias("rows"))
    with_feature = lambda j: F.filter(F.transform("rows", lambda r, i: F.when(F.array_contains(r["f"], j), i).otherwise(-1)), lambda i: i >= 0)
    postings = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), with_feature)
    margin = lambda w, r: F.aggregate(r["f"], F.lit(0.0), lambda s, j: s + F.get(w, j))

    def descend(table):
        rows, postings = table["rows"], table["postings"]

        def step(w, _):
            off = F.transform(rows, lambda r: r["y"] - 1 / (1 + F.exp(-margin(w, r))))
            gradient = lambda e, p: F.aggregate(p, F.lit(0.0), lambda s, i: s + F.get(e, i)) / F.size(rows)
            update = lambda e: F.transform(w, lambda v, j: v + RATE * (gradient(e, F.get(postings, j)) - L2 * v))
            return _let(off, update)

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array_repeat(F.lit(0.0), BUCKETS + 1), step)

    return one.select(_let(F.struct("rows", postings.alias("postings")), descend).alias("w")).first().w


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's probability that the URL is to be blocked."""
    w = F.lit(weights)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("buckets", features(F.col("host"), F.col("path")))
    rows = rows.withColumn("p_block", 1 / (1 + F.exp(-F.aggregate("buckets", F.lit(weights[-1]), lambda s, j: s + F.get(w, j)))))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("p_block") >= BLOCK_ABOVE, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "p_block")
