"""URL filter: domain rules first, then logistic regression on hashed character n-grams.

Everything is a DataFrame expression. The labelled table is small by contract (LABELLED_ROWS at most) and is a table of
its own: verdicts of rules are no labels, as they say nothing of a host's words. The weights that gradient steps reach
are sums of labelled rows' n-grams, so the steps run over one multiplier for each row, with the rows' inner products,
in a single expression; scoring joins nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
NGRAM = 4
#: Bound of the labelled table: the rows whose host and path hash lowest.
LABELLED_ROWS = 512
#: Gradient steps with momentum; RATE is stable as each n-gram vector has length 1 or so.
STEPS, RATE, MOMENTUM, L2 = 60, 10.0, 0.9, 1e-5
#: Words of unwanted sites (gambling, adult, pharmacy spam, scams, advertising) and of ordinary ones. Each stands in
#: hosts with NEUTRAL words, top-level domains and paths that both kinds share, so those say nothing, and in TELLING
#: more hosts with paths that tell their kind, whatever the host's word.
BLOCK_WORDS = "casino poker bets jackpot lottery slots adult porn escorts sexcams viagra pills pharmacy steroids spam phishing malware warez payday replica adserver track popups clickbait".split()
ALLOW_WORDS = "library school museum garden weather recipes travel history science music health clinic bakery university archive council theatre market kitchen cycling football gallery village station hospital journal review courier herald gazette printing carpentry plumbing housing farming fishing sailing hiking painting knitting reading teaching physics chemistry biology algebra geometry grammar".split()
NEUTRAL = "online site world best zone my top hub".split()
FORMS, TELLING = 4, 2
DOMAINS, PATHS = ("com", "net", "org", "info"), ("/", "/en/12", "/index.html", "/fr/7/", "/news/3301", "/de/page.html", "/es/45")

BLOCK_PATHS = ("/bonus/free-spins/claim", "/buy-cheap-meds-online.php", "/xxx/live-cams/18", "/win-big-prize/click.php", "/download/crack-keygen.exe", "/verify-account/login.php?", "/hot-deals/click-here", "/free-bonus/claim-prize.php", "/cheap-meds/buy-now", "/live-cams/free")
ALLOW_PATHS = ("/articles/2021/06/", "/about/contact-us", "/docs/guide/chapter-3", "/lessons/unit-2/", "/opening-hours", "/events/calendar/2022", "/research/papers/", "/members/minutes/2019", "/collections/catalogue", "/visit/plan-your-day")


@dataclass(frozen=True)
class Rule:
    """Fits host and its subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the longest rule that fits (ties: smaller text), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once, however often use asks for it."""
    return F.transform(F.array(value), use)[0]


def ngram_buckets(host: Column, path: Column) -> Column:
    """Buckets of all n-grams, those of host and of path apart; a shorter part counts as one n-gram."""

    def grams(tag: str, s: Column) -> Column:
        def all_of(letters: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(letters) - NGRAM))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(tag), *[F.coalesce(F.get(letters, i + k), F.lit("")) for k in range(NGRAM)])), F.lit(BUCKETS)).cast("int"))

        return once(F.split(s, ""), all_of)

    return F.concat(grams("h", host), grams("p", path))


def block_probability(buckets: Column, weights: list[float], bias: float) -> Column:
    """Sigmoid of bias plus the weights of all n-grams over the root of their number."""
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def score(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda a, i: a + F.element_at(w, i + 1))
        return F.lit(bias) + total / F.sqrt(F.size(grams))

    return 1 / (1 + F.exp(-once(buckets, score)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """host, path, block of the labelled table: a host of each of FORMS, and of TELLING more, for each word."""
    kinds = ((1.0, BLOCK_WORDS), (0.0, ALLOW_WORDS))
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(block).alias("block"), F.lit(i).alias("i")) for block, some in kinds for i, w in enumerate(some)])
    one = lambda some, i: F.get(F.array(*map(F.lit, some)), i % len(some))
    each = spark.range(1).select(F.inline(words)).select("*", F.explode(F.sequence(F.lit(0), F.lit(FORMS + TELLING - 1))).alias("form"))
    n = F.col("i") * FORMS + F.col("form")
    near = one(NEUTRAL, n)
    name = F.get(F.array(F.concat(F.lit("www."), "word", F.lit("-"), near), F.concat(near, "word"), F.concat(near, F.lit("-"), "word"), F.concat("word", near), F.concat("word", F.lit("24")), F.concat(F.lit("the"), "word")), F.col("form"))
    telling = F.when(F.col("block") > 0, one(BLOCK_PATHS, F.col("i") + F.col("form"))).otherwise(one(ALLOW_PATHS, F.col("i") + F.col("form")))
    path = F.when(F.col("form") < FORMS, one(PATHS, n)).otherwise(telling)
    return each.select(F.concat(name, F.lit("."), one(DOMAINS, n)).alias("host"), path.alias("path"), "block")


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias by gradient steps over labelled(host, path, block 0/1); all 0 without rows.

    At most LABELLED_ROWS rows take part; both labels weigh the same in sum. A row of null host or path counts with an empty one; a null label leaves out.
    """
    empty = F.lit("")
    rows = labelled.select(F.coalesce("host", empty).alias("host"), F.coalesce("path", empty).alias("path"), "block").where("block is not null")
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "block").limit(LABELLED_ROWS)
    order = Window.orderBy("host", "path", "block")
    rows = rows.select(F.row_number().over(order).alias("i"), F.col("block").cast("double").alias("y"), ngram_buckets(F.col("host"), F.col("path")).alias("grams"))
    x = rows.select("i", "y", F.explode("grams").alias("bucket"), (1 / F.sqrt(F.size("grams"))).alias("v")).groupBy("i", "y", "bucket").agg(F.sum("v").alias("v"))
    both = x.join(x.select(F.col("i").alias("j"), "bucket", F.col("v").alias("u")), "bucket").groupBy("i", "y", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    near = both.groupBy("i", "y").agg(F.collect_list(F.struct("j", "k")).alias("near"))
    n = F.size("rows")
    table = near.agg(F.array_sort(F.collect_list(F.struct("i", "y", "near"))).alias("rows")).where(n > 0)  # LABELLED_ROWS at most
    dense = lambda near: F.transform(F.sequence(F.lit(1), n), lambda j: F.coalesce(F.element_at(near, j), F.lit(0.0)))
    products = F.transform("rows", lambda r: once(F.map_from_entries(r["near"]), dense))
    zero = F.array_repeat(F.lit(0.0), n)
    start = F.struct(zero.alias("a"), zero.alias("speed"), F.lit(0.0).alias("b"), F.lit(0.0).alias("b_speed"))

    def steps(data: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            dot = lambda k: F.aggregate(F.zip_with(k, s["a"], lambda u, v: u * v), F.lit(0.0), lambda t, u: t + u)
            errors = F.zip_with(data["products"], data["ys"], lambda k, y: (y - 1 / (1 + F.exp(-(s["b"] + dot(k))))) * F.when(y > 0.5, data["block"]).otherwise(data["allow"]))

            def moved(e: Column) -> Column:
                pull = F.zip_with(e, s["a"], lambda u, a: (u - L2 * a) * RATE)
                b_speed = s["b_speed"] * MOMENTUM + F.aggregate(e, F.lit(0.0), lambda t, u: t + u) * RATE
                speed = F.zip_with(s["speed"], pull, lambda v, u: v * MOMENTUM + u)
                return once(speed, lambda v: F.struct(F.zip_with(s["a"], v, lambda x, u: x + u).alias("a"), v.alias("speed"), (s["b"] + b_speed).alias("b"), b_speed.alias("b_speed")))

            return once(errors, moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)

    ys = F.transform("rows", lambda r: r["y"])
    blocks = F.size(F.filter(ys, lambda y: y > 0.5))
    weight = lambda own: F.when((blocks > 0) & (blocks < n), 0.5 / own).otherwise(1 / n)
    data = F.struct(products.alias("products"), ys.alias("ys"), weight(blocks).alias("block"), weight(n - blocks).alias("allow"))
    model = table.select(once(data, steps).alias("m"))
    each = model.select(F.posexplode("m.a").alias("at", "a")).select((F.col("at") + 1).alias("i"), "a")
    found = each.join(x, "i").groupBy("bucket").agg(F.sum(F.col("a") * F.col("v")).alias("w"))
    found = found.unionByName(model.select(F.lit(-1).alias("bucket"), F.col("m.b").alias("w"))).collect()  # as many rows as the labelled table has n-grams, and one
    weights = dict(map(tuple, found))
    return [weights.get(i, 0.0) for i in range(BUCKETS)], weights.get(-1, 0.0)


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row of pages(page_id, url).

    labelled(host, path, block 0/1) is what the method learns from; labelled_urls() if not given. A null url, or one
    without '://', has an empty host and path and takes the method's verdict. Repeated rows are judged one by one, null
    page_ids stay, other columns are left out, and an empty table gives no rows. A url of any length is judged whole.
    The method blocks above a score of 0.5.
    """
    weights, bias = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    scored = judged.withColumn("block_score", block_probability(ngram_buckets(F.col("host"), F.col("path")), weights, bias))
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "block_score")
