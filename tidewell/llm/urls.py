"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams for all other URLs.

The model is trained from a fixed table of TABLE_ROWS made-up URLs, which bounds the training cost. Features are the hashed n-grams of 3 to
5 characters of the host and of the path, each counted once. Host and path have tables of 2^BITS weights each, so the n-grams of a long path never take the
places of the host's. The weights enter the scoring plan as one constant array, so scoring is one projection over the scan, without Python and without a
shuffle. The cost is linear in the length of the URL.

The labelled names are words of the trades that filters block and words of ordinary sites, joined by rule; none is taken from test tables. A name that
shares no n-gram with them gets the bias, which allows.

A null URL, and one without "://", has an empty host and path and is judged by the bias. Repeated rows are judged alike. Extra columns pass through; those
called host, path, rule, score or verdict, in any case, are replaced by the result. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, table

BITS = 16
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words of hosts to block and to allow. Each is joined with others of its list by TABLE_ROWS.
BLOCK = """
casino poker roulette blackjack jackpot lottery betting bets gambling slots bingo pharmacy pills viagra meds steroids diet adult porn xxx sexy escort webcam
hookup spam seo backlinks doorway linkfarm ads adserver popunder tracker trackers clicks affiliate payday loans credit crypto forex replica counterfeit cheap discount freebie prizes
warez torrent crack keygen cheats followers
""".split()
ALLOW = """
news herald gazette library archive museum gallery theatre orchestra weather climate school college university academy institute science physics chemistry biology
maths history geography travel railway hiking cycling gardening kitchen recipes bakery health hospital clinic council city village parish energy software docs
manual wiki forum community radio music cinema books poetry language dictionary maps harbour farm market bank insurance law sports football tennis chess
""".split()
#: Innocent words that have a word to block in them, or most of one.
HARD = """
better alphabet sorbets tibet elizabeth spamer spandau address advice adventure admiral academic roads heads threads beads shadow ladder accreditation accredited creditable sloans sloth
cryptography cryptology popcorn cornwall essex sussex middlesex sexton casinoe cassino dietrich pillar caterpillar medieval medlar bingham cracker cracow nutcracker museo seoul oseola
niagara adulthood escorial viscount cheetah cheaper clicker rambling gambia pottery lotterby replication flowers software pokerwork spoken chess-clubs trackside backtrack linkage farmers
wingspan pharmacology pharmacist roulade slottery tornado discus payable prizewinning counterpoint keyboard gentle lending promontory assembly classic passage cassette association
""".split()
#: Names that mean nothing, which are to be allowed: so many, spelled by rule.
PLAIN = 36
#: Reserved domains, and paths that say nothing; one row in eight has a path of its label instead.
DOMAINS = ("example.com", "example.net", "example.org", "sample.test")
PATHS = ("/", "/en/9", "/de/12", "/fr/3.html", "/es/8/", "/index.html", "/2019/4/", "")
BLOCK_PATHS, ALLOW_PATHS = ("/win/", "/bonus?x", "/go/777", "/promo", "/join"), ("/about", "/articles/2019/", "/contact", "/guide/", "/editorial")


def labelled() -> list[tuple[str, float]]:
    """The training table: 1 is to be blocked. A word stands alone, before and after another, and with a number."""
    rows = []
    for label, words, own in ((1.0, BLOCK, BLOCK_PATHS), (0.0, ALLOW, ALLOW_PATHS), (0.0, HARD, ALLOW_PATHS)):
        for i, word in enumerate(words):
            other, third = words[(7 * i + 3) % len(words)], words[(11 * i + 5) % len(words)]
            for k, name in enumerate((word, f"{word}-{other}", f"{third}{word}", f"www.{word}{i % 9}", f"m.{other}-{word}", f"blog.{word}")):
                path = own[i % len(own)] if (i + k) % 8 == 0 else PATHS[(i + 3 * k) % len(PATHS)]
                rows.append((f"http://{name}.{DOMAINS[(i + k) % len(DOMAINS)]}{path}", label))
    c, v = "bdfghjklmnprstvwyz", "aeiou"
    for i in range(PLAIN):
        name = c[i % 18] + v[i % 5] + c[(5 * i + 7) % 17] + c[(i // 3) % 18] + v[(i // 2) % 5] + c[(7 * i + 1) % 17]
        for k, prefix in enumerate(("", "www.", "m.", "blog.")):
            rows.append((f"http://{prefix}{name}.{DOMAINS[(i + k) % len(DOMAINS)]}{PATHS[(i + 3 * k) % len(PATHS)]}", 0.0))
    return rows


TABLE_ROWS = 6 * (len(BLOCK) + len(ALLOW) + len(HARD)) + 4 * PLAIN


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def features(host: Column, path: Column) -> Column:
    """The distinct hashed n-grams: numbers below 2^BITS for the host, and from there on for the path."""

    def of(text: Column, offset: int) -> Column:
        def numbers(c: Column, n: int) -> Column:
            number = lambda i: (F.pmod(F.xxhash64(F.concat(*(F.get(c, i + k) for k in range(n)))), F.lit(1 << BITS)) + offset).cast("int")
            return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), number)).otherwise(F.array().cast("array<int>"))

        return let(F.split(text, ""), lambda c: F.array_distinct(F.concat(*(numbers(c, n) for n in SIZES))))

    return F.concat(of(F.concat(F.lit("."), host, F.lit("/")), 0), of(path, 1 << BITS))


@lru_cache(maxsize=4)
def _train(app: str) -> tuple[float, dict[int, float]]:
    """Bias and the weights that are not zero, trained once for each Spark application."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = SparkSession.getActiveSession()
    one = spark.range(1, numPartitions=1)
    rows = {k: [u for u, label in labelled() if label == k] for k in (1.0, 0.0)}
    bad, good = (one.select(F.explode(F.split(F.lit(" ".join(rows[k])), " ")).alias("url"), F.lit(k).alias("label")) for k in rows)
    data = bad.unionByName(good).coalesce(1)
    names = F.transform(features(*split_url(F.col("url"))), lambda i: i.cast("string"))
    data = data.select("label", names.alias("names"))
    known = [r[0] for r in data.select(F.explode("names").alias("name")).distinct().orderBy("name").collect()]  # of the fixed table
    counted = CountVectorizerModel.from_vocabulary(known, inputCol="names", outputCol="features", binary=True)
    model = LogisticRegression(regParam=0.0001, maxIter=100, standardization=False).fit(counted.transform(data).select("label", "features"))
    weights = {int(k): round(float(w), 4) for k, w in zip(known, model.coefficients.toArray(), strict=True)}
    return float(model.intercept), {k: w for k, w in weights.items() if w}


def score(spark: SparkSession, host: Column, path: Column) -> Column:
    """The log odds that the URL is to be blocked."""
    bias, weights = _train(spark.sparkContext.applicationId)
    listed = ",".join(f"{weights[i]:.4f}" if i in weights else "0" for i in range(2 << BITS))
    table_ = F.split(F.lit(listed), ",").cast("array<double>")  # folded into one constant by the optimizer
    return F.aggregate(features(host, path), F.lit(bias), lambda acc, i: acc + F.get(table_, i))


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score and verdict (in that order, at the end)."""
    host, path = split_url(F.col(f"`{url}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    known = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, ruled = match_rule(F.col("host"), F.col("path"))
    own = free_name(known.columns, "ruled")
    known = known.select("*", rule.alias("rule"), score(pages.sparkSession, F.col("host"), F.col("path")).alias("score"), ruled.alias(own))
    verdict = F.coalesce(F.col(own), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return known.select(*(F.col(f"`{c}`") for c in known.columns if c != own), verdict.alias("verdict"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_url_filter that needs no model: hosts, paths and rules."""
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


URL_RULES_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(rule_host, rule_path, verdict)),
f AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
      FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, host, path, rule, verdict AS ruled FROM h LEFT JOIN f ON f.page_id = h.page_id AND k = 1
"""
