"""URL filter: listed rules decide first, association rules mined from labels decide the rest.

Every url becomes a set of tokens (scheme, host parts by position, path parts, query
names). FP-growth mines the token sets of labelled urls; rules ``tokens -> label`` are kept
above a support and a confidence, and dropped where a rule of fewer tokens says the same
with no less confidence. Rules are matched by an inverted index: each stands under the
rarest of its tokens, a token set looks up its tokens and verifies the rest. Matching
works on distinct token sets, so a host with many pages costs no more than its kinds
of urls. DataFrame functions and Spark's FP-growth only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import saved

# Host and path prefix, verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """Rule (0) or verdict (1) of the longest listed rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule[0].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule[value]) if out is None else out.when(fits, rule[value])
    return out if out is not None else F.lit(None).cast("string")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; digits count as one sign, so numbered pages are alike."""
    host_parts = F.reverse(F.split(host, r"\."))
    path_parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda p: p != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]), lambda p: p != "")
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.coalesce(scheme, F.array().cast("array<string>")),
                F.transform(
                    F.filter(host_parts, lambda p: p != ""),
                    lambda p: F.concat(F.lit("host:"), p),
                ),
                F.transform(path_parts, lambda p: F.concat(F.lit("path:"), p)),
                F.transform(names, lambda p: F.concat(F.lit("query:"), p)),
            )
        )
    )


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``(rule, tokens, verdict, confidence, n, index)`` from ``(tokens, verdict)``.

    ``n`` counts the labelled urls that hold the tokens and the label, ``index`` is the
    rarest of the tokens. Rules may have any number of tokens. No rows give no rules.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    if not baskets.head(1):
        return spark.createDataFrame(
            [], "rule string, tokens array<string>, verdict string, confidence double, n long, index string"
        )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    sets = saved(model.freqItemsets, "itemsets")
    is_label = lambda i: i.startswith(LABEL)
    n_labels = F.size(F.filter("items", is_label))
    plain = sets.where(n_labels == 0).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("all"))
    with_label = sets.where((n_labels == 1) & (F.size("items") > 1)).select(
        F.array_sort(F.filter("items", lambda i: ~is_label(i))).alias("tokens"),
        F.substring(F.filter("items", is_label)[0], len(LABEL) + 1, 1 << 30).alias("verdict"),
        F.col("freq").alias("n"),
    )
    rules = with_label.join(plain, "tokens").withColumn("confidence", F.col("n") / F.col("all"))
    rules = rules.where(F.col("confidence") >= min_confidence)
    often = plain.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), "all")
    rarest = (
        rules.select("tokens", "verdict", F.explode("tokens").alias("token"))
        .join(often, "token")
        .groupBy("tokens", "verdict")
        .agg(F.min(F.struct("all", "token"))["token"].alias("index"))
    )
    rules = saved(
        rules.join(rarest, ["tokens", "verdict"]).select(
            F.array_join("tokens", " ").alias("rule"), "tokens", "verdict", "confidence", "n", "index"
        ),
        "rules",
    )
    # A rule falls to one whose tokens are fewer and all among its own.
    token_rows = rules.select("rule", "tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    short = rules.select(
        F.col("index").alias("token"), F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("of_fewer")
    )
    spare = (
        token_rows.join(short, ["token", "verdict"])
        .where(
            (F.size("fewer") < F.size("tokens"))
            & (F.size(F.array_except("fewer", "tokens")) == 0)
            & (F.col("of_fewer") >= F.col("confidence"))
        )
        .select("rule", "verdict")
        .distinct()
    )
    return saved(rules.join(spare, ["rule", "verdict"], "left_anti").select(rules.columns), "rules")


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, verdict, rule)`` of the best rule for each token set that has one.

    Best: highest confidence, then most urls, fewest tokens, first by name and verdict.
    """
    looked_up = token_sets.select("tokens", F.explode("tokens").alias("index"))
    hits = looked_up.join(rules.withColumnRenamed("tokens", "needed"), "index").where(
        F.size(F.array_except("needed", "tokens")) == 0
    )
    rank = F.struct(-F.col("confidence"), -F.col("n"), F.size("needed"), "rule", "verdict")
    best = hits.groupBy("tokens").agg(F.min(rank).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("verdict"), F.col("best.rule").alias("rule"))


def filter_urls(
    urls: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labels: DataFrame | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    default: str = DEFAULT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_rule)``, one row per input row.

    A listed rule (``host/path prefix``) fits its host and all subdomains if the path
    starts with its own; the longest wins. Urls that no listed rule fits get the verdict
    of the best association rule, else ``default``. Labels for mining are ``(url,
    verdict)`` rows; without them, the urls that a listed rule decides. Null urls and
    urls without ``://`` have empty host and path, no rule and, but for a mined rule on
    what tokens they have, the default. Repeated rows come out as often as they come in,
    null ids stay null, other columns are ignored.
    """
    spark = urls.sparkSession

    def parsed(df: DataFrame, url: Column) -> DataFrame:
        df = df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
        return df.withColumn("tokens", tokens_of(url, F.col("host"), F.col("path")))

    pages = urls.select(
        F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")
    )
    pages = parsed(pages, F.col("url"))
    pages = saved(
        pages.withColumn("rule", listed(F.col("host"), F.col("path"), rules, 0))
        .withColumn("listed", listed(F.col("host"), F.col("path"), rules, 1))
        .drop("url"),
        "pages",
    )
    if labels is None:
        known = pages.where("listed is not null").select("tokens", F.col("listed").alias("verdict"))
    else:
        known = parsed(labels.where("url is not null and verdict is not null"), F.col("url")).select("tokens", "verdict")
    mined = mine(known.where(F.size("tokens") > 0), min_support, min_confidence)
    open_ = pages.where("listed is null").select("tokens").distinct()
    judged = saved(match(open_, mined), "judged").select(
        F.col("tokens").alias("set"), F.col("verdict").alias("found"), F.col("rule").alias("mined_rule")
    )
    joined = pages.join(judged, F.col("listed").isNull() & (F.col("tokens") == F.col("set")), "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", "found", F.lit(default)).alias("verdict"),
        "mined_rule",
    )
