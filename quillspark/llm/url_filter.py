"""URL filter: host rules first, then the ratio of two character language models.

Two variable-order Markov models (up to three characters of context, Witten-Bell smoothing over all
shorter contexts) are counted from the URLs that the rules accept and from those that they reject. A
URL's score is the difference of its log-likelihoods divided by its length; the threshold is the one
that best separates labelled URLs which the models have not seen.

``filter_urls`` with ``folded`` writes URLs in an alphabet of 32 symbols, so a model has at most 32**4
entries, which are broadcast. Without it, the models count the characters as they are, with contexts of any
length; they grow with the input, stay distributed, and meet the URLs by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import HOT_ROWS, let, materialise

_DIGITS = "0123456789abcdefghijklmnopqrstuv"
_FROM = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789" + "/.-_?&=#%:;" + "~"
_TO = _DIGITS[:26] * 2 + "q" * 10 + "rsttuuuuuuu" + "v"
#: Labelled URLs of this crc32 remainder calibrate, the others are counted.
FOLDS = 4
#: Stands before a URL's first character as often as a context is long.
START = "\x02"
#: How many characters there may be: Unicode's.
CHARACTERS = 1_114_112


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains; the path has to start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, allow) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(found)
    return found


def grams(url: Column, order: int) -> Column:
    """Array of the codes of all (context, character) windows of a URL, scheme left out."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^:/?#]*://", "")
    text = F.translate(F.regexp_replace(bare, r"(?s)[^a-zA-Z0-9/.\-_?&=#%:;]", "~"), _FROM, _TO)
    padded = F.concat(F.lit("v" * order), text)
    cut = F.regexp_extract_all(padded, F.lit(f"(?=(.{{{order + 1}}}))"), 1)
    return F.transform(cut, lambda g: F.conv(g, 32, 10).cast("int"))


def model(counts: DataFrame, order: int) -> DataFrame:
    """code, llr (log-likelihood ratio in millionths) for every code of ``counts``.

    ``counts``: code, a, b (how often counted URLs that are accepted and rejected have it; 0 for codes of
    other URLs). Every table here has at most 32**(order + 1) rows, lower orders far fewer.
    """
    lower = None
    for k in range(order + 1):
        size = 32 ** (k + 1)
        seen = counts.groupBy((F.col("code") % size).alias("code")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        seen = seen.withColumn("context", (F.col("code") / 32).cast("int"))
        context = seen.groupBy("context").agg(
            *(F.sum(x).alias(f"n_{x}") for x in "ab"),
            *(F.count_if(F.col(x) > 0).cast("double").alias(f"kinds_{x}") for x in "ab"),
        )
        full = seen.join(F.broadcast(context), "context")
        if lower is None:
            full = full.withColumn("below_a", F.lit(1 / 32)).withColumn("below_b", F.lit(1 / 32))
        else:
            full = full.withColumn("rest", F.col("code") % (size // 32)).join(F.broadcast(lower), "rest")

        def smooth(x: str) -> Column:
            weight = F.greatest(F.col(f"kinds_{x}"), F.lit(1.0))
            return (F.col(x) + weight * F.col(f"below_{x}")) / (F.col(f"n_{x}") + weight)

        lower = full.select(F.col("code").alias("rest"), smooth("a").alias("below_a"), smooth("b").alias("below_b"))
    ratio = F.round(1e6 * (F.log("below_a") - F.log("below_b"))).cast("long")
    return lower.select(F.col("rest").alias("code"), ratio.alias("llr"))


def whole_grams(url: Column, order: int) -> Column:
    """Array of the windows of ``order`` + 1 characters that end at each character of a URL, scheme left out."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^:/?#]*://", "")
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - order), lambda i: F.array_join(F.slice(c, i, order + 1), ""))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(let(F.split(F.concat(F.lit(START * order), bare), ""), cut))


def whole_model(spark: SparkSession, counts: DataFrame, order: int, hot_codes: int = HOT_ROWS) -> DataFrame:
    """code, llr as ``model``, of codes that are strings of ``order`` + 1 characters.

    Windows of all lengths are counted from the codes at once, a window's context is summed up where its
    windows stand together, and a code folds the figures of its own endings from the shortest up. No table is
    bounded, so none is marked for broadcast; a context has no more windows than there are characters."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.struct(k.alias("k"), F.right("code", k + 1).alias("end")))
    cut = counts.select("code", "a", "b", F.explode(ends).alias("x")).select("code", "a", "b", "x.k", "x.end")
    seen = cut.groupBy("end").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("codes"))
    seen = seen.withColumn("context", F.expr("left(end, length(end) - 1)"))
    same = W.partitionBy("context")
    seen = seen.select(
        "end", "codes", "a", "b", *(F.sum(x).over(same).alias(f"n_{x}") for x in "ab"),
        *(F.greatest(F.count_if(F.col(x) > 0).over(same).cast("double"), F.lit(1.0)).alias(f"w_{x}") for x in "ab"),
    )
    seen = materialise(spark, seen, "url-windows")
    # an ending that many codes have meets them in many tasks: of such there are ten thousand at most
    most = max(hot_codes, (seen.agg(F.sum("codes")).first()[0] or 0) // 10_000)
    hot = F.broadcast(materialise(spark, seen.where(F.col("codes") > most), "hot-endings"))
    cold = cut.select("code", "k", "end").join(hot.select("end"), "end", "left_anti").join(seen.where(F.col("codes") <= most), "end")
    met = cut.select("code", "k", "end").join(hot, "end").unionByName(cold)
    told = met.groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("k", "a", "b", "n_a", "n_b", "w_a", "w_b"))).alias("x")
    )

    def smooth(acc: Column, x: Column) -> Column:
        p = lambda s: ((x[s] + x[f"w_{s}"] * acc[s]) / (x[f"n_{s}"] + x[f"w_{s}"])).alias(s)
        return F.struct(p("a"), p("b"))

    flat = F.lit(1 / CHARACTERS)
    told = told.select("code", F.aggregate("x", F.struct(flat.alias("a"), flat.alias("b")), smooth).alias("p"))
    return told.select("code", F.round(1e6 * (F.log("p.a") - F.log("p.b"))).cast("long").alias("llr"))


def whole_scores(spark: SparkSession, rows: DataFrame, order: int) -> DataFrame:
    """page_id, url, times (1), score, chars for each row of ``rows`` (page_id, url, fit, fold).

    Codes that are a thousandth of all windows or more, of which there are a thousand at most, are joined by
    broadcast, so that no key of the shuffle is hot."""
    rows = materialise(spark, rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    counted = lambda allow: F.coalesce((F.col("fold") != 0) & (F.col("fit.allow") == allow), F.lit(False)).cast("int")
    cut = rows.select("row", counted(True).alias("a"), counted(False).alias("b"), F.explode(whole_grams(F.col("url"), order)).alias("code"))
    counts = cut.groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    counts = materialise(spark, counts, "url-codes")
    most = (counts.agg(F.sum("n")).first()[0] or 0) / 1000
    llr = materialise(spark, whole_model(spark, counts, order).join(counts.select("code", "n"), "code"), "url-model")
    hot = F.broadcast(llr.where(F.col("n") >= most).select("code", F.col("llr").alias("known")))
    met = cut.select("row", "code").join(hot, "code", "left")
    cold = met.where("known is null").select("row", "code").join(llr.where(F.col("n") < most).select("code", "llr"), "code").select("row", "llr")
    parts = met.where("known is not null").select("row", F.col("known").alias("llr")).union(cold)
    parts = parts.groupBy("row").agg(F.sum("llr").alias("llr"), F.count("llr").alias("chars"))
    return rows.join(parts, "row", "left").select(
        "page_id", "url", F.lit(1).alias("times"), F.coalesce(F.col("llr") / F.col("chars") / 1e6, F.lit(0.0)).alias("score"), F.coalesce("chars", F.lit(0)).alias("chars")
    )


def folded_scores(spark: SparkSession, rows: DataFrame, order: int) -> DataFrame:
    """page_id, url, times, score, chars for each distinct row of ``rows`` (page_id, url, fit, fold)."""
    rows = rows.select("page_id", "url", "fit", "fold", F.posexplode_outer(grams(F.col("url"), order)).alias("at", "code"))
    counted = lambda allow: F.coalesce((F.col("fold") != 0) & (F.col("fit.allow") == allow), F.lit(False)).cast("long")
    counts = rows.where("code is not null").groupBy("code").agg(F.sum(counted(True)).alias("a"), F.sum(counted(False)).alias("b"))
    counts = materialise(spark, counts, "url-codes")
    llr = F.broadcast(materialise(spark, model(counts, order), "url-model"))  # 32**(order + 1) rows at most
    # a row's characters lie in one task, so this shuffles one short row for each row of the input
    return rows.join(llr, "code", "left").groupBy("page_id", "url").agg(
        F.count_if(F.coalesce("at", F.lit(0)) == 0).cast("int").alias("times"),
        F.coalesce(F.sum("llr") / F.count("llr") / 1e6, F.lit(0.0)).alias("score"),
        F.count("llr").alias("chars"),
    )


def filter_urls(
    spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = 3, folded: bool = True
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score, threshold for every row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path and fits no rule. A URL without
    characters scores 0 and is allowed, as nothing speaks against it; so is every URL when the rules
    label no URL of one side. Ties with the threshold are allowed. Repeated rows stay and get equal
    results; other columns of ``pages`` are not read. ``order``: characters of context, at most 3 if ``folded``.
    """
    if order < 1 or folded and order > 3:
        raise ValueError("order must be 1, 2 or 3, or more without folding")

    def ruled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
        return rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))

    rows = ruled(pages.select("page_id", "url"))
    rows = rows.withColumn("fold", F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % FOLDS)
    if folded:
        scored = folded_scores(spark, rows, order)
    else:
        scored = whole_scores(spark, rows, order)
    scored = materialise(spark, scored, "url-scores")
    # held-out labels by score: the ratio of two smoothed models is bounded, so are the bins
    bins = (
        ruled(scored).where((F.crc32(F.col("url").cast("binary")) % FOLDS == 0) & F.col("fit").isNotNull())
        .groupBy((F.floor(F.col("score") * 50) / 50).alias("bin"))
        .agg(F.sum(F.col("fit.allow").cast("int") * F.col("times")).alias("a"), F.sum((~F.col("fit.allow")).cast("int") * F.col("times")).alias("b"))
    )
    every, above = W.partitionBy(), W.orderBy(F.desc("bin"))
    part = lambda x: F.sum(x).over(above) / F.nullif(F.sum(x).over(every), F.lit(0))
    cut = bins.select("bin", (part("a") - part("b")).alias("gain")).where("gain is not null")
    threshold = F.coalesce(cut.agg(F.max_by("bin", F.struct("gain", -F.col("bin")))).scalar(), F.lit(-1e9))
    judged = ruled(scored.withColumn("threshold", threshold))
    allow = F.coalesce(F.col("fit.allow"), (F.col("chars") == 0) | (F.col("score") >= F.col("threshold")))
    judged = judged.select(
        "page_id", "url", "host", "path", F.col("fit.rule").alias("rule"),
        F.when(allow, "allow").otherwise("block").alias("verdict"), "score", "threshold", "times",
    )
    return judged.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
