"""Languages by the characters of a text: a model of three-letter sequences, learned from labelled texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialise, sized


@dataclass(frozen=True)
class Settings:
    """``sample``: texts of each language that are learned from, those of the least MD5 of their ids. ``chars``: of each
    text so many characters are read, in learning and in telling. ``floor``: the share of a language that a sequence
    counts with where it was not seen. ``margin``: by so much, a sequence on average, the best language has to lead, in
    thousandths of a natural logarithm. ``broadcast_rows``: a larger model is joined by shuffle."""

    sample: int = 400
    chars: int = 5000
    floor: float = 0.02
    margin: int = 100
    broadcast_rows: int = 2_000_000


def sequences(text: Column, chars: int) -> Column:
    """Array of the three-letter sequences of a text's first characters, in lower case; what is no letter is one space."""
    plain = F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, chars)), r"[^\p{L}]+", " ")
    return F.regexp_extract_all(F.concat(F.lit(" "), plain, F.lit(" ")), F.lit(r"(?=(\p{L}..|.\p{L}.|..\p{L}))"), F.lit(1))


def learn(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """gram, language, weight: how much a sequence speaks for a language, from ``texts`` (id, text, language).

    The weight is the logarithm of the language's share of the sequence, over languages of equal size, against the floor.
    Texts without a language are not learned from. The model has as many rows as the bounded sample has sequences, at
    most."""
    first = W.partitionBy("language").orderBy(F.md5(F.col("id").cast("string")), "id")
    some = texts.where("language is not null").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= s.sample)
    seen = some.select("language", F.explode(sequences(F.col("text"), s.chars)).alias("gram")).groupBy("language", "gram").agg(F.count(F.lit(1)).alias("n"))
    rate = F.col("n") / F.sum("n").over(W.partitionBy("language"))
    seen = seen.withColumn("rate", rate).withColumn("share", F.col("rate") / F.sum("rate").over(W.partitionBy("gram")))
    weight = F.round(1000 * F.ln(1 + F.col("share") / s.floor)).cast("long")
    return materialise(texts.sparkSession, seen.select("gram", "language", weight.alias("weight")), "language-model")


def tell(texts: DataFrame, model: DataFrame, s: Settings = Settings()) -> DataFrame:
    """id, language, lead of each of ``texts`` (id, text; ids are distinct): null where no language leads by the margin, as
    in a text without a known sequence. A text's sequences lie in one task, so a row a language is shuffled."""
    grams = texts.select("id", F.explode(sequences(F.col("text"), s.chars)).alias("gram"))
    found = grams.join(sized(model, s.broadcast_rows), "gram", "left")
    # sequences count once each, however many languages have them
    sums = found.groupBy("id", "language").agg(F.sum("weight").alias("weight"))
    sizes = texts.select("id", F.size(sequences(F.col("text"), s.chars)).alias("n"))
    best = sums.where("language is not null").groupBy("id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("weight", "language")))).alias("x"))
    rows = sizes.join(best, "id", "left")
    lead = F.col("x")[0]["weight"] - F.coalesce(F.get("x", F.lit(1))["weight"], F.lit(0))
    rows = rows.withColumn("lead", F.when(F.col("n") > 0, F.floor(lead / F.col("n"))).cast("long"))
    return rows.select("id", F.when(F.col("lead") >= s.margin, F.col("x")[0]["language"]).alias("language"), "lead")
