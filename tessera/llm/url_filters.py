"""URL filter: host and path rules, then the ratio of two character language models.

URLs that a rule allows train the accepted model, URLs that a rule blocks train the rejected one.
Both are variable-order Markov models over a folded alphabet: order 3 interpolated with orders 2, 1
and 0. A URL's score is the difference of its two log-likelihoods over its length. One labelled URL
in five is kept out of the models; the threshold is the one that parts these best (all labelled ones,
if one kind is missing among these). Built-in functions only.

Tables of n-grams have a proven bound: the folded alphabet has 40 symbols, so there are at most
40^4 = 2.56 million n-grams whatever the number of URLs. They are broadcast by the three symbols of
their context: 64,000 rows at most, each with its symbols and their ratios, some 30 MB.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, drop_stash, stash, table, without

#: (verdict, host and path); the host fits itself and its subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 40
#: Weight of the lower order in interpolation.
LAMBDA = 4.0
FOLDS = 5
SALTS = 8  # places in which a hot url's rows meet its score


def held_out(url: Column) -> Column:
    return F.crc32(url.cast("binary")) % FOLDS == 0


def kept_out(url: str) -> bool:
    """held_out() of one url."""
    return zlib.crc32(url.encode()) % FOLDS == 0


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # longer rules wrap, so they are asked first
        at = rule.index("/")
        fits = F.concat(F.lit("."), host).endswith("." + rule[:at]) & path.startswith(rule[at:])
        best, verdict = F.when(fits, rule).otherwise(best), F.when(fits, says).otherwise(verdict)
    return best, verdict


def grams(urls: DataFrame, url: str, keep: list[str]) -> DataFrame:
    """One row per symbol of the folded url: the symbol and the three before it."""
    plain = F.translate(after_scheme(F.col(url)), UPPER + "123456789", LOWER + "000000000")
    folded = F.regexp_replace(plain, r"[^a-z0./_?=&%#:~-]", "*")
    letters = urls.select(*keep, F.split(F.concat(F.lit("^^^"), folded), "").alias("_a")).where(F.size("_a") > 3)
    every = F.transform(F.sequence(F.lit(0), F.size("_a") - 4), lambda i: F.concat(*(F.get("_a", i + k) for k in range(4))))
    return letters.select(*keep, F.explode(every).alias("gram"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram -> log P_accepted - log P_rejected, from (gram, allow, block) counts."""
    out = counts
    for size in (3, 2, 1):  # counts of the gram's last symbols
        by = F.substring("gram", 5 - size, size)
        sums = counts.groupBy(by.alias(f"_k{size}")).agg(F.sum("allow").alias(f"allow{size}"), F.sum("block").alias(f"block{size}"))
        out = out.join(sums, by == F.col(f"_k{size}"))
    for size in (3, 2, 1):  # and of their contexts, of so many symbols
        by = F.substring("gram", 4 - size, size)
        sums = counts.groupBy(by.alias(f"_c{size}")).agg(F.sum("allow").alias(f"allow_c{size}"), F.sum("block").alias(f"block_c{size}"))
        out = out.join(sums, by == F.col(f"_c{size}"))
    total = F.broadcast(counts.agg(F.sum("allow").alias("allow_all"), F.sum("block").alias("block_all")))  # one row
    out = out.join(total)

    def log_p(c: str) -> Column:
        p = (F.col(f"{c}1") + 1.0) / (F.col(f"{c}_all") + float(SYMBOLS))
        for n, context in ((f"{c}2", f"{c}_c1"), (f"{c}3", f"{c}_c2"), (c, f"{c}_c3")):
            p = (F.col(n) + LAMBDA * p) / (F.col(context) + LAMBDA)
        return F.log(p)

    return out.select("gram", (log_p("allow") - log_p("block")).alias("ratio"))


def by_context(ratios: DataFrame) -> DataFrame:
    """context, symbols and ratios: a row for the first three symbols of n-grams, with their last ones in order."""
    last = F.array_sort(F.collect_list(F.struct(F.substring("gram", 4, 1).alias("symbol"), "ratio")))
    rows = ratios.groupBy(F.substring("gram", 1, 3).alias("context")).agg(last.alias("last"))
    return rows.select("context", F.array_join("last.symbol", "").alias("symbols"), F.col("last.ratio").alias("ratios"))


def threshold(scored: DataFrame) -> float | None:
    """The score that parts allowed from blocked URLs best; None if either kind is missing.

    URLs that the models did not see decide. Scores are counted in 1001 bins, so a bounded table
    reaches the driver.
    """
    labelled = scored.where("_label IS NOT NULL")
    unseen = labelled.where(held_out(F.col("_url")))
    if unseen.agg(F.count_distinct("_label")).first()[0] == 2:
        labelled = unseen
    bins = labelled.groupBy(F.round(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), "score")), 2).alias("bin"))
    rows = bins.agg(F.sum("_allow").alias("a"), F.sum("_block").alias("b")).orderBy("bin").collect()
    all_a, all_b = sum(r.a for r in rows), sum(r.b for r in rows)
    if not all_a or not all_b:
        return None
    best, at, below_a, below_b = 1.0, -5.0, 0, 0
    for r in rows:  # blocked below the bin: errors are allowed URLs below and blocked ones from it on
        error = below_a / all_a + (all_b - below_b) / all_b
        if (error, abs(r.bin)) < (best, abs(at)):
            best, at = error, r.bin
        below_a, below_b = below_a + r.a, below_b + r.b
    return at - 0.005


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Every row of pages with host, path, rule, score and verdict (allow or block).

    host and path are empty for a null url or one without ``://``. Where no rule fits, a URL is
    blocked if its score is under the threshold; a URL without symbols after the scheme has a null
    score and is allowed, and so is every one if the rules leave either model without examples.
    Repeated rows count as often as they occur and each get the verdict; added names replace columns.
    """
    rest = without(pages, ["host", "path", "rule", "score", "verdict", "_url", "_salt"])
    url = col(url_col).cast("string")
    rule, says = rule_of(host_of(F.col("_url")), path_of(F.col("_url")), rules)
    urls = rest.groupBy(url.alias("_url")).agg(F.count("*").alias("_n")).where("_url IS NOT NULL").withColumn("_label", says)
    urls = urls.withColumns({"_allow": F.when(F.col("_label") == "allow", F.col("_n")).otherwise(0), "_block": F.when(F.col("_label") == "block", F.col("_n")).otherwise(0)})
    urls = stash(urls, "urls")
    # a few rows of urls fill a file, and each becomes as many rows as it has symbols: deal them out
    dealt = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_url")
    # n-grams of all urls have a row, as lower orders tell of those that the models did not see
    seen = {c: F.when(held_out(F.col("_url")), 0).otherwise(F.col(c)) for c in ("_allow", "_block")}
    counts = grams(dealt.withColumns(seen), "_url", ["_allow", "_block"]).groupBy("gram").agg(F.sum("_allow").alias("allow"), F.sum("_block").alias("block"))
    counts = stash(counts, "url-grams")
    ratios = stash(by_context(log_ratios(counts)), "url-model")
    scored = grams(dealt, "_url", ["_url", "_label", "_allow", "_block"]).withColumn("context", F.substring("gram", 1, 3)).join(F.broadcast(ratios), "context")
    ratio = F.get("ratios", F.instr("symbols", F.substring("gram", 4, 1)) - 1)
    scored = scored.groupBy("_url").agg(F.round(F.avg(ratio), 9).alias("score"), F.first("_label").alias("_label"), F.first("_allow").alias("_allow"), F.first("_block").alias("_block"))
    scored = stash(scored, "url-scores")
    for used in (urls, counts, ratios):
        drop_stash(used)
    cut = threshold(scored)
    method = F.lit("allow") if cut is None else F.when(F.col("score") < cut, "block").otherwise("allow")
    # rows of one url, or of none, meet its score in several places
    salt = F.pmod(F.xxhash64(*[col(c) for c in rest.columns]), F.lit(SALTS)).cast("int")
    spread = scored.select("_url", "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    # never broadcast: scores are small as files, but not as rows for each salt in the driver
    out = rest.withColumns({"_url": url, "_salt": salt}).join(spread.hint("merge"), ["_url", "_salt"], "left")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"host": host, "path": path})
    return out.select(*[col(c) for c in rest.columns], "host", "path", rule.alias("rule"), "score", F.coalesce(says, method).alias("verdict"))


def op8_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
