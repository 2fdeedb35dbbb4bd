"""URL filters: host and path rules, then a ratio of character language models.

URLs that a rule decides are the labelled rows.  Two smoothed variable-order
Markov models over characters, one of accepted and one of rejected URLs, are
counted from them, and the length-normalised log-likelihood difference decides
the rest.  Its threshold is calibrated on labelled URLs that were kept out of
the counts.  The models are a table of strings that grows with the labelled
URLs; scoring joins the different windows of all URLs with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import BROADCAST_ROWS, ascii_lower, join_counted, spread
from mnemo.sources.durable import durable

#: (verdict, host, path): the rules in force.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Longest context in characters, and the marks before and after a URL.
ORDER = 5
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where ``url`` is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    found = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return ascii_lower(found(r"(?s)^([^/?#]*)")), found(r"(?s)^[^/?#]*([^?#]*)")


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.  A fixed list, tried in one projection."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def windows(url: Column) -> Column:
    """What begins at each character of a marked URL, up to ``ORDER`` + 1 characters; none for URLs without any."""
    shown = F.translate(F.lower(F.regexp_replace(url, r"(?s)^.*?://", "")), START + END, "")
    found = F.regexp_extract_all(F.concat(F.lit(START), shown, F.lit(END)), F.lit(rf"(?s)(?=(.{{1,{ORDER + 1}}}))."), F.lit(1))
    return F.when(shown != "", found).otherwise(F.array().cast("array<string>"))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(g, len, n1, n0) of all strings of up to ``ORDER`` + 1 characters in ``labelled`` (url, accepted).

    Whole windows are counted first, so each URL is read once and short strings
    are added up from few rows.
    """
    whole = labelled.select(F.explode(windows(F.col("url"))).alias("w"), "accepted").groupBy("w").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0"))
    each = whole.select(F.explode(F.sequence(F.lit(1), F.length("w"))).alias("len"), "w", "n1", "n0")
    return each.groupBy(F.left("w", F.col("len")).alias("g"), "len").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def model(labelled: DataFrame, weight: float = 4.0, least: int = 2) -> DataFrame:
    """(g, value): what every kept string adds to a URL's log ratio wherever it occurs.

    A string is kept if it occurs ``least`` times in ``labelled`` (single
    characters always), so contexts are as long as the data allow and the table
    grows with the input.  The estimate of a character after a context is its
    count smoothed with ``weight`` counts of the estimate after the context
    without its first character; a kept context that the character never
    followed leaves it to the shorter one.  Written as differences between a
    string and the ones without its first and without its last character, the
    logarithms of all positions are a sum over the strings that occur.
    """
    counts = durable(gram_counts(labelled).where((F.col("len") == 1) | (F.col("n1") + F.col("n0") >= least)))
    after = counts.where("len > 1").groupBy(F.left("g", F.col("len") - 1).alias("g")).agg(F.sum("n1").alias("y1"), F.sum("n0").alias("y0"))
    counts = durable(counts.join(after, "g", "left").na.fill(0, ["y1", "y0"]))
    one = (F.col("len") == 1) & (F.col("g") != START)
    symbols, all1, all0 = counts.where(one).agg(F.count("*"), F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0))).first()
    leave = F.log((F.col("y0") + weight) / (F.col("y1") + weight))
    p = lambda k, total: F.when(F.col("g") == START, 1.0).otherwise((F.col(f"n{k}") + 0.5) / (total + 0.5 * symbols))
    level = counts.where("len = 1").select("g", p(1, all1).alias("p1"), p(0, all0).alias("p0"), leave.alias("leave"))
    level = level.withColumn("ratio", F.log(F.col("p1") / F.col("p0")))
    out = level.select("g", (F.col("ratio") + F.col("leave")).alias("value"))
    for n in range(2, ORDER + 2):
        shorter = level.select(F.col("g").alias("tail"), F.col("p1").alias("q1"), F.col("p0").alias("q0"), F.col("ratio").alias("was"))
        context = counts.where(F.col("len") == n - 1).select(F.col("g").alias("head"), F.col("y1").alias("c1"), F.col("y0").alias("c0"))
        here = counts.where(F.col("len") == n).withColumns({"tail": F.substring("g", 2, n), "head": F.left("g", F.lit(n - 1))}).join(shorter, "tail").join(context, "head")
        for k in "10":
            here = here.withColumn(f"p{k}", (F.col(f"n{k}") + weight * F.col(f"q{k}")) / (F.col(f"c{k}") + weight))
        here = here.withColumns({"ratio": F.log(F.col("p1") / F.col("p0")), "leave": leave})
        left = F.log((F.col("c0") + weight) / (F.col("c1") + weight))
        level = durable(here.select("g", "p1", "p0", "ratio", (F.col("ratio") - F.col("was") - left + F.col("leave")).alias("value")))
        out = out.unionByName(level.select("g", "value"))
    return out


def scored(urls: DataFrame, values: DataFrame) -> DataFrame:
    """``urls`` (url and more, all different) with ``score``: the mean log ratio of a character, 0 for none.

    Windows go with a hash of their URL, not the URL, so long ones stay linear.
    """
    urls = urls.withColumn("_id", F.unhex(F.md5("url")))
    each = urls.select("_id", F.explode(windows(F.col("url"))).alias("w"))
    met = durable(each.groupBy("w").agg(F.count("*").alias("n")))
    parts = met.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("len")).withColumn("g", F.left("w", F.col("len")))
    few = F.broadcast(values) if values.count() <= BROADCAST_ROWS else values
    met = durable(parts.join(few, "g", "left").groupBy("w", "n").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value")))
    # the mark before a URL is no character of it
    mean = F.round(F.sum("value") / (F.count("*") - 1), 9)
    summed = join_counted(each, met, "w").groupBy("_id").agg(mean.alias("score"))
    return urls.join(summed, "_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).drop("_id")


def threshold(scored: DataFrame, steps: int = 100) -> DataFrame:
    """One row ``t``: where (score, accepted) part best, by balanced accuracy, in the middle of the gap there; 0 if a class is missing.

    Scores are counted in bins of 1/``steps`` between -8 and 8, so the ordered pass sees at most 16 * ``steps`` rows.
    """
    binned = scored.select(F.floor(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), "score")) * steps).alias("bin"), "accepted")
    binned = binned.groupBy("bin").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0"))
    bins = binned.groupBy().agg(F.sort_array(F.collect_list(F.struct("bin", "n1", "n0"))).alias("bins"), F.sum("n1").alias("all1"), F.sum("n0").alias("all0"))
    start = F.struct(F.lit(0.0).alias("below1"), F.lit(0.0).alias("below0"), F.lit(-1.0).alias("best"), F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        good = (F.col("all1") - acc["below1"]) / F.col("all1") + acc["below0"] / F.col("all0")
        return F.struct(
            (acc["below1"] + x["n1"]).alias("below1"),
            (acc["below0"] + x["n0"]).alias("below0"),
            F.greatest(acc["best"], good).alias("best"),
            F.when(good > acc["best"], (F.coalesce(acc["last"] + 1, x["bin"]) + x["bin"]) / F.lit(2.0 * steps)).otherwise(acc["t"]).alias("t"),
            x["bin"].cast("double").alias("last"),
        )

    best = F.aggregate("bins", start, step, lambda acc: acc["t"])
    return bins.select(F.when((F.col("all1") > 0) & (F.col("all0") > 0), best).otherwise(0.0).alias("t"))


def judge(pages: DataFrame, url: str = "url", rules: tuple = RULES, held_out: int = 5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    Different URLs are labelled, counted and scored once, whatever their number
    of copies.  One labelled URL in ``held_out`` (by hash) calibrates the
    threshold, the others are counted.  A null or empty URL has score 0, as has
    every URL while no labelled one exists; the threshold is 0 while a class is
    missing, and a score at the threshold is allowed.  Equal URLs get equal
    rows, very long ones are read whole, and an empty table gives an empty one.
    Columns of ``pages`` with the names of the added ones are replaced.
    """
    made = ["host", "path", "rule", "score", "verdict"]
    held = [c for c in pages.columns if c not in made]
    key = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    each = pages.select(key.alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    host, path = host_and_path(F.col("url"))
    each = each.withColumns({"host": host, "path": path})
    each = durable(spread(each.withColumn("_m", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("out", F.pmod(F.xxhash64("url"), F.lit(held_out)) == 0)))
    values = durable(model(each.where("_m is not null and not out").select("url", (F.col("_m.verdict") == "allow").alias("accepted"))))
    each = durable(scored(each, values))
    t = threshold(each.where("_m is not null and out").select("score", (F.col("_m.verdict") == "allow").alias("accepted"))).first()[0]
    each = each.withColumn("verdict", F.coalesce("_m.verdict", F.when(F.col("score") >= t, "allow").otherwise("block")))
    each = each.select(F.col("url").alias("_url"), "n", "host", "path", F.col("_m.rule").alias("rule"), "score", "verdict")
    rows = pages.select(*[F.col(f"`{c}`") for c in held], key.alias("_url"))
    return join_counted(rows, each, "_url").select(*[F.col(f"`{c}`") for c in held], *made)
