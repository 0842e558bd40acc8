"""URL filter: host and path rules, else a character language-model ratio; DataFrame functions only.

URLs that a rule allows or blocks are the accepted and rejected examples. For both a variable-order Markov model counts
characters after contexts of up to `order` characters of host and path; probabilities are interpolated over the orders by
Witten-Bell smoothing down to an even base. A URL's score is the difference of the log-likelihoods divided by its length.
The threshold is calibrated by cross-fitting: examples of one half are scored by the counts of the other
half, and the cut is taken where the share of rejected examples above it and of accepted ones below it is least. Other URLs are scored by the counts of all.

Scores are made once per distinct gram and distinct URL text, so frequent hosts cost no more than rare ones. Null URLs and those without
`://` have an empty host and path; these are scored like others (their text is its end alone). With no accepted or no
rejected examples every other URL is allowed. Repeated rows get equal verdicts; an empty table gives an empty result;
columns besides the two named aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

ORDER = 4
#: Probability of any character before anything is counted.
BASE = 1.0 / 1024
#: Scores of at most so many distinct grams (some 20 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Calibration bins per unit of score.
BINS = 200

_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and the start of a path, with what they get: allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _grams(text: Column, order: int) -> Column:
    """For each character of the text and its end: the `order` characters before it and itself."""
    padded = F.concat(F.lit(_START * order), text, F.lit(_END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))


def _gram_scores(counts: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(model, gram, score): log-probability ratio of the last character of each asked gram.

    counts: (model, gram, accepted, rejected). Each order's context is joined once; it holds its characters' counts in a map, which the alphabet bounds.
    """
    letter = F.substr("gram", F.lit(order + 1))
    found = asked.select("model", "gram", letter.alias("letter"), F.lit(BASE).alias("pa"), F.lit(BASE).alias("pr"))
    for k in range(order + 1):
        context = F.substr("gram", F.lit(order + 1 - k), F.lit(k)) if k else F.lit("")
        each = counts.groupBy("model", context.alias("context"), letter.alias("letter")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        by_context = each.groupBy("model", "context").agg(
            F.map_from_entries(F.collect_list(F.struct("letter", F.struct("a", "r")))).alias("letters"),
            F.sum("a").alias("na"),
            F.sum("r").alias("nr"),
            F.count_if(F.col("a") > 0).alias("ta"),
            F.count_if(F.col("r") > 0).alias("tr"),
        )
        met = found.withColumn("context", context).join(by_context, ["model", "context"], "left")
        seen = F.try_element_at("letters", F.col("letter"))

        def smoothed(n: Column, total: str, kinds: str, lower: str) -> Column:
            mass = F.col(total) + F.col(kinds)
            return F.when(mass > 0, (F.coalesce(n, F.lit(0)) + F.col(kinds) * F.col(lower)) / mass).otherwise(F.col(lower))

        found = met.select("model", "gram", "letter", smoothed(seen["a"], "na", "ta", "pa").alias("pa"), smoothed(seen["r"], "nr", "tr", "pr").alias("pr"))
    return found.select("model", "gram", (F.log("pa") - F.log("pr")).alias("score"))


def _threshold(scores: DataFrame) -> float:
    """The cut with the least sum of the two error shares; scores: (verdict, score) of examples."""
    bins = scores.groupBy("verdict", F.floor(F.col("score") * BINS).cast("long").alias("bin")).count().collect()
    # Scores lie within log(1 / BASE) and its double, so the bins are few.
    total = {v: sum(r[2] for r in bins if r[0] == v) for v in ("allow", "block")}
    if not all(total.values()):
        return float("-inf")
    share: dict[int, float] = {}
    for verdict, at, n in bins:
        share[at] = share.get(at, 0.0) + (n if verdict == "allow" else -n) / total[verdict]
    best, cut, wrong = 1.0, min(share), 1.0  # all rejected ones above the lowest cut
    for at in sorted(share):
        wrong += share[at]
        if wrong < best - 1e-12:
            best, cut = wrong, at + 1
    following = [at for at in share if at >= cut]
    middle = (cut + min(following)) / 2 if following else cut
    return middle / BINS


def judged(pages: DataFrame, rules: list[Rule], order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) per row; the score is null where a rule decides."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "by_rule": verdict, "text": F.concat("host", "path")})
    # The distinct texts; examples of half f are scored by model f, which leaves that half out, the rest by model 2.
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    texts = rows.groupBy("text", "by_rule").agg(F.count("*").alias("copies"))
    texts = texts.withColumn("model", F.when(F.col("by_rule").isNotNull(), half).otherwise(F.lit(2)))
    split = stored(texts.select("text", "by_rule", "model", F.explode(_grams(F.col("text"), order)).alias("gram")), "url-grams")
    by_gram = stored(split.groupBy("model", "by_rule", "gram").agg(F.count("*").alias("n")), "url-counts")
    serves = F.explode(F.array(F.lit(2), F.lit(1) - F.col("model"))).alias("model")
    of = lambda v: F.when(F.col("by_rule") == v, F.col("n")).otherwise(0)
    counts = by_gram.filter("by_rule is not null").select(serves, "gram", of("allow").alias("accepted"), of("block").alias("rejected"))
    scores = stored(_gram_scores(stored(counts, "url-models"), by_gram.select("model", "gram").distinct(), order), "url-scores")
    few = scores.count() <= MOST_BROADCAST
    met = split.join(F.broadcast(scores) if few else scores, ["model", "gram"])
    by_text = stored(met.groupBy("text", "by_rule").agg(F.avg("score").alias("score")), "url-texts")
    cut = _threshold(by_text.filter("by_rule is not null").select(F.col("by_rule").alias("verdict"), "score"))
    open_ = by_text.filter("by_rule is null").select("text", "score")
    # Ruled rows aren't joined: their null keys would meet in one task.
    own = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    scored = rows.filter("by_rule is null").join(open_, "text", "left").select("id", "host", "path", "rule", own.alias("verdict"), "score")
    ruled_ = rows.filter("by_rule is not null").select("id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return scored.union(ruled_).withColumnRenamed("id", id_col)
