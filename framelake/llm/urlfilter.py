"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule names words (runs of letters and digits) that every URL it fits must contain. Of these, the one that the fewest URLs of
the table contain becomes its key. The tokens of a URL fetch the rules filed under them, and only those run their
regular expression. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Rules up to this number travel as a literal of the plan; more are joined as a table.
INLINE = 2_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` must all stand in them as whole lower-case words.

    ``weight``: the rule with the largest one decides; rules of weight 0 are the method's own and never named in a result.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^0-9a-z]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def prefix_rule(verdict: str, name: str) -> Rule:
    """A rule like ``example.org/en/1``: the host with its subdomains, and paths that start so. The longer one wins."""
    host, slash, path = name.partition("/")
    inside = path.rpartition("/")[0] if "/" in path else ""  # the last part may be the beginning of a longer word
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host + slash + path)}", tuple(dict.fromkeys(words_of(host) + words_of(inside))), len(name))


def host_word_rule(name: str, *words: str) -> Rule:
    """Blocks hosts in which the words stand one after the other, as in ``www.free-bets.example``."""
    return Rule(name, "block", r"^(?:[^/]*[.-])?" + "[.-]".join(map(re.escape, words)) + r"(?:[.-]|/|$)", words, 0)


#: The method's own rules, for URLs that no prefix rule fits. Whatever fits none of them is allowed.
SPAM_HOSTS = (
    host_word_rule("casino", "casino"), host_word_rule("free-bets", "free", "bets"), host_word_rule("cheap-pills", "cheap", "pills"),
    host_word_rule("adult", "adult"), host_word_rule("porn", "porn"), host_word_rule("xxx", "xxx"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.concat_ws("/", host, F.translate(path, UPPER, LOWER)), "[^0-9a-z]+"))


def keyed(parts: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[str, Rule]]:
    """Each rule with its key: of its tokens, the one in the fewest URLs. Rules without a token get an empty key."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = tokens(F.col("host"), F.col("path"))
    if len(wanted) <= INLINE:
        found = F.array_intersect(found, F.array(*map(F.lit, wanted)).cast("array<string>"))
    counted = parts.select(F.explode(found).alias("token")).groupBy("token").count()
    if len(wanted) > INLINE:
        counted = counted.join(parts.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    times = {r["token"]: r["count"] for r in counted.collect()}  # at most one row for each token of a rule
    return [(min(r.tokens, key=lambda t: (times.get(t, 0), t), default=""), r) for r in rules]


def _rule(r: Rule) -> Column:
    return F.struct(F.lit(-r.weight).alias("order"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``).

    The fitting rule of the largest weight decides, of equal ones the first by name; its name is given if its weight is over 0.
    Without a fitting rule the verdict is ``default``. A null URL has an empty host and path. Repeated rows are judged
    one by one. With few rules there is no shuffle but the count of tokens; with many, distinct URLs meet the rules in a join.
    """
    if not rules:
        rules = (Rule("", default, "$^", (), -1),)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    index = keyed(parts, rules)
    target = F.concat("host", "path")
    if len(rules) <= INLINE:
        by_key: dict[str, list[Rule]] = {}
        for key, rule in index:
            by_key.setdefault(key, []).append(rule)
        filed = F.create_map(*[c for key, some in by_key.items() for c in (F.lit(key), F.array(*map(_rule, some)))])
        fetched = F.flatten(F.filter(F.transform(F.array_append(tokens(F.col("host"), F.col("path")), F.lit("")), lambda t: filed[t]), lambda x: x.isNotNull()))
        judged = parts.withColumn("_fetched", F.array_distinct(fetched))
        judged = judged.withColumn("_best", F.array_min(F.filter("_fetched", lambda r: F.regexp_like(target, r["pattern"]))))
    else:
        table = pages.sparkSession.createDataFrame([(k, -r.weight, r.name, r.verdict, r.pattern) for k, r in index], "token string, order int, name string, verdict string, pattern string")
        urls = parts.select("host", "path").distinct().withColumn("token", F.explode(F.array_union(tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
        fits = urls.join(table, "token").filter(F.regexp_like(target, F.col("pattern")))
        best = fits.groupBy("host", "path").agg(F.min(F.struct("order", "name", "verdict")).alias("_best"))
        judged = parts.join(best, ["host", "path"], "left")
    name = F.when(F.col("_best.order") < 0, F.col("_best.name"))
    return judged.select("page_id", "url", "host", "path", name.alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
