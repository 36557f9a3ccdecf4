"""URL filters: listed host/path rules, and association rules that FP-growth mines from labelled urls.

Everything is DataFrame and SQL functions; the miner is Spark's own FP-growth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The list that the contract states, as (action, host, path).
LISTED_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

BLOCK_ITEM = "verdict=block"
#: A token set of at least this part of the pages is matched by broadcast: there are at most as many such sets.
HOT = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class RuleMining:
    """Limits of the mined rules.

    min_support bounds the frequent tokens to 1/min_support per token of a url, whatever the input's size; a rule
    blocks when it holds for min_confidence of its labelled urls and for min_lift times the share of blocked urls.
    """

    min_support: float = 0.005
    min_confidence: float = 0.5
    min_lift: float = 1.25
    max_antecedent: int = 3


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def url_host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null url or one without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty likewise."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: every label suffix of the host, its labels' words, the path's folders and the file's ending.

    Numbers are not tokens, so a page's own number can't become a rule.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    words = F.transform(
        F.filter(F.split(host, r"[.\-]"), lambda w: (w != "") & ~w.rlike(r"\A\d+\z")), lambda w: F.concat(F.lit("word="), w)
    )
    folders = F.transform(
        F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+\z", ""), "/"), lambda s: (s != "") & ~s.rlike(r"\A\d+\z")),
        lambda s: F.concat(F.lit("path="), s),
    )
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)
    endings = F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, words)), folders, endings))


def listed_rule(host: Column, path: Column, rules=LISTED_RULES) -> Column:
    """The longest listed rule that fits, as struct(rule, action); null if none.

    A rule fits its host and all subdomains when the url's path starts with the rule's path (an
    empty path starts with none of them). Length counts the host's and the path's characters; of two equally long rules the longer host wins.
    """
    ordered = sorted(rules, key=lambda r: (-(len(r[1]) + len(r[2])), -len(r[1]), r))
    cases = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in ordered
    ]
    return F.coalesce(*cases)


def joined(tokens: Column) -> Column:
    """Tokens as one text that no other tokens have: by spaces, with spaces and backslashes in a token escaped."""
    return F.array_join(F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\ "))), " ")


def closed_tokens(labelled: DataFrame, mining: RuleMining) -> DataFrame:
    """(token, members): the frequent tokens by the set of rows that they occur in; token is the longest of its members.

    Rows of the same tokens are counted as one first. Two tokens have the same rows if the sums over their rows of
    two hashes agree; tokens below the support are in no rule.
    """
    alike = labelled.groupBy("tokens").agg(F.count("*").alias("n"))
    total = labelled.count()
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)"))
    marked = alike.select("tokens", "n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), wide(1).alias("a"), wide(2).alias("b"))
    frequent = marked.where(F.col("n") >= mining.min_support * total)
    return frequent.groupBy("n", "a", "b").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("token"), F.collect_set("token").alias("members")).select("token", "members")


def mine_rules(labelled: DataFrame, mining: RuleMining = RuleMining()) -> DataFrame:
    """Rules (rule_id, tokens, n_tokens, confidence, lift, support, members) from labelled(tokens array<string>, blocked boolean).

    Rows with null tokens or a null label are left out; no labelled row gives no rule. Of rules with the same
    consequence, one whose tokens contain another's with at least its confidence is dropped. Of tokens that occur in
    the same labelled urls only one is mined, so that k folders that always go together are one item and not 2^k sets;
    elsewhere they may come apart, so a rule keeps, for each of its tokens, all that stand for it: members(token, of).
    """
    sound = labelled.where(F.col("tokens").isNotNull() & F.col("blocked").isNotNull())
    # of at most tokens-per-url / min_support names
    classes = written(closed_tokens(sound, mining), "url-tokens")
    kept = classes.agg(F.collect_set("token").alias("kept"))
    baskets = (
        sound.crossJoin(F.broadcast(kept)).withColumn("tokens", F.array_intersect("tokens", "kept"))
        .select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK_ITEM)))).otherwise(F.col("tokens")).alias("items"))
        .where(F.size("items") > 0)
    )
    model = FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(baskets)
    rules = (
        model.associationRules.where(
            F.array_contains("consequent", BLOCK_ITEM) & (F.col("lift") >= mining.min_lift) & (F.size("antecedent") <= mining.max_antecedent)
        )
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")
        .withColumn("n_tokens", F.size("tokens"))
        .withColumn("rule_id", joined(F.col("tokens")))
    )
    rules = written(rules, "url-rules")
    # a rule is redundant if a shorter one (sharing a token) says at least as much
    tokens = rules.select("rule_id", "n_tokens", "confidence", F.explode("tokens").alias("token"))
    general = tokens.select(F.col("rule_id").alias("other"), F.col("n_tokens").alias("other_n"), F.col("confidence").alias("other_confidence"), "token")
    redundant = (
        tokens.join(general, "token")
        .where((F.col("other_n") < F.col("n_tokens")) & (F.col("other_confidence") >= F.col("confidence")))
        .groupBy("rule_id", "other", "other_n")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") == F.col("other_n"))
        .select("rule_id")
        .distinct()
    )
    told = rules.join(redundant, "rule_id", "left_anti")
    stand = told.select("rule_id", F.explode("tokens").alias("of")).join(classes.withColumnRenamed("token", "of"), "of").select("rule_id", "of", F.explode("members").alias("token"))
    return told.join(stand.groupBy("rule_id").agg(F.collect_list(F.struct("token", "of")).alias("members")), "rule_id")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_id, mined_rule): for each token set the most confident rule of which it holds, for each token, a member.

    The rules become an inverted index token -> rule; a set meets only the rules it shares a token with, and a rule
    fires when all its tokens have been met.
    """
    index = rules.select("rule_id", "n_tokens", "confidence", F.explode("members").alias("m")).select("rule_id", "n_tokens", "confidence", "m.token", "m.of")
    return (
        sets.select("set_id", F.explode("tokens").alias("token"))
        .join(index, "token")
        .groupBy("set_id", "rule_id", "n_tokens", "confidence", "of")
        .agg(F.lit(1).alias("one"))
        .groupBy("set_id", "rule_id", "n_tokens", "confidence")
        .agg(F.count("*").alias("met"))
        .where(F.col("met") == F.col("n_tokens"))
        .groupBy("set_id")
        .agg(F.max_by("rule_id", F.struct("confidence", "n_tokens", "rule_id")).alias("mined_rule"))
    )


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=LISTED_RULES, mining: RuleMining = RuleMining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every row of pages(page_id, url).

    The listed rule decides; where none fits, the mined rules do: block if one fires, else allow. labelled has
    (url, blocked). Null urls and urls without ``://`` have empty host and path and are allowed; repeated rows are
    judged each; empty tables give no rows. Other columns of either frame are not looked at.
    """
    def parted(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn(
            "tokens", F.array_sort(url_tokens(F.col("host"), F.col("path")))
        )

    mined = mine_rules(parted(labelled, "blocked"), mining)
    judged = (
        parted(pages, "page_id")
        .withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
        .withColumn("set_id", F.when(F.col("listed").isNull(), joined(F.col("tokens"))))
    )
    sets = judged.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("pages"))
    told = written(sets.join(match_rules(sets, mined), "set_id", "left").select("set_id", "pages", "mined_rule"), "url-sets")
    # a set with one page in HOT or more is one of HOT at most: those travel to the pages
    total = told.agg(F.sum("pages").alias("total"))  # one row
    hot = told.join(F.broadcast(total), F.col("pages") * HOT >= F.col("total")).select(F.col("set_id").alias("hot_id"), F.col("mined_rule").alias("hot_rule"))
    met = judged.join(F.broadcast(hot), F.col("set_id") == F.col("hot_id"), "left")
    # rows that a listed rule or a hot set decides get keys of their own, which match nothing and spread over the tasks
    own = F.concat(F.lit("own "), F.xxhash64("page_id", "path").cast("string"))
    spread = met.withColumn("set_id", F.when(F.col("set_id").isNull() | F.col("hot_id").isNotNull(), own).otherwise(F.col("set_id")))
    cold = told.select("set_id", F.col("mined_rule").alias("cold_rule"))
    return (
        spread.join(cold, "set_id", "left").withColumn("mined_rule", F.coalesce("hot_rule", "cold_rule"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("listed.rule").alias("rule"),
            F.coalesce("listed.action", F.when(F.col("mined_rule").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
            "mined_rule",
        )
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): a page's label is that of the document its url names by the last number of the path.

    Blocked: toxic, or of quality 0. Urls without such a number, or naming a document without a label, give no row.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    named = pages.select("url", F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[.][A-Za-z]+)?/?(?:[?#].*)?$', 1), '') AS BIGINT)").alias("doc_id"))
    blocked = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return named.join(marks, "doc_id").select("url", blocked.alias("blocked"))
