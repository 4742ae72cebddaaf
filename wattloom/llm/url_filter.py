"""Association-rule URL filters: FP-growth over URL tokens, rules matched by inverted index (operator 5)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of the rules' index up to this number are sent to all tasks when URLs are matched; more are joined by shuffle.
FEW_RULES = 50_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as struct<rule,verdict>, or null: a rule fits
    its host and subdomains of it where the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of, as a set: scheme, top domain, registered domain, first label, path words,
    file ending, query keys, fragment.  Numbers count as one word.  Null or without a scheme: none."""
    labels = F.split(host, r"\.")
    words = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(F.lower(s), r"\d+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.regexp_replace(F.lower(F.regexp_extract(s, r"^([^=]*)", 1)), r"\d+", "0")))
    one = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(name + "="), value))).otherwise(F.array().cast("array<string>"))
    made = F.concat(
        one("scheme", F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), one("top", F.element_at(labels, -1)),
        one("domain", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))), F.when(F.size(labels) > 2, one("first", labels[0])).otherwise(F.array().cast("array<string>")),
        words, one("ending", F.lower(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1))), keys, F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(made))).otherwise(F.array().cast("array<string>"))


def inseparable(tokens: DataFrame, least: float) -> DataFrame:
    """(item, members): tokens of `tokens` (row, token) that occur in `least` rows or more; those that occur
    in exactly the same rows are members of one item, named by the first."""
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    items = seen.where(F.col("n") >= least).groupBy("n", "x", "y").agg(F.array_sort(F.collect_set("token")).alias("members"))
    return items.select(F.col("members")[0].alias("item"), "members")


def mine(labelled: DataFrame, items: str, label: str, *, support: float = 0.002, confidence: float = 0.8, longest: int = 3) -> DataFrame:
    """Rules (rule_id, antecedent, members, verdict, confidence, support) that Spark's FP-growth finds in the
    labelled token sets.  The label is an item of each transaction; an itemset with it, against the itemset
    without, gives the confidence.  Kept are rules of `longest` items at most, with at least the support (share of
    labelled URLs) and confidence, unless a shorter one within it is as sure.

    Tokens that occur in exactly the same labelled URLs are one item, or a long path that many URLs repeat would
    have an itemset for each of its subsets.  Any member stands for its item: members[k] are those of antecedent[k]."""
    spark = labelled.sparkSession
    mark = "\x01"
    rows = stored(labelled.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.array_distinct(items).alias("tokens"), F.concat(F.lit(mark), F.col(label)).alias("label")), "url-labels")
    n = rows.where(F.size("tokens") > 0).count()
    kind = "rule_id bigint, antecedent array<string>, members array<array<string>>, verdict string, confidence double, support double"
    if not n:
        return spark.createDataFrame([], kind)
    each = rows.select("row", F.explode("tokens").alias("token"))
    names = stored(inseparable(each, support * n), "url-items")
    basket = each.join(names.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("own"))
    rows = rows.where(F.size("tokens") > 0).join(basket, "row", "left").select(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array("label")).alias("items"))
    sets = stored(FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows).freqItemsets.where(F.size("items") <= longest + 1), "itemsets")
    own = sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(mark))).alias("antecedent"), F.array_join(F.filter("items", lambda x: x.startswith(mark)), "").alias("m"), "freq")
    alone = own.where("m = ''").select(F.col("antecedent").alias("a2"), F.col("freq").alias("all"))
    sure = own.where("m != '' and size(antecedent) between 1 and " + str(longest)).join(alone, F.col("antecedent") == F.col("a2"))
    sure = sure.select("antecedent", F.expr("substring(m, 2)").alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / n).alias("support")).where(F.col("confidence") >= confidence)
    parts = sure.select("antecedent", "verdict", "confidence", F.explode(F.transform(F.sequence(F.lit(1), F.size("antecedent")), lambda k: F.array_remove("antecedent", F.element_at("antecedent", k)))).alias("within"))
    parts = parts.where(F.size("within") > 0)
    shorter = sure.select(F.col("antecedent").alias("within"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"))
    spare = parts.join(shorter, "within").where((F.col("verdict") == F.col("v2")) & (F.col("c2") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    kept = sure.join(spare, ["antecedent", "verdict"], "left_anti").withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
    whole = kept.select("rule_id", F.posexplode("antecedent").alias("at", "item")).join(names, "item")
    whole = whole.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("at", "members"))).alias("m")).select("rule_id", F.col("m.members").alias("members"))
    return stored(kept.join(whole, "rule_id").select("rule_id", "antecedent", "members", "verdict", "confidence", "support"), "url-rules")


def matched(df: DataFrame, items: str, rules: DataFrame) -> DataFrame:
    """df and mined struct<antecedent,verdict,confidence>: the surest rule (then the better supported, then the least id) of
    whose items a row has a member each, or null.  The inverted index leads from a token to the rules that need it; each
    distinct token set is looked up once."""
    index = rules.select("rule_id", F.size("antecedent").alias("need"), F.posexplode("members").alias("at", "own"), F.struct("confidence", "support", (-F.col("rule_id")).alias("id"), "verdict", "antecedent").alias("r"))
    index = index.select("rule_id", "need", "at", "r", F.explode("own").alias("token"))
    index = F.broadcast(index) if index.count() <= FEW_RULES else index
    d = df.withColumn(f"{P}set", F.to_json(F.col(items)))
    sets = d.groupBy(f"{P}set").agg(F.first(items).alias(f"{P}items"))
    hits = sets.select(f"{P}set", F.explode(f"{P}items").alias("token")).join(index, "token").groupBy(f"{P}set", "rule_id").agg(F.size(F.collect_set("at")).alias("n"), F.first("need").alias("need"), F.first("r").alias("r"))
    best = hits.where("n = need").groupBy(f"{P}set").agg(F.max("r").alias("r")).select(F.col(f"{P}set").alias(f"{P}s2"), F.struct("r.antecedent", "r.verdict", "r.confidence").alias("mined"))
    best = stored(best, "url-matches")  # read anew, both sides of the join are dealt by it, and AQE can split a set that most URLs share
    return d.join(best, F.col(f"{P}set") == F.col(f"{P}s2"), "left").drop(f"{P}set", f"{P}s2")


def judge(df: DataFrame, url: str, rules: list[tuple[str, str, str]], *, default: str = "allow", support: float = 0.002, confidence: float = 0.8) -> DataFrame:
    """df with host, path, rule, verdict and mined (the token rule behind a verdict, if one is).

    The listed rules come first; the URLs that they judge are the labels from which token rules are mined;
    any other URL takes the surest token rule that it meets, or else `default`.  A null URL, or one without
    ://, has an empty host and path and takes the default.  Columns of df by those names are replaced."""
    made = ["host", "path", "rule", "verdict", "mined"]
    d = df.drop(*made).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    d = d.withColumns({f"{P}l": listed(F.col("host"), F.col("path"), rules), f"{P}tok": tokens(F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path"))})
    learned = mine(d.where(f"{P}l is not null").select(f"{P}tok", F.col(f"{P}l.verdict").alias("verdict")), f"{P}tok", "verdict", support=support, confidence=confidence)
    d = matched(d, f"{P}tok", learned)
    by_rule = F.col(f"{P}l").isNotNull()
    return d.withColumns({"rule": F.col(f"{P}l.rule"), "verdict": F.coalesce(F.col(f"{P}l.verdict"), F.col("mined.verdict"), F.lit(default)), "mined": F.when(~by_rule, F.col("mined"))}).drop(f"{P}l", f"{P}tok")
