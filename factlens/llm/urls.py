"""URL filters by association rules.

An address is a set of tokens: labels and endings of its host, path segments, file ending, query keys, scheme. Over
the addresses whose pages have labels, pattern growth finds token combinations that come with the label `bad`; rules with
enough support and confidence, and no shorter rule inside them, are kept. A rule blocks an address that has all of its
tokens: an inverted index from a rule's rarest token finds the rules that may fit, and a look at the
others shows which do. Hand-written rules of host and path come first.

Rules of one token are counted directly; tokens that only bad addresses have, and tokens that all have, make no longer
rule that would be kept; tokens on exactly the same addresses stand for each other. All others are combined, however
many an address has, by pattern growth over projected addresses, one more token a round (`_longer`). So twenty keys that
always come together cost no more than one; the cost grows with the number of combinations that enough bad addresses
have without being a rule, 2^k at worst for k tokens that mix freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.store import written

#: Fixed rules of the contract: verdict, host, start of the path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Rule tables of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, ties by host then path; null if none does."""
    found = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*found, F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))


def tokens(url: Column) -> Column:
    """The address as a sorted set of tokens; numbers are left out, since they don't repeat."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("^[0-9]+$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.get(F.split(x, "="), 0)), lambda k: k != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    prefixed = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                prefixed("host", F.filter(labels, lambda x: x != "")),
                F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site:"), F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))))).otherwise(F.array().cast("array<string>")),
                prefixed("path", segments),
                F.when(ending != "", F.array(F.concat(F.lit("end:"), ending))).otherwise(F.array().cast("array<string>")),
                prefixed("key", keys),
                F.when(url.rlike("^[a-z]+://"), F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([a-z]+)://", 1)))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def _broadcast(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _longer(state: DataFrame, least: float, confidence: float) -> DataFrame:
    """state(prefix, total, tail, n, n_bad) -> rules(ids, confidence): prefixes with more ids, none with another inside.

    A row is n addresses, n_bad of them bad, that have the tokens of prefix, as total do, and of the later ones those in
    tail. A round counts each prefix with one more token. A branch ends only where no such rule can follow: its bad
    addresses are too few, the token is in all of the prefix's (it changes nothing), a rule lies inside, or the good
    addresses with all tokens left, which stay whatever is added, outweigh the bad ones.
    """
    ids = F.array_append("prefix", F.col("id"))
    rules = None
    while True:
        counted = state.select("prefix", "total", "n", "n_bad", F.explode("tail").alias("id")).groupBy("prefix", "total", "id").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
        counted = counted.filter((F.col("n_bad") >= least) & (F.col("n") < F.col("total")))
        if rules is not None:
            inside = rules.select(F.col("ids").alias("rule"), F.explode("ids").alias("id"))
            counted = counted.join(inside, (inside["id"] == counted["id"]) & (F.size(F.array_except("rule", F.array_append("prefix", counted["id"]))) == 0), "left_anti")
        counted = written(counted.select("prefix", "id", "n", "n_bad", (F.col("n_bad") / F.col("n")).alias("sure")), "url-counted")
        found = counted.filter(F.col("sure") >= confidence).select(ids.alias("ids"), F.col("sure").alias("confidence"))
        rules = found if rules is None else rules.union(found)
        open_ = counted.filter(F.col("sure") < confidence).groupBy("prefix").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("n", "n_bad")))).alias("open"))
        open_ = open_.filter(F.size("open") > 1)
        stay = F.filter("tail", lambda i: F.map_contains_key("open", i))
        whole = state.join(open_, "prefix").filter(F.size(stay) == F.size("open")).groupBy("prefix").agg(F.sum(F.col("n") - F.col("n_bad")).alias("good"))
        sure = lambda _, c: c["n_bad"] / (c["n_bad"] + F.coalesce("good", F.lit(0))) >= confidence
        open_ = open_.join(whole, "prefix", "left").select("prefix", F.map_filter("open", sure).alias("open")).filter(F.size("open") > 1)
        grown = state.join(open_, "prefix").select("prefix", "open", "n", "n_bad", stay.alias("tail"))
        grown = grown.select("prefix", "open", "n", "n_bad", "tail", F.posexplode("tail").alias("place", "id")).filter("place + 1 < size(tail)")
        grown = grown.groupBy(ids.alias("prefix"), F.col("open")[F.col("id")]["n"].alias("total"), F.expr("slice(tail, place + 2, size(tail))").alias("tail"))
        state = written(grown.agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "url-grown")
        if state.isEmpty():
            return rules


def mined_rules(labelled: DataFrame, support: float = 0.0, confidence: float = 0.6, least_count: int = 20, max_items: int | None = None) -> DataFrame:
    """labelled(tokens, bad) -> rules(rule_id, tokens, any_of, n_tokens, confidence, rarest).

    A rule needs least_count bad addresses, however many there are, and at least the share `support` of all; a rule with
    a shorter one inside it is dropped: it would block nothing more. tokens stand for all that are on the same
    addresses: any token of each array in any_of serves. rarest is the array of the rarest one. max_items is without
    effect, since all tokens of an address are combined; callers may still give it.
    """
    rows = written(labelled.select("tokens", "bad"), "url-labelled").withColumn("row", F.monotonically_increasing_id())
    least = max(least_count, support * rows.filter(F.col("bad") | (F.size("tokens") > 0)).count() if support else 0)
    at = written(rows.select("row", "bad", F.explode(F.array_distinct("tokens")).alias("token")), "url-tokens")
    n_rows = rows.count()
    # two sums of hashes of the rows tell tokens on the same addresses
    known = at.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *[F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")).alias(f"on{i}") for i in (1, 2)]
    )
    same = known.filter(F.col("n_bad") >= least).groupBy("n", "n_bad", "on1", "on2").agg(F.array_sort(F.collect_list("token")).alias("any_of"))
    same = same.select(F.monotonically_increasing_id().alias("id"), F.get("any_of", F.lit(0)).alias("item"), "any_of", "n", "n_bad", (F.col("n_bad") / F.col("n")).alias("sure"))
    same = written(same, "url-items")
    singles = same.filter(F.col("sure") >= confidence).select(F.array("id").alias("ids"), F.col("sure").alias("confidence"))
    open_ = same.filter((F.col("sure") < confidence) & (F.col("n") < n_rows)).select("item", F.struct("n", "id").alias("rank"))
    baskets = at.join(_broadcast(open_), at["token"] == F.col("item")).groupBy("row", "bad").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    baskets = baskets.groupBy("ranks").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    # a combination is looked for at its rarest token, among the more frequent ones
    dealt = baskets.select("n", "n_bad", "ranks", F.posexplode("ranks").alias("place", "first")).filter("place + 1 < size(ranks)")
    dealt = dealt.groupBy(F.array("first.id").alias("prefix"), F.col("first.n").alias("total"), F.expr("transform(slice(ranks, place + 2, size(ranks)), r -> r.id)").alias("tail"))
    dealt = written(dealt.agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "url-baskets")
    longer = _longer(dealt, least, confidence)
    found = written(singles.union(longer).withColumn("rule_id", F.monotonically_increasing_id()), "url-found")
    parts = found.select("rule_id", "confidence", F.explode("ids").alias("id")).join(_broadcast(same.select("id", "item", "any_of", F.col("n").alias("seen"))), "id")
    rules = parts.groupBy("rule_id", "confidence").agg(F.array_sort(F.collect_list("item")).alias("tokens"), F.sort_array(F.collect_list(F.struct("seen", "any_of", "item"))).alias("p"))
    rules = written(
        rules.select("rule_id", "tokens", F.col("p.any_of").alias("any_of"), F.size("tokens").alias("n_tokens"), "confidence", F.col("p.any_of")[0].alias("rarest"), F.col("p.item")[0].alias("first")),
        "url-rules",
    )
    # the rules inside a rule have their rarest token in it
    inner = rules.select(F.col("tokens").alias("inner_tokens"), F.col("n_tokens").alias("inner_n"), F.col("first").alias("token"))
    outer = rules.select("rule_id", "tokens", "n_tokens", F.explode("tokens").alias("token"))
    inside = outer.join(inner, "token").filter("inner_n < n_tokens").filter(F.size(F.array_except("inner_tokens", "tokens")) == 0)
    return rules.drop("first").join(inside.select("rule_id").distinct(), "rule_id", "left_anti")


def blocked(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses(key, tokens), one row a key -> the keys that some rule blocks."""
    index = written(rules.select(F.explode("rarest").alias("token"), "any_of"), "url-index")
    at = addresses.select("key", "tokens", F.explode("tokens").alias("token"))
    maybe = at.join(_broadcast(index), "token")
    return maybe.filter(F.forall("any_of", lambda some: F.arrays_overlap(some, F.col("tokens")))).select("key").distinct()


def judge(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
    support: float = 0.0, confidence: float = 0.6, least_count: int = 20, max_items: int | None = None,
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict.

    labels(page_id, bad) says which pages were found bad; unlabelled pages don't teach, contradicting labels count as
    bad. Null addresses and those without :// have empty host and path and no tokens: nothing blocks them. Equal
    addresses are judged alike, repeated rows kept; other columns are left out; empty tables give empty results.
    """
    rows = written(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("tokens", F.when(F.col("url").contains("://"), tokens(F.col("url"))).otherwise(F.array().cast("array<string>")))
        .withColumn("key", F.md5(F.to_json("tokens").cast("binary")))
        .drop("url"),
        "url-pages",
    )
    known = labels.select(F.col("page_id").alias("p"), "bad").filter("p IS NOT NULL AND bad IS NOT NULL").groupBy("p").agg(F.max("bad").alias("bad"))
    labelled = rows.join(known, F.col("page_id") == F.col("p")).select("tokens", "bad")
    mined = mined_rules(labelled, support, confidence, least_count, max_items)
    # equal token sets are looked up once
    distinct = rows.filter(F.size("tokens") > 0).groupBy("key").agg(F.first("tokens").alias("tokens"))
    hit = written(blocked(distinct, mined).select(F.col("key").alias("k")), "url-hits")
    fixed = fixed_rule(F.col("host"), F.col("path"))
    judged = rows.withColumn("fixed", fixed).join(_broadcast(hit), F.col("key") == F.col("k"), "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("k").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.col("k").isNotNull().alias("mined"))
