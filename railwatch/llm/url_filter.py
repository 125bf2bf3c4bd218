"""URL filtering by fixed rules and by association rules mined from labels.

Tokens that the same labelled rows hold are one item, since no rule could tell
them apart. Items that are sure enough by themselves are rules; larger sets that
hold one of them block nothing more, so it is taken out before FP-growth mines
combinations of the other items from the bad pages. These are counted over the
other labelled pages and pruned by confidence, and a rule that contains another
rule is dropped.

Rules lie in an inverted index under their rarest item. A URL meets only the
rules under its items and is blocked if it holds all items of one, an item being
held by any of its tokens. Everything runs in DataFrame operations.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.joins import join_small
from railwatch.session import stored

# (verdict, host, path): the rules that go before mined ones.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

MIN_CONFIDENCE = 0.6
# A rule needs this many bad rows, however many rows there are.
MIN_ROWS = 20


def _after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _fits(host: str, path: str) -> Column:
    ours = F.col("host")
    return ((ours == host) | ours.endswith(f".{host}")) & F.col("path").startswith(path)


def fixed_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(_fits(host, path), host + path, verdict) for verdict, host, path in ordered]
    return (
        F.coalesce(*(F.when(c, F.lit(name)) for c, name, _ in fits)),
        F.coalesce(*(F.when(c, F.lit(verdict)) for c, _, verdict in fits)),
    )


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, marked by the part they stand in: host labels, path words, query words."""

    def words(part: Column, mark: str) -> Column:
        found = F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}-]+"), lambda t: t != "")
        return F.transform(found, lambda t: F.concat(F.lit(mark), t))

    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*[^?#]*(.*)$", 1)
    return F.array_distinct(F.concat(words(host_of(url), "host:"), words(path_of(url), "path:"), words(rest, "query:")))


def _held_by(sets: DataFrame, baskets: DataFrame) -> DataFrame:
    """rule, others: how many ``baskets(items)`` hold all items of each of ``sets(rule, items)``; none if no basket does.

    A set is looked for only in the baskets that hold its rarest item.
    """
    tokens_of = baskets.select(F.explode("items").alias("token"), F.col("items").alias("basket"))
    uses = tokens_of.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    each = sets.select("rule", "items", F.explode("items").alias("token")).join(uses, "token", "left")
    rarest = each.groupBy("rule").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("rarest"), F.first("items").alias("items")
    )
    looked_for = rarest.filter("rarest.uses > 0").select("rule", "items", F.col("rarest.token").alias("token"))
    met = join_small(tokens_of, looked_for, ["token"]).filter(F.size(F.array_except("items", "basket")) == 0)
    return met.groupBy("rule").agg(F.count(F.lit(1)).alias("others"))


def items_of(baskets: DataFrame) -> DataFrame:
    """token, item, bad_rows, rows: tokens that enough bad rows of ``baskets(number, bad, tokens)`` hold.

    Tokens with equal rows (told by their number and two 64-bit hashes) share an
    item, which has the name of the least of them.
    """
    held = baskets.select("bad", "number", F.explode("tokens").alias("token")).groupBy("token")
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "number")).alias(f"same_{seed}") for seed in (1, 2)]
    counted = held.agg(F.count_if("bad").alias("bad_rows"), F.count(F.lit(1)).alias("rows"), *same)
    alike = Window.partitionBy("rows", "same_1", "same_2")
    frequent = counted.filter(F.col("bad_rows") >= MIN_ROWS)
    return frequent.select("token", F.min("token").over(alike).alias("item"), "bad_rows", "rows")


def _sets_of(baskets: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, items: the items that the tokens of each basket stand for; none for baskets without any."""
    met = join_small(baskets.select(key, F.explode("tokens").alias("token")), known.select("token", "item"), ["token"])
    return met.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _smallest(rules: DataFrame) -> DataFrame:
    """Rules that contain no other rule."""
    index = rules.select(F.col("rule").alias("inner"), F.col("items").alias("held"), F.element_at("items", 1).alias("token"))
    each = rules.select("rule", "items", F.explode("items").alias("token")).join(index, "token")
    larger = each.filter((F.size("held") < F.size("items")) & (F.size(F.array_except("held", "items")) == 0))
    return rules.join(larger.select("rule").distinct(), "rule", "left_anti")


def mined_rules(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, items, confidence) from ``labelled(url, bad)``, and the items (token, item, rows) they speak of.

    A rule needs ``MIN_ROWS`` bad rows that hold it. Only bad rows are mined; the
    other rows are counted for the sets found.
    """
    cut = labelled.select("bad", tokens(F.col("url")).alias("tokens"))
    baskets = stored(cut.withColumn("number", F.monotonically_increasing_id()), "baskets")
    known = stored(items_of(baskets), "items")
    confidence = F.col("bad_rows") / F.col("rows")
    one = known.select(F.col("item").alias("rule"), F.array("item").alias("items"), confidence.alias("confidence"))
    one = one.filter(F.col("confidence") >= MIN_CONFIDENCE).distinct()
    open_ = stored(known.filter(confidence < MIN_CONFIDENCE), "open")
    harmful = stored(_sets_of(baskets.filter("bad"), open_, "number").filter(F.size("items") > 1), "harmful")
    rows = harmful.count()
    if rows < MIN_ROWS:
        return stored(one, "rules"), known
    # The product with the number of rows is rounded up, so half a row less asks for MIN_ROWS.
    model = FPGrowth(itemsCol="items", minSupport=(MIN_ROWS - 0.5) / rows).fit(harmful)
    items = F.array_sort("items")
    found = model.freqItemsets.filter(F.size("items") > 1)
    sets = stored(found.select(F.concat_ws(" ", items).alias("rule"), items.alias("items"), "freq"), "sets")
    counted = sets.join(_held_by(sets, _sets_of(baskets.filter("not bad"), open_, "number")), "rule", "left")
    surety = (F.col("freq") / (F.col("freq") + F.coalesce("others", F.lit(0)))).alias("confidence")
    several = stored(counted.select("rule", "items", surety).filter(F.col("confidence") >= MIN_CONFIDENCE), "several")
    return stored(one.unionByName(_smallest(several)), "rules"), known


def _fired(urls: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """url, mined_rule, confidence: the surest rule of every URL that some rule matches, of equally sure ones the last by name."""
    uses = known.select("item", "rows").distinct()
    each = rules.select("rule", "items", "confidence", F.explode("items").alias("item")).join(uses, "item")
    index = each.groupBy("rule", "items", "confidence").agg(F.min(F.struct("rows", "item")).alias("rarest"))
    index = index.select("rule", F.col("items").alias("asked"), "confidence", F.col("rarest.item").alias("item"))
    held = _sets_of(urls.select("url", tokens(F.col("url")).alias("tokens")), known, "url")
    met = join_small(held.select("url", "items", F.explode("items").alias("item")), index, ["item"])
    whole = met.filter(F.size(F.array_except("asked", "items")) == 0)
    surest = F.max(F.struct("confidence", "rule")).alias("surest")
    return whole.groupBy("url").agg(surest).select("url", F.col("surest.rule").alias("mined_rule"), "surest.confidence")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule, confidence.

    A page shows the document whose number ends its path, so that document's
    label is the page's: bad if its quality is 0 or it is toxic. Pages whose
    document has no label teach nothing; of several labels of a document any bad
    one counts. Mining looks at all labelled pages.

    Null URLs and URLs without ``://`` have an empty host and path and no tokens,
    and are allowed. Repeated rows and null ids are judged each. Of several rules
    that match, the surest is named, of equally sure ones the last by name; the
    longest fixed rule goes before all of them. Other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    number = F.regexp_extract("url", r"^[^?#]*/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1)
    known = labels.filter("doc_id is not null").groupBy("doc_id")
    known = known.agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False))) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    numbered = pages.withColumn("doc_id", F.when(number != "", number.cast("long")))
    mined, items = mined_rules(numbered.join(known, "doc_id").select("url", "bad"))
    fired = _fired(pages.filter("url is not null").select("url").distinct(), mined, items)
    rule, verdict = fixed_rule(rules)
    mined_verdict = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return (
        pages.join(fired, "url", "left")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined_rule", "confidence")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "mined_rule", "confidence")
    )
