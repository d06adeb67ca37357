"""News, posts and their sources: keys, predicates, scores, dedupe, matching and roll-ups.

Vocabularies are parameters: lists of terms or (pattern, points) pairs, or small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.spread import components, total_rank
from tidemark.sources.shared import written

TRACKING = r"(utm_[^=&]*|fbclid|gclid|ncid|sid|session|tracking)=[^&#]*"


# Fixed patterns and words: what is news of the market, of a sector, and of neither; terms too broad to name a sector.
MARKET = r"(?i)코스피|코스닥|증시|주식시장|시장\s*(?:흐름|마감|전망|수급)|외국인|기관|금리|환율|원화|달러|마감|상승|하락|급등|급락"
LOW_PRIORITY = r"(?i)유상증자|제3자배정|시간외|애프터마켓|after\s*market|신규\s*상장|상장예비심사|예심\s*청구|공모가|주요공시|취득|처분|단일판매|공급계약|투자주의|조회공시|풍문"
NO_SECTOR = r"(?i)\bLH\b|한국토지주택공사|부동산\s*(?:대책|시장|거래|분양)|아파트|청약|전세|월세|노동|파업|임금|세관|관세청|밀수|압수"
BROAD = "AI 부품 기계 건설 철강 금융 증권 보험 화학 정유 유통 미디어 게임 인터넷 소비재".split()


def is_direct(url: Column, discovery: Column, host: str) -> Column:
    """An article of its own: with an address, that is neither found by discovery nor on the discovery host."""
    at = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return (F.coalesce(url, F.lit("")) != "") & ~F.coalesce(discovery, F.lit(False)) & (at != host)


def is_market(text: Column) -> Column:
    return text.rlike(MARKET)


def sector_terms(sector: str, names: list[str], keywords: list[str]) -> list[str]:
    """The terms of a sector: the parts of its name and its keywords, of two characters or more and not broad, and its stocks' names."""
    fit = lambda words: [w for w in (" ".join(x.split()) for x in words) if len(w) >= 2 and w not in BROAD]
    return list(dict.fromkeys([*fit(sector.replace("/", " ").split()), *filter(None, names), *fit(keywords)]))


def is_sector(text: Column, terms: list[str]) -> Column:
    """News of a sector: one of its terms, and neither what no sector wants nor routine disclosures."""
    named = reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms), F.lit(False))
    return named & ~text.rlike(NO_SECTOR) & ~text.rlike(LOW_PRIORITY)


def squeezed(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def url_key(url: Column | str) -> Column:
    """The address without tracking parameters and fragment, in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, f"(?i)([?&]){TRACKING}(?=&|$)", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, "&{2,}", "&"), r"\?&", "?")
    return F.lower(F.regexp_replace(bare, r"[?&]+$", ""))


def number_of(text: Column | str) -> Column:
    """A number written with commas or blanks; null for a dash, an empty or another text."""
    x = F.regexp_replace(text, r"[,\s]", "")
    n = x.try_cast("double")
    return F.when(~F.isnan(n), n)


def matches(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs, in any case."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t.lower())) for t in terms), F.lit(False))


def pattern_score(text: Column, points: list[tuple[str, int]], need: str | None = None, penalty: int = 0) -> Column:
    """Sum of the points of the patterns that occur, less penalty if need does not."""
    total = reduce(lambda a, b: a + b, (F.when(text.rlike(p), n).otherwise(0) for p, n in points), F.lit(0))
    return total - F.when(~text.rlike(need), penalty).otherwise(0) if need else total


def first_label(text: Column, patterns: list[tuple[str, str]], rest: str | None = None) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), name) for p, name in patterns), F.lit(rest))


def all_labels(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for p, name in patterns)))


def segment(text: Column, name: str, others: list[str], reach: int = 70) -> Column:
    """The part of a sentence from name on, no longer than reach and not past another name."""
    found = F.regexp_extract(text, f"(?i){name}[^\\n.。]{{0,{reach}}}", 0)
    for other in others:
        at = F.locate(other, found)
        found = F.when(at > 1, F.left(found, at - 1)).otherwise(found)
    return found


def event_tags(text: Column, names: dict[str, str], up: str, down: str, tags: list[tuple[str, str]], most: int = 2) -> dict[str, Column]:
    """Of each named index, its direction ("up", "down", empty) and the first percentage beside it; and the first tags whose pattern occurs.

    names: column prefix to the name in the text.
    """
    out = {}
    for prefix, name in names.items():
        part = segment(text, name, [n for n in names.values() if n != name])
        out[f"{prefix}_direction"] = F.when(part.rlike(up), "up").when(part.rlike(down), "down").otherwise("")
        out[f"{prefix}_percent"] = F.regexp_extract(part, r"\d+(?:[.]\d+)?%", 0)
    return out | {"tags": F.array_join(F.slice(all_labels(text, tags), 1, most), ", ")}


def without_chrome(text: Column, drop: list[str], most: int = 3000) -> Column:
    """Lines that are not boilerplate, as far as most characters."""
    line = lambda x: ~F.trim(x).isin(*drop) & ~x.rlike(r"^\s*https?://\S+\s*$") & (F.trim(x) != "")
    return F.substring(F.array_join(F.filter(F.split(text, "\n"), line), "\n"), 1, most)


def good_summaries(items: DataFrame, by: list[str], bad: Column) -> DataFrame:
    """Items that are not bad; where a group has none, all of it."""
    good = F.count_if(~bad).over(W.partitionBy(*by))
    return items.withColumn("__good", good).where(~bad | (F.col("__good") == 0)).drop("__good")


def same_date(items: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """Items of the day, and counts of those without a date or of another one."""
    counts = items.agg(F.count_if(F.col("published").isNull()).alias("missing_date"), F.count_if(F.col("published") != day).alias("other_date"), F.count_if(F.col("published") == day).alias("kept"))
    return items.where(F.col("published") == day), counts


def sector_match(items: DataFrame, terms: DataFrame, top: int = 5, block: int = 500) -> DataFrame:
    """(sector, rank, item_id, score) of items that hold any term of a sector.

    terms (sector, term) is folded into arrays of conditions, so that each text is read once for every ``block`` terms and
    nothing is joined. The driver holds one block of terms at a time; the matches of each but a single block are written.
    """

    def hits(known: list[tuple[str, str]]) -> DataFrame:
        found = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(t)), s) for s, t in known))))
        return items.select("item_id", "score", F.explode(found).alias("sector"))

    rows = ((r["sector"], r["term"].lower()) for r in terms.select("sector", "term").where("term is not null").distinct().orderBy("sector", "term").toLocalIterator())
    parts, known = [], list(islice(rows, block))
    while known:
        more = list(islice(rows, block))
        parts.append(written(hits(known), "matches") if parts or more else hits(known))
        known = more
    each = reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0] if parts else items.select("item_id", "score", F.lit("").alias("sector")).where("false")
    rank = F.row_number().over(W.partitionBy("sector").orderBy(F.desc("score"), "item_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top)


def ranked(items: DataFrame, top: int, least: int | None = None) -> DataFrame:
    """Highest score first, then in the order of arrival."""
    kept = items if least is None else items.where(F.col("score") >= least)
    return kept.orderBy(F.desc("score"), "seq").limit(top)


def news_keys(url: Column, headline: Column) -> tuple[Column, Column]:
    """(address, headline) as dedupe keys: an item without an address has its headline for one, an empty headline is no second key."""
    title = F.lower(squeezed(F.coalesce(headline, F.lit(""))))
    address = F.nullif(url_key(squeezed(F.coalesce(url, F.lit("")))), F.lit(""))
    named = F.concat(F.lit("headline:"), title)
    return F.coalesce(F.concat(F.lit("url:"), address), named), F.when(title != "", named)


def deduped(items: DataFrame, keys: list[str], seq: str = "seq", rounds: int = 3, together: int = 1_000_000) -> DataFrame:
    """items in order of seq (a unique long), each kept unless an earlier kept one has one of its keys.

    A dropped item's keys do not count, so this is not a dropDuplicates for each key. Of items with the same keys only the
    first can be kept. In a round, every item that is the first undecided one of all of its keys is kept, and those that share
    a key with it are dropped. What a few rounds leave undecided are chains of items that decide each other: they are split
    into components, each gone through in order by one task, whatever the length of its chains. A component of more than
    ``together`` items gets further rounds instead, which all tasks share.
    """
    open_ = written(items.groupBy(*keys).agg(F.min(seq).alias(seq)).where(F.coalesce(*keys).isNotNull()), "open")
    kept = items.where(F.coalesce(*keys).isNull()).select(seq)

    def firsts(rows: DataFrame, k: str) -> DataFrame:
        return written(rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(seq).alias("__first")), "first")

    while not open_.isEmpty():
        for _ in range(rounds):
            state = open_
            for i, k in enumerate(keys):
                state = state.join(firsts(open_, k).withColumnRenamed("__first", f"__first{i}"), k, "left")
            wins = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"__first{i}") == F.col(seq), F.lit(True)) for i in range(len(keys))))
            won = written(state.where(wins).select(seq, *keys), "kept")
            kept = kept.unionByName(won.select(seq))
            for k in keys:
                open_ = open_.join(written(won.where(F.col(k).isNotNull()).select(k).distinct(), "taken"), k, "left_anti").select(seq, *keys)
            open_ = written(open_.join(won.select(seq), seq, "left_anti").select(seq, *keys), "open")
            if open_.isEmpty():
                return items.join(kept, seq, "left_semi")
        links = [open_.where(F.col(k).isNotNull()).join(firsts(open_, k), k).select(F.col(seq).alias("u"), F.col("__first").alias("v")) for k in keys]
        parts = components(reduce(DataFrame.unionByName, links)).withColumnsRenamed({"node": seq, "component": "__component"})
        sizes = parts.groupBy("__component").agg((F.count("*") > together).alias("__giant"))
        parts = written(open_.join(parts, seq, "left").withColumn("__component", F.coalesce("__component", seq)).join(sizes, "__component", "left"), "parts")
        small = parts.where(F.coalesce(~F.col("__giant"), F.lit(True)))
        kept = kept.unionByName(written(_in_order(small, keys, seq), "kept"))
        open_, rounds = written(parts.where("__giant").select(seq, *keys), "open"), rounds * 4
    return items.join(kept, seq, "left_semi")


def _in_order(parts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(seq) of what going through each component in order keeps; a task reads its components one after the other."""
    columns = [F.col("__component").alias("component"), F.col(seq).alias("seq"), *(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys))]
    dealt = parts.select(*columns).repartition("component").sortWithinPartitions("component", "seq")

    def gone_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, seen = None, set()
        for b in batches:
            kept = []
            for c, n, *own in b.itertuples(index=False, name=None):
                if c != component:
                    component, seen = c, set()
                own = [(i, k) for i, k in enumerate(own) if isinstance(k, str)]
                if not any(k in seen for k in own):
                    seen.update(own)
                    kept.append(n)
            yield pd.DataFrame({seq: pd.Series(kept, dtype="int64")})

    return dealt.mapInPandas(gone_through, f"{seq} long")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def theme_rollup(items: DataFrame, patterns: list[tuple[str, str]], most: int = 5) -> DataFrame:
    """(theme, n, headlines): items of each theme, and the first distinct headlines."""
    each = items.select("seq", "headline", F.explode(all_labels(F.col("text"), patterns)).alias("theme"))
    first = each.groupBy("theme", "headline").agg(F.min("seq").alias("seq")).withColumn("k", F.row_number().over(W.partitionBy("theme").orderBy("seq")))
    heads = first.where(F.col("k") <= most).groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "headline"))), lambda x: x["headline"]).alias("headlines"))
    return each.groupBy("theme").agg(F.count("*").alias("n")).join(heads, "theme")


def source_metrics(posts: DataFrame, by: str, as_of: Column, timeline: int = 20, old: int = 365) -> DataFrame:
    """Counts of a source's posts: all, its first page, what names the company there, and its newest posts on anything.

    posts: (by, post_id, published, page, relevant, anchor and is_trading, is_listicle,
    is_formulaic, is_deep_tech, is_stock, is_bracketed); of equal days the lesser post_id is
    newer. A post is dedicated if it is relevant and neither of trading nor a list; deep
    posts count on every page. The newest posts are cut off before rows are exchanged, so
    that a source with a third of all posts is no task of its own.
    """
    found = F.col("relevant") & (F.col("page") == 1)
    single = F.col("relevant") & ~F.col("is_trading") & ~F.col("is_listicle")
    own = found & single
    counts = posts.groupBy(by).agg(
        F.count("*").alias("posts"), F.max("page").cast("long").alias("pages"), F.count_if(F.col("page") == 1).alias("page1"), F.count_if((F.col("page") == 1) & F.col("is_trading")).alias("page1_trading"),
        F.count_if(found).alias("relevant"), F.count_if(found & F.col("is_listicle")).alias("listicles"), F.count_if(found & F.col("is_trading")).alias("trading"),
        F.count_if(own).alias("dedicated"), F.count_if(own & F.col("is_formulaic")).alias("dedicated_formulaic"), F.count_if(single & F.col("is_deep_tech")).alias("deep_tech"),
        F.count(F.when(found, F.col("published"))).alias("dated"), F.count_if(found & (F.date_diff(as_of, F.col("published")) > old)).alias("stale"),
        F.min("published").alias("oldest"), F.max("published").alias("newest"), F.max(F.when(found, F.col("published"))).alias("latest"), F.array_sort(F.collect_set("anchor")).alias("anchors"),
    )
    newest = F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_last("published"), "post_id"))
    kinds = ("stock", "bracketed", "formulaic")
    recent = posts.select(by, "published", "post_id", *(f"is_{k}" for k in kinds)).withColumn("nth", newest).where(F.col("nth") <= timeline)
    recent = recent.groupBy(by).agg(F.count("*").alias("timeline"), *(F.count_if(f"is_{k}").alias(k) for k in kinds))
    both = counts.join(recent.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")))
    return both.drop("__by")


def source_gates(metrics: DataFrame, deep: bool = False, least: int = 2) -> DataFrame:
    """accepted and the first reason against; deep asks for a deep post instead of dedicated ones."""
    share = lambda a, b, n: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)) >= n, F.lit(False))
    enough = F.col("timeline") >= 5
    few = F.col("deep_tech") < 1 if deep else ~((F.col("dedicated") >= least) | ((F.size("anchors") > 0) & (F.col("dedicated") >= 1)))
    reason = (
        F.when(share("page1_trading", "page1", 0.5), "trading-shop")
        .when((F.col("dated") >= 3) & share("stale", "dated", 0.8), "stale")
        .when((F.col("dedicated") < 3) & enough & ~share("stock", "timeline", 0.5), "off-topic")
        .when(enough & share("formulaic", "timeline", 0.7), "farm")
        .when((F.col("dedicated") >= 2) & share("dedicated_formulaic", "dedicated", 0.7), "dedicated-farm")
        .when(few, "no-deep-post" if deep else "too-few")
    )
    return metrics.withColumns({"reason": reason, "accepted": reason.isNull()})


def ranked_sources(metrics: DataFrame, by: str, deep: bool = False) -> DataFrame:
    """Sources with an anchor first (deep: those with the most deep posts), then by dedicated and relevant posts, pages, the latest day and name."""
    first = F.desc("deep_tech") if deep else F.desc(F.size("anchors") > 0)
    return total_rank(metrics, [first, F.desc("dedicated"), F.desc("relevant"), F.desc("pages"), F.desc_nulls_last("latest"), F.asc(by)], "rank")


def candidate_pool(sources: DataFrame, top: int = 10) -> DataFrame:
    """The most found unanchored sources, and all anchored ones."""
    return sources.where("not anchored").orderBy(F.desc("hits"), "source").limit(top).unionByName(sources.where("anchored")).dropDuplicates(["source"])


def report(items: DataFrame, sectors: DataFrame, day: Column, roles: str = "role", top: int = 12, least: int = 1, per_sector: int = 5, few: int = 5) -> DataFrame:
    """One run's table (part, name, rank, item_id, n).

    ``market`` and ``sector`` hold the best of the day's direct items (empty sectors are kept), ``discovery`` the day's items found by
    discovery in their order, ``role`` the day's items of each role, ``missing-date`` and ``other-date`` what each role lost by its date,
    and ``warning`` the number of market items where that is under ``few``. items: (item_id, seq, score, text, role, discovery, published); sectors: (sector, term).
    """
    own = items.where(F.col("published") == day)
    direct, found = own.where("not discovery"), own.where("discovery")
    none, no_rank = F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("rank")
    number = W.orderBy(F.desc("score"), "seq")
    best = ranked(direct, top, least).select(F.lit("market").alias("part"), F.lit("all").alias("name"), F.row_number().over(number).alias("rank"), "item_id", none)
    matched = sector_match(direct, sectors, per_sector)
    by_sector = sectors.select("sector").distinct().join(matched, "sector", "left").select(F.lit("sector").alias("part"), F.col("sector").alias("name"), "rank", "item_id", none)
    discovered = total_rank(found.select("item_id", "seq"), [F.asc("seq")], "rank").select(F.lit("discovery").alias("part"), F.lit("all").alias("name"), F.col("rank").cast("int").alias("rank"), "item_id", none)
    counts = items.groupBy(roles).agg(F.count_if(F.col("published") == day).alias("role"), F.count_if(F.col("published").isNull()).alias("missing-date"), F.count_if(F.col("published") != day).alias("other-date"))
    counts = counts.unpivot(roles, ["role", "missing-date", "other-date"], "part", "n").where("n > 0").select("part", F.col(roles).alias("name"), no_rank, F.lit(None).cast("long").alias("item_id"), "n")
    warned = best.agg(F.count("*").alias("n")).where(F.col("n") < few).select(F.lit("warning").alias("part"), F.lit("few-market-items").alias("name"), no_rank, F.lit(None).cast("long").alias("item_id"), "n")
    return reduce(DataFrame.unionByName, [best, by_sector, discovered, counts, warned])
