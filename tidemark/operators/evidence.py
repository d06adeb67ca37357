"""Evidence around documents: references, headlines, baselines, updates, selections and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.news import first_label, squeezed

HOST_AND_PATH = r"(?i)^https?://([^/?#]+)/([^/?#]+)"


def references(links: DataFrame, reserved: list[str], most: int = 3) -> DataFrame:
    """(source, target): names that the first pages of a source link to, without itself and reserved ones.

    links: (source, page, href); the name is the first part of a path.
    """
    page = F.dense_rank().over(W.partitionBy("source").orderBy("page"))
    name = F.regexp_extract("href", r"^(?:https?://[^/?#]+)?/([A-Za-z0-9_-]+)", 1)
    found = links.withColumns({"nth": page, "target": F.lower(name)}).where(F.col("nth") <= most)
    return found.where((F.col("target") != "") & (F.col("target") != F.lower("source")) & ~F.col("target").isin(*reserved)).select("source", "target").distinct()


def merged_updates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Update blocks keyed by (memo, day): new ones replace those of their day, and repeat no event of another day."""
    events = old.select("memo", F.col("day").alias("other"), "event")
    fresh = new.join(events, (new["memo"] == events["memo"]) & (new["event"] == events["event"]) & (new["day"] != events["other"]), "left_anti")
    return old.join(fresh.select("memo", "day"), ["memo", "day"], "left_anti").unionByName(fresh)


def external_views(posts: DataFrame, views: DataFrame) -> DataFrame:
    """One evidence table of posts (source, item_id, text) and broker views (broker, report_id, title)."""
    a = posts.select(F.col("source").alias("name"), F.col("item_id").alias("id"), F.lit("blogger").alias("role"), F.lit("unverified").alias("verification"))
    return a.unionByName(views.select(F.col("broker").alias("name"), F.col("report_id").alias("id"), F.lit("broker").alias("role"), F.when(F.col("title").isNotNull(), "titled").otherwise("unverified").alias("verification")))


def selected_posts(posts: DataFrame, in_title: Column, in_head: Column, most: int = 5) -> DataFrame:
    """For each source, posts whose title matches and then others, of these those whose head mentions it."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("in_title"), "seq"))
    picked = posts.withColumns({"in_title": in_title, "in_head": in_head}).withColumn("rank", rank).where(F.col("rank") <= most)
    return picked.where("in_title or in_head")


def notes(warnings: DataFrame, classes: list[tuple[str, str]], most: int = 4) -> DataFrame:
    """The first distinct classes of each run's warnings, in the order of the classes."""
    order = {name: i for i, (_, name) in enumerate(classes)}
    kind = first_label(F.col("warning"), classes)
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    each = warnings.withColumn("note", kind).where("note is not null").select("run", "note").distinct().withColumn("place", place[F.col("note")])
    return each.withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy("place"))).where(F.col("rank") <= most).select("run", "rank", "note")


def leader_names(rankings: DataFrame, lenses: tuple[str, ...] = ("short", "intermediate", "structural"), top: int = 3, most: int = 8) -> DataFrame:
    """The first names of several lenses, each once, in the order of lenses and ranks."""
    place = F.array_position(F.array(*map(F.lit, lenses)), F.col("lens"))
    fit = rankings.where((F.col("rank") <= top) & F.col("lens").isin(*lenses)).withColumn("place", place)
    once = fit.groupBy("ticker").agg(F.min(F.struct("place", "rank")).alias("at"))
    return once.withColumn("nth", F.row_number().over(W.orderBy("at"))).where(F.col("nth") <= most).select("nth", "ticker")


def ordinary_shares(listings: DataFrame, patterns: list[str], name: str = "name") -> DataFrame:
    """Listings whose name, without blanks, matches none of the patterns of other instruments."""
    bare = F.regexp_replace(name, r"\s+", "")
    out = listings
    for p in patterns:
        out = out.where(~F.coalesce(bare.rlike(p), F.lit(False)))
    return out


def normal_ticker(text: Column) -> Column:
    """The first run of six digits, else the trimmed text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d{6})", 1), F.lit("")), F.trim(text))


def within_lookback(rows: DataFrame, date: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last days; those of an unknown date are kept."""
    return rows.where(F.col(date).isNull() | ((F.col(date) <= as_of) & (F.col(date) >= F.date_sub(as_of, days))))


#: How articles write a target price in won, in the order of trust; the last one counts ten thousands.
PRICE_FORMS = [
    r"목표주가[를을]?\s*([0-9][0-9,]{2,})\s*원으로\s*(?:상향|하향|제시|유지|조정|상승|하락)",
    r"목표주가[를을]?\s*([0-9][0-9,]{2,})\s*원",
    r"목표가[를을]?\s*([0-9][0-9,]{2,})\s*원",
    r"목표\s*가격[을를]?\s*([0-9][0-9,]{2,})\s*원",
    r"\bTP\s*([0-9][0-9,]{2,})",
    r"(?i)target\s*price[^0-9]{0,20}([0-9][0-9,]{2,})",
]
TEN_THOUSANDS_FORM = r"목표주가[를을]?\s*([0-9]+(?:\.[0-9]+)?)\s*만\s*원"
#: Rating phrases, those that contain others first.
RATING_FORMS = [
    ("비중확대", "Overweight"), ("비중축소", "Underweight"), (r"시장수익률\s*상회", "Outperform"), (r"시장수익률\s*하회", "Underperform"), ("시장수익률", "Neutral"),
    ("적극매수", "Strong Buy"), ("중립", "Neutral"), ("매수", "Buy"), ("매도", "Sell"), ("보유", "Hold"),
    (r"(?i)\bEqual[-\s]?weight\b", "Equal-weight"), (r"(?i)\bOverweight\b", "Overweight"), (r"(?i)\bUnderweight\b", "Underweight"), (r"(?i)\bOutperform\b", "Outperform"),
    (r"(?i)\bUnderperform\b", "Underperform"), (r"(?i)\bStrong\s*Buy\b", "Strong Buy"), (r"(?i)\bBuy\b", "Buy"), (r"(?i)\bSell\b", "Sell"), (r"(?i)\bHold\b", "Hold"), (r"(?i)\bNeutral\b", "Neutral"),
]
DATE_FORMS = [r"(20[0-9]{2})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일", r"\b(20[0-9]{2})[-/.]\s*([0-9]{1,2})[-/.]\s*([0-9]{1,2})\b"]
#: Least and (exclusive) greatest target price that is believed.
PRICES = (100, 100_000_000)


#: What each of these forms can't do without, in lower case for those that take either case; it is looked for first, as that costs far less than the pattern.
PRICE_NEEDS = ["목표주가", "목표주가", "목표가", "목표", "TP", "target"]
RATING_NEEDS = ["비중확대", "비중축소", "시장수익률", "시장수익률", "시장수익률", "적극매수", "중립", "매수", "매도", "보유", "equal", "overweight", "underweight", "outperform", "underperform", "strong", "buy", "sell", "hold", "neutral"]
DATE_NEEDS = ["년", "20"]


def ascii_bounds(pattern: str) -> str:
    r"""pattern with \b at ASCII letters, digits and _ alone: Hangul right beside a word does not continue it."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def once(x: Column, f) -> Column:
    """f of x, which is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def has(text: Column, pattern: str, need: str, low: Column) -> Column:
    """Whether what a pattern needs occurs in the text, or in the text in lower case if it takes either case."""
    return F.contains(low if pattern.startswith("(?i)") else text, F.lit(need))


def target_price(text: Column, low: Column | None = None) -> Column:
    """The price of the first form that is found and believed; the first place of a form alone counts. low: text in lower case, where it is known."""
    least, most = PRICES

    def of(t: Column) -> Column:
        number = lambda p: F.regexp_replace(F.regexp_extract(t["text"], ascii_bounds(p), 1), ",", "").try_cast("bigint")
        whole = [F.when(has(t["text"], p, need, t["low"]), number(p)) for p, need in zip(PRICE_FORMS, PRICE_NEEDS, strict=True)]
        tens = F.when(F.contains(t["text"], F.lit("목표주가")), F.regexp_extract(t["text"], TEN_THOUSANDS_FORM, 1).try_cast("double") * 10_000)
        return F.get(F.filter(F.array(*whole, F.round(tens).cast("bigint")), lambda v: (v >= least) & (v < most)), F.lit(0))

    return once(F.struct(text.alias("text"), (F.lower(text) if low is None else low).alias("low")), of)


def rating(text: Column, low: Column | None = None) -> Column:
    found = lambda t: F.coalesce(*(F.when(has(t["text"], p, need, t["low"]) & t["text"].rlike(ascii_bounds(p)), label) for (p, label), need in zip(RATING_FORMS, RATING_NEEDS, strict=True)))
    return once(F.struct(text.alias("text"), (F.lower(text) if low is None else low).alias("low")), found)


def stated_date(text: Column) -> Column:
    """The first full date, else null; one that the calendar lacks is null too."""

    def of(p: str, need: str) -> Column:
        def iso(x: Column) -> Column:
            part = lambda i: F.regexp_extract(x, ascii_bounds(p), i)
            return F.when(x != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))

        return F.when(F.contains(text, F.lit(need)), once(F.regexp_extract(text, ascii_bounds(p), 0), iso))

    return F.coalesce(*map(of, DATE_FORMS, DATE_NEEDS)).try_cast("date")


def broker_views_extract(articles: DataFrame, aliases: DataFrame, around: int = 200, thesis: int = 240, most_aliases: int = 1000) -> DataFrame:
    """For each article and broker named in it: price, rating and date of the paragraph around its first alias, else of the whole text.

    articles (article_id, text, published: date of the article or null). A paragraph ends at
    blank lines; in a text with none around, it reaches `around` characters to both sides.
    Aliases of letters, digits and signs of ASCII count as whole words only, others anywhere.
    aliases (broker, alias) is a dimension, folded into one expression and so refused beyond
    most_aliases rows; nothing is shuffled.
    """
    known = [(r["broker"], r["alias"]) for r in aliases.select("broker", "alias").distinct().limit(most_aliases + 1).collect()]
    if len(known) > most_aliases:
        raise ValueError(f"more than {most_aliases} aliases")
    text = F.col("text")

    def place(alias: str) -> Column:
        if not alias.isascii():
            return F.instr(text, alias)
        upto = F.regexp_extract(text, rf"(?s)^.*?\Q{alias}\E(?<![A-Za-z0-9]\Q{alias}\E)(?![A-Za-z0-9])", 0)
        return F.when(F.contains(text, F.lit(alias)), once(F.length(upto), lambda n: F.when(n > 0, n - len(alias) + 1)))

    def first_place(broker: str) -> Column:
        own = [F.struct(place(a).alias("at"), F.lit(-len(a)).alias("shorter"), F.lit(a).alias("alias")) for b, a in sorted(known) if b == broker]
        return F.struct(F.lit(broker).alias("broker"), F.array_min(F.filter(F.array(*own), lambda x: x["at"] > 0)).alias("first"))

    each = F.filter(F.array(*map(first_place, sorted({b for b, _ in known}))), lambda x: x["first"].isNotNull())
    if not known:
        each = F.array().cast("array<struct<broker:string,first:struct<at:int,shorter:int,alias:string>>>")
    # What is written of the text is read once for all its brokers. The outer explode is filtered after, as Spark would otherwise find the places twice.
    named = articles.select("article_id", "text", "published", each.alias("each"))
    named = named.select("*", F.when(F.size("each") > 0, F.struct("text", F.lower(text).alias("low"))).alias("t"))
    whole, low = F.col("t.text"), F.col("t.low")
    named = named.select("article_id", "text", "each", target_price(whole, low).alias("price"), rating(whole, low).alias("rated"), F.coalesce("published", stated_date(whole)).alias("dated"))
    hits = named.select("article_id", "text", "price", "rated", "dated", F.explode_outer("each").alias("h")).where("h is not null").select("article_id", "text", "price", "rated", "dated", "h.broker", "h.first.alias", "h.first.at")
    at, blank = F.col("at"), "\n\n"
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length("alias"), F.length("text"))
    paragraph = F.concat(F.substring_index(before, blank, -1), "alias", F.substring_index(after, blank, 1))
    start = F.greatest(F.lit(1), at - around)
    near = F.when(F.contains(before, F.lit(blank)) | F.contains(after, F.lit(blank)), paragraph).otherwise(F.substring(text, start, at + around - start))
    found = hits.withColumn("near", near).withColumn("flat", squeezed(F.col("near")))
    flat, near = F.col("flat"), F.col("near")
    short = F.when(F.length(flat) <= thesis, flat).otherwise(F.concat(F.trim(F.substring(flat, 1, thesis - 1)), F.lit("…")))
    return found.select(
        "article_id", "broker", "alias", F.coalesce(target_price(near), "price").alias("target_price"), F.coalesce(rating(near), "rated").alias("rating"),
        F.coalesce(stated_date(near), "dated").alias("report_date"), short.alias("thesis"),
    )


def public_view(text: Column, internal: list[str]) -> Column:
    """A memo's lines without internal ones, images and link targets."""
    own = lambda x: ~x.rlike("(?i)" + "|".join(internal))
    kept = F.array_join(F.filter(F.split(text, "\n"), own), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")


def nicknames(queries: DataFrame, blocked: list[str], particles: str) -> DataFrame:
    """Tails of related queries (company, query) that are names: not blocked, not ASCII alone, without particles."""
    tail = F.regexp_replace(F.trim(F.regexp_replace("query", F.concat(F.lit("(?i)^"), F.col("company"), F.lit(r"\s+")), F.lit(""))), f"({particles})$", "")
    fit = queries.withColumn("tail", tail).where((F.length("tail") >= 2) & ~F.lower("tail").isin(*blocked) & ~F.col("tail").rlike(r"^[\x00-\x7F]+$"))
    return fit.select("company", "tail").distinct()
