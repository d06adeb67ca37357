"""Column functions for text, dates, addresses, keys and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.filings import BLANK, trimmed

_WORD = "[0-9A-Za-z_]"
# Fixed patterns of the date phrases.
ISO = rf"(?<!{_WORD})(20\d{{2}})[-.](\d{{1,2}})[-.](\d{{1,2}})(?!{_WORD})"
MONTH_DAY = rf"(?<!{_WORD})(\d{{1,2}})\.(\d{{1,2}})\.(?={_WORD})"
NOW, YESTERDAY, DAYS_AGO = r"오늘|방금|분\s*전|시간\s*전", r"어제|1일\s*전|하루\s*전", r"(\d+)\s*일\s*전"
LONG_DATE = r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
LOOSE_DATE = rf"(?<!{_WORD})(20\d{{2}})[-/.]\s*(\d{{1,2}})[-/.]\s*(\d{{1,2}})(?!{_WORD})"


def squeezed(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, f"{BLANK}+", " "))


def decoded(x: Column) -> Column:
    """Text without character data marks and with the five entities and the numbered ones of the lower range as characters.

    Numbered entities are replaced one kind at a time, as many as a text has different ones.
    """
    x = F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    codes = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#([0-9]+|[xX][0-9A-Fa-f]+);"), F.lit(1)))
    number = lambda c: F.when(F.lower(c).startswith("x"), F.conv(F.substring(c, 2, 8), 16, 10)).otherwise(c).try_cast("int")
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(number(c)), 8, "0")), "UTF-32")
    known = F.filter(codes, lambda c: number(c).between(1, 0xD7FF) | number(c).between(0xE000, 0x10FFFF))
    x = F.aggregate(known, x, lambda s, c: F.replace(s, F.concat(F.lit("&#"), c, F.lit(";")), char(c)))
    for name, to in (("quot", '"'), ("apos", "'"), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(to))
    return x


def _date(text: Column, pattern: str) -> Column:
    part = lambda g: F.regexp_extract(text, pattern, g)
    return F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")


def news_date(text: Column, as_of: Column) -> Column:
    """The day an item names, by its own clock: a date, month and day of the clock's year, today or hours ago, yesterday, days ago; null for no such day."""
    x = squeezed(text)
    month_day = F.concat_ws("-", F.year(as_of).cast("string"), F.lpad(F.regexp_extract(x, MONTH_DAY, 1), 2, "0"), F.lpad(F.regexp_extract(x, MONTH_DAY, 2), 2, "0")).try_cast("date")
    ago = F.regexp_extract(x, DAYS_AGO, 1).try_cast("int")
    return (
        F.when(x.rlike(ISO), _date(x, ISO)).when(x.rlike(MONTH_DAY), month_day).when(x.rlike(NOW), as_of).when(x.rlike(YESTERDAY), F.date_sub(as_of, 1)).when(ago.isNotNull(), F.date_sub(as_of, ago))
    )


def feed_date(text: Column, as_of: Column, zone: str = "Asia/Seoul") -> Column:
    """news_date, or the day in a zone of a feed's full time stamp."""
    x = squeezed(decoded(text))
    stamp = F.regexp_replace(F.regexp_replace(x, "^[A-Za-z]{3}, *", ""), " (?:GMT|UTC|Z)$", " +0000")
    at = F.coalesce(F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm Z")))
    here = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone))
    return F.coalesce(news_date(x, as_of), here)


def report_date(text: Column, article: Column) -> Column:
    """The first date of a text, written out or with separators, else that of its article."""
    return F.coalesce(F.when(text.rlike(LONG_DATE), _date(text, LONG_DATE)).when(text.rlike(LOOSE_DATE), _date(text, LOOSE_DATE)), article)


def compact_date(text: Column) -> Column:
    """A date of eight digits."""
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("date"))


def mobile_address(url: Column, host: str) -> Column:
    """A post's address on the mobile site, from its path or its parameters; any other address as it is."""
    x, at = trimmed(url), host.replace(".", r"\.")
    path = rf"^https?://(?:m\.)?{at}/([A-Za-z0-9_-]+)/(\d{{6,}})"
    view = rf"^https?://(?:m\.)?{at}/PostView\.naver\?[^#]*\bblogId=([A-Za-z0-9_-]+)[^#]*\blogNo=(\d{{6,}})"
    made = lambda p: F.concat(F.lit(f"https://m.{host}/"), F.regexp_extract(x, p, 1), F.lit("/"), F.regexp_extract(x, p, 2))
    return F.when(x.rlike(path), made(path)).when(x.rlike(view), made(view)).otherwise(x)


def named_paths(text: Column, host: str, reserved: list[str], own: Column) -> Column:
    """The distinct first path parts of a host's addresses in a text, in order, without reserved ones and the text's own."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(host.replace(".", r"\.") + "/([A-Za-z0-9_-]+)"), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(*reserved) & ~x.eqNullSafe(own))


def ticker_of(urls: Column) -> Column:
    """The ticker that the first address to name one names: a code parameter, or a chart's symbol."""
    code = lambda u: F.nullif(F.regexp_extract(u, r"(?i)[?&]code=(\d{6})\b", 1), F.lit(""))
    symbol = lambda u: F.upper(F.nullif(F.regexp_extract(u, r"(?i)/chart/([0-9]{6}\.(?:KS|KQ))\b", 1), F.lit("")))
    return F.get(F.filter(F.transform(urls, lambda u: F.coalesce(code(u), symbol(u))), lambda t: t.isNotNull()), F.lit(0))


def short_key(x: Column, length: int) -> Column:
    """The first hex digits of the text's SHA-1."""
    return F.substring(F.sha1(x), 1, length)


def settled(x: Column) -> Column:
    """Text with plain line ends, no blanks before them, one empty line at most, and trimmed."""
    x = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?m)[ \t]+$", ""), "\n{3,}", "\n\n")
    return trimmed(x)


def content_key(title: Column, body: Column, images: Column) -> Column:
    """SHA-256 of a post's settled title and body and its number of images: equal for posts that read the same."""
    return F.sha2(F.to_json(F.struct(settled(title).alias("title"), settled(body).alias("body"), images.cast("long").alias("imageCount"))), 256)


def _shown(x: Column, text: Column, none: str) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), none).otherwise(text)


def thousands(x: Column, none: str = "N/A") -> Column:
    return _shown(x, F.format_number(F.floor(x + 0.5), 0), none)


def percent(share: Column, digits: int = 1, none: str = "-") -> Column:
    """A share as a percentage."""
    return _shown(share, F.concat(F.replace(F.format_number(share * 100, digits), F.lit(","), F.lit("")), F.lit("%")), none)


def signed_percent(x: Column, digits: int = 1, none: str = "N/A") -> Column:
    """A percentage with its sign, that of zero a plus."""
    return _shown(x, F.concat(F.when(x >= 0, "+").otherwise("−"), F.replace(F.format_number(F.abs(x), digits), F.lit(","), F.lit("")), F.lit("%")), none)


def signed_amount(x: Column, none: str = "N/A") -> Column:
    return _shown(x, F.concat(F.when(x >= 0, "+").otherwise("−"), F.format_number(F.abs(F.floor(x + 0.5)), 0)), none)


def ratio(x: Column, digits: int = 2, none: str = "-") -> Column:
    return _shown(x, F.concat(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")), F.lit("x")), none)


def price(x: Column, currency: Column, none: str = "—") -> Column:
    """Dollars with cents, any other currency as whole won."""
    dollars = F.concat(F.lit("$"), F.replace(F.format_number(x, 2), F.lit(","), F.lit("")))
    return _shown(x, F.when(currency.eqNullSafe(F.lit("USD")), dollars).otherwise(F.concat(F.lit("₩"), thousands(x))), none)
