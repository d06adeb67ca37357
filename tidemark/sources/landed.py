"""Typed readers of landed files, and the dated snapshot table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BAR = "struct<date:string,open:double,high:double,low:double,close:double,volume:double>"
CHART = f"ticker string, name string, source string, range string, interval string, currency string, exchangeName string, bars array<{BAR}>"
FILING = "struct<rcept_no:string,rcept_dt:string,corp_code:string,corp_name:string,stock_code:string,report_nm:string,flr_nm:string>"


def finite(x: str) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.col(x))


def load_bars(spark: SparkSession, path: str, chart_per_file: bool = True) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) of charts, one in a file or one in a line; bars without a close are dropped."""
    rows = spark.read.schema(CHART).json(path, multiLine=chart_per_file).select("ticker", F.inline("bars"))
    numbers = {c: finite(c) for c in ("open", "high", "low", "close", "volume")}
    return rows.withColumns(numbers).withColumn("date", F.to_date("date")).where("close is not null and date is not null")


def load_quotes(spark: SparkSession, path: str, zone: str = "Asia/Seoul") -> DataFrame:
    """Bars of payloads with parallel arrays and epoch seconds."""
    side = ", ".join(f"{c} array<double>" for c in ("open", "high", "low", "close", "volume"))
    raw = spark.read.schema(f"ticker string, timestamp array<bigint>, quote struct<{side.replace(' array', ':array')}>").json(path, multiLine=True)
    each = raw.select("ticker", F.inline(F.arrays_zip("timestamp", *(F.col(f"quote.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("timestamp"), zone))
    return each.withColumn("date", day).drop("timestamp").where("close is not null")


def load_listings(pages: DataFrame) -> DataFrame:
    """Listing rows of HTML tables (page, html), placed by the cell that is a six-digit code."""
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "&amp;", "&"), "&nbsp;|\\s+", " "))
    row = pages.select(F.explode(F.expr(r"regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1)")).alias("row"))
    cells = row.select(F.transform(F.expr(r"regexp_extract_all(row, '(?is)<td[^>]*>(.*?)</td>', 1)"), strip).alias("c"))
    at = cells.withColumn("i", F.array_position(F.transform("c", lambda x: x.rlike("^[0-9]{6}$")), True).cast("int")).where("i >= 2")
    get = lambda k: F.get("c", F.col("i") - 1 + k)
    return at.select(
        F.get("c", F.lit(0)).alias("name"), F.when(F.col("i") > 2, F.get("c", F.lit(1))).alias("market"), get(0).alias("ticker"), get(1).alias("industry"), get(2).alias("product"), F.to_date(get(3)).alias("listed"), get(4).alias("closing_month")
    )


def load_filings(spark: SparkSession, path: str, page_per_file: bool = True) -> DataFrame:
    """Filing pages, one in a file or one in a line; status 013 means no rows; the first row of each receipt number by file and place stays."""
    raw = spark.read.schema(f"status string, list array<{FILING}>").json(path, multiLine=page_per_file).withColumn("file", F.input_file_name())
    rows = raw.where("status <> '013'").select("file", F.posexplode("list").alias("seq", "r")).select("file", "seq", "r.*")
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("rcept_no").orderBy("file", "seq"))).where("k = 1")
    return first.drop("k", "file", "seq").withColumn("filed", F.to_date("rcept_dt", "yyyyMMdd"))


def load_corp_codes(spark: SparkSession, path: str) -> DataFrame:
    """Stock code to company of the master file; blank codes are dropped, of equal ones the last by change date stays."""
    raw = spark.read.format("xml").option("rowTag", "list").schema("corp_code string, corp_name string, stock_code string, modify_date string").load(path)
    rows = raw.withColumn("stock_code", F.trim("stock_code")).where("stock_code <> ''")
    order = W.partitionBy("stock_code").orderBy(F.desc("modify_date"), F.desc("corp_code"))
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def load_rss(spark: SparkSession, path: str) -> DataFrame:
    """Feed items with a title and a link (or a guid that is one)."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, description string, pubDate string, source string").load(path)
    url = F.when(F.col("link").rlike("^https?://"), F.col("link")).when(F.col("guid").rlike("^https?://"), F.col("guid"))
    day = F.to_date(F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4})", 1), F.lit("d MMM yyyy")))
    return raw.select(F.trim("title").alias("headline"), url.alias("url"), "source", "description", "pubDate", day.alias("published")).where("headline <> '' and url is not null")


def load_dimensions(spark: SparkSession, path: str, schema: str, need: dict[str, str], one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a JSON dimension, an array in a file or a row in a line, by patterns that columns must match."""
    rows = spark.read.schema(schema).json(path, multiLine=one_per_file)
    ok = F.lit(True)
    for c, pattern in need.items():
        ok = ok & F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def write_snapshot(df: DataFrame, path: str, as_of: str) -> None:
    """Replaces the partition of one day, and no other."""
    df.withColumn("as_of", F.lit(as_of).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


#: Fixed formats: endpoint name to the columns its rows have besides the keys.
ENDPOINTS = {
    "shareholders": ["nm", "relate", "bsis_posesn_stock_co", "trmend_posesn_stock_co", "trmend_posesn_stock_qota_rt"],
    "dividends": ["se", "thstrm", "frmtrm", "lwfr"],
    "treasury": ["acqs_mth1", "stock_knd", "bsis_qy", "trmend_qy"],
    "capital_changes": ["isu_dcrs_de", "isu_dcrs_stle", "isu_dcrs_qy"],
    "board": ["nm", "ofcps", "rgist_exctv_at", "fte_at"],
    "accounts": ["fs_div", "sj_div", "account_nm", "thstrm_amount", "frmtrm_amount", "bfefrmtrm_amount"],
}
ENDPOINT_KEYS = ["corp_code", "bsns_year", "reprt_code"]


def load_filing_endpoints(spark: SparkSession, path: str, page_per_file: bool = True) -> dict[str, DataFrame]:
    """A table for each endpoint folder; accounts are of the consolidated statement where there is one."""
    found = {}
    for name, columns in ENDPOINTS.items():
        row = ",".join(f"{c}:string" for c in (*ENDPOINT_KEYS, *columns))
        raw = spark.read.schema(f"status string, list array<struct<{row}>>").json(f"{path}/{name}", multiLine=page_per_file)
        found[name] = raw.where("status = '000'").select(F.inline("list"))
    order = F.when(F.col("fs_div") == "CFS", 0).otherwise(1)
    best = F.min(order).over(W.partitionBy(*ENDPOINT_KEYS))
    found["accounts"] = found["accounts"].withColumn("__best", best).where(order == F.col("__best")).drop("__best")
    return found
