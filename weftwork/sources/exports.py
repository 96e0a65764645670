"""CSV exports of known services: recognised by their header, reduced by groups; any other CSV by column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators import stats

# format -> columns it must have; the first that fits holds.
HEADERS = {
    "linkedin_connections": ["first name", "last name", "company", "position"], "linkedin_messages": ["from", "to", "date", "subject"], "netflix_history": ["title", "date"],
    "spotify_streaming": ["ts", "master_metadata_track_name", "master_metadata_album_artist_name"], "spotify_simple": ["endtime", "artistname", "trackname"], "amazon_orders": ["order date", "order id", "title"],
    "bank_statement": ["date", "description", "amount"], "paypal_history": ["date", "name", "type", "status", "gross"], "fitbit_sleep": ["start time", "end time", "minutes asleep"], "myfitnesspal": ["date", "calories"],
    "uber_trips": ["city", "request time", "dropoff time", "fare amount"], "apple_health": ["type", "sourcename", "value", "startdate"],
}


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A CSV file with lower-case column names; the delimiter is the most frequent of , ; tab | in the header line."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).first()
        line = first[0] if first else ""
        delimiter = max(",;\t|", key=line.count)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter).csv(path)
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def format_of(columns: list[str]) -> str | None:
    have = {c.strip().lower() for c in columns}
    return next((name for name, need in HEADERS.items() if have.issuperset(need)), None)


def money(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"[$, €£]", "").try_cast("double")


def _rows(metric: str, table: DataFrame, value: str = "value", n: str = "n") -> DataFrame:
    return table.select(F.lit(metric).alias("metric"), F.col(value).cast("string").alias("value"), F.col(n).cast("double").alias("n"))


def _totals(df: DataFrame, **totals: Column) -> DataFrame:
    one = df.agg(*[c.cast("double").alias(k) for k, c in totals.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit("").alias("value"), F.col(k).alias("n")) for k in totals])).alias("t")).select("t.*")


def summarise(df: DataFrame, kind: str | None = None) -> DataFrame:
    """(metric, value, n): the aggregates of a known export, or the column profile of any other table."""
    kind = kind or format_of(df.columns)
    c = F.col
    top = lambda column, k, name: _rows(name, stats.top_values(df, column, k))
    total = F.count("*")
    if kind == "linkedin_connections":
        return _totals(df, rows=total).unionByName(top(c("company"), 15, "company")).unionByName(top(c("position"), 15, "position"))
    if kind == "linkedin_messages":
        return _totals(df, rows=total).unionByName(top(F.array_join(F.array_sort(F.array("from", "to")), " - "), 10, "pair"))
    if kind == "netflix_history":
        show = F.split("title", ":")[0]
        return _totals(df, rows=total, titles=F.count_distinct("title"), shows=F.count_distinct(show)).unionByName(top(show, 15, "show"))
    if kind in ("spotify_streaming", "spotify_simple"):
        artist, track, ms = ("master_metadata_album_artist_name", "master_metadata_track_name", "ms_played") if kind == "spotify_streaming" else ("artistname", "trackname", "msplayed")
        hours = F.sum(c(ms).try_cast("double")) / 3_600_000 if ms in df.columns else F.lit(None)
        return _totals(df, rows=total, artists=F.count_distinct(artist), tracks=F.count_distinct(track), hours=hours).unionByName(top(c(artist), 15, "artist")).unionByName(top(c(track), 15, "track"))
    if kind == "amazon_orders":
        return _totals(df, rows=total, orders=F.count_distinct("order id"))
    if kind in ("bank_statement", "paypal_history"):
        amount, name = (money(c("amount")), "description") if kind == "bank_statement" else (money(c("gross")), "name")
        spent = df.where(amount < 0).groupBy(F.substring(name, 1, 30).alias("value")).agg(F.sum(-amount).alias("n")).orderBy(F.desc("n"), "value").limit(15)
        return _totals(df, rows=total, income=F.sum(F.when(amount > 0, amount)), expense=F.sum(F.when(amount < 0, -amount)), net=F.sum(amount)).unionByName(_rows("expense by name", spent))
    if kind == "fitbit_sleep":
        asleep = c("minutes asleep").try_cast("double")
        return _totals(df, rows=total, minutes=F.sum(asleep), mean_minutes=F.avg(asleep))
    if kind == "myfitnesspal":
        return _totals(df, rows=total, calories=F.sum(money(c("calories"))), mean_calories=F.avg(money(c("calories"))))
    if kind == "uber_trips":
        return _totals(df, rows=total, fares=F.sum(money(c("fare amount")))).unionByName(top(c("city"), 15, "city"))
    if kind == "apple_health":
        return _totals(df, rows=total).unionByName(top(c("type"), 15, "type"))
    profile = stats.column_profile(df)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("n")) for m in ("rows", "non_empty", "distinct_values", "numeric", "dates")])).alias("p")
    return profile.select(c("column").alias("value"), cells).select("p.metric", "value", "p.n")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """(type, source, unit, value, start_at, end_at) of a health export; the file is split by record."""
    rows = spark.read.format("xml").option("rowTag", "Record").schema("_type string, _sourceName string, _unit string, _value string, _startDate string, _endDate string").load(path)
    at = lambda column: F.coalesce(F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss")))
    name = F.regexp_replace("_type", "^HK(Quantity|Category)TypeIdentifier", "")
    return rows.select(name.alias("type"), F.col("_sourceName").alias("source"), F.col("_unit").alias("unit"), F.col("_value").try_cast("double").alias("value"), at("_startDate").alias("start_at"), at("_endDate").alias("end_at"))


def xml_counts(spark: SparkSession, path: str, tag: str, by: str) -> DataFrame:
    """(value, n): how often each value of an attribute ``by`` of elements ``tag`` occurs."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(f"`_{by}` string").load(path)
    return rows.groupBy(F.col(f"_{by}").alias("value")).agg(F.count("*").alias("n"))
