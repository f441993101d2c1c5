"""Price panels in long form, derived from the star schema or read from files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.windows import ordered, so_far


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, price, quantity) of every shipped line. Nations number 25, the one side whose size is fixed."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity")
    buyer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(
        F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))), F.col("c_nationkey") == F.col("n_nationkey")
    )
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "ticker")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "ticker", F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")
    )


def week(ts):
    return F.date_trunc("week", ts).cast("date")


def _exact(column: str):
    """A sum that does not depend on the order of its rows."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def _snapped(x, unit: float = 1e6):
    """To the nearest 1 / unit, halves upwards, in plain floating point."""
    return F.floor(x * unit + 0.5) / unit


def raw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, volume): weekly value per unit on the full nation x week spine; missing weeks are null."""
    seen = shipments(spark, sf_dir).groupBy("ticker", week(F.col("ts")).alias("date")).agg(_exact("price").alias("px"), _exact("quantity").alias("volume"))
    weeks = seen.agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("interval 7 days"))).alias("date"))
    spine = table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")).crossJoin(weeks)  # 25 x weeks
    return spine.join(seen, ["ticker", "date"], "left").select("ticker", "date", _snapped(F.try_divide("px", "volume")).alias("close"), "volume")


def index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, volume): cumulated index of demeaned log levels; positive, without gaps."""
    level = F.ln("close")
    step = F.coalesce(F.round(0.02 * (level - F.avg(level).over(Window.partitionBy("ticker"))), 10), F.lit(0.0))
    steps = raw_levels(spark, sf_dir).select("ticker", "date", "volume", step.alias("step"))
    close = F.round(100 * F.exp(F.sum("step").over(so_far("ticker"))), 6)
    return steps.select("ticker", "date", close.alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, close): hourly mean of each event type's value."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("close"))


def ohlcv(spark: SparkSession, sf_dir: str, tickers: Iterable[str] | None = None) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) per week from single lines; equal times are ordered by price."""
    rows = shipments(spark, sf_dir).withColumn("unit", _snapped(F.col("price") / F.col("quantity")))
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(list(tickers)))
    return rows.groupBy("ticker", week(F.col("ts")).alias("date")).agg(
        F.min(F.struct("ts", "unit"))["unit"].alias("open"), F.max("unit").alias("high"), F.min("unit").alias("low"),
        F.max(F.struct("ts", "unit"))["unit"].alias("close"), F.sum("quantity").alias("volume"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, ticker): region and nation names."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("grp"), F.col("n_name").alias("ticker"))


def universe_from_mapping(spark: SparkSession, groups: Mapping[str, object], prefix: str = "etf_") -> DataFrame:
    """(grp, ticker, pos) of a nested mapping: equities keep their sector, ETFs take a prefix, lists are groups."""
    flat: dict[str, list[str]] = {}
    for section, content in groups.items():
        if isinstance(content, Mapping):
            for name, tickers in content.items():
                flat[f"{prefix}{name}" if section == "etfs" else name] = list(tickers)
        else:
            flat[section] = list(content)
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("grp", T.StringType()), T.StructField("tickers", T.ArrayType(T.StringType()))])
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(flat.items())], schema)
    return rows.select("grp", F.explode("tickers").alias("ticker"), "pos")


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    """A YAML universe file, small by nature, read on the driver through Spark."""
    import yaml

    return universe_from_mapping(spark, yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect())))


def group_of(members: DataFrame, tickers: DataFrame) -> DataFrame:
    """Adds ``grp``: the first group that holds the ticker, or null."""
    pos = F.col("pos") if "pos" in members.columns else F.col("grp")
    first = members.groupBy("ticker").agg(F.min_by("grp", pos).alias("grp"))
    return tickers.join(first, "ticker", "left")


def fetch(panel: DataFrame, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None, column: str = "close") -> DataFrame:
    """(ticker, date, column) within [start, end); filters reach the scan. No rows at all is a ValueError."""
    out = panel
    if tickers is not None:
        out = out.filter(F.col("ticker").isin(list(tickers)))
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("date") < F.lit(end).cast("date"))
    out = out.select("ticker", "date", column).filter(F.col(column).isNotNull())
    if out.isEmpty():
        raise ValueError(f"no {column} of {'any ticker' if tickers is None else list(tickers)} from {start} to {end}")
    return out


BAR_JSON = "meta struct<symbol: string>, series map<string, struct<`1. open`: string, `2. high`: string, `3. low`: string, `4. close`: string, `5. adjusted close`: string, `6. volume`: string>>"


def parse_daily_json(documents: DataFrame, column: str = "body") -> DataFrame:
    """Bars from REST-shaped documents: {meta: {symbol}, series: {date: {"1. open": "...", ...}}}."""
    doc = documents.select(F.from_json(column, BAR_JSON).alias("d"))
    each = doc.select(F.col("d.meta.symbol").alias("ticker"), F.explode("d.series").alias("day", "bar"))
    names = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. adjusted close": "adj_close", "6. volume": "volume"}
    return each.select("ticker", F.to_date("day").alias("date"), *[F.col("bar").getField(k).cast("double").alias(v) for k, v in names.items()])


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)


def align(left: DataFrame, *others: DataFrame, on: str = "date") -> DataFrame:
    """Inner join of any number of series on their date, without rows that hold a null."""
    out = left
    for other in others:
        out = out.join(other, on, "inner")
    return out.dropna()


def lagged(column: str, *keys: str):
    return F.lag(column).over(ordered(*keys))
