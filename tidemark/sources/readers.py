"""Scans: records, text files, JSON lines, event tables, inventories, landing files of providers, reports, samples."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import canonical_ticker, padded_cik, squeeze

SEGMENTS = "array<struct<speaker:string,text:string>>"
RECORD_FIELDS = ("record_key", "source_id", "source_file", "source_row", "ticker", "event_date", "company", "year", "quarter", "transcript", "structured_content")


@dataclass(frozen=True)
class Source:
    """A registered corpus: its layout, files, and which of their fields stand for ours."""

    source_id: str
    layout: str  # parquet, text or jsonl
    pattern: str
    fields: dict[str, str] = field(default_factory=dict)
    priority: int = 0


def resolve(registry: dict[str, Source], ids: list[str] | None) -> list[Source]:
    """The named sources, all without names; an unknown name is an error."""
    if unknown := [i for i in ids or [] if i not in registry]:
        raise ValueError(f"unknown sources: {unknown}")
    return [registry[i] for i in ids] if ids else list(registry.values())


def _file(c: str = "_metadata.file_path") -> Column:
    return F.element_at(F.split(F.col(c), "/"), -1)


def parse_segments(c: Column, kind: T.DataType) -> Column:
    """Segments out of a list, or of JSON (also JSON in a JSON string); anything else is an empty list."""
    if isinstance(kind, T.StringType):
        once = F.from_json(c, SEGMENTS)
        twice = F.from_json(F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "struct<v:string>")["v"], SEGMENTS)
        return F.coalesce(F.when(F.size(once) > 0, once), twice, F.array().cast(SEGMENTS))
    return F.coalesce(c.cast(SEGMENTS), F.array().cast(SEGMENTS))


def read_parquet_source(spark: SparkSession, root: str, s: Source) -> DataFrame:
    """Only the mapped columns are read; rows are numbered within their file by the reader."""
    raw = spark.read.parquet(f"{root}/{s.pattern}")
    take = lambda name: F.col(s.fields[name]) if s.fields.get(name) in raw.columns else F.lit(None)
    seg = s.fields.get("structured_content")
    out = raw.select(
        F.lit(s.source_id).alias("source_id"), _file().alias("source_file"), F.col("_metadata.row_index").alias("source_row"), *[take(c).cast("string").alias(c) for c in ("ticker", "event_date", "company")],
        *[take(c).cast("int").alias(c) for c in ("year", "quarter")], take("transcript").cast("string").alias("transcript"),
        (parse_segments(F.col(seg), raw.schema[seg].dataType) if seg in raw.columns else F.array().cast(SEGMENTS)).alias("structured_content"),
    )
    return _keyed(out)


def read_text_source(spark: SparkSession, root: str, s: Source) -> DataFrame:
    """One record per file; the folder names the ticker, the file name starts with the date."""
    raw = spark.read.text(f"{root}/{s.pattern}", wholetext=True)
    path = F.col("_metadata.file_path")
    return _keyed(raw.select(
        F.lit(s.source_id).alias("source_id"), _file().alias("source_file"), F.lit(0).cast("bigint").alias("source_row"), F.element_at(F.split(path, "/"), -2).alias("ticker"), F.nullif(F.regexp_extract(_file(), r"^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("")).alias("event_date"),
        F.lit(None).cast("string").alias("company"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("quarter"), F.col("value").alias("transcript"), F.array().cast(SEGMENTS).alias("structured_content"),
    ))


def read_jsonl_source(spark: SparkSession, root: str, s: Source) -> DataFrame:
    """One record per line; blank and broken lines are skipped. A field may name several aliases, parted by ``|``:
    the first that is not blank counts. Without a transcript, questions and answers are joined in turn."""
    lines = spark.read.text(f"{root}/{s.pattern}").where(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("v"), _file().alias("source_file"), F.monotonically_increasing_id().alias("source_row"))
    lines = lines.where("v is not null and size(v) > 0")
    take = lambda name: F.coalesce(*[F.nullif(F.trim(F.col("v")[a]), F.lit("")) for a in s.fields.get(name, name).split("|")])
    q, a = F.from_json(F.col("v")[s.fields.get("questions", "questions")], "array<string>"), F.from_json(F.col("v")[s.fields.get("answers", "answers")], "array<string>")
    joined = F.concat_ws("\n", F.flatten(F.transform(F.arrays_zip(q.alias("q"), a.alias("a")), lambda x: F.array_compact(F.array(x["q"], x["a"])))))
    return _keyed(lines.select(
        F.lit(s.source_id).alias("source_id"), "source_file", "source_row", *[take(c).alias(c) for c in ("ticker", "event_date", "company")], *[take(c).try_cast("int").alias(c) for c in ("year", "quarter")],
        F.coalesce(take("transcript"), F.nullif(joined, F.lit(""))).alias("transcript"), F.coalesce(F.from_json(F.col("v")[s.fields.get("structured_content", "structured_content")], SEGMENTS), F.array().cast(SEGMENTS)).alias("structured_content"),
    ))


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(":", "source_id", "source_file", "source_row").alias("record_key"), *RECORD_FIELDS[1:])


READERS = {"parquet": read_parquet_source, "text": read_text_source, "jsonl": read_jsonl_source}


def read_sources(spark: SparkSession, root: str, registry: dict[str, Source], ids: list[str] | None = None) -> DataFrame:
    """The union of the resolved sources in one record schema."""
    parts = [READERS[s.layout](spark, root, s) for s in resolve(registry, ids)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def inventory(spark: SparkSession, root: str, known: list[str]) -> DataFrame:
    """(source_id, file, file_type, bytes) below the folders of known sources, hidden files left out, contents unread."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rest = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    out = f.select(F.get(rest, F.lit(0)).alias("source_id"), F.element_at(rest, -1).alias("file"), F.lower(F.element_at(F.split(F.element_at(rest, -1), r"\."), -1)).alias("file_type"), F.col("length").alias("bytes"))
    return out.where(F.col("source_id").isin(known) & ~F.col("file").startswith("."))


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, ticker, event_date, cik) of calls from CSV or Parquet, exact repeats dropped.

    ``record_key`` may stand for ``call_id``, ``universe_cik`` for ``cik``; rows without a ticker or date are left out.
    """
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    if "call_id" not in df.columns and "record_key" in df.columns:
        df = df.withColumnRenamed("record_key", "call_id")
    if missing := {"call_id", "ticker", "event_date"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    number = next((F.col(c) for c in ("universe_cik", "cik") if c in df.columns), F.lit(None)).cast("string")
    out = df.select("call_id", canonical_ticker(F.col("ticker")).alias("ticker"), F.col("event_date").try_cast("date").alias("event_date"), padded_cik(number).alias("cik"))
    return out.where("ticker is not null and event_date is not null").distinct()


def rows_at(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records at (source_file, source_row) of ``wanted``, whole."""
    return records.join(wanted.select("source_file", "source_row").distinct(), ["source_file", "source_row"], "left_semi")


FACT_UNITS = "map<string,array<struct<start:string,`end`:string,val:double,filed:string,form:string,fy:int,fp:string,frame:string,accn:string>>>"


def parse_company_facts(landed: DataFrame, payload: str = "value") -> DataFrame:
    """Facts out of landed JSON (facts, taxonomy, concept, units, rows): one row each; broken payloads give none."""
    f = landed.select(F.from_json(payload, f"struct<cik:string,facts:map<string,map<string,struct<units:{FACT_UNITS}>>>>").alias("p"))
    t = f.select(F.col("p.cik").alias("cik"), F.explode("p.facts").alias("taxonomy", "c")).select("cik", "taxonomy", F.explode("c").alias("concept", "u"))
    r = t.select("cik", "taxonomy", "concept", F.explode("u.units").alias("unit", "l")).select("cik", "taxonomy", "concept", "unit", F.explode("l").alias("x"))
    return r.select("cik", "taxonomy", "concept", "unit", F.col("x.val").alias("fact_value"), *[F.col(f"x.{a}").try_cast("date").alias(b) for a, b in (("start", "period_start"), ("end", "period_end"), ("filed", "filed_date"))], "x.form", "x.fy", "x.fp", "x.frame", "x.accn")


def parse_estimates(landed: DataFrame, ticker: str, payload: str = "value", provider: str = "provider") -> DataFrame:
    """Provider rows (date, epsActual, epsEstimated, revenueActual, revenueEstimated) in standard columns."""
    rows = F.from_json(payload, "array<struct<date:string,epsActual:double,epsEstimated:double,revenueActual:double,revenueEstimated:double>>")
    x = landed.select(F.explode(rows).alias("x"))
    return x.select(F.lit(ticker).alias("ticker"), F.col("x.date").try_cast("date").alias("source_event_date"), F.col("x.epsActual").alias("reported_eps"), F.col("x.epsEstimated").alias("estimated_eps"), F.col("x.revenueActual").alias("reported_revenue"), F.col("x.revenueEstimated").alias("estimated_revenue"), F.lit(provider).alias("provider")).where("source_event_date is not null")


def parse_surprise_percent(rows: DataFrame) -> DataFrame:
    """Earnings frames with a surprise in percent: as a share, the date as a day."""
    return rows.withColumns({"surprise": F.col("surprise_percent").try_cast("double") / 100, "source_event_date": F.to_date("earnings_date")})


def parse_chart(landed: DataFrame, payload: str = "value") -> DataFrame:
    """(ticker, trade_date, close_price) out of chart JSON: adjusted close, else close; seconds in UTC are days."""
    kind = "struct<chart:struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>>"
    r = landed.select(F.explode(F.from_json(payload, kind)["chart"]["result"]).alias("r"))
    z = F.arrays_zip(F.col("r.timestamp").alias("t"), F.get(F.col("r.indicators.adjclose.adjclose"), F.lit(0)).alias("a"), F.get(F.col("r.indicators.quote.close"), F.lit(0)).alias("c"))
    x = r.select(F.col("r.meta.symbol").alias("ticker"), F.explode(z).alias("x"))
    return x.select(canonical_ticker(F.col("ticker")).alias("ticker"), F.to_date(F.timestamp_seconds(F.col("x").getField("t"))).alias("trade_date"), F.coalesce(F.col("x").getField("a"), F.col("x").getField("c")).alias("close_price")).where("close_price is not null")


def parse_splits(rows: DataFrame) -> DataFrame:
    """(ticker, split_date, factor) from numerator and denominator; zero or null denominators give none."""
    return rows.select("ticker", "split_date", F.try_divide(F.col("numerator").try_cast("double"), F.col("denominator").try_cast("double")).alias("factor")).where("factor is not null")


def frozen_universe(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    if "ticker" not in df.columns:
        raise ValueError("a universe needs a ticker column")
    out = df.withColumn("ticker", canonical_ticker(F.col("ticker")))
    return out.withColumn("market_cap_usd", F.col("market_cap_usd").try_cast("double")) if "market_cap_usd" in df.columns else out


def price_window(closes: DataFrame, events: DataFrame, before: int = 40, after: int = 60) -> tuple[DataFrame, DataFrame]:
    """(closes within the events' range, tickers of events without any close)."""
    span = events.agg(F.date_sub(F.min("event_date"), before).alias("a"), F.date_add(F.max("event_date"), after).alias("z"))
    inside = closes.crossJoin(F.broadcast(span)).where("trade_date between a and z").drop("a", "z")
    return inside, events.select("ticker").distinct().join(inside, "ticker", "left_anti")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(section, row, name, value, lower, upper) of the tables in Markdown reports: ``v [lo, hi]`` cells are split."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("row", "line")).where(F.col("line").rlike(r"^\|") & ~F.col("line").rlike(r"^\|[\s:|-]+$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda x: squeeze(x))
    c = t.select("row", F.get(cells, F.lit(0)).alias("name"), F.posexplode(F.slice(cells, 2, 1000)).alias("section", "cell"))
    num = r"(-?\d+(?:\.\d+)?)"
    return c.select("section", "row", "name", F.regexp_extract("cell", rf"^{num}", 1).try_cast("double").alias("value"), F.regexp_extract("cell", rf"\[{num},", 1).try_cast("double").alias("lower"), F.regexp_extract("cell", rf",\s*{num}\]", 1).try_cast("double").alias("upper"))


def sample_prices(spark: SparkSession, tickers: list[str], first: date, last: date, seed: int = 7) -> DataFrame:
    """(ticker, trade_date, return): seeded normal returns on business days, for trying things out."""
    t = spark.createDataFrame([(x,) for x in tickers], "ticker string")
    d = t.select("ticker", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("trade_date")).where(F.weekday("trade_date") < 5)
    u = lambda k: (F.pmod(F.xxhash64("ticker", "trade_date", F.lit(seed + k)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    return d.withColumn("return", F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * F.pi() * u(1)) * 0.02)


def optional(df: DataFrame, column: str, kind: str, default=None) -> Column:
    """A column as ``kind``, or the default where it is absent, null or (for text) blank."""
    if column not in df.columns:
        return F.lit(default).cast(kind)
    c = F.col(column).try_cast(kind)
    c = F.nullif(F.trim(c), F.lit("")) if kind == "string" else c
    return F.coalesce(c, F.lit(default).cast(kind)) if default is not None else c


