"""Filing queries: index arrays to rows, filters, company lookup, missing periods, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from .arrays import unnest
from .joins import left_join_spreading_nulls, null_safe_join
from .ordered import first_rows


def filing_rows(index: DataFrame, recent: str, *keep: str) -> DataFrame:
    """One row per filing from a record of parallel arrays; absent optional arrays give null and ''."""
    a = lambda name: F.col(f"{recent}.{name}")
    zipped = F.arrays_zip(
        a("form"), a("filingDate"), a("accessionNumber"), a("primaryDocument"),
        F.coalesce(a("fileNumber"), F.array().cast("array<string>")),
        F.coalesce(a("description"), F.array().cast("array<string>")),
    )
    names = ("form_type", "filing_date", "accession_number", "primary_document", "file_number", "description")
    shape = "array<struct<" + ", ".join(f"{n} string" for n in names) + ">>"
    rows = unnest(index, [*keep, a("description").isNull().alias("plain")], zipped.cast(shape), "position", "f")
    columns = [F.col(f"f.{n}").alias(n) for n in names[:-1]]
    return with_period(
        rows.select(*keep, *columns, F.when(F.col("plain"), "").otherwise(F.col("f.description")).alias("description"))
    )


def with_period(filings: DataFrame, date: str = "filing_date") -> DataFrame:
    day = F.to_date(date)
    return filings.withColumn("year", F.year(day)).withColumn("quarter", F.quarter(day))


def wanted(
    types: list[str],
    start: str | None = None,
    end: str | None = None,
    years: list[int] | None = None,
    quarters: list[int] | None = None,
    by_year: str = "10-K",
    by_quarter: str = "8-K",
) -> Column:
    """One predicate: type listed; annual type by year; current type by year and quarter; date bounds for all."""
    keep = F.col("form_type").isin(*types)
    if years:
        keep &= ~F.col("form_type").isin(by_year, by_quarter) | F.col("year").isin(*years)
    if quarters:
        keep &= (F.col("form_type") != by_quarter) | F.col("quarter").isin(*quarters)
    if start:
        keep &= F.col("filing_date") >= start
    if end:
        keep &= F.col("filing_date") <= end
    return keep


def ticker_rows(tickers: DataFrame, column: str) -> DataFrame:
    """Ticker dimension from JSON text ``{n: {cik_str, ticker, title}}``: upper-case ticker, ten-digit id."""
    entry = F.from_json(column, "map<string, struct<cik_str string, ticker string, title string>>")
    rows = tickers.select(F.explode(entry).alias("n", "t"))
    return rows.select(F.upper("t.ticker").alias("ticker"), values.zero_pad(F.col("t.cik_str")).alias("cik"))


def find_companies(requested: DataFrame, tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """Company id by ticker, else the ticker itself as an id; no company gives a row with an error."""
    mapped = requested.withColumn("__t", F.upper("ticker")).join(
        tickers.select(F.col("ticker").alias("__t"), F.col("cik").alias("__cik")), "__t", "left"
    )
    known = companies.select("cik", "company_name")
    direct = known.select(F.col("cik").alias("__direct"), F.col("company_name").alias("__direct_name"))
    by_map = known.select(F.col("cik").alias("__cik"), F.col("company_name").alias("__name"))
    both = left_join_spreading_nulls(mapped, by_map, "__cik").withColumn("__direct", values.zero_pad(F.col("ticker")))
    both = both.join(direct, "__direct", "left")
    missing = F.col("__name").isNull() & F.col("__direct_name").isNull()
    return both.select(
        "ticker",
        F.when(F.col("__name").isNotNull(), F.col("__cik")).when(~missing, F.col("__direct")).alias("cik"),
        F.coalesce("__name", "__direct_name").alias("company_name"),
        F.when(missing, F.concat(F.lit("Could not find company info for ticker "), F.col("ticker"))).alias("error"),
    )


def period_grid(spark, years: list[int], quarters: list[int]) -> DataFrame:
    """All requested (year, quarter) pairs, from the two short request lists."""
    row = spark.range(1).select(
        F.explode(F.array(*[F.lit(y) for y in years])).alias("year"), F.array(*[F.lit(q) for q in quarters]).alias("qs")
    )
    return row.select("year", F.explode("qs").alias("quarter"))


def missing_periods(
    filings: DataFrame, entity: list[str], form: str, years: list[int], quarters: list[int] | None = None, requested: DataFrame | None = None
) -> DataFrame:
    """Requested periods an entity has no filing for.

    Found periods become a bit mask per entity (a partial aggregate), so nothing is crossed. With ``requested``, a table
    of entities, exactly these are told about: one without any filing lacks every period.
    """
    want = [(y, q) for y in years for q in quarters] if quarters else [(y, None) for y in years]
    own = F.col("form_type") == form
    hit = lambda y, q: own & (F.col("year") == y) & (F.lit(True) if q is None else F.col("quarter") == q)
    grouped = filings.groupBy(*entity).agg(*[F.max(hit(y, q).cast("int")).alias(f"w{i}") for i, (y, q) in enumerate(want)])
    if requested is not None:
        grouped = null_safe_join(requested.select(*entity).distinct(), grouped, entity, "left")
    entries = F.array(
        *[
            F.when(
                F.coalesce(F.col(f"w{i}"), F.lit(0)) == 0,
                F.struct(F.lit(y).alias("year"), F.lit(q).cast("int").alias("quarter")),
            )
            for i, (y, q) in enumerate(want)
        ]
    )
    return grouped.select(*entity, F.explode(F.array_compact(entries)).alias("m")).select(*entity, "m.year", "m.quarter")


def absent_from(requested: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys without a match, for request tables too long for ``missing_periods``."""
    return requested.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def missing_message(form: str, name: Column) -> Column:
    year = F.col("year").cast("string")
    return F.when(
        F.col("quarter").isNull(), F.concat(F.lit(f"{form} for year "), year, F.lit(" not available for "), name)
    ).otherwise(
        F.concat(F.lit(f"{form} for "), name, F.lit(" in "), year, F.lit(" Q"), F.col("quarter").cast("string"),
                 F.lit(" not available"))
    )


def entity_report(filings: DataFrame, entity: list[str], downloaded: str, latest: int = 3) -> DataFrame:
    """Counts, success rate and the most recent filings (one text) per entity."""
    counts = filings.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("filing_count"), F.count_if(F.col(downloaded)).alias("download_count")
    )
    recent = first_rows(filings, entity, [F.desc("filing_date"), F.col("accession_number")], latest)
    line = F.concat(
        F.col("form_type"), F.lit(" - "), F.col("filing_date"), F.lit(" (Year: "), F.col("year").cast("string"),
        F.lit(", Q"), F.col("quarter").cast("string"), F.lit(")"),
    )
    listed = recent.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    texts = listed.select(*entity, F.array_join(F.transform("l", lambda e: e["line"]), "; ").alias("recent_filings"))
    return null_safe_join(counts, texts, entity).withColumn(
        "success_rate", values.percent(F.col("download_count"), F.col("filing_count"))
    )


def run_summary(status: DataFrame) -> DataFrame:
    """Totals of a run from one row per requested entity: ``found, filings, downloads, errors``."""
    return status.agg(
        F.count(F.lit(1)).alias("total_tickers"), F.count_if("found").alias("processed_tickers"),
        F.sum("filings").alias("total_filings"), F.sum("downloads").alias("downloaded_filings"),
        F.sum("errors").alias("errors"),
    )


def types_with_samples(filings: DataFrame, n: int = 3) -> DataFrame:
    """Filings per type with the first ``n`` as samples."""
    counts = filings.groupBy("form_type").agg(F.count(F.lit(1)).alias("filings"))
    sample = first_rows(filings, ["form_type"], [F.desc("filing_date"), F.col("accession_number")], n)
    return sample.select("form_type", "rank", "filing_date", "accession_number").join(counts, "form_type")