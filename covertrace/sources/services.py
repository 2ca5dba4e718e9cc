"""News services over HTTP as Python data sources, with the transport handed in (there is none by default)."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records per call of the first service (a call that gives as many may have lost some), stories per query of the second.
CALL_LIMIT, STORY_LIMIT = 250, 1000

# Country names of the first service to ISO codes; others stay unknown.
COUNTRIES = {
    "Denmark": "DK", "Norway": "NO", "Sweden": "SE", "Finland": "FI", "Iceland": "IS", "United Kingdom": "GB", "Ireland": "IE", "Netherlands": "NL", "Belgium": "BE", "Germany": "DE",
    "France": "FR", "Spain": "ES", "Portugal": "PT", "Italy": "IT", "Poland": "PL", "Switzerland": "CH", "Austria": "AT", "Greece": "GR", "Russia": "RU", "Ukraine": "UA", "Turkey": "TR",
    "Estonia": "EE", "Latvia": "LV", "Lithuania": "LT", "United States": "US", "Canada": "CA", "Mexico": "MX", "Brazil": "BR", "Chile": "CL", "Peru": "PE", "Argentina": "AR", "Ecuador": "EC",
    "Colombia": "CO", "Mauritania": "MR", "Senegal": "SN", "Gambia": "GM", "Morocco": "MA", "Ghana": "GH", "Nigeria": "NG", "Ivory Coast": "CI", "Guinea": "GN", "Guinea-Bissau": "GW",
    "Sierra Leone": "SL", "Liberia": "LR", "Namibia": "NA", "South Africa": "ZA", "Angola": "AO", "Egypt": "EG", "Kenya": "KE", "Tanzania": "TZ", "China": "CN", "Japan": "JP",
    "South Korea": "KR", "India": "IN", "Vietnam": "VN", "Thailand": "TH", "Indonesia": "ID", "Philippines": "PH", "Malaysia": "MY", "Bangladesh": "BD", "Australia": "AU",
    "New Zealand": "NZ", "Singapore": "SG",
}
# Language names of the first service.
LANGUAGES = {"English": "en", "Danish": "da", "German": "de", "French": "fr", "Spanish": "es", "Portuguese": "pt", "Norwegian": "no", "Swedish": "sv", "Dutch": "nl", "Italian": "it", "Chinese": "zh", "Japanese": "ja", "Russian": "ru", "Arabic": "ar"}

SCHEMAS = {
    "seen": "title string, seendate string, url string, domain string, sourcecountry string, language string",
    "stories": "title string, publish_date string, url string, media_name string, media_url string, language string, text string",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def seen_rows(records: DataFrame) -> DataFrame:
    """Canonical rows of the first service's records: compact stamps, country and language names; it gives no bodies."""
    s, name = F.col("seendate"), F.trim("sourcecountry")
    date = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    stamp = F.when(F.length(s) >= 15, F.concat(date, F.lit("T"), F.concat_ws(":", F.substring(s, 10, 2), F.substring(s, 12, 2), F.substring(s, 14, 2)))).when(F.length(s) >= 8, date)
    return records.select(
        F.col("title").alias("headline"), stamp.alias("published_at"), "url", F.col("domain").alias("outlet_name"), F.col("domain").alias("outlet_domain"),
        F.when(name.rlike("^[A-Z]{2}$"), name).otherwise(_lookup(COUNTRIES, name)).alias("country"), _lookup(LANGUAGES, F.col("language")).alias("language"),
        F.lit(None).cast("string").alias("byline"), F.lit(None).cast("string").alias("body_text"),
    )


def story_rows(records: DataFrame) -> DataFrame:
    """Canonical rows of the second service's stories."""
    return records.select(
        F.col("title").alias("headline"), F.col("publish_date").alias("published_at"), "url", F.coalesce(F.nullif("media_name", F.lit("")), "media_url").alias("outlet_name"),
        F.col("media_url").alias("outlet_domain"), F.lit(None).cast("string").alias("country"), "language", F.lit(None).cast("string").alias("byline"), F.nullif("text", F.lit("")).alias("body_text"),
    )


class _Query(InputPartition):
    def __init__(self, options: dict[str, str]):
        super().__init__(0)
        self.options = options


class _Reader(DataSourceReader):
    """One query, page by page, through a transport ``module:function`` taking the parameters and giving a payload."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self) -> list[InputPartition]:
        return [_Query(self.options)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        options = partition.options
        module, _, name = options["transport"].partition(":")
        fetch: Callable[[dict], dict] = getattr(importlib.import_module(module), name)
        limit, given, token = int(options.get("limit", STORY_LIMIT)), 0, None
        while given < limit:
            payload = fetch({**{k: v for k, v in options.items() if k not in ("transport", "limit")}, "pagination_token": token})
            records = payload.get("articles") or payload.get("stories") or []
            for record in records[: limit - given]:
                yield tuple(record.get(c) for c in self.columns)
            given += len(records)
            token = payload.get("pagination_token")
            if not records or not token:
                return


class NewsService(DataSource):
    """``spark.read.format("news_service")`` with options kind (seen, stories), transport, query, start, end, limit."""

    @classmethod
    def name(cls) -> str:
        return "news_service"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "seen")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NewsService)


def hit_cap(records: DataFrame, limit: int = CALL_LIMIT) -> bool:
    """Whether a call gave as many records as it may, so that some may be missing."""
    return records.limit(limit).count() >= limit
