"""Timestamps as typed, in many forms and zones, to one UTC instant."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from covertrace.session import written

# Month names (English, Danish, German, Spanish, French), by month.
MONTH_NAMES = {
    1: ("january", "jan", "januar", "jänner", "enero", "ene", "janvier", "janv"),
    2: ("february", "feb", "februar", "febrero", "février", "fevrier", "févr", "fév"),
    3: ("march", "mar", "marts", "märz", "marz", "mär", "marzo", "mars"),
    4: ("april", "apr", "abril", "abr", "avril", "avr"),
    5: ("may", "maj", "mai", "mayo"),
    6: ("june", "jun", "juni", "junio", "juin"),
    7: ("july", "jul", "juli", "julio", "juillet", "juil"),
    8: ("august", "aug", "agosto", "ago", "août", "aout"),
    9: ("september", "sep", "sept", "septiembre", "setiembre", "septembre"),
    10: ("october", "oct", "oktober", "okt", "octubre", "octobre"),
    11: ("november", "nov", "noviembre", "novembre"),
    12: ("december", "dec", "dezember", "dez", "diciembre", "dic", "décembre", "decembre", "déc"),
}
# Zone abbreviations in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540,
    "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: Shifts at which a local time may stand a second time, in minutes.
OVERLAPS = (30, 60, 120)

_CLOCK = r"(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?"
_TAIL = r"\s*(.*)"
_SIGNED = r"^(?:UTC|GMT)?([+-]\d{2}):?(\d{2})?(?:\s*\(.*\))?$"
_WORD = r"(?:[\p{L}]{2,12}\.?,?\s+)?"
# Each form becomes year|month|day|hour|minute|second|fraction|half of day|zone.
FORMS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ]\s*" + _CLOCK + _TAIL + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})[T ]\s*" + _CLOCK + _TAIL + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?()()" + _TAIL + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}),?[T ]\s*" + _CLOCK + _TAIL + "$", "$3|#$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^" + _WORD + r"(\d{1,2})(?:\.|st|nd|rd|th|er|º)?\s*(?:de |of )?\s*([\p{L}]{3,12})\.?,?\s+(?:de |del )?(\d{4}),?\s+(?:kl\.?|at|um|à|a las)?\s*" + _CLOCK + _TAIL + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^" + _WORD + r"([\p{L}]{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}),?\s+(?:at\s+)?" + _CLOCK + _TAIL + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)


def _spread(text: Column) -> Column:
    """Parts of a timestamp with a time of day, as an array of nine strings; null where no form fits."""
    spread = F.lit(None).cast("string")
    for pattern, parts in reversed(FORMS):
        spread = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, parts)).otherwise(spread)
    return F.split(spread, r"\|", -1)


def ntz_micros(ts: Column) -> Column:
    """Microseconds from 1970 of a zoneless timestamp, whatever the session's zone."""
    second = F.extract(F.lit("SECOND"), ts)
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (second * 1_000_000).cast("long")
    )


def parse_written(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_wall`` (zoneless timestamp), ``_offset`` (minutes), ``_zone`` (IANA name), ``_epoch`` (microseconds).

    At most one of the last three is filled; all are null for a wall time without a zone. A zone that can't be
    read leaves ``_wall`` null, as do values without a time of day and impossible dates.
    """
    months = F.create_map(*[F.lit(x) for m, names in MONTH_NAMES.items() for n in names for x in (n, m)])
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    zones = sorted(available_timezones())
    col, part = F.col, lambda k: F.col("_p")[k]
    number = lambda c: c.try_cast("int")
    digits = col("_text")
    # each step stands in a projection of its own, so that no expression is repeated in the generated code
    steps = (
        {"_text": F.trim(F.regexp_replace(F.col(column), r"[\s\u00a0\u2009\u202f]+", " "))},
        {
            "_epoch": F.when(digits.rlike(r"^\d{10}$"), digits.try_cast("long") * 1_000_000)
            .when(digits.rlike(r"^\d{13}$"), digits.try_cast("long") * 1_000)
            .when(digits.rlike(r"^\d{16}$"), digits.try_cast("long")),
            "_p": _spread(col("_text")),
        },
        {"_day_first": part(1).startswith("#"), "_m": F.regexp_replace(part(1), "^#", ""), "_d": number(part(2)), "_h": number(part(3)), "_half": F.lower(F.substring(part(7), 1, 1)), "_tail": F.trim(part(8))},
        {
            "_month": F.coalesce(number(col("_m")), months[F.lower(col("_m"))]),
            "_hour": F.when(col("_half") == "", col("_h")).when(col("_h").between(1, 12), col("_h") % 12 + F.when(col("_half") == "p", 12).otherwise(0)),
            "_second": F.concat(F.when(part(5) == "", "0").otherwise(part(5)), F.lit("."), F.rpad(F.substring(part(6), 1, 6), 6, "0")).try_cast("decimal(16,6)"),
            "_bracket": F.regexp_extract("_tail", r"^\[([A-Za-z0-9_+/-]+)\]$", 1),
            "_signed": F.regexp_extract("_tail", _SIGNED, 1),
            "_minutes": F.regexp_extract("_tail", _SIGNED, 2),
        },
        {
            "_swap": col("_day_first") & (col("_month") > 12) & (col("_d") <= 12),  # day first unless that is impossible
            "_offset": F.when(
                col("_signed") != "", number(col("_signed")) * 60 + F.when(col("_signed").startswith("-"), -1).otherwise(1) * F.coalesce(number(col("_minutes")), F.lit(0))
            ).otherwise(F.coalesce(known[F.upper("_tail")], known[F.upper("_bracket")])),
        },
        {
            "_zone": F.when(col("_offset").isNull(), F.coalesce(F.when(col("_bracket") != "", col("_bracket")), F.when(col("_tail") != "", col("_tail")))),
            "_mo": F.when(col("_swap"), col("_d")).otherwise(col("_month")),
            "_da": F.when(col("_swap"), col("_month")).otherwise(col("_d")),
        },
        {"_wall": F.when(col("_zone").isNull() | col("_zone").isin(zones), F.try_make_timestamp_ntz(number(part(0)), col("_mo"), col("_da"), col("_hour"), number(part(4)), col("_second")))},
    )
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.select(*df.columns, "_wall", "_offset", "_zone", "_epoch")


def with_zone_instant(df: DataFrame, wall: str, zone: str, out: str) -> DataFrame:
    """``df`` with ``out``: the UTC wall time of a local time that stands exactly once in its zone, else null."""
    utc = F.col("_utc")
    back = lambda c: F.convert_timezone(F.lit("UTC"), F.col(zone), c)
    once = back(utc) == F.col(wall)
    for minutes in OVERLAPS:
        step = F.make_dt_interval(mins=F.lit(minutes))
        once = once & (back(utc + step) != F.col(wall)) & (back(utc - step) != F.col(wall))
    return df.withColumn("_utc", F.convert_timezone(F.col(zone), F.lit("UTC"), F.col(wall))).withColumn(out, F.when(once, utc)).drop("_utc")


def estimate_zones(parsed: DataFrame, imports: DataFrame, candidates: list[str]) -> DataFrame:
    """(campaign_id, estimated_zone) from zoneless wall times: nothing is delivered before it is published.

    For each candidate zone (an offset history) the rows whose instant lies after the import of their file are
    violations; the zone with the fewest stands, then the one whose instants lie nearest the imports, then
    the first by name. ``parsed`` holds only campaigns without a zone.
    """
    bare = parsed.where(F.col("_wall").isNotNull() & F.col("_offset").isNull() & F.col("_zone").isNull()).join(
        imports.select(F.col("id").alias("import_id"), F.unix_micros(F.col("imported_at").cast("timestamp")).alias("_in")), "import_id"
    )
    tried = bare.select("campaign_id", "_wall", "_in", F.explode(F.array(*[F.lit(c) for c in candidates])).alias("zone"))
    at = ntz_micros(F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("_wall")))
    scored = tried.groupBy("campaign_id", "zone").agg(F.count_if(at > F.col("_in")).alias("bad"), F.min(F.when(at <= F.col("_in"), F.col("_in") - at)).alias("near"))
    best = W.partitionBy("campaign_id").orderBy("bad", F.col("near").asc_nulls_last(), "zone")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").select("campaign_id", F.col("zone").alias("estimated_zone"))


def normalised_instants(rows: DataFrame, campaigns: DataFrame, imports: DataFrame) -> DataFrame:
    """(row_id, published_us): the instant of each row whose ``published_at`` fixes one, in microseconds since 1970 UTC.

    A zone in the value stands first, then the campaign's; a campaign whose zone is missing or unknown gets the one
    that ``estimate_zones`` finds. No row comes out for null, blank or undated values, dates without a time of
    day, unreadable zones, and local times that stand twice or never. Campaigns are a fixed register of a few
    dozen rows and are broadcast by Spark on their measured size. Repeated rows come out as often as they stand.
    """
    zones = sorted(available_timezones())
    named = campaigns.select(F.col("id").alias("campaign_id"), F.when(F.col("timezone").isin(zones), F.col("timezone")).alias("campaign_zone")).dropDuplicates(["campaign_id"])
    parsed = parse_written(rows.select("row_id", "import_id", "campaign_id", "published_at").where(F.col("published_at").isNotNull()), "published_at")
    parsed = parsed.join(named, "campaign_id", "left")
    candidates = [r[0] for r in named.select("campaign_zone").where("campaign_zone is not null").distinct().orderBy("campaign_zone").limit(len(zones)).collect()]
    lacking = not named.where("campaign_zone is null").isEmpty()
    if candidates and lacking:
        # written, as the filters of the estimate would else be pushed down with a copy of the parsing each
        parsed = parsed.join(estimate_zones(written(parsed.where("campaign_zone is null")), imports, candidates), "campaign_id", "left")
    else:
        parsed = parsed.withColumn("estimated_zone", F.lit(None).cast("string"))
    bare = F.col("_offset").isNull() & F.col("_epoch").isNull()
    parsed = parsed.withColumn("zone", F.when(bare, F.coalesce("_zone", "campaign_zone", "estimated_zone")))
    parsed = with_zone_instant(parsed, "_wall", "zone", "_local")
    fixed = ntz_micros(F.col("_wall")) - F.col("_offset").cast("long") * 60_000_000
    us = F.coalesce(F.col("_epoch"), F.when(F.col("_offset").isNotNull(), fixed).otherwise(ntz_micros(F.col("_local"))))
    # the running id keeps the optimizer from pushing this filter, and with it a second copy of the parsing, to the scan
    found = parsed.select("row_id", us.alias("published_us"), F.monotonically_increasing_id().alias("_at"))
    return found.where(F.col("published_us").isNotNull() & (F.col("_at") >= 0)).select("row_id", "published_us")
