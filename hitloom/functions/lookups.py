"""Fixed lookups of the request plan: locales, time ranges. Literal maps, so no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Locales the brave pages know. Country and interface language
# follow from the code: de-DE gives (de, de-de).
BRAVE_LOCALES = (
    "en-US en-GB de-DE fr-FR es-ES ja-JP it-IT pt-BR ru-RU zh-CN zh-TW ko-KR "
    "nl-NL sv-SE da-DK fi-FI nb-NO pl-PL tr-TR ar-SA th-TH vi-VN id-ID ms-MY"
).split()

# Region code of the duckduckgo form per locale.
DUCKDUCKGO_REGIONS = {
    "en-US": "us-en", "en-GB": "uk-en", "de-DE": "de-de", "fr-FR": "fr-fr",
    "es-ES": "es-es", "ja-JP": "jp-jp", "it-IT": "it-it", "pt-BR": "br-pt",
    "nl-NL": "nl-nl", "zh-CN": "cn-zh", "zh-TW": "tw-tzh", "ko-KR": "kr-kr",
    "sv-SE": "se-sv", "da-DK": "dk-da", "fi-FI": "fi-fi", "nb-NO": "no-nb",
    "pl-PL": "pl-pl", "tr-TR": "tr-tr", "ru-RU": "ru-ru",
}

# Time range codes per engine. brave-news takes none.
TIME_RANGE_CODES = {
    "brave": {"day": "pd", "week": "pw", "month": "pm", "year": "py"},
    "duckduckgo": {"day": "d", "week": "w", "month": "m", "year": "y"},
    "bingnews": {"day": "4", "week": "7", "month": "9", "year": "9"},
}

# Names of the safe-search levels.
SAFESEARCH_NAMES = {0: "off", 1: "moderate", 2: "strict"}


def literal_map(values: dict) -> Column:
    """A constant map, parsed once."""

    def sql(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value).lower()

    return F.expr(f"map({', '.join(sql(v) for pair in values.items() for v in pair)})")


def brave_country(locale: Column) -> Column:
    known = locale.isin(BRAVE_LOCALES)
    return F.when(known, F.lower(F.substring_index(locale, "-", -1))).otherwise("us")


def brave_language(locale: Column) -> Column:
    return F.when(locale.isin(BRAVE_LOCALES), F.lower(locale)).otherwise("en-us")


def duckduckgo_region(locale: Column) -> Column:
    found = F.try_element_at(literal_map(DUCKDUCKGO_REGIONS), locale)
    return F.coalesce(found, F.lit("wt-wt"))


def map_locale(locale: Column) -> Column:
    """Struct of country and ui_lang (brave) and kl (duckduckgo), each with its default."""
    return F.struct(
        brave_country(locale).alias("country"),
        brave_language(locale).alias("ui_lang"),
        duckduckgo_region(locale).alias("kl"),
    )


def time_range_code(engine: Column, time_range: Column) -> Column:
    """Engine's own code for day, week, month or year; empty for anything else."""
    out = F.lit("")
    for name, codes in TIME_RANGE_CODES.items():
        code = F.coalesce(F.try_element_at(literal_map(codes), time_range), F.lit(""))
        out = F.when(engine == name, code).otherwise(out)
    return out


def safesearch_name(level: Column) -> Column:
    """off, moderate or strict; off for any other level."""
    return F.coalesce(F.try_element_at(literal_map(SAFESEARCH_NAMES), level), F.lit("off"))
