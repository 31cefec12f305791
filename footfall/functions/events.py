"""Expressions over event properties."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.text import one_spaced

CLICK_TEXT_LIMIT = 120


def click_properties(tag: Column, element_id: Column, text: Column, href: Column) -> Column:
    """Properties of a click: tag, then id, text and href where there is something to say."""
    return F.struct(
        F.lower(tag).alias("tag"),
        F.nullif(element_id, F.lit("")).alias("id"),
        F.nullif(F.substring(one_spaced(text), 1, CLICK_TEXT_LIMIT), F.lit("")).alias("text"),
        href.alias("href"),
    )


def property_value(properties: Column, name: str) -> Column:
    return F.get_json_object(properties, "$['" + name + "']")


def agent_label(device: Column, browser: Column) -> Column:
    both = F.concat_ws(" / ", F.nullif(device, F.lit("")), F.nullif(browser, F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), F.lit("-"))
