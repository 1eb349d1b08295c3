"""Messages: numeric and passed-through fields, JSON in and out, interceptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_fields(message: Column, fields: list[str]) -> list[Column]:
    """The fields of a JSON object as doubles: text becomes 0, a missing field raises an error."""
    out = []
    for f in fields:
        raw = F.get_json_object(message, f"$.{f}")
        value = F.coalesce(raw.try_cast("double"), F.lit(0.0))
        out.append(F.when(F.array_contains(F.json_object_keys(message), f), value).otherwise(F.raise_error(F.concat(F.lit(f"field {f} is missing in "), message)).cast("double")).alias(f))
    return out


def passed_through(message: Column, fields: list[str]) -> Column:
    """All other fields as strings."""
    whole = F.from_json(message, "map<string,string>")
    return F.map_filter(whole, lambda k, _: ~k.isin(*fields)) if fields else whole


def projected(item: Column, headers: list[str]) -> list[Column]:
    """Output columns of a map of values: a missing header is 0."""
    return [F.coalesce(F.try_element_at(item, F.lit(h)).cast("double"), F.lit(0.0)).alias(h) for h in headers]


def edited(item: Column, drop: list[str] | None = None, put: dict[str, Column] | None = None) -> Column:
    """A map of values without some headers, and with others set or added."""
    out = F.map_filter(item, lambda k, _: ~k.isin(*drop)) if drop else item
    if put:
        out = F.map_filter(out, lambda k, _: ~k.isin(*put))
        out = F.map_concat(out, F.create_map(*(x for k, v in put.items() for x in (F.lit(k), v))))
    return out


def without_ids(rows: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    """rows but those whose id is among gone's; rows without an id stay."""
    return rows.join(gone.select(id).distinct(), id, "left_anti")


def chosen(rows: DataFrame, id: str, value: str = "kwh") -> DataFrame:
    """The id and one numeric field of the user's choice, as columns id and value."""
    return rows.select(F.col(id).alias("id"), F.col(value).cast("double").alias("value"))


def quarantined(df: DataFrame, message: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose message parses (column parsed), and the rows whose does not."""
    marked = df.withColumn("parsed", F.from_json(message, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col(message).isNull() | F.col("parsed._bad").isNotNull()
    return marked.where(~bad).withColumn("parsed", F.col("parsed").dropFields("_bad")), marked.where(bad).drop("parsed")


def item_json(key: Column, values: dict[str, Column], passed: Column | None = None) -> Column:
    """A released item: id first, values as 32-bit floats, then what was passed through."""
    item = F.to_json(F.struct(key.cast("string").alias("id"), *(v.cast("float").alias(k) for k, v in values.items())))
    if passed is None:
        return item
    rest = F.to_json(passed)
    joined = F.concat(F.substring(item, F.lit(1), F.length(item) - F.lit(1)), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    return F.when(F.size(passed) > 0, joined).otherwise(item)


def payload_items(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """One row for each object of a payload that is an array of objects or one object; empty ones give none."""
    text = F.trim(F.col(payload))
    array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return df.withColumn("items", F.from_json(array, f"array<struct<{schema}>>")).where(F.size("items") > 0).select(*[c for c in df.columns if c != payload], F.explode("items").alias("item"))


def produced(value: Column) -> Column:
    """Interceptor before sending."""
    return F.concat(F.regexp_replace(F.regexp_replace(value, "e", "3"), "o", "0"), F.lit(" X"))


def consumed(value: Column) -> Column:
    """Interceptor after polling."""
    return F.regexp_replace(F.regexp_replace(value, "e", "3"), "4", "x")


def number_or_text(value: Column) -> tuple[Column, Column]:
    """CSV coercion: plain digits with at most points as a double, all else as text (so negatives stay text)."""
    plain = F.regexp_replace(value, r"[.,]", "")
    numeric = plain.rlike("^[0-9]+$")
    return F.when(numeric, value.try_cast("double")), F.when(~numeric, value)
