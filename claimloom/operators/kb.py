"""Person and organisation records from a knowledge-base table.

Entities: entity_id, labels map<string,string>, aliases map<string,array<string>>, descriptions map<string,string>,
claims array<struct<property, ord, value_id, value_time, value_string, start_time, end_time, of_id>>.
Labels are joined once for all properties instead of one call for each value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import first_alias, in_languages, kb_date, kb_date_short, media_url

CLAIM = "struct<property:string,ord:int,value_id:string,value_time:string,value_string:string,start_time:string,end_time:string,of_id:string>"
#: The properties of key people, in order.
KEY_PEOPLE = ("P169", "P488", "P3320", "P1037", "P1075")


def properties(entities: DataFrame) -> DataFrame:
    """A row per property value of each entity."""
    return entities.select("entity_id", F.inline("claims"))


def labelled(entities: DataFrame, languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """properties with the labels of values and of qualifiers' entities.

    A row without an id gets a key that no entity has, made of its own entity's, so such rows are spread; popular
    values are split by AQE, as an id has one label row.
    """
    rows = properties(entities)
    labels = entities.select(F.col("entity_id").alias("_key"), in_languages(F.col("labels"), languages).alias("_label"))
    for value, name in (("value_id", "value_label"), ("of_id", "of_label")):
        keyed = rows.withColumn("_key", F.coalesce(value, F.concat(F.lit("\n"), "entity_id", F.lit("\n"), F.col("ord").cast("string"))))
        rows = keyed.join(labels, "_key", "left").withColumnRenamed("_label", name).drop("_key")
    return rows


KB_JSON = "struct<id:string,labels:map<string,struct<value:string>>,aliases:map<string,array<struct<value:string>>>,descriptions:map<string,struct<value:string>>,claims:map<string,array<string>>>"


def from_json(c: Column) -> Column:
    """A knowledge base's entity document (JSON) as a struct of entity_id, labels, aliases, descriptions and claims.

    A statement's value is its main value: an entity's id, a time or a string; the qualifiers of start, end and
    organisation are the first ones of P580, P582 and P642. A statement without a value is left out.
    """
    d = F.from_json(c, KB_JSON)
    value = "$.mainsnak.datavalue.value"

    def qualifier(x: Column, prop: str, field: str) -> Column:
        return F.get_json_object(x, f"$.qualifiers.{prop}[0].datavalue.value.{field}")

    def claim(prop: Column):
        def of(x: Column, i: Column) -> Column:
            plain = F.when(F.get_json_object(x, f"{value}.id").isNull() & F.get_json_object(x, f"{value}.time").isNull(), F.get_json_object(x, value))
            fields = {"value_id": F.get_json_object(x, f"{value}.id"), "value_time": F.get_json_object(x, f"{value}.time"), "value_string": plain, "start_time": qualifier(x, "P580", "time"), "end_time": qualifier(x, "P582", "time"), "of_id": qualifier(x, "P642", "id")}
            return F.struct(prop.alias("property"), i.cast("int").alias("ord"), *[v.alias(k) for k, v in fields.items()])

        return of

    listed = F.flatten(F.transform(F.map_entries(d["claims"]), lambda e: F.transform(e["value"], claim(e["key"]))))
    there = F.filter(F.coalesce(listed, F.array().cast(f"array<{CLAIM}>")), lambda x: F.coalesce(x["value_id"], x["value_time"], x["value_string"]).isNotNull())
    plain = lambda m: F.transform_values(m, lambda k, v: v["value"])
    return F.struct(d["id"].alias("entity_id"), plain(d["labels"]).alias("labels"), F.transform_values(d["aliases"], lambda k, v: F.transform(v, lambda x: x["value"])).alias("aliases"), plain(d["descriptions"]).alias("descriptions"), there.alias("claims"))


def _first(prop: str, c: Column) -> Column:
    """The value of a property's first row."""
    return F.min_by(F.when(F.col("property") == prop, c), F.when(F.col("property") == prop, F.col("ord")))


def _all(prop: str, c: Column) -> Column:
    """All labelled values of a property in source order."""
    rows = F.collect_list(F.when((F.col("property") == prop) & F.col("value_label").isNotNull(), F.struct(F.col("ord"), c.alias("v"))))
    return F.transform(F.array_sort(rows), lambda x: x["v"])


def latest_first(items: Column) -> Column:
    """Items with start_date and end_date: running ones first, then by end and start, ties in source order."""
    order = lambda x: F.struct(F.coalesce(x["end_date"], F.lit("9999-99-99")).alias("e"), F.coalesce(x["start_date"], F.lit("0000-00-00")).alias("s"))
    placed = F.transform(items, lambda x, i: F.struct(order(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.transform(F.reverse(F.array_sort(placed)), lambda p: p["x"])


def persons(entities: DataFrame) -> DataFrame:
    """One row per entity with a person's fields; absent ones null, absent lists empty."""
    span = [kb_date(F.col("start_time")).alias("start_date"), kb_date(F.col("end_time")).alias("end_date")]
    dated = F.struct(F.col("value_label").alias("name"), *span)
    held = F.struct(F.col("value_label").alias("name"), *span, F.col("of_label").alias("organization"))
    out = labelled(entities).groupBy("entity_id").agg(
        _first("P569", kb_date(F.col("value_time"))).alias("birth_date"),
        _first("P570", kb_date(F.col("value_time"))).alias("death_date"),
        _first("P19", F.col("value_label")).alias("birth_place"),
        _first("P21", F.col("value_label")).alias("gender"),
        latest_first(_all("P102", dated)).alias("political_party"),
        _all("P140", F.col("value_label")).alias("religion"),
        _all("P1142", F.col("value_label")).alias("political_ideology"),
        latest_first(_all("P106", dated)).alias("occupation_details"),
        latest_first(_all("P39", held)).alias("position_held"),
        _all("P101", F.col("value_label")).alias("field_of_work"),
        media_url(_first("P18", F.col("value_string")), 300).alias("image_url"),
    )
    out = out.withColumn("occupation", F.transform("occupation_details", lambda x: x["name"]))
    about = entities.select("entity_id", in_languages(F.col("labels"), ["en"]).alias("name"), in_languages(F.col("descriptions"), ["en"]).alias("description"))
    return _filled(about.join(out, "entity_id", "left"), ["political_party", "religion", "political_ideology", "occupation", "occupation_details", "position_held", "field_of_work"])


def organizations(entities: DataFrame) -> DataFrame:
    """One row per entity with an organisation's fields; absent ones null, absent lists empty."""
    both = ("en", "it")
    order = F.array_position(F.array(*[F.lit(p) for p in KEY_PEOPLE]), F.col("property"))
    people = F.collect_list(F.when((order > 0) & F.col("value_label").isNotNull(), F.struct(order.alias("p"), F.col("ord"), F.col("value_label").alias("v"))))
    out = labelled(entities, both).groupBy("entity_id").agg(
        F.get(_all("P31", F.col("value_label")), 0).alias("type"),
        _first("P571", kb_date_short(F.col("value_time"))).alias("inception_date"),
        _first("P576", kb_date_short(F.col("value_time"))).alias("dissolution_date"),
        _first("P159", F.col("value_label")).alias("headquarters"),
        _first("P17", F.col("value_label")).alias("country"),
        _first("P856", F.col("value_string")).alias("official_website"),
        _first("P749", F.col("value_label")).alias("parent_organization"),
        _all("P355", F.col("value_label")).alias("subsidiaries"),
        _all("P452", F.col("value_label")).alias("industry"),
        F.transform(F.array_sort(people), lambda x: x["v"]).alias("key_people"),
        media_url(_first("P18", F.col("value_string")), 800).alias("image_url"),
    )
    about = entities.select("entity_id", in_languages(F.col("labels"), both).alias("name"), in_languages(F.col("descriptions"), both).alias("description"), first_alias(F.col("aliases")).alias("alias"), F.lit(True).alias("found"))
    return _filled(about.join(out, "entity_id", "left"), ["subsidiaries", "industry", "key_people"])


def _filled(df: DataFrame, lists: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in lists})
