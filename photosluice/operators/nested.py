"""Deeply nested semi-structured records as related flat tables.

A record's JSON is parsed once and taken apart level by level: every object field and array
element becomes a row that names its parent by surrogate key and its position among its siblings.
The merged schema over all records says which kinds of value stand at which place; from it follow
the tables: one for the records, and a child table for every array place, whose rows name the row
of the table above and their ordinal, and whose columns are all values that the schema knows
below that place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photosluice.core.storage import settle

FORKS = ("fork", "fork.by_selection")
_AT_ONCE = 3  # layers of quoting taken off in one pass
PLACES_MOST = 10_000  # places of a merged schema, a table of settings that the driver reads


def _unquoted(c: Column) -> Column:
    for _ in range(_AT_ONCE):
        inner = F.try_variant_get(F.try_parse_json(c), "$", "string")
        c = F.when(c.rlike(r'^\s*"'), inner).otherwise(c)
    return c


def parsed_records(records: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """(``keys``, ``v``): the object or array in each distinct JSON text as a variant; others are left out.

    Text that is itself a JSON string (quoted once more) is unwrapped, however often.
    """
    rows = records.select(*keys, F.col(json_col).alias("_text")).distinct()
    rows = settle(rows.select(*keys, _unquoted(F.col("_text")).alias("_text")).where("_text is not null"), "records")
    while rows.where(F.col("_text").rlike(r'^\s*"')).limit(1).count():
        rows = settle(rows.select(*keys, _unquoted(F.col("_text")).alias("_text")).where("_text is not null"), "records")
    text = F.col("_text")
    return rows.select(*keys, F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text)).alias("v")).where("v is not null")


def kind_of(v: str | Column) -> Column:
    """``object``, ``array``, ``null`` or the scalar's type in lower case."""
    shape = F.schema_of_variant(v)
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "VOID", "null")
        .otherwise(F.lower(shape))
    )


def _exploded(df: DataFrame, variant: str) -> DataFrame:
    """``df`` with a row (``pos``, ``key``, ``value``) for every child of the object or array ``variant``."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))


def _escaped(name: Column) -> Column:
    """A key within a place: ``~`` and ``/`` are written ``~0`` and ``~1``, a key ``[]`` as ``~[]``."""
    plain = F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.when(name == "[]", F.lit("~[]")).otherwise(plain)


def tree_nodes(records: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """Every value in the records' JSON as a row.

    Columns: ``keys``, ``path`` (keys and array positions joined by ``/``), ``parent_path``,
    ``depth``, ``ordinal`` (position among its siblings, from 0), ``name`` (object key, null in
    arrays), ``place`` (escaped keys, ``[]`` for positions), ``parent_place``, ``kind``, ``value``
    (scalars as text), ``node_id`` and ``parent_id`` (surrogate keys; the record itself is the
    parent of the top level), ``row_id``, ``table`` and ``field``: the array element, or record, that
    the value belongs to, that one's place and the place within it. Keys are made of the parent's
    key and the own name and position, so that a ``/`` in a name matters nowhere. Repeated rows
    count once; null, empty and broken texts and texts that hold neither object nor array have no
    rows; nulls in the JSON are scalars. Keys are taken as they stand. Levels are written out one
    by one, so any depth works.
    """
    blank = F.lit("")
    level = parsed_records(records, json_col, *keys).withColumn("node_id", F.xxhash64(*keys)).select(
        *keys, blank.alias("path"), blank.alias("place"), F.lit(0).alias("depth"), "v", kind_of("v").alias("kind"),
        "node_id", F.col("node_id").alias("row_id"), F.lit(None).cast("long").alias("row_parent"), blank.alias("table"), blank.alias("field"),
    )
    level = settle(level, "level")
    levels: list[DataFrame] = []
    while True:
        inner = level.where("kind in ('object', 'array')").select(*keys, "path", "place", "depth", "v", F.col("node_id").alias("parent_id"), "row_id", "row_parent", "table", "field")
        step = _exploded(inner, "v").withColumnsRenamed({"path": "parent_path", "place": "parent_place", "pos": "ordinal", "key": "name"}).drop("v").withColumnRenamed("value", "v")
        join = lambda parent, last: F.when(F.col(parent) == "", last).otherwise(F.concat_ws("/", parent, last))
        top = lambda parent, last: F.when(F.col("depth") == 0, last).otherwise(F.concat_ws("/", parent, last))
        element, own = F.col("name").isNull(), _escaped(F.col("name"))
        step = step.withColumns({
            "path": top("parent_path", F.coalesce("name", F.col("ordinal").cast("string"))),
            "place": top("parent_place", F.coalesce(own, F.lit("[]"))),
            "node_id": F.xxhash64("parent_id", F.coalesce(F.concat(F.lit("k"), "name"), F.lit("i")), "ordinal"),
            "kind": kind_of("v"),
        })
        step = step.withColumns({
            "row_parent": F.when(element, F.col("row_id")).otherwise(F.col("row_parent")),
            "row_id": F.when(element, F.col("node_id")).otherwise(F.col("row_id")),
            "field": F.when(element, blank).otherwise(join("field", own)),
            "table": F.when(element, F.col("place")).otherwise(F.col("table")),
            "depth": F.col("depth") + 1,
        })
        level = settle(
            step.select(*keys, "path", "parent_path", "depth", "ordinal", "name", "place", "parent_place", "v", "kind", "node_id", "parent_id", "row_id", "row_parent", "table", "field"), "level"
        )
        if level.limit(1).count() == 0:
            break
        levels.append(level)
    rows = reduce(DataFrame.unionByName, levels) if levels else level
    scalar = F.when(~F.col("kind").isin("object", "array", "null"), F.try_variant_get("v", "$", "string"))
    return rows.withColumn("value", scalar).drop("v")


def merged_schema(nodes: DataFrame) -> DataFrame:
    """(``place``, ``depth``, ``table``, ``field``, ``kinds``, ``records``): what stands where, over all records of ``nodes``."""
    return nodes.groupBy("place", "depth", "table", "field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("records"))


def fields_of(nodes: DataFrame) -> dict[str, list[str]]:
    """The columns of each table, from the merged schema: ``''`` is the table of the records."""
    rows = merged_schema(nodes).select("place", "table", "field", "kinds").limit(PLACES_MOST + 1).collect()
    if len(rows) > PLACES_MOST:
        raise ValueError(f"more than {PLACES_MOST} places: the keys look like data")
    found: dict[str, set[str]] = {"": set()}
    for r in rows:
        found.setdefault(r["table"], set())
        if set(r["kinds"]) - {"object", "array"} and r["field"]:
            found[r["table"]].add(r["field"])
    return {t: sorted(f) for t, f in sorted(found.items())}


def child_table(nodes: DataFrame, place: str, fields: list[str] | None = None) -> DataFrame:
    """The array elements at ``place`` (ending in ``[]``) as a table with a column for each of ``fields``.

    Each row keeps ``node_id``, ``parent_id`` (the array), ``parent_row`` (the ``node_id`` of the
    row of the table above, or the record's key) and ``ordinal``; a field that an element lacks is null, an element that is a single value has it in
    ``value``. Without ``fields`` all that the merged schema has.
    """
    fields = fields_of(nodes).get(place, []) if fields is None else fields
    of = nodes.where(F.col("place") == place).select("node_id", "parent_id", F.col("row_parent").alias("parent_row"), "ordinal", "value")
    if not fields:
        return of
    values = nodes.where((F.col("table") == place) & F.col("field").isin(fields))
    wide = values.groupBy(F.col("row_id").alias("node_id")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"field_{f}") for f in fields])
    return of.join(wide, "node_id", "left")


def child_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """A child table for every array place of the merged schema."""
    return {t: child_table(nodes, t, f) for t, f in fields_of(nodes).items() if t}


def _text_at(v: Column, path: str) -> Column:
    """Text at ``path``, null if something else stands there."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def pipeline_steps(records: DataFrame, steps_col: str, *keys: str) -> DataFrame:
    """Every step of the records' pipelines, at any depth of their forks.

    Columns: ``keys``, ``node_path`` (position at top level, ``<fork>/<branch>/<position>`` in a
    branch), ``parent_path`` (path of the fork), ``ordinal``, ``branch``, ``stage``, ``alias``,
    ``config`` (JSON text), ``node_id``, ``parent_id``. A step is written as a name, as
    ``[name, config, alias]`` or as an object with ``stage``, ``config`` and ``alias``, parts may
    be missing; null elements are no steps but keep their position. Branches are written as an
    object, as pairs, or as objects with ``name`` and ``pipeline``; a bare pipeline in a list is
    ``branch_<position>``. Repeated rows count once; texts that can't be read have no steps.
    """
    roots = parsed_records(records, steps_col, *keys)
    level = roots.select(*keys, F.lit("").alias("parent_path"), F.lit(None).cast("string").alias("branch"), F.col("v").alias("pipeline"))
    level = level.withColumn("parent_id", F.xxhash64(*keys))
    found: list[DataFrame] = []
    while True:
        steps = _exploded(level.where(kind_of("pipeline") == "array"), "pipeline").select(
            *keys, "parent_path", "parent_id", "branch", F.col("pos").alias("ordinal"), F.col("value").alias("v")
        ).where(kind_of("v") != "null")
        v, kind = F.col("v"), kind_of("v")
        node = F.when(F.col("branch").isNull(), F.col("ordinal").cast("string")).otherwise(F.concat_ws("/", "parent_path", "branch", "ordinal"))
        stage = F.when(kind == "string", F.try_variant_get(v, "$", "string")).when(kind == "array", _text_at(v, "$[0]")).otherwise(_text_at(v, "$.stage"))
        config = F.when(kind == "array", F.try_variant_get(v, "$[1]", "variant")).when(kind == "object", F.try_variant_get(v, "$.config", "variant"))
        alias = F.when(kind == "array", _text_at(v, "$[2]")).when(kind == "object", _text_at(v, "$.alias"))
        own = F.xxhash64("parent_id", F.coalesce(F.concat(F.lit("b"), "branch"), F.lit("t")), "ordinal")
        steps = settle(
            steps.select(*keys, node.alias("node_path"), "parent_path", "parent_id", own.alias("node_id"), "ordinal", "branch", stage.alias("stage"), alias.alias("alias"), config.alias("config")),
            "steps",
        )
        found.append(steps)
        forks = steps.where(F.col("stage").isin(*FORKS)).select(
            *keys, F.col("node_path").alias("parent_path"), F.col("node_id").alias("parent_id"), F.try_variant_get("config", "$.branches", "variant").alias("branches")
        ).where(kind_of("branches").isin("object", "array"))
        item = _exploded(forks, "branches").select(*keys, "parent_path", "parent_id", "pos", "key", F.col("value").alias("b"))
        b, kind = F.col("b"), kind_of("b")
        pair = (kind == "array") & _text_at(b, "$[0]").isNotNull() & (kind_of(F.try_variant_get(b, "$[1]", "variant")) == "array")
        name = (
            F.when(F.col("key").isNotNull(), F.col("key"))
            .when(pair, _text_at(b, "$[0]"))
            .when(kind == "object", F.coalesce(_text_at(b, "$.name"), F.concat(F.lit("branch_"), "pos")))
            .otherwise(F.concat(F.lit("branch_"), "pos"))
        )
        inner = (
            F.when(F.col("key").isNotNull(), b)
            .when(pair, F.try_variant_get(b, "$[1]", "variant"))
            .when(kind == "object", F.try_variant_get(b, "$.pipeline", "variant"))
            .otherwise(b)
        )
        level = settle(item.select(*keys, "parent_path", "parent_id", name.alias("branch"), inner.alias("pipeline")), "branches")
        if level.limit(1).count() == 0:
            break
    rows = reduce(DataFrame.unionByName, found)
    return rows.withColumn("config", F.to_json("config"))
