"""Assets: their objects, the components on them, scripts behind guids, and where scripts are used."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.keys import normal_guid, strip_blanks
from corvane.operators.projections import asset_kind
from corvane.operators.skew import salted_join

# Names of built-in types by class id; ids of settings of a scene, which are no objects.
CLASS_NAMES = {
    1: "GameObject", 4: "Transform", 20: "Camera", 23: "MeshRenderer", 25: "Renderer", 33: "MeshFilter", 54: "Rigidbody", 64: "MeshCollider", 65: "BoxCollider",
    81: "AudioListener", 82: "AudioSource", 108: "Light", 111: "Animation", 114: "MonoBehaviour", 120: "LineRenderer", 124: "Behaviour", 135: "SphereCollider",
    136: "CapsuleCollider", 137: "SkinnedMeshRenderer", 198: "ParticleSystem", 212: "SpriteRenderer", 222: "CanvasRenderer", 223: "Canvas", 224: "RectTransform", 225: "CanvasGroup",
}
SETTINGS_IDS = (29, 104, 127, 157, 196, 1001)
HEADER = r"--- !u!(\d+) &(-?\d+)([^\n]*)"

#: Values of properties that say nothing.
EMPTY_VALUES = ("", "0", "{fileID: 0}", "[]")


def class_name_of(class_id: Column) -> Column:
    """The built-in type of a class id; Component_<id> for others."""
    known = F.create_map(*(F.lit(x) for pair in CLASS_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, class_id), F.concat(F.lit("Component_"), class_id.cast("string")))


def asset_objects(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, class_id, file_id, type_name, name, script_guid, stripped, links, properties of the objects in asset texts.

    An object runs from its header line to the next; settings of a scene are left out. links are the ids (not 0) that it
    refers to, in order; properties its own fields (indented by two or four blanks, not m_..., with a value that says
    something), in order. Texts without a header give nothing. All of it is done by Spark's functions on strings.
    """
    lined = texts.where(F.col(text).isNotNull()).select(F.col(key), F.regexp_replace(text, r"\r\n?", "\n").alias("__text"))
    parts = lined.select(key, F.posexplode(F.split("__text", r"(?m)^(?=--- !u!\d+ &)")).alias("position", "__part")).where(F.col("__part").rlike(f"^{HEADER}"))
    head = lambda n: F.regexp_extract("__part", f"^{HEADER}", n)
    fields = F.regexp_extract_all("__part", F.lit(r"(?m)^(?:  |    )([A-Za-z]\w*: *\S[^\n]*)$"), 1)
    fields = F.transform(fields, lambda x: F.struct(F.substring_index(x, ":", 1).alias("field"), F.trim(F.regexp_replace(x, r"^\w+:", "")).alias("value")))
    own = F.filter(fields, lambda x: ~x["field"].startswith("m_") & ~x["value"].isin(*EMPTY_VALUES))
    links = F.filter(F.regexp_extract_all("__part", F.lit(r"\{fileID: (-?\d+)"), 1), lambda x: x != "0")
    made = parts.select(
        key,
        "position",
        head(1).cast("int").alias("class_id"),
        head(2).alias("file_id"),
        F.regexp_extract("__part", r"(?m)^(\w+):[ \t]*$", 1).alias("__kind"),
        F.trim(F.regexp_extract("__part", r"(?m)^  m_Name:([^\n]*)$", 1)).alias("name"),
        F.lower(F.regexp_extract("__part", r"m_Script: *\{[^}]*guid: *([0-9a-fA-F]{32})", 1)).alias("script_guid"),
        head(3).contains("stripped").alias("stripped"),
        links.alias("links"),
        own.alias("properties"),
    )
    kept = made.where(~F.col("class_id").isin(*SETTINGS_IDS))
    return kept.withColumn("type_name", F.when(F.col("__kind") != "", F.col("__kind")).otherwise(class_name_of(F.col("class_id")))).drop("__kind")


def scripts_by_guid(tables: Iterable[DataFrame]) -> DataFrame:
    """script_guid, class_name, script_path: of several scripts for a guid the one of least path, then class."""
    known = reduce(DataFrame.unionByName, [t.select("guid", "class_name", "script_path") for t in tables])
    one = known.select(normal_guid(F.col("guid")).alias("script_guid"), "script_path", "class_name").where("script_guid <> ''")
    return one.groupBy("script_guid").agg(F.min(F.struct("script_path", "class_name")).alias("__one")).select("script_guid", "__one.class_name", "__one.script_path")


def component_names(components: DataFrame, scripts: DataFrame) -> DataFrame:
    """components with script_guid in normal form and shown_name: the script's class, or the first 8 of its guid in brackets.

    scripts are those of scripts_by_guid. Components without a guid have no shown_name; a guid that holds a large share of
    them is spread over several tasks.
    """
    known = scripts.select("script_guid", F.col("class_name").alias("__class"))
    guid = normal_guid(F.col("script_guid"))
    joined = salted_join(components.withColumn("script_guid", guid), known, ["script_guid"], F.struct(*components.columns[:2]), "left")
    shown = F.coalesce("__class", F.when(F.col("script_guid") != "", F.concat(F.lit("["), F.substring("script_guid", 1, 8), F.lit("...]"))))
    return joined.withColumn("shown_name", shown).drop("__class")


def asset_references(components: DataFrame, scripts: DataFrame) -> DataFrame:
    """script_guid, class_name, script_path, prefabs, scenes, others: the assets that use each known script, sorted.

    References to unknown scripts are left out. Assets are made distinct before they are gathered.
    """
    used = components.select(normal_guid(F.col("script_guid")).alias("script_guid"), "asset_path").where("script_guid <> ''").distinct()
    found = used.join(scripts, "script_guid").withColumn("__kind", asset_kind(F.col("asset_path")))
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("__kind") == kind, F.col("asset_path"))))
    return found.groupBy("script_guid", "class_name", "script_path").agg(of("prefab").alias("prefabs"), of("scene").alias("scenes"), of("other").alias("others"))


def class_references_in_assets(components: DataFrame, scripts: DataFrame) -> DataFrame:
    """class_name, n_guids, files (sorted): the assets that use any script of a class."""
    used = components.select(normal_guid(F.col("script_guid")).alias("script_guid"), "asset_path").where("script_guid <> ''").distinct()
    found = used.join(scripts.where("class_name <> ''"), "script_guid")
    return found.groupBy("class_name").agg(F.count_distinct("script_guid").alias("n_guids"), F.sort_array(F.collect_set("asset_path")).alias("files"))


def object_components(components: DataFrame, scripts: DataFrame) -> DataFrame:
    """asset_path, go_file_id, scripts (sorted names), n_components of the objects that have script components.

    Each component counts once, by its latest row; those on no object ("0" or null) are left out.
    """
    latest = components.groupBy("mb_no").agg(F.max(F.struct("seen_at", "loaded_at", "asset_path", "go_file_id", "script_guid")).alias("__row"))
    rows = latest.select("mb_no", "__row.asset_path", strip_blanks(F.col("__row.go_file_id")).alias("go_file_id"), "__row.script_guid").where("go_file_id <> '' and go_file_id <> '0'")
    named = component_names(rows, scripts)
    return named.groupBy("asset_path", "go_file_id").agg(F.sort_array(F.collect_list("shown_name")).alias("scripts"), F.count(F.lit(1)).alias("n_components"))


def object_of(links: DataFrame, objects: DataFrame, transforms: DataFrame) -> DataFrame:
    """asset_path, link, object_id, through: which object a link means, itself or the one of a transform; null if neither.

    links has asset_path and link, objects asset_path and file_id, transforms asset_path, file_id and go_file_id, each
    distinct. through is object, transform or null.
    """
    direct = objects.select("asset_path", F.col("file_id").alias("link"), F.col("file_id").alias("__object"))
    over = transforms.where("go_file_id is not null").groupBy("asset_path", F.col("file_id").alias("link")).agg(F.min("go_file_id").alias("__over"))
    both = links.select("asset_path", "link").distinct().join(direct, ["asset_path", "link"], "left").join(over, ["asset_path", "link"], "left")
    through = F.when(F.col("__object").isNotNull(), "object").when(F.col("__over").isNotNull(), "transform")
    return both.select("asset_path", "link", F.coalesce("__object", "__over").alias("object_id"), through.alias("through"))


def telling_properties(components: DataFrame, key: str = "mb_no", properties: str = "properties") -> DataFrame:
    """key, field, value: the fields of JSON objects that aren't internal (m_...) and hold a value that says something.

    Text that is no JSON object gives nothing.
    """
    fields = components.select(key, F.explode(F.map_entries(F.from_json(properties, "map<string,string>"))).alias("__e")).select(key, F.col("__e.key").alias("field"), F.col("__e.value").alias("value"))
    return fields.where(F.col("value").isNotNull() & ~F.col("field").startswith("m_") & ~F.col("value").isin(*EMPTY_VALUES)).distinct()
