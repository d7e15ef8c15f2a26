"""Readers of incident corpora and threat knowledge, and projections of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = "incidents array<struct<incident_id bigint, title string, text string, mitigations array<struct<position bigint, category string, action string>>>>"
#: The reference source that names techniques and controls in threat-knowledge bundles.
SOURCE = "mitre-attack"


def parse_corpus(documents: DataFrame, provenance: str, value: str = "value") -> DataFrame:
    """(incident_id, position, category, action, provenance) of JSON texts {"incidents": […]}; broken ones give no rows."""
    parsed = documents.select(F.explode(F.from_json(value, T._parse_datatype_string(CORPUS))["incidents"]).alias("i"))
    return parsed.select("i.incident_id", F.explode("i.mitigations").alias("m")).select("incident_id", "m.*", F.lit(provenance).alias("provenance"))


def read_corpus(spark: SparkSession, path: str, provenance: str) -> DataFrame:
    """`parse_corpus` of whole JSON files, also gzipped ones; an absent path gives no rows."""
    return parse_corpus(optional(spark, path, "value string", "text"), provenance)


def optional(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """A layer that may be absent: no rows then. Whatever reads the path, it is asked by Spark, so it may be in any store."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format(form).options(wholetext=True, multiLine=True).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def required(spark: SparkSession, path: str, schema: str, remedy: str) -> DataFrame:
    """A layer that must be there; its absence is an error that says what to do."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} is missing; {remedy}") from e


#: Kinds of nodes, the first letter of their codes, and how much of a description is kept.
PREFIXES = {"attack-pattern": "T", "course-of-action": "M", "intrusion-set": "G", "malware": "S", "tool": "S", "campaign": "C"}
CLIPS = {"course-of-action": 600, "intrusion-set": 400, "malware": 300, "tool": 300, "campaign": 300}
_OPTIONAL = {"x_mitre_deprecated": "boolean", "revoked": "boolean", "description": "string", "aliases": "array<string>", "first_seen": "string", "last_seen": "string"}


def _whole(objects: DataFrame) -> DataFrame:
    """Objects with all columns that a bundle may leave out."""
    return objects.withColumns({c: F.lit(None).cast(kind) for c, kind in _OPTIONAL.items() if c not in objects.columns})


def _active() -> Column:
    return ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))


def _code() -> Column:
    return F.get(F.filter("external_references", lambda r: r["source_name"] == SOURCE), F.lit(0))["external_id"]


def nodes(objects: DataFrame, *kinds: str) -> DataFrame:
    """(id, kind, code, name, description, aliases, first_seen, last_seen) of the active objects of some kinds that have a code of their kind. Revoked and deprecated ones are gone,
    and so are codes of another kind, as older bundles have."""
    rows = _whole(objects).where(F.col("type").isin(list(kinds)) & _active()).withColumn("code", _code())
    limit = F.coalesce(*[F.when(F.col("type") == k, F.lit(n)) for k, n in CLIPS.items()], F.lit(600))
    letter = F.coalesce(*[F.when(F.col("type") == k, F.lit(c)) for k, c in PREFIXES.items()])
    kept = rows.where(F.col("code").isNotNull() & F.startswith("code", letter))
    clean = F.trim(F.coalesce("description", F.lit("")))
    short = F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.left(clean, limit)), F.lit("...")))
    return kept.select("id", F.col("type").alias("kind"), "code", "name", short.alias("description"), "aliases", "first_seen", "last_seen")


def edges(objects: DataFrame, kind: str) -> DataFrame:
    """(source_ref, target_ref, description) of the active relationships of a kind, each once."""
    rows = _whole(objects).where((F.col("type") == "relationship") & (F.col("relationship_type") == kind) & _active())
    return rows.select("source_ref", "target_ref", "description").distinct()


def techniques(objects: DataFrame) -> DataFrame:
    """(id, technique, name) of the active attack patterns of a bundle."""
    return nodes(objects, "attack-pattern").select("id", F.col("code").alias("technique"), "name")


def controls_of(objects: DataFrame) -> DataFrame:
    """(control, technique): which active control mitigates which active technique, by the bundle's relationships."""
    left = nodes(objects, "course-of-action").select(F.col("id").alias("source_ref"), F.col("code").alias("control"))
    right = techniques(objects).select(F.col("id").alias("target_ref"), "technique")
    return edges(objects, "mitigates").join(left, "source_ref").join(right, "target_ref").select("control", "technique").distinct()


def _with_techniques(objects: DataFrame, rows: DataFrame, relation: str) -> DataFrame:
    """`rows` (id, …) with the sorted codes of the active techniques that their relationships lead to; none: an empty list."""
    right = techniques(objects).select(F.col("id").alias("target_ref"), "technique")
    found = edges(objects, relation).join(right, "target_ref").groupBy(F.col("source_ref").alias("id")).agg(F.array_sort(F.collect_set("technique")).alias("techniques"))
    return rows.join(found, "id", "left").withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>")))


def mitigations(objects: DataFrame) -> DataFrame:
    """(code, name, description, techniques) of the active controls, also of those that are linked with nothing."""
    return _with_techniques(objects, nodes(objects, "course-of-action"), "mitigates").select("code", "name", "description", "techniques")


def groups(objects: DataFrame) -> DataFrame:
    """(code, name, aliases, description, techniques) of the active groups that use a technique: others can't be compared with anything."""
    rows = _with_techniques(objects, nodes(objects, "intrusion-set"), "uses").where(F.size("techniques") > 0)
    return rows.select("code", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "description", "techniques")


def software(objects: DataFrame) -> DataFrame:
    """(code, name, kind, description, techniques) of the active malware and tools that use a technique."""
    return _with_techniques(objects, nodes(objects, "malware", "tool"), "uses").where(F.size("techniques") > 0).select("code", "name", "kind", "description", "techniques")


def campaigns(objects: DataFrame) -> DataFrame:
    """(code, name, description, first_seen, last_seen, attributed_to, attributed_to_name, techniques) of the active campaigns.

    A campaign belongs to whom its attribution names, active or not; of several, the one with the largest id."""
    actors = _whole(objects).where("type <> 'relationship'").select(F.col("id").alias("target_ref"), _code().alias("attributed_to"), F.col("name").alias("attributed_to_name"))
    owner = edges(objects, "attributed-to").groupBy(F.col("source_ref").alias("id")).agg(F.max("target_ref").alias("target_ref"))
    rows = _with_techniques(objects, nodes(objects, "campaign"), "uses").join(owner, "id", "left").join(actors, "target_ref", "left")
    return rows.select("code", "name", "description", "first_seen", "last_seen", "attributed_to", "attributed_to_name", "techniques")


def bundle_examples(objects: DataFrame, least: int = 4) -> DataFrame:
    """(ordinal, technique, source, name, sentence): how active groups, software and campaigns used active techniques, in the words of the relationships; `least` words or more.

    Ordinals count from 1 in the order of technique, source, name and sentence: within a technique by a window, and after all techniques before it."""
    left = nodes(objects, "intrusion-set", "malware", "tool", "campaign").select(F.col("id").alias("source_ref"), F.col("code").alias("source"), "name")
    right = techniques(objects).select(F.col("id").alias("target_ref"), "technique")
    said = edges(objects, "uses").join(left, "source_ref").join(right, "target_ref")
    rows = said.select("technique", "source", "name", clean_example(F.coalesce("description", F.lit(""))).alias("sentence")).where(F.size(F.split("sentence", " ")) >= least)
    sizes = rows.groupBy("technique").agg(F.count("*").alias("n"))  # one row for each technique
    before = sizes.select("technique", (F.sum("n").over(Window.orderBy("technique")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("technique").orderBy("source", "name", "sentence"))
    return rows.join(before, "technique").select((F.col("before") + place).cast("long").alias("ordinal"), "technique", "source", "name", "sentence")


def clean_example(text):
    """A procedure sentence without citations, link targets and code tags, single-spaced."""
    for pattern, to in ((r"\(Citation:[^)]*\)", ""), (r"\[([^\]]+)\]\(https?://[^)]+\)", "$1"), (r"</?code>", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def procedure_examples(edges: DataFrame, least: int = 4) -> DataFrame:
    """(technique, source, sentence) of described uses (technique, source, description) of `least` words or more."""
    rows = edges.select("technique", "source", clean_example(F.col("description")).alias("sentence"))
    return rows.where(F.size(F.split("sentence", " ")) >= least).distinct()


def keyed(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row for each key: the last by ordinal."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(key, "r.*")


def line_actions(docs: DataFrame, text: str) -> DataFrame:
    """One response action for each line of three characters or more, category contain."""
    lines = docs.withColumn("action", F.explode(F.transform(F.split(text, "\n"), lambda x: F.trim(x))))
    return lines.where(F.length("action") >= 3).withColumn("category", F.lit("contain"))
