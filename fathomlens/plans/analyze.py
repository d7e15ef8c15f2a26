"""The whole analysis as one plan, and an engine object with one method for each verb.

Reports in, fingerprints, similar incidents and a ranked response out. Every stage is an operator of this library; nothing
is collected in between. Vocabularies and knowledge are DataFrames that the caller loads (see `sources`)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CVE, TECHNIQUE, extract_ids
from ..operators import actions, catalog, fingerprint, indicators, mapper, memory, names, overview, privacy
from ..sources.sinks import staged


@dataclass
class Knowledge:
    """vocabulary (ordinal, label, term, weight): types and ways in. techniques (ordinal, label = technique id, term, weight, rank): phrases and, with rank of
    the tactic, names. Optional: hints (family, label, weight), families (ordinal, term): names that mean ransomware, decisive (ordinal, label, term), impacts
    (ordinal, label, term, weight), kev (cve, …): known exploited, lexicon (see operators.names) for names without a shape, examples: a fitted mapper (see
    operators.mapper.fit), official (ordinal, technique, name): names of techniques, searched as far as no curated phrase has them (see fingerprint.owned_names)."""

    vocabulary: DataFrame
    techniques: DataFrame
    hints: DataFrame | None = None
    families: DataFrame | None = None
    decisive: DataFrame | None = None
    impacts: DataFrame | None = None
    kev: DataFrame | None = None
    lexicon: DataFrame | None = None
    examples: mapper.ExampleIndex | None = None
    official: DataFrame | None = None

    def terms(self) -> DataFrame:
        """All phrases that a report is searched for at once: (ordinal, label, term, weight, source, kind)."""
        phrases = self.techniques if self.official is None else fingerprint.owned_names(self.official, self.techniques)
        kinds = {"type": self.vocabulary, "technique": phrases, "family": self.families, "decisive": self.decisive, "impact": self.impacts}
        column = lambda df, c, kind: F.col(c).cast(kind).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c)
        each = [df.select(column(df, "ordinal", "long"), column(df, "label", "string"), "term", column(df, "weight", "int"), column(df, "source", "string"), F.lit(k).alias("kind")) for k, df in kinds.items() if df is not None]
        return reduce(DataFrame.union, each)


def sanitized(rows: DataFrame, lexicon: DataFrame | None, doc: str = "doc", text: str = "text") -> DataFrame:
    """`rows` with sanitized, entities, residuals and names_checked. With a lexicon, names are taken out too, and the check knows the same words; without one it
    says nothing of names."""
    if lexicon is None:
        return privacy.self_check(privacy.redact(rows, text)).withColumn("names_checked", F.lit(False))
    safe = staged(names.sanitize(rows, lexicon, doc, text, staged))
    return names.self_check(safe, lexicon, doc, staged).withColumn("names_checked", F.lit(True))


def fingerprints(reports: DataFrame, knowledge: Knowledge, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sanitized, clean, attack_type, initial_vector, severity, techniques, tactics, cves, impacts, title, embedding_text) of every report; `doc` must be unique.

    Text is sanitised and checked first; everything else is taken from the sanitised text, which is searched once for all phrases. Techniques are those
    named by id or by an affirmed phrase; their families, names of ransomware and decisive markers weigh in the type; severity counts impacts, known exploited
    CVEs and techniques. A report without any hit has the type unknown, no techniques and severity low."""
    rows = reports.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    checked = staged(sanitized(rows, knowledge.lexicon).select("doc", "sanitized", "residuals"))  # matching and assembly read it several times
    hits = staged(fingerprint.phrase_hits(checked, knowledge.terms(), "doc", "sanitized", only_affirmed=True))
    of = lambda kind: hits.where(F.col("kind") == kind)

    named = checked.select("doc", F.posexplode(extract_ids(F.col("sanitized"), TECHNIQUE)).alias("ord", "technique"))
    explicit = named.select("doc", "technique", F.lit("explicit").alias("source"), F.concat(F.lit("explicit id "), "technique").alias("evidence"), F.col("ord").cast("long").alias("ord"))
    phrases = of("technique").select("doc", F.col("label").alias("technique"), F.coalesce("source", F.lit("phrase")).alias("source"), F.col("term").alias("evidence"), (F.col("at") + 1_000_000).alias("ord"))
    single = explicit.unionByName(phrases)
    if knowledge.examples is not None:
        single = staged(single)
        single = fingerprint.with_suggestions(single, mapper.suggestions(checked, knowledge.examples, staged, "doc", "sanitized"))
    facts = staged(fingerprint.technique_facts(single))

    first = fingerprint.label_scores(of("type"))
    scores = first.select("doc", "label", "score")
    if knowledge.hints is not None:
        scores = fingerprint.add_hints(scores, facts.select("doc", "technique", "confidence"), knowledge.hints)
    if knowledge.families is not None:
        scores = fingerprint.family_bonus(scores, of("family"))
    # A label that only a hint or a family brings comes after those of phrases, by name.
    scores = scores.join(first.select("doc", "label", "ordinal"), ["doc", "label"], "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(1 << 30)))
    marks = of("decisive").select("doc", "ordinal", "label") if knowledge.decisive is not None else None
    types = fingerprint.classify(scores, marks)
    ranks = knowledge.techniques.groupBy(F.col("label").alias("technique")).agg(F.min("rank").alias("rank"))
    order = F.array(*map(F.lit, fingerprint.TACTICS))
    sets = facts.join(ranks, "technique", "left").groupBy("doc").agg(F.array_sort(F.collect_set("technique")).alias("techniques"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    found = of("impact").groupBy("doc", "label").agg(F.max("weight").alias("weight"), F.count_distinct("term").alias("n"))
    harm = found.groupBy("doc").agg(F.sum("weight").alias("harm"), F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))), lambda x: x["label"]).alias("impacts"))

    cves = checked.select("doc", extract_ids(F.col("sanitized"), CVE).alias("cves"))
    rows = checked.join(cves, "doc").join(types, "doc", "left").join(sets, "doc", "left").join(harm, "doc", "left")
    known = F.lit(False)
    if knowledge.kev is not None:
        exploited = fingerprint.enrich_cves(cves.select("doc", F.explode("cves").alias("cve")), knowledge.kev).groupBy("doc").agg(F.max("known_exploited").alias("exploited"))
        rows, known = rows.join(exploited, "doc", "left"), F.coalesce("exploited", F.lit(False))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "attack_type": F.coalesce("attack_type", F.lit("unknown")),
        "initial_vector": F.coalesce("initial_vector", F.lit("unknown")),
        "techniques": F.coalesce("techniques", none),
        "tactics": F.transform(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: F.element_at(order, (r + 1).cast("int"))),
        "impacts": F.coalesce("impacts", none),
        "harm": F.coalesce("harm", F.lit(0)),
    })
    level = fingerprint.severity(F.col("harm"), known, F.size("techniques"), F.col("initial_vector") != "unknown")
    return rows.select(
        "doc", "sanitized", (F.size("residuals") == 0).alias("clean"), "attack_type", "initial_vector", level.alias("severity"), "techniques", "tactics", "cves", "impacts",
        fingerprint.title(F.col("attack_type"), F.col("initial_vector")).alias("title"),
        fingerprint.embedding_text(F.col("attack_type"), F.col("initial_vector"), F.col("techniques"), F.col("impacts")).alias("embedding_text"),
    )


def similar(asked: DataFrame, stored: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar stored fingerprints of each asked one by hybrid score: (query, doc, score, structure, hybrid, place, …)."""
    semantic = memory.tfidf_scores(asked.select("doc", "embedding_text"), stored.select("doc", "embedding_text"), "doc", "doc", "embedding_text", staged).where("query <> doc")
    a = asked.select(F.col("doc").alias("query"), *[F.col(c).alias(f"a_{c}") for c in ("techniques", "tactics", "attack_type", "initial_vector", "cves")])
    pairs = memory.top_k(semantic, max(3 * k, 10)).select("query", "doc").join(a, "query").join(stored, "doc")
    both = lambda c: (F.col(f"a_{c}"), F.col(c))
    structure = F.round(memory.structural_score(both("techniques"), both("tactics"), both("attack_type"), both("initial_vector"), both("cves")), 4)
    return memory.hybrid(semantic, pairs.select("query", "doc", structure.alias("structure")), k)


class Engine:
    """Verbs over a store of two Parquet tables under `root`; the search memory is derived from them on every call."""

    def __init__(self, spark: SparkSession, knowledge: Knowledge, incidents: DataFrame, actions_: DataFrame):
        self.spark, self.knowledge, self.incidents, self.actions = spark, knowledge, incidents, actions_

    def sanitize(self, reports: DataFrame) -> DataFrame:
        return sanitized(reports, self.knowledge.lexicon, "doc_id")

    def analyze(self, reports: DataFrame) -> DataFrame:
        return fingerprints(reports, self.knowledge)

    def search(self, reports: DataFrame, k: int = 5) -> DataFrame:
        return similar(self.analyze(reports), self.incidents, k)

    def respond(self, reports: DataFrame, k: int = 5) -> DataFrame:
        """Ranked actions of the similar incidents of each report."""
        matches = self.search(reports, k).select("query", F.col("doc").alias("incident_id"), F.col("hybrid").alias("similarity"), "place")
        return actions.roll_up(matches, self.actions)

    def contribute(self, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new incidents to append, refused ones): clean fingerprints that are not stored yet, dated by month only."""
        rows = self.analyze(reports)
        new = rows.where("clean").join(self.incidents.select("embedding_text", "sanitized").distinct(), ["embedding_text", "sanitized"], "left_anti")
        return new.withColumn("shared_at", F.date_trunc("month", F.current_timestamp())), rows.where("not clean")

    def indicators(self, reports: DataFrame) -> DataFrame:
        return indicators.profile(reports, "doc_id", "text")

    def delete(self, ids: DataFrame) -> None:
        self.incidents, self.actions = self.incidents.join(ids.select(F.col("incident_id").alias("doc")), "doc", "left_anti"), self.actions.join(ids, "incident_id", "left_anti")

    def get(self, ids: DataFrame) -> DataFrame:
        return catalog.public_view(ids.select(F.col("incident_id").alias("doc")).join(self.incidents, "doc"))

    def stats(self) -> DataFrame:
        return overview.breakdowns(self.incidents, ["attack_type", "initial_vector", "severity"])
