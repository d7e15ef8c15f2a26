"""Fingerprints: vocabulary matches, classification, severity, signature.

Vocabularies are DataFrames (ordinal, label, term, weight); phrases are found by joining word n-grams with them,
never by testing every phrase on every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.negation import WORD, negations
from ..functions.text import family, word_filter

# Fixed values of the fingerprint format.
VECTORS = ["phishing", "exposed_service", "stolen_credentials", "removable_media"]
TACTICS = ["reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact"]
CONFIDENCE = {"phrase": 0.75, "name": 0.85, "explicit": 0.95}
OTHER_SOURCE = 0.55
INFERRED = ["example", "llm"]
LEAST_NAME = 8
#: Official names that are everyday words of the trade.
COMMON_NAMES = [
    "credentials", "domains", "databases", "malware", "software", "tool", "hardware", "firmware", "exploits", "vulnerabilities", "server", "serverless", "proxy", "compression", "scripting",
    "source", "impersonation", "botnet", "at", "trap", "dll", "dns", "ssh", "cdns", "whois", "add-ins", "confluence", "sharepoint", "multi-factor authentication",
]


def negated(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, start, end): the spans of `negations`."""
    return docs.select(F.col(doc).alias("doc"), F.explode(negations(F.col(text))).alias("s")).select("doc", "s.start", "s.end")


def phrase_hits(docs: DataFrame, vocabulary: DataFrame, doc: str, text: str, only_affirmed: bool = False) -> DataFrame:
    """(doc, ordinal, label, term, weight, …, at): places where a term of the vocabulary, or its plural, is in the lower-cased text, between characters other than a-z and
    digits. at counts words, from 1.

    A text is words with what stands behind each. A filter of bounded size, made of the terms' first words, picks the words that may begin a term, in the row; only these
    become rows, with as many words behind them as the longest term has, and are joined with the first words of the terms. So few rows are made, none is shuffled while the
    vocabulary is small, and terms may be of any length and hold any punctuation (but before their first letter or digit). `only_affirmed` leaves out what the text denies (see
    `negations`)."""
    terms = vocabulary.withColumn("_term", F.regexp_replace(F.lower("term"), "^[^a-z0-9]+", "")).where("_term <> ''")
    terms = terms.withColumn("_first", F.regexp_extract("_term", WORD, 0))
    # A term's last word may stand in its plural, which is then the first word of a one-word term.
    single = F.col("_first") == F.col("_term")
    forms = terms.withColumn("_first", F.explode(F.when(single, F.array("_first", F.concat("_first", F.lit("s")), F.concat("_first", F.lit("es")))).otherwise(F.array("_first"))))
    begins = word_filter(forms.select("_first"))
    longest = terms.agg(F.max(F.size(F.regexp_extract_all("_term", F.lit(WORD), F.lit(0))))).first()[0] or 0
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"{WORD}[^a-z0-9]*"), F.lit(0))
    denied = [negations(F.col(text)).alias("_denied")] if only_affirmed else []
    # The spans are made before the words are rows, once a text.
    texts = docs.select(F.col(doc).alias("doc"), *denied, pieces.alias("_pieces"))
    words = F.transform("_pieces", lambda p, i: F.struct(i.alias("i"), F.regexp_extract(p, WORD, 0).alias("word")))
    spots = F.transform(F.filter(words, lambda w: begins(w["word"])), lambda w: F.struct(w["i"].alias("i"), w["word"].alias("word"), F.array_join(F.slice("_pieces", w["i"] + 1, longest + 1), "").alias("ahead")))
    rows = texts.select(*(c for c in texts.columns if c != "_pieces"), F.explode(spots).alias("_s")).select("*", F.col("_s.word").alias("_first"), F.col("_s.ahead").alias("_ahead"), (F.col("_s.i") + 1).cast("long").alias("_at"))
    hits = rows.join(forms, "_first").where(F.startswith("_ahead", "_term") & ~F.substr("_ahead", F.length("_term") + 1).rlike("^(?!(?:e?s)?(?:[^a-z0-9]|$))"))
    if only_affirmed:
        hits = hits.where(~F.exists("_denied", lambda s: (F.col("_at") >= s["start"]) & (F.col("_at") < s["end"])))
    return hits.select("doc", *vocabulary.columns, F.col("_at").alias("at"))


def affirmed(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits that start in no negated span (an interval anti-join within the document)."""
    inside = hits.join(spans, "doc").where("at >= start and at < end").select("doc", "ordinal", "at").distinct()
    return hits.join(inside, ["doc", "ordinal", "at"], "left_anti")


def label_scores(hits: DataFrame) -> DataFrame:
    """(doc, label, score, terms, ordinal): summed weights and number of the distinct terms of a label."""
    once = hits.groupBy("doc", "label", "term").agg(F.max("weight").alias("weight"), F.min("ordinal").alias("ordinal"))
    return once.groupBy("doc", "label").agg(F.sum("weight").cast("long").alias("score"), F.count("*").alias("terms"), F.min("ordinal").alias("ordinal"))


def classify(scores: DataFrame, decisive: DataFrame | None = None, least: int = 4) -> DataFrame:
    """(doc, attack_type, initial_vector): outcome by decisive marker, else the best outcome from `least`, else the best of all.

    scores (doc, label, score, ordinal); labels of VECTORS are ways in, all others outcomes. Ties: the smallest ordinal. decisive
    (doc, ordinal, label): markers found; the smallest ordinal decides. Labels with the same ordinal: by name."""
    best = lambda cond: F.min_by(F.when(cond, F.col("label")), F.when(cond, F.struct((-F.col("score")).alias("s"), "ordinal", "label")))
    way_in = F.col("label").isin(VECTORS)
    found = scores.groupBy("doc").agg(best(~way_in & (F.col("score") >= least)).alias("outcome"), best(F.lit(True)).alias("top"), best(way_in).alias("vector"))
    if decisive is not None:
        found = found.join(decisive.groupBy("doc").agg(F.min_by("label", F.struct("ordinal", "label")).alias("sign")), "doc", "left")
    else:
        found = found.withColumn("sign", F.lit(None).cast("string"))
    return found.select("doc", F.coalesce("sign", "outcome", "top").alias("attack_type"), F.coalesce("vector", F.lit("unknown")).alias("initial_vector"))


def add_hints(scores: DataFrame, techniques: DataFrame, hints: DataFrame) -> DataFrame:
    """Scores with the weight of hints (family, label, weight) for observed techniques (doc, technique, confidence): 2 less, 1 at least, below a confidence of .7."""
    seen = techniques.withColumn("family", family(F.col("technique"))).join(hints, "family")
    weight = F.when(F.col("confidence") < 0.7, F.greatest(F.lit(1), F.col("weight") - 2)).otherwise(F.col("weight")).cast("long")
    more = seen.select("doc", "label", weight.alias("score"))
    return scores.select("doc", "label", "score").union(more).groupBy("doc", "label").agg(F.sum("score").alias("score"))


def confidence(sources: Column, n_evidence: Column) -> Column:
    """Confidence of a mapping: that of its best source that quotes the report, .05 more if an inferred source (INFERRED) agrees; of inferred sources alone .60, of both
    .65; .03 for each further piece of evidence, .98 at most."""
    quoted = F.array_except(sources, F.array(*map(F.lit, INFERRED)))
    inferred = F.size(sources) - F.size(quoted)
    best = F.array_max(F.transform(quoted, lambda s: F.coalesce(*[F.when(s == n, F.lit(c)) for n, c in CONFIDENCE.items()], F.lit(OTHER_SOURCE))))
    base = F.when(F.size(quoted) > 0, best + F.when(inferred > 0, 0.05).otherwise(0.0)).when(inferred > 1, 0.65).when(inferred > 0, 0.60).otherwise(OTHER_SOURCE)
    return F.round(F.least(F.least(base, F.lit(0.98)) + 0.03 * (n_evidence - 1), F.lit(0.98)), 2)


def technique_facts(facts: DataFrame) -> DataFrame:
    """(doc, technique, sources, evidence, n_evidence, confidence) of single facts (doc, technique, source, evidence, ord).

    A parent goes where a sub-technique of it was found, unless it was named explicitly. Evidence is distinct, in the order
    of discovery. See `confidence`."""
    subs = facts.where(F.col("technique").contains(".")).select("doc", family(F.col("technique")).alias("technique")).distinct().withColumn("sub", F.lit(True))
    named = facts.where("source = 'explicit'").select("doc", "technique").distinct().withColumn("named", F.lit(True))
    kept = facts.join(subs, ["doc", "technique"], "left").join(named, ["doc", "technique"], "left").where("sub is null or named").drop("sub", "named")
    first = kept.groupBy("doc", "technique", "evidence").agg(F.min("ord").alias("ord"), F.collect_set("source").alias("sources"))
    rows = first.groupBy("doc", "technique").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence"))), lambda x: x["evidence"]).alias("evidence"),
    )
    evidence = F.filter("evidence", lambda e: e.isNotNull())
    return rows.select("doc", "technique", F.array_join("sources", ",").alias("sources"), F.array_join(evidence, " / ").alias("evidence"), F.size(evidence).cast("long").alias("n_evidence"), confidence(F.col("sources"), F.size(evidence)).alias("confidence"))


def with_suggestions(facts: DataFrame, suggestions: DataFrame, first_ord: int = 1 << 40) -> DataFrame:
    """Facts with the suggestions (doc, technique, evidence, place) of a learned mapper, as source example.

    Where a rule found a technique of the family already, a suggestion adds nothing, but its agreement (no evidence) if it is the same technique. Of two suggestions of
    a family, the first by place stays."""
    known = facts.select("doc", "technique").distinct()
    families = known.select("doc", family(F.col("technique")).alias("family")).distinct()
    rows = suggestions.withColumn("family", family(F.col("technique")))
    order = Window.partitionBy("doc", "family").orderBy("place", "technique")
    new = rows.join(families, ["doc", "family"], "left_anti").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    place = (F.lit(first_ord) + F.col("place")).cast("long").alias("ord")
    new = new.select("doc", "technique", F.lit("example").alias("source"), "evidence", place)
    agreed = rows.join(known, ["doc", "technique"], "left_semi").select("doc", "technique", F.lit("example").alias("source"), F.lit(None).cast("string").alias("evidence"), place)
    return facts.select("doc", "technique", "source", "evidence", "ord").unionByName(new).unionByName(agreed)


def owned_names(techniques: DataFrame, aliases: DataFrame, least: int = LEAST_NAME, stop: list[str] = COMMON_NAMES) -> DataFrame:
    """(ordinal, label, term, weight, source): one vocabulary of the curated phrases (aliases: ordinal, label, term, weight) and of the official names (techniques:
    ordinal, technique, name), for `phrase_hits`.

    Names under `least` characters and those that are everyday words of the trade are left out, and so are names that the curated phrases have given to another
    technique: of several owners of a phrase, the last by ordinal. Names come after all phrases."""
    owners = aliases.groupBy(F.lower("term").alias("phrase")).agg(F.max_by("label", F.struct("ordinal", "label")).alias("owner"))
    names = techniques.where((F.length("name") >= least) & ~F.lower("name").isin(stop)).withColumn("phrase", F.lower("name"))
    taken = (names["phrase"] == owners["phrase"]) & (names["technique"] != owners["owner"])
    names = names.join(owners, taken, "left_anti")
    own = aliases.select(F.col("ordinal").cast("long").alias("ordinal"), "label", "term", F.col("weight").cast("int").alias("weight"), F.lit("phrase").alias("source"))
    return own.unionByName(names.select((F.col("ordinal") + (1 << 32)).cast("long").alias("ordinal"), F.col("technique").alias("label"), F.col("name").alias("term"), F.lit(0).cast("int").alias("weight"), F.lit("name").alias("source")))


def tactic_order(tactics: Column) -> Column:
    """Distinct tactics in kill-chain order, unknown ones last by name."""
    rank = lambda t: F.coalesce(*[F.when(t == n, F.lit(i)) for i, n in enumerate(TACTICS)], F.lit(len(TACTICS)))
    pairs = F.array_sort(F.transform(F.array_distinct(tactics), lambda t: F.struct(rank(t).alias("r"), t.alias("t"))))
    return F.transform(pairs, lambda x: x["t"])


def severity(impact_weight: Column, known_exploited: Column, techniques: Column, foothold: Column) -> Column:
    """Band of impacts + 3 if a known exploited CVE + a third of the techniques (3 at most); a foothold is medium at least."""
    points = impact_weight + F.when(known_exploited, 3).otherwise(0) + F.least(F.lit(3), F.floor(techniques / 3))
    return F.when(points >= 9, "critical").when(points >= 6, "high").when((points >= 3) | foothold, "medium").otherwise("low")


def signature(facts: DataFrame, doc: str, attack: str, rank: str, technique: str, most: int = 6) -> DataFrame:
    """(doc, signature): TYPE | rank:technique > … of the first `most` techniques by rank, then order of id. A document has one `attack`; its rows are brought together once."""
    first = F.slice(F.array_sort(F.collect_set(F.struct(F.col(rank).alias("rank"), F.col(technique).alias("technique")))), 1, most)
    chain = F.array_join(F.transform(first, lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["technique"])), " > ")
    return facts.groupBy(doc, attack).agg(chain.alias("c")).select(doc, F.concat(F.upper(F.coalesce(attack, F.lit("unknown"))), F.lit(" | "), "c").alias("signature"))


def signature_text(attack: Column, techniques: Column, impacts: Column, most: int = 6, harms: int = 4) -> Column:
    """TYPE | tactic:technique > … | impact:a+b of techniques (array of structs confidence, technique, rank, tactic) and impacts.

    The `most` surest techniques (ties by id) in kill-chain order; none: no-techniques; one without a tactic counts as unmapped and comes last."""
    surest = F.slice(F.array_sort(F.transform(techniques, lambda t: F.struct((-t["confidence"]).alias("c"), t["technique"].alias("t"), t["rank"].alias("r"), t["tactic"].alias("n")))), 1, most)
    order = F.array_sort(F.transform(surest, lambda t, i: F.struct(F.coalesce(t["r"], F.lit(1 << 30)).alias("r"), i.alias("i"), F.concat(F.coalesce(t["n"], F.lit("unmapped")), F.lit(":"), t["t"]).alias("step"))))
    chain = F.array_join(F.transform(order, lambda t: t["step"]), " > ")
    harm = F.array_join(F.slice(impacts, 1, harms), "+")
    some = lambda text, none: F.when(text != "", text).otherwise(none)
    return F.concat(F.upper(F.coalesce(attack, F.lit("unknown"))), F.lit(" | "), some(F.coalesce(chain, F.lit("")), "no-techniques"), F.lit(" | impact:"), some(F.coalesce(harm, F.lit("")), "none"))


def enriched(own: dict[str, Column], extra: dict[str, Column], types: list[str], impacts: list[str]) -> dict[str, Column]:
    """attack_type, initial_vector and impacts of the rules with what an enrichment adds: a type only where the rules have none and only a known one, the way in with it
    where it is one, known impacts behind the rules' own."""
    open_ = (F.coalesce(own["attack_type"], F.lit("unknown")) == "unknown") & F.coalesce(extra["attack_type"].isin(types), F.lit(False))
    vector = F.coalesce(own["initial_vector"], F.lit("unknown"))
    more = F.filter(F.coalesce(extra["impacts"], F.array().cast("array<string>")), lambda x: x.isin(impacts))
    return {
        "attack_type": F.when(open_, extra["attack_type"]).otherwise(F.coalesce(own["attack_type"], F.lit("unknown"))),
        "initial_vector": F.when(open_ & (vector == "unknown") & extra["attack_type"].isin(VECTORS), extra["attack_type"]).otherwise(vector),
        "impacts": F.array_distinct(F.concat(F.coalesce(own["impacts"], F.array().cast("array<string>")), more)),
    }


def broken_invariants(techniques: Column, impacts: Column, embedded: Column, known: list[str]) -> Column:
    """What a stored fingerprint must never show, as texts: techniques (array of structs technique, evidence) with an id of another form or without evidence, unknown impacts, and
    redaction tokens or mail addresses in the text that is vectorised."""
    ids = F.transform(F.filter(techniques, lambda t: ~F.coalesce(t["technique"].rlike(r"^T\d{4}(?:\.\d{3})?\z"), F.lit(False))), lambda t: F.concat(F.lit("invalid technique id: "), F.coalesce(t["technique"], F.lit(""))))
    bare = F.transform(F.filter(techniques, lambda t: F.coalesce(t["evidence"], F.lit("")) == ""), lambda t: F.concat(F.coalesce(t["technique"], F.lit("")), F.lit(" has no supporting evidence")))
    harms = F.transform(F.filter(impacts, lambda x: ~x.isin(known)), lambda x: F.concat(F.lit("unknown impact: "), x))
    text = F.coalesce(embedded, F.lit(""))
    shown = F.when(text.contains("REDACTED"), F.array(F.lit("embedding_text contains redaction tokens"))).otherwise(F.array().cast("array<string>"))
    mail = F.when(text.rlike(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"), F.array(F.lit("embedding_text contains an email address"))).otherwise(F.array().cast("array<string>"))
    return F.concat(ids, bare, harms, shown, mail)


def embedding_text(attack: Column, vector: Column, techniques: Column, impacts: Column) -> Column:
    """The only text that is ever vectorised: labels of closed vocabularies in a fixed template."""
    return F.format_string("type %s; entry %s; techniques %s; impact %s", attack, vector, F.array_join(techniques, " "), F.array_join(impacts, " "))


def summary(attack: Column, vector: Column, techniques: Column) -> Column:
    return F.format_string("A %s incident entered through %s and used %s technique(s).", F.translate(attack, "_-", "  "), F.translate(vector, "_-", "  "), techniques.cast("string"))


def enrich_cves(cves: DataFrame, kev: DataFrame) -> DataFrame:
    """CVEs (doc, cve) with their catalogue record, unmatched ones flagged and kept."""
    return cves.join(kev.withColumn("known_exploited", F.lit(True)), "cve", "left").withColumn("known_exploited", F.coalesce("known_exploited", F.lit(False)))


def kev_summary(enriched: DataFrame) -> DataFrame:
    """(doc, total, known, urgency): critical with a known exploited CVE, review with any, none without."""
    sums = enriched.groupBy("doc").agg(F.count("cve").alias("total"), F.count_if("known_exploited").alias("known"))
    return sums.withColumn("urgency", F.when(F.col("known") > 0, "critical").when(F.col("total") > 0, "review").otherwise("none"))


def violations(attack: Column, severity_: Column, confidence: Column, evidence: Column, allowed: list[str], bands: list[str]) -> Column:
    """Names of the expectations that a fingerprint breaks."""
    checks = {
        "attack_type missing": attack.isNull(),
        "attack_type unknown": attack.isNotNull() & ~attack.isin(allowed),
        "severity unknown": ~F.coalesce(severity_, F.lit("")).isin(bands),
        "confidence out of range": ~F.coalesce(confidence.between(0, 1), F.lit(False)),
        "technique without evidence": F.coalesce(evidence, F.lit(0)) < 1,
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def merge_enrichment(own: Column, extra: Column) -> Column:
    """The rules' value where there is one; enrichment only adds."""
    return F.coalesce(F.nullif(own, F.lit("unknown")), extra, F.lit("unknown"))


def family_bonus(scores: DataFrame, hits: DataFrame, label: str = "ransomware", bonus: int = 4) -> DataFrame:
    """Scores (doc, label, score) with `bonus` more for `label` where a text names a catalogued family: once, however many; hits (doc) of their names."""
    more = hits.select("doc").distinct().select("doc", F.lit(label).alias("label"), F.lit(bonus).cast("long").alias("score"))
    return scores.select("doc", "label", "score").union(more).groupBy("doc", "label").agg(F.sum("score").alias("score"))


def title(attack: Column, vector: Column) -> Column:
    """The title under which an incident is shared: its type, and its way in where that is known and another."""
    entry = F.coalesce(vector, F.lit("unknown"))
    via = F.when(~entry.isin("unknown", "") & (entry != attack), F.concat(F.lit(" via "), F.replace(entry, F.lit("_"), F.lit(" ")))).otherwise("")
    return F.concat(F.initcap(F.replace(attack, F.lit("_"), F.lit(" "))), via)


def dated_title(attack: Column, day: Column) -> Column:
    """The title of an incident that has none: its type and the day."""
    return F.concat(F.initcap(F.replace(attack, F.lit("_"), F.lit(" "))), F.lit(" ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")"))
