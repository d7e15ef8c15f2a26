"""Names without a shape: people, organisations and places, told by capital letters and a vocabulary.

Words are read in their row; only those that may be names, capitalised ones, become rows (doc, at, word, …), of which runs are windows. Vocabularies are joined. `lexicon` has a row for each word: (word, ordinary, public, given, company, sector booleans); words in lower case. Words of
several words are published names ("cobalt strike"). What it doesn't know counts as a name, so less vocabulary means more redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as v
from ..functions.text import word_filter
from . import privacy

_LETTER = "A-Za-z\\u00C0-\\u024F"
TOKEN = rf"[{_LETTER}][{_LETTER}0-9]*(?:['’-][{_LETTER}0-9]+)*|(?<![\w.-])[0-9]+[{_LETTER}]{{3,}}[{_LETTER}0-9]*"
_OPENERS = r"[ \t\"'“”‘’(\[{«]*"
_STARTS = rf"(?:[\n\r.!?:;—–•*|/]|[\p{{So}}\p{{Co}}]){_OPENERS}$|(?:^|[\n\r])[ \t]*-{_OPENERS}$|\t.?$|  $"
_BESIDE = [" ", " & ", "-"]
# Endings of inflected words, with what takes their place; and what belongs to an organisation.
ENDINGS = [("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("d", ""), ("ing", ""), ("ing", "e"), ("ly", ""), ("er", ""), ("er", "e"), ("est", ""), ("est", "e"), ("ment", ""), ("ness", ""), ("al", "")]
_OWNED = r"(?i)^(network|networks|systems|servers|employees|staff|customers|data|environment|infrastructure|domain|tenant|offices|subsidiary|soc|security|internal|corporate|production|backups?|email|payment|website|portal|operations|plants?|branches|stores|users)$"
FLAGS = ["ordinary", "public", "given", "company", "sector"]


def stems(word: Column) -> Column:
    """The words that a lower-cased word may be an inflection of, itself first; stems have four letters or more."""
    cut = []
    for ending, instead in ENDINGS:
        stem = F.concat(F.substr(word, F.lit(1), F.length(word) - len(ending)), F.lit(instead))
        single = F.substr(stem, F.lit(1), F.length(stem) - 1)  # stopped -> stop
        double = (F.length(stem) >= 5) & (F.right(stem, F.lit(1)) == F.right(single, F.lit(1)))
        ends = F.endswith(word, F.lit(ending)) & word.rlike("^[a-z]+$")
        cut += [F.when(ends & (F.length(stem) >= 4), stem), F.when(ends & double, single)]
    return F.array_compact(F.array(word, *cut))


def flags(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, ordinary, public, given, company, sector) of distinct lower-cased words.

    An inflection of an ordinary word is ordinary, a plural of a public or sector word is one; a compound with hyphens is what all its parts are
    (single letters count as ordinary, numbers as public)."""
    parts = words.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), F.split("word", "-")))).alias("part")).where("part <> ''")
    tried = parts.select("part").distinct().select("part", F.posexplode(stems(F.col("part"))).alias("n", "stem"))
    singular = (F.col("n") == 0) | (F.concat("stem", F.lit("s")) == F.col("part"))
    hits = tried.join(lexicon.select(F.col("word").alias("stem"), *FLAGS), "stem")
    own = {"ordinary": F.lit(True), "public": singular, "given": F.col("n") == 0, "company": F.col("n") == 0, "sector": singular}
    known = hits.groupBy("part").agg(*[F.max(F.coalesce(F.col(f), F.lit(False)) & when).alias(f) for f, when in own.items()])
    rows = parts.join(known, "part", "left")
    whole, none = F.col("part") == F.col("word"), F.lit(False)
    has = {f: F.coalesce(F.col(f), none) for f in FLAGS}
    has["ordinary"] |= privacy._isin(F.col("part"), v.FUNCTION_WORDS + v.GENERIC_SUBJECTS + v.PERSON_VERBS + v.ORG_VERBS)
    has["public"] |= privacy._isin(F.col("part"), v.STRUCTURE_WORDS + [x.lower() for x in v.SECURITY_ACRONYMS])
    each = {"ordinary": has["ordinary"] | has["public"] | (F.length("part") == 1), "public": has["public"] | F.col("part").rlike("^[0-9]+$")}
    out = rows.groupBy("word").agg(
        *[F.max(whole & has[f]).alias(f) for f in FLAGS],
        *[F.min(F.when(~whole, each[f])).alias(f"parts_{f}") for f in each],
    )
    compound = F.col("word").contains("-")
    return out.select("word", *[(F.col(f) | (compound & F.coalesce(f"parts_{f}", none)) if f in each else F.col(f)).alias(f) for f in FLAGS])


def _capital(token: Column) -> Column:
    """Whether a token is capitalised; one that begins with a digit, if it has a capital letter."""
    return token.rlike(r"^(?:\p{Lu}|[0-9].*\p{Lu})")


#: What a capitalised word, and the word after it, is by the lists of `vocabulary`.
_LISTS = {"function": v.FUNCTION_WORDS, "structure": v.STRUCTURE_WORDS, "generic": v.FUNCTION_WORDS + v.GENERIC_SUBJECTS, "number": v.NUMBER_WORDS, "head": v.TERM_HEADS, "acronym": [x.lower() for x in v.SECURITY_ACRONYMS]}
_NEXT = {"next_actor": v.THREAT_ACTOR_WORDS, "next_does": v.PERSON_VERBS, "next_unit": v.UNIT_WORDS, "next_acts": v.ORG_VERBS}


def tokens(docs: DataFrame, doc: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(doc, at, word, owns, after, initial, capital, grams, lists…): the capitalised words of each text, without possessives, with the gap after, whether a sentence, a bullet, a cell or a heading
    begins or is there, and a boolean for each of the lists that it, or the word after it, is in (`_LISTS`, `_NEXT`, next_owned). Rows that aren't `capital` have grams (more, gram): what
    stands, in two to five words, one of them capitalised, from a word on that begins a published name of `lexicon` as far as a filter can tell.

    All other words stay in their row, as places in its arrays. A word never goes beyond its line, so words are found line by line, and whether the line is a heading."""
    begins = word_filter(lexicon.where(F.col("word").contains(" ")).select(F.substring_index("word", " ", 1)))
    bare = lambda w: F.when(F.endswith(w, F.lit("'s")) | F.endswith(w, F.lit("’s")), F.substr(w, F.lit(1), F.length(w) - 2)).otherwise(w)
    long = lambda w: F.length(bare(w)) >= 2
    t = F.coalesce(F.col(text), F.lit(""))
    found = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), 0)
    rows = docs.select(F.col(doc).alias("doc"), F.split(t, TOKEN, -1).alias("_gaps"), F.split(t, "\n", -1).alias("_lines")).withColumn("_found", F.transform("_lines", found))

    def headed(line: Column, words: Column) -> Column:
        every = F.exists(words, _capital) & F.forall(words, lambda w: _capital(w) | _of(bare(w), v.FUNCTION_WORDS))
        return F.array_repeat((F.size(words) <= 8) & every & ~line.rlike(r"[.!?]\s*$"), F.size(words))

    rows = rows.select("doc", "_gaps", F.flatten("_found").alias("_words"), F.flatten(F.zip_with("_lines", "_found", headed)).alias("_headed"))
    places = lambda test: F.array_compact(F.transform("_words", lambda w, i: F.when(test(w), i)))
    rows = rows.select("*", places(lambda w: _capital(w) & long(w)).alias("_capital"), places(long).alias("_long"))
    word, gap = (lambda i: F.get("_words", i)), (lambda i: F.get("_gaps", i))

    def grams(j: Column) -> Column:
        part = lambda i: F.when(i.isNotNull(), F.struct(F.lower(bare(word(i))).alias("word"), gap(i + 1).isin(" ", "-").alias("joined"), _capital(word(i)).alias("capital")))

        def of(parts: Column) -> Column:
            each = [F.get(parts, F.lit(k)) for k in range(5)]
            out = []
            for n in range(1, 5):
                inside = reduce(Column.__and__, [x["joined"] for x in each[:n]]) & reduce(Column.__or__, [x["capital"] for x in each[: n + 1]])
                out.append(F.when(each[n].isNotNull() & inside, F.struct(F.lit(n).alias("more"), F.concat_ws(" ", *[x["word"] for x in each[: n + 1]]).alias("gram"))))
            return F.array_compact(F.array(*out))

        return privacy._let(F.array(*[part(F.get("_long", j + k)) for k in range(5)]), of)

    def told(i: Column, capital: bool, grams: Column) -> Column:
        texts = {"token": word(i), "before": gap(i), "after": gap(i + 1), "next": F.coalesce(word(i + 1), F.lit(""))}
        return F.struct(i.alias("at"), *[x.alias(c) for c, x in texts.items()], F.get("_headed", i).alias("heading"), F.lit(capital).alias("capital"), grams.cast("array<struct<more:int,gram:string>>").alias("grams"))

    capitals = F.transform("_capital", lambda i: told(i, True, F.lit(None)))
    named = F.transform("_long", lambda i, j: F.when(begins(F.lower(bare(word(i)))), told(i, False, grams(j))))
    # explode_outer, as explode would have the optimiser make the array twice, to leave out rows without any
    rows = rows.select("doc", F.explode_outer(F.concat(capitals, F.filter(named, lambda x: F.size(x["grams"]) > 0))).alias("x")).where("x is not null").select("doc", "x.*").withColumn("word", bare(F.col("token")))
    starts = F.col("before").rlike(_STARTS) | ((F.col("at") == 0) & F.col("before").rlike(f"^{_OPENERS}$"))
    lists = [F.lower(of).isin(words).alias(c) for of, some in (("word", _LISTS), ("next", _NEXT)) for c, words in some.items()]
    owns = (F.col("word") != F.col("token")).alias("owns")
    return rows.select("doc", "at", "word", owns, "after", (starts | F.col("heading")).alias("initial"), "capital", "grams", *lists, F.col("next").rlike(_OWNED).alias("next_owned"))


def published(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc, at): tokens that are part of a published name of two to five words, one of them capitalised."""
    found = rows.select("doc", "at", F.explode("grams").alias("g")).select("doc", "at", "g.*")
    names = lexicon.where(F.col("word").contains(" ")).select(F.col("word").alias("gram")).distinct()
    return found.join(names, "gram").select("doc", F.explode(F.sequence("at", F.col("at") + F.col("more"))).alias("at")).distinct()


def _of(column: str | Column, words: list[str]) -> Column:
    return privacy._isin(F.lower(column), words)


def classified(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Capitalised tokens with their flags and `reads`: PERSON, NAME or null, each by itself.

    Numerals, short codes, written numbers and published names are none; a given name is a person anywhere; what is public is none. A sentence's first
    word is a name if it is no ordinary word, or an ambiguous given name before what a person does; another one unless it is an ordinary word in capitals or
    before a word for a unit."""
    known = flags(rows.where("capital").select(F.lower("word").alias("word")).distinct(), lexicon)
    caps = rows.where("capital").drop("grams").join(published(rows, lexicon).withColumn("in_name", F.lit(True)), ["doc", "at"], "left").withColumn("key", F.lower("word"))
    caps = caps.join(known.withColumnRenamed("word", "key"), "key", "left").withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in (*FLAGS, "in_name")})
    roman = F.col("word").rlike("^(?=[IVXL])(?:XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")
    caps = caps.withColumn("incidental", roman | ((F.length("word") <= 4) & F.col("word").rlike("[0-9]")))
    actor = F.col("public") & (~F.col("ordinary") | F.col("next_actor"))
    # A word that is both a given name and an ordinary one is ambiguous; one that is only a given name is strong.
    strong = F.col("given") & ~F.col("ordinary")
    first = F.when(~F.col("ordinary"), "NAME").when(F.col("given") & F.col("next_does"), "PERSON")
    later = F.when(F.col("ordinary") & (F.col("next_unit") | F.col("word").rlike(r"^[^\p{Ll}]*$")), None).otherwise("NAME")
    reads = F.when(F.col("incidental") | F.col("in_name") | F.col("number") | actor, None).when(strong, "PERSON").when(F.col("public"), None).when(F.col("initial"), first).otherwise(later)
    return caps.withColumn("reads", reads).drop("key")


def _neighbours(caps: DataFrame) -> DataFrame:
    """With `joined`: whether the next capitalised token reads as part of the same name, and its columns as following_…"""
    order = Window.partitionBy("doc").orderBy("at")
    lead = lambda c: F.lead(c).over(order)
    joined = F.coalesce(lead("at") == F.col("at") + 1, F.lit(False)) & F.col("after").isin(_BESIDE) & ~F.col("owns")
    return caps.withColumns({"joined": joined, "following_sector": F.coalesce(lead("sector"), F.lit(False)), "following_public": F.coalesce(lead("public"), F.lit(False)), "following_acts": lead("next_acts"), "following_owns": lead("owns")})


def names(docs: DataFrame, doc: str, text: str, lexicon: DataFrame, stage=lambda df: df) -> DataFrame:
    """(doc, at, until, name, label): runs of tokens (from place at to until) of each text that name a person, an organisation or a place.

    `stage` may write an intermediate table that is read several times (see sources.sinks.staged). The lexicon, too, is read several times, once at once, so it had better be a table.

    1. Tokens are read one by one (`classified`). 2. A run of ordinary or public words that ends in a head of technical terms is none. 3. An ordinary
    capitalised word before a name, or before a sector word, joins it, and so on from right to left. 4. The capitalised run that opens a sentence before
    what an organisation does is one, unless it is a plural, a tool or a section word; a company is one where something of its own follows. 5. What
    was read on good evidence is the same name everywhere in the text. 6. Neighbouring parts are one name; a given name makes it a person."""
    rows = stage(tokens(docs, doc, text, lexicon))
    caps = _neighbours(classified(rows, lexicon))
    order = Window.partitionBy("doc").orderBy("at")
    back = Window.partitionBy("doc").orderBy(F.desc("at"))
    # A run's number counts the tokens that aren't joined with the one before.
    run = F.sum(F.when(F.coalesce(F.lag("joined").over(order), F.lit(False)), 0).otherwise(1)).over(order)
    caps = caps.withColumn("run", run)
    within = Window.partitionBy("doc", "run")
    plain = (F.col("ordinary") | F.col("public") | F.col("function")) & ~(F.col("given") & ~F.col("ordinary"))
    term = (F.count("*").over(within) >= 2) & F.max_by("head", "at").over(within) & F.min(plain).over(within)
    caps = caps.withColumn("term", term).withColumn("in_name", F.col("in_name") | F.col("term"))
    caps = caps.withColumn("reads", F.when(F.col("term") & (F.col("reads") == "NAME"), None).otherwise(F.col("reads")))
    caps = caps.withColumn("sure", F.col("reads").isNotNull() & ((F.col("reads") == "PERSON") | ~F.col("ordinary")))
    # 3. From right to left: within a stretch of words that can join, one joins if a name or a sector word is further right.
    able = F.col("reads").isNull() & ~F.col("incidental") & ~F.col("in_name") & F.col("ordinary") & ~F.col("public") & F.col("joined") & ~F.col("function") & ~F.col("structure")
    caps = caps.withColumn("able", able).withColumn("stretch", F.sum(F.when(F.col("able"), 0).otherwise(1)).over(back))
    ahead = Window.partitionBy("doc", "stretch").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    joins = F.col("able") & F.coalesce(F.max(F.col("reads").isNotNull() | F.col("sector")).over(ahead), F.lit(False))
    evident = F.col("following_sector") & (F.coalesce("following_acts", F.lit(False)) | F.coalesce("following_owns", F.lit(False)))
    sure = F.col("sure") | (joins & (evident | F.coalesce(F.max("sure").over(ahead), F.lit(False))))
    caps = caps.withColumns({"reads": F.when(joins, "NAME").otherwise(F.col("reads")), "sure": sure})
    # 4. Subjects of sentences, and companies that own something.
    size, first, last = F.count("*").over(within), (lambda c: F.min_by(c, "at").over(within)), (lambda c: F.max_by(c, "at").over(within))
    subject = first("initial") & last("next_acts") & ~last("owns") & ~first("generic") & (size <= 4)
    tool = last("public") & ~last("company")
    none = F.when(size == 1, (F.lower("word").endswith("s") & F.col("ordinary")) | tool).otherwise(tool & ~last("sector"))
    part = ~F.col("structure") & ~F.col("acronym") & ~((size > 1) & F.col("sector")) & ~F.col("incidental")
    owner = F.col("company") & F.col("owns") & F.col("next_owned")
    organisation = (subject & ~none & part) | (owner & F.col("reads").isNull())
    caps = caps.withColumns({"sure": F.col("sure") | organisation, "reads": F.when(organisation, F.coalesce("reads", F.lit("ORG"))).otherwise(F.col("reads"))})
    # 5. The same word again.
    everywhere = F.max(F.when(F.col("sure") & (F.length("word") > 3), F.col("reads"))).over(Window.partitionBy("doc", "word"))
    caps = caps.withColumn("reads", F.coalesce("reads", F.when(~F.col("in_name"), everywhere))).where("reads is not null")
    # 6. Neighbours.
    starts = ~F.coalesce((F.lag("at").over(order) == F.col("at") - 1) & F.lag("joined").over(order), F.lit(False))
    caps = caps.withColumn("name", F.sum(starts.cast("int")).over(order))
    spans = caps.groupBy("doc", "name").agg(F.min("at").alias("at"), F.max("at").alias("until"), F.sort_array(F.collect_list(F.struct("at", "word", "after", "reads"))).alias("parts"))
    gap = lambda x, i: F.concat(x["word"], F.when(i + 1 < F.size("parts"), x["after"]).otherwise(F.lit("")))
    label = F.when(F.exists("parts", lambda x: x["reads"] == "PERSON"), "PERSON").otherwise(F.get("parts", F.lit(0))["reads"])
    return spans.select("doc", "at", "until", F.array_join(F.transform("parts", gap), "").alias("name"), label.alias("label"))


_TOKENS = re.compile(TOKEN, re.ASCII)  # \w is ASCII in Java, too


def marked_text(text: str, spans: list[dict]) -> str:
    """The text with a mark in place of each span, from its token `at` to its token `until`; a possessive stays. Spans stand in order and apart."""
    out, last, waiting = [], 0, iter(spans)
    span = next(waiting, None)
    for i, m in enumerate(_TOKENS.finditer(text)):
        if span is None:
            break
        if i == span["at"]:
            out.append(text[last : m.start()])
        if i == span["until"]:
            out += [span["mark"], m[0][-2:] if m[0].endswith(("'s", "’s")) else ""]
            last, span = m.end(), next(waiting, None)
    return "".join([*out, text[last:]])


@F.arrow_udf(T.StringType())
def _marked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """`marked_text` of each text; those without spans stay as they are."""
    for texts, spans in batches:
        yield pa.array([marked_text(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(texts, spans)], pa.string())


def sanitize(docs: DataFrame, lexicon: DataFrame, doc: str = "doc_id", text: str = "text", stage=lambda df: df) -> DataFrame:
    """`docs` with sanitized and entities: shapes taken out first, then names; see `privacy.redact`.

    `doc` must be unique and not null. `stage` may write an intermediate table that is read twice (see sources.sinks.staged). An alias has the
    token of the full name; a name's token is numbered after those of the shapes."""
    known = privacy.vocabulary_words(docs, doc, text, lexicon, stage)
    rows = docs.join(known.withColumnRenamed("doc", doc), doc, "left")
    rows = stage(privacy.marked(rows, text, known="known").drop("known"))
    found = names(rows.select(F.col(doc).alias("doc"), F.col("_state.t").alias("t")), "doc", "t", lexicon, stage)
    found = stage(found)
    owners = privacy.unify_aliases(found.select("doc", "name", "label")).withColumnRenamed("label", "owner_label")
    spans = found.join(owners, ["doc", "name"]).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "until", F.col("owner_label").alias("label"), F.col("owner").alias("value"), "name"))).alias("_spans"))
    rows = rows.join(spans.withColumnRenamed("doc", doc), doc, "left")
    entity = lambda s: F.struct(s["label"].alias("label"), s["value"].alias("value"))
    new = F.array_except(F.transform(F.coalesce("_spans", F.array().cast("array<struct<at:int,until:int,label:string,value:string,name:string>>")), entity), F.col("_state.entities"))
    rows = rows.withColumn("_all", F.concat("_state.entities", new)).withColumn("_tokens", privacy.numbered(F.col("_all")))
    mark = lambda s: F.concat(F.lit(privacy.MARK), F.array_position("_all", entity(s)).cast("string"), F.lit(privacy.MARK))
    marks = F.transform("_spans", lambda s: F.struct(s["at"].alias("at"), s["until"].alias("until"), mark(s).alias("mark")))
    rows = rows.withColumn("_named", _marked(F.col("_state.t"), marks))
    shown = F.when(F.col(text).isNotNull(), privacy.finished(F.col(text), F.col("_named"), F.col("_tokens")))
    own = [F.col(c) for c in docs.columns if c not in ("sanitized", "entities")]
    return rows.withColumn("sanitized", shown).select(*own, "sanitized", F.col("_tokens").alias("entities"))


def self_check(sanitized: DataFrame, lexicon: DataFrame, doc: str = "doc_id", stage=lambda df: df) -> DataFrame:
    """`sanitized` with residuals: what a second run of shapes and names, with the same vocabulary as the first, still finds in the sanitized text; see `privacy.self_check`."""
    again = sanitize(sanitized.select(doc, F.col("sanitized").alias("_text")), lexicon, doc, "_text", stage)
    found = again.select(doc, F.transform("entities", lambda e: e["value"]).alias("residuals"))
    return sanitized.drop("residuals").join(found, doc)


def lexicon_of(**words: DataFrame) -> DataFrame:
    """A lexicon from DataFrames (word) by flag: ordinary=…, public=…, given=…, company=…, sector=…"""
    each = [df.select(F.lower("word").alias("word"), *[F.lit(f == flag).alias(f) for f in FLAGS]) for flag, df in words.items()]
    return reduce(DataFrame.union, each).groupBy("word").agg(*[F.max(f).alias(f) for f in FLAGS])
