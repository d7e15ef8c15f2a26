"""Privacy layer: entities, span-exact redaction with numbered tokens, audit, self-check, pseudonyms.

Identifiers with a shape are taken out by column expressions, so a document never leaves its row. What needs a vocabulary
(whether a word is ordinary) is looked up by a join of the few words that may be asked for. Names without a shape are in `names`."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mask_value
from ..functions.vocabulary import FUNCTION_WORDS, NO_ORGANISATIONS, SECURITY_ACRONYMS, TECH_PREFIXES

#: Stands for what must survive while patterns run; no pattern matches it.
HOLD = "\x02"
#: Around the number of an entity while patterns run.
MARK = "\x01"
_ENTITY = "array<struct<label:string,value:string>>"


@dataclass(frozen=True)
class Shape:
    """A kind of identifier: the label of its tokens and its pattern.

    A text without any of `needs` has none of the kind, nor one without any of `said` once lower-cased, nor one without a match of `hint`, which is a part of every match that is
    quick to look for; most texts are passed over by these. With `group`, only what that group matches is taken out. `keep` (match, value, known words) tells what is no
    identifier, `clean` makes the value of what was matched, `label_of` the label of a match where there are several."""

    label: str
    pattern: str
    group: int = 0
    keep: Callable[[Column, Column, Column], Column] | None = field(default=None, compare=False)
    clean: Callable[[Column], Column] | None = field(default=None, compare=False)
    label_of: Callable[[Column], Column] | None = field(default=None, compare=False)
    needs: str | tuple[str, ...] = ""
    said: tuple[str, ...] = ()
    hint: str = ""

    def possible(self, text: Column) -> Column | None:
        """Whether a text may hold one; None where nothing can be told."""
        needs = (self.needs,) if isinstance(self.needs, str) else self.needs
        lowered = _let(F.lower(text), lambda low: _any_of(low, list(self.said))) if self.said else None
        tests = [F.rlike(text, F.lit(self.hint)) if self.hint else None, _any_of(text, [x for x in needs if x]), lowered]
        tests = [t for t in tests if t is not None]
        return reduce(Column.__and__, tests) if tests else None


def _any_of(text: Column, words: list[str]) -> Column | None:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]) if words else None


def _isin(value: Column, words: list[str]) -> Column:
    """Whether the value is one of the words, which are one literal to the planner."""
    return F.rlike(value, F.lit(rf"^(?:{'|'.join(map(re.escape, dict.fromkeys(words)))})\z"))


def _term(word: Column, known: Column) -> Column:
    """Whether a lower-cased word is a word of the trade or of the vocabulary."""
    return _isin(word, TECH_PREFIXES) | F.array_contains(known, word)


def _short_forms(value: Column) -> Column:
    """Whether a value, or each part of it, is a short form of the trade."""
    parts = F.split(F.upper(value), "[- ]+")
    return _isin(F.upper(value), SECURITY_ACRONYMS) | F.forall(parts, lambda p: _isin(p, SECURITY_ACRONYMS))


def _no_host(match: Column, value: Column, known: Column) -> Column:
    """What has letters and digits without naming a machine: terms, versions, years. Machines have a zero before their number, a prefix that is no word, or three parts and a number."""
    parts = F.split(value, "-")
    prefix = F.lower(F.regexp_extract(value, "^[A-Za-z]+", 0))
    padded = F.exists(parts, lambda p: F.regexp_extract(p, "[0-9]+", 0).rlike("^0[0-9]"))
    machine = padded | ~_term(prefix, known) | ((F.size(parts) >= 3) & F.element_at(parts, -1).rlike("^[0-9]+$"))
    term = ~value.rlike("[0-9]") | _short_forms(value) | F.array_contains(known, F.lower(value)) | (F.length(prefix) < 2) | _isin(prefix, TECH_PREFIXES)
    return term | F.exists(parts, lambda p: p.rlike("^(19|20)[0-9][0-9]$")) | ~machine


def _no_account(match: Column, value: Column, known: Column) -> Column:
    return value.contains(MARK) | value.contains(HOLD) | _term(F.lower(value), known)


_ARTICLE = r"(?i)^(the|a|an|our|its|their|this|that)\s+"


def _body(value: Column) -> Column:
    """The name without an article; empty where nothing else is left."""
    return F.trim(F.regexp_replace(F.concat(value, F.lit(" ")), _ARTICLE, ""))


def _no_organisation(match: Column, value: Column, known: Column) -> Column:
    function = F.lower(F.regexp_replace(F.trim(match), _ARTICLE, ""))
    return _isin(function, NO_ORGANISATIONS) | (value == "") | _isin(F.lower(value), FUNCTION_WORDS)


def _described(match: Column, value: Column, known: Column) -> Column:
    """Form values that describe: only lower-cased vocabulary words, or neither words nor digits."""
    words = F.regexp_extract_all(value, F.lit("([A-Za-z][A-Za-z0-9'-]*)"), 1)
    plain = F.forall(words, lambda w: w.rlike("^[a-z]") & F.array_contains(known, w))
    return (value == "") | F.when(F.size(words) == 0, ~value.rlike("[0-9]")).otherwise(plain)


# The labels of form fields, by what they name.
FIELDS = {
    "ORG": ["organisation", "organization", "company", "client", "customer", "vendor", "supplier", "partner", "victim", "entity", "institution", "employer", "affected organisation", "affected organization", "subsidiary"],
    "PERSON": ["name", "full name", "employee", "user", "analyst", "reporter", "contact", "owner", "author", "prepared by", "reported by", "approved by", "assigned to", "escalated to", "investigated by", "reviewed by", "requested by", "submitted by", "handled by", "responder"],
    "LOCATION": ["location", "site", "branch", "city", "country", "region", "office", "facility", "plant", "address", "building"],
    "HOSTNAME": ["hostname", "host", "device", "asset", "machine", "computer", "workstation", "server", "endpoint", "system name"],
    "ACCOUNT": ["account", "username", "user name", "user id", "login"],
    "REFERENCE": ["reference", "ref", "ticket", "case", "case id", "incident id", "report id", "tracking id"],
}
_LABELS = {name: label for label, names in FIELDS.items() for name in names}


def _field_label(match: Column) -> Column:
    name = F.regexp_extract(F.lower(match), r"^[ \t]*(?:[-*•][ \t]*)?([a-z ]*[a-z])", 1)
    return F.coalesce(*[F.when(_isin(name, [n for n, x in _LABELS.items() if x == label]), F.lit(label)) for label in FIELDS], F.lit("ORG"))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOT = r"(?:\.|\[\.\])"
_ALONE = r"(?<![\w.\-@/\\])"
_NAME_ENDS = r"(?![\w\-@]|\.[A-Za-z0-9])"
_PART = r"(?:[A-Z][a-z]*(?:[-'][A-Z][a-z]+)+|[A-Z][a-z]+)"
_PERSON = rf"({_PART}(?:\s+{_PART}){{0,2}})"
_FOREIGN = r"[\p{L}&&[^A-Za-z\u00C0-\u024F]]"
_LAST_LABELS = [
    "com", "net", "org", "gov", "edu", "mil", "int", "info", "biz", "xyz", "top", "onion", "io", "co", "me", "tv", "app", "dev", "cloud", "health", "bank", "shop", "online", "site",
    "live", "sa", "ae", "qa", "kw", "bh", "om", "eg", "jo", "lb", "ma", "tn", "tr", "uk", "de", "fr", "nl", "se", "no", "fi", "dk", "es", "it", "pl", "ch", "at", "be", "ie", "pt",
    "gr", "cz", "ro", "ru", "cn", "jp", "kr", "in", "pk", "id", "my", "sg", "au", "nz", "ca", "mx", "br", "ar", "za", "ng", "ke", "local", "internal", "corp", "lan", "intranet",
    "home", "arpa", "example", "test", "invalid", "localdomain",
]
_BODIES = [
    "Inc", "LLC", "Ltd", "Limited", "Corp", "Corporation", "Company", "Co\\.", "GmbH", "PLC", "LLP", "Bank", "Group", "Holdings", "Centre", "Center", "Hospital", "Clinic", "Authority",
    "Ministry", "University", "College", "Institute", "Agency", "Foundation", "Association", "Council", "Commission", "Trust",
]
_HEADS = [
    "Ministry", "University", "Bank", "Authority", "College", "Institute", "Agency", "Council", "Commission", "Department", "Hospital", "Municipality", "Government", "City", "State",
    "Province", "Republic", "Kingdom", "Embassy", "Chamber", "Society", "Organisation", "Organization", "Association", "Foundation", "Office",
]
_INTRODUCED = "service account|user account|admin account|administrator account|domain account|local account|account|username|user name|user id|userid|login name|logon name|logged in as|signed in as|logged on as"
_ROLES = "employee|user|staff member|victim|attacker|contractor|reported by|escalated to|assigned to|investigated by|approved by|contacted|notified"

# Shapes in the order in which they are taken out. What an earlier one took, a later one doesn't see.
SHAPES = [
    Shape("FOREIGN_TEXT", rf"{_FOREIGN}+(?:[\s،؛؟.,:;!?()\-–—\"'«»/٠-٩]*{_FOREIGN}+)*", label_of=lambda m: F.when(m.rlike("^[\u0600-\u08FF\uFB50-\uFFFF]"), "ARABIC_TEXT").otherwise("FOREIGN_TEXT"), hint="[\u00AA\u00B5\u00BA\u0250-\U0010FFFF]"),
    Shape("SECRET", r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_\-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,}){2})\b", needs=("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ")),
    Shape("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", needs='@'),
    Shape("URL", r"(?i)\bhttps?://[^\s<>\"')\]]+", needs='://'),
    Shape("URL", r"(?i)\bhxxps?(?::|\[:\])//[^\s<>\"')\]]+", needs='//'),
    Shape("IP", rf"\b(?:{_OCTET}{_DOT}){{3}}{_OCTET}(?:/\d{{1,2}})?\b", hint=r"[0-9](?:\.|\[\.\])[0-9]"),
    Shape("IP", r"(?i)\b(?:[A-F0-9]{1,4}:){5}[A-F0-9:]{2,}\b", needs=':', hint=":[A-Fa-f0-9]{1,4}:"),
    Shape("IP", r"(?i)(?<![\w:.])(?:[A-F0-9]{1,4}:){1,7}(?::[A-F0-9]{1,4}){1,7}(?![\w:])", needs='::'),
    Shape("MAC", r"(?i)\b(?:[0-9A-F]{2}[:\-]){5}[0-9A-F]{2}\b", hint=r"[:\-][A-Fa-f0-9]{2}[:\-]"),
    Shape("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", hint="[0-9]{2}[A-Z0-9]{11}"),
    Shape("CREDIT_CARD", r"\b(?:\d{4}[ \-]?){3}\d{3,4}\b", hint="[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    Shape("NATIONAL_ID", r"\b[12]\d{9}\b", hint="[12][0-9]{9}"),
    Shape("PHONE", r"(?:\+\d{1,3}[ \-]?)?(?:\(?0\)?)?\d{2,4}[ \-]?\d{3}[ \-]?\d{4}\b", hint="[0-9]{3}[ -]?[0-9]{4}"),
    Shape("USER_PATH", r"(?i)[A-Z]:\\Users\\[^\\\s\"']+", needs='\\'),
    Shape("USER_PATH", r"(?i)/(?:home|Users)/[A-Z0-9._\-]+", needs='/'),
    Shape("ACCOUNT", r"\b[A-Za-z0-9\-]{2,30}\\[A-Za-z0-9._\-]{2,30}\b", needs='\\'),
    Shape("REFERENCE", r"\b(?:IR|INC|INCIDENT|CASE|TKT|TICKET|REF|SR|CHG|PRB|RITM|SEC|CR|REQ)[-_#]?\d{2,}(?:[-_/]\d+)*\b", hint="[A-Z][-_#]?[0-9]{2}"),
    Shape("HOSTNAME", r"\b[A-Z]{2,}(?:-[A-Z0-9]{1,10}){1,3}\b", keep=lambda m, v, known: _short_forms(v), hint="-[A-Z0-9]"),
    Shape("DOMAIN", rf"(?i)\b(?:[A-Z0-9](?:[A-Z0-9\-]{{0,61}}[A-Z0-9])?{_DOT})+(?:{'|'.join(_LAST_LABELS)})\b", hint=r"\.\]?[A-Za-z]"),
    Shape("HOSTNAME", rf"{_ALONE}[A-Za-z][A-Za-z0-9]{{1,14}}(?:-[A-Za-z0-9]{{1,14}}){{1,4}}{_NAME_ENDS}", keep=_no_host, needs="-", hint="-[A-Za-z0-9]"),
    Shape("HOSTNAME", rf"{_ALONE}[A-Za-z]{{2,10}}\d{{2,4}}[a-z]?{_NAME_ENDS}", keep=_no_host, hint="[A-Za-z][0-9]{2}"),
    Shape("ACCOUNT", rf"{_ALONE}(?i:svc|srv|adm|admin|sa|sys|bkp|ops)[_.][A-Za-z0-9][A-Za-z0-9_.\-]{{1,24}}(?![\w@])", hint="[_.][A-Za-z0-9]"),
    Shape("ACCOUNT", rf"\b(?i:{_INTRODUCED})\s+(?i:named\s+|called\s+|name\s+)?[\"'“]?([A-Za-z][A-Za-z0-9._\-]{{2,30}})", 1, keep=_no_account, said=tuple(_INTRODUCED.split("|"))),
    Shape("PERSON", rf"\b(?:Mr|Mrs|Ms|Dr|Eng|Engineer|Analyst|Manager|Director|Officer|CISO|CTO|CEO)\.?[:,]?\s+{_PERSON}", 1, needs=("Mr", "Ms", "Dr", "Eng", "Analyst", "Manager", "Director", "Officer", "CISO", "CTO", "CEO")),
    Shape("PERSON", rf"\b(?i:{_ROLES})[:,]?\s+{_PERSON}\b", 1, said=tuple(_ROLES.split("|"))),
    Shape("ORG", rf"\b([A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){{0,3}})\s+(?:{'|'.join(_BODIES)})\b", 1, keep=_no_organisation, clean=_body),
    Shape("ORG", rf"\b(?:{'|'.join(_HEADS)})\s+of\s+((?:the\s+)?[A-Z][A-Za-z0-9&.\-]*(?:\s+(?:and\s+|&\s+)?[A-Z][A-Za-z0-9&.\-]*){{0,3}})", 1, keep=_no_organisation, clean=_body, needs=tuple(_HEADS), hint=r"of\s+(?:the\s+)?[A-Z]"),
    Shape("FIELD", rf"(?im)^[ \t]*(?:[-*•][ \t]*)?(?:{'|'.join(sorted(_LABELS, key=len, reverse=True))})[ \t]*[:：][ \t]*([^\n,;(\x01\x02\[]{{2,80}})", 1, keep=_described, clean=F.trim, label_of=_field_label),
]
#: A pattern without any match, for a redaction that keeps nothing.
NOTHING = "(?!)"
#: A part of every match of PROTECTED, quick to look for: see `Shape`.
_MAY_HOLD = (Shape("", "", needs="_REDACTED"), Shape("", "", said=("cve-",)), Shape("", "", needs="\\", said=("hk",)), Shape("", "", hint="T[0-9]{4}"), Shape("", "", hint="[0-9A-Fa-f]{32}"))
#: What identifies no one and is kept: tokens of an earlier pass, CVE and technique ids, file hashes, registry paths.
PROTECTED = (
    r"\[[A-Z_]+_REDACTED(?:_[0-9]+)?\]|(?i:\bCVE-[0-9]{4}-[0-9]{4,7}\b)|\bT[0-9]{4}(?:\.[0-9]{3})?\b|(?i:\b[0-9a-f]{64}\b|\b[0-9a-f]{40}\b|\b[0-9a-f]{32}\b)"
    r"|(?i:\b(?:HKLM|HKCU|HKCR|HKU|HKEY_[A-Z_]+)\\[\w\\\-]+)"
)


def shapes_of(*labels: str) -> list[Shape]:
    """The shapes of some labels."""
    return [s for s in SHAPES if s.label in labels]


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _let(value: Column, body) -> Column:
    """body(value), with `value` written and computed once however often the body names it.

    Steps that name their input several times would otherwise grow without bound when the optimiser merges them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _join(gaps: Column, found: Column) -> Column:
    """gap, found, gap, … as one text."""
    return F.array_join(F.zip_with(gaps, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _step(shape: Shape, known: Column):
    """From (t, entities) to (t, entities) with one shape's values taken out of t, by position, and marked by the entity's number."""

    def match(full: Column, value: Column) -> Column:
        clean = shape.clean(value) if shape.clean else value
        label = shape.label_of(full) if shape.label_of else F.lit(shape.label)
        keep = shape.keep(full, clean, known) if shape.keep else F.lit(False)
        return F.struct(full.alias("full"), F.struct(label.alias("label"), clean.alias("value")).alias("entity"), keep.alias("keep"))

    def matched(found: Column, t: Column) -> Column:
        if not shape.group:
            return F.transform(found, lambda x: match(x, x))
        return F.zip_with(found, _found(t, shape.pattern, shape.group), match)

    def rewritten(t: Column, matches: Column, entities: Column) -> Column:
        def instead(m: Column) -> Column:
            token = F.concat(F.lit(MARK), F.array_position(entities, m["entity"]).cast("string"), F.lit(MARK))
            value = m["entity"]["value"]
            if shape.label == "FIELD":  # the value ends the match, and its words may be in the label
                start = F.regexp_instr(m["full"], F.lit("[:：]"))
                return F.when(m["keep"], m["full"]).otherwise(F.concat(F.substr(m["full"], F.lit(1), start), F.replace(F.substr(m["full"], start + 1), value, token)))
            return F.when(m["keep"], m["full"]).otherwise(F.replace(m["full"], value, token) if shape.group else token)

        return F.struct(_join(F.split(t, shape.pattern, -1), F.transform(matches, instead)).alias("t"), entities.alias("entities"))

    def step(state: Column) -> Column:
        def taken(matches: Column) -> Column:
            new = F.transform(F.filter(matches, lambda m: ~m["keep"]), lambda m: m["entity"])
            more = F.concat(state["entities"], F.array_except(new, state["entities"]))
            return _let(more, lambda entities: rewritten(state["t"], matches, entities))

        some = _let(_found(state["t"], shape.pattern), lambda found: F.when(F.size(found) == 0, state).otherwise(_let(matched(found, state["t"]), taken)))
        possible = shape.possible(state["t"])
        return some if possible is None else F.when(possible, some).otherwise(state)

    return step


def _held(text: Column, protected: str) -> Column:
    """The text with what is protected as HOLD."""
    held = F.array_join(F.split(text, protected, -1), HOLD)
    if protected != PROTECTED:
        return held
    return F.when(reduce(Column.__or__, [s.possible(text) for s in _MAY_HOLD]), held).otherwise(text)


def marked(docs: DataFrame, text: str, shapes: list[Shape] = SHAPES, known: str | None = None, state: str = "_state", protected: str = PROTECTED) -> DataFrame:
    """`docs` with `state`: struct<t, entities>, the text with every identifier as MARK number MARK and what is protected as HOLD, and the entities by number, from 1.

    known: column with an array of the vocabulary's words in the text, lower-cased (see `vocabulary_words`). Each shape is a projection of its
    own: one expression for all would be too deep to be analysed. Each names the state once, as the optimiser may put them into one another."""
    words = F.lit(None) if known is None else F.col(known)
    words = F.coalesce(words.cast("array<string>"), F.array().cast("array<string>"))
    docs = docs.withColumn(state, F.struct(_held(F.coalesce(F.col(text), F.lit("")), protected).alias("t"), F.array().cast(_ENTITY).alias("entities")))
    for s in shapes:
        docs = docs.withColumn(state, _let(F.col(state), _step(s, words)))
    return docs


def numbered(entities: Column) -> Column:
    """array<struct<label, value, number, token>>: numbered within their label; the only one of a label stays bare. Sorted by label once, so long lists cost little more."""
    by_label = F.array_sort(F.transform(entities, lambda e, i: F.struct(e["label"].alias("label"), i.alias("i"), e["value"].alias("value"))))

    def of(sorted_: Column, labels: Column) -> Column:
        each = F.array_distinct(labels)
        first = F.map_from_arrays(each, F.transform(each, lambda label: F.array_position(labels, label)))
        count = F.map_from_arrays(each, F.transform(each, lambda label: F.size(F.filter(labels, lambda x: x == label))))

        def one(e: Column, k: Column, bounds: Column) -> Column:
            number = (k - bounds["first"][e["label"]] + 2).cast("long")
            bare = F.concat(F.lit("["), e["label"], F.lit("_REDACTED]"))
            token = F.when(bounds["count"][e["label"]] == 1, bare).otherwise(F.concat(F.lit("["), e["label"], F.lit("_REDACTED_"), number.cast("string"), F.lit("]")))
            return F.struct(e["i"].alias("i"), F.struct(e["label"].alias("label"), e["value"].alias("value"), number.alias("number"), token.alias("token")).alias("e"))

        bounds = F.struct(first.alias("first"), count.alias("count"))
        return F.transform(F.array_sort(_let(bounds, lambda b: F.transform(sorted_, lambda e, k: one(e, k, b)))), lambda x: x["e"])

    return _let(by_label, lambda s: _let(F.transform(s, lambda e: e["label"]), lambda labels: of(s, labels)))


def finished(text: Column, t: Column, tokens: Column, protected: str = PROTECTED) -> Column:
    """`t` with tokens for marks, and what `text` holds at the places of HOLD."""
    pattern = f"{MARK}([0-9]+){MARK}"
    shown = F.transform(_found(t, pattern, 1), lambda n: F.element_at(tokens, n.cast("int"))["token"])
    named = F.when(F.contains(t, F.lit(MARK)), _join(F.split(t, pattern, -1), shown)).otherwise(t)
    return _let(named, lambda x: F.when(F.contains(x, F.lit(HOLD)), _join(F.split(x, HOLD, -1), _found(text, protected))).otherwise(x))


def vocabulary_words(docs: DataFrame, doc: str, text: str, lexicon: DataFrame, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc, known): the ordinary and public words of `lexicon` (see `names.flags`) among those that shapes ask for: letters before digits, names with
    hyphens and digits, words after an account's introduction, form values. `stage` may write these few words, which are read several times, so that texts are searched once."""
    from .names import flags

    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    hosts = _found(t, r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*[0-9][a-z0-9-]*")
    values = F.flatten(F.transform(_found(t, SHAPES[-1].pattern, 1), lambda v: _found(v, "[a-z][a-z0-9'-]*")))
    begun = lambda h: F.concat(h, F.transform(h, lambda x: F.regexp_extract(x, "^[a-z]+", 0)))
    asked = F.concat(_let(hosts, begun), _found(t, rf"\b(?:{_INTRODUCED})\s+(?:named\s+|called\s+|name\s+)?[\"'“]?([a-z][a-z0-9._\-]{{2,30}})", 1), values)
    # explode_outer, as explode would have the optimiser look for the words once more, to leave out rows without any
    words = docs.select(F.col(doc).alias("doc"), F.explode_outer(F.array_distinct(asked)).alias("word"))
    words = stage(words.where("word is not null"))
    known = words.join(flags(words.select("word").distinct(), lexicon).where("ordinary or public").select("word"), "word")
    return known.groupBy("doc").agg(F.collect_set("word").alias("known"))


def redact(docs: DataFrame, text: str = "text", shapes: list[Shape] = SHAPES, known: str | None = None, protected: str = PROTECTED) -> DataFrame:
    """`docs` with sanitized and entities: array<struct<label, value, number, token>>.

    A value always gets the same token. Tokens of a label are numbered in the order in which the shapes take them out, unless there is only
    one, which stays bare. Protected shapes survive. Null texts give null and no entities. Idempotent. `known`: a column of `docs` with the words that
    `vocabulary_words` finds; without it no word counts as ordinary, so more is taken out.
    `protected`: what survives; with NOTHING, a shape takes out all that it matches, inside hashes too."""
    own = [F.col(c) for c in docs.columns if c not in ("sanitized", "entities")]
    named = lambda s: _let(numbered(s["entities"]), lambda e: F.named_struct(F.lit("t"), finished(F.col(text), s["t"], e, protected), F.lit("entities"), e))
    df = marked(docs, text, shapes, known, protected=protected).withColumn("_r", _let(F.col("_state"), named))
    return df.select(*own, F.when(F.col(text).isNotNull(), F.col("_r.t")).alias("sanitized"), F.col("_r.entities").alias("entities"))


def entity_counts(redacted: DataFrame, doc: str) -> DataFrame:
    """(doc, label, n): distinct values of each label."""
    return redacted.select(doc, F.explode("entities").alias("e")).groupBy(doc, F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


def audit_rows(redacted: DataFrame, doc: str) -> DataFrame:
    """(doc, token, label, preview): what was taken out, masked."""
    rows = redacted.select(doc, F.explode("entities").alias("e"))
    return rows.select(doc, F.col("e.token").alias("token"), F.col("e.label").alias("label"), mask_value(F.col("e.value")).alias("preview"))


def self_check(sanitized: DataFrame, shapes: list[Shape] = SHAPES, known: str | None = None) -> DataFrame:
    """`sanitized` with residuals: identifiers that a second run still finds in the sanitized text; clean means none.

    The second run knows the same shapes, so it finds what a replacement has laid bare, and no other kind of identifier."""
    again = marked(sanitized, "sanitized", shapes, known)
    return again.withColumn("residuals", F.transform("_state.entities", lambda e: e["value"])).drop("_state")


def gate(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): only what the self-check found clean may be shared."""
    clean = F.size("residuals") == 0
    return checked.where(clean), checked.where(~clean)


@F.pandas_udf(T.StringType())
def _canonical(names: pd.Series) -> pd.Series:
    return names.map(lambda n: n if n is None else " ".join(unicodedata.normalize("NFKC", n).casefold().split()))


def pseudonym(name: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the name in its compatibility form (NFKC), without case and with single spaces, in hex; null where it is blank.

    Built from SHA-2 as RFC 2104 says. Only the form of the name is made in Python: there is no expression for it."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key) for p in (0x36, 0x5C))
    clean = _canonical(name)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), clean.cast("binary")), 256))
    return F.when(clean != "", F.sha2(F.concat(F.lit(outer), first), 256))


def unify_aliases(names: DataFrame) -> DataFrame:
    """(doc, name, owner, label): a single word that is part of exactly one full name of its document shares that name's token.

    names (doc, name[, label]); other names own themselves. A name that is read in several ways has the strongest label of PERSON, ORG, NAME; an
    alias takes that of its owner."""
    names = names if "label" in names.columns else names.withColumn("label", F.lit("NAME"))
    rank = F.when(F.col("label") == "PERSON", 2).when(F.col("label") == "ORG", 1).otherwise(0)
    own = names.groupBy("doc", "name").agg(F.max_by("label", rank).alias("label"))
    full = own.where(F.col("name").contains(" ")).select("doc", F.col("name").alias("full"), F.col("label").alias("full_label"), F.explode(F.split("name", " ")).alias("name")).distinct()
    one = full.groupBy("doc", "name").agg(F.count("*").alias("n"), F.min("full").alias("full"), F.min("full_label").alias("full_label")).where("n = 1")
    return own.join(one, ["doc", "name"], "left").select("doc", "name", F.coalesce("full", "name").alias("owner"), F.coalesce("full_label", "label").alias("label"))
