"""Indicators of compromise that identify no one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extensions and protocols that are reported.
EXTENSIONS = (
    "locked encrypted crypt crypted locky wcry wncry ryk conti lockbit akira basta phobos djvu cerber zepto onion exe dll ps1 vbs js jar hta lnk iso img scr bat cmd msi docm xlsm pptm"
).split()
PROTOCOLS = "smb rdp ssh ftp sftp tftp http https dns ldap kerberos winrm wmi telnet smtp imap pop3 snmp icmp tls ssl vnc nfs".split()
HASHES = {"sha256": 64, "sha1": 40, "md5": 32}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)


def hashes(text: Column) -> Column:
    """array<struct<kind, value>> of distinct lower-cased hashes, longest kind first; a hash inside a longer one is none."""
    return F.concat(*[_kind(k, F.array_distinct(_all(F.lower(text), rf"\b[0-9a-f]{{{n}}}\b"))) for k, n in HASHES.items()])


def _kind(name: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("kind"), x.cast("string").alias("value")))


def extensions(text: Column) -> Column:
    found = _all(F.lower(text), r"\.(?:" + "|".join(EXTENSIONS) + r")\b")
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.substr(x, F.lit(2)))))


def protocols(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(F.lower(text), r"\b(?:" + "|".join(PROTOCOLS) + r")\b"), F.upper)))


def ports(text: Column) -> Column:
    """Distinct ports from "port N" and "tcp/N", 1 to 65535, ascending."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(F.regexp_extract_all(low, F.lit(r"\bport ([0-9]{1,5})\b"), 1), F.regexp_extract_all(low, F.lit(r"\b(?:tcp|udp)[/:]([0-9]{1,5})\b"), 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x.between(1, 65535))))


def registry_keys(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, r"\b(?:HKLM|HKCU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER)(?:\\[A-Za-z0-9_ ]+)+")))


def profile(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, kind, value): one row for each indicator."""
    t = F.col(text)
    every = F.concat(hashes(t), _kind("extension", extensions(t)), _kind("protocol", protocols(t)), _kind("port", ports(t)), _kind("registry", registry_keys(t)), _kind("cve", F.array_sort(F.array_distinct(F.transform(_all(t, r"(?i)\bCVE-\d{4}-\d{4,7}\b"), F.upper)))))
    return docs.select(F.col(doc).alias("doc"), F.explode(every).alias("i")).select("doc", "i.kind", "i.value")


def summary_lines(profile_: DataFrame) -> DataFrame:
    """(doc, total, line): "2 sha256 · 1 port" by kind name."""
    counts = profile_.groupBy("doc", "kind").agg(F.count("*").alias("n"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), "kind")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", part.alias("p")))), lambda x: x["p"]), " · ")
    return counts.groupBy("doc").agg(F.sum("n").alias("total"), line.alias("line"))


def redacted_profile(entity_counts: DataFrame, doc: str) -> DataFrame:
    """(doc, line): redacted kinds, most frequent first, ties by label."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label")))
    return entity_counts.groupBy(doc).agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["label"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("line"))
