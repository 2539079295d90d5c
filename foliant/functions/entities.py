"""Named entities and keywords as columns: structured types by pattern, names by titles, legal forms and a small list of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

# Patterns, legal forms, titles, places and words of time.
URL = r"https?://[^\s<>\"')]+|www\.[^\s<>\"')]+"
MONEY = r"[€$£]\s?[0-9][0-9 .,]*[0-9]\b|\b(?:EUR|USD|GBP|CHF)\s?[0-9][0-9 .,]*[0-9]\b|[0-9][0-9 .,]*\s?(?:EUR|USD|GBP|CHF)\b"
MONTHS = (
    "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|januar|februar|märz|april|juni|juli|august|september|oktober|november|dezember|"
    "january|february|march|june|july|october|december"
)
DATE = rf"\b(?:[0-9]{{1,2}}[./\-][0-9]{{1,2}}[./\-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|(?:{MONTHS})\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}})\b"
FORMS = "GmbH|AG|SARL|SAS|SASU|SA|EURL|SCI|SNC|Inc\\.?|Ltd\\.?|LLC|PLC|Corp\\.?|Company|Bank|Versicherung|Assurance"
TITLES = "M\\.|Mme|Mlle|Mr\\.?|Mrs\\.?|Ms\\.?|Dr\\.?|Prof\\.?|Herr|Frau"
PLACES = (
    "paris berlin toulouse lyon marseille madrid london munich münchen hamburg frankfurt köln wien zürich geneva genève france germany deutschland spain italy belgium luxembourg "
    "bordeaux nantes strasbourg stuttgart karlsruhe"
).split()
_UPPER, _WORD = "[A-ZÀ-ÖØ-Þ]", r"[\p{L}\p{N}_]"
ORGANIZATION = rf"({_UPPER}(?:{_WORD}|[&'.\-])*(?:\s+{_UPPER}(?:{_WORD}|[&'.\-])*){{0,3}}\s+(?:{FORMS}))"
PERSON = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{TITLES})\s+({_UPPER}(?:{_WORD}|['\-])+(?:\s+{_UPPER}(?:{_WORD}|['\-])+){{1,2}})"
NAME = rf"(?:^|[^\p{{L}}\p{{N}}_])({_UPPER}[a-zà-öø-ÿ\-]{{2,}})"

#: (type, pattern, group, confidence, normal form) of what SQL can match; the form is a format of the value's SQL.
TYPES = (
    ("URL", URL, 0, 0.95, "rtrim({v}, '.,);')"),
    ("MONEY", MONEY, 0, 0.7, "regexp_replace({v}, '[ \\t\\n\\r]+', '', 'g')"),
    ("DATE", DATE, 0, 0.8, "lower({v})"),
    ("ORGANIZATION", ORGANIZATION, 1, 0.5, "lower({v})"),
    ("PERSON", PERSON, 1, 0.35, "lower({v})"),
    ("LOCATION", NAME, 1, 0.4, "lower({v})"),
)


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_type, normalized, confidence, n): each distinct value of a text once, n being 1 as the count of an entity
    in a document is not kept. Personal data with checks (cards, accounts, phones) come from findings.find."""
    raw = F.coalesce(F.col(text), F.lit(""))
    fold = {"URL": lambda v: F.regexp_replace(v, r"[.,);]+$", ""), "MONEY": lambda v: F.regexp_replace(v, r"[ \t\n\r]+", "")}
    found = []
    for kind, pattern, group, confidence, _ in TYPES:
        values = F.regexp_extract_all(raw, F.lit(f"({pattern})" if group == 0 else pattern), 1)
        values = F.array_distinct(F.transform(values, fold.get(kind, F.lower)))
        if kind == "LOCATION":
            values = F.filter(values, lambda v: v.isin(*PLACES))
        found.append(F.struct(F.lit(kind).alias("entity_type"), F.lit(confidence).alias("confidence"), values.alias("values")))
    rows = df.select(F.col(key), F.explode(F.array(*found)).alias("f")).select(key, "f.entity_type", "f.confidence", F.explode("f.values").alias("normalized"))
    return rows.select(key, "entity_type", "normalized", "confidence", F.lit(1).cast("long").alias("n"))


def entities_sql(table: str, key: str, text: str) -> str:
    parts = []
    for kind, pattern, group, confidence, form in TYPES:
        quoted = pattern.replace("'", "''")
        value = form.format(v="v")
        keep = f" WHERE {value} IN ({', '.join(repr(p) for p in PLACES)})" if kind == "LOCATION" else ""
        parts.append(f"SELECT DISTINCT {key}, '{kind}' AS entity_type, {value} AS normalized, {confidence}::DOUBLE AS confidence, 1::BIGINT AS n FROM (SELECT {key}, unnest(regexp_extract_all(coalesce({text}, ''), '{quoted}', {group})) AS v FROM {table}){keep}")
    return " UNION ALL ".join(parts)


def person_masked(name: Column) -> Column:
    return F.concat(F.substring(name, 1, 1), F.lit("***"))


def email_entities(text: Column) -> Column:
    return F.array_distinct(F.transform(t.matches(text, t.EMAIL), t.mask_email))
