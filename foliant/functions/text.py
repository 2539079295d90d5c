"""Column functions over text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
LATIN = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ_]+"
TOPIC = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]{3,}"

# Words that are no topic terms.
STOPWORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how its may new now old see two way who boy did use she too "
    "that with have this will your from they know want been good much some time very when come here just like long make many more only over such take "
    "than them well were what would there their about which these other into could should also after before between because "
    "les des une que qui dans pour avec sur pas par plus est sont aux cette cet ses son sa nous vous ils elles mais ou et en du au "
    "der die das und ist sind mit von den dem ein eine einer eines auf für als bei nach nicht auch werden wird wurde sich aus im zum zur über durch dass man kann oder "
    "http https www com org net pdf doc page"
).split()

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
CARD = r"\b[3-6][0-9]{14,15}\b"
URL = r"https?://[^\s<>\"']+"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def spaced(text: Column) -> Column:
    """The tokens of a text, lower case, each between blanks of its own: what stands in it as " word " is a token. One pass of
    a pattern and no array, for counts of a few given words."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", "  "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def spaced_size(spaced_: Column) -> Column:
    """Tokens of a spaced text."""
    return F.when(spaced_ == "", 0).otherwise(F.length(spaced_) - F.length(F.replace(spaced_, F.lit("  "), F.lit(" "))) + 1).cast("long")


def spaced_count(spaced_: Column, words: str, begins: bool = False) -> Column:
    """Occurrences of a word, of words in a row (between two blanks each), or of words that begin so."""
    part = " " + words + ("" if begins else " ")
    return ((F.length(spaced_) - F.length(F.replace(spaced_, F.lit(part)))) / len(part)).cast("long")


def latin_tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({LATIN})"), 1)


def topic_tokens(text: Column, most: int = 4000) -> Column:
    """Lower-case words of three characters at least that are no numbers and no stop words; the first `most` of a text are
    the operator's bound, as one text must not decide a topic."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOPIC})"), 1)
    return F.slice(F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(*STOPWORDS)), 1, most)


def safe_term(term: Column) -> Column:
    """Fit for a label: 3 to 40 characters, no number, nothing of the shape of an address, a path or an identifier."""
    return F.length(term).between(3, 40) & ~term.rlike(r"^[0-9]+$|[@/:\\]|^[0-9]{2,}")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)


def occurrences(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def mask_email(value: Column) -> Column:
    """First character, three stars, domain."""
    return F.regexp_replace(value, r"^(.)[^@]*(@.*)$", "$1***$2")


def mask_phone(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.lpad(F.right(digits, F.lit(2)), F.length(digits), F.lit("*"))


def mask_iban(value: Column) -> Column:
    bare = F.upper(F.regexp_replace(value, r"\s", ""))
    return F.when(F.length(bare) >= 8, F.concat(F.substring(bare, 1, 4), F.lit(" **** **** "), F.right(bare, F.lit(4)))).otherwise("****")


def mask_name(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 1), F.lit("***"))


def mask_address(value: Column) -> Column:
    return F.concat(F.when(F.length(value) > 8, F.substring(value, 1, 8)).otherwise(""), F.lit("…"))


def mask_dob(value: Column) -> Column:
    return F.concat(F.lit("**/**/"), F.when(F.length(value) >= 4, F.right(value, F.lit(4))).otherwise("****"))


def national_ok(value: Column) -> Column:
    """Thirteen places and a key of two, which complete the number to a multiple of 97; 2A and 2B stand for 19 and 18."""
    bare = F.upper(F.regexp_replace(value, r"\s", ""))
    number = F.replace(F.replace(F.substring(bare, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    key = F.substring(bare, 14, 2).cast("long")
    return bare.rlike(r"^[0-9]{5}([0-9]{2}|2A|2B)[0-9]{8}$") & (key == 97 - number.cast("long") % 97)


def mask_card(value: Column) -> Column:
    return F.concat(F.lit("**** **** **** "), F.right(value, F.lit(4)))


def mask_ip(value: Column) -> Column:
    return F.concat(F.regexp_extract(value, r"^(\d+\.\d+)\.", 1), F.lit(".*.*"))


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def iban_ok(value: Column) -> Column:
    """ISO 7064 mod 97: the first four characters go to the end, letters count from 10; folded digit by digit."""
    bare = F.upper(F.regexp_replace(value, r"\s", ""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    number = F.aggregate(
        F.split(moved, ""), F.lit(0).cast("long"),
        lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("long")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return bare.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (number == 1)
