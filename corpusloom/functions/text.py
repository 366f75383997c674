"""Text functions as Column expressions: tokenizers, hashes, stems, normalizers, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that the lexical index leaves out.
STOPWORDS = (
    "the a an and or but of to in on at by for with from into is are was were be been being it its this that these those as "
    "their they them his her has have had not can will if we you your i how does did do what who why where when which"
).split()
# Function words that calibration leaves out of probes and entities, and what it adds for coverage.
PROBE_STOPWORDS = (
    "the a an and or but of to in on at by for with from into through is are was were be been being it its this that these those as their they them also "
    "can will which when where while his her has have had not often usually without"
).split()
COVERAGE_STOPWORDS = PROBE_STOPWORDS + (
    "what how who why where when do does did me tell about explain explained facts information overview history definition important work works known "
    "anything said much many each would could some such very more after before"
).split()
# Suffixes in the order in which the stemmer tries them, and the shortest stem.
SUFFIXES = ["ization", "isation", "ication", "ation", "ition", "tion", "ing", "ed", "ate", "ize", "ise"]
MIN_STEM = 4
# Patterns of credentials in the order of their replacement; True keeps group 1.
SECRETS: list[tuple[str, bool]] = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", False),
    (r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}", False),
    (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", False),
    (r"\bgithub_pat_[A-Za-z0-9_]{30,}\b", False),
    (r"\bnpm_[A-Za-z0-9]{36}\b", False),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", False),
    (r"\bAKIA[0-9A-Z]{16}\b", False),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", False),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False),
    (r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/-]{20,}=*", True),
    (r"(?i)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|secret|password|passwd)\s*[:=]\s*[\"']?)[^\s\"']{6,}", True),
]
# Fixed value: the pattern of an e-mail address.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
# Tags that tools put into prompts.
HARNESS_TAGS = ["system-reminder", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr", "user-prompt-submit-hook"]
# The second seed of the hash pair, FNV's offset and prime.
SEEDS, FNV_START, FNV_PRIME = (0, 0x9E3779B9), 0x811C9DC5, 16777619


def raw_tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Distinct tokens of 2 to 32 characters."""
    return F.array_distinct(F.filter(raw_tokens(text), lambda w: F.length(w).between(2, 32)))


def index_tokens(text: Column) -> Column:
    """Tokens of 2 to 32 characters without function words."""
    return F.filter(raw_tokens(text), lambda w: F.length(w).between(2, 32) & ~w.isin(STOPWORDS))


def fnv1a(word: Column, seed: int = 0) -> Column:
    """FNV-1a over the characters of an ASCII word, 32 bits in a BIGINT."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START ^ seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def stem(word: Column) -> Column:
    """The first suffix that leaves MIN_STEM characters goes, else a closing e."""
    found = F
    for suffix in SUFFIXES:
        found = found.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= MIN_STEM), F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return found.when(word.endswith("e") & (F.length(word) - 1 >= MIN_STEM), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def strip_possessive(word: Column) -> Column:
    """A closing 's goes, of s' and any other closing apostrophe the apostrophe."""
    return F.when(word.endswith("'s"), F.substring(word, F.lit(1), F.length(word) - 2)).when(word.endswith("'"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def phrase(text: Column) -> Column:
    """Lower case; what isn't a-z, 0-9 or an apostrophe becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9' ]", " "), " +", " "))


def evidence(text: Column) -> Column:
    """Lower case; what isn't a-z or 0-9 (an apostrophe too) becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def quote_present(passage: Column, quote: Column) -> Column:
    """Whether a passage carries a quote: as a whole, or of more than 6 words of 3 letters and more at least 60 %."""
    words = F.filter(F.split(evidence(quote), " "), lambda w: F.length(w) >= 3)
    held = evidence(passage)
    share = F.size(F.filter(words, lambda w: held.contains(w))) / F.size(words)
    return (evidence(quote) != "") & (held.contains(evidence(quote)) | ((F.size(words) > 6) & (share >= 0.6)))


def slug(heading: Column) -> Column:
    """Anchor of a heading: lower case, letters, digits, marks, - and _ stay, blanks become -."""
    return F.replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\p{M}_\- ]", ""), F.lit(" "), F.lit("-"))


def redacted(text: Column) -> tuple[Column, Column]:
    """The text without credentials and e-mail addresses, and how many were replaced."""
    count = F.lit(0)
    for pattern, keeps in SECRETS:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, "$1[redacted]" if keeps else "[redacted]")
    count = count + F.regexp_count(text, F.lit(EMAIL))
    return F.regexp_replace(text, EMAIL, "[email]"), count.cast("long")


def cleaned(text: Column) -> Column:
    """Without harness tags, at most one blank line in a row, trimmed."""
    text = reduce(lambda t, tag: F.regexp_replace(t, rf"(?s)<{tag}>.*?</{tag}>", ""), HARNESS_TAGS, F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def short_title(text: Column, most: int = 80) -> Column:
    """The first line that isn't blank, cut with an ellipsis."""
    line = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*(\S[^\n]*)$", 1))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def heading_of(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def body_of(text: Column) -> Column:
    """What stands below the first line."""
    return F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise(F.lit(""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")
