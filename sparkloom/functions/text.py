"""String and set functions as Columns: tokens, identifiers, paths, globs, languages, tags."""

from __future__ import annotations

import fnmatch
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str

#: Where a lower-case letter or digit meets a capital; names in camelCase and snake_case; words.
HUMP = "([0-9a-z])([A-Z])"
_LOW = "[a-z]+"
CAMEL = re.compile(rf"\b({_LOW}(?:[A-Z]{_LOW})+)\b")
SNAKE = re.compile(rf"\b({_LOW}(?:_{_LOW})+)\b")
WORD = re.compile("[0-9A-Z_a-z]+")


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ACCENTS = [(chr(cp), unicodedata.normalize("NFD", chr(cp))[0]) for cp in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(cp))) > 1 and unicodedata.normalize("NFD", chr(cp))[0].isascii()]
_FROM, _TO = "".join(a for a, _ in _ACCENTS), "".join(b for _, b in _ACCENTS)


def fold_accents(c: Name) -> Column:
    """Latin letters without their accents (there is no built-in function)."""
    return F.when(col(c).rlike("[\u00c0-\u024f]"), F.translate(col(c), _FROM, _TO)).otherwise(col(c))


def index_tokens(c: Name) -> Column:
    """Lower-cased, accent-folded runs of letters and digits, in order; ``_`` separates."""
    return F.regexp_extract_all(fold_accents(F.lower(F.coalesce(col(c), F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def words(c: Name, pattern: str = r"([A-Za-z0-9_]+)") -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(1))


def split_identifier(c: Name) -> Column:
    """Lower-case words of a camelCase, snake_case or kebab-case name, of two characters or more."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), HUMP, "$1 $2"), "[_-]", " ")
    return F.filter(words(F.lower(spaced), "([a-z0-9]+)"), lambda t: F.length(t) >= 2)


#: Words that say nothing about code.
STOP_WORDS = sorted(set("a an and are as at be been being by can code designed do does for from function had has have in input into is it its method not of on or output parameters procedure purpose return returns takes that the this to used using was were which with".split()))


def token_set(c: Name, keep_stop_words: bool = False) -> Column:
    """The distinct lower-case tokens of a text with their ``_`` parts; short and stop words go unless they are kept."""
    whole = words(F.lower(F.coalesce(col(c), F.lit(""))))
    parts = F.filter(F.flatten(F.transform(whole, lambda t: F.split(t, "_"))), lambda t: F.length(t) >= 2)
    both = F.array_distinct(F.concat(whole, parts))
    if keep_stop_words:
        return both
    return F.filter(both, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def overlap(query: Column, other: Column) -> Column:
    """The share of the query's tokens that the other set has; 0 if either is empty."""
    n = F.size(F.array_intersect(query, other))
    return F.when((F.size(query) > 0) & (F.size(other) > 0), n / F.size(query)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def trigrams(c: Name) -> Column:
    s = col(c)
    n = F.length(s) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Name, b: Name) -> Column:
    return jaccard(trigrams(a), trigrams(b))


# -- paths and languages --------------------------------------------------------

_SUFFIXES = "css:css go:go html:html,htm java:java javascript:js,jsx python:py rust:rs typescript:ts,tsx"
SUFFIX_LANGUAGE = {s: k for k, ss in (x.split(":") for x in _SUFFIXES.split()) for s in ss.split(",")}
ALIASES = {**SUFFIX_LANGUAGE, "golang": "go", "mjs": "javascript"}
FAMILY = {"typescript": ("javascript", "typescript"), "javascript": ("javascript", "typescript")}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def language_of_path(path: Name) -> Column:
    suffix = F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))
    return F.coalesce(_lookup(SUFFIX_LANGUAGE, suffix), F.lit("unknown"))


def normal_language(name: str | None) -> str:
    low = (name or "").strip().lower().lstrip(".")
    return ALIASES.get(low, low)


def language_family(name: str | None) -> tuple[str, ...]:
    """The languages that a filter on this one admits: TypeScript and JavaScript are one family."""
    n = normal_language(name)
    return FAMILY.get(n, (n,)) if n else ()


def language_is(c: Name, name: str | None) -> Column:
    found = language_family(name)
    return F.lower(col(c)).isin(*found) if found else F.lit(True)


def glob_regex(pattern: str) -> str:
    """A glob, in which ``*`` crosses slashes, as a Java regular expression for the whole string."""
    return "^" + re.sub(r"\\[Zz]$", r"\\z", fnmatch.translate(pattern))


def suffixes_of(language: str) -> list[str]:
    """A language's file suffixes, the commonest first."""
    return [s for s, lang in SUFFIX_LANGUAGE.items() if lang == normal_language(language)]


def file_glob(language: str | None = None, active_file: str | None = None) -> str | None:
    """A pattern for files of a language, else for files like the active one; None if neither says anything."""
    found = suffixes_of(language or "")
    if found:
        return f"*.{found[0]}"
    suffix = (active_file or "").rpartition(".")[2]
    return f"*.{suffix}" if suffix and "." in (active_file or "") and "/" not in suffix else None


def path_like(c: Name, pattern: str | None) -> Column:
    return col(c).rlike(glob_regex(pattern)) if pattern else F.lit(True)


def tags_all(c: Name, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(col(c), t) for t in wanted), F.lit(True))


def tags_any(c: Name, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(col(c), F.lower), F.array(*[F.lit(t.lower()) for t in wanted])) if wanted else F.lit(True)


def contains_any(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(n) for n in needles), F.lit(False))


def count_of(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (c.contains(n).cast("int") for n in needles), F.lit(0))


def module_of_path(path: Name) -> Column:
    """Dotted module name of a file path."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(path), r"\.[^./\\]+$", ""), r"^[./\\]+", ""), r"[/\\]+", ".")


def last_segment(c: Name) -> Column:
    return F.element_at(F.split(col(c), r"\."), -1)


def short_hash(c: Name, n: int = 16) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, n)
