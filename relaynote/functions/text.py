"""Column functions on text. Patterns see Unicode letters, digits and white space, as in (?U)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

SPACE = r"(?U)\s+"
LONG_SENTENCE = 240


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f refers to it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: str | Column) -> Column:
    """Without white space, of any kind, at either end. Of a column's name the pattern is only tried where an end has some."""
    bare = F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")
    if not isinstance(x, str):
        return bare
    return F.when(F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(r"(?U)\s"), bare).otherwise(F.col(x))


def collapse(x: str | Column) -> Column:
    """Stripped, and every run of white space one blank."""
    return F.regexp_replace(strip(x), SPACE, " ")


def key(x: str | Column) -> Column:
    """What texts are compared by when duplicates are looked for."""
    return F.lower(collapse(x))


def words(x: str | Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(strip(x), SPACE), lambda w: w != "")


def tokens(x: str | Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit(r"(?U)(\w+)"), F.lit(1))


def contains_any(x: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether the text contains one of the needles. Searches for bytes: a pattern would try all of them at each place."""
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needles]) if needles else F.lit(False)


def sentences(x: str | Column) -> Column:
    """Split behind . ! or ? where white space follows."""
    return F.filter(F.split(strip(x), r"(?<=[.!?])(?U)\s+"), lambda s: s != "")


def pack_long(sentence: Column, most: int = LONG_SENTENCE) -> Column:
    """A sentence of over `most` characters is cut at its commas, and neighbouring parts that fit together are joined by
    a blank. Without two parts it is cut to slices of `most` characters."""
    parts = F.filter(F.transform(F.split(sentence, ","), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        fits = (state["open"] != "") & (F.char_length(state["open"]) + F.char_length(part) + 2 <= most)
        return F.when(state["open"] == "", F.struct(state["done"].alias("done"), part.alias("open"))).when(
            fits, F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit(" "), part).alias("open"))
        ).otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), part.alias("open")))

    packed = F.aggregate(parts, start, add, lambda s: F.concat(s["done"], F.filter(F.array(s["open"]), lambda o: o != "")))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(sentence) - 1) / most).cast("int")), lambda i: F.substr(sentence, i * most + 1, F.lit(most)))
    return F.when(F.char_length(sentence) <= most, F.array(sentence)).when(F.size(parts) >= 2, packed).otherwise(slices)


def word_chunks(x: str | Column, size: int = 120) -> Column:
    """Pieces of `size` words. The text is split once, not once a piece."""

    def cut(w: Column) -> Column:
        count = F.ceil(F.size(w) / size).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return bound(words(x), cut)


def clauses(x: str | Column) -> Column:
    """Clauses of a sentence of ten words or more: split at conjunctions, else semicolons, else long dashes, else
    around parentheses, whichever first gives two parts."""
    text = c(x)
    tidy = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    conjunction = rf"(?iU)\s+(?:{'|'.join(config.CLAUSE_CONJUNCTIONS)})\s+"
    mark = "\x1f"
    ways = [
        F.split(text, conjunction),
        F.split(text, r"(?U);\s+"),
        F.split(text, r"(?U)\s*—\s+"),
        F.split(F.regexp_replace(text, r"(?U)\s*\(([^)]+)\)", f"{mark}$1{mark}"), mark),
    ]
    out = F.array(text)
    for way in reversed(ways):
        out = F.when(F.size(tidy(way)) > 1, tidy(way)).otherwise(out)
    return F.when(F.size(words(text)) < 10, F.array(text)).otherwise(out)


def urls(x: str | Column) -> Column:
    return F.regexp_extract_all(c(x), F.lit(r"(?U)(https?://[^\s]+)"), F.lit(1))


def component(url: str | Column) -> Column:
    """The first known component whose pattern occurs in the URL."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(config.COMPONENT_PATTERNS):
        out = F.when(c(url).rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def evidence(x: str | Column) -> Column:
    """Evidence keywords in the text, in their order."""
    lower = F.lower(F.coalesce(c(x), F.lit("")))
    found = F.array(*[F.when(F.contains(lower, F.lit(k)), F.lit(k)) for k in config.EVIDENCE_KEYWORDS])
    return F.filter(found, lambda k: k.isNotNull())


def is_causal(x: str | Column) -> Column:
    return F.coalesce(F.lower(c(x)).rlike(config.CAUSAL_PATTERN), F.lit(False))


def is_protected(x: str | Column) -> Column:
    return F.coalesce(contains_any(F.lower(c(x)), config.PROTECTED_KEYWORDS), F.lit(False))


def is_referential(x: str | Column) -> Column:
    lower = F.lower(c(x))
    return F.coalesce(contains_any(lower, config.REFERENTIAL_WORDS) & lower.rlike("|".join(config.REFERENTIAL_PATTERNS)), F.lit(False))


def is_implementation(x: str | Column, policy: config.Policy = config.Policy()) -> Column:
    text = F.coalesce(c(x), F.lit(""))
    return contains_any(F.lower(text), policy.implementation_indicators) | F.contains(text, F.lit("`")) | F.contains(text, F.lit("->"))


def has_grammar_issue(x: str | Column) -> Column:
    text = c(x)
    first = F.substring(text, 1, 1)
    lower_start = (F.lower(first) == first) & (F.upper(first) != first)
    return (text != "") & (~F.substring(text, -1, 1).isin(".", "!", "?") | F.contains(text, F.lit("  ")) | (lower_start & (F.char_length(text) > 10)))


def fix_grammar(x: str | Column) -> Column:
    """A capital at the start, a mark at the end, single blanks."""
    text = strip(x)
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    ended = F.when((capital != "") & ~F.substring(capital, -1, 1).isin(".", "!", "?"), F.concat(capital, F.lit("."))).otherwise(capital)
    return F.regexp_replace(ended, SPACE, " ")


def glossary_corrected(x: str | Column, confidence: str | Column, glossary: config.Glossary = config.Glossary(), below: float = 0.6, all_terms: bool = False) -> Column:
    """Phrases, longest first, where the confidence is low; then acronyms and terms, word by word.

    As in the original only the first term is ever compared, unless all_terms is given.
    """
    text = collapse(x)
    low = text
    for bad, good in sorted(glossary.phrase_corrections, key=lambda p: -len(p[0])):
        low = F.regexp_replace(low, rf"(?iu)\Q{bad}\E", good.replace("\\", "\\\\").replace("$", "\\$"))
    text = F.when(c(confidence) < below, low).otherwise(text)
    if not glossary.terms:
        return text
    known = dict(glossary.acronyms)
    for t in reversed(glossary.terms if all_terms else glossary.terms[:1]):
        known.setdefault(t.lower(), t)
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    return collapse(F.array_join(F.transform(F.split(text, SPACE), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " "))


def ambiguity_warnings(x: str | Column, glossary: config.Glossary = config.Glossary()) -> Column:
    """A warning for each glossary term or acronym with an ambiguous word within three tokens."""
    nearby = F.array(*[F.lit(a) for a in config.AMBIGUOUS_NEARBY])
    names: dict[str, list[str]] = {}
    for n in [*glossary.terms, *[a for a, _ in glossary.acronyms]]:
        names.setdefault(n.lower(), []).append(n)
    if not names:
        return F.array().cast("array<string>")
    table = F.create_map(*[v for low, of in names.items() for v in (F.lit(low), F.array(*[F.lit(n) for n in of]))])

    def warn(toks: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            start = F.greatest(i - 3, F.lit(0))
            word = F.get(F.array_intersect(nearby, F.slice(toks, start + 1, i + 4 - start)), F.lit(0))
            line = lambda n: F.concat(F.lit("Glossary term '"), n, F.lit("' appears near ambiguous word '"), word, F.lit("'"))
            return F.when(F.map_contains_key(table, t), F.filter(F.transform(F.element_at(table, t), line), lambda x: x.isNotNull()))

        return F.array_distinct(F.flatten(F.array_compact(F.transform(toks, of))))

    return bound(tokens(x), warn)


def connector(x: str | Column) -> Column:
    out = F.lit(config.OTHER_CONNECTOR)
    for pattern, word in reversed(config.CONNECTORS):
        out = F.when(c(x).rlike(f"(?i){pattern}"), F.lit(word)).otherwise(out)
    return out


def repaired_paragraph(x: str | Column) -> Column:
    """A capital behind each full stop, single blanks, a mark at the end."""
    parts = F.split(c(x), r"\.[ ]+")
    text = F.array_join(F.transform(parts, lambda p, i: F.when((i > 0) & F.substring(p, 1, 1).rlike("[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), ". ")
    text = F.regexp_replace(text, " +", " ")
    return F.when((text != "") & ~F.substring(text, -1, 1).isin(".", "!", "?"), F.concat(text, F.lit("."))).otherwise(text)
