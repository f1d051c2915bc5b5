"""Names reduced to what people type."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.constants import COLLAPSE, KAZAKH_TO_RUSSIAN, KINDS, KIND_VISIBILITY, LATIN, STREET_WORDS, VISIBILITY

#: What counts as punctuation: in the index builder the underscore is a letter, in the query front end it is not.
KEEP_UNDERSCORE, DROP_UNDERSCORE = r"[^\p{L}\p{N}_\s]", r"[^\p{L}\p{N}\s]"


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column, punctuation: str = KEEP_UNDERSCORE) -> Column:
    """Lower case, Kazakh letters as their Russian neighbours, no street words, no punctuation. Letters come first, so a street word with Kazakh letters of its own stays, as Russian ones."""
    out = F.translate(F.lower(text), "".join(KAZAKH_TO_RUSSIAN), "".join(KAZAKH_TO_RUSSIAN.values()))
    for word in STREET_WORDS:
        out = F.replace(out, F.lit(word), F.lit(" "))
    return _squeeze(F.regexp_replace(out, punctuation, " "))


def latinise(text: Column, punctuation: str = KEEP_UNDERSCORE) -> Column:
    """The fold in Latin letters, with y as i and kh as h."""
    letters = F.create_map(*[F.lit(x) for pair in LATIN.items() for x in pair])
    out = F.array_join(F.transform(F.split(fold(text, punctuation), ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")
    for a, b in COLLAPSE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return _squeeze(out)


def search_keys(name: Column, aliases: Column, reduce) -> Column:
    """All spellings, reduced, each once, in one string."""
    spellings = F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda s: s.isNotNull())
    return F.array_join(F.array_distinct(F.transform(spellings, lambda s: reduce(s))), " ")


def starts_word(key: Column, query: Column) -> Column:
    return F.startswith(key, query) | F.contains(key, F.concat(F.lit(" "), query))


def kind_of(detail: Column) -> Column:
    """The kind that stands before the street in a detail line."""
    return F.lower(F.trim(F.split(detail, "·")[0]))


def category_of(kind: Column) -> Column:
    out = F.lit("building")
    for name, kinds in KINDS.items():
        out = F.when(kind.isin(kinds), name).otherwise(out)
    return out


def visibility_of(kind: Column, category: Column) -> Column:
    """struct(priority, min_zoom)."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("priority"), F.lit(p[1]).alias("min_zoom"))
    out = pair(VISIBILITY["building"])
    for name, p in VISIBILITY.items():
        out = F.when(category == name, pair(p)).otherwise(out)
    for name, p in KIND_VISIBILITY.items():
        out = F.when((kind == name) & (category != "landmark"), pair(p)).otherwise(out)
    return out
