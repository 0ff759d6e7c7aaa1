"""Normal keys of tool and operation names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that stand for a method, and words that say nothing.
VERBS = {
    "fetch": "get", "retrieve": "get", "read": "get", "show": "get", "describe": "get",
    "search": "list", "find": "list", "query": "list", "lookup": "list", "browse": "list",
    "create": "post", "add": "post", "insert": "post", "new": "post", "submit": "post",
    "update": "put", "modify": "put", "edit": "put", "set": "put", "change": "put", "patch": "put",
    "remove": "delete", "destroy": "delete", "del": "delete",
}
FILLER = ("api", "v1", "v2", "v3", "the", "a", "an", "of", "for", "by", "to", "and", "with")
METHODS = ("get", "put", "post", "delete", "patch", "options", "head", "trace")


def strict_key(name: Column) -> Column:
    """Lower case without separators."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def tokens(name: Column) -> Column:
    """Words of a name: parameters out, camel case split, filler dropped, verbs folded, plain plurals cut."""
    s = F.regexp_replace(name, r"\{[^}]*\}", " ")
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*FILLER))
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    folded = F.transform(words, lambda t: F.coalesce(F.try_element_at(verbs, t), t))
    return F.transform(folded, lambda t: F.when((F.length(t) > 3) & t.rlike("[^sui]s$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def loose_key(name: Column) -> Column:
    """The distinct words of a name in order."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(name))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two key sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))
