"""Host lines, registrable domains and origins."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# Services on which any subdomain is someone else's machine.
WILDCARD_DNS = ("sslip.io", "nip.io", "xip.io", "traefik.me", "localtest.me", "lvh.me", "trycloudflare.com", "ngrok.io", "ngrok.app", "ngrok-free.app", "loca.lt", "serveo.net", "localhost.run")
#: A small public-suffix table for tests and offline use: rule, and whether it is private. A full list can be given instead (`suffix_rules`).
SUFFIXES = [
    *((x, False) for x in ("com", "org", "net", "io", "dev", "app", "edu", "gov", "uk", "co.uk", "org.uk", "ac.uk", "de", "fr", "es", "jp", "co.jp", "au", "com.au", "br", "com.br", "eu", "ai", "test", "example", "fixture")),
    *((x, True) for x in ("github.io", "vercel.app", "netlify.app", "pages.dev", "workers.dev", "blogspot.com", "web.app", "firebaseapp.com", "herokuapp.com", "azurewebsites.net")),
]
_IP = r"^(\d+\.\d+\.\d+\.\d+|\[.*\])$"
_ADDRESS = r"^\d+\.\d+\.\d+\.\d+$|:"


def host_line(line: Column) -> tuple[Column, Column]:
    """Host and rank of a line `domain`, `rank,domain` or URL; null where it has none, and for comments."""
    s = T.trim(line)
    parts = F.transform(F.split(s, ","), T.trim)
    first = F.get(parts, F.lit(0))
    rank = F.when((F.size(parts) >= 2) & first.rlike(r"^[0-9]{1,9}$"), F.try_to_number(first, F.lit("999999999")).cast("int"))
    last = F.element_at(parts, -1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"(?i)^https?://", ""), "/.*$", ""), r":\d+$", ""))
    good = ~s.startswith("#") & host.rlike(r"^[a-z0-9.-]+\.[a-z0-9-]+$")
    return F.when(good, host), F.when(good & (rank >= 1), rank)


def www_variant(a: Column, b: Column) -> Column:
    """One host is the other with a leading `www.`."""
    return (F.concat(F.lit("www."), a) == b) | (F.concat(F.lit("www."), b) == a)


def same_origin(a: Column, b: Column) -> Column:
    return T.origin(a) == T.origin(b)


class Rules(NamedTuple):
    """Suffix rules by kind: plain names, the names under which every label is a suffix (`*.name`), and exceptions to those (`!name`)."""

    plain: list[str]
    wild: list[str]
    exceptions: list[str]

    @classmethod
    def of(cls, suffixes: list[tuple[str, bool]], private: bool) -> Rules:
        names = [s for s, own in suffixes if private or not own]
        return cls([s for s in names if s[0] not in "*!"], [s[2:] for s in names if s.startswith("*.")], [s[1:] for s in names if s[0] == "!"])


def ascii_name(name: str) -> str:
    """A host or rule with its international labels in their ASCII form; labels that have none stay."""

    def one(label: str) -> str:
        try:
            return label.encode("idna").decode()
        except UnicodeError:
            return label

    return ".".join(x if x.isascii() else one(x) for x in name.lower().split("."))


@F.pandas_udf(StringType())
def _ascii_names(names: pd.Series) -> pd.Series:
    return names.map(ascii_name, na_action="ignore")


def _plain_name(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"\.$", "")


def registrable(host: Column, suffixes: list[tuple[str, bool]] | None = None, *, private: bool = True) -> Column:
    """The public suffix and one label more, by a literal table of rules; null for addresses, bare suffixes and single labels.

    An exception wins over all other rules and makes what follows its first label the suffix; of the others the one with the
    most labels counts, where `*.name` covers one label more than `name`. An unknown last label counts as a suffix. With
    `private`, private suffixes count too.
    """
    rules = Rules.of(suffixes or SUFFIXES, private)
    table = lambda names: F.array(*[F.lit(ascii_name(s)) for s in names]).cast("array<string>")
    h = _plain_name(host)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    places = F.sequence(F.lit(0), n - 1)
    tail = lambda i: F.array_join(F.slice(labels, i + 1, n), ".")
    hits = lambda names: F.filter(places, lambda i: F.array_contains(table(names), tail(i)))
    # the place at which the suffix starts; the domain starts one label before
    starts = [hits(rules.plain)] if rules.plain else []
    starts += [F.transform(F.filter(hits(rules.wild), lambda i: i > 0), lambda i: i - 1)] if rules.wild else []
    longest = F.array_min(F.concat(*starts)) if starts else F.lit(None).cast("int")
    excepted = F.array_min(hits(rules.exceptions)) + 1 if rules.exceptions else F.lit(None).cast("int")
    place = F.coalesce(excepted, longest, n - 1)
    return F.when(h.rlike(_IP) | (n < 2) | (place < 1) | (h == ""), F.lit(None).cast("string")).otherwise(tail(place - 1))


def registrable_join(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host", *, private: bool = True, international: bool = False) -> DataFrame:
    """The same against a table of rules (suffix, private) of any length: tails of names are joined with the rules' names.

    With `international`, hosts with other than ASCII letters are looked up by their ASCII form (the rules of `suffix_rules` have it).
    """
    name = _plain_name(F.col(host_col))
    name = F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(_ascii_names(name)) if international else name
    names = hosts.select(host_col).distinct().withColumn("h", name).withColumn("labels", F.split("h", r"\."))
    tails = names.select(host_col, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("pos", "tail"))
    usable = suffixes if private else suffixes.filter(~F.col("private"))
    rule = F.col("suffix")
    kinds = usable.select(F.regexp_replace(rule, r"^(\*\.|!)", "").alias("tail"), F.when(rule.startswith("!"), 1).when(rule.startswith("*."), -1).otherwise(0).alias("step")).distinct()
    # a suffix starts at a plain name, one label before the name of a wildcard, one after the start of an exception
    found = tails.join(kinds, "tail").withColumn("start", F.col("pos") + F.col("step")).filter("start >= 0")
    place = found.groupBy(host_col).agg(F.min(F.when(F.col("step") == 1, F.col("start"))).alias("excepted"), F.min(F.when(F.col("step") < 1, F.col("start"))).alias("longest"))
    domain = names.join(place, host_col, "left").withColumn("place", F.coalesce("excepted", "longest", F.size("labels") - 1))
    own = F.when(~F.col("h").rlike(_IP) & (F.size("labels") >= 2) & (F.col("place") >= 1), F.array_join(F.slice("labels", F.col("place"), F.size("labels")), "."))
    return hosts.join(domain.select(host_col, own.alias("registrable_domain")), host_col, "left")


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules (suffix, private) of a public list in its usual format: one a line up to white space, `//` comments, a marked private section."""
    whole = spark.read.text(path, wholetext=True)
    own = F.regexp_extract("value", r"(?s)===BEGIN PRIVATE DOMAINS===(.*?)===END PRIVATE DOMAINS===", 1)
    rest = F.regexp_replace("value", r"(?s)===BEGIN PRIVATE DOMAINS===.*?===END PRIVATE DOMAINS===", "")
    part = lambda text, private: whole.select(F.explode(F.split(text, r"\r?\n")).alias("line"), F.lit(private).alias("private"))
    lines = part(rest, False).unionByName(part(own, True)).select(F.lower(F.regexp_extract("line", r"^\s*(\S*)", 1)).alias("rule"), "private")
    kept = lines.filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    return kept.select(F.when(F.col("rule").rlike(r"^[\x00-\x7F]*$"), F.col("rule")).otherwise(_ascii_rules(F.col("rule"))).alias("suffix"), "private").distinct()


@F.pandas_udf(StringType())
def _ascii_rules(rules: pd.Series) -> pd.Series:
    return rules.map(lambda r: ("!" if r.startswith("!") else "") + ascii_name(r.removeprefix("!")), na_action="ignore")


def same_site(a: Column, b: Column, suffixes: list[tuple[str, bool]] | None = None) -> Column:
    """Two hosts are one site: equal addresses, a host and its `www.` form, or one registrable domain (the last two labels where either has none)."""
    bare = lambda h: F.regexp_replace(F.lower(h), r"^\[|\]$", "")
    x, y = bare(a), bare(b)
    address = x.rlike(_ADDRESS) | y.rlike(_ADDRESS)
    one, other = registrable(x, suffixes), registrable(y, suffixes)
    last = lambda h: F.array_join(F.slice(F.split(h, r"\."), -2, 2), ".")
    tails = F.when(F.size(F.split(x, r"\.")) < 2, x).otherwise(last(x)) == F.when(F.size(F.split(y, r"\.")) < 2, y).otherwise(last(y))
    return F.when(address, x == y).when(www_variant(x, y), True).when(one.isNotNull() & other.isNotNull(), one == other).otherwise(tails)


def suffix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUFFIXES, "suffix STRING, private BOOLEAN")
