"""Platform and edge labels of a homepage, by an ordered table of rules turned into one expression."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import http as H


class Rule(NamedTuple):
    label: str
    html: tuple[str, ...] = ()
    generator: str | None = None
    header: tuple[tuple[str, str | None], ...] = ()


# Labels and their marks, in the order in which the first one counts.
RULES = (
    Rule("mintlify", ("(?i)mintlify", "(?i)_mintlify/", r"(?i)mintcdn\.com")),
    Rule("gitbook", ("(?i)gitbook", r"(?i)gitbook\.io"), "(?i)gitbook"),
    Rule("docusaurus", ("(?i)docusaurus",), "(?i)docusaurus"),
    Rule("readme.io", (r"(?i)cdn\.readme\.io/", r"(?i)readmeio\.com/", r"(?i)\breadme-io\b")),
    Rule("fern", (r"(?i)buildwithfern|fern-docs|\bfern\b.*docs",)),
    Rule("nextra", ("(?i)[/\"'`]nextra[/\"'`-]", "(?i)nextra-theme"), "(?i)nextra"),
    Rule("mkdocs", ("(?i)mkdocs",), "(?i)mkdocs"),
    Rule("hugo", (), "(?i)hugo"),
    Rule("gatsby", ("(?i)gatsby-",), "(?i)gatsby"),
    Rule("nextjs", ("(?i)/_next/static/", "__NEXT_DATA__")),
    Rule("nuxt", ("(?i)/_nuxt/", "__NUXT__")),
    Rule("webflow", ("(?i)webflow",), "(?i)webflow"),
    Rule("wordpress", ("(?i)wp-content/", "(?i)wp-includes/"), "(?i)wordpress"),
    Rule("squarespace", (r"(?i)static1?\.squarespace\.com/", r"(?i)squarespace-cdn\.com/", "SQUARESPACE_ROLLUPS"), "(?i)squarespace"),
    Rule("wix", (r"(?i)wix\.com|wixstatic\.com|parastorage\.com",), "(?i)wix"),
    Rule("shopify", (r"(?i)cdn\.shopify\.com", r"(?i)Shopify\.theme"), None, (("x-shopify-stage", None), ("x-shopid", None), ("x-sorting-hat-shopid", None))),
    Rule("ghost", (), "(?i)ghost"),
    Rule("hubspot", (r"(?i)hs-scripts\.com|hubspot",), "(?i)hubspot"),
    Rule("framer", (r"(?i)framerusercontent\.com|framer\.com",), "(?i)framer"),
    Rule("github-pages", header=(("x-github-request-id", None), ("server", r"(?i)github\.com"))),
    Rule("vercel", header=(("x-vercel-id", None), ("x-vercel-cache", None), ("server", "(?i)^vercel$"))),
    Rule("netlify", header=(("x-nf-request-id", None), ("server", "(?i)netlify"))),
    Rule("cloudflare-pages", (r"(?i)https?://[a-z0-9.-]+\.pages\.dev/",)),
    Rule("fastly", header=(("x-served-by", "(?i)cache-"), ("via", "(?i)varnish"), ("x-fastly-request-id", None))),
    Rule("akamai", header=(("server", "(?i)akamai"), ("x-akamai-transformed", None), ("x-akamai-request-id", None))),
    Rule("cloudfront", header=(("via", "(?i)cloudfront"), ("x-amz-cf-id", None))),
    Rule("cloudflare", header=(("cf-ray", None), ("server", "(?i)^cloudflare$"))),
    Rule("google-frontend", header=(("server", "(?i)^(gws|GSE|ESF|Google Frontend|sffe)$"),)),
    Rule("nginx", header=(("server", "(?i)nginx"),)),
    Rule("apache", header=(("server", "(?i)apache"),)),
    Rule("iis", header=(("server", "(?i)microsoft-iis"), ("x-powered-by", r"(?i)asp\.net"))),
    Rule("envoy", header=(("server", "(?i)envoy"),)),
    Rule("express", header=(("x-powered-by", "(?i)express"),)),
    Rule("php", header=(("x-powered-by", "(?i)php"),)),
)
CDN = ("cloudflare", "fastly", "akamai", "cloudfront")
HOSTING = ("vercel", "netlify", "cloudflare-pages", "google-frontend", "nginx", "apache", "iis", "envoy", "express", "php", "github-pages")
HINT_ONLY = ("hubspot", "framer", "gitbook", "webflow", "cloudflare-pages")
HTML_CHARS = 512 * 1024


def _hit(rule: Rule, headers: Column, html: Column, generator: Column) -> Column:
    """The kind of evidence (header before generator before html) and what shows it; null without any."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("by"), F.lit("").alias("signal")))
    for name, pattern in rule.header:
        value = H.header(headers, name)
        shown = F.concat(F.lit(f"header:{name}="), F.substring(value, 1, 40)) if pattern else F.lit(f"header:{name}")
        out = out.when(F.coalesce(value.rlike(pattern) if pattern else value.isNotNull(), F.lit(False)), F.struct(F.lit("header").alias("by"), shown.alias("signal")))
    if rule.generator:
        out = out.when(F.coalesce(generator.rlike(rule.generator), F.lit(False)), F.struct(F.lit("generator").alias("by"), F.concat(F.lit("generator:"), F.substring(generator, 1, 40)).alias("signal")))
    for pattern in rule.html:
        out = out.when(html.rlike(pattern), F.struct(F.lit("html").alias("by"), F.lit(f"html:{rule.label}").alias("signal")))
    return out


def fingerprints(responses: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """host, fingerprint of homepage captures (status, final_url, error, headers, text); patterns run only on pages with status 200."""
    html = F.when(F.col("status") == 200, F.substring(F.coalesce("text", F.lit("")), 1, HTML_CHARS)).otherwise(F.lit(""))
    rows = responses.withColumn("_html", html).withColumn("_generator", H.generator(F.col("_html")))
    found = F.filter(
        F.array(*[F.struct(F.lit(r.label).alias("label"), _hit(r, F.col("headers"), F.col("_html"), F.col("_generator")).alias("hit")) for r in rules]),
        lambda x: x["hit"].isNotNull(),
    )
    rows = rows.withColumn("_found", found)
    edge, hint = (lambda x: x["label"].isin(*CDN)), (lambda x: (x["hit"]["by"] == "html") & x["label"].isin(*HINT_ONLY))
    labels = lambda keep: F.transform(F.filter(F.col("_found"), keep), lambda x: x["label"])
    platforms = labels(lambda x: ~edge(x) & ~hint(x))
    app = F.get(F.filter(platforms, lambda p: ~p.isin(*HOSTING)), F.lit(0))
    return rows.select(
        "host",
        F.struct(
            F.col("status").alias("homepage_status"),
            F.when(F.col("status") > 0, F.col("final_url")).alias("homepage_final_url"),
            F.col("error").alias("homepage_error"),
            H.header(F.col("headers"), "server").alias("server"),
            H.header(F.col("headers"), "x-powered-by").alias("powered_by"),
            F.col("_generator").alias("generator"),
            platforms.alias("platforms"),
            F.coalesce(app, F.get(platforms, F.lit(0)), F.when(F.col("status") == 0, "unreachable").otherwise("unknown")).alias("primary"),
            F.get(labels(edge), F.lit(0)).alias("cdn"),
            labels(lambda x: ~edge(x) & hint(x)).alias("hints"),
            F.transform(F.col("_found"), lambda x: x["hit"]["signal"]).alias("signals"),
        ).alias("fingerprint"),
    )
