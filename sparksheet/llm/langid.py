"""Language identification by Bayesian evidence fusion.

Four kinds of evidence add their log-likelihoods: the text (three-byte grams, by counts learned from texts of known
language), the language a page's markup declares, the address (a language code in its path, else the host's last
label), and the host.  How far declarations and addresses can be trusted is itself counted: over all rows, how often
each goes with each language that the text alone suggests.  The host's prior is hierarchical: its counts are smoothed
toward its domain's, the domain's toward all rows', each by grouped aggregation.  A row's own text is left out of the
counts that it is judged by.

Defined cases: null or empty text, missing declaration, address or host are no evidence (nothing is added); without
any evidence the global prior decides; ties go to the language first in order; languages are those of the training
rows (null ones left out; each takes 32 KB of the learned table); without training rows the result has null languages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .evidence import GRAMS, gram_counts, letter_grams, scored


def page_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def declared_language(html: Column) -> Column:
    """The html element's lang attribute, its first part in lower case; empty if none."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))


def address_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def site_of(host: Column) -> Column:
    """A host's registrable part: its last two labels, three where the last but one is a country's own second level (co.uk, com.br)."""
    return F.regexp_extract(host, r"([^.]+\.(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+\.[^.]+)$", 1)


def learn_counts(df: DataFrame, lang_col: str, text_col: str) -> dict[str, np.ndarray]:
    """For each language how often its texts hold each gram."""
    known = df.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("label"), text_of(text_col).alias("t"))
    out: dict[str, np.ndarray] = {}
    for r in gram_counts(known).collect():  # GRAMS rows for each language at most
        out.setdefault(r["label"], np.zeros(GRAMS))[r["gram"]] += r["n"]
    return out


def likelihoods(*counts: dict[str, np.ndarray], langs: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (the counts' own unless given), and the log-likelihood of each gram by language, from one or several counts."""
    langs = sorted({x for c in counts for x in c}) if langs is None else langs
    sums = np.array([sum((c[x] for c in counts if x in c), np.full(GRAMS, 0.5)) for x in langs]).reshape(len(langs), GRAMS)
    return langs, np.log(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300))


def learn(df: DataFrame, lang_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    return likelihoods(learn_counts(df, lang_col, text_col))


def identify(rows: DataFrame, langs: list[str], tables: np.ndarray | list[np.ndarray], keys: list[str], weight: float = 0.2, strength: float = 5.0) -> DataFrame:
    """rows (keys..., t, declared, address, host, domain) -> keys, host, declared, address, text_lang, lang, p.

    tables: the grams' log-likelihoods, or several of them, of which each row names one by its column `fold`.
    weight: how much one gram counts (neighbouring grams repeat each other); strength: how many rows a prior is worth."""
    if not langs:
        return rows.select(*keys, "host", "declared", "address", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("p"))
    names = [f"l{i}" for i in range(len(langs))]

    folds = [tables] if isinstance(tables, np.ndarray) else list(tables)
    rows = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(0))

    def of_text(text: str, fold: int) -> tuple:
        x = weight * (folds[fold] @ letter_grams(text)) if text.strip() else np.zeros(len(langs))
        return tuple(x - x.max())

    in_langs = lambda c: F.when(F.col(c).isin(langs), F.col(c)).when(F.col(c) != "", F.lit("*")).otherwise("")
    rows = rows.withColumn("declared", F.coalesce("declared", F.lit(""))).withColumn("address", F.coalesce("address", F.lit(""))).withColumn("host", F.coalesce("host", F.lit(""))).withColumn("domain", F.coalesce("domain", F.lit("")))
    rows = rows.withColumn("d", in_langs("declared")).select(*keys, "host", "domain", "declared", "address", "d", "fold", "t")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "t")
    soft = lambda ls: [F.exp(x) / sum((F.exp(y) for y in ls), F.lit(0.0)) for x in ls]
    first = cut(scored(rows, columns, of_text, names, "fold"))
    first = first.select("*", *[p.alias(f"p{i}") for i, p in enumerate(soft([F.col(n) for n in names]))])
    shares = [f"p{i}" for i in range(len(langs))]
    total = first.agg(*[F.sum(p).alias(p) for p in shares]).first()
    overall = np.array([total[p] or 0 for p in shares]) + 1
    overall = overall / overall.sum()

    def sums_of(column: str) -> DataFrame:
        """By value of the column: rows, and their shares of the languages."""
        return first.where(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias(f"{column}_n"), *[F.sum(p).alias(f"{column}_{i}") for i, p in enumerate(shares)])

    def smoothed(column: str, i: int, prior: Column) -> Column:
        """The share of language i among the other rows of this value, toward a prior."""
        others = F.greatest(F.coalesce(F.col(f"{column}_{i}") - F.col(f"p{i}"), F.lit(0.0)), F.lit(0.0))
        return (others + strength * prior) / (F.coalesce(F.col(f"{column}_n") - 1, F.lit(0)) + strength)

    full = first
    for column in ("d", "address", "domain", "host"):
        # Rows without a value match nothing, but would meet in one task: their key is dealt by hash.
        apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*keys), F.lit(9973)).cast("string"))
        full = full.withColumn("at", F.when(F.col(column) != "", F.col(column)).otherwise(apart))
        full = full.join(sums_of(column).withColumnRenamed(column, "at"), "at", "left").drop("at")
    parts = []
    for i, g in enumerate(map(float, overall)):
        known = [F.when(F.col(c) != "", F.log(smoothed(c, i, F.lit(g)) / g)).otherwise(0.0) for c in ("d", "address")]
        prior = F.when(F.col("domain") != "", smoothed("domain", i, F.lit(g))).otherwise(g)
        parts.append(F.col(names[i]) + known[0] + known[1] + F.log(F.when(F.col("host") != "", smoothed("host", i, prior)).otherwise(prior)))
    best = lambda xs: F.array(*[F.lit(x) for x in langs])[F.array_position(F.array(*xs), F.greatest(*xs) if len(xs) > 1 else xs[0]).cast("int") - 1]
    full = full.select(*keys, "host", "declared", "address", best([F.col(n) for n in names]).alias("text_lang"), *[x.alias(f"z{i}") for i, x in enumerate(parts)])
    zs = [F.col(f"z{i}") for i in range(len(langs))]
    top = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return full.select(*keys, "host", "declared", "address", "text_lang", best(zs).alias("lang"), (1 / sum((F.exp(z - top) for z in zs), F.lit(0.0))).alias("p"))


def of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What identify() takes, from web pages."""
    url, html = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    host = address_host(url)
    code = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:/|$)", 1))
    last = F.regexp_extract(host, r"([a-z]+)$", 1)
    return pages.select(F.col(f"`{id_col}`"), page_text(html).alias("t"), declared_language(html).alias("declared"), F.when(code != "", code).otherwise(last).alias("address"), host.alias("host"), site_of(host).alias("domain"))
