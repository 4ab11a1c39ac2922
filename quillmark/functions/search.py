"""Full-text analysis, BM25 scoring and snippets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.tree import quote

STOP_WORDS = tuple("a an and are as at be but by for from if in into is it no not of on or that the this to with was would you".split())
_ACCENTS = {"a": "áàâäãåāăą", "c": "çćĉċč", "e": "éèêëēĕėęě", "i": "íìîïĩīĭį", "n": "ñńņň", "o": "óòôöõōŏő", "u": "úùûüũūŭůűų", "y": "ýÿŷ"}

#: Rows of a table for each file that a term's postings are dealt out to, so a frequent term is not one task's alone.
SHARE = 4_000_000


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms."""

    whitespace: bool = False
    case_folding: bool = True
    stop_words: bool = True
    accent_folding: bool = False

    def terms(self, text: Column) -> Column:
        """The terms of a column in order, repeats kept."""
        x = F.lower(text) if self.case_folding else text
        if self.accent_folding:
            marked = "".join(_ACCENTS.values())
            plain = "".join(k * len(v) for k, v in _ACCENTS.items())
            x = F.translate(x, marked + ("" if self.case_folding else marked.upper()), plain + ("" if self.case_folding else plain.upper()))
        parts = F.split(x, r"(?U)\s+" if self.whitespace else r"[^\p{IsAlphabetic}\p{N}]+")
        drop = ("", *STOP_WORDS) if self.stop_words else ("",)
        return F.filter(parts, lambda t: ~t.isin(*drop))

    def query(self, text: str) -> list[str]:
        """Distinct terms of a query string, in order."""
        x = text.lower() if self.case_folding else text
        if self.accent_folding:
            table = {ord(c): k for k, v in _ACCENTS.items() for c in v} | {ord(c): k.upper() for k, v in _ACCENTS.items() for c in v.upper() if len(c) == 1}
            x = x.translate(table)
        parts = x.split() if self.whitespace else re.split(r"[\W_]+", x)
        return list(dict.fromkeys(t for t in parts if t and not (self.stop_words and t in STOP_WORDS)))


def terms_sql(field: str, analyzer: Analyzer) -> str:
    """``Analyzer.terms`` as SQL over an expression."""
    x = f"lower({field})" if analyzer.case_folding else f"({field})"
    if analyzer.accent_folding:
        marked, plain = "".join(_ACCENTS.values()), "".join(k * len(v) for k, v in _ACCENTS.items())
        upper = not analyzer.case_folding
        x = f"translate({x}, {quote(marked + (marked.upper() if upper else ''))}, {quote(plain + (plain.upper() if upper else ''))})"
    pattern = r"(?U)\s+" if analyzer.whitespace else r"[^\p{IsAlphabetic}\p{N}]+"
    drop = ("", *STOP_WORDS) if analyzer.stop_words else ("",)
    return f"filter(split({x}, {quote(pattern)}), t -> t NOT IN ({', '.join(map(quote, drop))}))"


def _maybe(field: str, words: list[str], analyzer: Analyzer) -> str:
    """Whether a text can hold one of the terms: a plain search that spares most texts their analysis."""
    if analyzer.accent_folding:
        return "true"
    x = f"lower({field})" if analyzer.case_folding else f"({field})"
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")" if words else "false"


def score_sql(field: str, words: list[str], c: dict, analyzer: Analyzer, k1: float = 1.2, b: float = 0.75, boost: float = 1.0) -> str:
    """BM25 as SQL: a text is analysed once, and only if it may hold a term."""
    parts = []
    for w, seen in zip(words, c["df"]):
        idf = math.log((c["n"] - seen + 0.5) / (seen + 0.5) + 1)
        tf = f"size(filter(t, x -> x = {quote(w)}))"
        parts.append(f"greatest({idf!r}D * {tf} * {k1 + 1!r}D / ({tf} + {k1!r}D * ({1 - b!r}D + {b!r}D * size(t) / {float(c['avgdl'])!r}D)), 0D)")
    if not parts:
        return "0D"
    total = f"transform(array({terms_sql(field, analyzer)}), t -> ({' + '.join(parts)}) * {float(boost)!r}D)[0]"
    return f"(CASE WHEN {field} IS NULL OR NOT {_maybe(field, words, analyzer)} THEN 0D ELSE {total} END)"


def match_sql(field: str, query: str, analyzer: Analyzer | None = None) -> str:
    """Whether a text holds a term of the query."""
    analyzer = analyzer or Analyzer()
    words = analyzer.query(query)
    if not words:
        return "false"
    return f"({field} IS NOT NULL AND {_maybe(field, words, analyzer)} AND arrays_overlap({terms_sql(field, analyzer)}, array({', '.join(map(quote, words))})))"


def fraction_sql(field: str, query: str, analyzer: Analyzer | None = None) -> str:
    analyzer = analyzer or Analyzer()
    words = analyzer.query(query)
    return f"(size(array_intersect({terms_sql(field, analyzer)}, array({', '.join(map(quote, words))}))) / {float(len(words))!r}D)" if words else "0D"


def snippet_sql(field: str, query: str) -> str:
    words = sorted(Analyzer().query(query), key=lambda w: (-len(w.encode()), w))
    if not words:
        return f"({field})"
    each = "|".join("\\Q" + w + "\\E" for w in words)
    return f"regexp_replace({field}, {quote(f'(?iu)({each})')}, '<mark>$1</mark>')"


def corpus(df: DataFrame, field: str, query: list[str], analyzer: Analyzer) -> dict:
    """Statistics of the whole table before any filter: rows, mean length, and rows with each term; one row."""
    terms = df.select(analyzer.terms(F.col(field)).alias("t"), F.col(field).isNotNull().alias("has"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("has"), F.size("t"))).alias("avgdl")]
    aggs += [F.sum(F.array_contains("t", q).cast("long")).alias(f"df{i}") for i, q in enumerate(query)]
    r = terms.agg(*aggs).first()
    return {"n": r["n"], "avgdl": max(r["avgdl"] or 1.0, 1.0), "df": [r[f"df{i}"] or 0 for i in range(len(query))]}


def score(df: DataFrame, field: str, query: str, analyzer: Analyzer | None = None, k1: float = 1.2, b: float = 0.75, boost: float = 1.0, stats: DataFrame | None = None) -> Column:
    """BM25 of each row; the statistics come from ``stats``, the unfiltered table, or from ``df``."""
    analyzer = analyzer or Analyzer()
    words = analyzer.query(query)
    c = corpus(stats if stats is not None else df, field, words, analyzer)
    return F.expr(score_sql(f"`{field}`", words, c, analyzer, k1, b, boost))


def fraction(text: Column, query: str, analyzer: Analyzer | None = None) -> Column:
    """Part of the query's terms that a text has, for texts outside a corpus."""
    analyzer = analyzer or Analyzer()
    words = analyzer.query(query)
    if not words:
        return F.lit(0.0)
    return F.size(F.array_intersect(analyzer.terms(text), F.array(*map(F.lit, words)))) / F.lit(float(len(words)))


def postings(df: DataFrame, key: str, field: str, analyzer: Analyzer | None = None) -> DataFrame:
    """The inverted index: term, key, tf and the document's length dl, one row for each term of a row.

    Terms are counted inside their row, as runs of its sorted terms, so nothing is shuffled.
    """
    analyzer = analyzer or Analyzer()

    def runs(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return F.struct(t.alias("t"), F.when(F.size(t) > 0, begins).alias("begins"))

    rows = df.select(F.col(key), F.get(F.transform(F.array(F.sort_array(analyzer.terms(F.col(field)))), runs), F.lit(0)).alias("__x"))
    rows = rows.select(key, F.col("__x.t").alias("__t"), F.col("__x.begins").alias("__begins"))
    # The outer form, as Spark infers a filter from the other one and analyses each text anew for it.
    rows = rows.select(key, F.size("__t").alias("dl"), "__t", "__begins", F.posexplode_outer("__begins").alias("__p", "__at")).filter(F.col("__at").isNotNull())
    return rows.select(F.get("__t", F.col("__at")).alias("term"), key, "dl", (F.coalesce(F.get("__begins", F.col("__p") + 1), F.col("dl")) - F.col("__at")).cast("long").alias("tf"))


class TextIndex:
    """A stored inverted index: postings dealt out and sorted by term, so a look-up reads the row groups of its terms only.

    A term's postings are in one file, or in one for each ``SHARE`` rows of the table.

    Beside the postings stand the number of rows and the mean length, and each
    term's number of documents comes from its own postings.
    """

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> None:
        self.spark, self.path, self.analyzer = spark, path, analyzer or Analyzer()

    def build(self, df: DataFrame, key: str, field: str, parts: int | None = None) -> TextIndex:
        rows = postings(df, key, field, self.analyzer).withColumnRenamed(key, "key")
        # By hash: ranges would take a sample first, and so analyse all texts twice.
        by = [F.col("term"), F.pmod(F.xxhash64("key"), F.lit(df.count() // SHARE + 1))]
        dealt = rows.repartition(parts, *by) if parts else rows.repartition(*by)
        dealt.sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{self.path}/postings")
        sizes = df.select(F.size(self.analyzer.terms(F.col(field))).alias("dl"), F.col(field).isNotNull().alias("has"))
        sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("has"), F.col("dl"))), F.lit(1.0)).alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def search(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key and score of the best k documents."""
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        return indexed_top(self.spark.read.parquet(f"{self.path}/postings"), "key", stats["n"], stats["avgdl"], query, k, self.analyzer, k1, b)


def indexed_top(index: DataFrame, key: str, rows: int, mean: float, query: str, k: int, analyzer: Analyzer | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best k documents by BM25, read from postings of the query's terms only."""
    words = (analyzer or Analyzer()).query(query)
    hit = index.filter(F.col("term").isin(*words))
    seen = hit.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    idf = F.log((F.lit(float(rows)) - F.col("seen") + 0.5) / (F.col("seen") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / max(mean, 1.0)))
    scored = hit.join(seen, "term").groupBy(key).agg(F.sum(part).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def snippet(text: Column, query: str, analyzer: Analyzer | None = None) -> Column:
    """The text with each match of a query term in <mark>; longer terms first."""
    words = sorted((analyzer or Analyzer()).query(query), key=lambda w: (-len(w.encode()), w))
    if not words:
        return text
    each = "|".join("\\Q" + w + "\\E" for w in words)
    return F.regexp_replace(text, f"(?iu)({each})", "<mark>$1</mark>")
