"""Quality rules: repetition and size counts, and an n-gram perplexity band by language.

The perplexity model is an interpolated modified Kneser-Ney model of order 5
over the bytes of words, one for each value of ``lang``; contexts do not reach
across words.  A gram is one 64-bit key: 24 bits that stand for the language,
then up to five bytes.  Grams are counted in Spark over all documents and kept as
sorted arrays in the shared folder, which workers memory-map.  Bytes rather than
whole words keep the model's size bounded by the alphabet instead of the
vocabulary.

A document is rejected by ``base_failed`` (fewer than ``min_words`` words, or
more than a fifth of its words in repeated 5-word windows), or because one of two
perplexities leaves the band of its language: bits per byte, and bits per word.
Deviations from the language's median are standardised by the text's length, as
the mean over n words spreads with 1/sqrt(n), and measured in units of their
quartiles on either side, which single odd documents do not move; the bands end
``Z`` such units from the median.  Apart from that, a text with more than one
symbol of ``#*$%&|<>`` for ten words is rejected as markup or a table; the columns
``band_failed`` and ``symbols_failed`` show which rule decided.

Defined results: a null text has no words, all counts 0 and no bits, and fails;
a null ``lang`` is a language of its own; repeated rows are measured each; other
columns are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textcore as tc
from .lm_scoring import discounts, summed
from .shared import parts, released, settle, shared_dir

ORDER = 5
#: Texts are handled in slices of about this many bytes, as the arrays of grams are many times as large.
SLICE = 2 << 20
#: A task sends its counts when it holds so many grams.
FLUSH = 1_000_000
MIN_WORDS = 10
#: Symbols for each word beyond which a text counts as markup or a table.
MAX_SYMBOLS = 0.1
#: Standard deviations, estimated from quartiles, that bound the bands.
Z = 4.0
#: Distance from the median to a quartile of the normal distribution, in standard deviations.
QUARTILE = 0.6745
#: Words from which on a longer text does not narrow the band further.
LONG = 1000.0
#: Languages up to which their bands are broadcast; beyond it, they are joined by shuffle.
BROADCAST_LANGUAGES = 10_000

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@lru_cache(4096)
def _lang_code(lang: str | None) -> int:
    return 0 if lang is None else 1 + xxhash.xxh64_intdigest(lang) % ((1 << 24) - 1)


def lang_codes(lang: pa.Array) -> np.ndarray:
    return np.array([_lang_code(x) for x in lang.to_pylist()], np.uint64)


def word_grams(body: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the full-order grams of words, and the word of each; a word ends with a predicted 0x20."""
    n = end - start + 1
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(start, n) + at
    padded = np.append(body, np.uint8(0x20))
    b = np.where(at == np.repeat(n - 1, n), np.uint8(0x20), padded[np.minimum(place, len(body))]).astype(np.uint64)
    key = b.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(b)
        earlier[back:] = b[:-back]
        earlier[at < back] = 0
        key |= earlier << np.uint64(8 * back)
    return key | (np.repeat(lang, n) << np.uint64(8 * ORDER)), word


def _distinct_words(text: pa.Array, lang: pa.Array) -> tuple:
    """Words of a slice, distinct by language: keys and words of grams, then the word's place of each occurrence."""
    h, row, start, end, n = tc.words(text)
    code = lang_codes(lang)[row] if len(row) else np.zeros(0, np.uint64)
    _, first, back = np.unique(tc.combine(h, code), return_index=True, return_inverse=True)
    body, _ = tc.raw(text)
    keys, word = word_grams(body, start[first], end[first], code[first])
    return keys, word, back, row, n, h, start, end


def count_grams(docs: DataFrame) -> DataFrame:
    """Counts of full-order grams over all words: key, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            text, lang = batch.column(0), batch.column(1)
            for lo, hi in tc.slices(text, SLICE):
                keys, word, back, *_ = _distinct_words(text.slice(lo, hi - lo), lang.slice(lo, hi - lo))
                times = np.bincount(back, minlength=int(word[-1]) + 1 if len(word) else 0)
                keys, c = summed(keys, times[word])
                held_k, held_c = summed(np.concatenate([held_k, keys]), np.concatenate([held_c, c]))
                if len(held_k) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held_k.view(np.int64)), pa.array(held_c)], ["key", "c"])
                    held_k, held_c = held_k[:0], held_c[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held_k.view(np.int64)), pa.array(held_c)], ["key", "c"])

    return docs.select("text", F.col("lang").cast("string")).mapInArrow(released(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Model:
    """The arrays' place, how many shards there are, and which of them have rows."""

    path: str
    shards: int
    there: frozenset[int]
    discounts: tuple[tuple[float, float, float], ...]


def train(docs: DataFrame) -> Model:
    """Kneser-Ney counts of all orders, written as sorted arrays."""
    level = settle(count_grams(docs))
    grams = level.select(F.lit(ORDER).alias("n"), "key", "c")
    for n in range(ORDER - 1, 0, -1):
        low = (1 << (8 * n)) - 1
        suffix = F.shiftleft(F.shiftrightunsigned("key", 8 * (n + 1)), 8 * n).bitwiseOR(F.col("key").bitwiseAND(F.lit(low)))
        level = level.groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("c"))
        grams = grams.union(level.select(F.lit(n).alias("n"), "key", "c"))
    grams = settle(grams)
    tally = lambda *x: F.sum(F.col("c").isin(*x).cast("long"))
    by = {r["n"]: r for r in grams.groupBy("n").agg(*(tally(i).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()}
    found = tuple(discounts(*(by[n][f"n{i}"] for i in (1, 2, 3, 4))) if n in by else (0.5, 1.0, 1.5) for n in range(1, ORDER + 1))
    contexts = grams.groupBy("n", F.shiftrightunsigned("key", 8).alias("key")).agg(F.sum("c").alias("c"), tally(1).alias("k1"), tally(2).alias("k2"), F.sum((F.col("c") > 2).cast("long")).alias("k3"))
    shards = 2 * parts(docs, 64 << 20, least=4) + 1
    path = f"{shared_dir(docs.sparkSession)}/bytes-kneser-ney-{uuid.uuid4().hex}"
    rows = grams.select("n", "key", "c", *(F.lit(0).cast("long").alias(k) for k in ("k1", "k2", "k3")), F.lit(0).alias("kind")).union(contexts.select("n", "key", "c", "k1", "k2", "k3", F.lit(1)))

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        n, key, kind = (table[x].to_numpy() for x in ("n", "key", "kind"))
        h = gram_hash(key.view(np.uint64), n)
        for name, which in (("gram", kind == 0), ("context", kind == 1)):
            order = np.flatnonzero(which)[np.argsort(h[which])]
            values = np.stack([table[x].to_numpy()[order] for x in ("c", "k1", "k2", "k3")][: 4 if name == "context" else 1])
            store.save(f"{path}/{name}-{shard:05d}", hash=h[order], values=values)
        return pa.table({"shard": pa.array([shard], pa.int32()), "rows": pa.array([len(h)], pa.int64())})

    written = rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard").applyInArrow(write, "shard int, rows long").collect()
    return Model(path, shards, frozenset(r["shard"] for r in written), found)


def gram_hash(key: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return tc.combine(key, np.asarray(n, np.uint64) + np.zeros(len(key), np.uint64))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.m = model

    def _values(self, name: str, key: np.ndarray, n: int) -> np.ndarray:
        h, shard = gram_hash(key, n), key.view(np.int64) % self.m.shards
        out = np.zeros((4 if name == "context" else 1, len(key)), np.int64)
        for k in np.unique(shard).tolist():
            if k not in self.m.there:
                continue
            keys, values = (store.load(f"{self.m.path}/{name}-{k:05d}", x) for x in ("hash", "values"))
            own = np.flatnonzero(shard == k)
            own = own[np.argsort(h[own])]
            at, there = store.find(keys, h[own])
            out[:, own[there]] = values[:, at[there]]
        return out

    def log2(self, key: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of each full-order gram."""
        p = np.full(len(key), 1 / 256)
        lang = key >> np.uint64(8 * ORDER)
        for n in range(1, ORDER + 1):
            bits = np.uint64(8 * n)
            own = (lang << bits) | (key & np.uint64((1 << (8 * n)) - 1))
            own, back = np.unique(own, return_inverse=True)
            (c,) = self._values("gram", own, n)
            context, which = np.unique(own >> np.uint64(8), return_inverse=True)
            total, *kinds = self._values("context", context, n)[:, which]
            d = self.m.discounts[n - 1]
            left = c - np.array([0, *d])[np.minimum(c, 3)]
            weight = sum(a * b for a, b in zip(d, kinds))
            total, left, weight = total[back], left[back], weight[back]
            p = np.where(total > 0, (left + weight * p) / np.maximum(total, 1), p)
        return np.log2(p)


def base_counts(text: pa.Array, found: tuple) -> dict[str, np.ndarray]:
    """The counts by row, from the words found in the texts."""
    body, off = tc.raw(text)
    _, _, _, row, n, h, start, end = found
    rows = len(off) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return sums[off[1:]] - sums[off[:-1]]

    black = ~tc.WHITE[body]
    inked = np.append(0, np.cumsum(black))
    lo, hi, line_row = tc.spans(body, off, body != 0x0A)
    with_word = inked[hi] > inked[lo]
    lo, hi, line_row = lo[with_word], hi[with_word], line_row[with_word]
    _, kept = tc.distinct(tc.hash_spans(body, lo, hi), line_row)
    dup = np.bincount(line_row, minlength=rows) - np.bincount(kept, minlength=rows)
    w, first = tc.windows(h, row, 5)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(w):
        _, back, times = np.unique(tc.combine(w, row[first].astype(np.uint64)), return_inverse=True, return_counts=True)
        twice = first[times[back] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    again = np.cumsum(covered)[:-1] > 0
    return {"n_words": n, "word_chars": per_row(black & ((body & 0xC0) != 0x80)), "n_symbols": per_row(SYMBOLS[body]), "n_dup_lines": dup, "n_repeat_words": np.bincount(row[again], minlength=rows)}


def _measured(model: Model, text: pa.Array, lang: pa.Array) -> dict[str, np.ndarray]:
    found = _distinct_words(text, lang)
    keys, word, back, row, n, *_ = found
    out = base_counts(text, found)
    distinct_keys, which = np.unique(keys, return_inverse=True)
    log_p = Scorer(model).log2(distinct_keys)[which]
    of_word = np.bincount(word, weights=log_p, minlength=len(back) and int(back.max()) + 1)
    size = np.bincount(word, minlength=len(of_word))
    out["n_bytes"] = np.bincount(row, weights=size[back], minlength=len(n)).astype(np.int64)
    total = np.bincount(row, weights=of_word[back], minlength=len(n))
    out["bits"] = np.where(out["n_bytes"] > 0, -total / np.maximum(out["n_bytes"], 1), np.nan)
    out["word_bits"] = np.where(out["n_words"] > 0, -total / np.maximum(out["n_words"], 1), np.nan)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out


MEASURES = ", ".join(f"{c} long" for c in COUNTS) + ", n_bytes long, bits double, word_bits double, base_failed boolean"
PERPLEXITIES = ("bits", "word_bits")


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (columns text and lang among them) with the measures beside them; bits are null without words."""
    names = list(docs.columns)
    text_at, lang_at = names.index("text"), names.index("lang")
    leave = names == ["doc_id", "lang", "text"]  # then texts need not come back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = batch.column(text_at), batch.column(lang_at)
            for lo, hi in tc.slices(text, SLICE):
                out = _measured(model, text.slice(lo, hi - lo), lang.slice(lo, hi - lo))
                own = batch.slice(lo, hi - lo)
                cols = [*(own.columns[:2] if leave else own.columns), *(pa.array(x, from_pandas=True) for x in out.values())]
                yield pa.RecordBatch.from_arrays(cols, names=[*(names[:2] if leave else names), *out])

    kept = docs.schema.fields[:2] if leave else docs.schema.fields
    return docs.mapInArrow(released(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MEASURES]))


def bands(measures: DataFrame) -> DataFrame:
    """By language (band_lang): middle, lower and upper unit of each perplexity.

    Taken from the documents that pass the base rules; the units are robust
    standard deviations of the deviations times ``narrows``.
    """
    sound = measures.filter("not base_failed and bits is not null").select("lang", "n_words", *PERPLEXITIES)
    middle = sound.groupBy(F.col("lang").alias("m_lang")).agg(*(F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_mid") for c in PERPLEXITIES))
    rows = with_bands(sound, middle, "m_lang")
    quarter = lambda c: F.percentile_approx((F.col(c) - F.col(f"{c}_mid")) * narrows(), F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    rows = rows.groupBy(F.col("lang").alias("band_lang")).agg(*(x for c in PERPLEXITIES for x in (F.first(f"{c}_mid").alias(f"{c}_mid"), quarter(c).alias(f"{c}_q"))))
    least = lambda c, x: F.greatest(x / QUARTILE, 0.01 * F.col(f"{c}_mid"))
    return rows.select("band_lang", *(x for c in PERPLEXITIES for x in (f"{c}_mid", least(c, -F.col(f"{c}_q")[0]).alias(f"{c}_low"), least(c, F.col(f"{c}_q")[1]).alias(f"{c}_up"))))


def narrows() -> Column:
    """What a text's length multiplies deviations by, so that short and long texts spread alike."""
    return 1 / F.sqrt(1 / F.greatest(F.col("n_words").cast("double"), F.lit(1.0)) + 1 / LONG)


def with_bands(measures: DataFrame, found: DataFrame, key: str = "band_lang") -> DataFrame:
    """Measures beside their language's row; it is broadcast when there are few languages."""
    found = settle(found)
    few = found.count() <= BROADCAST_LANGUAGES
    return measures.join(F.broadcast(found) if few else found, measures["lang"].eqNullSafe(found[key]), "left")


def band_failed() -> Column:
    """Whether a perplexity is outside the band that stands beside it; without words or band, it is not."""
    out = F.lit(False)
    for c in PERPLEXITIES:
        z = (F.col(c) - F.col(f"{c}_mid")) * narrows()
        out = out | (z < -Z * F.col(f"{c}_low")) | (z > Z * F.col(f"{c}_up"))
    return F.coalesce(out, F.lit(False))


def judged(measures: DataFrame) -> DataFrame:
    """The measures with band_failed, symbols_failed and kept."""
    rows = with_bands(measures, bands(measures)).withColumns({"band_failed": band_failed(), "symbols_failed": F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")})
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed") & ~F.col("symbols_failed"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Documents are settled with their measures, so texts are measured once and
    never move between tasks; only the bands are joined.
    """
    names = list(docs.columns)
    inner = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang"), F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("rest"))
    rows = judged(settle(measure(inner, train(docs)))).filter("kept")
    return rows.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in names))


def verdicts(docs: DataFrame) -> DataFrame:
    """The measures of each document with ``kept``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    m = judged(settle(measure(rows, train(docs))))
    return m.select("doc_id", *COUNTS, "base_failed", "kept", "bits", "word_bits", "band_failed", "symbols_failed", "lang")
