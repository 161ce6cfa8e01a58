"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies a likelihood of the text (hashed byte trigrams), how often
texts of the language declare what this one declares, and a prior of its host. Host priors are
smoothed hierarchically: host towards site (the last two labels), site towards address suffix,
suffix towards all rows. Counts come from grouped aggregates over all rows. A further class,
"und", stands for what is no language: there trigrams are all equally likely.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch, bounded_batches, tidy, utf8_chunks

UNDETERMINED = "und"
#: Buckets of trigrams; training rows for each language and how many characters of each are read.
BUCKETS, TRAIN_ROWS, TRAIN_CHARS = 1 << 15, 300, 20_000
#: Shorter texts are learned from only where a language has no more of others than are looked at; trigrams overlap, so their evidence is divided.
SHORT_CHARS, OVERLAP = 40, 3.0
#: Prior weight of "und", pseudo-counts of each level of hosts and of declarations.
UND_PRIOR, HOST_WEIGHT, DECLARED_WEIGHT = 0.01, 20.0, 2.0


@dataclass(frozen=True)
class Model:
    """Log likelihoods of trigrams by language; ``und`` is the last class."""

    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x classes

    @property
    def classes(self) -> list[str]:
        return [*self.languages, UNDETERMINED]

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed log likelihoods (rows x classes) and the number of letter bytes of each row."""
        sums, counts = [], []
        for _, raw, offsets in utf8_chunks(column):
            bucket, row = trigrams(raw, offsets)
            n = len(offsets) - 1
            letters = np.cumsum(np.r_[0, _LOWER[raw] != 32])
            counts.append(letters[offsets[1:]] - letters[offsets[:-1]])
            own = np.empty((n, self.table.shape[1]))
            for c in range(self.table.shape[1]):
                own[:, c] = np.bincount(row, weights=self.table[:, c][bucket], minlength=n)
            sums.append(own)
        if not sums:
            return np.zeros((0, self.table.shape[1])), np.zeros(0, np.int64)
        return np.concatenate(sums), np.concatenate(counts)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# digits, punctuation and white space tell nothing about the language: all are a blank
_LOWER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each byte trigram that holds at most one blank, within rows."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[raw].astype(np.uint32)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blanks = (low == 32).astype(np.int8)
    ok = (row[:-2] == row[2:]) & (blanks[:-2] + blanks[1:-1] + blanks[2:] <= 1)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket[ok].astype(np.int64), row[:-2][ok]


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """Learns every label from at most TRAIN_ROWS rows, of each at most the first TRAIN_CHARS characters.

    A label is learned however rare it is; blank ones and "und" name no language. The rows are those
    with the smallest hashes, texts of SHORT_CHARS or more first; of frequent labels among about
    twice as many that a hash threshold lets through, so that no task gets more than a bounded
    number of rows of a label. The driver gets counts of trigrams: memory follows the labels.
    """
    bounded_batches(rows.sparkSession)
    named = (F.trim(F.col(label)) != "") & (F.col(label) != UNDETERMINED)
    usable = rows.where(named & (F.trim(F.col(text)) != "")).select(F.col(label).alias("label"), F.substring(F.col(text), 1, TRAIN_CHARS).alias("text"), (F.length(text) < SHORT_CHARS).alias("short"), F.xxhash64(key, text).alias("h"))
    often = usable.where("NOT short").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > 2 * TRAIN_ROWS).collect()
    some = usable
    if often:
        top = F.create_map(*[F.lit(x) for r in often for x in (r["label"], int(2 * TRAIN_ROWS / r["n"] * (1 << 31)))])
        most = F.when(F.col("short"), F.when(top[F.col("label")].isNotNull(), F.lit(-1))).otherwise(top[F.col("label")])
        some = usable.where(F.pmod("h", F.lit(1 << 31)) <= F.coalesce(most, F.lit(1 << 31)))
    ranked = some.withColumn("r", F.expr("row_number() OVER (PARTITION BY label ORDER BY short, h, text)")).where(F.col("r") <= TRAIN_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_trigram_counts([t]) for t in batch.column(1).to_pylist()]
            found = [np.flatnonzero(c) for c in made]
            n = [len(f) for f in found]
            flat = pa.array(np.concatenate([c[f] for c, f in zip(made, found, strict=True)]) if n else [], pa.int64())
            labels = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([labels, pa.array(np.concatenate(found) if n else [], pa.int64()), flat], names=["label", "bucket", "n"])

    counted = ranked.select("label", "text").mapInArrow(tidy(run), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("label").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))
    counts = {}
    for r in packed.toLocalIterator():
        counts[r["label"]] = np.zeros(BUCKETS)
        counts[r["label"]][r["buckets"]] = r["ns"]
    return _model(counts)


def _trigram_counts(texts: list[str]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for _, raw, offsets in utf8_chunks(pa.array(texts, pa.string())):
        out += np.bincount(trigrams(raw, offsets)[0], minlength=BUCKETS)
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    return _model({language: _trigram_counts(texts) for language, texts in samples.items()})


def _model(by_language: dict[str, np.ndarray]) -> Model:
    languages = tuple(sorted(by_language))
    counts = np.column_stack([by_language[x] for x in languages]) if languages else np.zeros((BUCKETS, 0))
    smooth = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)) if languages else counts
    return Model(languages, np.c_[smooth, np.full(BUCKETS, -np.log(BUCKETS))])


def text_evidence(rows: DataFrame, model: Model, columns: dict[str, Column]) -> DataFrame:
    """The given columns with evidence (log likelihood by class), n_letters and text_language."""
    own = rows.select(*[c.alias(n) for n, c in columns.items()])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    names = [c for c in own.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = model.likelihoods(batch.column(batch.schema.get_field_index("text")))
            sums = sums / OVERLAP
            best = [model.classes[i] if k else UNDETERMINED for i, k in zip(sums.argmax(1), n, strict=True)]
            evidence = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), len(model.classes)).cast(pa.list_(pa.float64()))
            made = [evidence, pa.array(n, pa.int64()), pa.array(best, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *made], names=[*names, "evidence", "n_letters", "text_language"])

    return own.mapInArrow(tidy(run), f"{kinds}, evidence array<double>, n_letters long, text_language string")


def _counts(rows: DataFrame, by: str, classes: list[str]) -> DataFrame:
    found = [F.count_if(F.col("text_language") == c).cast("double") for c in classes]
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*found).alias("n"))


def _smoothed(n: str, prior: str, weight: float) -> Column:
    """Shares of the counts ``n``, drawn towards ``prior``."""
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(n, prior, lambda a, p: (a + p * F.lit(weight)) / total)


def host_priors(rows: DataFrame, classes: list[str]) -> DataFrame:
    """host, prior: the language shares of each host, by way of its site and its suffix."""
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.first("site", True).alias("site"), F.first("suffix", True).alias("suffix"), F.array(*[F.count_if(F.col("text_language") == c).cast("double") for c in classes]).alias("n"))
    add = [F.sum(F.col("n")[i]) for i in range(len(classes))]
    whole = hosts.agg(*[F.coalesce(x, F.lit(0.0)) for x in add]).first()  # a number for each class
    everywhere = F.array(*[F.lit((n + 1.0) / (sum(whole) + len(classes))) for n in whole])
    suffixes = hosts.groupBy("suffix").agg(F.array(*add).alias("n")).select("suffix", _smoothed("n", everywhere, HOST_WEIGHT).alias("suffix_prior"))
    sites = hosts.groupBy("site", "suffix").agg(F.array(*add).alias("n")).alias("s")
    sites = sites.join(suffixes.alias("x"), F.col("s.suffix").eqNullSafe(F.col("x.suffix"))).select("s.site", "s.suffix", _smoothed("n", F.col("suffix_prior"), HOST_WEIGHT).alias("site_prior"))
    joined = hosts.alias("h").join(sites.alias("s"), F.col("h.site").eqNullSafe(F.col("s.site")) & F.col("h.suffix").eqNullSafe(F.col("s.suffix")))
    return joined.select("h.host", _smoothed("n", F.col("site_prior"), HOST_WEIGHT).alias("prior"))


def identify(rows: DataFrame, scratch: Scratch, model: Model, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: Column | None = None) -> DataFrame:
    """key, text_key, language, confidence, text_language, declared, n_letters, kept.

    ``declared`` names a column that declares the language, such as a markup attribute; it is no evidence of its
    own where the model learned the same rows by it as their label. ``host`` is the host of the address, if any. kept is false where the most
    probable class is "und". Null and empty texts and those without letters are "und";
    one of a letter or two has no trigram and goes by the other evidence. Null hosts take no prior, null declarations no
    evidence; rows that repeat a text get the same result each; an empty table gives no rows;
    other columns are ignored.
    """
    bounded_batches(rows.sparkSession)
    classes = model.classes
    host = (F.lit(None) if host is None else F.lower(host)).cast("string")
    said = (F.lower(F.substring_index(F.trim(F.col(declared)), "-", 1)) if declared else F.lit(None)).cast("string")
    own = text_evidence(rows, model, {"row_id": F.col(key), "text_key": F.xxhash64(text), "declared": said, "host": host, "text": F.col(text)})
    labels = F.split("host", r"\.")
    own = own.withColumn("site", F.substring_index("host", ".", -2)).withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)))
    own = scratch.write(own, "evidence")

    # how often texts of each language declare each value; a value nobody declares tells nothing
    shares = _counts(own, "declared", classes)
    *totals, values = shares.agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0.0)) for i in range(len(classes))], F.count("*")).first()
    whole = F.array(*[F.lit(t + DECLARED_WEIGHT * max(1, values)) for t in totals])
    shares = shares.select("declared", F.zip_with("n", whole, lambda a, t: F.log((a + DECLARED_WEIGHT) / t)).alias("said"))
    # written tables: small ones are broadcast, else the engine can split the joins at a common value
    shares, priors = scratch.write(shares, "shares"), scratch.write(host_priors(own, classes), "priors")

    none = F.array(*[F.lit(0.0) for _ in classes])
    joined = own.join(shares, "declared", "left").join(priors, "host", "left")
    flat = F.array(*[F.lit(float(np.log(UND_PRIOR if c == UNDETERMINED else 1.0))) for c in classes])
    score = F.zip_with("evidence", F.coalesce("said", none), lambda a, b: a + b)
    score = F.zip_with(score, F.coalesce(F.transform("prior", lambda p: F.log(p)), none), lambda a, b: a + b)
    joined = joined.withColumn("score", F.zip_with(score, flat, lambda a, b: a + b))
    best = F.array_max("score")
    named = F.array(*map(F.lit, classes))
    language = F.when(F.col("n_letters") == 0, F.lit(UNDETERMINED)).otherwise(F.element_at(named, F.array_position("score", best).cast("int")))
    confidence = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - best))
    out = joined.select("row_id", "text_key", language.alias("language"), confidence.alias("confidence"), "text_language", "declared", "n_letters")
    return out.withColumn("kept", F.col("language") != UNDETERMINED).withColumnRenamed("row_id", key)


def page_host(url: str = "url") -> Column:
    return F.try_parse_url(F.col(url), F.lit("HOST"))


def markup_language(html: str = "html") -> Column:
    """The lang attribute of the html element, if it declares one."""
    found = F.regexp_extract(F.col(html), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.when(found != "", found)


def markup_text(html: str = "html") -> Column:
    """The text between tags, without scripts and styles."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, declared, host. The source stands for the host; lang is the model's label and so declares nothing."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """The same of web pages: doc_id is -1 - page_id, so that ids of pages and documents never meet."""
    return pages.select((-1 - F.col("page_id")).cast("long").alias("doc_id"), markup_text().alias("text"), markup_language().alias("declared"), page_host().alias("host"))


def keep_identified(docs: DataFrame, scratch: Scratch, model: Model) -> DataFrame:
    """The documents whose language is determined, with all their columns; null ids stay."""
    found = identify(evidence_of_documents(docs), scratch, model, declared="declared", host=F.col("host"))
    rejected = found.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = (docs["doc_id"] == rejected["_id"]) & (F.xxhash64(docs["text"]) == rejected["_key"])
    return docs.join(rejected, same, "left_anti")
