"""A stored lexical index: postings in term order, document frequencies, corpus statistics.

It is built once for a corpus and application, in the shared folder; queries read
only the row groups that hold their terms. ``patched`` keeps it up with a log of
changed documents without reading the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .shared import cut, stands

#: Distinct query terms up to which they are pushed into the scan of the postings.
PUSHED_TERMS = 1_000


@dataclass(frozen=True)
class Lexicon:
    """postings (term, id, tf, dl) and terms (term, df), both stored in term order; two numbers for the corpus."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    mean_length: float

    def of(self, wanted: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """(postings, terms), with the terms pushed down where they are listed."""
        if wanted is None:
            return self.postings, self.terms
        return self.postings.where(F.col("term").isin(wanted)), self.terms.where(F.col("term").isin(wanted))


def postings(docs: DataFrame, id_: str = "id", text: str = "content") -> DataFrame:
    """(id, term, tf, dl): one row for each distinct term of a document."""
    t = docs.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("_t"))
    return t.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def build(docs: DataFrame, id_: str = "id", text: str = "content", parts: bool = False) -> Lexicon:
    """The index of documents; with ``parts``, rows that share an id are parts of one document, which is never put together."""
    if parts:
        size = docs.groupBy(F.col(id_).alias("id")).agg(F.sum(F.size(tokens(F.col(text)))).cast("int").alias("dl"))
        size = cut(size, "lengths")
        p = docs.select(F.col(id_).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        return _stored(p.join(size, "id"), size.agg(F.count("*").alias("n"), F.avg("dl").alias("l")))
    lengths = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("l"))
    return _stored(postings(docs, id_, text), lengths)


def _stored(rows: DataFrame, lengths: DataFrame) -> Lexicon:
    stored = cut(rows.select("term", "id", "tf", "dl").repartitionByRange("term").sortWithinPartitions("term"), "postings")
    terms = cut(stored.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    n = lengths.first()
    return Lexicon(stored, terms, n.n, n.l or 0.0)


_BUILT: dict[tuple, Lexicon] = {}


def lexicon(docs: DataFrame, id_: str = "id", text: str = "content", parts: bool = False) -> Lexicon:
    """The index of a corpus, built at its first use; other files, or another plan over them, are another corpus. One whose folder was cleared is built again."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, docs.semanticHash(), tuple(sorted(docs.inputFiles())), id_, text, parts)
    known = _BUILT.get(key)
    if known is None or not (stands(known.postings) and stands(known.terms)):
        known = _BUILT[key] = build(docs, id_, text, parts)
    return known


def patched(index: Lexicon, changed: DataFrame, removed: DataFrame, id_: str = "id", text: str = "content") -> Lexicon:
    """The index after ``changed`` documents (new texts, also of known ids) and ``removed`` ids.

    Postings of touched documents go and those of new texts come; a document
    without any word counts as long as it isn't touched.
    """
    touched = changed.select(F.col(id_).alias("id")).unionByName(removed.select(F.col(id_).alias("id"))).distinct()
    kept = index.postings.join(touched, "id", "left_anti")
    new = postings(changed, id_, text)
    before = index.postings.join(touched, "id", "left_semi").groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
    after = changed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(F.col(text)))), F.lit(0)).alias("l")).first()
    docs = index.docs - before.n + after.n
    total = index.docs * index.mean_length - before.l + after.l
    spark = index.postings.sparkSession
    return _stored(kept.unionByName(new.select(*kept.columns)), spark.range(1).select(F.lit(docs).alias("n"), F.lit(total / docs if docs else 0.0).alias("l")))
