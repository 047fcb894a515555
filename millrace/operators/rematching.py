"""Matching again only what has changed.

Distinct requests are known by a digest of their texts and of the catalogue they
were matched with. A later run matches the requests whose digest is new and takes
all others' products from the results kept; the result is that of matching all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import matching as X
from millrace.streaming.runs import saved


def catalog_version(products: DataFrame) -> str:
    """A text that changes with the catalogue's rows, whatever their order."""
    fields = F.struct("catalog_idx", "name", "model", "brand")
    return str(products.agg(F.concat_ws("-", F.count(F.lit(1)), F.sum(F.xxhash64(fields).cast("decimal(38,0)"))).alias("v")).first().v)


def digest(version: str) -> Column:
    """Of a request (name, spec, brand) under a catalogue."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    # lengths tell apart where texts end
    return F.md5(F.concat_ws("|", F.lit(version), *(F.concat_ws(":", F.length(part(c)), part(c)) for c in ("name", "spec", "brand"))))


class Prepared:
    """A catalogue ready to be matched with: its texts and words written once, for many runs."""

    def __init__(self, products: DataFrame, tokenise=X.R.keywords) -> None:
        self.products, self.tokenise = products, tokenise
        self.texts = saved(X.prepare_products(products, tokenise), "products")
        self.version = catalog_version(products)

    def match(self, requests: DataFrame, synonyms: DataFrame | None = None, most: int = 20, ratio=X.sequence_ratio) -> DataFrame:
        """As :func:`millrace.operators.matching.match`, with each request's digest."""
        found = X.match(requests, self.products, synonyms, most, tokenise=self.tokenise, prepared=self.texts, ratio=ratio)
        return found.withColumn("digest", digest(self.version))


def changed(requests: DataFrame, asked: DataFrame, version: str) -> DataFrame:
    """Distinct requests that have not been asked yet. asked (digest): all requests matched so far, with products or without."""
    own = requests.where("name <> ''").select("name", F.coalesce("spec", F.lit("")).alias("spec"), F.coalesce("brand", F.lit("")).alias("brand")).distinct()
    return own.withColumn("digest", digest(version)).join(asked.select("digest").distinct(), "digest", "left_anti")


def rematch(kept: DataFrame, asked: DataFrame, requests: DataFrame, prepared: Prepared, synonyms: DataFrame | None = None, most: int = 20, ratio=X.sequence_ratio) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The products of all distinct requests now, the digests asked by now, and the requests that were matched.

    kept: products found by earlier runs with their digest; of requests that are no more, and of other catalogues, nothing stays.
    """
    new = saved(changed(requests, asked, prepared.version), "changed")
    wanted = saved(requests.where("name <> ''").select(digest(prepared.version).alias("digest")).distinct(), "digests")
    found = prepared.match(new.drop("digest"), synonyms, most, ratio)
    out = kept.join(wanted, "digest", "left_semi").unionByName(found.select(*kept.columns)) if kept is not None else found
    return out, wanted, new


def for_lines(lines: DataFrame, matches: DataFrame, version: str) -> DataFrame:
    """Lines (with name, spec, brand) with their requests' products; a line without any keeps one empty row."""
    rows = lines.withColumn("digest", digest(version))
    return rows.join(matches.select("digest", "rank", "catalog_idx", "score", "match_type"), "digest", "left").drop("digest")
