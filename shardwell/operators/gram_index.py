"""Substring search by an inverted index of positional q-grams.

A text's grams of q characters at places 0, step, 2 step, ... become rows (gram, key, field, part, place), kept in folders by a
hash of the gram and sorted by gram inside, so that a search opens the folders of its own grams and, of those, the row
groups that hold them. A string of q + step - 1 characters or more has, among any `step` grams in a row, exactly one at an
indexed place in each of its occurrences; the search takes the rarest such window, by the counts of grams that are kept
beside the postings, and settles what it meets on the text. With step 1 a string of q characters is its own posting list, and a
shorter one is a prefix of grams. Strings too short for a sampled index are met at all places of the texts by an
equi-join of their length.

Postings of frequent grams are spread over files by their keys; a search for one fetches no more than the postings that are
its result. Nulls have no grams; empty strings are in every text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwell.sources.shared import new_folder, signature

#: Postings, or counts of grams, for each file of a folder: what a task that writes one has to sort.
FILE_ROWS = 1 << 20
TEXT = ["key", "field", "part"]


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def grams(text: Column, q: int, step: int = 1) -> Column:
    """Grams at every step-th place, in order; the last ones are shorter. (Matched, because substrings count from the start.)"""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{q}}})).{{1,{step}}}"), 1)


@dataclass(frozen=True)
class GramIndex:
    spark: SparkSession
    path: str
    key: str
    q: int
    step: int
    buckets: int
    fold: bool

    @classmethod
    def build(cls, texts: DataFrame, q: int = 3, step: int = 1, buckets: int = 32, fold: bool = False, path: str | None = None) -> GramIndex:
        """texts: key, field, part (number of a value of a field that has several), value. fold: case doesn't count."""
        spark = texts.sparkSession
        index = cls(spark, path or new_folder(spark, "grams"), dict(texts.dtypes)["key"], q, step, buckets, fold)
        path = index.path
        texts.filter("value IS NOT NULL").select("key", "field", F.col("part").cast("int"), "value").write.parquet(f"{path}/texts")
        texts = index.texts()
        chars = texts.agg(F.sum(F.length("value"))).first()[0] or 0
        spread = 1 + chars // step // (buckets * FILE_ROWS)
        rows = texts.select(*TEXT, F.posexplode(grams(index.folded(F.col("value")), q, step)).alias("n", "gram"))
        rows = rows.select("gram", *TEXT, (F.col("n") * step).alias("place"), bucket(F.col("gram"), buckets).alias("bucket"))
        file = lambda by: (F.col("bucket") * spread + F.pmod(F.xxhash64(by), F.lit(spread))).cast("int")
        dealt = rows.repartitionById(buckets * spread, file("key")).sortWithinPartitions("bucket", "gram", *TEXT, "place")
        dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
        counts = index.postings().groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts = counts.repartitionById(buckets * spread, file("gram")).sortWithinPartitions("bucket", "gram")
        counts.write.partitionBy("bucket").parquet(f"{path}/counts")
        return index

    def texts(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key}, field string, part int, value string").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"gram string, key {self.key}, field string, part int, place int, bucket int").parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.path}/counts")

    def folded(self, c: Column) -> Column:
        return F.lower(c) if self.fold else c

    def of(self, table: DataFrame, wanted: list[str]) -> DataFrame:
        """The rows of some grams: their folders, and in these their row groups."""
        return table.filter(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % self.buckets for g in wanted})) & F.col("gram").isin(wanted))

    def find(self, needle: str, fields: tuple[str, ...] = ()) -> DataFrame:
        """key, field, part of the texts (of some fields) that have the needle."""
        needle = needle.lower() if self.fold else needle
        n, q = len(needle), self.q
        within = lambda rows: rows.filter(F.col("field").isin(*fields)) if fields else rows
        has = F.contains(self.folded(F.col("value")), F.lit(needle))
        if not n:
            return within(self.texts()).select(*TEXT)
        if n < q + self.step - 1:
            if self.step == 1:
                return within(self.postings().filter(F.startswith("gram", F.lit(needle)))).select(*TEXT).distinct()
            return within(self.texts()).filter(has).select(*TEXT)
        own = [needle[k : k + q] for k in range(n - q + 1)]
        known = dict(self.of(self.counts(), sorted(set(own))).select("gram", "n").collect())  # as many as the needle has at most
        window = min(range(len(own) - self.step + 1), key=lambda k: (sum(known.get(g, 0) for g in own[k : k + self.step]), k))
        hits = within(self.of(self.postings(), sorted(set(own[window : window + self.step])))).select(*TEXT).distinct()
        return hits if n == q else hits.join(self.texts(), TEXT).filter(has).select(*TEXT)

    def find_all(self, needles: DataFrame) -> DataFrame:
        """id, key, field, part: the texts that have each needle (id, needle)."""
        q, step = self.q, self.step
        needles = needles.filter("needle IS NOT NULL").select("id", self.folded(F.col("needle")).alias("needle"))
        value = self.folded(F.col("value"))
        long = needles.filter(F.length("needle") >= q + step - 1)
        own = long.select("id", F.posexplode(grams(F.col("needle"), q)).alias("offset", "gram")).filter(F.length("gram") == q)
        own = own.withColumn("bucket", bucket(F.col("gram"), self.buckets))
        some = [r[0] for r in own.select("bucket").distinct().collect()]  # no more than there are folders
        counted = own.join(self.counts().filter(F.col("bucket").isin(some)), ["bucket", "gram"], "left")
        ahead = Window.partitionBy("id").orderBy("offset").rowsBetween(0, step - 1)  # the grams of one needle
        sums = counted.withColumn("sum", F.sum(F.coalesce("n", F.lit(0))).over(ahead)).withColumn("size", F.count("*").over(ahead))
        best = sums.filter(F.col("size") == step).groupBy("id").agg(F.min(F.struct("sum", "offset"))["offset"].alias("window"))
        asked = own.join(best, "id").filter(F.col("offset").between(F.col("window"), F.col("window") + step - 1)).select("id", "bucket", "gram", "offset").withColumnRenamed("id", "_id")
        met = self.postings().filter(F.col("bucket").isin(some)).join(asked, ["bucket", "gram"]).filter(F.col("place") >= F.col("offset")).select("_id", *TEXT).distinct()
        found = met.join(long.withColumnRenamed("id", "_id"), "_id").join(self.texts(), TEXT).filter(F.contains(value, F.col("needle"))).select(F.col("_id").alias("id"), *TEXT)
        short = needles.filter(F.length("needle").between(1, q + step - 2))
        for (n,) in sorted(short.select(F.length("needle")).distinct().collect()):  # fewer lengths than q + step
            each = self.texts().select(*TEXT, F.explode(F.array_distinct(grams(value, n))).alias("needle"))
            found = found.unionByName(each.join(short.filter(F.length("needle") == n), "needle").select("id", *TEXT))
        empty = needles.filter("needle = ''").agg(F.collect_list("id").alias("ids"))  # they are in every text
        return found if empty.filter(F.size("ids") > 0).isEmpty() else found.unionByName(self.texts().crossJoin(F.broadcast(empty)).select(F.explode("ids").alias("id"), *TEXT))


_BUILT: dict[tuple, GramIndex] = {}


def index_of(source: DataFrame, texts: DataFrame, **options) -> GramIndex:
    """The index of texts, which come from the files of source; built again only if these have changed."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, texts._jdf.queryExecution().analyzed().semanticHash(), signature(source), tuple(sorted(options.items())))
    if key not in _BUILT:
        _BUILT[key] = GramIndex.build(texts, **options)
    return _BUILT[key]
