"""Benchmark decontamination by SimHash over item-sized windows. Native: DataFrame functions only.

1. A few pairs of long words of each item are its anchors, so many and so far apart that a window without any of them
   lacks too many runs of WIDTH words to pass; documents without an anchor go no further. In the others every run that
   some item has (an item of fewer words is a run by itself) begins a window of that item's size (the document's last
   one, if it ends before). A window that begins with another run shares no less when it is moved on to the next shared
   one, so the best window is among these. Those with too few shared runs can't pass. The one with most is judged first,
   others only if they could be better.
2. Windows and items get SimHash fingerprints over their runs, each weighted by how often it occurs.
3. Multi-index blocks: two fingerprints within RADIUS bits agree in one of RADIUS + 1 blocks at least, so an equi-join
   on (item, block, bits) finds them all; the complete distance is verified.
4. The weighted similarity of what is left is computed exactly: shared weight of runs over the larger total weight.

At a similarity of 0.8 or more the distance of two fingerprints is about 13 on average and beyond 24 in about one case
in ten thousand, so RADIUS = 26 loses nothing in practice; the tests hold it against brute force.

Defined results: null texts count as empty and match nothing; an item without words matches nothing; repeated rows add
nothing (one row for each pair of ids, of the best window of any text of that id); drop_contaminated judges each row by
its own text, whatever other rows share its id; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, free_name, text_or_empty, words_of

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 26
#: So many runs of items (about 40 bytes each) go to all tasks; more are met by a shuffled join.
SET_LIMIT = 100_000
#: Below this similarity the zones of anchors would meet, and documents are not filtered by them.
ANCHORED = 0.5


def runs(words: str, width: int) -> Column:
    """Hashes of all runs of width words of the array column; its position is that of the first word."""
    w = F.col(words)
    shifted = [F.slice(w, k + 1, F.greatest(F.size(w) - (width - 1), F.lit(0))) for k in range(width)]
    names = [f"w{k}" for k in range(width)]
    zipped = F.arrays_zip(*(s.alias(n) for s, n in zip(shifted, names, strict=True)))
    return F.transform(zipped, lambda x: F.xxhash64(F.lit(width), *(x[n] for n in names)))


def simhash(hashes: str) -> Column:
    """64-bit fingerprint of an array column of hashes, repeats weighted by their number."""
    bits = f"transform(sequence(0, 63), k -> aggregate({hashes}, 0, (a, h) -> a + CAST(shiftrightunsigned(h, k) & 1L AS INT)))"
    return F.expr(f"aggregate(transform({bits}, (c, k) -> IF(2 * c > size({hashes}), shiftleft(1L, k), 0L)), 0L, (a, b) -> a | b)")


def blocks(fp: str, n: int) -> Column:
    """n blocks (index, bits) of the fingerprint."""
    cuts = [64 * k // n for k in range(n + 1)]
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*parts)


def shared(a: str, b: str) -> Column:
    """Weight that two arrays of hashes share: of each value the smaller number of times."""
    return F.expr(f"aggregate(array_distinct({a}), 0, (n, h) -> n + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))")


def item_table(items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """item_id, n_words, width, words, runs (hashes), fp."""
    words = items.select(F.col(item_col).alias("item_id"), words_of(text_or_empty(text_col)).alias("words")).filter(F.size("words") > 0).distinct()
    sized = words.select("item_id", "words", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(width)).alias("width"))
    hashed = None
    for k in range(1, width + 1):
        part = sized.filter(F.col("width") == k).select("item_id", "n_words", "width", "words", runs("words", k).alias("runs"))
        hashed = part if hashed is None else hashed.unionByName(part)
    return hashed.withColumn("fp", simhash("runs"))


def anchors(table: DataFrame, similarity: float, width: int) -> DataFrame:
    """Distinct (word, pair): words, and pairs of words of which they are the first, at least one of which is in every
    window that passes.

    Two neighbouring words `width` or more from both ends are in `width - 1` runs. Pairs that far apart share none, so k
    of them missing cost k * (width - 1) runs: k is the least number for which that is more than a passing window may
    lack. An item of one word has no pair.
    """
    spare = f"CAST(floor((n_words - {width - 1}) * {1 - similarity} + 1e-9) AS INT)"
    inner = table.withColumn("k", F.expr(f"IF(n_words < {2 * width - 1}, 1, {spare} div {width - 1} + 1)"))
    inner = inner.withColumn("step", F.expr(f"IF(k = 1, n_words + {width}, (n_words - {width - 1}) div k)"))
    inner = inner.withColumn("from", F.expr(f"IF(n_words < {2 * width - 1}, 0, {width - 1})"))
    inner = inner.withColumn("size", F.expr(f"IF(n_words < {2 * width - 1}, n_words, IF(k = 1, n_words - {2 * (width - 1)}, step - {width - 1}))"))
    # the longest word of each zone but its last one, so that the pair lies within
    spot = "from + z * step + i"
    longest = f"array_max(transform(sequence(0, greatest(size - 2, 0)), i -> struct(length(get(words, {spot})) AS n, get(words, {spot}) AS word, get(words, {spot} + 1) AS next)))"
    picked = inner.select(F.explode(F.expr(f"transform(sequence(0, k - 1), z -> {longest})")).alias("a"))
    return picked.select("a.word", F.concat("a.word", F.lit(" "), "a.next").alias("pair")).distinct()


def anchored(docs: DataFrame, text_col: str, found: list) -> DataFrame:
    """The documents that have an anchor: first by their words in small letters, lower() also meeting other capitals, on
    both sides alike; then by words as they count."""

    def has(words: Column, firsts: set[str], pairs: set[str], lone: set[str]) -> Column:
        def met(x: Column, y: Column) -> Column:  # a pair is looked up only where its first word is
            hit = x.isin(sorted(firsts)) & F.concat(x, F.lit(" "), y).isin(sorted(pairs))
            return hit | x.isin(sorted(lone)) if lone else hit

        each = lambda w: F.array_contains(F.zip_with(w, F.slice(w, 2, F.size(w)), met), True)
        return F.exists(F.array(words), each)  # binds the words once

    rough = F.split(F.lower(text_or_empty(text_col)), SPACES)
    paired = [r for r in found if r["pair"]]
    some = docs.filter(has(rough, {r["rough"] for r in paired}, {r["rough_pair"] for r in paired}, {r["rough"] for r in found if not r["pair"]}))
    return some.filter(has(words_of(text_or_empty(text_col)), {r["word"] for r in paired}, {r["pair"] for r in paired}, {r["word"] for r in found if not r["pair"]}))


def findings(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, similarity: float, width: int, radius: int) -> DataFrame:
    """doc_id, digest (of the text), item_id, similarity, window_start, n_words: the best window of each text and item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    table = scratch.write(item_table(items, item_col, width=width), "items")
    starts = scratch.write(table.select("item_id", "n_words", "width", F.posexplode("runs").alias("at", "run")), "runs")
    widths = sorted(r[0] for r in starts.select("width").distinct().collect()) or [width]  # width values at most
    few = starts.count() <= SET_LIMIT

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if few and similarity >= ANCHORED:
        found = anchors(table, similarity, width).select("*", F.lower("word").alias("rough"), F.lower("pair").alias("rough_pair")).collect()  # about one in ten words of the items
        rows = anchored(rows, "text", found) if found else rows.limit(0)
    base = rows.select("doc_id", F.sha2(text_or_empty("text").cast("binary"), 256).alias("digest"), words_of(text_or_empty("text")).alias("words"))
    indexed = [F.transform(runs("words", k), lambda h, i: F.struct(i.alias("pos"), h.alias("run"))) for k in widths]
    found = base.withColumn("all_runs", F.concat(*indexed) if len(indexed) > 1 else indexed[0])
    if few:
        known = [r[0] for r in starts.select("run").distinct().collect()]
        hits = found.withColumn("hits", F.filter("all_runs", lambda x: x["run"].isin(known))).drop("all_runs").filter(F.size("hits") > 0)
    else:
        flat = found.select("doc_id", "digest", F.explode("all_runs").alias("x")).select("doc_id", "digest", "x", "x.run")
        met = flat.join(starts.select("run").distinct(), "run", "left_semi").groupBy("doc_id", "digest").agg(F.collect_set("x").alias("hits"))
        met = met.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "hits")
        hits = base.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).drop("_id", "_digest")
    held = scratch.write(hits.dropDuplicates(["doc_id", "digest"]), "held")

    each = held.select("doc_id", "digest", F.size("words").alias("size"), F.explode("hits").alias("x")).select("doc_id", "digest", "size", "x.pos", "x.run")
    places = starts.select("item_id", "n_words", "width", "run").distinct()
    met = each.join(F.broadcast(places) if few else places, "run").drop("run")
    total = F.col("n_words") - F.col("width") + 1
    start = F.greatest(F.least(F.col("pos"), F.col("size") - F.col("n_words")), F.lit(0))
    met = met.select("doc_id", "digest", "item_id", "n_words", "width", total.alias("total"), "pos", start.alias("start"))
    one = Window.partitionBy("doc_id", "digest", "item_id")
    # up to total - 1 further
    ahead = F.expr("count(*) OVER (PARTITION BY doc_id, digest, item_id ORDER BY pos / total RANGE BETWEEN CURRENT ROW AND 0.999999D FOLLOWING)")
    alike = F.count("*").over(Window.partitionBy("doc_id", "digest", "item_id", "start"))  # at the end of the document
    bound = F.least(F.greatest(ahead, alike), F.col("total"))
    starting = met.withColumn("bound", bound).filter(F.col("bound") >= similarity * F.col("total") - 1e-9)
    starting = starting.groupBy("doc_id", "digest", "item_id", "n_words", "width", "total", "start").agg(F.max("bound").alias("bound"))
    first = F.row_number().over(one.orderBy(F.desc("bound"), "start"))
    windows = scratch.write(starting.withColumn("rank", first).withColumn("top", F.max("bound").over(one)), "windows")

    best = scratch.write(_best(windows.filter("rank = 1"), held, table, widths, similarity, radius), "best")
    own = best.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("item_id").alias("_item"), "m.similarity")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & F.col("item_id").eqNullSafe(F.col("_item"))
    more = windows.filter("rank > 1").join(own, same, "left").withColumn("met", F.coalesce("similarity", F.lit(0.0)))
    more = more.filter((F.col("met") < F.col("top") / F.col("total")) & (F.col("bound") / F.col("total") >= F.col("met"))).select(*windows.columns)
    rest = _best(more, held, table, widths, similarity, radius)
    return best.unionByName(rest).groupBy("doc_id", "digest", "item_id").agg(F.max("m").alias("m"))


def _best(windows: DataFrame, held: DataFrame, table: DataFrame, widths: list[int], similarity: float, radius: int) -> DataFrame:
    """doc_id, digest, item_id and m (similarity, -window_start, n_words) of the best of the windows that pass."""
    words = held.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "words")
    cut = windows.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    cut = cut.select("doc_id", "digest", "item_id", "n_words", "width", "start", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("window"))
    hashed = None
    for k in widths:
        part = cut.filter(F.col("width") == k).select("doc_id", "digest", "item_id", "n_words", "start", runs("window", k).alias("own"))
        hashed = part if hashed is None else hashed.unionByName(part)
    hashed = hashed.filter(F.size("own") > 0).groupBy("doc_id", "digest", "item_id", "n_words", "own").agg(F.min("start").alias("start"))
    hashed = hashed.withColumn("own_fp", simhash("own"))
    n = radius + 1
    probe = hashed.select("*", F.explode(blocks("own_fp", n)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    index = table.select("item_id", "fp", F.explode(blocks("fp", n)).alias("b")).select("item_id", "fp", "b.block", "b.bits")
    near = probe.join(index, ["item_id", "block", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("own_fp"))) <= radius)
    near = near.select("doc_id", "digest", "item_id", "n_words", "start", "own").distinct()
    verified = near.join(table.select("item_id", "runs"), "item_id")
    verified = verified.withColumn("similarity", shared("own", "runs") / F.greatest(F.size("own"), F.size("runs"))).filter(F.col("similarity") >= similarity)
    return verified.groupBy("doc_id", "digest", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("at"), F.col("n_words"))).alias("m"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item that it holds: id, item_id, similarity, window_start, n_words."""
    best = findings(docs, items, id_col, text_col, item_col, similarity, width, radius).groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return best.select(F.col("doc_id").alias(id_col), "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.at")).alias("window_start"), F.col("m.n_words").alias("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows whose text holds no item."""
    name = free_name(docs, "lost")
    lost = findings(docs, items, id_col, text_col, item_col, SIMILARITY, WIDTH, RADIUS).select(F.struct("doc_id", "digest").alias(name)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(f"{name}.doc_id")) & (F.sha2(text_or_empty(text_col).cast("binary"), 256) == F.col(f"{name}.digest"))
    return docs.join(lost, same, "left_anti")
