"""Information-theoretic sanitisation of personal data. Native: DataFrame functions only.

Protected entities are what the base patterns find: emails, IP addresses, cards, phones. Over the distinct texts of the
corpus, IC(e) = ln(N / f(e)) is the information that knowing entity e gives, and PMI(t; e) = ln(N f(t, e) / (f(t) f(e)))
the part of it that a term t near e gives away; f counts distinct texts, so that copies add no evidence. A term of at
least SUPPORT texts beside e whose PMI reaches DISCLOSURE of IC(e) discloses e: beside e it must go as well. It is generalised
to its first PREFIX letters if that form discloses less than the threshold, else removed.

A term stands beside an entity if it is one of CONTEXT words within REACH characters on a side, up to the next entity of
its kind; so pairs are linear in the occurrences of entities, whatever a text holds. Only documents with entities take
part in the pairs; all documents give the counts of the pairs' terms, by partial aggregates of (term, text). Texts are
never shuffled. The patterns are written so that they can't backtrack: they start where a run of their characters does.

Defined results: null text is empty; patterns that fail their test (parts over 255, Luhn, number of digits) are dropped
without another try inside them; spans count code points, ends exclusive, base spans by kind and then start, terms
after them; repeated rows each get a row and count as one text; a null id is a row like any other; columns of other
names are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, lower_ascii, text_or_empty

CONTEXT, REACH = 8, 200
SUPPORT, DISCLOSURE = 3, 0.95
PREFIX = 4
#: Candidate terms (some 50 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 100_000
KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract, with starts and possessive repeats that leave their matches alike.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: What a text must have for its pattern to be tried.
SIGNS = dict(zip(KINDS, (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){15}", r"\+[0-9]"), strict=True))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"
#: Terms have no digit, @ or +: such words are entities or parts of them.
NO_TERM = "[0-9@+]"
SPACE = r"[\x20\x09-\x0D]"

_CHUNK = 256


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.right(p, F.lit(3)).cast("int") <= 255))
    n = F.length(digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def starts(gaps: Column, sizes: Column) -> Column:
    """Where each match begins: gaps before the matches and their sizes, summed up in chunks, so in time near linear."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, m: F.struct(g.alias("gap"), m.alias("size")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda c: F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK)))
    none = F.array().cast("array<int>")

    def walk(base: Column, chunk: Column) -> Column:
        zero = F.struct(base.alias("at"), none.alias("out"))
        return F.aggregate(chunk, zero, lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")))["out"]

    def whole(a: Column, chunk: Column) -> Column:
        moved = F.aggregate(chunk, a["at"], lambda t, x: t + x["gap"] + x["size"])
        return F.struct(moved.alias("at"), F.concat(a["out"], walk(a["at"], chunk)).alias("out"))

    found = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), whole)["out"]
    return F.when(F.size(sizes) > 0, found).otherwise(none)


def _words(text: Column, base: Column) -> Column:
    """Words of a short text that begins at base: (term, start, end) of each, without punctuation at its ends."""
    first = F.struct(base.alias("at"), F.array().cast("array<struct<word: string, at: int>>").alias("out"))
    return F.aggregate(F.split(text, SPACE, -1), first, lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.when(w == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(w.alias("word"), a["at"].alias("at"))))).alias("out")))["out"]


def _term(w: Column) -> Column:
    left = F.ltrim(w["word"], F.lit(PUNCTUATION))
    own = F.rtrim(left, F.lit(PUNCTUATION))
    start = w["at"] + F.length(w["word"]) - F.length(left)
    return F.struct(lower_ascii(own).alias("term"), start.alias("start"), (start + F.length(own)).alias("end"))


def _context(left: Column, right: Column, start: Column, end: Column) -> Column:
    """Terms on both sides of an entity; a word that the reach cuts is left out."""
    short, n = F.length(left) <= REACH, F.lit(CONTEXT)
    base = start - F.least(F.length(left), F.lit(REACH))
    before = F.filter(_words(F.right(left, F.lit(REACH)), base), lambda w: short | (w["at"] > base))
    before = F.slice(before, F.greatest(F.size(before) - CONTEXT + 1, F.lit(1)), n)
    after = F.filter(_words(F.left(right, F.lit(REACH)), end), lambda w: (F.length(right) <= REACH) | (w["at"] + F.length(w["word"]) < end + REACH))
    terms = F.transform(F.concat(before, F.slice(after, 1, CONTEXT)), _term)
    return F.filter(terms, lambda t: (t["term"] != "") & ~t["term"].rlike(NO_TERM))


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column a kind: its matches that pass, as structs of start, end, entity and terms."""
    for kind in KINDS:
        tried = F.col(text).rlike(SIGNS[kind])
        docs = docs.withColumn("_m", F.when(tried, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, PATTERNS[kind], -1)))
        docs = docs.withColumn("_at", F.when(F.size("_m") > 0, starts(F.transform("_p", F.length), F.transform("_m", F.length))))
        value = {"email": lambda m: lower_ascii(m), "ip": lambda m: m}.get(kind, digits)
        met = F.transform("_m", lambda m, i: F.struct(m.alias("match"), i.alias("i")))
        met = F.filter(met, lambda x: passes(kind, x["match"]))

        def entry(x: Column) -> Column:
            at = F.get("_at", x["i"])
            end = at + F.length(x["match"])
            return F.struct(at.alias("start"), end.alias("end"), F.concat(F.lit(f"{kind}:"), value(x["match"])).alias("entity"), _context(F.get("_p", x["i"]), F.get("_p", x["i"] + 1), at, end).alias("terms"))

        docs = docs.withColumn(kind, F.transform(met, entry)).drop("_m", "_p", "_at")
    return docs


def general(term: Column) -> Column:
    """What a term is generalised to."""
    return F.concat(F.left(term, F.lit(PREFIX)), F.lit("*"))


def _share(n: Column, both: Column, own: Column, entity: Column) -> Column:
    """PMI(t; e) / IC(e)."""
    return F.log(n * both / (own * entity)) / F.log(n / entity)


class Sanitiser:
    """Base spans of all rows, and the terms that the corpus shows to disclose entities.

    texts: keeps the texts of rows with entities beside their spans, for sanitised().
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False):
        self.scratch = Scratch(docs.sparkSession, "sanitise")
        whole = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
        self.digest = F.unhex(F.md5(F.col("text").cast("binary")))
        found = occurrences(whole.withColumn("digest", self.digest))
        span = lambda k: F.transform(KINDS[k], lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        every = F.concat(*KINDS)
        beside = F.flatten(F.transform(every, lambda x: F.transform(x["terms"], lambda t: F.struct(x["entity"].alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")))))
        kept = [F.when(F.size(every) > 0, F.col("text")).alias("text")] if texts else []
        base = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", F.concat(*map(span, range(4))).alias("spans"), F.array_distinct(F.transform(every, lambda x: x["entity"])).alias("entities"), beside.alias("beside"), *kept)
        self.base = self.scratch.write(base, "base")
        self.near = self.base.filter(F.size("beside") > 0).select("row", "digest", F.explode("beside").alias("b")).select("row", "digest", "b.*")
        self.disclosed = self._disclosed(whole)

    def _disclosed(self, whole: DataFrame) -> DataFrame:
        """(entity, term, action): what the corpus shows to disclose an entity."""
        both = self.near.select("entity", "term", "digest").distinct().groupBy("entity", "term").agg(F.count("*").alias("f_both")).filter(F.col("f_both") >= SUPPORT)
        wide = self.near.select("entity", general(F.col("term")).alias("form"), "digest").distinct().groupBy("entity", "form").agg(F.count("*").alias("f_wide"))
        own = self.base.select("digest", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("f_entity"))
        n = self.base.select("digest").distinct().count()
        count = F.lit(float(n))
        tells = lambda both, own: _share(count, F.col(both), F.col(own), F.col("f_entity")) >= DISCLOSURE
        # Texts that have a term (a form) beside any entity are no more than all that have it. So who discloses too little by
        # these counts is settled: such a term is out, such a form will do. The others are counted in all texts.
        least = lambda name, c: self.near.select(c.alias(name), "digest").distinct().groupBy(name).agg(F.count("*").alias(f"least_{name}"))
        pairs = both.withColumn("form", general(F.col("term"))).join(own, "entity").join(least("term", F.col("term")), "term").filter(F.col("f_entity") < n).filter(tells("f_both", "least_term"))
        pairs = pairs.join(wide, ["entity", "form"]).join(least("form", general(F.col("term"))), "form")
        pairs = self.scratch.write(pairs.withColumn("open", tells("f_wide", "least_form")).drop("least_term", "least_form"), "pairs")
        names = self.scratch.write(pairs.select(F.explode(F.array("term", F.when(F.col("open"), F.col("form")))).alias("name")).filter("name IS NOT NULL").distinct(), "names")
        some = names.count()
        cut = whole.select(self.digest.alias("digest"), F.split(lower_ascii(F.col("text")), SPACE).alias("words"))
        words = cut.select("digest", F.explode("words").alias("w"))  # a step of its own: a digest a text, not a word
        words = words.select("digest", F.rtrim(F.ltrim("w", F.lit(PUNCTUATION)), F.lit(PUNCTUATION)).alias("w")).filter(F.col("w") != "")
        words = words.select("digest", F.explode(F.array("w", general(F.col("w")))).alias("name"))
        met = words.join(F.broadcast(names) if some <= BROADCAST_TERMS else names, "name", "left_semi")
        counted = self.scratch.write(met.distinct().groupBy("name").agg(F.count("*").alias("f")), "counted") if some else names.withColumn("f", F.lit(0).cast("long"))
        term, form = counted.select(F.col("name").alias("term"), F.col("f").alias("f_term")), counted.select(F.col("name").alias("form"), F.col("f").alias("f_form"))
        out = pairs.join(term, "term").filter(tells("f_both", "f_term")).join(form, "form", "left")
        return out.select("entity", "term", F.when(F.col("open") & tells("f_wide", "f_form"), "remove").otherwise("generalise").alias("action"))

    def spans(self) -> DataFrame:
        """A row a document: row, doc_id, spans (kind 0 to 3, start, end) and terms (start, end, action), in order."""
        key = F.concat("entity", F.lit("\n"), "term").alias("pair")
        sizes = self.near.groupBy(key).agg(F.count("*").alias("n"))
        groups = self.disclosed.select(key, "action").join(sizes, "pair")
        rows = self.near.select("row", "start", "end", key)
        hits = join_groups(rows, groups, "pair", "n", F.col("row").cast("string"), self.near.count()).filter("action IS NOT NULL")
        hits = hits.groupBy("row", "start", "end").agg(F.max("action").alias("action"))  # "remove" > "generalise"
        hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
        some = self.base.filter(F.size("beside") > 0).join(hits, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast(hits.schema["terms"].dataType)))
        none = self.base.filter(F.size("beside") == 0).withColumn("terms", F.array().cast(hits.schema["terms"].dataType))
        return some.drop("entities", "beside", "digest").unionByName(none.drop("entities", "beside", "digest"))

    def sanitised(self) -> DataFrame:
        """doc_id and text of the rows that have entities, with the entities named by kind and disclosing terms generalised or removed."""
        labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("put")))
        dropped = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise(F.concat(F.substring("text", t["start"] + 1, F.lit(PREFIX)), F.lit("*"))).alias("put")))
        cuts = F.array_sort(F.concat(named, dropped))

        def put(a: Column, c: Column) -> Column:
            before = F.substring("text", a["at"] + 1, F.greatest(c["start"] - a["at"], F.lit(0)))
            return F.struct(F.greatest(a["at"], c["end"]).alias("at"), F.concat(a["out"], F.array(before, c["put"])).alias("out"))

        done = F.aggregate(cuts, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), put)
        rows = self.spans().filter("text IS NOT NULL").select("doc_id", "text", done.alias("done"))
        return rows.select("doc_id", F.concat(F.array_join("done.out", ""), F.substring("text", F.col("done.at") + 1, F.length("text"))).alias("text"))


def digests(spans: DataFrame) -> DataFrame:
    """Counts a kind, the digest of the base spans and the list of all spans."""
    named = F.array(*map(F.lit, KINDS))
    said = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("spans", lambda x: said(F.get(named, x["kind"]), x))
    terms = F.transform("terms", lambda x: said(F.lit("term"), x))
    tally = lambda column, field, value: F.size(F.filter(column, lambda x: x[field] == value)).cast("long")
    counts = [tally("spans", "kind", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    acts = [tally("terms", "action", a).alias(name) for a, name in (("generalise", "n_generalised"), ("remove", "n_removed"))]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), *acts)
