"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find the protected entities. The terms of the documents that hold one are weighed by the
corpus: a term's pointwise mutual information with an entity over whole documents, as a share of the
entity's information content, says how much of the entity the term discloses. Terms above a threshold
are generalised wherever they stand, and removed where they give nearly all of it away.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadtide.llm.common import column, fresh, saved

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the patterns, which match the same text: what follows a repeated part can never
# be part of it. A run is entered at its start only, so a long run without a match is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]{3,}"


@dataclass(frozen=True)
class Disclosure:
    """A term is weighed if it stands in ``support`` documents that are not all one text. It counts as
    disclosing from ``threshold`` of an entity's information on, and is removed from ``remove`` on, if it
    meets the entity more often than chance: all entities together may give at most ``chance`` such
    meetings a term. At most ``sent`` numbers are broadcast."""

    support: int = 2
    threshold: float = 0.8
    remove: float = 0.95
    chance: float = 0.05
    sent: int = 1_000_000


def positions(text: Column, pattern: str) -> Column:
    """Array of (``start``, ``end``, ``match``) of the non-overlapping matches, in code points."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.char_length(x["hit"])
        hit = F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("match"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out")))

    return F.aggregate(pairs, start, step)["out"]


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": n.between(12, 19) & luhn(digits),
        "phone": n.between(9, 15),
    }[kind]


def spans_of(text: Column, kind: str) -> Column:
    """Array of (``start``, ``kind`` number, ``end``, ``match``) of one kind."""
    found = F.filter(positions(text, PATTERNS[kind]), lambda m: passes(kind, m["match"]))
    number = F.lit(KINDS.index(kind))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), number.alias("kind"), m["end"].alias("end"), m["match"].alias("match")))
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast("array<struct<start:long,kind:int,end:long,match:string>>"))


def base_spans(text: Column) -> Column:
    """The spans of all kinds by start and kind."""
    return F.array_sort(F.concat(*(spans_of(text, kind) for kind in KINDS)))


def entity(span: Column) -> Column:
    """The protected value behind a mention, however it is written."""
    digits = F.regexp_replace(span["match"], "[^0-9]", "")
    return F.when(span["kind"] < 2, F.lower(span["match"])).otherwise(digits)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(docs, id_col).cast("long").alias("id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))


def bare(text: Column, base: Column) -> Column:
    """The text with mentions blanked out; every other character keeps its place."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["start"] - acc["at"]).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["at"], s["start"])).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, blank).alias("out"))

    done = F.aggregate(base, start, step)
    return F.when(F.size(base) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text))))


def terms_in(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def marks(text: Column, guilty: Column) -> Column:
    """Array of (``start``, ``end``, ``share``) of the terms that the map ``guilty`` has, by start."""
    pairs = F.arrays_zip(F.split(text, TERM, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,share:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        share = F.try_element_at(guilty, F.lower(x["hit"]))
        out = F.when(share.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), share.alias("share")))))
        return F.struct(b.alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def disclosing(held: DataFrame, seen: DataFrame, n: int, conf: Disclosure) -> DataFrame:
    """(``term``, ``share``) for the terms that disclose too much of an entity: the largest share.

    ``held`` has ``doc``, ``entities`` and ``terms`` of the rows with personal data, ``seen`` every
    ``term`` of all ``n`` rows with its text's ``version``. Entities of the same rows share a group, as
    all counts are equal for them, so a document full of addresses is not paired with its terms for each.
    """
    mentions = held.select("doc", F.explode("entities").alias("entity"))
    part = lambda i: F.sum(F.pmod(F.xxhash64(F.lit(i), "doc"), F.lit(1 << 31)))
    groups = mentions.groupBy("entity").agg(F.count("*").alias("with_entity"), *(part(i).alias(f"s{i}") for i in range(3)))
    groups = saved(groups.where(F.col("with_entity") < n), "entities")
    top, entities = groups.agg(F.max("with_entity"), F.count("*")).first()
    top = top or 0
    of_doc = mentions.join(groups, "entity").select("doc", "with_entity", "s0", "s1", "s2").distinct()
    # A term in more documents than this has a smaller share even if every document of the entity holds it.
    most = lambda w: F.lit(n) * F.pow(w / F.lit(max(n, 1)), F.lit(conf.threshold)) * (1 + 1e-9)
    counts = seen.groupBy("term").agg(F.count("*").alias("with_term"), F.min("version").alias("a"), F.max("version").alias("b"))
    counts = counts.where((F.col("with_term") >= conf.support) & (F.col("with_term") <= most(F.lit(top))))
    if conf.support > 1:
        counts = counts.where("a <> b")
    pairs = held.select("doc", F.explode("terms").alias("term")).join(counts.select("term", "with_term"), "term")
    pairs = pairs.join(of_doc, "doc").where(F.col("with_term") <= most(F.col("with_entity")))
    pairs = pairs.groupBy("term", "with_term", "with_entity", "s0", "s1", "s2").agg(F.count("*").alias("both"))
    pmi = F.log(F.col("both") * F.lit(n) / (F.col("with_term") * F.col("with_entity")))
    share = F.least(pmi / F.log(F.lit(n) / F.col("with_entity")), F.lit(1.0))
    # If the term fell on documents at random, ``expected`` of them would hold the entity, and ``both`` or
    # more with a chance of at most expected ** both / both!, which exp(-surprise) bounds.
    expected = F.col("with_term") * F.col("with_entity") / F.lit(max(n, 1))
    surprise = F.col("both") * F.log(F.col("both") / expected) - F.col("both") + F.log(2 * math.pi * F.col("both")) / 2
    sure = (F.col("both") > expected) & (surprise >= math.log(max(entities, 1) / conf.chance))
    return pairs.where(sure).select("term", share.alias("share")).where(F.col("share") >= conf.threshold).groupBy("term").agg(F.max("share").alias("share"))


def guilty_of(docs: DataFrame, id_col: str, text_col: str, conf: Disclosure) -> DataFrame:
    """(``i``, ``v``, ``guilty``) for the documents that hold disclosing terms: id, hash of the text, and
    the terms with their shares. Every row of ``docs`` counts as a document."""
    rows = texts_of(docs, id_col, text_col).select("id", F.xxhash64("text").alias("version"), "text", base_spans(F.col("text")).alias("base"))
    rows = rows.select("id", "version", "base", bare(F.col("text"), F.col("base")).alias("bare"))
    held = rows.where(F.size("base") > 0)
    held = held.select(F.xxhash64("id", "version").alias("doc"), F.array_distinct(F.transform("base", entity)).alias("entities"), terms_in(F.col("bare")).alias("terms"))
    seen = rows.select("id", "version", F.explode(terms_in(F.col("bare"))).alias("term"))
    guilty = saved(disclosing(saved(held, "held"), seen.select("version", "term"), docs.count(), conf), "guilty")
    # Numbers out of a range 64 times as large as they are many let one in 64 other terms pass. Beyond the
    # bound all terms go to the join.
    many = guilty.count()
    if many <= conf.sent:
        number = lambda term: F.pmod(F.xxhash64(term), F.lit(64 * max(many, 1)))
        numbers = guilty.select(number("term").alias("number")).distinct()
        seen = seen.withColumn("number", number("term")).join(F.broadcast(numbers), "number", "left_semi").drop("number")
    hits = seen.join(guilty, "term").distinct().groupBy("id", "version").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("guilty"))
    return saved(hits.select(F.col("id").alias("i"), F.col("version").alias("v"), "guilty"), "disclosing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``version`` (hash of the text), ``base`` spans and ``terms``,
    the disclosing ones as (``start``, ``end``, ``share``) by start.

    A null text counts as empty and has no spans; texts are read whole; repeated rows give a row each; a
    null id stays null; other columns are not looked at; an empty table gives none. A term that
    discloses an entity is reported everywhere outside mentions, in documents without the entity too.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    out = rows.join(guilty_of(docs, id_col, text_col, conf), F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left")
    out = out.select("id", "version", "text", "guilty", base_spans(F.col("text")).alias("base"))
    nothing = F.array().cast("array<struct<start:long,end:long,share:double>>")
    terms = F.when(F.col("guilty").isNull(), nothing).otherwise(marks(bare(F.col("text"), F.col("base")), F.col("guilty")))
    return out.select("id", "version", "base", terms.alias("terms"))


def sanitised(text: Column, base: Column, terms: Column, conf: Disclosure) -> Column:
    """The text with mentions replaced by their kind and disclosing terms by ``<TERM>`` or nothing."""
    labels = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    marks = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(labels, s["kind"] + 1).alias("label")))
    soft = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= conf.remove, F.lit("")).otherwise(F.lit("<TERM>")).alias("label")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept, s["label"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(F.array_sort(F.concat(marks, soft)), start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of the text; other rows and columns as
    they were.

    Null and empty texts stay; texts are read whole; repeated rows are cleaned alike and count as documents
    each; rows without an id are told apart by their text; where spans overlap the one that starts first is
    replaced; an empty table stays empty.
    """
    i, v, g = fresh(docs, "own_id", "own_version", "own_guilty")
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    found = guilty_of(docs, id_col, text_col, conf).select(F.col("i").alias(i), F.col("v").alias(v), F.col("guilty").alias(g))
    both = docs.join(found, column(docs, id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(v)), "left")
    text = column(both, text_col).cast("string")
    base = base_spans(F.coalesce(text, F.lit("")))
    terms = F.when(F.col(g).isNull(), F.array().cast("array<struct<start:long,end:long,share:double>>")).otherwise(marks(bare(text, base), F.col(g)))
    clean = sanitised(text, base, terms, conf)
    touched = F.col(g).isNotNull() | text.rlike("|".join(NEEDS.values()))
    return both.withColumn(text_col, F.when(touched, clean).otherwise(column(both, text_col))).select(*docs.columns)
