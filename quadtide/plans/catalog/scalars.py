"""Registered queries: scalar functions (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide.functions import registry
from quadtide.functions import scalars as k
from quadtide.functions import terms
from quadtide.plans.catalog import query
from quadtide.plans.catalog.views import DATA
from quadtide.sources.tables import Tables
from quadtide.vocab import XSD


@query(
    "K1_logic",
    """SELECT l_orderkey AS o, l_linenumber AS n, (x > 20 OR nul) AS any_of, (x > 20 AND nul) AS all_of, NOT (x > 20) AS none,
 l_discount <> 0 AS num_true, l_returnflag <> '' AS str_true FROM (SELECT *, l_quantity AS x, CASE WHEN l_tax > 0.04 THEN true WHEN l_tax < 0.02 THEN false END AS nul FROM lineitem)""",
)
def _k1(t: Tables):
    nul = F.when(F.col("l_tax") > 0.04, True).when(F.col("l_tax") < 0.02, False)
    big = F.col("l_quantity") > 20
    return t.lineitem.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), k.or_(big, nul).alias("any_of"), k.and_(big, nul).alias("all_of"),
        k.not_(big).alias("none"), k.truth(F.col("l_discount"), "number").alias("num_true"), k.truth(F.col("l_returnflag"), "string").alias("str_true"),
    )


@query(
    "K2_compare",
    """SELECT p_partkey AS id, p_size = 7 AS eq, p_size <> 7 AS ne, p_size < 20 AS lt, p_size > 20 AS gt, p_size <= 20 AS le, p_name >= 'red' AS ge,
 p_size = p_partkey % 10 AS term_eq, NULL::BOOLEAN AS mixed FROM part""",
)
def _k2(t: Tables):
    size, name = F.col("p_size"), F.col("p_name")
    as_int = terms.number(size, XSD + "integer")
    as_double = terms.number((F.col("p_partkey") % 10).cast("double"))
    return t.part.select(
        F.col("p_partkey").alias("id"), (size == 7).alias("eq"), (size != 7).alias("ne"), (size < 20).alias("lt"), (size > 20).alias("gt"),
        (size <= 20).alias("le"), (name >= "red").alias("ge"), k.compare_terms(as_int, "=", as_double).alias("term_eq"),
        k.compare_terms(as_int, "<", terms.string(name)).alias("mixed"),
    )


@query("K3_in", "SELECT o_orderkey AS id, o_orderstatus IN ('F', 'P') AS one_of, o_orderpriority NOT IN ('1-URGENT', '5-LOW') AS none_of FROM orders")
def _k3(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), k.in_(F.col("o_orderstatus"), "F", "P").alias("one_of"),
        k.not_in(F.col("o_orderpriority"), "1-URGENT", "5-LOW").alias("none_of"),
    )


@query(
    "K4_arithmetic",
    """SELECT l_orderkey AS o, l_linenumber AS n, l_quantity + l_tax AS plus, l_quantity - l_tax AS less, l_quantity * l_discount AS product,
 l_linenumber / CAST(nullif(l_suppkey % 4, 0) AS DOUBLE) AS quotient, -l_quantity AS negative FROM lineitem""",
)
def _k4(t: Tables):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    return t.lineitem.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (q + tax).alias("plus"), (q - tax).alias("less"),
        (q * F.col("l_discount")).alias("product"), k.divide(F.col("l_linenumber"), F.col("l_suppkey") % 4).alias("quotient"),
        k.negate(q).alias("negative"),
    )


@query(
    "K5_literal_parts",
    """SELECT doc_id AS id, text AS str, lang AS tag, lang = 'en' AS english, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS type,
 'http://www.w3.org/2001/XMLSchema#integer' AS num_type, 'http://example.org/data/doc/' || doc_id AS iri_text FROM documents""",
)
def _k5(t: Tables):
    literal = terms.tagged(F.col("text"), F.col("lang"))
    number = terms.number(F.col("n_chars"), XSD + "integer")
    rows = t.documents.select("doc_id", literal.alias("l"), number.alias("n"))
    lit_, num = F.col("l"), F.col("n")
    return rows.select(
        F.col("doc_id").alias("id"), terms.lex(lit_).alias("str"), terms.lang(lit_).alias("tag"),
        terms.lang_matches(terms.lang(lit_), "en").alias("english"), terms.datatype(lit_).alias("type"), terms.datatype(num).alias("num_type"),
        terms.lex(terms.iri(F.concat(F.lit(DATA + "doc/"), "doc_id"))).alias("iri_text"),
    )


@query("K6_bound", "SELECT doc_id AS id, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def _k6(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("id"), k.bound(F.col("quality")).alias("labelled"))


@query(
    "K7_iri_bnode",
    """SELECT page_id AS id, '<' || url || '>' AS absolute, '<http://example.org/data/page/' || page_id || '>' AS relative,
 '<http://example.org/rooted>' AS rooted, '<http://example.org/data/x#f' || page_id || '>' AS fragment, true AS same_node, '_:' AS node_start FROM pages""",
)
def _k7(t: Tables):
    base, pid = DATA + "x", F.col("page_id")
    one, two = k.bnode(F.lit("a"), pid), k.bnode(F.lit("a"), pid)
    return t.pages.select(
        pid.alias("id"), k.iri(F.col("url"), base).alias("absolute"), k.iri(F.concat(F.lit("page/"), pid), base).alias("relative"),
        k.iri(F.lit("/rooted"), base).alias("rooted"), k.iri(F.concat(F.lit("#f"), pid), base).alias("fragment"),
        (one == two).alias("same_node"), F.substring(one, 1, 2).alias("node_start"),
    )


@query("K8_nondeterministic", "SELECT s_suppkey AS id, true AS in_range, true AS is_now, 36 AS uuid_length, true AS urn FROM supplier")
def _k8(t: Tables):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), k.rand().alias("r"), k.now().alias("now"), k.str_uuid().alias("u"), k.uuid().alias("iri"))
    return rows.select(
        "id", ((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"), (F.col("now") <= F.current_timestamp()).alias("is_now"),
        F.length("u").alias("uuid_length"), k.starts(F.col("iri"), "<urn:uuid:").alias("urn"),
    )


@query(
    "K9_rounding",
    """SELECT c_custkey AS id, abs(x) AS magnitude, CAST(ceil(x) AS DOUBLE) AS up, CAST(floor(x) AS DOUBLE) AS down,
 CAST(floor(x + 0.5) AS DOUBLE) AS nearest FROM (SELECT c_custkey, c_acctbal / 8 - 300.5 AS x FROM customer)""",
)
def _k9(t: Tables):
    x = F.col("c_acctbal") / 8 - 300.5
    return t.customer.select(
        F.col("c_custkey").alias("id"), k.abs_(x).alias("magnitude"), k.ceil(x).alias("up"), k.floor(x).alias("down"), k.round_(x).alias("nearest")
    )


@query(
    "K10_strings",
    """SELECT doc_id AS id, lang || '-' || source AS joined, substring(text, 3, 5) AS part, substring(text, 4) AS rest,
 substring(source, 1, 1) AS early, CAST(length(text) AS INTEGER) AS n, upper(source) AS up, lower(source) AS low FROM documents""",
)
def _k10(t: Tables):
    text, source = F.col("text"), F.col("source")
    return t.documents.select(
        F.col("doc_id").alias("id"), k.concat(F.col("lang"), F.lit("-"), source).alias("joined"), k.substr(text, 3, 5).alias("part"),
        k.substr(text, 4).alias("rest"), k.substr(source, -1, 3).alias("early"), k.strlen(text).alias("n"),
        k.ucase(source).alias("up"), k.lcase(source).alias("low"),
    )


@query(
    "K11_regex",
    """SELECT doc_id AS id, regexp_matches(text, '[0-9]{3}') AS digits, regexp_matches(text, 'the', 'i') AS any_case,
 regexp_replace(source, '^src([0-9]+)$', 'S-\\1') AS renamed FROM documents""",
)
def _k11(t: Tables):
    return t.documents.select(
        F.col("doc_id").alias("id"), k.regex(F.col("text"), "[0-9]{3}").alias("digits"), k.regex(F.col("text"), "the", "i").alias("any_case"),
        k.replace(F.col("source"), "^src([0-9]+)$", "S-$1").alias("renamed"),
    )


@query(
    "K12_contains",
    "SELECT page_id AS id, contains(html, 'lang=\"fr\"') AS french, starts_with(url, 'https://') AS secure, ends_with(url, '#top') AS top FROM pages",
)
def _k12(t: Tables):
    return t.pages.select(
        F.col("page_id").alias("id"), k.contains(F.col("html"), 'lang="fr"').alias("french"), k.starts(F.col("url"), "https://").alias("secure"),
        k.ends(F.col("url"), "#top").alias("top"),
    )


@query(
    "K13_before_after",
    """SELECT page_id AS id, CASE WHEN instr(url, '?') > 0 THEN substring(url, 1, instr(url, '?') - 1) ELSE '' END AS before,
 CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages""",
)
def _k13(t: Tables):
    return t.pages.select(F.col("page_id").alias("id"), k.before(F.col("url"), "?").alias("before"), k.after(F.col("url"), "://").alias("after"))


@query("K14_encode_for_uri", "SELECT conv_id, turn, url_encode(text) AS encoded FROM conversations")
def _k14(t: Tables):
    return t.conversations.select("conv_id", "turn", k.encode_for_uri(F.col("text")).alias("encoded"))


@query(
    "K15_time_fields",
    """SELECT event_id AS id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d,
 CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(date_part('microsecond', ts) / 1000000.0 AS DOUBLE) AS s FROM events""",
)
def _k15(t: Tables):
    text = terms.lex(F.col("x"))
    rows = t.events.select(F.col("event_id").alias("id"), terms.date_time(F.col("ts")).alias("x")).select("id", text.alias("x"))
    x = F.col("x")
    return rows.select(
        "id", k.year(x).alias("y"), k.month(x).alias("mo"), k.day(x).alias("d"), k.hours(x).alias("h"), k.minutes(x).alias("mi"), k.seconds(x).alias("s")
    )


@query(
    "K16_time_zone",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '-05:30' WHEN 2 THEN '' ELSE '+02:00' END AS tz,
 CASE event_id % 4 WHEN 0 THEN 'PT0S' WHEN 1 THEN '-PT5H30M' WHEN 3 THEN 'PT2H' END AS zone, CAST(hour(ts) AS INTEGER) AS local_hour FROM events""",
)
def _k16(t: Tables):
    m = F.col("event_id") % 4
    zone = F.when(m == 0, "Z").when(m == 1, "-05:30").when(m == 2, "").otherwise("+02:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return t.events.select("event_id", text.alias("x")).select(
        F.col("event_id").alias("id"), k.tz(F.col("x")).alias("tz"), k.timezone(F.col("x")).alias("zone"), k.hours(F.col("x")).alias("local_hour")
    )


@query(
    "K17_hashes",
    "SELECT doc_id AS id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, 96 AS sha384_length, 128 AS sha512_length FROM documents",
)
def _k17(t: Tables):
    x = F.col("text")
    return t.documents.select(
        F.col("doc_id").alias("id"), k.md5(x).alias("md5"), k.sha1(x).alias("sha1"), k.sha(x, 256).alias("sha256"),
        F.length(k.sha(x, 384)).alias("sha384_length"), F.length(k.sha(x, 512)).alias("sha512_length"),
    )


@query(
    "K18_coalesce_if",
    """SELECT doc_id AS id, coalesce(quality, toxic, -1) AS first_known, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS verdict
 FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _k18(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), k.coalesce(F.col("quality"), F.col("toxic"), F.lit(-1)).alias("first_known"),
        k.if_(F.col("quality") == 1, F.lit("good"), F.lit("bad")).alias("verdict"),
    )


@query(
    "K19_make_literals",
    """SELECT doc_id AS id, '"' || source || '"@' || lang AS tagged, '"' || n_chars || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS typed,
 '"' || source || '"' AS plain FROM documents""",
)
def _k19(t: Tables):
    return t.documents.select(
        F.col("doc_id").alias("id"), k.str_lang(F.col("source"), F.upper("lang")).alias("tagged"),
        k.str_dt(F.col("n_chars").cast("string"), XSD + "integer").alias("typed"), k.str_dt(F.col("source"), F.lit(XSD + "string")).alias("plain"),
    )


@query("K20_same_term", "SELECT c_custkey AS id, c_nationkey % 2 = 0 AS same FROM customer")
def _k20(t: Tables):
    plain = terms.number(F.col("c_nationkey"), XSD + "integer")
    other = F.when(F.col("c_nationkey") % 2 == 0, plain).otherwise(terms.number(F.col("c_nationkey"), XSD + "long"))
    return t.customer.select(F.col("c_custkey").alias("id"), k.same_term(plain, other).alias("same"))


@query(
    "K21_kind_tests",
    """SELECT c_custkey AS id, m = 0 AS iri, m = 1 AS blank, m > 1 AS literal, m = 2 AS is_number,
 CASE m WHEN 0 THEN 'iri' WHEN 1 THEN 'bnode' ELSE 'literal' END AS kind FROM (SELECT c_custkey, c_custkey % 4 AS m FROM customer)""",
)
def _k21(t: Tables):
    m, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    term = (
        F.when(m == 0, terms.iri(F.concat(F.lit(DATA), key))).when(m == 1, terms.bnode(key))
        .when(m == 2, terms.typed(key, XSD + "integer")).otherwise(terms.string(F.col("c_name")))
    )
    x = F.col("x")
    return t.customer.select(F.col("c_custkey").alias("id"), term.alias("x")).select(
        "id", terms.is_iri(x).alias("iri"), terms.is_blank(x).alias("blank"), terms.is_literal(x).alias("literal"),
        terms.is_numeric(x).alias("is_number"), terms.kind(x).alias("kind"),
    )



@query(
    "K22_casts",
    f"""SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS BIGINT) AS i,
 TRY_CAST(p_name AS DOUBLE) AS bad, DATE '2024-02-01' + CAST(p_size AS INTEGER) AS day FROM part""",
)
def _k22(t: Tables):
    text = F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    return t.part.select(
        F.col("p_partkey").alias("id"), registry.call(XSD + "double", F.col("p_size")).alias("d"),
        registry.call(XSD + "string", F.col("p_size")).alias("s"),
        registry.call(XSD + "long", registry.call(XSD + "integer", F.floor("p_retailprice"))).alias("i"),
        registry.call(XSD + "double", F.col("p_name")).alias("bad"), registry.call(XSD + "date", text).alias("day"),
    )


@query(
    "K23_dynamic_call",
    "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS as_double, CAST(p_size AS VARCHAR) AS as_string FROM part",
)
def _k23(t: Tables):
    wanted = {"as_double": XSD + "double", "as_string": XSD + "string"}
    return t.part.select(F.col("p_partkey").alias("id"), *[registry.call(iri, F.col("p_size")).alias(n) for n, iri in wanted.items()])


@query(
    "K24_durations",
    """SELECT event_id AS id, CASE WHEN n * 60 < 1800 THEN -1 WHEN n * 60 > 1800 THEN 1 ELSE 0 END AS against_half_hour,
 CASE WHEN n < 24 THEN -1 WHEN n > 24 THEN 1 ELSE 0 END AS against_two_years, NULL::INTEGER AS mixed
 FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events)""",
)
def _k24(t: Tables):
    n = F.get_json_object("props", "$.k")
    rows = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("PT"), n, F.lit("M")).alias("d"), F.concat(F.lit("P"), n, F.lit("M")).alias("m"))
    return rows.select(
        "id", k.compare_durations(F.col("d"), F.lit("PT1800S")).alias("against_half_hour"),
        k.compare_durations(F.col("m"), F.lit("P2Y")).alias("against_two_years"), k.compare_durations(F.col("d"), F.col("m")).alias("mixed"),
    )
