"""SPARQL's scalar functions as columns; an expression error is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.vocab import LANG_STRING, XSD


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Logic and comparison ----------------------------------------------------------------------------


def truth(x: Column, kind: str = "boolean") -> Column:
    """Effective boolean value of a typed column."""
    if kind == "number":
        return (x != 0) & ~F.isnan(x.cast("double"))
    if kind == "string":
        return x != ""
    return x


def or_(a: Column, b: Column) -> Column:
    return a | b


def and_(a: Column, b: Column) -> Column:
    return a & b


def not_(a: Column) -> Column:
    return ~a


DURATIONS = tuple(XSD + n for n in ("duration", "dayTimeDuration", "yearMonthDuration"))
#: No zone is further from UTC than this.
FURTHEST_ZONE = 14 * 3600


def _compare_moments(test, left: Column, right: Column) -> Column:
    """Two times of one type. One with a zone and one without compare only if no zone could matter."""
    zoned = [F.regexp(terms.lex(x), F.lit(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$")) for x in (left, right)]
    a, b = terms.moment(left), terms.moment(right)
    apart = F.abs(F.unix_micros(a) - F.unix_micros(b)) > FURTHEST_ZONE * 1_000_000
    return F.when((terms.datatype(left) == terms.datatype(right)) & ((zoned[0] == zoned[1]) | apart), test(a, b))


def compare_terms(left: Column, op: str, right: Column) -> Column:
    """``= != < > <= >=`` over terms: by value inside one value space, an error across spaces.

    Dates and times with zone are spaces of their own, and so are the two kinds of durations.
    Strings with a language are equal or not, but have no order.
    """
    ops = {
        "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
        ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    }
    test = ops[op]
    out = F.coalesce(
        test(terms.num(left), terms.num(right)), _compare_moments(test, left, right),
        test(terms.boolean(left), terms.boolean(right)),
        F.when((terms.datatype(left) == XSD + "string") & (terms.datatype(right) == XSD + "string"), test(terms.lex(left), terms.lex(right))),
        F.when(
            terms.datatype(left).isin(*DURATIONS) & terms.datatype(right).isin(*DURATIONS),
            test(compare_durations(terms.lex(left), terms.lex(right)), F.lit(0)),
        ),
    )
    if op in ("=", "!="):
        same = left == right
        # Terms of other kinds are equal when identical; of two different literals that is known only
        # if both have a language.
        tagged = (terms.datatype(left) == LANG_STRING) & (terms.datatype(right) == LANG_STRING)
        known = same | tagged | ~(terms.is_literal(left) & terms.is_literal(right))
        out = F.coalesce(out, F.when(known, same if op == "=" else ~same))
    return out


def in_(x: Column, *options) -> Column:
    return x.isin(*options)


def not_in(x: Column, *options) -> Column:
    return ~x.isin(*options)


# Numbers ----------------------------------------------------------------------------------------


def divide(a: Column, b: Column) -> Column:
    """Division of numbers; by zero is an error."""
    return F.try_divide(_lit(a).cast("double"), _lit(b).cast("double"))


def negate(a: Column) -> Column:
    return -a


def abs_(x: Column) -> Column:
    return F.abs(x)


def _whole(x: Column, rounded: Column) -> Column:
    """Doubles from 2**53 on are whole already; they, NaN and infinities do not fit through a long."""
    value = _lit(x).cast("double")
    return F.when(F.abs(value) < float(1 << 53), rounded.cast("double")).otherwise(value)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil(x))


def floor(x: Column) -> Column:
    return _whole(x, F.floor(x))


def round_(x: Column) -> Column:
    """Halves go up, also below zero."""
    return _whole(x, F.floor(x + 0.5))


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


# Strings ----------------------------------------------------------------------------------------


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def substr(text: Column, start, length=None) -> Column:
    """1-based; a start before the text counts towards the length, as in XPath."""
    start = _lit(start)
    if length is None:
        return F.substring(text, F.greatest(start, F.lit(1)), F.length(text) + 1)
    end = start + _lit(length)
    first = F.greatest(start, F.lit(1))
    return F.substring(text, first, F.greatest(end - first, F.lit(0)))


def strlen(text: Column) -> Column:
    return F.length(text)


def ucase(text: Column) -> Column:
    return F.upper(text)


def lcase(text: Column) -> Column:
    return F.lower(text)


def contains(text: Column, part) -> Column:
    return F.contains(text, _lit(part))


def starts(text: Column, part) -> Column:
    return F.startswith(text, _lit(part))


def ends(text: Column, part) -> Column:
    return F.endswith(text, _lit(part))


def before(text: Column, part) -> Column:
    at = F.locate(part, text) if isinstance(part, str) else F.call_function("locate", part, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).when(at == 0, "")


def after(text: Column, part) -> Column:
    at = F.locate(part, text) if isinstance(part, str) else F.call_function("locate", part, text)
    n = F.length(_lit(part))
    return F.when(at > 0, F.substring(text, at + n, F.length(text))).when(at == 0, "")


def encode_for_uri(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``-_.~``."""
    out = F.url_encode(text)
    for raw, shown in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


# Flag letters of XPath regular expressions, and Java's inline form of each.
_FLAGS = {"i": "i", "s": "s", "m": "m", "x": "x"}


def _pattern(pattern: str, flags: str) -> str:
    if "q" in flags:
        pattern, flags = "\\Q" + pattern + "\\E", flags.replace("q", "")
    inline = "".join(_FLAGS[f] for f in flags)
    return f"(?{inline}){pattern}" if inline else pattern


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(_pattern(pattern, flags))


def replace(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(text, _pattern(pattern, flags), replacement)


# Times ------------------------------------------------------------------------------------------

# Fields are those of the written time, so they come from the text and not from the instant.
_TIME = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _field(lexical: Column, group: int, type_: str) -> Column:
    return F.regexp_extract(lexical, _TIME, group).try_cast(type_)


def year(lexical: Column) -> Column:
    return _field(lexical, 1, "int")


def month(lexical: Column) -> Column:
    return _field(lexical, 2, "int")


def day(lexical: Column) -> Column:
    return _field(lexical, 3, "int")


def hours(lexical: Column) -> Column:
    return _field(lexical, 4, "int")


def minutes(lexical: Column) -> Column:
    return _field(lexical, 5, "int")


def seconds(lexical: Column) -> Column:
    return _field(lexical, 6, "double")


def tz(lexical: Column) -> Column:
    """Time zone text, empty without one; NULL for text that is no time."""
    return F.when(lexical.rlike(_TIME), F.regexp_extract(lexical, _TIME, 7))


def timezone(lexical: Column) -> Column:
    """Time zone as a day-time duration; an error without one."""
    zone = tz(lexical)
    sign = F.when(F.startswith(zone, F.lit("-")), "-").otherwise("")
    h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    body = F.concat(
        sign, F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""),
        F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""),
    )
    zero = (zone == "Z") | ((h == 0) & (m == 0))
    return F.when(zero, "PT0S").when(zone != "", body)


_DURATION = r"^(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
_MONTHS = r"^(-)?P(?:(\d+)Y)?(?:(\d+)M)?$"


def day_time_duration(lexical: Column) -> Column:
    """xsd:dayTimeDuration text as an interval."""
    # A part that is not there is not cast, as the parser of decimals throws an exception for empty text.
    part = lambda i, t: F.coalesce(F.nullif(F.regexp_extract(lexical, _DURATION, i), F.lit("")).try_cast(t), F.lit(0).cast(t))
    total = F.make_dt_interval(part(2, "int"), part(3, "int"), part(4, "int"), part(5, "decimal(18,6)"))
    signed = F.when(F.startswith(lexical, F.lit("-")), -total).otherwise(total)
    return F.when(lexical.rlike(_DURATION) & ~lexical.rlike("(P|T)$"), signed)


def year_month_duration(lexical: Column) -> Column:
    """xsd:yearMonthDuration text as a number of months."""
    part = lambda i: F.coalesce(F.regexp_extract(lexical, _MONTHS, i).try_cast("int"), F.lit(0))
    total = part(2) * 12 + part(3)
    signed = F.when(F.startswith(lexical, F.lit("-")), -total).otherwise(total)
    return F.when(lexical.rlike(_MONTHS) & ~lexical.rlike("P$"), signed)


def compare_durations(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two durations of one kind; a day-time and a year-month one cannot be compared."""

    def sign(a: Column, b: Column) -> Column:
        return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)

    return F.coalesce(
        sign(day_time_duration(left), day_time_duration(right)),
        sign(year_month_duration(left), year_month_duration(right)),
    )


def now() -> Column:
    return F.current_timestamp()


# Hashes -----------------------------------------------------------------------------------------


def md5(text: Column) -> Column:
    return F.md5(text)


def sha1(text: Column) -> Column:
    return F.sha1(text)


def sha(text: Column, bits: int) -> Column:
    if bits not in (256, 384, 512):
        raise ValueError("SHA256, SHA384 or SHA512")
    return F.sha2(text, bits)


# Terms ------------------------------------------------------------------------------------------


def iri(text: Column, base: str = "") -> Column:
    """IRI from text, resolved against a base."""
    if not base:
        return terms.iri(text)
    scheme_end = base.index(":") + 1
    authority_end = base.find("/", scheme_end + 2) if base[scheme_end:].startswith("//") else scheme_end
    authority = base if authority_end < 0 else base[:authority_end]
    no_fragment = base.split("#")[0]
    no_query = no_fragment.split("?")[0]
    folder = no_query[: no_query.rindex("/") + 1] if "/" in no_query[len(authority):] else authority + "/"
    joined = (
        F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text)
        .when(text == "", F.lit(no_fragment))
        .when(F.startswith(text, F.lit("//")), F.concat(F.lit(base[:scheme_end]), text))
        .when(F.startswith(text, F.lit("/")), F.concat(F.lit(authority), text))
        .when(F.startswith(text, F.lit("#")), F.concat(F.lit(no_fragment), text))
        .when(F.startswith(text, F.lit("?")), F.concat(F.lit(no_query), text))
        .otherwise(F.concat(F.lit(folder), text))
    )
    return terms.iri(joined)


def bnode(label: Column | None = None, *row: Column) -> Column:
    """A blank node; the same label gives the same node within one row, identified by ``row``."""
    if label is None:
        return terms.bnode(F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return terms.bnode(F.sha2(F.concat_ws("\u0001", label, *[r.cast("string") for r in row]), 256))


def uuid() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def str_uuid() -> Column:
    return F.uuid()


def str_lang(lexical: Column, tag) -> Column:
    return terms.tagged(lexical, _lit(tag))


def str_dt(lexical: Column, datatype) -> Column:
    return terms.typed(lexical, datatype) if isinstance(datatype, str) else terms.typed_by(lexical, datatype)


def same_term(a: Column, b: Column) -> Column:
    return a == b


def coalesce(*args: Column) -> Column:
    return F.coalesce(*args)


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """IF; an error in the condition is an error, not the second branch."""
    return F.when(condition, then).when(~condition, otherwise)


def bound(x: Column) -> Column:
    return x.isNotNull()
