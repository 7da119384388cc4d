"""Identity, tokens, cleaning and small text functions, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of any script, digits among them, for the sparse index.
TERM = r"[\p{L}\p{N}_]+"
#: Tokens for comparing results: runs of ASCII letters and digits, two or more.
ALNUM = r"[a-z0-9]{2,}"
CJK = r"[\x{4E00}-\x{9FA5}]"
#: Signs that recognition software leaves behind. Fixed values.
OCR_NOISE = "□■◆◇▪▫●○☐"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space of any script.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(_c(text), F.lit(WHITE))


def content_hash(text: Column | str) -> Column:
    return F.md5(_c(text).cast("binary"))


def doc_id(text: Column | str) -> Column:
    """The first twelve hex digits of the content's md5."""
    return F.substring(content_hash(text), 1, 12)


def term_index(token: Column | str) -> Column:
    """The first four md5 bytes of a token, big-endian, modulo 2^31."""
    return F.conv(F.substring(F.md5(_c(token).cast("binary")), 1, 8), 16, 10).cast("long") % 2147483648


def _bigrams(chars: Column) -> Column:
    return F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1)))).otherwise(F.array().cast("array<string>"))


def terms(text: Column | str) -> Column:
    """The sparse index's tokens: words of the lower-case text, and pairs of neighbouring CJK characters."""
    low = F.lower(_c(text))
    words = F.regexp_extract_all(low, F.lit(TERM), 0)
    # A text of ASCII alone has no such pairs and is not searched for them.
    return F.when(F.octet_length(_c(text)) == F.length(_c(text)), words).otherwise(F.concat(words, _bigrams(F.regexp_extract_all(low, F.lit(CJK), 0))))


def compare_tokens(text: Column | str) -> Column:
    """The distinct tokens by which two results are compared."""
    low = F.lower(_c(text))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(ALNUM), 0), _bigrams(F.regexp_extract_all(low, F.lit(CJK), 0))))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    a, b = _c(a), _c(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column | str) -> Column:
    """Compatibility composition. Texts of ASCII have it and are not sent to Python: a null goes in their place."""
    text = _c(text)
    return F.coalesce(_nfkc(F.when(F.octet_length(text) != F.length(text), text)), text)


def clean_plain(text: Column | str) -> Column:
    """Prose as one line: words that a hyphen parts at a line's end are joined, any run of blanks, tabs and line ends is one
    blank, noise goes and leaves what stood around it, characters are composed, and the ends are stripped."""
    joined = F.translate(F.replace(_c(text), F.lit("-\n"), F.lit("")), "\n\t", "  ")
    return strip(nfkc(F.translate(F.regexp_replace(joined, " {2,}", " "), OCR_NOISE, "")))


def clean_structured(text: Column | str) -> Column:
    """Tables, code and lists: lines stay, noise and white space at their ends go, characters keep their form."""
    out = F.regexp_replace(F.regexp_replace(_c(text), r"\r\n?", "\n"), rf"(?m)^(?U)\s*[{OCR_NOISE}]\s*$", "")
    out = F.regexp_replace(F.regexp_replace(out, f"[{OCR_NOISE}]", ""), r"(?m)[^\S\n]+$", "")
    return strip(out)


def clean_text(text: Column | str, category: Column | str) -> Column:
    return F.when(_c(category).isin("table", "code", "list"), clean_structured(text)).otherwise(clean_plain(text))


def sentences(text: Column | str) -> Column:
    """Sentences with their ends. A full stop of Latin script ends none."""
    found = F.regexp_extract_all(_c(text), F.lit(r"[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$"), 0)
    return F.filter(F.transform(found, strip), lambda s: s != "")


def heading_prefix(content: Column | str, path: Column | str) -> Column:
    """Content below its headings as Markdown lines, unless it begins with them."""
    lines = F.filter(F.transform(_c(path), lambda t, i: F.when(strip(t) != "", F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), strip(t)))), lambda x: x.isNotNull())
    head = F.array_join(lines, "\n")
    return F.when((head == "") | F.startswith(_c(content), head), _c(content)).otherwise(F.concat(head, F.lit("\n\n"), _c(content)))


#: What the names of map entries hold whose values are secrets, in any case of letters. Fixed values.
SECRET_NAMES = ("api_key", "api-key", "apikey", "token", "password", "secret", "authorization", "bearer")


def redact_secret(value: Column | str, head: int = 4, tail: int = 4) -> Column:
    """A secret's first and last characters; nothing of a short one."""
    value = _c(value)
    long = F.concat(F.substring(value, 1, head), F.lit("..."), F.right(value, F.lit(tail)))
    return F.when(F.coalesce(value, F.lit("")) == "", "(empty)").when(F.length(value) <= head + tail, "***").otherwise(long)


def redact_url(url: Column | str) -> Column:
    """A URL without user name and password."""
    url = _c(url)
    return F.when(F.coalesce(url, F.lit("")) == "", "(empty)").otherwise(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#\s]*@", "$1"))


def redact_map(payload: Column | str) -> Column:
    """A map whose secret-named entries are redacted; empty values stay."""

    def secret(name: Column) -> Column:
        return reduce(Column.__or__, [F.contains(F.lower(name), F.lit(n)) for n in SECRET_NAMES])

    return F.transform_values(_c(payload), lambda k, v: F.when(secret(k) & (F.coalesce(v, F.lit("")) != ""), redact_secret(v)).otherwise(v))


def file_type(name: Column | str, content_type: Column | str) -> Column:
    """pdf, md or txt: by content type first, then by suffix; null for what is not supported."""
    kind, suffix = F.lower(F.trim(F.split_part(F.coalesce(_c(content_type), F.lit("")), F.lit(";"), F.lit(1)))), F.lower(F.regexp_extract(F.coalesce(_c(name), F.lit("")), r"\.([^.]+)$", 1))
    return (
        F.when(kind == "application/pdf", "pdf").when(kind.isin("text/markdown", "text/x-markdown"), "md").when(kind.startswith("text/"), "txt")
        .when(suffix == "pdf", "pdf").when(suffix.isin("md", "markdown"), "md").when(suffix.isin("txt", "text"), "txt")
    )


def text_type(text: Column | str, source: Column | str) -> Column:
    """md or txt for a bare text: by suffix, else md if any line is a heading of level one to three."""
    name = F.lower(F.coalesce(_c(source), F.lit("")))
    return F.when(name.rlike(r"\.(md|markdown)$"), "md").when(name.rlike(r"\.(txt|text)$"), "txt").when(_c(text).rlike(r"(?m)^\s*#{1,3} "), "md").otherwise("txt")


def combine_warnings(*parts: Column | str) -> Column:
    return F.nullif(F.array_join(F.filter(F.array(*[F.nullif(_c(p), F.lit("")) for p in parts]), lambda x: x.isNotNull()), ","), F.lit(""))


def vector_url(raw: Column | str) -> Column:
    """Scheme, host and port of a service address; what it does not say is null."""
    raw = _c(raw)
    has = raw.contains("://")
    rest = F.when(has, F.regexp_extract(raw, r"^.*?://(.*)$", 1)).otherwise(raw)
    port = F.when(has, F.nullif(F.regexp_extract(rest, r"^[^:]*:(\d+)$", 1), F.lit("")))
    return F.struct(F.when(has, F.regexp_extract(raw, r"^(.*?)://", 1)).alias("scheme"), F.when(has, F.regexp_extract(rest, r"^([^:]*)", 1)).otherwise(rest).alias("host"), port.cast("int").alias("port"))


#: Dimensions of embedding models by name. Fixed values.
VECTOR_DIMENSIONS = {"gemini-embedding-001": 3072, "text-embedding-004": 768, "BAAI/bge-large-zh-v1.5": 1024, "BAAI/bge-m3": 1024}


def estimated_dimension(model: Column | str, default: int = 3072) -> Column:
    out = F.lit(default)
    for name, dim in VECTOR_DIMENSIONS.items():
        out = F.when(_c(model) == name, dim).otherwise(out)
    return out
