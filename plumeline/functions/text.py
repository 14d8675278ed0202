"""Text columns: entities, white space, tags, display text, slugs and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it; Java's \s and Spark's trim know less of it.
SPACE = "[\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
#: Named entities in the order in which they are resolved.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Characters escaped in HTML output.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, with the value named once: SQL's expressions have no other way to name a part of themselves."""
    return F.get(F.transform(F.array(value), body), 0)


def tag_open(name: str) -> str:
    """Start of an element's tag; what follows the name must not prolong it."""
    return f"<{name.replace('.', '[.]')}(?![A-Za-z0-9_])"


def _numbered(text: Column, pattern: str, base: int) -> Column:
    """Replace the numeric entities of one base in one pass: what they make is not read again."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a byte order mark of our own goes first: the decoder takes one away, and that could be U+FEFF itself
    char = lambda m: F.coalesce(F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(_code(m, base)), 8, "0"))), "UTF-32"), F.lit(""))
    return bound(found, lambda marks: F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, char(F.get(marks, i)))), ""))


#: What a number that is no character becomes.
REPLACEMENT = 0xFFFD


def _code(entity: Column, base: int) -> Column:
    """The code point that an entity names; U+FFFD for surrogates and for numbers beyond Unicode, however long."""

    def known(digits: Column) -> Column:
        code = F.when(F.length(digits) == 0, F.lit(0)).when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("long")).otherwise(F.lit(1 << 40))
        return bound(code, lambda c: F.when((c > 0x10FFFF) | c.between(0xD800, 0xDFFF), F.lit(REPLACEMENT)).otherwise(c))

    return F.when(entity.isNotNull(), bound(F.ltrim(F.regexp_extract(entity, "([0-9A-Fa-f]+);", 1), F.lit("0")), known))


def decode_entities(text: Column) -> Column:
    """CDATA sections opened, then named and numeric entities, each kind in one pass. A number that is no character becomes U+FFFD: one bad feed must not stop a run."""
    out = F.when(text.contains("<![CDATA["), F.regexp_replace(text, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")).otherwise(text)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    numbered = lambda t: bound(_numbered(t, "(?i)&#x[0-9a-f]+;", 16), lambda u: _numbered(u, "&#[0-9]+;", 10))
    return bound(out, lambda t: F.when(t.contains("&#"), numbered(t)).otherwise(t))


def norm_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_tags(text: Column) -> Column:
    def stripped(t: Column) -> Column:
        for element in ("script", "style"):
            t = F.regexp_replace(t, f"(?is){tag_open(element)}[^>]*>.*?</{element}>", " ")
        return F.regexp_replace(F.regexp_replace(t, "(?i)<br\\s*/?>|</p>", " "), "<[^>]+>", " ")

    return F.when(text.contains("<"), stripped(text)).otherwise(text)


def display_text(text: Column) -> Column:
    """Entities first, tags second: escaped markup goes too. Null where nothing is left."""
    spaced = bound(decode_entities(text), lambda t: norm_space(strip_tags(t)))
    return bound(F.regexp_replace(spaced, " ([.,!?;:])", "$1"), filled)


def filled_once(text: Column) -> Column:
    """filled() of what is dear to work out."""
    return bound(text, filled)


def raw_text(text: Column) -> Column:
    return bound(norm_space(decode_entities(text)), filled)


def escape_html(text: Column) -> Column:
    for char, name in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _icu(of: str, method: str, text: Column, ascii_form: Column) -> Column:
    """A static method (string, true) of the ICU library that comes with Spark, in the engine; ``ascii_form`` for texts that are ASCII, which are most."""
    called = F.reflect(F.lit(f"com.ibm.icu.{of}"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNull() | F.regexp_like(text, F.lit("^[\\x00-\\x7F]*$")), ascii_form).otherwise(called)


def nfkc(text: Column) -> Column:
    """Unicode NFKC, which Spark's own functions lack."""
    return bound(text, lambda t: _icu("text.Normalizer", "compose", t, t))


def fold_case(text: Column) -> Column:
    """Full Unicode case folding: sharp s is ss, long s is s, and all sigmas are one."""
    return bound(text, lambda t: _icu("lang.UCharacter", "foldCase", t, F.lower(t)))


def slugify(label: Column, compatible: bool = True) -> Column:
    """Lower-cased letters and digits of any script, joined by single hyphens. ``compatible``: the label may need NFKC."""
    low = F.lower(nfkc(label) if compatible else label)
    kept = F.regexp_replace(F.regexp_replace(low, f"(?:{SPACE}|[/_.])+", "-"), "[^\\p{L}\\p{N}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def compare_key(text: Column, compatible: bool = True) -> Column:
    """How tags and search texts are compared: NFKC, white space collapsed, case folded."""
    return fold_case(norm_space(nfkc(text) if compatible else text))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2).cast("long")


def filled(text: Column) -> Column:
    """Empty counts as missing."""
    return F.nullif(text, F.lit(""))


def count_label(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit("0"))
