"""Expressions over links and HTML fragments."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatwire.functions.text import WS, bind, strip_space

# Named character references of the HTML standard that end in a semicolon.
REFERENCES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
_LISTED = "\x02".join(f"{name}\x01{char}" for name, char in REFERENCES.items())
# Those that the standard knows without one, too, longest first.
BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{BARE}))"
# In an attribute a bare name counts only where no letter, digit or = follows.
REFERENCE_IN_VALUE = rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{BARE})(?![A-Za-z0-9=]))"

# Comments, and elements whose content is not text; unclosed ones run to the end of the page.
HIDDEN_PATTERN = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b[^>]*>|\z)"
                  r"|<style\b.*?(?:</style\b[^>]*>|\z)")
# What follows the name of a tag; a quoted value may hold a closing bracket.
REST = r"""(?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*|[^>]*)"""
ANY_TAG = f"<{REST}>"


def _code_point(digits: Column, base: int) -> Column:
    """The character of a number; U+FFFD for numbers that name none."""
    short = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("bigint"))
    named = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(named, n)), 8, "0")), "UTF-32")
    return F.when(named, char).otherwise("\ufffd")


def _reference(ref: Column, in_value: bool) -> Column:
    """The character of one reference; an unknown name is cut to a bare one that it
    begins with, or stays as it is."""
    inner = F.regexp_replace(ref, "^&|;$", "")
    names = F.str_to_map(F.lit(_LISTED), F.lit("\x02"), F.lit("\x01"))  # one constant of the plan
    bare = F.regexp_extract(inner, f"^({BARE})", 1)
    cut = F.lit(None).cast("string") if in_value else F.concat(
        F.try_element_at(names, bare), F.substr(ref, F.length(bare) + 2))
    return (F.when(F.rlike(inner, F.lit("^#[xX]")), _code_point(F.substr(inner, F.lit(3)), 16))
            .when(F.startswith(inner, F.lit("#")), _code_point(F.substr(inner, F.lit(2)), 10))
            .otherwise(F.coalesce(F.try_element_at(names, inner), cut, ref)))


def _decoded(c: Column, in_value: bool) -> Column:
    """References and what stands between them, in one pass: nothing is decoded twice."""
    reference = REFERENCE_IN_VALUE if in_value else REFERENCE
    parts = F.regexp_extract_all(c, F.lit(f"{reference}|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(
        F.startswith(p, F.lit("&")) & (F.length(p) > 1), _reference(p, in_value)).otherwise(p)), "")


def decode_entities(c: Column, in_value: bool = False) -> Column:
    """Named and numeric character references to characters, inside the JVM.

    Also those without a semicolon that the standard allows; in an attribute's
    value (``in_value``) they are mostly parts of an address and stay.
    """
    return bind(c, lambda t: F.when(F.contains(t, F.lit("&")), _decoded(t, in_value)).otherwise(t))


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN_PATTERN, "")


def plain(fragment: Column) -> Column:
    """Text of a fragment, trimmed; inner white space is kept."""
    return strip_space(decode_entities(F.regexp_replace(fragment, ANY_TAG, "")))


def joined(fragment: Column) -> Column:
    """Text of a fragment with every text node trimmed before joining."""
    tight = F.regexp_replace(fragment, f"[{WS}]*{ANY_TAG}[{WS}]*", "")
    return strip_space(decode_entities(tight))


def first_element(fragment: Column, names: str) -> Column:
    """Content of the first element of one of ``names``, to its own end; null if there is none.

    ``names`` is an alternation of element names. The fragment is cut at the tags
    of the name that opens first, and depth is counted through them, so elements
    of that name inside it end for themselves. One that is never closed runs on.
    """
    opening = rf"(?is)<(?:{names})\b{REST}>"
    name = F.regexp_extract(fragment, rf"(?is)<({names})\b{REST}>", 1)
    rest = F.get(F.split(fragment, opening, 2), F.lit(1))

    def tag(before: str, after: str) -> Column:
        return F.concat(F.lit(before), name, F.lit(after))

    pieces = F.regexp_extract_all(rest, tag(r"(?is).*?(?:</?", rf"\b{REST}>|\z)"), F.lit(0))
    closing, again = tag("(?is)</", r"\b[^<>]*>\z"), tag("(?is)<", rf"\b{REST}>\z")

    def step(acc: Column, piece: Column) -> Column:
        closes, opens = F.rlike(piece, closing), F.rlike(piece, again)
        depth = F.when(closes, acc["depth"] - 1).when(opens, acc["depth"] + 1).otherwise(acc["depth"])
        ends = closes & (acc["depth"] == 1)
        text = F.concat(acc["text"], F.when(ends, F.regexp_replace(piece, closing, F.lit(""))).otherwise(piece))
        return F.when(acc["depth"] == 0, acc).otherwise(
            F.struct(depth.alias("depth"), text.alias("text")))

    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))
    return F.when(F.rlike(fragment, F.lit(opening)), F.aggregate(pieces, start, step)["text"])


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag; null when absent."""
    quoted = F.regexp_extract(tag, rf'(?is)[{WS}]{name}[{WS}]*=[{WS}]*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?is)[{WS}]{name}[{WS}]*=[{WS}]*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)[{WS}]{name}[{WS}]*=[{WS}]*([^\"'{WS}>]+)", 1)
    present = F.rlike(tag, F.lit(rf"(?is)[{WS}]{name}[{WS}]*="))
    value = F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(single, F.lit("")), bare)
    return F.when(present, decode_entities(value, in_value=True))


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def site_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)


# Parts of an address by RFC 3986, appendix B.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(c, f"(?s){PARTS}", k)


def _without_dots(path: Column) -> Column:
    """RFC 3986, 5.2.4: steps over "." and back over ".."."""
    steps = F.split(path, "/")

    def walk(done: Column, step: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(step == "..", up).when(step == ".", done).otherwise(
            F.concat(done, F.array(step)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    folder = F.element_at(steps, -1).isin(".", "..")
    return F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def _join(base: Column, href: Column) -> Column:
    scheme, host = F.concat(_part(base, 1), F.lit(":")), _part(base, 2)
    path, base_path = _part(href, 3), _part(base, 3)
    tail = F.concat(_part(href, 4), _part(href, 5))
    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"(?s)^(.*/)", 1))
    joined_ = (
        F.when(_part(href, 1) != "", href)
        .when(_part(href, 2) != "", F.concat(scheme, _part(href, 2), _without_dots(path), tail))
        .when(F.startswith(path, F.lit("/")), F.concat(scheme, host, _without_dots(path), tail))
        .when(path != "", F.concat(scheme, host, _without_dots(F.concat(folder, path)), tail))
        .when(_part(href, 4) != "", F.concat(scheme, host, base_path, tail))
        .otherwise(F.concat(scheme, host, base_path, _part(base, 4), tail)))
    # brackets belong to numeric hosts and come in pairs
    odd = F.rlike(F.concat(_part(href, 2), host), F.lit(r"\[[^\]]*$|^[^\[]*\]"))
    return F.when(~odd & (_part(base, 1) != ""), joined_)


def resolve_link(base: Column, href: Column, rule: str = "prefix") -> Column:
    """Absolute address of a link; null for one that cannot be joined.

    ``prefix`` puts the site root before anything that does not start with
    ``http``; ``rfc`` joins by RFC 3986.
    """
    if rule == "rfc":
        return bind(F.array(base, strip_space(href)), lambda p: _join(p[0], p[1]))
    if rule != "prefix":
        raise ValueError(f"unknown rule {rule!r}")
    slash = F.when(F.startswith(href, F.lit("/")), F.lit("")).otherwise(F.lit("/"))
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(
        F.concat(site_root(base), slash, href))
