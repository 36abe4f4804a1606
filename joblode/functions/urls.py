"""URL expressions: the canonical form used for deduplication and the validated form that is stored."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions.text import WHITESPACE, bind, blank_to_null, clean

# Character sets are written out: the regex engine turns a listed set into one table lookup, while a
# union of ranges is a chain of calls per character.
_LETTERS = string.ascii_letters + string.digits
_SAFE = re.escape(_LETTERS + "-._~!$&'()*+,;=:@/%")
_GRAPHIC = "".join(map(chr, range(0x21, 0x7F)))


def _any_but(excluded: str) -> str:
    return "[" + re.escape("".join(char for char in _GRAPHIC if char not in excluded)) + "]"


# Already canonical: lower-case scheme and host, no trailing slash, no fragment. Passed through.
_HOST = re.escape(string.ascii_lowercase + string.digits + "-._")
_CANONICAL = rf"^[a-z]+://[{_HOST}]+(?:/{_any_but('/?#')}+)*(?:\?{_any_but('#')}+)?$"

# Already normalized web address: plain host, safe path, query and fragment, no dot segment.
_LABEL = re.escape(string.ascii_lowercase + string.digits + "_")
_NORMALIZED = (
    rf"^https?://(?:[{_LABEL}](?:[{_LABEL}\-]*[{_LABEL}])?\.)+[a-z]{{2,}}/(?!\.|%2[eE]|.*/(?:\.|%2[eE]))"
    rf"[{_SAFE}]*(?:\?[{_SAFE.replace("'", '')}?]*)?(?:#[{_SAFE}?]*)?$"
)

_HEAD = r"^[A-Za-z]+://[A-Za-z0-9._\-]+"
_CAPITALS = r"^(?=[A-Za-z]*[A-Z]|[A-Za-z]+://[A-Za-z0-9._\-]*[A-Z])[!-~]+\z"

_WEB_ADDRESS = r"(?is)^(https?):[/\\]*([^/\\?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_CONTROLS = "".join(map(chr, range(0x21)))
_ENDPOINT = r"^(\[[^\]]*\]|[^:]*)(?::(\d*))?$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


# Bootstring parameters of internationalised host names (RFC 3492), fixed values.
_TMIN, _TMAX, _SKEW, _DAMP, _START_BIAS, _START_CODE = 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_BASE = len(_DIGITS)
_DIGITS_AT_MOST = 12
_NESTED_DIGITS, _DIVISIONS_AT_MOST = 4, 6
_DOTS = "\u3002\uff0e\uff61"
_INVISIBLE = "\u00ad\u200b\u2060\ufeff"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def _fields(**columns: Column) -> Column:
    return F.struct(*(column.alias(name) for name, column in columns.items()))


def canonical_url(url: Column) -> Column:
    """Scheme and authority lowered, trailing slashes of the path cut, query kept, fragment dropped.

    Without a scheme or an authority the whole text is lowered and its trailing slashes are cut. An
    empty result is NULL: such rows have no URL identity.
    """

    def assemble(part: Column) -> Column:
        path = F.rtrim(F.substr(part.base, F.length(part.head) + 1), F.lit("/"))
        query = F.substr(part.bare, F.length(part.base) + 1)
        absolute = F.concat(F.lower(part.head), path, F.when(query == "?", "").otherwise(query))
        return F.when(part.head != "", absolute).otherwise(F.lower(F.rtrim(part.text, F.lit("/"))))

    def split(text: Column) -> Column:
        compact = F.ltrim(text, F.lit(_CONTROLS))
        for char in "\t\r\n":
            compact = F.replace(compact, F.lit(char), F.lit(""))
        return bind(F.substring_index(compact, "#", 1), lambda bare: with_base(text, bare))

    def with_base(text: Column, bare: Column) -> Column:
        return bind(F.substring_index(bare, "?", 1), lambda base: bind(_fields(
            text=text, bare=bare, base=base, head=F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]+", 0),
        ), assemble))

    stripped = F.trim(url, F.lit(WHITESPACE))
    return F.when(url.rlike(_CANONICAL), url).otherwise(blank_to_null(bind(stripped, split)))


def _percent_encoded(text: Column, unsafe: str) -> Column:
    """Percent-encode the characters of a class (and everything outside printable ASCII)."""
    wanted = rf"[^\x21-\x7e]|[{unsafe}]"

    def encode(char: Column) -> Column:
        return F.when(
            char.rlike(wanted), F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))
        ).otherwise(char)

    return bind(
        text,
        lambda value: F.when(
            value.rlike(wanted), F.array_join(F.transform(F.split(value, ""), encode), "")
        ).otherwise(value),
    )


def _without_dot_segments(path: Column) -> Column:
    """Resolve "." and ".." path segments."""
    dot, dots = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    nothing = F.array().cast("array<string>")

    def resolve(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            nothing,
            lambda done, part: F.when(part.rlike(dot), done)
            .when(part.rlike(dots), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part))),
        )
        last = F.element_at(segments, -1)
        tail = F.when(last.rlike(dot) | last.rlike(dots), F.array(F.lit(""))).otherwise(nothing)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    return bind(
        path,
        lambda value: F.when(
            value.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), bind(F.split(F.substr(value, F.lit(2)), "/"), resolve)
        ).otherwise(value),
    )


def _bias(delta: Column, points: Column, first: Column) -> Column:
    """The adapted bias after a difference; every quotient is whole."""
    halved = F.floor(delta / F.when(first, _DAMP).otherwise(2))
    limit, shrink = (_BASE - _TMIN) * _TMAX // 2, _BASE - _TMIN

    def finish(start: Column) -> Column:
        """A division for each time the value is above the limit; how often follows from the value itself."""

        def after(times: int) -> Column:
            left = F.floor(start / shrink**times)
            return times * _BASE + F.floor((shrink + 1) * left / (left + _SKEW))

        found = F.when(start <= limit, after(0))
        for times in range(1, _DIVISIONS_AT_MOST):
            found = found.when(start < (limit + 1) * shrink**times, after(times))
        return found.otherwise(after(_DIVISIONS_AT_MOST))

    return bind((halved + F.floor(halved / points)).cast("long"), finish)


def _variable_length(delta: Column, bias: Column) -> Column:
    """A difference as digits, the least significant one first.

    Nearly all have a few digits, and these are nested: digits behind the last one are not computed. The analyzer bounds
    how deep expressions nest, so that the digits of longer ones follow in a loop.
    """

    def digit(value: Column) -> Column:
        return F.substr(F.lit(_DIGITS), value.cast("int") + 1, F.lit(1))

    def threshold(place: Column, bias: Column) -> Column:
        return F.least(F.greatest(place * _BASE - bias, F.lit(_TMIN)), F.lit(_TMAX)).cast("long")

    def quotient(rest: Column, limit: Column) -> Column:
        return F.floor((rest - limit) / (_BASE - limit)).cast("long")

    def lower(rest: Column, limit: Column) -> Column:
        return digit(limit + F.pmod(rest - limit, _BASE - limit))

    def step(now: Column, place: Column) -> Column:
        limit = threshold(place, now.bias)
        last = now.rest < limit
        return F.when(now.done, now).otherwise(_fields(
            rest=quotient(now.rest, limit),
            bias=now.bias,
            text=F.concat(now.text, F.when(last, digit(now.rest)).otherwise(lower(now.rest, limit))),
            done=last,
        ))

    def looped(rest: Column, bias: Column) -> Column:
        start = _fields(rest=rest, bias=bias, text=F.lit(""), done=F.lit(False))
        return F.aggregate(F.sequence(F.lit(_NESTED_DIGITS + 1), F.lit(_DIGITS_AT_MOST)), start, step, lambda now: now.text)

    def from_place(place: int, rest: Column, bias: Column) -> Column:
        if place > _NESTED_DIGITS:
            return looped(rest, bias)
        limit = threshold(F.lit(place), bias)
        behind = bind(quotient(rest, limit), lambda left: from_place(place + 1, left, bias))
        return F.when(rest < limit, digit(rest)).otherwise(F.concat(lower(rest, limit), behind))

    return bind(_fields(rest=delta.cast("long"), bias=bias.cast("long")), lambda now: from_place(1, now.rest, now.bias))


def punycode(label: Column) -> Column:
    """The Bootstring form of a label without its prefix.

    Inserted characters go by code point, then place. A difference between two of them follows from their code points
    and from how many smaller or equal characters stand before them, and the bias of each from the difference before
    it, so all differences are found side by side.
    """

    def coded(chars: Column) -> Column:
        basic = F.filter(chars, lambda c: c.code < _START_CODE)
        extra = F.sort_array(F.filter(chars, lambda c: c.code >= _START_CODE))

        def placed(char: Column, rank: Column) -> Column:
            before = F.size(F.filter(chars, lambda c: (c.at < char.at) & (c.code <= char.code)))
            return _fields(code=char.code.cast("long"), at=before.cast("long"), points=(F.size(basic) + rank + 1).cast("long"))

        return bind(F.transform(extra, placed), lambda marks: bind(differences(marks), lambda deltas: F.concat(
            F.array_join(F.transform(basic, lambda c: c.text), ""), F.when(F.size(basic) > 0, "-").otherwise(""),
            F.array_join(F.transform(deltas, lambda d, rank: _variable_length(
                d.delta,
                F.when(rank == 0, F.lit(_START_BIAS)).otherwise(
                    bind(F.get(deltas, rank - 1), lambda p: _bias(p.delta, p.points, rank == 1))
                ),
            )), ""),
        )))

    def differences(marks: Column) -> Column:
        def one(mark: Column, rank: Column) -> Column:
            previous = F.get(marks, rank - 1)
            code = F.when(rank == 0, F.lit(_START_CODE)).otherwise(previous.code)
            at = F.when(rank == 0, F.lit(0)).otherwise(previous.at + 1)
            return _fields(delta=(mark.code - code) * mark.points + mark.at - at, points=mark.points)

        return F.transform(marks, one)

    def character(at: Column) -> Column:
        return bind(F.substr(label, at, F.lit(1)), lambda c: _fields(code=F.ascii(c), at=at, text=c))

    return bind(F.transform(F.sequence(F.lit(1), F.length(label)), character), coded)


def ascii_host(host: Column) -> Column:
    """A lower-case host in ASCII: labels with other characters become punycode behind "xn--".

    Full-width forms and ideographic full stops count as their ASCII counterparts, invisible joiners are left out.
    """
    plain = F.translate(F.translate(host, _DOTS + _WIDE, "..." + "".join(map(chr, range(0x21, 0x7F)))), _INVISIBLE, "")
    label = lambda part: F.when(F.octet_length(part) == F.length(part), part).otherwise(F.concat(F.lit("xn--"), punycode(part)))
    converted = F.array_join(F.transform(F.split(F.lower(plain), r"\."), label), ".")
    return F.when(F.octet_length(host) == F.length(host), host).otherwise(converted)


def _assemble_web_address(part: Column) -> Column:
    port = F.nullif(part.port, F.lit("")).try_cast("int")
    default = F.when(part.scheme == "http", 80).otherwise(443)
    shown_port = F.when((part.port == "") | (port == default), "").otherwise(
        F.concat(F.lit(":"), port.cast("string"))
    )
    host_ok = (
        (part.host != "")
        & ~part.host.rlike(r"[\x00-\x20#%/<>?@\\^|`{}\"\x7f]")
        & (part.host.rlike(r"^[^\[\]:]+$") | part.host.rlike(r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]$"))
        & (~part.host.rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)\.?$") | part.host.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    )
    port_ok = (part.port == "") | F.coalesce(port <= 65535, F.lit(False))
    path = F.when(part.path == "", "/").otherwise(
        _percent_encoded(_without_dot_segments(F.translate(part.path, "\\", "/")), "\"<>`{}")
    )
    whole = F.concat(
        part.scheme, F.lit("://"), part.user, part.host, shown_port, path,
        _percent_encoded(part.query, "\"<>'"), _percent_encoded(part.fragment, "\"<>`"),
    )
    return F.when(host_ok & port_ok, whole)


def _dissect_web_address(text: Column) -> Column:
    def with_endpoint(pieces: Column) -> Column:
        endpoint = F.substring_index(pieces[1], "@", -1)
        return bind(endpoint, lambda end: bind(_fields(
            scheme=F.lower(pieces[0]),
            user=F.substr(pieces[1], F.lit(1), F.length(pieces[1]) - F.length(end)),
            host=ascii_host(F.lower(F.regexp_extract(end, _ENDPOINT, 1))),
            port=F.regexp_extract(end, _ENDPOINT, 2),
            path=pieces[2],
            query=pieces[3],
            fragment=pieces[4],
        ), _assemble_web_address))

    groups = F.array(*(F.regexp_extract(text, _WEB_ADDRESS, group) for group in range(1, 6)))
    usable = text.rlike(_WEB_ADDRESS) & (F.length(text) <= lexicon.MAX_URL_LENGTH)
    return F.when(usable, bind(groups, with_endpoint))


def valid_http_url(url: Column) -> Column:
    """Validated and normalized http(s) URL, NULL when malformed.

    Follows the public URL standard for web schemes: scheme and host lowered, default port dropped, an
    empty path becomes "/", dot segments resolved, unsafe characters percent-encoded, hosts with other than
    ASCII letters as punycode. Two limits: combining marks in a host are not composed first, and IPv4 hosts
    are accepted only in the usual four-part decimal form.
    """
    short = F.length(url) <= lexicon.MAX_URL_LENGTH
    lowered = F.concat(F.lower(F.regexp_extract(url, _HEAD, 0)), F.regexp_replace(url, _HEAD, ""))
    # capitals in scheme and host are all that many addresses lack
    return (
        F.when(url.rlike(_NORMALIZED) & short, url)
        .when(url.rlike(_CAPITALS) & short & lowered.rlike(_NORMALIZED), lowered)
        .otherwise(bind(clean(url), _dissect_web_address))
    )
