"""URL keys as Columns: merge key, frontier key, cache identity, host, scope helpers.

The three keys differ on purpose: the merge key re-encodes and strips, the frontier key keeps query parts verbatim, the
cache identity keeps the whole query. Texts without a host are only stripped of trailing slashes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
HOST_PORT = r"^(?:.*@)?([^@:\[\]]+|\[[^\]]*\])(?::(\d*))?$"
DEFAULT_PORT = {"http": "80", "https": "443"}


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def part(url: Column | str, k: int) -> Column:
    """1 scheme (lower), 2 authority, 3 path, 4 query; empty where absent."""
    found = F.regexp_extract(_col(url), SPLIT, k)
    return F.lower(found) if k == 1 else found


def _text(sql: str) -> str:
    """SQL on one line, so that a repeated part stays readable where it is written."""
    return "(" + " ".join(sql.split()) + ")"


def _ipv4(h: str) -> str:
    """SQL: dotted form of an IPv4 literal of 1 to 4 parts in decimal, octal or hexadecimal; null for other texts."""
    number = "CASE WHEN p RLIKE '^0x[0-9a-f]+$' THEN conv(substring(p, 3, 20), 16, 10) WHEN p RLIKE '^0[0-7]+$' THEN conv(p, 8, 10) WHEN p RLIKE '^([1-9][0-9]{0,11}|0)$' THEN p END"
    fits = "size(v) <= 4 AND forall(transform(v, (p, k) -> coalesce(p < CASE WHEN k < size(v) - 1 THEN 256 ELSE power(256, 5 - size(v)) END, false)), ok -> ok)"
    value = "aggregate(slice(v, 1, size(v) - 1), 0L, (a, p) -> a * 256 + CAST(p AS BIGINT)) * CAST(power(256, 5 - size(v)) AS BIGINT) + CAST(element_at(v, -1) AS BIGINT)"
    dotted = "concat_ws('.', shiftright(n, 24) & 255, shiftright(n, 16) & 255, shiftright(n, 8) & 255, n & 255)"
    return _text(f"""get(transform(array(transform(split({h}, '[.]'), p -> CAST({number} AS DECIMAL(20, 0)))),
      v -> CASE WHEN {fits} THEN get(transform(array({value}), n -> {dotted}), 0) END), 0)""")


def _ipv6(h: str) -> str:
    """SQL: shortest form of an IPv6 literal of hexadecimal groups; null for other texts."""
    groups = f"transform(array(struct(filter(split(split_part({h}, '::', 1), ':'), g -> g <> '') AS a, filter(split(split_part({h}, '::', 2), ':'), g -> g <> '') AS b)), s -> concat(s.a, array_repeat('0', greatest(8 - size(s.a) - size(s.b), 0)), s.b))"
    runs = " ".join(f"WHEN f LIKE '%:{'0:' * n}%' THEN regexp_replace(f, '^(.*?):{'0:' * n}(.*)$', '$1::$2')" for n in range(8, 1, -1))
    sound = f"{h} RLIKE '^[0-9a-f:]+$' AND size(v) = 8 AND ({h} LIKE '%::%' OR NOT exists(split({h}, ':'), g -> g = '')) AND NOT exists(v, g -> length(g) > 4)"
    full = "concat(':', array_join(transform(v, g -> regexp_replace(g, '^0+(?=.)', '')), ':'), ':')"
    return _text(f"""get(transform({groups}, v -> CASE WHEN {sound} THEN
      regexp_replace(regexp_replace(get(transform(array({full}), f -> CASE {runs} ELSE f END), 0), '^:(?!:)', ''), '(?<!:):$', '') END), 0)""")


def _state(n: str, delta: str, bias: str, h: str, out: str) -> str:
    return f"struct(CAST({n} AS BIGINT) AS n, CAST({delta} AS BIGINT) AS delta, CAST({bias} AS BIGINT) AS bias, CAST({h} AS BIGINT) AS h, {out} AS out)"


def _punycode(label: str) -> str:
    """SQL: the ASCII form of a label with other characters, as a fold over steps of next code point m and character c."""
    limit = "greatest(1, least(26, k * 36 - s.bias))"
    digit = f"CASE WHEN a.q < {limit} THEN a.q ELSE {limit} + (a.q - {limit}) % (36 - {limit}) END"
    digits = f"""aggregate(sequence(1, 8), struct(s.delta AS q, '' AS o), (a, k) -> CASE WHEN a.q < 0 THEN a ELSE
      struct(CASE WHEN a.q < {limit} THEN -1L ELSE (a.q - {limit}) div (36 - {limit}) END AS q, concat(a.o, substring('abcdefghijklmnopqrstuvwxyz0123456789', CAST({digit} + 1 AS INT), 1)) AS o) END, a -> a.o)"""
    bias = """get(transform(array(s.delta div CASE WHEN s.h = w.basic THEN 700 ELSE 2 END), d -> aggregate(sequence(1, 6), struct(d + d div (s.h + 1) AS d, 0L AS k),
      (a, i) -> CASE WHEN a.d > 455 THEN struct(a.d div 35 AS d, a.k + 36 AS k) ELSE a END, a -> a.k + 36 * a.d div (a.d + 38))), 0)"""
    fold = f"""CASE WHEN e.c = -1 THEN {_state("e.m", "s.delta + (e.m - s.n) * (s.h + 1)", "s.bias", "s.h", "s.out")}
      WHEN e.c = -2 THEN {_state("s.n + 1", "s.delta + 1", "s.bias", "s.h", "s.out")}
      WHEN e.c < e.m THEN {_state("s.n", "s.delta + 1", "s.bias", "s.h", "s.out")}
      WHEN e.c = e.m THEN {_state("s.n", "0", bias, "s.h + 1", f"concat(s.out, {digits})")} ELSE s END"""
    steps = """flatten(transform(array_sort(array_distinct(filter(w.points, c -> c >= 128))), m -> concat(array(struct(m AS m, -1L AS c)), transform(w.points, c -> struct(m AS m, c AS c)), array(struct(m AS m, -2L AS c)))))"""
    start = _state("128", "0", "72", "w.basic", f"concat('xn--', regexp_replace({label}, '[^\\\\x00-\\\\x7f]', ''), CASE WHEN w.basic > 0 THEN '-' ELSE '' END)")
    word = f"transform(array(transform(filter(split({label}, ''), c -> c <> ''), c -> CAST(ascii(c) AS BIGINT))), p -> struct(p AS points, CAST(size(filter(p, c -> c < 128)) AS BIGINT) AS basic))"
    return _text(f"get(transform({word}, w -> aggregate({steps}, {start}, (s, e) -> {fold}, s -> s.out)), 0)")


def _idna(h: str) -> str:
    """SQL: name with its labels in ASCII form. Letters are lower-case by now; sharp s and final sigma go as IDNA 2003 has it."""
    plain = f"replace(replace(translate({h}, '\u3002\uff0e\uff61', '...'), '\u00df', 'ss'), '\u03c2', '\u03c3')"
    return _text(f"array_join(transform(split({plain}, '[.]'), l -> CASE WHEN l RLIKE '^[\\\\x00-\\\\x7f]*$' THEN l ELSE {_punycode('l')} END), '.')")


#: SQL function of a lower-case host without trailing dots. One text, as it is the same for all columns.
UNUSUAL = f"""x -> CASE WHEN x LIKE '[%' THEN coalesce({_ipv6("translate(x, '[]', '')")}, translate(x, '[]', ''))
  WHEN x RLIKE '(^|[.])[.]|[^.]{{64,}}' THEN ''
  WHEN x RLIKE '^[0-9][0-9a-fx]*([.][0-9][0-9a-fx]*){{0,3}}$' THEN coalesce({_ipv4("x")}, x)
  WHEN NOT x RLIKE '^[\\\\x00-\\\\x7f]*$' THEN {_idna("x")} ELSE x END"""
#: Hosts that are their own canonical form: ASCII labels, the last one no number.
USUAL = r"^(?:[a-z0-9_-]{1,63}\.)*[a-z_][a-z0-9_-]{0,62}$"


def canonical_host(name: Column) -> Column:
    """Lower-case host without trailing dots; address literals in one spelling, other names in IDNA form; bad ones empty.

    The usual host is left by one test; the rest of the expression is evaluated for the others only.
    """
    lower = F.lower(name)
    return F.when(lower.rlike(USUAL), lower).otherwise(F.get(F.call_function("transform", F.array(F.regexp_replace(lower, r"\.+$", "")), F.expr(UNUSUAL)), F.lit(0)))


def host(url: Column | str) -> Column:
    """Canonical host of a URL; empty if there is none."""
    return canonical_host(F.regexp_extract(part(url, 2), HOST_PORT, 1))


def port(url: Column | str) -> Column:
    return F.regexp_extract(part(url, 2), HOST_PORT, 2)


def _netloc(url: Column | str) -> Column:
    scheme, p = part(url, 1), port(url)
    default = F.coalesce(*[F.when(scheme == s, F.lit(n)) for s, n in DEFAULT_PORT.items()], F.lit(""))
    return F.concat(host(url), F.when((p == "") | (p == default), "").otherwise(F.concat(F.lit(":"), p)))


def _is_tracking(component: Column) -> Column:
    name = F.lower(F.try_url_decode(F.regexp_replace(F.split_part(component, F.lit("="), F.lit(1)), r"%(?![0-9A-Fa-f]{2})", "%25")))
    return F.coalesce(name, F.lower(F.split_part(component, F.lit("="), F.lit(1)))).startswith("utm_")


def kept_query(url: Column | str) -> Column:
    """Query components other than ``utm_*``, verbatim and in order."""
    return F.array_join(F.filter(F.split(part(url, 4), "&"), lambda c: ~_is_tracking(c)), "&")


def _recoded(text: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.regexp_replace(F.regexp_replace(F.url_encode(plain), r"\*", "%2A"), "%7E", "~")


def normalize_url(url: Column | str) -> Column:
    """Merge and citation key: lower scheme (https if none) and host, no default port, ``utm_*``, trailing slash, fragment."""
    url = _col(url)
    pieces = F.filter(F.split(part(url, 4), "&"), lambda c: (c != "") & ~_is_tracking(c))
    query = F.array_join(
        F.transform(pieces, lambda c: F.concat(_recoded(F.split_part(c, F.lit("="), F.lit(1))), F.lit("="), _recoded(F.regexp_replace(c, "^[^=]*=?", "")))), "&"
    )
    path = F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/]*$", ""), "/+$", "")
    scheme = F.when(part(url, 1) == "", "https").otherwise(part(url, 1))
    full = F.concat(scheme, F.lit("://"), _netloc(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(url, 2) == "", F.regexp_replace(url, "/+$", "")).otherwise(full)


def dedup_key(url: Column | str) -> Column:
    """Frontier key: path untouched, raw query components kept, only ``utm_*`` and the fragment dropped."""
    url = _col(url)
    query = kept_query(url)
    user = F.regexp_extract(part(url, 2), "^(.*@)", 1)
    full = F.concat(part(url, 1), F.lit("://"), user, _netloc(url), part(url, 3), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((part(url, 2) == "") | (part(url, 1) == ""), F.substring_index(url, "#", 1)).otherwise(full)


def cache_identity(url: Column | str) -> Column:
    """Cache identity: host case folded, default port dropped, empty path as ``/``, query verbatim."""
    path, query = part(url, 3), part(url, 4)
    return F.concat(part(url, 1), F.lit("://"), _netloc(url), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def without_fragment(url: Column | str) -> Column:
    return F.substring_index(_col(url), "#", 1)


def host_suffixes(h: Column) -> Column:
    """A host and all its parent domains, for equi-joins instead of suffix tests."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def remove_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` segments resolved, also when percent-encoded."""
    segments = F.transform(F.split(path, "/"), lambda s: F.struct(s.alias("raw"), F.regexp_replace(s, "(?i)%2e", ".").alias("dot")))
    empty = F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        dropped = F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ""), F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(s["dot"] == ".", acc).when(s["dot"] == "..", dropped).otherwise(F.array_append(acc, s["raw"]))

    joined = F.array_join(F.aggregate(segments, empty, add), "/")
    rooted = F.when(path.startswith("/") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", "/").otherwise(joined))
    return F.when(path.rlike(r"(/|/\.|/\.\.)$") & ~rooted.endswith("/"), F.concat(rooted, F.lit("/"))).otherwise(rooted)


def glob_regex(pattern: str) -> str:
    """Shell pattern (``*``, ``?``, ``[...]``) as an anchored Java regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body.startswith('!') else body}]")
            i = end + 1
        else:
            out.append("\\" + c if not c.isalnum() else c)
    return "(?s)^" + "".join(out) + "$"


def scope_rejection(url: Column | str, depth: Column, seed: str, max_depth: int, include_parents: bool = False, include_subdomains: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), query_policy: str = "preserve", extensions: tuple[str, ...] = ("", ".htm", ".html", ".pdf")) -> Column:
    """First reason why a URL is out of a crawl's scope, null if it is in scope."""
    s = F.lit(seed)
    origin = lambda u: F.concat_ws("|", part(u, 1), F.when(port(u) == "", F.when(part(u, 1) == "http", "80").otherwise("443")).otherwise(port(u)))
    same = (origin(url) == origin(s)) & ((host(url) == host(s)) | (F.lit(include_subdomains) & host(url).endswith(F.concat(F.lit("."), host(s)))))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    seed_path = F.when(part(s, 3) == "", "/").otherwise(part(s, 3))
    prefix = F.regexp_extract(seed_path, "^(.*/)", 1)
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    any_of = lambda patterns: F.lit(False) if not patterns else path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))
    return (
        F.when(depth > max_depth, "depth_exceeded")
        .when(host(url) == "", "invalid_url")
        .when(~same, "outside_origin")
        .when(F.lit(not include_parents) & (path != seed_path) & ~path.startswith(prefix), "outside_seed_path")
        .when(F.lit(query_policy == "exclude") & (part(url, 4) != ""), "query_excluded")
        .when(any_of(exclude), "excluded_path")
        .when(F.lit(bool(include)) & ~any_of(include), "outside_included_paths")
        .when(~suffix.isin(*[e.lower() for e in extensions]), "unsupported_file_type")
    )
