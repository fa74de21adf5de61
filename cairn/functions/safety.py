"""URL safety: literal and looked-up addresses against blocked categories. No name is resolved in executors."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.url import host, part

EMBEDDED = (("::ffff:0:0/96", 0), ("64:ff9b::/96", 0), ("::/96", 0), ("2002::/16", 80))


def parse_ipv4(text: str) -> ipaddress.IPv4Address | None:
    """1 to 4 parts in decimal, octal or hexadecimal, the last one filling what is left."""
    parts = text.split(".")
    if not 1 <= len(parts) <= 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p, 16) if p.lower().startswith("0x") else int(p, 8) if len(p) > 1 and p.startswith("0") else int(p) if p.isascii() and p.isdigit() else -1)
        except ValueError:
            return None
    widths = [256] * (len(parts) - 1) + [256 ** (5 - len(parts))]
    if any(not 0 <= n < w for n, w in zip(numbers, widths, strict=True)):
        return None
    value = 0
    for n in numbers[:-1]:
        value = value * 256 + n
    return ipaddress.IPv4Address(value * widths[-1] + numbers[-1])


def parse_literal(text: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    text = text.strip("[]")
    try:
        return ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return parse_ipv4(text)


def forms(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> list:
    """The address and any IPv4 address inside it (mapped, NAT64, 6to4, compatible)."""
    out = [ip]
    if ip.version == 6:
        for net, shift in EMBEDDED:
            if ip in ipaddress.ip_network(net):
                out.append(ipaddress.IPv4Address((int(ip) >> shift) & 0xFFFFFFFF))
    return out


def is_safe_ip(text: str, blocked: tuple[str, ...] = ()) -> bool:
    ip = parse_literal(text)
    if ip is None:
        return False
    return all(str(x) not in blocked and x.is_global and not x.is_multicast and not x.is_reserved for x in forms(ip)[:1]) and all(str(x) not in blocked and x.is_global for x in forms(ip)[1:])


@F.pandas_udf(T.BooleanType())
def safe_ip(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bool(t) and is_safe_ip(t))


@F.pandas_udf(T.StringType())
def literal_ip(hosts: pd.Series) -> pd.Series:
    """The canonical form of a host that is an address literal, else null."""
    return hosts.map(lambda h: None if not h else None if (ip := parse_literal(h)) is None else str(ip))


def safe_urls(urls: DataFrame, url_col: str, addresses: DataFrame) -> DataFrame:
    """Rows whose URL is http(s) and whose address, literal or from the table ``addresses`` (host, ip), is safe in every form."""
    with_host = urls.withColumn("_h", host(url_col)).filter(part(url_col, 1).isin("http", "https") & (F.col("_h") != ""))
    names = with_host.select("_h").distinct()
    known = names.join(addresses.select(F.col("host").alias("_h"), "ip"), "_h", "left").withColumn("ip", F.coalesce(literal_ip("_h"), "ip"))
    good = known.groupBy("_h").agg(F.min(F.coalesce(safe_ip("ip"), F.lit(False)).cast("int")).alias("_ok")).filter("_ok = 1")
    return with_host.join(good.select("_h"), "_h", "left_semi").drop("_h")


def domain_safe(url: Column) -> Column:
    return part(url, 1).isin("http", "https") & (host(url) != "")
