"""Mixed timestamp texts brought to one UTC instant.

``interpretations`` lists every valid reading of a text (order of day and month, epoch unit, zone). ``normalise`` chooses
one per row by Viterbi over the record order of each source. The sequence of a source holds all its rows that have a
reading, in whatever format: a switch of format and a jump back in time between two neighbours cost a little, a reading
that contradicts what is known of the source costs most. Rows in a format without an order of day and month (ISO, month
names, epochs) carry the last order on, so that taking up the other order after them is a switch as well. A reading against
the usual order of its source, that of most rows which allow one order only, costs as much as a switch.

Sources are decoded in blocks of consecutive row ids: each block gives its matrix of least costs between the states of
its first and last row, the few block matrices of a source are decoded in order, then each block is decoded between the
two states chosen for it. The result equals one pass over the whole source, and no task holds more than one block.

Defined results: null, empty, relative and impossible texts have no reading and give null; a wall clock in a skipped or
repeated hour has none; without a zone in the text and with an unknown zone of the source a wall clock has none; a date
alone is midnight UTC; digits alone count from 1970 (seconds, milli-, micro- or nanoseconds by their number); digits
finer than microseconds are cut off; of sequences of equal cost the one with most earlier instants counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.session import checkpoint
from cairn.text import WHITE

READING = T.StructType([T.StructField("micros", T.LongType()), T.StructField("fmt", T.StringType()), T.StructField("cost", T.IntegerType())])
CONTRADICTS = 1000  # a reading against the known date order of its source
SWITCH, BACKWARD, UNUSUAL = 2, 1, 2
ORDERS = ("dmy", "mdy")  # formats that differ in the order of day and month only
BLOCK_ROWS = 1 << 16
TIE, NEVER = 1 << 32, float("inf")  # what a unit of cost weighs against one later instant; the cost of what cannot be

#: Month names in English, German, French and Spanish, cut to what tells them apart.
MONTHS = {
    1: "jan january januar jänner janv janvier ene enero",
    2: "feb february februar févr fevr février fevrier febrero",
    3: "mar march märz maerz mär mrz mars marzo",
    4: "apr april avr avril abr abril",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juil juillet julio",
    8: "aug august août aout ago agosto",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october okt oktober octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dez dezember déc décembre decembre dic diciembre",
}
MONTH = {name: number for number, names in MONTHS.items() for name in names.split()}
#: English weekday names by ISO number, cut to three letters.
WEEKDAYS = {"mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6, "sun": 7}

ZONE = r"(?P<zone>Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)+)?(?:\[(?P<region>[A-Za-z_/+-]+)\])?"
CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,12}))?)?"
WEEKDAY = r"(?:(?P<wd>[A-Za-z]{3,9}),? +)?"
AMPM = r"(?: ?(?P<ap>[AaPp]\.?[Mm]\.?))?"
TAIL = rf"(?: Uhr)? ?{ZONE}"
PATTERNS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:[Tt]| +){CLOCK} ?{ZONE})?")),
    ("slash_ymd", re.compile(rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:[Tt, ]+{CLOCK}{AMPM}{TAIL})?")),
    ("basic", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,12}}))?)? ?{ZONE}")),
    ("mail", re.compile(rf"{WEEKDAY}(?P<d>\d{{1,2}})[ -](?P<mon>[^\W\d_]{{3,10}})\.?[ -](?P<y>\d{{4}}|\d{{2}})(?:,? +{CLOCK}{AMPM}{TAIL})?")),
    ("ctime", re.compile(rf"(?:(?P<wd>[A-Za-z]{{3,9}}) +)?(?P<mon>[A-Za-z]{{3,9}}) +(?P<d>\d{{1,2}}) +{CLOCK} (?:(?P<zone2>[A-Z]{{3,5}}) )?(?P<y>\d{{4}}) ?{ZONE}")),
    ("month_first", re.compile(rf"{WEEKDAY}(?P<mon>[^\W\d_]{{3,10}})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}})(?:,?(?: at)? +{CLOCK}{AMPM}{TAIL})?")),
    ("day_name", re.compile(rf"{WEEKDAY}(?P<d>\d{{1,2}})(?:\.|er)? (?:de )?(?P<mon>[^\W\d_]{{3,10}})\.?(?: de)? (?P<y>\d{{4}})(?:(?:,| à| at| um| a las)? +(?P<h>\d{{1,2}})[:h](?P<mi>\d{{2}})(?::(?P<s>\d{{2}}))?{AMPM}{TAIL})?")),
]
NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:,?(?:[Tt]| +){CLOCK}{AMPM}{TAIL})?")
EPOCH = re.compile(r"(?P<n>\d{1,19})(?:[.,](?P<f>\d{1,12}))?")
START = datetime(1970, 1, 1, tzinfo=UTC)


@lru_cache(1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown names raise different errors
        return None


@lru_cache(1024)
def abbreviations(name: str) -> dict[str, timedelta | None]:
    """Abbreviations used in a zone with their offset (None where one abbreviation stands for several)."""
    zone, found = _zone(name), {}
    if zone is not None:
        for year in range(1990, 2038):
            for month in range(1, 13):
                at = datetime(year, month, 15, tzinfo=UTC).astimezone(zone)
                short, offset = at.tzname(), at.utcoffset()
                if short and short.isalpha():
                    found[short] = offset if found.get(short, offset) == offset else None
    return found


def _wall(at: datetime, zone: ZoneInfo) -> datetime | None:
    """The instant of a wall clock, or None in a skipped or repeated hour."""
    early, late = at.replace(tzinfo=zone, fold=0), at.replace(tzinfo=zone, fold=1)
    return early if early.utcoffset() == late.utcoffset() else None


def _micros(at: datetime) -> int:
    return (at - START) // timedelta(microseconds=1)


def _instant(g: dict, year: int, month: int, day: int, source_zone: str | None) -> int | None:
    try:
        whole = date(year, month, day)
        if g.get("wd"):
            wd = WEEKDAYS.get(g["wd"][:3].lower())
            if wd is not None and wd != whole.isoweekday():
                return None
        if g.get("h") is None:
            return _micros(datetime(year, month, day, tzinfo=UTC))
        hour = int(g["h"])
        if half := (g.get("ap") or "").lower():
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half[0] == "p" else 0)
        micro = int(((g.get("f") or "") + "000000")[:6])
        at = datetime(year, month, day, hour, int(g["mi"]), int(g.get("s") or 0), micro)
    except ValueError:
        return None
    zone, region = g.get("zone") or g.get("zone2"), g.get("region")
    if zone is None and region is not None:
        zone = region
    if zone is None:
        known = _zone(source_zone) if source_zone else None
        local = _wall(at, known) if known is not None else None
        return None if local is None else _micros(local.astimezone(UTC))
    if zone in ("Z", "z", "UTC", "GMT", "UT"):
        return _micros(at.replace(tzinfo=UTC))
    if zone[0] in "+-":
        hours, minutes = int(zone[1:3]), int(zone[3:].lstrip(":") or 0)
        if hours > 15 or minutes > 59:
            return None
        offset = timedelta(hours=hours, minutes=minutes) * (-1 if zone[0] == "-" else 1)
        return _micros(at.replace(tzinfo=timezone(offset)).astimezone(UTC))
    if "/" in zone:
        named = _zone(zone)
        local = _wall(at, named) if named is not None else None
        return None if local is None else _micros(local.astimezone(UTC))
    offset = abbreviations(source_zone).get(zone) if source_zone else None
    return None if offset is None else _micros(at.replace(tzinfo=timezone(offset)).astimezone(UTC))


def interpretations(text: str | None, source_zone: str | None, order: str | None) -> list[tuple[int, str, int]]:
    """Every valid reading (micros since 1970, format, cost) of a time text, cheapest first."""
    if text is None:
        return []
    text = text.strip(WHITE)
    found: dict[tuple[int, str], int] = {}

    def add(micros: int | None, fmt: str, cost: int) -> None:
        if micros is not None and cost < found.get((micros, fmt), cost + 1):
            found[micros, fmt] = cost

    if m := EPOCH.fullmatch(text):
        digits, fraction = m["n"], m["f"] or ""
        finer = 0 if len(digits) <= 11 else 3 if len(digits) <= 14 else 6 if len(digits) <= 17 else 9
        exact = int(digits) * 10 ** (12 - finer) + int((fraction + "0" * 12)[:12]) // 10**finer
        micros = exact // 10**6
        if micros < 253_402_300_800 * 10**6:
            add(micros, f"epoch{finer}", 0)
        return [(a, b, c) for (a, b), c in found.items()]
    for fmt, pattern in PATTERNS:
        if m := pattern.fullmatch(text):
            g = m.groupdict()
            month = int(g["m"]) if g.get("m") else MONTH.get(g["mon"].lower(), 0)
            year = int(g["y"])
            if len(g["y"]) == 2:
                year += 2000 if year < 70 else 1900
            add(_instant(g, year, month, int(g["d"]), source_zone), fmt, 0)
            break
    if m := NUMERIC.fullmatch(text):
        g = m.groupdict()
        a, b, year = int(g["a"]), int(g["b"]), int(g["y"])
        dmy, mdy = _instant(g, year, b, a, source_zone), _instant(g, year, a, b, source_zone)
        known = order if order in ("dmy", "mdy") else None
        if mdy == dmy:  # one instant in either order
            add(dmy, known or "dmy", 0)
        else:
            add(dmy, "dmy", CONTRADICTS if known == "mdy" else 0)
            add(mdy, "mdy", CONTRADICTS if known == "dmy" else 0)
    return sorted(((a, b, c) for (a, b), c in found.items()), key=lambda x: (x[2], x[0], x[1]))


def with_readings(df: DataFrame, text_col: str, zone_col: str, order_col: str, out: str = "readings") -> DataFrame:
    """Adds the array of readings of ``text_col``."""

    @F.pandas_udf(T.ArrayType(READING))
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, zone, order in batches:
            yield pd.Series([[{"micros": a, "fmt": b, "cost": c} for a, b, c in interpretations(t, z, o)] for t, z, o in zip(text, zone, order, strict=True)])

    return df.withColumn(out, read(text_col, zone_col, order_col))


def _states(row: list, usual: str | None, scale: int) -> list[tuple[int, int, str, str, int]]:
    """(number, micros, format, order, own cost) of the readings of a row; one without an order of its own carries either."""
    out = []
    for k, r in enumerate(row):
        fmt = r["fmt"]
        own = r["cost"] * scale + (k if scale > 1 else 0)
        if fmt in ORDERS:
            out.append((k, r["micros"], fmt, fmt, own + (UNUSUAL * scale if usual is not None and usual != fmt else 0)))
        else:
            out.extend((k, r["micros"], fmt, order, own) for order in ORDERS)
    return out


def _advance(cost: list, prev: list, cur: list, scale: int) -> tuple[list, list[int]]:
    """Least cost of each state without its own, and the state of the row before that gives it."""
    if len(prev) == len(cur) == 2 and prev[1][0] == cur[1][0] == 0:  # one reading each, which carries the order on
        step = scale * (SWITCH * (prev[0][2] != cur[0][2]) + BACKWARD * (cur[0][1] < prev[0][1]))
        return [cost[0] + step, cost[1] + step], [0, 1]
    least, back = [], []
    for _, micros, fmt, order, _ in cur:
        best, at = NEVER, 0
        for i, (_, p_micros, p_fmt, p_order, _) in enumerate(prev):
            turn = 0
            if p_order != order:
                if fmt != order:  # carried, so it does not change here
                    continue
                turn = SWITCH * (p_fmt != p_order)  # between two rows with an order the formats tell
            total = cost[i] + scale * (turn + SWITCH * (p_fmt != fmt) + BACKWARD * (micros < p_micros))
            if total < best:
                best, at = total, i
        least.append(best)
        back.append(at)
    return least, back


def _with_own(least: list, states: list) -> list:
    return [a + s[4] for a, s in zip(least, states, strict=True)]


def block_matrix(rows: list, usual: str | None = None, scale: int = 1) -> np.ndarray:
    """Least cost from each state of the first row to each of the last, both rows' own costs included."""
    prev = _states(rows[0], usual, scale)
    costs = [[s[4] if i == k else NEVER for k, s in enumerate(prev)] for i in range(len(prev))]
    for row in rows[1:]:
        cur = _states(row, usual, scale)
        costs = [_with_own(_advance(cost, prev, cur, scale)[0], cur) for cost in costs]
        prev = cur
    return np.array(costs, dtype=object)


def decode_block(rows: list, start: int | None = None, end: int | None = None, usual: str | None = None) -> list[int]:
    """The reading of each row by Viterbi over one block, with the states of its ends fixed where given."""
    prev = _states(rows[0], usual, TIE)
    cost = [s[4] if start is None or k == start else NEVER for k, s in enumerate(prev)]
    numbers, back = [[s[0] for s in prev]], []
    for row in rows[1:]:
        cur = _states(row, usual, TIE)
        least, at = _advance(cost, prev, cur, TIE)
        cost, prev = _with_own(least, cur), cur
        numbers.append([s[0] for s in cur])
        back.append(at)
    at = cost.index(min(cost)) if end is None else end
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return [n[k] for n, k in zip(numbers, reversed(path), strict=True)]


def _with_usual(marked: DataFrame, source_cols: list[str], readings: str) -> DataFrame:
    """Adds ``_usual``: the order of most rows of the source that allow one order only (null where there is none)."""
    only = marked.filter((F.size(readings) == 1) & F.col(readings)[0]["fmt"].isin(*ORDERS)).select(*source_cols, F.col(readings)[0]["fmt"].alias("_fmt"))
    lead = F.sum(F.when(F.col("_fmt") == ORDERS[0], 1).otherwise(-1))
    usual = only.groupBy(*source_cols).agg(F.when(lead > 0, ORDERS[0]).when(lead < 0, ORDERS[1]).alias("_usual"))
    return marked.join(usual, source_cols, "left")


def normalise(df: DataFrame, source_cols: list[str], id_col: str, readings: str = "readings", block_rows: int = BLOCK_ROWS, usual: bool = False) -> DataFrame:
    """Chooses one reading per row that has any; adds ``chosen`` (a reading) and ``n_readings``, drops rows without readings.

    ``df`` needs the source columns, a bigint ``id_col`` giving the record order, and ``readings``. Rows of equal id are
    ordered by their readings. ``usual`` weighs the usual order of each source.
    """
    keys = [*source_cols, "_block"]
    rows = checkpoint(df.filter(F.size(readings) > 0).select(*source_cols, id_col, readings).withColumn("_block", F.floor(F.col(id_col) / block_rows)))
    rows = _with_usual(rows, source_cols, readings) if usual else rows.withColumn("_usual", F.lit(None).cast("string"))
    key_fields = [rows.schema[c] for c in keys]
    summary = [T.StructField("_usual", T.StringType()), T.StructField("first", T.ArrayType(READING)), T.StructField("last", T.ArrayType(READING)), T.StructField("cost", T.ArrayType(T.ArrayType(T.LongType())))]
    matrix_schema = T.StructType([*key_fields, *summary])
    ends_schema = T.StructType([*key_fields, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out_schema = T.StructType([*[rows.schema[c] for c in source_cols], rows.schema[id_col], T.StructField("chosen", READING), T.StructField("n_readings", T.IntegerType())])

    def ordered(table: pa.Table) -> tuple[list[int], list, np.ndarray, pa.StructArray]:
        """Ids and readings in record order, and where the readings of each row begin among those of all rows."""
        ids, lists = table.column(id_col).to_pylist(), table.column(readings).combine_chunks()
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        parts = zip(*(flat.field(f.name).to_pylist() for f in READING), strict=True)
        dicts = [{"micros": a, "fmt": b, "cost": c} for a, b, c in parts]
        stops = np.cumsum(sizes)
        seq = [dicts[i:j] for i, j in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
        at = sorted(range(len(ids)), key=lambda k: (ids[k], [(r["micros"], r["fmt"]) for r in seq[k]]))
        return [ids[k] for k in at], [seq[k] for k in at], (stops - sizes)[at], flat

    def table_of(schema: T.StructType, columns: list[list]) -> pa.Table:
        fields = to_arrow_schema(schema)
        return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def to_matrix(key: tuple, table: pa.Table) -> pa.Table:
        (_, seq, _, _), order = ordered(table), table.column("_usual")[0].as_py()
        values = [*(k.as_py() for k in key), order, seq[0], seq[-1], [[None if c == NEVER else c for c in costs] for costs in block_matrix(seq, order, TIE)]]
        return table_of(matrix_schema, [[v] for v in values])

    def to_ends(key: tuple, table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda b: b["_block"])
        total, prev, back = [], [], []
        for b in blocks:
            first, last = _states(b["first"], b["_usual"], TIE), _states(b["last"], b["_usual"], TIE)
            entry, before = _advance(total, prev, first, TIE) if prev else ([0] * len(first), [0] * len(first))
            through = [[NEVER if row[k] is None else e + row[k] for e, row in zip(entry, b["cost"], strict=True)] for k in range(len(last))]
            total, prev = [min(t) for t in through], last
            back.append((before, [t.index(min(t)) for t in through]))
        at, ends = total.index(min(total)), []
        for before, within in reversed(back):
            start = within[at]
            ends.append((start, at))
            at = before[start]
        starts, stops = zip(*reversed(ends), strict=True)
        return table_of(ends_schema, [*([b[k] for b in blocks] for k in keys), list(starts), list(stops)])

    def choose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, seq, starts, flat = ordered(left)
        path = decode_block(seq, right.column("start")[0].as_py(), right.column("end")[0].as_py(), left.column("_usual")[0].as_py())
        alike = [1 if len(row) == 1 else len({r["micros"] for r in row if r["cost"] == row[k]["cost"]}) for row, k in zip(seq, path, strict=True)]
        return table_of(out_schema, [*([k.as_py()] * len(ids) for k in key[:-1]), ids, flat.take(pa.array(starts + path)), alike])

    ends = rows.groupBy(*keys).applyInArrow(to_matrix, matrix_schema).groupBy(*source_cols).applyInArrow(to_ends, ends_schema)
    return rows.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(choose, out_schema)


def utc_text(micros: F.Column) -> F.Column:
    """`2024-05-06T07:08:09.000000Z`."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def chosen_readings(df: DataFrame, hosts: DataFrame, source_cols: list[str], id_col: str, text_col: str, host_col: str = "host") -> DataFrame:
    """Source columns, id, ``chosen`` and ``n_readings`` (instants of the same cost) under what is known of the host."""
    known = hosts.groupBy(F.col("host").alias(host_col)).agg(F.max("time_zone").alias("_zone"), F.max("date_order").alias("_order"))
    joined = df.join(known, host_col, "left")
    return normalise(with_readings(joined, text_col, "_zone", "_order"), source_cols, id_col, usual=True)


def unambiguous_instants(df: DataFrame, hosts: DataFrame, source_cols: list[str], id_col: str, text_col: str, host_col: str = "host") -> DataFrame:
    """Source columns, id and ``utc`` of the rows whose text denotes exactly one instant under what is known of its host."""
    picked = chosen_readings(df, hosts, source_cols, id_col, text_col, host_col)
    return picked.filter((F.col("chosen.cost") == 0) & (F.col("n_readings") == 1)).select(*source_cols, id_col, utc_text(F.col("chosen.micros")).alias("utc"))


def resolved_instants(df: DataFrame, hosts: DataFrame, source_cols: list[str], id_col: str, text_col: str, host_col: str = "host") -> DataFrame:
    """Source columns, id, ``utc`` and ``n_readings`` of the rows with several instants, as the neighbours decide them."""
    picked = chosen_readings(df, hosts, source_cols, id_col, text_col, host_col).filter("n_readings > 1")
    return picked.select(*source_cols, id_col, utc_text(F.col("chosen.micros")).alias("utc"), "n_readings")
