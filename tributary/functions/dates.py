"""Dates and times: parts, boundaries, arithmetic, formats."""

from __future__ import annotations

import re

from ..plans import tree as t
from ..plans.lexer import SqlError
from . import formats

#: Spellings of parts: fixed values.
PARTS = {
    "YEAR": "YEAR YEARS YR YRS Y YY YYY YYYY", "QUARTER": "QUARTER QUARTERS QTR QTRS Q", "MONTH": "MONTH MONTHS MON MONS MM", "WEEK": "WEEK WEEKS W WK WY WEEKOFYEAR WOY", "ISOWEEK": "ISOWEEK WEEKISO WEEK_ISO WEEKOFYEARISO",
    "DAY": "DAY DAYS D DD DAYOFMONTH", "DAYOFWEEK": "DAYOFWEEK WEEKDAY DW DOW", "DAYOFWEEKISO": "DAYOFWEEKISO DAYOFWEEK_ISO DOW_ISO", "DAYOFYEAR": "DAYOFYEAR YEARDAY DOY DY", "HOUR": "HOUR HOURS H HH HR HRS", "MINUTE": "MINUTE MINUTES M MI MIN MINS",
    "SECOND": "SECOND SECONDS S SEC SECS", "MILLISECOND": "MILLISECOND MILLISECONDS MS MSEC MSECS", "MICROSECOND": "MICROSECOND MICROSECONDS US USEC USECS", "NANOSECOND": "NANOSECOND NANOSECONDS NS NSEC", "ISOYEAR": "ISOYEAR YEAROFWEEK YEAROFWEEKISO",
    "EPOCH": "EPOCH EPOCH_SECOND EPOCH_SECONDS", "DECADE": "DECADE DECADES", "CENTURY": "CENTURY CENTURIES", "MILLENNIUM": "MILLENNIUM MILLENNIA", "TIMEZONE": "TIMEZONE", "TIMEZONE_HOUR": "TIMEZONE_HOUR TZH", "TIMEZONE_MINUTE": "TIMEZONE_MINUTE TZM", "DATE": "DATE", "TIME": "TIME",
}
PART_OF = {w: p for p, words in PARTS.items() for w in words.split()}
WEEKDAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")


def words_of(node: t.Node) -> str:
    if isinstance(node, t.Call) and node.name == "WEEK" and node.args:
        return f"WEEK({words_of(node.args[0])})"
    return node.value.upper() if isinstance(node, t.Text) else node.last.upper() if isinstance(node, t.Name) else node.name if isinstance(node, t.Call) else ""


def is_part(node: t.Node) -> bool:
    word = words_of(node)
    return word in PART_OF or word.startswith("WEEK(")


def part(node: t.Node) -> str:
    """The part that a bare word or a string names; WEEK(day) is kept."""
    word = words_of(node)
    if word.startswith("WEEK("):
        return word
    if word not in PART_OF:
        raise SqlError(f"no date part: {word or type(node).__name__}")
    return PART_OF[word]


def looks_temporal(node: t.Node) -> bool:
    return isinstance(node, t.Typed) or isinstance(node, t.Call) and re.search("DATE|TIME|NOW", node.name) is not None or isinstance(node, t.Cast) and re.match("DATE|TIME", node.type) is not None


def is_date(node: t.Node) -> bool:
    return isinstance(node, (t.Typed, t.Cast)) and node.type == "DATE"


def interval(e, value: t.Node, unit: str) -> str:
    """INTERVAL 1 DAY, INTERVAL '1 day 2 hours', INTERVAL x MONTH."""
    if not unit:
        if not isinstance(value, t.Text):
            raise SqlError("an interval needs a unit")
        return f"INTERVAL '{re.sub(r',', ' ', value.value)}'"
    if " TO " in unit:
        return f"INTERVAL {e.expr(value)} {unit}"
    unit = PART_OF.get(unit, unit)
    text = e.expr(value)
    if isinstance(value, t.Text):
        text = value.value.strip()
    if re.fullmatch(r"-?\d+", text) and e.dialect not in {"bigquery", "redshift"} and unit in {"YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"}:
        return f"INTERVAL '{text}' {unit}"  # whole days keep a date a date
    if unit == "QUARTER":
        return f"make_ym_interval(0, 3 * ({text}))"
    if unit in {"YEAR", "MONTH"}:
        return f"make_ym_interval({text}, 0)" if unit == "YEAR" else f"make_ym_interval(0, {text})"
    scale = {"WEEK": f"7 * ({text}), 0, 0, 0", "DAY": f"{text}, 0, 0, 0", "HOUR": f"0, {text}, 0, 0", "MINUTE": f"0, 0, {text}, 0", "SECOND": f"0, 0, 0, {text}", "MILLISECOND": f"0, 0, 0, ({text}) / 1000.0", "MICROSECOND": f"0, 0, 0, ({text}) / 1000000.0"}
    if unit not in scale:
        raise SqlError(f"no interval unit: {unit}")
    return f"make_dt_interval({scale[unit]})"


def truncate(unit: str, value: str, keep: str = "TIMESTAMP_NTZ") -> str:
    """`value` at the start of its part, as type `keep`. Weeks begin on Monday unless a day is named."""
    if m := re.fullmatch(r"WEEK\((\w+)\)", unit):
        back = f"date_sub(cast({value} AS DATE), pmod(dayofweek({value}) - {WEEKDAYS.index(m[1]) + 1}, 7))"
        return f"cast({back} AS {keep})"
    if unit == "ISOYEAR":
        return f"cast(date_trunc('WEEK', make_date(extract(YEAROFWEEK FROM {value}), 1, 4)) AS {keep})"
    unit = {"ISOWEEK": "WEEK"}.get(unit, unit)
    if keep == "DATE" and unit in {"YEAR", "QUARTER", "MONTH", "WEEK"}:
        return f"trunc({value}, '{unit}')"
    if unit in {"DECADE", "CENTURY", "MILLENNIUM"}:
        n = {"DECADE": 10, "CENTURY": 100, "MILLENNIUM": 1000}[unit]
        return f"cast(make_date(cast(floor((year({value}) - {0 if n == 10 else 1}) / {n}) * {n} + {0 if n == 10 else 1} AS INT), 1, 1) AS {keep})"
    return f"cast(date_trunc('{unit}', {value}) AS {keep})"


def boundaries(unit: str, start: str, end: str) -> str:
    """How many boundaries of the part lie between start and end."""
    months = f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"
    if unit == "YEAR":
        return f"cast(year({end}) - year({start}) AS BIGINT)"
    if unit == "ISOYEAR":
        return f"cast(extract(YEAROFWEEK FROM {end}) - extract(YEAROFWEEK FROM {start}) AS BIGINT)"
    if unit == "MONTH":
        return f"cast({months} AS BIGINT)"
    if unit == "QUARTER":
        return f"cast((year({end}) - year({start})) * 4 + quarter({end}) - quarter({start}) AS BIGINT)"
    if unit == "DAY":
        return f"cast(datediff({end}, {start}) AS BIGINT)"
    if unit.startswith("WEEK(") or unit in {"WEEK", "ISOWEEK"}:
        return f"cast(datediff({truncate(unit, end, 'DATE')}, {truncate(unit, start, 'DATE')}) / 7 AS BIGINT)"
    if unit == "NANOSECOND":
        return f"(1000 * timestampdiff(MICROSECOND, {start}, {end}))"
    if unit in {"HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"}:
        return f"timestampdiff({unit}, date_trunc('{unit}', {start}), date_trunc('{unit}', {end}))"
    raise SqlError(f"no difference in {unit}")


def time_boundaries(unit: str, start: str, end: str) -> str:
    return f"time_diff('{unit}', time_trunc('{unit}', {start}), time_trunc('{unit}', {end}))"


def add(unit: str, n: str, value: str, temporal: str = "") -> str:
    if unit == "NANOSECOND":
        unit, n = "MICROSECOND", f"cast(({n}) / 1000 AS INT)"
    if temporal == "DATE" and unit in {"DAY", "WEEK"}:
        return f"date_add({value}, {n if unit == 'DAY' else f'7 * ({n})'})"
    if temporal == "DATE" and unit in {"MONTH", "QUARTER", "YEAR"}:
        scale = {"MONTH": "", "QUARTER": "3 * ", "YEAR": "12 * "}[unit]
        return f"add_months({value}, {scale}({n}))" if scale else f"add_months({value}, {n})"
    return f"timestampadd({unit}, {n}, {value})"


def bigquery_add(temporal, sign):
    def build(e, node, a):
        by = node.args[1]
        if isinstance(by, t.Interval) and by.unit:
            n = by.value.value if isinstance(by.value, t.Text) else e.expr(by.value)
            unit = PART_OF.get(by.unit, by.unit)
        elif len(node.args) == 3:  # (part, n, value)
            unit, n, a = part(node.args[0]), a[1], [a[2]]
        else:
            return f"{a[0]} {'+' if sign > 0 else '-'} {a[1]}"
        n = n if sign > 0 else f"-({n})"
        if temporal == "TIME":
            return f"({a[0]} + {interval(e, t.Raw(n), unit)})"
        return add(unit, n, a[0], temporal)

    return build


def bigquery_diff(temporal):
    def build(e, node, a):
        unit = part(node.args[2])
        if temporal == "TIMESTAMP" and unit in {"DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"}:
            return f"timestampdiff({unit}, {a[1]}, {a[0]})"  # complete units, not boundaries
        return time_boundaries(unit, a[1], a[0]) if temporal == "TIME" else boundaries(unit, a[1], a[0])

    return build


def warehouse_diff(e, node, a):
    """DATEDIFF(part, start, end)."""
    return boundaries(part(node.args[0]), a[1], a[2])


def warehouse_add(e, node, a):
    """DATEADD(part, n, value): whole-day parts keep a date a date."""
    unit = part(node.args[0]).replace("ISOWEEK", "WEEK")
    return add(unit, a[1], a[2], "DATE") if is_date(node.args[2]) else f"dateadd({unit}, {a[1]}, {a[2]})"


def bigquery_trunc(keep):
    def build(e, node, a):
        if is_part(node.args[0]) and not is_part(node.args[1]):
            return truncate(part(node.args[0]), a[1], keep)
        unit = part(node.args[1])
        if keep == "TIME":
            return f"time_trunc('{unit}', {a[0]})"
        if len(a) > 2:
            return f"to_utc_timestamp({truncate(unit, f'from_utc_timestamp({a[0]}, {a[2]})', 'TIMESTAMP')}, {a[2]})"
        return truncate(unit, a[0], keep)

    return build


def warehouse_trunc(e, node, a):
    """DATE_TRUNC(part, value), or the parts the other way round."""
    first, second = node.args[0], node.args[1]
    if isinstance(first, t.Text) and is_part(first) or not is_part(second):
        unit, value, source = part(first), a[1], second
    else:
        unit, value, source = part(second), a[0], first
    keep = "DATE" if is_date(source) else "TIMESTAMP_NTZ"
    return truncate(unit, value, keep)


def date_part(e, node, a):
    return extract(e, part(node.args[0]), a[1])


def extract(e, unit: str, value: str) -> str:
    unit = unit if unit.startswith("WEEK(") else PART_OF.get(unit, unit)
    if unit.startswith("WEEK("):
        day = WEEKDAYS.index(unit[5:-1]) + 1
        return f"cast(floor((dayofyear({value}) + 6 - pmod(dayofweek({value}) - {day}, 7)) / 7) AS INT)"
    if unit in {"YEAR", "QUARTER", "MONTH", "DAY", "HOUR", "MINUTE"}:
        return f"extract({unit} FROM {value})"
    exact = f"extract(SECOND FROM {value})"
    told = {
        "WEEK": f"weekofyear({value})", "ISOWEEK": f"weekofyear({value})", "SECOND": f"cast(floor({exact}) AS INT)", "MILLISECOND": f"cast(pmod(floor({exact} * 1000), 1000) AS INT)", "MICROSECOND": f"cast(pmod(floor({exact} * 1000000), 1000000) AS INT)",
        "NANOSECOND": f"(1000 * cast(pmod(floor({exact} * 1000000), 1000000) AS BIGINT))", "ISOYEAR": f"extract(YEAROFWEEK FROM {value})", "DAYOFYEAR": f"dayofyear({value})", "EPOCH": f"unix_seconds(cast({value} AS TIMESTAMP))",
        "DAYOFWEEK": f"dayofweek({value})" if e.dialect in {"bigquery", "any", "databricks"} else f"(dayofweek({value}) - 1)", "DAYOFWEEKISO": f"(weekday({value}) + 1)", "DATE": f"cast({value} AS DATE)", "TIME": f"cast({value} AS TIME)",
        "DECADE": f"cast(floor(year({value}) / 10) AS INT)", "CENTURY": f"cast(ceil(year({value}) / 100) AS INT)", "MILLENNIUM": f"cast(ceil(year({value}) / 1000) AS INT)", "TIMEZONE": "0", "TIMEZONE_HOUR": "0", "TIMEZONE_MINUTE": "0",
    }
    if unit not in told:
        raise SqlError(f"no part to extract: {unit}")
    return told[unit]


def _pattern(node, a, at, translate):
    from ..plans.emit import string

    told = node.args[at].value if isinstance(node.args[at], t.Text) else None
    return string(translate(told)) if told is not None else a[at]


def format_bigquery(temporal):
    def build(e, node, a):
        pattern = _pattern(node, a, 0, formats.from_strftime)
        value = a[1]
        if temporal == "TIME":
            value = f"make_timestamp_ntz(DATE '1970-01-01', {a[1]})"
        if len(a) > 2:
            value = f"from_utc_timestamp({value}, {a[2]})"
        return f"date_format({value}, {pattern})"

    return build


def parse_bigquery(spark):
    def build(e, node, a):
        pattern = re.sub("HH(?=:)|hh(?=:)", lambda m: m[0][0], _pattern(node, a, 0, formats.from_strftime))  # hours of one digit too
        # AM and PM are taken in either case, as upper-case letters.
        value = f"upper({a[1]})" if re.search("(^|[^a-zA-Z])a($|[^a-zA-Z])", pattern.strip("'")) else a[1]
        return f"{'try_' * node.safe}{spark}({value}, {pattern})"

    return build


def parse_template(spark, fallback):
    """TO_DATE(text, format) and the like; without a format a cast."""

    def build(e, node, a):
        if len(a) == 1:
            if isinstance(node.args[0], t.Raw):
                return f"cast(timestamp_seconds({a[0]}) AS {fallback})"
            return f"{'try_' if spark.startswith('try_') else ''}cast({a[0]} AS {fallback})"
        return f"cast({spark}({a[0]}, {_pattern(node, a, 1, formats.from_template)}) AS {fallback})"

    return build


def bigquery_date(e, node, a):
    if len(a) == 3:
        return f"make_date({', '.join(a)})"
    if len(a) == 2:
        return f"cast(from_utc_timestamp({a[0]}, {a[1]}) AS DATE)"
    return f"cast({a[0]} AS DATE)"


def bigquery_datetime(e, node, a):
    if len(a) == 6:
        return f"make_timestamp_ntz({', '.join(a)})"
    if len(a) == 2 and isinstance(node.args[1], t.Text):
        return f"cast(from_utc_timestamp({a[0]}, {a[1]}) AS TIMESTAMP_NTZ)"
    if len(a) == 2:
        return f"make_timestamp_ntz({', '.join(a)})"
    return f"cast({a[0]} AS TIMESTAMP_NTZ)"


def bigquery_time(e, node, a):
    if len(a) == 3:
        return f"make_time({a[0]}, {a[1]}, {a[2]})"
    if len(a) == 2:
        return f"cast(from_utc_timestamp({a[0]}, {a[1]}) AS TIME)"
    return f"cast({a[0]} AS TIME)"


def bigquery_timestamp(e, node, a):
    return f"to_utc_timestamp({a[0]}, {a[1]})" if len(a) == 2 else f"cast({a[0]} AS TIMESTAMP)"


def last_day(e, node, a):
    if len(a) == 1 or part(node.args[1]) == "MONTH":
        return f"last_day({a[0]})"
    unit = part(node.args[1])
    months = {"YEAR": 12, "QUARTER": 3}.get(unit)
    start = truncate(unit, a[0], "DATE")
    return f"date_sub(add_months({start}, {months}), 1)" if months else f"date_add({start}, 6)"


def end_of_month_add(e, node, a):
    """ADD_MONTHS: the last day of a month stays one."""
    return f"(CASE WHEN cast({a[0]} AS DATE) = last_day({a[0]}) THEN last_day(add_months({a[0]}, {a[1]})) ELSE add_months({a[0]}, {a[1]}) END)"


def convert_zone(e, node, a):
    if len(a) == 2:
        return f"convert_timezone('UTC', {a[0]}, cast({a[1]} AS TIMESTAMP_NTZ))"
    return f"convert_timezone({a[0]}, {a[1]}, cast({a[2]} AS TIMESTAMP_NTZ))"


def parts_stamp(kind):
    def build(e, node, a):
        if len(a) == 2:
            return f"make_timestamp_ntz({a[0]}, {a[1]})"
        seconds = f"{a[5]} + ({a[6]}) / 1000000000.0" if len(a) > 6 else a[5]
        zone = f", {a[7]}" if len(a) > 7 and kind == "make_timestamp" else ""
        return f"{kind}({', '.join(a[:5])}, {seconds}{zone})"

    return build


def time_parts(e, node, a):
    seconds = f"{a[2]} + ({a[3]}) / 1000000000.0" if len(a) > 3 else a[2]
    return f"make_time({a[0]}, {a[1]}, {seconds})"


def date_parts(e, node, a):
    """Months and days may lie outside their ranges."""
    return f"date_add(add_months(make_date({a[0]}, 1, 1), {a[1]} - 1), cast({a[2]} - 1 AS INT))"


def time_slice(e, node, a):
    """The start or end of the n-part slice since 1970-01-01 (weeks: since a Monday)."""
    unit = part(node.args[2])
    end = len(node.args) > 3 and (words_of(node.args[3]) == "END")
    n = a[1]
    if unit in {"YEAR", "QUARTER", "MONTH"}:
        months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]
        index = f"floor(((year({a[0]}) - 1970) * 12 + month({a[0]}) - 1) / ({n} * {months}))"
        return f"cast(add_months(DATE '1970-01-01', cast(({index} + {int(end)}) * {n} * {months} AS INT)) AS TIMESTAMP_NTZ)"
    seconds = {"WEEK": 604800, "DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]
    shift = 345600 if unit == "WEEK" else 0
    stamp = f"unix_seconds(cast({a[0]} AS TIMESTAMP))"
    index = f"floor(({stamp} - {shift}) / ({n} * {seconds}))"
    return f"cast(timestamp_seconds(({index} + {int(end)}) * {n} * {seconds} + {shift}) AS TIMESTAMP_NTZ)"


def compare_as(left, right):
    from .registry import fold_compare

    return fold_compare(left, right)


def compared(left, right):
    return lambda e, node, a: compare_as(f"cast({a[0]} AS {left})", f"cast({a[1]} AS {right})")


def interval_compare(e, node, a):
    """Months count as 30 days, so that both kinds of intervals compare."""
    size = lambda x: f"(unix_micros(cast(TIMESTAMP_NTZ '1970-01-01 00:00:00' + {x} AS TIMESTAMP)))"
    return compare_as(size(a[0]), size(a[1]))


def databricks_add(sign):
    def build(e, node, a):
        if len(a) == 3:
            n = a[1] if sign > 0 else f"-({a[1]})"
            return add(part(node.args[0]), n, a[2], "DATE" if is_date(node.args[2]) else "")
        return f"{'date_add' if sign > 0 else 'date_sub'}({a[0]}, {a[1]})"

    return build


def databricks_diff(e, node, a):
    return f"timestampdiff({part(node.args[0])}, {a[1]}, {a[2]})" if len(a) == 3 else f"datediff({a[0]}, {a[1]})"


COMMON = {
    "UNIX_DATE": "unix_date({0})", "DATE_FROM_UNIX_DATE": "date_from_unix_date({0})", "TIMESTAMP_MICROS": "timestamp_micros({0})", "TIMESTAMP_MILLIS": "timestamp_millis({0})", "TIMESTAMP_SECONDS": "timestamp_seconds({0})",
    "UNIX_MICROS": "unix_micros(cast({0} AS TIMESTAMP))", "UNIX_MILLIS": "unix_millis(cast({0} AS TIMESTAMP))", "UNIX_SECONDS": "unix_seconds(cast({0} AS TIMESTAMP))", "LAST_DAY": last_day, "DATE_PART": date_part, "CONVERT_TIMEZONE": convert_zone,
}
BIGQUERY = {
    "DATE": bigquery_date, "DATETIME": bigquery_datetime, "TIME": bigquery_time, "TIMESTAMP": bigquery_timestamp,
    **{f"{k}_ADD": bigquery_add(k, 1) for k in ("DATE", "DATETIME", "TIME", "TIMESTAMP")}, **{f"{k}_SUB": bigquery_add(k, -1) for k in ("DATE", "DATETIME", "TIME", "TIMESTAMP")}, **{f"{k}_DIFF": bigquery_diff(k) for k in ("DATE", "DATETIME", "TIME", "TIMESTAMP")},
    "DATE_TRUNC": bigquery_trunc("DATE"), "DATETIME_TRUNC": bigquery_trunc("TIMESTAMP_NTZ"), "TIME_TRUNC": bigquery_trunc("TIME"), "TIMESTAMP_TRUNC": bigquery_trunc("TIMESTAMP"), **{f"FORMAT_{k}": format_bigquery(k) for k in ("DATE", "DATETIME", "TIME", "TIMESTAMP")},
    "PARSE_DATE": parse_bigquery("to_date"), "PARSE_DATETIME": parse_bigquery("to_timestamp_ntz"), "PARSE_TIME": parse_bigquery("to_time"), "PARSE_TIMESTAMP": parse_bigquery("to_timestamp"), "DATEADD": warehouse_add, "DATEDIFF": warehouse_diff,
}
KINDS = {"DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP"}
WAREHOUSE = {"DATEADD": warehouse_add, "DATEDIFF": warehouse_diff, "DATE_TRUNC": warehouse_trunc, "ADD_MONTHS": end_of_month_add, "DATE_ADD": warehouse_add, "DATE_DIFF": warehouse_diff}
REDSHIFT = {
    **WAREHOUSE, **{(f"{a}_CMP" if a == b else f"{a}_CMP_{b}"): compared(KINDS[a], KINDS[b] if a != "DATE" else KINDS[b]) for a in KINDS for b in KINDS}, "DATE_PART_YEAR": "year({0})", "INTERVAL_CMP": interval_compare, "MONTHS_BETWEEN": "months_between({*})",
    "TIMEOFDAY": "date_format(now(), 'EEE MMM dd HH:mm:ss.SSSSSS yyyy z')", "TIMEZONE": "convert_timezone('UTC', {0}, cast({1} AS TIMESTAMP_NTZ))", "TO_TIMESTAMP": parse_template("to_timestamp", "TIMESTAMP"), "TO_DATE": parse_template("to_date", "DATE"),
}
SNOWFLAKE = {
    **WAREHOUSE, "DATE_FROM_PARTS": date_parts, "DATEFROMPARTS": date_parts, "TIME_FROM_PARTS": time_parts, "TIMEFROMPARTS": time_parts, "DAYNAME": "dayname({0})", "MONTHNAME": "monthname({0})", "TIMEADD": warehouse_add, "TIMESTAMPADD": warehouse_add, "TIMEDIFF": warehouse_diff, "TIMESTAMPDIFF": warehouse_diff,
    **{n: parts_stamp(k) for k, names in {"make_timestamp_ntz": "TIMESTAMP_FROM_PARTS TIMESTAMPFROMPARTS TIMESTAMP_NTZ_FROM_PARTS TIMESTAMPNTZFROMPARTS", "make_timestamp": "TIMESTAMP_TZ_FROM_PARTS TIMESTAMPTZFROMPARTS", "make_timestamp_ltz": "TIMESTAMP_LTZ_FROM_PARTS TIMESTAMPLTZFROMPARTS"}.items() for n in names.split()},
    "DATE": parse_template("to_date", "DATE"), "TO_DATE": parse_template("to_date", "DATE"), "TRY_TO_DATE": parse_template("try_to_date", "DATE"), "TIME": parse_template("to_time", "TIME"), "TO_TIME": parse_template("to_time", "TIME"), "TRY_TO_TIME": parse_template("try_to_time", "TIME"),
    "TO_TIMESTAMP": parse_template("to_timestamp", "TIMESTAMP_NTZ"), "TO_TIMESTAMP_NTZ": parse_template("to_timestamp", "TIMESTAMP_NTZ"), "TRY_TO_TIMESTAMP": parse_template("try_to_timestamp", "TIMESTAMP_NTZ"), "TRY_TO_TIMESTAMP_NTZ": parse_template("try_to_timestamp", "TIMESTAMP_NTZ"),
    "TO_TIMESTAMP_LTZ": parse_template("to_timestamp", "TIMESTAMP"), "TO_TIMESTAMP_TZ": parse_template("to_timestamp", "TIMESTAMP"), "TRY_TO_TIMESTAMP_LTZ": parse_template("try_to_timestamp", "TIMESTAMP"), "TRY_TO_TIMESTAMP_TZ": parse_template("try_to_timestamp", "TIMESTAMP"), "TIME_SLICE": time_slice, "MONTHS_BETWEEN": "months_between({*})",
}
DATABRICKS = {
    "DATEADD": databricks_add(1), "DATE_ADD": databricks_add(1), "DATE_SUB": databricks_add(-1), "DATEDIFF": databricks_diff, "DATE_DIFF": databricks_diff, "TIMESTAMP": "timestamp({0})", "DATE_TRUNC": "date_trunc({*})", "LAST_DAY": "last_day({0})",
    "CONVERT_TIMEZONE": "convert_timezone({*})", "DATE_PART": "date_part({*})",
}
