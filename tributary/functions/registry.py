"""Functions of each dialect as Spark SQL: one flat table for each dialect, then the common one, then Spark's own name.

An entry is a template ({0}, {1} .. arguments, {*} all of them), a dict of templates by number of arguments
(None: any other number), or a function of (emitter, call, argument texts).
"""

from __future__ import annotations

import re

from ..plans import tree as t
from ..plans.lexer import SqlError
from . import dates, formats, geo

COLLATIONS = {"case_insensitive": "UTF8_LCASE", "case_sensitive": "UTF8_BINARY", "nocase": "UTF8_LCASE", "und:ci": "UNICODE_CI", "binary": "UTF8_BINARY", "": "UTF8_BINARY"}


def collation(name: str) -> str:
    return COLLATIONS.get(name.lower(), name)


def text_of(node: t.Node) -> str | None:
    return node.value if isinstance(node, t.Text) else None


# Helpers for entries


def regexp_extract(e, node, a):
    """First match, or its first group if the pattern has one; NULL without a match."""
    pattern = text_of(node.args[1])
    group = 1 if pattern is not None and re.search(r"(?<!\\)\((?!\?)", pattern) else 0
    value = a[0] if len(a) < 3 else f"substring({a[0]}, {a[2]})"
    nth = a[3] if len(a) > 3 else "1"
    return f"get(regexp_extract_all({value}, {a[1]}, {group}), {nth} - 1)"


def regexp_extract_all(e, node, a):
    pattern = text_of(node.args[1])
    group = 1 if pattern is not None and re.search(r"(?<!\\)\((?!\?)", pattern) else 0
    return f"regexp_extract_all({a[0]}, {a[1]}, {group})"


def regexp_replace(e, node, a):
    """All matches; \\1 in the replacement becomes $1."""
    replacement = text_of(node.args[2]) if len(node.args) > 2 else ""
    told = a[2] if replacement is None else _string(re.sub(r"\\(\d)", r"$\1", replacement))
    pattern = flagged(node, a, 4 if e.dialect == "redshift" else 5)
    return f"regexp_replace({a[0]}, {pattern}, {told}{', ' + a[3] if len(a) > 3 and a[3].isdigit() else ''})"


def flagged(node, a, at):
    """The pattern with a flag argument, such as 'i', put into it."""
    flags = "".join(c for c in (text_of(node.args[at]) or "") if c in "ims") if len(node.args) > at else ""
    return f"concat('(?{flags})', {a[1]})" if flags else a[1]


def regexp_substr(e, node, a):
    """The n-th match from a position on."""
    value = a[0] if len(a) < 3 or a[2] == "1" else f"substring({a[0]}, {a[2]})"
    nth = a[3] if len(a) > 3 else "1"
    return f"get(regexp_extract_all({value}, {flagged(node, a, 4)}, {a[5] if len(a) > 5 else 0}), {nth} - 1)"


def regexp_instr(e, node, a):
    if len(a) < 3 or a[2] == "1":
        return f"regexp_instr({a[0]}, {a[1]})"
    return f"(CASE WHEN regexp_instr(substring({a[0]}, {a[2]}), {a[1]}) > 0 THEN regexp_instr(substring({a[0]}, {a[2]}), {a[1]}) + {a[2]} - 1 ELSE 0 END)"


def _string(value: str) -> str:
    from ..plans.emit import string

    return string(value)


def literal_split(e, node, a):
    """Split by the delimiter as plain text; an empty one splits into characters."""
    delimiter = a[1] if len(a) > 1 else "','"
    if delimiter == "''":
        return f"filter(split({a[0]}, ''), x -> x <> '')"
    return f"split({a[0]}, concat('\\\\Q', {delimiter}, '\\\\E'), -1)"


def tokens(a, delimiters):
    """The non-empty tokens between any of the delimiter characters."""
    return f"filter(split({a}, concat('[', regexp_replace({delimiters}, '([^A-Za-z0-9])', '\\\\\\\\$1'), ']')), x -> x <> '')"


def fold_compare(left, right):
    return f"(CASE WHEN {left} < {right} THEN -1 WHEN {left} > {right} THEN 1 WHEN {left} = {right} THEN 0 END)"


def compare(left, right):
    return lambda e, node, a: fold_compare(f"cast({a[0]} AS {left})", f"cast({a[1]} AS {right})")


def ordered_list(name):
    """array_agg and its kin: with ORDER BY the values are sorted by the keys; LIMIT cuts."""

    def build(e, node, a):
        if node.within:
            node.order, node.within = node.within, []
        ignore, node.nulls = node.nulls == "IGNORE", ""  # lists take no nulls anyhow, unless they come with keys
        collected = f"{'collect_set' if node.distinct else 'collect_list'}({a[0]}){clauses(e, node, order=False)}"
        if not node.order:
            text = collected
        elif len(node.order) == 1 and e.expr(node.order[0].key) == a[0]:
            up = "false" if node.order[0].direction == "DESC" else "true"
            text = f"sort_array({collected}, {up})"
        else:
            checks = " ".join(f"WHEN l.k{i} < r.k{i} THEN {1 if o.direction == 'DESC' else -1} WHEN l.k{i} > r.k{i} THEN {-1 if o.direction == 'DESC' else 1}" for i, o in enumerate(node.order))
            pairs = ", ".join(f"'k{i}', {e.expr(o.key)}" for i, o in enumerate(node.order))
            entry = f"named_struct({pairs}, 'v', {a[0]})"
            entry = f"CASE WHEN {a[0]} IS NOT NULL THEN {entry} END" if ignore else entry
            collected = f"collect_list({entry}){clauses(e, node, order=False)}"
            return limited(e, node, f"transform(array_sort({collected}, (l, r) -> CASE {checks} ELSE 0 END), x -> x.v)")
        return limited(e, node, text)

    return build


def limited(e, node, text):
    return f"slice({text}, 1, {e.expr(node.limit)})" if node.limit is not None else text


def clauses(e, node, order=True):
    """FILTER, IGNORE NULLS and OVER of a call."""
    text = ""
    if node.within:
        text += f" WITHIN GROUP (ORDER BY {e.orders(node.within)})"
    elif node.order and order:
        text += f" WITHIN GROUP (ORDER BY {e.orders(node.order)})"
    if node.where is not None:
        text += f" FILTER (WHERE {e.expr(node.where)})"
    if node.nulls in {"IGNORE", "RESPECT"}:
        text += f" {node.nulls} NULLS"
    if node.over is not None:
        text += f" OVER {e.window(node.over)}"
    return text


def aggregate(template):
    """A template for the aggregate itself, with FILTER and OVER put behind it."""

    def build(e, node, a):
        head = fill(template, ["DISTINCT " * (node.distinct and i == 0) + x for i, x in enumerate(a)])
        return head + clauses(e, node)

    return build


def outside(template, inner):
    """`template` around an aggregate `inner`, so that FILTER and OVER stay with the aggregate."""
    return lambda e, node, a: template.replace("{agg}", fill(inner, a) + clauses(e, node))


def percentile(name):
    """PERCENTILE_CONT(x, p) OVER (..) as well as the ordered-set form."""

    def build(e, node, a):
        if node.within:
            return f"{name}({a[0]})" + clauses(e, node)
        node.within = [t.Order(node.args[0])]
        return f"{name}({a[1]})" + clauses(e, node)

    return build


def at_extreme(name):
    """MAX_BY and MIN_BY: of several rows at the extreme the one with the least value, whatever order rows come in.

    Spark takes the row that it meets last. Least is by number (as double, then whole), then by text.
    """

    def build(e, node, a):
        if len(a) != 2:
            return plain(e, node, a)
        value = f"CAST({a[0]} AS STRING)"
        number, whole = f"try_cast({value} AS DOUBLE)", f"try_cast({value} AS DECIMAL(38, 0))"
        if name == "max_by":  # the greatest of the reverse: digits of the text's bytes, and an end that is above all digits
            order = f"{a[0]} IS NOT NULL, -nullif({number}, double('NaN')), -{whole}, translate(hex({value}), '0123456789ABCDEF', 'FEDCBA9876543210') || 'G'"
        else:
            order = f"{a[0]} IS NULL, {number}, {whole}, {value}"
        return f"{name}({'DISTINCT ' * node.distinct}{a[0]}, if({a[1]} IS NULL, NULL, struct({a[1]}, {order})))" + clauses(e, node)

    return build


def count(e, node, a):
    if node.distinct and node.over is not None:
        return f"size(collect_set({a[0]}){clauses(e, node)})"
    return f"count({'DISTINCT ' * node.distinct}{', '.join(a) or '*'})" + clauses(e, node)


def listagg(e, node, a):
    inner = "DISTINCT " * node.distinct + a[0]
    text = f"listagg({inner}{', ' + a[1] if len(a) > 1 else ', ' + repr(',') if e.dialect == 'bigquery' else ''})"
    if node.over is not None or node.limit is not None:
        node.order, node.within = node.within or node.order, []
        values = ordered_list("")(e, node, a)
        return f"array_join({values}, {a[1] if len(a) > 1 else repr(',' if e.dialect == 'bigquery' else '')})"
    return text + clauses(e, node)


def bigquery_round(e, node, a):
    if len(a) > 2 or (len(a) == 2 and isinstance(node.args[1], t.Text)):
        return f"bround({', '.join(a[:2])})" if "EVEN" in (text_of(node.args[-1]) or "").upper() else f"round({', '.join(a[:2])})"
    return f"round({', '.join(a)})"


def trunc_number(e, node, a):
    """Towards zero at n digits; dates are truncated to a part."""
    if len(a) == 2 and isinstance(node.args[1], (t.Text, t.Name)) and dates.is_part(node.args[1]):
        return f"trunc({a[0]}, {_string(dates.part(node.args[1]))})"
    if len(a) == 1 and e.dialect == "redshift" and dates.looks_temporal(node.args[0]):
        return f"cast({a[0]} AS DATE)"
    if len(a) == 1:
        return f"(CASE WHEN {a[0]} < 0 THEN ceil({a[0]}) ELSE floor({a[0]}) END)"
    scaled = f"abs({a[0]}) * pow(10, {a[1]})"
    return f"(sign({a[0]}) * floor({scaled}) / pow(10, {a[1]}))"


def bigquery_format(e, node, a):
    told = text_of(node.args[0])
    kinds = re.findall(r"%[-+ #0,(]*\d*(?:\.\d+)?([a-zA-Z])", told or "")
    a = [a[0], *(f"cast({x} AS DOUBLE)" if kind in "fFeEgG" else x for x, kind in zip(a[1:], kinds + ["s"] * len(a)))]
    return f"format_string({_string(re.sub('%[tT]', '%s', told)) if told is not None else a[0]}{''.join(', ' + x for x in a[1:])})"


def json_object(e, node, a):
    """to_json of a struct; keys and values by pairs, arguments, or colons."""
    pairs = []
    args = [x for x in node.args]
    while args:
        x = args.pop(0)
        if isinstance(x, t.Pair):
            pairs.append((x.name, e.expr(x.value)))
        else:
            key = x.value if isinstance(x, t.Text) else getattr(x, "last", e.expr(x).strip("'"))
            pairs.append((key, e.expr(args.pop(0))))
    inner = ", ".join(f"{_string(k)}, {v}" for k, v in pairs)
    keep = node.nulls != "ABSENT" and node.name != "OBJECT_CONSTRUCT"
    return f"to_json(named_struct({inner}), map('ignoreNullFields', '{'false' if keep else 'true'}'))"


def object_construct(e, node, a):
    inner = json_object(e, node, a)
    return f"parse_json({inner})"


def json_path(node, a, at=1):
    """A literal JSON path with double-quoted keys in brackets turned into single-quoted ones."""
    if len(a) <= at:
        return "'$'"
    told = text_of(node.args[at])
    return a[at] if told is None else _string(re.sub(r'\["(.*?)"\]|\."(.*?)"', lambda m: f"['{m[1] or m[2]}']", told))


def json_extract(e, node, a):
    return f"get_json_object({a[0]}, {json_path(node, a)})"


def json_scalar(e, node, a):
    path = json_path(node, a)
    return f"(CASE WHEN schema_of_variant(try_variant_get(try_parse_json({a[0]}), {path}, 'variant')) RLIKE '^(OBJECT|ARRAY|VOID)' THEN NULL ELSE get_json_object({a[0]}, {path}) END)"


def json_strings(e, node, a):
    return f"from_json(get_json_object({a[0]}, {json_path(node, a)}), 'array<string>')"


def json_array(e, node, a):
    return f"transform(cast(variant_get(parse_json({a[0]}), {json_path(node, a)}, 'array<variant>') AS ARRAY<VARIANT>), x -> to_json(x))"


def json_path_text(e, node, a):
    """Keys as arguments; a last boolean asks for NULL where the text is no JSON, which get_json_object does anyhow."""
    keys = [text_of(x) for x in node.args[1:] if isinstance(x, t.Text)]
    path = "$" + "".join(f"['{k}']" for k in keys)
    return f"get_json_object({a[0]}, {_string(path)})"


def json_element(e, node, a):
    return f"get_json_object({a[0]}, concat('$[', {a[1]}, ']'))"


def get_path(e, node, a):
    told = text_of(node.args[1])
    return f"try_variant_get({a[0]}, {_string('$.' + told) if told is not None else f'concat({chr(39)}$.{chr(39)}, {a[1]})'}, 'variant')"


def variant_kind(a):
    return (
        f"(CASE WHEN {{v}} IS NULL THEN NULL WHEN is_variant_null({{v}}) THEN 'null' WHEN schema_of_variant({{v}}) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant({{v}}) LIKE 'ARRAY%' THEN 'array' "
        f"WHEN schema_of_variant({{v}}) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant({{v}}) = 'STRING' THEN 'string' ELSE 'number' END)"
    ).replace("{v}", f"try_parse_json({a})")


def to_char(e, node, a):
    if len(a) == 1:
        return f"cast({a[0]} AS STRING)"
    told = text_of(node.args[1])
    if told is not None and formats.is_temporal_template(told):
        return f"date_format({a[0]}, {_string(formats.from_template(told))})"
    return f"to_char({a[0]}, {_string(formats.number_format(told)) if told is not None else a[1]})"


def to_number(name, safe=False):
    def build(e, node, a):
        numbers = [x for x, n in zip(a[1:], node.args[1:]) if isinstance(n, t.Raw)]
        form = next((text_of(n) for n in node.args[1:] if isinstance(n, t.Text)), None)
        precision = numbers[0] if numbers else "38"
        scale = numbers[1] if len(numbers) > 1 else str(len(re.sub(r"[^09]", "", re.split(r"[.D]", form, maxsplit=1)[1])) if form and re.search(r"[.D]", form) else 0)
        digits = f"regexp_replace(regexp_replace(cast({a[0]} AS STRING), '[^+0-9.eE-]', ''), '^(.*)-$', '-$1')"
        return f"{'try_' * safe}cast({digits} AS DECIMAL({precision}, {scale}))" if form else f"{'try_' * safe}cast({a[0]} AS DECIMAL({precision}, {scale}))"

    return build


def to_binary(safe):
    def build(e, node, a):
        form = a[1] if len(a) > 1 else "'hex'"
        return f"{'try_' * safe}to_binary({a[0]}, {form})"

    return build


def pad(name):
    return {2: f"{name}({{0}}, {{1}}, ' ')", 3: f"{name}({{*}})"}


def struct_array(e, node, a):
    """ARRAY(SELECT ..): the values of a one-column query as an array."""
    (nested,) = node.args
    query = nested.query
    name = "value__"
    if isinstance(query, t.Select) and len(query.items) == 1:
        query.items[0].alias = name
        order = [o for o in query.order]
        inner = e.query(query)
        listed = f"sort_array(collect_list({name}))" if not order else f"collect_list({name})"
        if order and e.expr(order[0].key) in (name, getattr(query.items[0].value, "last", None)):
            listed = f"sort_array(collect_list({name}), {'false' if order[0].direction == 'DESC' else 'true'})"
        return f"(SELECT {listed} FROM ({inner}))"
    return f"(SELECT collect_list(*) FROM ({e.query(query)}))"


def array_or_query(e, node, a):
    if len(node.args) == 1 and isinstance(node.args[0], t.Nested):
        return struct_array(e, node, a)
    return f"array({', '.join(a)})"


def generate_array(e, node, a):
    step = a[2] if len(a) > 2 else "1"
    return f"(CASE WHEN {step} = 0 OR ({step} > 0 AND {a[0]} > {a[1]}) OR ({step} < 0 AND {a[0]} < {a[1]}) THEN array() ELSE sequence({a[0]}, {a[1]}, {step}) END)"


def temporal_array(e, node, a):
    step = a[2] if len(a) > 2 else "INTERVAL 1 DAY"
    kind = "DATE" if "DATE" in node.name else "TIMESTAMP"
    return f"sequence(cast({a[0]} AS {kind}), cast({a[1]} AS {kind}), {step})"


def string_function(e, node, a):
    if len(a) == 2:
        return f"date_format(from_utc_timestamp({a[0]}, {a[1]}), 'yyyy-MM-dd HH:mm:ss')"
    if isinstance(node.args[0], t.Call) and node.args[0].name == "PARSE_JSON":
        return f"get_json_object({a[0]}, '$')"
    return f"cast({a[0]} AS STRING)"


def lax(kind, safe=True):
    def build(e, node, a):
        ok = "try_" if safe or node.safe else ""
        return f"{ok}cast(get_json_object(cast({a[0]} AS STRING), '$') AS {kind})"

    return build


def position(e, node, a):
    """instr(text, part) or the place from a start on."""
    return f"locate({', '.join(a)})" if len(a) > 2 else f"instr({a[1]}, {a[0]})"


def bigquery_instr(e, node, a):
    if len(a) == 2:
        return f"instr({a[0]}, {a[1]})"
    return f"locate({a[1]}, {a[0]}, {a[2]})"


def any_null(name):
    """greatest and least give NULL for any NULL."""
    return lambda e, node, a: f"(CASE WHEN {' OR '.join(f'{x} IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END)"


def array_sort(e, node, a):
    """Ascending, nulls last for Snowflake's default; the flags of its second and third argument."""
    up = len(a) < 2 or a[1].upper() == "TRUE"
    return f"array_sort({a[0]})" if up and not (len(a) > 2 and a[2].upper() == "TRUE") else f"sort_array({a[0]}, {'true' if up else 'false'})"


def seeded_random(e, node, a):
    return f"cast((rand({', '.join(a)}) - 0.5) * 1.8446744073709552E19 AS BIGINT)"


def nth_value(e, node, a):
    if len(a) > 2:
        node.nulls = "IGNORE" if a[2].upper() == "TRUE" else node.nulls
    return f"nth_value({a[0]}, {a[1]})" + clauses(e, node)


def window_value(name):
    def build(e, node, a):
        if len(a) > 1 and a[1].upper() in {"TRUE", "FALSE"}:
            node.nulls, a = ("IGNORE" if a[1].upper() == "TRUE" else node.nulls), a[:1]
        return f"{name}({a[0]})" + clauses(e, node)

    return build


def trims(name):
    """TRIM(text, characters)."""
    spark = {"TRIM": "BOTH", "LTRIM": "LEADING", "RTRIM": "TRAILING"}[name]

    def build(e, node, a):
        if len(a) == 1:
            return f"{name.lower()}({a[0]})"
        return f"trim({spark} {a[1]} FROM {a[0]})"

    return build


def reject(reason):
    def build(e, node, a):
        raise SqlError(f"{node.name}: {reason}")

    return build


def approx_distinct(e, node, a):
    return f"approx_count_distinct({a[0]})" + clauses(e, node)


def quantiles(e, node, a):
    """The n + 1 bounds of n equal parts, n a literal."""
    if not a[1].isdigit():
        raise SqlError(f"{node.name} takes a literal number of quantiles")
    parts = ", ".join(f"{i / int(a[1])!r}D" for i in range(int(a[1]) + 1))
    return f"approx_percentile({a[0]}, array({parts}), 10000)" + clauses(e, node)


def vector(template):
    return lambda e, node, a: template.replace("{0}", a[0]).replace("{1}", a[1])


def utf32(code):
    return f"decode(unhex(lpad(hex(cast({code} AS BIGINT)), 8, '0')), 'UTF-32')"


COMMON = {
    "NVL": "coalesce({*})", "IFNULL": "coalesce({*})", "ISNULL": {1: "({0} IS NULL)", 2: "coalesce({*})"}, "ZEROIFNULL": "coalesce({0}, 0)", "NULLIFZERO": "nullif({0}, 0)",
    "COUNT": count, "ARRAY_AGG": ordered_list("array_agg"), "ARRAYAGG": ordered_list("array_agg"), "STRING_AGG": listagg, "LISTAGG": listagg,
    "APPROX_COUNT_DISTINCT": approx_distinct, "APPROXIMATE_COUNT": approx_distinct, "APPROXIMATE_PERCENTILE_DISC": percentile("percentile_disc"),
    "PERCENTILE_CONT": percentile("percentile_cont"), "PERCENTILE_DISC": percentile("percentile_disc"),
    "COUNTIF": aggregate("count_if({0})"), "COUNT_IF": aggregate("count_if({0})"), "LOGICAL_AND": aggregate("bool_and({0})"), "LOGICAL_OR": aggregate("bool_or({0})"),
    "FIRST_VALUE": window_value("first_value"), "LAST_VALUE": window_value("last_value"), "FIRST": window_value("first"), "LAST": window_value("last"), "NTH_VALUE": nth_value,
    "PERCENT_RANK": lambda e, n, a: "percent_rank()" + clauses(e, n), "TRIM": trims("TRIM"), "LTRIM": trims("LTRIM"), "RTRIM": trims("RTRIM"), "BTRIM": trims("TRIM"),
    "CURRENT_TIMESTAMP": {0: "current_timestamp()", 1: "convert_timezone({0}, localtimestamp())"}, "GETDATE": "current_timestamp()", "NOW": "now()", "SYSDATE": "current_date()", "CURDATE": "current_date()",
    "CURRENT_DATE": {0: "current_date()", 1: "to_date(convert_timezone({0}, localtimestamp()))"}, "CURRENT_TIME": {0: "current_time()", None: "current_time()"}, "LOCALTIMESTAMP": "localtimestamp()", "CURRENT_TIMEZONE": "current_timezone()",
    "CURRENT_DATETIME": {0: "localtimestamp()", 1: "convert_timezone(current_timezone(), {0}, localtimestamp())"},
    "ENDS_WITH": "endswith({*})", "STARTS_WITH": "startswith({*})", "STRPOS": "instr({0}, {1})", "CHARINDEX": position, "POSITION": position, "CHR": lambda e, n, a: utf32(a[0]),
    "TO_BASE64": "base64({0})", "FROM_BASE64": "unbase64({0})", "FROM_HEX": "unhex({0})", "TO_HEX": "lower(hex({0}))", "UNICODE": "ascii({0})", "REPLICATE": "repeat({*})",
    "POW": "pow({*})", "GENERATE_UUID": "uuid()", "UUID_STRING": "uuid()", "ARRAY_LENGTH": "size({0})", "ARRAY_REVERSE": "reverse({0})", "ARRAY_CAT": "concat({*})", "ARRAY_CONCAT": "concat({*})",
    "UNNEST": "explode({0})", "DATE_FROM_PARTS": "make_date({*})", "EDITDISTANCE": {2: "levenshtein({*})", 3: "least(levenshtein({0}, {1}), {2})"}, "MEAN": aggregate("mean({0})"), "MEDIAN": aggregate("median({0})"), "MAX_BY": at_extreme("max_by"), "MIN_BY": at_extreme("min_by"),
    "SAFE_CAST": "try_cast({*})", "IFF": "if({*})", "DECODE": {2: "decode({*})", None: "decode({*})"}, "SQUARE": "pow({0}, 2)",
    "INITCAP": "initcap({0})", "SOUNDEX": "soundex({0})", "CRC32": "crc32({0})", "NEXT_DAY": "next_day({*})", "STRTOL": "cast(conv({0}, {1}, 10) AS BIGINT)", "PARSE_URL": "parse_url({*})",
    "COTH": "(1 / tanh({0}))", "CSCH": "(1 / sinh({0}))", "SECH": "(1 / cosh({0}))", "APPROX_TOP_COUNT": aggregate("approx_top_k({*})"), "APPROX_QUANTILES": quantiles, "IFPLUS": "(CASE WHEN {0} = {1} THEN {1} ELSE {0} + {2} END)",
    "COSINE_DISTANCE": vector("(1 - aggregate(zip_with({0}, {1}, (x, y) -> cast(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x AS DOUBLE) * x) * aggregate({1}, 0D, (s, x) -> s + cast(x AS DOUBLE) * x)))"),
    "EUCLIDEAN_DISTANCE": vector("sqrt(aggregate(zip_with({0}, {1}, (x, y) -> pow(cast(x AS DOUBLE) - y, 2)), 0D, (s, x) -> s + x))"),
    "APPENDS": reject("needs table history"), "CHANGES": reject("needs table history"), "EXTERNAL_OBJECT_TRANSFORM": reject("needs an object store of its own"), "VECTOR_SEARCH": reject("is a table function of its own"), "SEARCH": reject("needs a search index"),
    **dates.COMMON, **geo.CALLS,
}

BIGQUERY = {
    "BYTE_LENGTH": "octet_length({0})", "OCTET_LENGTH": "octet_length({0})", "CODE_POINTS_TO_BYTES": "unhex(array_join(transform({0}, c -> lpad(hex(c), 2, '0')), ''))",
    "CODE_POINTS_TO_STRING": f"array_join(transform({{0}}, c -> {utf32('c')}), '')", "COLLATE": lambda e, n, a: f"collate({a[0]}, {_string(collation(text_of(n.args[1]) or ''))})",
    "CONTAINS_SUBSTR": "contains(lower(cast({0} AS STRING)), lower({1}))", "EDIT_DISTANCE": lambda e, n, a: f"levenshtein({a[0]}, {a[1]})" if len(a) == 2 else f"least(levenshtein({a[0]}, {a[1]}), {e.expr(n.args[2].value) if isinstance(n.args[2], t.Pair) else a[2]})",
    "FORMAT": bigquery_format, "INSTR": bigquery_instr, "LPAD": pad("lpad"), "RPAD": pad("rpad"), "NORMALIZE": {1: "normalize_text({0}, 'NFC')", 2: lambda e, n, a: f"normalize_text({a[0]}, '{getattr(n.args[1], 'last', 'NFC').upper()}')"},
    "NORMALIZE_AND_CASEFOLD": {1: "casefold_text({0}, 'NFC')", 2: lambda e, n, a: f"casefold_text({a[0]}, '{getattr(n.args[1], 'last', 'NFC').upper()}')"},
    "REGEXP_CONTAINS": "regexp_like({0}, {1})", "REGEXP_EXTRACT": regexp_extract, "REGEXP_SUBSTR": regexp_extract, "REGEXP_EXTRACT_ALL": regexp_extract_all, "REGEXP_INSTR": regexp_instr, "REGEXP_REPLACE": regexp_replace,
    "SAFE_CONVERT_BYTES_TO_STRING": "decode({0}, 'UTF-8')", "TO_CODE_POINTS": "transform(filter(split({0}, ''), x -> x <> ''), c -> ascii(c))", "SPLIT": literal_split, "SUBSTR": "substring({*})",
    "DIV": "({0} DIV {1})", "IEEE_DIVIDE": "(CASE WHEN {1} <> 0 THEN cast({0} AS DOUBLE) / {1} WHEN {0} = 0 OR isnan({0}) THEN double('NaN') WHEN {0} > 0 THEN double('Infinity') WHEN {0} < 0 THEN double('-Infinity') END)",
    "IS_INF": "(abs({0}) = double('Infinity'))", "IS_NAN": "isnan({0})", "LOG": {1: "ln({0})", 2: "log({1}, {0})"}, "RAND": "rand()", "RANGE_BUCKET": "size(filter({1}, b -> b <= {0}))", "ROUND": bigquery_round, "TRUNC": trunc_number,
    "SAFE_DIVIDE": "try_divide({*})", "SAFE_ADD": "try_add({*})", "SAFE_MULTIPLY": "try_multiply({*})", "SAFE_SUBTRACT": "try_subtract({*})", "SAFE_NEGATE": "try_multiply({0}, -1)", "GREATEST": any_null("greatest"), "LEAST": any_null("least"),
    "ARRAY_CONCAT_AGG": lambda e, n, a: "flatten(collect_list({0}){1})".format(a[0], clauses(e, n, order=False)) if not n.order else f"flatten({ordered_list('')(e, n, a)})", "ARRAY": array_or_query, "ARRAY_INTERSECT": "sort_array(array_intersect({*}))", "ARRAY_DISTINCT": "sort_array(array_distinct({0}))",
    "ARRAY_TO_STRING": "array_join({*})", "GENERATE_ARRAY": generate_array, "GENERATE_DATE_ARRAY": temporal_array, "GENERATE_TIMESTAMP_ARRAY": temporal_array,
    "BOOL": lax("BOOLEAN", False), "LAX_BOOL": lax("BOOLEAN"), "FLOAT64": lax("DOUBLE", False), "LAX_FLOAT64": lax("DOUBLE"), "INT64": lax("BIGINT", False), "LAX_INT64": "cast(round(try_cast(get_json_object(cast({0} AS STRING), '$') AS DOUBLE)) AS BIGINT)", "STRING": string_function, "LAX_STRING": "get_json_object(cast({0} AS STRING), '$')",
    "JSON_EXTRACT": json_extract, "JSON_QUERY": json_extract, "JSON_EXTRACT_SCALAR": json_scalar, "JSON_VALUE": json_scalar, "JSON_EXTRACT_STRING_ARRAY": json_strings, "JSON_VALUE_ARRAY": json_strings, "JSON_EXTRACT_ARRAY": json_array, "JSON_QUERY_ARRAY": json_array,
    "JSON_OBJECT": json_object, "JSON_ARRAY": "to_json(array({*}))", "JSON_TYPE": lambda e, n, a: variant_kind(a[0]), "TO_JSON_STRING": "to_json({0})", "TO_JSON": "to_json({0})", "PARSE_JSON": "to_json(parse_json({0}))",
    "OBJECT_CONSTRUCT": object_construct, "OBJECT_CONSTRUCT_KEEP_NULL": object_construct, "CHAR_LENGTH": "char_length({0})", "CHARACTER_LENGTH": "character_length({0})", "BIT_COUNT": "bit_count({0})", "ANY_VALUE": aggregate("any_value({0}, true)"),
    **dates.BIGQUERY,
}

REDSHIFT = {
    "BPCHARCMP": lambda e, n, a: fold_compare(f"rtrim({a[0]})", f"rtrim({a[1]})"), "BTTEXT_PATTERN_CMP": lambda e, n, a: fold_compare(a[0], a[1]), "LEN": "length({0})", "TEXTLEN": "length({0})",
    "COLLATE": BIGQUERY["COLLATE"], "OCTETINDEX": "(CASE WHEN instr({1}, {0}) = 0 THEN 0 ELSE octet_length(substring({1}, 1, instr({1}, {0}) - 1)) + 1 END)", "REGEXP_COUNT": lambda e, n, a: f"regexp_count({a[0]}, {flagged(n, a, 3)})",
    "REGEXP_INSTR": regexp_instr, "REGEXP_REPLACE": {2: "regexp_replace({0}, {1}, '')", None: regexp_replace}, "REGEXP_SUBSTR": regexp_substr,
    "TO_CHAR": to_char, "TO_NUMBER": to_number("TO_NUMBER"), "TRUNC": trunc_number, "ARRAY": "array({*})", "ARRAY_FLATTEN": "flatten({0})", "GET_ARRAY_LENGTH": "size({0})", "SPLIT_TO_ARRAY": literal_split, "SUBARRAY": {2: "slice({0}, {1} + 1, size({0}))", 3: "slice({0}, {1} + 1, {2})"},
    "DEXP": "exp({0})", "DLOG1": "ln({0})", "DLOG10": "log10({0})", "LOG": {1: "log10({0})", 2: "log({0}, {1})"}, "RANDOM": "rand()",
    "JSON_PARSE": "parse_json({0})", "CAN_JSON_PARSE": "(try_parse_json({0}) IS NOT NULL)", "IS_VALID_JSON": "coalesce(schema_of_variant(try_parse_json({0})) NOT LIKE 'ARRAY%', false)", "IS_VALID_JSON_ARRAY": "coalesce(schema_of_variant(try_parse_json({0})) LIKE 'ARRAY%', false)",
    "JSON_EXTRACT_ARRAY_ELEMENT_TEXT": json_element, "JSON_EXTRACT_PATH_TEXT": json_path_text, "JSON_TYPEOF": lambda e, n, a: variant_kind(a[0]), "JSON_SERIALIZE": "to_json({0})", "JSON_SERIALIZE_TO_VARBYTE": "encode(to_json({0}), 'UTF-8')", "JSON_ARRAY_LENGTH": "json_array_length({0})",
    "SPLIT_PART": "split_part({*})", "RATIO_TO_REPORT": lambda e, n, a: f"({a[0]} / sum({a[0]}){clauses(e, n)})", "FUNC_SHA1": "sha1({0})", "SHA1": "sha1({0})", "SHA2": "sha2({*})", "STRTOL": "cast(conv({0}, {1}, 10) AS BIGINT)", "CBRT": "cbrt({0})", "SIGN": "sign({0})",
    "CHAR_LENGTH": "char_length({0})", "CHARACTER_LENGTH": "character_length({0})", "DIFFERENCE": "size(filter(sequence(1, 4), i -> substring(soundex({0}), i, 1) = substring(soundex({1}), i, 1)))",
    **dates.REDSHIFT,
}


def generate_range(e, node, a):
    if len(a) == 1:
        a = ["0", *a]
    step = a[2] if len(a) > 2 else "1"
    return f"(CASE WHEN ({step} > 0 AND {a[0]} >= {a[1]}) OR ({step} < 0 AND {a[0]} <= {a[1]}) THEN array() ELSE sequence({a[0]}, {a[1]} - cast(sign({step}) AS INT), {step}) END)"


def array_except(e, node, a):
    """A multiset difference: each value of the second array takes one away."""
    return (
        f"transform(filter(transform({a[0]}, (x, i) -> named_struct('x', x, 'n', size(filter(slice({a[0]}, 1, i + 1), y -> y <=> x)))), "
        f"s -> s.n > size(filter({a[1]}, y -> y <=> s.x))), s -> s.x)"
    )


SNOWFLAKE = {
    **{f"SEQ{n}": {0: "seq4"} for n in (1, 2, 4, 8)},
    "REGEXP_COUNT": REDSHIFT["REGEXP_COUNT"], "REGEXP_SUBSTR_ALL": "regexp_extract_all({0}, {1}, 0)", "REGEXP_EXTRACT_ALL": "regexp_extract_all({0}, {1}, 0)", "REGEXP_INSTR": regexp_instr, "REGEXP_SUBSTR": regexp_substr, "REGEXP_LIKE": lambda e, n, a: f"regexp_like({a[0]}, concat('^(?:', {flagged(n, a, 2)}, ')$'))", "REGEXP_REPLACE": {2: "regexp_replace({0}, {1}, '')", None: regexp_replace},
    "BIT_LENGTH": "bit_length({0})", "OCTET_LENGTH": "octet_length({0})", "CHAR": lambda e, n, a: utf32(a[0]), "INSERT": "overlay({0} PLACING {3} FROM {1} FOR {2})", "RTRIMMED_LENGTH": "length(rtrim({0}))", "SPACE": "space({0})",
    "STRTOK": lambda e, n, a: f"get({tokens(a[0], a[1] if len(a) > 1 else repr(' '))}, {a[2] if len(a) > 2 else 1} - 1)", "STRTOK_TO_ARRAY": lambda e, n, a: tokens(a[0], a[1] if len(a) > 1 else repr(" ")), "SPLIT": literal_split, "SPLIT_PART": "split_part({*})", "LEN": "length({0})",
    "ENDSWITH": "endswith({*})", "STARTSWITH": "startswith({*})", "JAROWINKLER_SIMILARITY": "jaro_winkler({0}, {1})", "ARRAY_CONSTRUCT": "array({*})", "ARRAY_COMPACT": "array_compact({0})", "ARRAY_CONSTRUCT_COMPACT": "array_compact(array({*}))",
    "ARRAY_CONTAINS": "array_contains({1}, {0})", "ARRAY_EXCEPT": array_except, "ARRAY_FLATTEN": "flatten({0})", "ARRAY_GENERATE_RANGE": generate_range, "ARRAY_INSERT": "array_insert({0}, {1} + 1, {2})", "ARRAY_INTERSECTION": "sort_array(array_intersect({*}))", "ARRAY_MAX": "array_max({0})", "ARRAY_MIN": "array_min({0})",
    "ARRAY_POSITION": "nullif(array_position({1}, {0}) - 1, -1)", "ARRAY_PREPEND": "array_prepend({*})", "ARRAY_APPEND": "array_append({*})", "ARRAY_REMOVE": "array_remove({*})", "ARRAY_REMOVE_AT": "concat(slice({0}, 1, {1}), slice({0}, {1} + 2, size({0})))", "ARRAY_SIZE": "size({0})", "ARRAY_SLICE": "slice({0}, {1} + 1, {2} - ({1}))", "ARRAY_SORT": array_sort,
    "ARRAY_DISTINCT": "array_distinct({0})", "ARRAY_TO_STRING": "array_join({*})", "ARRAYS_OVERLAP": "coalesce(arrays_overlap({*}), false)", "VARIANCE_POP": aggregate("var_pop({0})"), "VARIANCE_SAMP": aggregate("var_samp({0})"),
    "BITAND_AGG": aggregate("bit_and(cast(round({0}) AS BIGINT))"), "BITOR_AGG": aggregate("bit_or(cast(round({0}) AS BIGINT))"), "BITXOR_AGG": aggregate("bit_xor(cast(round({0}) AS BIGINT))"), "BOOLAND_AGG": aggregate("bool_and(cast({0} AS BOOLEAN))"), "BOOLOR_AGG": aggregate("bool_or(cast({0} AS BOOLEAN))"),
    "BOOLXOR_AGG": outside("({agg} = 1)", "count_if(cast({0} AS BOOLEAN))"), "SKEW": aggregate("skewness({0})"), "GROUPING_ID": "grouping_id({*})", "TO_VARCHAR": to_char, "TO_CHAR": to_char, "TO_BINARY": to_binary(False), "TRY_TO_BINARY": to_binary(True),
    "OBJECT_AGG": aggregate("map_from_entries(collect_list(struct({0}, {1})))"), "ARRAY_UNIQUE_AGG": aggregate("collect_set({0})"), "ARRAY_UNION_AGG": lambda e, n, a: f"array_distinct(flatten(collect_list({a[0]}){clauses(e, n)}))", "HASH_AGG": aggregate("bit_xor(xxhash64({*}))"), "BITMAP_COUNT": "bitmap_count({0})",
    **{f"{p}{n}": to_number(n, bool(p)) for p in ("", "TRY_") for n in ("TO_DECIMAL", "TO_NUMBER", "TO_NUMERIC")}, "TO_DOUBLE": "cast({0} AS DOUBLE)", "TRY_TO_DOUBLE": "try_cast({0} AS DOUBLE)", "TO_BOOLEAN": "cast({0} AS BOOLEAN)", "TRY_TO_BOOLEAN": "try_cast({0} AS BOOLEAN)",
    "RANDOM": seeded_random, "DIV0": "(CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END)", "DIV0NULL": "(CASE WHEN coalesce({1}, 0) = 0 THEN 0 ELSE {0} / {1} END)", "ROUND": bigquery_round, "TRUNC": trunc_number, "TRUNCATE": trunc_number, "LOG": {1: "ln({0})", 2: "log({0}, {1})"},
    "CHECK_JSON": "(try_parse_json({0}) IS NOT NULL)", "PARSE_JSON": "parse_json({0})", "TRY_PARSE_JSON": "try_parse_json({0})", "GET_PATH": get_path, "GET": lambda e, n, a: f"get({a[0]}, {a[1]})", "OBJECT_KEYS": "json_object_keys(to_json({0}))", "STRIP_NULL_VALUE": "(CASE WHEN is_variant_null({0}) THEN NULL ELSE {0} END)", "TO_JSON": "to_json({0})",
    "OBJECT_CONSTRUCT": object_construct, "OBJECT_CONSTRUCT_KEEP_NULL": object_construct, "TYPEOF": "upper(typeof({0}))", "PARSE_IP": "split({0}, '/')", "SOUNDEX_P123": "soundex({0})", "MODE": aggregate("mode({0})"), "MINHASH": reject("has no Spark counterpart"), "GREATEST": any_null("greatest"), "LEAST": any_null("least"),
    **dates.SNOWFLAKE,
}

DATABRICKS = {
    "REGEXP_REGEX": "regexp({*})", "STRING": "string({0})", "LOCATE": "locate({*})", "ARRAY": "array({*})", "ARRAY_AGG": ordered_list("array_agg"), "COLLECT_SET": lambda e, n, a: f"sort_array(collect_set({a[0]}){clauses(e, n)})",
    "ANY": aggregate("any({0})"), "POSITION": "position({*})", "CHARINDEX": "locate({*})", "LTRIM": {1: "ltrim({0})", 2: "ltrim({0}, {1})"}, "RTRIM": {1: "rtrim({0})", 2: "rtrim({0}, {1})"}, "BTRIM": "btrim({*})", "CHR": "chr({0})", "TRIM": trims("TRIM"),
    "FIRST": window_value("first"), "LAST": window_value("last"), "ISNULL": "isnull({0})", "DECODE": "decode({*})", "TRUNC": "trunc({*})", "UNNEST": "explode({0})",
    **dates.DATABRICKS,
}

DIALECT = {"any": BIGQUERY, "bigquery": BIGQUERY, "redshift": REDSHIFT, "snowflake": SNOWFLAKE, "databricks": DATABRICKS}


def names(dialect: str) -> set[str]:
    """The functions that have an entry of their own."""
    return set(DIALECT[dialect]) | set(COMMON)


def fill(template: str, a: list[str]) -> str:
    text = re.sub(r"\{(\d)\}", lambda m: a[int(m[1])], template)
    return text.replace("{*}", ", ".join(a))


def call(e, node: t.Call) -> str:
    """The Spark SQL of a call."""
    name = node.name
    if name in e.params and not node.args and name in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "CURRENT_DATETIME", "LOCALTIMESTAMP", "CURRENT_TIMEZONE"):
        return e.time_key(name)
    entry = DIALECT[e.dialect].get(name, COMMON.get(name))
    a = e.exprs(node.args) if not (len(node.args) == 1 and isinstance(node.args[0], t.Nested) and name == "ARRAY") else [""]
    if isinstance(entry, dict):
        entry = entry.get(len(a), entry.get(None))
        if entry is None:
            raise SqlError(f"{name} doesn't take {len(a)} arguments")
    if entry is None:
        return plain(e, node, a)
    if callable(entry):
        return entry(e, node, a)
    try:
        return fill(entry, a)
    except IndexError:
        raise SqlError(f"{name} doesn't take {len(a)} arguments") from None


def plain(e, node: t.Call, a: list[str]) -> str:
    """A function that Spark has under the same name."""
    told = ", ".join(a)
    name = node.name.lower()
    if "." in name:
        name = ".".join(f"`{p}`" if not p.isidentifier() else p for p in name.split("."))
    if node.over is not None and node.distinct:
        return f"{name}(DISTINCT {told})" + clauses(e, node)
    return f"{name}({'DISTINCT ' * node.distinct}{told})" + clauses(e, node)


def extract(e, part: str, value: str) -> str:
    return dates.extract(e, part, value)


def interval(e, value: t.Node, unit: str) -> str:
    return dates.interval(e, value, unit)


def table_function(e, node: t.Produced) -> str:
    """UNNEST, GENERATOR, FLATTEN, SPLIT_TO_TABLE and the like in FROM."""
    from ..plans.emit import quote

    name, args = node.call.name, node.call.args
    alias = node.alias
    if name == "UNNEST":
        array = e.expr(args[0])
        structs = isinstance(args[0], t.ArrayOf) and args[0].items and isinstance(args[0].items[0], t.StructOf) and not node.offset
        table = e.fresh("u")
        if structs:
            return f"(SELECT inline({array})) AS {quote(alias or table)}{e.columns(node.columns)}" if not node.lateral else f"LATERAL inline({array}) AS {quote(alias or table)}"
        column = (node.columns or [alias or "unnest"])[0]
        if node.offset:
            return f"LATERAL posexplode({array}) AS {quote(table)}({quote(node.offset)}, {quote(column)})".removeprefix("" if node.lateral else "LATERAL ")
        return f"explode({array}) AS {quote(alias or table)}({quote(column)})"
    if name == "GENERATOR":
        given = {x.name.upper(): e.expr(x.value) for x in args if isinstance(x, t.Pair)}
        return f"range({given.get('ROWCOUNT', e.expr(args[0]) if args and not isinstance(args[0], t.Pair) else '1')}) AS {quote(alias or e.fresh('g'))}({quote((node.columns or ['seq4'])[0])})"
    if name in {"SPLIT_TO_TABLE", "STRTOK_SPLIT_TO_TABLE"}:
        a = e.exprs(args)
        parts = literal_split(e, node.call, a) if name == "SPLIT_TO_TABLE" else tokens(a[0], a[1] if len(a) > 1 else "' '")
        inner = f"(SELECT 1 AS seq, pos + 1 AS index, col AS value FROM (SELECT posexplode({parts})))"
        if e.dialect == "snowflake" and any(isinstance(x, t.Name) for x in args):
            return f"LATERAL posexplode(concat(array(''), {parts})) AS {quote(alias or e.fresh('s'))}(index, value)"
        return f"{inner} AS {quote(alias or e.fresh('s'))}{e.columns(node.columns)}"
    if name == "FLATTEN":
        given = {x.name.upper(): x.value for x in args if isinstance(x, t.Pair)}
        source = given.get("INPUT", args[0] if args else None)
        if "RECURSIVE" in given and e.expr(given["RECURSIVE"]).upper() == "TRUE":
            raise SqlError("FLATTEN doesn't go into nested values by itself: flatten its value again")
        text = e.expr(source)
        if "PATH" in given:
            text = f"variant_get({text}, {_string('$.' + (text_of(given['PATH']) or ''))}, 'variant')"
        outer = "_outer" if "OUTER" in given and e.expr(given["OUTER"]).upper() == "TRUE" else ""
        return f"LATERAL variant_explode{outer}({text}) AS {quote(alias or e.fresh('f'))}(index, key, value)".removeprefix("" if node.lateral else "LATERAL ")
    if name in {"GENERATE_SERIES"}:
        return f"explode(sequence({', '.join(e.exprs(args))})) AS {quote(alias or e.fresh('s'))}({quote((node.columns or [alias or 'generate_series'])[0])})"
    text = call(e, node.call)
    return f"{text} AS {quote(alias)}{e.columns(node.columns)}" if alias else text
