"""Column expressions over change events. Everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import EVENT_TYPES

# Seconds from year 0 to 1970, and the lengths of a UUID's segments.
SECONDS_TO_EPOCH = 62167219200
UUID_SEGMENTS = (8, 4, 4, 4, 12)
DDL_KINDS = ("ALTER TABLE", "CREATE TABLE", "DROP TABLE", "RENAME TABLE", "TRUNCATE TABLE")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_name(column: str) -> bool:
    """Only such names may be looked up inside images."""
    return re.fullmatch(r"[A-Za-z0-9_]+", column) is not None


def image(json) -> Column:
    """A row image as a map of variants: keeps types, digits and explicit nulls; the text `null` is no image."""
    return F.from_json(_col(json), "map<string,variant>")


def pk_encode(parts: Column) -> Column:
    """Key values (array<string>) in ordinal order: backslash and bar escaped, joined by a bar; null is `<nil>`."""
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(F.coalesce(p, F.lit("<nil>")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))), "|")


def pk_hash(pk) -> Column:
    return F.sha2(_col(pk), 256)


def changed_columns(before, after) -> Column:
    """Sorted keys of the before image whose value differs in the after image; null unless both are there."""
    differs = lambda _, x, y: x.isNotNull() & ~F.to_json(x).eqNullSafe(F.to_json(y))
    return F.sort_array(F.map_keys(F.map_filter(F.map_zip_with(image(before), image(after), differs), lambda _, d: d)))


def json_value(json, column: str) -> Column:
    """A value of an image as text, as it is written; null if missing or an explicit null."""
    return F.get_json_object(_col(json), f"$.{column}")


def json_is_null(json, column: str) -> Column:
    """True for an explicit null only, not for a missing key."""
    return F.coalesce(F.is_variant_null(F.variant_get(F.try_parse_json(_col(json)), f"$.{column}", "variant")), F.lit(False))


def event_type_name(code) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, _col(code)), F.concat(F.lit("UNKNOWN("), _col(code).cast("string"), F.lit(")")))


def escape_string(s) -> Column:
    return F.replace(F.replace(F.replace(_col(s), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\0"), F.lit("\\0"))


def quote_string(s) -> Column:
    return F.concat(F.lit("'"), escape_string(s), F.lit("'"))


def quote_name(s) -> Column:
    return F.concat(F.lit("`"), F.replace(_col(s), F.lit("`"), F.lit("``")), F.lit("`"))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_number(text: Column) -> Column:
    """A number's text without exponent, digit for digit: the point is moved. A whole number has no fraction."""

    def moved(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, r"^([-+]?)0*([0-9]*)\.?([0-9]*)(?:[eE]([-+]?[0-9]+))?$", i)
        parts = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("digits"), (F.length(part(2)) + F.coalesce(part(4).try_cast("int"), F.lit(0))).alias("point"))
        return let(parts, cut)

    def cut(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        before = F.greatest(point, F.lit(0))
        whole = F.regexp_replace(F.substring(F.rpad(digits, F.greatest(point, F.length(digits)), F.lit("0")), F.lit(1), before), "^0+", "")
        rest = F.regexp_replace(F.concat(F.repeat(F.lit("0"), -point), F.substring(digits, before + 1, F.length(digits))), "0+$", "")
        return let(F.struct(x["sign"].alias("sign"), whole.alias("whole"), rest.alias("rest")), put)

    def put(x: Column) -> Column:
        sign = F.when((x["sign"] == "-") & (F.concat(x["whole"], x["rest"]) != ""), F.lit("-")).otherwise("")
        return F.concat(sign, F.when(x["whole"] == "", F.lit("0")).otherwise(x["whole"]), F.when(x["rest"] == "", F.lit("")).otherwise(F.concat(F.lit("."), x["rest"])))

    number = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
    return let(text, lambda t: F.when(t.isNull() | t.rlike("^-?[1-9][0-9]*$"), t).when(t.rlike(number), moved(t)).otherwise(F.raise_error(F.concat(F.lit("not a finite number: "), t))))


def sql_literal(v: Column) -> Column:
    """A variant as a SQL literal; objects and arrays as quoted JSON. A number that isn't finite raises."""
    kind, own = F.schema_of_variant(v), F.variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit("NULL"))
        .when(kind == "BOOLEAN", F.when(own == "true", F.lit("1")).otherwise(F.lit("0")))
        .when(kind == "BIGINT", own)
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), plain_number(own))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), quote_string(F.to_json(v)))
        .otherwise(quote_string(own))
    )


def typed_literal(c: Column, kind: str) -> Column:
    """A typed column as a SQL literal: binary as X'..', timestamps with microseconds."""
    if kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    elif kind.startswith("timestamp"):
        text = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("'"))
    elif kind == "boolean":
        text = c.cast("int").cast("string")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        text = c.cast("string")
    elif kind in ("float", "double") or kind.startswith("decimal"):
        text = plain_number(c.cast("string"))
    else:
        text = quote_string(c.cast("string"))
    return F.coalesce(text, F.lit("NULL"))


def partition_name(ts) -> Column:
    return F.concat(F.lit("p_"), F.date_format(_col(ts), "yyyyMMddHH"))


def partition_time(name) -> Column:
    """The hour of p_YYYYMMDDHH; null for anything else."""
    return F.when(_col(name).rlike("^p_[0-9]{10}$"), F.try_to_timestamp(F.substring(_col(name), 3, 10), F.lit("yyyyMMddHH")))


def to_seconds(ts) -> Column:
    return F.unix_timestamp(_col(ts)) + F.lit(SECONDS_TO_EPOCH)


def from_to_seconds(n) -> Column:
    return F.timestamp_seconds(_col(n) - F.lit(SECONDS_TO_EPOCH))


def gtid_repair(s) -> Column:
    """A GTID set with short UUID segments filled up with zeros on the left; what isn't a UUID stays."""

    def entry(e: Column) -> Column:
        e = F.trim(e)
        at = F.instr(e, ":")
        parts = F.split(F.substring(e, 1, 1 << 20).substr(F.lit(1), at - 1), "-")
        filled = [F.when(F.length(p) < n, F.lpad(p, n, "0")).otherwise(p) for i, n in enumerate(UUID_SEGMENTS) for p in [F.get(parts, F.lit(i))]]
        return F.when((at > 0) & (F.size(parts) == 5), F.concat(F.concat_ws("-", *filled), e.substr(at, F.length(e)))).otherwise(e)

    return F.array_join(F.transform(F.split(_col(s), ","), entry), ",")


def ddl_kind(query) -> Column:
    """The kind of a DDL statement, null for others."""
    q = F.upper(F.trim(_col(query)))
    out = F.lit(None).cast("string")
    for kind in DDL_KINDS:
        out = F.when(q.startswith("TRUNCATE" if kind.startswith("TRUNCATE") else kind), F.lit(kind)).otherwise(out)
    return out


def ddl_table(query) -> tuple[Column, Column]:
    """(schema, table) that a DDL statement names; an empty schema if it names none. The words before the name go one by
    one: the verb, TABLE, IF EXISTS or IF NOT EXISTS."""
    rest = F.trim(_col(query))
    for word in (r"\w+", "TABLE", r"IF\s+(?:NOT\s+)?EXISTS"):
        rest = F.regexp_replace(rest, rf"(?i)^{word}\s+", "")
    name = r"`[^`]+`|\w+"
    first = F.regexp_extract(rest, rf"^(?:{name})", 0)
    second = F.regexp_extract(rest.substr(F.length(first) + 1, F.length(rest)), rf"^\.({name})", 1)
    plain = lambda c: F.replace(c, F.lit("`"), F.lit(""))
    return F.when(second == "", F.lit("")).otherwise(plain(first)), plain(F.when(second == "", first).otherwise(second))


def dir_time(name) -> Column:
    """The moment in a snapshot folder's name, 2026-02-28T00-00-00Z."""
    return F.try_to_timestamp(F.regexp_replace(_col(name), r"^(\d{4}-\d\d-\d\d)T(\d\d)-(\d\d)-(\d\d)Z?$", "$1 $2:$3:$4"), F.lit("yyyy-MM-dd HH:mm:ss"))


def archive_path(path) -> tuple[Column, Column, Column]:
    """(root, server, hour) of an archive file's path."""
    p, layout = _col(path), r"^(.*)/server_id=([^/]+)/event_date=(\d{4}-\d\d-\d\d)/event_hour=(\d\d?)/"
    hour = F.try_to_timestamp(F.concat(F.regexp_extract(p, layout, 3), F.lit(" "), F.lpad(F.regexp_extract(p, layout, 4), 2, "0")), F.lit("yyyy-MM-dd HH"))
    return F.regexp_extract(p, layout, 1), F.regexp_extract(p, layout, 2), hour


def human_bytes(n) -> Column:
    n = _col(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncate_text(s, n: int) -> Column:
    return F.when(F.length(_col(s)) > n, F.concat(F.substring(_col(s), 1, n - 1), F.lit("…"))).otherwise(_col(s))


def row_size(before="row_before", after="row_after", *texts: str) -> Column:
    """Approximate bytes of an event: 200, a key hash, its texts, and for each key of its images 64, the key and the value:
    a string's bytes, 8 for other plain values, nothing for null; an object or array counts by its JSON text."""

    def value(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        return F.when(kind == "VOID", 0).when(nested, F.octet_length(F.to_json(v))).when(kind == "STRING", F.octet_length(F.variant_get(v, "$", "string"))).otherwise(8)

    def size(j) -> Column:
        entry = F.map_entries(image(j))
        return F.coalesce(F.aggregate(F.transform(entry, lambda e: 64 + F.octet_length(e["key"]) + F.coalesce(value(e["value"]), F.lit(0))), F.lit(0), lambda a, x: a + x), F.lit(0))

    out = F.lit(264) + size(before) + size(after)
    for t in texts:
        out += F.coalesce(F.octet_length(_col(t)), F.lit(0))
    return out.cast("long")


def canonical_key(c: Column, data_type: str, column_type: str = "") -> Column:
    """A key column's value in the text form of the log, by its source type. Unsupported types fail here."""
    t = data_type.lower()
    if t in ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "year"):
        return c.cast("decimal(20,0)").cast("string")
    if t in ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "enum", "decimal", "numeric"):
        return c.cast("string")
    if t == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if t in ("datetime", "timestamp"):
        found = re.search(r"\((\d)\)", column_type)
        if found or column_type.lower() in ("datetime", "timestamp"):
            n = int(found[1]) if found else 0
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss" + ("." + "S" * n if n else ""))
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    raise ValueError(f"no canonical key form for type {data_type}")


def json_string(text: Column) -> Column:
    """Text as a JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def normal_value(c: Column, kind: str = "string") -> Column:
    """A snapshot value of a Spark type as a variant: JSON objects and arrays as such, other text as a string, times in
    whole seconds."""
    if kind.startswith("timestamp"):
        return F.parse_json(json_string(F.date_format(c, "yyyy-MM-dd HH:mm:ss")))
    text = c.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text)), F.parse_json(json_string(text)))
