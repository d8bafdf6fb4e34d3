"""Dumps of tables as text: statements, tab-separated rows, schemas, coordinates; and a dump of a state."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import typed_literal
from tidemark.session import share_package

# Escapes inside quotes.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0", b"b": b"\b", b"Z": b"\x1a"}

#: Tasks for each core that the ranges are dealt to, at most.
TASKS_A_CORE = 8
#: What a line can begin in: nothing special, a quoted text, a quoted name, a comment over several lines.
PLAIN, SINGLE, DOUBLE, NAME, COMMENT = QUOTES = range(5)
#: Where in a statement: before it, in one that holds no rows, in an INSERT before its VALUES, among its rows.
BEFORE, OTHER, HEAD, ROWS = MODES = range(4)
_CLOSING = {SINGLE: re.compile(rb"(?:[^'\\]++|\\.|'')*+'", re.S), DOUBLE: re.compile(rb"(?:[^\"\\]++|\\.|\"\")*+\"", re.S), NAME: re.compile(rb"(?:[^`]++|``)*+`"), COMMENT: re.compile(rb".*?\*/", re.S)}
_OPENING = {b"'": SINGLE, b'"': DOUBLE, b"`": NAME, b"/*": COMMENT}
_MARK = rb"'|\"|`|/\*|(?:--[ \t\r]|--(?=\n)|#)[^\n]*|[();]"
_MARKS = re.compile(_MARK)
_WORDS = re.compile(_MARK + rb"|[A-Za-z_][A-Za-z_0-9]*|[^\s]")

_SINGLE, _DOUBLE, _BACK = (rb"'(?:[^'\\]++|\\.|'')*+'", rb"\"(?:[^\"\\]++|\\.|\"\")*+\"", rb"`(?:[^`]++|``)*+`")
_IN_ROW = rb"[^'\"`()/#;-]++|" + b"|".join((_SINGLE, _DOUBLE, _BACK)) + rb"|/\*.*?\*/|(?:--[ \t\r]|--(?=\n)|#)[^\n]*|-|/(?!\*)"
#: A row whose parentheses are nested once at most and that is whole; others are read mark by mark.
_ROW = re.compile(rb"\((?:" + _IN_ROW + rb"|\((?:" + _IN_ROW + rb")*+\))*+\)", re.S)
#: What hides marks, and the marks that stay of it: of a quote its ends, of a comment only the begin of one that isn't closed.
_HIDDEN = re.compile(rb"(')(?:[^'\\]++|\\.|'')*+('?)|(\")(?:[^\"\\]++|\\.|\"\")*+(\"?)|(`)(?:[^`]++|``)*+(`?)|/\*.*?\*/|(/\*).*\Z|(?:--[ \t\r]|--(?=\n)|#)[^\n]*", re.S)
_BONES = re.compile(rb"[();]|[A-Za-z_][A-Za-z_0-9]*|[^\s();A-Za-z_]+")


class Place:
    """Where a reader is in a statement. depth counts parentheses; moved says that a statement began or the rows of one, so
    that the depth no longer depends on where the reader started."""

    __slots__ = ("depth", "mode", "moved")

    def __init__(self, mode: int = BEFORE, depth: int = 0, moved: bool = False):
        self.mode, self.depth, self.moved = mode, depth, moved


def advance(text: bytes, quote: int, places: list[Place], spans: list[tuple[int, int]] | None = None, start: int = 0) -> tuple[int, int | None]:
    """Reads whole lines from a quote state on; moves each place and gives (quote state, where an open row starts or None).
    With one place, spans gets the rows of INSERT statements; a row that was open before starts at `start`, which is below
    zero where an earlier part of the text holds its start."""
    at, row = 0, start if spans is not None and places[0].mode == ROWS and places[0].depth > 0 else None
    while True:
        if quote != PLAIN:
            m = _CLOSING[quote].match(text, at)
            if m is None:
                return quote, row
            at, quote = m.end(), PLAIN
        plain = places[0].mode in (OTHER, ROWS) if spans is not None else all(p.mode in (OTHER, ROWS) for p in places)
        m = (_MARKS if plain else _WORDS).search(text, at)
        if m is None:
            return quote, row
        mark, at = m[0], m.end()
        if mark in _OPENING:
            quote = _OPENING[mark]
            if quote != COMMENT:
                for p in places:
                    p.mode = OTHER if p.mode == BEFORE else p.mode
        elif mark.startswith((b"--", b"#")):
            continue
        elif mark == b";":
            for p in places:
                p.mode, p.depth, p.moved = BEFORE, 0, True
            row = None
        elif mark == b"(":
            if spans is not None and places[0].mode == ROWS and places[0].depth == 0 and (whole := _ROW.match(text, m.start())):
                spans.append(whole.span())
                at = whole.end()
                continue
            for p in places:
                p.mode = OTHER if p.mode == BEFORE else p.mode
                p.depth += 1
            if spans is not None and places[0].mode == ROWS and places[0].depth == 1:
                row = m.start()
        elif mark == b")":
            for p in places:
                p.depth -= 1
            if spans is not None and places[0].mode == ROWS and places[0].depth == 0 and row is not None:
                spans.append((row, at))
                row = None
        else:
            word = mark.upper()
            for p in places:
                if p.mode == BEFORE:
                    p.mode = HEAD if word == b"INSERT" else OTHER
                elif p.mode == HEAD and word == b"VALUES":
                    p.mode, p.depth, p.moved = ROWS, 0, True


def skeleton(text: bytes, quote: int) -> tuple[bytes, int]:
    """Whole lines from a quote state on without what quotes and comments hold, and the quote state after them."""
    at = 0
    if quote != PLAIN:
        m = _CLOSING[quote].match(text)
        if m is None:
            return b"", quote
        at = m.end()
    bones = _HIDDEN.sub(rb" \1\2\3\4\5\6\7", text[at:])
    if not bones or bones.endswith(b"\n"):
        return bones, PLAIN
    return (bones[:-2], COMMENT) if bones.endswith(b"/*") else (bones, _OPENING[bones[-1:]])


def moved(bones: bytes, places: list[Place]) -> None:
    """Moves places as advance() does. What stands before the last end of a statement no longer matters after it, and where
    words no longer matter parentheses are only counted."""
    last = bones.rfind(b";")
    if last >= 0:
        one = Place(BEFORE, 0, True)
        moved(bones[last + 1 :], [one])
        for p in places:
            p.mode, p.depth, p.moved = one.mode, one.depth, True
        return
    for p in places:
        at = 0
        while p.mode not in (OTHER, ROWS) and (m := _BONES.search(bones, at)):
            mark, at = m[0], m.end()
            if p.mode == BEFORE and mark != b")":
                p.mode = HEAD if mark.upper() == b"INSERT" else OTHER
            elif p.mode == HEAD and mark.upper() == b"VALUES":
                p.mode, p.depth, p.moved = ROWS, 0, True
            p.depth += (mark == b"(") - (mark == b")")
        p.depth += bones.count(b"(", at) - bones.count(b")", at)


def unquoted(text: bytes, mark: bytes) -> bytes:
    """What stands between two marks; of a mark only its own kind is doubled."""
    if b"\\" not in text and mark not in text:
        return text
    return re.sub(rb"\\(.)|" + mark * 2, lambda e: _ESCAPES.get(e[1], e[1]) if e[1] is not None else mark, text, flags=re.S)


_CELL = re.compile(rb"'((?:[^'\\]++|\\.|'')*+)'|\"((?:[^\"\\]++|\\.|\"\")*+)\"|`(?:[^`]++|``)*+`|(?:/\*.*?\*/|(?:--(?=[ \t\r\n])|#)[^\n]*)|[(),]|[^'\"`/(),#-]++|[/-]", re.S)
_TEXT = rb"[^'\"`(),/#-]"
#: A value without comments: a quoted text, a word, number or call of one plain argument, or a text with an introducer.
_VALUE = re.compile(rb"\s*+(?:'((?:[^'\\]++|\\.|'')*+)'|(-?" + _TEXT + rb"++(?:\(" + _TEXT + rb"*+\)" + _TEXT + rb"*+)?|[A-Za-z0-9_]++\s*+" + _SINGLE + rb"))\s*+([,)])", re.S)
_INTRODUCED = re.compile(rb"_[A-Za-z0-9]+\s*'(.*)'", re.S)


def cells(row: bytes) -> list[str | None]:
    """The values of (a, b, ...): a quoted text without its quotes, NULL as None, and any other expression as it is written,
    such as 0x4142, X'4142', _binary 'ab' or a call; binary_value() reads those. A text that isn't UTF-8 becomes 0x...."""
    out: list[str | None] = []
    at = 1
    while m := _VALUE.match(row, at):  # rows of plain values, as nearly all are; others are read mark by mark
        at, raw = m.end(), m[2]
        value = unquoted(m[1], b"'") if raw is None else raw.strip()
        try:
            out.append(None if raw is not None and value.upper() == b"NULL" else value.decode())
        except UnicodeDecodeError:
            break
        if m[3] == b")":
            return out
    out = []
    depth, parts, written = 0, [], []

    def end() -> None:
        raw = b"".join(written).strip()
        if parts and all(p is not None or not w.strip() for p, w in zip(parts, written, strict=True)):
            value = b"".join(p for p in parts if p is not None)
        else:
            value = raw
            if raw.upper() == b"NULL":
                out.append(None)
                return
        try:
            out.append(value.decode())
        except UnicodeDecodeError:
            inner = _INTRODUCED.fullmatch(value)
            out.append("0x" + (unquoted(inner[1], b"'") if inner else value).hex().upper())

    for m in _CELL.finditer(row):
        mark = m[0]
        if mark == b"(" and not depth:
            depth = 1
        elif depth == 1 and mark in (b",", b")"):
            end()
            parts, written = [], []
            if mark == b")":
                break
        elif not mark.startswith((b"/*", b"--", b"#")):
            depth += (mark == b"(") - (mark == b")")
            parts.append(unquoted(m[1], b"'") if m[1] is not None else unquoted(m[2], b'"') if m[2] is not None else None)
            written.append(mark)
    return out


def binary_value(value: Column | str) -> Column:
    """The bytes of a binary column's value as a dump writes it: 0x4142, X'4142', x'4142', _binary 'ab' (an introducer of
    any name), or the text itself."""
    value = F.col(value) if isinstance(value, str) else value
    hexed = F.coalesce(F.nullif(F.regexp_extract(value, r"^0[xX]([0-9A-Fa-f]*)$", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"^[xX]'([0-9A-Fa-f]*)'$", 1), F.lit("")))
    none = value.rlike(r"^(0[xX]|[xX]'')$")
    quoted = r"(?s)^_[A-Za-z0-9]+\s*'(.*)'$"
    inner = F.regexp_extract(value, quoted, 1)
    escapes = (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0"), ("\\b", "\b"), ("\\Z", "\x1a"), ("\\'", "'"), ('\\"', '"'), ("''", "'"))

    def plain(c: Column) -> Column:
        for written, meant in escapes:
            c = F.replace(c, F.lit(written), F.lit(meant))
        return c

    text = F.array_join(F.transform(F.split(inner, r"\\\\"), plain), "\\")
    return F.when(none, F.lit(b"")).when(hexed.isNotNull(), F.unhex(hexed)).when(value.rlike(quoted), text.cast("binary")).otherwise(value.cast("binary"))


def _effects(batches) -> Iterator:
    """What each range does to a reader, whatever it starts in: (file, start, effects), where effects has for each quote and
    mode (quote, mode, depth, moved)."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("quote", pa.int32()), ("mode", pa.int32()), ("depth", pa.int64()), ("moved", pa.bool_())]))
    held, states = None, {}

    def finish():
        rows = [{"quote": states[q][0], "mode": p.mode, "depth": p.depth, "moved": p.moved} for q in QUOTES for p in states[q][1]]
        return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([rows], kind)], names=["file", "start", "effects"])

    for key, text in _texts(batches):
        if key != held:
            if held is not None:
                yield finish()
            held, states = key, {q: (q, [Place(m) for m in MODES]) for q in QUOTES}
        bones = {now: skeleton(text, now) for now in {now for now, _ in states.values()}}
        for now, places in states.values():
            moved(bones[now][0], places)
        states = {q: (bones[now][1], places) for q, (now, places) in states.items()}
    if held is not None:
        yield finish()


def _texts(batches) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, start), lines) of batches (file, start, value, ...), a part of a batch for each range."""
    for batch in batches:
        files, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        first = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], starts[i]) != (files[first], starts[first]):
                yield (files[first], starts[first]), b"".join(x + b"\n" for x in lines[first:i])
                first = i


def _composed(ranges):
    """(file, start, quote, mode, depth, open) of one file's ranges: what a range starts in, from the effects of
    all before it, and whether it ends within a row."""
    import pandas as pd

    quote, mode, depth, out = PLAIN, BEFORE, 0, []
    for r in ranges.sort_values("start").itertuples():
        e = r.effects[quote * len(MODES) + mode]
        before = (quote, mode, depth)
        quote, mode, depth = int(e["quote"]), int(e["mode"]), int(e["depth"]) + (0 if e["moved"] else depth)
        out.append((r.file, int(r.start), *before, mode == ROWS and depth > 0))
    return pd.DataFrame(out, columns=["file", "start", "quote", "mode", "depth", "open"])


def _parsed(batches) -> Iterator:
    """(file, start, part, text, values) of (file, start, value, length, size, quote, mode, depth, open, cut): rows, or with
    `cut` instead the parts of rows that the range's ends cut, 0 the first of a row, 1 a middle one, 2 the last."""
    import pyarrow as pa

    names = ["file", "start", "part", "text", "values"]
    rows: list[tuple] = []

    def full():
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()))
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=names)
        rows.clear()
        return out

    state: dict = {}

    def begin(key, info):
        length, size, quote, mode, depth, cut = info
        if quote is None and (key[1] > 0 or length < size):
            raise ValueError(f"the ranges of {key[0]} changed between two readings of it")
        state.update(key=key, last=key[1] + length >= size, quote=quote or PLAIN, place=Place(mode or BEFORE, depth or 0), held=b"", outside=bool(depth and mode == ROWS), cut=cut)

    def finish():
        """A row that is still open when its range ends."""
        if not state:
            return
        if state["last"] and state["quote"] != PLAIN:
            raise ValueError(f"a quote is not closed in {state['key'][0]}")
        if state["place"].mode == ROWS and state["place"].depth > 0:
            if state["last"]:
                raise ValueError(f"{state['key'][0]} ends within a row: {state['held'][-80:]!r}")
            if state["cut"]:
                rows.append((*state["key"], 1 if state["outside"] else 0, state["held"], None))

    for batch in batches:
        info = list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7, 8)), strict=True))
        at = 0
        for key, text in _texts([batch]):
            if state.get("key") != key:
                finish()
                begin(key, info[at])
            at += text.count(b"\n")
            spans: list[tuple[int, int]] = []
            before = len(state["held"])
            quote, row = advance(text, state["quote"], [state["place"]], spans, -before)
            state["quote"] = quote
            joined = state["held"] + text
            for a, b in spans:
                own = joined[a + before : b + before]
                if state["outside"]:
                    if state["cut"]:
                        rows.append((*key, 2, own, None))
                    state["outside"] = False
                elif not state["cut"]:
                    rows.append((*key, None, None, cells(own)))
            open_row = state["place"].mode == ROWS and state["place"].depth > 0
            state["held"] = joined[row + before :] if open_row else b""
            if len(rows) > 10_000:
                yield full()
    finish()
    yield full()


def _stitched(parts):
    """Rows of one file that ends of ranges have cut."""
    import pandas as pd

    out, held = [], b""
    for r in parts.sort_values(["start", "part"], key=lambda c: c.map({2: 0, 1: 1, 0: 2}) if c.name == "part" else c).itertuples():
        held = r.text if r.part == 0 else held + r.text
        if r.part == 2:
            out.append((r.file, cells(held)))
            held = b""
    if held:
        raise ValueError(f"{parts.file.iloc[0]} ends within a row: {held[-80:]!r}")
    return pd.DataFrame(out, columns=["file", "values"])


def read_sql_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, values array<string>) of INSERT statements, whatever their lines, comments and quotes look like; the values are
    those of cells(). A quote or row that a file doesn't close raises.

    Files of any size are read in the byte ranges that Spark deals to tasks, each of whole lines. For a file of several
    ranges, a first job finds what each range does to a reader that starts in any quote, comment or statement; put together
    in the order of the ranges, these effects tell what each range really starts in, a row of 50 bytes for each of them. With that
    a range reads its rows by itself, and only rows over the end of a range are joined apart."""
    share_package(spark)
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"), ("file_block_length", "length"), ("file_size", "size"))]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), *meta)
    # A task reads one range after the other; more tasks than this would only cost their start.
    lines = lines.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)

    def several(batches):
        import pyarrow.compute as pc

        for batch in batches:
            yield batch.filter(pc.or_(pc.greater(batch.column(1), 0), pc.less(batch.column(3), batch.column(4))))

    effects = "file string, start long, effects array<struct<quote:int,mode:int,depth:long,moved:boolean>>"
    cut_up = lambda batches: _effects(several(batches))
    ranges = lines.select("file", "start", "value", "length", "size").mapInArrow(cut_up, effects).groupBy("file").applyInPandas(_composed, "file string, start long, quote int, mode int, depth long, open boolean")

    def read(cut: bool) -> DataFrame:
        known = F.broadcast(ranges.filter(F.col("open") | ((F.col("mode") == ROWS) & (F.col("depth") > 0))) if cut else ranges)
        own = lines.join(known, ["file", "start"], "inner" if cut else "left")
        own = own.select("file", "start", "value", "length", "size", "quote", "mode", "depth", F.lit(cut).alias("cut"))
        return own.mapInArrow(_parsed, "file string, start long, part int, text binary, values array<string>")

    over_ends = read(True).groupBy("file").applyInPandas(_stitched, "file string, values array<string>")
    return read(False).select("file", "values").unionByName(over_ends).select(F.element_at(F.split("file", "/"), -1).alias("file"), "values")


def read_tab_dump(spark: SparkSession, path: str) -> DataFrame:
    r"""(file, values array<string>) of tab-separated rows: \N is null; \t, \n, \r and \\ are escapes. A line may end in CR LF."""

    def plain(c: Column) -> Column:
        for escaped, meant in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            c = F.replace(c, F.lit(escaped), F.lit(meant))
        return c

    def cell(c: Column) -> Column:  # between escaped backslashes, no backslash begins in one piece and ends in the next
        return F.when(c != "\\N", F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\"))

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.transform(F.split(F.regexp_replace("value", "\r$", ""), "\t"), cell).alias("values"))


def discover_dump(spark: SparkSession, path: str) -> DataFrame:
    """(schema_name, table_name, schema_file, data_files) from a dump's file names; views have no data and stay out."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    name = r"^([^.]+)\.([^.]+?)(?:\.\d+)?(-schema)?\.(?:sql|dat)$"
    part = lambda i: F.regexp_extract("file", name, i)
    own = files.filter(~F.col("file").rlike(r"-schema-(view|create|triggers|post)")).select(part(1).alias("schema_name"), F.regexp_replace(part(2), "-schema$", "").alias("table_name"), F.col("file").contains("-schema.").alias("is_schema"), "file").filter("table_name <> ''")
    return own.groupBy("schema_name", "table_name").agg(F.max(F.when(F.col("is_schema"), F.col("file"))).alias("schema_file"), F.sort_array(F.collect_list(F.when(~F.col("is_schema"), F.col("file")))).alias("data_files")).filter("schema_file IS NOT NULL")


def dump_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(started, binlog_file, binlog_pos, gtid_set) of a dump's metadata, old and new syntax."""
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    pick = lambda p: F.max(F.nullif(F.regexp_extract(value, p, 1), F.lit("")))
    return spark.read.text(path).agg(
        F.try_to_timestamp(pick(r"(?i)^#?\s*Started dump at:?\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)")).alias("started"),
        pick(r"(?i)^(?:Log|File|source_log_file)\s*[:=]\s*\"?([^\s\"]+?)\"?$").alias("binlog_file"),
        pick(r"(?i)^(?:Pos|Position|source_log_pos)\s*[:=]\s*(\d+)").cast("long").alias("binlog_pos"),
        pick(r"(?i)^(?:GTID|Executed_Gtid_Set|executed_gtid_set)\s*[:=]\s*\"?([^\"]+?)\"?$").alias("gtid_set"),
    )


def table_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, column_name, data_type, column_type) from CREATE TABLE text, one column a line."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    column = r"^\s*`([^`]+)`\s+(([A-Za-z]+)(?:\([^)]*\))?(?:\s+unsigned)?)"
    found = lines.select("file", "n", F.regexp_extract("line", column, 1).alias("column_name"), F.lower(F.regexp_extract("line", column, 3)).alias("data_type"), F.lower(F.regexp_extract("line", column, 2)).alias("column_type"))
    return found.filter("column_name <> ''").withColumnRenamed("n", "position")


def write_dump(rows: DataFrame, path: str, schema: str, table: str, create: str, started: str, binlog_file: str = "", binlog_pos: int = 0, gtid_set: str = "", rows_per_statement: int = 1000, rows_per_file: int = 100_000) -> list[str]:
    """A state as a dump that loaders and discover_dump() read: schema.table-schema.sql, schema.table.00000.sql and on with
    INSERT statements of several rows, and metadata with the coordinates. Statements are put together within the partitions
    of rows, without a shuffle; the driver only names the files, which it returns."""
    spark = rows.sparkSession
    share_package(spark)
    kinds = dict(rows.dtypes)
    row = F.concat(F.lit("("), F.concat_ws(",", *[typed_literal(F.col(c), kinds[c]) for c in rows.columns]), F.lit(")"))
    quote = lambda name: "`" + name.replace("`", "``") + "`"
    head = f"INSERT INTO {quote(table)} ({', '.join(map(quote, rows.columns))}) VALUES\n"

    def join(batches):
        import pyarrow as pa

        def table(rows):
            texts = [head + ",\n".join(rows[i : i + rows_per_statement]) + ";" for i in range(0, len(rows), rows_per_statement)]
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            full = len(held) // rows_per_statement * rows_per_statement
            yield table(held[:full])
            held = held[full:]
        yield table(held)

    about = [f"# Started dump at: {started}", f"File: {binlog_file}", f"Pos: {binlog_pos}", *([f"GTID: {gtid_set}"] if gtid_set else [])]
    single = lambda lines: spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
    statements_of = rows.select(row.alias("row")).mapInArrow(join, "value string")
    parts = {f"{schema}.{table}.{{:05d}}.sql": statements_of, f"{schema}.{table}-schema.sql": single([create.rstrip(";") + ";"]), "metadata": single(about)}
    return [name for form, df in parts.items() for name in _named(df, path, form, max(1, rows_per_file // rows_per_statement))]


def _named(df: DataFrame, path: str, form: str, rows_per_file: int) -> list[str]:
    """Writes text and gives its files names of this form, in place of any of before."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(path))
    work = f"{path}/_{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).text(work)
    for old in fs.globStatus(hadoop.Path(f"{path}/{form.replace('{:05d}', '[0-9]*')}")) or []:
        fs.delete(old.getPath(), False)
    files = sorted(f.getPath().getName() for f in fs.listStatus(hadoop.Path(work)) if f.getPath().getName().startswith("part-") and f.getLen())
    names = [form.format(i) for i in range(len(files))]
    for file, name in zip(files, names, strict=True):
        if not fs.rename(hadoop.Path(f"{work}/{file}"), hadoop.Path(f"{path}/{name}")):
            raise OSError(f"can't rename {file} to {name} in {path}")
    fs.delete(hadoop.Path(work), True)
    return names
