"""Dumps in byte ranges of any size against a plain reading, and values of all kinds there and back."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import dumps


@pytest.fixture
def ranges(spark):
    """Sets the size of a range in bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def use(size: int):
        for name, value in zip(names, (str(size), "0", "1")):
            spark.conf.set(name, value)

    yield use
    for name in names:
        spark.conf.unset(name)


def quoted(rng: random.Random, value: str) -> str:
    mark = rng.choice("'\"")
    out = value.replace("\\", "\\\\").replace(mark, rng.choice([mark * 2, "\\" + mark]))
    if rng.random() < 0.5:
        out = out.replace("\n", "\\n")
    return mark + out + mark


def random_dump(rng: random.Random, ends: str) -> tuple[str, list[list]]:
    """A file with all that may confuse a reader, and its rows."""
    noise = ["/* it's; (1,2)\n a 'note', INSERT INTO t VALUES (9) */", "-- it's (a; comment\n", "# \"one; more (\n", "SET a = 'x;(''\n';\n", "CREATE TABLE `a;'b` (\n `c(` int);\n", "/*!40101 SET NAMES binary*/;\n", "\n\n"]
    text, rows = [], []
    for _ in range(rng.randrange(1, 6)):
        text.append(rng.choice(noise))
        text.append(rng.choice(["INSERT INTO `t;'(` VALUES\n", "insert  into t (`a`, `b`)\nvalues ", "INSERT INTO t VALUES"]))
        n = rng.randrange(1, 7)
        for i in range(n):
            row, cells = [], []
            for _ in range(rng.randrange(1, 4)):
                kind = rng.randrange(5)
                if kind == 0:
                    row.append(None)
                    cells.append(rng.choice(["NULL", "null"]))
                elif kind == 1:
                    row.append(rng.choice(["-1.5e3", "now(3)", "X'4142'", "_binary 'a;(b'", "0x00", "f('),', (1,2))"]))
                    cells.append(row[-1])
                else:
                    value = "".join(rng.choice(["a", "é", "'", '"', "`", "\\", ";", "(", ")", ",", "\n", ends, "/*", "*/", "-- ", "#", "VALUES", " "]) for _ in range(rng.randrange(9)))
                    row.append(value)
                    cells.append(quoted(rng, value))
            space = rng.choice(["", " ", "\n", " /* ') */ ", "-- x'\n"])
            text.append("(" + (space + ",").join(cells) + space + ")")
            text.append(rng.choice([",", ",\n", ", /* ( */\n", "\n,"]) if i < n - 1 else rng.choice([";", ";\n", " ;\n"]))
            rows.append(row)
    return "".join(text), rows


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_any_size(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    want = []
    for i in range(5):
        text, rows = random_dump(rng, rng.choice(["\n", "\r\n"]))
        (tmp_path / f"a.b.{i:05d}.sql").write_bytes(text.encode())
        want += [(f"a.b.{i:05d}.sql", r) for r in rows]
    for size in (9, 40, 333, 1 << 20):
        ranges(size)
        df = dumps.read_sql_dump(spark, str(tmp_path))
        assert size > 1000 or df.rdd.getNumPartitions() > 5
        assert key((r.file, r["values"]) for r in df.collect()) == key(want), size


def test_effects_compose():
    """What a range does, put after what those before it do, is what a reader of the whole does."""
    rng = random.Random(8)
    for _ in range(60):
        lines = [x + b"\n" for x in random_dump(rng, "\n")[0].encode().split(b"\n")]
        place, quote = dumps.Place(), dumps.PLAIN
        at = 0
        while at < len(lines):
            text = b"".join(lines[at : (at := at + rng.randrange(1, 5))])
            places = [dumps.Place(m) for m in dumps.MODES]
            end, _ = dumps.advance(text, quote, places)
            mode, depth = places[place.mode].mode, places[place.mode].depth + (0 if places[place.mode].moved else place.depth)
            quote, _ = dumps.advance(text, quote, [place])
            assert (end, mode, depth) == (quote, place.mode, place.depth)


@pytest.mark.parametrize("lines", [1, 2, 7])
def test_rows_over_batches(spark, tmp_path, ranges, lines):
    """Rows of several lines come whole, wherever Arrow's batches end."""
    rng = random.Random(lines)
    text, want = random_dump(rng, "\n")
    text += "INSERT INTO t VALUES\n" + ",\n".join(f"({i},'v;\n\n(\n{i}'\n,\n1)" for i in range(50)) + ";\n"
    want += [[str(i), f"v;\n\n(\n{i}", "1"] for i in range(50)]
    (tmp_path / "a.b.sql").write_text(text)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(lines))
    try:
        for size in (100, 1 << 20):
            ranges(size)
            assert key(r["values"] for r in dumps.read_sql_dump(spark, str(tmp_path)).collect()) == key(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_skeletons_move_as_readers_do():
    """The effects from skeletons are those of reading mark by mark, from any start, and rows are found alike."""
    rng = random.Random(5)
    for _ in range(150):
        lines = [x + b"\n" for x in random_dump(rng, rng.choice(["\n", "\r\n"]))[0].encode().split(b"\n")]
        a = rng.randrange(len(lines))
        text = b"".join(lines[a : a + rng.randrange(1, 12)])
        for quote in dumps.QUOTES:
            want, got = ([dumps.Place(m) for m in dumps.MODES] for _ in range(2))
            end, _ = dumps.advance(text, quote, want)
            bones, own = dumps.skeleton(text, quote)
            dumps.moved(bones, got)
            assert own == end and [(p.mode, p.depth, p.moved) for p in got] == [(p.mode, p.depth, p.moved) for p in want], (text, quote)


def test_large_files_begin_with_a_comment(spark, tmp_path, ranges):
    text = "/* a note;\n second line */\nINSERT INTO t VALUES\n" + ",\n".join(f"({i},'v;\n{i}')" for i in range(500)) + ";\n"
    (tmp_path / "a.b.sql").write_text(text)
    for size in (100, 4000):
        ranges(size)
        got = {tuple(r["values"]) for r in dumps.read_sql_dump(spark, str(tmp_path)).collect()}
        assert got == {(str(i), f"v;\n{i}") for i in range(500)}


def test_open_quotes_and_rows_raise(spark, tmp_path, ranges):
    for name, text, match in (("a", "INSERT INTO t VALUES (1,'x');\nINSERT INTO t VALUES\n(2,'open);\n" + "\n" * 50, "not closed"), ("b", "INSERT INTO t VALUES (1,\n2,\n3" + "\n" * 50, "within a row")):
        (tmp_path / f"{name}.sql").write_text(text)
        for size in (20, 1 << 20):
            ranges(size)
            with pytest.raises(Exception, match=match):
                dumps.read_sql_dump(spark, str(tmp_path / f"{name}.sql")).collect()


def test_binary_values(spark, tmp_path):
    data = [b"AB", b"", b"\x00\xff'\\\n", "é".encode(), None]
    rows = spark.createDataFrame(list(enumerate(data)), "id int, b binary")
    names = dumps.write_dump(rows, str(tmp_path / "w"), "app", "t", "CREATE TABLE `t` (`id` int, `b` blob)", "2024-01-01 00:00:00")
    back = dumps.read_sql_dump(spark, [str(tmp_path / "w" / n) for n in names if n.endswith(".sql") and "schema" not in n])
    got = {int(r.id): r.b if r.b is None else bytes(r.b) for r in back.select(F.col("values")[0].alias("id"), dumps.binary_value(F.col("values")[1]).alias("b")).collect()}
    assert got == dict(enumerate(data))
    raw = b"INSERT INTO t VALUES (0,0x4142),(1,X'4142'),(2,_binary 'A\\'\\\\n\\0'),(3,_binary '\xff\\'\xfe'),(4,'\xff\xfe'),(5,'plain'),(6,x''),(7,NULL);\n"
    (tmp_path / "r.sql").write_bytes(raw)
    read = dumps.read_sql_dump(spark, str(tmp_path / "r.sql"))
    got = {int(r.id): r.b if r.b is None else bytes(r.b) for r in read.select(F.col("values")[0].alias("id"), dumps.binary_value(F.col("values")[1]).alias("b")).collect()}
    assert got == {0: b"AB", 1: b"AB", 2: b"A'\\n\0", 3: b"\xff'\xfe", 4: b"\xff\xfe", 5: b"plain", 6: b"", 7: None}
    assert {r["values"][0]: r["values"][1] for r in read.collect()}["1"] == "X'4142'"


def test_tab_values(spark, tmp_path):
    r"""A real U+0001, backslashes before letters, and CR LF."""
    (tmp_path / "t.dat").write_bytes(b"1\ta\x01b\t\\N\r\n2\t\\\\n\\n\\\\\\t\\\\\\\\\tx\\ty\n3\t\t\\\\N\n")
    got = [r["values"] for r in dumps.read_tab_dump(spark, str(tmp_path / "t.dat")).collect()]
    assert got == [["1", "a\x01b", None], ["2", "\\n\n\\\t\\\\", "x\ty"], ["3", "", "\\N"]]
