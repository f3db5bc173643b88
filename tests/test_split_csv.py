import csv
import io
import random

import pytest

from chartloom.sources import split_csv, tables


def cell(rng):
    kind = rng.randrange(6)
    text = "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', 'x']) for _ in range(rng.choice((0, 3, 12, 300 if rng.random() < 0.03 else 5))))
    return text if kind else 'plain"quote'


def rendered(rng, rows):
    out = ["a,b,c\n"]
    for row in rows:
        cells = [c if c == 'plain"quote' else '"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') or rng.random() < 0.3 else c for c in row]
        out.append(",".join(cells) + rng.choice(("\n", "\r\n", "\n\n")))
    return "".join(out)


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def test_blocks_agree_with_a_plain_reader(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    rows = [(f"r{i}", cell(rng), cell(rng)) for i in range(300)]
    text = rendered(rng, rows)
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    assert split_csv._lines(spark, str(path), "UTF-8").rdd.getNumPartitions() > 20
    plain = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    got = sorted(split_csv.read_split_csv(spark, str(path), True, source_row="n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(2, 302))
    assert [[r.a, r.b or "", r.c or ""] for r in got] == plain == [list(r) for r in rows]


def test_states_are_carried_over_blocks(spark):
    # entering outside, entering inside: keep, turn, forget
    kinds = {"keep": (False, True), "turn": (True, False), "shut": (False, False), "open": (True, True)}
    rng = random.Random(4)
    names = [rng.choice(list(kinds)) for _ in range(60)]
    rows = [("f", i * 10, 10, *kinds[n], 2, 3) for i, n in enumerate(names)]
    summaries = spark.createDataFrame(rows, "file string, start long, length long, out_leaves boolean, in_leaves boolean, out_rows long, in_rows long")
    state, first, wanted = False, 0, []
    for n in names:
        wanted.append((state, first))
        first += 3 if state else 2
        state = kinds[n][state]
    assert [(r.inside, r.first_row) for r in split_csv.block_states(summaries).orderBy("start").collect()] == wanted


def test_width_encoding_and_empty_files(spark, tmp_path):
    def write(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    latin = write("l.csv", 'a,b\n"é\n€",1\n'.encode("cp1252"))
    assert split_csv.read_split_csv(spark, latin).collect() == tables.read_csv(spark, latin).collect()
    assert split_csv.read_split_csv(spark, latin).first().a == "é\n€"
    narrow = write("n.csv", b'a,b\n1\n')
    assert split_csv.read_split_csv(spark, narrow).first().asDict() == {"a": "1", "b": None}
    with pytest.raises(Exception, match="(?i)malformed"):
        split_csv.read_split_csv(spark, narrow, strict_width=True).collect()
    assert split_csv.read_split_csv(spark, write("e.csv", b"a,b\n")).count() == 0
    assert split_csv.read_split_csv(spark, write("o.csv", b'a,b\n1,"open\nto the end')).first().b == "open\nto the end"
