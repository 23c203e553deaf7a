"""Readers in splits against the plain readers, with splits that end anywhere."""

import random

import pytest

from relsift.sources import files, lines


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_keep_their_order(spark, small_splits, tmp_path):
    a = [f"line {i} " + "x" * (i % 50) for i in range(120)] + ["", "", "last\r"]
    b = ["one", "", "three"]
    (tmp_path / "a.txt").write_bytes("\n".join(a).encode() + b"\n")
    (tmp_path / "b.txt").write_bytes("\r\n".join(b).encode())
    got = [tuple(r) for r in lines.read_numbered_lines(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == list(enumerate([x.rstrip("\r") for x in a] + b, 1))
    assert lines.split_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 20


def test_two_files_joined_by_line(spark, small_splits, tmp_path):
    for name, tag in (("left", "l"), ("right", "r")):
        (tmp_path / name).write_text("".join(f"{tag}{i}{'é' * (i % 9)}\n" for i in range(200)))
    left, right = (lines.read_numbered_lines(spark, str(tmp_path / n), out=n, first=0) for n in ("left", "right"))
    rows = left.join(right, "id").collect()
    assert len(rows) == 200 and all(r.left.startswith(f"l{r.id}") and r.right.startswith(f"r{r.id}") for r in rows)


SCHEMA = "id long, a string, b string, x double"


def value(rng):
    return rng.choice(["plain", "", 'say ""hi""', "two\nlines", "\n\n", "comma, here", '""', "long " * 60, "é\r\nü", "many\n" * 30, " spaced "])


def plain(spark, path):
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(SCHEMA).csv(path))


@pytest.mark.parametrize("seed,end", [(1, "\n"), (3, "\r\n"), (4, "\n")])
def test_csv_in_splits_equals_plain_reader(spark, small_splits, tmp_path, seed, end):
    rng = random.Random(seed)
    for name in "ab":
        rows = ["id,a,b,x"] + [f'{i},"{value(rng)}","{value(rng)}",{rng.choice(["1.5", ""])}' for i in range(40)]
        (tmp_path / f"{name}.csv").write_bytes((end.join(rows) + (end if seed % 2 else "")).encode())
    got = lines.read_csv_splits(spark, str(tmp_path), SCHEMA)
    found = got.collect()
    kept = [str(r).replace("\\r\\n", "\\n") if end == "\r\n" else str(r) for r in found]  # the plain reader changes them there
    assert sorted(kept) == sorted(map(str, plain(spark, str(tmp_path)).collect())) and len(found) == 80


def test_csv_headers_alone_and_no_rows(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("id,a,b,x\n")
    (tmp_path / "b.csv").write_text('"id","a\nname","b","x"\n' + "7,u,v,2.0")
    assert [tuple(r) for r in lines.read_csv_splits(spark, str(tmp_path), SCHEMA).collect()] == [(7, "u", "v", 2.0)]


def test_round_trip_of_the_relevance_table(spark, sf_small, tmp_path):
    from relsift.sources.fixture import relevance_table
    rel = relevance_table(spark, sf_small)
    path = files.write_csv(rel, str(tmp_path / "rel"))
    got = lines.read_csv_splits(spark, path, files.REL_SCHEMA)
    assert sorted(map(str, got.collect())) == sorted(map(str, files.read_relevance_csv(spark, path).collect()))
