"""Large CSV files by byte ranges: the rows of the one-split reader, whatever the quotes and wherever a block ends."""

import os
import random

import pytest
from pyspark.sql import functions as F

from murmur.sources.csv import read_complaints_csv
from murmur.sources.csv_splits import ends_inside, first_states

FIELDS = ["plain", "", '"quoted"', '"a ""b"" c"', '"two\nlines"', '"three\n\nlines, and\n""quotes"""', 'stray "quote" inside',
          '5" pipe', '"closed" and more', '"sep , inside"', '""', '"""x"""', " spaces ", 'it\'s "', '"ends with \n"']


@pytest.fixture()
def small_blocks(spark):
    """Blocks of some 300 bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def both(spark, path, **options):
    """Rows in file order by one split and by blocks."""
    out = []
    for over in (1 << 40, 0):
        df = read_complaints_csv(spark, path, with_position=True, split_over=over, **options)
        out.append([tuple(r)[:-2] for r in df.orderBy("_file", "_position").collect()])
    return out


@pytest.mark.parametrize("seed, sep, end, encoding", [(1, ",", "\n", "utf-8"), (2, ";", "\n", "latin-1"), (3, ",", "\r\n", "utf-8"),
                                                      (4, "\t", "\n", "utf-8-sig"), (5, ",", "\n", "utf-8")])
def test_blocks_give_the_rows_of_one_split(spark, tmp_dir, small_blocks, seed, sep, end, encoding):
    rng = random.Random(seed)
    rows = [sep.join([f"S{i}", "é", *(rng.choice(FIELDS) for _ in range(3))]) for i in range(150)]
    rows[40] = f'S40{sep}é{sep}"' + "a long text\n" * 200 + f'"{sep}{sep}'          # many blocks long
    rows[60] = ""                                                                  # an empty line
    text = sep.join(["sr_number", "region", "sr_type", "rca", "city"]) + "\n" + "\n".join(rows) + ("\n" if seed % 2 else "")
    path = os.path.join(tmp_dir, "a.csv")
    with open(path, "wb") as f:
        f.write(text.replace("\n", end).encode(encoding))
    one, split = both(spark, path)
    assert len(one) == 149 and split == one


def test_files_of_a_folder_keep_their_order(spark, tmp_dir, small_blocks):
    for name in ("01.csv", "02.csv"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("sr_number,rca\n" + "".join(f'{name}-{i},"x\ny"\n' for i in range(60)))
    one, split = both(spark, tmp_dir)
    assert split == one and len(split) == 120


def test_malformed_rows_and_empty_files(spark, tmp_dir, small_blocks):
    path = os.path.join(tmp_dir, "m.csv")
    with open(path, "w") as f:
        f.write("sr_number,rca,city\n" + "".join(f"{i},a\n" if i % 7 == 0 else f"{i},a,b,c\n" if i % 7 == 1 else f"{i},a,b\n" for i in range(100)))
    one, split = both(spark, path)
    assert split == one
    one, split = both(spark, path, drop_malformed=True)
    assert split == one and len(one) < 100
    empty = os.path.join(tmp_dir, "e.csv")
    with open(empty, "w") as f:
        f.write("sr_number,rca\n")
    assert both(spark, empty) == [[], []]


def test_an_unclosed_quote_takes_the_rest(spark, tmp_dir, small_blocks):
    path = os.path.join(tmp_dir, "u.csv")
    with open(path, "w") as f:
        f.write('sr_number,rca\n1,x\n2,"open\n' + "3,y\n" * 200)
    one, split = both(spark, path)
    assert [r[0] for r in split] == [r[0] for r in one] == ["1", "2"]


def test_line_states():
    cases = {(b'a,"b', False): True, (b'b",c', True): False, (b'a"b,c', False): False, (b'x","y', True): True,
             (b'""', True): True, (b'"""', True): False, (b"", True): True, (b'"a"x,"', False): True}
    assert {k: ends_inside(*k, b",") for k in cases} == cases


def test_states_compose_in_block_order(spark):
    rng = random.Random(0)
    maps, want = [], {}
    for file in "abc":
        state = False
        for block in range(40):
            m = rng.choice([(False, True), (True, False), (True, False), (False, False), (True, True)])
            maps.append((file, block, *m))
            want[file, block] = state
            state = m[state]
    got = first_states(spark.createDataFrame(maps, "file string, block bigint, from_out boolean, from_in boolean"))
    assert {(r["file"], r["block"]): r["inside"] for r in got.collect()} == want
