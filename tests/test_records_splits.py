"""Records of quoted CSV are put together where they are read; only what crosses splits is shuffled."""

import pytest

from churnscope.sources import records as R
from tests.test_records import plain, some_rows, written


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def held(df):
    return sorted(tuple(r) for x in df.collect() if x["record"] for r in plain(x["record"]))


def test_few_lines_are_left_to_shuffles(spark, tmp_path, monkeypatch):
    """Most records span lines, yet only those at the splits' edges reach the joins."""
    rows = [[str(k), f"S{k}", 'two,\n"lines\nhere', "1", "2024-01-05 10:00:00", "2.50", "1", "UK"] for k in range(4000)]
    (tmp_path / "t.csv").write_text(written(rows), newline="")
    seen, joined = [], R._joined

    def kept(lines, block_lines):
        seen.append(lines.count())
        return joined(lines, block_lines)

    monkeypatch.setattr(R, "_joined", kept)
    lines = R.lines_of(spark, str(tmp_path))
    splits = lines.select("split").distinct().count()
    assert held(R.records(lines)) == sorted(map(tuple, plain(written(rows))))
    assert seen and seen[0] <= 10 * splits < 4000


@pytest.mark.parametrize("fill", ["plain", "empty"])
def test_splits_without_a_quote(spark, tmp_path, small_splits, fill):
    """Splits whose lines tell nothing of the state, begun outside and inside a field."""
    dull = [[str(k), "S", "x", "1", "2024-01-05 10:00:00", "2.50", "1", "UK"] for k in range(150)]
    long = "\n".join("text, with a comma" if fill == "plain" else "" for _ in range(150 if fill == "plain" else 2500))
    rows = [*dull, ["a", "S", long, "1", "2024-01-05", "2", "1", 'end"'], *dull, *some_rows(40, 5), ["b", "S", long, "1", "2024-01-05", "2", "1", long], *dull]
    for k, sep in enumerate(("\n", "\n")):
        (tmp_path / f"{k}.csv").write_text(written(rows[k:], sep), newline="")
    lines = R.lines_of(spark, str(tmp_path))
    found = R.pieces(lines)
    assert not R._begin_inside(found.filter(found.kind == R.ACTION)).isEmpty()
    assert held(R.records(lines, 7)) == sorted(tuple(r) for k in (0, 1) for r in plain(written(rows[k:])))
