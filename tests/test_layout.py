"""What files and row groups a filter on either key still reads."""

from __future__ import annotations

import pytest

from spillway.sources import interleaved, rows_scanned, write_interleaved

ROWS = 40_000


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(ROWS).selectExpr(
        "id",
        "(id * 7919) % 10007 AS application",
        "timestampadd(MINUTE, CAST((id * 104729) % 500000 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS at",
        "md5(CAST(id AS STRING)) AS reference",
    ).selectExpr("*", "CAST(at AS DATE) AS day")


KEYS = {"application": "application", "day": "unix_date(day)"}


def test_digits_take_turns(spark):
    frame = spark.createDataFrame([(a, b, c) for a in (0, 5, 7) for b in (0, 2, 6) for c in (1, 4)], "a long, b long, c long")
    for r in frame.selectExpr("*", f"{interleaved(['a', 'b', 'c'], 3)} AS z").collect():
        assert r["z"] == sum((r[k] >> d & 1) << 3 * d + n for d in range(3) for n, k in enumerate("abc"))
    with pytest.raises(ValueError):
        interleaved(["a", "b"], 32)


def test_filters_on_either_key_skip_most_rows(spark, rows, tmp_path):
    place, by_one = str(tmp_path / "both"), str(tmp_path / "one")
    write_interleaved(rows, place, KEYS, ["id"], files=64)
    rows.repartitionByRange(64, "application", "id").sortWithinPartitions("application").write.parquet(by_one)
    filters = {
        "application": "application BETWEEN 4000 AND 4100",
        "time": "day BETWEEN DATE '2024-04-01' AND DATE '2024-04-03' AND at < TIMESTAMP_NTZ '2024-04-03 07:00:00'",
    }
    read = {}
    for path in (place, by_one):
        for key, condition in filters.items():
            found = spark.read.parquet(path).where(condition)
            assert sorted(found.select("id").collect()) == sorted(rows.where(condition).select("id").collect())
            read[path, key] = rows_scanned(found.select("id"))
    # 64 files are 8 by 8 boxes, not aligned to the ranges: a narrow filter meets two or three of 8.
    assert read[place, "application"] < ROWS * 3 / 8 and read[place, "time"] < ROWS * 3 / 8
    assert read[by_one, "time"] > ROWS * 0.9


def test_lookups_by_bloom_filter(spark, rows, tmp_path):
    with_filter, without = str(tmp_path / "bloom"), str(tmp_path / "plain")
    plain_pages = {"parquet.enable.dictionary": "false"}
    write_interleaved(rows, with_filter, KEYS, files=16, lookups={"reference": ROWS // 16}, options=plain_pages)
    write_interleaved(rows, without, KEYS, files=16, options=plain_pages)
    def looked_up(path):
        return rows_scanned(spark.read.parquet(path).where("reference = md5('12345')").select("id"))

    assert 0 < looked_up(with_filter) <= ROWS / 4
    assert looked_up(without) > ROWS / 2


def test_nulls_one_value_and_empty(spark, rows, tmp_path):
    odd = rows.limit(300).selectExpr("id", "CAST(NULL AS BIGINT) AS application", "at", "reference", "IF(id % 3 = 0, NULL, day) AS day")
    odd = odd.unionAll(rows.where("id < 200").selectExpr("id", "-9223372036854775807L", "at", "reference", "day"))
    odd = odd.unionAll(rows.where("id < 200").selectExpr("id", "9223372036854775807L", "at", "reference", "day"))
    write_interleaved(odd, str(tmp_path / "odd"), KEYS)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert back.exceptAll(odd).count() == 0 and back.count() == odd.count()
    write_interleaved(rows.limit(0), str(tmp_path / "none"), KEYS)
    assert spark.read.schema(rows.schema).parquet(str(tmp_path / "none")).count() == 0
