"""The catalogue's look-ups read the tiles they need and no others."""

from __future__ import annotations

import json

import pytest

from marginalia.operators import trees as tr
from marginalia.sources import catalogue as ct

SHAPE = "id long, col_id string, rank string, extant boolean, parent long, valid long, epithet string, authority string, children array<long>, synonyms array<long>"


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('cat')}/c"
    rows = [(1, None, "kingdom", True, None, None, "Animalia", None, list(range(100, 110)), [])]
    rows += [(100 + k, None, "genus", True, 1, None, f"Gen{chr(97 + k)}us", "Doe, 1900", [1000 + 100 * k + i for i in range(90)], []) for k in range(10)]
    rows += [(1000 + 100 * k + i, None, "species", i % 2 == 0, 100 + k, None, f"ep{chr(97 + i % 26)}{i // 26}us", None, [], [5000 + i] if k == 0 else []) for k in range(10) for i in range(90)]
    rows += [(5000 + i, None, "species", True, None, 1000 + i, f"Old{i} name", None, [], []) for i in range(90)]
    df = spark.createDataFrame(rows, SHAPE)
    ct.write(df, tr.postings(df), path, 6)
    return ct.Catalogue(spark, path, resident=2)


def files(df):
    return {f.rpartition("/")[2] for f in df.inputFiles()}


def test_look_ups_read_the_tiles_named(spark, cat):
    assert len(cat.data.files) == 6 and len(cat.index.files) == 6
    asked = spark.createDataFrame([(1050,), (1051,), (77,), (999_999,), (-5,)], "id long")
    found = cat.records(asked)
    want = {f for f, lo, hi in zip(cat.data.files, cat.data.lo, cat.data.hi, strict=True) if any(lo <= k <= hi for k in (1050, 1051, 77))}
    assert files(found) == want and 1 <= len(want) <= 2
    assert {r.id for r in found.collect()} == {1050, 1051}
    assert cat.records(spark.createDataFrame([(999_999,)], "id long")).count() == 0
    got = cat.postings(spark.createDataFrame([("epb1us",), ("nothing",)], "term string"))
    assert 1 <= len(files(got)) <= 2 and {r.id % 100 for r in got.collect()} == {27} and got.filter("kind = 'E'").count() == 10
    many = cat.postings_from("epa")
    assert len(files(many)) < 6 and {r.term for r in many.collect()} == {f"epa{k}us" for k in range(4)}


def test_every_key_is_found(spark, cat):
    every = {r.id for r in cat.all_records().collect()}
    assert len(every) == 1 + 10 + 900 + 90
    assert {r.id for r in cat.records(spark.createDataFrame([(k,) for k in every], "id long")).collect()} == every
    assert set(cat.data.files) == {f for k in every for f in cat.data.files if cat.data.lo[cat.data.files.index(f)] <= k <= cat.data.hi[cat.data.files.index(f)]}


def test_few_tiles_stay_in_memory(cat):
    for number in (1, 5003, 1000, 1500, 1889, 1, 5050):
        assert cat.get(number)["id"] == number and len(cat._held) <= 2
    assert cat.get(4000) is None and cat.get(-1) is None


def test_overlapping_tiles_are_an_error(spark, cat, tmp_path):
    spark.createDataFrame([("a", 1, 10), ("b", 10, 20)], "file string, lo long, hi long").write.parquet(f"{tmp_path}/data.tiles")
    with pytest.raises(ValueError, match="a ends at 10, b starts at 10"):
        ct.Tiles(spark, str(tmp_path), "data", "bigint")


def test_json_of_records(spark, cat):
    ids = spark.createDataFrame([(1003,), (5003,), (104,), (1,)], "id long")
    told = {r.id: json.loads(r.json) for r in ct.to_json(cat, ids).collect()}
    assert told[1003] == {"id": 1003, "name": "Genaus epd0us", "isSynonym": False, "parentId": 100, "genus": "Genaus", "kingdom": "Animalia", "synonymIDs": [5003], "rank": "species"}
    assert told[5003] == {"id": 5003, "name": "Old3 name", "isSynonym": True, "validId": 1003, "genus": "Genaus", "kingdom": "Animalia", "rank": "species"}
    assert told[104]["authority"] == "Doe, 1900" and len(told[104]["childIDs"]) == 90 and told[1] == {"id": 1, "name": "Animalia", "isSynonym": False, "childIDs": list(range(100, 110)), "rank": "kingdom"}
    full = {r.id: json.loads(r.json) for r in ct.to_json(cat, ids, higher=False, expand=True).collect()}
    assert full[5003]["valid"] == {"id": 1003, "name": "Genaus epd0us", "isSynonym": False, "rank": "species"} and "genus" not in full[5003]
    assert full[1003]["synonyms"] == [{"id": 5003, "name": "Old3 name", "isSynonym": True, "rank": "species"}] and full[1003]["parent"]["authority"] == "Doe, 1900"
    assert [c["id"] for c in full[104]["children"]] == list(range(1400, 1490))


def test_find_and_search(cat):
    ids = lambda df: {json.loads(r.json)["id"] for r in df.collect()}
    assert ids(ct.find_json(cat, "Gen", prefix=True)) == set(range(100, 110))
    assert ids(ct.find_json(cat, "gen", prefix=True)) == set() and ids(ct.find_json(cat, "gen", prefix=True, match_case=False)) == set(range(100, 110))
    assert ids(ct.find_json(cat, "Genbus epa1us")) == {1126} and ids(ct.find_json(cat, "epa1us", to_rank="genus")) == set()
    assert ids(ct.search_json(cat, "epa1us")) == {1026 + 100 * k for k in range(10)} and ids(ct.search_json(cat, "name")) == set()
