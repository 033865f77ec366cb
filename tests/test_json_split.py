import json
import random

import pytest

from curatio.sources import io
from curatio.sources.json_split import scan, split_records

SCHEMA = "id long, s string, items array<struct<a: string, b: array<long>>>"


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Ranges of a few hundred bytes, so that records, strings and escapes cross them."""
    monkeypatch.setattr(io, "ONE_TASK_BYTES", 0)
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def records(n, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['}', '{', '[', ']', '"', '\\', ',', ' ', '\n', 'é', '😀', 'a', ':']) for _ in range(r.randint(0, 30)))
    return [{"id": i, "s": text(), "items": [{"a": text(), "b": list(range(r.randint(0, 3)))} for _ in range(r.randint(0, 4))]}
            | ({"extra": {"x": [text()]}} if i % 5 == 0 else {}) for i in range(n)]


@pytest.mark.parametrize("indent,ascii_only", [(None, False), (2, True)])
def test_many_ranges_equal_one_reader(small_ranges, tmp_path, indent, ascii_only):
    spark = small_ranges
    rows = records(120, 7) + [{"id": 1000, "s": "}{\\\"" * 700, "items": None}, {"id": 1001}]
    for k, some in enumerate((rows, records(3, 1), [])):
        (tmp_path / f"f{k}.json").write_text(json.dumps(some, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    paths = [str(tmp_path / f"f{k}.json") for k in range(3)]
    got = io.read_json_records(spark, paths, SCHEMA)
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(paths)
    key = lambda x: str(x)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() == len(rows) + 3
    parts = split_records(spark, paths[0])
    assert spark.read.option("lineSep", "}").text(paths[0]).rdd.getNumPartitions() > 10
    assert [json.loads(r.record) for r in parts.orderBy("pos").collect()] == rows


def test_scan_takes_escapes_and_both_string_states():
    #   brackets outside: [ { [ ] }   then } is in a string   then the string ends: }
    pieces = ['[{"a": [1]', ',"é', r'\"{" : "\\"']
    assert [x.tolist() for x in scan(pieces, "}")] == [[2, 3, 6], [1, 1, 0], [0, -1, 0]]
    with pytest.raises(ValueError):
        scan(["a\\", "b"], "}")


@pytest.mark.parametrize("bad", ['[{"id": 1}', '[{"id": 1}, {"id": 2', '[{"id": 1, "s": "x}]', '[{"id": 1}] {"id": 2}', '[{"id": 1}, 7]', '[7, {"id": 1}]'])
def test_cut_or_mixed_arrays_are_errors(spark, tmp_path, monkeypatch, bad):
    monkeypatch.setattr(io, "ONE_TASK_BYTES", 0)
    p = tmp_path / "bad.json"
    p.write_text(bad)
    with pytest.raises(Exception):
        io.read_json_records(spark, str(p), "id long, s string").collect()


def test_category_maps_keep_the_order_of_the_file(small_ranges, tmp_path):
    r = random.Random(2)
    data = {f"c{k} ]\"{{": [r.choice(['a', 'b "]', '[x', 'é}', 'long ' * 90]) + str(r.randint(0, 9)) for _ in range(r.randint(0, 12))] for k in range(40)}
    for indent in (None, 1):
        p = tmp_path / f"m{indent}.json"
        p.write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")
        rows = io.read_category_map(small_ranges, str(p)).orderBy("position").collect()
        assert [(x.category, x.instruction) for x in rows] == [(c, i) for c, items in data.items() for i in items]
    want = {i: c for c, items in data.items() for i in items}
    got = {x.instruction: x.category for x in io.invert_category_map(io.read_category_map(small_ranges, str(p))).collect()}
    assert got == want
