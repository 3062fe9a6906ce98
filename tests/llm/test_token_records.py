"""Token records: brute force, round trips, damage, splits, shuffled reads, retried tasks and odd rows."""

import glob
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm import token_records as tr
from strataframe.llm.queries import LLM_QUERIES, TOKENIZER
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.01"


def brute_force(docs):
    """(doc_id, start, n_tokens, crc) in id order by an unchanged tokenizer."""
    model = Tokenizer.from_file(TOKENIZER)
    start, out = 0, []
    for doc_id, text in sorted(docs):
        ids = np.asarray(model.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op13_token_records"](spark, SF)
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute_force(docs), key=repr)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('records')}/set"
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    tr.write_token_records(docs, path, TOKENIZER)
    return path


def test_ids_come_back_in_order(spark, written):
    rows = tr.read_records(spark, written).collect()  # in the order of the files
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert all(r.n_tokens * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    model = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows[::50]:
        assert model.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist()) == (texts[r.doc_id] or "")
    numbers = tr.read_records(spark, written).select("doc_id", tr.id_array("ids").alias("n")).first()
    assert numbers.n == np.frombuffer(rows[0].ids, "<u4").tolist()


def test_splits_of_files_give_the_same_rows(spark, written):
    small = tr.read_records(spark, written, split_bytes=10_000)
    assert small.rdd.getNumPartitions() > 50
    columns = ("file", "record", "doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(small, *columns) == rows_of(tr.read_records(spark, written, with_ids=False), *columns)


def test_files_by_hand(spark, written):
    """Framing, masked checksums, index and manifest, read without the library."""
    root = written.removeprefix("file://")
    for entry in map(json.loads, open(f"{root}/_manifest.jsonl")):
        data, index = (open(f"{root}/{entry['file']}.{kind}", "rb").read() for kind in ("rec", "idx"))
        rows = np.frombuffer(index[8:], "<u8").reshape(-1, 2)
        assert index[:8] == b"TKRINDEX" and len(rows) == entry["records"] + 1
        assert rows[-1].tolist() == [len(data), entry["ids"]] == [entry["bytes"], entry["ids"]]
        for (at, before), (end, after) in zip(rows[:-1].tolist(), rows[1:].tolist()):
            size, check = struct.unpack_from("<QI", data, at)
            crc = zlib.crc32(data[at : at + 8])
            assert check == ((crc >> 15 | crc << 17) + 0xA282EAD8) % 2**32
            assert struct.unpack_from("<I", data, at + 20)[0] == 3 and end == at + 16 + size and (size - 12) // 2 == after - before
    assert not [f for f in os.listdir(root) if f.startswith(".") and not f.endswith(".crc")]


def test_wide_and_narrow_ids(spark, tmp_path):
    """Ids up to 32 bits come back; those below 65,536 take two bytes."""
    path = str(tmp_path / "set")
    ids = {1: [0, 65_535], 2: [65_536], 3: [2**32 - 1, 5], None: []}
    rows = [(d, np.asarray(n, "<u4").tobytes()) for d, n in ids.items()]
    tr.write_records(spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1), path)
    got = tr.read_records(spark, path).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == ids
    assert [r.end - r.offset for r in tr.record_index(spark, path).orderBy("record").collect()] == [32, 32, 36, 28]


def test_shuffled_reads_are_permutations(spark, written):
    plain = {(r.doc_id, r.ids) for r in tr.read_records(spark, written).collect()}
    one = tr.shuffled_records(spark, written, 1).collect()
    again = tr.shuffled_records(spark, written, 1).collect()
    two = tr.shuffled_records(spark, written, 2).collect()
    assert {(r.doc_id, r.ids) for r in one} == plain == {(r.doc_id, r.ids) for r in two} and len(one) == len(plain)
    assert one == again and [r.doc_id for r in one] != [r.doc_id for r in two]
    assert [r.place for r in one] == sorted(r.place for r in one)
    ids = [r.doc_id for r in one]
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.15


@pytest.mark.parametrize("at", [3, 9, 20, 30, -2])
def test_damage_is_found(spark, tmp_path, at):
    path = str(tmp_path / "set")
    docs = spark.createDataFrame([(1, "some words to damage here")], "doc_id long, text string").coalesce(1)
    tr.write_token_records(docs, path, TOKENIZER)
    (name,) = glob.glob(f"{path}/*.rec")
    data = bytearray(open(name, "rb").read())
    data[at] ^= 4
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="no record begins|is damaged"):
        tr.read_records(spark, path).collect()


def test_what_lost_attempts_leave_is_not_read(spark, tmp_path):
    """Files of attempts that were not committed are deleted by the commit; without a manifest nothing is read."""
    path = str(tmp_path / "set")
    os.makedirs(path)
    for kind in ("rec", "idx"):
        open(f"{path}/part-000000-dead.{kind}", "wb").write(b"junk")
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="manifest"):
        tr.read_records(spark, path).collect()
    tr.write_token_records(docs, path, TOKENIZER)
    assert [r.doc_id for r in tr.read_records(spark, path).collect()] == [1, 2]
    assert not glob.glob(f"{path}/*dead*")
    with pytest.raises(Exception, match="holds records already"):
        tr.write_token_records(docs, path, TOKENIZER)
    tr.write_token_records(docs.filter("doc_id = 2"), path, TOKENIZER, overwrite=True)
    assert [r.doc_id for r in tr.read_records(spark, path).collect()] == [2]
    assert len(glob.glob(f"{path}/*.rec")) == 1


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path / "odd")
    tr.write_token_records(odd_docs, path, TOKENIZER)
    rows = tr.read_records(spark, path).collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    by_id = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows if r.doc_id is not None}
    known = [(r.doc_id, r.text) for r in odd_docs.filter("doc_id is not null").distinct().collect()]
    assert by_id == {d: (n, c) for d, _, n, c in brute_force(known)}
    empty = str(tmp_path / "none")
    tr.write_token_records(no_docs, empty, TOKENIZER)
    assert tr.read_records(spark, empty).count() == tr.record_index(spark, empty).count() == 0
    assert tr.shuffled_records(spark, empty, 1).count() == 0


def test_a_frequent_id_is_spread_over_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).repartition(4)
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tr.write_token_records(rows, path, TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [e["records"] for e in tr.read_manifest(path)]
    assert sum(sizes) == 4000 and max(sizes) < 1500
