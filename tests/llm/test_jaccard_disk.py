"""What the Jaccard join leaves on disk, and groups of one block beside groups of several."""

import os

import numpy as np
import pytest

from bandweave import session
from bandweave.llm import jaccard


@pytest.mark.parametrize("block", [2, 128])
def test_blocks_go_once_their_pairs_are_known(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path / "shared"))
    words = [f"w{i}" for i in range(40)]
    # Three chains of texts, each text without one word of the one before; and texts that link with nothing.
    rows = [(100 * c + i, " ".join(f"c{c}{w}" for w in words[i : 36 + i])) for c in range(3) for i in range(5)]
    rows += [(900, ""), (901, None), (902, "alone")]
    found = {r.doc: r.component for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 3).collect()}
    assert found == {k: k // 100 * 100 if k < 900 else k for k, _ in rows}
    left = os.listdir(tmp_path / "shared")
    assert not any(x.startswith(("jaccard-blocks", "jaccard-apart", "jaccard-roots")) for x in left)
    assert sum(x.startswith("links") for x in left) <= 4  # the last of each search for components


def test_a_clean_write_leaves_the_setting_as_it_was(spark):
    rows = spark.range(10).repartition(3, "id")
    for value in (None, "false"):
        if value:
            spark.conf.set(session.CLEANUP, value)
        assert session.materialize(rows, clean=True).count() == 10
        assert spark.conf.get(session.CLEANUP, None) == value
    spark.conf.unset(session.CLEANUP)


def test_sketches_are_two_bytes_a_shingle_and_hold_all_bits():
    items = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    raw = jaccard.sketch(items)
    assert len(raw) <= 2 * len(items) + 64
    assert np.array_equal(jaccard.sketched(raw), np.sort((items & np.uint64((1 << jaccard.SHORT) - 1)).astype(np.uint32)))
    assert not len(jaccard.sketched(jaccard.sketch(items[:0])))


@pytest.mark.parametrize("block", [2, 128])
def test_slices_find_the_same_links_and_leave_no_texts(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(jaccard, "ROOM", 1)
    monkeypatch.setattr(jaccard, "SLICES", 2)
    monkeypatch.setattr(jaccard, "MOST_SLICES", 2)
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path / "shared"))
    words = [f"w{i}" for i in range(40)]
    rows = [(100 * c + i, " ".join(f"c{c}{w}" for w in words[i : 36 + i])) for c in range(2) for i in range(4)]
    rows += [rows[0], (None, rows[1][1]), (900, "")]  # copies, with and without id
    found = sorted(((r.doc, r.component) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 3).collect()), key=str)
    assert found == sorted(((k, 0 if k is None else k // 100 * 100 if k < 900 else k) for k, _ in rows), key=str)
    assert not any(x.startswith(("jaccard-texts", "jaccard-shared", "jaccard-nodes", "jaccard-pairs")) for x in os.listdir(tmp_path / "shared"))


def test_only_the_last_table_stays(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path / "shared"))
    kept = spark.range(3)
    with session.temporary_tables(spark):
        for name in ("one", "two"):
            with session.temporary_tables(spark):
                within = session.materialize(kept, "within", codec="zstd")
                kept = session.materialize(within.selectExpr("id + 1 as id"), name)
    assert [x.split("-")[0] for x in os.listdir(tmp_path / "shared")] == ["two"] and sorted(r.id for r in kept.collect()) == [2, 3, 4]
    assert session._written is None
