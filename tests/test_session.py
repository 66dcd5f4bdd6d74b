import pytest

from bandweave.session import materialize, release


def test_release_deletes_its_own_table_only(spark, tmp_path):
    kept, gone = materialize(spark.range(5), "kept"), materialize(spark.range(5), "gone")
    release(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist"):
        gone.count()
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        release(spark.read.parquet(str(tmp_path / "own")))
    release(materialize(spark.range(0), "empty"))
