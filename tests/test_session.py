"""Where intermediates go."""

from __future__ import annotations

import pytest

from runlens import session


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, setting=None, folder=None):
        self.sparkContext = FakeContext(master, folder)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_the_setting_wins():
    fake = FakeSession("yarn", "hdfs:///shared/tmp/", "hdfs:///other")
    assert session.shared_dir(fake) == "hdfs:///shared/tmp"
    assert session.scratch_path(fake, "x").startswith("hdfs:///shared/tmp/runlens/x-")


def test_a_checkpoint_folder_set_in_code_is_used():
    assert session.shared_dir(FakeSession("yarn", None, "s3://b/c")) == "s3://b/c"


def test_a_cluster_gets_no_local_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("spark://host:7077"))


def test_a_local_master_may_use_a_temporary_folder():
    fake = FakeSession("local[2]")
    first = session.shared_dir(fake)
    assert first and session.shared_dir(fake) == first


def test_a_scope_removes_what_was_written_in_it(spark):
    import os
    from runlens.session import materialize, scratch_scope

    def there(df):
        return os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    before = materialize(spark.range(3), "kept")
    with scratch_scope(spark):
        outer = materialize(spark.range(4), "outer")
        with scratch_scope(spark):
            inner = materialize(spark.range(5), "inner")
            files = [df.inputFiles()[0].removeprefix("file://") for df in (outer, inner)]
            assert inner.count() == 5
        assert not os.path.exists(files[1]) and os.path.exists(files[0])
    assert not os.path.exists(files[0]) and there(before)
