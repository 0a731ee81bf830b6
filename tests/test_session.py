import os
from types import SimpleNamespace

import pytest

from tablelens import session as S


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getCheckpointDir(self):
        return self.folder


def session(master, configured):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=Context(master))


def test_configured_folder_is_used_as_it_is():
    assert S.shared_dir(session("yarn", "hdfs://lake/cut/")) == "hdfs://lake/cut"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError):
        S.shared_dir(session("yarn", None))


def test_a_local_session_keeps_its_own_folder():
    local = session("local[2]", None)
    assert S.shared_dir(local) == S.shared_dir(local)


def test_cut_lineage_goes_on_from_a_written_table(spark):
    cut = S.cut_lineage(spark.range(5).withColumnRenamed("id", "a b"))
    assert cut.count() == 5 and all(S.shared_dir(spark).split(":")[-1] in f for f in cut.inputFiles())


def test_folders_of_a_scope_go_unless_they_are_read(spark):
    before = S.cut_lineage(spark.range(3))
    with S.cut_folders() as made:
        first, second = S.cut_lineage(spark.range(5)), S.cut_lineage(spark.range(7))
    assert len(made) == 2 and first.count() == 5

    def there(folder):
        return os.path.exists(folder.removeprefix("file:"))

    assert S.discard(spark, made, but=second.filter("id > 1")) == made[1:]
    assert not there(made[0]) and there(made[1]) and before.count() == 3 and second.count() == 7
    assert S.discard(spark, made) == [] and not there(made[1])
