import pytest

from panelwright.llm import common


class Conf:
    def get(self, key, default=None):
        return default


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master):
        self.conf, self.sparkContext = Conf(), Context(master)


def test_an_unset_folder_is_an_error_on_a_cluster():
    with pytest.raises(ValueError):
        common.shared_dir(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(Session("local-cluster[3,2,1000]"))
    assert common.shared_dir(Session("local[4]")).startswith("file:///")


def test_stored_tables_are_in_the_shared_folder(spark):
    made = common.stored(spark.range(3))
    assert made.inputFiles()[0].startswith("file:") and made.count() == 3
    assert common.stored(spark.range(0)).count() == 0
