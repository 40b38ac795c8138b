import pytest

from pagescan import storage


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, master, folder=None):
        self.conf = Conf({storage._SETTING: folder} if folder else {})
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return Conf()


def test_the_session_names_the_folder():
    assert storage.shared_folder(Session("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        storage.shared_folder(Session("spark://host:7077"))


def test_local_sessions_get_one_folder():
    session = Session("local[2]")
    assert storage.shared_folder(session) == storage.shared_folder(session)


def test_written_tables_read_back(spark):
    rows = storage.Workspace(spark, "test").write(spark.range(10), "t")
    assert rows.count() == 10
