import pytest

from slovomer.sources import shared


class _Session:
    """A session that says which master it has."""

    def __init__(self, master, folder=None):
        self.master, self.folder, self.sparkContext, self.conf = master, folder, self, self
        self.applicationId = "app"

    def get(self, name, default=None):
        return self.folder

    def getConf(self):
        return self


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        shared.shared_folder(_Session(master))
    assert shared.shared_folder(_Session(master, "hdfs://name/x/")) == "hdfs://name/x"


def test_own_folder_in_local_mode():
    assert shared.shared_folder(_Session("local[2]")).startswith("file://")
