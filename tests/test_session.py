from types import SimpleNamespace

import pytest

from weftline.session import shared_dir


class Context:
    def __init__(self, master: str, named: str | None):
        self.master, self.named, self.folder = master, named, None

    def getConf(self) -> dict:
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def getCheckpointDir(self) -> str | None:
        return self.folder

    def setCheckpointDir(self, folder: str) -> None:
        self.folder = folder


def shared(master: str, named: str | None = None) -> str:
    return shared_dir(SimpleNamespace(sparkContext=Context(master, named)))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_master_gets_a_folder_of_its_own(master):
    assert "weftline-" in shared(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared(master)
    assert shared(master, "s3a://bucket/shared") == "s3a://bucket/shared"
