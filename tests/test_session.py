"""Where shared tables go."""

import pytest

from diffloom.session import scratch_root


class Conf(dict):
    """Settings of a session that is not started."""

    @property
    def conf(self):
        return self


def test_named_folder_is_taken():
    assert scratch_root(Conf({"spark.checkpoint.dir": "s3://b/x/", "spark.master": "yarn"})) == "s3://b/x"


def test_local_session_falls_back_to_its_warehouse():
    assert scratch_root(Conf({"spark.sql.warehouse.dir": "/w/", "spark.master": "local[8]"})) == "/w/_scratch"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host"])
def test_cluster_without_shared_folder_raises(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Conf({"spark.sql.warehouse.dir": "file:/w", "spark.master": master}))
