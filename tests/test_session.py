import pytest

from quire import session


def test_blocks_clear_their_scratch(spark):
    with session.cleared(spark) as outer:
        kept = session.materialise(spark.range(3), "kept")
        with session.cleared(spark) as inner:
            gone = session.materialise(spark.range(5), "gone")
            assert gone.count() == 5 and len(inner) == 1
        assert session.listed(spark, inner[0]) == [] and kept.count() == 3
        path = outer.pop()
    assert session.listed(spark, path) and kept.count() == 3
    session.discard(spark, kept)
    assert session.listed(spark, path) == []


def test_a_failing_block_clears_its_scratch_too(spark):
    with pytest.raises(ZeroDivisionError), session.cleared(spark) as own:
        session.materialise(spark.range(3), "x")
        raise ZeroDivisionError
    assert session.listed(spark, own[0]) == []


class Cluster:
    """As much of a session without a checkpoint folder as checkpoint_root looks at."""

    def __init__(self, master: str):
        self.conf = self.sparkContext = self._jsc = self
        self.master = master

    def get(self, name, default=None):
        return default

    getConf = sc = getCheckpointDir = lambda self: self

    def isEmpty(self):
        return True


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Cluster(master))


def test_small_files_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    for text in ("{}", "é"):
        session.write_text(spark, path, text)
        assert (tmp_path / "a/b.json").read_text(encoding="utf-8") == text
    assert session.listed(spark, f"{tmp_path}/none") == []
