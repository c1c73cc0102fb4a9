import pytest

from factloom import storage


def test_scratch_tables_are_read_back_and_deleted(spark):
    df = storage.materialize(spark.range(5), "five")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert df.count() == 5
    storage.discard(df)
    from pathlib import Path

    assert not Path(folder).exists()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "spark://host:7077" if key == "spark.master" else default

    with pytest.raises(ValueError):
        storage.scratch_dir(Session)
