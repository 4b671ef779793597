from loomdex.session import clear_cuts, cut, fits_broadcast, shared_dir


def test_cut_and_clear(spark):
    import os

    df = cut(spark.range(5), "five")
    assert df.count() == 5 and fits_broadcast(df, 5) and not fits_broadcast(df, 4)
    folder = f"{shared_dir(spark)}/loomdex/{spark.sparkContext.applicationId}".removeprefix("file://")
    assert any(name.startswith("five-") for name in os.listdir(folder))


def test_clear(spark, monkeypatch, tmp_path):
    from loomdex import session

    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    cut(spark.range(3), "three")
    clear_cuts(spark)
    assert not list((tmp_path / "loomdex").glob("*"))
