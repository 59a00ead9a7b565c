from docweft.durable import ensure_checkpoint_dir, scratch, stored


def test_stored_rows_lie_in_the_shared_folder(spark):
    d = stored(spark.range(10))
    assert d.count() == 10 and all(ensure_checkpoint_dir(spark).rstrip("/").rsplit("/", 1)[-1] in f for f in d.inputFiles())
    assert scratch(spark) != scratch(spark)
