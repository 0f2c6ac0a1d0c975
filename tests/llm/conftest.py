import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder_of(spark, tmp_path):
    """A data folder with the given documents (and other tables) as Parquet."""

    def make(documents, **tables):
        spark.createDataFrame(documents, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
