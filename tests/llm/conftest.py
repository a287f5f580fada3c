import pytest
from odd_tables import BENCHMARK, DOCS, LABELS, TALKS, odd_documents


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, repeats, long texts and clashing columns."""
    path = tmp_path_factory.mktemp("odd")
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    write(odd_documents(), DOCS, "documents")
    write([(1, 1, 0, "t"), (1, 1, None, None), (2, 0, 1, "t"), (3, None, None, None), (None, 1, 0, None), (5, 1, 0, "x"), (6, 0, 0, "x"), (7, 7, 0, "x"), (8, 1, 0, None), (8, 0, 0, None), (99, 1, 1, "none")], LABELS, "labels")
    write([(1, "What is 12 km plus 30 km for Anna on the long road to town?", 1), (1, "What is 12 km plus 30 km for Anna on the long road to town?", 1), (None, "short one", 2), (2, None, 3), (3, "", 4)], BENCHMARK, "benchmark")
    write([(1, 0, "user", "hi", 1, "t"), (1, 1, "assistant", None, 1, "t"), (1, 1, "assistant", "twice", 1, "t"), (1, None, None, "no turn", 1, "t"), (None, 0, "user", "no id", 1, "t"), (2, 0, "assistant", "a\\ </s> [INST] \\[/INST]<s>", 1, "t"), (3, 0, "user", "", 1, "t")], TALKS, "conversations")
    return str(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", BENCHMARK), ("conversations", TALKS)):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
