import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_graph(spark):
    """edges given as 'a>b c>d' (kind Imports) -> (nodes, edges) of one project."""

    def make(text, project="p", kind="Imports", more_nodes=()):
        pairs = [x.split(">") for x in text.split()]
        rows = [(project, a, b, kind, 1, k + 1, 1.0, "Extracted") for k, (a, b) in enumerate(pairs)]
        edges = spark.createDataFrame(rows, "project string, src string, dst string, kind string, weight long, line long, confidence double, confidence_kind string")
        ids = sorted({x for p in pairs for x in p} | set(more_nodes))
        nodes = spark.createDataFrame([(project, i, "Module", f"{i}.py", "Python", 1, True, []) for i in ids], "project string, id string, kind string, file_path string, language string, line long, is_local boolean, alternative_paths array<string>")
        return nodes, edges

    return make
