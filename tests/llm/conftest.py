import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gatewell.llm.shipping import ship  # noqa: E402
from texts_for_tests import prose  # noqa: E402


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Small documents with copies, near copies, shared passages and odd cases."""
    found: dict[int, str | None] = {0: None, 1: "", 2: " \n ", 3: "one", 4: "ONE", 5: "a b c d"}
    shared = " ".join(prose(999, 60))
    for k in range(10, 40):
        words = prose(k, 150)
        if k % 3 == 0:
            words[40:40] = shared.split()
        found[k] = " ".join(words)
    for k in range(40, 60):  # near copies of one document, each with its own changes
        words = prose(11, 150)
        for j in range(k - 40):
            words[(7 * j * k) % 150] = f"x{k}{j}"
        found[k] = " ".join(words)
    for k in range(60, 70):
        found[k] = found[12].upper() if k % 2 else found[12]
    found[70] = "a" * 3000
    found[71] = "é ß " * 400 + "ab" * 300
    found[72] = " ".join(prose(5, 4000))
    found[73] = found[72] + " tail"
    return found


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with columns that clash with names the operators use inside."""
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), k, "x", 1) for k, t in texts.items()]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
              "key bigint, id string, kept int").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < 0")
